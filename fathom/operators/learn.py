"""Losses over batches, relational layers, feedback: what trains or adapts weights, on given vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import dense

#: Temperature of the contrastive loss, margin of the directional one, rate and bounds of feedback (fixed values).
TEMPERATURE, MARGIN, RATE = 0.05, 0.2, 0.01


def batch_products(pairs: DataFrame, batch: str, cause: str, effect: str) -> DataFrame:
    """(batch, i, j, s): products of all causes with all effects of one batch, from (batch, id, cause, effect). A batch is as small as its caller makes it."""
    x = pairs.select(batch, F.col("id").alias("i"), F.col(cause).alias("x"))
    y = pairs.select(batch, F.col("id").alias("j"), F.col(effect).alias("y"))
    return x.join(y, batch).select(batch, "i", "j", dense.dot("x", "y").alias("s"))


def info_nce(products: DataFrame, batch: str, temperature: float = TEMPERATURE) -> DataFrame:
    """(batch, loss): mean of -ln softmax of the own effect among the batch's; the greatest logit is taken out first."""
    t = F.col("s") / temperature
    rows = products.groupBy(batch, "i").agg(F.max(t).alias("top"), F.collect_list(t).alias("ts"), F.max(F.when(F.col("i") == F.col("j"), t)).alias("own"))
    loss = F.log(F.aggregate("ts", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))) + F.col("top") - F.col("own")
    return rows.groupBy(batch).agg(F.avg(loss).alias("loss"))


def margin_loss(products: DataFrame, batch: str, margin: float = MARGIN) -> DataFrame:
    """(batch, loss): mean of what the own product lacks of being `margin` over the mean of the others."""
    own = F.sum(F.when(F.col("i") == F.col("j"), F.col("s")).otherwise(0.0))
    rest, n = F.sum(F.when(F.col("i") != F.col("j"), F.col("s")).otherwise(0.0)), F.count("*")
    each = products.groupBy(batch, "i").agg((own - F.when(n > 1, rest / (n - 1)).otherwise(0.0)).alias("gap"))
    return each.groupBy(batch).agg(F.avg(F.greatest(F.lit(0.0), margin - F.col("gap"))).alias("loss"))


def separation(pairs: DataFrame, batch: str, cause: str, effect: str) -> DataFrame:
    """(batch, loss): mean cosine of each cause with its own effect."""
    return pairs.groupBy(batch).agg(F.avg(dense.cosine(cause, effect)).alias("loss"))


def times(matrix: list[list[float]], vector: Column | str) -> Column:
    """A literal matrix times a vector."""
    return F.transform(F.lit(matrix).cast("array<array<double>>"), lambda row: dense.dot(row, vector))


def relational_layer(nodes: DataFrame, edges: DataFrame, own: list[list[float]], kinds: dict[str, list[list[float]]], relu: bool = True) -> DataFrame:
    """(id, h): own matrix times h, plus for each kind its matrix times the mean h of the sources of edges (a, b, kind) into the node."""
    width = len(own[0])
    parts = edges.join(nodes.select(F.col("id").alias("a"), "h"), "a").select("b", "kind", F.posexplode("h").alias("pos", "x"))
    means = parts.groupBy("b", "kind", "pos").agg(F.avg("x").alias("x")).groupBy("b", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("m"))
    means = means.select("b", "kind", F.transform("m", lambda s: s["x"]).alias("m"))
    turned = None
    for kind, matrix in kinds.items():
        turned = F.when(F.col("kind") == kind, times(matrix, "m")) if turned is None else turned.when(F.col("kind") == kind, times(matrix, "m"))
    sums = means.select("b", F.posexplode(turned).alias("pos", "x")).groupBy("b", "pos").agg(F.sum("x").alias("x")).groupBy("b").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("s"))
    sums = sums.select(F.col("b").alias("id"), F.transform("s", lambda s: s["x"]).alias("s"))
    zero = F.array_repeat(F.lit(0.0), width)
    out = F.zip_with(times(own, "h"), F.coalesce("s", zero), lambda x, y: F.greatest(x + y, F.lit(0.0)) if relu else x + y)
    return nodes.join(sums, "id", "left").select("id", out.alias("h"))


def confidence(relevance: Column, diversity: Column, novelty: Column) -> Column:
    """0.6 of relevance, 0.25 of diversity, 0.15 of novelty, within 0..1."""
    return dense.clamp(0.6 * relevance + 0.25 * diversity + 0.15 * novelty)


def bounded_sums(df: DataFrame, by: str, order: list[str], step: Column, low: float = -1.0, high: float = 1.0, start: float = 0.0) -> DataFrame:
    """(by, value, n): the fold x -> min(high, max(low, x + step)) over each group's rows in order, for groups of any size.

    Such a step maps x to min(hi, max(lo, x + a)), and two of these maps make one of the same kind. Rows are dealt by ranges of
    (by, order), so a group may lie in many tasks; each makes one map of its run, and a group's maps, one a task, are applied in turn.
    Null steps count as 0.
    """
    rows = df.select(F.col(by).alias("g"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.coalesce(step.cast("double"), F.lit(0.0)).alias("step"))
    keys = [f"o{i}" for i in range(len(order))]
    dealt = rows.repartitionByRange("g", *keys).withColumn("run", F.spark_partition_id()).sortWithinPartitions("g", *keys)
    kind = dict(rows.dtypes)["g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for g, number, x in zip(batch.column("g").to_pylist(), batch.column("run").to_pylist(), batch.column("step").to_pylist(), strict=True):
                if held is None or g != held[0]:
                    if held is not None:
                        out.append(held)
                    held = [g, number, 0.0, -math.inf, math.inf, 0]
                held[2] += x
                held[3] = min(high, max(low, held[3] + x))
                held[4] = min(high, max(low, held[4] + x))
                held[5] += 1
            yield from _maps(out, batch.schema.field("g").type)
        if held is not None:
            yield from _maps([held], batch.schema.field("g").type)

    maps = dealt.select("g", "run", "step").mapInArrow(run, f"g {kind}, run int, a double, lo double, hi double, n long")
    each = maps.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("run", "a", "lo", "hi"))).alias("maps"), F.sum("n").alias("n"))  # one a task at most
    value = F.aggregate("maps", F.lit(start), lambda x, m: F.least(m["hi"], F.greatest(m["lo"], x + m["a"])))
    return each.select(F.col("g").alias(by), value.alias("value"), "n")


def _maps(held: list[list], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    if held:
        kinds = (kind, pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["g", "run", "a", "lo", "hi", "n"])


def learned_weights(feedback: DataFrame, query: str, order: list[str], verdict: str, rate: float = RATE) -> DataFrame:
    """(query, weight, updates): feedback (positive, negative, neutral) in its order, each step kept within -1..1."""
    delta = F.when(F.col(verdict) == "positive", rate).when(F.col(verdict) == "negative", -rate).otherwise(0.0)
    return bounded_sums(feedback, query, order, delta).withColumnsRenamed({"value": "weight", "n": "updates"})


def query_edges(history: DataFrame, session: str, order: str) -> DataFrame:
    """(a, b): each query to the next of its session, which consolidation links."""
    from pyspark.sql import Window

    nxt = F.lead("id").over(Window.partitionBy(session).orderBy(order, "id"))
    return history.select(F.col("id").alias("a"), nxt.alias("b")).where("b is not null")
