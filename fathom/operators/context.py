"""Context assembly: priority, token budget, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.dense import col

#: Ages in seconds up to which recency has a factor, and agreement from which diversity has a bonus (fixed values).
RECENCY = ((3600, 1.3), (86400, 1.2), (604800, 1.1), (2592000, 1.0))
DIVERSITY = ((5.0, 1.5), (2.5, 1.2), (1.0, 1.0))
REST = 0.8


def recency_factor(age: Column) -> Column:
    out = F.when(age < RECENCY[0][0], RECENCY[0][1])
    for limit, f in RECENCY[1:]:
        out = out.when(age < limit, f)
    return out.otherwise(REST)


def diversity_bonus(agreement: Column) -> Column:
    out = F.when(agreement >= DIVERSITY[0][0], DIVERSITY[0][1])
    for limit, f in DIVERSITY[1:]:
        out = out.when(agreement >= limit, f)
    return out.otherwise(REST)


def category(agreement: Column) -> Column:
    return F.when(agreement >= 2.5, "cluster").when(agreement >= 1.0, "single").otherwise("none")


def token_estimate(text: Column | str) -> Column:
    """ceil(words * 1.3), kept free of rounding by whole numbers."""
    n = F.size(F.filter(F.split(col(text), r"\s+"), lambda w: w != "")).cast("long")
    return F.floor((n * 13 + 9) / 10).cast("long")


#: Tokens of a context and of each category's share; the first two may take what is left beyond their share (fixed values).
BUDGET = {"total": 1200, "divergence": 200, "cluster": 400, "single": 300, "session": 200}
OVERFLOWING = ("divergence", "cluster")


def budgets(total: int) -> dict[str, int]:
    """Shares in proportion for another total."""
    return {k: BUDGET[k] * total // BUDGET["total"] for k in BUDGET} | {"total": total}


def budget(df: DataFrame, group: str, order: list[Column], tokens: str, total: int = 1200, category: str | None = None) -> DataFrame:
    """Rows of each group in order, each taken if it still fits the total and, with a category, its category's share or may go beyond it.

    Returns (group, id, tokens) of what was taken; ids come from column id. A fold over the group's candidates, which retrieval has bounded;
    what is kept has a token at least each, so it is bounded by the total.
    """
    shares = budgets(total)
    kind = F.col(category) if category else F.lit("cluster")
    rows = df.select(group, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("id"), F.col(tokens).cast("long").alias("t"), kind.alias("c")).alias("r"))
    sorted_rows = rows.groupBy(group).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    names = [k for k in BUDGET if k != "total"]
    start = F.struct(F.lit(0).cast("long").alias("used"), *[F.lit(0).cast("long").alias(k) for k in names], F.array().cast("array<struct<id:bigint,t:bigint>>").alias("kept"))

    def take(acc: Column, r: Column) -> Column:
        inside = F.lit(False)
        for k in names:
            inside = inside | ((r["c"] == k) & ((acc[k] + r["t"] <= shares[k]) | F.lit(k in OVERFLOWING)))
        fits = (acc["used"] + r["t"] <= total) & inside
        spent = [F.when(fits & (r["c"] == k), acc[k] + r["t"]).otherwise(acc[k]).alias(k) for k in names]
        kept = F.when(fits, F.concat(acc["kept"], F.array(F.struct(r["id"].cast("long").alias("id"), r["t"].alias("t"))))).otherwise(acc["kept"])
        return F.struct(F.when(fits, acc["used"] + r["t"]).otherwise(acc["used"]).alias("used"), *spent, kept.alias("kept"))

    return sorted_rows.select(group, F.explode(F.aggregate("rs", start, take)["kept"]).alias("k")).select(group, F.col("k.id").alias("id"), F.col("k.t").alias("tokens"))


def summary(text: Column | str, words: int = 20) -> Column:
    """The first words, with dots if there were more."""
    own = F.filter(F.split(col(text), r"\s+"), lambda w: w != "")
    return F.concat(F.array_join(F.slice(own, 1, words), " "), F.when(F.size(own) > words, "...").otherwise(""))


def time_ago(age: Column) -> Column:
    part = lambda unit, name: F.concat(F.floor(age / unit).cast("string"), F.lit(f"{name} ago"))
    return F.when(age < 60, "just now").when(age < 3600, part(60, "m")).when(age < 86400, part(3600, "h")).otherwise(part(86400, "d"))


#: Tokens of a brief context, and words of a summary (fixed values).
BRIEF, SUMMARY = 200, 20


def ranked_candidates(found: DataFrame, age: Column) -> DataFrame:
    """found with category, tokens and priority; memories that agree too little are left out.

    found has id, content, relevance, agreement and what age needs; priority is relevance times the factors of recency and diversity.
    """
    kind = category(F.col("agreement"))
    rows = found.withColumns({"age": age, "category": kind, "tokens": token_estimate("content")}).where("category != 'none'")
    return rows.withColumn("priority", F.col("relevance") * recency_factor(F.col("age")) * diversity_bonus(F.col("agreement")))


def selected(candidates: DataFrame, total: int = 1200) -> DataFrame:
    """Of ranked candidates those that the budget and its shares hold, by category, then priority, then id, with place from 1."""
    first = F.when(F.col("category") == "cluster", 0).otherwise(1)
    kept = budget(candidates.withColumn("one", F.lit(1)), "one", [first, -F.col("priority")], "tokens", total, "category")
    rows = candidates.join(kept.select("id"), "id")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(first, F.desc("priority"), "id")))  # as many rows as the budget has tokens


def full_context(chosen: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row (text, tokens, memories): sections of related work, of what may be related, and of spaces that shifted; an empty text without any."""
    lines = chosen.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("place", F.when(F.col("category") == "cluster", F.concat(F.lit("- **"), time_ago(F.col("age")), F.lit("**: "), summary("content", SUMMARY))).otherwise(F.concat(F.lit("- "), summary("content", SUMMARY), F.lit(" ("), time_ago(F.col("age")), F.lit(")"))).alias("line")))).alias("ls"))
    part = lambda kind: F.max(F.when(F.col("category") == kind, F.array_join(F.transform("ls", lambda x: x["line"]), "\n")))
    own = lines.agg(part("cluster").alias("cluster"), part("single").alias("single"))
    ids = chosen.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("memories"))
    shifts = alerts.agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), F.col("space"), F.lit(": "), F.col("severity")))), "\n").alias("shifts"))  # 13 spaces at most
    section = lambda title, body: F.when(body.isNotNull() & (body != ""), F.concat(F.lit(f"### {title}\n"), body))
    body = F.concat_ws("\n\n", section("Recent Related Work", F.col("cluster")), section("Potentially Related", F.col("single")), section("Note: Activity Shift Detected", F.col("shifts")))
    joined = own.crossJoin(ids).crossJoin(shifts).withColumn("text", F.when(body != "", F.concat(F.lit("## Relevant Context\n\n"), body)).otherwise(""))  # one row each
    return joined.select("text", token_estimate("text").alias("tokens"), "memories")


def brief_context(chosen: DataFrame) -> DataFrame:
    """One row (text, tokens, memories): the summaries side by side."""
    own = chosen.agg(F.array_sort(F.collect_list(F.struct("place", "id", summary("content", SUMMARY).alias("s")))).alias("rows"))
    text = F.when(F.size("rows") > 0, F.concat(F.lit("Related: "), F.array_join(F.transform("rows", lambda x: x["s"]), "; "))).otherwise("")
    return own.select(text.alias("text"), token_estimate(text).alias("tokens"), F.transform("rows", lambda x: x["id"]).alias("memories"))
