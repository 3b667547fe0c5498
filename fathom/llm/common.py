"""What the operators share: the folder all executors see, written tables, and worker-wide caches."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one slice that Python holds at a time; long texts are further cut by bytes.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20
#: Bytes of an Arrow batch where rows carry whole texts or sets.
BATCH_BYTES = 8 << 20


#: Where written tables lie while a scope holds.
SCOPE = "fathom.llm.scope"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or under the scope's. Where that is unset, a local session (tests) gets a folder of this machine; on a cluster that is an error."""
    root = spark.conf.get(SCOPE, None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fathom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/fathom-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost executors cost no earlier stage."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """While it holds, written tables lie in one folder, which is deleted at its end: results must be written elsewhere, or counted, inside. Scopes nest."""
    before, folder = spark.conf.get(SCOPE, None), shared_dir(spark)
    spark.conf.set(SCOPE, folder)
    try:
        yield folder
    finally:
        spark.conf.unset(SCOPE) if before is None else spark.conf.set(SCOPE, before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """While it holds, jobs hand rows to Python in Arrow batches of about that many bytes; for jobs that run inside only."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(name: str, make: Callable):
    """One object for each name and Python worker; it outlives a task when Spark reuses the worker."""
    caches = sys.__dict__.setdefault("_fathom_worker_cache", {})
    if name not in caches:
        caches[name] = make()
    return caches[name]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES):
    """Parts of a batch of at most SLICE_ROWS rows and about `most` bytes of text."""
    start, used = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist() if batch.num_rows else []
    for i, n in enumerate(lengths):
        if i > start and (used + n > most or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += n
    if start < batch.num_rows:
        yield batch.slice(start)


def utf8_bytes(text: Column | str) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front where df has such a column already (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
