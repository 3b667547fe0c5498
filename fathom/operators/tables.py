"""Written intermediate tables: lineage ends there, and any executor can read them."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Where written() puts its tables while a scope holds.
SCOPE = "fathom.tables.scope"


def _root(spark: SparkSession) -> str:
    root = spark.conf.get(SCOPE, None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fathom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in spark.checkpoint.dir, read again. Where that is unset, a local session (tests) gets a folder of this machine; on a cluster that is an error."""
    spark = df.sparkSession
    path = f"{_root(spark)}/tables-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """While it holds, written tables lie in one folder under spark.checkpoint.dir, which is deleted at its end: what is kept of results must be written or counted inside. Scopes nest."""
    before = spark.conf.get(SCOPE, None)
    folder = f"{_root(spark)}/scope-{uuid.uuid4().hex}"
    spark.conf.set(SCOPE, folder)
    try:
        yield folder
    finally:
        spark.conf.unset(SCOPE) if before is None else spark.conf.set(SCOPE, before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
