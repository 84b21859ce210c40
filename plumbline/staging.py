"""Tables in the shared folder: what is read twice, or what cuts a long plan, is written once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local session may do without: it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage, is computed once, and outlives executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    sc = spark.sparkContext  # PySpark has no call of its own that deletes a folder of the shared file system
    for path in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no plan reads any more: what was made of them is stored itself."""
    for t in tables:
        _delete(t.sparkSession, [t.stored_at])
        if t.stored_at in _made:
            _made.remove(t.stored_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the tables stored inside but for those that ``keep`` names."""
    first = len(_made)
    try:
        yield
    finally:
        _delete(spark, _made[first:])
        del _made[first:]


def keep(df: DataFrame) -> DataFrame:
    """A stored table that the surrounding ``scratch`` leaves in place."""
    _made.remove(df.stored_at)
    return df
