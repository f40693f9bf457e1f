"""Tables written to the folder that driver and executors share, and read back: lineage ends at files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session in local mode (tests) may go without that setting; it then
    gets a temporary folder of its own, removed at exit.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="relspark-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/relspark-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This cuts the lineage at files that outlive any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # noqa: SLF001  for drop_scratch
    return out


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize`; nothing may read it after."""
    path = getattr(df, "_scratch_path", None)
    if path is None:
        return
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001
