"""Helpers that all corpus operators share: shared scratch tables, row keys, text rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.sources.scratch import drop_scratch, materialize, scratch_path

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of an Arrow batch on its way to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small where the session allows larger ones: texts are long, and batches count twice, in the JVM and in Python."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        n, unit = re.match(r"(-?\d+)([kmgt]?)", spark.conf.get(key).lower()).groups()
        now = int(n) * 1024 ** " kmgt".index(unit or " ")
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(doc_id: str, text: str) -> Column:
    """16 bytes that tell rows apart by id and text; rows that share both are one document."""
    a, b = F.col(doc_id), F.col(text)
    return F.unhex(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in (F.xxhash64(a, b), F.xxhash64(b, a)))))


def crc_mod(col: str, mod: int):
    """crc32 of the value's decimal text, modulo ``mod``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


__all__ = ["BATCH_BYTES", "BATCH_ROWS", "SPACE", "WORD", "bounded_batches", "crc_mod", "drop_scratch", "materialize", "read", "row_key", "scratch_path"]
