"""A corpus pipeline of five of the operators, each stage on what the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of ``docs``.  Rows are
told apart by a 128-bit hash of id and text: rows that share both are one
document.  ``run`` writes each stage's result to the shared scratch folder and
reads it back for the next.

Edge cases, by stage: null and empty texts fail the quality rules and go; such
rows given to a later stage stay (they hold no shingle, window or secret) and
have size 0 in the mix.  Of rows with equal id and text near-dedup leaves the one
that is first as JSON; of a group, the one with the smallest id, and among equal
ids the smallest row key.  Null ids come after all others.  Extra columns go
along, whatever their names; columns whose names the stages use themselves are
renamed while a stage runs.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm.common import materialize, read, row_key
from relspark.llm.decontamination import contamination
from relspark.llm.mixing import mix_sources
from relspark.llm.near_dedup import near_duplicates
from relspark.llm.quality_rules import quality_rules
from relspark.llm.secrets import redacted, secret_scan

#: Key tables (16 bytes a row) are broadcast up to this many rows and joined by a shuffle beyond.
MAX_BROADCAST_ROWS = 1_000_000
#: Words of a shingle in near-dedup, as in op8.
SHINGLE = 4


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """Each row whole in ``doc``, so that no column of it clashes with what a stage adds; its key; and ``names`` beside it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), row_key("doc_id", "text").alias("row_key"), *names)


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= MAX_BROADCAST_ROWS else keys


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules(_packed(docs, "text", "lang").drop("row_key"), keep=["doc"]).where("kept").select("doc.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    found = materialize(near_duplicates(docs, shingle=SHINGLE).select("row_key", "stays"), "pipeline-near")
    drop = materialize(found.where(~F.col("stays")).select("row_key").distinct(), "pipeline-drop")
    out = _packed(docs).join(_small(drop), "row_key", "left_anti")
    again = materialize(found.where("stays").groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_key"), "pipeline-again")
    if not again.isEmpty():  # repeated rows: one of each stays
        again = _small(again)
        once = out.join(again, "row_key", "left_semi").groupBy("row_key").agg(F.min_by("doc", F.to_json("doc")).alias("doc")).select("doc", "row_key")
        out = out.join(again, "row_key", "left_anti").unionByName(once)
    return out.select("doc.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = contamination(docs, read(spark, sf_dir, "benchmark"))
    drop = materialize(found.where("contaminated").select("row_key").distinct(), "pipeline-drop")
    return _packed(docs).join(_small(drop), "row_key", "left_anti").select("doc.*")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced in the text; widely copied examples stay."""
    found = secret_scan(docs).where("n_live > 0").groupBy("row_key").agg(F.first("live").alias("live"))
    found = _small(materialize(found, "pipeline-live"))
    rows = _packed(docs).join(found, "row_key", "left").withColumn("clean", redacted("doc.text", "live"))
    hit = F.col("live").isNotNull()
    changed = {"text": F.col("clean"), "n_chars": F.length("clean")}
    return rows.select(*((F.when(hit, changed[c].cast(docs.schema[c].dataType)).otherwise(F.col(f"doc.`{c}`")) if c in changed else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the words that the mix takes of it."""
    return mix_sources(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret scan", secrets_stage),
    ("mixing", mixing_stage),
]

#: SQL can't state the stages; the tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "stage-" + name.replace(" ", "-"))
    return docs
