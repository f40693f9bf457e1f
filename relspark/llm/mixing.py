"""Mixing sources to target weights with hash-threshold histograms.

Everything is DataFrame and SQL.  Each document has a fixed 60-bit hash.  A
source's budget is met by taking all documents whose hash is below the
source's threshold, so larger budgets take supersets (nested thresholds) and no
row is ever sorted.  The threshold is found by histograms: tokens are summed by
source and leading hash bits, the bucket where the running sum crosses the
budget is found, its rows alone are written apart and summed again by the next
bits, until all bits are used.  The sizes are read three times in all: for the
first histogram (which also has the sources' sums), for the boundary buckets and
for the result.

Targets are ``min(weight * level, max_repeat * size)`` with the one level at
which they add up to ``share`` of all sizes: what resharing the excess by weight
until no target is above its limit leads to.  Each round of resharing is one sum
over the sources; a round that makes no more source full is the last.  Sources
are ranked for their weights by range partitions, whose counts alone (one row a
partition) meet in one task.

Edge cases: a null text has size 0; a null source is a source of its own, last
in order.  Rows that agree in id and text have one hash and are taken together.
A source without words has target 0.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relspark.llm.common import WORD, drop_scratch, materialize

#: Bits of the histograms, one after the other.
LEVELS = (12, 16, 16, 16)
HASH_BITS = sum(LEVELS)
#: Tables of one row a source are broadcast up to this many rows, and joined by a shuffle beyond.
MAX_BROADCAST_ROWS = 100_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def ranked_sources(sizes: DataFrame, weights: list[int]) -> DataFrame:
    """(key, source_size, weight): weights go round by code points of the sources, null last."""
    last = F.col("key") == ""
    rows = sizes.repartitionByRange(last, "key").sortWithinPartitions(last, "key").withColumn("at", F.monotonically_increasing_id())
    rows = materialize(rows.select("key", "source_size", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at")), "mix-ranked")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.pmod(F.col("before") + F.col("at"), F.lit(len(weights))) + 1).cast("int"))
    return rows.join(F.broadcast(parts), "part").select("key", "source_size", weight.alias("weight"))


def source_targets(sizes: DataFrame, weights: list[int], share: float, max_repeat: float) -> DataFrame:
    """One row a source: its size, target, whole repeats and the budget that is left for the threshold."""
    per = materialize(ranked_sources(sizes, weights).withColumn("ratio", F.lit(max_repeat) * F.col("source_size") / F.col("weight")), "mix-weighed")
    all_size, all_weight = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, full = share * float(all_size) / all_weight if all_weight else 0.0, 0
    while True:
        n, capped, used = per.where(F.col("ratio") <= F.lit(level)).agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == full or used == all_weight:
            break
        full, level = n, (share * float(all_size) - max_repeat * float(capped)) / float(all_weight - used)
    is_full = F.col("ratio") <= F.lit(level)
    target = F.when(is_full, F.lit(max_repeat) * F.col("source_size")).otherwise(F.col("weight") * F.lit(level))
    per = per.withColumn("target", target.cast("double"))
    per = per.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    return per.select("key", "source_size", "target", "base", (F.col("target") - F.col("base") * F.col("source_size")).alias("budget"))


def _crossing(hist: DataFrame) -> DataFrame:
    """Of a histogram (key, budget, before, bucket, s) the bucket of each key where the running sum crosses its budget."""
    run = Window.partitionBy("key").orderBy("bucket")
    hist = hist.withColumn("upto", F.col("before") + F.sum("s").over(run)).withColumn("start", F.col("upto") - F.col("s"))
    return hist.where((F.col("start") <= F.col("budget")) & (F.col("upto") > F.col("budget"))).select("key", "budget", F.col("bucket").alias("prefix"), F.col("start").alias("before"), "s")


def thresholds(sized: DataFrame, hist: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """Per source the hash below which documents are taken once more; ``hist`` is the histogram of the leading bits."""
    shift = HASH_BITS - LEVELS[0]
    hist = hist.join(_small(targets.select("key", "budget"), n_sources), "key").withColumn("before", F.lit(0).cast("long"))
    bound, rows = materialize(_crossing(hist), "mix-bound"), sized.select("key", "size", "h")
    for bits in LEVELS[1:]:
        inside = rows.join(_small(bound.drop("s"), n_sources), "key").where(F.shiftright("h", shift) == F.col("prefix"))
        rows = materialize(inside.select("key", "size", "h", "budget", "before"), "mix-boundary")
        shift -= bits
        hist = rows.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("s"), F.first("budget").alias("budget"), F.first("before").alias("before"))
        bound, rows = materialize(_crossing(hist), "mix-bound"), rows.select("key", "size", "h")
    # The crossing documents go whichever way ends nearer to the budget.
    return bound.select("key", F.when(2 * F.col("before") + F.col("s") < 2 * F.col("budget"), F.col("prefix") + 1).otherwise(F.col("prefix")).alias("cut"))


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_repeat: float = 2.0,
) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target and taken (words that the mix takes)."""
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("key"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.expr(f"cast(conv(substr(md5(concat(coalesce(cast(`{doc_id}` AS string), ''), ':', md5(coalesce(`{text}`, '')))), 1, 15), 16, 10) AS bigint)").alias("h"),
    )
    sized = materialize(sized, "mix-sized")
    hist = materialize(sized.groupBy("key", F.shiftright("h", HASH_BITS - LEVELS[0]).alias("bucket")).agg(F.sum("size").alias("s")), "mix-histogram")
    targets = materialize(source_targets(hist.groupBy("key").agg(F.sum("s").alias("source_size")), list(weights), share, max_repeat), "mix-targets")
    n = targets.count()
    cuts = thresholds(sized, hist, targets, n)
    plan = materialize(targets.join(_small(cuts, n), "key", "left").select("key", "source_size", "target", "base", "cut"), "mix-plan")
    for x in (hist, targets):
        drop_scratch(x)
    out = sized.join(_small(plan, n), "key")
    extra = F.coalesce((F.col("h") < F.col("cut")).cast("long"), F.lit(0))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("base") + extra)).alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM per),
ratios AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM weighed),
runs AS (
  SELECT *, sum(source_size) OVER w AS capped, sum(weight) OVER w AS used, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
  FROM ratios WINDOW w AS (ORDER BY ratio, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT *, CASE WHEN all_weight > used THEN (1.5::DOUBLE * all_size::DOUBLE - 2.0::DOUBLE * capped::DOUBLE) / (all_weight - used)::DOUBLE END AS next_level FROM runs),
fulls AS (SELECT *, ratio <= coalesce(lag(next_level) OVER (ORDER BY ratio, source IS NULL, source), 1.5::DOUBLE * all_size::DOUBLE / all_weight::DOUBLE) AS is_full FROM levels),
lev AS (SELECT coalesce((SELECT next_level FROM fulls WHERE is_full ORDER BY used DESC LIMIT 1),
                        (SELECT 1.5::DOUBLE * all_size::DOUBLE / all_weight::DOUBLE FROM fulls LIMIT 1)) AS level),
targets AS (SELECT source, source_size, CASE WHEN is_full THEN 2.0::DOUBLE * source_size ELSE weight * level END AS target FROM fulls, lev),
based AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM targets),
cums AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h)::BIGINT AS upto, sum(s.size) OVER (PARTITION BY s.source, s.h)::BIGINT AS g
  FROM sized s JOIN based b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  (size * (base + CASE WHEN upto <= budget OR (upto - g <= budget AND 2 * (upto - g) + g < 2 * budget) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM cums
"""
