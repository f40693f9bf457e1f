"""Chat formatting: every participant's perspective of a dialogue.

Everything is DataFrame and SQL.  For each participant of a conversation, each
turn becomes one rendered segment: the participant's own turns as assistant
(with a loss mask over content and end marker), other speakers' as named users,
system turns as system.  A conversation rendered from one perspective is the
concatenation of its segments by turn, then speaker, then segment (rows that
agree in all three are the same), null turns first.  :func:`dialogues` assembles
conversations up to a size whole; longer ones stay segments, so that a
conversation of any length never meets in one task.

Edge cases: a null role is the participant ``unknown``; a null text is empty;
rows of a null conv_id form one conversation; repeated rows and repeated turns
each give their own segment; a conversation of system turns alone has no
participant and gives no rows; an empty table gives no rows.  Control markers
inside texts are broken up, so that content can't open or close a message; in
names, white space, ``%`` and ``<`` are percent-encoded, so that no two
participants share a name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate_perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """conv_id, perspective, turn, speaker, role, name, segment, mask_start, mask_end (code points; -1 where nothing is trained)."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("k"),
        F.col(conv).isNull().alias("k_null"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |")).alias("content"),
    )
    people = rows.where(F.col("speaker") != system).select("k", "k_null", F.col("speaker").alias("perspective")).distinct()
    out = rows.join(people, ["k", "k_null"])
    own = F.col("speaker") == F.col("perspective")
    out = out.withColumn("role", F.when(own, "assistant").when(F.col("speaker") == system, "system").otherwise("user"))
    name = reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(f"%{ord(c):02X}")), "%<\t\n\x0b\x0c\r ", F.col("speaker"))
    out = out.withColumn("name", F.when(F.col("role") == "user", name).otherwise(""))
    head = F.concat(F.lit(OPEN), F.col("role"), F.when(F.col("name") != "", F.concat(F.lit(" name="), F.col("name"))).otherwise(""), F.lit("\n"))
    out = out.withColumn("head", head)
    body = F.concat("content", F.lit(CLOSE))
    return out.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "role",
        "name",
        F.concat("head", body, F.lit("\n")).alias("segment"),
        F.when(own, F.length("head")).otherwise(-1).cast("int").alias("mask_start"),
        F.when(own, F.length("head") + F.length(body)).otherwise(-1).cast("int").alias("mask_end"),
    )


#: Code points of the longest dialogue that is one row.
MAX_DIALOGUE = 1 << 20


def dialogues(segments: DataFrame, max_chars: int = MAX_DIALOGUE) -> tuple[DataFrame, DataFrame]:
    """The segments of :func:`rotate_perspectives` assembled, and those of dialogues beyond ``max_chars`` as they are.

    Per conversation and perspective: conv_id, perspective, n_turns, text, and
    masks (start, end of the trained stretches in ``text``).  Sizes are summed
    before any row meets another, and only short dialogues are gathered.
    """
    size = F.length("segment").cast("long")
    key = ["conv_id", "perspective"]
    on = segments["conv_id"].eqNullSafe(F.col("c_")) & (segments["perspective"] == F.col("p_"))
    long = segments.groupBy(*key).agg(F.sum(size).alias("n_")).where(F.col("n_") > max_chars).select(F.col("conv_id").alias("c_"), F.col("perspective").alias("p_"))
    short, rest = segments.join(long, on, "left_anti"), segments.join(long, on, "left_semi")
    turns = F.array_sort(F.collect_list(F.struct("turn", "speaker", "segment", "mask_start", "mask_end")))
    out = short.groupBy(*key).agg(turns.alias("t"))
    # Each turn's place is the sum of the lengths before it, carried along in one pass.
    placed = F.aggregate(
        "t",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("masks")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["segment"])).alias("at"),
            F.when(x["mask_start"] >= 0, F.concat(a["masks"], F.array(F.struct((a["at"] + x["mask_start"]).alias("start"), (a["at"] + x["mask_end"]).alias("end"))))).otherwise(a["masks"]).alias("masks"),
        ),
        lambda a: a["masks"],
    )
    return out.select(*key, F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("text"), placed.alias("masks")), rest


def query(spark, sf_dir: str) -> DataFrame:
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


def dialogue_query(spark, sf_dir: str) -> DataFrame:
    """Whole dialogues, and segments of those that are too long, each with its masks as text."""
    whole, rest = dialogues(query(spark, sf_dir))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return whole.select("conv_id", "perspective", "n_turns", "text", masks.alias("masks")).unionByName(
        rest.select("conv_id", "perspective", F.lit(1).cast("long").alias("n_turns"), F.col("segment").alias("text"), F.when(F.col("mask_start") >= 0, F.concat_ws(":", "mask_start", "mask_end")).otherwise("").alias("masks"))
    )


ORACLE = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system'),
j AS (
  SELECT r.*, p.perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
n AS (SELECT *, CASE WHEN role = 'user' THEN replace(replace(replace(replace(replace(replace(replace(replace(speaker, '%', '%25'), '<', '%3C'), chr(9), '%09'), chr(10), '%0A'), chr(11), '%0B'), chr(12), '%0C'), chr(13), '%0D'), ' ', '%20') ELSE '' END AS name FROM j),
h AS (SELECT *, '<|im_start|>' || role || CASE WHEN name <> '' THEN ' name=' || name ELSE '' END || chr(10) AS head FROM n)
SELECT conv_id, perspective, turn, speaker, role, name, head || content || '<|im_end|>' || chr(10) AS segment,
  (CASE WHEN role = 'assistant' THEN length(head) ELSE -1 END)::INTEGER AS mask_start,
  (CASE WHEN role = 'assistant' THEN length(head) + length(content) + 10 ELSE -1 END)::INTEGER AS mask_end
FROM h
"""

DIALOGUE_ORACLE = rf"""
WITH s AS ({ORACLE}),
o AS (SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT conv_id, perspective, count(*) AS n_turns, string_agg(segment, '' ORDER BY turn NULLS FIRST, speaker, segment) AS text,
  coalesce(string_agg((before + mask_start)::BIGINT || ':' || (before + mask_end)::BIGINT, ',' ORDER BY before) FILTER (mask_start >= 0), '') AS masks
FROM o GROUP BY conv_id, perspective
"""
