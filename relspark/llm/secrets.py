"""Secret scans with corpus-wide ownership frequency.

Base patterns give the spans that any single text shows.  Every base value and
every other long mixed token is a candidate; candidates are hashed, and the
hashes are counted by distinct repositories and owners over the whole corpus.
A value that more than ``max_owners`` owners or more than ``max_repos``
repositories hold is a widely copied example; one that few hold is taken as
live, whatever characters a base value has.  Tokens that are live by that count
become spans of kind ``owned`` beside the base spans, which all stay; only these
tokens must look random to be candidates.  A table without a repository column
has each distinct text for a repository, so that exact copies count once.

Only hashes of values leave the scan, never the values.

Edge cases: a null text is empty and has no spans.  A null owner or repository
is an owner or repository of its own.  Repeated rows are each reported and add
neither owner nor repository.  Texts of any length are scanned whole, in time
that grows with their length.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import bounded_batches, materialize, row_key
from relspark.llm.textops import slices, text_buffers, word_spans

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "owned"]

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[np.frombuffer(b"0123456789abcdef", np.uint8)] = True
_TOKEN_BYTES = np.zeros(256, bool)
_TOKEN_BYTES[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", np.uint8)] = True

SCHEMA = "uid long, doc_id long, row_key binary, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, base string, cands array<struct<kind:int,start:int,end:int,hash:string>>"
_CANDS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))


def entropy(value: str) -> float:
    """Shannon entropy of the characters, in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_random(value: str, least: float) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= least


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind number, start, end, value) by start, then kind."""
    low = text.lower()
    out = []
    if any(k in low for k in _KEYWORDS):
        out += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def other_tokens(text: str, base: list) -> list[tuple[int, int, int, str]]:
    """Long mixed tokens that no base span touches; both lists are in the order of their starts."""
    out, at, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        while at < len(base) and base[at][1] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and looks_random(m[0], 3.5):
            out.append((3, m.start(), m.end(), m[0]))
    return out


def _long_runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, least: int) -> np.ndarray:
    """The numbers of the texts that hold a run of ``least`` bytes of the table; a run ends with its text."""
    starts, ends, texts = word_spans(data, offsets, table)
    return np.unique(texts[ends - starts >= least])


def _scan(batches):
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 36
    empty = hashlib.sha256(b"").hexdigest()
    for part in slices(batches, "text"):
        data, offsets = text_buffers(part.column(4))
        if offsets[-1] > offsets[0]:
            tokens = set(_long_runs(data, offsets, _TOKEN_BYTES, 20).tolist())
        else:
            tokens = set()
        texts = part.column(4)
        cols = {"n": [[], [], []], "sha": [], "base": [], "cands": []}
        for i in range(part.num_rows):
            text = texts[i].as_py() or ""
            low_hit = i in tokens or "AKIA" in text or any(k in text.lower() for k in _KEYWORDS)
            base = base_spans(text) if low_hit else []
            more = other_tokens(text, base) if i in tokens else []
            for k in range(3):
                cols["n"][k].append(sum(x[0] == k for x in base))
            named = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in base)
            cols["base"].append(named)
            cols["sha"].append(hashlib.sha256(named.encode()).hexdigest() if named else empty)
            cols["cands"].append([{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()[:32]} for k, s, e, v in base + more])
        uid = pa.array(np.arange(number, number + part.num_rows))
        number += part.num_rows
        yield pa.RecordBatch.from_arrays(
            [uid, part.column(0), part.column(1), part.column(2), part.column(3), *(pa.array(x, pa.int64()) for x in cols["n"]), pa.array(cols["sha"], pa.string()), pa.array(cols["base"], pa.string()), pa.array(cols["cands"], _CANDS)],
            ["uid", "doc_id", "row_key", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "base", "cands"],
        )


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: str | None = None, max_owners: int = 2, max_repos: int = 8) -> DataFrame:
    """Per row: doc_id, row_key, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example and the live spans as an array."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        row_key(doc_id, text).alias("row_key"),
        F.col(owner).cast("string").alias("owner"),
        (F.md5(F.col(text).cast("binary")) if repo is None else F.col(repo).cast("string")).alias("repo"),
        F.col(text).alias("text"),
    )
    scan = materialize(rows.mapInArrow(_scan, SCHEMA), "secrets")
    kept = ["uid", "doc_id", "row_key", "n_assign", "n_access", "n_hex", "base_sha256"]
    found = scan.where(F.size("cands") > 0).select(*kept, "owner", "repo", F.explode("cands").alias("c"))
    # Distinct (hash, owner) and (hash, repository) first, both summed before their shuffles; no task gathers the rows of a hash.
    seen = found.select(F.col("c.hash").alias("hash"), "owner", "repo")
    owners = seen.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    repos = seen.select("hash", "repo").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"))
    stats = materialize(owners.join(repos, "hash"), "secret-owners")
    judged = found.withColumn("hash", F.col("c.hash")).join(stats, "hash")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    judged = judged.where((F.col("c.kind") < 3) | live)
    span = F.struct(F.col("c.start").alias("start"), F.col("c.kind").alias("kind"), F.col("c.end").alias("end"), live.alias("live"))
    by_doc = judged.groupBy("uid").agg(*(F.first(c).alias(c) for c in kept[1:]), F.array_sort(F.collect_list(span)).alias("found"))
    names = F.array(*(F.lit(k) for k in KINDS))
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    alive = F.filter("found", lambda s: s["live"])
    by_doc = by_doc.select(*kept, spans.alias("spans"), F.size(alive).cast("long").alias("n_live"), (F.size("found") - F.size(alive)).cast("long").alias("n_example"), alive.alias("live"))
    # Documents whose candidates were all common tokens have no row in by_doc.
    none = F.lit(None).cast(by_doc.schema["live"].dataType)
    plain = scan.where(F.size("cands") == 0)
    lost = scan.where((F.size("cands") > 0) & (F.col("base") == "")).join(by_doc.select("uid"), "uid", "left_anti")
    rest = plain.unionByName(lost).select(*kept, F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"), F.coalesce(none, F.array().cast(none_type(by_doc))).alias("live"))
    return by_doc.unionByName(rest).drop("uid")


def none_type(df: DataFrame) -> str:
    return df.schema["live"].dataType.simpleString()


def redact(text: str, spans: list, mark: str = "[SECRET]") -> str:
    """The text with the union of the spans replaced."""
    out, at = [], 0
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def redacted(text: str, live: str) -> Column:
    """``text`` with the spans of ``live`` replaced; null where ``live`` is null, and only the other texts pass through Python."""

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if s is None else redact(t or "", s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(run, "string")(F.when(F.col(live).isNotNull(), F.col(text)), F.col(live))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return secret_scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example")


#: Matches lie between the pieces that a split by their pattern leaves, which gives their places.
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source FROM documents),
m AS (
  SELECT r, 0 AS kind, regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS all_, regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS val, string_split_regex(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps FROM t
  UNION ALL SELECT r, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM t
  UNION ALL SELECT r, 2, regexp_extract_all(text, '[0-9a-f]{32,}'), regexp_extract_all(text, '[0-9a-f]{32,}'), string_split_regex(text, '[0-9a-f]{32,}') FROM t
  UNION ALL SELECT r, 3, regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}'), string_split_regex(text, '[A-Za-z0-9+/_=-]{20,}') FROM t),
each AS (SELECT r, kind, unnest(all_) AS a, unnest(val) AS v, unnest(gaps[1 : len(all_)]) AS g, unnest(range(1, len(all_) + 1)) AS i FROM m WHERE len(all_) > 0),
placed AS (SELECT *, sum(length(g) + length(a)) OVER (PARTITION BY r, kind ORDER BY i)::BIGINT AS e FROM each),
spans AS (SELECT r, kind, e - length(a) AS s, e, v FROM placed WHERE (kind = 0 AND length(v) >= 8) OR (kind = 1 AND length(v) >= 16) OR kind >= 2),
base AS (SELECT * FROM spans WHERE kind < 3),
chars AS (SELECT r, s, unnest(string_split(v, '')) AS ch FROM spans WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')),
random AS (SELECT r, s FROM chars GROUP BY r, s HAVING entropy(ch) >= 3.5),
more AS (SELECT x.* FROM spans x JOIN random USING (r, s) WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = x.r AND b.s < x.e AND x.s < b.e)),
cands AS (SELECT * FROM base UNION ALL SELECT * FROM more),
stats AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS n_owners, count(DISTINCT text) AS n_repos FROM cands JOIN t USING (r) GROUP BY v),
judged AS (SELECT c.*, n_owners <= 2 AND n_repos <= 8 AS live, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e AS name FROM cands c JOIN stats USING (v)),
shown AS (SELECT * FROM judged WHERE kind < 3 OR live),
by_doc AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY s, kind) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM shown GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM t LEFT JOIN by_doc USING (r)
"""
