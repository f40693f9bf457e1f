"""Benchmark decontamination with a distributed positional inverted index.

Index: the training texts are tokenised in segments of about a megabyte, and
each segment stores, for every term in it, the sorted list of its positions (one
position space a segment, with gaps between documents).  Segments are rows of a
table in the shared folder, so posting lists live where their documents do and
nothing is shuffled.  The index knows nothing of the benchmark.

Search: corpus-wide counts order the terms of each test window from the rarest
to the commonest.  Windows are filed under their rarest term, so a segment looks
only at windows whose rarest term it has.  That term's list, moved back by the
term's offset, is intersected with the next one's, and so on, until it is empty
or a match.  With ``slop`` the same lists give in-order proximity matches.

A word is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A to Z
lower-cased; terms are compared by 64-bit hashes.

A benchmark of any size is matched: it is dealt into parts of ``PART_BYTES``,
each is held in memory for one pass over the index (a longer item in pieces that
overlap by a window), and the hits of the parts are merged by document.

Edge cases: null and empty texts have no words and no hits.  Repeated documents
and items are each reported or merged by their id; a null item_id is the empty
text.  An item of fewer words than a window is one window; one without words is
none.  An empty benchmark hits nothing, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import bounded_batches, materialize, row_key
from relspark.llm.textops import WORDS_ALNUM, hashed_words, slices

#: Text of the benchmark that one pass over the index holds, and words of one piece of it.
PART_BYTES = 4 << 20
PART_WORDS = 1_000_000

INDEX_SCHEMA = "segment long, n_docs int, doc_ids binary, row_keys binary, null_ids binary, first binary, n_words binary, terms binary, counts binary, positions binary"
RESULT_SCHEMA = "doc_id long, row_key binary, n_words long, n_hit long, n_items long, items string, items_sha256 string, contaminated boolean"


class Windows:
    """Test windows as rows of term numbers, by length, with the items that hold them."""

    def __init__(self, items: list[tuple[str, np.ndarray]], width: int):
        self.items = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        self.vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.empty(0, np.uint64)
        rows: dict[int, list] = {}
        for i, words in items:
            n = min(width, len(words))
            if n:
                at = np.searchsorted(self.vocabulary, words).astype(np.int32)
                rows.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(at, n), number[i]))
        self.groups = []
        for n, parts in sorted(rows.items()):
            words = np.concatenate([w for w, _ in parts])
            who = np.repeat([k for _, k in parts], [len(w) for w, _ in parts])
            words, at = np.unique(words, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([at.ravel(), who], 1), axis=0)
            self.groups.append((n, words, np.searchsorted(pairs[:, 0], np.arange(len(words) + 1)), pairs[:, 1]))


def parts_of(benchmark: DataFrame, width: int) -> Iterator[Windows]:
    """The benchmark (i, t) in parts that fit into memory."""
    size = benchmark.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // PART_BYTES))
    for k in range(n):
        held, words = [], 0
        for r in benchmark.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).toLocalIterator():
            hashes, _ = hashed_words(pa.array([r.t], pa.large_string()), WORDS_ALNUM)
            for lo in range(0, max(1, len(hashes) - width + 1), PART_WORDS):
                piece = hashes[lo : lo + PART_WORDS + width - 1]
                if held and words + len(piece) > PART_WORDS:
                    yield Windows(held, width)
                    held, words = [], 0
                held.append((r.i, piece))
                words += len(piece)
        if held:
            yield Windows(held, width)


def _moved(base: np.ndarray, other: np.ndarray) -> np.ndarray:
    at = np.searchsorted(other, base)
    at[at == len(other)] = 0
    return base[other[at] == base] if len(other) else base[:0]


def phrase_starts(lists: dict[int, np.ndarray], words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Start positions of the exact phrase: offset-adjusted lists, intersected from the rarest term."""
    base = lists[words[order[0]]] - order[0]
    for k in order[1:]:
        if not len(base):
            break
        base = _moved(base, lists[words[k]] - k)
    return base


def proximity_ends(lists: dict[int, np.ndarray], words: np.ndarray, slop: int) -> np.ndarray:
    """End positions of in-order matches with at most ``slop`` words between neighbours."""
    ends = lists[words[0]]
    for w in words[1:]:
        here = lists[w]
        before = np.searchsorted(ends, here) - 1
        ok = before >= 0
        ok[ok] = here[ok] - ends[before[ok]] <= slop + 1
        ends = here[ok]
        if not len(ends):
            break
    return ends


def _index(gap: int):
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for part in slices(batches, "text"):
            hashes, owner = hashed_words(part.column(2), WORDS_ALNUM)
            n = part.num_rows
            sizes = np.bincount(owner, minlength=n).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]]).astype(np.int64)
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            cuts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, np.int64)
            rank = (order + owner[order] * gap).astype(np.int32 if len(hashes) + n * gap < 2**31 else np.int64)
            ids = part.column(0)
            row = [
                np.asarray(pc.fill_null(ids.cast(pa.int64()), 0), np.int64),
                np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8),
                np.asarray(ids.is_null()).astype(np.uint8),
                first,
                sizes,
                ranked[cuts],
                np.diff(np.append(cuts, len(ranked))).astype(np.int64),
                rank,
            ]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in row)], [x.split()[0] for x in INDEX_SCHEMA.split(", ")])
            number += 1

    return run


def _places(vocabulary: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the segment's terms the vocabulary has, and their numbers in it."""
    if not len(vocabulary) or not len(terms):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(vocabulary, terms)
    at[at == len(vocabulary)] = 0
    known = np.flatnonzero(vocabulary[at] == terms)
    return known, at[known]


def _term_counts(vocabulary: np.ndarray):
    def run(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                known, at = _places(vocabulary, np.frombuffer(terms.as_py(), np.uint64))
                total[at] += np.frombuffer(counts.as_py(), np.int64)[known]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "n"])

    return run


_NO_ITEMS = hashlib.sha256(b"").hexdigest()


def _verdict(n_hit: list, named: list) -> list:
    text = [",".join(sorted(x)) for x in named]
    return [pa.array(n_hit, pa.int64()), pa.array([len(x) for x in named], pa.int64()), pa.array(text, pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() if x else _NO_ITEMS for x in text], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())]


def covered(starts: np.ndarray, lengths: np.ndarray) -> int:
    """Words in the union of the spans."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], (starts + lengths)[order]
    reach = np.maximum.accumulate(e)
    before = np.concatenate([[-1], reach[:-1]])
    return int(np.maximum(0, e - np.maximum(s, before)).sum())


class _Search:
    """Looks up one part of the benchmark in segments."""

    def __init__(self, windows: Windows, frequency: np.ndarray, slop: int | None):
        self.vocabulary, self.items, self.slop = windows.vocabulary, windows.items, slop
        self.groups = []
        for length, words, at, who in windows.groups:
            order = np.argsort(frequency[words], axis=1, kind="stable").astype(np.int32)
            lead = words[np.arange(len(words)), order[:, 0]]
            by_lead = np.argsort(lead, kind="stable")
            self.groups.append((length, words, order, at, who, by_lead, np.searchsorted(lead[by_lead], np.arange(len(frequency) + 1))))

    def hits(self, row: dict) -> dict[int, tuple[list, list, set]]:
        """By number of the document in the segment: starts and lengths of matches, and items."""
        first = np.frombuffer(row["first"], np.int64)
        counts = np.frombuffer(row["counts"], np.int64)
        known, here = _places(self.vocabulary, np.frombuffer(row["terms"], np.uint64))
        positions = np.frombuffer(row["positions"], np.int32 if len(row["positions"]) == 4 * int(counts.sum()) else np.int64)
        ends = np.cumsum(counts)
        lists = {int(t): positions[ends[i] - counts[i] : ends[i]].astype(np.int64) for i, t in zip(known, here, strict=True)}
        there = np.zeros(len(self.vocabulary), bool)
        there[here] = True
        out: dict[int, tuple[list, list, set]] = {}
        for length, words, order, at, who, by_lead, lead in self.groups:
            if not len(here):
                break
            picked = np.concatenate([by_lead[lead[t] : lead[t + 1]] for t in here])
            for k in picked[there[words[picked]].all(axis=1)]:
                starts = phrase_starts(lists, words[k], order[k]) if self.slop is None else proximity_ends(lists, words[k], self.slop)
                if not len(starts):
                    continue
                of = np.searchsorted(first, starts, "right") - 1
                names = {self.items[i] for i in who[at[k] : at[k + 1]]}
                for d in np.unique(of):
                    s, n, found = out.setdefault(int(d), ([], [], set()))
                    s.append(starts[of == d] - first[d])
                    n.append(np.full(len(s[-1]), length if self.slop is None else 1))
                    found |= names
        return out

    def whole(self, batches):
        """Every document with its verdict, for a benchmark of one part."""
        for batch in batches:
            for row in batch.to_pylist():
                n, found = row["n_docs"], self.hits(row)
                n_hit = [covered(*(np.concatenate(x) for x in found[d][:2])) if d in found else 0 for d in range(n)]
                yield pa.RecordBatch.from_arrays([*_documents_of(row), *_verdict(n_hit, [found[d][2] if d in found else () for d in range(n)])], [x.split()[0] for x in RESULT_SCHEMA.split(", ")])

    def some(self, batches):
        """Documents with hits: their place and what was found."""
        for batch in batches:
            for row in batch.to_pylist():
                found = self.hits(row)
                if found:
                    spans = [[np.concatenate(x).astype(np.int64).tobytes() for x in found[d][:2]] for d in found]
                    yield pa.RecordBatch.from_arrays([pa.array([row["segment"]] * len(found)), pa.array(list(found), pa.int32()), pa.array([s for s, _ in spans], pa.binary()), pa.array([n for _, n in spans], pa.binary()), pa.array([sorted(found[d][2]) for d in found], pa.list_(pa.string()))], ["segment", "doc", "starts", "lengths", "items"])


def _documents_of(row: dict) -> list:
    keys = row["row_keys"]
    return [
        pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=np.frombuffer(row["null_ids"], np.uint8).astype(bool)),
        pa.array([keys[16 * d : 16 * d + 16] for d in range(row["n_docs"])], pa.binary()),
        pa.array(np.frombuffer(row["n_words"], np.int64)),
    ]


def _documents(batches):
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n_docs"]
            yield pa.RecordBatch.from_arrays([pa.array([row["segment"]] * n), pa.array(range(n), pa.int32()), *_documents_of(row)], ["segment", "doc", "doc_id", "row_key", "n_words"])


def _merge(batches):
    for batch in batches:
        hit, named = [], []
        for starts, lengths, items in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            hit.append(covered(*(np.concatenate([np.frombuffer(x, np.int64) for x in y]) for y in (starts, lengths))))
            named.append({x for y in items for x in y})
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_verdict(hit, named)], ["segment", "doc", "n_hit", "n_items", "items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, slop: int | None = None) -> DataFrame:
    """Per document: doc_id, row_key (of id and text), n_words, n_hit, n_items, items, items_sha256, contaminated.

    ``slop`` None: exact phrases.  A number: in-order matches with up to that
    many words between neighbours; n_hit then counts the words where one ends.
    """
    bounded_batches(docs.sparkSession)
    test = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))
    # Positions of two documents lie further apart than any match may reach.
    index = materialize(rows.mapInArrow(_index(1 + (slop or 0)), INDEX_SCHEMA), "postings")

    def search(windows: Windows) -> _Search:
        frequency = np.zeros(len(windows.vocabulary), np.int64)
        counts = index.select("terms", "counts").mapInArrow(_term_counts(windows.vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        for r in counts.collect():  # one number a term of this part
            frequency[r.term] = r.n
        return _Search(windows, frequency, slop)

    parts = parts_of(test, width)
    first, second = next(parts, None), next(parts, None)
    if second is None:
        return index.mapInArrow(search(first or Windows([], width)).whole, RESULT_SCHEMA)
    found = [materialize(index.mapInArrow(search(x).some, "segment long, doc int, starts binary, lengths binary, items array<string>"), "hits") for x in (first, second)]
    found += [materialize(index.mapInArrow(search(x).some, "segment long, doc int, starts binary, lengths binary, items array<string>"), "hits") for x in parts]
    hits = reduce(lambda a, b: a.unionByName(b), found).groupBy("segment", "doc").agg(*(F.collect_list(c).alias(c) for c in ("starts", "lengths", "items")))
    hits = hits.mapInArrow(_merge, "segment long, doc int, n_hit long, n_items long, items string, items_sha256 string, contaminated boolean")
    out = index.select("segment", "n_docs", "doc_ids", "row_keys", "null_ids", "n_words").mapInArrow(_documents, "segment long, doc int, doc_id long, row_key binary, n_words long")
    out = out.join(hits, ["segment", "doc"], "left")
    return out.select("doc_id", "row_key", "n_words", *(F.coalesce(c, F.lit(d)).alias(c) for c, d in (("n_hit", 0), ("n_items", 0), ("items", ""), ("items_sha256", _NO_ITEMS), ("contaminated", False))))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def proximity_query(spark, sf_dir: str) -> DataFrame:
    """Six words of an item in their order, with up to two words between neighbours."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=6, slop=2)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS r FROM documents),
iw AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT r, i, grams.n, item_id FROM grams JOIN win USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

PROXIMITY_ORACLE = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS r FROM documents),
iw AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (SELECT row_number() OVER () AS q, g FROM (
  SELECT DISTINCT w[i : i + least(len(w), 6) - 1] AS g FROM (SELECT w, unnest(range(1, greatest(len(w) - 5, 1) + 1)) AS i FROM iw WHERE len(w) > 0))),
owner AS (SELECT DISTINCT q, item_id FROM win JOIN (SELECT item_id, w, unnest(range(1, greatest(len(w) - 5, 1) + 1)) AS i FROM iw WHERE len(w) > 0) x ON win.g = x.w[i : i + least(len(w), 6) - 1]),
terms AS (SELECT q, k, g[k] AS t, len(g) AS n FROM (SELECT q, g, unnest(range(1, len(g) + 1)) AS k FROM win)),
pos AS (SELECT r, p, w[p] AS t FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM dw)),
ends(r, q, k, p) AS (
  SELECT r, q, k, p FROM pos JOIN terms USING (t) WHERE k = 1
  UNION
  SELECT e.r, e.q, e.k + 1, b.p FROM ends e JOIN terms x ON x.q = e.q AND x.k = e.k + 1 JOIN pos b ON b.r = e.r AND b.t = x.t AND b.p > e.p AND b.p <= e.p + 3),
hits AS (SELECT DISTINCT r, e.q, p FROM ends e JOIN terms x ON x.q = e.q AND x.k = e.k AND x.n = e.k),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits JOIN owner USING (q)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
