"""Quality classifier: random-indexing word vectors and a two-layer network.

Every token has a fixed sparse ternary index vector that its hash determines.
A word's vector is the sum of the index vectors of its neighbours in the fit
sample; words outside the bounded vocabulary use the vector of their shape (the
character classes in them).  A document is the mean of its words' vectors and
of its shapes' vectors, with four scalars (length, distinct words and lines).
A two-layer numpy network is trained on three quarters of the sample; the
temperature of its probabilities is calibrated on the rest.

Learning is bounded: at most ``max_rows`` labelled rows and ``max_bytes`` bytes
of text; scoring reads every whole text.

Edge cases: null and empty texts are the zero vector and get its score.  If the
sample lacks a class, all scores are the labelled share (0.5 without labels).
Repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import bounded_batches, crc_mod
from relspark.llm.learning import fit_temperature, labelled_sample, logits, sigmoid, two_layer
from relspark.llm.textops import WORDS_BY_SPACE, hash_spans, mix, slices, text_buffers, word_spans

DIM, NONZERO, WINDOW, MAX_WORDS = 64, 6, 2, 20_000

#: Bit sets of character classes: lower, upper, digit, symbol, exclamation and question, other ASCII, not ASCII, bar.
_CLASS = np.full(256, 32, np.uint8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 1, 2, 4, 64
_CLASS[np.frombuffer(b"#*$%&<>", np.uint8)], _CLASS[np.frombuffer(b"!?", np.uint8)], _CLASS[0x7C] = 8, 16, 128
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0


def _tokens(col: pa.Array):
    """Word hashes, shapes, text numbers, and scalars of each text."""
    data, offsets = text_buffers(col)
    n = len(offsets) - 1
    if offsets[-1] == offsets[0]:
        z = np.empty(0, np.int64)
        return z.astype(np.uint64), z, z, np.zeros((n, 4))
    starts, ends, texts = word_spans(data, offsets, WORDS_BY_SPACE)
    words = hash_spans(data, starts, ends)
    inside = _CLASS[data[: offsets[-1]]]
    shapes = np.bitwise_or.reduceat(inside, starts).astype(np.int64) if len(starts) else np.empty(0, np.int64)
    shapes += 256 * (np.minimum(ends - starts, 24) // 8)
    size = np.bincount(texts, minlength=n)
    lines = np.bincount(np.searchsorted(offsets, np.flatnonzero(data[offsets[0] : offsets[-1]] == 10) + offsets[0], "right") - 1, minlength=n)
    order = np.lexsort((words, texts))
    w, t = words[order], texts[order]
    first = np.concatenate([[True], (w[1:] != w[:-1]) | (t[1:] != t[:-1])]) if len(w) else np.empty(0, bool)
    distinct = np.bincount(t[first], minlength=n)
    scalars = np.stack([np.log1p(size), distinct / np.maximum(size, 1), np.log1p(distinct), np.log1p(lines)], 1)
    return words, shapes, texts, scalars


def index_vectors(tokens: np.ndarray) -> np.ndarray:
    """The sparse ternary vector of each token hash."""
    out = np.zeros((len(tokens), DIM), np.float32)
    rows = np.arange(len(tokens))
    h = mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
    for _ in range(NONZERO):
        h = mix(h + np.uint64(0x14057B7EF767814F))
        np.add.at(out, (rows, (h % np.uint64(DIM)).astype(np.int64)), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0))
    return out


def train_vectors(parts: list) -> dict:
    """Word and shape vectors from neighbours in the sample."""
    df: dict = {}
    for words, _, texts, _ in parts:
        pair = np.unique(np.stack([texts.astype(np.uint64), words], 1), axis=0)[:, 1] if len(words) else words
        for w, n in zip(*np.unique(pair, return_counts=True), strict=True):
            df[w] = df.get(w, 0) + int(n)
    common = sorted((w for w in df if df[w] >= 3), key=lambda w: (-df[w], int(w)))[:MAX_WORDS]
    vocabulary = np.sort(np.array(common, np.uint64))
    vec, shape_vec = np.zeros((len(vocabulary), DIM), np.float32), np.zeros((1024, DIM), np.float32)
    n_vec, n_shape = np.zeros(len(vocabulary)), np.zeros(1024)
    for words, shapes, texts, _ in parts:
        if not len(words):
            continue
        uniq, at = np.unique(shapes.astype(np.uint64) + np.uint64(1 << 40), return_inverse=True)
        own = index_vectors(uniq)[at]
        known, k = _lookup(vocabulary, words)
        own[known] += index_vectors(vocabulary)[k[known]]
        around = np.zeros_like(own)
        for d in range(1, WINDOW + 1):
            same = texts[d:] == texts[:-d]
            around[d:][same] += own[:-d][same]
            around[:-d][same] += own[d:][same]
        np.add.at(vec, k[known], around[known])
        np.add.at(n_vec, k[known], 1)
        np.add.at(shape_vec, shapes, own + around)
        np.add.at(n_shape, shapes, 1)
    vec /= np.maximum(n_vec, 1)[:, None]
    shape_vec /= np.maximum(n_shape, 1)[:, None]
    return {"vocabulary": vocabulary, "vec": vec, "shape_vec": shape_vec}


def _lookup(vocabulary, words):
    if not len(vocabulary):
        return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
    k = np.searchsorted(vocabulary, words)
    k[k == len(vocabulary)] = 0
    return vocabulary[k] == words, k


def document_vectors(model: dict, part) -> np.ndarray:
    words, shapes, texts, scalars = part
    n = len(scalars)
    if not len(words):
        return np.concatenate([np.zeros((n, 2 * DIM)), scalars], 1)
    known, k = _lookup(model["vocabulary"], words)
    size = np.maximum(np.bincount(texts, minlength=n), 1)[:, None]
    # Pool by counting (text, term) pairs first: vectors are then added once a pair.
    width = len(model["vocabulary"]) + 1024
    term = np.where(known, k, len(model["vocabulary"]) + shapes)
    table = np.concatenate([model["vec"], model["shape_vec"]])
    out = []
    for ids, vectors, m in ((term, table, width), (shapes, model["shape_vec"], 1024)):
        pair, n_pair = np.unique(texts * m + ids, return_counts=True)
        rows = vectors[pair % m] * n_pair[:, None]
        at = pair // m
        starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        pooled = np.zeros((n, DIM))
        pooled[at[starts]] = np.add.reduceat(rows, starts, axis=0)
        out.append(pooled / size)
    return np.concatenate([*out, scalars], 1)


def fit(sample: list) -> dict:
    y = np.array([l for _, _, l in sample], float)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    texts = [t for _, t, _ in sample]
    parts = [_tokens(pa.array(texts[lo : lo + 256], pa.large_string())) for lo in range(0, len(texts), 256)]
    model = train_vectors(parts)
    x = np.concatenate([document_vectors(model, p) for p in parts])
    rest = np.arange(len(y)) % 4 == 3
    model["net"] = two_layer(x[~rest], y[~rest])
    model["net"]["temperature"] = fit_temperature(logits(model["net"], x[rest]), y[rest])
    return model


def scores(model: dict, col: pa.Array) -> np.ndarray:
    if "constant" in model:
        return np.full(len(col), model["constant"])
    return sigmoid(logits(model["net"], document_vectors(model, _tokens(col))) / model["net"]["temperature"])


def _score(model: dict, threshold: float):
    def run(batches):
        for part in slices(batches, "text"):
            score = scores(model, part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def quality_classifier(docs: DataFrame, labels: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.5, max_rows: int = 6_000, max_bytes: int = 32 << 20) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.  ``held_out``: a condition on the id; such rows teach nothing."""
    bounded_batches(docs.sparkSession)
    model = fit(labelled_sample(docs, labels, label, ~held_out, max_rows, max_bytes, doc_id, text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    return rows.mapInArrow(_score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), crc_mod("doc_id", 3) == 1)
