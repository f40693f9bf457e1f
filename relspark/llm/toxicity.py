"""Toxicity by weak supervision.

Voters: a seed lexicon, words and word beginnings that stand out in toxic rows
of the labelled sample (by presence, or by density where clean texts have them
now and then), how many of these terms fire, and patterns of the writing
(:data:`PATTERNS`).  Voters that don't fire abstain.  A generative label model (a
latent class, with each voter's accuracy fitted by EM, which sees no label)
estimates the accuracies over labelled and unlabelled rows alike; voters that
fire together beyond what the class explains are correlated, and their evidence
is divided among them.  Its posteriors are the labels of a logistic regression
on the voters' firing and counts, which scores all documents.

Learning is bounded: at most ``max_rows`` labelled rows and ``max_bytes`` bytes
of their texts, and half as many of each unlabelled, are held by the driver.
Held-out rows are in neither sample.  Scoring reads every whole text.

Edge cases: null and empty texts have no hits and get the score of a text
without evidence.  Without labelled rows of both classes only the seed lexicon
and the patterns vote.  Repeated rows get equal scores; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import bounded_batches, crc_mod
from relspark.llm.learning import labelled_sample, logistic, sigmoid, unlabelled_sample
from relspark.llm.textops import WORDS_ALNUM, _LOWER, hash_spans, slices, text_buffers, word_spans

#: Common English insults.
SEED_LEXICON = ["idiot", "moron", "stupid", "dumb", "trash", "scum", "loser", "clown", "pathetic", "disgusting", "worthless", "filthy", "jerk", "imbecile", "vermin"]
PREFIXES = (3, 4, 5, 6, 7)
MAX_MINED = 160
#: Set apart from presence, the density of a term has its hash with these bits turned.
DENSE_MARK = np.uint64(0xA5A5A5A5A5A5A5A5)
#: Toxic rows are covered by up to so many mined terms each.
DEPTH = 5.0
#: A term is dense in a text from this share of its words and two occurrences on.
DENSE = 0.006
#: Patterns of the writing: capitals for a third of the letters, repeated exclamation marks, letters hidden behind
#: symbols, a letter four times in a row, and exclamation marks for a twentieth of the words.
PATTERNS = ("shouting", "bangs", "masked", "stretched", "exclaiming")
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MASK = np.zeros(256, bool)
_MASK[np.frombuffer(b"*#@$%", np.uint8)] = True


def _terms(data, offsets):
    """Hashes of words and word beginnings, with the number of their text; and word counts."""
    starts, ends, texts = word_spans(data, offsets, WORDS_ALNUM)
    low = _LOWER[data[offsets[0] : offsets[-1]]]
    starts, ends = starts - offsets[0], ends - offsets[0]
    out = [(hash_spans(low, starts, ends), texts)]
    for n in PREFIXES:
        # A beginning counts in characters' bytes; only longer words have it.
        longer = ends - starts > n
        s = starts[longer]
        out.append((hash_spans(low, s, s + n) ^ np.uint64(n), texts[longer]))
    return out, np.bincount(texts, minlength=len(offsets) - 1)


def _hash_word(word: str) -> np.uint64:
    b = np.frombuffer(word.encode(), np.uint8)
    return hash_spans(b, np.zeros(1, np.int64), np.array([len(b)], np.int64))[0]


def counts(col: pa.Array, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of the (sorted) lexicon's terms per text, and numbers of words."""
    data, offsets = text_buffers(col)
    n = len(offsets) - 1
    out = np.zeros((n, len(lexicon)))
    if offsets[-1] == offsets[0]:
        return out, np.zeros(n)
    terms, sizes = _terms(data, offsets)
    for h, texts in terms:
        at = np.searchsorted(lexicon, h)
        at[at == len(lexicon)] = 0
        hit = lexicon[at] == h if len(lexicon) else np.zeros(len(h), bool)
        np.add.at(out, (texts[hit], at[hit]), 1)
    return out, sizes


def patterns(col: pa.Array) -> np.ndarray:
    """Which of :data:`PATTERNS` fire in each text."""
    data, offsets = text_buffers(col)
    n = len(offsets) - 1
    lo, hi = int(offsets[0]) if n else 0, int(offsets[-1]) if n else 0
    if hi == lo:
        return np.zeros((n, len(PATTERNS)), bool)
    part, ends = data[lo:hi], offsets - lo

    def total(mask: np.ndarray) -> np.ndarray:
        """How often the mask holds in each text."""
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[ends[1:]] - sums[ends[:-1]]

    def run(mask: np.ndarray, k: int) -> np.ndarray:
        """Where ``k`` bytes in a row are in the mask; the last of them marks the place.  Texts are told apart by their border."""
        out = mask.copy()
        for j in range(1, k):
            out[j:] &= mask[:-j]
            out[:j] = False
        inner = ends[1:-1]
        for j in range(k - 1):  # no run goes over a border
            at = inner[inner + j < len(out)] + j
            out[at] = False
        return out

    letters, caps, bang = _LETTER[part], (part >= 0x41) & (part <= 0x5A), part == 0x21
    same = np.concatenate([[False], part[1:] == part[:-1]]) & letters
    masked = run(_MASK[part], 2)
    masked[2:] &= letters[:-2]
    n_letters, words = total(letters), total((part == 0x20) | (part == 0x0A)) + 1
    return np.stack([(total(caps) * 3 >= n_letters) & (n_letters >= 20), total(run(bang, 2)) > 0, total(masked) > 0, total(run(same, 3)) > 0, total(bang) * 20 >= words], 1)


def mine(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of toxic rows that clean rows hardly have, the ones that explain most rows first; and which count by density."""
    n_pos, n_neg = int((y == 1).sum()), int((y == 0).sum())
    if not n_pos or not n_neg:
        return np.empty(0, np.uint64), np.empty(0, bool)
    seen, dense_seen = {0: [], 1: []}, []
    for lo in range(0, len(texts), 256):
        data, offsets = text_buffers(pa.array(texts[lo : lo + 256], pa.large_string()))
        if offsets[-1] == offsets[0]:
            continue
        terms, sizes = _terms(data, offsets)
        h, d = np.concatenate([x for x, _ in terms]), np.concatenate([x for _, x in terms])
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        times = np.diff(np.append(np.flatnonzero(first), len(h)))
        h, d = h[first], d[first]
        dense = (times >= 2) & (times >= DENSE * sizes[d])
        h, d = np.concatenate([h, h[dense] ^ DENSE_MARK]), np.concatenate([d, d[dense]])
        for k in (0, 1):
            of = y[lo + d] == k
            seen[k].append((h[of], lo + d[of]))
        dense_seen.append(np.unique(h[len(times) :]))
    pos_h, pos_d = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (list(z) for z in zip(*seen[1], strict=True)))
    neg, neg_n = np.unique(np.concatenate([x for x, _ in seen[0]]), return_counts=True)
    uniq, where, n = np.unique(pos_h, return_inverse=True, return_counts=True)
    at = np.minimum(np.searchsorted(neg, uniq), len(neg) - 1)
    bad = np.where(neg[at] == uniq, neg_n[at], 0)
    good = (n >= 3) & ((n + 0.5) / (n_pos + 1) > 20 * (bad + 0.5) / (n_neg + 1)) & (bad <= 0.002 * n_neg + 0.05 * n)
    # Set cover: again and again the term that most toxic rows still lack.
    left = np.full(len(y), DEPTH)
    rows = [[] for _ in range(len(uniq))]
    for w, d in zip(where, pos_d, strict=True):
        if good[w]:
            rows[w].append(d)
    live = {int(k): np.array(rows[k]) for k in np.flatnonzero(good)}
    out = []
    while live and len(out) < MAX_MINED:
        gains = {k: left[r].sum() - 0.5 * bad[k] for k, r in live.items()}
        best = max(gains, key=lambda k: (gains[k], int(uniq[k])))
        if gains[best] < 3:
            break
        out.append(uniq[best])
        r = live.pop(best)
        left[r] = np.maximum(0, left[r] - 1)
    found = np.array(out, np.uint64)
    dense = np.isin(found, np.concatenate(dense_seen))
    # A term that counts by presence has no need to count by density as well.
    terms = np.where(dense, found ^ DENSE_MARK, found)
    use = ~dense | ~np.isin(terms, found[~dense])
    return terms[use], dense[use]


def firing(n_hits: np.ndarray, sizes: np.ndarray, by_density: np.ndarray) -> np.ndarray:
    """Which term voters fire: by presence or by density."""
    dense = (n_hits >= 2) & (n_hits >= DENSE * np.maximum(sizes, 1)[:, None])
    return np.where(by_density, dense, n_hits > 0)


def votes(fired: np.ndarray) -> np.ndarray:
    """All voters: one a term, then two or more terms, four or more, and no term at all."""
    n = fired.sum(1)
    return np.stack([*fired.T, n >= 2, n >= 4, n == 0], 1) if fired.shape[1] else np.stack([n >= 2, n >= 4, n == 0], 1)


def label_model(v: np.ndarray, start: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of the rows from those to ``start`` with, each voter's accuracy as the share of toxic among the rows where it fires, and its share of evidence."""
    v = v.astype(float)
    fires = v.sum(0)
    post = start
    share = np.ones(v.shape[1])
    for k in range(rounds):
        toxic = (post @ v + 2 * prior) / (fires + 2)
        if k == rounds // 2:  # correlations that the class leaves: products of residuals
            rate = np.stack([((1 - post) @ v) / max(1e-9, (1 - post).sum()), (post @ v) / max(1e-9, post.sum())])
            res = v - ((1 - post)[:, None] * rate[0] + post[:, None] * rate[1])
            cov = res.T @ res / len(v)
            sd = np.sqrt(np.diag(cov)) + 1e-9
            corr = np.abs(cov / np.outer(sd, sd))
            share = 1 / np.where(corr > 0.3, corr, 0).sum(1).clip(1)
        weight = share * (np.log(toxic / (1 - toxic)) - np.log(prior / (1 - prior)))
        post = _balanced(v @ weight, prior)
    return post, toxic, share


def _balanced(evidence: np.ndarray, prior: float) -> np.ndarray:
    """Posteriors whose mean is the prior: without that the latent class may drift to whatever splits the rows best."""
    lo, hi = -40.0, 40.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if sigmoid(evidence + mid).mean() > prior else (mid, hi)
    return sigmoid(evidence + (lo + hi) / 2)


def _inputs(n_hits, sizes, written, by_density):
    fired = firing(n_hits, sizes, by_density)
    n = np.where(fired, n_hits, 0).sum(1)
    return np.concatenate([written, votes(fired).astype(float), np.log1p(n)[:, None], np.log1p(100 * n / np.maximum(sizes, 1))[:, None]], 1)


def fit(sample: list, unlabelled: list[str] = ()) -> dict:
    texts = [t for _, t, _ in sample]
    y = np.array([l for _, _, l in sample], int)
    seed = np.array([_hash_word(w) for w in SEED_LEXICON], np.uint64)
    mined, dense = mine(texts, y)
    terms = {int(t): False for t in seed} | {int(t): bool(d) for t, d in zip(mined, dense, strict=True) if int(t) not in seed}
    lexicon = np.array(sorted(terms), np.uint64)
    model = {"lexicon": lexicon, "by_density": np.array([terms[int(t)] for t in lexicon])}
    if len(set(y.tolist())) < 2:
        w = np.zeros(len(PATTERNS) + len(lexicon) + 5)
        w[len(PATTERNS) : len(PATTERNS) + len(lexicon)] = 3.0
        return model | {"w": w, "b": -3.0}
    texts += list(unlabelled)
    parts = [(*counts(x, lexicon), patterns(x)) for x in (pa.array(texts[lo : lo + 512], pa.large_string()) for lo in range(0, len(texts), 512))]
    n_hits, sizes, written = (np.concatenate(x) for x in zip(*parts, strict=True))
    prior = float(np.clip(y.mean(), 0.01, 0.5))
    by_term = votes(firing(n_hits, sizes, model["by_density"]))
    start = np.where(by_term[:, :-1].any(1), 0.9, 0.02)
    post, toxic, share = label_model(np.concatenate([written, by_term], 1), start, prior)
    w, b = logistic(_inputs(n_hits, sizes, written, model["by_density"]), post)
    return model | {"w": w, "b": b, "accuracy": toxic, "share": share}


def scores(model: dict, col: pa.Array) -> np.ndarray:
    n_hits, sizes = counts(col, model["lexicon"])
    return sigmoid(_inputs(n_hits, sizes, patterns(col), model["by_density"]) @ model["w"] + model["b"])


def _score(model: dict, threshold: float):
    def run(batches):
        for part in slices(batches, "text"):
            score = scores(model, part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.3, max_rows: int = 8_000, max_bytes: int = 48 << 20) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.  ``held_out``: a condition on the id; such rows teach nothing."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, ~held_out, max_rows, max_bytes, doc_id, text)
    model = fit(sample, unlabelled_sample(docs, labels, label, ~held_out, max_rows // 2, max_bytes // 2, doc_id, text) if sample else [])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    return rows.mapInArrow(_score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"), crc_mod("doc_id", 4) == 2)
