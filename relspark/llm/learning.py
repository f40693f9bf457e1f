"""A bounded sample of labelled rows, and small numpy models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, max_rows: int, max_bytes: int, doc_id: str = "doc_id", text: str = "text") -> list:
    """Up to ``max_rows`` rows (id, text, y) and ``max_bytes`` bytes of text, in the order of a hash of the id.

    ``learn`` is a condition on the id column: only rows that meet it are ever
    seen.  Rows of several labels take the larger; null labels and ids are left out.
    An id of several texts gives one; texts that don't fit into the bytes left are skipped.
    """
    y = labels.where(learn & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("y"))
    order = F.md5(F.concat(F.lit("fit:"), F.col(doc_id).cast("string")))
    y = y.select(F.col(doc_id).alias("id_"), "y", order.alias("o_")).orderBy("o_").limit(max_rows)
    rows = y.collect()  # max_rows rows at most
    if not rows:
        return []
    spark = docs.sparkSession
    picked = spark.createDataFrame([(r.id_, r.y, r.o_) for r in rows], "id_ long, y int, o_ string")
    found = docs.select(F.col(doc_id).alias("id_"), F.coalesce(F.col(text), F.lit("")).alias("t_")).join(F.broadcast(picked), "id_")
    # One text of each id, the first by its hash; a text that doesn't fit is left out and the next ones are tried.
    sizes = found.select("id_", "o_", F.md5("t_").alias("m_"), F.octet_length("t_").alias("n")).groupBy("id_", "o_").agg(F.min(F.struct("m_", "n")).alias("t")).collect()
    total, texts = 0, []
    for r in sorted(sizes, key=lambda r: r.o_):
        if total + r.t.n <= max_bytes:
            total += r.t.n
            texts.append((r.id_, r.t.m_))
    if not texts:
        return []
    out = found.withColumn("m_", F.md5("t_")).join(F.broadcast(spark.createDataFrame(texts, "id_ long, m_ string")), ["id_", "m_"], "left_semi").dropDuplicates(["id_"])
    return sorted(((r.o_, r.t_, r.y) for r in out.select("o_", "t_", "y").collect()), key=lambda r: r[:2])


def unlabelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, max_rows: int, max_bytes: int, doc_id: str = "doc_id", text: str = "text") -> list[str]:
    """Up to ``max_rows`` texts and ``max_bytes`` bytes of rows that meet ``learn`` and have no label, in the order of a hash of their id."""
    known = labels.where(F.col(label).isNotNull()).select(F.col(doc_id).alias("id_")).distinct()
    rows = docs.where(learn & F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id_"), F.col(text).alias("t_"))
    sizes = rows.select("id_", F.octet_length("t_").alias("n")).join(known, "id_", "left_anti").groupBy("id_").agg(F.max("n").alias("n"))
    sizes = sizes.select("id_", "n", F.md5(F.concat(F.lit("more:"), F.col("id_").cast("string"))).alias("o_")).orderBy("o_").limit(max_rows).collect()
    total, ids = 0, []
    for r in sorted(sizes, key=lambda r: r.o_):
        if total + r.n <= max_bytes:
            total += r.n
            ids.append((r.id_,))
    if not ids:
        return []
    picked = docs.sparkSession.createDataFrame(ids, "id_ long")
    got = rows.join(F.broadcast(picked), "id_").groupBy("id_").agg(F.min("t_").alias("t_")).collect()
    return [r.t_ for r in sorted(got, key=lambda r: r.id_)]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, target: np.ndarray, l2: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets, by Newton steps."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w)) * l2 * max(1, len(x)) ** 0.5
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x1 @ w)
        grad = x1.T @ (p - target) + ridge @ w
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 + ridge
        step = np.linalg.solve(hess + 1e-6 * np.eye(len(w)), grad)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def two_layer(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7, l2: float = 1e-4) -> dict:
    """A ReLU network with one hidden layer, trained by Adam on class-weighted cross entropy."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 64):
            b = order[lo : lo + 64]
            h = np.maximum(0, x[b] @ p[0] + p[1])
            d = (sigmoid(h @ p[2] + p[3][0]) - y[b]) / len(b)
            dh = np.outer(d, p[2]) * (h > 0)
            grads = [x[b].T @ dh + l2 * p[0], dh.sum(0), h.T @ d + l2 * p[2], np.array([d.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 2e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "scale": scale, "w1": p[0], "b1": p[1], "w2": p[2], "b2": float(p[3][0]), "temperature": 1.0}


def logits(net: dict, x: np.ndarray) -> np.ndarray:
    h = np.maximum(0, np.clip((x - net["mean"]) / net["scale"], -8, 8) @ net["w1"] + net["b1"])
    return h @ net["w2"] + net["b2"]


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows that training didn't see."""
    if not len(z):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [-(y * np.log(sigmoid(z / t) + 1e-12) + (1 - y) * np.log(1 - sigmoid(z / t) + 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
