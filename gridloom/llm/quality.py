"""Quality classification by positive-unlabelled learning.

A small network is fitted on trusted positives (labelled good) and unlabelled
web text with the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),

so unlabelled text is neither taken as bad nor trusted as good.  The class
prior is estimated from positives and unlabelled text alone: models that tell
one from the other are cross-fitted, and above each of many scores the ratio of
the share of unlabelled to the share of positive texts is taken, with one
standard error of its own added; the least is the estimate (the median over a
few seeds).  Labelled bad rows, where there are any, do nothing but place the
scores on a scale (Platt), so that a score can be read as a probability.

Features describe the whole text and no language: shares of kinds of bytes,
repeated neighbours, word and line shapes.  They are computed in one pass over
bytes and words.

Fitting takes at most about ``fit_rows`` rows of each kind, chosen by a hash of
the id (a documented bound); scoring takes every row.

Defined cases: null text counts as empty; an empty text gets the score of the
all-zero features; without positives every score is 0.5; where no unlabelled row
is drawn (labels cover every document), all documents, their labels unseen, are
the unlabelled text; repeated rows are
scored one by one; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"|", b"#", b"$", b"%", b"&", b"*", b"<>", b"()[]{}", b"'\"", b"-_", b":;", b"/\\", b"@", b"=+~^`", b"\t\r\x0b\x0c", bytes(range(128, 192)), bytes(range(192, 256))]
_LUT = np.zeros(256, np.intp)
for _i, _k in enumerate(_KINDS):
    _LUT[list(_k)] = _i + 1
N_FEATURES = len(_KINDS) + 1 + 10


def features(text: str | None) -> np.ndarray:
    """Numbers between about 0 and 1 that describe the whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES, np.float32)
    if not data:
        return out
    share = np.bincount(_LUT, np.bincount(np.frombuffer(data, np.uint8), minlength=256), len(_KINDS) + 1) / len(data)
    k = len(_KINDS) + 1
    out[:k] = np.sqrt(share)
    words = data.split()
    n = len(words)
    if n:
        distinct = len(set(words))
        out[k] = sum(map(bytes.__eq__, words, words[1:])) / n
        out[k + 1] = distinct / n
        out[k + 2] = np.log1p(distinct) / np.log1p(n)
        out[k + 3] = min(1.0, len(data) / n / 20)
        out[k + 4] = 1 / n
        out[k + 5] = np.log1p(n) / 12
        lines = data.split(b"\n")
        out[k + 6] = 1 - len(set(lines)) / len(lines)
        out[k + 7] = min(1.0, np.log1p(len(data) / len(lines)) / 10)
        out[k + 8] = sum(map(bytes.isupper, words)) / n
        out[k + 9] = max(map(len, words)) / (max(map(len, words)) + 50)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class PuModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(x) + self.shift)


def _fit_risk(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int = 500, hidden: int = 12, rate: float = 0.02, seed: int = 5) -> list[np.ndarray]:
    """Weights that minimise the non-negative PU risk; with no prior, those that tell ``p`` from ``u``."""
    rng = np.random.default_rng(seed)
    d = p.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for step in range(1, steps + 1):
        pb, ub = p[rng.integers(0, len(p), 512)], u[rng.integers(0, len(u), 512)]
        x = np.concatenate([pb, ub])
        h = np.tanh(x @ w[0] + w[1])
        z = h @ w[2] + w[3][0]
        s = _sigmoid(z)
        sp, su = s[:512], s[512:]
        dz = np.empty(1024)
        if prior is None:
            dz[:512], dz[512:] = (sp - 1) / 1024, su / 1024
        else:  # logistic loss: l(z) = log(1 + e^-z)
            negative = np.log1p(np.exp(np.clip(z[512:], -30, 30))).mean() - prior * np.log1p(np.exp(np.clip(z[:512], -30, 30))).mean()
            if negative >= 0:
                dz[:512], dz[512:] = (prior * (sp - 1) - prior * sp) / 512, su / 512
            else:  # step back from what makes the risk negative
                dz[:512], dz[512:] = prior * sp / 512, -su / 512
        dh = np.outer(dz, w[2]) * (1 - h * h)
        g = [x.T @ dh + 1e-3 * w[0], dh.sum(axis=0), h.T @ dz + 1e-3 * w[2], np.array([dz.sum()])]
        for i in range(4):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
            w[i] = w[i] - rate * (1 - step / (steps + 1)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 2, seeds: int = 5) -> float:
    """Share of positives among the unlabelled rows of features, from cross-fitted scores."""
    levels = np.linspace(0.0, 0.95, 96)
    folds = min(folds, len(positive), len(unlabelled))
    if folds < 2:
        return 0.5
    found = []
    for seed in range(seeds):
        rng = np.random.default_rng(seed)
        p_fold, u_fold = rng.permutation(len(positive)) % folds, rng.permutation(len(unlabelled)) % folds
        above_p, above_u = np.zeros(len(levels)), np.zeros(len(levels))
        for k in range(folds):
            w1, b1, w2, _ = _fit_risk(positive[p_fold != k], unlabelled[u_fold != k], None, seed=seed)
            p, u = (np.tanh(x @ w1 + b1) @ w2 for x in (positive[p_fold == k], unlabelled[u_fold == k]))
            t = np.quantile(p, levels)
            above_p += len(p) - np.searchsorted(np.sort(p), t)
            above_u += len(u) - np.searchsorted(np.sort(u), t)
        qp, qu = above_p / len(positive), np.maximum(above_u, 0.5) / len(unlabelled)
        ratio = qu / qp
        error = ratio * np.sqrt((1 - qu) / (qu * len(unlabelled)) + (1 - qp) / (qp * len(positive)))
        found.append((ratio + error).min())
    return float(np.clip(np.median(found), 0.02, 0.98))


def fit_arrays(positive: np.ndarray, unlabelled: np.ndarray, negative: np.ndarray | None = None) -> PuModel | None:
    """A model from rows of features; ``negative`` rows only set its scale."""
    if not len(positive) or not len(unlabelled):
        return None
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    z = lambda x: np.clip((x - mean) / scale, -6, 6)
    prior = estimate_prior(z(positive), z(unlabelled))
    model = PuModel(mean, scale, _fit_risk(z(positive), z(unlabelled), prior), prior)
    if negative is not None and len(negative):
        raw = np.concatenate([model.raw(positive), model.raw(negative)])
        y = np.concatenate([np.ones(len(positive)), np.zeros(len(negative))])
        a, b = 1.0, 0.0
        for _ in range(60):  # Newton steps of a ridge-regularised logistic fit
            q = _sigmoid(a * raw + b)
            r = np.clip(q * (1 - q), 1e-6, None)
            g = np.array([((q - y) * raw).sum() + 1e-2 * a, (q - y).sum()])
            hess = np.array([[(r * raw * raw).sum() + 1e-2, (r * raw).sum()], [(r * raw).sum(), r.sum() + 1e-6]])
            step = np.linalg.solve(hess, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if a > 0:
            model.slope, model.shift = float(a), float(b)
    return model


def _feature_table(rows: DataFrame) -> DataFrame:
    """``kind, i, f`` of rows ``kind, i, t``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t.as_py()).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.binary())], names=["kind", "i", "f"])

    return rows.select("kind", "i", "t").mapInArrow(compute, "kind int, i string, f binary")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = 8000, learn: Column | None = None) -> PuModel | None:
    """A model from ``labels`` (id, 1 for a trusted good text, 0 for a known bad one) and the unlabelled rest of ``docs``.

    Where ``learn`` (over the columns of ``labels``) does not hold, a label is
    not learned from, and its document is not unlabelled text either.  About
    ``fit_rows`` rows of each kind are used at most.
    """
    named = labels.where(F.col(id_col).isNotNull()).withColumn("_i", F.col(id_col))
    seen = named.select("_i").distinct()
    marks = named.where(F.col(label_col).isNotNull() & (F.lit(True) if learn is None else learn)).groupBy("_i").agg(F.max(label_col).cast("int").alias("kind"))
    sizes = {r.kind: r["count"] for r in marks.groupBy("kind").count().collect()}  # two rows
    n_docs = docs.count()
    million = 1_000_000
    at = F.pmod(F.xxhash64(F.col("_i").cast("string"), F.lit("quality")), F.lit(million))
    limit = {k: int(min(1.0, fit_rows / max(1, n)) * million) + 1 for k, n in {**sizes, -1: max(1, n_docs - sum(sizes.values()))}.items()}
    keys = marks.where(F.col("kind").isin(0, 1)).where(at < F.when(F.col("kind") == 1, limit.get(1, million)).otherwise(limit.get(0, million)))
    text = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("t"))
    # the chosen ids are about ``2 * fit_rows`` at most, so they go to the texts
    labelled = text.join(F.broadcast(keys), "_i").select("kind", F.col("_i").cast("string").alias("i"), "t")
    free = text.where(at < limit[-1]).join(seen, "_i", "left_anti").select(F.lit(-1).alias("kind"), F.col("_i").cast("string").alias("i"), "t")
    found = _feature_table(labelled.unionByName(free)).toPandas()
    if not (found.kind == -1).any():
        every = text.where(at < int(min(1.0, fit_rows / max(1, n_docs)) * million) + 1).select(F.lit(-1).alias("kind"), F.col("_i").cast("string").alias("i"), "t")
        found = pd.concat([found, _feature_table(every).toPandas()])
    found = found.sort_values(["kind", "i"], ignore_index=True)
    of = lambda k: np.stack([np.frombuffer(f, np.float32) for f in found.f[found.kind == k]]).astype(np.float64) if (found.kind == k).any() else np.empty((0, N_FEATURES))
    return fit_arrays(of(1), of(-1), of(0))


def score_batches(batches: Iterator[pa.RecordBatch], model: PuModel | None, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with the score of each of its rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([features(t.as_py()) for t in batch.column(column)]).astype(np.float64)
        yield batch, model.score(x) if model else np.full(len(x), 0.5)


def score(docs: DataFrame, model: PuModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in score_batches(batches, held.value, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=[id_col, "score"])

    return base.mapInArrow(compute, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: PuModel | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in score_batches(batches, held.value, column):
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(compute, docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the quality of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
