"""Toxicity by compression length: how much zstandard saves on a text with toxic words at hand.

Two dictionaries share a sample of windows of ordinary text; the toxic one also
has, nearest to the data, the words that toxic text uses in many contexts and
ordinary text hardly ever (contexts, so that copies of one text do not count
again).  A text is lower-cased, reduced to its words and cut into windows of
eight words; each window is compressed with both and is toxic by as many bytes
as the toxic dictionary saves.  In dictionaries and windows alike a word is
followed by eight bytes of its own digest: a match of a whole word then saves
far more than a match costs, and syllables that two words share save nothing
extra.  The spread of the windows' savings gives a few features, and a logistic
curve fitted on the training rows calibrates them; the threshold is one half.

This is not the method of two dictionaries trained separately, which finds far
too little here (the README has the figures): in effect the toxic dictionary is
a learned list of words, and compression is how it is looked up and weighed.

Training takes at most about ``fit_rows`` labelled rows of each class, chosen by
a hash of the id, ``base_windows`` ordinary windows and ``words_bytes`` of toxic
words, those with most contexts (documented bounds).  Whole texts are used, on
the executors: the driver gets words, windows and features only.  Scoring takes
every window of every whole text.

Defined cases: null text counts as empty and gets the score of a text without
toxic windows; with labels of one class only (or none) the score is that share
(or 0); an empty table gives no rows; repeated rows are scored one by one; rows
with a null id are scored, but not learned from; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import drop_written, written

WORDS = 8
#: Bytes that are part of words of lower-cased text; all others part them.
_WORDS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_WORDS).split()


def _line(words: list[bytes]) -> bytes:
    digest = xxhash.xxh3_64_digest
    return b" " + b" ".join([w + digest(w) for w in words]) + b" "


def windows(text: str | None) -> list[bytes]:
    """All windows of the text; one (maybe of no words) at least."""
    words = words_of(text)
    return [_line(words[i : i + WORDS]) for i in range(0, max(1, len(words)), WORDS)]


def contexts(texts: list[str | None]) -> tuple[set[tuple[bytes, int]], int]:
    """((word, digest of the word before it), also for each five- or six-byte head of longer words; bytes of words)."""
    seen: set[tuple[bytes, int]] = set()
    size = 0
    for t in texts:
        words = words_of(t)
        size += sum(map(len, words))
        for before, w in zip([b"", *words], words):
            if len(w) >= 4:
                at = xxhash.xxh3_64_intdigest(before) >> 1
                seen.add((w, at))
                for k in (5, 6):
                    if len(w) > k:
                        seen.add((w[:k] + b"*", at))
    return seen, size


def distinctive_words(sample: DataFrame, words_bytes: int = 32768) -> list[bytes]:
    """Words of ``sample`` (y, t) that mark toxic text, the surest last; ``words_bytes`` at most, digests included."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_pylist()
            for kind in (0, 1):
                for at in range(0, b.num_rows, 200):
                    seen, size = contexts([t.as_py() for t, k in zip(b.column(1)[at : at + 200], y[at : at + 200]) if k == kind])
                    rows = [*seen, (None, size)]
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([w for w, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], names=["y", "w", "n"])

    found = written(sample.select("y", "t").mapInArrow(pairs, "y int, w binary, n long"), "contexts")
    size = {r.y: max(1, r.n or 0) for r in found.where("w is null").groupBy("y").agg(F.sum("n").alias("n")).collect()}
    counts = found.where("w is not null").distinct().groupBy("w").agg(F.sum("y").alias("c"), F.sum(1 - F.col("y")).alias("o")).where("c >= 2")
    odds = F.log(F.col("c") / size[1]) - F.log((F.col("o") + 1) / size[0])
    counts = written(counts.select("w", "c", odds.alias("odds"), (F.substring("w", -1, 1) == F.lit(b"*")).alias("head")), "words")
    heads = counts.where("head and odds > 3 and c >= 15").orderBy(F.desc("c"), "w").limit(words_bytes // 12).select(F.expr("substring(w, 1, length(w) - 1)").alias("w")).collect()
    of_head = F.lit(False)
    for k in (5, 6):
        own = [r.w for r in heads if len(r.w) == k]
        if own:
            of_head |= (F.length("w") > k) & F.substring("w", 1, k).isin([F.lit(bytes(w)) for w in own])
    best = counts.where("not head").where(of_head | F.expr("c >= 6 and odds > 2.5")).orderBy(F.desc("c"), F.desc("w")).limit(words_bytes // 12).collect()
    drop_written(found)
    drop_written(counts)
    chosen, left = [], words_bytes
    for r in best:
        left -= len(r.w) + 9
        if left < 0:
            break
        chosen.append(bytes(r.w))
    return chosen[::-1]


def ordinary_windows(sample: DataFrame, n: int = 256) -> list[bytes]:
    """The ``n`` windows of ordinary texts of ``sample`` (y, t) with the least digests: a random choice that does not hang on partitions."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = {xxhash.xxh3_64_intdigest(w, 11) >> 1: w for t in b.column(1) for w in windows(t.as_py())}
            keys = sorted(own)[:n]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([own[k] for k in keys], pa.binary())], names=["k", "w"])

    found = sample.where("y = 0").select("y", "t").mapInArrow(least, "k long, w binary")
    return [bytes(r.w) for r in found.distinct().orderBy("k").limit(n).collect()]


@dataclass
class CompressionModel:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None = None
    constant: float = 0.0

    def __post_init__(self) -> None:
        self._packers = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_packers": None}

    def saved(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, for each window."""
        if self._packers is None:
            make = lambda d: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            self._packers = make(self.ordinary).compress, make(self.toxic).compress
        a, b = self._packers
        return np.array([len(a(w)) - len(b(w)) for w in parts], np.float64)

    def features(self, text: str | None) -> np.ndarray:
        x = self.saved(windows(text))
        return np.array([*(np.sqrt((x >= k).mean()) for k in (1, 2, 4, 7, 10)), *(np.sqrt((x <= -k).mean()) for k in (1, 2, 4)), np.sqrt(np.maximum(x - 1, 0).mean()), np.maximum(np.sort(x)[-3:], 0).sum() / 40, x.mean() / 4, np.log1p(len(x)) / 10])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        z = np.stack([self.features(t) for t in texts]) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.clip(q * (1 - q), 1e-6, None)[:, None]).T @ x + ridge, x.T @ (q - y) + ridge @ w)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 2500, words_bytes: int = 32768, base_windows: int = 256) -> CompressionModel:
    """A model from ``labels`` (id, 1 toxic or 0); ``labels`` must hold only rows to learn from."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_i")).agg(F.max(label_col).cast("int").alias("y")).where("y in (0, 1)")
    sizes = {r.y: r["count"] for r in marks.groupBy("y").count().collect()}  # two rows
    million = 1_000_000
    limit = {k: int(min(1.0, fit_rows / max(1, sizes.get(k, 1))) * million) + 1 for k in (0, 1)}
    some = marks.where(F.pmod(F.xxhash64(F.col("_i").cast("string"), F.lit("toxic")), F.lit(million)) < F.when(F.col("y") == 1, limit[1]).otherwise(limit[0]))
    # the chosen ids are about ``2 * fit_rows`` at most, so they go to the texts and not the texts to them
    text = docs.select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    sample = written(text.join(F.broadcast(some), "_i").select("y", F.col("_i").cast("string").alias("i"), "t"), "toxic")
    seen = {r.y for r in sample.select("y").distinct().collect()}
    if seen != {0, 1}:
        drop_written(sample)
        return CompressionModel(b"", b"", None, 1.0 if 1 in seen else 0.0)
    base = b"".join(ordinary_windows(sample, base_windows))
    model = CompressionModel(base, base + _line(distinctive_words(sample, words_bytes)))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [held.value.features(t.as_py()).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.binary())], names=["y", "i", "f"])

    found = sample.select("y", "i", "t").mapInArrow(measured, "y int, i string, f binary").toPandas().sort_values(["y", "i", "f"])  # about ``2 * fit_rows`` rows
    drop_written(sample)
    model.weights = _logistic(np.stack([np.frombuffer(f) for f in found.f]), found.y.to_numpy(np.float64))
    return model


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(batch.column(1).to_pylist()))], names=[id_col, "score"])

    return base.mapInArrow(compute, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
