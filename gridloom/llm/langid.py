"""Language identification by a byte convolutional network, trained in numpy.

The text is lower-cased, encoded as UTF-8 and cut into windows of 256 bytes.
Each byte becomes one of 64 classes; filters of widths 2, 3 and 4 over one-hot
classes are max-pooled over the window and a softmax layer gives the languages.
As the input is one-hot, a filter is a sum of table look-ups, so inference adds
rows of small tables for pairs of classes.  All windows of the whole text are
scored; the text's language is that of the highest mean log-probability.

Training takes about ``fit_rows`` rows (a parameter of :func:`fit`) of each
language, chosen by a hash of the id, and all rows of a language that has no
more, and runs on the driver: a language is learned however few of the rows are
its own.  The model is a few hundred kB.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
null languages are not learned from; with no labelled rows at all every text is
``und``; repeated rows are scored one by one; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTHS, FILTERS, WINDOW, CLASSES = (2, 3, 4), 12, 256, 64
UNKNOWN = "und"


def _byte_classes() -> np.ndarray:
    """Letters have a class each; so have the 64 tails of UTF-8, folded in half; other bytes share a few."""
    lut = np.zeros(256, np.uint8)
    lut[33:48] = lut[58:65] = lut[91:97] = lut[123:127] = 1
    lut[48:58] = 2
    for b in range(97, 123):
        lut[b] = 3 + b - 97
    for b in range(128, 192):
        lut[b] = 29 + (b & 31)
    lut[192:] = 61
    lut[0xC3], lut[0xC2] = 62, 63
    return lut


_LUT = _byte_classes()


def windows_of(texts: list[str | None], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(classes of all windows, windows of each text); the last window of a text is filled with spaces."""
    parts, counts = [], []
    for t in texts:
        data = (t or "").lower().encode("utf-8", "surrogatepass")
        n = -(-len(data) // size)
        parts.append(data.ljust(n * size))
        counts.append(n)
    return _LUT[np.frombuffer(b"".join(parts), np.uint8)].reshape(-1, size), np.array(counts)


class ByteConvNet:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.dense = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.base = np.zeros(len(languages), np.float32)
        self.pairs = None

    def _features(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled filters of each window, and the places of their maxima; for training."""
        values, places = [], []
        for t, b, w in zip(self.tables, self.bias, WIDTHS):
            n = x.shape[1] - w + 1
            s = sum(t[j][x[:, j : j + n]] for j in range(w))
            at = s.argmax(axis=1)
            places.append(at)
            values.append(np.take_along_axis(s, at[:, None, :], 1)[:, 0] + b)
        return np.maximum(np.concatenate(values, axis=1), 0), np.stack(places, 1)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 900, batch: int = 192, rate: float = 0.01, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        own = [*self.tables, self.bias, self.dense, self.base]
        m, v = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own]
        weight = (1 / np.bincount(y, minlength=len(self.languages)).clip(1))[y]
        chance = weight / weight.sum()
        for step in range(1, steps + 1):
            pick = rng.choice(len(x), batch, p=chance)
            xb, yb = x[pick], y[pick]
            h, places = self._features(xb)
            z = h @ self.dense + self.base
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(batch), yb] -= 1
            dz = p / batch
            dh = (dz @ self.dense.T) * (h > 0)
            grads = [np.zeros_like(t) for t in self.tables]
            for k, w in enumerate(WIDTHS):
                g = dh[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    np.add.at(grads[k][j], (xb[np.arange(batch)[:, None], places[:, k] + j], np.arange(FILTERS)[None, :]), g)
            grads += [dh.sum(axis=0).reshape(self.bias.shape), h.T @ dz + 1e-4 * self.dense, dz.sum(axis=0)]
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                own[i] -= (now * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.pairs = [[(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(-1, FILTERS) if j + 1 < len(t) else t[j] for j in range(0, len(t), 2)] for t in self.tables]

    def log_probabilities(self, x: np.ndarray, part: int = 512) -> np.ndarray:
        """Of each window, for each language."""
        out = np.empty((len(x), len(self.languages)), np.float32)
        for a in range(0, len(x), part):
            xb = x[a : a + part].astype(np.int32)
            two = xb[:, :-1] * CLASSES + xb[:, 1:]
            values = []
            for k, w in enumerate(WIDTHS):
                n = x.shape[1] - w + 1
                s = np.take(self.pairs[k][0], two[:, :n], axis=0)
                if w == 3:
                    s += np.take(self.pairs[k][1], xb[:, 2 : 2 + n], axis=0)
                elif w == 4:
                    s += np.take(self.pairs[k][1], two[:, 2 : 2 + n], axis=0)
                values.append(s.max(axis=1) + self.bias[k])
            z = np.maximum(np.concatenate(values, axis=1), 0) @ self.dense + self.base
            z -= z.max(axis=1, keepdims=True)
            out[a : a + part] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        x, counts = windows_of(texts)
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not len(x):
            return names, scores
        logs = self.log_probabilities(x)
        ends = np.cumsum(counts)
        for i, (t, n, e) in enumerate(zip(texts, counts, ends)):
            if n and any(map(str.isalpha, t)):
                mean = logs[e - n : e].mean(axis=0, dtype=np.float64)
                p = np.exp(mean - mean.max())
                k = int(p.argmax())
                names[i], scores[i] = self.languages[k], float(p[k] / p.sum())
        return names, scores


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 6000, windows: int = 4) -> ByteConvNet | None:
    """A network from at most about ``fit_rows`` rows of each language, with up to ``windows`` windows of each; None without labels.

    The rows are those with the smallest hashes of their ids (of their texts, where the id is null), a share that is
    set for each language by the number of its rows.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null and t rlike '\\\\p{L}'")
    sizes = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}  # a row for each language
    if not sizes:
        return None
    steps = 1 << 40
    large = {l: int(fit_rows / n * steps) + 1 for l, n in sizes.items() if n > fit_rows}
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in large.items() for x in pair]), F.col("l")), F.lit(steps)) if large else F.lit(steps)
    at = F.pmod(F.xxhash64(F.coalesce("i", "t"), F.lit("langid")), F.lit(steps))
    length = WINDOW * windows
    some = rows.where(at < limit).select("i", F.expr(f"substring(t, 1 + cast(pmod(xxhash64(i), greatest(1, length(t) - {length})) as int), {length})").alias("t"), "l").sort("i", "l", "t").toPandas()
    languages = sorted(some["l"].unique())
    x, counts = windows_of(some["t"].tolist())
    y = np.repeat(np.searchsorted(languages, some["l"]), counts)
    net = ByteConvNet(languages)
    net.train(x, y)
    return net


def identify(docs: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` of each row."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    base = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, step = [], [], 256
            for a in range(0, batch.num_rows, step):
                texts = batch.column(1)[a : a + step].to_pylist()
                n, s = held.value.predict(texts) if held.value else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                names += n
                scores += s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return base.mapInArrow(score, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the language of every document, learned from three quarters of the rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return identify(docs, net).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
