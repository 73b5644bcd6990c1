"""Language identification by a small byte convolutional network, in numpy.

Filters of several widths slide over the bytes of a fixed-length window, their
greatest response in the window is kept (max pooling after a rectifier), and a
softmax layer gives the languages.  Training runs on the driver over a bounded
sample of labelled rows.  In tasks a text is cut into overlapping windows that
cover all of it; windows are evaluated in batches and a text's probabilities are
the mean over its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanframe.llm.batches import text_slices

WINDOW = 256  # bytes
WIDTHS = (2, 3, 4)
OVERLAP = max(WIDTHS) - 1
UNDETERMINED = "und"
_BLOCK = 256  # windows evaluated at once
SLACK = 4  # rows ranked per row drawn, when training rows are chosen


def windows_of(data: bytes) -> np.ndarray:
    """Overlapping windows (rows of ``WINDOW`` bytes, zero-padded) covering ``data``."""
    step = WINDOW - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + WINDOW, dtype=np.uint8)
    padded[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


@dataclass
class ByteCnn:
    languages: list[str]
    filters: list[np.ndarray]  # per width: (width, 256, filters)
    bias: np.ndarray  # of all filters
    dense: np.ndarray
    dense_bias: np.ndarray

    def responses(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, filters) before the rectifier; used in training."""
        n = x.shape[1] - OVERLAP
        parts = [sum(w[j][x[:, j : j + n]] for j in range(len(w))) for w in self.filters]
        return np.concatenate(parts, axis=2) + self.bias

    def prepare(self) -> None:
        """Sum filter rows per byte pair, so that a position costs three table reads."""
        two, three, four = self.filters

        def pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
            return (first[:, None, :] + second[None, :, :]).reshape(65_536, -1)

        self.head = np.concatenate([pairs(w[0], w[1]) for w in (two, three, four)], axis=1) + self.bias
        self.head = np.ascontiguousarray(self.head, dtype=np.float32)
        self.third = np.ascontiguousarray(three[2], dtype=np.float32)
        self.tail = np.ascontiguousarray(pairs(four[2], four[3]), dtype=np.float32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax of every window."""
        f = self.third.shape[1]
        pooled = np.empty((len(x), 3 * f), dtype=np.float32)
        for lo in range(0, len(x), _BLOCK):
            b = x[lo : lo + _BLOCK]
            pair = b[:, :-1].astype(np.int32) << 8 | b[:, 1:]
            z = self.head[pair[:, :-2]]
            z[:, :, f : 2 * f] += self.third[b[:, 2:-1]]
            z[:, :, 2 * f :] += self.tail[pair[:, 2:]]
            pooled[lo : lo + _BLOCK] = z.max(axis=1)
        return _softmax(np.maximum(pooled, 0) @ self.dense + self.dense_bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train_cnn(
    samples: list[tuple[bytes, str]], filters: int = 8, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 11
) -> ByteCnn:
    """Fit on (window bytes, language) pairs by Adam on the cross entropy."""
    languages = sorted({lang for _, lang in samples})
    rng = np.random.default_rng(seed)
    k, total = len(languages), filters * len(WIDTHS)
    net = ByteCnn(
        languages,
        [rng.normal(0, 0.2, (w, 256, filters)) for w in WIDTHS],
        np.zeros(total),
        rng.normal(0, 0.3, (total, k)),
        np.zeros(k),
    )
    if k:
        x = np.stack([windows_of(data[:WINDOW])[0] for data, _ in samples])
        y = np.array([languages.index(lang) for _, lang in samples])
        weight = (1 / np.bincount(y, minlength=k))[y]  # languages count alike
        weight /= weight.mean()
        params = [*net.filters, net.bias, net.dense, net.dense_bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                grads = _gradients(net, x[rows], y[rows], weight[rows])
                t += 1
                for p, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    net.filters = [w.astype(np.float32) for w in net.filters]
    net.prepare()
    return net


def _gradients(net: ByteCnn, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    z = net.responses(x)
    best = z.argmax(axis=1)
    top = np.take_along_axis(z, best[:, None, :], axis=1)[:, 0]
    hidden = np.maximum(top, 0)
    d = _softmax(hidden @ net.dense + net.dense_bias)
    d[np.arange(len(y)), y] -= 1
    d *= (weight / len(y))[:, None]
    back = (d @ net.dense.T) * (top > 0)
    out, lo = [], 0
    for w in net.filters:
        n = w.shape[2]
        g = np.zeros_like(w)
        for j in range(len(w)):  # only the position of the maximum receives a gradient
            byte = np.take_along_axis(x, best[:, lo : lo + n] + j, axis=1)
            np.add.at(g[j], (byte, np.arange(n)[None, :]), back[:, lo : lo + n])
        out.append(g)
        lo += n
    return [*out, back.sum(axis=0), hidden.T @ d, d.sum(axis=0)]


def labelled_sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[bytes, str]]:
    """At most ``per_language`` windows of each language, one a row, drawn by a hash of id and text.

    A share of that hash, from the language's number of rows, keeps about
    ``SLACK * per_language`` rows of each language before they are ranked, so that
    no common language is sorted whole.  Fewer than ``per_language`` come of a
    larger language only if most of its texts are null or empty.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count().collect()  # one row a language, as the network has outputs
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, SLACK * per_language / r["count"]))])
    rows = rows.filter(F.col("text").isNotNull() & (F.length("text") > 0))
    key = F.xxhash64("id", "text")
    rows = rows.filter(F.pmod(key, F.lit(1 << 30)) < share[F.col("lang")] * F.lit(float(1 << 30)))
    at = F.pmod(key, F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int") + 1
    drawn = rows.select("lang", key.alias("k"), F.substring(F.col("text"), at, F.lit(WINDOW)).alias("t"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("k", "t"))
    chosen = drawn.withColumn("nth", nth).filter(F.col("nth") <= per_language)
    return [(r["t"].encode("utf-8", "surrogatepass"), r["lang"]) for r in chosen.orderBy("lang", "nth").collect()]


def train_language_model(
    df: DataFrame, id_col: str, text_col: str, lang_col: str, usable: Column | None = None, per_language: int = 1500
) -> ByteCnn:
    """Train on the rows that satisfy ``usable``; ``per_language`` bounds the sample of each language."""
    rows = df if usable is None else df.filter(usable)
    return train_cnn(labelled_sample(rows, id_col, text_col, lang_col, per_language))


def predict_text(net: ByteCnn, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and its probability of each whole text."""
    usable = [bool(t) and bool(net.languages) and any(map(str.isalpha, t)) for t in texts]
    data = [t.encode("utf-8", "surrogatepass") for t, ok in zip(texts, usable) if ok]
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if data:
        parts = [windows_of(d) for d in data]
        counts = np.array([len(p) for p in parts])
        p = net.probabilities(np.concatenate(parts))
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        # every window is full but the last of a text
        step = WINDOW - OVERLAP
        size = np.full(len(p), float(WINDOW))
        size[first + counts - 1] = [max(1, len(d) - (n - 1) * step) for d, n in zip(data, counts.tolist())]
        mean = np.add.reduceat(p * size[:, None], first, axis=0) / np.add.reduceat(size, first)[:, None]
        at = mean.argmax(axis=1)
        where = [i for i, ok in enumerate(usable) if ok]
        for i, a, s in zip(where, at.tolist(), mean[np.arange(len(at)), at].tolist()):
            names[i], scores[i] = net.languages[a], min(max(s, 0.0), 1.0)
    return names, scores


def identify_language(df: DataFrame, id_col: str, text_col: str, net: ByteCnn) -> DataFrame:
    """Per row: ``id_col, lang_pred, score``; ``und`` and 0 for null text or text without a letter.

    Whole texts are read, in windows; repeated rows stay repeated and score alike; an empty
    table gives an empty result; other columns are never read.
    """

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 2 << 20):
            names, scores = predict_text(net, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["id", "lang_pred", "score"],
            )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(df: DataFrame, text_col: str, net: ByteCnn, least_score: float = 0.35) -> DataFrame:
    """The rows of ``df`` with a determined language of at least ``least_score``; columns unchanged.

    Null texts and texts without a letter go; rows that repeat all stay or all go.
    """
    at = df.columns.index(text_col)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_col, 2 << 20):
            names, scores = predict_text(net, batch.column(at).to_pylist())
            mask = [n != UNDETERMINED and s >= least_score for n, s in zip(names, scores)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(keep, df.schema)
