"""Language identification by a byte convolutional network (operator 4).

Texts are cut into windows of ``WINDOW`` bytes that together cover all of them.
Filters of several widths run over the embedded bytes of a window, the largest
answer of each filter is pooled, and a softmax layer gives the languages'
probabilities; a text's are the mean over its windows, weighted by their bytes.
The network is trained in numpy by Adam, on ``MAX_WINDOWS`` labelled windows at
most, of at most ``MAX_DOCS`` labelled texts: any window of a text may be drawn,
and no text gets its next one before all others had theirs.

Defined results: a text that is null or has no letter is ``und`` with score 0,
as is everything if there is nothing to learn from; repeated rows get equal
results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import sample_texts
from .words import chunks, offsets

#: Labelled texts, and labelled windows of them, to learn from.
MAX_DOCS, MAX_WINDOWS = 3000, 12_000
WINDOW = 256
EMBEDDED, WIDTHS, FILTERS = 4, (2, 3, 4), 8
EPOCHS, BATCH, RATE = 4, 64, 0.004
UNKNOWN = "und"


def windows(texts: pa.Array, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, real lengths and bytes (padded by 0) of the windows of all texts, which must not be null."""
    at = offsets(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    counts = -(-np.diff(at) // size)
    row = np.repeat(np.arange(len(texts)), counts)
    start = at[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * size
    length = np.minimum(size, at[1:][row] - start)
    padded = np.concatenate([raw, np.zeros(size, np.uint8)])
    out = padded[start[:, None] + np.arange(size)]
    short = length < size
    out[short] *= np.arange(size) < length[short, None]
    return row, length, out


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDED
    filters: list[np.ndarray]  # for each width: (width * EMBEDDED) x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.out, self.out_bias]

    def answers(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Of each width: windows x places x filters."""
        e = self.embedding[x].reshape(len(x), -1)
        for width, f in zip(WIDTHS, self.filters):
            n = x.shape[1] - width + 1
            views = np.lib.stride_tricks.as_strided(e, (len(x), n, width * EMBEDDED), (e.strides[0], EMBEDDED * e.itemsize, e.itemsize))
            yield (views.reshape(-1, width * EMBEDDED) @ f).reshape(len(x), n, -1)

    def features(self, tops: list[np.ndarray]) -> np.ndarray:
        return np.maximum(np.concatenate(tops, 1) + np.concatenate(self.biases), 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.features([a.max(1) for a in self.answers(x)]) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        tops, places = [], []
        for a in self.answers(x):
            places.append(a.argmax(1))
            tops.append(np.take_along_axis(a, places[-1][:, None], 1)[:, 0])
        h = self.features(tops)
        z = h @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        g_h = (p @ self.out.T) * (h > 0)
        g_embedding = np.zeros_like(self.embedding)
        g_filters, g_biases = [], []
        for k, (width, f, where) in enumerate(zip(WIDTHS, self.filters, places)):
            g = g_h[:, k * FILTERS : (k + 1) * FILTERS]
            seen = x[np.arange(len(x))[:, None, None], where[:, :, None] + np.arange(width)]  # rows x filters x width
            e = self.embedding[seen].reshape(len(x), FILTERS, -1)
            g_filters.append(np.einsum("nf,nfd->df", g, e))
            g_biases.append(g.sum(0))
            g_e = (g[:, :, None] * f.T).reshape(len(x), FILTERS, width, EMBEDDED)
            np.add.at(g_embedding, seen, g_e)
        return [g_embedding, *g_filters, *g_biases, h.T @ p, p.sum(0)]


def fit(x: np.ndarray, languages: list[str], y: np.ndarray, seed: int = 7) -> Network:
    """From windows and the place of each one's language."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = Network(
        languages, draw(256, EMBEDDED, scale=0.5), [draw(w * EMBEDDED, FILTERS, scale=0.5) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw(FILTERS * len(WIDTHS), len(languages), scale=0.2), np.zeros(len(languages), np.float32),
    )
    values = net.parameters()
    m, v = [np.zeros_like(a) for a in values], [np.zeros_like(a) for a in values]
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(order), BATCH):
            batch, t = order[a : a + BATCH], t + 1
            for value, g, mm, vv in zip(values, net.gradients(x[batch], y[batch]), m, v):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                value -= (RATE * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame) -> Network | None:
    """From at most MAX_DOCS texts with a language, and MAX_WINDOWS of their windows; None if there are none."""
    known = sample_texts(docs.where("lang is not null and text is not null and text <> ''"), MAX_DOCS, "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                row, _, x = windows(part.column("text"))
                hashes = np.array([zlib.crc32(w) for w in x], np.int64)
                order = np.lexsort((hashes, row))
                turn = np.empty(len(x), np.int64)  # each text's windows in the order of their hashes
                turn[order] = np.arange(len(x)) - np.searchsorted(row, row)[order]
                for a in range(0, len(x), 4096):
                    b = a + 4096
                    yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(row[a:b])), pa.array(turn[a:b]), pa.array([w.tobytes() for w in x[a:b]], pa.binary())], ["lang", "turn", "bytes"])

    got = known.select("lang", "text").mapInArrow(cut, "lang string, turn long, bytes binary").orderBy("turn", F.xxhash64("bytes"), "lang").limit(MAX_WINDOWS).collect()
    if not got:
        return None
    languages = sorted({r.lang for r in got})
    place = {name: k for k, name in enumerate(languages)}
    return fit(np.stack([np.frombuffer(bytes(r.bytes), np.uint8) for r in got]), languages, np.array([place[r.lang] for r in got]))


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """All columns of docs, plus lang_pred and score."""
    rest = docs.drop("lang_pred", "score")
    schema = rest.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    held = docs.sparkSession.sparkContext.broadcast(net)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts = part.column("text").fill_null("")
                letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                net = held.value
                if net is None:
                    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    row, length, x = windows(texts)
                    total = np.zeros((len(texts), len(net.languages)))
                    for a in range(0, len(x), BATCH):
                        np.add.at(total, row[a : a + BATCH], net.probabilities(x[a : a + BATCH]) * length[a : a + BATCH, None])
                    total /= np.maximum(1, total.sum(1, keepdims=True))
                    best = total.argmax(1)
                    names = [net.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
                    scores = np.where(letters, np.minimum(1, total.max(1)), 0.0)
                yield part.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(scores))

    return rest.mapInArrow(make, schema)
