"""Quality classifier: a byte-level convolutional network in numpy.

Filters of eight bytes slide over the whole document by four bytes. Their responses are max-pooled over overlapping
chunks of 512 bytes (half a chunk apart), squashed, and combined over all chunks by their mean and maximum into one
probability. The first layer is held as one table of responses per place and byte value, so a convolution is eight
table look-ups and its gradient reaches only the positions that won a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_remainder, text_of

WIDTH, STRIDE, FILTERS = 8, 4, 24
HALF = 64  # positions of half a chunk: 256 bytes
BLOCK = HALF * STRIDE


def _byte_features() -> np.ndarray:
    b = np.arange(256)
    kinds = [(b >= 97) & (b <= 122), (b >= 65) & (b <= 90), (b >= 48) & (b <= 57), (b <= 32), (b > 32) & (b < 48) | (b > 57) & (b < 65) | (b > 90) & (b < 97) | (b > 122) & (b < 128), b >= 128]
    return np.stack(kinds, 1).astype(np.float32)


class ConvNet:
    """table: (WIDTH, 256, FILTERS); the head weighs means and maxima of the pooled responses."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        kinds = _byte_features()
        table = kinds @ rng.normal(0, 0.35, (WIDTH, kinds.shape[1], FILTERS)) + rng.normal(0, 0.12, (WIDTH, 256, FILTERS))
        self.table = table.astype(np.float32)
        self.bias = np.full(FILTERS, -0.5, np.float32)
        self.head = np.zeros(2 * FILTERS, np.float32)
        self.head_bias = np.zeros(1, np.float32)

    @staticmethod
    def padded(text: bytes) -> np.ndarray:
        """Bytes up to a whole number of half chunks, at least WIDTH spaces after the text."""
        n = -(-(len(text) + WIDTH) // BLOCK) * BLOCK
        out = np.full(n, 32, np.uint8)
        out[: len(text)] = np.frombuffer(text, np.uint8)
        return out

    def blocks(self, data: np.ndarray, with_place: bool = False):
        """Maxima of the responses over each half chunk, and where they are if asked."""
        tops, places = [], []
        tail = np.full(WIDTH, 32, np.uint8)
        step = BLOCK * 512
        for at in range(0, len(data), step):
            own = np.concatenate([data[at : at + step + WIDTH], tail])
            n = min(step, len(data) - at) // STRIDE
            z = np.repeat(self.bias[None], n, 0)
            for j in range(WIDTH):
                z += self.table[j][own[j : j + n * STRIDE : STRIDE]]
            z = z.reshape(-1, HALF, FILTERS)
            tops.append(z.max(1))
            if with_place:
                first = at + np.arange(len(z))[:, None] * BLOCK
                places.append(first + z.argmax(1) * STRIDE)
        return (np.concatenate(tops), np.concatenate(places)) if with_place else np.concatenate(tops)

    @staticmethod
    def pool(tops: np.ndarray) -> np.ndarray:
        """Features of a document from its half chunks: chunks are neighbouring halves."""
        chunks = np.tanh(np.maximum(tops[:-1], tops[1:]) if len(tops) > 1 else tops)
        return np.concatenate([chunks.mean(0), chunks.max(0)])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out, group, size = [], [], 0
        for text in [*texts, None]:
            if text is not None:
                group.append(self.padded(text))
                size += len(group[-1])
            if group and (text is None or size > 1 << 20):
                tops = self.blocks(np.concatenate(group))
                ends = np.cumsum([len(g) // BLOCK for g in group])
                out += [self.pool(x) for x in np.split(tops, ends[:-1])]
                group, size = [], 0
        x = np.array(out, np.float32).reshape(-1, 2 * FILTERS) @ self.head + self.head_bias[0]
        return 1 / (1 + np.exp(-x.astype(np.float64)))

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = 14, batch: int = 32, rate: float = 0.01, seed: int = 5) -> ConvNet:
        """Adam on the log loss; a chunk's gradient goes to the position that won it."""
        rng = np.random.default_rng(seed)
        data, y = [self.padded(t) for t in texts], np.array(labels, np.float32)
        if not len(y):
            return self
        prior = float(np.clip(y.mean(), 0.01, 0.99))
        self.head_bias[0] = np.log(prior / (1 - prior))
        params = [self.table, self.bias, self.head, self.head_bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                rows = order[at : at + batch]
                grads = [np.zeros_like(p) for p in params]
                joined = np.concatenate([data[r] for r in rows])
                tops, places = self.blocks(joined, True)
                ends = np.cumsum([len(data[r]) // BLOCK for r in rows])
                padded = np.concatenate([joined, np.full(WIDTH, 32, np.uint8)])
                for k, r in enumerate(rows):
                    lo, hi = ends[k] - len(data[r]) // BLOCK, ends[k]
                    own, where = tops[lo:hi], places[lo:hi]
                    if len(own) > 1:
                        right = own[1:] > own[:-1]
                        chunk, where = np.tanh(np.where(right, own[1:], own[:-1])), np.where(right, where[1:], where[:-1])
                    else:
                        chunk = np.tanh(own)
                    top = chunk.argmax(0)
                    x = np.concatenate([chunk.mean(0), chunk.max(0)])
                    error = 1 / (1 + np.exp(-(x @ self.head + self.head_bias[0]))) - y[r]
                    grads[2] += error * x
                    grads[3] += error
                    d = np.repeat((error * self.head[:FILTERS] / len(chunk))[None], len(chunk), 0)
                    d[top, np.arange(FILTERS)] += error * self.head[FILTERS:]
                    d *= 1 - chunk**2
                    grads[1] += d.sum(0)
                    columns = np.broadcast_to(np.arange(FILTERS), where.shape)
                    for j in range(WIDTH):
                        np.add.at(grads[0][j], (padded[where + j], columns), d)
                t += 1
                for p, g, (m, v) in zip(params, grads, moments, strict=True):
                    g = g / len(rows) + 1e-5 * p
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        return self


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", mod: int = 4, held: int = 2, max_rows: int = 2400, max_bytes: int = 32768) -> ConvNet:
    """Fits on at most max_rows labelled rows outside the held-out fold, in a seeded order of their ids.

    The bound of the sample is max_rows rows, each of at most max_bytes bytes (longer ones are not drawn). Rows with
    a null label are no labels. Without labelled rows every score is 0.5.
    """
    chosen = labels.where(labels[label_col].isNotNull() & (crc_remainder(labels[id_col], mod) != held))
    chosen = chosen.select(labels[id_col].alias("k"), F.col(label_col).cast("int").alias("y")).orderBy(F.xxhash64("k"), "k", "y").limit(max_rows)
    text = text_of(docs, text_col).cast("binary")
    src = docs.where(F.octet_length(text) <= max_bytes).select(docs[id_col].alias("k"), text.alias("text"))
    rows = src.join(F.broadcast(chosen), "k").orderBy("k", "text").limit(max_rows).collect()
    return ConvNet().fit([bytes(r["text"]) for r in rows], [r["y"] for r in rows])


def score(docs: DataFrame, model: ConvNet, id_col: str = "doc_id", text_col: str = "text", mod: int = 4, held: int = 2) -> DataFrame:
    """id, held_out, score (probability of label 1) and predicted of each row, from its whole text only.

    A null text is empty; empty texts get the score of a blank chunk; repeated rows repeat their result; an empty
    table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.table, model.bias, model.head, model.head_bias))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = ConvNet.__new__(ConvNet)
        net.table, net.bias, net.head, net.head_bias = sent.value
        for batch in batches:
            s = net.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.7).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    src = docs.select(docs[id_col].cast("long").alias("id"), (crc_remainder(docs[id_col], mod) == held).alias("held_out"), text_of(docs, text_col).cast("binary").alias("text"))
    return src.mapInArrow(work, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
