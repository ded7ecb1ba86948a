"""Quality classifier: logistic regression on hashed word n-grams, learned by FTRL.

A text's features are its words and marks (runs of letters or digits, single other
characters), alone and as pairs of neighbours, hashed to 2**BITS places. A pair of equal
words also counts as the pair (word, same word), with how much of the text such pairs
are, in five steps. Each feature has the value 1 / sqrt(number of different features). The score is a sparse dot product of the
weights that these places hold. Training follows the regularised leader, one labelled
document after the other, `epochs` times, on at most `sample` labelled documents (those
with the smallest hash of their ids), one row an id, and `most_bytes` of their features.

Nulls: a null text is empty, and an empty text scores by the bias alone. Rows with a null
or unknown label aren't learned from. Repeated rows score alike. An empty table gives no
rows; without any labelled row every score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import WordHashes, discard, materialise, within

BITS = 20
WORD = re.compile(r"[^\W_]+|[^\w\s]|_")
PAIR = np.uint64(0x9E3779B97F4A7C15)
SAME_STEPS = (0.0, 0.02, 0.1, 0.4)

_words = WordHashes()


def features(text: str | None) -> np.ndarray:
    """Places of a text's words, marks and pairs, each once, ascending."""
    words = WORD.findall(text or "")
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * PAIR) ^ (h[1:] + (h[1:] >> np.uint64(29)))
    same = np.count_nonzero(h[:-1] == h[1:]) / len(h)
    steps = np.array([_words[f"same {x}"] for x in SAME_STEPS if same > x], np.uint64)
    places = np.concatenate([h, pairs * PAIR, steps]) >> np.uint64(64 - BITS)
    seen = np.zeros(1 << BITS, np.bool_) if len(places) > 50_000 else None
    if seen is not None:
        seen[places.astype(np.int64)] = True
        return np.flatnonzero(seen)
    return np.unique(places).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; `z` and `n` are its only state."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.005, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, places: np.ndarray, label: int) -> None:
        at = np.append(places, 1 << BITS)
        value = np.full(len(at), 1 / np.sqrt(max(1, len(places))))
        value[-1] = 1.0
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 8_000, epochs: int = 5, most_bytes: int = 256_000_000) -> np.ndarray:
    """Weights (the last is the bias) from labelled rows that aren't held out. At most
    `sample` documents of `most_bytes` places together are learned from; the driver gets no
    more. Of rows that repeat an id, the one with the least features counts."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def places(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t).astype("<i4").tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["doc_id", "quality", "places"])

    # chosen has at most `sample` rows of two numbers
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int"), "text")
    found = joined.mapInArrow(places, "doc_id long, quality int, places binary")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.length("places").alias("size"), "places", "quality")).alias("x"))
    learned = materialise(one.select("doc_id", "x.*"), "quality-features")
    ordered = learned.select("doc_id", "size").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = within([tuple(r) for r in ordered.collect()], most_bytes)
    table = learned.where(F.col("doc_id").isin(ids)).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    discard(learned)
    model = Ftrl()
    got = []
    for batch in (x for x in table.to_batches() if x.num_rows):  # places as they lie in the batch, not copied
        ends = np.frombuffer(batch.column("places").buffers()[1], "<i4")[batch.column("places").offset :][: batch.num_rows + 1]
        data = np.frombuffer(batch.column("places").buffers()[2] or b"", np.uint8)
        got += [(data[ends[i] : ends[i + 1]].view("<i4"), y.as_py()) for i, y in enumerate(batch.column("quality"))]
    for _ in range(epochs if got else 0):
        for p, y in got:
            model.learn(p, y)
    return model.weights().astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    at = np.flatnonzero(weights[:-1])
    sent = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at], float(weights[-1])))

    def run(batches):
        at, value, bias = sent.value
        w = np.zeros(1 << BITS, np.float32)
        w[at] = value
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                p = features(t)
                out.append(bias + float(w[p].sum()) / np.sqrt(max(1, len(p))))
            s = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of docs whose text isn't rejected; all columns stay. No shuffle: the
    score is computed beside the row."""
    at = np.flatnonzero(weights[:-1])
    sent = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at], float(weights[-1])))
    column = docs.columns.index("text")

    def run(batches):
        at, value, bias = sent.value
        w = np.zeros(1 << BITS, np.float32)
        w[at] = value
        for b in batches:
            keep = []
            for t in b.column(column).to_pylist():
                p = features(t)
                keep.append(bias + float(w[p].sum()) / np.sqrt(max(1, len(p))) >= 0)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
