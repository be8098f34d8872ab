"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

A word is a run of letters, of digits or of other signs (bytes beyond ASCII count as letters; case counts).
Its hash picks one of ``BUCKETS`` rows. Every row has a fixed sparse index vector, ``NONZERO`` signs at
random places of ``WIDTH``. A word's vector is the sum of the index vectors of its neighbours, up to ``WINDOW``
words before and after it, over all texts of the corpus, scaled to length 1. The sums are integers, so they
are the same however the corpus is partitioned. Each task sums a table of its own, ``BUCKETS`` x ``WIDTH``
numbers however long its texts are; tables are added in two steps, by block and task first, then by block.

A document's features are the mean and the spread of its words' vectors, how alike neighbours'
vectors are, and how often a word repeats the one before. A network of two layers maps them
to a logit; it is fitted in NumPy to at most ``fit_rows`` labelled documents, those with the smallest hashes
of their ids. A fifth of those fits nothing but the temperature, by which logits are divided so that the
probabilities have the least log loss there. The driver holds the word vectors (``BUCKETS`` x ``WIDTH``),
the fitted rows' features and the network, whatever the size of the corpus.

Odd cases: a null text counts as empty; a text without a word has features of 0 and so the score of those;
very long texts are read in stretches of ``STRETCH`` bytes, at whose ends a word of more bytes is cut and which
have no neighbours beyond;
repeated rows are scored alike and count in the word vectors as often as they are there; labels other than 0
and 1 are ignored, of several labels of an id the highest counts; rows with a null id are scored but not
learned from, and are not held out; without labels of both kinds every score is (ones + 1) / (labels + 2);
an empty table gives no rows; the new column is named so that it clashes with none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import partitions, text_or_empty, unused_name

BUCKETS, WIDTH, NONZERO, WINDOW = 1 << 14, 32, 4, 2
FIT_ROWS, HIDDEN, EPOCHS, SEED = 4_000, 24, 150, 42
STRETCH = 1 << 20
#: Folds by crc32 of the id as text; this one is held out.
FOLDS, HELD_OUT = 5, 0
#: Buckets in a block of a task's table.
BLOCK = 256


def _classes() -> np.ndarray:
    """0 for white space, 1 for letters, 2 for digits, 3 for other signs."""
    out = np.full(256, 3, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = 0
    out[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = 1
    out[[*b"0123456789"]] = 2
    return out


_CLASS = _classes()
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for hashes of any run from one running sum."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(STRETCH + 1, np.uint64(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's index vector."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :NONZERO].astype(np.int64)
    return places, rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def words(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each word of some texts that lie side by side; ``firsts`` are their first bytes."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = _CLASS[data]
    mark = np.ones(n, dtype=bool)
    mark[1:] = kind[1:] != kind[:-1]
    mark[firsts[firsts < n]] = True
    starts = np.flatnonzero(mark)
    ends = np.append(starts[1:], n)
    word = kind[starts] != 0
    starts, ends = starts[word], ends[word]
    power, inverse = _powers()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.searchsorted(firsts, starts, side="right") - 1


def stretches(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of the words of a string column, by stretches of whole short texts or of parts of a long one."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STRETCH, side="right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[last])
        if hi - lo <= STRETCH:
            bucket, at = words(data[lo:hi], offsets[row:last] - lo)
            # Empty texts share their first byte with the next one; the last of them owns it.
            yield bucket, at + row
        else:
            while lo < hi:
                to = min(lo + STRETCH, hi)
                if to < hi:
                    kind = _CLASS[data[lo:to]]
                    border = np.flatnonzero(kind[1:] != kind[:-1])
                    to = lo + int(border[-1]) + 1 if len(border) else to
                bucket, at = words(data[lo:to], np.zeros(1, np.int64))
                yield bucket, at + row
                lo = to
        row = last


def add_contexts(table: np.ndarray, bucket: np.ndarray, row: np.ndarray) -> None:
    """Adds the index vectors of each word's neighbours in its text to its row of the flat ``table``."""
    places, signs = _index()
    for apart in range(1, WINDOW + 1):
        same = row[apart:] == row[:-apart]
        left, right = bucket[:-apart][same], bucket[apart:][same]
        for word, near in ((left, right), (right, left)):
            at = (word[:, None] * WIDTH + places[near]).ravel()
            table += np.bincount(at, weights=signs[near].ravel(), minlength=len(table)).astype(np.int64)


_SUMS = "block int, salt int, sums binary"


def _blocks(table: np.ndarray, salt: int) -> pa.RecordBatch:
    parts = table.reshape(-1, BLOCK * WIDTH)
    used = np.flatnonzero(parts.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), salt, np.int32)), pa.array([parts[i].astype("<i8").tobytes() for i in used], pa.binary())], names=["block", "salt", "sums"])


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    """The blocks summed by the keys; a task holds a table at most for each salt it has."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        salt = 0
        for batch in batches:
            for block, salt, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[block] = held.get(block, 0) + np.frombuffer(sums, "<i8")
        n = len(held)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([salt] * n, pa.int32()), pa.array([v.astype("<i8").tobytes() for v in held.values()], pa.binary())], names=["block", "salt", "sums"])

    return rows.repartition(partitions(rows.sparkSession), *keys).mapInArrow(add, _SUMS)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(``BUCKETS``, ``WIDTH``) unit vectors of the words of the whole corpus, 0 where there is no word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, salt = np.zeros(BUCKETS * WIDTH, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for bucket, row in stretches(batch.column(0)):
                add_contexts(table, bucket, row)
        yield _blocks(table, salt % (1 << 30))

    counted = docs.select(text_or_empty(text).alias("text")).mapInArrow(count, _SUMS)
    sums = _added(_added(counted.withColumn("salt", F.col("salt") % partitions(docs.sparkSession)), "block", "salt"), "block")
    out = np.zeros((BUCKETS // BLOCK, BLOCK * WIDTH), np.float64)
    for r in sums.collect():  # BUCKETS x WIDTH numbers
        out[r["block"]] = np.frombuffer(r["sums"], "<i8")
    out = out.reshape(BUCKETS, WIDTH)
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.where(size > 0, size, 1)).astype(np.float32)


#: Features of a document: mean and spread of its words' vectors, and two of neighbours.
FEATURES = 2 * WIDTH + 2


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """The features of each text: the mean and the standard deviation of its words' vectors, the mean inner
    product of neighbours' vectors, and the share of words that repeat the one before."""
    n = len(texts)
    sums, count = np.zeros((n, FEATURES)), np.zeros(n)
    for bucket, row in stretches(texts):
        borders = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
        for lo, hi in zip(borders[:-1], borders[1:], strict=True):
            mine = vectors[bucket[lo:hi]].astype(np.float64)
            to = sums[row[lo]]
            to[:WIDTH] += np.ones(hi - lo) @ mine
            to[WIDTH:-2] += np.einsum("ij,ij->j", mine, mine)
            to[-2] += np.einsum("ij,ij->", mine[1:], mine[:-1])
            to[-1] += np.count_nonzero(bucket[lo + 1 : hi] == bucket[lo : hi - 1])
            count[row[lo]] += hi - lo
    out = sums / np.maximum(count, 1)[:, None]
    out[:, WIDTH:-2] = np.sqrt(np.maximum(out[:, WIDTH:-2] - out[:, :WIDTH] ** 2, 0))
    return out


class Network:
    """Standardised features, a layer of tanh, a logit, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fit: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED):
        self.prior = (float(y.sum()) + 1) / (len(y) + 2)
        self.known = len(np.unique(y[fit])) == 2
        if not self.known:
            return
        self.mean, sd = x[fit].mean(axis=0), x[fit].std(axis=0)
        self.scale = np.where(sd > 1e-9, sd, 1.0)
        rng = np.random.default_rng(seed)
        k = x.shape[1]
        self.weights = [rng.normal(0, 1 / np.sqrt(k), (k, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self._descend(self._scaled(x[fit]), y[fit].astype(float), epochs, rng)
        held = ~fit if len(np.unique(y[~fit])) == 2 else fit
        self.temperature = _temperature(self.logits(x[held]), y[held].astype(float))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _descend(self, x: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator, rate: float = 0.01, decay: float = 1e-3, batch: int = 128) -> None:
        """Adam on the log loss, in batches; steps shrink to nothing by the last epoch."""
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                a, b = x[order[lo : lo + batch]], y[order[lo : lo + batch]]
                w1, b1, w2, b2 = self.weights
                h = np.tanh(a @ w1 + b1)
                off = (_sigmoid(h @ w2 + b2) - b) / len(b)
                back = np.outer(off, w2) * (1 - h * h)
                slopes = [a.T @ back + decay * w1, back.sum(axis=0), h.T @ off + decay * w2, off.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(slopes):
                    m, v = moments[i]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.weights[i] = self.weights[i] - rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(self._scaled(x) @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature) if self.known else np.full(len(x), self.prior)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _temperature(z: np.ndarray, y: np.ndarray, low: float = 0.05, high: float = 20.0) -> float:
    """Of 400 temperatures between the two, by equal ratios, the one with the least log loss.

    Labels are drawn in by one row of each kind, so logits that part the kinds wholly aren't stretched for ever."""
    ones = y.sum()
    wanted = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    tried = np.geomspace(low, high, 400)
    loss = [(np.logaddexp(0, z / t) - wanted * z / t).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


class Model:
    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.network.probability(pooled(texts, self.vectors))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Word vectors from all documents, the network from labelled ones that are not held out."""
    vectors = word_vectors(docs, text)
    ident = F.col(doc_id)
    key = F.pmod(F.xxhash64(F.col("id"), F.lit("quality")), F.lit(1 << 40))
    marked = labels.select(ident.alias("id"), F.col(label).alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    there = docs.select(ident.alias("id")).distinct()
    # The sample is chosen by ids alone; fit_rows of them are sent to the documents.
    chosen = marked.join(there, "id", "left_semi").withColumn("key", key).orderBy("key", "id").limit(fit_rows)
    sample = docs.select(ident.alias("id"), text_or_empty(text).alias("text")).join(F.broadcast(chosen), "id").select("key", "y", F.xxhash64("text").alias("tie"), "text")
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(3), held.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "y", "tie", "x"])

    rows = sample.mapInArrow(features, "key long, y int, tie long, x binary").orderBy("key", "tie").limit(fit_rows).collect()
    x = np.array([np.frombuffer(r["x"]) for r in rows]).reshape(len(rows), FEATURES)
    return Model(vectors, Network(x, np.array([r["y"] for r in rows], dtype=int), np.array([r["key"] % 5 != 0 for r in rows], dtype=bool)))


def scored(docs: DataFrame, model: Model, text: str = "text", to: str = "quality_score") -> DataFrame:
    """``docs`` with a new last column, the probability of label 1, named ``to`` or longer."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(held.value.score(texts), pa.float64())

    return docs.withColumn(unused_name(docs, to), score(text_or_empty(text)))
