"""Operator 4: quality classifier on random-indexing word vectors.

Words are runs of letters, runs of digits, runs of one symbol, and line ends, of the raw text; each
is hashed to one of ROWS rows of a fixed table (words may share a row; bytes of a word after the 4,096th share one multiplier of the hash),
and a word said again just after itself goes to a row of its own. Random indexing: every row has a sparse ternary index vector,
and a row's context vector is the sum of the index vectors of its neighbours, over all documents of the corpus: tasks sum
tables of ROWS x DIMS numbers, which are added up in steps of at most FAN tables a task. A document is the mean
of the unit context vectors of its words. A two-layer numpy network scores it, and a temperature,
fitted on a part of the training rows that the network has not seen, calibrates the probability to the labels' own shares.

The network is fitted on at most ``sample`` labelled documents (those with the least hash of doc_id), outside the
held-out fold, one text for each doc_id. The tables that are broadcast have a fixed size: ROWS x DIMS floats and the network.

Defined cases: null text is empty, and an empty text has the zero vector and gets its score like any
other; labels that are null, and ids with both labels, are not used; of several texts of one labelled doc_id the one with the least hash is; without
any usable label, or with one class only, all documents get that class's share (0.5 without labels); repeated rows get equal scores; a null doc_id
is scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

SAMPLE = 12_000
ROWS, DIMS, NONZERO, REACH = 1 << 14, 64, 4, 2
HIDDEN, EPOCHS, BATCH, SEED = 32, 40, 128, 20240229
BLOCKS, FAN = 16, 64
AGAIN, RECENT = 0, 4  # the row of a word that equals one of the RECENT words before it
CONTEXT_SLICE = 2 << 20  # text bytes whose neighbours are counted at a time
PIECE = 1 << 15  # words of one document that are summed at a time

_KIND = np.full(256, 4, np.uint8)  # bytes above 127 are parts of letters here
_KIND[np.r_[ord("a") : ord("z") + 1, ord("A") : ord("Z") + 1, 128:256]] = 1
_KIND[np.r_[ord("0") : ord("9") + 1]] = 2
_KIND[[0x20, 9, 11, 12, 13]] = 0
_KIND[10] = 3
_MULT = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word offsets of each text, table row of each word)."""
    offsets, data = C.text_bytes(texts)
    if not len(data):
        return np.zeros(len(offsets), np.int64), np.empty(0, np.int64)
    kind = _KIND[data]
    new = np.empty(len(data), bool)
    new[0], new[1:] = True, (kind[1:] != kind[:-1]) | ((kind[1:] == 4) & (data[1:] != data[:-1])) | (kind[1:] == 3)
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(new)
    place = np.arange(len(data), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(data))))
    np.minimum(place, len(_MULT) - 1, out=place)
    value = _MULT[place]
    value *= data.astype(np.uint64) + np.uint64(1)
    value[(kind == 4) & (place > 0)] = 0  # runs of a symbol count by their kind, not their length
    h = C.mix(np.add.reduceat(value, starts))
    held = kind[starts] != 0
    at, rows = np.searchsorted(starts[held], offsets), 1 + (h[held] >> np.uint64(40)).astype(np.int64) % (ROWS - 1)
    text, letters, again = np.repeat(np.arange(len(at) - 1), np.diff(at)), kind[starts[held]] == 1, np.zeros(len(rows), bool)
    for step in range(1, RECENT + 1):
        again[step:] |= letters[step:] & (rows[step:] == rows[:-step]) & (text[step:] == text[:-step])
    return at, np.where(again, AGAIN, rows)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(ROWS, NONZERO) places and signs of the sparse ternary index vectors."""
    h = C.mix(np.arange(ROWS * NONZERO, dtype=np.uint64) + np.uint64(SEED)).reshape(ROWS, NONZERO)
    return (h >> np.uint64(20)).astype(np.int64) % DIMS, np.where(h & np.uint64(1), 1.0, -1.0)


def context_sums(offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the index vectors of all words within REACH in the same text, for each row: first how often each row has each
    other beside it, then the index vectors of the distinct pairs."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pairs = [rows[step:][same] * ROWS + rows[:-step][same] for step in range(1, REACH + 1) for same in [text[step:] == text[:-step]]]
    pair, n = np.unique(np.concatenate(pairs), return_counts=True)
    a, b = pair // ROWS, pair % ROWS
    place, sign = index_vectors()
    total = np.zeros(ROWS * DIMS)
    for x, y in ((a, b), (b, a)):
        for k in range(NONZERO):
            total += np.bincount(x * DIMS + place[y, k], weights=sign[y, k] * n, minlength=ROWS * DIMS)
    return total.reshape(ROWS, DIMS)


def _context_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, part = np.zeros((ROWS, DIMS)), pyspark.TaskContext.get().partitionId()
    for batch in C.slices(batches, limit=CONTEXT_SLICE):
        total += context_sums(*word_rows(batch.column("text")))
    blocks = total.astype(np.int64).reshape(BLOCKS, -1)
    yield pa.record_batch([pa.array(range(BLOCKS), pa.int32()), pa.array([part] * BLOCKS, pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "part", "sums"])


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (block, part) of a partition, batch by batch."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for block, part, sums in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), batch.column("sums"), strict=True):
            x = np.frombuffer(sums.as_buffer(), np.int64)
            total[block, part] = total[block, part] + x if (block, part) in total else x.copy()
    yield pa.record_batch([pa.array([b for b, _ in total], pa.int32()), pa.array([p for _, p in total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "part", "sums"])


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The unit context vectors, from all texts."""
    schema = "block int, part int, sums binary"
    sums = C.save(C.doc_texts(docs).select("text").mapInArrow(_context_blocks, schema), at := C.scratch(docs.sparkSession, "quality-contexts"), compression="zstd")
    parts = 1 + (sums.agg(F.max("part")).first()[0] or 0)
    while parts > 1:
        parts = -(-parts // FAN)
        sums = sums.withColumn("part", F.expr(f"cast(part div {FAN} as int)")).repartition(parts * BLOCKS, "block", "part").mapInArrow(_add_blocks, schema)
    total = np.zeros((BLOCKS, ROWS * DIMS // BLOCKS))
    for r in sums.collect():  # ROWS x DIMS numbers
        total[r["block"]] += np.frombuffer(r["sums"], np.int64)
    C.drop(docs.sparkSession, at)
    return unit(total.reshape(ROWS, DIMS))


def unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors, dtype=np.float64), where=size > 0).astype(np.float32)


def pool(offsets: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of each text's words. A text is summed in pieces counted from its own start, so its vector
    doesn't depend on the batch."""
    out, at, n = np.zeros((len(offsets) - 1, DIMS)), 0, np.diff(offsets)
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        if n[at] > PIECE:
            for s in range(offsets[at], offsets[at + 1], PIECE):
                out[at] += vectors[rows[s : min(s + PIECE, offsets[at + 1])]].sum(axis=0, dtype=np.float64)
            to = at + 1
        else:
            full = np.flatnonzero(n[at:to]) + at
            if len(full):
                out[full] = np.add.reduceat(vectors[rows[offsets[at] : offsets[to]]], offsets[full] - offsets[at], axis=0)
        at = to
    return out / np.maximum(n, 1)[:, None]


@dataclass
class Net:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit_net(x: np.ndarray, y: np.ndarray) -> Net:
    """Adam on cross-entropy; the temperature by a grid on rows kept apart."""
    if len(set(y.tolist())) < 2:
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return Net(np.zeros(DIMS), np.ones(DIMS), np.zeros((DIMS, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    apart, train = order[: len(y) // 6], order[len(y) // 6 :]
    mean, scale = x[train].mean(0), x[train].std(0) + 1e-6
    z = (x - mean) / scale
    p = [rng.normal(0, DIMS**-0.5, (DIMS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(EPOCHS):
        rate = 0.01 * 0.93**epoch
        shuffled = rng.permutation(train)
        for s in range(0, len(train), BATCH):
            i = shuffled[s : s + BATCH]
            h = np.tanh(z[i] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[i]) / len(i)
            gh = np.outer(g, p[2]) * (1 - h * h)
            grads, t = [z[i].T @ gh + 1e-5 * p[0], gh.sum(0), h.T @ g + 1e-5 * p[2], np.array([g.sum()])], t + 1
            for k, d in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Net(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(apart):
        logits = net.logits(x[apart])
        loss = lambda T: float(np.logaddexp(0, np.where(y[apart] == 1, -1, 1) * logits / T).sum())
        net.temperature = min(np.geomspace(0.25, 16, 49), key=loss)
    return net


def _pooler(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            x = pool(*word_rows(batch.column("text")), vectors.value).astype(np.float32)
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    return run


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = model.value
        for batch in C.slices(batches):
            score = net.score(pool(*word_rows(batch.column("text")), vectors))
            yield pa.record_batch([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Net]:
    """(word vectors, network), learnt from labelled rows of the folds 0 and 2."""
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(C.fold(F.col("doc_id")) != 1)
    usable = usable.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").select("doc_id", "label")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded by the parameter, so it may be broadcast
    rows = C.doc_texts(docs).join(F.broadcast(chosen), "doc_id")
    texts = C.save(rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(C.row_key(), "text")).alias("text")), at := C.scratch(spark, "quality-sample"))  # a row a doc_id
    vectors = context_vectors(docs)
    shared = spark.sparkContext.broadcast(vectors)
    got = texts.mapInArrow(_pooler(shared), "doc_id long, label int, x binary").collect()  # sample rows of DIMS floats
    got = sorted(got, key=lambda r: (r["doc_id"], r["label"], r["x"]))
    C.drop(spark, at)
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float64).reshape(len(got), DIMS)
    return vectors, fit_net(x, np.array([r["label"] for r in got], np.float64))


def score(docs: DataFrame, model: tuple[np.ndarray, Net]) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = C.doc_texts(docs).mapInArrow(_scorer(shared), "doc_id long, score double")
    return rows.select("doc_id", (C.fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good(docs: DataFrame, model: tuple[np.ndarray, Net]) -> DataFrame:
    """The rows of docs that the model accepts, all columns as they are; rows are filtered where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for batch in C.slices(batches):
            yield batch.filter(pa.array(net.score(pool(*word_rows(batch.column("text")), vectors)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, C.table(spark, sf_dir, "labels")))
