"""Operator 5: language identification by a byte convolutional network in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes (the last one padded with zeros), so the
whole text is seen. Each byte has a learned vector; filters of several widths run over the window, the
largest response of each filter is kept, and a softmax layer turns these into log-probabilities. A
document's prediction is the softmax of its windows' mean log-probability, each window counted by the
letter bytes it holds.

Training uses windows of at most ``sample`` documents outside the held-out fold (those with the least
hash of doc_id and text) with a non-null lang, at most ``per_doc`` windows of each, spread over the text; equal rows are one document.
Both bounds are parameters and hold for the training sample alone.

Defined cases: null texts and texts without any letter are ``und`` with score 0; without any training
row every document is ``und``; repeated rows get equal predictions; a null doc_id is predicted; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

SAMPLE, PER_DOC = 4_000, 4
WINDOW, DIMS, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 12
EPOCHS, BATCH, RATE, SEED = 4, 64, 0.01, 7
CHUNK = 512  # windows in one matrix product
UNKNOWN = "und"

_LETTER = np.zeros(256, np.float64)
_LETTER[np.r_[ord("a") : ord("z") + 1, ord("A") : ord("Z") + 1, 128:256]] = 1


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text of each window, windows of WINDOW bytes)."""
    offsets, data = C.text_bytes(texts)
    size = np.diff(offsets)
    counts = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), counts)
    out = np.zeros(len(text) * WINDOW, np.uint8)
    out[C.ragged((np.cumsum(counts) - counts) * WINDOW, size)] = data
    return text, out.reshape(-1, WINDOW)


class Net:
    """Weights: byte vectors, one filter matrix for each width, and the softmax layer."""

    def __init__(self, langs: list[str], rng: np.random.Generator):
        self.langs = langs
        self.embed = rng.normal(0, 0.5, (256, DIMS)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, (w * DIMS) ** -0.5, (w * DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def responses(self, windows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(byte vectors under each filter, place of each largest response, the responses)."""
        n, wide = len(windows), max(WIDTHS)
        x = np.zeros((n, WINDOW + wide - 1, DIMS), np.float32)
        x[:, :WINDOW] = self.embed[windows]
        flat = x.reshape(n, -1)
        views = np.lib.stride_tricks.as_strided(flat, (n, WINDOW, wide * DIMS), (flat.strides[0], DIMS * 4, 4))
        stacked = np.zeros((wide * DIMS, FILTERS * len(WIDTHS)), np.float32)
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            stacked[: w * DIMS, k * FILTERS : (k + 1) * FILTERS] = f
        y = np.ascontiguousarray(views).reshape(n * WINDOW, -1) @ stacked
        y = y.reshape(n, WINDOW, -1)
        return views, y, np.concatenate(self.bias)

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.langs)), np.float32)
        for s in range(0, len(windows), CHUNK):
            _, y, bias = self.responses(windows[s : s + CHUNK])
            z = np.maximum(y.max(axis=1) + bias, 0) @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            out[s : s + CHUNK] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def gradients(self, windows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        n = len(windows)
        views, y, bias = self.responses(windows)
        place = y.argmax(axis=1)
        top = np.take_along_axis(y, place[:, None], 1)[:, 0] + bias
        hidden = np.maximum(top, 0)
        z = hidden @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), label] -= 1
        p *= (weight / n)[:, None]
        back = (p @ self.out.T) * (top > 0)
        seen = views[np.arange(n)[:, None], place]  # (n, filters, widest * DIMS)
        d_filters, d_embed = [], np.zeros_like(self.embed)
        padded = np.pad(windows, ((0, 0), (0, max(WIDTHS) - 1)))
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            mine = slice(k * FILTERS, (k + 1) * FILTERS)
            d_filters.append(np.einsum("nfd,nf->df", seen[:, mine, : w * DIMS], back[:, mine]))
            under = (back[:, mine, None] * f.T[None]).reshape(n, FILTERS, w, DIMS)
            at = padded[np.arange(n)[:, None, None], place[:, mine, None] + np.arange(w)]
            np.add.at(d_embed, at, under)
        d_embed[0] = 0
        d_bias = back.sum(axis=0)
        return [d_embed, *d_filters, *np.split(d_bias, len(WIDTHS)), hidden.T @ p, p.sum(axis=0)]


def fit_net(windows: np.ndarray, label: np.ndarray, langs: list[str]) -> Net:
    rng = np.random.default_rng(SEED)
    net = Net(langs, rng)
    weight = (len(label) / (len(langs) * np.maximum(np.bincount(label, minlength=len(langs)), 1)))[label].astype(np.float32)
    m, v, t = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(label))
        for s in range(0, len(order), BATCH):
            i, t = order[s : s + BATCH], t + 1
            for k, (w, g) in enumerate(zip(net.weights(), net.gradients(windows[i], label[i], weight[i]), strict=True)):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w -= (RATE * 0.5**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def _training_windows(per_doc: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            text, windows = cut(batch.column("text"))
            n = np.bincount(text, minlength=batch.num_rows)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
            # per_doc windows spread evenly from the first to the last
            held = (nth * per_doc // np.maximum(n[text], 1) != (nth - 1) * per_doc // np.maximum(n[text], 1)) | (n[text] <= per_doc)
            held &= _LETTER[windows].sum(axis=1) >= 16
            yield pa.record_batch([batch.column("lang").take(pa.array(text[held])), pa.array([w.tobytes() for w in windows[held]], pa.binary())], ["lang", "bytes"])

    return run


def fit(docs: DataFrame, sample: int = SAMPLE, per_doc: int = PER_DOC) -> Net | None:
    """Learn from text and lang of the folds 0 and 2; None without a training row."""
    spark = docs.sparkSession
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and text is not null and lang is not null").filter(C.fold(F.col("doc_id")) != 1)
    key = ["doc_id", "row", "lang"]
    usable = usable.withColumn("row", C.row_key())
    chosen = usable.select(*key).distinct().orderBy(F.xxhash64(*key), *key).limit(sample)  # bounded by the parameter
    rows = usable.join(F.broadcast(chosen), key).groupBy(*key).agg(F.first("text").alias("text"))  # equal rows are one
    rows = rows.select("lang", "text").mapInArrow(_training_windows(per_doc), "lang string, bytes binary").orderBy("lang", "bytes").collect()  # at most sample x per_doc windows
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    windows = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8).reshape(-1, WINDOW)
    return fit_net(windows, np.array([langs.index(r["lang"]) for r in rows]), langs)


def predict_batch(texts: pa.Array, net: Net | None) -> tuple[list[str], np.ndarray]:
    texts = pc.fill_null(texts, "")
    known = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
    if net is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    text, windows = cut(texts)
    letters = _LETTER[windows].sum(axis=1)
    logs = net.log_probs(windows) * letters[:, None]
    # windows of a text follow one another
    n = np.bincount(text, minlength=len(texts))
    full, total, weight = np.flatnonzero(n), np.zeros((len(texts), len(net.langs))), np.zeros(len(texts))
    if len(full):
        starts = (np.cumsum(n) - n)[full]
        total[full], weight[full] = np.add.reduceat(logs.astype(np.float64), starts, axis=0), np.add.reduceat(letters, starts)
    total /= np.maximum(weight, 1)[:, None]
    p = np.exp(total - total.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return [net.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p[np.arange(len(best)), best], 0.0)


def predict(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, limit=1 << 20):
            lang, score = predict_batch(batch.column("text"), shared.value)
            yield pa.record_batch([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = C.doc_texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", (C.fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
