"""Operator 6: quality rules with an n-gram perplexity model.

Base rules count words, symbols, repeated lines and repeated 3-word windows of the whole text. The
method adds perplexity: Spark counts all character n-grams of the documents that pass the base rules, by language, builds an
interpolated modified Kneser-Ney model from them (continuation counts for the lower orders, three
discounts for each language and order), and stores it as sorted arrays of 64-bit n-gram hashes with
log-probabilities beside them. No document explains itself: documents are dealt into two halves by a hash of their text
(copies together), each half has its own model, and a document is scored by the other half's.

Bands are a language's median log-perplexity and DEVIATIONS scaled median absolute deviations below and above it, over the documents
that pass the base rules; documents outside go. Short texts scatter more, so both are taken by the number of words
(to a power of two) where a language has CLASS_LEAST documents of that size. Elsewhere they are the whole language's, and the deviation is
the larger one of that and of the one that falls with the root of the number of words.

Units are characters (digits alike, white space alike), so the model grows slowly with the corpus. Its
size is checked: up to ``broadcast_rows`` n-grams it is broadcast, hashed on the executors, so that the driver sees numbers only; beyond
that the documents' n-grams are joined with the model's table. Both add the same log-probabilities, the one as 32-bit, the other as 64-bit numbers.

Defined cases: null texts count as empty, have no perplexity and fail the base rules; a null lang is a
language of its own; a language whose other half is empty has the same perplexity for all its documents of a half; repeated rows get equal rows; a null
doc_id is kept as it is; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

ORDER = 4
BROADCAST_ROWS = 4_000_000  # 64 MB of hashes, log-probabilities and weights
DEVIATIONS = 3.5  # half-width of a band, in scaled median absolute deviations
LEAST_WIDTH = 0.03  # of that half, in log-perplexity, for documents that are all alike
LANGUAGES = 4096  # a table with a row for each of so many is broadcast
CLASS_LEAST = 30  # documents of a language and size from which they have a band of their own
LEAST_WORDS, MOST_REPEATED = 50, 50  # base rules: words, and percent of them in repeated windows
BOS = 2
GRAM_SLICE = 1 << 20  # text bytes whose n-grams are held at a time
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NO_LANG = "und"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


# ---- base rules --------------------------------------------------------------------------------


def word_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words and n_repeat_words."""
    offsets, code, _ = C.split_words(texts)  # codes tell words apart within a slice, which is all that is needed
    text, first = C.windows(offsets, 3)
    word = code.astype(np.uint64)
    key = ((word[first] * MULTIPLIER + word[first + 1]) * MULTIPLIER + word[first + 2]) * MULTIPLIER + text.astype(np.uint64)
    coded = pa.array(key).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    again = first[np.bincount(coded)[coded] > 1] if len(first) else first
    covered = np.zeros(len(code), np.int64)
    for k in range(3):
        covered[again + k] = 1
    return {"n_words": np.diff(offsets), "n_repeat_words": C.segment_sums(covered, offsets)}


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    texts = pc.fill_null(texts, "")
    at, data = C.text_bytes(texts)
    word_bytes = ~_SPACE[data] & ((data & 0xC0) != 0x80)  # a code point's first byte
    words = word_counts(texts)
    lines = []
    for t in texts.to_pylist():
        seen, n = set(), 0
        for line in t.split("\n"):
            if line in seen:
                n += 1
            elif line.strip(" \t\n\v\f\r"):
                seen.add(line)
        lines.append(n)
    return {
        "n_words": words["n_words"],
        "word_chars": C.segment_sums(word_bytes, at),
        "n_symbols": C.segment_sums(_SYMBOL[data], at),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": words["n_repeat_words"],
    }


# ---- n-grams -----------------------------------------------------------------------------------


def symbols(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, code points) of texts, each after order-1 start marks; digits become 0, white space a blank."""
    parts = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in pc.fill_null(texts, "").to_pylist()]
    n = np.array([len(p) for p in parts], np.int64) + order - 1
    offsets = np.concatenate([[0], np.cumsum(n)])
    out = np.full(offsets[-1], BOS, np.uint32)
    if parts:
        flat = np.concatenate(parts)
        flat = np.where((flat >= 48) & (flat <= 57), np.uint32(48), np.where((flat >= 9) & (flat <= 13), np.uint32(32), flat))
        out[C.ragged(offsets[:-1] + order - 1, n - order + 1)] = flat
    return offsets, out


def gram_hashes(lang: np.ndarray, points: list[np.ndarray]) -> np.ndarray:
    """Hash of (language, n-gram): points[k] holds the k-th code point of each."""
    return C.mix(reduce(lambda h, p: h * MULTIPLIER + p.astype(np.uint64) + np.uint64(1), points, lang))


def lang_hash(langs: list[str | None]) -> np.ndarray:
    return C.hashes(pa.array([x or _NO_LANG for x in langs], pa.string()), seed=1)


def halves(texts: pa.Array) -> np.ndarray:
    """0 or 1 for each text."""
    return (C.hashes(pc.fill_null(texts, ""), seed=2) >> np.uint64(40)).astype(np.int64) & 1


def model_names(langs: list[str | None], half: np.ndarray) -> list[str]:
    """The name under which a half of a language is counted."""
    return [f"{h}{x or _NO_LANG}" for x, h in zip(langs, half.tolist(), strict=True)]


def grams(texts: pa.Array, langs: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each n-gram, place of its first code point, the code points, its hash)."""
    offsets, points = symbols(texts, order)
    text, first = C.windows(offsets, order)
    return text, first, points, gram_hashes(lang_hash(langs)[text], [points[first + k] for k in range(order)])


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each hash, one place of each distinct hash)."""
    coded = pa.array(h).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    some = np.empty(len(coded.dictionary), np.int64)
    some[code] = np.arange(len(code))
    return code, some


def _decode(points: np.ndarray, first: np.ndarray, order: int) -> list[str]:
    joined = points[first[:, None] + np.arange(order)].astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i : i + order] for i in range(0, len(joined), order)]


def _counter(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, limit=GRAM_SLICE):
            words = word_counts(batch.column("text"))
            batch = batch.filter(pa.array((words["n_words"] >= LEAST_WORDS) & (100 * words["n_repeat_words"] <= MOST_REPEATED * words["n_words"])))
            names = model_names(batch.column("lang").to_pylist(), halves(batch.column("text")))
            text, first, points, h = grams(batch.column("text"), names, order)
            if not len(h):
                continue
            code, some = distinct(h)
            yield pa.record_batch([pa.array([names[i] for i in text[some]], pa.string()), pa.array(_decode(points, first[some], order), pa.string()), pa.array(np.bincount(code))], ["lang", "gram", "n"])

    return run


def count(docs: DataFrame, order: int) -> DataFrame:
    """(lang, gram, c) over all documents that pass the base rules; lang names a language and half."""
    return docs.select("lang", "text").mapInArrow(_counter(order), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("c"))


# ---- the model ---------------------------------------------------------------------------------


def _discounts(table: DataFrame) -> DataFrame:
    """D1, D2 and D3+ of each language; the usual 0.5, 1 and 1.5 where counts of counts are missing."""
    n = [F.count_if(F.col("c") == k).cast("double") for k in range(1, 5)]
    rows = table.groupBy("lang").agg(*[x.alias(f"n{k + 1}") for k, x in enumerate(n)], F.count("*").alias("types"))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    pick = lambda k: F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))
    inside = lambda k: F.coalesce(F.when((pick(k) > 0) & (pick(k) < k), pick(k)), F.lit(k / 2))
    return rows.select("lang", "types", *[inside(k).alias(f"d{k}") for k in (1, 2, 3)])


def _discount(c: str) -> Column:
    return F.when(F.col(c) == 1, F.col("d1")).when(F.col(c) == 2, F.col("d2")).otherwise(F.col("d3"))


def build(counts: DataFrame, order: int) -> tuple[DataFrame, list[str]]:
    """(lang, gram, logp, back): the log-probability of a gram's last character after the others, and the weight
    that the gram, as a context, leaves to shorter ones. Grams of all orders (start marks alone are contexts without
    a probability); also the scratch paths."""
    spark, paths = counts.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        paths.append(C.scratch(spark, f"ngram-{name}"))
        return C.save(df, paths[-1])

    tables = {order: kept(counts, "counts")}
    for k in range(order - 1, 0, -1):
        tables[k] = kept(tables[k + 1].groupBy("lang", F.expr("substr(gram, 2)").alias("gram")).agg(F.count("*").alias("c")), f"order{k}")
    # a row a language, so it goes to all tasks while there are few of them
    small = F.broadcast if tables[1].select("lang").distinct().limit(LANGUAGES + 1).count() <= LANGUAGES else lambda df: df
    lower, contexts, probs = None, {}, {}
    for k in range(1, order + 1):
        discounts = small(_discounts(tables[k]))
        rows = tables[k].join(discounts, "lang").withColumn("ctx", F.expr(f"substr(gram, 1, {k - 1})"))
        left = rows.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum(_discount("c")).alias("taken"))
        rows = rows.join(left, ["lang", "ctx"])
        if lower is None:
            rows = rows.withColumn("under", 1.0 / (F.col("types") + 1))
        else:
            rows = rows.withColumn("short", F.expr("substr(gram, 2)")).join(lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("under")), ["lang", "short"])
        p = (F.col("c") - _discount("c")) / F.col("total") + F.col("taken") / F.col("total") * F.col("under")
        lower = probs[k] = kept(rows.select("lang", "gram", p.alias("p")), f"p{k}")
        contexts[k] = left.select("lang", F.col("ctx").alias("gram"), F.log(F.col("taken") / F.col("total")).alias("back"))
    parts = [probs[k].select("lang", "gram", F.log("p").alias("logp")).join(contexts[k + 1], ["lang", "gram"], "full") if k < order else probs[k].select("lang", "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("back")) for k in probs]
    # the empty context: what an unseen character gets, and what is left to it
    floor = _discounts(tables[1]).select("lang", F.lit("").alias("gram"), F.log(1.0 / (F.col("types") + 1)).alias("logp")).join(small(contexts[1]), ["lang", "gram"], "left")
    return kept(reduce(DataFrame.unionByName, [floor, *parts]), "model"), paths


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the model's table as numbers."""
    for batch in batches:
        size = pc.utf8_length(batch.column("gram")).to_numpy()
        langs = batch.column("lang").dictionary_encode()
        lang = lang_hash(langs.dictionary.to_pylist())[langs.indices.to_numpy(zero_copy_only=False)] if len(size) else np.empty(0, np.uint64)
        h = np.empty(len(size), np.uint64)
        for k in np.unique(size).tolist():
            i = np.flatnonzero(size == k)
            points = np.frombuffer("".join(batch.column("gram").take(pa.array(i)).to_pylist()).encode("utf-32-le"), np.uint32).reshape(len(i), k)
            h[i] = gram_hashes(lang[i], [points[:, j] for j in range(k)])
        yield pa.record_batch([pa.array(size.astype(np.int8)), pa.array(h.view(np.int64)), batch.column("logp").cast(pa.float32()), pc.fill_null(batch.column("back"), 0.0).cast(pa.float32())], ["size", "hash", "logp", "back"])


class SortedModel:
    """For each order, ascending n-gram hashes with log-probabilities and backoff weights."""

    def __init__(self, rows: pa.Table, order: int):
        self.order, self.at = order, {}
        size, h, logp, back = (rows.column(c).to_numpy() for c in ("size", "hash", "logp", "back"))
        for k in range(order + 1):
            i = np.flatnonzero(size == k)
            i = i[np.argsort(h[i].view(np.uint64))]
            self.at[k] = (h[i].view(np.uint64), logp[i], np.nan_to_num(back[i]))

    @classmethod
    def of(cls, model: DataFrame, order: int) -> SortedModel:
        return cls(model.select("lang", "gram", "logp", "back").mapInArrow(_hashed, "size byte, hash long, logp float, back float").toArrow(), order)

    def find(self, k: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.at[k][0]
        i = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        return (keys[i] == h, i) if len(keys) else (np.zeros(len(h), bool), i)

    def logp(self, lang: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Of each row's last code point after the others (rows of ``order`` code points)."""
        out, left = np.zeros(len(lang)), np.arange(len(lang))
        for k in range(self.order, -1, -1):
            last = [points[left, j] for j in range(self.order - k, self.order)]
            hit, i = self.find(k, gram_hashes(lang[left], last))
            hit &= ~np.isnan(self.at[k][1][i]) if len(self.at[k][1]) else False
            out[left[hit]] += self.at[k][1][i[hit]]
            left = left[~hit]
            if k and len(left):
                seen, i = self.find(k - 1, gram_hashes(lang[left], [points[left, j] for j in range(self.order - k, self.order - 1)]))
                out[left[seen]] += self.at[k - 1][2][i[seen]]
        out[left] += -20.0  # a language without a model
        return out


_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _scorer(model, order: int):
    """Rows with base counts and log-perplexity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, limit=GRAM_SLICE):
            base = base_counts(batch.column("text"))
            langs = model_names(batch.column("lang").to_pylist(), 1 - halves(batch.column("text")))
            text, first, points, h = grams(batch.column("text"), langs, order)
            n, total = np.bincount(text, minlength=batch.num_rows), np.zeros(batch.num_rows)
            if len(h):
                code, some = distinct(h)
                logp = model.value.logp(lang_hash(langs)[text[some]], points[first[some][:, None] + np.arange(order)])
                total = np.bincount(text, weights=logp[code], minlength=batch.num_rows)
            entropy = pa.array(np.where(n > 0, -total / np.maximum(n, 1), 0.0), mask=n == 0)
            yield pa.record_batch([batch.column("doc_id"), batch.column("lang"), *[pa.array(x) for x in base.values()], entropy], ["doc_id", "lang", *base, "log_ppl"])

    return run


def _joined(docs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """The same rows by joins, for a model too large to broadcast. Rows are told apart by a key of their own."""

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            counts = base_counts(b.column("text"))
            yield pa.record_batch([b.column("row"), b.column("doc_id"), b.column("lang"), *[pa.array(x) for x in counts.values()]], ["row", "doc_id", "lang", *counts])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, limit=1 << 20):
            langs = model_names(b.column("lang").to_pylist(), 1 - halves(b.column("text")))
            text, first, points, h = grams(b.column("text"), langs, order)
            if not len(h):
                continue
            _, some, n = np.unique(C.mix(h + text.astype(np.uint64)), return_index=True, return_counts=True)
            yield pa.record_batch([b.column("row").take(pa.array(text[some])), pa.array([langs[i] for i in text[some]], pa.string()), pa.array(_decode(points, first[some], order), pa.string()), pa.array(n)], ["row", "lang", "gram", "n"])

    docs = docs.withColumn("row", F.xxhash64("doc_id", "lang", "text"))  # equal rows share a key, and their result
    rows = docs.mapInArrow(base, f"row long, doc_id long, lang string, {_BASE}")
    found = docs.dropDuplicates(["row"]).mapInArrow(listed, "row long, lang string, gram string, n long").withColumn("logp", F.lit(None).cast("double")).withColumn("carry", F.lit(0.0))
    for k in range(order, -1, -1):
        part = model.filter(F.char_length("gram") == k).select("lang", F.col("gram").alias("tail"), F.col("logp").alias("here"))
        found = found.withColumn("tail", F.expr(f"substr(gram, {order - k + 1})")).join(part, ["lang", "tail"], "left")
        found = found.withColumn("logp", F.coalesce("logp", F.col("here") + F.col("carry"))).drop("here", "tail")
        if k:
            part = model.filter(F.char_length("gram") == k - 1).select("lang", F.col("gram").alias("ctx"), F.coalesce("back", F.lit(0.0)).alias("weight"))
            found = found.withColumn("ctx", F.expr(f"substr(gram, {order - k + 1}, {k - 1})")).join(part, ["lang", "ctx"], "left").withColumn("carry", F.col("carry") + F.coalesce("weight", F.lit(0.0))).drop("weight", "ctx")
    total = found.groupBy("row").agg((-F.sum(F.col("n") * F.coalesce("logp", F.col("carry") - 20.0)) / F.sum("n")).alias("log_ppl"))
    return rows.join(total, "row", "left").drop("row")


def bands(rows: DataFrame, deviations: float) -> DataFrame:
    """lang, size, lower and upper, from (lang, size, log_ppl) of the documents that pass the base rules."""
    both = rows.select("lang", F.sqrt(F.pow(F.lit(2.0), F.col("size"))).alias("root"), F.explode(F.array(F.col("size"), F.lit(-1))).alias("size"), "log_ppl")  # -1: all sizes
    median = lambda x: F.percentile_approx(x, 0.5, 10_000)
    middle = C.few(both.groupBy("lang", "size").agg(median("log_ppl").alias("middle"), F.count("*").alias("n")))
    off = F.abs(F.col("log_ppl") - F.col("middle"))
    spread = both.join(middle, ["lang", "size"]).groupBy("lang", "size").agg(median(off).alias("mad"), median(off * F.col("root")).alias("by_root"), F.first("middle").alias("middle"), F.first("n").alias("n"))
    found = C.save(spread, C.scratch(rows.sparkSession, "ngram-bands"))
    whole = C.few(found.filter("size = -1").select("lang", F.col("middle").alias("all_middle"), F.col("mad").alias("all_mad"), F.col("by_root").alias("all_by_root")))
    own = F.col("n") >= CLASS_LEAST
    at = F.when(own, F.col("middle")).otherwise(F.col("all_middle"))
    mad = F.when(own, F.col("mad")).otherwise(F.greatest("all_mad", F.col("all_by_root") / F.sqrt(F.pow(F.lit(2.0), F.col("size")))))
    half = F.greatest(1.4826 * deviations * mad, F.lit(LEAST_WIDTH))
    return found.filter("size >= 0").join(whole, "lang").select("lang", "size", (at - half).alias("lower"), (at + half).alias("upper"))


def quality_rules(docs: DataFrame, order: int = ORDER, broadcast_rows: int = BROADCAST_ROWS, deviations: float = DEVIATIONS) -> DataFrame:
    """doc_id, the base counts, base_failed, log_ppl and kept of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    model, paths = build(count(docs, order), order)
    if model.count() <= broadcast_rows:
        rows = docs.mapInArrow(_scorer(spark.sparkContext.broadcast(SortedModel.of(model, order)), order), f"doc_id long, lang string, {_BASE}, log_ppl double")
    else:
        rows = _joined(docs, model, order)
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    rows = rows.withColumn("lang", F.coalesce("lang", F.lit(_NO_LANG))).withColumn("size", F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)) + 0.5)).cast("int"))
    rows = C.save(rows, C.scratch(spark, "ngram-scored"))
    C.drop(spark, *paths)
    limits = C.few(bands(rows.filter("not base_failed and log_ppl is not null").select("lang", "size", "log_ppl"), deviations))
    inside = F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(False))
    return rows.join(limits, ["lang", "size"], "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_ppl", "lower", "upper")


def op6_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(C.table(spark, sf_dir, "documents"))
