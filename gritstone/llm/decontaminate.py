"""Operator 9: benchmark decontamination by template canonicalisation.

Words lose outer punctuation and case; numbers, names (capitalised words), units after a number and quantities become
typed placeholders. Windows of WIDTH template words are hashed and joined with the benchmark's windows. A
hit's slots pair the item's values with the document's; hits of one alignment (document place less item place)
whose values differ count only if the alignment's pairs are one-to-one, so a re-parameterised question is caught (each value replaced
throughout by another) and a chance fit of templates is not; hits with the item's own values count in any case. A document is
contaminated by an item if the distinct windows that hit are half of the item's, or RUN words' worth of windows.

Three hashes are taken of a window: with all placeholders; with placeholders for numbers, units and quantities only, where it has some
(languages that capitalise nouns have few other words left); and by its own words without case, so that a copy in
capitals or in lower case, whose names can't be told, hits as well. A window with fewer than LITERALS words that are no placeholders has no hash
of that kind, so different texts in capitals or tables of numbers don't match each other. Items shorter than a window are one
window of their own width. Items of fewer than ``least`` words (two) are not looked for: one word alone is no passage. Items with the same
words are one item, under the least item_id.

The benchmark's window hashes go to the Python workers as a filter only while they are at most ``broadcast_hashes``; beyond
that all windows are joined, with the same result.

Defined cases: null and empty texts hit nothing; null texts and null ids of items are left out; a repeated row gives
no second row (pairs are distinct); documents with a null doc_id are not reported by ``contaminated``, but ``clean`` takes
them out like others; rows of one doc_id with different texts are judged each by its own text, and ``contaminated`` names the id if one of them
holds the item (the figures are of the row with most hits); empty tables give no hits; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

WIDTH, LITERALS, LEAST = 8, 4, 2
RUN, SHARE = 13, 0.5
BROADCAST_HASHES = 4_000_000  # 32 MB
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec min h hr hrs day days week weeks month months year years hz khz mhz ghz b kb mb gb tb w kw v a k c f usd eur gbp dollar dollars euro euros cent cents percent pct meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres hour hours minute minutes second seconds degree degrees".split()
_PUNCT = ".,;:!?\"'()[]{}<>|*#&~`_=“”‘’«»…-–—"
_NUMBER = r"^[+-]?[$€£]?[0-9][0-9.,:/]*(%|st|nd|rd|th)?$"
_QUANTITY = r"^[0-9][0-9.,]*(" + "|".join(map(re.escape, UNITS)) + ")$"
LITERAL, NUMBER, NAME, UNIT, QUANTITY = range(5)
_HIT = "hash long, pos long, slots array<string>"


def canonical(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(type, literal hash, value) of each word by itself."""
    core = pc.utf8_trim(words, _PUNCT)
    core = pc.if_else(pc.equal(core, ""), words, core)  # a word of punctuation alone stays
    low = pc.utf8_lower(core)
    kind = np.zeros(len(words), np.int64)
    test = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
    kind[test(pc.match_substring_regex(core, r"^\p{Lu}"))] = NAME
    kind[test(pc.is_in(low, pa.array(UNITS)))] = UNIT
    digits = test(pc.match_substring_regex(core, "[0-9]"))
    if digits.any():
        some = low.filter(pa.array(digits))
        at = np.flatnonzero(digits)
        kind[at[test(pc.match_substring_regex(some, _QUANTITY))]] = QUANTITY
        kind[at[test(pc.match_substring_regex(some, _NUMBER))]] = NUMBER
    return kind, C.hashes(low), low


def template_windows(texts: pa.Array, widths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """For each width: (width, text, place in the text, first word, hash, code of each word's slot value or -1, values);
    first by templates, where a window has the plain words for it, then by templates of figures, where it has figures, then all
    windows by their own words, without slots."""
    offsets, code, words = C.split_words(texts)
    kinds, literal, values = canonical(words)
    kind, own = kinds[code], literal[code]
    unit = kind == UNIT
    if unit.any():  # a unit follows a number of the same text; elsewhere it is a word like any other, or a name
        follows = np.zeros(len(kind), bool)
        follows[1:] = kind[:-1] == NUMBER
        follows[offsets[:-1][np.diff(offsets) > 0]] = False
        kind[unit & ~follows] = LITERAL
    figure = (kind != LITERAL) & (kind != NAME)
    marks = C.mix(np.arange(1, 6, dtype=np.uint64))
    several, none = np.where(kind == LITERAL, own, marks[kind]), np.full(len(code), -1, np.int64)
    kinds_of = (
        (several, np.where(kind == LITERAL, -1, code), np.concatenate([[0], np.cumsum(kind == LITERAL)]), None, 0),
        (np.where(figure, marks[kind], own), np.where(figure, code, -1), np.concatenate([[0], np.cumsum(~figure)]), np.concatenate([[0], np.cumsum(figure)]), 2000),
        (own, none, None, None, 1000),
    )
    for width in widths:
        all_text, all_first = C.windows(offsets, width)
        for word, codes, plain, held, seed in kinds_of:
            text, first = all_text, all_first
            if plain is not None:
                some = plain[first + width] - plain[first] >= min(LITERALS, width)
                if held is not None:
                    some &= held[first + width] > held[first]
                text, first = text[some], first[some]
            x = np.full(len(first), width + seed, np.uint64)
            for k in range(width):
                x = C.mix(x * np.uint64(0x9E3779B97F4A7C15) + word[first + k])
            yield width, text, first - offsets[:-1][text], first, x.view(np.int64), codes, values


def _slot_lists(first: np.ndarray, width: int, slots: np.ndarray, values: pa.Array) -> pa.Array:
    codes = slots[first[:, None] + np.arange(width)] if len(first) else np.empty((0, width), np.int64)
    held = codes >= 0
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held.sum(axis=1))]), pa.int32()), values.take(pa.array(codes[held], pa.int64())).cast(pa.string()))


def _lister(keys: list[str], widths: tuple[int, ...], wanted, whole: bool = False):
    """Windows of each text; with ``wanted`` only those whose hash it holds, with ``whole`` those of the text's own width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value if wanted is not None else None
        for batch in C.slices(batches):
            sizes = batch.column("n_words").to_numpy() if whole else None
            for width, text, pos, first, h, slots, values in template_windows(batch.column("text"), widths):
                held = np.ones(len(h), bool)
                if whole:
                    held = np.minimum(sizes[text], max(widths)) == width
                if keep is not None and len(keep):
                    held = keep[np.minimum(np.searchsorted(keep, h), len(keep) - 1)] == h
                take = pa.array(text[held])
                yield pa.record_batch([*[batch.column(k).take(take) for k in keys], pa.array(h[held]), pa.array(pos[held]), _slot_lists(first[held], width, slots, values)], [*keys, "hash", "pos", "slots"])

    return run


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """item_id, n_words, hash, pos, slots of the benchmark's distinct items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    items = items.withColumn("words", words).filter(F.size("words") >= least)
    items = items.groupBy(F.array_join("words", " ").alias("text")).agg(F.min("item_id").alias("item_id"), F.first(F.size("words")).cast("long").alias("n_words"))
    windows = items.select("item_id", "n_words", "text").mapInArrow(_lister(["item_id", "n_words"], tuple(range(least, width + 1)), None, whole=True), f"item_id long, n_words long, {_HIT}")
    return windows.withColumn("n_windows", F.greatest(F.col("n_words") - width + 1, F.lit(1)).cast("long"))


def _held(docs: DataFrame, benchmark: DataFrame, width: int, broadcast_hashes: int) -> DataFrame:
    """doc_id, row, item_id, n_hits, n_windows, same, first_word of texts that hold an item."""
    spark = docs.sparkSession
    items = C.save(benchmark_windows(benchmark, width), C.scratch(spark, "decontaminate-items"))
    hashes = items.select("hash").distinct()
    wanted, widths = None, tuple(sorted(r[0] for r in items.select(F.least("n_words", F.lit(width))).distinct().collect()))  # at most width of them
    if hashes.count() <= broadcast_hashes:
        wanted = spark.sparkContext.broadcast(np.sort(hashes.toArrow().column("hash").to_numpy()))
    texts = C.doc_texts(docs).withColumn("row", C.row_key())
    hits = texts.mapInArrow(_lister(["doc_id", "row"], widths, wanted), f"doc_id long, row long, {_HIT}")
    hits = hits.join(items.select("hash", "item_id", "n_windows", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots")), "hash")
    hits = hits.filter(F.size("slots") == F.size("item_slots")).withColumn("shift", F.col("pos") - F.col("item_pos"))
    same = F.col("slots") == F.col("item_slots")
    place = hits.groupBy("doc_id", "row", "item_id", "shift").agg(
        F.max("n_windows").alias("n_windows"),
        F.collect_set("item_pos").alias("at"),  # at most an item's windows, as is the next
        F.collect_set(F.when(same, F.col("item_pos"))).alias("same_at"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))))).alias("pairs"),
        F.min("pos").alias("first_word"),
    )
    one_to_one = (F.size(F.array_distinct(F.col("pairs.i"))) == F.size("pairs")) & (F.size(F.array_distinct(F.col("pairs.d"))) == F.size("pairs"))
    unchanged = F.forall("pairs", lambda p: p["i"] == p["d"])
    place = place.withColumn("hit", F.when(one_to_one, F.col("at")).otherwise(F.col("same_at"))).filter(F.size("hit") > 0)
    found = place.groupBy("doc_id", "row", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.size(F.array_distinct(F.flatten(F.collect_set("hit")))).cast("long").alias("n_hits"), F.min("first_word").alias("first_word"), F.max(unchanged | ~one_to_one).alias("same")
    )
    need = F.least(F.ceil(F.col("n_windows") * SHARE), F.lit(max(RUN - width + 1, 1)))
    return found.filter(F.col("n_hits") >= need)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """doc_id, item_id, n_hits, n_windows, coverage, reparameterised, first_word of documents that hold an item."""
    found = _held(docs.filter("doc_id is not null"), benchmark, width, broadcast_hashes)
    best = F.max_by(F.struct("n_hits", "n_windows", "same", "first_word"), F.struct("n_hits", "same", -F.col("first_word")))
    found = found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")
    return found.select("doc_id", "item_id", "n_hits", "n_windows", (F.col("n_hits") / F.col("n_windows")).alias("coverage"), (~F.col("same")).alias("reparameterised"), "first_word")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns as they are."""
    return C.without(docs, _held(docs, benchmark, width, broadcast_hashes))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
