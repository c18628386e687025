"""Operator 10: line dedup by content-defined chunks of lines.

A rolling hash runs over the hashes of a text's lines; its window is two lines with words and the blank lines between
them, or one line alone if it holds LEAST_WORDS words. The corpus decides where a chunk begins and ends: it goes on while
the rolling hash is one that occurs at several places, so the cuts depend on what is repeated and neither on where a
passage stands nor on what stands beside it. Every run of lines that is repeated and has two lines with words, or a line of
LEAST_WORDS words, is therefore found whole. (Cuts by a divisor of the rolling hash, as for files, leave about half of such lines in
place: the first and last cut of a passage depend on its neighbours, and passages of two lines mostly hold no whole chunk.)
A window that occurs more than once, anywhere, stays at its first place (least doc_id, then hash of the text, then line), and its lines go
elsewhere; a line that goes is left at an earlier place.

Hashes only pick candidates: windows of one hash are then grouped by their bytes, and only equal bytes are
repeats. Counting sends (hash, place) without text and is combined before the shuffle; a fixed-size bitmap
of repeated hashes then lets only likely repeats' bytes be sent for the comparison (as it fills up, more are). The places of a hash
that many texts hold aren't brought together: its first place is broadcast.

Defined cases: null and empty texts have no window and stay as they are; blank lines alone are no window, those inside a
window go with it; rows of one doc_id with different texts are documents of their own; repeated rows
of one doc_id and equal text share their places, so a passage is not a repeat of itself within such rows; rows with a null
doc_id are never changed and are no occurrences; documents that lose all their lines with words keep the blank ones (the
pipeline drops those documents); windows of one text may overlap, so a line said five times over stays once; an empty table gives no rows;
other columns are kept by ``dedup``, whatever their names but for __lines_out and __chunks_out, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

LEAST_WORDS = 50
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_BACK = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


class Lines:
    """The windows of a batch of texts: first line (counted in its text), number of lines, text, rolling hash, and their bytes."""

    def __init__(self, texts: pa.Array):
        at, self.data = C.text_bytes(texts)
        data = self.data
        breaks = np.flatnonzero(data == 10)
        starts = np.sort(np.concatenate([at[:-1], breaks + 1]))  # a text's own start comes first among equal ones
        counts = np.diff(np.searchsorted(breaks, at)) + 1
        text, first_line = np.repeat(np.arange(len(at) - 1), counts), np.cumsum(counts) - counts
        ends = np.append(starts[1:] - 1, len(data))
        ends[first_line[1:] - 1] = at[1:-1]  # no line break after a text's last line
        gap = ~_SPACE[data]
        word = gap.copy()
        word[1:] &= ~gap[:-1]  # a word's first byte; a text's last word may touch the next one's first
        word[at[:-1][np.diff(at) > 0]] = gap[at[:-1][np.diff(at) > 0]]
        total = np.concatenate([[0], np.cumsum(word)])
        words = total[ends] - total[starts]
        raw = memoryview(data)
        h = np.fromiter((xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
        full = np.flatnonzero(words)
        a, b = full[:-1], full[1:]
        pair = text[a] == text[b]
        alone = full[words[full] >= LEAST_WORDS]
        first, last = np.concatenate([a[pair], alone]), np.concatenate([b[pair], alone])
        # prefix sums of h[i] / BASE^i: a window's hash is their difference times a power of BASE, whatever stands before it
        n = np.arange(len(starts) + 1)
        power, back = (np.cumprod(np.where(n > 0, np.uint64(x), np.uint64(1)), dtype=np.uint64) for x in (BASE, _BACK))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * back[:-1], dtype=np.uint64)])
        self.hash = C.mix((sums[last + 1] - sums[first]) * power[last] + (last - first).astype(np.uint64)).view(np.int64)
        self.text, self.line, self.lines = text[first], (first - first_line[text[first]]).astype(np.int32), (last - first + 1).astype(np.int32)
        self.start, self.end = starts[first], ends[last]


def _windows(columns: list[str], repeated=None):
    """Places of the windows; with ``repeated`` only those whose hash the bitmap has, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            w = Lines(batch.column("text"))
            held = np.flatnonzero(C.in_bitmap(repeated.value, w.hash)) if repeated is not None else np.arange(len(w.hash))
            take = pa.array(w.text[held])
            cols = [batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(w.line[held]), pa.array(w.lines[held]), pa.array(w.hash[held])]
            if repeated is not None:
                raw = w.data.tobytes()
                cols.append(pa.array([raw[s:e] for s, e in zip(w.start[held].tolist(), w.end[held].tolist(), strict=True)], pa.binary()))
            yield pa.record_batch(cols, columns)

    return run


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, row, line, lines of every occurrence of a window after its first."""
    spark = docs.sparkSession
    texts = C.doc_texts(docs).filter("doc_id is not null and text <> ''").withColumn("row", C.row_key())
    place, names = F.struct("doc_id", "row", "line"), ["doc_id", "row", "line", "lines", "hash"]
    schema = "doc_id long, row long, line int, lines int, hash long"
    places = C.save(texts.mapInArrow(_windows(names), schema), places_at := C.scratch(spark, "lines-places"))
    often = places.groupBy("hash").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo <> hi").select("hash")
    bitmap = spark.sparkContext.broadcast(C.bitmap(often, "hash"))
    found = texts.mapInArrow(_windows([*names, "bytes"], bitmap), f"{schema}, bytes binary")
    # the comparison: equal hash and equal bytes
    equal = found.groupBy("hash", "bytes").agg(F.min(place).alias("first"), F.max(place).alias("last")).select("hash", "first", "last")
    equal = C.save(equal, equal_at := C.scratch(spark, "lines-equal"))
    clash = equal.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    single = equal.filter("first <> last").join(clash, "hash", "left_anti").select("hash", "first")
    again = C.spread_join(places, single, ["hash"]).filter(place != F.col("first")).select("doc_id", "row", "line", "lines")
    if not clash.isEmpty():
        # texts that share a hash but not their bytes are told apart by their bytes
        both = found.join(clash, "hash")
        own = both.groupBy("hash", "bytes").agg(F.min(place).alias("first"))
        again = again.union(both.join(own, ["hash", "bytes"]).filter(place != F.col("first")).select("doc_id", "row", "line", "lines"))
    again = C.save(again.distinct(), C.scratch(spark, "lines-again"))
    C.drop(spark, places_at, equal_at)
    return again


def dedup(docs: DataFrame) -> DataFrame:
    """docs with repeated chunks taken out of text, and two more columns: __lines_out and __chunks_out (runs of lines that went)."""
    gone = repeats(docs).groupBy("doc_id", "row").agg(F.collect_list(F.struct("line", "lines")).alias("gone"))  # at most two windows a line of one text
    docs = docs.drop("__lines_out", "__chunks_out")
    # own columns side by side with docs in structs, so that no name clashes
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("row")).join(gone, ["doc_id", "row"], "left")
    # the line numbers that go
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform("gone", lambda g: F.sequence(g["line"], g["line"] + g["lines"] - 1)))))
    rows = rows.select("d", numbers.alias("numbers")).withColumn("lines", F.when(F.col("numbers").isNotNull(), F.split("d.text", "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "numbers")
    kept = F.transform(stay, lambda i: F.get("lines", i))
    text = F.when(F.col("numbers").isNull(), F.col("d.text")).otherwise(F.array_join(kept, "\n"))
    new_run = lambda a, x: F.struct((a["n"] + (x > a["at"] + 1).cast("int")).alias("n"), x.alias("at"))
    runs = F.aggregate("numbers", F.struct(F.lit(0).alias("n"), F.lit(-2).alias("at")), new_run, lambda a: a["n"])
    counts = [F.coalesce(F.when(F.col("numbers").isNotNull(), c), F.lit(0)).cast("long") for c in (F.size("numbers"), runs)]
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"d.`{c}`").alias(c) for c in docs.columns], counts[0].alias("__lines_out"), counts[1].alias("__chunks_out"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.col("__lines_out").alias("n_lines_removed"), F.col("__chunks_out").alias("n_chunks_removed"), F.char_length(text).cast("long").alias("n_chars_left"), F.crc32(text.cast("binary")).alias("text_crc32"))
