"""Operator 3: near duplicates by MinHash with tensored banding, links confirmed on full sets.

A document's set holds the distinct word shingles of its text. Two small collections of ``side``
MinHash groups (each of ``rows`` minima) are computed; a table key is formed from every pair of a
group of the first and a group of the second, so side*side tables of 2*rows minima cost only
2*side*rows minima.

1. Sketch: one row per document with the set's size and hash and the two collections.
2. Classes: documents with equal sets become one class before any key is made.
3. Buckets: classes that share a key (keys are counted first, and only those of several classes meet again); of buckets with the
   same members (their number and 128 bits of hashes) the first table's stays.
4. Star: in each bucket every class is compared on full sets with one pivot, the one that holds the fewest rare shingles (those of
   fewer than RARE classes), which a group of edited copies has at its middle. Links are closed to components.
   A pivot's pairs are cut into parts of some PART pairs, each with the pivot's text once.
5. Rest: pairs of a bucket that are still in different components. With Q any set of shingles, two sets
   share at most min(|u & Q|, |v & Q|) shingles inside Q, so a pair can only be linked if that, with the shingles
   that it shares outside Q, is enough. Q holds the shingles that RARE or more classes have; the others
   are joined (under RARE classes each; those of one class alone are left out before the shuffle), and pairs that need no rare
   shingle are found by their counts alone: in each bucket, the members outside its largest component meet its members, part by
   part. What passes is compared on full sets.

Every step is written to scratch space; its shuffle files go with it, so that disk holds one step's at a time.

No candidate is dropped, and a group of thousands of near copies costs about its size, not the square.

The side is the least at which a pair at the threshold shares no key with a probability of MISS at
most: 8 at 0.85 and 10 at 0.8, with two minima a group; a threshold that needs more than 255 is refused.

Defined cases: null, empty and wordless texts have an empty set and link with nothing; a text with
fewer words than a shingle is one shingle of all its words; repeated rows share their class; rows of one doc_id with
different texts are documents of their own (row, a hash of the text, tells them apart): kept says that the id is the
component's least, stays that the row is the one of its component to stay, of equal ids the least row; equal rows stay or go together; a null
doc_id gets a null component and stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

ROWS, MISS = 2, 1e-4
RARE = 8
PART, MEMBERS = 64, 256  # pairs of a pivot, and members of a bucket, that are handled together
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_KEYS = "key long, set_id binary, n long"
_SKETCH = "doc_id long, row long, n_shingles long, set_id binary, a array<long>, b array<long>"


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, shingle hashes) of each text's set, ascending within a text."""
    offsets, code, words = C.split_words(texts, lower=True)
    h = C.hashes(words)[code] if len(code) else np.empty(0, np.uint64)
    text, first = C.windows(offsets, width)
    mixed = np.zeros(len(first), np.uint64)
    for k in range(width):
        mixed = C.mix(mixed * np.uint64(0x9E3779B97F4A7C15) + h[first + k])
    n = np.diff(offsets)
    for i in np.flatnonzero((n > 0) & (n < width)):  # the whole sequence is one shingle
        x = np.array([n[i]], np.uint64)
        for w in h[offsets[i] : offsets[i + 1]]:
            x = C.mix(x * np.uint64(0x9E3779B97F4A7C15) + w)
        text, mixed = np.append(text, i), np.append(mixed, x)
    order = np.lexsort((mixed, text))
    text, mixed = text[order], mixed[order]
    if len(text):
        new = np.append(True, (text[1:] != text[:-1]) | (mixed[1:] != mixed[:-1]))
        text, mixed = text[new], mixed[new]
    return np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(n)))]).astype(np.int64), mixed


def collections(offsets: np.ndarray, shingles: np.ndarray, side: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The two collections, (texts, side) of uint64 each; only texts with a set."""
    full = np.flatnonzero(np.diff(offsets))
    starts, out = offsets[:-1][full], []
    seeds = C.mix(np.arange(1, 2 * side * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for c in range(2):
        groups = np.empty((len(full), side), np.uint64)
        for g in range(side):
            x = np.full(len(full), c * side + g, np.uint64)
            for r in range(rows):
                seed = seeds[(c * side + g) * rows + r]
                y = (shingles ^ seed) * (seed | np.uint64(1))
                y ^= y >> np.uint64(32)
                y *= np.uint64(0xD6E8FEB86659FD93)
                y ^= y >> np.uint64(32)
                x = C.mix(x * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(y, starts))
            groups[:, g] = x
        out.append(groups)
    return out[0], out[1]


def _set_ids(offsets: np.ndarray, shingles: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(shingles[s:e].tobytes()) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]


def _sketcher(width: int, side: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            offsets, shingles = shingle_sets(batch.column("text"), width)
            n = np.diff(offsets)
            a, b = collections(offsets, shingles, side, rows) if len(shingles) else (np.empty((0, side), np.uint64),) * 2
            at = np.concatenate([[0], np.cumsum((n > 0) * side)])
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("row"), pa.array(n), pa.array(_set_ids(offsets, shingles), pa.binary()), C.list_array(at, a.ravel().view(np.int64), pa.int64()), C.list_array(at, b.ravel().view(np.int64), pa.int64())],
                ["doc_id", "row", "n_shingles", "set_id", "a", "b"],
            )

    return run


def _keys(side: int, wanted):
    """Table keys of classes: every pair of groups of the two collections; a key's low 16 bits are its table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).flatten().to_numpy().view(np.uint64).reshape(-1, side) for c in "ab")
            pairs = C.mix(a[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + b[:, None, :]).reshape(-1, side * side)
            key = ((pairs << np.uint64(16)) | np.arange(side * side, dtype=np.uint64)).view(np.int64).ravel()
            row = np.repeat(np.arange(batch.num_rows), side * side)
            if wanted is not None:
                held = C.in_bitmap(wanted.value, key >> 16)
                key, row = key[held], row[held]
            row = pa.array(row)
            yield pa.record_batch([pa.array(key), batch.column("set_id").take(row), batch.column("n").take(row)], ["key", "set_id", "n"])

    return run


def side_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Groups in a collection; a pair needs an equal group in both."""
    side = max(1, math.ceil(math.log(miss / 2) / math.log(1 - min(percent / 100, 0.99) ** rows)))
    if side > 255:
        raise ValueError(f"{percent} % needs {side} groups a collection; a table's number has room for 255")
    return side


def sketch(docs: DataFrame, width: int, side: int, rows: int = ROWS) -> DataFrame:
    return _rows(docs).mapInArrow(_sketcher(width, side, rows), _SKETCH)


def _rows(docs: DataFrame) -> DataFrame:
    return C.doc_texts(docs).withColumn("row", C.row_key())


def _among(wanted, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(C.in_bitmap(wanted.value, batch.column("h").to_numpy()))).select(columns)

    return run


def _comparer(width: int):
    """(p, m, text) to (p, m, inter, total): a row without m holds p's text, and the rows of p after it its partners'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in C.slices(batches):
            p, m = batch.column("p").to_pylist(), batch.column("m").to_pylist()
            offsets, shingles = shingle_sets(batch.column("text"), width)
            out = []
            for i in range(batch.num_rows):
                own = shingles[offsets[i] : offsets[i + 1]]
                if m[i] is None:
                    mine = own.copy()
                    continue
                both = int((mine[np.minimum(np.searchsorted(mine, own), len(mine) - 1)] == own).sum())
                out.append((p[i], m[i], both, len(mine) + len(own) - both))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["p", "m", "inter", "total"])

    return run


def compare(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """inter and total (intersection and union) of the full sets of distinct pairs (p, m, part) of classes; texts: (set_id, text), one row
    a class. Pairs of one part of a pivot are compared together."""
    members = pairs.join(texts.withColumnRenamed("set_id", "m"), "m").select("p", "part", "m", "text")
    pivots = pairs.select("p", "part").distinct().join(texts.withColumnRenamed("set_id", "p"), "p").select("p", "part", F.lit(None).cast("binary").alias("m"), "text")
    rows = members.union(pivots).repartition("p", "part").sortWithinPartitions("p", "part", F.asc_nulls_first("m"))
    return rows.select("p", "m", "text").mapInArrow(_comparer(width), "p binary, m binary, inter long, total long")


def _slots(width: int):
    """How often each bitmap slot is met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            _, shingles = shingle_sets(batch.column("text"), width)
            slot, n = np.unique(shingles.view(np.int64) % C.BITMAP_BITS, return_counts=True)
            yield pa.record_batch([pa.array(slot), pa.array(n)], ["slot", "n"])

    return run


def _inside(width: int, common):
    """How many of a class's shingles are common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            offsets, shingles = shingle_sets(batch.column("text"), width)
            yield pa.record_batch([batch.column("set_id"), pa.array(C.segment_sums(C.in_bitmap(common.value, shingles), offsets))], ["set_id", "inside"])

    return run


def _outside(width: int, common, met):
    """(set_id, shingle): the rare ones of a class, without those that no other class has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            offsets, shingles = shingle_sets(batch.column("text"), width)
            rare = ~C.in_bitmap(common.value, shingles) & C.in_bitmap(met.value, shingles)
            of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[rare]
            yield pa.record_batch([batch.column("set_id").take(pa.array(of)), pa.array(shingles[rare].view(np.int64))], ["set_id", "shingle"])

    return run


def components(edges: DataFrame, name: str, spent: list[str]) -> DataFrame:
    """(node, comp) of the nodes of edges (u, v); comp is the least node reachable. Every node takes its
    least neighbour's label, then labels are followed one step on, until nothing changes. The result's path joins ``spent``."""
    spark = edges.sparkSession
    both = C.save(edges.select("u", "v").union(edges.select("v", "u")).distinct(), edges_at := C.scratch(spark, f"{name}-edges"))
    labels = C.save(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("comp")), old := C.scratch(spark, f"{name}-labels"))
    while True:
        low = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("comp").alias("low"))
        step = labels.join(low, labels.node == low.u).select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("comp").alias("far"))
        step = C.save(step.join(jump, "near", "left").select("node", "was", F.least("near", "far").alias("comp")), new := C.scratch(spark, f"{name}-labels"))
        done = step.filter("was <> comp").isEmpty()
        C.drop(spark, old)
        labels, old = step.select("node", "comp"), new
        if done:
            C.drop(spark, edges_at)
            spent.append(new)
            return labels


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Each step's shuffle files go when the step is written, and not when the driver happens to collect its garbage; no step reads another's."""
    was = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, was)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, side: int | None = None, rows: int = ROWS) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept and stays of documents linked at 100 * intersection >= percent * union."""
    with _tidy(docs.sparkSession):
        return _near_duplicates(docs, width, percent, side, rows)


def _near_duplicates(docs: DataFrame, width: int, percent: int, side: int | None, rows: int) -> DataFrame:
    spark = docs.sparkSession
    side = side or side_for(percent, rows)
    spent: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        """Saved until the operator ends, or until drop."""
        spent.append(C.scratch(spark, f"near-{name}"))
        return C.save(df, spent[-1])

    def drop(name: str) -> None:
        gone = [p for p in spent if f"/near-{name}-" in p]
        C.drop(spark, *gone)
        spent[:] = [p for p in spent if p not in gone]

    sketches = keep(sketch(docs, width, side, rows), "sketch")
    # one class per distinct set; copies are combined before the shuffle
    full = sketches.filter("n_shingles > 0 and doc_id is not null")
    classes = keep(full.groupBy("set_id").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("docs"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")), "classes")
    sketches = keep(sketches.select("doc_id", "row", "n_shingles", "set_id"), "sets")
    drop("sketch")
    tables = classes.select("set_id", "n", "a", "b")
    # most keys are one class's and go nowhere: they are counted alone, without the hashes of who has them
    several = tables.mapInArrow(_keys(side, None), _KEYS).groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    wanted = spark.sparkContext.broadcast(C.bitmap(several.select(F.shiftright("key", 16).alias("h")), "h"))
    keys = tables.mapInArrow(_keys(side, wanted), _KEYS)
    who = [F.bit_xor(F.xxhash64("set_id")).alias("who"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("also")]
    shared = keys.groupBy("key").agg(F.count("*").alias("members"), *who).filter("members > 1")
    shared = keep(shared.groupBy("members", "who", "also").agg(F.min(F.struct(F.expr("key & 65535").alias("t"), "key")).alias("first")).select("first.key"), "keys")
    wanted = spark.sparkContext.broadcast(C.bitmap(shared.select(F.shiftright("key", 16).alias("h")), "h"))
    found = keep(tables.mapInArrow(_keys(side, wanted), _KEYS).join(shared, "key"), "found")
    drop("keys")
    # a text for each class of a bucket
    where = found.select("set_id").distinct().join(classes.select("set_id", "first.doc_id", "first.row"), "set_id")
    named = F.xxhash64("doc_id", "row").alias("h")
    wanted = spark.sparkContext.broadcast(C.bitmap(where.select(named), "h"))  # most other texts stay where they are
    rows_of = _rows(docs).select("doc_id", "row", "text", named).mapInArrow(_among(wanted, ["doc_id", "row", "text"]), "doc_id long, row long, text string")
    rows_of = rows_of.groupBy("doc_id", "row").agg(F.first("text").alias("text"))  # repeated rows
    texts = keep(where.join(rows_of, ["doc_id", "row"]).select("set_id", "text"), "texts")
    slots = keep(texts.select("text").mapInArrow(_slots(width), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1"), "slots")
    common = spark.sparkContext.broadcast(C.bitmap(slots.filter(F.col("n") >= RARE), "slot"))
    met = spark.sparkContext.broadcast(C.bitmap(slots, "slot"))
    drop("slots")
    members = keep(found.join(texts.mapInArrow(_inside(width, common), "set_id binary, inside long"), "set_id"), "members")
    drop("found")
    fits = f"100 * least({{0}}, {{1}}) >= {percent} * greatest({{0}}, {{1}})"
    link = f"100 * inter >= {percent} * total"

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (p, m) of (p, m, part) that are links."""
        pairs = keep(pairs.groupBy("p", "m").agg(F.min("part").alias("part")), f"{name}-pairs")
        return keep(compare(pairs, texts, width).filter(link).select("p", "m"), f"{name}-links")

    pivots = keep(members.groupBy("key").agg(F.max_by(F.struct("set_id", "n"), F.struct(F.col("inside") / F.col("n"), F.xxhash64("set_id"))).alias("pivot"), F.count("*").alias("size")), "pivots")
    pairs = C.spread_join(members, pivots, ["key"], size="size").filter("set_id <> pivot.set_id").filter(fits.format("n", "pivot.n"))
    links = linked(pairs.select(F.col("pivot.set_id").alias("p"), F.col("set_id").alias("m"), F.expr(f"pmod(xxhash64(set_id), ceil(size / {PART}))").alias("part")), "star")
    tops = components(links.withColumnsRenamed({"p": "u", "m": "v"}), "near-star", spent)
    state = keep(members.join(tops.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id")), "state")
    drop("members")
    several = state.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size")).filter("c0 <> c1").select("key", "size")
    left = keep(C.spread_join(state, keep(several, "several"), ["key"], size="size").drop("size"), "left")
    more = None
    if not left.isEmpty():
        enough = f"100 * {{0}} >= {percent} * (un + vn - {{0}})"
        end = lambda x: [F.col(c).alias(f"{x}{c[0]}") for c in ("set_id", "n", "comp", "inside")]
        apart = F.expr("uc <> vc") & F.expr(fits.format("un", "vn"))
        # pairs that share rare ones
        open_ = keep(left.select("set_id", "n", "comp", "inside").distinct(), "open")
        named = F.xxhash64("set_id").alias("h")
        wanted = spark.sparkContext.broadcast(C.bitmap(open_.select(named), "h"))  # other texts stay where they are
        rare = texts.select("set_id", "text", named).mapInArrow(_among(wanted, ["set_id", "text"]), "set_id binary, text string")
        rare = rare.mapInArrow(_outside(width, common, met), "set_id binary, shingle long")
        rows = keep(open_.join(rare, "set_id"), "rare")
        both = rows.select("shingle", *end("u")).join(rows.select("shingle", *end("v")), "shingle").filter(apart & F.expr("us < vs"))
        both = both.groupBy("us", "vs").agg(F.count("*").alias("both"), *[F.first(c).alias(c) for c in ("un", "vn", "ui", "vi")]).filter(enough.format("(least(ui, vi) + both)"))
        both = keep(both.selectExpr("us as p", "vs as m"), "both")
        drop("rare")
        # pairs that common shingles alone may link, each in the first of the tables that hold both: who is not of a bucket's
        # largest component meets the bucket's members
        core = keep(left.filter(f"100 * inside >= {percent} * n"), "core")
        by_comp = core.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key")
        largest = by_comp.agg(F.max_by("comp", F.struct("k", "comp")).alias("top"), F.sum("k").alias("size"), F.count("*").alias("comps")).filter("comps > 1")
        largest = keep(largest.select("key", "top", "size", F.ceil(F.col("size") / MEMBERS).alias("parts")), "largest")
        rows = C.spread_join(core, largest, ["key"], size="size").join(classes.select("set_id", "a", "b"), "set_id")
        side_of = lambda rows, x, *more: rows.select("key", *end(x), F.col("a").alias(f"{x}_a"), F.col("b").alias(f"{x}_b"), *more)
        outside = side_of(rows.filter("comp <> top"), "u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        inside = side_of(rows, "v", F.expr("pmod(xxhash64(set_id), parts)").alias("part"), "top")
        first = " and ".join(f"({t} <= {k} or u_{c}[{k}] <> v_{c}[{k}])" for t, c in ((f"(key & 65535) div {side}", "a"), (f"(key & 65535) % {side}", "b")) for k in range(side))
        alike = outside.join(inside, ["key", "part"]).filter(apart & F.expr("vc = top or us < vs") & F.expr(enough.format("least(ui, vi)")) & F.expr(first)).selectExpr("least(us, vs) as p", "greatest(us, vs) as m")
        pairs = both if largest.isEmpty() else alike.union(both)
        links = linked(pairs.withColumn("part", F.expr("pmod(xxhash64(m), 16)")), "rest")
        if not links.isEmpty():
            of = lambda c, x: tops.select(F.col("node").alias(c), F.col("comp").alias(x))
            edges = links.join(of("p", "u"), "p", "left").join(of("m", "v"), "m", "left").select(F.coalesce("u", "p").alias("u"), F.coalesce("v", "m").alias("v"))
            more = components(edges.filter("u <> v"), "near-rest", spent)
    # a component's id is its least document
    comps = classes.select("set_id", "first", "docs").join(tops.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
    if more is not None:
        comps = comps.join(more.select(F.col("node").alias("comp"), F.col("comp").alias("on")), "comp", "left").withColumn("comp", F.coalesce("on", "comp")).drop("on")
    comps = keep(comps, "comps")
    least = keep(comps.groupBy("comp").agg(F.min("first").alias("top"), F.count("*").alias("size")), "least")
    ends = keep(C.spread_join(comps, least, ["comp"], size="size").select("set_id", "top", "docs"), "ends")
    placed = C.save(C.spread_join(sketches, ends, ["set_id"], "left", size="docs").drop("docs"), C.scratch(spark, "near-placed"))
    C.drop(spark, *spent)
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id"))
    placed = placed.select("doc_id", "row", "n_shingles", component.alias("component_id"), (alone | (F.struct("doc_id", "row") == F.col("top"))).alias("stays"))
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])) end as sh from w),
g as (select doc_id, len(sh) as n, unnest(sh) as sh from s),
links as (
  select a.doc_id as u, b.doc_id as v from g a join g b on a.sh = b.sh and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (select doc_id, doc_id as other from documents union select r.doc_id, l.v from reach r join links l on r.other = l.u),
c as (select doc_id, min(other) as component_id from reach group by doc_id)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, component_id, s.doc_id = component_id as kept from s join c on s.doc_id = c.doc_id
"""
