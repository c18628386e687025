"""Helpers shared by the training-data operators.

Scratch data goes to the folder the session names in ``spark.checkpoint.dir``; where it names none, a folder of this machine
is made if all of Spark runs in this process, and anything else is refused.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on; bounds a Python worker's memory whatever the batch.
SLICE_BYTES = 1 << 20


# ---- tables and scratch space ------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="gritstone-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/gritstone/{name}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write df as Parquet and read it back: cuts the lineage, survives lost executors."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):  # scratch space only; a leftover does no harm
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def doc_texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of documents; null texts become empty, other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def row_key() -> Column:
    """With doc_id, tells rows of documents apart: rows of one id with different texts are different documents."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs (all columns) but those that gone (doc_id, row) names; a null id is like any other."""
    names = gone.select(F.col("doc_id").alias("__gone_id"), F.col("row").alias("__gone_row")).distinct()
    return docs.join(names, docs["doc_id"].cast("long").eqNullSafe(names["__gone_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == names["__gone_row"]), "left_anti")


#: A key is hot with more than 1/HOT of a side's rows (and HOT_LEAST rows), so fewer than HOT keys are.
HOT, HOT_LEAST = 4096, 128


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", size: str | None = None) -> DataFrame:
    """left.join(right, on, how), inner or left, where right has one row a key. The rows of left of a hot key are cut into parts of about 1/HOT of
    all by a hash of the row, and right's row is repeated for each part, so no task gets a hot key's rows. ``size`` is a column of right with the number
    of left's rows of the key; without it they are counted. Both sides are read several times: give them written."""
    counts = right.select(*on, F.col(size).alias("__n")) if size else left.groupBy(*on).agg(F.count("*").alias("__n"))
    rows, most = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).first()
    least = max(rows // HOT, HOT_LEAST)
    if most <= least:
        return left.join(right, on, how)
    parts = F.ceil(F.col("__n") / least).alias("__parts")
    keys = F.broadcast(save(counts.filter(F.col("__n") > least).select(*on, parts), scratch(left.sparkSession, "hot")))  # fewer than HOT rows
    own = F.coalesce(F.pmod(F.xxhash64(*[left[c] for c in left.columns]), F.col("__parts")), F.lit(0).cast("long"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__parts") - 1, F.lit(0).cast("long"))))
    side = lambda df, part: df.join(keys, on, "left").withColumn("__part", part).drop("__parts")
    return side(left, own).join(side(right, each), [*on, "__part"], how).drop("__part")


def few(df: DataFrame, limit: int = 4096) -> DataFrame:
    """df marked for broadcast if it has at most ``limit`` rows, as it is otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3; fold 1 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


#: Bits of a broadcast membership map: 8 MB, whatever the corpus.
BITMAP_BITS = 1 << 26
_BLOCK = 1 << 15  # bits in one of Spark's bitmap buckets


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """BITMAP_BITS bits as bytes: bit h mod BITMAP_BITS of each long h; made on the executors, 4 kB blocks come to the driver."""
    bit = f"pmod({column}, {BITMAP_BITS})"
    rows = hashes.groupBy(F.expr(f"cast({bit} div {_BLOCK} as int)").alias("block")).agg(F.expr(f"bitmap_construct_agg({bit} % {_BLOCK})").alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(r["bits"], np.uint8)
        out[r["block"] * _BLOCK // 8 :][: len(part)] = part
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    b = (hashes.view(np.int64) % BITMAP_BITS).astype(np.int64)
    return (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1


# ---- Arrow batches -----------------------------------------------------------------------------


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` text bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # a worker lives on after its task


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array, offsets from 0."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+``: (word offset of each text, code of each word, distinct words)."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets, flat = parts.offsets.to_numpy().astype(np.int64), parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.min(full).as_py() is False:
        counts = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        offsets, flat = counts[offsets - offsets[0]], flat.filter(full)
    else:
        offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of each window, its first word) for all windows of ``width`` words inside one text."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][text]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start .. start+length-1 of each piece, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def list_array(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def crc32(data: bytes | memoryview) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
