"""Operator 1: token ids as Parquet list columns.

Documents are range-partitioned and sorted by doc_id, encoded in Arrow batches and written as
Parquet: ids as a dictionary-coded ``list<int>``, doc_id / part / start_in_part / n_tokens
delta-coded (format version 2), row groups of a set size, and column and offset indexes, so that a reader can
fetch the metadata alone or the tokens of a few documents alone. A small index beside the files
holds each part's first token, so the start of every document is known without a global sort of
tokens and without reading them.

Encoding: a text is cut where the byte-level pattern always cuts too (single spaces and line ends
between other characters, signs after letters), so the distinct pieces of a batch are encoded once
and put together, and a worker remembers a bounded number of them for its next batches.

Defined cases: null or empty text gives the end id alone; null doc_id sorts first; repeated rows
are all stored (ties in doc_id order by text); an empty table gives no rows; extra columns go.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
WRITE = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#part": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
#: Pieces whose ids a worker remembers, and their bytes at most.
KNOWN, KNOWN_BYTES = 200_000, 64
#: Pieces that the library gets as one text.
JOIN = 500
_BLANKS = r"\s\x0B\x1C-\x1F\x{85}\pZ\x{180E}"
_PLAIN = rf"\A[ \n]?[^{_BLANKS}]((?s:.)*[^{_BLANKS}])?\z"
_BYTES = np.arange(256)
_BLANK = (_BYTES >= 9) & (_BYTES <= 13) | (_BYTES >= 28) & (_BYTES <= 32)
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in _BYTES])
_PUNCT = (_BYTES > 32) & (_BYTES < 127) & ~_ALNUM
_WIDE = np.isin(_BYTES, (0xC2, 0xE1, 0xE2, 0xE3))  # first bytes of the wide blanks
_WIDE2, _WIDE3 = ([int.from_bytes(c.encode()) for c in cs] for cs in ("\x85\xa0", "\u1680\u180e\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))))
_loaded: dict = {}


def tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _ids(tok, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = [e.ids for e in tok.encode_batch_fast(pieces, add_special_tokens=False)]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return sizes, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum()))


def _token_bytes(tok) -> np.ndarray:
    """Bytes of text that each id stands for."""
    if ("bytes", id(tok)) not in _loaded:
        vocab = tok.get_vocab()
        sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        sizes[list(vocab.values())] = [len(t) for t in vocab]  # a sign for each byte
        for i, t in tok.get_added_tokens_decoder().items():
            sizes[i] = len(t.content.encode())
        _loaded["bytes", id(tok)] = sizes
    return _loaded["bytes", id(tok)]


def _piece_ids(tok, words: pa.Array, plain: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As _ids of each piece. Those that end without a blank and start with none, or with one space or line end, go to the library
    many at a time, as one text, a line end before each that has no blank; the bytes of its tokens tell where each piece ends."""
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int32)
    if plain is None:
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
    some = words.filter(pa.array(plain))
    bare = pc.invert(pc.or_(pc.starts_with(some, " "), pc.starts_with(some, "\n")))
    offsets, data = C.text_bytes(pc.binary_join_element_wise(pc.if_else(bare, "\n", ""), some, ""))
    bare, whole = bare.to_numpy(zero_copy_only=False), data.tobytes()
    _, ids = _ids(tok, [whole[s:e].decode() for s, e in itertools.pairwise(offsets[[*range(0, len(some), JOIN), len(some)]])])
    width = _token_bytes(tok)[ids]
    reached = np.concatenate([[0], np.cumsum(width)])
    at = np.searchsorted(reached, offsets)
    if at[-1] > len(ids) or (reached[at] != offsets).any() or (width[at[:-1][bare]] != 1).any():  # not of the byte-level kind
        return _ids(tok, words.to_pylist())
    sizes, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    starts[plain] = at[:-1] + bare
    sizes[plain] = at[1:] - starts[plain]
    rest, more = _ids(tok, words.filter(pa.array(~plain)).to_pylist())
    sizes[~plain], starts[~plain] = rest, len(ids) + np.cumsum(rest) - rest
    return sizes, np.concatenate([ids, more])[C.ragged(starts, sizes)]


class _Known:
    """Ids of up to KNOWN pieces that a worker has met. When they are too many, those not met again since the last time go."""

    def __init__(self, tok):
        self.tok = tok  # its id is the key, so it has to stay
        self.place: dict[str, int] = {}
        self.starts, self.sizes, self.ids, self.again = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)

    def find(self, words: np.ndarray) -> np.ndarray:
        at = np.fromiter(map(self.place.get, words, itertools.repeat(-1)), np.int64, len(words))
        self.again[at[at >= 0]] = True
        return at

    def add(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        if len(self.place) + len(words) > KNOWN:
            keep = np.flatnonzero(self.again)[-(KNOWN // 2) :]
            self.place = dict(zip(np.array(list(self.place), object)[keep], range(len(keep)), strict=True))
            self.ids, self.sizes = self.ids[C.ragged(self.starts[keep], self.sizes[keep])], self.sizes[keep]
            self.again = np.zeros(len(keep), bool)
        n = KNOWN - len(self.place)
        self.place.update(zip(words[:n], range(len(self.place), len(self.place) + len(words[:n])), strict=True))
        self.ids, self.sizes = np.concatenate([self.ids, ids[C.ragged(starts[:n], sizes[:n])]]), np.concatenate([self.sizes, sizes[:n]])
        self.starts, self.again = np.cumsum(self.sizes) - self.sizes, np.append(self.again, np.zeros(len(words[:n]), bool))


def _all_ids(tok, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes, ids) of different pieces, with what is known from earlier slices."""
    known = _loaded.setdefault(("known", id(tok)), _Known(tok))
    names = words.to_numpy(zero_copy_only=False)
    at = known.find(names)
    new, old = np.flatnonzero(at < 0), at >= 0
    fresh = words.take(pa.array(new))
    new_sizes, new_ids = _piece_ids(tok, fresh)
    new_starts = np.cumsum(new_sizes) - new_sizes
    starts, sizes, ids = np.empty(len(words), np.int64), np.empty(len(words), np.int64), np.concatenate([known.ids, new_ids])
    starts[new], sizes[new] = len(known.ids) + new_starts, new_sizes
    starts[old], sizes[old] = known.starts[at[old]], known.sizes[at[old]]
    short = np.flatnonzero(pc.binary_length(fresh).to_numpy(zero_copy_only=False) <= KNOWN_BYTES)
    if len(short):
        known.add(names[new[short]], new_starts[short], new_sizes[short], new_ids)
    return starts, sizes, ids


def _blanks(data: np.ndarray) -> np.ndarray:
    """Whether each byte is of a blank of any script."""
    blank, at = _BLANK[data], np.flatnonzero(_WIDE[data])
    if len(at):
        b = np.append(data, np.zeros(2, np.uint8)).astype(np.int64)
        two = b[at] << 8 | b[at + 1]
        for n, found in (2, np.isin(two, _WIDE2)), (3, np.isin(two << 8 | b[at + 2], _WIDE3)):
            for i in range(n):
                blank[at[found] + i] = True
    return blank


def _pieces(texts: pa.Array, tok) -> tuple[np.ndarray, pa.Array]:
    """(offsets, pieces) of texts. A cut is where the byte-level pattern always cuts: before a space or line end between two characters that are no
    blanks, and before an ASCII sign after a letter or digit (of ASCII or Latin-1), but not in a text with an added token, which may hold such a place."""
    starts, data = C.text_bytes(texts.cast(pa.string()))
    n = len(data)
    if not n:
        return np.zeros(len(texts) + 1, np.int64), pa.array([], pa.string())
    edge, blank = np.zeros(n + 1, bool), _blanks(data)
    edge[starts] = True
    spaces = np.flatnonzero((data[1:-1] == 32) | (data[1:-1] == 10)) + 1
    spaces = spaces[~(blank[spaces - 1] | blank[spaces + 1] | edge[spaces] | edge[spaces + 1])]
    word = _ALNUM[data]
    word[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # all but the signs of multiplication and division
    signs = np.flatnonzero(_PUNCT[data[1:]] & word[:-1]) + 1
    added = np.zeros(len(texts), bool)
    for t in tok.get_added_tokens_decoder().values():
        added |= pc.fill_null(pc.match_substring(texts, t.content), False).to_numpy(zero_copy_only=False)
    if added.any():
        signs = signs[~added[np.searchsorted(starts, signs, "right") - 1]]
    edge[spaces] = True
    edge[signs] = True
    bounds = np.flatnonzero(edge)
    return np.searchsorted(bounds, starts), pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))


def encode(texts: pa.Array, tok, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of whole texts, each with end_id after it; equal to encoding each text alone."""
    offsets, pieces = _pieces(texts, tok)
    coded = pieces.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    starts, sizes, ids = _all_ids(tok, coded.dictionary)
    starts, sizes = starts[code], sizes[code]
    if end_id is not None:  # one more piece after each text
        starts, sizes = np.insert(starts, offsets[1:], len(ids)), np.insert(sizes, offsets[1:], 1)
        ids = np.append(ids, np.int32(end_id))
        offsets = offsets + np.arange(len(offsets))
    total = np.concatenate([[0], np.cumsum(sizes)])
    return total[offsets], ids[C.ragged(starts, sizes)]


def _encoder(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = pyspark.TaskContext.get().partitionId(), 0
        for batch in C.slices(batches):
            offsets, ids = encode(batch.column("text"), tokenizer(path), end_id)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(done + offsets[:-1]), pa.array(np.diff(offsets)), C.list_array(offsets, ids, pa.int32())],
                ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
            )
            done += int(offsets[-1])

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Write the token files and the index of their parts under ``path``."""
    spark = docs.sparkSession
    rows = C.doc_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_encoder(tokenizer_path, end_id), SCHEMA).write.mode("overwrite").options(**WRITE).parquet(f"{path}/tokens")
    parts = metadata(spark, path).groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).collect()  # a row for each file
    base, index = 0, []
    for p in sorted(parts, key=lambda p: p["part"]):
        index.append((p["part"], base, p["n_docs"], p["n"], p["first_doc"], p["last_doc"]))
        base += p["n"]
    spark.createDataFrame(index, "part int, base long, n_docs long, part_tokens long, first_doc long, last_doc long").coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, start_in_part and n_tokens; the ids are not read."""
    return spark.read.schema("doc_id long, part int, start_in_part long, n_tokens long").parquet(f"{path}/tokens")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids; a filter on doc_id or start_in_part reaches the page indexes."""
    index = spark.read.parquet(f"{path}/index").select("part", "base")
    return spark.read.schema(SCHEMA).parquet(f"{path}/tokens").join(index, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [C.crc32(flat[s:e].tobytes()) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.record_batch([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(tokens: DataFrame) -> DataFrame:
    return tokens.mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = C.scratch(spark, "tokens")
    write(C.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digest(read(spark, path))
