"""Operator 7: SentencePiece encoding and decoding by unigram Viterbi over a double-array trie.

Pieces and log scores come from a public model file (never trained here), whose normalizer fields must ask for what is done here and nothing else. A text gets a whitespace
mark before it and one for every blank; Viterbi then finds the pieces with the largest sum of scores.
A character that no piece of its own covers costs the least score less 10 and is written as its UTF-8
bytes' pieces. Decoding joins the pieces, turns marks into blanks and takes off the first.

No piece but runs of marks holds a mark after its start, so the best path of a text is the best
paths of its marked words: the distinct words of a batch are solved once, many at a time in numpy, and
put together. The trie's arrays have a size set by the vocabulary and are broadcast.

Ties go to the path found first, from left to right, shorter pieces first.

Defined cases: null and empty texts have no ids and decode to the empty text; a mark that the text
itself holds decodes to a blank (as in the format itself), so round_trip compares after that; repeated
rows get equal rows; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

MARK = "▁"
PENALTY = 10.0
SEARCH = 2048  # places that the trie's builder looks at together
LONG = 48  # words of more bytes are solved one by one
TOGETHER = 1 << 15  # shorter ones that are solved together
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6  # piece types of the format


# ---- the model file ----------------------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        match tag & 7:
            case 0:
                yield tag >> 3, varint()
            case 1:
                at += 8
            case 2:
                n = varint()
                at += n
                yield tag >> 3, data[at - n : at]
            case 5:
                at += 4
                yield tag >> 3, data[at - 4 : at]


def check_normalizer(path: str) -> None:
    """Refuses model files that ask for text changes other than a mark before the text and one for every blank."""
    parts = dict(_fields(open(path, "rb").read()))  # noqa: SIM115
    trainer, normalizer = (dict(_fields(parts.get(n, b""))) for n in (2, 3))
    asked = {
        "a table of character replacements": bool(normalizer.get(2)),
        "no mark before the text": not normalizer.get(3, 1),
        "taking out blanks": bool(normalizer.get(4, 1)),
        "blanks as they are": not normalizer.get(5, 1),
        "marks after words": bool(trainer.get(24, 0)),
    }
    if any(asked.values()):
        raise ValueError(f"{path} asks for " + ", ".join(k for k, v in asked.items() if v))


def load_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id."""
    out = []
    for number, value in _fields(open(path, "rb").read()):  # noqa: SIM115
        if number == 1:
            f = dict(_fields(value))
            out.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
    return out


# ---- double-array trie -------------------------------------------------------------------------


def build_trie(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): the child of state s under byte b is base[s] + b if check there is s; value is -1 where no key ends."""
    nodes: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, value in keys.items():
        s = 0
        for b in key:
            if b not in nodes[s]:
                nodes[s][b] = len(nodes)
                nodes.append({})
                ends.append(-1)
            s = nodes[s][b]
        ends[s] = value
    size = 4 * len(nodes) + 8 * SEARCH
    base, check, value, used = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.zeros(size, bool)
    place, used[0], lowest, todo = {0: 0}, True, 1, [0]
    value[0] = ends[0]
    for node in todo:  # breadth first: the list grows as it is walked
        children = np.array(sorted(nodes[node]), np.int64)
        if not len(children):
            continue
        lowest += int(np.argmin(used[lowest:]))
        at = max(lowest - int(children[0]), 1)
        while True:  # the first place, a window at a time, where all children are free
            window = np.zeros(SEARCH, bool)
            for c in children:
                window |= used[at + c : at + c + SEARCH]
            if not window.all():
                at += int(np.argmin(window))
                break
            at += SEARCH
        base[place[node]] = at
        for c in children:
            child = nodes[node][int(c)]
            place[child] = at + int(c)
            used[at + c], check[at + c], value[at + c] = True, place[node], ends[child]
            todo.append(child)
    top = int(np.flatnonzero(used)[-1]) + 257
    return base[:top], check[:top], value[:top]


@dataclass
class Model:
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: float
    #: what each id decodes to: the bytes of all, and where each starts
    starts: np.ndarray
    data: np.ndarray

    @classmethod
    def from_pieces(cls, pieces: list[tuple[str, float, int]]) -> Model:
        normal = [s for _, s, t in pieces if t == NORMAL]
        scores = np.array([s for _, s, _ in pieces])
        top = max(normal, default=0.0)
        for i, (p, _, t) in enumerate(pieces):
            if t == USER_DEFINED:  # always better than its parts
                scores[i] = len(p) * top - 0.1
        byte_ids = np.full(256, -1, np.int64)
        for i, (p, _, t) in enumerate(pieces):
            if t == BYTE:
                byte_ids[int(p[3:5], 16)] = i
        own = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() if t in (NORMAL, USER_DEFINED, UNUSED) else b"" for p, _, t in pieces]
        trie = build_trie({p.encode(): i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER_DEFINED)})
        return cls(*trie, scores, byte_ids, min(normal, default=0.0) - PENALTY, np.concatenate([[0], np.cumsum([len(x) for x in own])]), np.frombuffer(b"".join(own), np.uint8))

    # ---- Viterbi ----

    def one(self, word: bytes) -> list[int]:
        """Ids of one marked word."""
        n = len(word)
        best, back, via = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value = self.base, self.check, self.value
        for i in range(n):
            if best[i] == float("-inf"):
                continue
            char = i + _char_bytes(word[i])
            state, j, single = 0, i, False
            while j < n:
                t = int(base[state]) + word[j]
                if check[t] != state or t == 0:
                    break
                state, j = t, j + 1
                v = int(value[t])
                if v >= 0:
                    single |= j == char
                    s = best[i] + self.scores[v]
                    if s > best[j]:
                        best[j], back[j], via[j] = s, i, v
            if not single:
                s = best[i] + self.unknown
                if s > best[char]:
                    best[char], back[char], via[char] = s, i, -1
        out, j = [], n
        while j > 0:
            i = back[j]
            out.extend([via[j]] if via[j] >= 0 else [int(self.byte_ids[b]) for b in reversed(word[i:j])])
            j = i
        return out[::-1]

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of short marked words, solved together: position by position, and at each the trie walks
        of all words that have not ended."""
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-size, kind="stable")
        n, m = len(words), int(size.max(initial=0))
        data = np.zeros((m + 1, n), np.uint8)
        flat = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        data[C.ragged(np.zeros(n, np.int64), size[order]), np.repeat(np.arange(n), size[order])] = flat
        best, back, via = np.full((m + 1, n), -np.inf), np.zeros((m + 1, n), np.int16), np.full((m + 1, n), -1, np.int32)
        best[0] = 0
        lengths = size[order]
        for i in range(m):
            w = np.flatnonzero((lengths > i) & (best[i] > -np.inf))
            first = data[i, w]
            char = i + np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
            single, start = np.zeros(len(w), bool), np.arange(len(w))
            state, walk, j = np.zeros(len(w), np.int64), w, i
            while len(walk):
                t = self.base[state].astype(np.int64) + data[j, walk]
                go = (self.check[t] == state) & (t > 0)
                walk, start, state, j = walk[go], start[go], t[go], j + 1
                v = self.value[state]
                hit = v >= 0
                a, s = walk[hit], v[hit].astype(np.int64)
                score = best[i, a] + self.scores[s]
                better = score > best[j, a]
                a = a[better]
                best[j, a], back[j, a], via[j, a] = score[better], i, s[better]
                single[start[hit]] |= char[start[hit]] == j
                on = lengths[walk] > j
                walk, start, state = walk[on], start[on], state[on]
            u, to = w[~single], char[~single]
            score = best[i, u] + self.unknown
            better = score > best[to, u]
            u, to = u[better], to[better]
            best[to, u], back[to, u], via[to, u] = score[better], i, -1
        # back along the best paths; the last piece comes first
        at, live, steps = lengths.copy(), np.flatnonzero(lengths > 0), []
        while len(live):
            p, frm = via[at[live], live].astype(np.int64), back[at[live], live].astype(np.int64)
            known = p >= 0
            steps.append((live[known], at[live[known]], p[known]))
            for x in range(4):  # bytes of a character without a piece
                y = live[~known]
                y = y[frm[~known] + x < at[y]]
                pos = back[at[y], y].astype(np.int64) + x
                steps.append((y, pos + 1, self.byte_ids[data[pos, y]]))
            at[live] = frm
            live = live[frm > 0]
        if not steps:
            return np.zeros(n + 1, np.int64), np.empty(0, np.int64)
        word, pos, ids = (np.concatenate(x) for x in zip(*steps, strict=True))
        word = order[word]
        o = np.lexsort((pos, word))
        return np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))]), ids[o]

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of marked words of any length."""
        short = np.array([len(w) <= LONG for w in words], bool)
        near = [w for w, s in zip(words, short, strict=True) if s]
        parts = [self.many(near[i : i + TOGETHER]) for i in range(0, max(len(near), 1), TOGETHER)]
        ends = np.cumsum([0, *(len(x) for _, x in parts)])
        offsets, ids = np.concatenate([parts[0][0][:1], *(at[1:] + e for (at, _), e in zip(parts, ends, strict=False))]), np.concatenate([x for _, x in parts])
        if short.all():
            return offsets, ids
        rest = [self.one(w) for w, s in zip(words, short, strict=True) if not s]
        sizes, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        sizes[short], starts[short] = np.diff(offsets), offsets[:-1]
        sizes[~short] = [len(r) for r in rest]
        starts[~short] = len(ids) + np.cumsum(sizes[~short]) - sizes[~short]
        ids = np.concatenate([ids, *[np.array(r, np.int64) for r in rest]])
        return np.concatenate([[0], np.cumsum(sizes)]), ids[C.ragged(starts, sizes)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of whole texts."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        full = pc.greater(pc.binary_length(texts), 0)
        # runs of blanks belong to one word; such texts are cut in Python
        odd = pc.or_(pc.match_substring(texts, "  "), pc.ends_with(texts, " "))
        odd = pc.or_(odd, pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        offsets, flat = parts.offsets.to_numpy().astype(np.int64), parts.flatten()
        if odd.any() or not pc.all(full).as_py():
            lists = [(flat.slice(s, n).to_pylist() if not o else _marked(t)) if f else [] for t, f, o, s, n in zip(texts.to_pylist(), full.to_pylist(), odd, offsets[:-1], np.diff(offsets), strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            flat = pa.array([w for x in lists for w in x], pa.string())
        coded = flat.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at, ids = self.words([(MARK + w.replace(" ", MARK)).encode() for w in coded.dictionary.to_pylist()])
        sizes = np.diff(at)[code]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return total[offsets], ids[C.ragged(at[:-1][code], sizes)]

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        sizes = np.diff(self.starts)[ids]
        data = self.data[C.ragged(self.starts[:-1][ids], sizes)].tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        return [data[s + (data[s : s + 1] == b" ") : e].decode("utf-8", "replace") for s, e in zip(at[:-1], at[1:], strict=True)]


def _char_bytes(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


def _marked(text: str) -> list[str]:
    """Words of a text with runs of blanks; each keeps the blanks before it but one."""
    return [w[1:] for w in re.findall(" +[^ ]*", " " + text)]


# ---- Spark -------------------------------------------------------------------------------------


def load_model(path: str) -> Model:
    check_normalizer(path)
    return Model.from_pieces(load_pieces(path))


def _encoder(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in C.slices(batches):
            texts = pc.fill_null(batch.column("text"), "")
            offsets, ids = m.encode(texts)
            decoded = m.decode(offsets, ids)
            raw = ids.astype("<u4")
            plain = pc.replace_substring(texts, MARK, " ").to_pylist()
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array(C.segment_sums(np.isin(ids, m.byte_ids), offsets)),
                    pa.array([C.crc32(raw[s:e].tobytes()) for s, e in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64()),
                    pa.array([C.crc32(d.encode()) for d in decoded], pa.int64()),
                    pa.array([d == t for d, t in zip(decoded, plain, strict=True)], pa.bool_()),
                    C.list_array(offsets, ids, pa.int32()),
                ],
                ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "decoded_crc32", "round_trip", "ids"],
            )

    return run


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, ids and what they hold, of every document; round_trip says that decoding gives the text again."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return C.doc_texts(docs).mapInArrow(_encoder(shared), "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean, ids array<int>")


def decode(tokens: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pc.fill_null(b.column("ids"), pa.scalar([], pa.list_(pa.int32())))
            offsets = ids.offsets.to_numpy().astype(np.int64)
            texts = shared.value.decode(offsets - offsets[0], ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def public_model() -> Model:
    import public_tokenizers

    return load_model(public_tokenizers.path("piece_bpe_32k.model"))


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(C.table(spark, sf_dir, "documents"), public_model()).drop("ids")
