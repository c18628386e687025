import collections
import itertools
import random
import re
import time
import zlib

import duckdb
import numpy as np
import oracle
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gritstone.llm import _common as C
from gritstone.llm import chat_rotation, decontaminate, language_cnn, line_dedup, near_dup, ngram_rules, quality_model, queries, secret_ledger, sentence_pieces, token_store

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    oracle.same(queries.QUERIES[name](spark, SMALL), oracle.connect(SMALL), queries.ORACLE_SQL[name])


def small(table="documents"):
    return duckdb.sql(f"select * from '{SMALL}/{table}.parquet' order by 1").fetchall()


def test_spread_join_equals_a_join(spark, tmp_path):
    rows = [(k, i) for i in range(3000) for k in [None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 700}"]]
    left = C.save(spark.createDataFrame(rows, "k string, i int"), str(tmp_path / "l"))
    right = C.save(left.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top")).filter("k is null or k <> 'k5'"), str(tmp_path / "r"))
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, ["k"], how).collect()))
        for size in (None, "n"):
            got = C.spread_join(left, right, ["k"], how, size)
            assert got.columns == ["k", "i", "n", "top"] and sorted(map(str, got.collect())) == want
    assert C.spread_join(left.limit(0), right, ["k"]).count() == 0


# ---- 1 ----


def test_token_store(spark, odd, none, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = token_store.tokenizer(path)
    token_store.write(odd, str(tmp_path / "t"), path)
    got = token_store.read(spark, str(tmp_path / "t")).orderBy("start").collect()
    want = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    at = 0
    for g, (i, t) in zip(got, want, strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (i, at, len(ids), ids)
        at += len(ids)
    meta = pq.read_metadata(next((tmp_path / "t/tokens").glob("*.parquet"))).row_group(0)
    assert meta.column(4).has_offset_index and "RLE_DICTIONARY" in meta.column(4).encodings and "DELTA_BINARY_PACKED" in meta.column(3).encodings
    token_store.write(none, str(tmp_path / "e"), path)
    assert token_store.read(spark, str(tmp_path / "e")).count() == 0


def test_token_store_digest(spark):
    tok = token_store.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.op1_token_store(spark, SMALL).collect()}
    at = 0
    for r in small():
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]
        assert got[r[0]] == (at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        at += len(ids)


def test_pieces_of_texts_encode_alike():
    tok, rng = token_store.tokenizer(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    texts = ["".join(rng.choice(["a", "B", " ", " ", "\n", "é", " ", "'s", "1", "<|endoftext|>", "　", "\x1c"]) for _ in range(rng.randrange(25))) for _ in range(500)]
    offsets, ids = token_store.encode(pa.array(texts), tok)
    assert [ids[s:e].tolist() for s, e in itertools.pairwise(offsets)] == [[*e.ids, 2] for e in tok.encode_batch(texts, add_special_tokens=False)]


class Counted:
    """A tokenizer that counts the bytes it is given."""

    def __init__(self, tok):
        self.tok, self.sent = tok, 0

    def __getattr__(self, name):
        return getattr(self.tok, name)

    def encode_batch_fast(self, texts, **kw):
        self.sent += sum(len(t.encode()) for t in texts)
        return self.tok.encode_batch_fast(texts, **kw)


def test_words_of_earlier_slices_and_with_signs_are_not_sent_again():
    tok = Counted(token_store.tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
    token_store.encode(pa.array([" ".join(f"w{i}" for i in range(3000))]), tok)
    sent, texts = tok.sent, ["w0 " + " ".join(f"w{i}{s}" for i in range(1, 3000)) for s in ("", ".", ",", "\nw0")]
    offsets, ids = token_store.encode(pa.array(texts), tok)
    assert tok.sent - sent < 100
    assert [ids[s:e].tolist() for s, e in itertools.pairwise(offsets)] == [[*e.ids, 2] for e in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("known", [0, 7, 200, 200_000])
def test_pieces_of_odd_texts_encode_alike_whatever_is_remembered(monkeypatch, known):
    monkeypatch.setattr(token_store, "KNOWN", known)
    tok, rng = Counted(token_store.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))), random.Random(known)
    parts = [*" \n\n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u180e\u2000\u2009\u200a\u200b\u2028\u202f\u205f\u3000\x00\x7f", *"   aZ09é÷×ßñ²½Ωж中😀´«—“.,;'’-_<|>", "'s", "'LL", "'re", "e\u0301", "<|endoftext|>", "<|endoftext", "x" * 80, "word", " the", "\nThe", "\x7fa", ". "]
    for _ in range(12):
        texts = ["".join(rng.choices(parts, k=rng.choice((0, 1, 2, 5, 30)))) for _ in range(400)]
        offsets, ids = token_store.encode(pa.array([None, *texts, ""]).slice(1, 400), tok)
        assert [ids[s:e].tolist() for s, e in itertools.pairwise(offsets)] == [[*e.ids, 2] for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert len(token_store._loaded["known", id(tok)].place) <= known


# ---- 2 ----


def test_ledger_scans_only_what_is_new(spark, odd, none, tmp_path):
    at = str(tmp_path / "ledger")
    secret_ledger.scan(none, at)
    versions = secret_ledger.scan(odd, at)
    before = spark.read.parquet(at).count()
    found = secret_ledger.digest(secret_ledger.by_path(versions, secret_ledger.findings(spark, at))).filter("doc_id = 11").first()
    assert (found.n_assign, found.n_access, found.n_hex) == (1, 1, 1) and found.spans == "assign:0:31,hex:9:31,access:33:53"
    secret_ledger.scan(odd, at)
    assert spark.read.parquet(at).count() == before
    newer = tuple(r if r.kind != "hex" else secret_ledger.Rule("hex", 2, r.pattern, 0, 30, r.gate) for r in secret_ledger.RULES)
    versions = secret_ledger.scan(odd, at, newer)
    assert {tuple(r.rules) for r in spark.read.parquet(at).collect()} >= {("hex@2",)}
    assert secret_ledger.digest(secret_ledger.by_path(versions, secret_ledger.findings(spark, at, newer)), newer).filter("doc_id = 11").first().n_hex == 0
    assert versions.count() == odd.count()


# ---- 3 ----


def components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            label[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_duplicates_of_edited_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(160):
        words = list(base) if i % 4 else [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, width, percent).collect()}
        assert got == components(rows, width, percent)


def test_near_duplicates_of_odd_rows(odd, none):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dup.near_duplicates(odd, 3, 85).collect()}
    assert got[1, 0] == (1, True) and got[5, 4] == (4, False) and got[4, 4] == (4, True) and got[6, 1] == (6, True) and got[None, 4] == (None, True)
    assert near_dup.near_duplicates(none, 3, 85).count() == 0


def test_near_duplicates_at_low_similarity(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(w if rng.random() > 0.12 else f"x{rng.randrange(999)}" for w in base)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, 3, 40).collect()}
    assert got == components(rows, 3, 40) and len({c for _, c in got.values()}) < 30
    with pytest.raises(ValueError):
        near_dup.side_for(2)


def test_near_duplicates_leave_lone_shingles_and_shuffle_files_behind(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(300)]
    rows = [(5 * i + k, " ".join(w if rng.random() > 0.01 * k else f"x{rng.randrange(10**6)}" for w in t.split())) for i, t in enumerate(texts) for k in range(1 + 4 * (i % 2))]
    docs = C.save(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "d"))
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in str(disk.getAllFiles().mkString(" ")).split() if "/shuffle_" in f}
    setting, before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"), files()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, 3, 85).collect()}
    assert got == components(rows, 3, 85)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    for _ in range(50):  # files go in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left


def test_near_duplicates_tell_texts_of_one_id_apart(spark):
    a, b = "one two three four five six seven eight nine ten", "quite another text of ten words that stands here alone"
    docs = spark.createDataFrame([(1, a, 7), (5, a, 7), (5, b, 7), (5, b + " too", 7), (None, a, 7), (9, None, 7)], "doc_id long, text string, __gone_id int")
    rows = near_dup.near_duplicates(docs, 3, 80).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (9, 9, True)]
    assert sum(r.stays for r in rows) == 4
    left = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    texts = [(r.doc_id, r.text) for r in left.collect()]
    assert left.columns == docs.columns and len(texts) == 4 and (1, a) in texts and (None, a) in texts and sum(i == 5 for i, _ in texts) == 1


# ---- 4 and 5 ----


def plain_rows(text):
    """Words by plain loops, and the table row of each."""
    kind = lambda b: 0 if b in b" \t\v\f\r" else 3 if b == 10 else 1 if b > 127 or chr(b).isalpha() else 2 if chr(b).isdigit() else 4
    words, data = [], text.encode()
    for i, b in enumerate(data):
        k = kind(b)
        if i and k == kind(data[i - 1]) and k != 3 and (k != 4 or b == data[i - 1]):
            words[-1][1].append(b)
        else:
            words.append((k, [b]))
    out, m = [], 0x9E3779B97F4A7C15
    for k, w in words:
        if k:
            h = sum((b + 1) * pow(m, min(j, 4095) + 1, 1 << 64) for j, b in enumerate(w[:1] if k == 4 else w)) % (1 << 64)
            h = int(C.mix(np.array([h], np.uint64))[0])
            out.append((k, 1 + (h >> 40) % (quality_model.ROWS - 1)))
    rows = [r for _, r in out]
    return [quality_model.AGAIN if k == 1 and any(j >= 0 and rows[j] == r for j in range(i - quality_model.RECENT, i)) else r for i, (k, r) in enumerate(out)]


def test_quality_equals_plain_loops(spark):
    texts = [r[1][:1500] for r in small()[:30]] + ["", "aa aa!! 12,,\n\n bé bé", "x" * 5000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    place, sign = quality_model.index_vectors()
    sums = np.zeros((quality_model.ROWS, quality_model.DIMS))
    for t in texts:
        rows = plain_rows(t)
        for i, r in enumerate(rows):
            for j in range(max(i - quality_model.REACH, 0), min(i + quality_model.REACH + 1, len(rows))):
                if j != i:
                    for k in range(quality_model.NONZERO):
                        sums[r, place[rows[j], k]] += sign[rows[j], k]
    vectors = quality_model.context_vectors(docs)
    assert np.allclose(vectors, sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9), atol=1e-6)
    rng = np.random.default_rng(3)
    net = quality_model.Net(rng.normal(size=64), rng.uniform(1, 2, 64), rng.normal(size=(64, 3)), rng.normal(size=3), rng.normal(size=3), 0.25, 1.7)
    for r in quality_model.score(docs, (vectors, net)).collect():
        rows = plain_rows(texts[r.doc_id])
        x = [float(np.mean([vectors[w][d] for w in rows])) if rows else 0.0 for d in range(64)]
        hidden = [np.tanh(sum((x[d] - net.mean[d]) / net.scale[d] * net.w1[d, h] for d in range(64)) + net.b1[h]) for h in range(3)]
        want = 1 / (1 + np.exp(-(sum(v * w for v, w in zip(hidden, net.w2, strict=True)) + 0.25) / 1.7))
        assert abs(r.score - want) < 1e-5 and r.predicted == int(r.score >= 0.5)


def test_quality_sample_is_one_text_a_label(spark):
    docs = spark.createDataFrame([(4, f"text number {i}") for i in range(500)] + [(9, "other"), (0, "both labels")], "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1), (4, 1), (9, 0), (0, 0), (0, 1)], "doc_id long, quality int")
    vectors, net = quality_model.fit(docs, labels)
    assert vectors.shape == (quality_model.ROWS, quality_model.DIMS) and np.isfinite(net.score(np.zeros((1, 64)))).all()


def test_language_equals_plain_loops(spark):
    langs, rng = ["a", "b", "c"], np.random.default_rng(4)
    net = language_cnn.Net(langs, rng)
    for b in net.bias:
        b += rng.normal(0, 0.1, b.shape).astype(np.float32)
    texts = ["kurz und gut", "", "123 456", "é" * 200, "word " * 120]

    def plain(t):
        data, total, weight = t.encode(), np.zeros(3), 0
        for s in range(0, len(data), language_cnn.WINDOW):
            window = data[s : s + language_cnn.WINDOW].ljust(language_cnn.WINDOW, b"\0")
            padded = window + b"\0" * (max(language_cnn.WIDTHS) - 1)
            hidden = []
            for w, f, bias in zip(language_cnn.WIDTHS, net.filters, net.bias, strict=True):
                best = np.max([np.concatenate([net.embed[b] for b in padded[i : i + w]]) @ f for i in range(language_cnn.WINDOW)], axis=0)
                hidden.extend(np.maximum(best + bias, 0))
            z = np.array(hidden) @ net.out + net.out_bias
            letters = sum(b > 127 or chr(b).isalpha() for b in window)
            total, weight = total + letters * (z - z.max() - np.log(np.exp(z - z.max()).sum())), weight + letters
        p = np.exp(total / max(weight, 1))
        return p / p.sum()

    got, score = language_cnn.predict_batch(pa.array(texts), net)
    for t, g, x in zip(texts, got, score, strict=True):
        if not any(c.isalpha() for c in t):
            assert (g, x) == ("und", 0)
        else:
            assert g == langs[plain(t).argmax()] and abs(x - plain(t).max()) < 1e-4


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in quality_model.op4_quality(spark, d).collect()}
    labels = [(i, q) for i, q in duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet'").fetchall() if rows[i].held_out]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in labels)
    assert np.mean([rows[i].predicted == q for i, q in labels]) > 0.95


def test_quality_of_odd_rows(spark, odd, none):
    model = quality_model.fit(odd, spark.createDataFrame([(4, 1), (9, 0), (1, None), (None, 1)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in quality_model.score(odd, model).collect())
    assert quality_model.score(none, model).count() == 0
    assert quality_model.good(odd, model).columns == odd.columns
    empty = quality_model.fit(none, none.select("doc_id", F.lit(1).alias("quality")))
    assert {r.score for r in quality_model.score(odd, empty).collect()} == {0.5}


def test_language_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    lang = dict(duckdb.sql(f"select doc_id, lang from '{d}/documents.parquet'").fetchall())
    rows = [r for r in language_cnn.op5_language(spark, d).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.95


def test_language_of_odd_rows(odd, none):
    net = language_cnn.fit(odd)
    got = {r.doc_id: r for r in language_cnn.predict(odd, net).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[8].lang_pred != "und"
    assert language_cnn.fit(none) is None and language_cnn.predict(none, None).count() == 0
    assert {r.lang_pred for r in language_cnn.predict(odd, None).collect()} == {"und"}


def test_cnn_gradients():
    rng = np.random.default_rng(1)
    net = language_cnn.Net(["a", "b"], rng)
    x, y, w = rng.integers(1, 256, (3, language_cnn.WINDOW)).astype(np.uint8), np.array([0, 1, 1]), np.ones(3, np.float32)
    loss = lambda: -net.log_probs(x)[np.arange(3), y].astype(np.float64).mean()
    grads = net.gradients(x, y, w)
    for weight, g in zip(net.weights(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was = weight[at]
        weight[at] = was + 1e-2
        up = loss()
        weight[at] = was - 1e-2
        down = loss()
        weight[at] = was
        assert abs((up - down) / 2e-2 - g[at]) < 0.1 * abs(g[at]) + 2e-3


# ---- 6 ----


def test_base_counts():
    texts = ["a b c a b c x", "", None, "l1\nl1\n \n \nl1", "é $$ | é", "a a a a"]
    got = ngram_rules.base_counts(pa.array(texts))
    assert got["n_words"].tolist() == [7, 0, 0, 3, 4, 4] and got["n_repeat_words"].tolist() == [6, 0, 0, 0, 0, 4]
    assert got["n_dup_lines"].tolist() == [0, 0, 0, 2, 0, 0] and got["word_chars"].tolist() == [7, 0, 0, 6, 5, 4] and got["n_symbols"].tolist() == [0, 0, 0, 0, 3, 0]


def kneser_ney(train, texts, order):
    """Plain dictionaries; log-perplexity of each text's characters under a model of train."""
    counts = {order: collections.Counter()}
    pad = lambda t: chr(ngram_rules.BOS) * (order - 1) + re.sub(r"[\t-\r]", " ", re.sub(r"[0-9]", "0", t))
    for t in map(pad, train):
        counts[order].update(t[i : i + order] for i in range(len(t) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    parts = {}
    for k in counts:
        n = [sum(c == j for c in counts[k].values()) for j in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        d = [j - (j + 1) * y * n[j] / n[j - 1] if n[j - 1] and n[0] else -1 for j in (1, 2, 3)]
        d = [x if 0 < x < j else j / 2 for j, x in zip((1, 2, 3), d, strict=True)]
        total, taken = collections.Counter(), collections.Counter()
        for g, c in counts[k].items():
            total[g[:-1]] += c
            taken[g[:-1]] += d[min(c, 3) - 1]
        parts[k] = (d, total, taken)

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        d, total, taken = parts[len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        c = counts[len(g)][g]
        return ((c - d[min(c, 3) - 1]) if c else 0) / total[g[:-1]] + taken[g[:-1]] / total[g[:-1]] * p(g[1:])

    return [-np.mean([np.log(p(t[i : i + order])) for i in range(len(t) - order + 1)]) if len(t) >= order else None for t in map(pad, texts)]


def base_passes(text):
    words = WORD.findall(text)
    seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words) >= 50 and 100 * len(again) <= 50 * len(words)


def test_perplexity_equals_plain_model(spark):
    rows = [(r[0], r[1]) for r in small() if r[2] == "fr"]
    docs = spark.createDataFrame([(i, t, "fr") for i, t in rows], "doc_id long, text string, lang string")
    half, want = dict(zip([i for i, _ in rows], ngram_rules.halves(pa.array([t for _, t in rows])).tolist(), strict=True)), {}
    for h in (0, 1):
        mine = [(i, t) for i, t in rows if half[i] == h]
        want |= dict(zip([i for i, _ in mine], kneser_ney([t for i, t in rows if half[i] != h and base_passes(t)], [t for _, t in mine], 4), strict=True))
    texts = dict(rows)
    for limit in (10**9, 0):
        got = ngram_rules.quality_rules(docs, broadcast_rows=limit).collect()
        for r in got:
            assert abs(r.log_ppl - want[r.doc_id]) < 1e-5 and r.base_failed != base_passes(texts[r.doc_id])
        assert {r.doc_id: r.kept for r in got} == inside_bands([(r.doc_id, "fr", r.n_words, r.log_ppl, r.base_failed) for r in got])


def inside_bands(rows):
    """kept by plain sorting."""
    middle = lambda v: sorted(v)[-(-len(v) // 2) - 1]

    groups = collections.defaultdict(list)
    for _, lang, n, x, failed in rows:
        if not failed:
            groups[lang, n.bit_length()].append((x, n))
            groups[lang].append((x, n))
    out = {}
    for i, lang, n, x, failed in rows:
        out[i] = False
        if not failed:
            own = groups[lang, n.bit_length()]
            own = own if (enough := len(own) >= ngram_rules.CLASS_LEAST) else groups[lang]
            m = middle([v for v, _ in own])
            mad = middle([abs(v - m) for v, _ in own])
            if not enough:
                mad = max(mad, middle([abs(v - m) * 2 ** ((k.bit_length() - 1) / 2) for v, k in own]) / 2 ** ((n.bit_length() - 1) / 2))
            out[i] = abs(x - m) <= max(1.4826 * ngram_rules.DEVIATIONS * mad, ngram_rules.LEAST_WIDTH)
    return out


def test_bands_reject_junk_and_keep_the_rest(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in ngram_rules.op6_ngram_rules(spark, d).collect()}
    lang = dict(duckdb.sql(f"select doc_id, lang from '{d}/documents.parquet'").fetchall())
    assert {i: r.kept for i, r in rows.items()} == inside_bands([(i, lang[i], r.n_words, r.log_ppl, r.base_failed) for i, r in rows.items()])
    gone = {q: [not rows[i].kept for i, x in duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet'").fetchall() if x == q and not rows[i].base_failed] for q in (0, 1)}
    assert np.mean(gone[0]) > 0.3 and np.mean(gone[1]) < 0.03


def test_rules_of_odd_rows(odd, none):
    for limit in (10**9, 0):
        got = ngram_rules.quality_rules(odd, broadcast_rows=limit).collect()
        assert len(got) == odd.count() and not any(r.kept for r in got if r.n_words < 50)
        assert ngram_rules.quality_rules(none, broadcast_rows=limit).count() == 0


# ---- 7 ----


def viterbi(model, vocabulary, text):
    data = (sentence_pieces.MARK + text.replace(" ", sentence_pieces.MARK)).encode() if text else b""
    best = [(0.0, [])] + [None] * len(data)
    for i in range(len(data)):
        if best[i] is None:
            continue
        char, single = i + sentence_pieces._char_bytes(data[i]), False
        for j in range(i + 1, min(len(data), i + 64) + 1):
            v = vocabulary.get(data[i:j])
            if v is not None:
                single |= j == char
                if best[j] is None or best[i][0] + model.scores[v] > best[j][0]:
                    best[j] = (best[i][0] + model.scores[v], best[i][1] + [v])
        if not single and (best[char] is None or best[i][0] + model.unknown > best[char][0]):
            best[char] = (best[i][0] + model.unknown, best[i][1] + [int(model.byte_ids[b]) for b in data[i:char]])
    return best[-1][1]


def test_sentence_pieces(odd, none):
    loaded = sentence_pieces.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentence_pieces.Model.from_pieces(loaded)
    vocabulary = {p.encode(): i for i, (p, _, t) in enumerate(loaded) if t == sentence_pieces.NORMAL}
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "th", "er", " ", "  ", "\n", "é", "▁", "日本", "😀", "\x00"]) for _ in range(rng.randrange(25))) for _ in range(400)] + [r[1][:3000] for r in small()[:20]]
    offsets, ids = model.encode(pa.array(texts))
    assert [ids[s:e].tolist() for s, e in itertools.pairwise(offsets)] == [viterbi(model, vocabulary, t) for t in texts]
    tokens = sentence_pieces.encode(odd, model)
    assert all(r.round_trip for r in tokens.collect()) and sentence_pieces.encode(none, model).count() == 0
    for r in tokens.filter("doc_id in (2, 8, 11)").collect():
        text = next(x.text for x in odd.collect() if x.doc_id == r.doc_id)
        ids = viterbi(model, vocabulary, text)
        assert (r.n_tokens, r.ids) == (len(ids), ids) and r.n_byte_tokens == sum(loaded[i][2] == sentence_pieces.BYTE for i in ids)
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)) and r.decoded_crc32 == zlib.crc32(text.replace("▁", " ").encode())
    back = {r.doc_id: r.text for r in sentence_pieces.decode(tokens, model).collect()}
    assert back[1] == "" and back[8] == "日本語 テキスト   x  y"


def test_model_files_that_ask_for_more_are_refused(tmp_path):
    for n, fields in enumerate((b"\x1a\x02\x20\x01", b"\x1a\x04\x18\x00\x20\x00", b"\x1a\x05\x12\x01x\x20\x00", b"\x12\x03\xc0\x01\x01\x1a\x02\x20\x00", b"")):
        (tmp_path / str(n)).write_bytes(fields)
        with pytest.raises(ValueError):
            sentence_pieces.check_normalizer(str(tmp_path / str(n)))
    sentence_pieces.check_normalizer(public_tokenizers.path("piece_bpe_32k.model"))


# ---- 8 ----


def test_rotation(spark):
    rows = [(1, 0, "Ann", "hi"), (1, 1, "Bob|>", "yo <|end|>"), (1, 2, "Ann", None), (1, None, None, "x"), (None, 0, "A", "t"), (1, 2, "Ann", None)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.speaker, r.block): r for r in chat_rotation.rotate(conv).collect()}
    assert got[1, "Bob|>", 0].text == "<|user name=Ann|>\nhi<|end|>\n<|assistant|>\nyo < |end|><|end|>\n<|user name=Ann|>\n<|end|>\n<|user name=Ann|>\n<|end|>\n"
    r = got[1, "Ann", 0]
    assert [r.text[m.start : m.end] for m in r.mask] == ["hi<|end|>\n", "<|end|>\n", "<|end|>\n"]
    assert got[1, "Ann", -1].text == "<|user|>\nx<|end|>\n" and (None, "A", 0) in got
    parts = chat_rotation.rotate(spark.createDataFrame([(1, 0, "u", "t")] * 7, "conv_id long, turn long, role string, text string"), piece=3).collect()
    assert sorted(p.n_turns for p in parts) == [1, 3, 3]
    assert chat_rotation.rotate(conv.limit(0)).count() == 0


def test_rotation_of_odd_conversations(spark):
    long = "tok " * 40_000
    rows = [(1, 300 * i, "A|b" if i % 2 else "A b", f"t{i}", "s", 0) for i in range(700)] + [(2, 5, "x", long, "s", 0), (2, 9, "%", None, "s", 0), (3, 1, None, "only", "s", 0)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, speaker string, piece int")
    got = {(r.conv_id, r.speaker, r.piece): r for r in chat_rotation.rotate(conv.repartition(7)).collect()}
    assert sorted(got) == sorted([(1, s, p) for s in ("A b", "A|b") for p in range(3)] + [(2, "%", 0), (2, "x", 0)])
    r = got[1, "A b", 1]
    assert (r.n_turns, r.n_own_turns) == (256, 128) and r.text.startswith("<|assistant|>\nt256<|end|>\n<|user name=A%7Cb|>\nt257<|end|>\n")
    assert [r.text[m.start : m.end] for m in r.mask] == [f"t{i}<|end|>\n" for i in range(256, 512, 2)]
    assert "<|user name=A%20b|>" in got[1, "A|b", 2].text and got[1, "A|b", 2].n_turns == 188
    assert got[2, "x", 0].text == f"<|assistant|>\n{long}<|end|>\n<|user name=%25|>\n<|end|>\n" and got[2, "%", 0].mask[0].start == len("<|user name=x|>\n") + len(long) + len("<|end|>\n<|assistant|>\n")


# ---- 9 ----


PUNCT = ".,;:!?\"'()[]{}<>|*#&~`_=“”‘’«»…-–—"


def plain_kinds(text):
    """(kind, word without case) of each word: N number, Q quantity, U unit after a number, C capitalised, - other."""
    out = []
    for w in WORD.findall(text):
        core = w.strip(PUNCT) or w
        low = core.lower()
        if re.fullmatch(r"[+-]?[$€£]?[0-9][0-9.,:/]*(%|st|nd|rd|th)?", low):
            kind = "N"
        elif (m := re.fullmatch(r"[0-9][0-9.,]*([a-z]+)", low)) and m[1] in decontaminate.UNITS:
            kind = "Q"
        elif low in decontaminate.UNITS:
            kind = "U" if out and out[-1][0] == "N" else "-"
        else:
            kind = "C" if core[:1].isupper() else "-"
        out.append((kind, low))
    return out


def held_items(docs, items, width=8):
    """(doc, item): n_hits, by comparing every window with every window."""
    out = {}
    for (i, t), (j, b) in itertools.product(docs, items):
        a, b = plain_kinds(t), plain_kinds(b)
        n = min(width, len(b))
        if len(b) < 2 or len(a) < n:
            continue
        by_shift = collections.defaultdict(lambda: ([], [], set()))
        template = lambda w, slots: tuple(k if k in slots else v for k, v in w)
        for p, q in itertools.product(range(len(b) - n + 1), range(len(a) - n + 1)):
            x, y = b[p : p + n], a[q : q + n]
            changed, same, pairs = by_shift[q - p]
            if [v for _, v in x] == [v for _, v in y]:
                same.append(p)
            for slots in ("NQUC", "NQU"):
                plain = lambda w: sum(k not in slots for k, _ in w)  # noqa: E731, B023
                if template(x, slots) == template(y, slots) and plain(x) >= min(4, n) and plain(y) >= min(4, n) and (slots == "NQUC" or any(k in slots for k, _ in x)):
                    changed.append(p)
                    pairs |= {(v, u) for (k, v), (_, u) in zip(x, y, strict=True) if k in slots}
                    if all(v == u for (k, v), (_, u) in zip(x, y, strict=True) if k in slots):
                        same.append(p)
        hit = set()
        for changed, same, pairs in by_shift.values():
            one = len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})
            hit |= set(changed) | set(same) if one else set(same)
        windows = len(b) - n + 1
        if len(hit) >= min(-(-windows // 2), 6):
            out[i, j] = len(hit)
    return out


def test_decontamination_equals_plain_comparison(spark):
    rng, words = random.Random(4), ["Anna", "ran", "to", "the", "mill", "with", "12", "3.5", "kg", "of", "Flour", "and", "5kg", "seven", "in", "a", "second", "Haus", "geht", "am", "Montag", "7", "mm"]
    items = [(j, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 14, 25])))) for j in range(24)]
    docs = []
    for i in range(60):
        _, item = rng.choice(items)
        changed = [{"Anna": "Olga", "12": "19", "3.5": "8"}.get(w, w) if i % 3 else w for w in item.split()]
        if i % 5 == 0 and changed:
            changed[rng.randrange(len(changed))] = rng.choice(words)
        docs.append((i, " ".join([*(rng.choice(words) for _ in range(rng.randrange(6))), *changed, *(rng.choice(words) for _ in range(rng.randrange(6)))])))
    docs += [(100 + r[0], r[1][:3000]) for r in small()[:25]]
    items += [(100 + r[0], r[1]) for r in small("benchmark")[:6]]
    first = {}  # items of the same words are one
    for j, b in items:
        first.setdefault(b, j)
    want = held_items(docs, [(j, b) for b, j in first.items()])
    for limit in (10**6, 0):
        rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_hashes=limit).collect()
        assert {(r.doc_id, r.item_id): r.n_hits for r in rows} == want and len(want) >= 40


def test_decontamination_of_short_items_units_and_nouns(spark):
    german = "Die Bäckerin verkauft am Morgen {n} Brote und am Abend {k} Brötchen an die Kinder aus der Stadt"
    bench = spark.createDataFrame([(1, "who wrote hamlet"), (2, "paid in a second one by one"), (3, german.format(n=12, k=30))], "item_id long, text string")
    rows = [(1, "Well, who wrote Hamlet? Nobody knows"), (1, "a clean text"), (2, "who wrote it"), (3, "paid c m second one by one"), (4, german.format(n=7, k=55)), (None, "so who wrote hamlet"), (5, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, __gone_row int")
    assert sorted((r.doc_id, r.item_id, r.reparameterised) for r in decontaminate.contaminated(docs, bench).collect()) == [(1, 1, False), (4, 3, True)]
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(1, "a clean text"), (2, "who wrote it"), (3, rows[3][1]), (5, None)], key=lambda x: x[0])


def test_decontamination_counts_equal_windows_beside_changed_ones(spark):
    item = "Tom met Mary near the old mill and Tom gave Mary the key of the house by the river which was closed since the flood of last year had come up to its door"
    text = item.replace("and Tom", "and Bob")  # one of two occurrences is edited
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [r.item_id for r in decontaminate.contaminated(docs, bench).collect()] == [7]


def test_decontamination(spark, odd, none):
    story = "{a} had {n} apples and gave {k} kg of them to {b} before the sun went down on the farm near the hills"
    bench = spark.createDataFrame([(7, story.format(a="Tom", b="Mary", n=12, k=5)), (8, None), (None, "x y z v w"), (9, "Tom")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + story.format(a="Tom", b="Mary", n=12, k=5)), (2, story.format(a="Bob", b="Sue", n=99, k=3)), (3, story.format(a="Bob", b="Bob", n=99, k=99)), (4, "the sun went down"), (None, "x"), (5, None)], "doc_id long, text string")
    for limit in (10**6, 0):
        got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contaminated(docs, bench, broadcast_hashes=limit).collect()}
        assert got == {(1, 7): False, (2, 7): True}
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0 and decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.clean(docs, bench).count() == 4


def test_decontamination_of_other_case(spark):
    item = "When Tom met Mary in London they walked to Hyde Park and fed the ducks. Then Mary told Tom that Paris was far nicer in May"
    docs = spark.createDataFrame([(1, item.upper()), (2, item.lower()), (3, "so " + item), (4, "QUITE ANOTHER TEXT IN CAPITALS THAT HAS AS MANY WORDS AS THE ITEM AND MORE OF THEM TO COME AT THE END OF IT")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    for limit in (10**6, 0):
        rows = decontaminate.contaminated(docs, bench, broadcast_hashes=limit).collect()
        assert sorted((r.doc_id, r.item_id, r.coverage, r.reparameterised) for r in rows) == [(i, 7, 1.0, False) for i in (1, 2, 3)]


def test_decontamination_finds_planted_items(spark):
    d = "/root/testdata/sf0.01"
    want = set(duckdb.sql(f"select doc_id, item_id from '{d}/documents.parquet' d join '{d}/benchmark.parquet' b on contains(d.text, b.text)").fetchall())
    assert {(r.doc_id, r.item_id) for r in decontaminate.op9_decontaminate(spark, d).collect()} == want


# ---- 10 ----


def without_repeats(rows):
    """Every later occurrence of two lines with words (and the blank ones between), or of one line of 50 words, goes."""
    first, out = {}, {}
    for i, t in sorted(set(rows)):
        lines, gone = t.split("\n"), set()
        full = [k for k, x in enumerate(lines) if WORD.search(x)]
        for s, e in sorted([*itertools.pairwise(full), *((k, k) for k in full if len(WORD.findall(lines[k])) >= 50)]):
            if first.setdefault("\n".join(lines[s : e + 1]), (i, s, e)) != (i, s, e):
                gone |= set(range(s, e + 1))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(spark, odd, none):
    rows = [(r[0], r[1]) for r in small()]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == without_repeats(rows)
    rows = line_dedup.dedup(odd).collect()
    assert len(rows) == odd.count() and [r.text for r in rows if r.doc_id is None] == ["a b c d e f"] and [r.text for r in rows if r.doc_id == 1] == [None]
    assert line_dedup.dedup(none).count() == 0


def test_line_dedup_takes_whole_passages_whatever_stands_beside(spark):
    rng = random.Random(7)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [[line(60)] for _ in range(10)] + [[line(rng.randrange(3, 20)) for _ in range(rng.randrange(5, 9))] + [line(45)] for _ in range(10)] + [[line(55), "", line(52), line(7)] for _ in range(5)]
    rows, own, i = [], {}, 0
    for p in passages:
        for _ in range(3):
            before, after = ([line(rng.randrange(4, 15)) for _ in range(rng.randrange(1, 4))] for _ in range(2))
            rows.append((i, "\n".join([*before, *p, *after])))
            own[i] = "\n".join([*before, *([] if i % 3 else p), *after])
            i += 1
    rows.append((i, "\n".join([line(9), *passages[10][:2], line(9)])))  # two lines under 50 words
    got = {r.doc_id: (r.text, r["__chunks_out"]) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in own} == {k: (t, 1 if k % 3 else 0) for k, t in own.items()}


def test_line_dedup_tells_texts_of_one_id_apart(spark):
    p = "one line of it\nand one more of it"
    rows = [(1, p), (2, p), (2, "keep one\nkeep two\nkeep three\nkeep four"), (None, p), (3, None), (3, ""), (4, "keep one\n \nkeep two"), (5, "single line\n" + p.split("\n")[0]), (6, "\n" + p + "\n"), (6, "\n" + p + "\n")]
    docs = spark.createDataFrame([(i, t, i, "x", 0) for i, t in rows], "doc_id long, text string, row long, gone string, __lines_out int")
    got = line_dedup.dedup(docs)
    assert got.columns == ["doc_id", "text", "row", "gone", "__lines_out", "__chunks_out"]
    assert sorted([(r.doc_id, r.text, r["__lines_out"]) for r in got.collect()], key=str) == sorted([(1, p, 0), (2, "", 2), (2, rows[2][1], 0), (None, p, 0), (3, None, 0), (3, "", 0), (4, rows[6][1], 0), (5, rows[7][1], 0), (6, "\n", 2), (6, "\n", 2)], key=str)


def test_line_dedup_recall(spark):
    """Lines inside runs of two lines with words that stand elsewhere too, first place excepted: none stays."""
    d = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet' where text is not null").fetchall()
    got = {r.doc_id: r.n_lines_removed for r in line_dedup.op10_line_dedup(spark, d).collect()}
    want = {i: t.count("\n") + 1 for i, t in rows}
    for i, t in without_repeats(rows).items():
        want[i] -= t.count("\n") + 1 if t else 0
    assert sum(want.values()) > 1000 and {i: got[i] for i in want if rows} == want


# ---- pipeline ----


def test_pipeline_of_odd_rows(spark, odd, none, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "kept", "n_tokens", F.lit("x").alias("row"), F.lit(0).alias("__gone_id")).union(spark.createDataFrame([(5, "another text of this id\nwith two lines", "en", "s", "k", 0, "x", 0)], "doc_id long, text string, lang string, source string, kept string, n_tokens int, row string, __gone_id int"))
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, docs, SMALL)
        if name == "pieces":
            assert all(r.round_trip for r in left.collect())
            continue
        assert left.columns == docs.columns
        if name != "quality":  # what the classifier keeps is up to its labels
            got = [(r.doc_id, r.text) for r in left.collect()]
            want = [(r.doc_id, r.text) for r in docs.collect()]
            repeated = {"lines": {10}, "near_duplicates": {5}, "decontaminate": set()}[name]
            for i, t in want:
                if i not in repeated:
                    assert got.count((i, t)) == want.count((i, t))
            assert name != "near_duplicates" or [t for i, t in got if i == 5] == ["another text of this id\nwith two lines"]
            assert name != "lines" or [t for i, t in got if i == 10] == ["line one here\nline two here\n"]
        assert stage(spark, none, SMALL).count() == 0
    assert corpus_pipeline.pieces(spark, none, SMALL).count() == 0


def test_pipeline(spark):
    docs, kept = C.table(spark, SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = C.save(stage(spark, docs, SMALL), C.scratch(spark, "test")).cache()
        kept[name] = docs
        if name == "lines":
            texts = without_repeats([(r.doc_id, r.text) for r in before.collect()])
            was = {r.doc_id: r.text for r in before.collect()}
            assert {r.doc_id: r.text for r in docs.collect()} == {i: t for i, t in texts.items() if t.strip(" ") or t == was[i]}
        if name == "near_duplicates":
            labels = components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in labels.items() if c == i}
        if name != "pieces":
            assert docs.columns == before.columns
    assert all(r.round_trip for r in kept["pieces"].collect())
    assert corpus_pipeline.run(spark, SMALL).count() == kept["pieces"].count()
