from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.operators import findings, graph, scan
from gritstone.sources import tables
from gritstone.streaming import state


def test_route_path(spark):
    urls = ["https://a.example/Users/42/?q=1", "/users/:id/", "http://h", "/a/{x}/B#top"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(T.route_path(F.col("u"))).collect()]
    assert got == ["/users/*", "/users/*", "/", "/a/*/b"]


def test_entropy(spark):
    got = spark.createDataFrame([("aabb",), ("abcd",), ("aaaa",)], "t string").select(F.round(T.entropy(F.col("t")), 6)).collect()
    assert [r[0] for r in got] == [1.0, 2.0, 0.0]


def test_wilson(spark):
    lo, hi = T.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(8.0, 10.0), (0.0, 0.0)], "k double, n double").select(F.round(lo, 4), F.round(hi, 4)).collect()
    assert [tuple(r) for r in rows] == [(0.4902, 0.9433), (0.0, 1.0)]


def test_band_join_takes_the_first_offset(spark):
    a = spark.createDataFrame([(1, "f", 10), (2, "f", 20)], "id int, file string, line long")
    b = spark.createDataFrame([(7, "f", 12), (8, "f", 8), (9, "f", 23)], "other int, file string, at long")
    got = findings.band_join(a, b, "file", "line", "at", 2, [F.col("at") - F.col("line")]).select("id", "other").collect()
    assert [tuple(r) for r in got] == [(1, 8)]


def test_taint_marks_sanitizers_and_stops_at_reassignment(spark):
    flows = spark.createDataFrame([("a", "b", False), ("b", "c", True), ("b", "d", False), ("d", "e", False), ("c", "b", False)], "src string, dst string, sanitizer boolean")
    node = lambda *x: spark.createDataFrame([(i,) for i in x], "node string")
    got = graph.taint(flows, node("a"), node("c", "e"), node("d")).collect()
    assert sorted(map(tuple, got)) == [("a", "c", True)]


def test_passages_are_held_whole(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "Short item"), (3, " "), (4, None), (5, "p q r s t u v w")], "item_id long, text string")
    texts = [(10, "x A b c d\ne f g h i j y"), (11, "a b c d e f g h and something else"), (12, "a short item"), (13, "shorter items"), (14, None), (15, "p q r s t u v w"), (None, "one short  item")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {tuple(r) for r in scan.passages_held(docs, items).collect()}
    assert got == {(10, 1), (12, 2), (None, 2), (15, 5)}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (5, 5)], "src long, dst long")
    assert {r.node: r.comp for r in graph.connected(edges).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5}


def test_watch_delta_drops_bursts(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "path string, line long, rule string")
    a, b = rows(("p", 1, "r"), ("q", 1, "r")), rows(("p", 1, "r"), ("z", 1, "r"))
    assert sorted(r.change for r in state.watch_delta(a, b).collect()) == ["added", "fixed"]
    assert state.watch_delta(a, b, most=1).count() == 0


def test_files_and_imports(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os\nfrom json import loads\n")
    (tmp_path / "bad.py").write_text("def (")
    files = tables.files(spark, str(tmp_path))
    assert sorted((r.module) for r in scan.code_imports(files).collect()) == ["json", "os"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("p", 3, "r", "high", "x")], "path string, line int, rule string, severity string, snippet string")
    for kind in ("json", "csv", "parquet", "sarif"):
        tables.write(rows, str(tmp_path / kind), kind)
    assert '"ruleId":"r"' in spark.read.text(str(tmp_path / "sarif")).first()[0]
