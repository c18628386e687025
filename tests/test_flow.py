import json
import random

import pytest
from pyspark.sql import functions as F

from gritstone.functions import scores as S
from gritstone.operators import flow, rules
from gritstone.sources import reports


def solve(nodes, edges, functions):
    """Facts by a plain worklist, one path edge at a time."""
    body, succ = {(n[0], n[1]): n for n in nodes}, {}
    for q, a, b in edges:
        succ.setdefault((q, a), []).append(b)
    start = {q: (e, p) for q, e, p in functions}
    seen, work, summaries, waiting = set(), [], {}, {}

    def put(*edge):
        if edge not in seen:
            seen.add(edge)
            work.append(edge)

    for q, (e, _) in start.items():
        put(q, e, "0", "0")
    while work:
        q, n, entry, fact = work.pop()
        if (q, n) not in body:
            continue
        _, _, kind, target, uses, callee, args, source, _ = body[q, n]
        after = succ.get((q, n), [])

        def back(to, end):
            caller, nodes_, e, f, t = to
            f = t if end == "$ret" else f
            if f is not None:
                for s in nodes_:
                    put(caller, s, e, f)

        if kind == "call" and callee in start:
            given = next((p for p, a in zip(start[callee][1], args or []) if a == fact), "0")
            put(callee, start[callee][0], given, given)
            to = (q, tuple(after), entry, fact, target)
            waiting.setdefault((callee, given), set()).add(to)
            for end in set(summaries.get((callee, given), ())):
                back(to, end)
        if not after:
            ends = summaries.setdefault((q, entry), set())
            if fact not in ends:
                ends.add(fact)
                for to in set(waiting.get((q, entry), ())):
                    back(to, fact)
        out = {fact}
        if kind == "assign":
            out = {f for f in [fact if fact != target else None, target if (source and fact == "0") or fact in (uses or []) else None] if f is not None}
        for s in after:
            for f in out:
                put(q, s, entry, f)
    return seen


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tabulation_equals_a_worklist(spark, seed):
    r, nodes, edges, functions = random.Random(seed), [], [], []
    names = ["a", "b", "c", flow.RETURN]
    for q in ("f", "g", "h"):
        functions.append((q, 0, r.sample(["a", "b"], 2)))
        for n in range(5):
            kind = r.choice(["assign", "call", "other"])
            nodes.append((q, n, kind, r.choice(names), r.sample(names[:3], r.randint(0, 2)), r.choice(["f", "g", "h", "gone", None]), r.sample(names[:3], 2), r.random() < 0.3, r.random() < 0.5))
            edges += [(q, n, m) for m in {n + 1, r.randint(0, 4)} if m < 5 and n < 4]
    ns = spark.createDataFrame(nodes, flow.NODES)
    facts = flow.tabulate(ns, spark.createDataFrame(edges, "qid string, src long, dst long"), spark.createDataFrame(functions, "qid string, entry long, params array<string>"))
    expected = solve(nodes, edges, functions)
    got = [tuple(x) for x in facts.select("qid", "node", "entry", "fact").collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    sinks = {(q, n, f) for q, n, _, f in expected for x in nodes if (x[0], x[1]) == (q, n) and x[8] and f in x[6]}
    assert {tuple(x) for x in flow.tainted_sinks(facts, ns).collect()} == sinks


def test_tabulation_of_nothing(spark):
    args = [spark.createDataFrame([], s) for s in (flow.NODES, "qid string, src long, dst long", "qid string, entry long, params array<string>")]
    assert flow.tabulate(*args).count() == 0


def test_dominators_equal_reachability_without_a_node(spark):
    r, edges = random.Random(5), {}
    for q in range(12):
        edges[f"f{q}"] = {(r.randint(0, 7), r.randint(0, 7)) for _ in range(r.randint(3, 16))}
    rows = spark.createDataFrame([(q, a, b) for q, es in edges.items() for a, b in es], "qid string, src long, dst long")
    got = flow.dominators(rows, spark.createDataFrame([(q, 0) for q in edges], "qid string, entry long")).collect()

    def reached(es, without=None):
        found, open_ = set(), [0] if without != 0 else []
        while open_:
            n = open_.pop()
            if n not in found:
                found.add(n)
                open_ += [b for a, b in es if a == n and b != without]
        return found

    for q, es in edges.items():
        own = {x.node: x for x in got if x.qid == q}
        live = reached(es)
        assert set(own) == live
        dom = {n: {d for d in live if d == n or n not in reached(es, d)} for n in live}
        for n in live:
            strict = dom[n] - {n}
            assert own[n].idom == next((d for d in strict if dom[d] == strict), None)
            frontier = {w for w in live if any(a in live and b == w and n in dom[a] for a, b in es) and (n == w or n not in dom[w])}
            assert own[n].frontier == sorted(frontier)


def test_aliases_through_fields(spark):
    copies = spark.createDataFrame([("a", "b"), ("x", "x")], "src string, dst string")
    fields = spark.createDataFrame([("a", "f", "c"), ("b", "f", "d"), ("c", "g", "e"), ("d", "g", "h"), ("x", "f", "y")], "base string, field string, name string")
    comp = {r.node: r.comp for r in flow.alias_classes(copies, fields).collect()}
    assert comp["a"] == comp["b"] and comp["c"] == comp["d"] and comp["e"] == comp["h"] and len(set(comp.values())) == 5


def test_calls_dead_code_and_relevance(spark):
    functions = spark.createDataFrame([("p", "run", "p.run", True), ("q", "run", "q.run", True), ("q", "one", "q.one", True), ("e", "main", "e.main", True)], "file string, name string, qid string, exported boolean")
    calls = spark.createDataFrame([("p", "p.x", "run"), ("z", "z.x", "run"), ("z", "z.x", "one"), ("z", "z.x", "none")], "file string, caller string, name string")
    resolved = flow.resolve_calls(calls, functions)
    assert {(r.file, r.name): r.callee for r in resolved.collect()} == {("p", "run"): "p.run", ("z", "run"): None, ("z", "one"): "q.one", ("z", "none"): None}
    assert [r.qid for r in flow.dead_functions(functions, resolved, spark.createDataFrame([("e",)], "file string")).collect()] == ["q.run"]
    imports = lambda *x: spark.createDataFrame(list(x), "src string, dst string")
    files, entries = spark.createDataFrame([(f,) for f in "emqz"], "file string"), spark.createDataFrame([("e",)], "file string")
    got = {r.file: r.relevance for r in flow.relevance(imports(("e", "m"), ("m", "q"), ("z", None)), files, entries).collect()}
    assert got == {"e": "direct", "m": "direct", "q": "indirect", "z": "unreachable"}
    assert {r.relevance for r in flow.relevance(imports(("e", None)), files, entries).collect() if r.file == "z"} == {"unknown"}


def test_globs():
    import re

    hits = lambda g, p: bool(re.search(rules.glob_pattern(g), p))
    assert hits("**/*.py", "a.py") and hits("**/*.py", "x/y/a.py") and not hits("*.py", "x/a.py")
    assert hits("src/**", "src/a/b") and hits("[!a]?.{js,ts}", "bc.ts") and not hits("[!a]?.{js,ts}", "ac.ts") and not hits("a.c", "abc")


def test_rules_with_windows(spark):
    lines = spark.createDataFrame([("f", "py", 1, "open"), ("f", "py", 4, "write"), ("g", "py", 1, "open"), ("g", "py", 9, "write"), ("h", "py", 1, "open write"), ("h", "py", 2, "safe"), (None, None, 1, None)], "path string, lang string, line int, snippet string")
    rule = {"id": "r", "allOf": ["open", "write"], "window": 3, "notMatch": "safe", "severity": "high"}
    assert [tuple(r) for r in rules.rule_findings(lines, [rule]).collect()] == [("r", "f", 1, "high", False)]
    assert rules.rule_findings(lines, [{"id": "s", "pattern": "open", "paths": ["g"], "shadow": True}]).collect()[0].shadow
    assert rules.rule_findings(lines, []).count() == 0


def test_policies(spark):
    rows = spark.createDataFrame([(1, "high", True), (2, "high", None), (3, "low", True)], "id int, severity string, open boolean")
    policy = 'deny[m] {\n finding := input.findings[_]\n finding.severity == "high"\n not finding.open\n m := sprintf("%v is %v", [finding.id, finding.severity])\n}'
    assert [r.msg for r in rules.policy_messages(rows, policy).collect()] == ["2 is high"]
    for bad in ("", "deny[m] { finding.id ~ 3; m := \"x\" }", "deny[m] { finding.open }"):
        with pytest.raises(ValueError):
            rules.policy_messages(rows, bad)


def test_nodes_and_chains(spark):
    nodes = spark.createDataFrame([("a", "call", "db.run"), ("b", "call", "dbxrun")], "file string, kind string, name string")
    assert [r.file for r in rules.query_nodes(nodes, kind="call", name="db.*").collect()] == ["a"]
    sha = __import__("hashlib").sha256(b"one").hexdigest()
    log = spark.createDataFrame([("k", 1, "one", ""), ("k", 2, "two", sha), ("k", 3, "three", sha)], "key string, at int, line string, prev string")
    assert [r["at"] for r in rules.chain_breaks(log, "key", "at", "line", "prev").collect()] == [3]


def test_scores(spark):
    rows = spark.createDataFrame([("high", True, [0.5, None, 0.5], "v1.2.3", "1.3"), (None, None, None, "x", "1")], "s string, k boolean, e array<double>, a string, b string")
    got = rows.select(
        S.exploitability(F.col("s"), kev=F.col("k")).alias("x"), S.through(F.col("e")).alias("p"), S.version_bump(F.col("a"), F.col("b")).alias("v"),
        S.step_up(F.col("s")).alias("u"), S.step_down(F.col("s")).alias("d"), S.expected_loss(F.lit(0.5), reach=F.lit("route"), sure=F.lit(None).cast("double")).alias("l"),
    ).collect()
    assert [tuple(r) for r in got] == [(0.92, 0.25, "minor", "critical", "medium", 18000), (0.3, 1.0, None, None, None, 18000)]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("p<", n, "r", "high", 'a|b & "c"\nd\x01') for n in (10, 9, 2)], "path string, line int, rule string, severity string, snippet string")
    text = {}
    for kind in reports.KINDS[:6]:
        reports.write_report(rows, str(tmp_path / kind), kind, ["path", "line", "rule"])
        text[kind] = "\n".join(f.read_text() for f in sorted((tmp_path / kind).glob("part-*")))
    results = json.loads(text["sarif"])["runs"][0]["results"]
    assert [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in results] == [2, 9, 10] and results[0]["level"] == "error"
    assert len({o["id"] for o in json.loads(text["stix"])["objects"]}) == 3 and len(json.loads(text["vex"])["statements"]) == 3
    __import__("xml.etree.ElementTree").etree.ElementTree.fromstring(text["junit"].strip())
    assert r"a\|b" in text["markdown"] and "&amp; &quot;c&quot;" in text["html"]
    for kind in ("sarif", "vex"):
        empty = [r.line for r in reports.lines_of(rows.limit(0), kind, ["path", "line", "rule"]).collect()]
        json.loads("\n".join(empty))


def test_manifests_and_boms(spark):
    files = [
        ("a/package.json", '{"dependencies": {"left": "^1.2.0"}, "devDependencies": {"@s/right": "~2.0.1"}}'), ("b/package.json", "{"), ("requirements-dev.txt", "# x\nflask==2.0\nrich[all]\n"),
        ("go.sum", "x.org/m v1.0.0 h1:abc=\nx.org/m v1.0.0/go.mod h1:d=\n"), ("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency>"),
        ("Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0.1"\n'), ("vcpkg.json", '{"dependencies": ["zlib", {"name": "fmt", "version>=": "9.0"}]}'), ("conan.lock", '{"requires": ["zlib/1.2.11#ab"]}'), ("go.mod", None),
    ]
    found = reports.manifest_components(spark.createDataFrame(files, "path string, content string"))
    got = {(r.ecosystem, r.name, r.version or None) for r in found.collect()}
    assert got == {("npm", "left", "1.2.0"), ("npm", "@s/right", "2.0.1"), ("pypi", "flask", "2.0"), ("pypi", "rich", None), ("go", "x.org/m", "1.0.0"), ("maven", "g:a", None), ("cargo", "serde", "1.0.1"), ("vcpkg", "zlib", None), ("vcpkg", "fmt", "9.0"), ("conan", "zlib", "1.2.11")}
    bom = json.loads("\n".join(r.line for r in reports.lines_of(found, "cyclonedx", ["ecosystem", "name", "version"]).collect()))
    assert "pkg:npm/%40s/right@2.0.1" in {c["purl"] for c in bom["components"]}
    assert len(json.loads("\n".join(r.line for r in reports.lines_of(found, "spdx", ["ecosystem", "name", "version"]).collect()))["packages"]) == 10


def test_rounds_of_a_tabulation_are_as_many_as_calls_are_deep(spark):
    n = 40
    nodes = [("f", i, "assign", f"v{i}", [f"v{i - 1}"], None, None, i == 0, False) for i in range(n)] + [("f", n, "call", "r", None, "g", [f"v{n - 1}"], False, False), ("f", n + 1, "other", None, None, None, ["r"], False, True)]
    nodes += [("g", 0, "assign", flow.RETURN, ["a"], None, None, False, False), ("g", 1, "exit", None, None, None, None, False, False)]
    edges, functions = [("f", i, i + 1) for i in range(n + 1)] + [("g", 0, 1)], [("f", 0, []), ("g", 0, ["a"])]
    ns = spark.createDataFrame(nodes, flow.NODES)
    facts = flow.tabulate(ns, spark.createDataFrame(edges, "qid string, src long, dst long"), spark.createDataFrame(functions, "qid string, entry long, params array<string>"), max_rounds=4)
    assert {tuple(x) for x in facts.select("qid", "node", "entry", "fact").collect()} == solve(nodes, edges, functions)
    assert [tuple(x) for x in flow.tainted_sinks(facts, ns).collect()] == [("f", n + 1, "r")]
