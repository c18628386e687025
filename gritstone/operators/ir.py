"""Program slices: reaching definitions, backward slices, infeasible branches, phi places, boundaries between zones, and patterns that backtrack."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.operators.graph import MERGE, Rounds


def reaching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, node, var, def): definitions that reach a node, from nodes (qid, node, target) and edges (qid, src, dst). A node that defines a variable ends
    earlier definitions of it. Ends when nothing is new."""
    rounds, n = Rounds(nodes.sparkSession), 0
    defs = rounds.keep(nodes.filter("target is not null").select("qid", "node", F.col("target").alias("var")), "defs")
    succ = rounds.keep(edges.select("qid", F.col("src").alias("node"), "dst").distinct(), "succ")
    front = seen = rounds.keep(defs.join(succ, ["qid", "node"]).select("qid", F.col("dst").alias("node"), "var", F.col("node").alias("def")).distinct(), "facts")
    while True:
        n += 1
        step = front.join(defs, ["qid", "node", "var"], "left_anti").join(succ, ["qid", "node"]).select("qid", F.col("dst").alias("node"), "var", "def").distinct()
        front = rounds.keep(step.join(seen, ["qid", "node", "var", "def"], "left_anti"), "facts")
        if front.isEmpty():
            return rounds.result(seen, "reaching")
        seen = seen.unionByName(front)
        if n % MERGE == 0:
            seen = rounds.keep(seen, "facts")


def _functions(nodes: DataFrame, edges: DataFrame, starts: DataFrame, node: list[str], edge: list[str]) -> DataFrame:
    """qid, nodes, edges, starts of functions that have starts (qid, node): a function's graph in one row, its size that of the function's source."""
    gather = lambda df, cols, name: df.filter("qid is not null").select("qid", F.struct(*cols).alias("x")).groupBy("qid").agg(F.collect_list("x").alias(name))
    rows = gather(starts, ["node"], "starts").join(gather(nodes, node, "nodes"), "qid", "left")
    return rows.join(gather(edges, edge, "edges"), "qid", "left")


def _solved(functions: DataFrame, solve: Callable[[list, list, list], list[tuple[int, int]]]) -> DataFrame:
    """(qid, node, value) of what ``solve`` makes of each function's nodes, edges and starts (lists of tuples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, out = ("nodes", "edges", "starts"), []
            sizes = [batch.column(c).value_lengths().fill_null(0).to_pylist() for c in names]
            flat = [list(zip(*(f.to_pylist() for f in batch.column(c).flatten().flatten()), strict=True)) for c in names]
            at = [0, 0, 0]
            for i, qid in enumerate(batch.column("qid").to_pylist()):
                mine = [flat[k][at[k] : at[k] + sizes[k][i]] for k in range(3)]
                at = [at[k] + sizes[k][i] for k in range(3)]
                out += [(qid, *r) for r in solve(*mine)]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["qid", "node", "value"])

    return functions.select("qid", "nodes", "edges", "starts").mapInArrow(run, "qid string, node long, value long")


def _depths(starts: Iterable[int], ahead: dict[int, Iterable[int]]) -> dict[int, int]:
    """Least depths of what the starts reach."""
    found = dict.fromkeys(starts, 0)
    work = deque(found)
    while work:
        at = work.popleft()
        for n in ahead.get(at, ()):
            if n not in found:
                found[n] = found[at] + 1
                work.append(n)
    return found


def _slice(nodes: list, edges: list, sinks: list) -> list[tuple[int, int]]:
    """Breadth first over uses; what defines a variable that a node uses is looked for against the edges, up to the nearest definitions."""
    prior, defines, uses = {}, {}, {}
    for a, b in edges:
        if a is not None and b is not None:
            prior.setdefault(b, set()).add(a)
    for n, target, names in nodes:
        if n is not None:
            defines.setdefault(n, set()).add(target)
            uses.setdefault(n, set()).update(names or ())

    def makers(node: int, var: str) -> set[int]:
        found, met, work = set(), set(), [*prior.get(node, ())]
        while work:
            n = work.pop()
            if n not in met:
                met.add(n)
                if var in defines.get(n, ()):
                    found.add(n)
                else:
                    work += prior.get(n, ())
        return found

    found = {n: 0 for (n,) in sinks if n is not None}
    work = deque(found)
    while work:
        at = work.popleft()
        for var in uses.get(at, ()):
            for n in makers(at, var) if var is not None else ():
                if n not in found:
                    found[n] = found[at] + 1
                    work.append(n)
    return list(found.items())


def backward_slice(nodes: DataFrame, edges: DataFrame, sinks: DataFrame) -> DataFrame:
    """(qid, node, depth): what the sinks (qid, node) depend on over uses and definitions, from nodes (qid, node, target, uses) and edges (qid, src, dst).
    A function is sliced whole by one task."""
    found = _solved(_functions(nodes, edges, sinks, [F.col("node").cast("long"), "target", "uses"], [F.col("src").cast("long"), F.col("dst").cast("long")]), _slice)
    return found.withColumnRenamed("value", "depth")


def _unreached(nodes: list, edges: list, entries: list) -> list[tuple[int, int]]:
    always, ahead = {}, {}
    for n, constant in nodes:
        if constant is not None:
            always.setdefault(n, set()).add(constant)
    for a, b, branch in edges:
        if a is not None and b is not None and (branch is None or a not in always or branch in always[a]):
            ahead.setdefault(a, []).append(b)
    found = _depths([n for (n,) in entries if n is not None], ahead)
    return [(n, 0) for n, _ in nodes if n not in found]


def infeasible(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(qid, node): nodes that no path reaches once branches on constants are cut: nodes (qid, node, constant: what a condition always is, or null), edges (qid, src, dst,
    branch: true, false or null), entries (qid, node). A function is walked by one task; one without an entry has no node that is reached."""
    number = nodes.schema["node"].dataType
    walked = _functions(nodes, edges, entries, [F.col("node").cast("long"), "constant"], [F.col("src").cast("long"), F.col("dst").cast("long"), "branch"])
    loose = nodes.select("qid", "node").join(entries.select("qid").distinct(), "qid", "left_anti")
    return _solved(walked, _unreached).select("qid", F.col("node").cast(number).alias("node")).unionByName(loose)


def phi_places(defs: DataFrame, frontiers: DataFrame) -> DataFrame:
    """(qid, var, node): where values of a variable meet: the iterated dominance frontier of its definitions (qid, var, node) over frontiers (qid, node, frontier)."""
    rounds = Rounds(defs.sparkSession)
    ahead = rounds.keep(frontiers.select("qid", "node", F.explode("frontier").alias("next")), "frontiers")
    front, seen = defs.select("qid", "var", "node").distinct(), None
    while True:
        front = front.join(ahead, ["qid", "node"]).select("qid", "var", F.col("next").alias("node")).distinct()
        front = rounds.keep(front if seen is None else front.join(seen, ["qid", "var", "node"], "left_anti"), "phis")
        if front.isEmpty():
            return rounds.result(front if seen is None else seen, "phis")
        seen = front if seen is None else seen.unionByName(front)


def boundaries(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """from_zone, to_zone, edges, modules: imports (src, dst) between modules (path, zone) of different zones."""
    zone = lambda c, name: modules.select(F.col("path").alias(c), F.col("zone").alias(name))
    rows = imports.select("src", "dst").distinct().join(zone("src", "from_zone"), "src").join(zone("dst", "to_zone"), "dst").filter("from_zone <> to_zone")
    return rows.groupBy("from_zone", "to_zone").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("modules"))


def backtracking(patterns: DataFrame) -> DataFrame:
    """patterns (pattern) with verdict: exponential, safe, or unreadable. A pattern is exponential if something repeated without bound can match one text in two ways: its
    alternatives may begin alike, or it can be cut between two rounds at several places, as its end repeats without bound what it may begin with."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(verdict=[_verdict(p) for p in pdf["pattern"]])

    return patterns.select("pattern").mapInPandas(run, "pattern string, verdict string")


_ALPHABET = frozenset(map(chr, range(32, 127))) | {"\n", "\t", "é"}


def _verdict(pattern: str | None) -> str:
    import re
    import warnings
    from re import _parser  # the standard library's own reading of a pattern

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = _parser.parse(pattern or "")
            return "exponential" if _ambiguous(tree.data) else "safe"
    except (re.error, RecursionError, OverflowError):
        return "unreadable"


def _chars(op, arg) -> frozenset:
    """Characters that one step may match."""
    import re

    name = str(op)
    if name == "LITERAL":
        return frozenset({chr(arg)})
    if name == "NOT_LITERAL":
        return _ALPHABET - {chr(arg)}
    if name == "ANY":
        return _ALPHABET - {"\n"}
    if name == "CATEGORY":
        short = {"CATEGORY_DIGIT": r"\d", "CATEGORY_NOT_DIGIT": r"\D", "CATEGORY_SPACE": r"\s", "CATEGORY_NOT_SPACE": r"\S", "CATEGORY_WORD": r"\w", "CATEGORY_NOT_WORD": r"\W"}[str(arg)]
        return frozenset(c for c in _ALPHABET if re.match(short, c))
    if name == "IN":
        out, negated = set(), False
        for o, a in arg:
            if str(o) == "NEGATE":
                negated = True
            elif str(o) == "RANGE":
                out |= {chr(c) for c in range(a[0], min(a[1], 0x24F) + 1)}
            else:
                out |= _chars(o, a)
        return _ALPHABET - out if negated else frozenset(out)
    return frozenset()


def _first(steps: list) -> tuple[frozenset, bool]:
    """(characters that may come first, whether nothing may be matched)."""
    out: frozenset = frozenset()
    for op, arg in steps:
        chars, empty = _first_of(op, arg)
        out |= chars
        if not empty:
            return out, False
    return out, True


def _first_of(op, arg) -> tuple[frozenset, bool]:
    name = str(op)
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        chars, empty = _first(arg[2].data)
        return chars, empty or arg[0] == 0
    if name == "SUBPATTERN":
        return _first(arg[3].data)
    if name == "BRANCH":
        parts = [_first(b.data) for b in arg[1]]
        return frozenset().union(*(c for c, _ in parts)), any(e for _, e in parts)
    chars = _chars(op, arg)
    return chars, not chars


def _open_ends(steps: list) -> frozenset:
    """First characters of what may repeat without bound and take in all that follows it in these steps."""
    out, after = frozenset(), []
    for op, arg in reversed(steps):
        name, mine = str(op), frozenset()
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            body = arg[2].data
            mine = (_first(body)[0] if str(arg[1]) == "MAXREPEAT" else frozenset()) | _open_ends(body)
        elif name == "SUBPATTERN":
            mine = _open_ends(arg[3].data)
        elif name == "BRANCH":
            mine = frozenset().union(*(_open_ends(b.data) for b in arg[1]))
        if all(mine & chars for chars in after):
            out |= mine
        chars, empty = _first_of(op, arg)
        if not empty:
            after.append(chars)
    return out


def _ambiguous(steps: list, repeated: bool = False) -> bool:
    for op, arg in steps:
        name = str(op)
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            body, endless = arg[2].data, str(arg[1]) == "MAXREPEAT"
            if endless and _open_ends(body) & _first(body)[0]:
                return True
            if _ambiguous(body, repeated or endless):
                return True
        elif name == "SUBPATTERN":
            if _ambiguous(arg[3].data, repeated):
                return True
        elif name == "BRANCH":
            firsts = [_first(b.data)[0] for b in arg[1]]
            if repeated and any(a & b for i, a in enumerate(firsts) for b in firsts[i + 1 :]):
                return True
            if any(_ambiguous(b.data, repeated) for b in arg[1]):
                return True
    return False
