"""Program graphs as relations: interprocedural facts by tabulation, alias classes, dominators, class hierarchies, call
resolution, invalidation and dead code. What is inside one function (dominators, its facts) is
solved by a task; the rest are joins, in rounds over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.operators.graph import MERGE, Rounds, connected, reach, written
from gritstone.operators.stats import null_join
from gritstone.sources.tables import table

ZERO, RETURN = "0", "$ret"
NODES = "qid string, node long, kind string, target string, uses array<string>, callee string, args array<string>, source boolean, sink boolean"


def tabulate(nodes: DataFrame, edges: DataFrame, functions: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(qid, node, entry, fact): facts that hold before each node, by the fact their function was entered with.

    ``nodes`` as NODES: kind is assign, call or other; ``uses`` are the names an assignment reads, ``source`` says that it
    reads input. ``edges`` are (qid, src, dst); ``functions`` are (qid, entry, params), entry being a node. A node without a
    successor is an exit. Every function is entered with the zero fact. An assignment kills its target and sets it again if
    it reads a tainted name or input; a call passes a tainted argument as the parameter in its place, and its target is
    tainted where the callee's exit holds RETURN; the caller's own facts pass a call unchanged.

    A function's graph is one row, its size that of the function's source, and is solved whole by a task. Between functions go only
    tainted arguments and the entries under which RETURN gets out, so rounds are as many as calls are deep, and each solves only
    functions that these reach and writes only what is new. Ends when nothing is new; raises after ``max_rounds``."""
    rounds, step = Rounds(nodes.sparkSession), F.col("step")
    node = F.struct("node", "kind", "target", "uses", "callee", "args", F.coalesce("source", F.lit(False)).alias("source"))
    body = nodes.filter("qid is not null and node is not null").select("qid", node.alias("n")).groupBy("qid").agg(F.collect_list("n").alias("body"))
    succ = edges.filter("qid is not null and src is not null").groupBy("qid").agg(F.collect_set(F.struct("src", "dst")).alias("succ"))
    starts = functions.groupBy("qid").agg(F.collect_set("entry").alias("starts"), F.max(F.col("entry").isNull()).alias("nowhere"))
    graphs = rounds.keep(starts.join(body, "qid", "left").join(succ, "qid", "left"), "graphs")
    params = functions.filter("qid is not null").select(F.col("qid").alias("callee"), "params")
    none = F.lit(None).cast("string")
    state = None  # (qid, entry, callee, pos, step): further entries of functions, and call sites (callee, pos) that return taint
    waits = None  # (qid, callee, pos, given): calls with a tainted argument
    seen = returning = None
    for n in range(max_rounds):
        if state is None:
            todo = graphs.withColumn("state", F.array().cast("array<struct<entry:string,callee:string,pos:bigint,new:boolean>>"))
        else:
            due = state.groupBy("qid").agg(F.collect_list(F.struct("entry", "callee", "pos", (step == n).alias("new"))).alias("state"), F.max("step").alias("last")).filter(F.col("last") == n)
            todo = graphs.join(due.drop("last"), "qid")
        out = rounds.keep(todo.select("qid", "starts", "nowhere", "body", "succ", "state").mapInArrow(_solve, _SOLVED), "solved")
        facts = out.filter("what = 'fact'").select("qid", "node", "entry", "fact")
        seen = facts if seen is None else seen.unionByName(facts)
        asked = out.filter("what = 'call'").select("qid", F.col("fact").alias("callee"), F.col("node").alias("pos")).join(params, "callee")
        given = F.coalesce(F.try_element_at("params", F.col("pos").cast("int")), F.lit(ZERO))
        asked = rounds.keep(asked.select("qid", "callee", "pos", given.alias("given")).distinct(), "calls")
        ends = out.filter("what = 'end'").select(F.col("qid").alias("callee"), F.col("entry").alias("given"))
        # who is entered anew, and which calls return taint: new calls of all that return it, and calls from before of what does now
        entered = asked.filter(F.col("given") != ZERO).select(F.col("callee").alias("qid"), F.col("given").alias("entry")).distinct()
        returning = ends if returning is None else returning.unionByName(ends)
        back = asked.join(returning, ["callee", "given"])
        if waits is not None:
            back = back.unionByName(waits.join(ends, ["callee", "given"]))
        waits = asked if waits is None else waits.unionByName(asked)
        back = back.select("qid", "callee", "pos")
        from_zero = ends.filter(F.col("given") == ZERO)
        if not from_zero.isEmpty():
            callers = nodes.filter("qid is not null and kind = 'call'").select("qid", "callee").distinct()
            back = back.unionByName(callers.join(from_zero.select("callee"), "callee").select("qid", "callee", F.lit(0).cast("long").alias("pos")))
        sent = entered.select("qid", "entry", none.alias("callee"), F.lit(None).cast("long").alias("pos"))
        sent = sent.unionByName(back.distinct().select("qid", none.alias("entry"), "callee", "pos"))
        if state is not None:
            sent = null_join(sent, state.select("qid", "entry", "callee", "pos"), ["qid", "entry", "callee", "pos"], "left_anti")
        sent = rounds.keep(sent.withColumn("step", F.lit(n + 1)), "state")
        if sent.isEmpty():
            return rounds.result(seen, "facts")
        state = sent if state is None else state.unionByName(sent)
    raise RuntimeError(f"facts still change after {max_rounds} rounds")


_SOLVED = "what string, qid string, node long, entry string, fact string"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is new in functions (qid, starts, nowhere, body, succ, state): facts; calls (callee in ``fact``, place of the tainted argument in ``node``); and entries
    under which RETURN gets out."""
    for batch in batches:
        cols = {c: batch.column(c) for c in ("starts", "body", "succ", "state")}
        at = {c: a.value_lengths().fill_null(0).to_pylist() for c, a in cols.items()}
        flat = {c: a.flatten() for c, a in cols.items()}
        fields = {c: list(zip(*(f.to_pylist() for f in flat[c].flatten()), strict=True)) for c in ("body", "succ", "state")} | {"starts": flat["starts"].to_pylist()}
        place, out = dict.fromkeys(cols, 0), []
        for i, (qid, nowhere) in enumerate(zip(batch.column("qid").to_pylist(), batch.column("nowhere").to_pylist(), strict=True)):
            mine = {}
            for c in cols:
                mine[c] = fields[c][place[c] : place[c] + at[c][i]]
                place[c] += at[c][i]
            body, succ = {}, {}
            for node, *rest in mine["body"]:
                body.setdefault(node, []).append(rest)
            for a, b in mine["succ"]:
                ahead = succ.setdefault(a, [])
                if b is not None:
                    ahead.append(b)
            starts = [*mine["starts"], None] if nowhere else mine["starts"]
            entries = {ZERO: False} if mine["state"] else {ZERO: True}
            for entry, _, _, new in mine["state"]:
                if entry is not None:
                    entries[entry] = new
            returns = {(c, p) for e, c, p, _ in mine["state"] if e is None}
            before = {(c, p) for e, c, p, new in mine["state"] if e is None and not new}
            told = set()
            for entry, new in entries.items():
                if new:
                    facts, calls = _solved(starts, body, succ, entry, returns)
                    old, old_calls = set(), set()
                elif returns != before:
                    facts, calls = _solved(starts, body, succ, entry, returns)
                    old, old_calls = _solved(starts, body, succ, entry, before)
                else:
                    continue
                more = facts - old
                out += [("fact", qid, n, entry, f) for n, f in more]
                told |= calls - old_calls
                gets_out = lambda found: any(f == RETURN and n in body and n not in succ for n, f in found)
                if gets_out(more) and not gets_out(old):
                    out.append(("end", qid, None, entry, None))
            out += [("call", qid, p, None, c) for c, p in told]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        cols_out = list(zip(*out, strict=True)) or [()] * 5
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols_out, kinds, strict=True)], ["what", "qid", "node", "entry", "fact"])


def _solved(starts: list, body: dict, succ: dict, entry: str, returns: set) -> tuple[set, set]:
    """(node, fact) of one function entered with a fact, and its calls (callee, place) with a tainted argument."""
    seen, calls = {(s, entry) for s in starts}, set()
    work = list(seen)
    while work:
        node, fact = work.pop()
        ahead = succ.get(node, ())
        for kind, target, uses, callee, args, source in body.get(node, ()):
            if kind == "assign":
                after = [] if fact == target else [fact]
                if target is not None and (source and fact == ZERO or uses is not None and fact in uses):
                    after.append(target)
            else:
                after = [fact]
                if kind == "call" and callee is not None:
                    pos = args.index(fact) + 1 if args is not None and fact in args else 0
                    if pos:
                        calls.add((callee, pos))
                    if target is not None and (callee, pos) in returns:
                        after.append(target)
            for s in ahead:
                for f in after:
                    if (s, f) not in seen:
                        seen.add((s, f))
                        work.append((s, f))
    return seen, calls


def tainted_sinks(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, node, fact): sinks that read a tainted name."""
    sinks = nodes.filter("sink").select("qid", "node", "args")
    return facts.join(sinks, ["qid", "node"]).filter(F.array_contains("args", F.col("fact"))).select("qid", "node", "fact").distinct()


def alias_classes(copies: DataFrame, fields: DataFrame) -> DataFrame:
    """(node, comp): alias classes by unification. ``copies`` (src, dst) are assignments between names; ``fields``
    (base, field, name) are loads and stores, and names of one field of one class are one class too. Each round unites at
    least two classes or is the last."""
    edges, known = written(copies.select("src", "dst").unionByName(fields.select(F.col("base").alias("src"), F.col("base").alias("dst"))).unionByName(fields.select(F.col("name").alias("src"), F.col("name").alias("dst"))), "copies"), -1
    while True:
        classes = connected(edges)
        count = classes.select("comp").distinct().count()
        if count == known:
            return classes
        known = count
        slots = fields.join(classes, fields["base"] == classes["node"]).groupBy("comp", "field", "name").agg(F.count("*").alias("n"))
        first = slots.groupBy("comp", "field").agg(F.min("name").alias("first"))
        edges = written(edges.unionByName(slots.join(first, ["comp", "field"]).select(F.col("first").alias("src"), F.col("name").alias("dst"))), "slots")


def dominators(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(qid, node, idom, frontier): immediate dominators and dominance frontiers of the nodes that a function's entry reaches;
    the entry's idom is null. A function's graph is one row, its size that of the function's source; a batch holds many."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(q, *r) for q, e, g in zip(pdf["qid"], pdf["entry"], pdf["graph"], strict=True) for r in _dominator_rows(int(e), [(int(x["src"]), int(x["dst"])) for x in g])]
            yield pd.DataFrame(rows, columns=["qid", "node", "idom", "frontier"]).astype({"idom": "Int64"})

    graphs = edges.groupBy("qid").agg(F.collect_list(F.struct("src", "dst")).alias("graph"))
    rows = entries.select("qid", "entry").join(graphs, "qid", "left").withColumn("graph", F.coalesce("graph", F.array().cast("array<struct<src:bigint,dst:bigint>>")))
    return rows.select("qid", "entry", "graph").mapInPandas(run, "qid string, node long, idom long, frontier array<long>")


def _dominator_rows(start: int, edges: list[tuple[int, int]]) -> list[tuple]:
    succ: dict[int, list[int]] = {}
    for a, b in edges:
        succ.setdefault(a, []).append(b)
    order, met, open_nodes = [], {start}, [(start, iter(succ.get(start, ())))]
    while open_nodes:  # post-order without recursion
        at, rest = open_nodes[-1]
        ahead = next((n for n in rest if n not in met), None)
        if ahead is None:
            order.append(at)
            open_nodes.pop()
        else:
            met.add(ahead)
            open_nodes.append((ahead, iter(succ.get(ahead, ()))))
    place = {n: i for i, n in enumerate(order)}
    pred: dict[int, set[int]] = {n: set() for n in order}
    for n in order:
        for s in succ.get(n, ()):
            pred[s].add(n)
    idom, moved = {start: start}, True
    while moved:
        moved = False
        for n in reversed(order[:-1]):
            best = None
            for p in pred[n]:
                if p in idom:
                    best = p if best is None else _meet(idom, place, best, p)
            if idom.get(n) != best:
                idom[n], moved = best, True
    up = idom | {start: None}
    frontier: dict[int, set[int]] = {n: set() for n in order}
    for n in order:
        for p in pred[n]:
            while p is not None and p != up[n]:
                frontier[p].add(n)
                p = up[p]
    return [(n, up[n], sorted(frontier[n])) for n in sorted(order)]


def _meet(idom: dict[int, int], place: dict[int, int], a: int, b: int) -> int:
    while a != b:
        if place[a] < place[b]:
            a = idom[a]
        else:
            b = idom[b]
    return a


def ancestors(parents: DataFrame) -> DataFrame:
    """(class, ancestor, depth) of (class, parent) rows, itself at depth 0 included; the least depth of each pair. Ends when nothing is new, cycles included."""
    rounds, depth = Rounds(parents.sparkSession), 0
    seen = front = rounds.keep(parents.select("class").unionByName(parents.select(F.col("parent").alias("class"))).distinct().select("class", F.col("class").alias("ancestor"), F.lit(0).alias("depth")), "classes")
    up = parents.select(F.col("class").alias("ancestor"), "parent")
    while True:
        depth += 1
        front = rounds.keep(front.join(up, "ancestor").select("class", F.col("parent").alias("ancestor")).distinct().join(seen, ["class", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "classes")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if depth % MERGE == 0:
            seen = rounds.keep(seen, "classes")
    return rounds.result(seen, "ancestors")


def resolve_methods(above: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, method, owner): the nearest definition of each method that a class has or inherits; ties go to the least owner."""
    rows = above.join(methods.select(F.col("class").alias("ancestor"), "method"), "ancestor")
    return rows.groupBy("class", "method").agg(F.min(F.struct("depth", "ancestor"))["ancestor"].alias("owner"))


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls (file, caller, name) with their callee's qid among functions (file, name, qid): one of the same file first, else the
    only one of that name anywhere; an ambiguous name stays null. Names are counted before the join, so no pairs arise."""
    near = functions.groupBy("file", "name").agg(F.min("qid").alias("near"), F.count("*").alias("n_near"))
    far = functions.groupBy("name").agg(F.min("qid").alias("far"), F.count("*").alias("n_far"))
    rows = calls.join(near, ["file", "name"], "left").join(far, "name", "left")
    return rows.select("file", "caller", "name", F.when(F.col("n_near") == 1, F.col("near")).when(F.col("n_near").isNull() & (F.col("n_far") == 1), F.col("far")).alias("callee"))


def invalidated(before: DataFrame, now: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(qid): functions of changed, added or removed files (path, hash), and all that call them, however far."""
    b, n = before.select("path", F.col("hash").alias("was")), now.select("path", F.col("hash").alias("is"))
    moved = b.join(n, "path", "full_outer").filter("not (was <=> is)").select("path")
    seeds = functions.join(moved, functions["file"] == moved["path"], "left_semi").select(F.col("qid").alias("node"))
    back = calls.filter("callee is not null").select(F.col("callee").alias("src"), F.col("caller").alias("dst")).distinct()
    return reach(back, seeds, None).select(F.col("node").alias("qid"))


def dead_functions(functions: DataFrame, calls: DataFrame, entry_files: DataFrame) -> DataFrame:
    """Exported functions that nothing calls, outside entry files (file)."""
    used = calls.filter("callee is not null and callee <> caller").select(F.col("callee").alias("qid"))
    return functions.filter("exported").join(used, "qid", "left_anti").join(entry_files, "file", "left_anti")


def relevance(imports: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, depth, relevance): direct (an entry or its import), indirect or unreachable, by imports (src, dst). ``unreachable`` is
    said only if there are entries and no reached file has an import that isn't resolved (null dst); else ``unknown``."""
    found = reach(imports.filter("dst is not null"), entries.select(F.col("file").alias("node")), None)
    loose = imports.filter("dst is null").select(F.col("src").alias("node")).join(found, "node", "left_semi")
    complete = not entries.isEmpty() and loose.isEmpty()
    rows = files.join(found.withColumnRenamed("node", "file"), "file", "left")
    return rows.withColumn("relevance", F.when(F.col("depth") <= 1, "direct").when(F.col("depth") > 1, "indirect").otherwise("unreachable" if complete else "unknown"))


# ---- queries: an order is a function, its lines are nodes, a part is a function that it calls ----


def _order_functions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """x is input on line 1 of a returned item; line n puts part(x) in y<n>, or is a sink of y<n-1> at 45 units or more."""
    name = lambda c, shift=0: F.concat(F.lit("y"), (F.col(c) - shift).cast("string"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_returnflag", "l_quantity")).alias("v")).select("l_orderkey", "l_linenumber", "v.*")
    first, sink = F.col("l_linenumber") == 1, (F.col("l_linenumber") > 1) & (F.col("l_quantity") >= 45)
    qid, part = F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    lines = rows.select(
        qid.alias("qid"), F.col("l_linenumber").cast("long").alias("node"), F.when(first, "assign").otherwise("call").alias("kind"), F.when(first, "x").when(~sink, name("l_linenumber")).alias("target"),
        F.array().cast("array<string>").alias("uses"), F.when(~first & ~sink, part).alias("callee"), F.when(sink, F.array(name("l_linenumber", 1))).otherwise(F.array(F.lit("x"))).alias("args"),
        (first & (F.col("l_returnflag") == "R")).alias("source"), sink.alias("sink"),
    )
    own = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    parts = table(spark, d, "part").select("p_size", own.alias("qid"))
    uses = F.when(F.col("p_size") <= 25, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    none = F.lit(None)
    body = parts.select("qid", F.lit(1).cast("long").alias("node"), F.lit("assign").alias("kind"), F.lit(RETURN).alias("target"), uses.alias("uses"), none.cast("string").alias("callee"), none.cast("array<string>").alias("args"), F.lit(False).alias("source"), F.lit(False).alias("sink"))
    end = parts.select("qid", F.lit(2).cast("long").alias("node"), F.lit("exit").alias("kind"), none.cast("string").alias("target"), none.cast("array<string>").alias("uses"), none.cast("string").alias("callee"), none.cast("array<string>").alias("args"), F.lit(False).alias("source"), F.lit(False).alias("sink"))
    after = F.lead("node").over(Window.partitionBy("qid").orderBy("node"))
    edges = lines.select("qid", F.col("node").alias("src"), after.alias("dst")).filter("dst is not null").unionByName(parts.select("qid", F.lit(1).cast("long").alias("src"), F.lit(2).cast("long").alias("dst")))
    functions = lines.groupBy("qid").agg(F.min("node").alias("entry")).withColumn("params", F.array().cast("array<string>")).unionByName(parts.select("qid", F.lit(1).cast("long").alias("entry"), F.array(F.lit("a")).alias("params")))
    return lines.unionByName(body).unionByName(end), edges, functions


def ifds_sinks(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, functions = _order_functions(spark, d)
    nodes = written(nodes, "nodes")
    return tainted_sinks(tabulate(nodes, edges, functions), nodes)


def points_to_classes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a nation are copies of one another; each stores its own value in one field."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("base"), F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("name"))
    copies = s.join(s.groupBy("n").agg(F.min("base").alias("src")), "n").select("src", F.col("base").alias("dst"))
    return alias_classes(copies, s.select("base", F.lit("f").alias("field"), "name")).groupBy("comp").agg(F.count("*").alias("names"))


def dominator_tree(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order in turn; a returned line may also skip the next."""
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("qid"), F.col("l_linenumber").cast("long").alias("src"), "l_returnflag").distinct()
    by = Window.partitionBy("qid").orderBy("src", "l_returnflag")
    rows = rows.withColumn("ahead", F.array(F.lead("src").over(by), F.when(F.col("l_returnflag") == "R", F.lead("src", 2).over(by))))
    edges = rows.select("qid", "src", F.explode(F.array_compact("ahead")).alias("dst"))
    tree = dominators(edges, rows.groupBy("qid").agg(F.min("src").alias("entry")))
    return tree.groupBy("node", "idom").agg(F.count("*").alias("functions"), F.sum(F.size("frontier")).cast("long").alias("joins"))


def call_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Parts as functions by name in a brand's file; calls by name from each order line's supplier file."""
    functions = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"), F.col("p_partkey").alias("qid"))
    calls = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    file = F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 5 + 1).cast("string"))
    calls = calls.select(file.alias("file"), F.col("l_orderkey").alias("caller"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"))
    return resolve_calls(calls, functions).groupBy("file").agg(F.count("*").alias("calls"), F.count("callee").alias("resolved"), F.sum("callee").alias("sum_callee"))


def invalidated_callers(spark: SparkSession, d: str) -> DataFrame:
    """Nations, customers and orders as functions; nations whose region is new are changed files."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nations, customers, orders = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    files = nations.select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("hash"))
    now = nations.select(F.col("n_name").alias("path"), F.sha2(F.when(F.col("n_regionkey") == 2, F.concat("n_name", F.lit("+"))).otherwise(F.col("n_name")), 256).alias("hash"))
    functions = nations.select(F.col("n_name").alias("file"), node("n", "n_nationkey").alias("qid"))
    calls = customers.select(node("c", "c_custkey").alias("caller"), node("n", "c_nationkey").alias("callee")).union(orders.select(node("o", "o_orderkey"), node("c", "o_custkey")))
    return invalidated(files, now, functions, calls).groupBy(F.substring("qid", 1, 1).alias("kind")).agg(F.count("*").alias("functions"))


def class_methods(spark: SparkSession, d: str) -> DataFrame:
    """Customers inherit from their nation, nations from their region; segment and region define methods of one name."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nations, customers = table(spark, d, "nation"), table(spark, d, "customer")
    parents = customers.select(node("c", "c_custkey").alias("class"), node("n", "c_nationkey").alias("parent")).union(nations.select(node("n", "n_nationkey"), node("r", "n_regionkey")))
    methods = customers.filter("c_acctbal < 0").select(node("c", "c_custkey").alias("class")).union(nations.filter("n_regionkey = 1").select(node("n", "n_nationkey"))).union(nations.select(node("r", "n_regionkey")).distinct())
    rows = resolve_methods(ancestors(parents), methods.withColumn("method", F.lit("run")))
    return rows.groupBy("owner").agg(F.count("*").alias("classes"))
