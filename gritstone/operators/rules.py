"""Rules that users write: path globs, patterns over files with windows, policies over findings, and audit chains."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.functions import scores as S
from gritstone.sources.tables import table


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: * and ? stay within a folder, ** crosses folders, [..] and {a,b} as usual."""
    out, at = "", 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out, at = out + "(?:[^/]+/)*", at + 3
        elif glob.startswith("**", at):
            out, at = out + ".*", at + 2
        elif c == "[" and "]" in glob[at + 2 :]:
            end = glob.index("]", at + 2)
            inner = glob[at + 1 : end].replace("\\", "\\\\")
            out, at = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif c == "{" and "}" in glob[at:]:
            end = glob.index("}", at)
            out, at = out + "(?:" + "|".join(glob_pattern(g)[1:-1] for g in glob[at + 1 : end].split(",")) + ")", end + 1
        else:
            out, at = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), at + 1
    return f"^{out}$"


def rule_findings(lines: DataFrame, rules: Iterable[dict]) -> DataFrame:
    """rule, path, line, severity, shadow. ``lines`` are (path, lang, line, snippet); a rule has id, severity, and ``pattern`` or ``allOf``
    with ``window``; maybe ``notMatch``, ``languages``, ``paths`` (globs) and ``shadow``. A pattern fires on each of its lines. allOf fires
    once a file, on the first line of its first pattern, if each other pattern has a line within the window; a line of notMatch
    in the file silences a rule. All rules go over the lines in one pass and one shuffle by file; the state of a file
    is its lines that match some pattern."""
    rules = list(rules)
    if not rules:
        return lines.sparkSession.createDataFrame([], "rule string, path string, line int, severity string, shadow boolean")
    marks, columns, outs = [], {}, []

    def mark(pattern: str) -> Column:
        if pattern not in columns:
            columns[pattern] = f"__m{len(columns)}"
            marks.append(F.col("snippet").rlike(pattern).alias(columns[pattern]))
        return F.col(columns[pattern])

    by_file = Window.partitionBy("path")
    for r in rules:
        parts = r.get("allOf") or [r["pattern"]]
        anchor, others, near = mark(parts[0]), [mark(p) for p in parts[1:]], int(r.get("window", 0))
        fires = anchor
        if r.get("allOf"):
            first = F.min(F.when(anchor, F.col("line"))).over(by_file)
            around = Window.partitionBy("path").orderBy("line").rangeBetween(-near, near)
            fires = reduce(lambda a, o: a & F.max(o).over(around), others, anchor & (F.col("line") == first))
        if r.get("notMatch"):
            fires = fires & ~F.max(mark(r["notMatch"])).over(by_file)
        if r.get("languages"):
            fires = fires & F.col("lang").isin(list(r["languages"]))
        if r.get("paths"):
            fires = fires & reduce(Column.__or__, [F.col("path").rlike(glob_pattern(g)) for g in r["paths"]])
        outs.append(F.when(fires, F.struct(F.lit(r["id"]).alias("rule"), F.lit(r.get("severity", "medium")).alias("severity"), F.lit(bool(r.get("shadow"))).alias("shadow"))))
    rows = lines.select("path", "lang", "line", *marks).filter(reduce(Column.__or__, [F.col(c) for c in columns.values()]))
    hits = rows.select("path", "line", F.array(*outs).alias("hits")).select("path", "line", F.explode(F.array_compact("hits")).alias("hit"))
    return hits.select("hit.rule", "path", "line", "hit.severity", "hit.shadow")


_BLOCK = re.compile(r"\bdeny(?:\s*\[\s*(\w+)\s*\])?\s*\{([^}]*)\}")
_TEST = re.compile(r'^(not\s+)?(?:finding|input)\.([\w.]+)\s*(?:(==|!=|>=|<=|>|<)\s*("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?|true|false))?$')
_MESSAGE = re.compile(r'^(\w+)\s*:?=\s*(?:sprintf\(\s*"([^"]*)"\s*,\s*\[([^\]]*)\]\s*\)|"([^"]*)")$')


def policy_messages(findings: DataFrame, policy: str, lenient: bool = False) -> DataFrame:
    """Findings with ``msg``, a row for each deny block, named or not, that holds. A block is lines of comparisons on ``finding.field`` or ``input.field``, all of which must
    hold, and one message, plain or sprintf with %v ("policy violation" in a block without a name). What can't be read raises ValueError, so that no policy is half applied;
    a lenient reader skips such lines, and has that message where a block has none."""
    messages = []
    for name, body in _BLOCK.findall(policy):
        holds, msg = F.lit(True), None
        for line in filter(None, (x.strip() for x in re.split(r"[\n;]", body))):
            if line.startswith("#") or line == "finding := input.findings[_]":
                continue
            if (m := _MESSAGE.match(line)) and m[1] == (name or "msg"):
                args = [F.col(a.strip().removeprefix("finding.")).cast("string") for a in (m[3] or "").split(",") if a.strip()]
                msg = F.lit(m[4]) if m[4] is not None else F.format_string(m[2].replace("%v", "%s"), *args)
            elif m := _TEST.match(line):
                field, op, raw = F.col(m[2]), m[3], m[4]
                if op is None:
                    absent = F.coalesce(field.cast("string"), F.lit("false")) == "false"
                    test = absent if m[1] else ~absent
                else:
                    value = F.lit(raw[1:-1]) if raw[0] == '"' else F.lit(raw == "true") if raw in ("true", "false") else F.lit(float(raw))
                    test = {"==": field == value, "!=": field != value, ">=": field >= value, "<=": field <= value, ">": field > value, "<": field < value}[op]
                    test = ~F.coalesce(test, F.lit(False)) if m[1] else F.coalesce(test, F.lit(False))
                holds = holds & test
            elif not lenient:
                raise ValueError(f"policy line not understood: {line}")
        if msg is None:
            if name and not lenient:
                raise ValueError(f"deny block without {name}")
            msg = F.lit("policy violation")
        messages.append(F.when(holds, msg))
    if not messages:
        raise ValueError("policy without deny blocks")
    return findings.withColumn("msg", F.explode(F.array_compact(F.array(*messages))))


#: Fixed value: what the first line of a chain has before it.
GENESIS = "GENESIS"


def query_nodes(nodes: DataFrame, **wanted: str) -> DataFrame:
    """Nodes (file, qid, kind, name, ...) by equality, or by a pattern where the value holds * or ? (of whole values)."""
    tests = [F.col(k).rlike("^" + re.escape(v).replace(r"\*", ".*").replace(r"\?", ".") + "$") if re.search(r"[*?]", v) else F.col(k) == v for k, v in wanted.items()]
    return nodes.filter(reduce(Column.__and__, tests, F.lit(True)))


def chain_breaks(log: DataFrame, key: str, order: str, line: str, previous: str) -> DataFrame:
    """Rows of an audit log whose ``previous`` isn't the sha-256 of the line before in their chain (empty or GENESIS for the first)."""
    before = F.lag(F.sha2(F.col(line), 256)).over(Window.partitionBy(key).orderBy(order))
    held = F.coalesce(F.when(F.col("__before").isNull(), F.col(previous).isin("", GENESIS)).otherwise(F.col(previous) == F.col("__before")), F.lit(False))
    return log.withColumn("__before", before).filter(~held).drop("__before")


RULES = (
    {"id": "license-dated", "allOf": ["[Ll]icensed under", "[0-9]{3,}"], "window": 3, "severity": "info"},
    {"id": "secret-line", "pattern": r"(password|secret|token) *[:=]", "severity": "critical", "notMatch": "[Ll]icensed under"},
    {"id": "mail-en", "pattern": r"[a-z]+@[a-z]+\.", "severity": "low", "languages": ["en"], "shadow": True},
)
POLICY = """
deny[msg] {
  finding.severity == "critical"
  finding.status == "O"
  finding.price >= 300000
  msg := sprintf("finding %v of %v", [finding.id, finding.owner])
}
deny[msg] { finding.severity == "high"; finding.status != "F"; finding.price > 400000; msg := "large and high" }
"""


def custom_rule_findings(spark: SparkSession, d: str) -> DataFrame:
    from gritstone.operators.scan import lines

    return rule_findings(lines(table(spark, d, "documents")), RULES).withColumn("line", F.col("line").cast("long"))


def severity_of(priority: Column) -> Column:
    return S.lookup(F.substring(priority, 1, 1), {"1": "critical", "2": "high", "3": "medium", "5": "low"}, "info")


def order_findings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), severity_of(F.col("o_orderpriority")).alias("severity"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("opened"))


def policy_rego(spark: SparkSession, d: str) -> DataFrame:
    return policy_messages(order_findings(spark, d), POLICY).select("id", "msg")


def finding_scores(spark: SparkSession, d: str) -> DataFrame:
    """All scores of all findings, with order columns in place of a finding's evidence."""
    f = order_findings(spark, d)
    open_, done, dear = F.col("status") == "O", F.col("status") == "F", F.col("price") >= 400000
    f = f.withColumn("exploit", S.exploitability(F.col("severity"), route_rooted=open_ & dear, reachable=F.when(open_, True).when(done, False), guarded=F.col("price") < 50000, kev=F.col("owner") % 97 == 0, helmet=F.col("owner") % 2 == 0))
    f = f.withColumn("risk", S.composite_risk(F.col("severity"), exploit=F.col("exploit"), mitigated=done, toxicity=F.col("price") / 5000, exploited_now=F.col("owner") % 89 == 0))
    f = f.withColumn("sure", S.confidence(F.col("severity"), parser=F.when(dear, "CHAIN").otherwise("AST"), evidence=open_, guarded=F.col("price") < 50000, unreachable=done))
    f = f.withColumn("loss", S.expected_loss(F.col("exploit"), data_class=F.when(F.col("owner") % 3 == 0, "PII").when(F.col("owner") % 7 == 0, "PCI"), crown_jewel=dear, reach=F.when(open_, "route").when(done, "unreachable"), sure=F.col("sure")))
    verdict = S.dependency_verdict(F.col("severity"), S.version_bump(F.lit("1.2.3"), F.when(F.col("owner") % 4 == 0, "2.0.0").when(F.col("owner") % 4 == 1, "1.3.0").when(F.col("owner") % 4 == 2, "1.2.9")), reachable=F.when(open_, True).when(done, False), kev=F.col("owner") % 97 == 0, tests=F.lit(True))
    return f.select("id", "exploit", S.exploitability_tier(F.col("exploit")).alias("tier"), "risk", S.risk_tier(F.col("risk")).alias("risk_tier"), "sure", "loss", verdict.alias("verdict"))
