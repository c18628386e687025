"""Operator 2: secret scans over an incremental blob ledger, DataFrame functions only.

Every version of a path is addressed by the SHA-256 of its text. The ledger holds one row per
(blob, rule versions) that has been scanned, with the hits as gaps and lengths. A new increment
scans only the blob and rule-version pairs that the ledger lacks; findings are then joined back
to all paths that ever held the blob.

Rules name a pattern, the group whose length counts, and the least length; a version change makes
the ledger's older rows for that rule count as unseen. Offsets come from ``split`` and
``regexp_extract_all`` with the same pattern: the text between matches and the matches alternate.

Copies are combined before the shuffle of texts (partial aggregation by blob), and in the join back
to paths a blob that many of them hold is broadcast, so its paths do not meet in one task.

The query feeds its table in two increments: half of the documents under an older version of one rule, then all of them under the
current ones. The second scans the other half's blobs by all rules, and the first half's by the newer rule alone.

Defined cases: null text is the empty blob; a null path stays a path of its own; repeated rows of
a path each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int
    least: int
    gate: str
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([any_case("password"), any_case("passwd"), any_case("secret"), any_case("token"), any_case("api") + "_?" + any_case("key")])
#: In this order at equal starts. Letter classes stand for either case, so that no other letter folds in. gate: a
#: cheaper pattern that any kept match contains. The least length is in the pattern where a shorter match cannot hide a longer one.
RULES = (
    Rule("assign", 1, rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"[:=]\x20*[\x22']?[A-Za-z0-9+/_.=-]{12}"),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}", 0, 18, "AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, "[0-9a-f]{16,}", 0, 16, "[0-9a-f]{16}"),
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----", base=False),
    Rule("bearer", 1, r"[Bb]earer\x20+[A-Za-z0-9._~+/=-]{20,}", 0, 1, r"earer\x20", base=False),
)
#: What the query's first increment is scanned by: the bearer rule took shorter values then.
OLDER = tuple(Rule(r.kind, r.version - 1, r.pattern.replace("{20,}", "{8,}"), r.group, r.least, r.gate, r.base) if r.kind == "bearer" else r for r in RULES)
_HIT = "struct<kind:int,nth:int,gap:int,len:int,ok:boolean>"
LEDGER = f"blob_id binary, rules array<string>, hits array<{_HIT}>"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hits(text: Column, n: int, rule: Rule, wanted: Column) -> Column:
    pattern = F.lit(rule.pattern)
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    rows = F.transform(
        F.arrays_zip(found.alias("m"), gaps.alias("g"), value.alias("v")),
        lambda x, i: F.struct(F.lit(n).alias("kind"), i.cast("int").alias("nth"), F.char_length(x["g"]).alias("gap"), F.char_length(x["m"]).alias("len"), (F.char_length(x["v"]) >= rule.least).alias("ok")),
    )
    # the text after the last match has no match beside it
    return F.when(wanted & text.rlike(rule.gate), F.filter(rows, lambda x: x["len"].isNotNull())).otherwise(F.lit(None)).cast(f"array<{_HIT}>")


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add to the ledger what is unseen of docs (doc_id, text); return the versions (doc_id, blob_id)."""
    spark = docs.sparkSession
    docs = C.doc_texts(docs).withColumn("blob_id", blob_id(F.col("text")))
    versions, keys = C.save(docs.select("doc_id", "blob_id"), C.scratch(spark, "ledger-versions")), [r.key for r in rules]
    if C.exists(spark, ledger):
        seen = spark.read.schema(LEDGER).parquet(ledger).groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        todo = versions.select("blob_id").distinct().join(seen, "blob_id", "left").select("blob_id", F.array_except(F.array(*map(F.lit, keys)), F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).filter(F.size("todo") > 0)
        blobs = docs.groupBy("blob_id").agg(F.first("text").alias("text")).join(todo, "blob_id")
    else:
        blobs = docs.groupBy("blob_id").agg(F.first("text").alias("text")).withColumn("todo", F.array(*map(F.lit, keys)))
    parts = [F.coalesce(_hits(F.col("text"), n, r, F.array_contains("todo", r.key)), F.array().cast(f"array<{_HIT}>")) for n, r in enumerate(rules)]
    blobs.select("blob_id", F.col("todo").alias("rules"), F.concat(*parts).alias("hits")).write.mode("append").parquet(ledger)
    return versions


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob_id, kind, start, end) of the current rule versions; code points, end exclusive."""
    current = F.array(*[F.lit(r.key) for r in rules])
    rows = spark.read.schema(LEDGER).parquet(ledger).filter(F.size("hits") > 0).select("blob_id", F.array_intersect("rules", current).alias("rules"), F.explode("hits").alias("h"))
    kind = reduce(lambda c, n: c.when(F.col("h.kind") == n, F.array_contains("rules", rules[n].key)), range(len(rules)), F.when(F.lit(False), F.lit(False)))
    rows = rows.filter(kind).select("blob_id", "h.*")
    before = "sum(gap + len) over (partition by blob_id, kind order by nth)"
    return rows.selectExpr("blob_id", "kind", "ok", f"{before} - len as start", f"{before} as end").filter("ok").drop("ok").distinct()


def by_path(versions: DataFrame, found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per version: its spans as an array of structs (start, kind, end), ordered."""
    spans = found.groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    return C.spread_join(versions, spans, ["blob_id"], "left").select("doc_id", "blob_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"))


def digest(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    names = F.array(*[F.lit(r.kind) for r in rules])
    base = sum(r.base for r in rules)  # base rules come first
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda n: F.size(F.filter("spans", lambda x: x["kind"] == n)).cast("long")
    return rows.select(
        "doc_id",
        *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(rules) if r.base],
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] < base)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, docs = C.scratch(spark, "ledger"), C.table(spark, sf_dir, "documents")
    scan(docs.filter(F.xxhash64("doc_id") > 0), ledger, OLDER)
    return digest(by_path(scan(docs, ledger), findings(spark, ledger)))


#: The rules once more, apart from RULES: as stated, without gates, and lengths tested after matching.
_STATED = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/=-]+)", 1, 20),
)
_MATCHES = " union all ".join(
    f"select doc_id, {n} as kind, '{kind}' as name, {least} as least, unnest(range(len(m))) as i, unnest(m) as m, unnest(v) as v, unnest(g[1:len(m)]) as g from (select doc_id, regexp_extract_all(text, '{p}') as m, regexp_extract_all(text, '{p}', {group}) as v, regexp_split_to_array(text, '{p}') as g from docs)"
    for n, (kind, p, group, least) in enumerate(_STATED)
)
ORACLE = f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
ends as (select *, cast(sum(length(g) + length(m)) over (partition by doc_id, kind order by i) as bigint) as e from ({_MATCHES})),
s as (select doc_id, kind, name, e - length(m) as s, e from ends where length(v) >= least),
g as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    string_agg(name || ':' || s || ':' || e, ',' order by s, kind) filter (kind < 3) as base, string_agg(name || ':' || s || ':' || e, ',' order by s, kind) as spans
  from s group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs d left join g on d.doc_id = g.doc_id
"""
