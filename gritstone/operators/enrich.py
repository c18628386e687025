"""What findings are joined with: scores, popular names, accepted risks, taxonomies, mitigations, blame, contracts between services."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.operators.graph import reach
from gritstone.operators.stats import few, null_join

EXPLOITED = 0.95
BAND = 64
#: A severity, and the one above or below it.
ABOVE = {"medium": "high", "high": "critical"}
BELOW = {"critical": "high", "high": "medium", "medium": "low", "low": "info"}
#: Fixed values, first hit wins: words of a title, and their family.
KEYWORDS = (
    ("sql *injection", "sql-injection"), ("command *injection", "command-injection"), ("code *injection|eval", "code-injection"), ("cross[- ]?site *scripting|xss", "xss"),
    ("path *traversal|directory *traversal", "path-traversal"), ("server[- ]?side *request *forgery|ssrf", "ssrf"), ("cross[- ]?site *request *forgery|csrf", "csrf"), ("open *redirect", "open-redirect"),
    ("xxe|external *entity", "xxe"), ("mass[- ]?assignment", "mass-assignment"), ("prototype *pollution", "prototype-pollution"), ("deserializ", "insecure-deserialization"),
)


def mapped(value: Column, table: dict[str, str]) -> Column:
    return reduce(lambda c, kv: F.when(value == kv[0], kv[1]).otherwise(c), table.items(), value)


def best_score(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """findings (id, severity, cves) with cve, epss, percentile, exploited_now and bumped: of a finding's CVEs the first with the largest score (cve, epss, percentile);
    from the 95th percentile on, medium and high go up one step."""
    rows = findings.select("id", F.posexplode("cves").alias("nth", "cve")).join(scores.select("cve", "epss", "percentile"), "cve")
    best = rows.groupBy("id").agg(F.max_by(F.struct("cve", "epss", "percentile"), F.struct(F.col("epss"), -F.col("nth"))).alias("b")).select("id", "b.*")
    now = F.coalesce(F.col("percentile") >= EXPLOITED, F.lit(False))
    return findings.join(best, "id", "left").withColumn("exploited_now", now).withColumn("bumped", F.when(now, mapped(F.col("severity"), ABOVE)).otherwise(F.col("severity")))


def _without_two(name: Column) -> Column:
    """The name, and the name with one and with two characters left out."""
    less = lambda s: F.transform(F.sequence(F.lit(1), F.char_length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.char_length(s))))
    one = F.when(F.char_length(name) > 0, less(name)).otherwise(F.array().cast("array<string>"))
    two = F.flatten(F.transform(one, lambda x: F.when(F.char_length(x) > 0, less(x)).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.array(name), one, two))


def lookalikes(names: DataFrame, popular: DataFrame) -> DataFrame:
    """name, near_to, distance, severity of names that aren't popular (name, rank) but one or two edits from one that is; the least distance, then rank, counts. Two names within
    two edits share what is left of them without two characters each, so hashes of that are joined and no pairs are tried."""
    others = names.select("name").distinct().join(popular.select("name"), "name", "left_anti")
    side = lambda df, c: df.select(*df.columns, F.explode(_without_two(F.col(c))).alias("__rest")).withColumn("__rest", F.xxhash64("__rest"))
    near = side(others, "name").join(side(popular.select(F.col("name").alias("near_to"), "rank"), "near_to"), "__rest").select("name", "near_to", "rank").distinct()
    near = near.withColumn("distance", F.levenshtein("name", "near_to", 2)).filter("distance between 1 and 2")
    best = near.groupBy("name").agg(F.min(F.struct("distance", "rank", "near_to")).alias("b"))
    return best.select("name", F.col("b.near_to").alias("near_to"), F.col("b.distance").cast("long").alias("distance"), F.when(F.col("b.distance") == 1, "critical").otherwise("high").alias("severity"))


def in_scope(names: DataFrame, scopes: list[str]) -> DataFrame:
    """Names that are, or are under, a private scope."""
    return names.filter(reduce(Column.__or__, [(F.col("name") == s) | F.col("name").startswith(f"{s}/") for s in scopes], F.lit(False)))


def accepted(findings: DataFrame, risks: DataFrame, now: Column) -> DataFrame:
    """id, risk: findings (id, ecosystem, name, version, aliases) that an unexpired entry (risk, cve, ecosystem, name, version, expires) accepts, by a CVE among the aliases or by
    package (version and ecosystem only if given); the least entry counts. Only the least entry of a CVE or package is joined, and a finding asks for its package with and without
    its version and ecosystem, so each of its keys meets one row."""
    open_ = risks.filter(F.col("expires").isNull() | (F.col("expires") > now))
    least = lambda *key: open_.filter(F.col(key[0]).isNotNull()).groupBy(*key).agg(F.min("risk").alias("risk"))
    by_cve = findings.select("id", F.explode("aliases").alias("cve")).join(least("cve"), "cve").select("id", "risk")
    package = ["name", "version", "ecosystem"]
    asked = findings.select("id", *package).filter("name is not null")
    for c in package[1:]:
        asked = asked.withColumn(c, F.explode(F.array_distinct(F.array(c, F.lit(None)))))
    by_name = null_join(asked, least(*package), package).select("id", "risk")
    return by_cve.unionByName(by_name).groupBy("id").agg(F.min("risk").alias("risk"))


def in_corpus(findings: DataFrame, entries: list[dict]) -> DataFrame:
    """entry, n: how many findings (channel, text) an entry's pattern matches in its channel (any without one). Entries are configuration, so they become columns of one pass."""
    hits = [F.count_if(F.col("text").rlike(e["pattern"]) & (F.col("channel") == e["channel"] if e.get("channel") else F.lit(True))).alias(f"c{i}") for i, e in enumerate(entries)]
    counts = findings.agg(*hits)
    return counts.select(F.explode(F.array(*[F.struct(F.lit(e["id"]).alias("entry"), F.col(f"c{i}").alias("n")) for i, e in enumerate(entries)])).alias("x")).select("x.*")


def dimension(findings: DataFrame, dim: DataFrame, key: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """findings with a dimension's columns, each with its default where the key is unknown. The dimension goes to all tasks while it is small."""
    rows = findings.join(few(dim.dropDuplicates([key])), key, "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (defaults or {}).items()})


def mitigated(findings: DataFrame, waf: DataFrame, network: DataFrame, auth: DataFrame, flags: DataFrame) -> DataFrame:
    """findings (route, service, flag) with waf (route, family), network (service), auth (route) and flag_off (flag) as booleans; routes are compared in canonical form."""
    is_ = lambda df, *key: few(df.select(*key).distinct().withColumn("__hit", F.lit(True)))
    canon = lambda df: df.withColumn("__route", T.route_path(F.col("route"))).drop("route")
    rows = findings.withColumn("__route", T.route_path(F.col("route")))
    for name, df, key in (("waf", canon(waf), ["__route", "family"]), ("network", network, ["service"]), ("auth", canon(auth), ["__route"]), ("flag_off", flags.filter("not enabled"), ["flag"])):
        rows = rows.join(is_(df, *key), key, "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__hit")
    return rows.drop("__route")


def blamed(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """findings (path, line, ...) with commit and author of the hunk (path, first, last, commit, author) that holds the line; the least commit of several. Lines are cut into
    bands, so this is an equi-join on (path, band)."""
    spread = hunks.withColumn("__band", F.explode(F.sequence(F.floor(F.col("first") / BAND), F.floor(F.col("last") / BAND))))
    keys = findings.select("path", "line").distinct()
    hit = keys.withColumn("__band", F.floor(F.col("line") / BAND)).join(spread, ["path", "__band"]).filter("line between first and last")
    hit = hit.groupBy("path", "line").agg(F.min(F.struct("commit", "author")).alias("b")).select("path", "line", "b.*")
    return findings.join(hit, ["path", "line"], "left")


def demoted(findings: DataFrame, routes: int) -> DataFrame:
    """findings (severity, reachable, category) with unreachable ones one severity lower, and what it was; nothing is dropped. A project without routes can't tell, and a
    source that names a request is not doubted."""
    sure = F.coalesce(F.col("category").rlike("(?i)HTTP|DOM|Form|URL|Query"), F.lit(False))
    down = (F.col("reachable") == False) & ~sure & F.col("severity").isin(list(BELOW)) & F.lit(routes > 0)  # noqa: E712
    down = F.coalesce(down, F.lit(False))
    return findings.withColumn("was", F.when(down, F.col("severity"))).withColumn("severity", F.when(down, mapped(F.col("severity"), BELOW)).otherwise(F.col("severity")))


PREDICATES = {
    "is_cross_file": lambda: F.coalesce(F.col("source_file") != F.col("file"), F.lit(False)),
    "not_cross_file": lambda: ~F.coalesce(F.col("source_file") != F.col("file"), F.lit(False)),
    "is_reachable": lambda: F.coalesce(F.col("reachable"), F.lit(False)),
    "not_reachable": lambda: F.coalesce(~F.col("reachable"), F.lit(False)),
    "has_multi_step_path": lambda: F.coalesce(F.col("steps") > 1, F.lit(False)),
}


def path_constraints(findings: DataFrame) -> DataFrame:
    """findings (file, source_file, reachable, steps, must, must_not: names of predicates) with dropped_by: the first name of ``must`` that fails, else the first of ``must_not``
    that holds, else null. Unknown names drop nothing."""
    holds = F.create_map(*[x for k, v in PREDICATES.items() for x in (F.lit(k), v())])
    bad = lambda names, value: F.try_element_at(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.try_element_at(holds, n) == value), F.lit(1))
    return findings.withColumn("dropped_by", F.coalesce(F.concat(F.lit("must:"), bad(F.col("must"), False)), F.concat(F.lit("must-not:"), bad(F.col("must_not"), True))))


def backfilled(findings: DataFrame, families: DataFrame) -> DataFrame:
    """findings (vuln, cwe, family, parser, component, steps) with family from the CWE (cwe, of_family), else from words of the title, and parser SCA, IR-TAINT or REGEX, where they are missing."""
    words = reduce(lambda c, kv: F.when(F.col("vuln").rlike(f"(?i){kv[0]}"), kv[1]).otherwise(c), reversed(KEYWORDS), F.lit(None).cast("string"))
    rows = findings.join(few(families.select("cwe", "of_family").dropDuplicates(["cwe"])), "cwe", "left")
    parser = F.when(F.col("component").isNotNull(), "SCA").when(F.col("steps") > 0, "IR-TAINT").otherwise("REGEX")
    return rows.withColumn("family", F.coalesce(F.when(F.col("family") != "", F.col("family")), "of_family", words)).withColumn("parser", F.coalesce(F.when(F.col("parser") != "", F.col("parser")), parser)).drop("of_family")


def catalog_hits(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """call, entry, kind: calls (call, callee, path) that an entry (entry, kind, match, value, extensions) names by the callee's last segment (tail), by all of it (full) or by its last two
    (member); entries with extensions fire in such files only. Each way is an equi-join."""
    parts = F.split("callee", r"\.")
    named = calls.select("call", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), F.explode(F.array(
        F.struct(F.lit("tail").alias("match"), F.element_at(parts, -1).alias("value")), F.struct(F.lit("full").alias("match"), F.col("callee").alias("value")),
        F.struct(F.lit("member").alias("match"), F.array_join(F.slice(parts, F.when(F.size(parts) > 1, -2).otherwise(1), 2), ".").alias("value")))).alias("k")).select("call", "ext", "k.*")
    rows = named.join(few(catalog), ["match", "value"]).filter("extensions is null or array_contains(extensions, ext)")
    return rows.select("call", "entry", "kind").distinct()


def first_sinks(reads: DataFrame, sinks: DataFrame, near: int = 20) -> DataFrame:
    """model, read_file, read_line, sink_line, severity: the first sink (file, line, severity critical, high or medium) of a reader's file within ``near`` lines of each distinct read
    (model, file, line). Sinks of one line become one before they meet reads by (file, band of lines), so a read meets at most twice a band's lines."""
    band = 2 * near + 1
    sinks = sinks.filter("severity in ('critical', 'high', 'medium')").groupBy("file", F.col("line").alias("sink_line")).agg(F.min("severity").alias("severity"))
    spread = sinks.withColumn("__band", F.explode(F.array_distinct(F.transform(F.array(F.lit(-near), F.lit(0), F.lit(near)), lambda o: F.floor((F.col("sink_line") + o) / band)))))
    hit = reads.select("model", "file", "line").distinct().withColumn("__band", F.floor(F.col("line") / band)).join(spread, ["file", "__band"]).filter(F.abs(F.col("sink_line") - F.col("line")) <= near)
    hit = hit.groupBy("model", "file", "line").agg(F.min(F.struct("sink_line", "severity")).alias("s"))
    return hit.select("model", F.col("file").alias("read_file"), F.col("line").alias("read_line"), "s.*")


def around(writes: DataFrame, reads: DataFrame, sinks: DataFrame, near: int = 20) -> DataFrame:
    """Round trips through a model: write (model, file, line), read (model, file, line) of the same model, and the read's first sink. All pairs of a model; ``round_trips`` counts them."""
    return writes.select("model", F.col("file").alias("write_file"), F.col("line").alias("write_line")).distinct().join(first_sinks(reads, sinks, near), "model")


def round_trips(writes: DataFrame, reads: DataFrame, sinks: DataFrame, near: int = 20) -> DataFrame:
    """model, trips, lines: how many rows ``around`` has of each model, and their sink lines' sum, without its pairs: each write goes with each read of its model."""
    w = writes.select("model", "file", "line").distinct().groupBy("model").agg(F.count("*").alias("__writes"))
    r = first_sinks(reads, sinks, near).groupBy("model").agg(F.count("*").alias("__reads"), F.sum("sink_line").alias("__lines"))
    return w.join(r, "model").select("model", (F.col("__writes") * F.col("__reads")).alias("trips"), (F.col("__writes") * F.col("__lines")).alias("lines"))


def contracts(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """client, server, key: uses (file, key) of what another file declares (file, key): canonical paths, rpc names or fields alike. The first declaration of a key counts."""
    first = servers.groupBy("key").agg(F.min("file").alias("server"))
    return clients.select(F.col("file").alias("client"), "key").distinct().join(first, "key").filter("client <> server")


def federation(uses: DataFrame, offers: DataFrame, seeds: DataFrame, depth: int = 12) -> DataFrame:
    """node, depth of the repositories that a seed (node) reaches over contracts between repositories: uses (repo, key) of offers (repo, key)."""
    edges = uses.join(offers.select("key", F.col("repo").alias("dst")), "key").select(F.col("repo").alias("src"), "dst").filter("src <> dst").distinct()
    return reach(edges, seeds, depth)


def top_cwe(findings: DataFrame, by: list[str]) -> DataFrame:
    """The most frequent cwe of each group; of equal ones the one seen first (seq)."""
    counts = findings.filter("cwe is not null").groupBy(*by, "cwe").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counts.groupBy(*by).agg(F.max_by(F.struct("cwe", "n"), F.struct(F.col("n"), -F.col("first"))).alias("t")).select(*by, "t.cwe", "t.n")


def bundles(findings: DataFrame, share: float = 0.8, least: int = 3) -> DataFrame:
    """vuln, sink, n, shared: groups of ``least`` findings or more (id, vuln, sink, vars) where one variable is used by ``share`` of those that use any, and by ``least`` of them."""
    key = ["vuln", "sink"]
    groups = findings.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.size("vars") > 0).alias("with_vars")).filter((F.col("n") >= least) & (F.col("with_vars") >= least))
    used = findings.select(*key, "id", F.explode("vars").alias("var")).distinct().groupBy(*key, "var").agg(F.count("*").alias("k"))
    best = used.groupBy(*key).agg(F.max_by(F.struct("var", "k"), F.struct(F.col("k"), "var")).alias("b")).select(*key, F.col("b.var").alias("shared"), F.col("b.k").alias("k"))
    return groups.join(best, key).filter((F.col("k") >= F.ceil(F.col("with_vars") * share)) & (F.col("k") >= least)).select(*key, "n", "shared", "k")


def contaminated(components: DataFrame, edges: DataFrame) -> DataFrame:
    """src, licenses: components (id, license) under another license that depend directly, over edges (src, dst), on one under a copyleft license."""
    copyleft = components.filter(F.col("license").rlike("^(A?GPL|SSPL)")).select(F.col("id").alias("dst"), "license")
    own = components.filter(~F.coalesce(F.col("license").rlike("^(A?GPL|SSPL)"), F.lit(False))).select(F.col("id").alias("src"))
    return edges.select("src", "dst").distinct().join(copyleft, "dst").join(own, "src", "left_semi").groupBy("src").agg(F.countDistinct("license").alias("licenses"), F.count("*").alias("dependencies"))
