"""Findings over time: differences of two scans, trends over many, what-if scans, resumed scans, drift, triage memory and suppressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.functions.text import severity_rank


def one_per_key(rows: DataFrame, key: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in an order, by aggregation."""
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*key).agg(pick(F.struct(*rows.columns), F.struct(*order)).alias("__row")).select("__row.*")


def _both(a: DataFrame, b: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """key, and was_ and is_ of the fields, with was and is telling the sides."""
    was = a.select(*key, *[F.col(c).alias(f"was_{c}") for c in fields], F.lit(True).alias("was"))
    now = b.select(*key, *[F.col(c).alias(f"is_{c}") for c in fields], F.lit(True).alias("is"))
    return was.join(now, key, "full_outer")


def _moved(fields: list[str]) -> Column:
    out = F.lit(False)
    for c in fields:
        out = out | ~F.col(f"was_{c}").eqNullSafe(F.col(f"is_{c}"))
    return out


def baseline_diff(before: DataFrame, now: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """key, change (added, removed, changed, unchanged) and the fields of both sides. The first row of a key counts."""
    rows = _both(one_per_key(before, key, order), one_per_key(now, key, order), key, fields)
    return rows.withColumn("change", F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(_moved(fields), "changed").otherwise("unchanged")).drop("was", "is")


def pr_delta(base: DataFrame, head: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """key, change (introduced, resolved, persistent, or shifted in severity or cwe), severity and cwe of both sides. The last row of a key counts."""
    rows = _both(one_per_key(base, key, order, last=True), one_per_key(head, key, order, last=True), key, ["severity", "cwe"])
    return rows.withColumn("change", F.when(F.col("was").isNull(), "introduced").when(F.col("is").isNull(), "resolved").when(_moved(["severity", "cwe"]), "shifted").otherwise("persistent")).drop("was", "is")


def delta_summary(delta: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """severity, introduced, resolved, persistent, and net: all rows of head less all of base."""
    own = F.when(F.col("change") == "resolved", F.col("was_severity")).otherwise(F.col("is_severity"))
    counts = delta.filter("change <> 'shifted'").groupBy(own.alias("severity")).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("introduced", "resolved", "persistent")])
    net = head.select("severity", F.lit(1).alias("x")).unionByName(base.select("severity", F.lit(-1).alias("x"))).groupBy("severity").agg(F.sum("x").alias("net"))
    return net.join(counts, "severity", "left").select("severity", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("introduced", "resolved", "persistent")], "net")


def gate(delta: DataFrame, fail_on: str = "high") -> DataFrame:
    """One row: blocked, if a finding of that severity or worse is introduced, and how many are."""
    worst = severity_rank(F.lit(fail_on))
    hit = (F.col("change") == "introduced") & (severity_rank(F.col("is_severity")) <= worst)
    return delta.agg(F.count_if(hit).alias("introduced")).withColumn("blocked", F.col("introduced") > 0)


def overlaid(files: DataFrame, overlays: DataFrame, removals: DataFrame) -> DataFrame:
    """files (path, content) with overlays put over them and removals (path) taken out; a path that is in both is overlaid."""
    base = files.select("path", "content").join(overlays.select("path"), "path", "left_anti").join(removals.select("path"), "path", "left_anti")
    return base.unionByName(overlays.select("path", "content"))


def what_if(files: DataFrame, overlays: DataFrame, removals: DataFrame, scan: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """The difference that overlays and removals make to a scan. Only paths that they touch are scanned twice: a file's findings are its own."""
    touched = overlays.select("path").unionByName(removals.select("path")).distinct()
    before = scan(files.join(touched, "path", "left_semi"))
    return baseline_diff(before, scan(overlaid(files.join(touched, "path", "left_semi"), overlays, removals)), key, key, ["severity"])


def changed_paths(before: DataFrame, now: DataFrame, dirty: DataFrame | None = None) -> DataFrame:
    """path of files whose hash differs from before or that are new, and of dirty ones that are still there."""
    new = now.select("path", "hash").join(before.select("path", F.col("hash").alias("was")), "path", "left").filter("not (hash <=> was)").select("path")
    return new if dirty is None else new.unionByName(now.select("path").join(dirty.select("path"), "path", "left_semi")).distinct()


def history(snapshots: DataFrame, last: int = 30) -> DataFrame:
    """at, total, critical, introduced, fixed, improving of the last snapshots, from rows (at, id, severity): ids that a snapshot has and the one before
    has not, and the reverse. The first one has nothing before it. Improving: neither total nor critical grew."""
    times = snapshots.select("at").distinct()
    nth = F.row_number().over(Window.orderBy(F.desc("at")))  # one row a snapshot
    times = times.withColumn("nth", nth).filter(F.col("nth") <= last)
    ids = snapshots.join(F.broadcast(times), "at").select("nth", "at", "id", "severity").dropDuplicates(["nth", "id"])
    now, was = ids.select("nth", "id", "severity", F.lit(1).alias("here")), ids.select((F.col("nth") - 1).alias("nth"), "id", F.lit(1).alias("there"))
    moves = now.join(was, ["nth", "id"], "full_outer").groupBy("nth").agg(F.count("here").alias("total"), F.count_if((F.col("here") == 1) & (F.col("severity") == "critical")).alias("critical"), F.count_if(F.col("there").isNull()).alias("introduced"), F.count_if(F.col("here").isNull()).alias("fixed"))
    rows = times.join(moves, "nth")
    older = Window.orderBy(F.desc("nth"))  # at most ``last`` rows
    calm = (F.col("total") <= F.lag("total").over(older)) & (F.col("critical") <= F.lag("critical").over(older))
    first = F.lag("total").over(older).isNull()
    return rows.select("at", "total", "critical", F.when(first, F.lit(0)).otherwise(F.col("introduced")).alias("introduced"), F.when(first, F.lit(0)).otherwise(F.col("fixed")).alias("fixed"), F.coalesce(calm, F.lit(True)).alias("improving"))


def set_changes(before: DataFrame, now: DataFrame, key: list[str], what: str, *more: str) -> DataFrame:
    """what, change (added or removed), and the columns ``more`` of that side, for keys of one side only."""
    a, b = before.dropDuplicates(key), now.dropDuplicates(key)
    added, removed = b.join(a, key, "left_anti").withColumn("change", F.lit("added")), a.join(b, key, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed).select(F.lit(what).alias("what"), "change", *more)


def drift(routes: tuple[DataFrame, DataFrame], components: tuple[DataFrame, DataFrame], vulnerable: tuple[DataFrame, DataFrame], findings: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row: counts of added and removed routes (method, path, auth), components (ecosystem, name, version), vulnerable components (those and advisory, severity)
    and findings (path, line, family, severity), auth boundaries lost, and the tier."""
    lost = routes[0].filter("auth").select("method", "path").join(routes[1].filter("not auth").select("method", "path"), ["method", "path"], "left_semi").distinct()
    none = [F.lit(None).cast("string").alias("severity"), F.lit(None).cast("boolean").alias("auth")]
    parts = [
        set_changes(*routes, ["method", "path"], "route", "auth").select("what", "change", none[0], "auth"),
        set_changes(*components, ["ecosystem", "name", "version"], "component").select("what", "change", *none),
        set_changes(*vulnerable, ["ecosystem", "name", "version", "advisory"], "vulnerable", "severity").select("what", "change", "severity", none[1]),
        set_changes(*findings, ["path", "line", "family"], "finding", "severity").select("what", "change", "severity", none[1]),
        lost.select(F.lit("boundary").alias("what"), F.lit("removed").alias("change"), *none),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    n = lambda what, change, test="true": F.count_if(F.expr(f"what = '{what}' and change = '{change}' and {test}"))
    counts = rows.agg(*[n(w, c).alias(f"{w}s_{c}") for w in ("route", "component", "vulnerable", "finding") for c in ("added", "removed")], n("boundary", "removed").alias("boundaries_lost"), n("finding", "added", "severity = 'critical'").alias("_crit"), n("vulnerable", "added", "severity in ('critical', 'high')").alias("_dep"), n("route", "added", "not auth").alias("_open"), F.count("*").alias("_all"))
    tier = F.expr("case when boundaries_lost > 0 or _crit > 0 then 'critical' when _dep > 0 or findings_added > 0 or _open > 0 then 'high' when components_added > 0 or routes_added > 0 then 'medium' when _all > 0 then 'low' else 'info' end")
    return counts.withColumn("tier", tier).drop("_crit", "_dep", "_open", "_all")


def resumable(files: DataFrame, scan: Callable[[DataFrame], DataFrame], ledger: str, run_key: str) -> DataFrame:
    """Findings of files (path, content), scanning only what the ledger lacks under this key (of rules and version). The ledger is Parquet: one folder for each key, a row
    (path, sha, findings) a scanned file, written by task commits, so a run that ended early has no torn rows. The result is that of a run from scratch."""
    spark = files.sparkSession
    files = files.select("path", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha"))
    at = f"{ledger.rstrip('/')}/key={run_key}"
    first = scan(files.limit(0).select("path", "content"))
    kind = f"path string, sha string, findings array<{first.drop('path').schema.simpleString()}>"
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    done = spark.read.schema(kind).parquet(at) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else spark.createDataFrame([], kind)
    todo = files.join(done.select("path", "sha"), ["path", "sha"], "left_anti")
    found = scan(todo.select("path", "content"))
    found = found.groupBy("path").agg(F.collect_list(F.struct(*[c for c in found.columns if c != "path"])).alias("findings"))
    empty = F.array().cast(first.sparkSession.createDataFrame([], kind).schema["findings"].dataType)
    todo.select("path", "sha").join(found, "path", "left").select("path", "sha", F.coalesce("findings", empty).alias("findings")).write.mode("append").parquet(at)
    rows = spark.read.schema(kind).parquet(at).join(files.select("path", "sha"), ["path", "sha"]).dropDuplicates(["path", "sha"])
    return rows.select("path", F.explode("findings").alias("f")).select("path", "f.*")


def human_and_model(triage: DataFrame, verdicts: DataFrame) -> DataFrame:
    """stable_id, bucket, human, model: the latest human verdict (stable_id, verdict, at) of each id beside the model's (stable_id, verdict). bucket is pair, or why
    the id is left out of the pairs, which alone have human and model set."""
    latest = triage.filter("stable_id is not null").groupBy("stable_id").agg(F.max_by("verdict", F.struct("at", "verdict")).alias("h"))
    model = verdicts.groupBy("stable_id").agg(F.max_by("verdict", F.struct("at", "verdict")).alias("m"))
    rows = latest.join(model, "stable_id", "left")
    bucket = F.expr("""case when m is null then 'no_model' when h = 'wontfix' then 'human_wontfix' when m in ('escalate', 'unvalidated', 'not-applicable') then concat('model_', replace(m, '-', '_'))
        when h in ('tp', 'fp') and m in ('accept', 'reject') then 'pair' else 'other' end""")
    rows = rows.withColumn("bucket", bucket)
    return rows.select("stable_id", "bucket", F.when(F.col("bucket") == "pair", F.col("h") == "tp").alias("human"), F.when(F.col("bucket") == "pair", F.col("m") == "accept").alias("model"))


def learned(findings: DataFrame, feedback: DataFrame, quorum: int = 2, last: int = 500) -> DataFrame:
    """findings with suppressed_by (null, id or pattern) and confidence, from feedback (stable_id, verdict, family, file, snippet, at). The last entries count. An id with
    ``quorum`` (two at least) false positives suppresses; so does a family and folder with as many whose snippet's first 30 characters the finding's
    first 80 hold. What isn't suppressed and was once a true positive gains 0.1 of confidence."""
    quorum = max(2, quorum)
    entries = feedback.orderBy(F.desc("at"), "stable_id").limit(last)  # bounded, so all that comes of it is broadcast
    ids = entries.filter("verdict = 'fp' and stable_id is not null").groupBy("stable_id").count().filter(F.col("count") >= quorum).select("stable_id", F.lit(True).alias("__id"))
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    patterns = entries.filter("verdict = 'fp' and family is not null").groupBy("family", folder(F.col("file")).alias("folder"), F.substring("snippet", 1, 80).alias("s")).count().filter(F.col("count") >= quorum)
    patterns = patterns.filter("s <> ''").groupBy("family", "folder").agg(F.collect_set(F.substring("s", 1, 30)).alias("__heads"))
    true = entries.filter("verdict = 'tp' and stable_id is not null").select("stable_id").distinct().withColumn("__tp", F.lit(True))
    rows = findings.withColumn("folder", folder(F.col("file"))).join(F.broadcast(ids), "stable_id", "left").join(F.broadcast(patterns), ["family", "folder"], "left").join(F.broadcast(true), "stable_id", "left")
    by_pattern = F.coalesce(F.exists("__heads", lambda h: F.substring("snippet", 1, 80).contains(h)), F.lit(False))
    rows = rows.withColumn("suppressed_by", F.when(F.col("__id"), "id").when(by_pattern, "pattern"))
    sure = F.when(F.col("suppressed_by").isNull() & F.col("__tp"), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)) + 0.1)).otherwise(F.col("confidence"))
    return rows.withColumn("confidence", sure).drop("folder", "__id", "__heads", "__tp")


def suppressed(findings: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """findings with active and marker, by audited entries (id, signer, reviewer, reason, ticket, expires, critical_ok): an entry holds if all of its fields are there, signer and
    reviewer differ, it is unexpired, and a critical finding is allowed for. A finding whose entry doesn't hold is kept, with what is wrong as marker."""
    rows = findings.join(entries.dropDuplicates(["id"]).select("id", *[F.col(c).alias(f"__{c}") for c in ("signer", "reviewer", "reason", "ticket", "expires", "critical_ok")], F.lit(True).alias("__is")), "id", "left")
    wrong = F.when(F.greatest(*[F.coalesce(F.col(f"__{c}"), F.lit("")) == "" for c in ("signer", "reviewer", "reason", "ticket")]) | F.col("__expires").isNull() | F.col("__critical_ok").isNull(), "incomplete")
    wrong = wrong.when(F.col("__signer") == F.col("__reviewer"), "self-reviewed").when(F.col("__expires") <= now, "expired").when((F.col("severity") == "critical") & ~F.col("__critical_ok"), "critical")
    marker = F.when(F.col("__is"), wrong)
    rows = rows.withColumn("marker", marker).withColumn("active", F.coalesce(F.col("__is") & F.col("marker").isNull(), F.lit(False)))
    return rows.drop(*[f"__{c}" for c in ("signer", "reviewer", "reason", "ticket", "expires", "critical_ok", "is")])


def mttr_key(path: Column, line: Column, vuln: Column, cwe: Column) -> Column:
    """A fingerprint of 16 digits over file, line, the name as a slug, and CWE; of a chain of files the last counts."""
    slug = F.regexp_replace(F.lower(vuln), "[^a-z0-9]+", "-")
    return F.substring(F.sha2(F.concat_ws(":", F.trim(F.element_at(F.split(path, " -> "), -1)), line.cast("string"), slug, cwe), 256), 1, 16)


def sync_triage(state: DataFrame, seen: DataFrame, scan: int) -> DataFrame:
    """The store (id, state, opened, fixed) after a scan that saw ids: new ids open, open ones that aren't seen are fixed, fixed, wont-fix and false-positive ones stay."""
    rows = state.join(seen.select("id").distinct().withColumn("__seen", F.lit(True)), "id", "full_outer")
    new, gone = F.col("state").isNull(), F.col("__seen").isNull() & ~F.col("state").isin("fixed", "wont-fix", "false-positive")
    at = F.lit(scan).cast("long")
    return rows.select("id", F.when(new, "open").when(gone, "fixed").otherwise(F.col("state")).alias("state"), F.when(new, at).otherwise(F.col("opened")).alias("opened"), F.when(~new & gone, at).otherwise(F.col("fixed")).alias("fixed"))


def empty_triage(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id long, state string, opened long, fixed long")
