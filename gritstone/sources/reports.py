"""Reports of findings and of components, written as distributed text: each row is rendered by JVM expressions, and what a format
puts around the rows are first and last lines of their own. Findings have rule, path, line, severity, snippet; components name,
version, ecosystem and maybe license."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the formats.
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "none"}
PURL_TYPE = {"npm": "npm", "pypi": "pypi", "go": "golang", "maven": "maven", "cargo": "cargo", "conan": "conan"}


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _escaped(c: str) -> Column:
    """Safe inside XML and HTML; control characters that XML forbids become blanks."""
    out = F.regexp_replace(_text(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def _cell(c: str) -> Column:
    return F.replace(F.regexp_replace(_text(c), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))


def _level(c: str, table: dict, otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def _id(*cols: str) -> Column:
    """A name-based identifier in the form of a UUID, the same for the same finding in every report."""
    h = F.sha2(F.concat_ws("\u0001", *[_text(c) for c in cols]), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(F.lit("a"), cut(18, 3)), cut(21, 12))


def purl(name: Column, version: Column, ecosystem: Column) -> Column:
    kind = ecosystem
    for k, v in PURL_TYPE.items():
        kind = F.when(ecosystem == k, v).otherwise(kind)
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), F.replace(name, F.lit("@"), F.lit("%40")), F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit("@"), version)).otherwise(""))


def rendered(rows: DataFrame, kind: str) -> tuple[list[str], Column, str, list[str]]:
    """(first lines, a row's line, what separates rows, last lines) of a format."""
    if kind == "markdown":
        return ["| severity | rule | place | snippet |", "|---|---|---|---|"], F.concat(F.lit("| "), F.concat_ws(" | ", _cell("severity"), _cell("rule"), F.concat_ws(":", _cell("path"), _text("line")), _cell("snippet")), F.lit(" |")), "", []
    if kind == "html":
        cells = [F.concat(F.lit("<td>"), _escaped(c), F.lit("</td>")) for c in ("severity", "rule", "path", "line", "snippet")]
        return ["<!doctype html><meta charset=utf-8><title>Findings</title><table>", "<tr><th>severity<th>rule<th>path<th>line<th>snippet</tr>"], F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")), "", ["</table>"]
    if kind == "junit":
        case = F.concat(F.lit('<testcase classname="'), _escaped("path"), F.lit('" name="'), _escaped("rule"), F.lit(":"), _text("line"), F.lit('"><failure type="'), _escaped("severity"), F.lit('">'), _escaped("snippet"), F.lit("</failure></testcase>"))
        return ['<?xml version="1.0" encoding="UTF-8"?>', '<testsuites><testsuite name="findings">'], case, "", ["</testsuite></testsuites>"]
    if kind == "sarif":
        place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
        row = F.to_json(F.struct(F.col("rule").alias("ruleId"), _level("severity", SARIF_LEVEL, "warning").alias("level"), F.struct(_text("snippet").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(_id("rule", "path", "line").alias("stableId")).alias("partialFingerprints")))
        return ['{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"gritstone"}},"results":['], row, ",", ["]}]}"]
    if kind == "stix":
        row = F.to_json(F.struct(F.lit("vulnerability").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("vulnerability--"), _id("rule", "path", "line")).alias("id"), F.col("rule").alias("name"), F.concat_ws(":", _text("path"), _text("line")).alias("description"), F.array(F.col("severity")).alias("labels")))
        return ['{"type":"bundle","id":"bundle--00000000-0000-5000-a000-000000000000","objects":['], row, ",", ["]}"]
    if kind == "vex":
        state = F.when(F.col("severity").isin("info", "low"), "not_affected").otherwise("affected")
        return ['{"@context":"https://openvex.dev/ns/v0.2.0","statements":['], F.to_json(F.struct(F.struct(F.col("rule").alias("name")).alias("vulnerability"), F.array(F.struct(F.col("path").alias("@id"))).alias("products"), state.alias("status"))), ",", ["]}"]
    name, version, eco = F.col("name"), F.col("version"), F.col("ecosystem")
    has_license = "license" in rows.columns
    if kind == "cyclonedx":
        licenses = [F.when(F.col("license").isNotNull(), F.array(F.struct(F.struct(F.col("license").alias("id")).alias("license")))).alias("licenses")] if has_license else []
        return ['{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"components":['], F.to_json(F.struct(F.lit("library").alias("type"), "name", "version", purl(name, version, eco).alias("purl"), *licenses)), ",", ["]}"]
    if kind == "spdx":
        declared = F.coalesce(F.col("license"), F.lit("NOASSERTION")) if has_license else F.lit("NOASSERTION")
        ref = F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), purl(name, version, eco).alias("referenceLocator"))
        return ['{"spdxVersion":"SPDX-2.3","SPDXID":"SPDXRef-DOCUMENT","packages":['], F.to_json(F.struct(F.concat(F.lit("SPDXRef-"), _id("ecosystem", "name", "version")).alias("SPDXID"), "name", version.alias("versionInfo"), declared.alias("licenseDeclared"), F.array(ref).alias("externalRefs"))), ",", ["]}"]
    raise ValueError(f"unknown report: {kind}")


KINDS = ("markdown", "html", "junit", "sarif", "stix", "vex", "cyclonedx", "spdx")


def lines_of(rows: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """The report as (part, line): part 0 first lines, 1 rows, 2 last lines. Rows keep their order columns, so the report is sorted by range partitions
    on executors. Each row but the first begins with the separator, so no task needs to know the last row."""
    first, row, between, last = rendered(rows, kind)
    spark = rows.sparkSession
    body = rows.select(F.lit(1).alias("part"), *[F.col(c).cast("string").alias(f"__o{i}") if c != "line" else F.lpad(F.col(c).cast("string"), 12, "0").alias(f"__o{i}") for i, c in enumerate(order)], row.alias("line"))
    ends = spark.createDataFrame([(0, f"{n:04}", x) for n, x in enumerate(first)] + [(2, f"{n:04}", x) for n, x in enumerate(last)], "part int, __o0 string, line string")
    out = body.unionByName(ends, allowMissingColumns=True)
    if between:  # the least row has none before it
        place = F.struct(*[f"__o{i}" for i in range(len(order))], "line")
        least = body.agg(F.min(place)).scalar()
        out = out.withColumn("line", F.when((F.col("part") == 1) & ~place.eqNullSafe(least), F.concat(F.lit(between), F.col("line"))).otherwise(F.col("line")))
    return out.orderBy("part", *[f"__o{i}" for i in range(len(order))]).select("part", "line")


def write_report(rows: DataFrame, path: str, kind: str, order: list[str]) -> None:
    """Sorted text files; read in the order of their names they are the report. Rows should be distinct in their order columns."""
    lines_of(rows.dropDuplicates(order), kind, order).select("line").write.text(path)


def manifest_components(files: DataFrame) -> DataFrame:
    """path, ecosystem, name, version, direct of the dependencies in manifests among files (path, content): package.json, requirements*.txt, go.mod,
    go.sum, pom.xml, Cargo.lock, conan.lock and vcpkg.json. What doesn't parse gives no rows."""
    base = files.filter("content is not null").select("path", "content", F.element_at(F.split("path", "/"), -1).alias("file"))

    def found(kind: Column, ecosystem: str, pattern: str, text: Column | str = "content", name: int = 1, version: int = 2, direct: bool = True) -> DataFrame:
        spots = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        rows = base.filter(kind).select("path", F.explode(spots).alias("spot"))
        return rows.select("path", F.lit(ecosystem).alias("ecosystem"), F.regexp_extract("spot", pattern, name).alias("name"), F.regexp_extract("spot", pattern, version).alias("version"), F.lit(direct).alias("direct"))

    file = F.col("file")
    node = base.filter(file == "package.json").select("path", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>, optionalDependencies map<string,string>").alias("j"))
    node = node.select("path", F.explode(F.map_zip_with(F.coalesce("j.dependencies", F.create_map().cast("map<string,string>")), F.map_zip_with(F.coalesce("j.devDependencies", F.create_map().cast("map<string,string>")), F.coalesce("j.optionalDependencies", F.create_map().cast("map<string,string>")), lambda _, a, b: F.coalesce(a, b)), lambda _, a, b: F.coalesce(a, b))).alias("name", "version"))
    vcpkg = base.filter(file == "vcpkg.json").select("path", F.explode(F.from_json("content", "dependencies array<string>")["dependencies"]).alias("item"))
    vcpkg = vcpkg.select("path", F.lit("vcpkg").alias("ecosystem"), F.when(F.col("item").startswith("{"), F.get_json_object("item", "$.name")).otherwise(F.col("item")).alias("name"), F.when(F.col("item").startswith("{"), F.get_json_object("item", r"$['version>=']")).alias("version"), F.lit(True).alias("direct"))
    parts = [
        node.select("path", F.lit("npm").alias("ecosystem"), "name", F.regexp_replace("version", r"^[\^~>=<v\s]+", "").alias("version"), F.lit(True).alias("direct")),
        found(file.rlike(r"^requirements.*\.txt$"), "pypi", r"(?m)^[ \t]*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?[ \t]*(?:==[ \t]*([A-Za-z0-9.+!-]+))?"),
        found(file == "go.mod", "go", r"(?m)^(?:require[ \t]+|[ \t]+)([a-z0-9.-]+\.[a-z]+/[^\s]+)[ \t]+v([^\s]+)"),
        found(file == "go.sum", "go", r"(?m)^([^\s]+) v([^\s/]+) h1:\S+", direct=False),
        found(file == "pom.xml", "maven", r"(?s)<dependency>(?:(?!</dependency>).)*?<groupId>\s*([^<\s]+)\s*</groupId>\s*<artifactId>\s*([^<\s]+)\s*</artifactId>(?:(?!</dependency>).)*?</dependency>").select("path", "ecosystem", F.concat_ws(":", "name", "version").alias("name"), F.lit(None).cast("string").alias("version"), "direct"),
        found(file == "Cargo.lock", "cargo", r'\[\[package\]\]\s*name = "([^"]+)"\s*version = "([^"]+)"', direct=False),
        found(file == "conan.lock", "conan", r'"([a-z0-9_.+-]+)/([A-Za-z0-9_.+-]+)(?:[@#%][^"]*)?"', direct=False),
        vcpkg,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("name <> ''").dropDuplicates(["path", "ecosystem", "name", "version"])


def report_sizes(spark, d: str) -> DataFrame:
    """Lines of each report over all secret and personal-data findings, which are found once; and a sum over hashes of the lines of the formats that aren't JSON."""
    from gritstone.operators.graph import written
    from gritstone.operators.scan import line_findings
    from gritstone.sources.tables import table

    rows = written(line_findings(table(spark, d, "documents")).dropDuplicates(["path", "line", "rule"]), "report-rows")
    digest = F.sum(F.conv(F.substring(F.md5("line"), 1, 8), 16, 10).cast("long"))
    parts = [lines_of(rows, k, ["path", "line", "rule"]).groupBy("part").agg(F.count("*").alias("lines"), (digest if k in KINDS[:3] else F.lit(None).cast("long")).alias("digest")).withColumn("kind", F.lit(k)) for k in KINDS[:6]]
    return reduce(DataFrame.unionByName, parts)
