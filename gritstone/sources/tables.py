"""Sources: the engine's tables, files as relations, and tolerant readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MAX_FILE_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by a key over four tasks a core. A small file of many rows is read by one task, which would do all the work that follows."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Register the tables that a statement names."""
    for name in NAMES:
        if name in sql:
            table(spark, sf_dir, name).createOrReplaceTempView(name)


#: Folders that a scan leaves out, and extensions that it reads.
IGNORED = "node_modules .git __pycache__ vendor dist build .next venv env .venv target bin obj .cache coverage bower_components tests test __tests__ spec mocks".split()
CODE = "js jsx ts tsx mjs cjs py java kt php phtml go rb cs c h cc cpp hpp rs swift dart sol tf".split()


def files(spark: SparkSession, root: str, ignore: list[str] | None = None, glob: str = "*", max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path, content, size, sha256 of the text files under root; large files and those in ignored folders (below root) are left out before they are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    below = F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/") + r"\E/", "/")
    folders = "|".join(x.replace(".", r"\.") for x in (IGNORED if ignore is None else ignore))
    rows = rows.filter((F.col("length") <= max_bytes) & ~below.rlike(f"/({folders})/"))
    return rows.select("path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSONL; rows that don't parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def admitted(files: DataFrame) -> DataFrame:
    """files (path, content) that a scan reads, with kind: code by extension, manifests of clusters by what they hold, and properties as auxiliary files."""
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    cluster = extension.isin("yaml", "yml") & F.col("content").rlike(r"(?m)^apiVersion:") & F.col("content").rlike(r"(?m)^kind:")
    kind = F.when(extension.isin(CODE) | cluster, "code").when(extension == "properties", "auxiliary")
    return files.withColumn("kind", kind).filter("kind is not null")


def os_packages(files: DataFrame) -> DataFrame:
    """name and version of installed packages from status files (stanzas between blank lines), of dpkg or of apk."""
    stanza = files.select("path", F.explode(F.split("content", r"\n\s*\n")).alias("s"))
    field = lambda k: F.regexp_extract("s", rf"(?m)^(?:{k}):\s*(\S+)", 1)
    return stanza.select("path", field("Package|P").alias("name"), field("Version|V").alias("version")).filter("name <> ''")


def binary_components(spark: SparkSession, root: str) -> DataFrame:
    """path, ecosystem, name, version of what archives and programs say of themselves: the title and version of a JAR's manifest, and modules of a Go program's build
    information. A file that can't be read gives none."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path, *r) for path, data in zip(pdf["path"], pdf["content"], strict=True) for r in _said(path, bytes(data))]
            yield pd.DataFrame(rows, columns=["path", "ecosystem", "name", "version"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content").mapInPandas(run, "path string, ecosystem string, name string, version string")


def _said(path: str, data: bytes) -> list[tuple[str, str, str]]:
    import io
    import re
    import zipfile

    if data[:2] == b"PK":
        try:
            text = zipfile.ZipFile(io.BytesIO(data)).read("META-INF/MANIFEST.MF").decode("utf-8", "replace")
        except (zipfile.BadZipFile, KeyError, OSError):
            return []
        text = re.sub(r"\r?\n ", "", text)  # lines that go on
        field = lambda *names: next((m[1].strip() for n in names if (m := re.search(rf"(?m)^{n}:(.*)$", text))), None)
        name = field("Implementation-Title", "Bundle-SymbolicName", "Automatic-Module-Name")
        return [("maven", name, field("Implementation-Version", "Bundle-Version") or "")] if name else []
    if b"\xff Go buildinf:" in data:
        found = re.findall(rb"(?:mod|dep)\t([^\t\n]+)\tv?([^\t\n]+)", data)
        return [("go", n.decode("utf-8", "replace"), v.decode("utf-8", "replace")) for n, v in found]
    return []


def config(text: str):
    """What a configuration file holds, as dicts, lists and scalars: block maps and lists by indentation, inline lists, quoted and plain scalars, comments. It is read
    on the driver: rules, suppressions and policies are configuration. Anything else raises ValueError."""
    lines = []
    for raw in text.split("\n"):
        line = _without_comment(raw).rstrip()
        if line.strip():
            lines.append((len(line) - len(line.lstrip()), line.strip()))
    value, at = _block(lines, 0, lines[0][0]) if lines else (None, 0)
    if at != len(lines):
        raise ValueError(f"line not understood: {lines[at][1]}")
    return value


def _without_comment(line: str) -> str:
    quote = None
    for i, c in enumerate(line):
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


def _scalar(text: str):
    if text[:1] == "[" and text[-1:] == "]":
        return [_scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def _block(lines: list[tuple[int, str]], at: int, indent: int):
    """(value, next line) of the block that begins at a line of that indentation."""
    if lines[at][1].startswith("- ") or lines[at][1] == "-":
        out = []
        while at < len(lines) and lines[at][0] == indent and (lines[at][1].startswith("- ") or lines[at][1] == "-"):
            rest = lines[at][1][1:].strip()
            if ": " in rest and rest[0] not in "'\"[" or rest.endswith(":"):  # a map that begins beside the dash
                inner = indent + len(lines[at][1]) - len(rest)
                lines[at] = (inner, rest)
                value, at = _block(lines, at, inner)
            elif rest:
                value, at = _scalar(rest), at + 1
            else:
                value, at = _block(lines, at + 1, lines[at + 1][0])
            out.append(value)
        return out, at
    out = {}
    while at < len(lines) and lines[at][0] == indent:
        key, colon, rest = lines[at][1].partition(":")
        if not colon:
            raise ValueError(f"line not understood: {lines[at][1]}")
        at += 1
        if rest.strip():
            out[key.strip()] = _scalar(rest.strip())
        elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("-")):
            out[key.strip()], at = _block(lines, at, lines[at][0])
        else:
            out[key.strip()] = None
    return out, at


def write(findings: DataFrame, path: str, kind: str) -> None:
    """Sinks: json, jsonl, csv, parquet, or sarif-like nested rows."""
    if kind == "sarif":
        location = F.struct(F.col("path").alias("uri"), F.struct(F.col("line").alias("startLine")).alias("region"))
        findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), F.col("severity").alias("level"), F.col("snippet").alias("message"), F.array(location).alias("locations"))).alias("value")).write.text(path)
    elif kind in ("json", "jsonl"):
        findings.write.json(path)
    elif kind == "csv":
        findings.write.csv(path, header=True)
    else:
        findings.write.parquet(path)
