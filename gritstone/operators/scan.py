"""Scans: line rules, whole-file rules, tokens, windows of rules, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.sources.tables import spread, table

#: Rule, pattern (also valid in RE2), severity, shape.
RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z.]{2,}", "medium", "pii"),
    ("ipv4", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "low", "pii"),
    ("phone", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", "medium", "pii"),
    ("key_value", r"(password|secret|token|api_?key) *[:=] *\"?[A-Za-z0-9+/_.=-]{12,}", "critical", "secret"),
    ("license", r"[Ll]icensed under", "info", "license"),
)


def lines(docs: DataFrame) -> DataFrame:
    """path, lang, line (from 1), snippet of each line."""
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")
    return docs.select(path, "lang", F.posexplode(F.split("text", "\n", -1)).alias("at", "snippet")).select("path", "lang", (F.col("at") + 1).alias("line"), "snippet")


def line_findings(docs: DataFrame, rules=RULES) -> DataFrame:
    """path, lang, line, rule, severity, shape, snippet. The rules are a few constants, so each line makes an array of its
    hits in one pass; one alternation over all rules is tried first."""
    any_rule = "|".join(f"(?:{p})" for _, p, _, _ in rules)
    hits = F.array(*[F.when(F.col("snippet").rlike(p), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.lit(k).alias("shape"))) for r, p, s, k in rules])
    rows = lines(docs.filter(F.col("text").rlike(any_rule))).filter(F.col("snippet").rlike(any_rule))
    return rows.select("path", "lang", "line", F.explode(F.array_compact(hits)).alias("hit"), "snippet").select("path", "lang", "line", "hit.*", "snippet")


def secret_pii_findings(spark: SparkSession, d: str) -> DataFrame:
    return line_findings(table(spark, d, "documents")).groupBy("lang", "rule", "severity").agg(F.count("*").alias("findings"), F.countDistinct("path").alias("files"))


def line_findings_stable_id(spark: SparkSession, d: str) -> DataFrame:
    rows = line_findings(table(spark, d, "documents"))
    rows = rows.withColumn("stable_id", T.stable_id(F.col("rule"), F.col("snippet"), F.col("shape"), F.col("path")))
    return rows.groupBy("stable_id").agg(F.min("rule").alias("rule"), F.min("path").alias("path"), F.min("line").cast("long").alias("line"), F.count("*").alias("copies"))


def secret_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, token, entropy of the tokens in docs (doc_id, text) that look like secrets. Bits are counted once, where the text is read: what the
    ``distinct`` gathers is small, so few tasks follow it."""
    tokens = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{24,}"), F.lit(0))), T.secret_shape)
    rows = docs.select("doc_id", F.explode(F.transform(tokens, lambda t: F.struct(t.alias("token"), T.entropy(t).alias("bits")))).alias("t"))
    return rows.filter(F.col("t.bits") >= T.ENTROPY_BITS).select("doc_id", "t.token", F.round("t.bits", 6).alias("entropy")).distinct()


def entropy_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Each part as a settings line whose value is base64, hex, or of few characters; and all documents, whose long tokens are hex."""
    h = F.sha2(F.col("p_partkey").cast("string"), 256)
    value = F.when(F.col("p_size") % 3 == 0, F.base64(F.unhex(h))).when(F.col("p_size") % 3 == 1, h).otherwise(F.repeat(F.lit("ab"), F.lit(14)))
    settings = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select((-F.col("p_partkey")).alias("doc_id"), F.concat(F.lit('key = "'), value, F.lit('"')).alias("text"))
    return secret_tokens(settings.unionByName(table(spark, d, "documents").select("doc_id", "text")))


def redaction_counts(spark: SparkSession, d: str) -> DataFrame:
    text, counts = T.redact(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", *[c.alias(f"n_{k}") for k, c in counts.items()], F.char_length(text).cast("long").alias("redacted_chars"))
    return rows.filter(" + ".join(f"n_{k}" for k in counts) + " > 0")


def html_rule_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pages with an inline script and no content security policy."""
    rows = table(spark, d, "pages").filter(F.col("html").rlike("<script[^>]*>") & ~F.lower("html").contains("content-security-policy"))
    return rows.select("page_id", F.regexp_count("html", F.lit("<script")).cast("long").alias("scripts"), F.regexp_count("html", F.lit("on(click|load|error)=")).cast("long").alias("handlers"))


def url_path_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Pages by canonical path; paths that several hosts serve."""
    pages = table(spark, d, "pages").select("page_id", T.route_path(F.col("url")).alias("route"), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"))
    return pages.groupBy("route").agg(F.count("*").alias("pages"), F.countDistinct("host").alias("hosts"), F.min("page_id").alias("first_page"))


def custom_rule_window(spark: SparkSession, d: str, anchor: str = "[Ll]icensed under", other: str = "[0-9]{3,}", near: int = 5) -> DataFrame:
    """Files whose first line with ``anchor`` has a line with ``other`` at most ``near`` lines away."""
    rows = lines(table(spark, d, "documents")).withColumn("a", F.col("snippet").rlike(anchor)).withColumn("o", F.col("snippet").rlike(other))
    by = Window.partitionBy("path")
    rows = rows.filter("a or o").withColumn("first", F.min(F.when(F.col("a"), F.col("line"))).over(by)).filter("o and abs(line - first) <= " + str(near))
    return rows.groupBy("path").agg(F.min("first").cast("long").alias("anchor_line"), F.count("*").alias("near_lines"))


def contamination_match(spark: SparkSession, d: str, words: int = 8) -> DataFrame:
    return passages_held(table(spark, d, "documents"), table(spark, d, "benchmark"), words)


def passages_held(docs: DataFrame, items: DataFrame, words: int = 8) -> DataFrame:
    """doc_id, item_id of documents that hold an item's whole word sequence, case aside. A hash join on the item's first ``words`` words
    (all of a shorter one) makes the candidates; those are compared over the item's length."""
    split = lambda c: F.filter(F.split(F.lower(c), r"[ \t\r\n]+"), lambda w: w != "")
    items = items.withColumn("w", split(F.col("text"))).filter(F.size("w") > 0).select("item_id", F.array_join(F.slice("w", 1, words), " ").alias("gram"), F.array_join("w", " ").alias("item"), F.least(F.size("w"), F.lit(words)).alias("n"))
    widths = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most ``words`` numbers
    docs = docs.withColumn("w", split(F.col("text"))).select("doc_id", "w")
    at = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))
    grams = docs.select("doc_id", F.explode(F.concat(F.array().cast("array<string>"), *[at(n) for n in widths])).alias("gram"))
    likely = grams.join(items, "gram").select("doc_id", "item_id", "item").distinct()
    whole = docs.select(F.col("doc_id").alias("held_by"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("whole"))
    both = likely.join(whole, likely["doc_id"].eqNullSafe(whole["held_by"]))
    # marks may follow the last word without a blank, letters and digits may not
    item = F.concat(F.lit(r" \Q"), F.replace(F.col("item"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E((?<![\p{L}\p{N}])|(?![\p{L}\p{N}]))"))
    return both.filter(F.regexp_like("whole", item)).select("doc_id", "item_id").distinct()


def code_imports(files: DataFrame) -> DataFrame:
    """path, module of the imports of Python sources, from their syntax trees; files that don't parse give none."""
    import ast
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError):
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, ast.Import):
                        found += [(path, a.name) for a in node.names]
                    elif isinstance(node, ast.ImportFrom) and node.module:
                        found.append((path, node.module))
            yield pd.DataFrame(found, columns=["path", "module"])

    return files.select("path", "content").mapInPandas(run, "path string, module string")
