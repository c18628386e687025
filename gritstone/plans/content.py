"""Queries over texts and logs whose SQL spells the operator out: stable ids, redaction, tokens, passages, bands, reports, audit chains, bundles, licenses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.operators import enrich, findings, rules, scan
from gritstone.plans.statements import SEV
from gritstone.sources import reports
from gritstone.sources.tables import table


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_LINES = "(select source || '/' || doc_id as path, lang, unnest(string_split(text, chr(10))) as snippet, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)"
_HITS = "(" + " union all ".join(f"select path, lang, line, snippet, '{r}' as rule, '{s}' as severity, '{k}' as shape from {_LINES} l where regexp_matches(snippet, {_q(p)})" for r, p, s, k in scan.RULES) + ")"
_ONE_LITERAL = "|".join(rf"{q}(?:[^\\\x01]|\\[^\n\r])*?{q}" for q in ("'", '"', "`"))
_NORMAL = f"substr(trim(regexp_replace(regexp_replace(regexp_replace(lower(snippet), {_q(_ONE_LITERAL)}, '''_S_''', 'g'), '\\s+', ' ', 'g'), '[ ,;]+$', '')), 1, 200)"
_HINT = "array_to_string(list_filter(string_split(path, '/'), lambda p: p <> '')[-2:], '/')"
STABLE_SQL = f"select substr(sha256(rule || '|' || {_NORMAL} || '|' || shape || '|' || {_HINT}), 1, 16) as stable_id, min(rule) as rule, min(path) as path, min(line) as line, count(*) as copies from {_HITS} h group by 1"


def _entropy(s: str) -> str:
    k = f"(length({s}) - length(replace({s}, c, '')))"
    return f"-list_sum(list_transform(list_distinct(string_split({s}, '')), lambda c: {k} / cast(length({s}) as double) * log2({k} / cast(length({s}) as double))))"


def _secret(s: str) -> str:
    return f"length({s}) >= 24 and regexp_full_match({s}, '[A-Za-z0-9+/_=-]+') and not regexp_full_match({s}, '[0-9a-fA-F]+') and {_entropy(s)} >= 4.0"


ENTROPY_SQL = f"""
  with s as (select -p_partkey as doc_id, 'key = "' || case p_size % 3 when 0 then to_base64(unhex(sha256(cast(p_partkey as varchar)))) when 1 then sha256(cast(p_partkey as varchar)) else repeat('ab', 14) end || '"' as text from part union all select doc_id, text from documents),
  t as (select distinct doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/_=-]{{24,}}')) as token from s) select doc_id, token, round({_entropy('token')}, 6) as entropy from t where {_secret('token')}"""


def _redaction_sql() -> str:
    names, text, counts = "|".join(T.SECRET_NAMES), "text", []
    for name, pattern, put in (("pem", T.PEM, r"\1" + "\n" + T.REDACTED + "\n" + r"\2"), ("connection", T.CONNECTION, rf"\1{T.REDACTED}\3"), ("bearer", T.BEARER, f"Bearer {T.REDACTED}")):
        counts.append((f"n_{name}", f"len(regexp_extract_all({text}, {_q(pattern)}))"))
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(put)}, 'g')"
    sums = []
    for q in ("'", '"', "`"):
        pattern = rf"(?i)(\b(?:{names})\b)(\s*[:=]\s*){q}([^'\"`]+){q}"
        sums.append(f"len(regexp_extract_all({text}, {_q(pattern)}))")
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(rf'\1\2{q}{T.REDACTED}{q}')}, 'g')"
    counts.append(("n_key_value", " + ".join(sums)))
    inner = "substr(x, 2, length(x) - 2)"
    steps = f"select doc_id, {', '.join(f'cast({c} as bigint) as {n}' for n, c in counts)}, {text} as t from documents"
    held = f"select *, list_filter(regexp_extract_all(t, {_q(T.QUOTED)}), lambda x: {_secret(inner)}) as found from ({steps}) a"
    return f"""select doc_id, {', '.join(n for n, _ in counts)}, cast(len(found) as bigint) as n_literal, length(t) - coalesce(list_sum(list_transform(found, lambda x: length(x) - 2 - {len(T.REDACTED)})), 0) as redacted_chars
      from ({held}) b where {' + '.join(n for n, _ in counts)} + len(found) > 0"""


PASSAGE_SQL = r"""
  with d as (select doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda w: w <> ''), ' ') || ' ' as whole from documents), b as (select item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda w: w <> ''), ' ') as item from benchmark)
  select distinct doc_id, item_id from d join b on item <> '' and contains(whole, ' ' || item) and (regexp_matches(whole, ' \Q' || item || '\E[^\p{L}\p{N}]') or not regexp_matches(right(item, 1), '[\p{L}\p{N}]'))"""
_OURS = "(select event_id, user_id as file, cast(floor(epoch(ts) / 600) as bigint) as line from events where event_type in ('error', 'view'))"
_THEIRS = "(select event_id as other, user_id as file, cast(floor(epoch(ts) / 600) as bigint) as spot from events where event_type in ('click', 'purchase'))"
BAND_SQL = f"""
  with m as (select event_id, other, spot - line as line_offset, row_number() over (partition by event_id order by spot - line, other) as rn from {_OURS} a join {_THEIRS} b on a.file = b.file and spot - line between -2 and 2), k as (select * from m where rn = 1)
  select a.event_id, k.other, k.line_offset, case when k.other is null then 'ours_only' else 'both' end as side from {_OURS} a left join k on a.event_id = k.event_id
  union all select null, other, null, 'theirs_only' from {_THEIRS} b where other not in (select other from k)"""
WATCH_SQL = """
  with m as (select cast(ts as date) as day, user_id, case when event_id % 2 = 0 then 'added' else 'fixed' end as change from events where event_type = 'error' and (event_id % 2 = 0) <> (event_id % 3 = 0)),
  calm as (select day from m group by day having count(distinct user_id) <= 50) select day, change, count(*) as n from m where day in (select day from calm) group by 1, 2"""


def _report_sql() -> str:
    rows = f"(select distinct path, line, rule, severity, snippet from {_HITS} h)"
    cell = lambda c: f"replace(regexp_replace(cast({c} as varchar), '[\\r\\n]+', ' ', 'g'), '|', '\\|')"
    safe = lambda c: f"replace(replace(replace(replace(regexp_replace(cast({c} as varchar), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    lines = {
        "markdown": f"'| ' || {cell('severity')} || ' | ' || {cell('rule')} || ' | ' || {cell('path')} || ':' || line || ' | ' || {cell('snippet')} || ' |'",
        "html": "'<tr>' || " + " || ".join(f"'<td>' || {safe(c)} || '</td>'" for c in ("severity", "rule", "path", "line", "snippet")) + " || '</tr>'",
        "junit": f"""'<testcase classname="' || {safe('path')} || '" name="' || {safe('rule')} || ':' || line || '"><failure type="' || {safe('severity')} || '">' || {safe('snippet')} || '</failure></testcase>'""",
    }
    ends = {
        "markdown": (["| severity | rule | place | snippet |", "|---|---|---|---|"], []),
        "html": (["<!doctype html><meta charset=utf-8><title>Findings</title><table>", "<tr><th>severity<th>rule<th>path<th>line<th>snippet</tr>"], ["</table>"]),
        "junit": (['<?xml version="1.0" encoding="UTF-8"?>', '<testsuites><testsuite name="findings">'], ["</testsuite></testsuites>"]),
    }
    parts = []
    for kind in reports.KINDS[:6]:
        if kind in lines:
            body = [f"select 1 as part, {lines[kind]} as line from {rows} r"] + [f"select {2 * side} as part, {_q(x)} as line" for side in (0, 1) for x in ends[kind][side]]
            parts.append(f"select '{kind}' as kind, part, count(*) as lines, cast(sum(cast('0x' || substr(md5(line), 1, 8) as bigint)) as bigint) as digest from ({' union all '.join(body)}) x group by part")
        else:
            parts += [f"select '{kind}' as kind, 1 as part, count(*) as lines, cast(null as bigint) as digest from {rows} r having count(*) > 0", f"select '{kind}', 0, 1, null", f"select '{kind}', 2, 1, null"]
    return " union all ".join(parts)


def hash_chain_verify(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as audit logs: every line names the hash of the one before; some of those names, and some lines after they were named, were changed."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("prev", F.coalesce(F.lag(F.sha2("text", 256)).over(order), F.lit(rules.GENESIS)))
    k = F.col("conv_id") + F.col("turn")
    rows = rows.withColumn("prev", F.when(k % 7 == 0, "0").otherwise(F.col("prev"))).withColumn("text", F.when(k % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return rules.chain_breaks(rows, "conv_id", "turn", "text", "prev").select("conv_id", "turn")


CHAIN_SQL = "select conv_id, turn from (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as before from conversations) t where (conv_id + turn) % 7 = 0 or (conv_id + before) % 11 = 0"


def root_cause_bundle(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(SEV).alias("vuln"), (F.col("o_custkey") % 10).alias("sink"), F.expr(f"case when o_orderkey % 20 = 0 then array() when o_orderkey % 10 < case when {SEV} = 'critical' then 9 else 7 end then array('shared', 'own') else array(concat('v', o_orderkey)) end").alias("vars"))
    return enrich.bundles(rows)


BUNDLE_SQL = f"""
  with f as (select o_orderkey as id, {SEV} as vuln, o_custkey % 10 as sink from orders), g as (select vuln, sink, count(*) as n, count(*) filter (id % 20 <> 0) as w, count(*) filter (id % 20 <> 0 and id % 10 < case when vuln = 'critical' then 9 else 7 end) as k from f group by 1, 2)
  select vuln, sink, n, 'shared' as shared, k from g where n >= 3 and w >= 3 and k >= ceil(w * 0.8) and k >= 3"""


def license_one_hop(spark: SparkSession, d: str) -> DataFrame:
    components = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_name").like("%bolt%"), "GPL-3.0").when(F.col("p_name").like("%ring%"), "AGPL-3.0").when(F.col("p_size") > 5, "MIT").alias("license"))
    edges = table(spark, d, "lineitem").filter("l_discount > 0.05").select(F.col("l_partkey").alias("src"), (F.col("l_partkey") * 7 % 100 + 1).alias("dst"))
    return enrich.contaminated(components, edges)


LICENSE_SQL = """
  with c as (select p_partkey as id, case when p_name like '%bolt%' then 'GPL-3.0' when p_name like '%ring%' then 'AGPL-3.0' end as left_ from part), e as (select distinct l_partkey as src, l_partkey * 7 % 100 + 1 as dst from lineitem where l_discount > 0.05)
  select src, count(distinct b.left_) as licenses, count(*) as dependencies from e join c a on a.id = src and a.left_ is null join c b on b.id = dst and b.left_ is not null group by src"""

#: name: (query, SQL)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "line_findings_stable_id": (scan.line_findings_stable_id, STABLE_SQL),
    "entropy_tokens": (scan.entropy_tokens, ENTROPY_SQL),
    "redaction_counts": (scan.redaction_counts, _redaction_sql()),
    "contamination_match": (scan.contamination_match, PASSAGE_SQL),
    "tool_compare_band": (findings.tool_compare_band, BAND_SQL),
    "watch_delta": (findings.watch_delta, WATCH_SQL),
    "report_sizes": (reports.report_sizes, _report_sql()),
    "hash_chain_verify": (hash_chain_verify, CHAIN_SQL),
    "root_cause_bundle": (root_cause_bundle, BUNDLE_SQL),
    "license_one_hop": (license_one_hop, LICENSE_SQL),
}
