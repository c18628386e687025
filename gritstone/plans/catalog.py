"""Named queries of the engine and SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gritstone.operators import findings, flow, graph, rules, scan
from gritstone.plans import content, posture
from gritstone.plans.dialect import spark_query, spell
from gritstone.plans.statements import FINDINGS, STATEMENTS
from gritstone.sources import reports
from gritstone.streaming import state

_LINES = "(select source || '/' || doc_id as path, lang, unnest(string_split(text, chr(10))) as snippet, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_HITS = " union all ".join(f"select path, lang, line, snippet, '{r}' as rule, '{s}' as severity, '{k}' as shape from {_LINES} l where regexp_matches(snippet, {_q(p)})" for r, p, s, k in scan.RULES)
_EDGES = "(select 'n' || c_nationkey as src, 'c' || c_custkey as dst from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders union all select distinct 'o' || l_orderkey, 'p' || l_partkey from lineitem)"


def _up(x: str, digits: int) -> str:
    return f"cast(round(cast({x} as decimal(28, 9)), {digits}) as double)"


_SCORES = f"""
    with f as (select *, status = 'O' as open_, status = 'F' as done, price >= 400000 as dear, price < 50000 as guarded from {FINDINGS} x),
    a as (select *, case severity when 'critical' then 0.8e0 when 'high' then 0.65e0 when 'medium' then 0.4e0 when 'low' then 0.2e0 else 0.1e0 end
      + case when open_ and dear then 0.2e0 when open_ then 0.1e0 when done then -0.2e0 else 0e0 end - case when guarded then 0.15e0 else 0e0 end as s from f),
    e as (select *, {_up("least(1e0, greatest(0e0, case when owner % 97 = 0 then greatest(s, 0.92e0) else s end - case when owner % 2 = 0 then 0.05e0 else 0e0 end))", 2)} as exploit,
      {_up("least(1e0, greatest(0e0, (case severity when 'critical' then 0.85e0 when 'high' then 0.75e0 when 'medium' then 0.55e0 when 'low' then 0.35e0 else 0.2e0 end + case when dear then 0.12e0 else 0.1e0 end + case when open_ then 0.05e0 else 0e0 end) * case when guarded then 0.8e0 else 1e0 end * case when done then 0.55e0 else 1e0 end))", 3)} as sure from a),
    r as (select *, exploit * 100 * case when done then 0.4e0 else 1e0 end + least(15e0, price / 50000) as base from e),
    k as (select *, cast({_up("least(100e0, greatest(0e0, case when owner % 89 = 0 then greatest(base, 75e0) else base end))", 0)} as int) as risk,
      cast({_up("exploit * case when owner % 3 = 0 then 250000 when owner % 7 = 0 then 500000 when dear then 300000 else 50000 end * case when open_ then 0.9e0 when done then 0.05e0 else 0.3e0 end * greatest(0.4e0, sure)", 0)} as bigint) as loss from r)
    select id, exploit, case when exploit >= 0.8 then 'critical' when exploit >= 0.6 then 'high' when exploit >= 0.35 then 'medium' else 'low' end as tier, risk,
      case when risk >= 85 then 'critical' when risk >= 65 then 'high' when risk >= 35 then 'medium' when risk >= 15 then 'low' else 'minimal' end as risk_tier, sure, loss,
      case when owner % 4 = 3 then 'WAIT_FOR_PATCH' when owner % 97 = 0 and open_ then case when owner % 4 in (1, 2) then 'AUTO_MERGE_PATCH' else 'MANUAL_REVIEW' end when done then 'ACCEPT_RISK' when owner % 4 = 0 then 'MANUAL_REVIEW'
        when owner % 4 = 2 and severity in ('high', 'critical') then 'AUTO_MERGE_PATCH' when owner % 4 = 1 and severity = 'critical' then 'AUTO_MERGE_PATCH' else 'MANUAL_REVIEW' end as verdict from k"""
#: name: (query, SQL or None)
FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "secret_pii_findings": (scan.secret_pii_findings, f"select lang, rule, severity, count(*) as findings, count(distinct path) as files from ({_HITS}) h group by lang, rule, severity"),
    "html_rule_scan": (scan.html_rule_scan, "select page_id, len(regexp_extract_all(html, '<script')) as scripts, len(regexp_extract_all(html, 'on(click|load|error)=')) as handlers from pages where regexp_matches(html, '<script[^>]*>') and not contains(lower(html), 'content-security-policy')"),
    "url_path_normalize": (
        scan.url_path_normalize,
        "with p as (select page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) as host, regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/]*', ''), '[?#].*$', ''), '^/+|/+$', '', 'g') as path from pages), "
        "r as (select page_id, host, '/' || array_to_string(list_transform(string_split(path, '/'), lambda s: case when regexp_matches(s, '^(:.*|\\{.*\\}|<.*>|\\*|\\$\\{.*\\}|[0-9]+)$') then '*' else lower(s) end), '/') as route from p) "
        "select route, count(*) as pages, count(distinct host) as hosts, min(page_id) as first_page from r group by route",
    ),
    "custom_rule_window": (
        scan.custom_rule_window,
        f"with l as (select path, line, regexp_matches(snippet, '[0-9]{{3,}}') as o, min(case when regexp_matches(snippet, '[Ll]icensed under') then line end) over (partition by path) as first from {_LINES} x) "
        "select path, min(first) as anchor_line, count(*) as near_lines from l where o and abs(line - first) <= 5 group by path",
    ),
    "asof_previous_event": (
        findings.asof_previous_event,
        "select e.event_id, (select max_by(s.event_id, (s.ts, s.event_id)) from events s where s.user_id = e.user_id and s.event_type = 'signup' and s.ts <= e.ts) as signup from events e where e.event_type = 'purchase'",
    ),
    "reach_closure": (
        graph.reach_closure,
        f"with recursive r as (select 'n' || n_nationkey as node, 0 as depth from nation where n_regionkey = 1 union select dst, depth + 1 from r join {_EDGES} e on src = node where depth < 12) select node, cast(min(depth) as bigint) as depth from r group by node",
    ),
    "connected_areas": (
        graph.connected_areas,
        "with c as (select distinct s_nationkey - s_nationkey % 3 as comp, s_nationkey as node from supplier union select s_nationkey - s_nationkey % 3, s_nationkey - s_nationkey % 3 from supplier), s as (select comp, count(*) as nodes from c group by comp), "
        "r as (select *, row_number() over (order by nodes desc, comp) as rank_no, count(*) over () as n from s) select case when n > 8 and rank_no > 7 then 'misc' else cast(comp as varchar) end as area, cast(sum(nodes) as bigint) as nodes, count(*) as components from r group by 1",
    ),
    "sink_slice_depth": (
        graph.sink_slice_depth,
        f"with recursive r as (select 'o' || o_orderkey as node, 0 as depth from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' and o_totalprice > 200000 union select src, depth + 1 from r join {_EDGES} e on dst = node where depth < 12), "
        "m as (select node, min(depth) as depth from r group by node) select cast(depth as bigint) as depth, count(*) as nodes from m group by depth",
    ),
    "taint_flows": (
        findings.taint_flows,
        "with recursive f as (select 'n' || c_nationkey as src, 'c' || c_custkey as dst, c_mktsegment = 'BUILDING' as san, c_acctbal < 0 as cut from customer union all select 'c' || o_custkey, 'o' || o_orderkey, false, false from orders), "
        "t as (select 'n' || n_nationkey as source, 'n' || n_nationkey as node, false as sanitized from nation where n_regionkey = 3 union select source, dst, sanitized or san from t join f on src = node where not cut) "
        "select sanitized, count(*) as flows from t join orders on node = 'o' || o_orderkey where o_orderstatus = 'F' group by sanitized",
    ),
    "stream_event_windows": (state.stream_event_windows, "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2"),
    "triage_sync": (
        state.triage_sync,
        # a user is open on the days that see them, fixed on the first day after that doesn't; opened is the first day
        "with s as (select distinct date_diff('day', date '2024-01-01', cast(ts as date)) as scan, user_id as id from events where event_type = 'error'), d as (select distinct scan from s), "
        "u as (select id, min(scan) as opened, min(scan) as first from s group by id), g as (select id, min(d.scan) as gone from u join d on d.scan > opened where not exists (select 1 from s where s.id = u.id and s.scan = d.scan) group by id) "
        "select case when gone is null then 'open' else 'fixed' end as state, opened, count(*) as n from u left join g on g.id = u.id group by 1, 2",
    ),
    "triage_state": (
        state.triage_state,
        "select user_id, case when arg_max(event_type, (ts, event_id)) = 'error' then 'open' else 'fixed' end as state, count(*) filter (event_type = 'error') as errors, max(event_id) as last_event from events where event_type in ('error', 'purchase') group by user_id",
    ),
    "session_windows": (
        findings.session_windows,
        "with g as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts, event_id) >= ts - interval 6 hour then 0 else 1 end as new from events), s as (select user_id, sum(new) over (partition by user_id order by ts rows unbounded preceding) as sid from g) "
        "select user_id, count(*) as events_, count(distinct sid) as sessions from s group by user_id",
    ),
    "ifds_sinks": (
        flow.ifds_sinks,
        "with l as (select l_orderkey as o, l_linenumber as n, l_partkey as p, l_returnflag as r, l_quantity as q, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_returnflag, l_quantity) as rn from lineitem), u as (select * from l where rn = 1) "
        "select 'o' || s.o as qid, cast(s.n as bigint) as node, 'y' || (s.n - 1) as fact from u s join u c on c.o = s.o and c.n = s.n - 1 join u f on f.o = s.o and f.n = 1 join part on p_partkey = c.p where s.n > 2 and s.q >= 45 and c.q < 45 and f.r = 'R' and p_size <= 25",
    ),
    "points_to_classes": (flow.points_to_classes, "select min('s' || s_suppkey) as comp, count(*) as names from supplier group by s_nationkey union all select min('v' || s_suppkey), count(*) from supplier group by s_nationkey"),
    "dominator_tree": (flow.dominator_tree, None),  # tests hold it against reachability without each node
    "call_resolution": (
        flow.call_resolution,
        "with f as (select p_brand as file, p_name || ' ' || p_size as name, p_partkey as qid from part), near as (select file, name, min(qid) as q, count(*) as n from f group by all), far as (select name, min(qid) as q, count(*) as n from f group by all), "
        "c as (select 'Brand#' || (l_suppkey % 5 + 1) as file, p_name || ' ' || p_size as name from lineitem join part on l_partkey = p_partkey), "
        "r as (select c.file, case when near.n = 1 then near.q when near.n is null and far.n = 1 then far.q end as callee from c left join near on near.file = c.file and near.name = c.name left join far on far.name = c.name) "
        "select file, count(*) as calls, count(callee) as resolved, cast(sum(callee) as bigint) as sum_callee from r group by file",
    ),
    "invalidated_callers": (
        flow.invalidated_callers,
        "with n as (select n_nationkey from nation where n_regionkey = 2), c as (select c_custkey from customer join n on c_nationkey = n_nationkey), k as (select 'n' as kind from n union all select 'c' from c union all select 'o' from orders join c on o_custkey = c_custkey) select kind, count(*) as functions from k group by kind",
    ),
    "class_methods": (
        flow.class_methods,
        "with k as (select case when c_acctbal < 0 then 'c' || c_custkey when n_regionkey = 1 then 'n' || n_nationkey else 'r' || n_regionkey end as owner from customer join nation on c_nationkey = n_nationkey "
        "union all select case when n_regionkey = 1 then 'n' || n_nationkey else 'r' || n_regionkey end from nation union all select distinct 'r' || n_regionkey from nation) select owner, count(*) as classes from k group by owner",
    ),
    "custom_rule_findings": (
        rules.custom_rule_findings,
        f"with l as (select path, lang, line, regexp_matches(snippet, '[Ll]icensed under') as lic, regexp_matches(snippet, '[0-9]{{3,}}') as num, regexp_matches(snippet, '(password|secret|token) *[:=]') as sec, regexp_matches(snippet, '[a-z]+@[a-z]+\\.') as mail from {_LINES} x), "
        "f as (select path, min(line) as line from l where lic group by path) "
        "select 'license-dated' as rule, path, line, 'info' as severity, false as shadow from f where exists (select 1 from l where l.path = f.path and num and abs(l.line - f.line) <= 3) "
        "union all select 'secret-line', path, line, 'critical', false from l where sec and path not in (select path from f) union all select 'mail-en', path, line, 'low', true from l where mail and lang = 'en'",
    ),
    "policy_rego": (
        rules.policy_rego,
        f"select id, 'finding ' || id || ' of ' || owner as msg from {FINDINGS} f where severity = 'critical' and status = 'O' and price >= 300000 union all select id, 'large and high' from {FINDINGS} f where severity = 'high' and status <> 'F' and price > 400000",
    ),
    "finding_scores": (rules.finding_scores, _SCORES),
    "stream_alerts": (state.stream_alerts, "select distinct 'A' || user_id as advisory, event_type as ecosystem from events where value > 50"),
}


_ALL = FRAMES | content.QUERIES | posture.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in _ALL.items()} | {n: spark_query(s) for n, s in STATEMENTS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _ALL.items() if s} | {n: spell(s, duck=True) for n, s in STATEMENTS.items()}
