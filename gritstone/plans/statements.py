"""Relational queries as statements. Severity stands for order priority: urgent is critical, and so on; totals are made
exact (whole numbers or rounded), and every order is total."""

from __future__ import annotations

SEV = "case substr(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' when '5' then 'low' else 'info' end"
RANK = "case substr(o_orderpriority, 1, 1) when '1' then 0 when '2' then 1 when '3' then 2 when '5' then 3 else 4 end"
FINDINGS = f"(select o_orderkey as id, o_custkey as owner, {SEV} as severity, {RANK} as sev_rank, o_orderstatus as status, o_totalprice as price, o_orderdate as opened from orders)"
SCORED = "(select d.doc_id, lang, source, quality, toxic, least(99e-2, greatest(1e-2, n_chars / 4096e0)) as p from documents d join labels l on d.doc_id = l.doc_id where quality is not null)"

STATEMENTS: dict[str, str] = {
    # ---- projections and filters ----
    "normalize_channels": """
        select 'sast' as channel, o_orderkey as id, cast(null as varchar(40)) as package, 'medium' as default_severity from orders where o_orderstatus = 'P'
        union all select 'sca', p_partkey, p_brand, 'high' from part where p_type = 'SMALL'
        union all select 'secret', event_id, event_type, 'high' from events where event_type = 'error'""",
    "pack_filter": "select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey in (select p_partkey from part where p_brand in ('Brand#1', 'Brand#2') union select p_partkey from part where p_size = 7)",
    "severity_override": f"""
        select id, case when rule.n_name is not null then 'low' else severity end as severity, rule.n_name is not null as overridden
        from {FINDINGS} f join customer c on f.owner = c.c_custkey left join (select n_nationkey, n_name from nation where n_regionkey = 2) rule on rule.n_nationkey = c.c_nationkey
        where status <> 'F' or severity <> 'info'""",
    "policy_deny": f"""
        select id, concat('finding ', {{text(id)}}, ' is ', severity, ' and open') as msg from {FINDINGS} f
        where severity in ('critical', 'high') and status = 'O' and price >= 250000""",
    "exit_gate": f"select owner % 10 as team, case min(sev_rank) when 0 then 3 when 1 then 2 when 4 then 0 else 1 end as exit_code, count(*) as findings from {FINDINGS} f where status = 'O' group by owner % 10",
    "confidence_views": f"select case when p >= 0.9 then 'honest' when p >= 0.5 then 'default' else 'firehose' end as view_name, count(*) as findings from {SCORED} s group by 1",
    # ---- joins ----
    "enrich_best_match": """
        select l_orderkey, {top(l_partkey; price_key)} as partkey, max(p_retailprice) as best, max(p_retailprice) >= 1000 as exploited_now
        from (select l.l_orderkey, l.l_partkey, p.p_retailprice, p.p_retailprice * 10000000 - l.l_partkey as price_key from lineitem l left join part p on l.l_partkey = p.p_partkey) t group by l_orderkey""",
    "suppress_active": f"""
        select id, severity from {FINDINGS} f where not exists (select 1 from customer c where c.c_custkey = f.owner and c.c_mktsegment = 'BUILDING')
        and not (status = 'F' and {{days(opened; date '2001-08-02')}} > 365)""",
    "feedback_quorum": """
        with last_ones as (select *, row_number() over (order by ts desc, event_id desc) as rn from events),
        fp as (select user_id from last_ones where rn <= 500 and event_type = 'click' group by user_id having count(*) >= 2)
        select e.user_id, count(*) as kept from events e left join fp on e.user_id = fp.user_id where fp.user_id is null group by e.user_id""",
    "reverse_blast_radius": """
        select p_brand, count(distinct l_orderkey) as importers, count(distinct o_custkey) as owners, max(p_size) as max_crown
        from part join lineitem on p_partkey = l_partkey join orders on o_orderkey = l_orderkey group by p_brand""",
    "telemetry_confidence": """
        select event_type, n, case when n <= 0 then -8e-2 when n >= 1000 then 5e-2 else 0e0 end as delta from (select event_type, count(*) as n from events group by event_type) t""",
    "runtime_correlation": "select s_suppkey, exists (select 1 from lineitem l where l.l_suppkey = s.s_suppkey and l_returnflag = 'R') as observed from supplier s",
    "client_server_routes": """
        select c.l_orderkey as caller, s.p_brand as route, count(*) as calls from lineitem c join part s on c.l_partkey = s.p_partkey where c.l_quantity > 45 group by c.l_orderkey, s.p_brand""",
    "queue_producer_consumer": """
        select a.topic, producers, consumers from (select lower(trim(event_type)) as topic, count(distinct user_id) as producers from events where value > 20 group by 1) a
        join (select lower(trim(event_type)) as topic, count(distinct user_id) as consumers from events where value <= 20 group by 1) b on a.topic = b.topic""",
    "advisory_match_once": """
        select advisory, min(l_orderkey) as first_component, count(*) as components from (select p_partkey as advisory from part where p_type = 'ECONOMY' and p_size > 40) a join lineitem on l_partkey = advisory group by advisory""",
    # ---- aggregates ----
    "severity_histogram": f"select status, count(*) as total, {', '.join(f"count(case when severity = '{s}' then 1 end) as {s}" for s in ('critical', 'high', 'medium', 'low', 'info'))} from {FINDINGS} f group by status",
    "findings_per_kloc": """
        select lang, count(*) as files, round(sum(n_lines) / 1000e0, 1) as kloc, cast(sum(hits) as bigint) as findings, round(sum(hits) / (sum(n_lines) / 1000e0), 3) as density
        from (select lang, 1 + length(text) - length(replace(text, chr(10), '')) as n_lines, case when contains(text, 'icensed under') then 1 else 0 end as hits from documents) t group by lang""",
    "ece_bins": f"""
        select bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(quality), 6) as mean_y from (select p, quality, cast(least(9, floor(least(99999e-5, p) * 10)) as int) as bin from {SCORED} s) t group by bin""",
    "wilson_ci": f"""
        select source, n, k, round((k / n + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt((k / n) * (1 - k / n) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n), 6) as lo,
        round((k / n + 3.841458820694124 / (2 * n) + 1.959963984540054 * sqrt((k / n) * (1 - k / n) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n), 6) as hi
        from (select source, cast(count(*) as double) as n, cast(sum(quality) as double) as k from {SCORED} s group by source) t""",
    "scorecard_slices": f"select lang, source, count(*) as n, count(case when p >= 0.25 and quality = 1 then 1 end) as detected, cast(sum(quality) as bigint) as positives from {SCORED} s group by grouping sets ((lang), (source), ())",
    "sla_breaches": f"""
        select severity, count(*) as open_findings, count(case when age > sla then 1 end) as breaches from (select severity, {{days(opened; date '2001-08-02')}} as age,
        case severity when 'critical' then 7 when 'high' then 30 when 'medium' then 60 when 'low' then 90 else 180 end as sla from {FINDINGS} f where status = 'O') t group by severity""",
    "risk_dollars": """
        select p_type, cast(sum(floor(l_quantity * 1000 * case when l_returnflag = 'R' then 1.0e0 when l_returnflag = 'A' then 0.7e0 else 0.3e0 end * greatest(0.4e0, 1 - l_discount * 5) + 0.5)) as bigint) as loss
        from lineitem join part on l_partkey = p_partkey group by p_type""",
    "category_score": f"select owner, cast(greatest(0, 100 - sum(case severity when 'critical' then 25 when 'high' then 15 when 'medium' then 6 when 'low' then 2 else 0 end)) as bigint) as score from {FINDINGS} f group by owner",
    "layer_matrix": "select user_id, count(case when event_type = 'error' then 1 end) as error, count(case when event_type = 'click' then 1 end) as click, count(case when event_type = 'view' then 1 end) as view_, round(count(case when event_type = 'error' then 1 end) / cast(count(*) as double), 4) as share from events group by user_id",
    "consensus_deviation": """
        select l_suppkey, l_orderkey, l_linenumber from (select l_suppkey, l_orderkey, l_linenumber, l_returnflag, count(*) over (partition by l_suppkey) as n, count(case when l_returnflag <> 'R' then 1 end) over (partition by l_suppkey) as guarded
        from lineitem where l_quantity = 50) t where guarded >= 3 and guarded >= 0.5 * n and l_returnflag = 'R'""",
    "role_tier_inversion": f"select owner, id, sev_rank, reader from (select owner, id, sev_rank, status, max(case when status = 'P' then sev_rank end) over (partition by owner) as reader from {FINDINGS} f) t where status = 'F' and reader > sev_rank + 2",
    "control_coverage": """
        select r_name, count(*) as checks, count(case when c > 55 then 1 end) as passed, min(case when c > 55 then 1 else 0 end) = 1 as satisfied from (
        select r_name, n_nationkey, count(c_custkey) as c from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by r_name, n_nationkey) t group by r_name""",
    "cache_economics": "select role, count(*) as turns, cast(sum(length(text)) as bigint) as chars, round(sum(length(text)) / 4e0 * case role when 'assistant' then 15 else 3 end / 1000000, 6) as cost from conversations group by role",
    # ---- windows ----
    "cluster_keeper": """
        select l_partkey, l_orderkey, l_linenumber, size from (select l_partkey, l_orderkey, l_linenumber, count(*) over (partition by l_partkey) as size, row_number() over (partition by l_partkey order by l_quantity desc, l_extendedprice desc, l_orderkey, l_linenumber, l_suppkey) as rn from lineitem) t where rn = 1""",
    "clone_clusters": "select {hash16(text)} as shape, count(*) as size, min(doc_id) as keeper from documents group by 1 having count(*) > 1",
    "clone_outliers": f"""
        select owner, count(*) as size, min(sev_rank) as worst, max(sev_rank) as best from {FINDINGS} f group by owner having count(*) >= 3 and count(distinct severity) >= 2 and min(sev_rank) <= 1 and max(sev_rank) - min(sev_rank) >= 2""",
    "severity_sort_topk": f"select id, severity, pos from (select id, severity, cast(row_number() over (order by sev_rank, price desc, id) as bigint) as pos from {FINDINGS} f) t where pos <= 100",
    "trend_last_two": """
        select d, n, n - lag(n) over (order by d) as delta from (select {day(ts)} as d, count(*) as n from events group by 1) t""",
    "delta_trend": """
        select d, score, case when prev is null then 'flat' when score < prev - 1 then 'improving' when score > prev + 1 then 'regressing' else 'flat' end as trend from (select d, score, lag(score, 2) over (order by d) as prev from (
        select {day(ts)} as d, count(case when event_type = 'error' then 4 when event_type = 'click' then 1 end) as score from events group by 1) t) u""",
    "memory_search_topk": """
        select conv_id, turn, hits from (select conv_id, turn, hits, row_number() over (order by hits desc, case role when 'assistant' then 0 when 'user' then 1 else 2 end, conv_id, turn) as pos from (
        select conv_id, turn, role, case when contains(lower(text), 'the') then 1 else 0 end + case when contains(lower(text), 'ation') then 1 else 0 end + case when contains(lower(text), 'over') then 1 else 0 end as hits from conversations) t where hits > 0) u where pos <= 10""",
    "cost_running_cap": """
        select conv_id, turn, running <= 3000 as within_cap from (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and current row) as running from conversations) t""",
    "stratified_sample": """
        select stratum, doc_id from (
        select 'hash' as stratum, doc_id, row_number() over (order by {hash({text(doc_id)})}) as rn from documents union all
        select 'size', doc_id, row_number() over (order by n_chars desc, doc_id) from documents union all
        select 'recent', doc_id, row_number() over (order by doc_id desc) from documents) t where rn <= 34""",
    "latest_per_key": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) t where rn = 1",
    # ---- sets ----
    "sbom_drift": """
        select kind, count(*) as n from (select case when b.p_partkey is null then 'removed' when a.p_partkey is null then 'added' when a.v <> b.v then case when floor(a.v / 10) <> floor(b.v / 10) then 'bumped_major' else 'bumped' end when a.h <> b.h then 'substituted' else 'same' end as kind
        from (select p_partkey, p_size as v, {hash16(p_name)} as h from part where p_partkey % 11 <> 0) a
        full outer join (select p_partkey, case when p_partkey % 4 = 0 then p_size + 3 else p_size end as v, {hash16(case when p_partkey % 9 = 0 then concat(p_name, 'x') else p_name end)} as h from part where p_partkey % 13 <> 0) b on a.p_partkey = b.p_partkey) t group by kind""",
    "incremental_file_diff": """
        select change, count(*) as n from (select case when a.doc_id is null then 'added' when b.doc_id is null then 'removed' when a.h <> b.h then 'changed' else 'unchanged' end as change
        from (select doc_id, {hash16(text)} as h from documents where doc_id % 10 <> 3) a full outer join (select doc_id, {hash16(case when doc_id % 17 = 0 then concat(text, '.') else text end)} as h from documents where doc_id % 10 <> 4) b on a.doc_id = b.doc_id) t group by change""",
    "dead_parts": "select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)",
    "pack_union": "select distinct p_brand as cwe from part where p_size > 45 union select p_brand from part where p_type = 'PROMO'",
    # ---- scores ----
    "exploitability_tier": f"""
        select tier, count(*) as n from (select case when s >= 0.8 then 'critical' when s >= 0.6 then 'high' when s >= 0.35 then 'medium' else 'low' end as tier from (
        select round(least(1.0e0, greatest(0.0e0, case severity when 'critical' then 0.8e0 when 'high' then 0.65e0 when 'medium' then 0.4e0 when 'low' then 0.2e0 else 0.1e0 end + case when status = 'O' then 0.1e0 when status = 'F' then -0.2e0 else 0e0 end - case when price < 50000 then 0.15e0 else 0e0 end)), 2) as s from {FINDINGS} f) t) u group by tier""",
    "composite_tier": f"""
        select id, risk, case when risk >= 85 then 'critical' when risk >= 65 then 'high' when risk >= 35 then 'medium' when risk >= 15 then 'low' else 'minimal' end as tier from (
        select id, cast(floor(least(100e0, greatest(case when status = 'O' and price > 400000 then 80e0 else 0e0 end, case severity when 'critical' then 70 when 'high' then 55 when 'medium' then 35 when 'low' then 20 else 10 end * case when status = 'F' then 0.4e0 else 1e0 end + least(15e0, price / 50000e0))) + 0.5) as int) as risk from {FINDINGS} f) t""",
    "sca_verdict": f"""
        select verdict, count(*) as n from (select case when status = 'P' then 'WAIT_FOR_PATCH' when severity = 'critical' and status = 'O' and price > 300000 then 'AUTO_MERGE_PATCH' when status = 'F' then 'ACCEPT_RISK' when owner % 7 = 0 then 'MANUAL_REVIEW' when severity in ('critical', 'high') then 'AUTO_MERGE_PATCH' else 'MANUAL_REVIEW' end as verdict from {FINDINGS} f) t group by verdict""",
    "expected_loss_tiers": f"select severity, cast(sum(floor(price * case severity when 'critical' then 0.9e0 when 'high' then 0.5e0 else 0.05e0 end + 0.5)) as bigint) as loss from {FINDINGS} f where status = 'O' group by severity",
    "data_class": "select case when {matches(text; '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z.]{2,}')} then 'PII' when {matches(text; 'token *[:=]')} then 'SECRET' else 'none' end as class, count(*) as n from documents group by 1".replace("{2,}", "[A-Za-z.]+"),
    "props_json": "select {json(props; k)} % 10 as k10, count(*) as n, max({json(props; k)}) as most from events group by 1",
}
