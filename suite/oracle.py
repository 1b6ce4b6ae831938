"""The same results in SQL, written as directly as possible: whole-log windows, plain joins, recursion."""

from __future__ import annotations

_LINE = """
case when event_id % 211 = 0 then '### corrupt record ' || event_id
 else strftime(case when event_id % 1009 = 0 then ts - interval 3 hour else ts end, '%Y-%m-%d %H:%M:%S') || ' ' ||
  case when event_id % 331 = 0 then repeat('A', 60)
  else 'audit type=' || event_type || ' user=' || user_id || ' host=h' || (user_id % 7) || ' props=' || props end
 end"""

_PARSED = """
parsed as (
 select source, line_number, line as raw_payload, strptime(substr(line, 1, 19), '%Y-%m-%d %H:%M:%S') as ts
 from audit_log where regexp_matches(line, '^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}')
)"""

TEXT = f"""audit_log as (select event_type as source, event_id as line_number, {_LINE} as line from events), {_PARSED}"""

_LEVEL = """
strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || case when (event_id * 7919) % 100 < 85
 then substr('abcdefghijklmnopqrstuvwxyz012345', 1, 30 + (event_id % 3)::int)
 else repeat(substr('abcdefghijklmnopqrstuvwxyz', 1, 12 + (user_id % 2)::int), 2) end"""

LEVELS = f"""audit_log as (select event_type as source, event_id as line_number, {_LEVEL} as line from events), {_PARSED}"""

USER_TEXT = f"""audit_log as (
 select 'u' || user_id as source, row_number() over (partition by user_id order by event_id) as line_number, {_LINE} as line
 from events), {_PARSED}"""

AUDIT = """audit_json as (
 select 'trail' as source, event_id as line_number,
  case when event_id % 499 = 0 then '{"broken":' || event_id
  else '{"eventTime":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z","userIdentity":{"arn":"arn:aws:iam::000000000000:' ||
   case when user_id % 25 = 0 then 'root' else 'user/u' || user_id end || '"},"sourceIPAddress":"10.0.0.' || (props->>'$.k') ||
   '","awsRegion":"r' || (user_id % 4) || '","eventName":"' ||
   case when event_id % 50 = 0 then 'CreateAccessKey' else event_type end || '","eventSource":"audit"}'
  end as line
 from events),
records as (
 select source, line_number, line as raw_payload, strptime(json_extract_string(doc, '$.eventTime'), '%Y-%m-%dT%H:%M:%SZ') as ts,
  json_extract_string(doc, '$.userIdentity.arn') as actor, json_extract_string(doc, '$.sourceIPAddress') as source_ip,
  json_extract_string(doc, '$.awsRegion') as region, json_extract_string(doc, '$.eventName') as event_name,
  json_extract_string(doc, '$.eventSource') as event_source
 from (select *, case when json_valid(line) then line end as doc from audit_json) where doc is not null)"""

EVENT_LOG = "parsed as (select event_type as source, event_id as line_number, ts from events)"
USER_EVENT_LOG = "parsed as (select 'u' || user_id as source, event_id as line_number, ts from events)"
ORDER_LOG = "parsed as (select o_orderpriority as source, o_orderkey as line_number, o_orderdate as ts from orders)"


def _steps(of: str = "parsed") -> str:
    return f"""
lagged as (
 select source, line_number, ts, lag(ts) over w as prev_ts, lag(line_number) over w as prev_line
 from {of} window w as (partition by source order by line_number)),
steps as (
 select *, date_diff('microsecond', prev_ts, ts) as us, date_diff('microsecond', prev_ts, ts) / 1e6 as d
 from lagged where prev_ts is not null)"""


def _severity(us: str = "us") -> str:
    return f"case when {us} > 3600000000 then 'HIGH' when {us} > 300000000 then 'MEDIUM' else 'LOW' end"


def _gaps(low: int, extra: str = "true", severity: str | None = None) -> str:
    return f"""
gaps as (
 select source, prev_ts as start_time, ts as end_time, us, d, {severity or _severity()} as severity,
  prev_line as start_line, line_number as end_line
 from steps where us >= {low}000000 and us <= 172800000000 and {extra})"""


_LISTED = """
select source, start_time, end_time, round(d, 6) as duration_seconds, severity, start_line, end_line from gaps"""

_CHARS = """
chars as (
 select source, line_number, unnest(string_split(substr(raw_payload, 21), '')) as ch from parsed where length(raw_payload) > 20),
char_counts as (select source, line_number, ch, count(*) as c from chars group by all),
entropies as (
 select source, line_number, -sum(c / len * log2(c / len)) as e from
 (select *, sum(c) over (partition by source, line_number) as len from char_counts) group by all)"""

_COLLAPSE = f"""{_CHARS},
positioned as (
 select p.source, p.line_number, p.ts, coalesce(e.e, 0) as e, greatest(length(p.raw_payload) - 20, 0) as len, p.raw_payload,
  row_number() over (partition by p.source order by p.line_number) - 1 as n
 from parsed p left join entropies e on p.source = e.source and p.line_number = e.line_number),
folded as (
 select source, n, line_number, ts, e, raw_payload, 0.0::double as r_before, false as forged, e::double as r from positioned where n = 0
 union all
 select p.source, p.n, p.line_number, p.ts, p.e, p.raw_payload, f.r,
  p.n > 50 and p.len > 20 and (p.e < f.r * 0.75 or p.e < 3.0),
  case when p.n > 50 and p.len > 20 and (p.e < f.r * 0.75 or p.e < 3.0) then f.r else (f.r * p.n + p.e) / (p.n + 1) end
 from folded f join positioned p on p.source = f.source and p.n = f.n + 1),
forgeries as (
 select source, line_number, ts, e as entropy, r_before as baseline, substr(raw_payload, 1, 60) as raw_text
 from folded where forged)"""

_COLLAPSE_QUERY = f"""
with recursive {TEXT}, {_COLLAPSE}
select source, line_number, ts, round(entropy, 6) as entropy, round(baseline, 6) as baseline, raw_text from forgeries"""

_TRAVEL = """
seen as (
 select *, lag(source_ip) over w as prev_ip, lag(ts) over w as seen_ts from records where actor <> '' and source_ip <> ''
 window w as (partition by source, actor order by line_number)),
travel as (
 select source, line_number, ts, actor, prev_ip, source_ip, date_diff('microsecond', seen_ts, ts) / 1e6 / 3600.0 as hours
 from seen where prev_ip <> source_ip and seen_ts < ts and date_diff('microsecond', seen_ts, ts) < 3600000000)"""

_TRAVEL_TEXT = (
    "'🚨 IMPOSSIBLE TRAVEL WARNING: ' || actor || ' jumped from ' || prev_ip || ' to ' || source_ip || ' in ' || "
    "printf('%.2f', hours) || ' hours!'"
)
_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
_ESCALATION_TEXT = f"'⚠️ IAM ESCALATION WARNING: ' || actor || ' performed ' || event_name || ' at ' || {_STAMP}"
_ROOT_TEXT = f"'⚠️ ROOT ABUSE WARNING: AWS Root account activity detected at ' || {_STAMP} || ' (' || event_name || ')'"
_IS_ESCALATION = (
    "event_name in ('CreateAccessKey', 'AttachUserPolicy', 'AttachGroupPolicy', 'AttachRolePolicy', 'CreateLoginProfile', "
    "'UpdateAssumeRolePolicy', 'PutUserPolicy')"
)
_IS_ROOT = f"not ({_IS_ESCALATION}) and contains(lower(actor), 'root')"

_FEED = f"""{_TRAVEL},
feed as (
 select source, line_number, 0 as kind_rank, 'IAM_ESCALATION' as kind, {_ESCALATION_TEXT} as message from records where {_IS_ESCALATION}
 union all
 select source, line_number, 0, 'ROOT_ABUSE', {_ROOT_TEXT} from records where {_IS_ROOT}
 union all
 select source, line_number, 1, 'IMPOSSIBLE_TRAVEL', {_TRAVEL_TEXT} from travel)"""

_PII = (
    "cast(regexp_matches({0}, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+') as int)",
    "cast(regexp_matches({0}, '\\b(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}\\b') as int)",
    "cast(regexp_matches({0}, '(?i)(?:key|token|secret)[''\"]?\\s*[:=]\\s*[''\"]?([A-Za-z0-9\\-_]{{16,}})') as int)",
)


def _pii(column: str) -> str:
    return "(" + " + ".join(rule.format(column) for rule in _PII) + ")"


# All counters of the logs by user. Evidence comes from the escalation events of the audit trail, if asked for.
def _counters(evidence: bool, low: int = 100000) -> str:
    secondary = (
        f"(select count(*) from records s where {_IS_ESCALATION} and s.ts > g.start_time and s.ts < g.end_time)"
        if evidence
        else "0"
    )
    return f"""
{USER_TEXT}, {AUDIT if evidence else "unused as (select 1)"}, {_COLLAPSE}, {_steps()}, {_gaps(low)},
checked as (select g.*, {secondary} as evidence from gaps g),
line_counts as (
 select a.source, max(a.line_number) as total_lines, count(*) - count(p.ts) as malformed, min_by(p.ts, p.line_number) as file_start,
  max_by(p.ts, p.line_number) as file_end, coalesce(sum({_pii('p.raw_payload')}), 0) as pii
 from audit_log a left join parsed p on a.source = p.source and a.line_number = p.line_number group by a.source),
step_counts as (
 select source, count(*) filter (us > 172800000000) as maxgap, count(*) filter (us < 0) as causality from steps group by source),
gap_counts as (
 select source, count(*) as gaps, count(*) filter (us <= 300000000) as low, count(*) filter (us > 300000000 and us <= 3600000000) as med,
  count(*) filter (us > 3600000000) as high, count(*) filter (evidence > 0) as alibi from checked group by source),
forged as (select source, count(*) as forgery from forgeries group by source),
counters as (
 select l.source, l.total_lines, l.malformed, l.file_start, l.file_end, l.pii, coalesce(maxgap, 0) as maxgap,
  coalesce(causality, 0) as causality, coalesce(gaps, 0) as gaps, coalesce(low, 0) as low, coalesce(med, 0) as med,
  coalesce(high, 0) as high, coalesce(alibi, 0) as alibi, coalesce(forgery, 0) as forgery
 from line_counts l left join step_counts using (source) left join gap_counts using (source) left join forged using (source))"""


_SCORED = """
trusted as (
 select *, greatest(0, least(100, cast(trunc(100.0::double - low * 2 - med * 5 - high * 15 - maxgap * 20 - causality * 30
  - forgery * 20 - malformed * 0.1::double - case when alibi > 0 then 50 else 0 end) as bigint))) as trust from counters),
reasoned as (
 select *, case when alibi > 0 or trust < 50 then 'COMPROMISED' when trust < 85 then 'SUSPICIOUS' else 'NORMAL' end as status,
  concat_ws(' | ',
   case when alibi > 0 then 'CRITICAL: ' || alibi || ' Alibi Failures detected (Proven tampering)' end,
   case when causality > 0 then 'CAUSALITY VIOLATION: ' || causality || ' reverse-time jumps detected' end,
   case when forgery > 0 then 'SYNTHETIC FORGERY: ' || forgery || ' instances of Shannon Entropy collapse' end,
   case when high > 0 then 'Major timeline disruptions (HIGH gaps)' end,
   case when maxgap > 0 then maxgap || ' instances of catastrophic timestamp inconsistency' end,
   case when malformed > total_lines * 0.01::double then 'Unusually high volume of malformed/corrupted lines' end) as causes,
  concat_ws('; ',
   case when low > 0 then 'LOW gaps (' || low || 'x): -' || low * 2 end,
   case when med > 0 then 'MEDIUM gaps (' || med || 'x): -' || med * 5 end,
   case when high > 0 then 'HIGH gaps (' || high || 'x): -' || high * 15 end,
   case when maxgap > 0 then 'Max gap violations (' || maxgap || 'x): -' || maxgap * 20 end,
   case when causality > 0 then 'Causality violations (' || causality || 'x): -' || causality * 30 end,
   case when forgery > 0 then 'Entropy collapses (' || forgery || 'x): -' || forgery * 20 end,
   case when alibi > 0 then 'Alibi failures: -50' end,
   case when malformed > 0 then 'Malformed lines (' || malformed || 'x): -' || printf('%.1f', malformed * 0.1::double) end) as deductions
 from trusted),
scored as (
 select *, case when causes <> '' then causes when trust < 100 then 'Minor temporal inconsistencies degrading reliability'
  else 'Perfect contiguous structural integrity' end as reason from reasoned)"""


def _human(us: str) -> str:
    s = f"({us} // 1000000)"
    return f"""case when {s} = 0 then '0s' else concat_ws(' ',
 case when {s} // 86400 > 0 then ({s} // 86400) || 'd' end,
 case when {s} % 86400 // 3600 > 0 then ({s} % 86400 // 3600) || 'h' end,
 case when {s} % 3600 // 60 > 0 then ({s} % 3600 // 60) || 'm' end,
 case when {s} % 60 > 0 then ({s} % 60) || 's' end) end"""


def _minute(ts: str) -> str:
    return f"(hour({ts}) * 60 + minute({ts}))"


_OUTSIDE = f"""((isodow(prev_ts) >= 6 and isodow(ts) >= 6) or {_minute('ts')} < 540 or
 cast(prev_ts as time) > time '17:00:00')"""
_BUSINESS = f"case when {_OUTSIDE} then 'LOW' else {_severity()} end"

_SAFE = """not (
 (prev_ts >= timestamp '2024-01-02 00:00:00' and ts <= timestamp '2024-01-03 12:00:00') or
 (prev_ts >= timestamp '2024-01-05 06:00:00' and ts <= timestamp '2024-01-05 18:00:00') or
 (prev_ts >= timestamp '2024-01-08 00:00:00' and ts <= timestamp '2024-01-12 00:00:00'))"""

_EXTENT = """
extent as (
 select source, min_by(ts, line_number) as file_start, max_by(ts, line_number) as file_end,
  date_diff('microsecond', min_by(ts, line_number), max_by(ts, line_number)) as span_us
 from parsed group by source)"""

_MAD = """
medians as (select source, count(*) as n_gaps, median(d) as med from gaps group by source),
spread as (
 select g.source, any_value(m.n_gaps) as n_gaps, any_value(m.med) as med, median(abs(g.d - m.med)) as mad
 from gaps g join medians m on g.source = m.source group by g.source)"""

_SENTENCE = """case kind
 when 'ROOT_ABUSE' then 'Root account usage detected, representing a severe risk [T1078.001 (Default Accounts)].'
 when 'IAM_ESCALATION' then 'Privilege escalation activity detected in the audit trail [T1098 (Account Manipulation)].'
 else 'Impossible travel authentication anomaly detected [T1078 (Valid Accounts)].' end"""

ORACLE: dict[str, str] = {
    "scan_text_lines": f"""
with {TEXT}
select source, line_number // 5000 as chunk, row_number() over (partition by source, line_number // 5000 order by line_number) as line_number,
 line from audit_log""",
    "normalize_text_log": f"with {TEXT} select source, line_number, ts, raw_payload from parsed",
    "normalize_cloud_audit": f"""
with {AUDIT}
select source, line_number, ts, raw_payload, actor, source_ip, region, event_name, event_source from records""",
    "read_audit_records": f"""
with {AUDIT},
spoiled as (select distinct line_number // 100 as doc from audit_json where not json_valid(line))
select 'doc-' || (line_number // 100) as source, row_number() over (partition by line_number // 100 order by line_number) as line_number,
 ts, actor, source_ip, event_name, raw_payload
from records where line_number // 100 not in (select doc from spoiled)""",
    "rejected_lines": f"""
with {TEXT}
select a.source, a.line_number, a.line from audit_log a
where not exists (select 1 from parsed p where p.source = a.source and p.line_number = a.line_number)""",
    "custody_hash": "select doc_id, sha256(text) as sha256 from documents",
    "custody_hash_files": """
select doc_id % 20 as bucket, sha256(string_agg(text, chr(10) order by doc_id) || chr(10)) as sha256,
 sha256(string_agg(text, chr(10) order by doc_id) || chr(10)) as sha256_in_chunks
from documents group by doc_id % 20""",
    "parse_timestamps": """
select event_type as source, event_id as line_number,
 case event_id % 8
  when 3 then null when 5 then null when 6 then null
  when 4 then case when month(ts) = 2 and day(ts) = 29 then null
   else cast('2023' || substr(strftime(ts, '%Y-%m-%d %H:%M:%S'), 5) as timestamp) end
  when 7 then try_cast('1999' || substr(strftime(ts, '%Y-%m-%d %H:%M:%S'), 5) as timestamp)
  else date_trunc('second', ts) end as ts
from events""",
    "payload_entropy": """
with chars as (select doc_id, unnest(string_split(substr(text, 21), '')) as ch from documents where length(text) > 20),
counted as (select doc_id, ch, count(*) as c from chars group by all),
entropies as (
 select doc_id, -sum(c / len * log2(c / len)) as e from (select *, sum(c) over (partition by doc_id) as len from counted) group by doc_id)
select d.doc_id, greatest(length(d.text) - 20, 0) as chars, coalesce(round(e.e, 6), 0.0) as entropy
from documents d left join entropies e using (doc_id)""",
    "severity_bucket": f"""
with {EVENT_LOG}, {_steps()}
select source, line_number, round(d, 6) as duration_seconds, {_severity()} as severity from steps""",
    "business_hours_gaps": f"with {EVENT_LOG}, {_steps()}, {_gaps(60, severity=_BUSINESS)} {_LISTED}",
    "safe_interval_filter": f"with {EVENT_LOG}, {_steps()}, {_gaps(60, _SAFE)} {_LISTED}",
    "pii_rule_hits": f"""
select doc_id, {_PII[0].format('text')} = 1 as email, {_PII[1].format('text')} = 1 as ipv4, {_PII[2].format('text')} = 1 as api_key
from documents""",
    "duration_human": f"""
with {USER_EVENT_LOG}, {_steps()} select source, line_number, {_human('us')} as duration_human from steps""",
    "gap_position": f"""
with {EVENT_LOG}, {_steps()}, {_gaps(300)}, {_EXTENT}
select g.source, g.end_line,
 round(case when span_us > 0 then date_diff('microsecond', file_start, start_time) / 1e6 / (span_us / 1e6) * 100 else 0.0 end, 6) as position,
 round(case when span_us > 0 then d / (span_us / 1e6) * 100 else 0.0 end, 6) as width
from gaps g join extent using (source)""",
    "gap_detect": f"with {TEXT}, {_steps()}, {_gaps(60)} {_LISTED}",
    "causality_violations": f"""
with {TEXT}, {_steps()}
select source, prev_ts as timestamp_before, ts as timestamp_after, line_number from steps where us < 0""",
    "max_gap_violations": f"""
with {ORDER_LOG}, {_steps()}
select source, line_number, prev_ts as timestamp_before, ts as timestamp_after, d as delta_seconds from steps where us > 172800000000""",
    "entropy_collapse": _COLLAPSE_QUERY,
    "entropy_collapse_in_blocks": _COLLAPSE_QUERY,
    "entropy_collapse_two_levels": f"""
with recursive {LEVELS}, {_COLLAPSE}
select source, line_number, ts, round(entropy, 6) as entropy, round(baseline, 6) as baseline, raw_text from forgeries""",
    "impossible_travel": f"""
with {AUDIT}, {_TRAVEL}
select source, line_number, ts, actor, prev_ip, source_ip, round(hours, 6) as delta_hours, {_TRAVEL_TEXT} as message from travel""",
    "iam_escalation": f"""
with {AUDIT} select source, line_number, ts, actor, event_name, {_ESCALATION_TEXT} as message from records where {_IS_ESCALATION}""",
    "root_abuse": f"""
with {AUDIT} select source, line_number, ts, actor, event_name, {_ROOT_TEXT} as message from records where {_IS_ROOT}""",
    "alert_feed": f"with {AUDIT}, {_FEED} select source, line_number, kind_rank, kind, message from feed",
    "technique_mapping": f"""
with {AUDIT}, {_FEED},
techniques(kind, technique_key, technique) as (values
 ('IAM_ESCALATION', 'CreateAccessKey', 'T1098 (Account Manipulation)'), ('ROOT_ABUSE', 'root_abuse', 'T1078.001 (Default Accounts)'),
 ('IMPOSSIBLE_TRAVEL', 'ConsoleLogin', 'T1078 (Valid Accounts)'))
select source, line_number, kind, technique_key, technique from feed join techniques using (kind)""",
    "alibi_cross_check": f"""
with {EVENT_LOG}, {_steps()}, {_gaps(3600)},
secondary as (select ts from events union all select o_orderdate from orders)
select source, start_time, end_time, severity, end_line,
 (select count(*) from secondary s where s.ts > g.start_time and s.ts < g.end_time) as alibi_evidence_count from gaps g""",
    "cloud_alibi": f"""
with {TEXT}, {AUDIT}, {_steps()}, {_gaps(300)}
select source, start_time, end_time, severity, end_line,
 (select count(*) from records s where s.ts > g.start_time and s.ts < g.end_time) as alibi_evidence_count from gaps g""",
    "safe_interval_anti_join": f"""
with {EVENT_LOG}, {_steps()}, {_gaps(300)},
safe as (
 select ts - interval 1 minute as safe_start, ts + to_seconds(cast(trunc(value) as bigint) * 10) as safe_end from events)
{_LISTED} g where not exists (select 1 from safe s where s.safe_start <= g.start_time and s.safe_end >= g.end_time)""",
    "log_extent": f"with {TEXT}, {_EXTENT} select source, file_start, file_end, span_us / 1e6 as span_seconds from extent",
    "severity_breakdown": f"""
with {TEXT}, {_steps()}, {_gaps(300)}
select source, count(*) as total_gaps, count(*) filter (severity = 'LOW') as low_count,
 count(*) filter (severity = 'MEDIUM') as medium_count, count(*) filter (severity = 'HIGH') as high_count from gaps group by source""",
    "trust_score": f"""
with {USER_EVENT_LOG}, {_steps()}, {_gaps(150000)},
counted as (
 select source, max(line_number) as total_lines, (select count(*) from gaps g where g.source = p.source and us > 3600000000) as high,
  (select count(*) from steps s where s.source = p.source and us > 172800000000) as maxgap from parsed p group by source),
trusted as (select *, greatest(0, least(100, 100 - high * 15 - maxgap * 20)) as trust from counted)
select source, trust, case when trust < 50 then 'COMPROMISED' when trust < 85 then 'SUSPICIOUS' else 'NORMAL' end as status,
 cast(0 as bigint) as alibi_failures, round(high * 3 / total_lines, 6) as suspicion_density from trusted""",
    "log_counters": f"""
with recursive {_counters(False)}
select source, total_lines, malformed as malformed_count, gaps as total_gaps, maxgap as max_gap_violations,
 causality as causality_count, forgery as forgery_count, cast(pii as bigint) as pii_leaks from counters""",
    "suspicion_reason": f"with recursive {_counters(False)}, {_SCORED} select source, trust, status, reason from scored",
    "trust_deductions": f"with recursive {_counters(False)}, {_SCORED} select source, deductions from scored",
    "gap_mad": f"""
with {TEXT}, {_steps()}, {_gaps(300)}, {_MAD}
select source, n_gaps, round(med, 6) as median_seconds, round(mad, 6) as mad_seconds from spread""",
    "gap_cause": f"""
with {TEXT}, {_steps()}, {_gaps(300)}, {_MAD}
select g.source, g.end_line, round(g.d, 6) as duration_seconds,
 case when g.d > s.mad * 3 and s.mad > 0 then 'statistical' else 'static' end as cause
from gaps g join spread s on g.source = s.source""",
    "gap_cause_far": f"""
with {TEXT}, {_steps()}, {_gaps(300)}, {_MAD}
select g.source, g.end_line + case when g.source in ('click', 'error') then -1000000 else 1700000000000000 end as end_line,
 round(g.d, 6) as duration_seconds,
 case when g.d > s.mad * 3 and s.mad > 0 then 'statistical' else 'static' end as cause
from gaps g join spread s on g.source = s.source""",
    "gap_timeline": f"""
with {TEXT}, {_steps()}, {_gaps(300)}, {_EXTENT},
placed as (
 select g.source, least(59, cast(trunc(greatest(0.0, date_diff('microsecond', file_start, start_time) / 1e6) / ((span_us / 1e6) / 60)) as bigint)) as bucket,
  end_line, severity from gaps g join extent e on g.source = e.source where span_us > 0),
marks as (
 select source, bucket, case max_by(severity, end_line) when 'HIGH' then 'X' when 'MEDIUM' then 'x' else '!' end as mark
 from placed group by source, bucket)
select e.source, string_agg(coalesce(m.mark, '.'), '' order by b.bucket) as timeline
from extent e cross join (select unnest(range(60)) as bucket) b left join marks m on m.source = e.source and m.bucket = b.bucket
where span_us > 0 group by e.source""",
    "pii_totals": f"select source, cast(sum({_pii('text')}) as bigint) as pii_leaks from documents group by source",
    "incident_narrative": f"""
with {AUDIT}, {_FEED}, {_steps('records')}, {_gaps(300)},
told as (select source, row_number() over (partition by source order by line_number, kind_rank) as place, {_SENTENCE} as sentence from feed),
sentences as (
 select * from told
 union all
 select source, 0, 'Detected ' || count(*) || ' abnormal audit silence(s) indicating potential log tampering [T1070.006 (Timestomp / Indicator Removal)].'
 from gaps group by source)
select source, greatest(place - 1, 0) // 500 as part, string_agg(sentence, ' ' order by place) as narrative
from sentences group by source, greatest(place - 1, 0) // 500""",
    "explain_narrative": f"""
with recursive {_counters(True)}, {_SCORED}
select source, concat_ws(' ',
 case status when 'COMPROMISED' then 'The system sustained a highly sophisticated data-poisoning attack.'
  when 'SUSPICIOUS' then 'The system exhibits suspicious temporal anomalies indicating potential probing or configuration failure.'
  else 'No active hostility detected. System timeline is contiguous.' end,
 case when causality > 0 then 'The attacker likely spoofed NTP timestamps to mask activities, mapping to MITRE T1070.006 (Indicator Removal: Timestomp).' end,
 case when forgery > 0 then 'Synthetic log payloads injected to bypass volumetric detection, mapping to MITRE T1001 (Data Obfuscation).' end,
 case when alibi > 0 then 'Secondary systems successfully achieved consensus (' || alibi || ' background activities confirmed during gaps), cryptographically proving intentional target log manipulation.' end,
 case when pii > 0 then 'Data exfiltration risk flagged: ' || pii || ' sensitive PII leakage events caught, mapping to MITRE T1005 (Data from Local System).' end) as narrative
from scored""",
    "integrity_report": f"""
with recursive {_counters(True)}, {_SCORED},
listed as (
 select source, count(*) as n, string_agg({_human('us')}, ', ' order by end_line) as durations, sum(evidence) as events_caught
 from checked group by source)
select s.source, cast(0 as bigint) as part, s.source as source_file, strftime(file_start, '%Y-%m-%dT%H:%M:%S') as file_start,
 strftime(file_end, '%Y-%m-%dT%H:%M:%S') as file_end, total_lines as total_lines_processed, cast(100000 as bigint) as threshold_seconds,
 cast(coalesce(date_diff('microsecond', file_start, file_end), 0) // 1000000 as bigint) as total_timespan_seconds, gaps as total_gaps_found, high,
 med as medium, low, malformed as malformed_lines_skipped, causality as causality_violations_detected, forgery as shannon_entropy_collapses,
 alibi as alibi_failures_detected, cast(pii as bigint) as pii_leakage_events, status as system_status,
 trust as log_trust_confidence_percent, reason as suspicion_reason, deductions, coalesce(n, 0) as n_detailed_gaps,
 coalesce(durations, '') as gap_durations, cast(coalesce(events_caught, 0) as bigint) as alibi_events
from scored s left join listed l on s.source = l.source""",
    "gap_ledger": f"""
with recursive {_counters(True)}, {_SCORED}
select c.source, c.end_line, strftime(start_time, '%Y-%m-%dT%H:%M:%S') as start_time, strftime(end_time, '%Y-%m-%dT%H:%M:%S') as end_time,
 us // 1000000 as duration_seconds, severity, evidence as alibi_events_caught, causality as total_causality_violations,
 forgery as shannon_entropy_collapses, trust || '%' as system_trust_confidence, status as system_status
from checked c join scored s on c.source = s.source""",
    "alibi_by_path": f"""
with audit_log as (select event_type as source, event_id as line_number, {_LINE} as line from events),
seen as (
 select strptime(substr(line, 1, 19), '%Y-%m-%d %H:%M:%S') as ts from audit_log
 where (source = 'click' or source[1] in ('e', 's', 'v')) and regexp_matches(line, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}')),
{EVENT_LOG}, {_steps()}, {_gaps(3600)}
select source, start_time, end_time, severity, end_line,
 (select count(*) from seen s where s.ts > g.start_time and s.ts < g.end_time) as alibi_evidence_count from gaps g""",
    "gap_numbers": f"""
with {TEXT}, {_steps()}, {_gaps(300)},
placed as (select source, end_line, row_number() over (partition by source order by end_line) as gap_number from gaps)
select source, end_line, gap_number, 'GAP-' || lpad(gap_number::varchar, greatest(2, length(gap_number::varchar))::int, '0') as gap_id from placed""",
    "report_gaps": f"""
with {TEXT}, {_steps()}, {_gaps(300)}, {_EXTENT},
placed as (
 select g.*, e.file_start, e.span_us, row_number() over (partition by g.source order by end_line) - 1 as n,
  (select count(*) from events s where s.ts > g.start_time and s.ts < g.end_time) as evidence
 from gaps g join extent e on g.source = e.source)
select source, n // 500 as part, n % 500 as place, strftime(start_time, '%Y-%m-%dT%H:%M:%S') as start_time,
 strftime(end_time, '%Y-%m-%dT%H:%M:%S') as end_time, us // 1000000 as duration_seconds, {_human('us')} as duration_human, severity,
 start_line, end_line,
 case when span_us > 0 then round_even((date_diff('microsecond', file_start, start_time) / 1e6) / (span_us / 1e6) * 100.0, 1) else 0.0::double end as position_percent,
 case when span_us > 0 then round_even((us / 1e6) / (span_us / 1e6) * 100.0, 1) else 0.0::double end as width_percent, evidence as alibi_events_caught
from placed""",
    "report_alerts": f"""
with {AUDIT}, {_FEED},
placed as (select source, message, row_number() over (partition by source order by line_number, kind_rank) - 1 as n from feed)
select source, n // 500 as part, n % 500 as place, message from placed""",
}
