"""Queries over scores, policies, alert rules, model quality and table upkeep."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions import fixed, text
from ..functions.times import before, ts_lit
from ..operators import alerts as al, events as ev, geo, metrics as mx, policy as po, scoring as sc
from ..session import shared_dir
from ..sinks import tables as sk
from .event_queries import ACTIVE, D1, NOW, PLACED, RANK, TOP_RULES  # noqa: F401
from .event_queries import BLOCKED_COUNTRIES, OWNER, cached_predictions, list_flags, new_ips
from .network_queries import FEATS, features
from .registry import query
from .views import AS_OF
from .weblog_queries import any_word, lit

ODD9 = "length({c}) - length(translate({c}, '<>\"'';|&$`', ''))"
ODD7 = "length({c}) - length(translate({c}, '<>\"'';|&', ''))"


def behave(src: str) -> str:
    """Check SQL of the behaviour features of the rows in ``src``."""
    return f"""bg as (select *, (epoch_us(timestamp) - lag(epoch_us(timestamp)) over (partition by source_ip order by timestamp, id)) / 1e6 as gap from {src}),
bm as (select source_ip, (epoch_us(min(timestamp)) + epoch_us(max(timestamp))) / 2 as mid from bg group by 1),
ba as (select b.source_ip, count(*) as n, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 60e6 as span, count(distinct request_path) as unique_paths,
  count(*) filter (where severity in ('high', 'critical')) as bad, count(distinct attack_vector) filter (where attack_vector <> 'unknown') as num_attack_types, coalesce(stddev_pop(gap), 0) as dev,
  avg(length(request_path)) as apl, cast(sum({ODD9.format(c='request_path')}) as bigint) as suspicious_chars_total,
  count(*) filter (where epoch_us(timestamp) > mid) as late, count(*) filter (where epoch_us(timestamp) <= mid) as early from bg b join bm using (source_ip) group by 1),
beh as (select source_ip, n as total_events, round_even(case when n >= 2 then n / greatest(span, 1) else 0 end, 2) as requests_per_minute, round_even(unique_paths / n, 3) as path_diversity_ratio,
  round_even(bad / n, 3) as error_ratio, num_attack_types, round_even(dev, 2) as temporal_entropy, dev < 2 and n > 4 as is_rhythmic_bot,
  round_even(case when n >= 10 then (n - n // 2) / (n // 2) else 1 end, 2) as escalation_ratio, round_even(case when n >= 10 then late / greatest(early, 1) else 1 end, 2) as time_escalation_ratio,
  unique_paths, round_even(apl, 1) as avg_path_length, suspicious_chars_total from ba)"""


@query("behavioral_features", f"with {behave('full_events')} select * from beh")
def _(t):
    return sc.behavioral_features(t.full_events)


@query("escalation_ratio", f"with {behave('full_events')} select source_ip, escalation_ratio, time_escalation_ratio from beh")
def _(t):
    return sc.behavioral_features(t.full_events).select("source_ip", "escalation_ratio", "time_escalation_ratio")


FACT = fixed.FACTORS
SCORE = """ts0 as (select *, ml_confidence * 40 as p1, case when requests_per_minute > 5 then least(20, requests_per_minute) else 0 end as p2, case when num_attack_types > 1 then least(15, num_attack_types * 5) else 0 end as p3,
  case when error_ratio > 0.3 then least(10, error_ratio * 10) else 0 end as p4, case when is_rhythmic_bot then 10 else 0 end as p5, case when country_code in ('CN', 'RU', 'KP', 'IR', 'BY', 'VN') then 5 else 0 end as p6,
  case when escalation_ratio > 2 then 5 else 0 end as p7, case when suspicious_chars_total > 10 then least(5, suspicious_chars_total / 10) else 0 end as p8,
  case when avg_path_length > 150 then least(5, (avg_path_length - 150) / 50) else 0 end as p9 from {src}),
ts1 as (select *, p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 + p9 as total from ts0),
ts as (select *, least(100, round_even(total, 1)) as threat_score,
  case when total >= 80 then 'BLOCK_IMMEDIATE' when total >= 60 then 'BLOCK_DELAYED' when total >= 40 then 'THROTTLE' when total >= 20 then 'MONITOR' else 'ALLOW' end as recommended_action,
  case when total >= 80 then 'critical' when total >= 60 then 'high' when total >= 40 then 'medium' when total >= 20 then 'low' else 'info' end as threat_priority,
  concat_ws('|', case when p1 > 20 then '""" + FACT["ml"] + """=' || cast(round_even(p1, 1) as double) end, case when requests_per_minute > 5 then '""" + FACT["speed"] + """=' || cast(round_even(p2, 1) as double) end,
    case when num_attack_types > 1 then '""" + FACT["vectors"] + """=' || cast(round_even(p3, 1) as double) end, case when error_ratio > 0.3 then '""" + FACT["errors"] + """=' || cast(round_even(p4, 1) as double) end,
    case when is_rhythmic_bot then '""" + FACT["bot"] + """=10.0' end, case when p6 > 0 then '""" + FACT["country"] + """=5.0' end, case when escalation_ratio > 2 then '""" + FACT["escalation"] + """=5.0' end,
    case when suspicious_chars_total > 10 then '""" + FACT["chars"] + """=' || cast(round_even(p8, 1) as double) end, case when avg_path_length > 150 then '""" + FACT["paths"] + """=' || cast(round_even(p9, 1) as double) end) as factors from ts1)"""
SCORE_IN = f"places as ({PLACED}), sin as (select b.*, p.ml_confidence, g.country_code from beh b join predictions p on b.source_ip = p.ip_address join places g on g.ip = b.source_ip)"
FACTOR_TEXT = lambda c: F.transform(c, lambda f: F.concat(f["factor"], F.lit("="), f["points"].cast("string")))


def places(t):
    return geo.geo_lookup(t.security_events, t.geo_ranges, "source_ip").select("ip", "country_code")


def scored_ips(t):
    preds = t.predictions.select(F.col("ip_address").alias("source_ip"), "ml_confidence")
    rows = sc.behavioral_features(t.full_events).join(preds, "source_ip").join(places(t).withColumnRenamed("ip", "source_ip"), "source_ip")
    return sc.threat_score(rows)


@query("threat_score", f"with {behave('full_events')}, {SCORE_IN}, {SCORE.format(src='sin')} select source_ip, threat_score, recommended_action, threat_priority, factors from ts")
def _(t):
    return scored_ips(t).select("source_ip", "threat_score", "recommended_action", "threat_priority", FACTOR_TEXT(F.col("threat_factors")).alias("factors"))


CONF = "printf('%.1f', {v})"
REASON_HEAD = "case when {b} then 'El modelo clasifica este tráfico como MALICIOSO con ' || printf('%.1f', {c} * 100) || '% de confianza' else 'El modelo clasifica este tráfico como NORMAL con ' || printf('%.1f', (1 - {c}) * 100) || '% de confianza' end"
NIGHT = "(hour(timestamp) >= 22 or hour(timestamp) <= 6)"


@query("event_features", f"""
select id, source_ip, cast(hour(timestamp) as int) as hour, cast(isodow(timestamp) - 1 as int) as day_of_week, case when isodow(timestamp) >= 6 then 1 else 0 end as is_weekend,
  case when {NIGHT} then 1 else 0 end as is_night, {RANK} + 1 as severity_level, coalesce(attack_vector, 'unknown') as attack_vector, event_type, request_method,
  cast(length(request_path) as int) as path_length, case when contains(request_path, '?') then 1 else 0 end as has_query_string, cast({ODD7.format(c='request_path')} as int) as suspicious_chars,
  cast(length(user_agent) as int) as ua_length, case when {any_word('lower(user_agent)', ['bot', 'crawler', 'spider'])} then 1 else 0 end as is_bot, coalesce(country_code, 'unknown') as country from full_events""")
def _(t):
    return sc.event_features(t.full_events)


@query("prediction_reason", f"""
select e.id, concat_ws(' | ', {REASON_HEAD.format(b='s.is_suspicious', c='s.confidence')}, case when s.is_anomaly then 'Detectado como ANOMALÍA (comportamiento inusual)' end,
  case when severity in ('high', 'critical') then 'Severidad alta detectada' end, case when {ODD7.format(c='request_path')} > 3 then 'Caracteres sospechosos en URL (' || ({ODD7.format(c='request_path')}) || ')' end,
  case when {NIGHT} then 'Tráfico nocturno (horario inusual)' end, case when length(request_path) > 100 then 'URL muy larga (' || length(request_path) || ' caracteres)' end) as reason
from full_events e join event_scores s on e.id = s.id""")
def _(t):
    rows = sc.event_features(t.full_events).join(t.event_scores, "id")
    return rows.select("id", sc.prediction_reason(F.col("is_suspicious"), F.col("confidence"), F.col("is_anomaly")).alias("reason"))


POINTS = """case when event_type like '%brute_force%' then 10 when event_type like '%injection%' then 15 when event_type like '%flooding%' then 8 when event_type like '%scan%' then 5 when event_type like '%bot%' then 3 else 0 end
  + case severity when 'critical' then 20 when 'high' then 10 when 'medium' then 5 else 0 end"""
L100 = "l100 as (select * from (select *, row_number() over (partition by source_ip order by timestamp desc, id desc) as rn from security_events) where rn <= 100)"
ASCORE = f"asc_ as (select source_ip as ip, cast(least(sum({POINTS}), 100) as bigint) as score from l100 group by 1)"


@query("ip_attack_score", f"with {L100}, {ASCORE} select * from asc_")
def _(t):
    return sc.attack_score(t.security_events)


REP = f"""places as ({PLACED}),
rs as (select source_ip as ip, count(*) as total_reports, max(timestamp) as last_reported, count(*) filter (where severity in ('high', 'critical')) as high_events, count(*) filter (where severity = 'medium') as medium_events,
  string_agg(event_type, '|' order by rn) filter (where rn <= 10) as attack_history from l100 group by 1),
rb as (select rs.*, exists(select 1 from blocked_ips b where b.ip_address = rs.ip and {ACTIVE}) as is_currently_blocked,
  exists(select 1 from ip_lists l where l.ip_address = rs.ip and l.list = 'whitelist' and l.is_active) as is_whitelisted, exists(select 1 from ip_lists l where l.ip_address = rs.ip and l.list = 'blacklist' and l.is_active) as is_blacklisted from rs),
rl as (select *, least(high_events * 10 + medium_events * 3, 70) + case when is_currently_blocked then 20 else 0 end as local from rb),
rep as (select rl.ip, total_reports, last_reported, high_events, medium_events, attack_history, is_currently_blocked, is_whitelisted, is_blacklisted, least(local, 100) as abuse_score, local > 50 as is_abusive, g.country_code,
  regexp_matches({OWNER}, 'vpn|proxy|tor|relay|exit|hosting|datacenter|cloud') as is_vpn_proxy, regexp_matches({OWNER}, 'amazon|aws|microsoft|azure|google|digitalocean|linode|ovh|hetzner|vultr|rackspace|cloudflare') as is_cloud,
  g.country_code in ('CN', 'RU') as is_blocked_country from rl join ip_orgs o on o.ip = rl.ip join places g on g.ip = rl.ip),
repu as (select *, case when is_blacklisted then 100.0e0 else least(100.0e0, round_even(cast(abuse_score as double) * 0.6e0 + least(high_events * 5, 30) + case when is_vpn_proxy then 10 else 0 end + case when is_blocked_country then 20 else 0 end, 4)) end as reputation_score from rep)"""


def reputation(t):
    ips = t.security_events.select(F.col("source_ip").alias("ip")).distinct()
    return sc.reputation(t.security_events, t.blocked_ips, list_flags(ips, t.ip_lists), t.ip_orgs, places(t), AS_OF, BLOCKED_COUNTRIES)


@query("ip_reputation_local", f"with {L100}, {REP} select ip, total_reports, last_reported, high_events, medium_events, abuse_score, is_abusive, is_whitelisted from repu")
def _(t):
    return reputation(t).select("ip", "total_reports", "last_reported", "high_events", "medium_events", "abuse_score", "is_abusive", "is_whitelisted")


@query("ip_reputation", f"with {L100}, {REP} select ip, reputation_score from repu")
def _(t):
    return reputation(t).select("ip", "reputation_score")


PROFILE = ["ip", "country_code", "is_vpn_proxy", "is_cloud", "is_blocked_country", "abuse_score", "reputation_score", "attack_history", "is_whitelisted", "is_blacklisted", "is_currently_blocked"]


@query("ip_enriched_profile", f"with {L100}, {REP} select {', '.join(PROFILE)} from repu")
def _(t):
    return reputation(t).select(*PROFILE)


D30 = "timestamp '2024-01-01 00:00:00'"


def susp(hours_from: str, extra: str = "") -> str:
    return f"""sr as (select e.*, s.confidence, s.is_suspicious, s.is_anomaly from full_events e join event_scores s on e.id = s.id where e.timestamp >= {hours_from} {extra}),
sp as (select source_ip, round_even(avg(confidence), 9) as ml_confidence, count(*) filter (where is_suspicious) as suspicious_events, count(*) filter (where is_anomaly) as anomaly_events, min(timestamp) as first_seen, max(timestamp) as last_seen,
  arg_min(severity, (timestamp, id)) as f_sev, arg_min(request_path, (timestamp, id)) as f_path, arg_min(timestamp, (timestamp, id)) as f_ts from sr group by 1 having round_even(avg(confidence), 9) >= 0.6),
sk as (select sr.* from sr join sp using (source_ip)), {behave('sk')}, places as ({PLACED}),
sj as (select b.*, sp.* exclude (source_ip), g.country_code, exists(select 1 from blocked_ips x where x.ip_address = b.source_ip and {ACTIVE}) as is_blocked from beh b join sp using (source_ip) join places g on g.ip = b.source_ip),
{SCORE.format(src='sj')}"""


SUSP_COLS = ["ip_address", "ml_confidence", "total_events", "suspicious_events", "anomaly_events", "country_code", "first_seen", "last_seen", "is_blocked", "threat_score", "recommended_action", "requests_per_minute", "error_ratio"]
SUSP_SQL = "select source_ip as ip_address, round_even(ml_confidence, 6) as ml_confidence, " + ", ".join(SUSP_COLS[2:])


def suspicious(t, events=None, hours=24 * 30):
    return sc.suspicious_ips(events if events is not None else t.full_events, t.event_scores, places(t), t.blocked_ips, AS_OF, hours)


def susp_out(df):
    return df.withColumn("ml_confidence", rounded("ml_confidence", 6)).select(*SUSP_COLS)


@query("suspicious_ips", f"with {susp(D30)} {SUSP_SQL} from ts")
def _(t):
    return susp_out(suspicious(t))


CACHED = f"(select ip_address from predictions where ml_confidence >= 0.9 and last_seen >= {D1} and is_valid)"


@query("suspicious_ips_incremental", f"""
with {susp(D30, f'and e.source_ip not in {CACHED}')}
select source_ip as ip_address, round_even(ml_confidence, 6) as ml_confidence, threat_score, 'new' as origin from ts
union all select ip_address, ml_confidence, threat_score, 'cached' from predictions where ml_confidence >= 0.9 and last_seen >= {D1} and is_valid""")
def _(t):
    return incremental(t).select("ip_address", rounded("ml_confidence", 6).alias("ml_confidence"), "threat_score", "origin")


def incremental(t):
    """Valid cached rows and fresh analysis of the addresses the cache lacks."""
    cached = cached_predictions(t.predictions, 24, 0.9)
    fresh = t.full_events.join(cached.select(F.col("ip_address").alias("source_ip")), "source_ip", "left_anti")
    new = suspicious(t, fresh).select("ip_address", "ml_confidence", "threat_score", F.lit("new").alias("origin"))
    old = cached.select("ip_address", "ml_confidence", "threat_score", F.lit("cached").alias("origin"))
    return old.unionByName(new).orderBy(F.desc("threat_score"), "ip_address")


@query("union_cached_new", f"""
select ip_address, ml_confidence, threat_score from predictions where ml_confidence >= 0.6 and last_seen >= {D1} and is_valid
union all select source_ip, 0.0e0, 0.0e0 from (select distinct source_ip from security_events where timestamp >= {D1} and source_ip not in (select ip_address from predictions where ml_confidence >= 0.6 and last_seen >= {D1} and is_valid))""")
def _(t):
    cached = cached_predictions(t.predictions, 24).select("ip_address", "ml_confidence", "threat_score")
    new = new_ips(t).select(F.col("ip").alias("ip_address"), F.lit(0.0).alias("ml_confidence"), F.lit(0.0).alias("threat_score"))
    return cached.unionByName(new)


ACT = {a[1]: a for a in fixed.ACTIONS}
ACT_TEXT = "case recommended_action " + " ".join(f"when '{k}' then '{a[2]}'" for k, a in ACT.items()) + " end"
ACT_DESC = "case recommended_action " + " ".join(f"when '{k}' then '{a[3]}'" for k, a in ACT.items()) + " end"


@query("enhanced_reason", f"""
with {susp(D30)},
fx as (select *, [x for x in [case when p1 > 20 then '{FACT["ml"]}** (+' || cast(round_even(p1, 1) as double) || ' pts): ' || printf('%.1f', ml_confidence * 100) || '% confianza de ser malicioso' end,
  case when requests_per_minute > 5 then '{FACT["speed"]}** (+' || cast(round_even(p2, 1) as double) || ' pts): ' || printf('%.1f', requests_per_minute) || ' requests/minuto (normal: <2)' end,
  case when num_attack_types > 1 then '{FACT["vectors"]}** (+' || cast(round_even(p3, 1) as double) || ' pts): ' || num_attack_types || ' tipos diferentes de ataque' end,
  case when error_ratio > 0.3 then '{FACT["errors"]}** (+' || cast(round_even(p4, 1) as double) || ' pts): ' || printf('%.0f', error_ratio * 100) || '% de requests generan errores críticos' end,
  case when is_rhythmic_bot then '{FACT["bot"]}** (+10.0 pts): Intervalos regulares detectados (no humano)' end, case when p6 > 0 then '{FACT["country"]}** (+5.0 pts): Origen: ' || country_code end,
  case when escalation_ratio > 2 then '{FACT["escalation"]}** (+5.0 pts): Actividad incrementó ' || printf('%.1f', escalation_ratio) || 'x en última mitad del período' end,
  case when suspicious_chars_total > 10 then '{FACT["chars"]}** (+' || cast(round_even(p8, 1) as double) || ' pts): ' || suspicious_chars_total || ' caracteres sospechosos en URLs' end,
  case when avg_path_length > 150 then '{FACT["paths"]}** (+' || cast(round_even(p9, 1) as double) || ' pts): Promedio de ' || printf('%.0f', avg_path_length) || ' caracteres (normal: <100)' end] if x is not null] as fl from ts),
ex as (select *, concat_ws(chr(10), case f_sev when 'high' then '  • Severidad alta' when 'critical' then '  • Severidad crítica' end, case when {ODD7.format(c='f_path')} > 3 then '  • ' || ({ODD7.format(c='f_path')}) || ' caracteres maliciosos en URL' end,
  case when length(f_path) > 100 then '  • URL muy larga (' || length(f_path) || ' chars)' end, case when hour(f_ts) >= 22 or hour(f_ts) <= 6 then '  • Horario sospechoso (' || hour(f_ts) || ':00 hrs)' end) as el from fx)
select source_ip as ip_address, concat_ws(chr(10), case when ml_confidence >= 0.6 then '⚠️ **CLASIFICADO COMO MALICIOSO** (' || printf('%.1f', ml_confidence * 100) else '✅ **CLASIFICADO COMO NORMAL** (' || printf('%.1f', (1 - ml_confidence) * 100) end || '% confianza)',
  chr(10) || '**Threat Score: ' || cast(threat_score as double) || '/100** - ' || {ACT_TEXT}, chr(10) || '**📊 Análisis de Comportamiento:**',
  case when requests_per_minute > 2 then '  • ' || printf('%.1f', requests_per_minute) || ' requests/minuto (anormal, promedio normal: ~0.5)' end, case when num_attack_types > 0 then '  • ' || num_attack_types || ' vectores de ataque diferentes detectados' end,
  case when error_ratio > 0.3 then '  • ' || printf('%.0f', error_ratio * 100) || '% de requests resultaron en errores críticos' end, case when is_rhythmic_bot then '  • Patrón bot detectado (intervalos regulares de ~' || printf('%.1f', temporal_entropy) || 's)' end,
  case when escalation_ratio > 2 then '  • Escalamiento: ' || printf('%.1f', escalation_ratio) || 'x más actividad en última hora' end,
  case when len(fl) > 0 then chr(10) || '**🔍 Factores Principales (' || len(fl) || ' detectados):**' end, nullif(array_to_string(['  • **' || f for f in fl[1:5]], chr(10)), ''),
  case when el <> '' then chr(10) || '**🎯 Características del Evento:**' end, nullif(el, ''), chr(10) || '**' || {ACT_TEXT} || '**', '   ' || {ACT_DESC}) as reasons from ex""")
def _(t):
    return suspicious(t).select("ip_address", "reasons")


# ------------------------------------------------------------------ decisions
PCT = "select ip_address, round_even(ml_confidence * 100, 4) as ml_confidence, threat_score, severity, total_events as event_count, zeek_detections, f2b_bans from predictions"


def decision_sql(src: str, name: str) -> str:
    p = fixed.POLICIES[name]
    least = fixed.SEVERITIES.index(p["min_severity"])
    srcs = "(case when ml_confidence > 0 then 1 else 0 end + case when zeek_detections > 0 then 1 else 0 end + case when f2b_bans > 0 then 1 else 0 end)"
    multi = f"when {srcs} < 2 then 'Solo detectado por ' || {srcs} || ' fuente(s), se requieren 2+'" if p["require_multiple_sources"] else ""
    return f"""dp as ({src}), dr as (select *, case when ip_address in (select ip_address from blocked_ips where {ACTIVE}) then 'IP ya bloqueada'
  when ip_address in (select ip_address from ip_lists where list = 'whitelist' and is_active) then 'IP en whitelist'
  when regexp_matches(ip_address, '^(127\\.|10\\.|172\\.16\\.|192\\.168\\.)') then 'IP interna excluida'
  when ml_confidence < {p['min_ml_confidence']} then 'Confianza ML insuficiente (' || ml_confidence || '% < {p['min_ml_confidence']}%)'
  when threat_score < {p['min_threat_score']} then 'Threat score insuficiente (' || threat_score || ' < {p['min_threat_score']})'
  when {RANK} < {least} then 'Severidad insuficiente (' || severity || ' < {p['min_severity']})'
  when event_count < {p['min_events']} then 'Eventos insuficientes (' || event_count || ' < {p['min_events']})' {multi}
  else 'Auto-bloqueado: ML=' || printf('%.1f', ml_confidence) || '%, ThreatScore=' || threat_score || ', Severity=' || severity || ', Events=' || event_count end as reason from dp),
dd as (select *, starts_with(reason, 'Auto-bloqueado: ML') as should_block from dr)"""


def percent(t):
    return t.predictions.select(
        "ip_address", rounded(F.col("ml_confidence") * 100, 4).alias("ml_confidence"), "threat_score", "severity",
        F.col("total_events").alias("event_count"), "zeek_detections", "f2b_bans")


def decide(t, rows, name):
    return po.auto_block_decision(rows, po.active_ips(t.blocked_ips, AS_OF), po.listed_ips(t.ip_lists, "whitelist"), fixed.POLICIES[name])


@query("auto_block_decision", f"with {decision_sql(PCT, 'default')} select ip_address, should_block, reason from dd")
def _(t):
    return decide(t, percent(t), "default").select("ip_address", "should_block", "reason")


SUMMARY = """select count(*) as evaluated, count(*) filter (where should_block) as blocked, count(*) filter (where not should_block) as skipped, count(*) filter (where reason = 'IP ya bloqueada') as already_blocked,
  count(*) filter (where reason = 'IP en whitelist') as whitelisted, count(*) filter (where not should_block and reason not in ('IP ya bloqueada', 'IP en whitelist')) as insufficient_criteria from dd"""


@query("auto_block_batch", f"with {decision_sql(PCT, 'aggressive')} {SUMMARY}")
def _(t):
    return po.decision_summary(decide(t, percent(t), "aggressive"))


SCORE_SEV = "case when threat_score >= 90 then 'critical' when threat_score >= 70 then 'high' when threat_score >= 50 then 'medium' else 'low' end"


@query("top_predictions_for_block", f"""
select ip_address, ml_confidence, threat_score, {SCORE_SEV} as severity, total_events as event_count, first_seen, last_seen
from (select * from predictions where last_seen >= {D1} order by ml_confidence desc, ip_address limit 100)""")
def _(t):
    return top_for_block(t.predictions)


def top_for_block(predictions, hours=24, limit=100):
    rows = ev.in_window(predictions, AS_OF, hours, "last_seen").orderBy(F.desc("ml_confidence"), "ip_address").limit(limit)
    return rows.select("ip_address", "ml_confidence", "threat_score", text.score_severity(F.col("threat_score")).alias("severity"),
                       F.col("total_events").alias("event_count"), "first_seen", "last_seen")


SUSP_PCT = f"select source_ip as ip_address, round_even(ml_confidence * 100, 4) as ml_confidence, cast(threat_score as double) as threat_score, {SCORE_SEV} as severity, total_events as event_count, 1 as zeek_detections, 0 as f2b_bans from ts"


@query("predictions_to_decisions", f"with {susp(D30)}, {decision_sql(SUSP_PCT, 'aggressive')} select ip_address, severity, should_block, reason from dd")
def _(t):
    rows = suspicious(t).select(
        "ip_address", rounded(F.col("ml_confidence") * 100, 4).alias("ml_confidence"), "threat_score",
        text.score_severity(F.col("threat_score")).alias("severity"), F.col("total_events").alias("event_count"),
        F.lit(1).alias("zeek_detections"), F.lit(0).alias("f2b_bans"))
    return decide(t, rows, "aggressive").select("ip_address", "severity", "should_block", "reason")


@query("should_auto_block", f"""
with {L100}, {ASCORE}, sv as (select source_ip as ip, case max({RANK}) when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'critical' end as severity from security_events where timestamp >= {D1} group by 1),
x as (select sv.ip, severity, score, exists(select 1 from ip_lists l where l.ip_address = sv.ip and list = 'whitelist' and is_active) as w, exists(select 1 from ip_lists l where l.ip_address = sv.ip and list = 'blacklist' and is_active) as b from sv join asc_ a on a.ip = sv.ip)
select ip, severity, score, case when w then false when b then true when severity = 'critical' then true when severity = 'high' and score >= 10 then true when score >= 20 then true else false end as should_block,
  case when w then 'IP is whitelisted' when b then 'IP is blacklisted' when severity = 'critical' then 'Critical threat detected (score: ' || score || ')' when severity = 'high' and score >= 10 then 'High threat with score ' || score || ' >= threshold 10'
    when score >= 20 then 'Threat score ' || score || ' exceeds auto-block threshold' else 'Below threshold (score: ' || score || ', threshold: 10)' end as reason from x""")
def _(t):
    worst = ev.in_window(t.security_events, AS_OF, 24).groupBy(F.col("source_ip").alias("ip")).agg(
        text.severity_name(F.max(text.severity_rank(F.col("severity")))).alias("severity"))
    rows = list_flags(worst.select("ip"), t.ip_lists).join(worst, "ip").join(sc.attack_score(t.security_events), "ip")
    return po.should_auto_block(rows).select("ip", "severity", "score", "should_block", "reason")


@query("upsert_block_list", f"""
with r as (select ip_address, count(*) as n, arg_max(reason, (asked_at, id)) as reason, arg_max(threat_level, (asked_at, id)) as threat_level, max(asked_at) as asked_at, arg_min(blocked_by, (asked_at, id)) as blocked_by,
  arg_max(coalesce(duration_hours, -1), (asked_at, id)) as hrs from block_requests group by 1)
select ip_address, coalesce(s.blocked_by, r.blocked_by) as blocked_by, coalesce(r.reason, s.reason) as reason, coalesce(r.threat_level, s.threat_level) as threat_level,
  case when r.n is not null then r.hrs <= 0 else s.is_permanent end as is_permanent, case when r.n is null then s.unblock_time when r.hrs > 0 then r.asked_at + interval 1 hour * r.hrs end as unblock_time,
  coalesce(r.asked_at, s.last_blocked) as last_blocked, coalesce(s.total_attacks, 0) + coalesce(r.n, 0) as total_attacks
from block_snapshot s full join r using (ip_address)""")
def _(t):
    return po.upsert_blocks(t.block_snapshot, t.block_requests)


@query("auto_block_apply", f"""
with {decision_sql(PCT, 'aggressive')}
select ip_address, coalesce(s.blocked_by, 'auto_blocker') as blocked_by, coalesce(d.reason, s.reason) as reason, coalesce(d.severity, s.threat_level) as threat_level,
  case when d.ip_address is not null then false else s.is_permanent end as is_permanent,
  case when d.ip_address is null then s.unblock_time else {NOW} + interval 12 hour end as unblock_time,
  case when d.ip_address is null then s.last_blocked else {NOW} end as last_blocked,
  coalesce(s.total_attacks, 0) + case when d.ip_address is null then 0 else 1 end as total_attacks
from block_snapshot s full join (select * from dd where should_block) d using (ip_address)""")
def _(t):
    chosen = decide(t, percent(t), "aggressive")
    asked = po.decisions_to_requests(chosen, fixed.POLICIES["aggressive"], ts_lit(AS_OF))
    return po.upsert_blocks(t.block_snapshot, asked)


# ------------------------------------------------------------------ table upkeep
@query("upsert_predictions", f"""
with u as (select ip_address, ml_confidence, threat_score, total_events, first_seen, last_seen, analyzed_at, is_valid, 0 as fresh from prediction_store
  union all select ip_address, ml_confidence, threat_score, total_events, first_seen, last_seen, analyzed_at, true, 1 from prediction_batch),
l as (select *, row_number() over (partition by ip_address order by analyzed_at desc, fresh desc) as rn, count(*) filter (where fresh = 0) over (partition by ip_address) as known from u)
select ip_address, ml_confidence, threat_score, total_events, case when first_seen is null and known = 0 then {NOW} else first_seen end as first_seen, case when last_seen is null and known = 0 then {NOW} else last_seen end as last_seen,
  analyzed_at, is_valid, ml_confidence >= 0.6 as is_suspicious from l where rn = 1""")
def _(t):
    return sk.upsert_predictions(t.prediction_store, t.prediction_batch, AS_OF)


@query("retention_cleanup", f"select ip_address, analyzed_at from prediction_store where analyzed_at >= {D30}")
def _(t):
    return sk.retained(t.prediction_store, "analyzed_at", AS_OF, 30).select("ip_address", "analyzed_at")


OLD = (("predictions", "prediction_store", "analyzed_at"), ("events", "security_events", "timestamp"), ("metrics", "model_metrics", "evaluated_at"))


@query("retention_report", " union all ".join(
    f"select '{n}' as table_name, count(*) filter (where {c} < {D30}) as deleted, count(*) filter (where coalesce({c} >= {D30}, true)) as kept from {v}" for n, v, c in OLD))
def _(t):
    return sk.retention_report({n: (getattr(t, v), c) for n, v, c in OLD}, AS_OF, 30)


@query("retention_rewrite", f"select ip_address, analyzed_at from prediction_store where analyzed_at >= {D30} or analyzed_at is null")
def _(t):
    kept = sk.clean_up(t.prediction_store, "analyzed_at", AS_OF, 30, shared_dir(t.spark, "retained"))
    return kept.select("ip_address", "analyzed_at")


NOON = AS_OF - timedelta(hours=12)


@query("retention_days", f"select id, timestamp, source_ip from security_events where timestamp >= timestamp '{NOON - timedelta(days=20)}' or timestamp is null")
def _(t):
    rows, path = t.security_events.select("id", "timestamp", "source_ip"), shared_dir(t.spark, "events-by-day")
    sk.write_by_day(rows, "timestamp", path)
    return sk.clean_up_days(t.spark, path, rows.schema, "timestamp", NOON, 20)


@query("invalidate_predictions", "select ip_address, ml_confidence, false as is_valid from prediction_store")
def _(t):
    return sk.invalidated(t.prediction_store).select("ip_address", "ml_confidence", "is_valid")


COUNTED = ["security_events", "blocked_ips", "threats", "alerts", "predictions", "conn", "dns", "ssl", "files", "notices"]


@query("table_row_counts", "with n as (" + " union all ".join(f"select '{c}' as table_name, count(*) as n from {c}" for c in COUNTED) + ") select * from n union all select 'total', cast(sum(n) as bigint) from n")
def _(t):
    return sk.row_counts({c: getattr(t, c) for c in COUNTED})


# ------------------------------------------------------------------ alert rules
CHECKS = """rc as (select r.*, k.key as field, json_extract_string(k.value, '$.operator') as op, json_extract_string(k.value, '$.value') as raw, json_type(k.value, '$.value') as kind from alert_rules r, json_each(r.conditions) k where r.is_enabled),
ev as (select *, case when type in ('ml_prediction', 'zeek_detection', 'fail2ban_ban') then type else 'custom' end as rule_type from alert_events),
hold as (select e.id, c.id as rule_id, bool_and(case
    when field in ('ml_confidence', 'confidence') then case when kind in ('VARCHAR', 'ARRAY') then op in ('!=', 'not_in') else
      case op when '>' then v > cast(raw as double) when '<' then v < cast(raw as double) when '>=' then v >= cast(raw as double) when '<=' then v <= cast(raw as double) when '==' then v = cast(raw as double) when '!=' then v <> cast(raw as double) else false end end
    else case op when '==' then kind = 'VARCHAR' and s is not null and s = raw when '!=' then not coalesce(kind = 'VARCHAR' and s = raw, false) when 'in' then s is not null and kind = 'ARRAY' and contains(raw, '"' || s || '"')
      when 'not_in' then not (s is not null and kind = 'ARRAY' and contains(raw, '"' || s || '"')) when 'contains' then s is not null and contains(s, raw) when '>' then kind = 'VARCHAR' and s > raw else false end end) as ok
  from (select *, case field when 'ml_confidence' then e0.ml_confidence when 'confidence' then cast(e0.confidence as double) end as v,
    case field when 'severity' then e0.severity when 'detection_type' then e0.detection_type when 'country' then e0.country when 'message' then e0.message end as s, e0.id as eid
    from (select e.id as id0, e.rule_type as rt, e.ml_confidence, e.confidence, e.severity, e.detection_type, e.country, e.message, e.id from ev e) e0 join rc on rc.rule_type = e0.rt) z
  join ev e on e.id = z.eid join alert_rules c on c.rule_name = z.rule_name group by 1, 2),
hits as (select e.id, r.id as rule_id, e.timestamp, e.severity, e.type, e.ip, e.country, e.message, e.confidence, r.rule_name, r.severity_threshold, r.cooldown_minutes, r.channel_ids, r.subject_template, r.message_template, e.detection_type, e.ml_confidence from ev e join alert_rules r on r.rule_type = e.rule_type and r.is_enabled
  left join hold h on h.id = e.id and h.rule_id = r.id where coalesce(h.ok, r.conditions = '{}'))"""


@query("rule_event_match", f"with {CHECKS} select id, rule_id, rule_name from hits")
def _(t):
    return al.match_rules(t.alert_events, t.alert_rules).select("id", "rule_id", "rule_name")


@query("rule_condition_match", f"with {CHECKS} select rule_id, rule_name, count(*) as matched from hits group by all")
def _(t):
    return al.match_rules(t.alert_events, t.alert_rules).groupBy("rule_id", "rule_name").agg(F.count("*").alias("matched"))


LEVEL = "case {c} when 'LOW' then 0 when 'MEDIUM' then 1 when 'HIGH' then 2 when 'CRITICAL' then 3 end"
MET = f"(severity_threshold is null or coalesce({LEVEL.format(c='severity')} >= {LEVEL.format(c='severity_threshold')}, false))"


@query("severity_threshold", f"with {CHECKS} select id, rule_id, severity, {MET} as passes from hits")
def _(t):
    m = al.match_rules(t.alert_events, t.alert_rules)
    return m.select("id", "rule_id", "severity", al.threshold_met(F.col("severity"), F.col("severity_threshold")).alias("passes"))


MESSAGE = """case when subject_template is null then 'Alert: ' || type || ' - ' || message else replace(replace(replace(replace(replace(regexp_replace(subject_template, '\\{\\{\\s*(\\w+)\\s*\\}\\}', '{{\\1}}', 'g'),
  '{{ip}}', ip), '{{severity}}', severity), '{{type}}', type), '{{country}}', coalesce(country, 'None')), '{{confidence}}', cast(confidence as varchar)) end"""


@query("render_message", f"with {CHECKS} select id, rule_id, {MESSAGE} as subject from hits")
def _(t):
    m = al.match_rules(t.alert_events, t.alert_rules)
    return m.select("id", "rule_id", al.render(F.col("subject_template"), al.TEXT_FIELDS + al.NUMBER_FIELDS).alias("subject"))


@query("rule_channel_fanout", f"""
with {CHECKS} select h.id, h.rule_id, c.id as channel_id, c.channel_name from hits h, unnest(cast(h.channel_ids as bigint[])) as u(cid) join alert_channels c on c.id = u.cid where c.is_enabled""")
def _(t):
    m = al.match_rules(t.alert_events, t.alert_rules)
    return al.channel_fanout(m, t.alert_channels).select("id", "rule_id", "channel_id", "channel_name")


COOL = CHECKS + f""", ok as (select *, epoch_us(timestamp) as us, cast(cooldown_minutes as bigint) * 60000000 as cd from hits where {MET}),
tm as (select distinct rule_id, us, cd from ok where cd > 0),
chain as (select rule_id, min(us) as us, any_value(cd) as cd from tm group by rule_id
  union all select c.rule_id, (select min(n.us) from tm n where n.rule_id = c.rule_id and n.us >= c.us + c.cd), c.cd from chain c where exists (select 1 from tm n where n.rule_id = c.rule_id and n.us >= c.us + c.cd)),
fired as (select ok.* from ok where cd = 0 union all select * exclude (rn) from (select ok.*, row_number() over (partition by ok.rule_id, ok.us order by ok.id) as rn from ok join chain c on c.rule_id = ok.rule_id and c.us = ok.us) where rn = 1)"""


@query("alert_cooldown", f"with recursive {COOL} select rule_id, id, timestamp from fired")
def _(t):
    return al.triggered(t.alert_events, t.alert_rules).select("rule_id", "id", "timestamp")


DELIVER = COOL + f""", dl as (select f.rule_id, f.rule_name, c.id as channel_id, f.id as event_id, f.timestamp, coalesce(f.severity, 'MEDIUM') as severity, {MESSAGE} as subject, {MESSAGE.replace('subject_template', 'message_template')} as message,
  cast(to_json({{id: f.id, type: f.type, detection_type: f.detection_type, severity: f.severity, ip: f.ip, country: f.country, message: f.message, ml_confidence: f.ml_confidence, confidence: f.confidence}}) as varchar) as event_metadata,
  cast(0 as bigint) as send_duration_ms,
  c.channel_type = 'email' and c.recipients > 0 as success, case when c.channel_type <> 'email' then 'Channel type not supported' when c.recipients = 0 then 'No recipients configured' else '' end as error_message
  from (select *, unnest(cast(channel_ids as bigint[])) as cid from fired) f join alert_channels c on c.id = f.cid where c.is_enabled)"""


@query("alert_deliveries", f"with recursive {DELIVER} select * from dl")
def _(t):
    return al.deliveries(t.alert_events, t.alert_rules, t.alert_channels)


@query("alert_delivery_counters", f"""
with recursive {DELIVER} select 'rule' as kind, rule_id as id, count(*) filter (where success) as total_alerts_sent, count(*) filter (where success) as successful_sends, count(*) filter (where not success) as failed_sends from dl group by rule_id
union all select 'channel', channel_id, count(*), count(*) filter (where success), count(*) filter (where not success) from dl group by channel_id""")
def _(t):
    rows = al.deliveries(t.alert_events, t.alert_rules, t.alert_channels)
    out = [al.delivery_counters(rows, c).select(F.lit(k).alias("kind"), F.col(c).alias("id"), "total_alerts_sent", "successful_sends", "failed_sends")
           for k, c in (("rule", "rule_id"), ("channel", "channel_id"))]
    return out[0].unionByName(out[1])


@query("alert_pipeline", f"""
with recursive {DELIVER} select f.rule_id, f.rule_name, count(*) as total_triggers, max(f.timestamp) as last_triggered_at,
  coalesce((select count(*) filter (where success) from dl where dl.rule_id = f.rule_id), 0) as total_alerts_sent,
  coalesce((select count(*) filter (where not success) from dl where dl.rule_id = f.rule_id), 0) as failed_sends
from fired f group by f.rule_id, f.rule_name""")
def _(t):
    return al.trigger_counters(al.triggered(t.alert_events, t.alert_rules), t.alert_channels)


# ------------------------------------------------------------------ model quality
CM = "cm as (select count(*) filter (where y_true = 0 and y_pred = 0) as tn, count(*) filter (where y_true = 0 and y_pred = 1) as fp, count(*) filter (where y_true = 1 and y_pred = 0) as fn, count(*) filter (where y_true = 1 and y_pred = 1) as tp from scored)"


@query("confusion_matrix", f"with {CM} select * from cm")
def _(t):
    return mx.confusion_matrix(t.scored)


@query("classification_metrics", f"with {CM} select tn + fp + fn + tp as samples, (tp + tn) / (tn + fp + fn + tp) as accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1_score from cm")
def _(t):
    return mx.classification_metrics(t.scored)


CUM = """pt as (select y_prob as threshold, count(*) filter (where y_true = 1) as pos, count(*) filter (where y_true = 0) as neg from scored group by 1),
cu as (select *, cast(sum(pos) over w as bigint) as tps, cast(sum(neg) over w as bigint) as fps, row_number() over w as k, lead(pos) over w as np, lead(neg) over w as nn from pt window w as (order by threshold desc)),
tt as (select cast(sum(pos) as double) as p, cast(sum(neg) as double) as n, count(*) as k from pt)"""


@query("roc_curve", f"""
with {CUM}, kp as (select 1.0e0 as threshold, 0 as tps, 0 as fps, 0 as k union all select threshold, tps, fps, k from cu where k = 1 or np is null or np <> pos or nn <> neg),
nu as (select *, row_number() over (order by k) - 1 as i, count(*) over () as m from kp) select threshold, fps / tt.n as fpr, tps / tt.p as tpr from nu, tt where i % greatest(1, m // 100) = 0""")
def _(t):
    return mx.roc_curve(t.scored)


@query("roc_auc", f"with {CUM} select sum(neg * (2 * tps - pos) / 2) / (any_value(tt.p) * any_value(tt.n)) as auc from cu, tt")
def _(t):
    return mx.roc_auc(t.scored)


@query("pr_curve", f"""
with {CUM}, x as (select tt.k - cu.k as i, threshold, tps / (tps + fps) as precision, tps / tt.p as recall from cu, tt union all select k, null, 1, 0 from tt),
c as (select count(*) as m from x) select threshold, precision, recall from x, c where i % greatest(1, m // 100) = 0""")
def _(t):
    return mx.pr_curve(t.scored)


@query("pr_auc", f"with {CUM}, x as (select *, tps / (tps + fps) as pr, lag(tps / (tps + fps)) over (order by threshold desc) as lp from cu) select sum(pos * (pr + coalesce(lp, 1)) / 2) / any_value(tt.p) as auc from x, tt")
def _(t):
    return mx.pr_auc(t.scored)


@query("latest_per_version", "select model_version, run, evaluated_at, accuracy from (select *, row_number() over (partition by model_version order by evaluated_at desc, run desc) as rn from model_metrics) where rn = 1")
def _(t):
    return mx.latest_per_version(t.model_metrics).select("model_version", "run", "evaluated_at", "accuracy")


VERSIONS = "vs as (select min(model_version) as a, max(model_version) as b from model_metrics), la as (select * from (select *, row_number() over (partition by model_version order by evaluated_at desc, run desc) as rn from model_metrics) where rn = 1)"


@query("compare_versions", f"""
with {VERSIONS} select m as measure, case m when 'accuracy' then x.accuracy when 'precision' then x.precision else x.recall end as version1, case m when 'accuracy' then y.accuracy when 'precision' then y.precision else y.recall end as version2,
  round_even(case m when 'accuracy' then y.accuracy - x.accuracy when 'precision' then y.precision - x.precision else y.recall - x.recall end, 6) as difference
from vs join la x on x.model_version = a join la y on y.model_version = b, unnest(['accuracy', 'precision', 'recall']) as u(m)""")
def _(t):
    ends = t.model_metrics.agg(F.min("model_version").alias("a"), F.max("model_version").alias("b")).first()
    return mx.compare_versions(t.model_metrics, ends["a"], ends["b"], ["accuracy", "precision", "recall"])


TREND = """h as (select *, row_number() over (order by evaluated_at desc, model_version) as rn from model_metrics), two as (select a.*, b.accuracy as previous from h a left join h b on b.rn = 2 where a.rn = 1)"""
TREND_CASE = "case when accuracy > previous + 0.01 then 'improving' when accuracy < previous - 0.01 then 'degrading' else 'stable' end"


@query("metric_trend", f"with {TREND} select model_version, evaluated_at, accuracy as latest, previous, {TREND_CASE} as trend from two")
def _(t):
    return mx.metric_trend(t.model_metrics)


@query("metrics_summary", f"""
with {TREND}, r as (select * from model_metrics where evaluated_at >= timestamp '2023-01-31 00:00:00' order by evaluated_at desc, model_version limit 100)
select count(*) as total_evaluations, round_even(avg(r.accuracy), 6) as avg_accuracy, round_even(avg(r.precision), 6) as avg_precision, round_even(avg(r.recall), 6) as avg_recall,
  (select model_version from two) as latest_version, (select accuracy from two) as latest_accuracy, (select {TREND_CASE} from two) as trend from r""")
def _(t):
    recent = ev.in_window(t.model_metrics, AS_OF, 365 * 24, "evaluated_at").orderBy(F.desc("evaluated_at"), "model_version").limit(100)
    means = recent.agg(F.count("*").alias("total_evaluations"), *[rounded(F.avg(c), 6).alias("avg_" + c) for c in ("accuracy", "precision", "recall")])
    last = mx.metric_trend(recent).select(F.col("model_version").alias("latest_version"), F.col("latest").alias("latest_accuracy"), "trend")
    return ev.one_row(means, last)


# ------------------------------------------------------------------ labelled frames
LABEL2 = "severity in ('critical', 'high') or is_blocked or event_type in ('brute_force', 'port_scan', 'sql_injection', 'ddos', 'malicious_traffic') or coalesce(attack_vector in ('brute_force', 'port_scan', 'sql_injection', 'ddos'), false)"
FRAME_COLS = "hour, day_of_week, is_weekend, is_night, severity_level, path_length, has_query_string, suspicious_chars, ua_length, is_bot"


def base_features(label: str, where: str = "true") -> str:
    return f"""select id, source_ip, cast(hour(timestamp) as int) as hour, {RANK} + 1 as severity_level, cast(length(request_path) as int) as path_length, coalesce(f.http_requests, 0) as http_requests, coalesce(f.connections_count, 0) as connections_count,
  case when {label} then 1 else 0 end as label from full_events e left join feats f on e.source_ip = f.ip where {where}"""


@query("training_frame", f"with {FEATS} {base_features(f'severity in ({chr(39)}critical{chr(39)}, {chr(39)}high{chr(39)}) or exists(select 1 from blocked_ips b where b.ip_address = e.source_ip and {ACTIVE})')}")
def _(t):
    from ..ml import frames

    return frames.training_frame(t.full_events, features(t), t.blocked_ips, AS_OF).select(
        "id", "source_ip", "hour", "severity_level", "path_length", "http_requests", "connections_count", "label")


@query("validation_frame", f"with {FEATS} {base_features(LABEL2, f'timestamp >= {D30}')}")
def _(t):
    from ..ml import frames

    return frames.validation_frame(t.full_events, features(t), AS_OF).select(
        "id", "source_ip", "hour", "severity_level", "path_length", "http_requests", "connections_count", "label")


@query("stratified_split", """
with x as (select id, label, md5(cast(id as varchar)) as h from (select id, case when severity in ('critical', 'high') then 1 else 0 end as label from security_events)),
r as (select *, row_number() over (partition by label order by h, id) as rn, count(*) over (partition by label) as n from x)
select id, label, case when rn <= floor(n * 0.8) then 'train' else 'test' end as part from r""")
def _(t):
    from ..ml import frames

    rows = t.security_events.select("id", F.when(F.col("severity").isin("critical", "high"), 1).otherwise(0).alias("label"))
    return frames.stratified_split(rows, "label", "id", 0.8)
