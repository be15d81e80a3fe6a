"""Queries over security events: lookups, reports, per-address and per-country views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions import text
from ..functions.times import before
from ..operators import events as ev, geo
from .registry import query
from .views import AS_OF

D1 = "timestamp '2024-01-30 00:00:00'"
D7 = "timestamp '2024-01-24 00:00:00'"
D30 = "timestamp '2024-01-01 00:00:00'"
NOW = "timestamp '2024-01-31 00:00:00'"
ACTIVE = f"(is_permanent or unblock_time is null or unblock_time > {NOW})"
ACTIVE_DATED = f"(is_permanent or coalesce(unblock_time > {NOW}, false))"
SRC = """case when lower(event_type) like '%ml\\_%' escape '\\' or event_type = 'suspicious_traffic' then 'ml'
  when regexp_matches(lower(event_type), 'port_scan|dns_tunnel|beaconing|dga|ssl') then 'zeek'
  when event_type like '%ban%' or event_type like '%blocked%' then 'fail2ban' else 'other' end"""
RANK = "case severity when 'low' then 0 when 'medium' then 1 when 'high' then 2 when 'critical' then 3 end"
RANK_NAME = "case max({r}) when 0 then 'low' when 1 then 'medium' when 2 then 'high' when 3 then 'critical' end".format(r=RANK)
SEV4 = ", ".join(f"count(*) filter (where severity = '{s}') as {s}" for s in ("critical", "high", "medium", "low"))
PTS = "case severity when 'critical' then 50 when 'high' then 30 when 'medium' then 10 when 'low' then 5 else {d} end"
IPNUM = ("cast(split_part({c}, '.', 1) as bigint) * 16777216 + cast(split_part({c}, '.', 2) as bigint) * 65536 + "
         "cast(split_part({c}, '.', 3) as bigint) * 256 + cast(split_part({c}, '.', 4) as bigint)")
PRIVATE = "(" + " or ".join(f"starts_with({{c}}, '{p}')" for p in (
    "127.", "10.", "172.16.", "192.168.", "::1", "fe80:", "fc00:")) + ")"


def hex6(c: str) -> str:
    """Check-side key of an IPv6 text: its 32 digits."""
    left = f"list_filter(string_split(split_part(lower({c}), '::', 1), ':'), lambda x: x <> '')"
    right = f"list_filter(string_split(case when contains({c}, '::') then split_part(lower({c}), '::', 2) else '' end, ':'), lambda x: x <> '')"
    middle = f"list_transform(range(8 - len({left}) - len({right})), lambda i: '0')"
    return f"array_to_string(list_transform(list_concat({left}, {middle}, {right}), lambda x: lpad(x, 4, '0')), '')"


def places_sql(ips: str) -> str:
    """Check-side place lookup: ``ips`` is a query giving a column ip."""
    return f"""select i.ip, case when {PRIVATE.format(c='i.ip')} then 'LAN' else coalesce(g.country_code, 'XX') end as country_code,
      case when {PRIVATE.format(c='i.ip')} then 'Private Network' else coalesce(g.country_name, 'Unknown') end as country_name,
      case when {PRIVATE.format(c='i.ip')} then 'Private' else coalesce(g.continent_name, 'Unknown') end as continent_name
      from ({ips}) i left join geo_ranges g on {IPNUM.format(c='i.ip')} between g.ip_from and g.ip_to"""


def both_places_sql(ips: str) -> str:
    """The same for addresses of both families; of several IPv6 ranges the innermost."""
    return f"""select ip, country_code, country_name, continent_name from ({places_sql(f"select ip from ({ips}) where not contains(ip, ':')")})
    union all select c.ip, p.country_code, p.country_name, p.continent_name from (select ip, substr(ip, 8) as dotted from ({ips}) where contains(ip, ':') and contains(ip, '.')) c
      join ({places_sql(f"select distinct substr(ip, 8) as ip from ({ips}) where contains(ip, ':') and contains(ip, '.')")}) p on p.ip = c.dotted
    union all select i.ip, case when {PRIVATE.format(c='i.ip')} then 'LAN' else coalesce(g.country_code, 'XX') end,
      case when {PRIVATE.format(c='i.ip')} then 'Private Network' else coalesce(g.country_name, 'Unknown') end,
      case when {PRIVATE.format(c='i.ip')} then 'Private' else coalesce(g.continent_name, 'Unknown') end
      from (select ip, {hex6('ip')} as h from ({ips}) where contains(ip, ':') and not contains(ip, '.')) i
      left join (select *, {hex6('first_ip')} as h1, {hex6('last_ip')} as h2 from geo_ranges_six) g on i.h between g.h1 and g.h2
      qualify row_number() over (partition by i.ip order by g.h1 desc, g.h2) = 1"""


def both_ranges(t):
    return geo.all_ranges(t.geo_ranges, t.geo_ranges_six)


EVENT_COLS = "id, timestamp, source_ip, event_type, severity"


def cols(df):
    return df.select(*[c.strip() for c in EVENT_COLS.split(",")])


# ------------------------------------------------------------------ lookups
@query("recent_events", f"select {EVENT_COLS} from security_events where timestamp >= {D1} order by timestamp desc, id desc limit 100")
def _(t):
    return cols(ev.recent_events(t.security_events, AS_OF))


@query("events_by_ip", f"select {EVENT_COLS} from security_events where source_ip = '203.0.0.7' order by timestamp desc, id desc limit 50")
def _(t):
    return cols(ev.events_by_ip(t.security_events, "203.0.0.7"))


@query("events_by_type", f"select {EVENT_COLS} from security_events where event_type = 'port_scan' and timestamp >= {D1}")
def _(t):
    return cols(ev.events_by_type(t.security_events, "port_scan", AS_OF))


@query("events_filtered", f"select {EVENT_COLS} from security_events where severity = 'critical' and event_type = 'http_attack' order by timestamp desc, id desc limit 100")
def _(t):
    return cols(ev.events_filtered(t.security_events, "critical", "http_attack"))


@query("event_by_id", f"select {EVENT_COLS} from security_events where id = 77")
def _(t):
    return cols(ev.event_by_id(t.security_events, 77))


@query("active_blocks", f"select ip_address, is_permanent, unblock_time, last_blocked, threat_level from blocked_ips where {ACTIVE}")
def _(t):
    return (
        t.blocked_ips.filter(ev.active_block(AS_OF))
        .orderBy(F.desc("last_blocked"), "ip_address")
        .select("ip_address", "is_permanent", "unblock_time", "last_blocked", "threat_level")
    )


@query("ip_block_status", f"""
select e.ip, case when b.ip_address is null then false when b.is_permanent then true
  when b.unblock_time <= {NOW} then false else true end as is_blocked
from (select distinct source_ip as ip from security_events) e left join blocked_ips b on e.ip = b.ip_address""")
def _(t):
    ips = t.security_events.select(F.col("source_ip").alias("ip")).distinct()
    return block_status(ips, t.blocked_ips)


def block_status(ips, blocked):
    now = blocked.withColumn("active", ev.active_block(AS_OF)).groupBy(F.col("ip_address").alias("ip")).agg(
        F.bool_or("active").alias("active"))
    return ips.join(now, "ip", "left").select("ip", F.coalesce("active", F.lit(False)).alias("is_blocked"))


@query("ip_list_membership", """
select e.ip, count(*) filter (where l.list = 'whitelist' and l.is_active) > 0 as is_whitelisted,
  count(*) filter (where l.list = 'blacklist' and l.is_active) > 0 as is_blacklisted
from (select distinct source_ip as ip from security_events) e left join ip_lists l on e.ip = l.ip_address group by e.ip""")
def _(t):
    ips = t.security_events.select(F.col("source_ip").alias("ip")).distinct()
    return list_flags(ips, t.ip_lists)


def list_flags(ips, lists):
    flags = lists.filter("is_active").groupBy(F.col("ip_address").alias("ip")).agg(
        F.bool_or(F.col("list") == "whitelist").alias("w"), F.bool_or(F.col("list") == "blacklist").alias("b"))
    return ips.join(flags, "ip", "left").select(
        "ip", F.coalesce("w", F.lit(False)).alias("is_whitelisted"), F.coalesce("b", F.lit(False)).alias("is_blacklisted"))


THREAT_COLS = ["id", "detected_at", "threat_type", "severity", "source", "description"]


@query("active_threats", "select id, detected_at, threat_type, severity, source, description from threats where not is_resolved and not false_positive")
def _(t):
    return t.threats.filter(~F.col("is_resolved") & ~F.col("false_positive")).orderBy(*ev.newest("detected_at")).select(*THREAT_COLS)


@query("threats_by_type", "select id, detected_at, threat_type, severity, source, description from threats where threat_type = 'beaconing'")
def _(t):
    return t.threats.filter(F.col("threat_type") == "beaconing").select(*THREAT_COLS)


@query("threats_by_severity", "select id, detected_at, threat_type, severity, source, description from threats where severity = 'high'")
def _(t):
    return t.threats.filter(F.col("severity") == "high").select(*THREAT_COLS)


@query("recent_threats", "select id, detected_at, threat_type, severity, source, description from threats order by detected_at desc, id desc limit 10")
def _(t):
    return t.threats.orderBy(*ev.newest("detected_at")).limit(10).select(*THREAT_COLS)


ALERT_COLS = "id, created_at, alert_type, severity, title, source, is_read, is_resolved"


@query("alerts_by_status", f"select * from (select {ALERT_COLS} from alerts where is_read and not is_resolved and severity = 'high' order by created_at desc, id desc limit 50)")
def _(t):
    return alerts_by_status(t.alerts, "dismissed", "high")


def alerts_by_status(alerts, status="pending", severity=None, limit=50):
    conditions = {
        "pending": ~F.col("is_resolved"),
        "resolved": F.col("is_resolved"),
        "dismissed": F.col("is_read") & ~F.col("is_resolved"),
    }
    if status in conditions:
        alerts = alerts.filter(conditions[status])
    if severity is not None:
        alerts = alerts.filter(F.col("severity") == severity)
    return alerts.orderBy(*ev.newest("created_at")).limit(limit)


@query("unread_alerts", f"select {ALERT_COLS} from alerts where not is_read")
def _(t):
    return t.alerts.filter(~F.col("is_read")).orderBy(*ev.newest("created_at"))


@query("recent_system_logs", f"select * from system_logs where timestamp >= {D1} order by timestamp desc, id desc limit 100")
def _(t):
    return ev.recent_events(t.system_logs, AS_OF)


@query("alert_log_list", f"select id, channel_id, severity, sent_at, success from alert_logs where sent_at >= {D1} and severity = 'HIGH' and success order by sent_at desc, id desc limit 100")
def _(t):
    logs = ev.in_window(t.alert_logs, AS_OF, 24, "sent_at").filter((F.col("severity") == "high".upper()) & F.col("success"))
    return logs.orderBy(*ev.newest("sent_at")).limit(100).select("id", "channel_id", "severity", "sent_at", "success")


@query("metrics_history", f"select model_version, run, evaluated_at, accuracy, precision, recall, samples from model_metrics where evaluated_at >= {D30} order by evaluated_at desc, model_version limit 50")
def _(t):
    return ev.in_window(t.model_metrics, AS_OF, 30 * 24, "evaluated_at").orderBy(F.desc("evaluated_at"), "model_version").limit(50).select(
        "model_version", "run", "evaluated_at", "accuracy", "precision", "recall", "samples")


@query("auto_blocks_recent", f"select ip_address, is_permanent, last_blocked, threat_level from blocked_ips where blocked_by = 'auto_blocker' and last_blocked >= {D1}")
def _(t):
    return auto_blocks(t.blocked_ips).select("ip_address", "is_permanent", "last_blocked", "threat_level")


def auto_blocks(blocked, hours=24):
    return ev.in_window(blocked, AS_OF, hours, "last_blocked").filter(F.col("blocked_by") == "auto_blocker")


@query("cached_predictions", f"select ip_address, ml_confidence, threat_score, last_seen from predictions where ml_confidence >= 0.6 and last_seen >= {D7} and is_valid")
def _(t):
    return cached_predictions(t.predictions, 24 * 7).select("ip_address", "ml_confidence", "threat_score", "last_seen")


def cached_predictions(predictions, hours, min_confidence=0.6, only_valid=True):
    rows = ev.in_window(predictions, AS_OF, hours, "last_seen").filter(F.col("ml_confidence") >= min_confidence)
    if only_valid:
        rows = rows.filter("is_valid")
    return rows.orderBy(F.desc("threat_score"), "ip_address")


# ------------------------------------------------------------------ one-row reports
@query("security_dashboard", f"""
select (select count(*) from security_events where timestamp > {D1}) as attacks_today,
  (select count(*) from blocked_ips where not is_permanent) as temp_blocked_ips,
  (select count(*) from blocked_ips where is_permanent) as perm_blocked_ips,
  (select count(*) from threats where not is_resolved) as active_threats,
  (select count(*) from alerts where not is_resolved) as pending_alerts,
  (select count(distinct source_ip) from security_events where timestamp > timestamp '2024-01-30 23:00:00') as active_attackers""")
def _(t):
    return ev.security_dashboard(t.security_events, t.blocked_ips, t.threats, t.alerts, AS_OF)


@query("dashboard_stats", f"""
select (select count(*) from security_events where timestamp >= {D1}) as total_events_24h,
  (select count(*) from security_events where timestamp >= {D1} and severity = 'critical') as critical_events_24h,
  (select count(*) from blocked_ips where {ACTIVE_DATED}) as total_blocked_ips,
  (select count(*) from threats where not is_resolved) as active_threats,
  (select count(*) from alerts where not is_resolved) as pending_alerts""")
def _(t):
    return ev.dashboard_stats(t.security_events, t.blocked_ips, t.threats, t.alerts, AS_OF)


@query("attack_totals", f"select count(*) as total_events, count(distinct source_ip) as unique_ips from security_events where timestamp >= {D1}")
def _(t):
    return ev.attack_totals(t.security_events, AS_OF)


@query("attacks_by_type", f"select event_type, count(*) as count from security_events where timestamp >= {D1} group by event_type")
def _(t):
    return ev.attacks_by_type(t.security_events, AS_OF)


@query("attacks_by_severity", f"select {SEV4} from security_events where timestamp >= {D1}")
def _(t):
    return ev.attacks_by_severity(t.security_events, AS_OF)


@query("attacks_by_country", f"""
select country, count(*) as count from (select json_extract_string(nullif(geo_location, ''), '$.country') as country from geo_events where timestamp >= {D1})
where country is not null and country not in ('', 'Unknown', 'unknown') group by country""")
def _(t):
    return ev.attacks_by_country(t.geo_events, AS_OF)


@query("hourly_severity", f"""
select cast(h.b as int) as bin, strftime({D1} + interval 1 hour * h.b, '%H:%M') as hour,
  {", ".join(f"count(e.id) filter (where severity = '{s}') as {s}" for s in ("critical", "high", "medium", "low"))}
from range(24) h(b) left join security_events e on e.timestamp >= {D1} + interval 1 hour * h.b and e.timestamp < {D1} + interval 1 hour * (h.b + 1)
group by h.b""")
def _(t):
    return ev.hourly_severity(t.security_events, AS_OF)


@query("integrated_summary", f"""
select count(*) as total_events, count(distinct source_ip) as unique_ips, {SEV4},
  count(*) filter (where event_type in ('http_attack', 'suspicious_traffic', 'ml_detection')) as ml,
  count(*) filter (where event_type in ('port_scan', 'dns_tunneling', 'beaconing', 'dga_domain', 'ssl_self_signed')) as zeek,
  count(*) filter (where event_type like '%ban%') as fail2ban
from security_events where timestamp >= {D1}""")
def _(t):
    return ev.integrated_summary(t.security_events, AS_OF)


# ------------------------------------------------------------------ per address
@query("top_attackers", f"""
select source_ip, count(*) as attack_count, count(distinct event_type) as attack_types, max(timestamp) as last_attack,
  {RANK_NAME} as max_severity, string_agg(distinct event_type, ',' order by event_type) as attack_methods
from security_events where timestamp > {D7} group by source_ip order by attack_count desc, source_ip limit 100""")
def _(t):
    return ev.top_attackers(t.security_events, AS_OF)


TOP_IPS = f"""
top as (select source_ip, count(*) as count, {RANK_NAME} as max_severity, coalesce(max(country_code), 'Unknown') as country
  from security_events where timestamp >= {D1} group by source_ip order by count desc, source_ip limit 10),
flagged as (select t.*, exists(select 1 from blocked_ips b where b.ip_address = t.source_ip and {ACTIVE_DATED}) as is_blocked from top t)"""


@query("top_ips_blocked_flag", f"with {TOP_IPS} select source_ip, count, max_severity, country, is_blocked from flagged")
def _(t):
    return ev.top_ips_blocked_flag(t.security_events, t.blocked_ips, AS_OF)


@query("attack_geo_points", f"with {TOP_IPS} select source_ip as ip, country, count, max_severity as severity from flagged where country not in ('Unknown', '')")
def _(t):
    return ev.attack_geo_points(t.security_events, t.blocked_ips, AS_OF)


@query("recent_attacks", f"""
with placed as ({places_sql('select distinct ip_address as ip from blocked_ips')})
select e.id, e.timestamp, e.event_type, e.severity, e.source_ip, e.protocol, e.attack_vector, p.country_name as country
from security_events e left join placed p on e.source_ip = p.ip where e.timestamp > {D1}""")
def _(t):
    blocked = geo.geo_lookup(t.blocked_ips, t.geo_ranges, "ip_address").select(
        F.col("ip").alias("ip_address"), F.col("country_name").alias("country"))
    return ev.recent_attacks(t.security_events, blocked, AS_OF)


BEST = f"(select ip_address as ip, max(ml_confidence) as best from predictions where last_seen >= {D1} group by 1)"


@query("top_threats", f"""
with x as (select *, {SRC} as src, {PTS.format(d=0)} as pts from security_events where timestamp >= {D1}),
a as (select source_ip as ip, count(*) as total_events, count(*) filter (where src = 'ml') as ml_count, count(*) filter (where src = 'zeek') as zeek_detections,
  count(*) filter (where src = 'fail2ban') as fail2ban_bans, cast(sum(pts) as bigint) as p, {SEV4}, max(timestamp) as last_seen,
  coalesce(max(country_code), 'Unknown') as country, string_agg(distinct event_type, '|' order by event_type) as event_types from x group by 1),
b as (select a.*, case when ml_count > 0 then coalesce(cast(floor(best * 100 + 1e-9) as bigint), 0) else 0 end as ml_confidence from a left join {BEST} m using (ip))
select * exclude (p), ml_confidence + zeek_detections * 10 + fail2ban_bans * 20 + p as score from b order by score desc, ip limit 10""")
def _(t):
    return ev.top_threats(t.security_events, t.predictions, AS_OF)


@query("threat_ml_confidence", f"select t.id, t.threat_type, t.source, coalesce(best, 0.0) as ml_confidence from threats t left join {BEST} m on t.source = m.ip")
def _(t):
    return ev.threat_ml_confidence(t.threats, t.predictions, AS_OF, 24)


@query("threat_map", f"""
with x as (select *, {SRC} as src, {PTS.format(d=5)} as pts from security_events where timestamp >= {D1} and country_code is not null and country_code <> 'XX'),
i as (select country_code as country, source_ip, row_number() over (partition by country_code order by source_ip) as rn from (select distinct country_code, source_ip from x))
select country_code as country, count(*) as count, round_even(avg(pts), 2) as avg_score, count(distinct source_ip) as unique_ips,
  count(*) filter (where src = 'ml') as ml, count(*) filter (where src = 'zeek') as zeek, count(*) filter (where src = 'fail2ban') as fail2ban,
  (select string_agg(i.source_ip, '|' order by i.source_ip) from i where i.country = x.country_code and rn <= 10) as ips
from x group by country_code""")
def _(t):
    m = ev.threat_map(t.security_events, AS_OF)
    return m.withColumn("ml", F.col("ml").cast("bigint")).withColumn("avg_score", F.col("avg_score").cast("double"))


@query("attack_timeline", f"""
select strftime(date_trunc('day', timestamp) + interval 1 minute * (cast(floor((hour(timestamp) * 60 + minute(timestamp)) / 50) as int) * 50), '%Y-%m-%d %H:%M') as timestamp,
  count(*) filter (where src = 'ml') as ml_detections, count(*) filter (where src = 'zeek') as zeek_detections,
  count(*) filter (where src = 'fail2ban') as fail2ban_bans, count(*) as total, {SEV4}
from (select *, {SRC} as src from security_events where timestamp >= {D7}) x group by 1""")
def _(t):
    return ev.attack_timeline(t.security_events, AS_OF, hours=24 * 7, minutes=50)


FLAGS = f"""f as (select source_ip as ip, bool_or(src = 'ml') as ml, bool_or(src = 'zeek') as zeek, bool_or(src = 'fail2ban') as ban
  from (select source_ip, {SRC} as src from security_events where timestamp >= {D1}) group by 1)"""


@query("source_correlation", f"""
with {FLAGS} select count(*) filter (where ml) as ml_unique, count(*) filter (where zeek) as zeek_unique, count(*) filter (where ban) as fail2ban_unique,
  count(*) filter (where ml and zeek) as ml_and_zeek, count(*) filter (where ml and ban) as ml_and_fail2ban, count(*) filter (where zeek and ban) as zeek_and_fail2ban,
  count(*) filter (where ml and zeek and ban) as all_three,
  (select coalesce(string_agg(ip, '|' order by ip), '') from (select ip from f where ml and zeek order by ip limit 10)) as ml_and_zeek_ips,
  (select coalesce(string_agg(ip, '|' order by ip), '') from (select ip from f where ml and zeek and ban order by ip limit 10)) as all_three_ips
from f""")
def _(t):
    return ev.source_correlation(t.security_events, AS_OF)


@query("intersect_sources", f"""
with {FLAGS} select ip, 'ml_and_zeek' as seen_by from f where ml and zeek union all select ip, 'ml_and_fail2ban' from f where ml and ban
union all select ip, 'zeek_and_fail2ban' from f where zeek and ban union all select ip, 'all_three' from f where ml and zeek and ban""")
def _(t):
    rows = ev.in_window(t.security_events, AS_OF, 24).withColumn("src", text.event_source(F.col("event_type")))
    ips = {s: rows.filter(F.col("src") == s).select(F.col("source_ip").alias("ip")) for s in ("ml", "zeek", "fail2ban")}
    pairs = {
        "ml_and_zeek": ips["ml"].intersect(ips["zeek"]),
        "ml_and_fail2ban": ips["ml"].intersect(ips["fail2ban"]),
        "zeek_and_fail2ban": ips["zeek"].intersect(ips["fail2ban"]),
        "all_three": ips["ml"].intersect(ips["zeek"]).intersect(ips["fail2ban"]),
    }
    out = None
    for name, df in pairs.items():
        df = df.withColumn("seen_by", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


@query("ip_details", f"""
with s as (select {EVENT_COLS} from security_events union all select {EVENT_COLS} from events_six),
l as (select *, row_number() over (partition by source_ip order by timestamp desc, id desc) as rn from s),
k as (select * from l where rn <= 50),
ty as (select source_ip, string_agg(v, '|' order by v) as event_types from (select source_ip, event_type || '=' || count(*) as v from k group by source_ip, event_type) group by 1),
se as (select source_ip, string_agg(v, '|' order by v) as severities from (select source_ip, upper(severity) || '=' || count(*) as v from k group by source_ip, severity) group by 1),
ml as (select ip_address, count(*) as n, round_even(avg(ml_confidence), 4) as a, round_even(max(ml_confidence), 4) as m from predictions group by 1),
g as ({both_places_sql('select distinct source_ip as ip from s')}),
a as (select source_ip as ip, count(*) as total_events, min(timestamp) as first_seen, max(timestamp) as last_seen,
  string_agg(event_type || ':' || severity, '|' order by rn) filter (where rn <= 10) as recent_events from k group by 1)
select a.*, ty.event_types, se.severities, coalesce(ml.n, 0) as total_predictions, coalesce(ml.a, 0) as avg_confidence, coalesce(ml.m, 0) as max_confidence,
  g.country_code, g.country_name, g.continent_name
from a join ty on ty.source_ip = a.ip join se on se.source_ip = a.ip left join ml on ml.ip_address = a.ip left join g on g.ip = a.ip""")
def _(t):
    rows = cols(t.security_events).unionByName(cols(t.events_six))
    return ev.ip_details(rows, t.predictions, geo.geo_lookup(rows, both_ranges(t), "source_ip"))


# ------------------------------------------------------------------ per country
PLACED = places_sql("select distinct source_ip as ip from security_events")


@query("country_stats", f"""
with g as ({PLACED}), x as (select e.*, g.country_code as cc, g.country_name as cn from security_events e join g on e.source_ip = g.ip),
k as (select cc, string_agg(v, '|' order by v) as event_types from (select cc, event_type || '=' || count(*) as v from x group by cc, event_type) group by cc)
select x.cc as country_code, min(cn) as country_name, count(*) as total_events, count(distinct source_ip) as unique_ips,
  count(*) filter (where severity in ('critical', 'high')) as malicious_events, min(k.event_types) as event_types,
  round_even(count(*) filter (where severity in ('critical', 'high')) / count(*) * 100, 4) as malicious_percentage
from x join k on x.cc = k.cc group by x.cc""")
def _(t):
    return ev.country_stats(t.security_events, geo.geo_lookup(t.security_events, t.geo_ranges, "source_ip"))


@query("country_severity", f"""
select coalesce(json_extract_string(geo_location, '$.country_code'), 'XX') as country_code,
  min(coalesce(json_extract_string(geo_location, '$.country'), 'Unknown')) as country, count(*) as total_events, {SEV4}
from (select * from geo_events where geo_location <> '') group by 1""")
def _(t):
    return ev.country_severity(t.geo_events)


@query("available_countries", """
select code, min(name) as name from (select json_extract_string(geo_location, '$.country_code') as code, json_extract_string(geo_location, '$.country') as name
  from geo_events where geo_location <> '') where code <> 'XX' group by code""")
def _(t):
    return ev.available_countries(t.geo_events)


EITHER = "select id, source_ip from security_events union all select id, source_ip from events_six"


@query("geo_enrich", f"""
with e as ({EITHER}), g as ({both_places_sql("select distinct source_ip as ip from e")})
select e.id, e.source_ip, g.country_code, g.country_name, g.continent_name from e join g on e.source_ip = g.ip""")
def _(t):
    rows = t.security_events.select("id", "source_ip").unionByName(t.events_six.select("id", "source_ip"))
    return geo.geo_enrich(rows, both_ranges(t), "source_ip")


GEO_TEXT = "concat('{\"country\":\"', g.country_name, '\",\"country_code\":\"', g.country_code, '\",\"city\":\"', g.continent_name, '\",\"latitude\":0,\"longitude\":0}')"


@query("backfill_event_geo", f"""
with e as (select id, source_ip, geo_location from geo_events union all select id, source_ip, geo_location from events_six),
g as ({both_places_sql("select distinct source_ip as ip from e")})
select e.id, e.source_ip, case when e.geo_location is null or e.geo_location = '' then {GEO_TEXT} else e.geo_location end as geo_location
from e left join g on e.source_ip = g.ip""")
def _(t):
    kept = ["id", "source_ip", "geo_location"]
    return geo.backfill_event_geo(t.geo_events.select(*kept).unionByName(t.events_six.select(*kept)), both_ranges(t))


@query("geo_json", f"with g as ({PLACED}) select g.ip, {GEO_TEXT} as geo_location, g.country_code as read_back from g")
def _(t):
    places = geo.geo_lookup(t.security_events, t.geo_ranges, "source_ip")
    made = places.select("ip", text.geo_json(F.col("country_name"), F.col("country_code"), F.col("continent_name")).alias("geo_location"))
    return made.withColumn("read_back", text.parse_geo(F.col("geo_location"))["country_code"])


@query("geo_coverage", "select count(*) filter (where geo_location <> '') as with_geo, count(*) as total_events from geo_events")
def _(t):
    return geo.geo_coverage(t.geo_events)


PRED_COUNTRY = """select ip_address, case when ml_confidence < 0.5 then 'Unknown' when ml_confidence > 0.9 then null else 'Old (OO)' end as country,
  case when ml_confidence between 0.5 and 0.9 then 'OO' else 'XX' end as country_code from predictions
  union all select concat('10.', substr(ip_address, 1, 4), 'x'), 'Unknown', 'XX' from predictions
  union all select distinct source_ip, 'Unknown', 'XX' from events_six"""


@query("backfill_prediction_country", f"""
with p as ({PRED_COUNTRY}), g as ({both_places_sql("select distinct ip_address as ip from predictions union select source_ip from events_six")})
select ip_address, case when coalesce(country, 'Unknown') <> 'Unknown' then country when starts_with(ip_address, '10.') then 'Private Network (LAN)'
    when g.country_code <> 'XX' then g.country_name || ' (' || g.country_code || ')' else country end as country,
  case when coalesce(country, 'Unknown') <> 'Unknown' then p.country_code when starts_with(ip_address, '10.') then 'LAN'
    when g.country_code <> 'XX' then g.country_code else p.country_code end as country_code
from p left join g on p.ip_address = g.ip""")
def _(t):
    rows = t.spark.sql(PRED_COUNTRY.replace("from predictions", "from {predictions}").replace("from events_six", "from {events_six}"), predictions=t.predictions, events_six=t.events_six)
    return geo.backfill_prediction_country(rows, both_ranges(t))


@query("is_private_ip", f"""select ip, {PRIVATE.format(c='ip')} as is_private from (select distinct source_ip as ip from dns union select distinct source_ip from security_events)""")
def _(t):
    ips = t.dns.select(F.col("source_ip").alias("ip")).union(t.security_events.select("source_ip")).distinct()
    return ips.select("ip", text.is_private_ip(F.col("ip")).alias("is_private"))


OWNER = "lower(coalesce(isp, '')) || ' / ' || lower(coalesce(org, ''))"


@query("is_vpn_or_proxy", f"select ip, regexp_matches({OWNER}, 'vpn|proxy|tor|relay|exit|hosting|datacenter|cloud') as is_vpn from ip_orgs")
def _(t):
    return t.ip_orgs.select("ip", text.is_vpn_or_proxy(F.col("isp"), F.col("org")).alias("is_vpn"))


@query("is_cloud_provider", f"select ip, regexp_matches({OWNER}, 'amazon|aws|microsoft|azure|google|digitalocean|linode|ovh|hetzner|vultr|rackspace|cloudflare') as is_cloud from ip_orgs")
def _(t):
    return t.ip_orgs.select("ip", text.is_cloud_provider(F.col("isp"), F.col("org")).alias("is_cloud"))


BLOCKED_COUNTRIES = ["CN", "RU"]


@query("country_blocked", f"with g as ({PLACED}) select ip, country_code, country_code in ('CN', 'RU') as is_blocked_country from g")
def _(t):
    g = geo.geo_lookup(t.security_events, t.geo_ranges, "source_ip")
    return g.select("ip", "country_code", geo.country_blocked(F.col("country_code"), True, BLOCKED_COUNTRIES).alias("is_blocked_country"))


ALL_IPS = "select distinct source_ip as ip from dns union select distinct source_ip from security_events"


@query("country_allowed", f"""
with g as ({places_sql(ALL_IPS)})
select ip, 'blacklist' as mode, case when {PRIVATE.format(c='ip')} then true else country_code not in ('CN', 'RU') end as allowed,
  case when {PRIVATE.format(c='ip')} then 'IP privada/local' when country_code in ('CN', 'RU') then 'País bloqueado: ' || country_name || ' (' || country_code || ')'
    else 'País permitido: ' || country_name || ' (' || country_code || ')' end as reason from g
union all
select ip, 'whitelist', case when {PRIVATE.format(c='ip')} then true else country_code in ('US', 'DE') end,
  case when {PRIVATE.format(c='ip')} then 'IP privada/local' when country_code in ('US', 'DE') then 'País permitido: ' || country_name || ' (' || country_code || ')'
    else 'País no permitido: ' || country_name || ' (' || country_code || ')' end from g""")
def _(t):
    ips = t.dns.select(F.col("source_ip").alias("ip")).union(t.security_events.select("source_ip"))
    g = geo.geo_lookup(ips, t.geo_ranges)
    out = []
    for mode, countries in (("blacklist", ["CN", "RU"]), ("whitelist", ["US", "DE"])):
        policy = {"enabled": True, "mode": mode, "countries": countries, "block_unknown": False}
        allowed, reason = geo.country_allowed(F.col("ip"), F.col("country_code"), F.col("country_name"), policy)
        out.append(g.select("ip", F.lit(mode).alias("mode"), allowed.alias("allowed"), reason.alias("reason")))
    return out[0].unionByName(out[1])


# ------------------------------------------------------------------ rollups and shares
@query("hourly_stats_rollup", """
with r as (select date_trunc('hour', e.timestamp) as hour, e.source_ip, case when e.severity <> 'low' then e.event_type end as event_type, e.is_blocked, e.country_code, h.size as bytes
  from security_events e join http_access h on e.id = h.id),
k as (select hour, string_agg(v, '|' order by v) as attacks_by_type from (select hour, event_type || '=' || count(*) as v from r where event_type is not null group by hour, event_type) group by 1),
c as (select hour, string_agg(country_code || '=' || n, '|' order by rk) as top_countries from (select *, row_number() over (partition by hour order by n desc, country_code) as rk
  from (select hour, country_code, count(*) as n from r where country_code is not null group by 1, 2)) where rk <= 3 group by 1)
select r.hour, count(*) as total_requests, count(*) filter (where is_blocked) as blocked_requests, count(distinct source_ip) as unique_ips, count(event_type) as attacks_detected,
  cast(coalesce(sum(bytes), 0) as bigint) as bandwidth_used, min(k.attacks_by_type) as attacks_by_type, min(c.top_countries) as top_countries
from r left join k on r.hour = k.hour left join c on r.hour = c.hour group by r.hour""")
def _(t):
    sizes = t.http_access.select("id", F.col("size").alias("bytes"))
    rows = t.security_events.join(sizes, "id").withColumn(
        "event_type", F.when(F.col("severity") != "low", F.col("event_type")))
    return ev.hourly_rollup(rows)


@query("event_type_distribution", f"""
with x as (select * from security_events where timestamp >= {D30}), n as (select count(*) as n from x),
t as (select 'type' as kind, event_type as value, count(*) as count from x group by event_type order by count desc, value limit 10),
s as (select 'severity' as kind, severity as value, count(*) as count from x group by severity)
select kind, value, count, round_even(count / n.n * 100, 1) as percent from (select * from t union all select * from s) u, n""")
def _(t):
    return ev.event_type_distribution(t.security_events, AS_OF)


@query("label_events", f"""
select e.id, case when e.severity in ('critical', 'high') or exists(select 1 from blocked_ips b where b.ip_address = e.source_ip and {ACTIVE}) then 1 else 0 end as label
from security_events e""")
def _(t):
    return ev.label_events(t.security_events.select("id", "source_ip", "severity"), t.blocked_ips, AS_OF).select("id", "label")


# ------------------------------------------------------------------ cache differences
@query("new_ips_since_cache", f"""
select distinct source_ip as ip from security_events where timestamp >= {D1} and source_ip not in
  (select ip_address from predictions where ml_confidence >= 0.6 and last_seen >= {D1} and is_valid)""")
def _(t):
    return new_ips(t)


def new_ips(t, hours=24):
    recent = ev.in_window(t.security_events, AS_OF, hours).select(F.col("source_ip").alias("ip"))
    cached = cached_predictions(t.predictions, hours).select(F.col("ip_address").alias("ip"))
    return recent.join(cached, "ip", "left_anti").distinct()


@query("except_cached", f"""
select source_ip as ip from security_events where timestamp >= {D1} except
select ip_address from predictions where ml_confidence >= 0.6 and last_seen >= {D1} and is_valid""")
def _(t):
    recent = ev.in_window(t.security_events, AS_OF, 24).select(F.col("source_ip").alias("ip"))
    return recent.subtract(cached_predictions(t.predictions, 24).select(F.col("ip_address").alias("ip")))


@query("event_source_class", f"select id, {SRC} as source_class from security_events")
def _(t):
    return t.security_events.select("id", text.event_source(F.col("event_type")).alias("source_class"))


@query("severity_rank", f"select id, severity, {RANK} as rank from security_events")
def _(t):
    return t.security_events.select("id", "severity", text.severity_rank(F.col("severity")).alias("rank"))


@query("auto_block_stats", f"""
with a as (select * from blocked_ips where blocked_by = 'auto_blocker' and last_blocked >= {D1})
select count(*) as total_auto_blocked, {SEV4.replace('severity =', 'threat_level =')},
  count(*) filter (where {ACTIVE}) as currently_active, count(*) filter (where is_permanent) as permanent_blocks,
  (select string_agg(ip_address, '|' order by last_blocked desc, ip_address) from (select * from a order by last_blocked desc, ip_address limit 10)) as recent_blocks
from a""")
def _(t):
    rows = auto_blocks(t.blocked_ips)
    counts = rows.withColumnRenamed("threat_level", "severity").agg(
        F.count("*").alias("total_auto_blocked"), *ev.severity_counts(),
        F.count_if(ev.active_block(AS_OF)).alias("currently_active"), F.count_if("is_permanent").alias("permanent_blocks"))
    newest = rows.select("ip_address", "last_blocked").orderBy(F.desc("last_blocked"), "ip_address").limit(10)
    ordered = F.sort_array(F.collect_list(F.struct((-F.unix_micros(F.col("last_blocked").cast("timestamp"))).alias("o"), "ip_address")))
    return ev.one_row(counts, newest.agg(F.array_join(F.transform(ordered, lambda s: s["ip_address"]), "|").alias("recent_blocks")))


@query("alert_stats", f"""
with x as (select * from alert_logs where sent_at >= {D1})
select 'total' as grp, 'all' as value, count(*) as n, count(*) filter (where success) as ok, count(*) filter (where not success) as failed,
  round_even(count(*) filter (where success) / count(*) * 100, 4) as success_rate from x
union all select 'severity', severity, count(*), count(*) filter (where success), count(*) filter (where not success), round_even(count(*) filter (where success) / count(*) * 100, 4) from x group by severity
union all select 'channel', cast(channel_id as varchar), count(*), count(*) filter (where success), count(*) filter (where not success), round_even(count(*) filter (where success) / count(*) * 100, 4) from x group by channel_id""")
def _(t):
    return alert_stats(t.alert_logs)


def alert_stats(logs, hours=24):
    sets = ev.in_window(logs, AS_OF, hours, "sent_at").groupingSets(
        [("severity",), ("channel_id",), ()], "severity", "channel_id"
    ).agg(
        F.count("*").alias("n"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"),
        F.grouping_id().alias("gid"),
    )
    grp = text.first_case([(F.col("gid") == 1, "severity"), (F.col("gid") == 2, "channel")], "total")
    value = text.first_case(
        [(F.col("gid") == 1, F.col("severity")), (F.col("gid") == 2, F.col("channel_id").cast("string"))], "all")
    rate = rounded(F.coalesce(F.try_divide(F.col("ok"), F.col("n")), F.lit(0.0)) * 100, 4)
    return sets.filter((F.col("gid") != 2) | F.col("channel_id").isNotNull()).select(
        grp.alias("grp"), value.alias("value"), "n", "ok", "failed", rate.alias("success_rate"))


TOP_RULES = f"""tr as (select rule_id, count(*) as n from alert_logs where sent_at >= {D1} and rule_id is not null group by rule_id order by n desc, rule_id limit 5),
tn as (select tr.rule_id, r.rule_name, tr.n as count from tr join alert_rules r on r.id = tr.rule_id)"""


@query("top_alert_rules", f"with {TOP_RULES} select rule_id, rule_name, count from tn")
def _(t):
    return top_rules(t)


def top_rules(t, n=5):
    top = (
        ev.in_window(t.alert_logs, AS_OF, 24, "sent_at").filter(F.col("rule_id").isNotNull())
        .groupBy("rule_id").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "rule_id").limit(n)
    )
    return top.join(t.alert_rules.select(F.col("id").alias("rule_id"), "rule_name"), "rule_id")


@query("alert_dashboard", f"""
with {TOP_RULES}, x as (select * from alert_logs where sent_at >= {D1})
select count(*) as total_sent, count(*) filter (where success) as successful, count(*) filter (where not success) as failed,
  round_even(count(*) filter (where success) / count(*) * 100, 2) as success_rate, {SEV4.replace('severity =', 'lower(severity) =')},
  (select count(*) from alert_channels where is_enabled) as active_channels, (select count(*) from alert_rules where is_enabled) as active_rules,
  (select string_agg(rule_name || '=' || count, '|' order by rule_name) from tn) as top_rules from x""")
def _(t):
    logs = ev.in_window(t.alert_logs, AS_OF, 24, "sent_at").withColumn("severity", F.lower("severity"))
    counts = logs.agg(
        F.count("*").alias("total_sent"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"),
        rounded(F.coalesce(F.try_divide(F.count_if("success"), F.count("*")), F.lit(0.0)) * 100, 2).alias("success_rate"),
        *ev.severity_counts())
    item = F.concat(F.col("rule_name"), F.lit("="), F.col("count").cast("string"))
    return ev.one_row(
        counts,
        t.alert_channels.agg(F.count_if("is_enabled").alias("active_channels")),
        t.alert_rules.agg(F.count_if("is_enabled").alias("active_rules")),
        top_rules(t).agg(F.array_join(F.sort_array(F.collect_list(item)), "|").alias("top_rules")),
    )
