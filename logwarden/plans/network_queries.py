"""Queries over network-monitor tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions import fixed, text
from ..functions.times import ts_lit
from ..operators import network as net
from ..operators.events import in_window
from ..operators.intervals import with_previous
from .event_queries import D1, NOW
from .registry import query
from .views import AS_OF
from .weblog_queries import any_word, lit

CONN = "uid, timestamp, source_ip, dest_ip, dest_port, protocol, conn_state, coalesce(duration, 0) as duration, orig_bytes, coalesce(resp_bytes, 0) as resp_bytes, orig_pkts, resp_pkts"


def conn_cols(df):
    return df.selectExpr(*[c.strip() for c in CONN.replace("coalesce(duration, 0)", "coalesce(duration,0d)").replace("coalesce(resp_bytes, 0)", "coalesce(resp_bytes,0L)").replace(", ", "\n").split("\n")])


ENT = "round_even(coalesce(list_aggregate(string_split({c}, ''), 'entropy'), 0), 2)"
KNOWN = "regexp_matches(lower({c}), '" + "|".join(d.replace(".", "\\.") for d in fixed.KNOWN_DOMAINS) + "')"
SELF = "coalesce(subject = issuer, false)"
EXPIRED = f"coalesce(not_valid_after < {NOW}, false)"
WEAK = "coalesce(regexp_matches(version, 'SSLv2|SSLv3|TLSv1\\.?0|TLSv1\\.?1'), false)"
NOTE_SEV = """case when contains(note, 'Scan::Port_Scan') or contains(note, 'Malware') or contains(note, 'C&C') then 'critical'
  when contains(note, 'SSH::Password_Guessing') or contains(note, 'Brute_Force') then 'high' when contains(note, 'Weird') then 'low' else 'medium' end"""
DNS_W = f"(select * from dns where timestamp >= {D1})"
SSL_W = f"(select * from ssl where timestamp >= {D1})"
CONN_W = f"(select * from conn where timestamp >= {D1})"


# ------------------------------------------------------------------ browsing
@query("suspicious_connections", f"select {CONN} from conn where conn_state in ('S0', 'REJ', 'RSTO', 'RSTOS0') and timestamp >= {D1} order by timestamp desc, uid desc limit 100")
def _(t):
    flagged = t.conn.withColumn("is_suspicious", F.col("conn_state").isin(fixed.FAILED_STATES))
    return conn_cols(in_window(flagged, AS_OF, 24).filter("is_suspicious").orderBy(F.desc("timestamp"), F.desc("uid")).limit(100))


def browse(df, tie, limit=100, **equal):
    for column, value in equal.items():
        df = df.filter(F.col(column) == value)
    return df.orderBy(F.desc("timestamp"), F.col(tie).desc()).limit(limit)


@query("browse_connections", f"select {CONN} from conn where source_ip = '198.18.0.3' and protocol = 'udp' order by timestamp desc, uid desc limit 100")
def _(t):
    return conn_cols(browse(t.conn, "uid", source_ip="198.18.0.3", protocol="udp"))


@query("browse_dns", "select * from dns where query like '%tunnel%' and source_ip = '10.0.0.0' order by timestamp desc, id desc limit 100")
def _(t):
    return browse(t.dns.filter(F.col("query").like("%tunnel%")), "id", source_ip="10.0.0.0")


@query("browse_ssl", "select id, timestamp, source_ip, server_name, version from ssl where server_name like '%h7.%' order by timestamp desc, id desc limit 100")
def _(t):
    return browse(t.ssl.filter(F.col("server_name").like("%h7.%")), "id").select("id", "timestamp", "source_ip", "server_name", "version")


@query("browse_http", "select * from http_access where referrer like '%ref.example%' and ip = '203.0.0.9' order by timestamp desc, id desc limit 100")
def _(t):
    return browse(t.http_access.filter(F.col("referrer").like("%ref.example%")), "id", ip="203.0.0.9")


@query("browse_notices", f"select id, timestamp, note, {NOTE_SEV} as severity from notices where not is_resolved and {NOTE_SEV} = 'critical' order by timestamp desc, id desc limit 100")
def _(t):
    rows = t.notices.withColumn("severity", text.notice_severity(F.col("note")))
    return browse(rows, "id", is_resolved=False, severity="critical").select("id", "timestamp", "note", "severity")


# ------------------------------------------------------------------ expressions
@query("shannon_entropy", f"select id, query, {ENT.format(c='query')} as entropy from dns")
def _(t):
    return t.dns.select("id", "query", text.shannon_entropy(F.col("query")).alias("entropy"))


@query("is_known_domain", f"select id, {KNOWN.format(c='query')} as is_known from dns")
def _(t):
    return t.dns.select("id", text.is_known_domain(F.col("query")).alias("is_known"))


@query("is_self_signed", f"select id, {SELF} as is_self_signed from ssl")
def _(t):
    return t.ssl.select("id", text.is_self_signed(F.col("subject"), F.col("issuer")).alias("is_self_signed"))


@query("is_expired", f"select id, {EXPIRED} as is_expired from ssl")
def _(t):
    return t.ssl.select("id", text.is_expired(F.col("not_valid_after"), ts_lit(AS_OF)).alias("is_expired"))


@query("is_weak_tls", f"select id, {WEAK} as is_weak from ssl")
def _(t):
    return t.ssl.select("id", text.is_weak_tls(F.col("version")).alias("is_weak"))


@query("notice_severity", f"select id, note, {NOTE_SEV} as severity from notices")
def _(t):
    return t.notices.select("id", "note", text.notice_severity(F.col("note")).alias("severity"))


PORT_SQL = "case dest_port " + " ".join(f"when {p} then {lit(n)}" for p, n in fixed.PORT_NAMES.items()) + " else 'Unknown' end"
PORT_SRC = "(select dest_port, count(*) as n from (select dest_port from conn union all select target_port from security_events) group by 1)"


def ports(t):
    return t.conn.select("dest_port").unionAll(t.security_events.select("target_port")).groupBy("dest_port").agg(F.count("*").alias("n"))


@query("port_service", f"select dest_port, {PORT_SQL} as service, n from {PORT_SRC}")
def _(t):
    return ports(t).select("dest_port", text.port_service(F.col("dest_port")).alias("service"), "n")


@query("port_risk", f"""
select dest_port, concat_ws('|', case when dest_port in (23, 21, 20, 3389, 5900) then 'This port is considered insecure' end,
  case when dest_port in (3306, 5432, 27017, 6379) then 'Database port - should not be exposed publicly' end) as warnings,
  case when dest_port in (23, 21, 20, 3389, 5900, 3306, 5432, 27017, 6379) then 'high' else 'low' end as risk_level from {PORT_SRC}""")
def _(t):
    w = text.port_warnings(F.col("dest_port"))
    return ports(t).select("dest_port", w.alias("warnings"), F.when(F.size(w) > 0, "high").otherwise("low").alias("risk_level"))


# ------------------------------------------------------------------ scans
@query("port_scan_simple", f"""
select source_ip as ip, count(distinct dest_port) as ports_scanned, array_to_string(list_sort(list(distinct dest_port))[1:20], '|') as ports
from {CONN_W} where dest_port <> 0 group by 1 having count(distinct dest_port) >= 10""")
def _(t):
    return net.port_scan_simple(t.conn, AS_OF)


SCAN = f"""scan as (select *, case when ports_scanned >= 100 or rate >= 10 then 'critical' when ports_scanned >= 50 or rate >= 5 then 'high' when ports_scanned >= 25 then 'medium' else 'low' end as severity
  from (select *, ports_scanned / greatest(span, 1) as rate from (select source_ip as ip, count(distinct dest_port) as ports_scanned, count(distinct dest_ip) as unique_destinations,
    (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 as span, array_to_string(list_sort(list(distinct dest_port))[1:50], '|') as ports, min(timestamp) as first_seen, max(timestamp) as last_seen
    from {CONN_W} where dest_port <> 0 group by 1 having count(distinct dest_port) >= 15)))"""


@query("port_scan_rated", f"with {SCAN} select ip, ports_scanned, unique_destinations, round_even(span, 2) as time_window, round_even(rate, 2) as scan_rate, severity, ports, first_seen, last_seen from scan")
def _(t):
    return net.port_scan_rated(t.conn, AS_OF, hours=24)


ORD = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end"


@query("severity_then_ports", f"with {SCAN} select ip, ports_scanned, severity from scan order by {ORD}, ports_scanned desc, ip limit 25")
def _(t):
    return net.by_severity_then(net.port_scan_rated(t.conn, AS_OF, hours=24), "ports_scanned").limit(25).select("ip", "ports_scanned", "severity")


# ------------------------------------------------------------------ DNS
@query("dns_entropy_suspects", f"select id, query, source_ip, {ENT.format(c='query')} as query_entropy from {DNS_W} where {ENT.format(c='query')} >= 3.5")
def _(t):
    return net.high_entropy(t.dns, AS_OF).select("id", "query", "source_ip", "query_entropy")


@query("dns_long_queries", f"select id, query, length(query) as length, source_ip from {DNS_W} where length(query) > 60")
def _(t):
    return net.long_queries(t.dns, AS_OF).select("id", "query", F.length("query").cast("bigint").alias("length"), "source_ip")


@query("nxdomain_spam", "select source_ip as ip, count(*) as nxdomain_count from (select * from dns where timestamp >= timestamp '2024-01-01 00:00:00') where rcode_name = 'NXDOMAIN' group by 1 having count(*) >= 50")
def _(t):
    return net.nxdomain_spam(t.dns, AS_OF, hours=30 * 24)


@query("dga_domains", f"select id, query, source_ip, {ENT.format(c='query')} as query_entropy from {DNS_W} where {ENT.format(c='query')} >= 3.8 and not {KNOWN.format(c='query')}")
def _(t):
    return net.dga_domains(t.dns, AS_OF).select("id", "query", "source_ip", "query_entropy")


DOTS = "length(query) - length(replace(query, '.', ''))"


@query("dns_tunneling", f"select id, query, length(query) as length, {DOTS} as subdomain_levels, source_ip from {DNS_W} where length(query) > 60 and {DOTS} >= 3")
def _(t):
    return net.dns_tunneling(t.dns, AS_OF).select(
        "id", "query", F.length("query").cast("bigint").alias("length"), F.col("subdomain_levels").cast("bigint").alias("subdomain_levels"), "source_ip")


@query("dns_high_volume", "select source_ip as ip, count(*) as query_count from (select * from dns where timestamp >= timestamp '2024-01-01 00:00:00') group by 1 having count(*) >= 100 order by 2 desc, 1 limit 20")
def _(t):
    return net.dns_high_volume(t.dns, AS_OF, hours=30 * 24)


@query("dns_suspicious_domains", f"""
select domain, query_count, {ENT.format(c='domain')} as entropy from (select query as domain, count(*) as query_count from (select * from dns where timestamp >= timestamp '2024-01-01 00:00:00') group by 1 order by 2 desc, 1 limit 50)
where {ENT.format(c='domain')} >= 3.5 and query_count >= 10""")
def _(t):
    return net.dns_suspicious_domains(t.dns, AS_OF, hours=30 * 24)


# ------------------------------------------------------------------ TLS
def tls(t):
    return net.tls_flags(in_window(t.ssl, AS_OF, 24), ts_lit(AS_OF))


@query("tls_self_signed", f"select id, source_ip, dest_ip, server_name, subject from {SSL_W} where {SELF}")
def _(t):
    return tls(t).filter("is_self_signed").select("id", "source_ip", "dest_ip", "server_name", "subject")


@query("tls_expired", f"select id, source_ip, server_name, not_valid_after from {SSL_W} where {EXPIRED}")
def _(t):
    return tls(t).filter("is_expired").select("id", "source_ip", "server_name", "not_valid_after")


@query("tls_weak", f"select id, source_ip, server_name, version from {SSL_W} where {WEAK}")
def _(t):
    return tls(t).filter("is_weak_cipher").select("id", "source_ip", "server_name", "version")


@query("tls_rare_issuers", f"select issuer, count(*) as connection_count from {SSL_W} where issuer <> '' group by issuer having count(*) >= 5 and not {any_word('issuer', fixed.COMMON_ISSUERS)}")
def _(t):
    return net.tls_rare_issuers(t.ssl, AS_OF)


# ------------------------------------------------------------------ regularity
BEACON = f"""gaps as (select source_ip, dest_ip, dest_port, timestamp, (epoch_us(timestamp) - lag(epoch_us(timestamp)) over (partition by source_ip, dest_ip, dest_port order by timestamp)) / 1e6 as gap from {CONN_W}),
bst as (select source_ip, dest_ip, dest_port, count(*) as connection_count, avg(gap) as mean, stddev_pop(gap) as dev, min(timestamp) as first_seen, max(timestamp) as last_seen from gaps group by 1, 2, 3 having count(*) >= 10),
beacons as (select *, 1 - least(case when mean > 0 then dev / mean else 0 end, 1) as reg from bst)"""


@query("beaconing", f"with {BEACON} select source_ip, dest_ip, dest_port, connection_count, round_even(mean, 2) as mean_interval, round_even(reg, 3) as regularity, first_seen, last_seen from beacons where reg >= 0.9")
def _(t):
    return net.beaconing(t.conn, AS_OF)


REGULAR = """reg as (select source_ip as ip, case when count(*) > 5 and avg(gap) > 0 then greatest(0, 1 - coalesce(stddev_samp(gap), 0) / avg(gap)) else 0 end as connection_regularity
  from (select source_ip, (epoch_us(timestamp) - lag(epoch_us(timestamp)) over (partition by source_ip order by timestamp)) / 1e6 as gap from conn) group by 1)"""


@query("flow_regularity_sample", f"with {REGULAR} select ip, round_even(connection_regularity, 6) as connection_regularity from reg")
def _(t):
    return net.flow_regularity(t.conn).select("ip", rounded("connection_regularity", 6).alias("connection_regularity"))


@query("inter_event_interval", "select id, source_ip, coalesce((epoch_us(timestamp) - lag(epoch_us(timestamp)) over (partition by source_ip order by timestamp, id)) / 1e6, -1) as seconds from security_events")
def _(t):
    gaps = with_previous(t.security_events.select("id", "source_ip", "timestamp"), ["source_ip"], "timestamp", ["id"])
    return gaps.select("id", "source_ip", F.coalesce((F.col("_us") - F.col("prev_us")) / 1e6, F.lit(-1.0)).alias("seconds"))


# ------------------------------------------------------------------ features and rollups
FEATS = f"""{REGULAR},
fc as (select source_ip as ip, count(*) as connections_count, count(distinct dest_port) filter (where dest_port <> 0) as unique_dest_ports, count(distinct dest_ip) as unique_dest_ips,
  cast(sum(coalesce(orig_bytes, 0)) as bigint) as bytes_sent, cast(sum(coalesce(resp_bytes, 0)) as bigint) as bytes_received, cast(sum(orig_pkts) as bigint) as packets_sent, cast(sum(resp_pkts) as bigint) as packets_received,
  avg(duration) filter (where duration <> 0) as avg_duration, count(*) filter (where conn_state in ('S0', 'REJ', 'RSTO', 'RSTOS0')) as failed_connections from conn group by 1),
fd as (select source_ip as ip, count(*) as dns_queries, count(distinct query) as unique_domains, count(*) filter (where rcode <> 0) as failed_dns from dns group by 1),
fh as (select ip, count(*) as http_requests, count(distinct method) as http_methods_diversity, count(*) filter (where {any_word('lower(user_agent)', fixed.FEATURE_AGENTS)}) as suspicious_user_agents from http_access group by 1),
fs as (select source_ip as ip, count(*) as ssl_connections, count(*) filter (where contains(lower(validation_status), 'invalid')) as ssl_invalid_certs from ssl group by 1),
feats as (select ip, """ + ", ".join(
    f"round_even(coalesce({c}, 0), 6) as {c}" if c in net.REAL_FEATURES else f"coalesce({c}, 0) as {c}" for c in net.NETWORK_FEATURES
) + " from fc full join fd using (ip) full join fh using (ip) full join fs using (ip) full join reg using (ip))"


def features(t):
    return net.network_features(t.conn, t.dns, t.http_access, t.ssl)


@query("ip_multi_source_features", f"with {FEATS} select * from feats")
def _(t):
    f = features(t)
    for c in net.REAL_FEATURES:
        f = f.withColumn(c, rounded(c, 6))
    return f


@query("zeek_table_stats", f"""
select (select count(*) from {CONN_W}) as total_connections, (select count(*) from {DNS_W}) as total_dns_queries, (select count(*) from {SSL_W}) as total_ssl_connections,
  (select count(*) from http_access where timestamp >= {D1}) as total_http_requests, count(*) as total_notices, count(*) filter (where not is_resolved) as unresolved_notices
from notices where timestamp >= {D1}""")
def _(t):
    return net.table_stats(AS_OF, 24, t.notices, total_connections=t.conn, total_dns_queries=t.dns, total_ssl_connections=t.ssl, total_http_requests=t.http_access)


HOUR = "date_trunc('hour', timestamp) as hour"
FILES_T = "(select *, timestamp '2024-01-30 00:00:00' + interval '1' second * cast(total_bytes % 86400 as int) as timestamp from files)"


@query("zeek_hourly_rollup", f"""
with c as (select {HOUR}, count(*) as total_connections, count(*) filter (where protocol = 'tcp') as tcp_connections, count(*) filter (where protocol = 'udp') as udp_connections, count(*) filter (where protocol = 'icmp') as icmp_connections,
  cast(sum(orig_bytes) as bigint) as total_bytes_sent, cast(coalesce(sum(resp_bytes), 0) as bigint) as total_bytes_received, count(distinct source_ip) as unique_source_ips, count(distinct dest_ip) as unique_dest_ips from conn group by 1),
sc as (select hour, count(*) as port_scans_detected from (select {HOUR}, source_ip from conn where dest_port <> 0 group by 1, 2 having count(distinct dest_port) >= 15) group by 1),
sv as (select hour, string_agg(service || '=' || n, '|' order by rk) as top_services from (select *, row_number() over (partition by hour order by n desc, service) as rk from (select {HOUR}, {PORT_SQL} as service, count(*) as n from conn group by 1, 2) where service <> 'Unknown') where rk <= 3 group by 1),
d as (select {HOUR}, count(*) as dns_queries, count(*) filter (where rcode_name = 'NXDOMAIN') as dns_nxdomain from dns group by 1),
s as (select {HOUR}, count(*) as ssl_connections, count(*) filter (where contains(lower(validation_status), 'invalid')) as ssl_invalid_certs from ssl group by 1),
h as (select {HOUR}, count(*) as http_requests, count(*) filter (where status >= 400) as http_errors from http_access group by 1),
f as (select {HOUR}, count(*) as files_transferred from {FILES_T} group by 1), n as (select {HOUR}, count(*) as notices_generated from notices group by 1)
select hour, """ + ", ".join(f"coalesce({x}, 0) as {x}" for x in (
    "total_connections tcp_connections udp_connections icmp_connections total_bytes_sent total_bytes_received unique_source_ips unique_dest_ips port_scans_detected "
    "dns_queries dns_nxdomain ssl_connections ssl_invalid_certs http_requests http_errors files_transferred notices_generated").split()) + """, coalesce(top_services, '') as top_services
from c full join sc using (hour) full join sv using (hour) full join d using (hour) full join s using (hour) full join h using (hour) full join f using (hour) full join n using (hour)""")
def _(t):
    return net.hourly_rollup(t.conn, t.dns, t.ssl, t.http_access, timed_files(t), t.notices)


def timed_files(t):
    return t.spark.sql(FILES_T.strip("()").replace("timestamp '", "timestamp_ntz '").replace("from files", "from {files}"), files=t.files)


# ------------------------------------------------------------------ top connections
@query("top_connections_bytes", f"select uid, orig_bytes + coalesce(resp_bytes, 0) as total from {CONN_W} order by total desc, uid limit 10")
def _(t):
    return top(t, F.coalesce("orig_bytes", F.lit(0)) + F.coalesce("resp_bytes", F.lit(0)))


@query("top_connections_duration", f"select uid, duration as total from {CONN_W} where duration <> 0 order by total desc, uid limit 10")
def _(t):
    return top(t, F.col("duration"), F.coalesce(F.col("duration") != 0, F.lit(False)))


@query("top_connections_packets", f"select uid, orig_pkts + resp_pkts as total from {CONN_W} order by total desc, uid limit 10")
def _(t):
    return top(t, F.coalesce("orig_pkts", F.lit(0)) + F.coalesce("resp_pkts", F.lit(0)))


def top(t, measure, keep=None, n=10):
    rows = in_window(t.conn, AS_OF, 24)
    rows = rows if keep is None else rows.filter(keep)
    return rows.select("uid", measure.alias("total")).orderBy(F.desc("total"), "uid").limit(n)


# ------------------------------------------------------------------ detections to events and alerts
DET = f"""{SCAN}, {BEACON}, det as (select 'port_scan' as event_type, severity, ip as source_ip, 0 as target_port, ports_scanned || ' ports' as detail from scan
union all select 'dns_tunneling', 'high', source_ip, 53, query from {DNS_W} where length(query) > 60 and {DOTS} >= 3
union all select 'dga_domain', 'medium', source_ip, 53, query from {DNS_W} where {ENT.format(c='query')} >= 3.8 and not {KNOWN.format(c='query')}
union all select 'beaconing', 'critical', source_ip, 0, dest_ip || ':' || dest_port from beacons where reg >= 0.8
union all select 'ssl_self_signed', 'medium', source_ip, 443, server_name from {SSL_W} where {SELF})"""


@query("detections_to_events", f"with {DET} select *, case when event_type like '%scan%' then 'network_scan' else 'suspicious_traffic' end as attack_vector from det")
def _(t):
    rows = net.detection_rows(t.conn, t.dns, t.ssl, AS_OF, hours=1)
    scans = net.detection_rows(t.conn, t.dns, t.ssl, AS_OF, hours=24).filter("event_type = 'port_scan'")
    return rows.filter("event_type <> 'port_scan'").unionByName(scans).withColumn("target_port", F.coalesce("target_port", F.lit(0)))


@query("poll_detect", f"with {DET} select event_type, severity, count(*) as created from det group by all")
def _(t):
    rows = net.detection_rows(t.conn, t.dns, t.ssl, AS_OF, hours=1)
    scans = net.detection_rows(t.conn, t.dns, t.ssl, AS_OF, hours=24).filter("event_type = 'port_scan'")
    return rows.filter("event_type <> 'port_scan'").unionByName(scans).groupBy("event_type", "severity").agg(F.count("*").alias("created"))


@query("detections_to_alerts", f"""
with {SCAN}, {BEACON}, al as (
select 'port_scan' as threat_type, severity, ip as source, 'Port scan detectado: ' || ports_scanned || ' puertos' as description from (select * from scan order by {ORD}, ports_scanned desc, ip limit 5) where severity in ('critical', 'high')
union all select 'dns_dga', 'high', source_ip, 'Posible DGA detectado: ' || query from (select * from {DNS_W} where {ENT.format(c='query')} >= 3.8 and not {KNOWN.format(c='query')} order by timestamp, id limit 10) where {ENT.format(c='query')} >= 4.5
union all select 'dns_tunneling', 'critical', source_ip, 'Posible DNS tunneling: ' || query || ' (' || length(query) || ' chars)' from (select * from {DNS_W} where length(query) > 60 and {DOTS} >= 3 order by timestamp, id limit 5)
union all select 'ssl_self_signed', 'medium', source_ip, 'Certificado auto-firmado detectado: ' || server_name from (select * from {SSL_W} where {SELF} order by timestamp, id limit 10)
union all select 'beaconing', 'critical', source_ip, 'Posible beaconing a ' || dest_ip || ':' || dest_port || ' (regularidad: ' || printf('%.0f', round_even(reg, 3) * 100) || '%)' from (select * from beacons where reg >= 0.9 order by round_even(reg, 3) desc, source_ip, dest_ip, dest_port limit 5))
select *, upper(threat_type) || ' detectado' as title from al""")
def _(t):
    return net.detection_alerts(t.conn, t.dns, t.ssl, AS_OF)


@query("dedup_ingest", """
select distinct b.uid, b.source_ip, b.dest_port from conn b left join (select distinct uid from conn where protocol = 'tcp') s on s.uid = b.uid where s.uid is null
union all select cast(null as varchar), 'unkeyed', dest_port from conn where conn_state = 'REJ'""")
def _(t):
    stored = t.conn.filter("protocol = 'tcp'")
    nulls = t.conn.filter("conn_state = 'REJ'").select(F.lit(None).cast("string").alias("uid"), F.lit("unkeyed").alias("source_ip"), "dest_port")
    cols = ["uid", "source_ip", "dest_port"]
    batch = t.conn.select(*cols).unionByName(t.conn.select(*cols)).unionByName(nulls)
    return net.new_rows(batch, stored, "uid", "source_ip")
