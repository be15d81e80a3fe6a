"""Log-shaped views over the input tables.

Each view is one SQL text that both Spark and the checking engine accept, with
``@table@`` for inputs. Spark reads it as a DataFrame; ``with_views`` inlines
it as a CTE for the equivalent check query.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

AS_OF = datetime(2024, 1, 31)
BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

_IP = "concat('203.0.', cast(cast(floor(user_id / 256) as bigint) as string), '.', cast(user_id % 256 as string))"

VIEWS: dict[str, str] = {}

VIEWS["security_events"] = f"""
select event_id as id, ts as timestamp, {_IP} as source_ip,
  case event_id % 12 when 0 then 'http_attack' when 1 then 'ssh_brute_force' when 2 then 'port_scan' when 3 then 'fail2ban_ban'
    when 4 then 'ml_detection' when 5 then 'dga_domain' when 6 then 'http_404' when 7 then 'ssh_failed_login'
    when 8 then 'suspicious_traffic' when 9 then 'beaconing' when 10 then 'dns_tunneling' else 'ssl_self_signed' end as event_type,
  case when event_type = 'error' and value >= 100 then 'critical' when event_type = 'error' then 'high'
    when event_type = 'purchase' then 'medium' else 'low' end as severity,
  cast(20 + (event_id * 7) % 60 as int) as target_port,
  case event_id % 3 when 0 then 'http' when 1 then 'ssh' else 'tcp' end as protocol,
  case event_id % 6 when 0 then 'sql_injection' when 1 then 'xss' when 2 then 'brute_force' when 3 then 'path_traversal' when 4 then 'unknown' end as attack_vector,
  case user_id % 8 when 0 then 'CN' when 1 then 'RU' when 2 then 'US' when 3 then 'DE' when 4 then 'BR' when 5 then 'LAN' when 6 then 'XX' end as country_code,
  event_id % 10 = 0 as is_blocked
from @events@"""

VIEWS["http_access"] = """
select event_id as id, ts as timestamp,
  concat('203.0.0.', cast(case when user_id % 40 < 4 then 0 else user_id % 40 end as string)) as ip,
  case when event_id % 44 = 3 then 'TRACE' when event_id % 4 = 0 then 'POST' else 'GET' end as method,
  case (event_id + user_id) % 16 when 0 then '/item?id=1 union select a from b' when 1 then '/?q=<script>alert(1)</script>' when 2 then '/../../etc/passwd'
    when 3 then '/run?c=;ls' when 4 then '/shell.php' when 5 then '/wp-admin/' when 6 then '/.env' when 7 then '/phpmyadmin/' when 8 then '/admin/backup.zip'
    when 9 then '/robots.txt' when 10 then concat('/page/', cast(event_id % 97 as string)) when 11 then '/api/items' when 12 then '/xmlrpc.php'
    when 13 then concat('/p/', cast(event_id % 31 as string)) else '/' end as path,
  cast(case event_id % 9 when 0 then 404 when 1 then 500 when 2 then 403 else 200 end as int) as status,
  cast(floor(value * 100) as bigint) as size,
  case when user_id % 8 = 0 then '-' else 'https://ref.example/' end as referrer,
  case user_id % 10 when 0 then 'sqlmap/1.7' when 1 then 'curl/8.0' when 2 then 'Googlebot/2.1' when 3 then 'python-requests/2.31' when 4 then 'x'
    else 'Mozilla/5.0 (X11) Chrome/120 Safari/537' end as user_agent
from @events@"""

VIEWS["conn"] = """
select concat('C', cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string)) as uid,
  timestamp '2024-01-30 00:00:00' + interval '1' second * cast((l_orderkey * 37 + l_linenumber * 11) % 86400 as int) as timestamp,
  concat('198.18.', cast(cast(floor(l_suppkey / 256) as bigint) as string), '.', cast(l_suppkey % 256 as string)) as source_ip,
  concat('192.0.2.', cast(l_partkey % 200 as string)) as dest_ip,
  cast(case l_suppkey % 5 when 0 then 1 + l_partkey % 1024 when 1 then 1 + l_partkey % 40 when 2 then 1 + l_partkey % 20 when 3 then 80 + l_partkey % 3 else 1 + l_partkey % 60 end as int) as dest_port,
  case l_linenumber % 3 when 0 then 'tcp' when 1 then 'udp' else 'icmp' end as protocol,
  case l_linenumber % 4 when 0 then 'S0' when 1 then 'REJ' else 'SF' end as conn_state,
  case when l_tax = 0 then null else l_quantity / 10 end as duration,
  cast(floor(l_extendedprice) as bigint) as orig_bytes, case when l_discount = 0 then null else cast(floor(l_extendedprice * l_discount) as bigint) end as resp_bytes,
  cast(floor(l_quantity) as bigint) as orig_pkts, cast(floor(l_quantity * 2) as bigint) as resp_pkts
from @lineitem@
union all
select concat('B', cast(o_orderkey as string)),
  timestamp '2024-01-30 00:00:00' + interval '1' second * cast(cast(floor(o_orderkey / 20) as bigint) % 288 * 300
    + case when o_orderkey % 20 < 10 then 0 else o_custkey % 240 end as int),
  concat('198.51.', cast(100 + cast(floor(o_orderkey / 73728) as bigint) % 150 as string), '.',
    cast(cast(floor(o_orderkey / 5760) as bigint) * 20 % 256 + o_orderkey % 20 as string)), '192.0.2.250', 4443, 'tcp', 'SF', 0.5, 100, 200, 2, 3
from @orders@"""

VIEWS["dns"] = """
select e.event_id as id, e.ts as timestamp, concat('10.0.0.', cast(e.user_id % 10 as string)) as source_ip,
  case when e.event_id % 20 = 0 then concat(md5(cast(e.event_id as string)), '.', md5(cast(e.user_id as string)), '.a.b.tunnel.example')
    when e.event_id % 20 = 1 then concat(substr(md5(cast(e.event_id as string)), 1, 24), '.info')
    when e.event_id % 20 = 4 then concat('abcdefghijklmnopqrstuvwxyz012', cast(e.event_id as string), '.biz')
    when e.event_id % 20 in (2, 3) then 'www.google.com'
    else regexp_extract(p.url, '^https?://([^/]+)', 1) end as query,
  case when e.event_id % 7 = 0 then 'NXDOMAIN' else 'NOERROR' end as rcode_name, cast(case when e.event_id % 7 = 0 then 3 else 0 end as int) as rcode
from (select *, (select count(*) from @pages@) as n_pages from @events@) e join @pages@ p on p.page_id = e.event_id % e.n_pages"""

VIEWS["ssl"] = """
select o_orderkey as id, timestamp '2024-01-30 00:00:00' + interval '1' second * cast(o_orderkey % 86400 as int) as timestamp,
  concat('198.51.100.', cast(o_custkey % 250 as string)) as source_ip, '192.0.2.9' as dest_ip,
  case o_orderkey % 6 when 0 then 'SSLv3' when 1 then 'TLSv10' when 2 then 'TLSv1.1' when 3 then null when 4 then 'TLSv12' else 'TLSv13' end as version,
  concat('h', cast(o_custkey % 50 as string), '.example') as server_name,
  case when o_orderkey % 13 = 0 then null else concat('CN=h', cast(o_custkey % 50 as string)) end as subject,
  case when o_orderkey % 13 = 0 then null when o_orderkey % 9 = 0 then concat('CN=h', cast(o_custkey % 50 as string)) when o_orderkey % 9 < 4 then 'DigiCert CA'
    else concat('Rare CA ', cast(o_custkey % 7 as string)) end as issuer,
  timestamp '2024-01-31 00:00:00' + interval '1' day * cast(o_orderkey % 400 - 100 as int) as not_valid_after,
  case when o_orderkey % 10 = 0 then 'Invalid chain' else 'ok' end as validation_status
from @orders@"""

VIEWS["files"] = """
select concat('F', cast(p_partkey as string)) as fuid, p_name as filename,
  case p_size % 5 when 0 then 'application/x-dosexec' when 1 then 'text/x-shellscript' when 2 then 'application/pdf' when 3 then 'text/html' end as mime_type,
  cast(floor(p_retailprice * 100) as bigint) as total_bytes, concat('192.0.2.', cast(p_partkey % 200 as string), ',192.0.2.1') as tx_hosts
from @part@"""

VIEWS["notices"] = """
select s_suppkey as id, timestamp '2024-01-30 00:00:00' + interval '1' minute * cast(s_suppkey % 1440 as int) as timestamp,
  case when s_suppkey % 4 = 0 then null else concat('198.18.0.', cast(s_suppkey % 256 as string)) end as orig_h, concat('198.19.0.', cast(s_suppkey % 256 as string)) as src,
  case s_suppkey % 5 when 0 then 'Scan::Port_Scan' when 1 then 'SSH::Password_Guessing' when 2 then 'Weird::Activity' when 3 then 'Malware::Hash' else 'SSL::Invalid' end as note,
  s_acctbal < 0 as is_resolved
from @supplier@"""

# the two lists name some of all addresses, as such lists do
VIEWS["blocked_ips"] = f"""
select distinct {_IP} as ip_address,
  user_id % 21 = 0 as is_permanent,
  case when user_id % 21 = 0 then null else timestamp '2024-01-31 00:00:00' + interval '1' hour * cast(user_id % 48 - 24 as int) end as unblock_time,
  timestamp '2024-01-30 00:00:00' + interval '1' minute * cast(user_id % 1440 as int) as last_blocked,
  case when user_id % 2 = 0 then 'auto_blocker' else 'manual' end as blocked_by,
  case user_id % 4 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' else 'low' end as threat_level
from @events@ where user_id % 7 = 0"""

VIEWS["ip_lists"] = f"""
select distinct {_IP} as ip_address,
  case when user_id % 11 = 0 then 'whitelist' else 'blacklist' end as list, user_id % 3 <> 0 as is_active
from @events@ where user_id % 11 = 0 or user_id % 13 = 0"""

VIEWS["geo_ranges"] = """
select 3405774848 + n_nationkey * 16 as ip_from, 3405774848 + n_nationkey * 16 + 11 as ip_to, n_name as country_name,
  case n_nationkey % 5 when 0 then 'CN' when 1 then 'RU' when 2 then 'US' when 3 then 'DE' else 'BR' end as country_code, r_name as continent_name
from @nation@ join @region@ on n_regionkey = r_regionkey"""

VIEWS["geo_ranges_six"] = """
select concat('2001:db8:', lower(hex(n_nationkey)), '::') as first_ip, concat('2001:db8:', lower(hex(n_nationkey)), ':ffff:ffff:ffff:ffff:ffff') as last_ip,
  n_name as country_name, case n_nationkey % 3 when 0 then 'FR' when 1 then 'JP' else 'IN' end as country_code, r_name as continent_name
from @nation@ join @region@ on n_regionkey = r_regionkey
union all select concat('2001:db8:', lower(hex(n_nationkey)), '::'), concat('2001:db8:', lower(hex(n_nationkey)), '::3'), concat(n_name, ' net'), 'IT', 'EUROPE' from @nation@
union all select concat('2001:db8:', lower(hex(n_nationkey)), '::2'), concat('2001:db8:', lower(hex(n_nationkey)), '::2'), concat(n_name, ' host'), 'ES', 'EUROPE' from @nation@
union all select concat('2a00:', lower(hex(r_regionkey * 8)), '::'), concat('2a00:', lower(hex(r_regionkey * 8 + 6)), ':ffff:ffff:ffff:ffff:ffff:ffff'), r_name, 'SE', r_name from @region@
union all select '2c00::', '2fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff', 'Wide', 'ZA', 'AFRICA' from @region@ where r_regionkey = 0"""

# every event once more, seen from IPv6 addresses in long, short and IPv4-mapped form
VIEWS["events_six"] = """
select event_id as id, ts as timestamp,
  case event_id % 6 when 0 then concat('2001:db8:', lower(hex(user_id % 40)), '::', lower(hex(event_id % 7)))
    when 1 then concat('2001:0DB8:', hex(user_id % 40), ':0:0:00:0:', hex(event_id % 9)) when 2 then concat('2a00:', lower(hex(user_id % 64)), ':1::')
    when 3 then concat('::ffff:203.0.', cast(cast(floor(user_id / 256) as bigint) as string), '.', cast(user_id % 256 as string))
    when 4 then concat('2', lower(hex(11 + event_id % 5)), '00:5::', lower(hex(user_id % 300))) else concat('fe80::', lower(hex(user_id % 100))) end as source_ip,
  concat('v6_', event_type) as event_type, case when event_type = 'error' then 'high' else 'low' end as severity,
  case event_id % 4 when 0 then '' when 1 then '{"country":"Old","country_code":"OO"}' end as geo_location
from @events@"""

VIEWS["predictions"] = f"""
select {_IP} as ip_address,
  cast(user_id * 37 % 101 as double) / 100 as ml_confidence, cast(user_id * 53 % 101 as double) as threat_score,
  case user_id % 4 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' else 'low' end as severity,
  count(*) as total_events, min(ts) as first_seen, max(ts) as last_seen, user_id % 5 <> 0 as is_valid,
  cast(user_id % 3 as int) as zeek_detections, cast(user_id % 2 as int) as f2b_bans
from @events@ group by user_id"""

VIEWS["scored"] = """
select d.doc_id as id, l.quality as y_true, cast(d.doc_id * 37 % 101 as double) / 100 as y_prob,
  case when (d.doc_id * 37 % 101) >= 50 then 1 else 0 end as y_pred, d.source as model_version, d.doc_id % 5 as run
from @documents@ d join @labels@ l on d.doc_id = l.doc_id"""

VIEWS["auth_lines"] = """
select event_id as id, concat({syslog}, ' host sshd[1]: ',
  case event_id % 10 when 0 then 'Accepted password for root from ' when 1 then 'Accepted publickey for ops from ' when 2 then 'Invalid user guest from '
    when 3 then 'Failed password for invalid user test from ' when 4 then 'Connection closed by ' else concat('Failed password for u', cast(user_id % 5 as string), ' from ') end,
  '203.0.0.', cast(user_id % 15 as string), ' port 22 ssh2') as line
from (select *, timestamp '2024-01-30 00:00:00' + interval '1' second * cast(event_id * 5 % 86400 as int) as t from @events@) x"""

VIEWS["access_lines"] = """
select id, concat(ip, ' - - [', {clf}, ' +0000] "', method, ' ', path, ' HTTP/1.1" ', cast(status as string), ' ', cast(size as string), ' "', referrer, '" "', user_agent, '"') as line
from @http_access@
union all select event_id, 'malformed line' from @events@ where event_id % 50 = 0"""

# every event is a line; three of four are lines of other kinds, which the parser must pass over
VIEWS["ban_lines"] = """
select event_id as id, concat(cast(timestamp '2024-01-30 00:00:00' + interval '1' second * cast(event_id % 86400 as int) as string), ',123 fail2ban.',
  case event_id % 4 when 0 then 'actions' when 1 then 'filter' when 2 then 'jail' else 'server' end, ' [1]: ',
  case event_id % 4 when 0 then 'NOTICE [' when 1 then 'DEBUG [' when 2 then 'INFO [' else 'WARNING [' end,
  case event_id % 3 when 0 then 'sshd' when 1 then 'nginx-req-limit' else 'recidive' end, '] ',
  case when event_id % 4 = 1 then 'Ignore ' when event_id % 4 = 2 then 'Jail started for ' when event_id % 4 = 3 then 'Restore '
    when event_id % 5 = 0 then 'Unban ' when event_id % 5 = 1 then 'Found ' else 'Ban ' end,
  '203.0.0.', cast(user_id % 200 as string)) as line
from @events@"""

# --- console tables, shaped from the same inputs
VIEWS["threats"] = """
select id, timestamp as detected_at, event_type as threat_type, severity, source_ip as source,
  concat('finding ', event_type) as description, id % 3 = 0 as is_resolved, id % 7 = 0 as false_positive
from @security_events@ where severity <> 'low'"""

VIEWS["alerts"] = """
select id, timestamp as created_at, event_type as alert_type, severity, concat(upper(event_type), ' detected') as title,
  source_ip as source, id % 4 <> 0 as is_read, id % 5 = 0 as is_resolved
from @security_events@ where severity in ('high', 'critical')"""

VIEWS["system_logs"] = """
select id, timestamp, case when severity = 'low' then 'INFO' else 'WARNING' end as log_level, protocol as module,
  event_type as action, source_ip as ip_address, id % 9 <> 0 as success
from @security_events@"""

VIEWS["geo_events"] = """
select id, timestamp, source_ip, event_type, severity,
  case when country_code is null then null when id % 29 = 0 then '' else
    concat('{"country":"', case country_code when 'CN' then 'China' when 'RU' then 'Russia' when 'US' then 'United States' when 'DE' then 'Germany'
      when 'BR' then 'Brazil' when 'LAN' then 'Private Network' else 'Unknown' end, '","country_code":"', country_code, '"}') end as geo_location
from @security_events@"""

VIEWS["ip_orgs"] = f"""
select distinct {_IP} as ip, case user_id % 6 when 0 then 'Amazon AWS' when 1 then 'NordVPN' when 2 then 'Comcast Cable'
    when 3 then 'DigitalOcean LLC' when 4 then 'Tor Exit Relay' end as isp,
  case user_id % 5 when 0 then 'Google Cloud' when 1 then 'Home Line' when 2 then 'OVH Hosting' else 'City Net' end as org
from @events@"""

VIEWS["alert_logs"] = """
select id, case when id % 8 = 7 then null else cast(id % 8 + 1 as bigint) end as rule_id, cast(id % 4 + 1 as bigint) as channel_id,
  upper(severity) as severity, timestamp as sent_at, id % 5 <> 0 as success
from @security_events@"""

VIEWS["alert_events"] = """
select id, timestamp, case event_type when 'ml_detection' then 'ml_prediction' when 'suspicious_traffic' then 'ml_prediction'
    when 'port_scan' then 'zeek_detection' when 'beaconing' then 'zeek_detection' when 'dns_tunneling' then 'zeek_detection'
    when 'dga_domain' then 'zeek_detection' when 'fail2ban_ban' then 'fail2ban_ban' else event_type end as type,
  event_type as detection_type, upper(severity) as severity, source_ip as ip,
  cast(id * 37 % 101 as double) / 100 as ml_confidence, cast(id * 37 % 101 as bigint) as confidence, country_code as country,
  concat('seen ', event_type) as message
from @security_events@"""

VIEWS["alert_rules"] = """
select cast(column1 as bigint) as id, column2 as rule_name, column3 as rule_type, column4 as conditions, column5 as severity_threshold,
  column6 as channel_ids, column7 as is_enabled, cast(column8 as int) as cooldown_minutes, column9 as subject_template,
  case when column1 % 2 = 1 then concat(column2, ': {{ ip }} {{severity}} ({{type}})') end as message_template
from (values
  (1, 'confident', 'ml_prediction', '{"ml_confidence": {"operator": ">", "value": 0.8}}', 'MEDIUM', '[1, 2]', true, 60, 'ML {{ip}} {{severity}}'),
  (2, 'scans', 'zeek_detection', '{"detection_type": {"operator": "in", "value": ["port_scan", "dns_tunneling"]}}', null, '[1]', true, 240, null),
  (3, 'everything', 'fail2ban_ban', '{}', 'LOW', '[2, 3, 4]', true, 0, 'Ban of {{ ip }}'),
  (4, 'mixed types', 'ml_prediction', '{"severity": {"operator": ">", "value": 5}}', null, '[1]', true, 0, null),
  (5, 'odd operator', 'ml_prediction', '{"severity": {"operator": "~", "value": "HIGH"}}', null, '[1]', true, 0, null),
  (6, 'custom critical', 'custom', '{"severity": {"operator": "==", "value": "CRITICAL"}, "country": {"operator": "not_in", "value": ["LAN", "XX"]}}', 'HIGH', '[3]', true, 30, '{{type}} from {{country}}'),
  (7, 'not china', 'zeek_detection', '{"country": {"operator": "!=", "value": "CN"}, "confidence": {"operator": ">=", "value": 90}, "message": {"operator": "contains", "value": "dga"}}', 'LOW', '[1, 9]', true, 15, 'DGA {{ip}}'),
  (8, 'disabled', 'ml_prediction', '{}', null, '[1]', false, 0, null),
  (9, 'low numbers', 'custom', '{"confidence": {"operator": "<", "value": 5}, "ml_confidence": {"operator": "<=", "value": 0.03}}', null, null, true, 120, 'low {{confidence}}')
) as t(column1, column2, column3, column4, column5, column6, column7, column8, column9)"""

VIEWS["alert_channels"] = """
select cast(column1 as bigint) as id, column2 as channel_name, column3 as channel_type, column4 as is_enabled, cast(column5 as int) as recipients
from (values (1, 'ops mail', 'email', true, 2), (2, 'chat', 'slack', true, 0), (3, 'night mail', 'email', true, 0), (4, 'old mail', 'email', false, 1))
  as t(column1, column2, column3, column4, column5)"""

VIEWS["model_metrics"] = """
select model_version, run, timestamp '2024-01-01 00:00:00' + interval '1' day * cast(run * 5 as int) as evaluated_at,
  count(*) as samples,
  round(avg(case when y_true = y_pred then 1.0e0 else 0.0e0 end), 6) as accuracy,
  round(coalesce(sum(case when y_true = 1 and y_pred = 1 then 1.0e0 else 0.0e0 end) / nullif(sum(case when y_pred = 1 then 1.0e0 else 0.0e0 end), 0), 0), 6) as precision,
  round(coalesce(sum(case when y_true = 1 and y_pred = 1 then 1.0e0 else 0.0e0 end) / nullif(sum(case when y_true = 1 then 1.0e0 else 0.0e0 end), 0), 0), 6) as recall
from @scored@ group by model_version, run"""

VIEWS["full_events"] = """
select e.*, h.path as request_path, h.user_agent, h.method as request_method from @security_events@ e join @http_access@ h on e.id = h.id"""

VIEWS["event_scores"] = """
select e.id, p.ml_confidence as confidence, p.ml_confidence >= 0.5 as is_suspicious, e.id % 10 = 0 as is_anomaly
from @security_events@ e join @predictions@ p on e.source_ip = p.ip_address"""

VIEWS["block_snapshot"] = """
select ip_address, blocked_by, 'earlier' as reason, threat_level, is_permanent, unblock_time, last_blocked, cast(1 as bigint) as total_attacks from @blocked_ips@"""

VIEWS["block_requests"] = """
select id, source_ip as ip_address, concat('asked for ', event_type) as reason, severity as threat_level,
  case when id % 6 = 0 then null when id % 6 = 1 then 0 else cast(id % 6 * 12 as int) end as duration_hours, 'manual' as blocked_by, timestamp as asked_at
from @security_events@ where severity in ('high', 'critical')"""

VIEWS["prediction_batch"] = """
select ip_address, 1.0e0 - ml_confidence as ml_confidence, threat_score, total_events, case when zeek_detections = 0 then null else first_seen end as first_seen,
  case when zeek_detections = 1 then null else last_seen end as last_seen, timestamp '2024-01-20 00:00:00' + interval '1' hour * cast(total_events as int) as analyzed_at
from @predictions@ where f2b_bans = 1
union all select concat(ip_address, '0'), ml_confidence, threat_score, total_events, case when zeek_detections = 0 then null else first_seen end,
  case when zeek_detections = 1 then null else last_seen end, timestamp '2024-01-25 00:00:00' from @predictions@ where f2b_bans = 0"""

VIEWS["prediction_store"] = """
select ip_address, ml_confidence, threat_score, total_events, first_seen, last_seen,
  timestamp '2023-12-15 00:00:00' + interval '1' day * cast(zeek_detections * 20 as int) as analyzed_at, is_valid
from @predictions@"""

_SPARK_TOKENS = {
    "{syslog}": "date_format(t, 'MMM dd HH:mm:ss')",
    "{clf}": "date_format(timestamp, 'dd/MMM/yyyy:HH:mm:ss')",
}
_CHECK_TOKENS = {
    "{syslog}": "strftime(t, '%b %d %H:%M:%S')",
    "{clf}": "strftime(timestamp, '%d/%b/%Y:%H:%M:%S')",
}


class Tables:
    """Lazy access to the input tables and the views over them: ``t.security_events``, ``t.lineitem`` ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._cache = spark, sf_dir.rstrip("/"), {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in BASE_TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            elif name in VIEWS:
                self._cache[name] = self._view(VIEWS[name])
            else:
                raise AttributeError(name)
        return self._cache[name]

    def _view(self, text: str) -> DataFrame:
        inputs = {n: getattr(self, n) for n in set(re.findall(r"@(\w+)@", text))}
        for token, value in _SPARK_TOKENS.items():
            text = text.replace(token, value)
        text = text.replace("timestamp '", "timestamp_ntz '").replace("{", "{{").replace("}", "}}")
        text = re.sub(r"@(\w+)@", r"{\1}", text)
        return self.spark.sql(text, **inputs) if inputs else self.spark.sql(text.replace("{{", "{").replace("}}", "}"))


def _mentions(text: str) -> list[str]:
    words = set(re.findall(r"[a-z_]+", text))
    return [v for v in VIEWS if v in words]


def with_views(sql: str) -> str:
    """Prefix a check query with CTEs for every view it names."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered:
            return
        for dep in re.findall(r"@(\w+)@", VIEWS[name]):
            if dep in VIEWS:
                need(dep)
        ordered.append(name)

    for name in _mentions(sql):
        need(name)
    ctes = []
    for name in ordered:
        text = VIEWS[name]
        for token, value in _CHECK_TOKENS.items():
            text = text.replace(token, value)
        ctes.append(f"{name} as ({re.sub(r'@(\w+)@', r'\1', text).strip()})")
    if not ctes:
        return sql
    body = sql.strip()
    head = "with recursive " if re.match(r"with\s+recursive\b", body, re.I) else "with "
    joined = head + ",\n".join(ctes)
    if re.match(r"with\b", body, re.I):
        return joined + ",\n" + re.sub(r"^with(\s+recursive)?\s+", "", body, flags=re.I)
    return joined + "\n" + body
