"""Queries over web, login and ban logs, from raw lines to findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.times import from_access_stamp, from_syslog_stamp, micros
from ..operators import cooldown, weblogs as wl
from ..operators.intervals import latest_per_key, trailing_count
from ..operators.policy import active_ips, listed_ips
from ..sources import loglines as ll
from .registry import query
from .views import AS_OF

YEAR = AS_OF.year


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {lit(pattern)}, 'i')"


def any_rx(col: str, patterns) -> str:
    return "(" + " or ".join(rx(col, p) for p in patterns) + ")"


def any_word(col: str, words) -> str:
    return "(" + " or ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


ACC = lit(ll.ACCESS_LINE)
STAMP = f"regexp_extract(line, {lit(ll.SYSLOG_STAMP)}, 1)"
REQ = f"""req as (select id, regexp_extract(line, {ACC}, 1) as ip, regexp_extract(line, {ACC}, 2) as stamp, regexp_extract(line, {ACC}, 3) as method, regexp_extract(line, {ACC}, 4) as path,
  cast(regexp_extract(line, {ACC}, 5) as int) as status, cast(regexp_extract(line, {ACC}, 6) as bigint) as size, regexp_extract(line, {ACC}, 7) as referrer,
  regexp_extract(line, {ACC}, 8) as user_agent, try_strptime(split_part(regexp_extract(line, {ACC}, 2), ' ', 1), '%d/%b/%Y:%H:%M:%S') as timestamp
  from access_lines where regexp_matches(line, {ACC}))"""
TYPES = "[x for x in [" + ", ".join(
    f"case when {any_rx('lower(path || chr(32) || user_agent)', pats)} then '{name}' end" for name, pats in fixed.ATTACK_CLASSES.items()
) + "] if x is not null]"
TYPED = f"{REQ}, typed as (select *, {TYPES} as ty from req)"
SEV = """case when list_contains(ty, 'command_injection') or list_contains(ty, 'exploit') then 'critical'
  when len(list_intersect(ty, ['sql_injection', 'path_traversal', 'xss', 'scanner'])) > 0 then 'high'
  when status >= 500 then 'medium' when status = 404 then 'low' when status >= 400 then 'medium' else 'low' end"""
FAILS = "case when {n} >= 10 then 'critical' when {n} >= 5 then 'high' when {n} >= 3 then 'medium' else 'low' end"


@query("src_text_lines", "select id, line from access_lines order by id desc limit 1000")
def _(t):
    return ll.tail_lines(t.access_lines, "id")


@query("parse_nginx_access", f"with {REQ} select * from req")
def _(t):
    return requests(t).select("id", "ip", "stamp", "method", "path", "status", "size", "referrer", "user_agent", "timestamp")


def requests(t):
    return ll.parse_access(t.access_lines)


@query("parse_nginx_error", "select id, trim(line) as raw, 'nginx_error' as type from access_lines")
def _(t):
    return ll.parse_error(t.access_lines)


@query("ingest_nginx_events", f"""
with {TYPED} select id, timestamp, case when len(ty) > 0 then 'http_attack' when status = 404 then 'http_404' else 'http_error' end as event_type, {SEV} as severity,
  ip as source_ip, 'http' as protocol, substr(path, 1, 500) as request_path, substr(user_agent, 1, 500) as user_agent,
  case when len(ty) > 0 then array_to_string(ty, ',') when status = 404 then 'scan' else 'error' end as attack_vector,
  '{{"method":"' || method || '","status":' || status || ',"attack_types":[' || case when len(ty) > 0 then '"' || array_to_string(ty, '","') || '"' else '' end || ']}}' as details
from typed where len(ty) > 0 or status >= 400""")
def _(t):
    return ll.access_events(requests(t))


@query("attack_types", f"with {TYPED} select id, array_to_string(ty, '|') as attack_types from typed")
def _(t):
    r = requests(t)
    return r.select("id", text.attack_types(F.col("path"), F.col("user_agent")).alias("attack_types"))


@query("determine_severity", f"with {TYPED} select id, {SEV} as severity from typed")
def _(t):
    r = requests(t)
    return r.select("id", text.attack_severity(F.col("status"), text.attack_types(F.col("path"), F.col("user_agent"))).alias("severity"))


LOGIN = f"""logins as (select id, status, stamp, case when status in ('failed', 'success') then nullif(regexp_extract(line, 'for (\\w+) from ([\\d.]+)', 1), '')
    when status = 'invalid_user' then nullif(regexp_extract(line, 'Invalid user (\\w+) from ([\\d.]+)', 1), '') end as user,
  case when status in ('failed', 'success') then nullif(regexp_extract(line, 'for (\\w+) from ([\\d.]+)', 2), '')
    when status = 'invalid_user' then nullif(regexp_extract(line, 'Invalid user (\\w+) from ([\\d.]+)', 2), '') end as ip
  from (select *, case when contains(line, 'Failed password') then 'failed' when contains(line, 'Accepted password') or contains(line, 'Accepted publickey') then 'success'
    when contains(line, 'Invalid user') then 'invalid_user' end as status, nullif({STAMP}, '') as stamp from auth_lines where contains(lower(line), 'sshd')))"""
ATT = f"""att as (select id, kind, case kind when 'failed' then regexp_extract(line, {lit(ll.LOGIN_FAILED)}, 2) when 'accepted' then regexp_extract(line, {lit(ll.LOGIN_ACCEPTED)}, 3) else regexp_extract(line, {lit(ll.LOGIN_INVALID)}, 2) end as user,
  case kind when 'failed' then regexp_extract(line, {lit(ll.LOGIN_FAILED)}, 3) when 'accepted' then regexp_extract(line, {lit(ll.LOGIN_ACCEPTED)}, 4) else regexp_extract(line, {lit(ll.LOGIN_INVALID)}, 3) end as ip,
  case kind when 'accepted' then regexp_extract(line, {lit(ll.LOGIN_ACCEPTED)}, 2) end as method,
  try_strptime('{YEAR} ' || regexp_replace({STAMP}, '\\s+', ' ', 'g'), '%Y %b %d %H:%M:%S') as timestamp
  from (select *, case when regexp_matches(line, {lit(ll.LOGIN_FAILED)}) then 'failed' when regexp_matches(line, {lit(ll.LOGIN_ACCEPTED)}) then 'accepted'
    when regexp_matches(line, {lit(ll.LOGIN_INVALID)}) then 'invalid' end as kind from auth_lines where contains(line, 'sshd')) where kind is not null),
fail as (select *, count(*) over (partition by ip order by epoch_us(timestamp) range between 599999999 preceding and current row) as failures from att where kind = 'failed')"""


@query("parse_sshd", f"with {LOGIN} select * from logins")
def _(t):
    return logins(t).select("id", "status", "stamp", "user", "ip")


def logins(t):
    return ll.parse_sshd(t.auth_lines)


@query("ingest_sshd_events", f"""
with {ATT}
select id, timestamp, case when failures >= 5 then 'ssh_brute_force' else 'ssh_failed_login' end as event_type, {FAILS.format(n='failures')} as severity, ip as source_ip, 'ssh' as protocol,
  case when failures >= 5 then 'brute_force' else 'auth_failure' end as attack_vector, 'Failed SSH login for user ''' || user || ''' (attempt ' || failures || ')' as description, 'username: ' || user as details from fail
union all select id, timestamp, 'ssh_successful_login', 'low', ip, 'ssh', 'auth_success', 'Successful SSH login for user ''' || user || ''' via ' || method, 'username: ' || user || ', method: ' || method from att where kind = 'accepted'
union all select id, timestamp, 'ssh_invalid_user', 'medium', ip, 'ssh', 'scan', 'SSH attempt with invalid user ''' || user || '''', 'username: ' || user from att where kind = 'invalid'""")
def _(t):
    return ll.login_events(t.auth_lines, YEAR)


@query("ssh_failures_10m", f"with {ATT} select id, ip, timestamp, failures, {FAILS.format(n='failures')} as severity from fail")
def _(t):
    f = ll.failures_10m(attempts(t))
    return f.select("id", "ip", "timestamp", "failures", text.failure_severity(F.col("failures")).alias("severity"))


def attempts(t):
    return ll.login_attempts(t.auth_lines, YEAR)


BANS = f"""bans as (select id, kind, case when kind = 'ban' then regexp_extract(line, {lit(ll.BAN)}, 2) end as jail, case when kind = 'ban' then regexp_extract(line, {lit(ll.BAN)}, 3) end as ip,
  case when kind = 'ban' then try_strptime(regexp_extract(line, {lit(ll.BAN)}, 1), '%Y-%m-%d %H:%M:%S') end as timestamp
  from (select *, case when regexp_matches(line, {lit(ll.BAN)}) then 'ban' when regexp_matches(line, {lit(ll.UNBAN)}) then 'unban' when regexp_matches(line, {lit(ll.FOUND)}) then 'found' end as kind from ban_lines)
  where kind is not null)"""


@query("ingest_ban_events", f"""
with {BANS} select id, timestamp, 'fail2ban_ban' as event_type, case when contains(jail, 'sshd') or contains(jail, 'recidive') then 'high' else 'medium' end as severity,
  ip as source_ip, 'fail2ban' as protocol, jail as attack_vector, 'IP banned by Fail2ban jail: ' || jail as details from bans where kind = 'ban'""")
def _(t):
    return ll.ban_events(t.ban_lines)


@query("recent_bans", f"with {BANS} select timestamp, jail, ip from bans where kind = 'ban' order by timestamp desc, id desc limit 10")
def _(t):
    return ll.recent_bans(t.ban_lines).select("timestamp", "jail", "ip")


@query("ingest_summary", f"""
with {TYPED}, {BANS}, {ATT}
select 'nginx_access' as source, (select count(*) from access_lines) as total_lines, (select count(*) from typed where len(ty) > 0 or status >= 400) as created,
  (select count(*) from access_lines where trim(line) <> '') - (select count(*) from typed where len(ty) > 0 or status >= 400) as skipped
union all select 'ssh_auth', (select count(*) from auth_lines), (select count(*) from att), 0
union all select 'fail2ban', (select count(*) from ban_lines), (select count(*) from bans where kind = 'ban'), (select count(*) from bans where kind <> 'ban')""")
def _(t):
    return ll.ingest_summary(t.access_lines, t.auth_lines, t.ban_lines, YEAR)


@query("normalize_nginx_ts", f"with {REQ} select id, stamp, timestamp from req")
def _(t):
    return requests(t).select("id", "stamp", from_access_stamp(F.col("stamp")).alias("timestamp"))


@query("normalize_syslog_ts", f"select id, {STAMP} as stamp, try_strptime('{YEAR} ' || regexp_replace({STAMP}, '\\s+', ' ', 'g'), '%Y %b %d %H:%M:%S') as timestamp from auth_lines")
def _(t):
    s = ll.group(ll.SYSLOG_STAMP, 1)
    return t.auth_lines.select("id", s.alias("stamp"), from_syslog_stamp(s, YEAR).alias("timestamp"))


@query("blocked_access_events", """
select h.id, h.timestamp, 'blocked_access_attempt' as event_type, 'medium' as severity, h.ip as source_ip, 'blocked_ip' as attack_vector, h.path as request_path
from http_access h where h.ip in (select ip_address from blocked_ips where is_permanent or unblock_time is null or unblock_time > timestamp '2024-01-31 00:00:00')
  and h.ip not in (select ip_address from ip_lists where list = 'whitelist' and is_active)""")
def _(t):
    return wl.blocked_access(t.http_access, active_ips(t.blocked_ips, AS_OF), listed_ips(t.ip_lists, "whitelist"))


# ------------------------------------------------------------------ expressions
SIG_SQL = {k: "case " + " ".join(f"when {rx('path', p)} then {lit(fixed.SIGNATURE_LABELS[k] + p[:50])}" for p in pats) + " end"
           for k, pats in text.SIGNATURES.items()}


@query("signature_detail", "select id, " + ", ".join(f"{s} as {k}" for k, s in SIG_SQL.items()) + " from http_access")
def _(t):
    return t.http_access.select("id", *[text.signature_detail(F.col("path"), k).alias(k) for k in text.SIGNATURES])


TRUST = any_word("lower(user_agent)", fixed.TRUSTED_CRAWLERS)
AGENT_SQL = "case " + " ".join(f"when contains(lower(user_agent), '{w}') then 'Malicious tool detected: {w}'" for w in fixed.HACK_TOOLS) + " " + " ".join(
    f"when contains(lower(user_agent), '{w}') and not {TRUST} then 'Suspicious user agent: {w}'" for w in fixed.SUSPICIOUS_AGENTS) + " end"


@query("malicious_agent", f"select id, user_agent, {AGENT_SQL} as detail from http_access")
def _(t):
    return t.http_access.select("id", "user_agent", text.malicious_agent(F.col("user_agent")).alias("detail"))


LEGIT = any_word("lower(user_agent)", fixed.LEGITIMATE_BOTS)
UA_SCORE = "(" + " + ".join(f"case when contains(lower(user_agent), '{w}') then 20 else 0 end" for w in fixed.BOT_PATTERNS) + """
  + case when length(user_agent) < 20 then 10 else 0 end + case when user_agent not like '%Mozilla%' and user_agent not like '%Chrome%' and user_agent not like '%Safari%' then 15 else 0 end)"""


@query("user_agent_score", f"select user_agent, cast({UA_SCORE} as int) as score, {UA_SCORE} >= 20 as is_bot, {LEGIT} as is_legitimate, count(*) as n from http_access group by user_agent")
def _(t):
    ua = F.col("user_agent")
    seen = t.http_access.groupBy("user_agent").agg(F.count("*").alias("n"))
    return seen.select("user_agent", text.agent_score(ua).alias("score"), (text.agent_score(ua) >= 20).alias("is_bot"),
                       text.is_legitimate_bot(ua).alias("is_legitimate"), "n")


@query("is_legitimate_bot", f"select id, {LEGIT} as is_legitimate from http_access")
def _(t):
    return t.http_access.select("id", text.is_legitimate_bot(F.col("user_agent")).alias("is_legitimate"))


CLASS_SQL = "case " + " ".join(f"when contains(lower(user_agent), '{w}') then '{n}'" for w, n in fixed.BOT_CLASSES.items()) + f""" when {any_word('lower(user_agent)', fixed.SCRAPER_TOOLS)} then 'Web Scraper'
  when {any_word('lower(user_agent)', fixed.HTTP_CLIENTS)} then 'HTTP Client Tool' when n > 100 then 'Aggressive Scraper' else 'Unknown Bot' end"""
FIRST = "first_ua as (select ip, count(*) as n, arg_min(user_agent, (timestamp, id)) as user_agent from http_access group by ip)"


@query("bot_class", f"with {FIRST} select ip, user_agent, {CLASS_SQL} as bot_class from first_ua")
def _(t):
    first = t.http_access.groupBy("ip").agg(F.count("*").alias("n"), F.min_by("user_agent", F.struct("timestamp", "id")).alias("user_agent"))
    return first.select("ip", "user_agent", text.bot_class(F.col("user_agent"), F.col("n") > 100).alias("bot_class"))


@query("first_agent_per_ip", f"with {FIRST} select ip, user_agent from first_ua")
def _(t):
    return wl.first_agents(t.http_access)


FLOOD_N, FLOOD_S = 3, 3600
THREAT_SQL = f"""with fl as (select *, count(*) over (partition by ip order by epoch_us(timestamp) range between {FLOOD_S * 1000000 - 1} preceding and current row) as rate from http_access),
d as (select id, {", ".join(f"{s} as {k}" for k, s in SIG_SQL.items())}, {AGENT_SQL} as malicious_bot, rate >= {FLOOD_N} as flooding from fl)
select id, concat_ws('|', case when sql_injection is not null then 'sql_injection' end, case when xss is not null then 'xss' end, case when path_traversal is not null then 'path_traversal' end,
  case when command_injection is not null then 'command_injection' end, case when malicious_bot is not null then 'malicious_bot' end, case when flooding then 'http_flooding' end) as threats,
  case when command_injection is not null then 'critical' when sql_injection is not null or xss is not null or path_traversal is not null or flooding then 'high' when malicious_bot is not null then 'medium' else 'none' end as overall_severity,
  command_injection is not null or sql_injection is not null or xss is not null or path_traversal is not null or flooding as should_block from d"""


@query("http_request_threats", THREAT_SQL)
def _(t):
    rated = trailing_count(t.http_access, ["ip"], "timestamp", FLOOD_S * 1_000_000, "rate")
    out = wl.request_threats(rated, F.col("rate") >= FLOOD_N)
    return out.select("id", F.transform("threats", lambda e: e["type"]).alias("threats"), "overall_severity", "should_block")


# ------------------------------------------------------------------ reports
@query("failed_ssh_count", f"with {LOGIN} select count(*) filter (where status = 'failed') as failed from logins")
def _(t):
    return logins(t).agg(F.count_if(F.col("status") == "failed").alias("failed"))


@query("recent_ssh_failures", f"with {LOGIN} select id, status, user, ip from logins where status in ('failed', 'invalid_user') order by id desc limit 10")
def _(t):
    bad = logins(t).filter(F.col("status").isin("failed", "invalid_user"))
    return bad.orderBy(F.desc("id")).limit(10).select("id", "status", "user", "ip")


TOPS = "select '{s}' as section, cast({c} as varchar) as key, n from (select {c}, count(*) as n from {f} group by {c} order by n desc, {c} limit {k})"


@query("ssh_pattern_summary", f"""
with {LOGIN} select 'attempts' as section, 'total' as key, count(*) as n from logins union all select 'attempts', 'failed', count(*) filter (where status = 'failed') from logins
union all select 'attempts', 'successful', count(*) filter (where status = 'success') from logins
union all {TOPS.format(s='attacking_ip', c='ip', f="logins where status = 'failed' and ip is not null", k=10)}
union all {TOPS.format(s='attempted_user', c='user', f="logins where status in ('failed', 'invalid_user') and user is not null", k=10)}""")
def _(t):
    return wl.ssh_summary(logins(t))


PATH_CLASS = "case " + " ".join(f"when {rx('path', p)} then '{n}'" for p, n in fixed.PATH_CLASSES) + " end"


@query("nginx_pattern_summary", f"""
with {REQ} select 'totals' as section, 'total_requests' as key, count(*) as n from req union all select 'totals', 'unique_ips', count(distinct ip) from req
union all select 'totals', 'suspicious_requests', count({PATH_CLASS}) from req
union all select 'status', cast(status as varchar), count(*) from req group by status
union all {TOPS.format(s='top_ip', c='ip', f='req', k=10)}""")
def _(t):
    return wl.web_summary(requests(t))


F_BRUTE = "select 'ssh_bruteforce' as type, case when n > 50 then 'high' else 'medium' end as severity, ip, n as count from (select ip, count(*) as n from logins where status = 'failed' and ip is not null group by ip order by n desc, ip limit 20) where n > 10"
F_SCRAPE = "select 'possible_scraping' as type, case when n > 500 then 'high' else 'medium' end as severity, ip, n as count from (select ip, count(*) as n from req group by ip order by n desc, ip limit 20) where n > 100"
F_PATHS = f"select cls as type, case when n > 20 then 'high' else 'medium' end as severity, cast(null as varchar) as ip, n as count from (select {PATH_CLASS} as cls, count(*) as n from req group by 1) where cls is not null and n > 5"


@query("ssh_bruteforce_threats", f"with {LOGIN} {F_BRUTE}")
def _(t):
    return wl.ssh_bruteforce(logins(t))


@query("scraping_threats", f"with {REQ} {F_SCRAPE}")
def _(t):
    return wl.scraping(requests(t))


@query("suspicious_path_threats", f"with {REQ} {F_PATHS}")
def _(t):
    return wl.suspicious_paths(requests(t))


F_BFI = "bfi as (select ip, count(*) as attempts, count(distinct coalesce(user, 'unknown')) as user_count from logins where status = 'failed' and ip is not null group by ip having count(*) >= 10)"


@query("brute_force_ips", f"""with {LOGIN}, {F_BFI} select ip, any_value(attempts) as attempts, coalesce(user, 'unknown') as user, count(*) as tries
from bfi join logins using (ip) where status = 'failed' group by ip, coalesce(user, 'unknown')""")
def _(t):
    return wl.brute_force_ips(logins(t))


@query("suspicious_request_count", f"with {REQ} select count(*) filter (where {any_rx('path', fixed.SUSPICIOUS_PATHS)}) as suspicious from req")
def _(t):
    return requests(t).agg(F.count_if(text.suspicious_path(F.col("path"))).alias("suspicious"))


@query("import_suspicious_ips", f"with {TYPED} select ip, count(*) as requests, count(*) filter (where len(ty) > 0) as attacks from typed group by ip having count(*) > 100 or count(*) filter (where len(ty) > 0) > 5")
def _(t):
    return wl.heavy_importers(requests(t))


@query("import_brute_ips", f"with {ATT} select ip, count(*) as failed_attempts from att where kind = 'failed' group by ip having count(*) >= 5")
def _(t):
    return wl.failing_importers(attempts(t))


OFF = "select ip, count(*) as bans, string_agg(distinct jail, '|' order by jail) as jails from bans where kind = 'ban' group by ip having count(*) > {n}"


@query("repeat_offenders", f"with {BANS} {OFF.format(n=1)}")
def _(t):
    return wl.repeat_offenders(ll.parse_bans(t.ban_lines))


@query("offender_block_candidates", f"""
with {BANS}, {ATT}, o as ({OFF.format(n=2)})
select ip as ip_address, 'Auto-bloqueado: ' || count(*) || ' intentos SSH fallidos (detectado en logs históricos)' as reason, 'ml_auto' as blocked_by, 48 as duration_hours from att where kind = 'failed' group by ip having count(*) >= 10
union all select ip, 'Auto-bloqueado: ' || bans || ' bans por Fail2ban en jails: ' || array_to_string(string_split(jails, '|')[1:3], ', '), 'ml_auto', 72 from o""")
def _(t):
    return wl.offender_blocks(attempts(t), ll.parse_bans(t.ban_lines))


HITS = {n: "(" + " + ".join(f"case when contains(lower(path), {lit(p)}) then 1 else 0 end" for p in ps) + ")" for n, ps in fixed.VULN_FAMILIES.items()}
VULN = f"""vh as (select ip, {", ".join(f"cast(sum({h}) as bigint) as {n}" for n, h in HITS.items())} from {{src}} group by ip),
vuln as (select ip, {" + ".join(HITS)} as attempt_count, {" + ".join(f"case when {n} > 0 then 1 else 0 end" for n in HITS)} as kinds,
  array_to_string(list_sort([x for x in [{", ".join(f"case when {n} > 0 then '{n}' end" for n in HITS)}] if x is not null]), '|') as scan_types from vh)"""
VULN_KEEP = "attempt_count >= 5 or kinds >= 3"


@query("vuln_scan_threats", f"with {VULN.format(src='http_access')} select ip, attempt_count, scan_types, case when kinds >= 3 then 'high' else 'medium' end as severity from vuln where {VULN_KEEP}")
def _(t):
    return wl.vulnerability_scans(t.http_access)


def hits_sql(patterns, src, name):
    rows = " union all ".join(f"select {i} as i, {lit(p)} as pattern" for i, p in enumerate(patterns))
    return f"""{name}_p as ({rows}), {name}_h as (select ip, path, pattern, row_number() over (partition by ip order by timestamp, id, i) as rn from {src}, {name}_p where regexp_matches(path, pattern, 'i')),
{name} as (select ip, count(*) as attempts, string_agg(path || ' ~ ' || pattern, '|' order by rn) filter (where rn <= 5) as examples, 'high' as severity from {name}_h group by ip)"""


@query("sqli_threats", f"with {hits_sql(fixed.SQLI_PATTERNS, 'http_access', 'sq')} select * from sq")
def _(t):
    return wl.pattern_attempts(t.http_access, fixed.SQLI_PATTERNS)


@query("xss_threats", f"with {hits_sql(fixed.XSS_PATTERNS, 'http_access', 'xs')} select * from xs")
def _(t):
    return wl.pattern_attempts(t.http_access, fixed.XSS_PATTERNS)


BOTS = f"""bs as (select ip, count(*) as n, count(*) filter (where {any_word('lower(user_agent)', fixed.BOT_PATTERNS)}) as ba, count(*) filter (where referrer in ('-', '')) as nr,
  count(*) filter (where regexp_matches(path, '/\\d+')) as num, count(*) filter (where {any_word('lower(path)', fixed.LISTED_FILES)}) as listed, count(distinct user_agent) as uas,
  arg_min(user_agent, (timestamp, id)) as user_agent from {{src}} group by ip),
bots as (select ip, ba * 30 + case when n > 100 then 25 else 0 end + case when nr / n > 0.8 then 20 else 0 end + case when num > 20 then 15 else 0 end
  + case when uas = 1 and n > 10 then 10 else 0 end + listed * 5 as score, n as request_count, user_agent, {CLASS_SQL} as type from bs)"""


def first_bit(value: str, words: list[str]) -> str:
    return "bit_or(cast(case " + " ".join(f"when contains({value}, {lit(w)}) then {1 << i}" for i, w in enumerate(words)) + " else 0 end as bigint))"


def named_bits(bits: str, before: str, words: list[str]) -> str:
    return ", ".join(f"case when {bits} & {1 << i} <> 0 then {lit(before + w)} end" for i, w in enumerate(words))


WHY = fixed.BOT_REASONS
REASONS = f"""concat_ws('|', {named_bits('aw', WHY['agent'], fixed.BOT_PATTERNS)}, case when n > 100 then '{WHY['rapid']}' || n end,
  case when nr / n > 0.8 then '{WHY['referrer']}' || printf('%.2f%%', round_even(nr / n * 100, 2)) end, case when num > 20 then '{WHY['numbered']}' || num end,
  case when uas = 1 and n > 10 then '{WHY['one_agent']}' end, {named_bits('fw', WHY['listed'], fixed.LISTED_FILES)})"""


@query("bot_scores", f"""
with {BOTS.format(src='http_access')}, wd as (select ip, {first_bit('lower(user_agent)', fixed.BOT_PATTERNS)} as aw, {first_bit('lower(path)', fixed.LISTED_FILES)} as fw from http_access group by ip),
why as (select bs.ip, {REASONS} as reasons from bs join wd on wd.ip = bs.ip)
select bots.ip, score, type, request_count, user_agent, case when score >= 60 then 'high' else 'medium' end as severity, why.reasons
from bots join why on why.ip = bots.ip where score >= 30""")
def _(t):
    return wl.bot_scores(t.http_access)


ALL = f"""{REQ}, {LOGIN}, {F_BFI}, {VULN.format(src='req')}, {BOTS.format(src='req')}, {hits_sql(fixed.SQLI_PATTERNS, 'req', 'sq')}, {hits_sql(fixed.XSS_PATTERNS, 'req', 'xs')},
findings as ({F_BRUTE} union all {F_SCRAPE} union all {F_PATHS}
  union all select 'malicious_bot', 'high', ip, request_count from bots where score >= 60 and type not like 'Search Engine%' and type not like 'Social Media%'
  union all select 'brute_force_attack', case when attempts > 50 then 'high' else 'medium' end, ip, attempts from bfi
  union all select 'vulnerability_scan', case when kinds >= 3 then 'high' else 'medium' end, ip, attempt_count from vuln where {VULN_KEEP}
  union all select 'sql_injection_attempt', 'high', ip, attempts from sq union all select 'xss_attempt', 'high', ip, attempts from xs)"""


def findings(t):
    return wl.all_findings(requests(t), logins(t))


@query("threat_scan_union", f"with {ALL} select type, severity, ip, count from findings")
def _(t):
    return findings(t)


@query("union_findings", f"""with {ALL} select type, severity, ip, count, cast(null as bigint) as user_count from findings where type <> 'brute_force_attack'
union all select 'brute_force_attack', case when attempts > 50 then 'high' else 'medium' end, ip, attempts, user_count from bfi""")
def _(t):
    base = findings(t).filter(F.col("type") != "brute_force_attack")
    brute = wl.brute_force_totals(logins(t)).select(
        F.lit("brute_force_attack").alias("type"), F.when(F.col("attempts") > 50, "high").otherwise("medium").alias("severity"),
        "ip", F.col("attempts").alias("count"), "user_count")
    return base.unionByName(brute, allowMissingColumns=True)


@query("threat_statistics", """
select 'all' as grp, 'all' as value, count(*) as total, count(*) filter (where not is_resolved) as active, count(*) filter (where is_resolved) as resolved from threats
union all select 'type', threat_type, count(*), count(*) filter (where not is_resolved), count(*) filter (where is_resolved) from threats group by threat_type
union all select 'severity', severity, count(*), count(*) filter (where not is_resolved), count(*) filter (where is_resolved) from threats group by severity""")
def _(t):
    rows = t.threats.select(F.col("threat_type").alias("type"), "severity", F.col("is_resolved").alias("resolved"))
    return wl.finding_statistics(rows)


# ------------------------------------------------------------------ windows over events
@query("nth_latest_events", "select source_ip, id, timestamp, rn from (select *, row_number() over (partition by source_ip order by timestamp desc, id desc) as rn from security_events) where rn <= 50")
def _(t):
    return latest_per_key(t.security_events, ["source_ip"], "timestamp", "id", 50).select(
        "source_ip", "id", "timestamp", F.col("rn").cast("bigint").alias("rn"))


# ------------------------------------------------------------------ batch twins of the streaming jobs


def sliding(key, src, span, slide, agg, at_least):
    """Check SQL of sliding windows aligned to the epoch."""
    steps = span // slide
    return f"""with w as (select x.*, make_timestamp((epoch_us(x.timestamp) // {slide * 1000000} - s.i) * {slide * 1000000}) as ws from {src} x, range({steps}) s(i))
select {key}, ws as window_start, ws + interval {span} second as window_end, {agg} as n from w group by {key}, ws having {agg} >= {at_least}"""


@query("ssh_brute_force_window", sliding("ip", f"(with {ATT} select * from att where kind = 'failed')", 600, 60, "count(*)", 5))
def _(t):
    return wl.window_counts(attempts(t).filter("kind = 'failed'"), "ip", "600 seconds", "60 seconds", 5)


@query("http_flood_window", sliding("source_ip", "(select * from security_events where protocol in ('http', 'https'))", 3600, 600, "count(*)", 2))
def _(t):
    rows = t.security_events.filter(F.col("protocol").isin("http", "https"))
    return wl.window_counts(rows, "source_ip", "3600 seconds", "600 seconds", 2)


@query("port_scan_window", sliding("source_ip", "conn", 600, 60, "count(distinct dest_port)", 4))
def _(t):
    return wl.window_counts(t.conn.filter(F.col("dest_port").isNotNull()), "source_ip", "600 seconds", "60 seconds", 4, "dest_port")


def greedy_sql(trips, key, span_s):
    """Check SQL of the greedy cool-down: recursive over the fired times."""
    us = span_s * 1000000
    return f"""fires as (select {key}, min(us) as us from ({trips}) group by {key}
  union all select f.{key}, (select min(n.us) from ({trips}) n where n.{key} = f.{key} and n.us >= f.us + {us}) from fires f
  where exists (select 1 from ({trips}) n where n.{key} = f.{key} and n.us >= f.us + {us}))"""


def jail_sql(src, retry, find, ban):
    return f"""with recursive hits as (select ip, epoch_us(timestamp) as us, count(*) over (partition by ip order by epoch_us(timestamp) range between {find * 1000000 - 1} preceding and current row) as n from {src}),
trip as (select distinct ip, us from hits where n >= {retry}), {greedy_sql('select * from trip', 'ip', ban)}
select ip, make_timestamp(us) as banned_at, make_timestamp(us + {ban * 1000000}) as banned_until from fires"""


def jail_bans(requests_df, retry, find, ban):
    """Bans of a jail: ``retry`` hits in ``find`` seconds, one ban at a time of ``ban`` seconds."""
    rate = trailing_count(requests_df, ["ip"], "timestamp", find * 1_000_000, "n").filter(F.col("n") >= retry)
    fired = cooldown.fire_times(rate.select(F.col("ip").alias("key"), micros("timestamp").alias("us"), F.lit(ban * 1_000_000).cast("bigint").alias("cd")))
    return fired.select(
        F.col("key").alias("ip"), F.timestamp_micros("us").alias("banned_at"), F.timestamp_micros(F.col("us") + ban * 1_000_000).alias("banned_until"))


@query("rate_limit_jail", jail_sql(f"(select * from http_access where method in {tuple(fixed.JAIL_METHODS)})", 3, 3600, 86400))
def _(t):
    return jail_bans(wl.counted_requests(t.http_access).select("ip", "timestamp"), 3, 3600, 86400)


JAILED = f"""(select * from http_access where method in ('GET', 'POST') and (regexp_matches(user_agent, '^{fixed.JAIL_AGENTS}') or regexp_matches(referrer, '^{fixed.JAIL_AGENTS}'))
  and not regexp_matches(path || ' ' || referrer || ' ' || user_agent, '{fixed.JAIL_IGNORE}'))"""


@query("bot_jail", jail_sql(JAILED, 2, 7200, 7200))
def _(t):
    return jail_bans(wl.jail_hits(t.http_access).select("ip", "timestamp"), 2, 7200, 7200)


@query("block_gate", """
select h.id, h.ip, case when l.ip_address is not null then 'allow' when b.ip_address is not null then 'deny' else 'allow' end as verdict
from http_access h left join (select distinct ip_address from ip_lists where list = 'whitelist' and is_active) l on h.ip = l.ip_address
left join (select distinct ip_address from blocked_ips where is_permanent or unblock_time is null or unblock_time > timestamp '2024-01-31 00:00:00') b on h.ip = b.ip_address""")
def _(t):
    return gate(t.http_access.select("id", "ip"), active_ips(t.blocked_ips, AS_OF), listed_ips(t.ip_lists, "whitelist"))


def gate(requests_df, blocked, white):
    """Allow or deny each request; the whitelist goes first."""
    out = requests_df.join(white.withColumn("_w", F.lit(True)), "ip", "left").join(blocked.withColumn("_b", F.lit(True)), "ip", "left")
    return out.withColumn("verdict", F.when(F.col("_w").isNull() & F.col("_b").isNotNull(), "deny").otherwise("allow")).drop("_w", "_b")


@query("ssh_attempt_events", f"""
with {ATT} select id, timestamp, ip as source_ip, case kind when 'accepted' then 'ssh_successful_login' else 'ssh_failed_login' end as event_type,
  case kind when 'accepted' then 'low' else 'medium' end as severity from att where kind <> 'invalid'
union all select id, timestamp, ip, 'ssh_brute_force', 'high' from fail where failures >= 5""")
def _(t):
    a = attempts(t).filter(F.col("kind") != "invalid")
    ok = F.col("kind") == "accepted"
    base = a.select("id", "timestamp", F.col("ip").alias("source_ip"), F.when(ok, "ssh_successful_login").otherwise("ssh_failed_login").alias("event_type"),
                    F.when(ok, "low").otherwise("medium").alias("severity"))
    tripped = ll.failures_10m(a).filter("failures >= 5").select(
        "id", "timestamp", F.col("ip").alias("source_ip"), F.lit("ssh_brute_force").alias("event_type"), F.lit("high").alias("severity"))
    return base.unionByName(tripped)


BAN_ALERT = f"""with {BANS}, f as (select ip, arg_min(jail, (timestamp, id)) as jail, min(timestamp) as timestamp from bans where kind = 'ban' group by ip)
select ip, jail, timestamp, case when jail in ('sshd', 'ssh') then 'HIGH' else 'MEDIUM' end as severity, 'IP ' || ip || ' bloqueada por Fail2ban en jail ' || jail as reason from f"""


@query("ban_alert_severity", BAN_ALERT)
def _(t):
    return wl.ban_alerts(ll.parse_bans(t.ban_lines))
