"""Queries that go through files: monitor logs, manifests, exports, snapshots, polled ingest.

The inputs are first written as log files under the shared folder, then read
back by the operator under test.
"""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import functions as F, types as T

from ..functions.times import from_epoch_text, ts_lit
from ..operators import events as ev, network as net, weblogs as wl
from ..session import shared_dir
from ..sinks import tables as sk
from ..sources import growing, loglines as ll, monitor as mo
from ..streaming import jobs
from .decision_queries import COUNTED
from .network_queries import ENT, EXPIRED, NOTE_SEV, SELF, WEAK
from .registry import ORACLES, query
from .views import AS_OF
from .weblog_queries import BAN_ALERT, LOGIN, any_rx, any_word, fixed, logins, requests

EPOCH = "cast(unix_micros(cast(timestamp as timestamp)) / 1e6 as decimal(20, 6))"

#: Most rows of a written log file: packed files are read by one task each.
FILE_LINES = 250_000

CONN_HEAD = ["ts", "uid", "id.orig_h", "id.resp_h", "id.resp_p", "proto", "duration", "orig_bytes", "resp_bytes", "conn_state", "orig_pkts", "resp_pkts", "local_orig", "history"]
CONN_CELLS = [f"cast({EPOCH} as string)", "uid", "source_ip", "dest_ip", "cast(dest_port as string)", "protocol", "coalesce(cast(duration as string), '-')",
              "cast(orig_bytes as string)", "coalesce(cast(resp_bytes as string), '-')", "conn_state", "cast(orig_pkts as string)", "cast(resp_pkts as string)",
              "case when protocol = 'tcp' then 'T' else 'F' end", "'(empty)'"]


def write_lines(lines, path, packed):
    """Log files of at most ``FILE_LINES`` rows, so that no file keeps one task busy."""
    lines.write.option("maxRecordsPerFile", FILE_LINES).text(path, compression=packed)


def write_tsv(t, df, head, cells, name, path=None, packed="gzip"):
    """Monitor log files, each with ``#separator`` and ``#fields`` lines on top; ``packed`` names a codec.

    Rotated logs are packed: as plain text the copy would be a dozen times the tables. The row that begins a file brings its header along.
    """
    path = path or shared_dir(t.spark, name)
    top = F.lit("\n".join(["#separator \\x09", "\t".join(["#fields", *head]), ""]))
    row = F.expr("concat_ws('\t', " + ", ".join(cells) + ")")
    nth = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # in its partition
    write_lines(df.select(F.concat(F.when(nth % FILE_LINES == 0, top).otherwise(""), row).alias("value")), path, packed)
    return ll.read_lines(t.spark, path)


def write_json(t, df, fields: dict[str, str], name, junk=True, path=None, packed="gzip"):
    """Monitor log files with one object per line, plus a comment and a broken line per file."""
    path = path or shared_dir(t.spark, name)
    body = df.select(F.to_json(F.struct(*[F.expr(e).alias(k) for k, e in fields.items()])).alias("value"))
    if junk:
        body = body.unionByName(df.limit(3).select(F.explode(F.array(F.lit("# note"), F.lit('{"ts": broken'), F.lit(" "))).alias("value")))
    write_lines(body, path, packed)
    return ll.read_lines(t.spark, path)


CONN_JSON = {"ts": EPOCH, "uid": "uid", "id.orig_h": "source_ip", "id.resp_h": "dest_ip", "id.resp_p": "dest_port", "proto": "protocol", "duration": "duration",
             "orig_bytes": "orig_bytes", "resp_bytes": "resp_bytes", "conn_state": "conn_state", "orig_pkts": "orig_pkts", "resp_pkts": "resp_pkts"}

DNS_JSON = {"ts": EPOCH, "uid": "concat('D', id)", "id.orig_h": "source_ip", "query": "query", "rcode": "rcode", "rcode_name": "rcode_name",
            "answers": "case when rcode = 0 then array(source_ip, '10.9.9.9') else array() end", "AA": "id % 2 = 0"}
SSL_HEAD = ["ts", "uid", "id.orig_h", "id.resp_h", "version", "server_name", "subject", "issuer", "validation_status", "not_valid_after"]
SSL_CELLS = [f"cast({EPOCH} as string)", "concat('S', id)", "source_ip", "dest_ip",
             *[f"coalesce({c}, '-')" for c in ("version", "server_name", "subject", "issuer", "validation_status")],
             f"cast({EPOCH.replace('timestamp as', 'not_valid_after as')} as string)"]
HTTP_JSON = {"ts": EPOCH, "uid": "concat('H', id)", "id.orig_h": "ip", "method": "method", "uri": "path", "user_agent": "user_agent", "status_code": "status", "response_body_len": "size"}
FILES_HEAD = ["ts", "fuid", "tx_hosts", "rx_hosts", "filename", "mime_type", "total_bytes"]
FILES_CELLS = ["'1706572800.5'", "fuid", "tx_hosts", "'-'", "filename", "coalesce(mime_type, '-')", "cast(total_bytes as string)"]
NOTICE_JSON = {"ts": EPOCH, "uid": "concat('N', id)", "id.orig_h": "orig_h", "src": "src", "note": "note"}


def raw(df):
    return df.select(F.col("uid"), F.col("`id.orig_h`").alias("orig_h"), F.col("`id.resp_p`").alias("resp_p"), "resp_bytes", "local_orig", "history")


TSV_SQL = "select uid, source_ip as orig_h, cast(dest_port as varchar) as resp_p, cast(resp_bytes as varchar) as resp_bytes, case when protocol = 'tcp' then 'true' else 'false' end as local_orig, '' as history from conn"
JSON_SQL = "select uid, source_ip as orig_h, cast(dest_port as varchar) as resp_p, cast(resp_bytes as varchar) as resp_bytes, cast(null as varchar) as local_orig, cast(null as varchar) as history from conn"


@query("parse_zeek_tsv", TSV_SQL)
def _(t):
    return raw(mo.parse_tsv(write_tsv(t, t.conn, CONN_HEAD, CONN_CELLS, "conn-tsv"), mo.FIELDS["conn"]))


@query("parse_zeek_json", JSON_SQL)
def _(t):
    return raw(mo.parse_json(write_json(t, t.conn, CONN_JSON, "conn-json"), mo.FIELDS["conn"]))


@query("parse_zeek_auto", f"{TSV_SQL} union all {JSON_SQL}")
def _(t):
    both = write_tsv(t, t.conn, CONN_HEAD, CONN_CELLS, "auto-tsv").unionByName(write_json(t, t.conn, CONN_JSON, "auto-json"))
    return raw(mo.parse_auto(both, mo.FIELDS["conn"]))


@query("zeek_conn", """
select timestamp, uid, source_ip, dest_ip, dest_port, protocol, cast(duration as double) as duration, orig_bytes, coalesce(resp_bytes, 0) as resp_bytes, conn_state, orig_pkts, resp_pkts, protocol = 'tcp' as local_orig, false as local_resp, '' as history from conn""")
def _(t):
    out = mo.conn_table(mo.parse_auto(write_tsv(t, t.conn, CONN_HEAD, CONN_CELLS, "zeek-conn"), mo.FIELDS["conn"]))
    return out.drop("source_port", "service")


@query("zeek_dns", f"""
select 'D' || id as uid, timestamp, source_ip, query, rcode, rcode_name, case when rcode = 0 then source_ip || '|' || '10.9.9.9' else '' end as answers, id % 2 = 0 as "AA", false as "RD", {ENT.format(c='query')} as query_entropy from dns""")
def _(t):
    out = mo.dns_table(mo.parse_auto(write_json(t, t.dns, DNS_JSON, "zeek-dns"), mo.FIELDS["dns"]))
    return out.select("uid", "timestamp", "source_ip", "query", "rcode", "rcode_name", "answers", "AA", "RD", "query_entropy")


@query("zeek_ssl", f"""
select 'S' || id as uid, timestamp, source_ip, dest_ip, version, server_name, subject, issuer, validation_status, not_valid_after, {SELF} as is_self_signed, {EXPIRED} as is_expired, {WEAK} as is_weak_cipher, {SELF} or {EXPIRED} or {WEAK} as is_suspicious from ssl""")
def _(t):
    out = mo.ssl_table(mo.parse_auto(write_tsv(t, t.ssl, SSL_HEAD, SSL_CELLS, "zeek-ssl"), mo.FIELDS["ssl"]), ts_lit(AS_OF))
    return out.select("uid", "timestamp", "source_ip", "dest_ip", "version", "server_name", "subject", "issuer", "validation_status", "not_valid_after",
                      "is_self_signed", "is_expired", "is_weak_cipher", "is_suspicious")


MARKS = any_word("path", fixed.HTTP_LOG_MARKS)


@query("zeek_http", f"""
select 'H' || id as uid, timestamp, ip as source_ip, method, path as uri, user_agent, status as status_code, size as response_body_len, cast(0 as bigint) as request_body_len,
  {MARKS} or regexp_matches(lower(user_agent), 'nikto|sqlmap') as is_suspicious from http_access""")
def _(t):
    out = mo.http_table(mo.parse_auto(write_json(t, t.http_access, HTTP_JSON, "zeek-http"), mo.FIELDS["http"]))
    return out.select("uid", "timestamp", "source_ip", "method", "uri", "user_agent", "status_code", "response_body_len", "request_body_len", "is_suspicious")


@query("zeek_files", """
select fuid, split_part(tx_hosts, ',', 1) as source_ip, cast(null as varchar) as dest_ip, filename, mime_type, total_bytes,
  coalesce(mime_type in ('application/x-executable', 'application/x-dosexec', 'application/x-sh', 'text/x-shellscript'), false) as is_suspicious
from files where mime_type is null or mime_type <> 'text/html'""")
def _(t):
    batch = mo.files_table(mo.parse_auto(write_tsv(t, t.files, FILES_HEAD, FILES_CELLS, "zeek-files"), mo.FIELDS["files"]))
    stored = t.files.filter("mime_type = 'text/html'")
    rows = batch.select("fuid", "source_ip", "dest_ip", "filename", "mime_type", "total_bytes", "is_suspicious")
    return net.new_rows(rows, stored, "fuid", "filename")


@query("zeek_notice", f"select 'N' || id as uid, timestamp, coalesce(orig_h, src) as source_ip, note, {NOTE_SEV} as severity from notices")
def _(t):
    out = mo.notice_table(mo.parse_auto(write_json(t, t.notices, NOTICE_JSON, "zeek-notice"), mo.FIELDS["notice"]))
    return out.select("uid", "timestamp", "source_ip", "note", "severity")


@query("normalize_ts", """
select event_id as id, case event_id % 4 when 0 then date_trunc('second', ts) when 1 then ts end as timestamp from events""")
def _(t):
    raw_text = F.expr("case event_id % 4 when 0 then cast(unix_seconds(cast(ts as timestamp)) as string) "
                      "when 1 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") when 2 then 'not a time' end")
    return t.events.select(F.col("event_id").alias("id"), from_epoch_text(raw_text).alias("timestamp"))


# ------------------------------------------------------------------ manifests, exports, snapshots
@query("log_file_manifest", " union all ".join(
    f"select '{log}' as log, cast(sum(octet_length(encode(line)) + 1) as bigint) as size from {view}"
    for log, view in (("access.log", "access_lines"), ("auth.log", "auth_lines"), ("fail2ban.log", "ban_lines"))))
def _(t):
    path = shared_dir(t.spark, "varlog")
    for name, df in (("access.log", t.access_lines), ("auth.log", t.auth_lines), ("fail2ban.log", t.ban_lines)):
        df.select(F.col("line").alias("value")).write.text(f"{path}/{name}")
    return ll.log_manifest(t.spark, path, "*.txt", r".*/[^/]+\.log/part-[^/]+\.txt$").select(
        F.regexp_extract("path", r"/([^/]+\.log)/", 1).alias("log"), "size").groupBy("log").agg(F.sum("size").alias("size"))


@query("zeek_conn_splits", None)
def _(t):
    """Connections from logs read in splits that carry their file's header, without a join of lines and headers."""
    path = shared_dir(t.spark, "conn-splits")
    write_tsv(t, t.conn, CONN_HEAD, CONN_CELLS, "conn", f"{path}/tsv", packed="none")
    lines = growing.read_growing(t.spark, path, glob="*.txt", splitBytes=str(8 << 20))
    return mo.conn_table(mo.parse_headed(lines, mo.FIELDS["conn"])).drop("source_port", "service")


ORACLES["zeek_conn_splits"] = ORACLES["zeek_conn"]


@query("growing_logs_stream", " union all ".join(
    f"select '{log}' as log, count(*) as lines, cast(sum(octet_length(encode(line)) + 1) as bigint) as size, min(line) as least, max(line) as most, "
    f"count(distinct md5(line)) as different from {view}"
    for log, view in (("access.log", "access_lines"), ("auth.log", "auth_lines"), ("fail2ban.log", "ban_lines"))))
def _(t):
    path, out = shared_dir(t.spark, "growing-logs"), shared_dir(t.spark, "growing-out")
    for half in (0, 1):
        for name, df in (("access.log", t.access_lines), ("auth.log", t.auth_lines), ("fail2ban.log", t.ban_lines)):
            df.filter(F.pmod(F.xxhash64("line"), F.lit(2)) == half).select(F.col("line").alias("value")).write.mode("append").text(f"{path}/{name}")
        jobs.run(growing.read_growing(t.spark, path, stream=True, glob="*.txt"), out)
    lines = t.spark.read.parquet(f"{out}/data").withColumn("log", F.regexp_extract("file", r"/([^/]+\.log)/", 1))
    counted = lines.groupBy("log", "line").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("log").agg(
        F.sum("n").alias("lines"), F.sum(F.col("n") * (F.octet_length("line") + 1)).alias("size"), F.min("line").alias("least"),
        F.max("line").alias("most"), F.count(F.lit(1)).alias("different"))


def top100(t):
    return ev.top_threats(t.security_events, t.predictions, AS_OF, limit=100)


@query("export_threats", None)
def _(t):
    path = shared_dir(t.spark, "export-threats")
    sk.export(top100(t), path, "csv", sk.THREAT_COLUMNS)
    return t.spark.read.option("header", True).option("timestampNTZFormat", sk.MICROS).schema(
        "ip string, score bigint, ml_confidence bigint, zeek_detections bigint, fail2ban_bans bigint, total_events bigint, country string, last_seen timestamp_ntz").csv(path)


@query("export_timeline", None)
def _(t):
    path = shared_dir(t.spark, "export-timeline")
    sk.export(ev.attack_timeline(t.security_events, AS_OF), path, "csv", sk.TIMELINE_COLUMNS)
    return t.spark.read.option("header", True).schema(
        "timestamp string, ml_detections bigint, zeek_detections bigint, fail2ban_bans bigint, total bigint").csv(path)


ORACLES["export_threats"] = (
    "select ip, score, ml_confidence, zeek_detections, fail2ban_bans, total_events, country, last_seen from ("
    + ORACLES["top_threats"].replace("limit 10", "limit 100") + ") x")
ORACLES["export_timeline"] = (
    "select timestamp, ml_detections, zeek_detections, fail2ban_bans, total from ("
    + ORACLES["attack_timeline"].replace("/ 50)", "/ 60)").replace("as int) * 50)", "as int) * 60)").replace("2024-01-24", "2024-01-30") + ") x")


@query("export_threats_json", None)
def _(t):
    path = shared_dir(t.spark, "export-threats-json")
    sk.export(top100(t), path, "json", sk.THREAT_COLUMNS)
    return t.spark.read.option("timestampNTZFormat", sk.MICROS).schema(
        "ip string, score bigint, ml_confidence bigint, zeek_detections bigint, fail2ban_bans bigint, total_events bigint, country string, last_seen timestamp_ntz").json(path)


@query("export_timeline_json", None)
def _(t):
    path = shared_dir(t.spark, "export-timeline-json")
    sk.export(ev.attack_timeline(t.security_events, AS_OF), path, "json", sk.TIMELINE_COLUMNS)
    return t.spark.read.schema("timestamp string, ml_detections bigint, zeek_detections bigint, fail2ban_bans bigint, total bigint").json(path)


for _key in ("export_threats", "export_timeline"):
    ORACLES[f"{_key}_json"] = ORACLES[_key]


@query("snapshot_with_manifest", "with n as (" + " union all ".join(f"select '{c}' as table_name, count(*) as n from {c}" for c in COUNTED)
       + f"), a as (select * from n union all select 'total', cast(sum(n) as bigint) from n) select *, timestamp '2024-01-31 00:00:00' as export_date, {len(COUNTED)} as tables_count from a")
def _(t):
    return sk.snapshot({c: getattr(t, c) for c in COUNTED}, shared_dir(t.spark, "snapshot"), AS_OF)


@query("dashboard_combined", f"""
with {LOGIN}, d as ({ORACLES['dashboard_stats']}), b as ({ORACLES['bot_scores']})
select d.*, (select count(*) filter (where status = 'failed') from logins) as failed_ssh_attempts, (select count(*) filter (where {any_rx('path', fixed.SUSPICIOUS_PATHS)}) from http_access) as suspicious_requests,
  (select count(*) from b) as detected_bots from d""")
def _(t):
    from ..functions import text

    return ev.one_row(
        ev.dashboard_stats(t.security_events, t.blocked_ips, t.threats, t.alerts, AS_OF),
        logins(t).agg(F.count_if(F.col("status") == "failed").alias("failed_ssh_attempts")),
        requests(t).agg(F.count_if(text.suspicious_path(F.col("path"))).alias("suspicious_requests")),
        wl.bot_scores(t.http_access).agg(F.count("*").alias("detected_bots")),
    )


# ------------------------------------------------------------------ polled ingest and ban monitor, as streams run to the end of their input
@query("poll_ingest", """
select distinct 'conn' as log, uid, timestamp, source_ip, conn_state as detail from conn
union all select 'dns', 'D' || id, timestamp, source_ip, rcode_name from dns
union all select 'ssl', 'S' || id, timestamp, source_ip, version from ssl
union all select 'http', 'H' || id, timestamp, ip, method from http_access
union all select distinct 'files', fuid, timestamp '2024-01-30 00:00:00.5', split_part(tx_hosts, ',', 1), filename from files
union all select 'notice', 'N' || id, timestamp, coalesce(orig_h, src), note from notices""")
def _(t):
    base, out = shared_dir(t.spark, "poll-in"), shared_dir(t.spark, "poll-out")
    paths = {kind: f"{base}/{kind}/*" for kind in mo.FIELDS}

    def at(kind, part):
        return {"name": "", "path": f"{base}/{kind}/{part}"}

    tcp = F.col("protocol") == "tcp"
    write_tsv(t, t.conn.filter(tcp), CONN_HEAD, CONN_CELLS, **at("conn", "tsv"))
    write_json(t, t.conn.filter(~tcp), CONN_JSON, **at("conn", "json"))
    write_json(t, t.dns, DNS_JSON, **at("dns", "json"))
    write_tsv(t, t.ssl, SSL_HEAD, SSL_CELLS, **at("ssl", "tsv"))
    write_json(t, t.http_access, HTTP_JSON, **at("http", "json"))
    write_tsv(t, t.files, FILES_HEAD, FILES_CELLS, **at("files", "tsv"))
    write_json(t, t.notices, NOTICE_JSON, **at("notice", "json"))
    jobs.poll_logs(t.spark, paths, out, ts_lit(AS_OF))
    # days later keys that are stored come again, in the other format
    later = t.conn.filter(tcp).withColumn("timestamp", F.expr("timestamp + interval 3 days"))
    write_json(t, later, CONN_JSON, **at("conn", "again"))
    write_tsv(t, t.files, FILES_HEAD, FILES_CELLS, **at("files", "again"))
    jobs.poll_logs(t.spark, paths, out, ts_lit(AS_OF))
    detail = {"conn": "conn_state", "dns": "rcode_name", "ssl": "version", "http": "method", "files": "filename", "notice": "note"}
    parts = [t.spark.read.parquet(f"{out}/{kind}").select(
        F.lit(kind).alias("log"), F.col("fuid" if kind == "files" else "uid").alias("uid"), "timestamp", "source_ip", F.col(c).alias("detail"))
        for kind, c in detail.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("ban_monitor", BAN_ALERT)
def _(t):
    base, out = shared_dir(t.spark, "bans-in"), shared_dir(t.spark, "bans-out")
    t.ban_lines.select("id", "line").write.parquet(base)
    jobs.ban_monitor(t.spark, base, out)
    return t.spark.read.parquet(f"{out}/data").select("ip", "jail", "timestamp", "severity", "reason")


@query("ban_deliveries", f"""
with recursive a as ({BAN_ALERT}), f as (select a.*, r.id as rule_id, r.rule_name, r.channel_ids, r.subject_template, r.message_template from a, alert_rules r where r.rule_type = 'fail2ban_ban' and r.is_enabled)
select rule_id, ip, timestamp, severity, c.id as channel_id, replace(subject_template, '{{{{ ip }}}}', ip) as subject,
  replace(replace(replace(message_template, '{{{{ ip }}}}', ip), '{{{{severity}}}}', severity), '{{{{type}}}}', 'fail2ban_ban') as message,
  c.channel_type = 'email' and c.recipients > 0 as success
from (select *, unnest(cast(channel_ids as bigint[])) as cid from f) x join alert_channels c on c.id = x.cid where c.is_enabled""")
def _(t):
    base, out = shared_dir(t.spark, "bans-in"), shared_dir(t.spark, "bans-out")
    t.ban_lines.select("id", "line").write.parquet(base)
    jobs.ban_monitor(t.spark, base, out, t.alert_rules, t.alert_channels)
    return t.spark.read.parquet(f"{out}/deliveries").select("rule_id", "ip", "timestamp", "severity", "channel_id", "subject", "message", "success")


# ------------------------------------------------------------------ jobs on keyed state, stopped and started again in mid-stream
def streamed(t, df, job, name, **closing):
    """Output folder of ``job`` over ``df`` as a stream: the earlier half, the later half, and a closing row that lets the watermark pass."""
    base, out = shared_dir(t.spark, f"{name}-in"), shared_dir(t.spark, f"{name}-out")
    first, last = df.agg(F.min("timestamp"), F.max("timestamp")).first()
    free = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    row = {c: None for c in df.columns} | {"timestamp": last + timedelta(days=3)} | closing
    middle = F.col("timestamp") < ts_lit(first + (last - first) / 2)
    for part in (df.filter(middle), df.filter(~middle), t.spark.createDataFrame([tuple(row.values())], free)):
        part.write.mode("append").parquet(base)
        job(t.spark.readStream.schema(free).parquet(base), out)
    return out


def jail_stream(t, requests_df, name, job, **closing):
    schema = "ip string, action string, at timestamp, until timestamp"
    out = streamed(t, requests_df, lambda s, o: jobs.run(job(s), o), name, **closing)
    bans = t.spark.read.schema(schema).parquet(f"{out}/data").filter("action = 'ban'")
    return bans.select("ip", F.col("at").alias("banned_at"), F.col("until").alias("banned_until"))


@query("rate_limit_jail_stream", None)
def _(t):
    return jail_stream(t, t.http_access.select("timestamp", "ip", "method"), "rate-jail", lambda s: jobs.rate_jail(s, 3, 3600, 86400), method="GET")


@query("bot_jail_stream", None)
def _(t):
    rows = wl.jail_hits(t.http_access).select("timestamp", "ip", "method", "user_agent", "referrer", "path")
    return jail_stream(t, rows, "bot-jail", lambda s: jobs.bot_jail(s, 2, 7200, 7200), method="GET", user_agent="sqlmap", path="/")


@query("ssh_attempt_events_stream", None)
def _(t):
    rows = ll.login_attempts(t.auth_lines, 2024).select("id", "timestamp", "kind", "ip")
    out = streamed(t, rows, lambda s, o: jobs.run(jobs.ssh_attempt_events(s), o), "attempts", kind="failed")
    return t.spark.read.parquet(f"{out}/data").select("id", "timestamp", "source_ip", "event_type", "severity")


@query("alert_cooldown_stream", None)
def _(t):
    out = streamed(t, t.alert_events, lambda s, o: jobs.run(jobs.alert_cooldown(s, t.alert_rules), o), "cooldown")
    return t.spark.read.parquet(f"{out}/data").select("rule_id", "id", "timestamp")


@query("alert_deliveries_stream", None)
def _(t):
    out = streamed(t, t.alert_events, lambda s, o: jobs.alert_delivery(s, t.alert_rules, t.alert_channels, o), "delivery")
    return t.spark.read.parquet(f"{out}/deliveries").drop("n")


for _key in ("rate_limit_jail", "bot_jail", "ssh_attempt_events", "alert_cooldown", "alert_deliveries"):
    ORACLES[f"{_key}_stream"] = ORACLES[_key]
