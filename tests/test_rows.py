"""Row-level cases written by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logwarden.functions import fixed, text
from logwarden.functions.times import from_access_stamp, from_epoch_text, from_syslog_stamp
from logwarden.operators import alerts, events, geo, network, policy, weblogs
from logwarden.operators.intervals import trailing_count, with_previous
from logwarden.sinks import tables as sinks
from logwarden.sources import loglines, monitor


def values(df, column):
    return [r[column] for r in df.collect()]


def lines(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id bigint, line string")


def test_entropy_of_empty_and_uniform_text_is_zero(spark):
    df = spark.createDataFrame([("",), ("aaaa",), ("ab",), (None,)], "q string")
    assert values(df.select(text.shannon_entropy(F.col("q")).alias("e")), "e") == [0.0, 0.0, 1.0, 0.0]


def test_access_line_needs_a_numeric_size(spark):
    good = '1.2.3.4 - - [24/Jan/2024:10:30:45 +0000] "GET /a b HTTP/1.1" 200 12 "-" "Agent" more'
    bad = '1.2.3.4 - - [24/Jan/2024:10:30:45 +0000] "GET / HTTP/1.1" 200 - "-" "Agent"'
    rows = loglines.parse_access(lines(spark, good, bad, "x " + good, "")).collect()
    assert [(r.id, r.path, r.status, r.size, r.user_agent) for r in rows] == [(0, "/a b", 200, 12, "Agent")]
    assert rows[0].timestamp == datetime(2024, 1, 24, 10, 30, 45)


def test_syslog_day_with_one_digit_and_two_blanks(spark):
    df = lines(
        spark,
        "Jan  4 01:02:03 host sshd[1]: Failed password for invalid user bob from 9.9.9.9 port 1",
        "Jan 14 01:02:03 host sshd[1]: Accepted publickey for ann from 9.9.9.8 port 1",
        "Jan 14 01:02:04 host sshd[1]: Invalid user carl from 9.9.9.7",
        "Jan 14 01:02:04 host cron[1]: Failed password for x from 1.1.1.1",
    )
    rows = loglines.login_attempts(df, 2024).orderBy("id").collect()
    assert [(r.kind, r.user, r.ip, r.method) for r in rows] == [
        ("failed", "bob", "9.9.9.9", None), ("accepted", "ann", "9.9.9.8", "publickey"), ("invalid", "carl", "9.9.9.7", None)]
    assert rows[0].timestamp == datetime(2024, 1, 4, 1, 2, 3)


def test_stamps(spark):
    df = spark.createDataFrame([("1706572800",), ("1706572800.25",), ("2024-01-30T00:00:01",), ("soon",), (None,)], "s string")
    assert values(df.select(from_epoch_text(F.col("s")).alias("t")), "t") == [
        datetime(2024, 1, 30), datetime(2024, 1, 30, 0, 0, 0, 250000), datetime(2024, 1, 30, 0, 0, 1), None, None]
    one = spark.createDataFrame([("24/Jan/2024:10:30:45 +0900", "Feb  1 00:00:00")], "a string, b string")
    row = one.select(from_access_stamp(F.col("a")).alias("a"), from_syslog_stamp(F.col("b"), 2023).alias("b")).first()
    assert (row.a, row.b) == (datetime(2024, 1, 24, 10, 30, 45), datetime(2023, 2, 1))


def test_tsv_tokens_and_json_lines(spark):
    tsv = ["#separator \\x09", "#fields\tts\tuid\tid.orig_h\tlocal_orig\thistory\tduration", "1706572800.5\tC1\t1.1.1.1\tT\t(empty)\t-", "", "1706572801\tC2\t2.2.2.2\tF"]
    js = ["# note", "", '{"ts": 1706572800, "uid": "J1", "id.orig_h": "3.3.3.3"}', '{"broken": ']
    df = spark.createDataFrame([(x, "a.log") for x in tsv] + [(x, "b.log") for x in js], "line string, file string")
    rows = {r.uid: r for r in monitor.conn_table(monitor.parse_auto(df, monitor.FIELDS["conn"])).collect()}
    assert set(rows) == {"C1", "C2", "J1"}
    assert (rows["C1"].local_orig, rows["C1"].history, rows["C1"].duration, rows["C1"].orig_bytes) == (True, "", None, 0)
    assert (rows["C2"].local_orig, rows["C2"].history) == (False, None)
    assert rows["J1"].source_ip == "3.3.3.3" and rows["C1"].timestamp == datetime(2024, 1, 30, 0, 0, 0, 500000)


def test_other_separator_and_json_lists(spark):
    df = spark.createDataFrame([("#separator \\x7c", "f"), ("#fields|ts|fuid|tx_hosts", "f"), ("1|F1|4.4.4.4,5.5.5.5", "f")], "line string, file string")
    assert values(monitor.files_table(monitor.parse_auto(df, monitor.FIELDS["files"])), "source_ip") == ["4.4.4.4"]
    js = spark.createDataFrame([('{"ts":1,"uid":"D","answers":["a","b"],"query":"x"}', "g")], "line string, file string")
    assert values(monitor.dns_table(monitor.parse_auto(js, monitor.FIELDS["dns"])), "answers") == [["a", "b"]]


def test_trailing_count_has_a_strict_lower_bound_and_counts_ties(spark):
    secs = [0, 0, 599, 600, 601, 1300]
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate(secs)], "ip string, id int, s int").select(
        "ip", "id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)").alias("t"))
    out = {r.id: r.n for r in trailing_count(df, ["ip"], "t", 600_000_000, "n").collect()}
    assert out == {0: 2, 1: 2, 2: 3, 3: 2, 4: 3, 5: 1}


def test_previous_time_crosses_bucket_borders(spark):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate([0, 10, 59, 61, 4000])] + [("j", 9, 5)], "ip string, id int, s int").select(
        "ip", "id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)").alias("t"))
    out = {r.id: r.gap for r in with_previous(df, ["ip"], "t", ["id"]).select("id", ((F.col("_us") - F.col("prev_us")) / 1e6).alias("gap")).collect()}
    assert out == {0: None, 1: 10.0, 2: 49.0, 3: 2.0, 4: 3939.0, 9: None}


def test_identical_times_are_perfectly_regular(spark):
    df = spark.range(12).select(F.lit("a").alias("source_ip"), F.lit("b").alias("dest_ip"), F.lit(443).alias("dest_port"), F.expr("timestamp_ntz'2024-01-30 12:00:00'").alias("timestamp"))
    row = network.beaconing(df, datetime(2024, 1, 31)).first()
    assert (row.connection_count, row.mean_interval, row.regularity) == (12, 0.0, 1.0)


@pytest.mark.parametrize("conditions,matches", [
    ("{}", True),
    ('{"severity": {"operator": "~", "value": "HIGH"}}', False),
    ('{"confidence": {"operator": ">", "value": "90"}}', False),
    ('{"severity": {"operator": ">", "value": 5}}', False),
    ('{"confidence": {"operator": ">=", "value": 95}}', True),
    ('{"country": {"operator": "in", "value": ["CN", "RU"]}}', True),
    ('{"country": {"operator": "not_in", "value": ["CN"]}}', False),
    ('{"message": {"operator": "contains", "value": "login"}}', True),
    ('{"missing": {"operator": "==", "value": "x"}}', False),
    ('{"missing": {"operator": "!=", "value": "x"}}', True),
    ('{"confidence": {"operator": "in", "value": [95, 96]}}', True),
    ("not json", False),
])
def test_rule_conditions(spark, conditions, matches):
    event = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), "ml_prediction", "", "HIGH", "1.2.3.4", 0.95, 95, "CN", "Multiple failed login attempts")],
        "id bigint, timestamp timestamp_ntz, type string, detection_type string, severity string, ip string, ml_confidence double, confidence bigint, country string, message string")
    rule = spark.createDataFrame([(7, "r", "ml_prediction", conditions, None, "[1]", True, 0, None)],
                                 "id bigint, rule_name string, rule_type string, conditions string, severity_threshold string, channel_ids string, is_enabled boolean, cooldown_minutes int, subject_template string")
    assert (alerts.match_rules(event, rule).count() == 1) is matches


def test_message_templates(spark):
    df = spark.createDataFrame([("IP {{ ip }} {{severity}} {{nope}}!", "1.1.1.1", "HIGH", "t", "m"), (None, "2.2.2.2", "LOW", "scan", None)], "tpl string, ip string, severity string, type string, message string")
    assert values(df.select(alerts.render(F.col("tpl"), ["ip", "severity"]).alias("m")), "m") == ["IP 1.1.1.1 HIGH !", "Alert: scan - No details"]


def test_sample_block_decision(spark):
    row = spark.createDataFrame([("8.8.4.4", 95.5, 85.0, "high", 5, 2, 1), ("192.168.1.200", 95.5, 85.0, "high", 5, 2, 1), ("7.7.7.7", 95.5, 85.0, "high", 5, 0, 0)],
                                "ip_address string, ml_confidence double, threat_score double, severity string, event_count int, zeek_detections int, f2b_bans int")
    none = spark.createDataFrame([], "ip string")
    out = {r.ip_address: r for r in policy.auto_block_decision(row, none, none, fixed.POLICIES["default"]).collect()}
    assert out["8.8.4.4"].should_block and out["8.8.4.4"].reason == "Auto-bloqueado: ML=95.5%, ThreatScore=85.0, Severity=high, Events=5"
    assert not out["192.168.1.200"].should_block
    assert out["7.7.7.7"].reason == "Solo detectado por 1 fuente(s), se requieren 2+"
    off = policy.auto_block_decision(row, none, none, None)
    assert off.filter("should_block").count() == 0


def test_block_duration_of_zero_or_null_is_permanent(spark):
    snapshot = spark.createDataFrame([("a", "manual", "old", "low", False, datetime(2024, 1, 2), datetime(2024, 1, 1), 4)],
                                     "ip_address string, blocked_by string, reason string, threat_level string, is_permanent boolean, unblock_time timestamp_ntz, last_blocked timestamp_ntz, total_attacks bigint")
    at = datetime(2024, 2, 1)
    asks = spark.createDataFrame([(1, "a", "new", "high", 24, "auto", at), (2, "b", "x", "low", 0, "auto", at), (3, "c", "x", "low", None, "auto", at)],
                                 "id bigint, ip_address string, reason string, threat_level string, duration_hours int, blocked_by string, asked_at timestamp_ntz")
    out = {r.ip_address: r for r in policy.upsert_blocks(snapshot, asks).collect()}
    assert (out["a"].total_attacks, out["a"].unblock_time, out["a"].blocked_by, out["a"].reason) == (5, datetime(2024, 2, 2), "manual", "new")
    assert out["b"].is_permanent and out["c"].is_permanent and out["c"].unblock_time is None and out["c"].total_attacks == 1


def test_prediction_dates_default_on_insert_only(spark):
    schema = "ip_address string, ml_confidence double, threat_score double, total_events bigint, first_seen timestamp_ntz, last_seen timestamp_ntz, analyzed_at timestamp_ntz"
    old = spark.createDataFrame([("a", 0.5, 1.0, 1, datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3))], schema).withColumn("is_valid", F.lit(False))
    new = spark.createDataFrame([("a", 0.6, 1.0, 1, None, None, datetime(2024, 1, 4)), ("b", 0.59, 1.0, 1, None, None, datetime(2024, 1, 4))], schema)
    out = {r.ip_address: r for r in sinks.upsert_predictions(old, new, datetime(2024, 1, 31)).collect()}
    assert out["a"].first_seen is None and out["a"].is_valid and out["a"].is_suspicious
    assert out["b"].first_seen == datetime(2024, 1, 31) and not out["b"].is_suspicious


def test_geo_lookup_private_unknown_invalid_and_nested(spark):
    ranges = spark.createDataFrame([(16777216, 33554431, "Wide", "WW", "X"), (16843008, 16843263, "Inner", "IN", "Y")],
                                   "ip_from bigint, ip_to bigint, country_name string, country_code string, continent_name string")
    ips = spark.createDataFrame([("1.1.1.1",), ("1.2.3.4",), ("8.8.8.8",), ("192.168.1.1",), ("invalid",), ("1.1.1.1",)], "ip string")
    out = {r.ip: r.country_code for r in geo.geo_lookup(ips, ranges).collect()}
    assert out == {"1.1.1.1": "IN", "1.2.3.4": "WW", "8.8.8.8": "XX", "192.168.1.1": "LAN", "invalid": "XX"}


def test_geo_policy_off_allows_all(spark):
    allowed, _ = geo.country_allowed(F.lit("1.1.1.1"), F.lit("CN"), F.lit("China"), {"enabled": False})
    assert spark.range(1).select(allowed.alias("a")).first().a is True


def test_export_and_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    sinks.export(df, str(tmp_path / "csv"), "csv", ["y"])
    sinks.export(df, str(tmp_path / "json"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["y"]
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    out = {r.table_name: r.n for r in sinks.snapshot({"t": df, "u": df.union(df)}, str(tmp_path / "snap"), datetime(2024, 1, 1)).collect()}
    assert out == {"t": 1, "u": 2, "total": 3}


def test_windows_close_at_their_time(spark):
    rows = spark.sql("select * from values (1, timestamp_ntz'2024-01-30 23:00:00'), (2, timestamp_ntz'2024-01-31 00:00:00'), "
                     "(3, timestamp_ntz'2024-01-31 00:00:01'), (4, timestamp_ntz'2024-01-29 23:59:59') as t(id, timestamp)")
    assert {r.id for r in events.in_window(rows, datetime(2024, 1, 31), 24).collect()} == {1, 2}
    ips = rows.withColumn("source_ip", F.col("id").cast("string"))
    none = spark.sql("select true as is_permanent, false as is_resolved limit 0")
    report = events.security_dashboard(ips, none, none, none, datetime(2024, 1, 31)).first()
    assert report.attacks_today <= 2 and report.active_attackers == 1


def test_jail_passes_over_unknown_methods(spark):
    rows = spark.createDataFrame([("GET",), ("TRACE",), (None,), ("PATCH",)], "method string")
    assert {r.method for r in weblogs.counted_requests(rows).collect()} == {"GET", "PATCH"}


def test_rules_without_channels_still_trigger(spark):
    hits = spark.sql("select 1L as rule_id, 'a' as rule_name, timestamp_ntz'2024-01-01 00:00:00' as timestamp, '[1, 2, 9]' as channel_ids union all "
                     "select 1L, 'a', timestamp_ntz'2024-01-02 00:00:00', '[2]' union all select 2L, 'b', timestamp_ntz'2024-01-03 00:00:00', null")
    channels = spark.sql("select 1L as id, 'email' as channel_type, true as is_enabled, 2 as recipients union all select 2L, 'slack', true, 0")
    got = {r.rule_id: (r.total_triggers, r.total_alerts_sent, r.failed_sends) for r in alerts.trigger_counters(hits, channels).collect()}
    assert got == {1: (2, 1, 2), 2: (1, 0, 0)}
