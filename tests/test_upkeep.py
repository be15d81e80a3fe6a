"""Retention in place by day, and one-pass parsers and rollups on awkward rows."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logwarden.operators import network as net
from logwarden.sinks import tables as sk
from logwarden.sources import loglines as ll


def files(path: str) -> dict[str, tuple[int, int]]:
    """Name, inode and time of every data file below ``path``."""
    out = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.startswith("part-"):
                full = os.path.join(folder, n)
                out[full] = (os.stat(full).st_ino, os.stat(full).st_mtime_ns)
    return out


@pytest.mark.parametrize("hour, left", [(12, 12 + 24 * 3 + 1), (0, 24 * 4 + 1), (23, 1 + 24 * 3 + 1)])
def test_only_the_border_day_is_written_anew(spark, tmp_path, hour, left):
    path = str(tmp_path / "table")
    rows = spark.range(24 * 8).select("id", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int))").alias("at"))
    rows = rows.unionByName(spark.sql("select 9999L as id, cast(null as timestamp_ntz) as at"))
    sk.write_by_day(rows, "at", path)
    before = files(path)
    kept = sk.clean_up_days(spark, path, rows.schema, "at", datetime(2024, 1, 25, hour), 20)
    assert kept.columns == ["id", "at"]
    got = {r["id"] for r in kept.collect()}
    assert got == {r["id"] for r in rows.filter(f"at is null or at >= timestamp_ntz '2024-01-05 {hour:02}:00:00'").collect()} and len(got) == left
    after = files(path)
    later = {f for f in before if f"{sk.DAY}=2024-01-0" in f and f.split(f"{sk.DAY}=")[1][:10] > "2024-01-05" or "__HIVE" in f}
    assert later and all(after[f] == before[f] for f in later)
    assert not any(f"{sk.DAY}=2024-01-0{d}" in f for f in after for d in range(1, 5))
    again = sk.clean_up_days(spark, path, rows.schema, "at", datetime(2024, 1, 25, hour), 20)
    assert {r["id"] for r in again.collect()} == got


def test_a_border_day_without_kept_rows_goes(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.sql("select 1L as id, timestamp_ntz '2024-01-05 01:00:00' as at union all select 2L, timestamp_ntz '2024-01-06 01:00:00'")
    sk.write_by_day(rows, "at", path)
    assert [r["id"] for r in sk.clean_up_days(spark, path, rows.schema, "at", datetime(2024, 1, 25, 12), 20).collect()] == [2]
    assert not any("2024-01-05" in f for f in files(path))


def test_hourly_connections_of_nulls_and_ties(spark):
    rows = [(None, None, None, None)] + [("a", p, "x", "tcp") for p in (80, 80, 443, 443, 0)] + [("b", 22, None, "udp"), (None, 22, "y", "tcp")]
    conn = spark.createDataFrame(rows, "source_ip string, dest_port int, dest_ip string, protocol string").select(
        F.expr("timestamp_ntz '2024-01-30 05:10:00'").alias("timestamp"), "*", F.lit(2).cast("long").alias("orig_bytes"), F.lit(None).cast("long").alias("resp_bytes"))
    got = net.hourly_connections(conn, 2, 2).first()
    assert (got["total_connections"], got["tcp_connections"], got["udp_connections"]) == (8, 6, 1)
    assert (got["unique_source_ips"], got["unique_dest_ips"], got["port_scans_detected"]) == (2, 2, 1)
    assert (got["total_bytes_sent"], got["total_bytes_received"]) == (16, 0)
    assert got["top_services"] == "HTTP=2|HTTPS=2"


def test_lines_of_no_kind_are_counted(spark):
    lines = lambda *own: spark.createDataFrame([(x,) for x in own], "line string")
    web = '203.0.113.9 - - [30/Jan/2024:10:00:00 +0000] "GET {} HTTP/1.1" {} 5 "-" "Mozilla"'
    access = lines(web.format("/a", 200), web.format("/a", 404), web.format("/?q=<script>", 200), "", "  ", "junk")
    auth = lines("Jan 30 10:00:00 h sshd[1]: Failed password for root from 192.0.2.1 port 1 ssh2", "Jan 30 10:00:00 h sshd[1]: Invalid user bob from 192.0.2.1",
                 "Jan 30 10:00:00 h cron: Invalid user bob from 192.0.2.1", "sshd Failed password for", "")
    bans = lines("2024-01-30 10:00:00,1 x [sshd] Ban 192.0.2.1", "2024-01-30 10:00:00,1 x [sshd] Unban 192.0.2.1", "[sshd] Found 192.0.2.1", "] Ban ", "")
    got = {r["source"]: (r["total_lines"], r["created"], r["skipped"]) for r in ll.ingest_summary(access, auth, bans, 2024).collect()}
    assert got == {"nginx_access": (6, 2, 2), "ssh_auth": (5, 2, 0), "fail2ban": (5, 1, 2)}
    parsed = [(r["status"], r["user"], r["ip"]) for r in ll.parse_sshd(auth).collect()]
    assert sorted(parsed, key=str) == sorted([("failed", "root", "192.0.2.1"), ("invalid_user", "bob", "192.0.2.1"), ("failed", None, None)], key=str)
