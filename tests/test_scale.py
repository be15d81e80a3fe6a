"""Steps whose cost must not outgrow their input: what the plans move, and the same results as the plain form."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from logwarden.operators import intervals, weblogs as wl
from logwarden.plans import file_queries as fq
from logwarden.sources import monitor as mo


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_distinct_windows_build_no_sets(spark, monkeypatch):
    monkeypatch.setattr(intervals, "TASK_ROWS", 200)
    rng, start = np.random.default_rng(4), datetime(2024, 1, 30)
    rows = [(None if k % 50 == 0 else f"h{rng.integers(3)}", start + timedelta(seconds=int(rng.integers(0, 9000)) * (1 + k % 7)), None if k % 41 == 0 else int(rng.integers(12)))
            for k in range(3000)] + [("h0", None, 3), ("h1", datetime(1969, 12, 31, 23, 59, 30), 1), ("h1", datetime(1969, 12, 31, 23, 59, 50), 2)]
    conn = spark.createDataFrame(rows * 2, "ip string, timestamp timestamp_ntz, port int").repartition(5)
    for span, slide, least in (("600 seconds", "60 seconds", 2), ("60 seconds", "10 seconds", 1), ("1 hour", "1 hour", 6)):
        got = wl.window_counts(conn, "ip", span, slide, least, "port")
        want = conn.groupBy(F.window("timestamp", span, slide).alias("w"), "ip").agg(F.countDistinct("port").alias("n")).filter(F.col("n") >= least).select(
            "ip", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.dtypes == want.dtypes
        assert "collect_set" not in plan_of(got) and ", 31)" in plan_of(got)


def test_log_lines_do_not_move(spark, tables):
    both = fq.write_tsv(tables, tables.conn, fq.CONN_HEAD, fq.CONN_CELLS, "tsv").unionByName(fq.write_json(tables, tables.conn, fq.CONN_JSON, "json"))
    assert both.select("file").distinct().filter(~F.col("file").endswith(".gz")).count() == 0
    for rows in (mo.parse_auto(both, mo.FIELDS["conn"]), mo.parse_tsv(both, mo.FIELDS["conn"])):
        rows.collect()
        assert "Exchange hashpartitioning" not in plan_of(rows) and "BroadcastHashJoin" in plan_of(rows)


def test_many_headers_are_joined_not_sent_out(spark, tables):
    lines = fq.write_tsv(tables, tables.files, fq.FILES_HEAD, fq.FILES_CELLS, "files")
    sent, joined = mo.parse_auto(lines, mo.FIELDS["files"]), mo.parse_auto(lines, mo.FIELDS["files"], 0)
    assert sorted(map(str, sent.collect())) == sorted(map(str, joined.collect())) and sent.count() == tables.files.count()


def test_written_logs_have_bounded_files_each_with_its_header(spark, tables, monkeypatch):
    monkeypatch.setattr(fq, "FILE_LINES", 300)
    for lines, header in ((fq.write_tsv(tables, tables.ssl, fq.SSL_HEAD, fq.SSL_CELLS, "ssl"), 2), (fq.write_json(tables, tables.dns, fq.DNS_JSON, "dns"), 0)):
        files = lines.groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("line").startswith("#fields")).alias("fields")).collect()
        assert len(files) >= 4 and max(r.n for r in files) <= 300 + header and {r.fields for r in files} == {header // 2}
    ssl = fq.write_tsv(tables, tables.ssl, fq.SSL_HEAD, fq.SSL_CELLS, "ssl")
    assert mo.parse_auto(ssl, mo.FIELDS["ssl"]).select("uid").distinct().count() == tables.ssl.count() == ssl.filter(~F.col("line").startswith("#")).count()


def test_gaps_are_sorted_in_parts_that_follow_the_rows(spark, monkeypatch):
    rng, start = np.random.default_rng(9), datetime(2024, 1, 30)
    rows = [(f"h{rng.integers(5)}", start + timedelta(seconds=float(rng.integers(0, 90_000)) / 10)) for _ in range(4000)] + [(None, start), ("h0", None)]
    df = spark.createDataFrame(rows, "ip string, timestamp timestamp_ntz")
    plain = intervals.gap_moments(df, ["ip"], "timestamp")
    monkeypatch.setattr(intervals, "TASK_ROWS", 100)
    parted = intervals.gap_moments(df, ["ip"], "timestamp")
    assert "hashpartitioning(ip" in plan_of(parted) and ", 41)" in plan_of(parted) and ", 41)" not in plan_of(plain)
    for a, b in zip(plain.orderBy("ip").collect(), parted.orderBy("ip").collect(), strict=True):
        assert tuple(a)[:5] == tuple(b)[:5] and all(x == y or abs(x - y) < 1e-6 * abs(x) for x, y in zip(tuple(a)[5:], tuple(b)[5:]))


def test_lines_are_stripped_without_a_walk(spark):
    odd = ["", " ", "a", " a", "a ", "\ta b\r\n", "\x0b#x", "x\x0c", "\u00a0é\u00a0", "a\u2003", " # ", "\n\n", "- x -", None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(odd)], "id int, line string")
    got = rows.select("id", mo.stripped(F.col("line")).alias("a"), F.btrim("line", F.lit(" \t\n\r\x0b\x0c")).alias("b")).orderBy("id").collect()
    assert [r.a for r in got] == [r.b for r in got] == [None if x is None else x.strip(" \t\n\r\x0b\x0c") for x in odd]


def test_lines_are_copied_once_to_be_read(spark, tables):
    lines = fq.write_json(tables, tables.dns, fq.DNS_JSON, "dns")
    rows = mo.parse_auto(lines, mo.FIELDS["dns"])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
