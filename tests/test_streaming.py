"""Streaming jobs run to the end of their input, compared with their batch twins."""

import pickle
import time
import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from logwarden.operators import alerts, cooldown, weblogs as wl
from logwarden.operators.policy import active_ips, listed_ips
from logwarden.plans.views import AS_OF
from logwarden.plans.weblog_queries import jail_bans
from logwarden.sources import loglines as ll
from logwarden.streaming import ingest, jobs, keyed


def as_stream(spark, df, folder, files=3, order="timestamp"):
    """Write rows in time order as several files and read them as a stream, one file per batch."""
    rows = df.orderBy(order).toPandas()
    for i, part in enumerate(np.array_split(np.arange(len(rows)), files)):
        spark.createDataFrame(rows.iloc[part], df.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def closed(df, late, column="window_end"):
    """Windows a stream has finished: those ending before the last watermark."""
    return df.filter(F.col(column) <= F.lit(late))


def run_windows(spark, tmp_path, source, job, twin, key):
    stream = as_stream(spark, source, tmp_path / "in")
    jobs.run(job(stream), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out" / "data"))
    last = source.agg(F.max("timestamp")).first()[0] - timedelta(minutes=10)
    cols = [key, F.col("window_start").cast("timestamp_ntz"), F.col("window_end").cast("timestamp_ntz"), "n"]
    want = closed(twin.select(*cols), last)
    have = closed(got.select(*cols), last)
    assert rows(have) == rows(want)
    assert want.count() > 0


def test_ssh_brute_force(spark, tables, tmp_path):
    attempts = ll.login_attempts(tables.auth_lines, 2024).filter("kind = 'failed'").select("timestamp", "kind", "ip")
    twin = wl.window_counts(attempts, "ip", "600 seconds", "60 seconds", 2)
    run_windows(spark, tmp_path, attempts, lambda s: jobs.ssh_brute_force(s, 2), twin, "ip")


def test_http_flood(spark, tables, tmp_path):
    events = tables.security_events.select("timestamp", "protocol", "source_ip")
    twin = wl.window_counts(events.filter("protocol = 'http'"), "source_ip", "2 hours", "1 hour", 2)
    run_windows(spark, tmp_path, events, lambda s: jobs.http_flood(s, 2, "2 hours", "1 hour"), twin, "source_ip")


def test_port_scan(spark, tables, tmp_path):
    conn = tables.conn.select("timestamp", "source_ip", "dest_port")
    twin = wl.window_counts(conn, "source_ip", "600 seconds", "300 seconds", 3, "dest_port")
    run_windows(spark, tmp_path, conn, lambda s: jobs.port_scan(s, 3, "600 seconds", "300 seconds"), twin, "source_ip")


def test_block_gate(spark, tables, tmp_path):
    requests = tables.http_access.select("id", "timestamp", "ip", "path")
    blocks, white = active_ips(tables.blocked_ips, AS_OF), listed_ips(tables.ip_lists, "whitelist")
    jobs.run(jobs.denied_events(jobs.block_gate(as_stream(spark, requests, tmp_path / "in"), blocks, white)), str(tmp_path / "out"))
    want = wl.blocked_access(requests, blocks, white)
    assert rows(spark.read.parquet(str(tmp_path / "out" / "data")).select(*want.columns)) == rows(want)
    assert want.count() > 0


def closing(spark, folder, df):
    """A last file with one row two days on, by which the watermark passes all others."""
    end = df.agg(F.max("timestamp")).first()[0] + timedelta(days=2)
    row = {c: None for c in df.columns} | {"timestamp": end} | ({"kind": "failed"} if "kind" in df.columns else {})
    free = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    spark.createDataFrame([tuple(row.values())], free).coalesce(1).write.mode("append").parquet(str(folder))


def run_in_parts(spark, tmp_path, df, job, parts=3):
    """The stream of ``df`` run ``parts`` times, each time started anew, rows mixed up within ten minutes; then its closing row."""
    rows = df.orderBy((F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6 + F.rand(3) * 540)).toPandas()
    folder, out = tmp_path / "in", tmp_path / "out"
    for part in np.array_split(np.arange(len(rows)), 2 * parts):
        spark.createDataFrame(rows.iloc[part], df.schema).coalesce(1).write.mode("append").parquet(str(folder))
        if part[-1] % 2 or part[-1] == len(rows) - 1:
            if part[-1] == len(rows) - 1:
                closing(spark, folder, df)
            job(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder)), str(out))
    return out


def naive(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@pytest.mark.parametrize("failures", [2, 5])
def test_ssh_attempt_events_with_brute_force(spark, tables, tmp_path, failures):
    attempts = ll.login_attempts(tables.auth_lines, 2024).select("id", "timestamp", "kind", "ip")
    out = run_in_parts(spark, tmp_path, attempts, lambda s, o: jobs.run(jobs.ssh_attempt_events(s, failures), o))
    got = naive(spark.read.parquet(f"{out}/data"), "timestamp")
    known = attempts.filter("kind <> 'invalid'")
    ok = F.col("kind") == "accepted"
    want = known.select("id", "timestamp", F.col("ip").alias("source_ip"), F.when(ok, "ssh_successful_login").otherwise("ssh_failed_login").alias("event_type"),
                        F.when(ok, "low").otherwise("medium").alias("severity"))
    tripped = ll.failures_10m(known).filter(F.col("failures") >= failures).select(
        "id", "timestamp", F.col("ip").alias("source_ip"), F.lit("ssh_brute_force").alias("event_type"), F.lit("high").alias("severity"))
    assert rows(got.select(*want.columns)) == rows(want.unionByName(tripped))
    assert failures == 5 or tripped.count() > 0


def test_alert_cooldown_over_restarts_equals_one_batch(spark, tables, tmp_path):
    events = tables.alert_events
    out = run_in_parts(spark, tmp_path, events, lambda s, o: jobs.run(jobs.alert_cooldown(s, tables.alert_rules), o))
    want = alerts.triggered(events, tables.alert_rules)
    got = naive(spark.read.parquet(f"{out}/data"), "timestamp")
    columns = ["rule_id", "id", "timestamp", "severity", "ip", "confidence", "ml_confidence", "subject_template", "channel_ids"]
    assert rows(got.select(*columns)) == rows(want.select(*columns))
    assert want.count() > 0


def test_alert_delivery_log(spark, tables, tmp_path):
    events = tables.alert_events
    out = run_in_parts(spark, tmp_path, events, lambda s, o: jobs.alert_delivery(s, tables.alert_rules, tables.alert_channels, o), 2)
    want = alerts.deliveries(events, tables.alert_rules, tables.alert_channels)
    cols = ["rule_id", "channel_id", "event_id", "timestamp", "success", "error_message", "subject"]
    assert rows(spark.read.parquet(f"{out}/deliveries").select(*cols)) == rows(want.select(*cols))


@pytest.mark.parametrize("retry,find,ban", [(3, 3600, 86400), (100, 60, 3600), (2, 40_000, 600)])
def test_jail_stream_equals_batch_twin(spark, tables, tmp_path, retry, find, ban):
    requests = tables.http_access.select("timestamp", "ip")
    out = run_in_parts(spark, tmp_path, requests, lambda s, o: jobs.run(jobs.jail(s, retry, find, ban), o), 2)
    got = naive(spark.read.schema("ip string, action string, at timestamp, until timestamp").parquet(f"{out}/data"), "at", "until")
    want = jail_bans(requests, retry, find, ban)
    assert rows(got.filter("action = 'ban'").select("ip", "at", "until")) == rows(want)
    assert rows(got.filter("action = 'unban'").select("ip", "at")) == rows(want.select("ip", "banned_until"))
    assert want.count() > 0 or retry == 100


def in_turn(operator, data, cuts, known):
    """Feed an operator in parts, as a state store would."""
    memory, found = [], []
    for start, end in zip([0, *cuts], [*cuts, len(data)]):
        part = [(us, 0, arg, "r") for us, arg in data[start:end]]
        done = operator(part, memory, part[-1][0] if part else 0)
        found.extend(done.found)
        memory = done.memory
    return found + operator([], memory, known).found


@pytest.mark.parametrize("seed", range(6))
def test_operators_on_keyed_state_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    times = sorted(rng.integers(0, 4000, 400).tolist())
    steps = sorted({int(np.searchsorted(times, times[c], "right")) for c in rng.integers(0, 400, 7)})  # a time is in one part
    fired = [us for kind, us, *_ in in_turn(keyed.cooldown, [(t, 37) for t in times], steps, 10_000)]
    assert fired == greedy(times, 37)
    tripped = [t for t in times if sum(t - 60 < x <= t for x in times) >= 9]
    found = in_turn(keyed.jail(9, 60, 150), [(t, 0) for t in times], steps, 10_000)
    bans = greedy(tripped, 150)
    assert [(us, until) for kind, us, until, _ in found if kind == "ban"] == [(t, t + 150) for t in bans]
    assert [us for kind, us, *_ in found if kind == "unban"] == [t + 150 for t in bans]
    failed = [(t, int(rng.random() < 0.6)) for t in times]
    found = in_turn(keyed.attempts(4, 50), failed, steps, 10_000)
    assert sum(kind == "login" for kind, *_ in found) == 400
    want = [t for t, f in failed if f and sum(g and t - 50 < x <= t for x, g in failed) >= 4]
    assert [us for kind, us, *_ in found if kind == "brute"] == want and bans and want


class State:
    """A group's state as Spark keeps it between micro-batches."""

    def __init__(self):
        self.get, self.exists, self.known, self.timeout = None, False, 0, None

    def getCurrentWatermarkMs(self):
        return self.known

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutTimestamp(self, ms):
        self.timeout = ms

    def remove(self):
        self.get, self.exists = None, False


def hits(rng, n):
    row = '{"rule_id":3,"id":%d,"type":"fail2ban_ban","message_template":"' + "{{ ip }} {{severity}} " * 40 + '"}'
    us = rng.integers(1, 10**9, n)
    return pd.DataFrame({"key": "3", "us": us, "tie": np.arange(n) // 2, "arg": 10**6, "row": [row % i for i in range(n)]})


def test_a_hot_key_is_held_packed():
    rng, state, n = np.random.default_rng(1), State(), 30_000
    parts = [p for p in np.array_split(np.arange(n), 30)]
    sent = hits(rng, n)
    size = sent["row"].str.len().sum()
    tracemalloc.start()
    assert list(keyed.take("3", (sent.iloc[p].copy() for p in parts), state, keyed.cooldown)) == []
    first = tracemalloc.get_traced_memory()[1]
    assert len(pickle.dumps(state.get)) < size / 8 and state.timeout >= 1
    state.known = 10**7
    tracemalloc.reset_peak()
    got = pd.concat(keyed.take("3", iter(()), state, keyed.cooldown))
    second = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(first, second) < size / 2 and not state.exists
    want, ready = [], 0
    for us, _, row in sorted(zip(sent["us"], sent["tie"], sent["row"])):
        if us >= ready:
            want.append((us, row))
            ready = us + 10**6
    assert sorted(zip(got["us"], got["row"])) == want and len(want) > 500


def test_rows_that_stand_alone_are_spread(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 3 == 1).alias("alone"))
    sizes = {r.key: r["count"] for r in rows.groupBy(keyed.apart(F.col("k"), F.col("alone"), "id").alias("key")).count().collect()}
    assert sizes.pop("0") == sizes.pop("2") == 1000 and sum(sizes.values()) == 1000
    assert len(sizes) > 32 and max(sizes.values()) < 60


@pytest.mark.parametrize("seed", range(3))
def test_packed_rows_keep_their_order_and_text(seed, monkeypatch):
    monkeypatch.setattr(keyed, "PACK", 4)
    rng, state = np.random.default_rng(seed), State()
    seen, sent = [], []

    def operator(due, memory, known):
        handles = [r[3] for r in due]
        assert [r[:3] for r in due] == [due[i][:3] for i in range(len(due))] and handles == [r[3] for r in due[0:len(due)]]
        seen.extend(r[:3] for r in due)
        return keyed.Outcome([("x", r[0], i, r[3]) for i, r in enumerate(due)] + [("y", known, 0, "")], [1], known + 7)

    got = []
    for batch in range(6):
        state.known = batch * 20
        n = int(rng.integers(0, 40))
        part = pd.DataFrame({"us": rng.integers(batch * 20_000 + 1, batch * 20_000 + 70_000, n) // 5000 * 5000 + 1, "tie": rng.integers(0, 3, n), "arg": 0,
                             "row": [f"{batch}-{i}é" for i in rng.permutation(n)]})
        part.loc[part.index[:1], "us"] = keyed.NONE  # a row without a time never goes out
        sent += [tuple(r) for r in part[["us", "tie", "arg", "row"]].to_numpy()[1:]]
        out = pd.concat([pd.DataFrame(columns=keyed.FOUND_COLUMNS), *keyed.take("k", iter([part]), state, operator)])
        got += [(r.us, r.row) for r in out[out["kind"] == "x"].sort_values("until").itertuples()]
    assert state.exists and len(keyed.Held(*state.get[:3]).numbers) == sum(state.get[1])
    due = sorted(r for r in sent if r[0] <= state.known * 1000)
    assert sorted(got) == sorted((us, row) for us, _, _, row in due) and len(due) > 20
    first = [r for r in due if r[0] <= 20_000]
    assert got[:len(first)] == [(us, row) for us, _, _, row in first]


def test_idle_keys_leave_the_state():
    assert keyed.cooldown([(5, 0, 10, "a")], [], 20).memory == []
    assert keyed.cooldown([(5, 0, 10, "a")], [], 12) == keyed.Outcome([("fired", 5, 15, "a")], [15], 15, 15)
    assert keyed.jail(2, 10, 30)([(5, 0, 0, "a"), (6, 0, 0, "b")], [], 40).memory == []
    assert keyed.jail(2, 10, 30)([(5, 0, 0, "a")], [], 6) == keyed.Outcome([], [0, 5], 15)
    assert keyed.attempts(2, 10)([(5, 0, 1, "a")], [], 15).memory == []


def greedy(times, cooldown_us):
    fired, ready = [], None
    for t in sorted(set(times)):
        if ready is None or t >= ready:
            fired.append(t)
            ready = t + cooldown_us
    return fired


@pytest.mark.parametrize("seed,spread,cooldown_us", [(1, 10_000, 50), (2, 500_000, 700), (3, 3_000, 1), (4, 10**7, 10**6), (5, 200_000, 100)])
@pytest.mark.parametrize("fan", [64, 2])
def test_cooldown_against_brute_force(spark, monkeypatch, seed, spread, cooldown_us, fan):
    monkeypatch.setattr(cooldown, "FAN", fan)
    rng = np.random.default_rng(seed)
    data = [(k, int(t), cooldown_us) for k in ("a", "b") for t in rng.integers(0, spread, 1500)]
    df = spark.createDataFrame(data, "key string, us bigint, cd bigint").repartition(3)
    got = {k: [] for k in ("a", "b")}
    for r in cooldown.fire_times(df).collect():
        got[r.key].append(r.us)
    for k in got:
        assert sorted(got[k]) == greedy([t for kk, t, _ in data if kk == k], cooldown_us)


def test_late_rows_are_counted(spark, tmp_path):
    listener = jobs.LateRows()
    spark.streams.addListener(listener)
    try:
        base = datetime(2024, 1, 1)
        schema = "timestamp timestamp_ntz, kind string, ip string"
        for i, at in enumerate([base, base + timedelta(hours=3), base + timedelta(hours=4), base]):
            spark.createDataFrame([(at, "failed", "x")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.run(jobs.ssh_brute_force(stream, 1), str(tmp_path / "out"))
        import time

        for _ in range(50):
            if listener.dropped:
                break
            time.sleep(0.1)
        assert listener.dropped > 0
    finally:
        spark.streams.removeListener(listener)


def monitor_lines(spark, name, stamps):
    """Lines of one JSON file: a connection per uid and stamp."""
    made = [("conn", '{"ts": %d, "uid": %s, "id.orig_h": "10.0.0.1", "conn_state": "%s"}' % (ts, f'"{uid}"' if uid else "null", state), name) for uid, ts, state in stamps]
    return spark.createDataFrame(made, "log string, line string, file string")


def test_ingest_stores_each_key_once_and_a_repeated_batch_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "FOLD", 2)
    out, as_of = str(tmp_path / "out"), F.lit(AS_OF)

    def stored():
        return sorted((r["n"], str(r["uid"]), r["conn_state"]) for r in spark.read.parquet(f"{out}/conn").collect())

    batches = [[("a", 50, "later"), ("a", 10, "first"), ("b", 20, "x"), (None, 5, "y"), (None, 5, "y")], [("a", 900_000, "late"), ("c", 30, "z")],
               [("b", 1, "old"), ("d", 2, "w"), ("c", 3, "v")], [("a", 4, "u"), ("d", 5, "t"), ("e", 6, "s")]]
    for n, batch in enumerate(batches):
        ingest.store_batch(monitor_lines(spark, f"f{n}", batch), n, ["conn"], out, as_of)
    want = [(0, "None", "y"), (0, "None", "y"), (0, "a", "first"), (0, "b", "x"), (1, "c", "z"), (2, "d", "w"), (3, "e", "s")]
    assert stored() == want
    for n in (3, 1, 0):  # as after a failure between writing and the checkpoint
        ingest.store_batch(monitor_lines(spark, f"f{n}", batches[n]), n, ["conn"], out, as_of)
    assert stored() == want
    assert ingest.folders(spark, f"{out}/keys/conn", "upto") == [1]


def test_empty_batch_and_no_history(spark, tmp_path):
    out = str(tmp_path / "out")
    ingest.store_batch(monitor_lines(spark, "f", [("a", 1, "x")]).limit(0), 0, ["conn", "notice"], out, F.lit(AS_OF))
    assert spark.read.parquet(f"{out}/conn").count() == 0 == spark.read.parquet(f"{out}/notice").count()


def test_unseen_rows_are_read_once_and_meet_stored_keys_in_one_shuffle(spark):
    rows = spark.createDataFrame(
        [("a", 5, "x"), ("a", 5, "w"), ("a", 9, None), ("b", None, "y"), ("b", 1, "z"), (None, 1, "q"), (None, 1, "q"), ("c", 2, "v"), ("d", 3, "u")] * 3,
        "uid string, timestamp long, conn_state string").repartition(4)
    for stored, gone in ((None, ""), (spark.createDataFrame([("c",), ("c",), ("e",)], "uid string"), "c")):
        got = ingest.unseen(rows, stored, "uid")
        want = [r for r in [(None, 1, "q")] * 6 + [("a", 5, "w"), ("b", None, "y"), ("c", 2, "v"), ("d", 3, "u")] if r[0] != gone]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and got.columns == rows.columns
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate [_group") == 1 and "LeftAnti" not in plan and plan.count("RepartitionByExpression") + plan.count("Repartition 4") <= (1 if stored is None else 2)


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (blocks.apply(i) for i in range(blocks.size())) if f.getName().startswith("shuffle_")}


def test_ingest_goes_in_rounds_that_leave_the_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "ROUND_ROWS", 30)
    out, as_of, rng, held = str(tmp_path / "out"), F.lit(AS_OF), np.random.default_rng(3), []
    plain = ingest.unseen

    def watched(rows, stored, key):
        staged = sum(f.stat().st_size for f in (tmp_path / "out" / "staged").rglob("*.parquet"))
        held.append((rows.count(), None if stored is None else stored.count(), staged))
        return plain(rows, stored, key)

    monkeypatch.setattr(ingest, "unseen", watched)
    earlier, want, settings = set(), [], {k: spark.conf.get(k, None) for k in ingest.SETTINGS}
    for n in range(2):
        batch = [(None if k % 9 == 0 else f"u{rng.integers(150)}", int(rng.integers(1, 50)), f"s{rng.integers(3)}") for k in range(300)]
        first = {}
        for uid, ts, state in batch:
            if uid is None:
                want.append((n, "None", ts, state))
            elif uid not in earlier:
                first[uid] = min(first.get(uid, (ts, state)), (ts, state))
        want += [(n, uid, *row) for uid, row in first.items()]
        earlier |= set(first)
        before, held[:] = shuffle_files(spark), []
        for _ in range(2):  # the second time as after a failure
            ingest.store_batch(monitor_lines(spark, f"f{n}", batch).repartition(3), n, ["conn"], out, as_of)
        once = held[: len(held) // 2]
        assert len(once) > 3 and sum(r for r, _, _ in once) == 300 and max(r for r, _, _ in once) < 100
        assert [s for _, _, s in once] == sorted((s for _, _, s in once), reverse=True) and once[-1][2] < once[0][2] / 3
        assert not n or sum(s for _, s, _ in once) == len({r[1] for r in want if r[0] == 0} - {"None"})
        for _ in range(50):
            if not (left := shuffle_files(spark) - before):
                break
            time.sleep(0.1)
        assert not left
    got = spark.read.parquet(f"{out}/conn").select("n", "uid", F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("ts"), "conn_state").collect()
    assert sorted((r.n, str(r.uid), r.ts, r.conn_state) for r in got) == sorted(want)
    assert not (tmp_path / "out" / "keys").exists() and not ingest.folders(spark, f"{out}/staged/conn", "n")
    assert {k: spark.conf.get(k, None) for k in ingest.SETTINGS} == settings


def test_rounds_hold_all_slices_once():
    assert ingest.rounds({}, 5) == [[]]
    assert ingest.rounds({3: 4, 0: 2, 1: 3, 7: 9, 8: 1}, 5) == [[0, 1], [3], [7], [8]]


def test_polled_kinds_read_their_own_files_once_and_cache_nothing(spark, tmp_path, monkeypatch):
    base, out, seen = tmp_path / "in", str(tmp_path / "out"), []
    line = '{"ts": %d, "uid": "%s", "id.orig_h": "10.0.0.1", "conn_state": "S0", "rcode_name": "NOERROR"}\n'
    for kind in ("conn", "dns"):
        (base / kind).mkdir(parents=True)
        (base / kind / "a.log").write_text("".join(line % (k, f"{kind}{k}") for k in range(20)))
    store = ingest.store_batch

    def watched(batch, n, kinds, *rest):
        seen.append((tuple(kinds), n, batch.count()))
        before = spark.sparkContext._jsc.getPersistentRDDs().size()
        monkeypatch.setattr(type(batch), "persist", lambda *_: 1 / 0)
        store(batch, n, kinds, *rest)
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == before

    monkeypatch.setattr(ingest, "store_batch", watched)
    for more in (0, 1):
        jobs.poll_logs(spark, {k: f"{base}/{k}/*" for k in ("conn", "dns")}, out, F.lit(AS_OF))
        (base / "conn" / "b.log").write_text("#separator \\x09\n#fields\tts\tuid\n90.5\tconn3\n91.5\tnew\n")
    assert sorted(seen) == [(("conn",), 0, 20), (("conn",), 1, 4), (("dns",), 0, 20)]
    assert sorted(r["uid"] for r in spark.read.parquet(f"{out}/conn").collect()) == sorted([*(f"conn{k}" for k in range(20)), "new"])
    assert spark.read.parquet(f"{out}/dns").count() == 20
    assert not ingest.folders(spark, f"{out}/staged/conn", "n")
    (tmp_path / "out" / "checkpoint" / "offsets").mkdir()
    with pytest.raises(ValueError, match="one checkpoint for all kinds"):
        jobs.poll_logs(spark, {"conn": f"{base}/conn/*"}, out, F.lit(AS_OF))


def test_ban_ledger_logs_nothing_twice(spark, tables, tmp_path):
    out = str(tmp_path / "out")
    rules = tables.alert_rules.filter("rule_type = 'fail2ban_ban'").withColumn("cooldown_minutes", F.lit(60))
    stamp = "2024-01-30 {}:00:00,123 fail2ban.actions [1]: NOTICE [sshd] Ban 203.0.0.{}"
    batches = [[(10, 1), (10, 2), (11, 3)], [(11, 4), (12, 5)], [(12, 6), (14, 7)]]

    def run(n):
        lines = spark.createDataFrame([(k, stamp.format(hour, host)) for k, (hour, host) in enumerate(batches[n])], "id long, line string")
        wl.ban_alerts(ll.parse_bans(lines)).write.mode("overwrite").parquet(f"{out}/data/n={n}")
        jobs.fire_bans(spark, out, n, rules, tables.alert_channels)

    def logged():
        return rows(spark.read.parquet(f"{out}/deliveries").select("n", "rule_id", "channel_id", "timestamp", "ip", "message", "event_metadata"))

    for n in range(3):
        run(n)
    want = logged()
    assert sorted({(r[0], r[3][11:13]) for r in want}) == [("0", "10"), ("0", "11"), ("1", "12"), ("2", "14")]
    for n in (2, 1):  # as after a failure
        run(n)
    assert logged() == want
