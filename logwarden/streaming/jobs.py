"""Structured Streaming jobs.

Every job is a function from a streaming DataFrame to a streaming DataFrame, or
runs a query into a folder with its own checkpoint. Rows later than
``LATE`` are dropped; :class:`LateRows` counts them. Folders passed in must lie
on storage that all executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.times import micros
from ..operators import alerts as al, weblogs as wl
from ..operators.cooldown import with_cooldown
from ..sources import loglines as ll
from . import ingest, keyed

LATE = "10 minutes"


class LateRows(StreamingQueryListener):
    """Counts rows dropped for being later than the watermark."""

    def __init__(self) -> None:
        self.dropped = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.dropped += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watermarked(rows: DataFrame, ts: str = "timestamp", late: str = LATE) -> DataFrame:
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def run(df: DataFrame, out: str, mode: str = "append", once: bool = True, every: str = "5 minutes") -> None:
    """Write a stream as parquet under ``out``/data, its checkpoint beside it."""
    writer = df.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/data").option(
        "checkpointLocation", f"{out}/checkpoint"
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    writer.start().awaitTermination()


def start_batches(df: DataFrame, checkpoint: str, fn: Callable[[DataFrame, int], None], once: bool, every: str) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def run_batches(df: DataFrame, out: str, fn: Callable[[DataFrame, int], None], once: bool = True, every: str = "5 minutes") -> None:
    start_batches(df, f"{out}/checkpoint", fn, once, every).awaitTermination()


def await_all(queries: list[StreamingQuery]) -> None:
    """Wait until all have ended; if one fails, the others are stopped."""
    try:
        left = queries
        while left:
            left = [q for q in left if not q.awaitTermination(0.2)]
    finally:
        for q in queries:
            q.stop()


# ---------------------------------------------------------------- windows over requests and attempts


def ssh_brute_force(attempts: DataFrame, failures: int = 5) -> DataFrame:
    """Five failed logins of an address in ten minutes, sliding by a minute."""
    return wl.window_counts(watermarked(attempts.filter("kind = 'failed'")), "ip", "600 seconds", "60 seconds", failures)


def http_flood(events: DataFrame, requests: int = 100, span: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    rows = events.filter(F.col("protocol").isin("http", "https"))
    return wl.window_counts(watermarked(rows), "source_ip", span, slide, requests)


def port_scan(conn: DataFrame, ports: int = 10, span: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    rows = conn.filter(F.col("dest_port").isNotNull())
    return wl.window_counts(watermarked(rows), "source_ip", span, slide, ports, "dest_port")


def jail(requests: DataFrame, retry: int, find: int, ban: int, late: str = LATE) -> DataFrame:
    """Bans of a jail: ip, action, at and until.

    ``retry`` requests of an address within ``find`` seconds start a ban of ``ban`` seconds at the request that trips, one ban at a time;
    a second row says when it is over. Rows go out once the watermark has passed their time.
    """
    found = keyed.in_order(
        watermarked(requests.select("ip", "timestamp"), late=late), F.col("ip"), "timestamp", keyed.jail(retry, find * 1_000_000, ban * 1_000_000), carried=["ip"])
    return found.select(F.col("key").alias("ip"), F.col("kind").alias("action"), F.timestamp_micros("us").alias("at"), F.timestamp_micros("until").alias("until"))


def rate_jail(requests: DataFrame, retry: int = 50, find: int = 60, ban: int = 3600, late: str = LATE) -> DataFrame:
    """Bans of addresses with many requests; methods unknown to the jail's filter do not count."""
    return jail(wl.counted_requests(requests), retry, find, ban, late)


def bot_jail(requests: DataFrame, retry: int = 50, find: int = 300, ban: int = 7200, late: str = LATE) -> DataFrame:
    return jail(wl.jail_hits(requests), retry, find, ban, late)


def block_gate(requests: DataFrame, active_blocks: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Stream-static lookups: deny blocked addresses that are not whitelisted."""
    out = requests.join(whitelist.withColumn("_w", F.lit(True)), "ip", "left").join(active_blocks.withColumn("_b", F.lit(True)), "ip", "left")
    return out.withColumn("verdict", F.when(F.col("_w").isNull() & F.col("_b").isNotNull(), "deny").otherwise("allow")).drop("_w", "_b")


def denied_events(gated: DataFrame) -> DataFrame:
    return gated.filter("verdict = 'deny'").select(
        "id", "timestamp", F.lit("blocked_access_attempt").alias("event_type"), F.lit("medium").alias("severity"),
        F.col("ip").alias("source_ip"), F.lit("blocked_ip").alias("attack_vector"), F.col("path").alias("request_path"),
    )


def ssh_attempt_events(attempts: DataFrame, failures: int = 5, span: int = 600, late: str = LATE) -> DataFrame:
    """A login event per attempt, and a brute-force event for each failed one that makes ``failures`` within ``span`` seconds."""
    rows = watermarked(attempts.filter("kind <> 'invalid'"), late=late)
    kept = [c for c in ("id", "kind") if c in rows.columns]
    found = keyed.in_order(
        rows, F.col("ip"), "timestamp", keyed.attempts(failures, span * 1_000_000), arg=(F.col("kind") == "failed").cast("bigint"), carried=kept)
    brute, ok = F.col("found") == "brute", F.col("kind") == "accepted"
    return keyed.opened(found.select("key", "us", F.col("kind").alias("found"), "row"), [rows.schema[c] for c in kept]).select(
        *[c for c in kept if c != "kind"], F.timestamp_micros("us").alias("timestamp"), F.col("key").alias("source_ip"),
        F.when(brute, "ssh_brute_force").when(ok, "ssh_successful_login").otherwise("ssh_failed_login").alias("event_type"),
        F.when(brute, "high").when(ok, "low").otherwise("medium").alias("severity"),
    )


# ---------------------------------------------------------------- alerts, with a cool-down per rule


def alert_cooldown(events: DataFrame, rules: DataFrame, late: str = LATE) -> DataFrame:
    """Rule hits of a stream thinned by each rule's cool-down, with all columns of a hit. Hits without a cool-down all go out and need no order."""
    hits = al.match_rules(watermarked(events, late=late), rules).filter(al.threshold_met(F.col("severity"), F.col("severity_threshold")))
    minutes = F.coalesce("cooldown_minutes", F.lit(0)).cast("bigint") * 60_000_000
    key = keyed.apart(F.col("rule_id"), minutes <= 0, "id")
    fields = [f for f in hits.schema.fields if f.name != "timestamp"]
    found = keyed.in_order(hits, key, "timestamp", keyed.cooldown, tie=F.col("id"), arg=minutes, carried=[f.name for f in fields])
    return keyed.opened(found.select(F.timestamp_micros("us").alias("timestamp"), "row"), fields).select(*[f"`{f.name}`" for f in fields], "timestamp")


def alert_delivery(events: DataFrame, rules: DataFrame, channels: DataFrame, out: str, late: str = LATE, once: bool = True) -> None:
    """Rules, cool-down, threshold, channels and delivery log per micro-batch. Nothing is sent.

    Batch ``n`` writes ``out``/deliveries/n=``n`` anew, so a repeated batch logs nothing twice.
    """

    def each(batch: DataFrame, n: int) -> None:
        fired = batch.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
        al.log_deliveries(fired, channels).write.mode("overwrite").parquet(f"{out}/deliveries/n={n}")

    run_batches(alert_cooldown(events, rules, late), out, each, once)


# ---------------------------------------------------------------- ingest


def poll_logs(spark: SparkSession, paths: dict[str, str], out: str, as_of: Column, once: bool = True, every: str = "5 minutes") -> None:
    """New monitor log files, TSV or JSON, to one table per log kind (``paths``: kind to folder) under ``out``.

    The checkpoints remember the files, so lines of any age are read once; where a kind has a key (``ingest.KEYS``), rows whose key
    is stored already are dropped, however long ago that was, as are repeats within the batch. Each kind is a stream of its own, so that a
    kind's batch reads the files of that kind alone; one checkpoint for all kinds, the form before, cannot be continued. See :mod:`.ingest`.
    """
    if ingest.exists(spark, f"{out}/checkpoint/offsets"):
        raise ValueError(f"{out}/checkpoint is one checkpoint for all kinds; begin in a new folder")

    def start(kind: str, path: str) -> StreamingQuery:
        lines = spark.readStream.format("text").load(path).select(F.lit(kind).alias("log"), F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
        return start_batches(lines, f"{out}/checkpoint/{kind}", lambda batch, n: ingest.store_batch(batch, n, [kind], out, as_of), once, every)

    await_all([start(kind, path) for kind, path in paths.items()])


def ban_monitor(spark: SparkSession, path: str, out: str, rules: DataFrame | None = None, channels: DataFrame | None = None, once: bool = True) -> None:
    """One alert per newly banned address and run, and with ``rules`` its way through rules, cool-down, channels and delivery log.

    The ledger under ``out``/fired has a row per batch, rule, address and time that fired. Batch ``n`` looks at batches before ``n`` alone,
    for the last fire of each rule, and writes its own alerts, ledger and deliveries anew, so a repeated batch logs nothing twice.
    """
    schema = spark.read.parquet(path).schema
    lines = spark.readStream.schema(schema).parquet(path)

    def each(batch: DataFrame, n: int) -> None:
        wl.ban_alerts(ll.parse_bans(batch)).write.mode("overwrite").parquet(f"{out}/data/n={n}")
        if rules is not None:
            fire_bans(spark, out, n, rules, channels)

    run_batches(lines, out, each, once)


def fire_bans(spark: SparkSession, out: str, n: int, rules: DataFrame, channels: DataFrame) -> None:
    """The alerts of batch ``n`` through the rules; see :func:`ban_monitor`."""
    events = al.ban_events(spark.read.parquet(f"{out}/data/n={n}"))
    hits = al.match_rules(events, rules).filter(al.threshold_met(F.col("severity"), F.col("severity_threshold")))
    hits = hits.withColumn("_us", micros("timestamp")).withColumn("_cd", F.col("cooldown_minutes").cast("bigint") * 60_000_000)
    earlier = [m for m in ingest.folders(spark, f"{out}/fired", "n") if m < n]
    if earlier:
        ledger = spark.read.schema("rule_id bigint, ip string, us bigint").parquet(*[f"{out}/fired/n={m}" for m in earlier])
        last = ledger.groupBy("rule_id").agg(F.max("us").alias("_last"))  # a row per rule
        hits = hits.join(last, "rule_id", "left").filter(
            F.col("_last").isNull() | (F.col("_cd") <= 0) | (F.col("_us") >= F.col("_last") + F.col("_cd"))).drop("_last")
    fired = with_cooldown(hits, "rule_id", "_us", "_cd", "id")
    fired.select("rule_id", "ip", F.col("_us").alias("us"), *[c for c in fired.columns if c not in ("rule_id", "ip", "_us", "_cd")]).write.mode(
        "overwrite").parquet(f"{out}/fired/n={n}")
    done = spark.read.parquet(f"{out}/fired/n={n}")
    al.log_deliveries(done, channels).withColumn("ip", F.get_json_object("event_metadata", "$.ip")).write.mode("overwrite").parquet(f"{out}/deliveries/n={n}")
