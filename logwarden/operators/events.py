"""Reports and lookups over the security-event fact table.

Expected columns: id, timestamp, source_ip, event_type, severity, and where a
report needs them country_code, attack_vector, protocol.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import rounded
from ..functions import fixed, text
from ..functions.times import before, micros, ts_lit
from .intervals import latest_per_key


def newest(ts: str = "timestamp", tie: str = "id") -> list[Column]:
    return [F.col(ts).desc(), F.col(tie).desc()]


def in_window(df: DataFrame, as_of: datetime, hours: float, ts: str = "timestamp") -> DataFrame:
    """Rows of the ``hours`` up to ``as_of``; what came later is not seen."""
    return df.filter((F.col(ts) >= before(as_of, hours=hours)) & (F.col(ts) <= ts_lit(as_of)))


# ---------------------------------------------------------------- lookups


def recent_events(events: DataFrame, as_of: datetime, hours: float = 24, limit: int = 100) -> DataFrame:
    return in_window(events, as_of, hours).orderBy(*newest()).limit(limit)


def events_by_ip(events: DataFrame, ip: str, limit: int = 50) -> DataFrame:
    return events.filter(F.col("source_ip") == ip).orderBy(*newest()).limit(limit)


def events_by_type(events: DataFrame, event_type: str, as_of: datetime, hours: float = 24) -> DataFrame:
    return in_window(events, as_of, hours).filter(F.col("event_type") == event_type).orderBy(*newest())


def events_filtered(
    events: DataFrame, severity: str | None = None, event_type: str | None = None, limit: int = 100
) -> DataFrame:
    for column, value in (("severity", severity), ("event_type", event_type)):
        if value is not None:
            events = events.filter(F.col(column) == value)
    return events.orderBy(*newest()).limit(limit)


def event_by_id(events: DataFrame, event_id: int) -> DataFrame:
    return events.filter(F.col("id") == event_id)


# ---------------------------------------------------------------- one-row reports


def one_row(*parts: DataFrame) -> DataFrame:
    """Put single-row aggregates side by side without a cross join."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def severity_counts(prefix: str = "") -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(prefix + s) for s in reversed(fixed.SEVERITIES)]


def active_block(as_of: datetime, null_expiry_active: bool = True) -> Column:
    open_ended = F.col("unblock_time").isNull() if null_expiry_active else F.lit(False)
    return F.col("is_permanent") | open_ended | F.coalesce(F.col("unblock_time") > ts_lit(as_of), F.lit(False))


def security_dashboard(events, blocked, threats, alerts, as_of: datetime) -> DataFrame:
    return one_row(
        events.filter((F.col("timestamp") > before(as_of, hours=24)) & (F.col("timestamp") <= ts_lit(as_of))).agg(F.count("*").alias("attacks_today")),
        blocked.agg(
            F.count_if(~F.col("is_permanent")).alias("temp_blocked_ips"),
            F.count_if(F.col("is_permanent")).alias("perm_blocked_ips"),
        ),
        threats.agg(F.count_if(~F.col("is_resolved")).alias("active_threats")),
        alerts.agg(F.count_if(~F.col("is_resolved")).alias("pending_alerts")),
        events.filter((F.col("timestamp") > before(as_of, hours=1)) & (F.col("timestamp") <= ts_lit(as_of))).agg(
            F.countDistinct("source_ip").alias("active_attackers")
        ),
    )


def dashboard_stats(events, blocked, threats, alerts, as_of: datetime) -> DataFrame:
    return one_row(
        in_window(events, as_of, 24).agg(
            F.count("*").alias("total_events_24h"),
            F.count_if(F.col("severity") == "critical").alias("critical_events_24h"),
        ),
        blocked.agg(F.count_if(active_block(as_of, null_expiry_active=False)).alias("total_blocked_ips")),
        threats.agg(F.count_if(~F.col("is_resolved")).alias("active_threats")),
        alerts.agg(F.count_if(~F.col("is_resolved")).alias("pending_alerts")),
    )


def attack_totals(events: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    return in_window(events, as_of, hours).agg(
        F.count("*").alias("total_events"), F.countDistinct("source_ip").alias("unique_ips")
    )


def attacks_by_type(events: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    return in_window(events, as_of, hours).groupBy("event_type").agg(F.count("*").alias("count"))


def attacks_by_severity(events: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    return in_window(events, as_of, hours).agg(*severity_counts())


def attacks_by_country(events: DataFrame, as_of: datetime, hours: float = 24, geo: str = "geo_location") -> DataFrame:
    country = F.get_json_object(geo, "$.country")
    return (
        in_window(events, as_of, hours)
        .withColumn("country", country)
        .filter(F.col("country").isNotNull() & ~F.col("country").isin("", "Unknown", "unknown"))
        .groupBy("country")
        .agg(F.count("*").alias("count"))
    )


def hourly_severity(events: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Equal bins counted from the window start; empty bins are kept."""
    bins = min(hours, 24)
    width_us = (hours * 60 // bins) * 60_000_000
    start = before(as_of, hours=hours)
    bin_no = F.floor((micros(F.col("timestamp")) - micros(start)) / width_us).cast("int")
    counts = (
        in_window(events, as_of, hours)
        .withColumn("bin", bin_no)
        .filter(F.col("bin") < bins)
        .groupBy("bin")
        .agg(*severity_counts())
    )
    spine = events.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    at = F.timestamp_micros(micros(start) + F.col("bin").cast("bigint") * width_us)
    filled = [F.coalesce(s, F.lit(0).cast("bigint")).alias(s) for s in reversed(fixed.SEVERITIES)]
    return spine.join(counts, "bin", "left").select("bin", F.date_format(at, "HH:mm").alias("hour"), *filled)


# ---------------------------------------------------------------- per source address


def per_kind(events: DataFrame, *keys: str) -> DataFrame:
    """Counts per address, event type and severity (and more keys): few groups, plain hash aggregation.

    Reports that also list types build on it, so that the list is made from
    these rows and not from every event.
    """
    return events.groupBy("source_ip", "event_type", "severity", *keys).agg(
        F.count("*").alias("n"), F.max(micros("timestamp")).alias("last_us")
    )


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def top_attackers(events: DataFrame, as_of: datetime, days: int = 7, limit: int = 100) -> DataFrame:
    return (
        per_kind(events.filter(F.col("timestamp") > before(as_of, days=days)))
        .groupBy("source_ip")
        .agg(
            F.sum("n").alias("attack_count"),
            from_micros(F.max("last_us")).alias("last_attack"),
            text.severity_name(F.max(text.severity_rank(F.col("severity")))).alias("max_severity"),
            F.sort_array(F.collect_set("event_type")).alias("methods"),
        )
        .orderBy(F.desc("attack_count"), "source_ip")
        .limit(limit)
        .select(
            "source_ip", "attack_count", F.size("methods").cast("bigint").alias("attack_types"), "last_attack",
            "max_severity", F.array_join("methods", ",").alias("attack_methods"),
        )
    )


def top_ips_blocked_flag(events: DataFrame, blocked: DataFrame, as_of: datetime, hours: float = 24, limit: int = 10):
    """Busiest addresses with worst severity, a country and whether they are blocked now."""
    top = (
        in_window(events, as_of, hours)
        .groupBy("source_ip")
        .agg(
            F.count("*").alias("count"),
            text.severity_name(F.max(text.severity_rank(F.col("severity")))).alias("max_severity"),
            F.coalesce(F.max("country_code"), F.lit("Unknown")).alias("country"),
        )
        .orderBy(F.desc("count"), "source_ip")
        .limit(limit)
    )
    now_blocked = (
        blocked.filter(active_block(as_of, null_expiry_active=False))
        .select(F.col("ip_address").alias("source_ip"), F.lit(True).alias("is_blocked"))
        .dropDuplicates(["source_ip"])
    )
    return top.join(now_blocked, "source_ip", "left").withColumn(
        "is_blocked", F.coalesce("is_blocked", F.lit(False))
    )


def attack_geo_points(events: DataFrame, blocked: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    top = top_ips_blocked_flag(events, blocked, as_of, hours)
    return top.filter(~F.col("country").isin("Unknown", "")).select(
        F.col("source_ip").alias("ip"), "country", "count", F.col("max_severity").alias("severity")
    )


def recent_attacks(events: DataFrame, blocked_with_country: DataFrame, as_of: datetime) -> DataFrame:
    """Events of a day with the country stored for the blocked address."""
    recent = events.filter(F.col("timestamp") > before(as_of, hours=24)).select(
        "id", "timestamp", "event_type", "severity", "source_ip", "protocol", "attack_vector"
    )
    return recent.join(blocked_with_country, recent.source_ip == F.col("ip_address"), "left").drop("ip_address")


def top_threats(
    events: DataFrame, predictions: DataFrame, as_of: datetime, hours: float = 24, limit: int = 10
) -> DataFrame:
    """Combined score per address from model confidence, monitor hits, bans and severities."""
    source = text.event_source(F.col("event_type"))
    points = text.first_case([(F.col("severity") == s, p) for s, p in fixed.SEVERITY_SCORES.items()], 0)
    rows = in_window(events, as_of, hours).filter(F.col("source_ip").isNotNull() & (F.col("source_ip") != "unknown"))

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    per_ip = (
        per_kind(rows, "country_code")
        .withColumn("src", source)
        .groupBy(F.col("source_ip").alias("ip"))
        .agg(
            F.sum("n").alias("total_events"),
            count(F.col("src") == "ml").alias("ml_count"),
            count(F.col("src") == "zeek").alias("zeek_detections"),
            count(F.col("src") == "fail2ban").alias("fail2ban_bans"),
            F.sum(points * F.col("n")).cast("bigint").alias("severity_points"),
            *[count(F.col("severity") == s).alias(s) for s in reversed(fixed.SEVERITIES)],
            from_micros(F.max("last_us")).alias("last_seen"),
            F.coalesce(F.max("country_code"), F.lit("Unknown")).alias("country"),
            F.sort_array(F.collect_set("event_type")).alias("event_types"),
        )
    )
    best = best_confidence(predictions, as_of, hours)
    conf = F.when(F.col("ml_count") > 0, F.coalesce(F.floor(F.col("best") * 100 + 1e-9).cast("bigint"), F.lit(0)))
    return (
        per_ip.join(best, "ip", "left")
        .withColumn("ml_confidence", F.coalesce(conf, F.lit(0)).cast("bigint"))
        .withColumn(
            "score",
            F.col("ml_confidence") + F.col("zeek_detections") * 10 + F.col("fail2ban_bans") * 20
            + F.col("severity_points"),
        )
        .drop("best", "severity_points")
        .orderBy(F.desc("score"), "ip")
        .limit(limit)
    )


def best_confidence(predictions: DataFrame, as_of: datetime, hours: float) -> DataFrame:
    """Highest model confidence per address seen in the window."""
    return (
        in_window(predictions, as_of, hours, "last_seen")
        .groupBy(F.col("ip_address").alias("ip"))
        .agg(F.max("ml_confidence").alias("best"))
    )


def threat_ml_confidence(threats: DataFrame, predictions: DataFrame, as_of: datetime, hours: float) -> DataFrame:
    best = best_confidence(predictions, as_of, hours)
    return threats.join(best, threats.source == best.ip, "left").select(
        threats.id, threats.threat_type, threats.source, F.coalesce("best", F.lit(0.0)).alias("ml_confidence")
    )


def top_names(distinct: DataFrame, group: list[str], name: str, n: int = 10) -> DataFrame:
    """First ``n`` names per group in order; only ``n`` per group and map task reach the shuffle."""
    order = Window.partitionBy(*group).orderBy(name)
    return (
        distinct.withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= n)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(name)).alias("ips"))
    )


def threat_map(events: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    """Per country: counts, mean severity score, addresses (first ten) and counts per detector."""
    src = text.event_source(F.col("event_type"))
    points = text.first_case([(F.col("severity") == s, p) for s, p in fixed.SEVERITY_SCORES.items()], 5)
    known = in_window(events, as_of, hours).filter(F.col("country_code").isNotNull() & (F.col("country_code") != "XX"))
    per_ip = (
        known.withColumn("src", src)
        .groupBy(F.col("country_code").alias("country"), "source_ip")
        .agg(
            F.count("*").alias("n"),
            F.sum(points).alias("points"),
            F.count_if(F.col("src") == "ml").alias("ml"),
            F.count_if(F.col("src") == "zeek").alias("zeek"),
            F.count_if(F.col("src") == "fail2ban").alias("fail2ban"),
        )
    )
    totals = per_ip.groupBy("country").agg(
        F.sum("n").alias("count"),
        rounded(F.sum("points") / F.sum("n"), 2).alias("avg_score"),
        F.count("source_ip").alias("unique_ips"),
        F.sum("ml").alias("ml"),
        F.sum("zeek").alias("zeek"),
        F.sum("fail2ban").alias("fail2ban"),
    )
    names = top_names(per_ip.filter(F.col("source_ip").isNotNull()).select("country", "source_ip"), ["country"], "source_ip")
    return totals.join(names, "country", "left")


def attack_timeline(events: DataFrame, as_of: datetime, hours: float = 24, minutes: int = 60) -> DataFrame:
    """Buckets of ``minutes`` counted from midnight of each day."""
    ts = F.col("timestamp")
    minute_of_day = F.hour(ts) * 60 + F.minute(ts)
    start = micros(F.to_date(ts).cast("timestamp_ntz")) + (F.floor(minute_of_day / minutes) * minutes).cast(
        "bigint"
    ) * F.lit(60_000_000).cast("bigint")
    src = text.event_source(F.col("event_type"))
    return (
        in_window(events, as_of, hours)
        .withColumn("src", src)
        .withColumn("bucket", F.date_format(F.timestamp_micros(start), "yyyy-MM-dd HH:mm"))
        .groupBy("bucket")
        .agg(
            F.count_if(F.col("src") == "ml").alias("ml_detections"),
            F.count_if(F.col("src") == "zeek").alias("zeek_detections"),
            F.count_if(F.col("src") == "fail2ban").alias("fail2ban_bans"),
            F.count("*").alias("total"),
            *severity_counts(),
        )
        .withColumnRenamed("bucket", "timestamp")
    )


def source_flags(events: DataFrame) -> DataFrame:
    """One row per address with a flag per detector that saw it."""
    src = text.event_source(F.col("event_type"))
    return (
        events.filter(F.col("source_ip").isNotNull() & (F.col("source_ip") != "unknown"))
        .withColumn("src", src)
        .groupBy(F.col("source_ip").alias("ip"))
        .agg(*[F.bool_or(F.col("src") == s).alias(s) for s in ("ml", "zeek", "fail2ban")])
    )


def source_correlation(events: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    flags = source_flags(in_window(events, as_of, hours))
    ml, zeek, ban = F.col("ml"), F.col("zeek"), F.col("fail2ban")
    counts = flags.agg(
        F.count_if(ml).alias("ml_unique"),
        F.count_if(zeek).alias("zeek_unique"),
        F.count_if(ban).alias("fail2ban_unique"),
        F.count_if(ml & zeek).alias("ml_and_zeek"),
        F.count_if(ml & ban).alias("ml_and_fail2ban"),
        F.count_if(zeek & ban).alias("zeek_and_fail2ban"),
        F.count_if(ml & zeek & ban).alias("all_three"),
    )

    def first_ten(cond: Column, name: str) -> DataFrame:
        ten = flags.filter(cond).orderBy("ip").limit(10)
        return ten.agg(F.array_join(F.sort_array(F.collect_list("ip")), "|").alias(name))

    return one_row(counts, first_ten(ml & zeek, "ml_and_zeek_ips"), first_ten(ml & zeek & ban, "all_three_ips"))


def integrated_summary(events: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    kind = F.col("event_type")
    return in_window(events, as_of, hours).agg(
        F.count("*").alias("total_events"),
        F.countDistinct("source_ip").alias("unique_ips"),
        *severity_counts(),
        F.count_if(kind.isin(fixed.SUMMARY_ML_TYPES)).alias("ml"),
        F.count_if(kind.isin(fixed.SUMMARY_MONITOR_TYPES)).alias("zeek"),
        F.count_if(kind.like("%ban%")).alias("fail2ban"),
    )


def histogram(df: DataFrame, key: str, column: str, out: str) -> DataFrame:
    """``value=count`` texts per key; pre-counted, so a hot key brings one row per value and task."""
    counts = df.groupBy(key, column).agg(F.count("*").alias("n"))
    item = F.concat(F.col(column), F.lit("="), F.col("n").cast("string"))
    return counts.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias(out))


def ip_details(events: DataFrame, predictions: DataFrame, geo: DataFrame, limit: int = 50, recent: int = 10):
    """Profile of every address from its newest ``limit`` events, model results and place."""
    last = latest_per_key(events, ["source_ip"], "timestamp", "id", limit).withColumnRenamed("source_ip", "ip")
    seen = last.groupBy("ip").agg(
        F.count("*").alias("total_events"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("rn") <= recent, F.struct("rn", "event_type", "severity")))),
            lambda e: F.concat(e["event_type"], F.lit(":"), e["severity"]),
        ).alias("recent_events"),
    )
    types = histogram(last, "ip", "event_type", "event_types")
    sevs = histogram(last.withColumn("severity", F.upper("severity")), "ip", "severity", "severities")
    ml = predictions.groupBy(F.col("ip_address").alias("ip")).agg(
        F.count("*").alias("total_predictions"),
        rounded(F.avg("ml_confidence"), 4).alias("avg_confidence"),
        rounded(F.max("ml_confidence"), 4).alias("max_confidence"),
    )
    return (
        seen.join(types, "ip").join(sevs, "ip").join(ml, "ip", "left").join(geo, "ip", "left")
        .withColumn("total_predictions", F.coalesce("total_predictions", F.lit(0).cast("bigint")))
        .withColumn("avg_confidence", F.coalesce("avg_confidence", F.lit(0.0)))
        .withColumn("max_confidence", F.coalesce("max_confidence", F.lit(0.0)))
    )


def country_stats(events: DataFrame, geo: DataFrame) -> DataFrame:
    """Per country: events, addresses, malicious share and counts per type."""
    per_ip = events.filter(F.col("source_ip").isNotNull()).groupBy(F.col("source_ip").alias("ip"), "event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity").isin("critical", "high")).alias("bad")
    )
    placed = per_ip.join(geo.select("ip", "country_code", "country_name"), "ip")
    totals = placed.groupBy("country_code").agg(
        F.min("country_name").alias("country_name"),
        F.sum("n").alias("total_events"),
        F.countDistinct("ip").alias("unique_ips"),
        F.sum("bad").alias("malicious_events"),
    )
    kinds = placed.groupBy("country_code", "event_type").agg(F.sum("n").alias("n"))
    item = F.concat(F.col("event_type"), F.lit("="), F.col("n").cast("string"))
    kinds = kinds.groupBy("country_code").agg(F.sort_array(F.collect_list(item)).alias("event_types"))
    return totals.join(kinds, "country_code").withColumn(
        "malicious_percentage", rounded(F.col("malicious_events") / F.col("total_events") * 100, 4)
    )


def country_severity(events: DataFrame, geo: str = "geo_location") -> DataFrame:
    place = text.parse_geo(F.col(geo))
    return (
        events.filter(F.col(geo).isNotNull() & (F.col(geo) != ""))
        .withColumn("g", place)
        .withColumn("country_code", F.coalesce("g.country_code", F.lit("XX")))
        .groupBy("country_code")
        .agg(
            F.min(F.coalesce("g.country", F.lit("Unknown"))).alias("country"),
            F.count("*").alias("total_events"),
            *severity_counts(),
        )
    )


def available_countries(events: DataFrame, geo: str = "geo_location") -> DataFrame:
    seen = events.filter(F.col(geo).isNotNull() & (F.col(geo) != "")).select(geo).distinct()
    return (
        seen.withColumn("g", text.parse_geo(F.col(geo)))
        .select(F.coalesce("g.country_code", F.lit("XX")).alias("code"), F.coalesce("g.country", F.lit("Unknown")).alias("name"))
        .filter(F.col("code") != "XX")
        .groupBy("code")
        .agg(F.min("name").alias("name"))
        .orderBy("name")
    )


def hourly_rollup(requests: DataFrame, top: int = 3) -> DataFrame:
    """Per clock hour: requests, blocked, addresses, attacks, types, leading countries, bytes.

    Needs timestamp, source_ip, event_type (null for a plain request), is_blocked, country_code, bytes.
    """
    hour = F.date_trunc("HOUR", "timestamp").cast("timestamp_ntz")
    rows = requests.withColumn("hour", hour)
    base = rows.groupBy("hour").agg(
        F.count("*").alias("total_requests"),
        F.count_if("is_blocked").alias("blocked_requests"),
        F.countDistinct("source_ip").alias("unique_ips"),
        F.count("event_type").alias("attacks_detected"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bandwidth_used"),
    )
    kinds = histogram(rows.filter(F.col("event_type").isNotNull()), "hour", "event_type", "attacks_by_type")
    places = rows.filter(F.col("country_code").isNotNull()).groupBy("hour", "country_code").agg(F.count("*").alias("n"))
    best = Window.partitionBy("hour").orderBy(F.desc("n"), "country_code")
    places = (
        places.withColumn("rk", F.row_number().over(best))
        .filter(F.col("rk") <= top)
        .groupBy("hour")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rk", "country_code", "n"))),
                lambda e: F.concat(e["country_code"], F.lit("="), e["n"].cast("string")),
            ).alias("top_countries")
        )
    )
    return base.join(kinds, "hour", "left").join(places, "hour", "left")


def event_type_distribution(events: DataFrame, as_of: datetime, days: int = 30, top: int = 10) -> DataFrame:
    """Ten leading types and all severities with their percentage of the total."""
    rows = events.filter(F.col("timestamp") >= before(as_of, days=days))
    sets = rows.groupingSets([("event_type",), ("severity",), ()], "event_type", "severity").agg(
        F.count("*").alias("count"), F.grouping_id().alias("gid")
    )
    total = Window.partitionBy(F.lit(1))
    named = sets.withColumn("total", F.max(F.when(F.col("gid") == 3, F.col("count"))).over(total)).filter(
        F.col("gid") < 3
    )
    kind = F.when(F.col("gid") == 1, F.lit("type")).otherwise("severity")
    rank = Window.partitionBy("kind").orderBy(F.desc("count"), "value")
    return (
        named.select(kind.alias("kind"), F.coalesce("event_type", "severity").alias("value"), "count", "total")
        .withColumn("rk", F.row_number().over(rank))
        .filter((F.col("kind") == "severity") | (F.col("rk") <= top))
        .select("kind", "value", "count", rounded(F.col("count") / F.col("total") * 100, 1).alias("percent"))
    )


def label_events(events: DataFrame, blocked: DataFrame, as_of: datetime) -> DataFrame:
    """1 when the source is blocked now or the event is high or critical."""
    now = blocked.filter(active_block(as_of)).select(F.col("ip_address").alias("source_ip"), F.lit(1).alias("_b")).distinct()
    bad = F.col("severity").isin("critical", "high")
    return (
        events.join(now, "source_ip", "left")
        .withColumn("label", F.when(F.col("_b").isNotNull() | bad, 1).otherwise(0))
        .drop("_b")
    )
