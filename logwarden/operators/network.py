"""Detections and reports over network-monitor tables (connections, DNS, TLS, HTTP, files, notices)."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import rounded
from ..functions import fixed, text
from ..functions.times import micros
from .events import in_window, one_row
from .intervals import gap_moments


def has_port(df: DataFrame) -> DataFrame:
    return df.filter(F.col("source_ip").isNotNull() & F.coalesce(F.col("dest_port") != 0, F.lit(False)))


def port_scan_simple(conn: DataFrame, as_of: datetime, hours: float = 24, min_ports: int = 10) -> DataFrame:
    """Sources reaching many ports; ports are made distinct first and number at most 65535."""
    pairs = has_port(in_window(conn, as_of, hours)).select(F.col("source_ip").alias("ip"), "dest_port").distinct()
    return (
        pairs.groupBy("ip")
        .agg(F.sort_array(F.collect_list("dest_port")).alias("ports"))
        .filter(F.size("ports") >= min_ports)
        .select("ip", F.size("ports").cast("bigint").alias("ports_scanned"), F.slice("ports", 1, 20).alias("ports"))
        .orderBy(F.desc("ports_scanned"), "ip")
    )


def ports_and_peers(conn: DataFrame, *sums: Column) -> DataFrame:
    """Rows per (source, port) and per (source, destination) from one scan; ``gid`` 1 has the port, 2 the destination.

    Counting distinct ports and destinations from these keeps both steps in
    plain hash aggregation.
    """
    return conn.groupingSets([("source_ip", "dest_port"), ("source_ip", "dest_ip")], "source_ip", "dest_port", "dest_ip").agg(
        F.grouping_id().alias("gid"), *sums
    )


def port_scan_rated(conn: DataFrame, as_of: datetime, hours: float = 1, min_ports: int = 15) -> DataFrame:
    """Port scans with span, rate and severity, worst first."""
    pairs = ports_and_peers(
        has_port(in_window(conn, as_of, hours)).select("source_ip", "dest_port", "dest_ip", "timestamp"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    )
    per_ip = (
        pairs.groupBy(F.col("source_ip").alias("ip"))
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("gid") == 1, F.col("dest_port")))).alias("ports"),
            F.count(F.when(F.col("gid") == 2, F.col("dest_ip"))).alias("unique_destinations"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
        )
        .withColumn("n", F.size("ports").cast("bigint"))
        .filter(F.col("n") >= min_ports)
        .withColumn("span", (micros("last_seen") - micros("first_seen")) / F.lit(1e6))
        .withColumn("rate", F.col("n") / F.greatest("span", F.lit(1.0)))
    )
    n, rate = F.col("n"), F.col("rate")
    severity = text.first_case(
        [((n >= 100) | (rate >= 10), "critical"), ((n >= 50) | (rate >= 5), "high"), (n >= 25, "medium")], "low"
    )
    return by_severity_then(
        per_ip.select(
            "ip", n.alias("ports_scanned"), "unique_destinations", rounded("span", 2).alias("time_window"),
            rounded(rate, 2).alias("scan_rate"), severity.alias("severity"), F.slice("ports", 1, 50).alias("ports"),
            "first_seen", "last_seen",
        ),
        "ports_scanned",
    )


def by_severity_then(df: DataFrame, count: str, tie: str = "ip") -> DataFrame:
    return df.orderBy(text.severity_rank(F.col("severity")).desc(), F.col(count).desc(), tie)


# ---------------------------------------------------------------- DNS


def with_entropy(dns: DataFrame) -> DataFrame:
    """Add the entropy of each query; computed once per row however often it is read."""
    return text.once(dns, "query_entropy", text.shannon_entropy(F.col("query")))


def high_entropy(dns: DataFrame, as_of: datetime, hours: float = 24, at_least: float = 3.5) -> DataFrame:
    return with_entropy(in_window(dns, as_of, hours)).filter(F.col("query_entropy") >= at_least)


def long_queries(dns: DataFrame, as_of: datetime, hours: float = 24, longer: int = 60) -> DataFrame:
    return in_window(dns, as_of, hours).filter(F.length("query") > longer)


def nxdomain_spam(dns: DataFrame, as_of: datetime, hours: float = 24, at_least: int = 50) -> DataFrame:
    return (
        in_window(dns, as_of, hours)
        .filter(F.col("rcode_name") == "NXDOMAIN")
        .groupBy(F.col("source_ip").alias("ip"))
        .agg(F.count("*").alias("nxdomain_count"))
        .filter(F.col("nxdomain_count") >= at_least)
        .orderBy(F.desc("nxdomain_count"), "ip")
    )


def dga_domains(dns: DataFrame, as_of: datetime, hours: float = 24, at_least: float = 3.8) -> DataFrame:
    unknown = in_window(dns, as_of, hours).filter(~text.is_known_domain(F.col("query")))
    return with_entropy(unknown).filter(F.col("query_entropy") >= at_least)


def dot_count(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))


def dns_tunneling(dns: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    q = F.col("query")
    return in_window(dns, as_of, hours).filter((F.length(q) > 60) & (dot_count(q) >= 3)).withColumn(
        "subdomain_levels", dot_count(q)
    )


def dns_high_volume(dns: DataFrame, as_of: datetime, hours: float = 24, at_least: int = 100, limit: int = 20) -> DataFrame:
    return (
        in_window(dns, as_of, hours)
        .groupBy(F.col("source_ip").alias("ip"))
        .agg(F.count("*").alias("query_count"))
        .filter(F.col("query_count") >= at_least)
        .orderBy(F.desc("query_count"), "ip")
        .limit(limit)
    )


def dns_suspicious_domains(dns: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    """The 50 most asked names first, then the entropy and count conditions."""
    top = (
        in_window(dns, as_of, hours)
        .groupBy(F.coalesce("query", F.lit("")).alias("domain"))
        .agg(F.count("*").alias("query_count"))
        .orderBy(F.desc("query_count"), "domain")
        .limit(50)
    )
    return top.withColumn("entropy", text.shannon_entropy(F.col("domain"))).filter("entropy >= 3.5 and query_count >= 10")


# ---------------------------------------------------------------- TLS


def tls_flags(ssl: DataFrame, as_of: Column) -> DataFrame:
    flagged = (
        ssl.withColumn("is_self_signed", text.is_self_signed(F.col("subject"), F.col("issuer")))
        .withColumn("is_expired", text.is_expired(F.col("not_valid_after"), as_of))
        .withColumn("is_weak_cipher", text.is_weak_tls(F.col("version")))
    )
    return flagged.withColumn("is_suspicious", F.col("is_self_signed") | F.col("is_expired") | F.col("is_weak_cipher"))


def tls_rare_issuers(ssl: DataFrame, as_of: datetime, hours: float = 24, at_least: int = 5) -> DataFrame:
    return (
        in_window(ssl, as_of, hours)
        .filter(F.col("issuer").isNotNull() & (F.col("issuer") != ""))
        .groupBy("issuer")
        .agg(F.count("*").alias("connection_count"))
        .filter((F.col("connection_count") >= at_least) & ~text.contains_any(F.col("issuer"), fixed.COMMON_ISSUERS))
    )


# ---------------------------------------------------------------- regularity


def beaconing(conn: DataFrame, as_of: datetime, hours: float = 24, threshold: float = 0.9, min_count: int = 10) -> DataFrame:
    """Flows whose gaps are regular: 1 - min(population deviation / mean, 1).

    Gaps are summed per time bucket first, so one busy flow does not land in one task.
    """
    keys = ["source_ip", "dest_ip", "dest_port"]
    stats = gap_moments(in_window(conn, as_of, hours), keys, "timestamp").withColumnRenamed("n", "connection_count")
    stats = stats.withColumn("dev", F.sqrt(F.greatest(F.lit(0.0), F.col("squares") - F.col("mean") * F.col("mean"))))
    cv = F.when(F.col("mean") > 0, F.col("dev") / F.col("mean")).otherwise(F.lit(0.0))
    return (
        stats.withColumn("reg", 1 - F.least(cv, F.lit(1.0)))
        .filter((F.col("connection_count") >= min_count) & (F.col("reg") >= threshold))
        .select(
            *keys, "connection_count", rounded("mean", 2).alias("mean_interval"), rounded("reg", 3).alias("regularity"),
            "first_seen", "last_seen",
        )
        .orderBy(F.desc("regularity"), *keys)
    )


def flow_regularity(conn: DataFrame, more_than: int = 5) -> DataFrame:
    """Per source: max(0, 1 - sample deviation / mean) over the gaps of all its flows."""
    stats = gap_moments(conn, ["source_ip"], "timestamp")
    spread = F.greatest(F.lit(0.0), F.col("squares") - F.col("mean") * F.col("mean"))
    stats = stats.withColumn("dev", F.when(F.col("gaps") > 1, F.sqrt(spread * F.col("gaps") / (F.col("gaps") - 1))))
    value = F.greatest(F.lit(0.0), 1 - F.coalesce("dev", F.lit(0.0)) / F.col("mean"))
    return stats.select(
        F.col("source_ip").alias("ip"),
        F.when((F.col("n") > more_than) & (F.col("mean") > 0), value).otherwise(F.lit(0.0)).alias("connection_regularity"),
    )


# ---------------------------------------------------------------- features and rollups

CONN_FEATURES = [
    "connections_count", "unique_dest_ports", "unique_dest_ips", "bytes_sent", "bytes_received", "packets_sent",
    "packets_received", "avg_duration", "failed_connections",
]
OTHER_FEATURES = [
    "dns_queries", "unique_domains", "failed_dns", "http_requests", "http_methods_diversity",
    "suspicious_user_agents", "ssl_connections", "ssl_invalid_certs", "connection_regularity",
]
NETWORK_FEATURES = CONN_FEATURES + OTHER_FEATURES
REAL_FEATURES = {"avg_duration", "connection_regularity"}


def network_features(conn: DataFrame, dns: DataFrame, http: DataFrame, ssl: DataFrame) -> DataFrame:
    """18 features per address from four logs, zero where a log knows nothing of it.

    Each log is aggregated on its own; the results are stacked and summed, which
    replaces a chain of outer joins by one small shuffle.
    """
    ip = F.col("source_ip").alias("ip")
    long = F.coalesce(F.col("duration") != 0, F.lit(False))
    pairs = ports_and_peers(
        conn,
        F.count("*").alias("n"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")],
        F.sum(F.when(long, F.col("duration"))).alias("dur"),
        F.count_if(long).alias("dur_n"),
        F.count_if(F.col("conn_state").isin(fixed.FAILED_STATES)).alias("failed"),
    )
    by_port = F.col("gid") == 1

    def total(c: str) -> Column:
        return F.sum(F.when(by_port, F.col(c)))

    by_conn = pairs.groupBy(ip).agg(
        total("n").alias("connections_count"),
        F.count_if(by_port & F.coalesce(F.col("dest_port") != 0, F.lit(False))).alias("unique_dest_ports"),
        F.count(F.when(F.col("gid") == 2, F.col("dest_ip"))).alias("unique_dest_ips"),
        total("orig_bytes").alias("bytes_sent"),
        total("resp_bytes").alias("bytes_received"),
        total("orig_pkts").alias("packets_sent"),
        total("resp_pkts").alias("packets_received"),
        F.coalesce(F.try_divide(total("dur"), total("dur_n")), F.lit(0.0)).alias("avg_duration"),
        total("failed").alias("failed_connections"),
    )
    by_dns = dns.groupBy(ip).agg(
        F.count("*").alias("dns_queries"),
        F.countDistinct(F.nullif(F.col("query"), F.lit(""))).alias("unique_domains"),
        F.count_if(F.coalesce(F.col("rcode") != 0, F.lit(False))).alias("failed_dns"),
    )
    agent = text.contains_any(text.lower_agent(F.col("user_agent")), fixed.FEATURE_AGENTS)
    by_http = http.groupBy(F.col("ip")).agg(
        F.count("*").alias("http_requests"),
        F.countDistinct("method").alias("http_methods_diversity"),
        F.count_if(agent).alias("suspicious_user_agents"),
    )
    by_ssl = ssl.groupBy(ip).agg(
        F.count("*").alias("ssl_connections"),
        F.count_if(F.coalesce(F.lower("validation_status").contains("invalid"), F.lit(False))).alias("ssl_invalid_certs"),
    )
    parts = [by_conn, by_dns, by_http, by_ssl, flow_regularity(conn)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.filter(F.col("ip").isNotNull()).groupBy("ip").agg(
        *[F.coalesce(F.sum(c), F.lit(0.0 if c in REAL_FEATURES else 0)).cast("double" if c in REAL_FEATURES else "bigint").alias(c) for c in NETWORK_FEATURES]
    )


def table_stats(as_of: datetime, hours: float, notices: DataFrame, **tables: DataFrame) -> DataFrame:
    """Window counts of the monitor tables and of open notices, one row."""
    parts = [in_window(df, as_of, hours).agg(F.count("*").alias(name)) for name, df in tables.items()]
    parts.append(
        in_window(notices, as_of, hours).agg(
            F.count("*").alias("total_notices"), F.count_if(~F.col("is_resolved")).alias("unresolved_notices")
        )
    )
    return one_row(*parts)


def hourly_connections(conn: DataFrame, scan_ports: int, top: int) -> DataFrame:
    """Per clock hour totals, distinct addresses, scanning sources and leading services of connections.

    Connections are read once: grouping sets count per port of a source, per destination and per service, and two plain sums
    bring these to sources and hours. The services are those of a fixed table.
    """
    proto, sums = F.col("protocol"), ["n", "tcp", "udp", "icmp", "sent", "received"]
    rows = conn.select(
        F.date_trunc("HOUR", "timestamp").cast("timestamp_ntz").alias("hour"), "source_ip", "dest_port", "dest_ip",
        text.port_service(F.col("dest_port")).alias("service"), "protocol", "orig_bytes", "resp_bytes")
    per_port, per_dest, per_service = ("hour", "source_ip", "dest_port"), ("hour", "dest_ip"), ("hour", "service")
    sets = rows.groupingSets([per_port, per_dest, per_service], "hour", "source_ip", "dest_port", "dest_ip", "service").agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"), F.count_if(proto == "tcp").alias("tcp"), F.count_if(proto == "udp").alias("udp"),
        F.count_if(proto == "icmp").alias("icmp"), F.sum("orig_bytes").alias("sent"), F.sum("resp_bytes").alias("received"))
    ported = F.coalesce(F.col("dest_port") != 0, F.lit(False))
    by_source = sets.groupBy("hour", "gid", "source_ip", "service").agg(
        F.count_if(ported).alias("ports"), F.count("dest_ip").alias("dests"), *[F.sum(x).alias(x) for x in sums])
    of_source, of_dest, of_service = (F.col("gid") == 3) & F.col("source_ip").isNotNull(), F.col("gid") == 13, F.col("gid") == 14

    def total(c: str, kind: Column) -> Column:
        return F.sum(F.when(kind, F.col(c))).cast("bigint")

    leading = F.collect_list(F.when(of_service & (F.col("service") != "Unknown"), F.struct((-F.col("n")).alias("order"), "service")))
    named = F.transform(F.slice(F.sort_array(leading), 1, top), lambda e: F.concat(e["service"], F.lit("="), (-e["order"]).cast("string")))
    return by_source.groupBy("hour").agg(
        total("n", of_service).alias("total_connections"),
        total("tcp", of_service).alias("tcp_connections"),
        total("udp", of_service).alias("udp_connections"),
        total("icmp", of_service).alias("icmp_connections"),
        total("sent", of_service).alias("total_bytes_sent"),
        F.coalesce(total("received", of_service), F.lit(0)).alias("total_bytes_received"),
        F.count_if(of_source).alias("unique_source_ips"),
        total("dests", of_dest).alias("unique_dest_ips"),
        F.count_if(of_source & (F.col("ports") >= scan_ports)).alias("port_scans_detected"),
        F.array_join(named, "|").alias("top_services"),
    )


def hourly_rollup(conn, dns, ssl, http, files, notices, scan_ports: int = 15, top: int = 3) -> DataFrame:
    """Per clock hour figures of all monitor tables. ``files`` needs a timestamp."""
    hour = F.date_trunc("HOUR", "timestamp").cast("timestamp_ntz").alias("hour")
    c = hourly_connections(conn, scan_ports, top)
    d = dns.groupBy(hour).agg(F.count("*").alias("dns_queries"), F.count_if(F.col("rcode_name") == "NXDOMAIN").alias("dns_nxdomain"))
    s = ssl.groupBy(hour).agg(
        F.count("*").alias("ssl_connections"),
        F.count_if(F.lower("validation_status").contains("invalid")).alias("ssl_invalid_certs"),
    )
    h = http.groupBy(hour).agg(F.count("*").alias("http_requests"), F.count_if(F.col("status") >= 400).alias("http_errors"))
    f = files.groupBy(hour).agg(F.count("*").alias("files_transferred"))
    n = notices.groupBy(hour).agg(F.count("*").alias("notices_generated"))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [c, d, s, h, f, n])
    cols = [x for x in stacked.columns if x not in ("hour", "top_services")]
    return stacked.groupBy("hour").agg(
        *[F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(x) for x in cols],
        F.coalesce(F.max("top_services"), F.lit("")).alias("top_services"),
    )


# ---------------------------------------------------------------- detections to events and alerts


def detection_rows(conn: DataFrame, dns: DataFrame, ssl: DataFrame, as_of: datetime, hours: float = 1) -> DataFrame:
    """All detections in one event shape. DNS, beacons and TLS look back 24 times as long."""
    long = hours * 24

    def shape(df, kind, severity, port, ip="source_ip", detail=None):
        return df.select(
            F.lit(kind).alias("event_type"), severity.alias("severity"), F.col(ip).alias("source_ip"),
            (F.lit(port) if port else F.lit(None)).cast("int").alias("target_port"), detail.alias("detail"),
        )

    scans = port_scan_rated(conn, as_of, hours)
    parts = [
        shape(scans, "port_scan", F.col("severity"), 0, "ip", F.concat(F.col("ports_scanned").cast("string"), F.lit(" ports"))),
        shape(dns_tunneling(dns, as_of, long), "dns_tunneling", F.lit("high"), 53, detail=F.col("query")),
        shape(dga_domains(dns, as_of, long), "dga_domain", F.lit("medium"), 53, detail=F.col("query")),
        shape(beaconing(conn, as_of, long, 0.8), "beaconing", F.lit("critical"), 0,
              detail=F.concat(F.col("dest_ip"), F.lit(":"), F.col("dest_port").cast("string"))),
        shape(tls_flags(in_window(ssl, as_of, long), F.lit(None)).filter("is_self_signed"), "ssl_self_signed", F.lit("medium"), 443,
              detail=F.col("server_name")),
    ]
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.withColumn(
        "attack_vector", F.when(F.col("event_type").contains("scan"), "network_scan").otherwise("suspicious_traffic")
    )


def detection_alerts(conn: DataFrame, dns: DataFrame, ssl: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    """Threat and alert rows: a capped, ordered head of each detection, then its threshold."""

    def rows(df, kind, severity, ip, text_col):
        return df.select(
            F.lit(kind).alias("threat_type"), severity.alias("severity"), F.col(ip).alias("source"), text_col.alias("description"),
            F.concat(F.upper(F.lit(kind)), F.lit(" detectado")).alias("title"),
        )

    def word(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    scans = port_scan_rated(conn, as_of, hours).limit(5).filter(F.col("severity").isin("critical", "high"))
    dga = dga_domains(dns, as_of, hours).orderBy("timestamp", "id").limit(10).filter("query_entropy >= 4.5")
    tunnels = dns_tunneling(dns, as_of, hours).orderBy("timestamp", "id").limit(5)
    certs = tls_flags(in_window(ssl, as_of, hours), F.lit(None)).filter("is_self_signed").orderBy("timestamp", "id").limit(10)
    beacons = beaconing(conn, as_of, hours).limit(5)
    parts = [
        rows(scans, "port_scan", F.col("severity"), "ip", word("Port scan detectado: ", F.col("ports_scanned"), " puertos")),
        rows(dga, "dns_dga", F.lit("high"), "source_ip", word("Posible DGA detectado: ", F.col("query"))),
        rows(tunnels, "dns_tunneling", F.lit("critical"), "source_ip",
             word("Posible DNS tunneling: ", F.col("query"), " (", F.length("query"), " chars)")),
        rows(certs, "ssl_self_signed", F.lit("medium"), "source_ip", word("Certificado auto-firmado detectado: ", F.col("server_name"))),
        rows(beacons, "beaconing", F.lit("critical"), "source_ip",
             word("Posible beaconing a ", F.col("dest_ip"), ":", F.col("dest_port"), " (regularidad: ", F.format_string("%.0f", F.col("regularity") * 100), "%)")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def new_rows(batch: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key is not stored yet, one per key; rows without a key are all kept."""
    keyed = batch.filter(F.col(key).isNotNull()).join(stored.select(key), key, "left_anti")
    cols = batch.columns
    first = keyed.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("row")).select("row.*")
    return first.unionByName(batch.filter(F.col(key).isNull()))
