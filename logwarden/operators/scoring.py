"""Behaviour, threat and reputation scores per address."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import rounded
from ..functions import fixed, text
from ..functions.times import micros, ts_lit
from ..session import shared_table
from .events import active_block, in_window
from .intervals import gap_moments, latest_per_key


def behavioral_features(events: DataFrame) -> DataFrame:
    """Ten behaviour features per source_ip, plus a growth ratio split by time.

    Needs timestamp, severity, attack_vector, request_path. ``events`` is computed once: what the features need of it is written in
    narrow columns, and the passes for sums, gaps and halves each read theirs.
    """
    path = F.coalesce("request_path", F.lit("/"))
    sev = F.col("severity")
    vector = F.when(F.col("attack_vector") != "unknown", F.nullif(F.col("attack_vector"), F.lit("")))
    odd = text.count_chars(F.coalesce("request_path", F.lit("")), fixed.BEHAVIOUR_CHARS)
    rows = shared_table(events.select("source_ip", "timestamp", path.alias("p"), sev.isin("high", "critical").alias("bad"), vector.alias("v"), odd.alias("odd")), "behaviour")
    gaps = gap_moments(rows, ["source_ip"], "timestamp")
    us = micros("timestamp")
    spread = F.greatest(F.lit(0.0), F.col("squares") - F.col("mean") * F.col("mean"))
    gaps = gaps.select("source_ip", F.coalesce(F.sqrt(spread), F.lit(0.0)).alias("dev"))
    stats = rows.groupBy("source_ip").agg(
        F.count("*").alias("n"),
        F.min(us).alias("first"),
        F.max(us).alias("last"),
        F.countDistinct("p").alias("unique_paths"),
        F.count_if("bad").alias("bad"),
        F.countDistinct("v").alias("num_attack_types"),
        rounded(F.avg(F.length("p")), 1).alias("avg_path_length"),
        F.sum("odd").cast("bigint").alias("suspicious_chars_total"),
    )
    middle = stats.select("source_ip", ((F.col("first") + F.col("last")) / 2).alias("mid"))
    halves = (
        rows.select("source_ip", us.alias("us")).join(middle, "source_ip").groupBy("source_ip")
        .agg(F.count_if(F.col("us") > F.col("mid")).alias("late"), F.count_if(F.col("us") <= F.col("mid")).alias("early"))
    )
    n, half = F.col("n"), F.floor(F.col("n") / 2)
    span = (F.col("last") - F.col("first")) / 60e6
    out = stats.join(halves, "source_ip").join(gaps, "source_ip")
    return out.select(
        "source_ip",
        n.alias("total_events"),
        rounded(F.when(n >= 2, n / F.greatest(span, F.lit(1.0))).otherwise(F.lit(0.0)), 2).alias("requests_per_minute"),
        rounded(F.col("unique_paths") / n, 3).alias("path_diversity_ratio"),
        rounded(F.col("bad") / n, 3).alias("error_ratio"),
        "num_attack_types",
        rounded("dev", 2).alias("temporal_entropy"),
        ((F.col("dev") < 2) & (n - 1 > 3)).alias("is_rhythmic_bot"),
        rounded(F.when(n >= 10, (n - half) / half).otherwise(F.lit(1.0)), 2).alias("escalation_ratio"),
        rounded(F.when(n >= 10, F.col("late") / F.greatest("early", F.lit(1))).otherwise(F.lit(1.0)), 2).alias("time_escalation_ratio"),
        "unique_paths",
        "avg_path_length",
        "suspicious_chars_total",
    )


def threat_score(df: DataFrame, confidence: str = "ml_confidence", country: str = "country_code") -> DataFrame:
    """Add threat_score, action, texts, priority and factors from confidence, behaviour and country.

    The action follows the unrounded sum.
    """
    conf, rpm = F.col(confidence), F.col("requests_per_minute")
    kinds, err = F.col("num_attack_types"), F.col("error_ratio")
    esc, odd, length = F.col("escalation_ratio"), F.col("suspicious_chars_total"), F.col("avg_path_length")
    zero = F.lit(0.0)

    def points(cond: Column, value: Column) -> Column:
        return F.when(cond, value.cast("double")).otherwise(zero)

    parts = {
        "ml": (conf * 40, conf * 40 > 20, F.format_string("%.1f%% confianza de ser malicioso", conf * 100)),
        "speed": (points(rpm > 5, F.least(F.lit(20.0), rpm)), rpm > 5, F.format_string("%.1f requests/minuto (normal: <2)", rpm)),
        "vectors": (points(kinds > 1, F.least(F.lit(15), kinds * 5)), kinds > 1,
                    F.concat(kinds.cast("string"), F.lit(" tipos diferentes de ataque"))),
        "errors": (points(err > 0.3, F.least(F.lit(10.0), err * 10)), err > 0.3,
                   F.format_string("%.0f%% de requests generan errores críticos", err * 100)),
        "bot": (points(F.col("is_rhythmic_bot"), F.lit(10)), F.col("is_rhythmic_bot"), F.lit("Intervalos regulares detectados (no humano)")),
        "country": (points(F.col(country).isin(fixed.HIGH_RISK_COUNTRIES), F.lit(5)), F.col(country).isin(fixed.HIGH_RISK_COUNTRIES),
                    F.concat(F.lit("Origen: "), F.col(country))),
        "escalation": (points(esc > 2, F.lit(5)), esc > 2, F.format_string("Actividad incrementó %.1fx en última mitad del período", esc)),
        "chars": (points(odd > 10, F.least(F.lit(5.0), odd / 10)), odd > 10,
                  F.concat(odd.cast("string"), F.lit(" caracteres sospechosos en URLs"))),
        "paths": (points(length > 150, F.least(F.lit(5.0), (length - 150) / 50)), length > 150,
                  F.format_string("Promedio de %.0f caracteres (normal: <100)", length)),
    }
    total = zero
    for p, _, _ in parts.values():
        total = total + p
    factors = F.array_compact(F.array(*[
        F.when(F.coalesce(shown, F.lit(False)), F.struct(F.lit(fixed.FACTORS[k]).alias("factor"), rounded(p, 1).alias("points"), d.alias("description")))
        for k, (p, shown, d) in parts.items()
    ]))
    scored = df.withColumn("_total", total).withColumn("threat_factors", factors)

    def ladder(i: int) -> Column:
        return text.first_case([(F.col("_total") >= a[0], a[i]) for a in fixed.ACTIONS if a[0] is not None], fixed.ACTIONS[-1][i])

    return scored.select(
        *df.columns,
        F.least(F.lit(100.0), rounded("_total", 1)).alias("threat_score"),
        ladder(1).alias("recommended_action"),
        ladder(2).alias("action_text"),
        ladder(3).alias("action_description"),
        ladder(4).alias("threat_color"),
        ladder(5).alias("threat_priority"),
        "threat_factors",
    )


def enhanced_reason(df: DataFrame) -> DataFrame:
    """Add ``reasons``: a text over verdict, score, behaviour, factors, first event and advice.

    Needs the columns of :func:`threat_score`, ml_confidence and, of the
    first event, severity_level, suspicious_chars, path_length, hour, is_night.
    """
    conf = F.col("ml_confidence")
    bad = conf >= 0.6
    f1 = lambda fmt, c: F.format_string(fmt, c)
    verdict = F.when(bad, f1("⚠️ **CLASIFICADO COMO MALICIOSO** (%.1f%% confianza)", conf * 100)).otherwise(
        f1("✅ **CLASIFICADO COMO NORMAL** (%.1f%% confianza)", (1 - conf) * 100)
    )
    rpm, kinds, err = F.col("requests_per_minute"), F.col("num_attack_types"), F.col("error_ratio")
    top = F.slice("threat_factors", 1, 5)
    factor_lines = F.transform(
        top, lambda f: F.concat(F.lit("  • **"), f["factor"], F.lit("** (+"), f["points"].cast("string"), F.lit(" pts): "), f["description"])
    )
    level = F.col("severity_level")
    event_lines = F.array_compact(F.array(
        F.when(level >= 3, F.concat(F.lit("  • Severidad "), F.when(level == 3, "alta").otherwise("crítica"))),
        F.when(F.col("suspicious_chars") > 3, F.concat(F.lit("  • "), F.col("suspicious_chars").cast("string"), F.lit(" caracteres maliciosos en URL"))),
        F.when(F.col("path_length") > 100, F.concat(F.lit("  • URL muy larga ("), F.col("path_length").cast("string"), F.lit(" chars)"))),
        F.when(F.col("is_night") == 1, F.concat(F.lit("  • Horario sospechoso ("), F.col("hour").cast("string"), F.lit(":00 hrs)"))),
    ))
    lines = F.concat_ws(
        "\n",
        verdict,
        F.concat(F.lit("\n**Threat Score: "), F.col("threat_score").cast("string"), F.lit("/100** - "), F.col("action_text")),
        F.lit("\n**📊 Análisis de Comportamiento:**"),
        F.when(rpm > 2, f1("  • %.1f requests/minuto (anormal, promedio normal: ~0.5)", rpm)),
        F.when(kinds > 0, F.concat(F.lit("  • "), kinds.cast("string"), F.lit(" vectores de ataque diferentes detectados"))),
        F.when(err > 0.3, f1("  • %.0f%% de requests resultaron en errores críticos", err * 100)),
        F.when(F.col("is_rhythmic_bot"), f1("  • Patrón bot detectado (intervalos regulares de ~%.1fs)", F.col("temporal_entropy"))),
        F.when(F.col("escalation_ratio") > 2, f1("  • Escalamiento: %.1fx más actividad en última hora", F.col("escalation_ratio"))),
        F.when(F.size("threat_factors") > 0,
               F.concat(F.lit("\n**🔍 Factores Principales ("), F.size("threat_factors").cast("string"), F.lit(" detectados):**"))),
        factor_lines,
        F.when(F.size(event_lines) > 0, F.lit("\n**🎯 Características del Evento:**")),
        event_lines,
        F.concat(F.lit("\n**"), F.col("action_text"), F.lit("**")),
        F.concat(F.lit("   "), F.col("action_description")),
    )
    return df.withColumn("reasons", lines)


def event_features(events: DataFrame) -> DataFrame:
    """Fifteen features of an event for the classifier (five of them categorical)."""
    ts = F.col("timestamp")
    path, agent = F.coalesce("request_path", F.lit("/")), F.coalesce("user_agent", F.lit(""))
    hour, day = F.coalesce(F.hour(ts), F.lit(0)), F.coalesce(F.weekday(ts), F.lit(0))
    night = (hour >= 22) | (hour <= 6)
    return events.select(
        "id",
        F.col("source_ip"),
        hour.alias("hour"),
        day.alias("day_of_week"),
        F.when(day >= 5, 1).otherwise(0).alias("is_weekend"),
        F.when(ts.isNotNull() & night, 1).otherwise(0).alias("is_night"),
        (F.coalesce(text.severity_rank(F.col("severity")), F.lit(0)) + 1).alias("severity_level"),
        F.coalesce("attack_vector", F.lit("unknown")).alias("attack_vector"),
        F.coalesce("event_type", F.lit("unknown")).alias("event_type"),
        F.coalesce("request_method", F.lit("GET")).alias("request_method"),
        F.length(path).alias("path_length"),
        F.when(path.contains("?"), 1).otherwise(0).alias("has_query_string"),
        text.count_chars(path, fixed.EVENT_CHARS).alias("suspicious_chars"),
        F.length(agent).alias("ua_length"),
        F.when(text.contains_any(F.lower(agent), ["bot", "crawler", "spider"]), 1).otherwise(0).alias("is_bot"),
        F.coalesce("country_code", F.lit("unknown")).alias("country"),
    )


def prediction_reason(is_bad: Column, confidence: Column, is_anomaly: Column) -> Column:
    """Joined reason of one event; needs the columns of :func:`event_features`."""
    return F.concat_ws(
        " | ",
        F.when(is_bad, F.format_string("El modelo clasifica este tráfico como MALICIOSO con %.1f%% de confianza", confidence * 100)).otherwise(
            F.format_string("El modelo clasifica este tráfico como NORMAL con %.1f%% de confianza", (1 - confidence) * 100)
        ),
        F.when(is_anomaly, F.lit("Detectado como ANOMALÍA (comportamiento inusual)")),
        F.when(F.col("severity_level") >= 3, F.lit("Severidad alta detectada")),
        F.when(F.col("suspicious_chars") > 3,
               F.concat(F.lit("Caracteres sospechosos en URL ("), F.col("suspicious_chars").cast("string"), F.lit(")"))),
        F.when(F.col("is_night") == 1, F.lit("Tráfico nocturno (horario inusual)")),
        F.when(F.col("path_length") > 100, F.concat(F.lit("URL muy larga ("), F.col("path_length").cast("string"), F.lit(" caracteres)"))),
    )


def attack_score(events: DataFrame, latest: int = 100) -> DataFrame:
    """Score per address over its newest events: type points and severity points, at most 100."""
    kind, sev = F.col("event_type"), F.col("severity")
    by_type = text.first_case([(kind.contains(w), p) for w, p in fixed.EVENT_POINTS], 0)
    by_sev = text.first_case([(sev == s, p) for s, p in fixed.EVENT_SEVERITY_POINTS.items()], 0)
    return (
        latest_per_key(events, ["source_ip"], "timestamp", "id", latest)
        .groupBy(F.col("source_ip").alias("ip"))
        .agg(F.least(F.sum(by_type + by_sev), F.lit(100)).cast("bigint").alias("score"))
    )


def reputation(
    events: DataFrame, blocked: DataFrame, flags: DataFrame, owners: DataFrame, places: DataFrame,
    as_of: datetime, blocked_countries: list[str], latest: int = 100,
) -> DataFrame:
    """Local abuse score and reputation (0 to 100, higher is worse) of every address.

    ``flags``: ip, is_whitelisted, is_blacklisted. ``owners``: ip, isp, org. ``places``: ip, country_code.
    """
    recent = latest_per_key(events, ["source_ip"], "timestamp", "id", latest)
    stats = recent.groupBy(F.col("source_ip").alias("ip")).agg(
        F.count("*").alias("total_reports"),
        F.max("timestamp").alias("last_reported"),
        F.count_if(F.col("severity").isin("high", "critical")).alias("high_events"),
        F.count_if(F.col("severity") == "medium").alias("medium_events"),
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("rn") <= 10, F.struct("rn", "event_type")))), lambda e: e["event_type"]
        ).alias("attack_history"),
    )
    now = blocked.filter(active_block(as_of)).select(F.col("ip_address").alias("ip"), F.lit(True).alias("is_currently_blocked")).distinct()
    joined = stats.join(now, "ip", "left").join(flags, "ip", "left").join(owners, "ip", "left").join(places, "ip", "left")
    is_blocked = F.coalesce("is_currently_blocked", F.lit(False))
    local = F.least(F.col("high_events") * 10 + F.col("medium_events") * 3, F.lit(70)) + F.when(is_blocked, 20).otherwise(0)
    banned = F.coalesce(F.col("country_code").isin(blocked_countries), F.lit(False)) if blocked_countries else F.lit(False)
    out = (
        joined.withColumn("is_currently_blocked", is_blocked)
        .withColumn("abuse_score", F.least(local, F.lit(100)).cast("bigint"))
        .withColumn("is_abusive", local > 50)
        .withColumn("is_vpn_proxy", text.is_vpn_or_proxy(F.col("isp"), F.col("org")))
        .withColumn("is_cloud", text.is_cloud_provider(F.col("isp"), F.col("org")))
        .withColumn("is_blocked_country", banned)
        .withColumn("is_whitelisted", F.coalesce("is_whitelisted", F.lit(False)))
        .withColumn("is_blacklisted", F.coalesce("is_blacklisted", F.lit(False)))
    )
    score = (
        F.col("abuse_score") * 0.6 + F.least(F.col("high_events") * 5, F.lit(30))
        + F.when(F.col("is_vpn_proxy"), 10).otherwise(0) + F.when(F.col("is_blocked_country"), 20).otherwise(0)
    )
    return out.withColumn(
        "reputation_score", F.when(F.col("is_blacklisted"), F.lit(100.0)).otherwise(F.least(rounded(score, 4), F.lit(100.0)))
    )


def suspicious_ips(
    events: DataFrame, scores: DataFrame, places: DataFrame, blocked: DataFrame, as_of: datetime,
    hours: float = 24, min_confidence: float = 0.6,
) -> DataFrame:
    """Addresses whose mean event confidence reaches the limit, with behaviour, score and advice.

    ``scores``: id, confidence, is_suspicious, is_anomaly per event. The confidence
    limit is applied before the costly behaviour features, to a mean rounded to
    nine places so that the order of a distributed sum cannot decide. The joined rows and the addresses that pass are written
    once, as several passes read them.
    """
    used = ["id", "source_ip", "timestamp", "severity", "attack_vector", "request_path"]
    rows = in_window(events, as_of, hours).filter(F.col("source_ip").isNotNull()).select(*used).join(scores, "id")
    rows = shared_table(rows, "scored-events")
    first = F.min_by(F.struct("id", "timestamp", "severity", "request_path"), F.struct("timestamp", "id"))
    per_ip = (
        rows.groupBy("source_ip")
        .agg(
            rounded(F.avg("confidence"), 9).alias("ml_confidence"),
            F.count_if("is_suspicious").alias("suspicious_events"),
            F.count_if("is_anomaly").alias("anomaly_events"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
            first.alias("first_event"),
        )
        .filter(F.col("ml_confidence") >= min_confidence)
    )
    per_ip = shared_table(per_ip, "suspects")
    kept = rows.join(per_ip.select("source_ip"), "source_ip", "left_semi")
    now = blocked.filter(active_block(as_of)).select(F.col("ip_address").alias("source_ip"), F.lit(True).alias("is_blocked")).distinct()
    joined = (
        per_ip.join(behavioral_features(kept), "source_ip")
        .join(places.withColumnRenamed("ip", "source_ip"), "source_ip", "left")
        .join(now, "source_ip", "left")
        .withColumn("is_blocked", F.coalesce("is_blocked", F.lit(False)))
        .withColumn("country_code", F.coalesce("country_code", F.lit("XX")))
    )
    fe, path = F.col("first_event"), F.coalesce("first_event.request_path", F.lit("/"))
    hour = F.hour(fe["timestamp"])
    scored = threat_score(joined)
    detailed = (
        scored.withColumn("severity_level", F.coalesce(text.severity_rank(fe["severity"]), F.lit(0)) + 1)
        .withColumn("suspicious_chars", text.count_chars(path, fixed.EVENT_CHARS))
        .withColumn("path_length", F.length(path))
        .withColumn("hour", hour)
        .withColumn("is_night", F.when((hour >= 22) | (hour <= 6), 1).otherwise(0))
    )
    return (
        enhanced_reason(detailed)
        .drop("first_event", "severity_level", "suspicious_chars", "path_length", "hour", "is_night")
        .withColumnRenamed("source_ip", "ip_address")
        .orderBy(F.desc("threat_score"), "ip_address")
    )
