"""Who is blocked or listed, and decisions about blocking."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text

from .events import active_block


def active_ips(blocked: DataFrame, as_of: datetime) -> DataFrame:
    """Distinct addresses blocked at ``as_of``."""
    return blocked.filter(active_block(as_of)).select(F.col("ip_address").alias("ip")).distinct()


def listed_ips(lists: DataFrame, which: str) -> DataFrame:
    """Distinct addresses on the active whitelist or blacklist."""
    return lists.filter((F.col("list") == which) & F.col("is_active")).select(F.col("ip_address").alias("ip")).distinct()


def auto_block_decision(predictions: DataFrame, blocked: DataFrame, whitelist: DataFrame, policy: dict | None) -> DataFrame:
    """Decide per prediction: the first failing condition gives the reason, else block.

    Needs ip_address, ml_confidence (percent), threat_score, severity,
    event_count, zeek_detections, f2b_bans. ``blocked`` and ``whitelist``: distinct ip.
    """
    words = fixed.BLOCK_REASONS
    rows = (
        predictions.join(blocked.select(F.col("ip").alias("ip_address"), F.lit(True).alias("_b")), "ip_address", "left")
        .join(whitelist.select(F.col("ip").alias("ip_address"), F.lit(True).alias("_w")), "ip_address", "left")
    )
    already, white = F.col("_b").isNotNull(), F.col("_w").isNotNull()
    if not policy or not policy.get("enabled", True):
        cases = [(already, words["blocked"]), (white, words["whitelist"])]
        reason, block = text.first_case(cases, words["disabled"]), F.lit(False)
    else:
        conf, score, sev, n = F.col("ml_confidence"), F.col("threat_score"), F.col("severity"), F.col("event_count")
        level = F.coalesce(text.severity_rank(sev), F.lit(0))
        least = fixed.SEVERITIES.index(policy["min_severity"])
        sources = sum((F.when(F.coalesce(F.col(c) > 0, F.lit(False)), 1).otherwise(0) for c in ("ml_confidence", "zeek_detections", "f2b_bans")), F.lit(0))

        def why(head: str, value: Column, limit: object, unit: str = "") -> Column:
            return F.concat(F.lit(f"{head} ("), value.cast("string"), F.lit(f"{unit} < {limit}{unit})"))

        cases = [(already, F.lit(words["blocked"]))]
        if policy.get("whitelist_enabled", True):
            cases.append((white, F.lit(words["whitelist"])))
        if policy.get("exclude_internal_ips", False):
            cases.append((text.is_private_ip(F.col("ip_address")), F.lit(words["internal"])))
        cases += [
            (conf < policy["min_ml_confidence"], why("Confianza ML insuficiente", conf, policy["min_ml_confidence"], "%")),
            (score < policy["min_threat_score"], why("Threat score insuficiente", score, policy["min_threat_score"])),
            (level < least, why("Severidad insuficiente", sev, policy["min_severity"])),
            (n < policy["min_events"], why("Eventos insuficientes", n, policy["min_events"])),
        ]
        if policy.get("require_multiple_sources", True):
            cases.append((sources < 2, F.concat(F.lit("Solo detectado por "), sources.cast("string"), F.lit(" fuente(s), se requieren 2+"))))
        block = text.first_case([(c, False) for c, _ in cases], True)
        taken = F.concat(
            F.lit("Auto-bloqueado: ML="), F.format_string("%.1f", conf), F.lit("%, ThreatScore="), score.cast("string"),
            F.lit(", Severity="), sev, F.lit(", Events="), n.cast("string"),
        )
        reason = text.first_case(cases, taken)
    return rows.withColumn("should_block", block).withColumn("reason", reason).drop("_b", "_w")


def decision_summary(decisions: DataFrame) -> DataFrame:
    """Counts of one run: evaluated, blocked, already blocked, whitelisted, insufficient."""
    block, why = F.col("should_block"), F.col("reason")
    old, white = why == fixed.BLOCK_REASONS["blocked"], why == fixed.BLOCK_REASONS["whitelist"]
    return decisions.agg(
        F.count("*").alias("evaluated"),
        F.count_if(block).alias("blocked"),
        F.count_if(~block).alias("skipped"),
        F.count_if(old).alias("already_blocked"),
        F.count_if(white).alias("whitelisted"),
        F.count_if(~block & ~old & ~white).alias("insufficient_criteria"),
    )


def decisions_to_requests(decisions: DataFrame, policy: dict, at: Column) -> DataFrame:
    """Applying a run: its blocks as requests for :func:`upsert_blocks`."""
    hours = F.lit(None) if policy["permanent_block"] else F.lit(policy["default_block_duration"])
    return decisions.filter("should_block").select(
        "ip_address", "reason", F.col("severity").alias("threat_level"), hours.cast("int").alias("duration_hours"),
        F.lit("auto_blocker").alias("blocked_by"), at.alias("asked_at"), F.lit(0).cast("bigint").alias("id"),
    )


def upsert_blocks(snapshot: DataFrame, requests: DataFrame) -> DataFrame:
    """Fold block requests into the block list; the newest request of an address decides.

    A duration of null, zero or less is permanent. One aggregation over the
    requests, then one join with the list.
    """
    order = F.struct("asked_at", "id")
    last = requests.groupBy("ip_address").agg(
        F.count("*").alias("_n"),
        F.max_by(F.struct("reason", "threat_level", "duration_hours", "asked_at"), order).alias("new"),
        F.min_by("blocked_by", order).alias("_by"),
    )
    hours = F.col("new.duration_hours")
    permanent = hours.isNull() | (hours <= 0)
    expiry = F.when(~permanent, F.col("new.asked_at") + F.make_dt_interval(hours=hours))
    changed = F.col("_n").isNotNull()

    def pick(new: Column, old: str) -> Column:
        return F.when(changed, new).otherwise(F.col(old)).alias(old)

    return snapshot.join(last, "ip_address", "full").select(
        "ip_address",
        F.coalesce("blocked_by", "_by").alias("blocked_by"),
        pick(F.col("new.reason"), "reason"),
        pick(F.col("new.threat_level"), "threat_level"),
        pick(permanent, "is_permanent"),
        pick(expiry, "unblock_time"),
        pick(F.col("new.asked_at"), "last_blocked"),
        (F.coalesce("total_attacks", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("bigint").alias("total_attacks"),
    )


def should_auto_block(df: DataFrame, threshold: int = 10) -> DataFrame:
    """Verdict from list flags, the severity at hand and the attack score.

    Needs is_whitelisted, is_blacklisted, severity, score.
    """
    sev, score = F.col("severity"), F.col("score")
    s = score.cast("string")
    cases = [
        (F.col("is_whitelisted"), False, F.lit("IP is whitelisted")),
        (F.col("is_blacklisted"), True, F.lit("IP is blacklisted")),
        (sev == "critical", True, F.concat(F.lit("Critical threat detected (score: "), s, F.lit(")"))),
        ((sev == "high") & (score >= threshold), True,
         F.concat(F.lit("High threat with score "), s, F.lit(f" >= threshold {threshold}"))),
        (score >= threshold * 2, True, F.concat(F.lit("Threat score "), s, F.lit(" exceeds auto-block threshold"))),
    ]
    below = F.concat(F.lit("Below threshold (score: "), s, F.lit(f", threshold: {threshold})"))
    return df.withColumn("should_block", text.first_case([(c, v) for c, v, _ in cases], False)).withColumn(
        "reason", text.first_case([(c, r) for c, _, r in cases], below)
    )
