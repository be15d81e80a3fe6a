"""Alert rules: matching, thresholds, messages, cool-down, channels, deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text
from ..functions.times import micros
from .cooldown import with_cooldown

TEXT_FIELDS = ["type", "detection_type", "severity", "ip", "country", "message"]
NUMBER_FIELDS = ["ml_confidence", "confidence"]


def rule_checks(rules: DataFrame) -> DataFrame:
    """Parse each rule's conditions once, before any event is looked at.

    Adds ``checks``: field, operator, raw value, kind (text, list, other) and list items; null when not JSON.
    """
    entries = F.map_entries(F.from_json("conditions", "map<string,string>"))

    def parse(e: Column) -> Column:
        raw = F.get_json_object(e["value"], "$.value")
        kind = text.first_case(
            [(e["value"].rlike(r'"value"\s*:\s*"'), "text"), (e["value"].rlike(r'"value"\s*:\s*\['), "list")], "other"
        )
        return F.struct(
            e["key"].alias("field"),
            F.get_json_object(e["value"], "$.operator").alias("op"),
            raw.alias("raw"),
            kind.alias("kind"),
            F.from_json(raw, "array<string>").alias("items"),
        )

    return rules.withColumn("checks", F.transform(entries, parse))


def conditions_hold(checks: Column, texts: list[str], numbers: list[str]) -> Column:
    """All checks hold for the event in the same row. Comparing text with a number never holds."""
    text_map = F.create_map(*[x for c in texts for x in (F.lit(c), F.col(c))])
    number_map = F.create_map(*[x for c in numbers for x in (F.lit(c), F.col(c).cast("double"))])
    shown_map = F.create_map(*[x for c in numbers for x in (F.lit(c), F.col(c).cast("string"))])

    def holds(c: Column) -> Column:
        s, n = F.try_element_at(text_map, c["field"]), F.try_element_at(number_map, c["field"])
        shown = F.coalesce(s, F.try_element_at(shown_map, c["field"]))
        raw, op, is_text = c["raw"], c["op"], c["kind"] == "text"
        num = F.when(c["kind"] == "other", raw.try_cast("double"))

        def order(sign) -> Column:
            return F.when(s.isNotNull() & is_text, sign(s, raw)).when(n.isNotNull() & num.isNotNull(), sign(n, num)).otherwise(F.lit(False))

        equal = F.when(s.isNotNull(), is_text & (s == raw)).when(n.isNotNull(), F.coalesce(n == num, F.lit(False))).otherwise(raw.isNull())
        truthy = F.coalesce((s != "") | (n != 0), F.lit(False))
        member = F.when(is_text, s.isNotNull() & F.contains(raw, s)).otherwise(
            F.when(s.isNotNull(), F.array_contains(c["items"], s)).otherwise(
                F.exists(c["items"], lambda i: F.coalesce(i.try_cast("double") == n, F.lit(False)))
            )
        )
        member = F.coalesce(member, F.lit(False))
        return text.first_case(
            [
                (op == ">", order(lambda a, b: a > b)),
                (op == "<", order(lambda a, b: a < b)),
                (op == ">=", order(lambda a, b: a >= b)),
                (op == "<=", order(lambda a, b: a <= b)),
                (op == "==", equal),
                (op == "!=", ~equal),
                (op == "in", truthy & member),
                (op == "not_in", ~(truthy & member)),
                (op == "contains", truthy & is_text & F.coalesce(F.contains(shown, raw), F.lit(False))),
            ],
            False,
        )

    return F.coalesce(F.forall(checks, holds), F.lit(False))


def rule_type(event_type: Column) -> Column:
    return F.when(event_type.isin(fixed.RULE_TYPES), event_type).otherwise("custom")


def level(severity: Column) -> Column:
    return text.first_case([(severity == s, i) for i, s in enumerate(fixed.ALERT_LEVELS)])


def threshold_met(severity: Column, threshold: Column) -> Column:
    """No threshold always passes; an unknown level on either side never does."""
    known = F.coalesce(level(F.coalesce(severity, F.lit("LOW"))) >= level(threshold), F.lit(False))
    return threshold.isNull() | (threshold == "") | known


def match_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events with each enabled rule of their type whose conditions hold.

    An equality join on the rule type; the rules are small, so Spark sends
    them to the events when their size allows it.
    """
    body = F.col("message_template") if "message_template" in rules.columns else F.lit(None).cast("string")
    active = rule_checks(rules.filter("is_enabled")).select(
        F.col("id").alias("rule_id"), "rule_name", "rule_type", "checks", "severity_threshold", "channel_ids",
        "cooldown_minutes", "subject_template", body.alias("message_template"),
    )
    typed = events.withColumn("rule_type", rule_type(F.col("type")))
    return typed.join(active, "rule_type").filter(conditions_hold(F.col("checks"), TEXT_FIELDS, NUMBER_FIELDS)).drop("checks")


def render(template: Column, fields: list[str], kind: str = "type", details: str = "message") -> Column:
    """Fill ``{{ field }}`` marks from the row; without a template a default line."""
    out = F.regexp_replace(template, r"\{\{\s*(\w+)\s*\}\}", "{{$1}}")
    for f in fields:
        out = F.replace(out, F.lit("{{" + f + "}}"), F.coalesce(F.col(f).cast("string"), F.lit("None")))
    out = F.regexp_replace(out, r"\{\{\w+\}\}", "")
    default = F.concat(
        F.lit("Alert: "), F.coalesce(F.col(kind), F.lit("Unknown")), F.lit(" - "), F.coalesce(F.col(details), F.lit("No details"))
    )
    return F.when(template.isNull() | (template == ""), default).otherwise(out)


def triggered(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule hits after conditions, severity threshold and cool-down."""
    hits = match_rules(events, rules).filter(threshold_met(F.col("severity"), F.col("severity_threshold")))
    timed = hits.withColumn("_us", micros("timestamp")).withColumn("_cd", F.col("cooldown_minutes").cast("bigint") * 60_000_000)
    return with_cooldown(timed, "rule_id", "_us", "_cd", "id").drop("_us", "_cd")


def channel_fanout(hits: DataFrame, channels: DataFrame) -> DataFrame:
    """One row per hit and enabled channel of its rule."""
    enabled = channels.filter("is_enabled").select(F.col("id").alias("channel_id"), "channel_name", "channel_type", "recipients")
    ids = F.explode(F.from_json("channel_ids", "array<bigint>"))
    return hits.withColumn("channel_id", ids).join(enabled, "channel_id")


def deliveries(events: DataFrame, rules: DataFrame, channels: DataFrame) -> DataFrame:
    """Delivery log of a batch of events: rules, threshold, cool-down, channels."""
    return log_deliveries(triggered(events, rules), channels)


def log_deliveries(hits: DataFrame, channels: DataFrame) -> DataFrame:
    """Mail with recipients succeeds; other channel types are logged as failed.

    Subject and message are the rule's templates filled from the event, the metadata is the event as JSON. As nothing is sent, a
    delivery takes no time.
    """
    rows = channel_fanout(hits, channels)
    mail = F.col("channel_type") == "email"
    error = text.first_case([(~mail, "Channel type not supported"), (F.coalesce("recipients", F.lit(0)) == 0, "No recipients configured")])
    return rows.select(
        "rule_id", "rule_name", "channel_id", F.col("id").alias("event_id"), "timestamp",
        F.coalesce("severity", F.lit("MEDIUM")).alias("severity"),
        render(F.col("subject_template"), TEXT_FIELDS + NUMBER_FIELDS).alias("subject"),
        render(F.col("message_template"), TEXT_FIELDS + NUMBER_FIELDS).alias("message"),
        F.to_json(F.struct("id", *TEXT_FIELDS, *NUMBER_FIELDS), {"ignoreNullFields": "false"}).alias("event_metadata"),
        error.isNull().alias("success"), F.coalesce(error, F.lit("")).alias("error_message"), F.lit(0).cast("bigint").alias("send_duration_ms"),
    )


def ban_events(bans: DataFrame) -> DataFrame:
    """Alerts of banned addresses (ip, jail, timestamp, severity, reason) as events for the rules."""
    return bans.select(
        F.abs(F.xxhash64("ip", "timestamp")).alias("id"), "timestamp", F.lit("fail2ban_ban").alias("type"), F.lit("fail2ban_ban").alias("detection_type"),
        "severity", "ip", F.lit(None).cast("double").alias("ml_confidence"), F.lit(None).cast("bigint").alias("confidence"),
        F.lit(None).cast("string").alias("country"), F.col("reason").alias("message"))


def trigger_counters(hits: DataFrame, channels: DataFrame) -> DataFrame:
    """Per rule its hits, with or without a channel, the last of them, and good and failed deliveries, in one pass over the hits."""
    enabled = channels.filter("is_enabled").select(F.col("id").alias("channel_id"), "channel_type", "recipients")
    wide = hits.select("rule_id", "rule_name", "timestamp", F.posexplode_outer(F.from_json("channel_ids", "array<bigint>")).alias("_place", "channel_id"))
    rows = wide.join(enabled, "channel_id", "left")
    good = (F.col("channel_type") == "email") & (F.coalesce("recipients", F.lit(0)) > 0)
    return rows.groupBy("rule_id", "rule_name").agg(
        F.count_if(F.coalesce(F.col("_place"), F.lit(0)) == 0).alias("total_triggers"), F.max("timestamp").alias("last_triggered_at"),
        F.count_if(F.coalesce(good, F.lit(False))).alias("total_alerts_sent"),
        F.count_if(F.col("channel_type").isNotNull() & ~good).alias("failed_sends"))


def delivery_counters(rows: DataFrame, by: str) -> DataFrame:
    """Sent, good and failed deliveries per rule or channel, and the last good time; a rule's total counts good ones only."""
    total = F.count_if("success") if by == "rule_id" else F.count("*")
    return rows.groupBy(by).agg(
        total.alias("total_alerts_sent"), F.count_if("success").alias("successful_sends"),
        F.count_if(~F.col("success")).alias("failed_sends"), F.max(F.when(F.col("success"), F.col("timestamp"))).alias("last_alert_sent_at"),
    )
