"""Column expressions over request text, agents, domains and certificates.

All of them stay inside Catalyst: no Python runs per row.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed
from .numbers import rounded


def any_of(patterns: list[str], flags: str = "(?i)") -> str:
    """One alternation, so that a class costs one regex pass; no flags for text already in lower case."""
    return flags + "|".join(f"(?:{p})" for p in patterns)


def once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add a costly column that later filters and projections read instead of recomputing.

    The optimizer copies column definitions into pushed-down filters; it does not
    copy through a generator.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def lower_agent(agent: Column) -> Column:
    return F.lower(F.coalesce(agent, F.lit("")))


def first_case(branches: list[tuple[Column, object]], default: object = None) -> Column:
    """Ordered CASE: the first true branch gives the value."""
    expr = None
    for cond, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return expr.otherwise(default)


def shannon_entropy(text: Column) -> Column:
    """Base-2 character entropy rounded to two places; empty or null text is 0."""
    q = F.coalesce(text, F.lit(""))
    n = F.length(q).cast("double")
    chars = F.filter(F.array_distinct(F.split(q, "")), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        p = (F.length(q) - F.length(F.replace(q, c, F.lit("")))) / n
        return acc - p * F.log2(p)

    return rounded(F.aggregate(chars, F.lit(0.0), step), 2)


def attack_types(path: Column, agent: Column) -> Column:
    """Attack classes whose patterns occur in "path agent", in fixed order."""
    text = F.lower(F.concat(F.coalesce(path, F.lit("")), F.lit(" "), F.coalesce(agent, F.lit(""))))
    flags = [F.when(text.rlike(any_of(pats, "")), F.lit(name)) for name, pats in fixed.ATTACK_CLASSES.items()]
    return F.array_compact(F.array(*flags))


def attack_severity(status: Column, types: Column, failures: Column | None = None) -> Column:
    """Severity ladder: class of attack, then failure count, then HTTP status."""
    branches = [
        (F.arrays_overlap(types, F.array(F.lit("command_injection"), F.lit("exploit"))), "critical"),
        (F.arrays_overlap(types, F.array(*map(F.lit, ["sql_injection", "path_traversal", "xss", "scanner"]))), "high"),
    ]
    if failures is not None:
        branches += [(failures >= 10, "critical"), (failures >= 5, "high"), (failures >= 3, "medium")]
    branches += [(status >= 500, "medium"), (status == 404, "low"), (status >= 400, "medium")]
    return first_case(branches, "low")


def failure_severity(failures: Column) -> Column:
    """The failure-count part of :func:`attack_severity`."""
    return first_case([(failures >= 10, "critical"), (failures >= 5, "high"), (failures >= 3, "medium")], "low")


SIGNATURES = {
    "sql_injection": fixed.SQLI_SIGNATURES,
    "xss": fixed.XSS_SIGNATURES,
    "path_traversal": fixed.TRAVERSAL_SIGNATURES,
    "command_injection": fixed.COMMAND_SIGNATURES,
}


def signature_detail(text: Column, kind: str) -> Column:
    """Message naming the first signature of ``kind`` found in the text, else null."""
    label = fixed.SIGNATURE_LABELS[kind]
    return first_case([(text.rlike("(?i)" + p), label + p[:50]) for p in SIGNATURES[kind]])


def malicious_agent(agent: Column) -> Column:
    """Message for a hacking tool or a suspicious, not trusted agent, else null."""
    ua = lower_agent(agent)
    trusted = contains_any(ua, fixed.TRUSTED_CRAWLERS)
    branches = [(ua.contains(w), f"Malicious tool detected: {w}") for w in fixed.HACK_TOOLS]
    branches += [(ua.contains(w) & ~trusted, f"Suspicious user agent: {w}") for w in fixed.SUSPICIOUS_AGENTS]
    return first_case(branches)


def agent_score(agent: Column) -> Column:
    """+20 per bot word, +10 when shorter than 20, +15 without a browser name."""
    ua = F.coalesce(agent, F.lit(""))
    score = F.lit(0)
    for word in fixed.BOT_PATTERNS:
        score = score + F.when(F.lower(ua).contains(word), 20).otherwise(0)
    score = score + F.when(F.length(ua) < 20, 10).otherwise(0)
    browser = ua.contains("Mozilla") | ua.contains("Chrome") | ua.contains("Safari")
    return (score + F.when(~browser, 15).otherwise(0)).cast("int")


def is_legitimate_bot(agent: Column) -> Column:
    return contains_any(lower_agent(agent), fixed.LEGITIMATE_BOTS)


def has_bot_word(agent: Column) -> Column:
    return contains_any(lower_agent(agent), fixed.BOT_PATTERNS)


def bot_class(agent: Column, rapid: Column) -> Column:
    """Class of a bot from its first agent, then from its request rate."""
    ua = lower_agent(agent)
    branches = [(ua.contains(w), name) for w, name in fixed.BOT_CLASSES.items()]
    branches += [
        (contains_any(ua, fixed.SCRAPER_TOOLS), "Web Scraper"),
        (contains_any(ua, fixed.HTTP_CLIENTS), "HTTP Client Tool"),
        (rapid, "Aggressive Scraper"),
    ]
    return first_case(branches, "Unknown Bot")


def is_known_domain(domain: Column) -> Column:
    names = "|".join(re.escape(d).replace("\\-", "-") for d in fixed.KNOWN_DOMAINS)
    return F.coalesce(F.lower(domain).rlike(names), F.lit(False))


def is_self_signed(subject: Column, issuer: Column) -> Column:
    return F.coalesce(subject == issuer, F.lit(False))


def is_expired(not_after: Column, as_of: Column) -> Column:
    return F.coalesce(not_after < as_of, F.lit(False))


def is_weak_tls(version: Column) -> Column:
    return F.coalesce(version.rlike(fixed.WEAK_TLS), F.lit(False))


def notice_severity(note: Column) -> Column:
    note = F.coalesce(note, F.lit(""))
    return first_case([(contains_any(note, words), sev) for sev, words in fixed.NOTICE_LADDER], "medium")


def http_log_suspicious(uri: Column, agent: Column) -> Column:
    marks = contains_any(F.coalesce(uri, F.lit("")), fixed.HTTP_LOG_MARKS)
    return marks | contains_any(lower_agent(agent), ["nikto", "sqlmap"])


def suspicious_path(path: Column) -> Column:
    return path.rlike(any_of(fixed.SUSPICIOUS_PATHS))


def path_class(path: Column) -> Column:
    return first_case([(path.rlike("(?i)" + p), name) for p, name in fixed.PATH_CLASSES])


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def is_private_ip(ip: Column) -> Column:
    return reduce(lambda a, b: a | b, [ip.startswith(p) for p in fixed.PRIVATE_PREFIXES])


def owner_has_word(isp: Column, org: Column, words: list[str]) -> Column:
    return contains_any(F.lower(F.coalesce(isp, F.lit(""))), words) | contains_any(
        F.lower(F.coalesce(org, F.lit(""))), words
    )


def is_vpn_or_proxy(isp: Column, org: Column) -> Column:
    return owner_has_word(isp, org, fixed.VPN_WORDS)


def is_cloud_provider(isp: Column, org: Column) -> Column:
    return owner_has_word(isp, org, fixed.CLOUD_WORDS)


def event_source(event_type: Column) -> Column:
    """Which detector an event comes from: ml, zeek, fail2ban or other."""
    t = F.lower(event_type)
    return first_case(
        [
            (t.contains("ml_") | (t == "suspicious_traffic"), "ml"),
            (contains_any(t, fixed.MONITOR_TYPES), "zeek"),
            (t.contains("ban") | t.contains("blocked"), "fail2ban"),
        ],
        "other",
    )


def port_service(port: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.PORT_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, port), F.lit("Unknown"))


def port_warnings(port: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(port.isin(fixed.INSECURE_PORTS), F.lit("This port is considered insecure")),
            F.when(port.isin(fixed.DATABASE_PORTS), F.lit("Database port - should not be exposed publicly")),
        )
    )


def severity_rank(severity: Column) -> Column:
    """low 0 .. critical 3; unknown values are null."""
    return first_case([(severity == s, i) for i, s in enumerate(fixed.SEVERITIES)])


def severity_name(rank: Column) -> Column:
    return first_case([(rank == i, s) for i, s in enumerate(fixed.SEVERITIES)])


def score_severity(score: Column) -> Column:
    return first_case([(score >= 90, "critical"), (score >= 70, "high"), (score >= 50, "medium")], "low")


def geo_json(country: Column, code: Column, city: Column) -> Column:
    return F.to_json(
        F.struct(
            country.alias("country"),
            code.alias("country_code"),
            city.alias("city"),
            F.lit(0).alias("latitude"),
            F.lit(0).alias("longitude"),
        )
    )


def parse_geo(geo: Column) -> Column:
    return F.from_json(geo, "country string, country_code string, city string")
