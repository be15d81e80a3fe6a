"""Reports and detections over parsed web requests, login attempts and bans."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, text
from ..functions.numbers import rounded
from ..functions.times import micros
from .intervals import spread


def top_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; ties by value."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
        .limit(n)
    )


def section(df: DataFrame, name: str, key: str | Column, n: str = "n") -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return df.select(F.lit(name).alias("section"), key.cast("string").alias("key"), F.col(n).alias("n"))


def ssh_summary(logins: DataFrame) -> DataFrame:
    status = F.col("status")
    totals = logins.groupBy().agg(
        F.count("*").alias("total"), F.count_if(status == "failed").alias("failed"), F.count_if(status == "success").alias("successful")
    )
    lines = totals.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("key"), F.col(k).alias("n")) for k in ("total", "failed", "successful")
    ])).alias("x")).select("x.*")
    ips = top_counts(logins.filter(status == "failed"), "ip", 10)
    users = top_counts(logins.filter(status.isin("failed", "invalid_user")), "user", 10)
    return section(lines, "attempts", "key").unionByName(section(ips, "attacking_ip", "ip")).unionByName(
        section(users, "attempted_user", "user")
    )


def web_summary(requests: DataFrame) -> DataFrame:
    totals = requests.agg(
        F.count("*").alias("total_requests"),
        F.countDistinct("ip").alias("unique_ips"),
        F.count_if(text.path_class(F.col("path")).isNotNull()).alias("suspicious_requests"),
    )
    lines = totals.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("key"), F.col(k).alias("n")) for k in totals.columns
    ])).alias("x")).select("x.*")
    codes = requests.groupBy("status").agg(F.count("*").alias("n"))
    return (
        section(lines, "totals", "key")
        .unionByName(section(codes, "status", "status"))
        .unionByName(section(top_counts(requests, "ip", 10), "top_ip", "ip"))
    )


def finding(df: DataFrame, kind: Column | str, severity: Column, ip: Column, n: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(
        kind.alias("type"), severity.alias("severity"), ip.alias("ip"), n.cast("bigint").alias("count")
    )


def ssh_bruteforce(logins: DataFrame) -> DataFrame:
    """Among the 20 leading failing addresses those with more than 10 failures."""
    top = top_counts(logins.filter(F.col("status") == "failed"), "ip", 20).filter("n > 10")
    return finding(top, "ssh_bruteforce", F.when(F.col("n") > 50, "high").otherwise("medium"), F.col("ip"), F.col("n"))


def scraping(requests: DataFrame) -> DataFrame:
    top = top_counts(requests, "ip", 20).filter("n > 100")
    return finding(top, "possible_scraping", F.when(F.col("n") > 500, "high").otherwise("medium"), F.col("ip"), F.col("n"))


def suspicious_paths(requests: DataFrame) -> DataFrame:
    classes = (
        requests.withColumn("cls", text.path_class(F.col("path")))
        .filter(F.col("cls").isNotNull())
        .groupBy("cls")
        .agg(F.count("*").alias("n"))
        .filter("n > 5")
    )
    return finding(
        classes, F.col("cls"), F.when(F.col("n") > 20, "high").otherwise("medium"), F.lit(None).cast("string"), F.col("n")
    )


def tried_users(logins: DataFrame) -> DataFrame:
    """Failures per address and user name."""
    failed = logins.filter((F.col("status") == "failed") & F.col("ip").isNotNull())
    return failed.groupBy("ip", F.coalesce("user", F.lit("unknown")).alias("user")).agg(F.count("*").alias("tries"))


def brute_force_totals(logins: DataFrame, threshold: int = 10) -> DataFrame:
    """Addresses with many failures, and how many names they tried."""
    per_ip = tried_users(logins).groupBy("ip").agg(F.sum("tries").alias("attempts"), F.count("*").alias("user_count"))
    return per_ip.filter(F.col("attempts") >= threshold)


def brute_force_ips(logins: DataFrame, threshold: int = 10) -> DataFrame:
    """A row per name tried by an address with many failures; a spray of names is no longer one value."""
    return tried_users(logins).join(brute_force_totals(logins, threshold), "ip").select("ip", "attempts", "user", "tries")


def heavy_importers(requests: DataFrame) -> DataFrame:
    attack = F.size(text.attack_types(F.col("path"), F.col("user_agent"))) > 0
    return (
        requests.groupBy("ip")
        .agg(F.count("*").alias("requests"), F.count_if(attack).alias("attacks"))
        .filter((F.col("requests") > 100) | (F.col("attacks") > 5))
    )


def failing_importers(attempts: DataFrame, threshold: int = 5) -> DataFrame:
    return (
        attempts.filter(F.col("kind") == "failed").groupBy("ip").agg(F.count("*").alias("failed_attempts"))
        .filter(F.col("failed_attempts") >= threshold)
    )


def repeat_offenders(bans: DataFrame, more_than: int = 1) -> DataFrame:
    """Addresses with several bans and their jails, listed from counts per (address, jail)."""
    per_jail = bans.filter(F.col("kind") == "ban").groupBy("ip", "jail").agg(F.count("*").alias("n"))
    return (
        per_jail.groupBy("ip")
        .agg(F.sum("n").alias("bans"), F.sort_array(F.collect_list("jail")).alias("jails"))
        .filter(F.col("bans") > more_than)
    )


def offender_blocks(attempts: DataFrame, bans: DataFrame) -> DataFrame:
    """Block requests for brute force (48 h) and repeated bans (72 h)."""
    brute = failing_importers(attempts, 10).select(
        F.col("ip").alias("ip_address"),
        F.concat(F.lit("Auto-bloqueado: "), F.col("failed_attempts").cast("string"),
                 F.lit(" intentos SSH fallidos (detectado en logs históricos)")).alias("reason"),
        F.lit("ml_auto").alias("blocked_by"),
        F.lit(48).alias("duration_hours"),
    )
    again = repeat_offenders(bans, 2).select(
        F.col("ip").alias("ip_address"),
        F.concat(F.lit("Auto-bloqueado: "), F.col("bans").cast("string"), F.lit(" bans por Fail2ban en jails: "),
                 F.array_join(F.slice("jails", 1, 3), ", ")).alias("reason"),
        F.lit("ml_auto").alias("blocked_by"),
        F.lit(72).alias("duration_hours"),
    )
    return brute.unionByName(again)


def family_hits() -> dict[str, Column]:
    """Per path family the number of its patterns in a request."""
    path = F.lower("path")
    return {
        name: reduce(lambda a, b: a + b, [F.when(path.contains(p), 1).otherwise(0) for p in patterns])
        for name, patterns in fixed.VULN_FAMILIES.items()
    }


def family_verdict() -> tuple[Column, Column, Column]:
    """(attempts, families, severity) from summed family hits; severity is null below the limits."""
    names = list(fixed.VULN_FAMILIES)
    total = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    kinds = F.sort_array(F.array_compact(F.array(*[F.when(F.col(n) > 0, F.lit(n)) for n in names])))
    many = reduce(lambda a, b: a + b, [F.when(F.col(n) > 0, 1).otherwise(0) for n in names]) >= 3
    return total, kinds, F.when(many, "high").when(total >= 5, "medium")


def vulnerability_scans(requests: DataFrame) -> DataFrame:
    """Addresses probing several path families; one hit per (request, pattern)."""
    hits = family_hits()
    per_ip = requests.select("ip", *[c.alias(n) for n, c in hits.items()]).groupBy("ip").agg(*[F.sum(n).alias(n) for n in hits])
    total, kinds, severity = family_verdict()
    return per_ip.select("ip", total.alias("attempt_count"), kinds.alias("scan_types"), severity.alias("severity")).filter(
        F.col("severity").isNotNull()
    )


def pattern_attempts(requests: DataFrame, patterns: list[str], examples: int = 5) -> DataFrame:
    """Per address: hits per (request, pattern) and the first few as examples."""
    path = F.col("path")
    found = F.array_compact(
        F.array(*[F.when(path.rlike("(?i)" + p), F.struct(F.lit(i).alias("i"), F.lit(p).alias("pattern"))) for i, p in enumerate(patterns)])
    )
    hits = (
        requests.filter(path.rlike(text.any_of(patterns)))
        .select("ip", "timestamp", "id", "path", F.explode(found).alias("hit"))
    )
    counts = hits.groupBy("ip").agg(F.count("*").alias("attempts"))
    first = Window.partitionBy("ip").orderBy("timestamp", "id", "hit.i")
    shown = (
        hits.withColumn("rn", F.row_number().over(first))
        .filter(F.col("rn") <= examples)
        .groupBy("ip")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "path", F.col("hit.pattern").alias("pattern")))).alias("x"))
        .select("ip", F.transform("x", lambda e: F.concat(e["path"], F.lit(" ~ "), e["pattern"])).alias("examples"))
    )
    return counts.join(shown, "ip").withColumn("severity", F.lit("high"))


def bot_flags() -> dict[str, Column]:
    """Per request what the bot score looks at."""
    agent, path = F.coalesce("user_agent", F.lit("")), F.lower(F.coalesce("path", F.lit("")))
    return {
        "bot_agent": text.has_bot_word(agent),
        "no_referrer": F.coalesce("referrer", F.lit("")).isin("-", ""),
        "numbered": path.rlike(r"/\d+"),
        "listed": text.contains_any(path, fixed.LISTED_FILES),
    }


def bot_sums() -> list[Column]:
    agent = F.coalesce("user_agent", F.lit(""))
    return [
        F.count("*").alias("request_count"),
        *[F.count_if(c).alias(n) for n, c in bot_flags().items()],
        (F.min(agent) == F.max(agent)).alias("one_agent"),
        F.min_by(agent, F.struct("timestamp", "id")).alias("user_agent"),
    ]


def bot_score() -> Column:
    n = F.col("request_count")
    return (
        F.col("bot_agent") * 30
        + F.when(n > 100, 25).otherwise(0)
        + F.when(F.col("no_referrer") / n > 0.8, 20).otherwise(0)
        + F.when(F.col("numbered") > 20, 15).otherwise(0)
        + F.when(F.col("one_agent") & (n > 10), 10).otherwise(0)
        + F.col("listed") * 5
    ).cast("bigint")


def first_word_bit(value: Column, words: list[str]) -> Column:
    """A bit for the first of ``words`` that ``value`` contains, 0 for none."""
    return text.first_case([(value.contains(w), 1 << i) for i, w in enumerate(words)], 0).cast("bigint")


def bot_reasons() -> Column:
    """Why an address has its score: each reason once, in the order of the rules; ``agent_words`` and ``file_words`` are bit sets."""
    words, n = fixed.BOT_REASONS, F.col("request_count")
    ratio = F.col("no_referrer") / n
    named = lambda bits, key, names: [
        (F.col(bits).bitwiseAND(F.lit(1 << i)) != 0, F.lit(words[key] + name)) for i, name in enumerate(names)]
    counted = lambda key, column: F.concat(F.lit(words[key]), F.col(column).cast("string"))
    items = [
        *named("agent_words", "agent", fixed.BOT_PATTERNS), (n > 100, counted("rapid", "request_count")),
        (ratio > 0.8, F.concat(F.lit(words["referrer"]), F.format_string("%.2f%%", rounded(ratio * 100, 2)))),
        (F.col("numbered") > 20, counted("numbered", "numbered")), (F.col("one_agent") & (n > 10), F.lit(words["one_agent"])),
        *named("file_words", "listed", fixed.LISTED_FILES),
    ]
    return F.array_compact(F.array(*[F.when(cond, what) for cond, what in items]))


def bot_scores(requests: DataFrame) -> DataFrame:
    """Bot score per address with its reasons; kept from 30, high from 60."""
    agent, path = text.lower_agent(F.coalesce("user_agent", F.lit(""))), F.lower(F.coalesce("path", F.lit("")))
    stats = requests.filter(F.col("ip").isNotNull()).groupBy("ip").agg(
        *bot_sums(), F.bit_or(first_word_bit(agent, fixed.BOT_PATTERNS)).alias("agent_words"),
        F.bit_or(first_word_bit(path, fixed.LISTED_FILES)).alias("file_words"))
    return (
        stats.withColumn("score", bot_score())
        .filter(F.col("score") >= 30)
        .select(
            "ip", "score", text.bot_class(F.col("user_agent"), F.col("request_count") > 100).alias("type"), "request_count", "user_agent",
            F.when(F.col("score") >= 60, "high").otherwise("medium").alias("severity"), bot_reasons().alias("reasons"),
        )
    )


def first_agents(requests: DataFrame) -> DataFrame:
    return requests.groupBy("ip").agg(F.min_by("user_agent", F.struct("timestamp", "id")).alias("user_agent"))


def pattern_count(patterns: list[str]) -> Column:
    """Number of patterns found in a path; the patterns are tried only when one of them occurs."""
    path = F.col("path")
    each = reduce(lambda a, b: a + b, [F.when(path.rlike("(?i)" + p), 1).otherwise(0) for p in patterns])
    return F.when(path.rlike(text.any_of(patterns)), each).otherwise(0)


def request_findings(requests: DataFrame) -> DataFrame:
    """Path classes, bots, vulnerability scans, SQL injection and XSS from one pass over the requests.

    Grouping sets by address and by path class share the scan and the shuffle.
    """
    families = family_hits()
    marked = text.once(
        requests, "m",
        F.struct(
            text.path_class(F.col("path")).alias("cls"), pattern_count(fixed.SQLI_PATTERNS).alias("sqli"),
            pattern_count(fixed.XSS_PATTERNS).alias("xss"), *[c.alias(n) for n, c in families.items()],
        ),
    ).select("ip", "path", "user_agent", "referrer", "timestamp", "id", "m.*")
    sets = marked.groupingSets([("ip",), ("cls",)], "ip", "cls").agg(
        F.grouping_id().alias("gid"), *bot_sums(), *[F.sum(n).alias(n) for n in ("sqli", "xss", *families)]
    )
    by_ip, by_class = (F.col("gid") == 1) & F.col("ip").isNotNull(), (F.col("gid") == 2) & F.col("cls").isNotNull()
    n, score = F.col("request_count"), bot_score()
    kind = text.bot_class(F.col("user_agent"), n > 100)
    wanted = (score >= 60) & ~kind.startswith("Search Engine") & ~kind.startswith("Social Media")
    probes, _, probe_severity = family_verdict()

    def item(cond: Column, name: Column | str, severity: Column | str, count: Column) -> Column:
        as_col = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.when(cond, F.struct(as_col(name).alias("type"), as_col(severity).alias("severity"), count.cast("bigint").alias("count")))

    found = F.array_compact(F.array(
        item(by_class & (n > 5), F.col("cls"), F.when(n > 20, "high").otherwise("medium"), n),
        item(by_ip & wanted, "malicious_bot", "high", n),
        item(by_ip & probe_severity.isNotNull(), "vulnerability_scan", probe_severity, probes),
        item(by_ip & (F.col("sqli") > 0), "sql_injection_attempt", "high", F.col("sqli")),
        item(by_ip & (F.col("xss") > 0), "xss_attempt", "high", F.col("xss")),
    ))
    return sets.select("ip", F.explode(found).alias("f")).select("f.type", "f.severity", "ip", "f.count")


def all_findings(requests: DataFrame, logins: DataFrame) -> DataFrame:
    """Every scan result in one shape: type, severity, ip, count."""
    failures = logins.filter((F.col("status") == "failed") & F.col("ip").isNotNull()).groupBy("ip").agg(F.count("*").alias("n"))
    brute = failures.filter("n >= 10")
    parts = [
        ssh_bruteforce(logins),
        scraping(requests),
        finding(brute, "brute_force_attack", F.when(F.col("n") > 50, "high").otherwise("medium"), F.col("ip"), F.col("n")),
        request_findings(requests),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def finding_statistics(findings: DataFrame) -> DataFrame:
    """Total, open and closed findings overall, by type and by severity."""
    sets = findings.groupingSets([("type",), ("severity",), ()], "type", "severity").agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("resolved")).alias("active"),
        F.count_if("resolved").alias("resolved"),
        F.grouping_id().alias("gid"),
    )
    grp = text.first_case([(F.col("gid") == 1, "type"), (F.col("gid") == 2, "severity")], "all")
    return sets.select(grp.alias("grp"), F.coalesce("type", "severity", F.lit("all")).alias("value"), "total", "active", "resolved")


def request_threats(requests: DataFrame, flooded: Column | None = None) -> DataFrame:
    """Threats of each request, the overall severity and whether to block."""
    path = F.col("path")
    kinds = [("sql_injection", "high"), ("xss", "high"), ("path_traversal", "high"), ("command_injection", "critical")]
    items = [(k, s, text.signature_detail(path, k), "path") for k, s in kinds]
    items.append(("malicious_bot", "medium", text.malicious_agent(F.col("user_agent")), "user_agent"))
    if flooded is not None:
        items.append(("http_flooding", "high", F.when(flooded, F.lit("HTTP flooding")), "rate"))
    found = F.array_compact(F.array(*[
        F.when(d.isNotNull(), F.struct(F.lit(k).alias("type"), F.lit(s).alias("severity"), d.alias("detail"), F.lit(loc).alias("location")))
        for k, s, d, loc in items
    ]))
    rank = F.array_max(F.transform(F.col("threats"), lambda e: text.severity_rank(e["severity"])))
    return (
        requests.withColumn("threats", found)
        .withColumn("overall_severity", F.coalesce(text.severity_name(rank), F.lit("none")))
        .withColumn("is_threat", F.size("threats") > 0)
        .withColumn("should_block", F.col("overall_severity").isin("high", "critical"))
    )


def blocked_access(requests: DataFrame, active_blocks: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Events for requests of blocked, not whitelisted addresses. The lists are keyed by ip."""
    denied = requests.join(whitelist.select("ip"), "ip", "left_anti").join(active_blocks.select("ip"), "ip", "left_semi")
    return denied.select(
        "id", "timestamp", F.lit("blocked_access_attempt").alias("event_type"), F.lit("medium").alias("severity"),
        F.col("ip").alias("source_ip"), F.lit("blocked_ip").alias("attack_vector"), F.col("path").alias("request_path"),
    )


def window_counts(
    rows: DataFrame, key: str, span: str, slide: str, at_least: int, distinct: str | None = None
) -> DataFrame:
    """Sliding windows in which a key reaches a number of rows (or distinct values).

    Works on batch and stream. Rows are counted per slide first; only these counts are copied into the windows that hold the slide, so
    the number of rows that move does not grow with ``span / slide``, which must be whole. ``distinct`` values of a stream must come
    from a bounded set, such as port numbers; in a batch no set is built, see ``distinct_window_counts``.
    """
    if distinct and at_least > 0 and not rows.isStreaming:
        return distinct_window_counts(rows, key, span, slide, at_least, distinct)
    slides = rows.groupBy(F.window("timestamp", slide).alias("_slide"), key, *([distinct] if distinct else [])).agg(F.count("*").alias("_n"))
    n = F.size(F.collect_set(distinct)).cast("bigint") if distinct else F.sum("_n")
    return (
        slides.groupBy(F.window(F.window_time("_slide"), span, slide).alias("w"), key)
        .agg(n.alias("n"))
        .filter(F.col("n") >= at_least)
        .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
    )


def _micros_of(span: str) -> int:
    """A span of fixed length in microseconds."""
    return round(pd.Timedelta(span).total_seconds() * 1_000_000)


def distinct_window_counts(rows: DataFrame, key: str, span: str, slide: str, at_least: int, distinct: str) -> DataFrame:
    """Sliding windows in which a key reaches a number of distinct values; batch only.

    A value is in all windows that hold one of its slides. Slide by slide it comes into the windows that the slide before did not
    reach: +1 at the first of these, -1 behind the last. Marks of all values are added up per key and place; their running sum is the count,
    which stays the same up to the next mark. So no set is built, and a key as a whole is at most two rows per slide.
    Rows are counted before, so that no task sorts more of a larger input.
    """
    wide, step = _micros_of(span), _micros_of(slide)
    steps = wide // step
    place = F.floor(micros("timestamp") / step)
    slides = rows.filter(F.col("timestamp").isNotNull() & F.col(distinct).isNotNull()).select(
        F.col(key).alias("_key"), F.col(distinct).alias("_value"), place.alias("_at")).distinct()
    slides = spread(slides, rows.count(), "_key", "_value")
    before = F.lag("_at").over(Window.partitionBy("_key", "_value").orderBy("_at"))
    first = F.greatest(F.col("_at") - (steps - 1), F.coalesce(before + 1, F.col("_at") - (steps - 1)))
    spans = slides.select("_key", "_at", first.alias("_first"))
    marks = spans.select("_key", F.explode(F.array(
        F.struct(F.col("_first").alias("w"), F.lit(1).alias("d")), F.struct((F.col("_at") + 1).alias("w"), F.lit(-1).alias("d")))).alias("m"))
    sums = marks.groupBy("_key", F.col("m.w").alias("_w")).agg(F.sum("m.d").alias("_d")).filter(F.col("_d") != 0)
    order = Window.partitionBy("_key").orderBy("_w")
    counted = sums.withColumn("n", F.sum("_d").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn(
        "_next", F.lead("_w").over(order)).filter(F.col("n") >= at_least)
    start = F.explode(F.sequence("_w", F.col("_next") - 1))
    kind = rows.schema["timestamp"].dataType
    moment = lambda us: F.timestamp_micros(us).cast(kind)
    return counted.select(F.col("_key").alias(key), start.alias("_w"), "n").select(
        key, moment(F.col("_w") * step).alias("window_start"), moment(F.col("_w") * step + wide).alias("window_end"), "n")


def counted_requests(requests: DataFrame) -> DataFrame:
    """Requests whose method the rate jail's filter knows."""
    return requests.filter(F.col("method").isin(*fixed.JAIL_METHODS))


def jail_hits(requests: DataFrame) -> DataFrame:
    """GET and POST requests of bad agents, without the ignored crawlers."""
    agent, referrer = F.coalesce("user_agent", F.lit("")), F.coalesce("referrer", F.lit(""))
    bad = agent.rlike("^" + fixed.JAIL_AGENTS) | referrer.rlike("^" + fixed.JAIL_AGENTS)
    ignored = F.concat_ws(" ", "path", referrer, agent).rlike(fixed.JAIL_IGNORE)
    return requests.filter(F.col("method").isin("GET", "POST") & bad & ~ignored)


def ban_alerts(bans: DataFrame) -> DataFrame:
    """One alert per banned address, from its first ban."""
    first = bans.filter(F.col("kind") == "ban").groupBy("ip").agg(F.min_by(F.struct("jail", "timestamp"), F.struct("timestamp", "id")).alias("b"))
    return first.select(
        "ip", "b.jail", "b.timestamp", F.when(F.col("b.jail").isin("sshd", "ssh"), "HIGH").otherwise("MEDIUM").alias("severity"),
        F.concat(F.lit("IP "), F.col("ip"), F.lit(" bloqueada por Fail2ban en jail "), F.col("b.jail")).alias("reason"))
