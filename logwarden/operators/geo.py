"""Placing addresses: range lookup, country policy, owners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 text to a number; anything else is null."""
    parts = F.split(ip, r"\.")
    valid = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    n = F.lit(0).cast("bigint")
    for i in range(4):
        n = n * 256 + F.get(parts, F.lit(i)).try_cast("bigint")
    return F.when(valid, n)


#: Prefix lengths, within the first 64 bits, of the blocks over which ranges are spread, per family; the first is for all wider ranges.
BLOCKS = {4: [16, 24], 6: [16, 32, 48, 64]}
#: A range goes to the longest prefix at which it touches at most so many blocks.
SPREAD = 16
_LOW = -(1 << 63)


def ip_text4(ip: Column) -> Column:
    """The dotted address of plain and IPv4-mapped text."""
    return F.regexp_replace(F.lower(ip), r"^::ffff:(?=\d+\.)", "")


def ip_halves(ip: Column) -> Column:
    """Both halves of an IPv6 address as bigints that keep the order of addresses; null for other text."""
    sides = F.split(F.lower(ip), "::")
    groups = lambda side: F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    given = F.size(left) + F.size(right)
    shortened = F.size(sides) == 2
    form = ip.rlike(r"(?i)^(::|[0-9a-f]{1,4}(?=:))?([0-9a-f]{0,4}:{1,2})*[0-9a-f]{0,4}$") & ip.contains(":") & ~ip.contains(":::")
    edges = ~ip.rlike(r"^:[^:]|[^:]:$")
    valid = form & edges & F.when(shortened, given <= 7).otherwise((F.size(sides) == 1) & (given == 8)) & ~F.exists(
        F.concat(left, right), lambda g: F.length(g) > 4)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - given, F.lit(0))), right)
    digits = F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")
    half = lambda at: (F.conv(F.substring(digits, at, 16), 16, 10).cast("decimal(20,0)") + F.lit(_LOW)).cast("bigint")
    return F.when(valid, F.struct(half(1).alias("head"), half(17).alias("tail")))


def _of_number(n: Column) -> Column:
    """The key of an IPv4 number: its 32 bits on top of the head."""
    return F.struct(F.lit(4).alias("family"), F.shiftleft(n - F.lit(1 << 31), 32).alias("head"), F.lit(_LOW).alias("tail"))


def ip_key(ip: Column) -> Column:
    """Family and two halves of an address, in the order of addresses within a family; null for text that is no address."""
    n, six = ip_number(ip_text4(ip)), ip_halves(ip)
    return F.when(n.isNotNull(), _of_number(n)).when(six.isNotNull(), F.struct(F.lit(6).alias("family"), six["head"].alias("head"), six["tail"].alias("tail")))


def range_keys(ranges: DataFrame) -> DataFrame:
    """``ranges`` by numbers of IPv4 (ip_from, ip_to) or as text of either family (first_ip, last_ip), with both keys and the places."""
    if "first" in ranges.columns:
        return ranges
    text_form = "first_ip" in ranges.columns
    first, last = (ip_key(F.col(c)) if text_form else _of_number(F.col(c)) for c in (("first_ip", "last_ip") if text_form else ("ip_from", "ip_to")))
    return ranges.select(first.alias("first"), last.alias("last"), "country_code", "country_name", "continent_name")


def all_ranges(*tables: DataFrame) -> DataFrame:
    """Several tables of ranges as one."""
    return reduce(DataFrame.unionByName, [range_keys(r) for r in tables])


def _blocks(family: int, low: Column, high: Column) -> Column:
    """Prefix length and first and last block of a range of ``family``."""
    out = None
    for bits in BLOCKS[family]:
        at = lambda c: F.shiftright(c, 64 - bits)  # noqa: E731, B023
        item = F.struct(F.lit(bits).alias("bits"), at(low).alias("b1"), at(high).alias("b2"))
        out = item if out is None else F.when(at(high).cast("double") - at(low).cast("double") < SPREAD, item).otherwise(out)
    return out


def geo_lookup(ips: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """One row per distinct address, IPv4, IPv4-mapped or IPv6: country, continent.

    A range condition alone would plan a nested loop. Addresses are numbers of 128 bits, in two halves; ranges are spread over the
    blocks that they touch, at the prefix length that fits their size, and an address asks for its block at each length, which
    gives an equality key for both families. Private addresses are LAN, unknown ones XX; of nested ranges the innermost wins.
    """
    distinct = ips.select(F.col(ip).alias("ip")).filter(F.col("ip").isNotNull()).distinct()
    keyed = text.once(distinct, "k", ip_key(F.col("ip")))
    lengths = lambda f: F.array(*[F.lit(b) for b in BLOCKS[f]])
    asked = keyed.withColumn("bits", F.explode_outer(F.when(F.col("k.family") == 4, lengths(4)).when(F.col("k.family") == 6, lengths(6))))
    asked = asked.withColumn("blk", F.expr("shiftright(k.head, 64 - bits)"))
    held = text.once(range_keys(ranges), "at", F.when(F.col("first.family") == 4, _blocks(4, F.col("first.head"), F.col("last.head"))).otherwise(
        _blocks(6, F.col("first.head"), F.col("last.head"))))
    spread = held.select(
        "first", "last", "country_code", "country_name", "continent_name", F.col("first.family").alias("rfamily"), F.col("at.bits").alias("rbits"),
        F.explode(F.sequence("at.b1", "at.b2")).alias("rblk"))
    halves = lambda c: F.struct(F.col(f"{c}.head"), F.col(f"{c}.tail"))
    hit = asked.join(
        spread,
        (F.col("k.family") == F.col("rfamily")) & (F.col("bits") == F.col("rbits")) & (F.col("blk") == F.col("rblk"))
        & (halves("k") >= halves("first")) & (halves("k") <= halves("last")), "left")
    hit = hit.withColumn("ip_from", halves("first")).withColumn("inside", F.struct(F.bitwise_not(F.col("last.head")), F.bitwise_not(F.col("last.tail"))))
    inner = hit.groupBy("ip").agg(
        F.max_by(F.struct("country_code", "country_name", "continent_name"), F.when(F.col("rblk").isNotNull(), F.struct("ip_from", "inside"))).alias("g")
    )
    private = text.is_private_ip(F.col("ip"))

    def pick(lan: str, field: str, unknown: str) -> Column:
        return F.when(private, F.lit(lan)).otherwise(F.coalesce(F.col(f"g.{field}"), F.lit(unknown))).alias(field)

    return inner.select(
        "ip",
        pick("LAN", "country_code", "XX"),
        pick("Private Network", "country_name", "Unknown"),
        pick("Private", "continent_name", "Unknown"),
    )


def geo_enrich(df: DataFrame, ranges: DataFrame, ip: str) -> DataFrame:
    """Add country columns to every row through one lookup per distinct address."""
    places = geo_lookup(df, ranges, ip).withColumnRenamed("ip", "_gip")
    return df.join(places, F.col(ip) == F.col("_gip"), "left").drop("_gip")


def country_allowed(ip: Column, code: Column, name: Column, policy: dict) -> tuple[Column, Column]:
    """(allowed, reason) under a policy of mode, countries, enabled, block_unknown."""
    words = fixed.GEO_REASONS
    if not policy.get("enabled", False):
        return F.lit(True), F.lit(words["off"])
    listed = F.array_contains(F.array(*[F.lit(c) for c in policy["countries"]]), code)
    private = text.is_private_ip(ip)
    whitelist = policy.get("mode", "whitelist") == "whitelist"
    block_unknown = policy.get("block_unknown", False)
    label = F.concat(name, F.lit(" ("), code, F.lit(")"))
    allowed = text.first_case([(private, True), (code.isNull(), not block_unknown)], listed if whitelist else ~listed)
    refusal = words["not_allowed"] if whitelist else words["blocked"]
    reason = text.first_case(
        [
            (private, words["private"]),
            (code.isNull(), words["unknown_blocked"] if block_unknown else words["unknown_allowed"]),
            (allowed, F.concat(F.lit(words["allowed"]), label)),
        ],
        F.concat(F.lit(refusal), label),
    )
    return allowed, reason


def country_blocked(code: Column, enabled: bool, countries: list[str]) -> Column:
    if not enabled or not countries:
        return F.lit(False)
    return F.coalesce(code.isin(countries), F.lit(False))


def backfill_event_geo(events: DataFrame, ranges: DataFrame, geo: str = "geo_location") -> DataFrame:
    """Fill missing event places from one lookup per distinct address."""
    missing = F.col(geo).isNull() | (F.col(geo) == "")
    places = geo_lookup(events.filter(missing), ranges, "source_ip")
    found = places.select(
        F.col("ip").alias("_gip"),
        text.geo_json(F.col("country_name"), F.col("country_code"), F.col("continent_name")).alias("_geo"),
    )
    return (
        events.join(found, F.col("source_ip") == F.col("_gip"), "left")
        .withColumn(geo, F.when(missing, F.col("_geo")).otherwise(F.col(geo)))
        .drop("_gip", "_geo")
    )


def backfill_prediction_country(predictions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Unknown country of a prediction becomes LAN or "Name (CC)"; unplaced rows stay."""
    todo = F.col("country").isNull() | (F.col("country") == "Unknown")
    lan = reduce(lambda a, b: a | b, [F.col("ip_address").startswith(p) for p in fixed.BACKFILL_PRIVATE_PREFIXES])
    places = geo_lookup(predictions.filter(todo), ranges, "ip_address").filter(F.col("country_code") != "XX")
    found = places.select(F.col("ip").alias("_gip"), F.col("country_name").alias("_n"), F.col("country_code").alias("_c"))
    hit = F.col("_c").isNotNull()
    return (
        predictions.join(found, F.col("ip_address") == F.col("_gip"), "left")
        .withColumn(
            "country_code",
            F.when(todo & lan, F.lit("LAN")).when(todo & hit, F.col("_c")).otherwise(F.col("country_code")),
        )
        .withColumn(
            "country",
            F.when(todo & lan, F.lit("Private Network (LAN)"))
            .when(todo & hit, F.concat(F.col("_n"), F.lit(" ("), F.col("_c"), F.lit(")")))
            .otherwise(F.col("country")),
        )
        .drop("_gip", "_n", "_c")
    )


def geo_coverage(events: DataFrame, geo: str = "geo_location") -> DataFrame:
    has = F.col(geo).isNotNull() & (F.col(geo) != "")
    return events.agg(F.count_if(has).alias("with_geo"), F.count("*").alias("total_events"))
