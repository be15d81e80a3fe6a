"""Secret scans with multipart credential linking, DataFrame functions only.

Places are found without leaving the engine: a text split at a pattern gives the gaps, all matches of the pattern give what lies
between, and running sums of their lengths give code point offsets. Parts (access identifiers, secrets, endpoints) are then
joined by interval inside scopes: a weak part is reported only where its complement lies within ``reach`` code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from .frames import fresh, sized, text_key, written

#: Patterns of the base kinds, in the order of the report, then of the weak parts (fixed values).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i:user|username|login|account|client_?id|access_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)"""
ENDPOINT = r"""[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+"""
#: Looked for at the start of a run only and without backtracking, so that runs of any length cost their length.
BARE = r"(?<![A-Za-z0-9+/_-])[A-Za-z+/_-]*+[0-9][A-Za-z0-9+/_-]*"
KINDS = ("assign", "access", "hex", "ident", "endpoint", "bare")
BASE = KINDS[:3]
#: What a part is good for: who asks, what proves it, or where.
WHO, WHAT, WHERE = ("access", "ident"), ("assign", "hex", "bare"), ("endpoint",)
REACH = 256
MASK = "[SECRET]"

_PARTS = "array<struct<kind:string,i:int,gap:int,length:int,ok:boolean>>"


def _pieces(text: Column, kind: str, pattern: str, ok, hint: Column | None = None) -> Column:
    """Matches of ``pattern``: number, code points since the last match, own length, and whether ``ok`` holds; empty if there is none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    rows = F.transform(F.slice(F.arrays_zip(found.alias("m"), gaps.alias("g")), 1, F.size(found)), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.char_length(x["g"]).alias("gap"), F.char_length(x["m"]).alias("length"),
        ok(x["m"]).alias("ok")))
    seen = text.rlike(pattern) if hint is None else hint & text.rlike(pattern)
    return F.when(seen, rows.cast(_PARTS)).otherwise(F.array().cast(_PARTS))


def parts(text: Column) -> Column:
    """All matches of all kinds in one array."""
    value = lambda pattern, least: lambda m: F.char_length(F.regexp_extract(m, pattern, 1)) >= least
    yes = lambda m: F.lit(True)
    mixed = lambda m: (F.char_length(m) >= 20) & m.rlike("[a-z]") & m.rlike("[A-Z]")
    return F.concat(
        _pieces(text, "assign", ASSIGN, value(ASSIGN, 6)), _pieces(text, "access", ACCESS, yes, F.contains(text, F.lit("AKIA"))),
        _pieces(text, "hex", HEX, yes), _pieces(text, "ident", IDENT, value(IDENT, 3)),
        _pieces(text, "endpoint", ENDPOINT, yes, F.contains(text, F.lit("://"))), _pieces(text, "bare", BARE, mixed))


def located(scanned: DataFrame) -> DataFrame:
    """doc_id, _key, kind, start, end of the matches that hold, from the ``parts`` of each distinct row."""
    once = scanned.filter(F.size("parts") > 0).groupBy("doc_id", "_key").agg(F.first("parts").alias("parts"))
    rows = once.select("doc_id", "_key", F.inline("parts"))
    so_far = Window.partitionBy("doc_id", "_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(so_far))
    return ends.filter("ok").select("doc_id", "_key", "kind", (F.col("end") - F.col("length")).alias("start"), "end")


def linked(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """Base spans, and the weak parts with a complement within ``reach`` code points in the same text.

    The interval join is a sweep over a text's spans by start: the largest end before and the smallest start behind decide whether
    any span of a role lies in reach, so no pairs are made. An identifier needs a secret, a bare secret an identifier or endpoint,
    an endpoint both. A weak part that overlaps a base span is no part of its own (an endpoint may overlap an assignment); a bare secret
    inside an identifier or endpoint counts as a secret and has no span of its own only where that identifier or endpoint is
    reported around it. What an identifier's own value says does not prove that identifier.
    """
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    by = Window.partitionBy("doc_id", "_key").orderBy("start", "_order", "end")
    before, behind = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)

    def overlaps(kinds: tuple[str, ...]) -> Column:
        of = F.col("kind").isin(*kinds)
        return F.coalesce(F.max(F.when(of, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(
            F.min(F.when(of, F.col("start"))).over(behind) < F.col("end"), F.lit(False))

    def near(kinds: tuple[str, ...], only: Column | None = None) -> Column:
        of = F.col("kind").isin(*kinds) if only is None else F.col("kind").isin(*kinds) & only
        return F.coalesce(F.col("start") - F.max(F.when(of, F.col("end"))).over(before) <= reach, F.lit(False)) | F.coalesce(
            F.min(F.when(of, F.col("start"))).over(behind) - F.col("end") <= reach, F.lit(False))

    rows = spans.withColumn("_order", order)
    hidden = (F.when(F.col("kind").isin("bare", "ident"), overlaps(BASE))
              .when(F.col("kind") == "endpoint", overlaps(("access", "hex"))).otherwise(F.lit(False)))
    rows = rows.withColumn("_hidden", hidden).filter(~F.col("_hidden"))
    # a bare secret that is an identifier's value
    rows = rows.withColumn("_value", (F.col("kind") == "bare") & overlaps(("ident",)))
    rows = rows.withColumn("_who", near(WHO)).withColumn("_access", near(("access",))).withColumn("_where", near(WHERE))
    rows = rows.withColumn("_what", near(WHAT)).withColumn("_proof", near(WHAT, ~F.col("_value")))
    holds = (F.when(F.col("kind") == "ident", F.col("_proof"))
             .when(F.col("kind") == "bare", F.col("_where") | F.when(F.col("_value"), F.col("_access")).otherwise(F.col("_who")))
             .when(F.col("kind") == "endpoint", F.col("_who") & F.col("_what")).otherwise(F.lit(True)))
    around = F.max(F.when(F.col("kind").isin("ident", "endpoint"), F.col("end"))).over(before)
    rows = rows.filter(holds).withColumn("_inside", (F.col("kind") == "bare") & F.coalesce(around >= F.col("end"), F.lit(False)))
    return rows.filter(~F.col("_inside")).select("doc_id", "_key", "kind", "_order", "start", "end")


def _scan(docs: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """The written narrow rows (doc_id, _key, parts), and per distinct row its sorted spans."""
    scanned = written(docs.select("doc_id", text_key(F.col("text")).alias("_key"), parts(F.coalesce("text", F.lit(""))).alias("parts")), "secrets")
    spans = linked(located(scanned), reach)
    base = F.col("kind").isin(*BASE)
    item = F.struct("start", "_order", "end", "kind")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE]
    grouped = spans.groupBy("doc_id", "_key").agg(
        *counts, F.array_sort(F.collect_list(F.when(base, item))).alias("base"), F.array_sort(F.collect_list(item)).alias("spans"))
    return scanned, grouped


def _said(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end by start, comma-joined).

    Null and empty texts have no spans and the digest of the empty string. Repeated rows and null ids keep a result row each;
    other columns are ignored; an empty table gives an empty result. Spans that start together stand in the order of ``KINDS``.
    """
    scanned, grouped = _scan(docs, reach)
    found = grouped.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_of"), *[f"n_{k}" for k in BASE],
                           _said("base").alias("base"), _said("spans").alias("spans"))
    rows = scanned.select("doc_id", "_key").join(
        sized(written(found, "spans"), 100_000), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of")), "left")
    none = F.lit("")
    return rows.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
                       F.sha2(F.coalesce("base", none), 256).alias("base_sha256"), F.coalesce("spans", none).alias("spans"))


def masked_documents(docs: DataFrame, reach: int = REACH, mask: str = MASK) -> DataFrame:
    """``docs`` with every reported span of its text replaced by ``mask`` and, if there is such a column, n_chars counted anew.

    Overlapping spans become one mask. All rows and columns stay; null texts stay null.
    """
    key = fresh(docs, "_text_key")
    _, grouped = _scan(docs.select("doc_id", "text"), reach)
    before = Window.partitionBy("doc_id", "_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    flat = grouped.select("doc_id", "_key", F.inline("spans")).withColumn("_until", F.max("end").over(before))
    # kept stretches: from where all earlier spans end to where this one starts, and behind the last
    holes = flat.filter(F.col("_until").isNull() | (F.col("start") >= F.col("_until")))
    cuts = holes.groupBy("doc_id", "_key").agg(F.array_sort(F.collect_list(F.struct(
        "start", F.coalesce("_until", F.lit(0)).alias("since")))).alias("cuts"))
    last = flat.groupBy("doc_id", "_key").agg(F.max("end").alias("last"))
    found = last.join(cuts, (last["doc_id"].eqNullSafe(cuts["doc_id"])) & (last["_key"] == cuts["_key"])).select(
        last["doc_id"].alias("_id"), last["_key"].alias("_of"), "cuts", "last")
    names = [fresh(docs, f"_{c}_of_spans") for c in ("id", "key", "cuts", "last")]
    found = sized(written(found, "masks"), 100_000).toDF(*names)
    marked = docs.withColumn(key, text_key(F.col("text")))
    same = marked["doc_id"].eqNullSafe(found[names[0]]) & (marked[key] == found[names[1]])
    wide = marked.join(found, same, "left")
    text, tail = F.col("text"), F.substring(F.col("text"), F.col(names[3]) + 1, F.char_length("text"))
    kept = F.transform(names[2], lambda c: F.substring(text, c["since"] + 1, c["start"] - c["since"]))
    clean = F.when(F.col(names[2]).isNull(), text).otherwise(F.concat(F.array_join(kept, mask), F.lit(mask), tail))
    wide = wide.withColumn("text", clean)
    if "n_chars" in docs.columns:
        wide = wide.withColumn("n_chars", F.when(F.col(names[2]).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return wide.select(*[F.col(f"`{c}`") for c in docs.columns])
