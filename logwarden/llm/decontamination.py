"""Benchmark decontamination: short test items are searched inside long documents by min-hash sketches, DataFrame functions only.

An item of n distinct five-word shingles is contained in a document if at least ``threshold`` percent of them occur there. Then fewer
than ``n - ceil(threshold * n)`` + 1 are missing, so of the item's so many smallest shingle hashes (its bottom-k sketch) one at least
occurs. An item of fewer than five words is one shingle, all of it. Items are partitioned by width and by size, a class per power of two
of n. Each class has a border, its largest sketch hash: a large item's sketch is the lowest fifth of its hashes, so the
borders of large classes are low. Documents are probed class by class, with the hashes up to the border of the class,
and only where they have as many shingles as the smallest item of the class must share. Candidates are then verified on the
words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions.text import once
from .frames import BROADCAST_ROWS, fresh, sized, text_key, written

#: Bytes up to which a table with texts may be sent to all executors.
BROADCAST_BYTES = 32_000_000


def normal(text: Column) -> Column:
    """Lower case; every run of other characters than letters and digits becomes one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _shingles(words: str, width: int, of) -> Column:
    """``of(list of words)`` for each run of ``width`` words of the array column ``words``."""
    last = F.size(words) - width
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: of([F.get(words, i + k) for k in range(width)]))
    return F.when(last >= 0, runs)


def item_shingles(items: DataFrame, width: int = 5) -> DataFrame:
    """Distinct shingles of each item: item_id, width, shingle, h, n.

    Rows of one id count as one item. A text of fewer than ``width`` words has one shingle, as wide as the text; one without words has none.
    """
    words = items.select("item_id", F.split(normal(F.col("text")), " ").alias("_w")).filter("_w <> array('')")
    of = lambda w: F.struct(F.lit(len(w)).alias("width"), F.concat_ws(" ", *w).alias("shingle"), F.xxhash64(*w).alias("h"))
    both = F.coalesce(_shingles("_w", width, of), *(F.when(F.size("_w") == k, _shingles("_w", k, of)) for k in range(1, width)))
    rows = words.select("item_id", F.inline(both)).distinct()
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item_id")))


def sketches(shingled: DataFrame, threshold: int) -> DataFrame:
    """The bottom-k sketch of each item: item_id, width, class, h; class k holds the items of 2^k to 2^(k+1) - 1 shingles."""
    k = F.floor(F.col("n") * (100 - threshold) / 100) + 1
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("h"))
    klass = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    return shingled.withColumn("_rank", rank).filter(F.col("_rank") <= k).select("item_id", "width", klass.alias("class"), "h")


def probed(docs: DataFrame, words: str, keys: DataFrame, threshold: int) -> DataFrame:
    """``docs`` once for each class and hash of its ``words`` (an array) to be looked for among ``keys``, what ``sketches`` gives.

    The columns width, class and h are added, ``words`` goes. There are at most 5 widths and a class per power of two.
    """
    of = keys.groupBy("width", "class").agg(F.max("h").alias("border")).orderBy("width", "class").collect()
    hashed = docs
    for size in sorted({r["width"] for r in of}):
        runs = F.coalesce(_shingles(words, size, lambda w: F.xxhash64(*w)), F.array().cast("array<bigint>"))
        hashed = once(hashed, f"_h{size}", F.array_distinct(runs))
    none = F.array().cast("array<struct<width: int, class: int, h: bigint>>")

    def probe(size: int, klass: int, border: int) -> Column:
        held = F.col(f"_h{size}")
        low = F.filter(held, lambda h: h <= F.lit(border))
        marked = F.transform(low, lambda h: F.struct(F.lit(size).alias("width"), F.lit(klass).alias("class"), h.alias("h")))
        return F.when(F.size(held) * 100 >= threshold * 2 ** klass, marked).otherwise(none)

    kept = [c for c in docs.columns if c != words]
    return hashed.select(*kept, F.inline(F.concat(none, *(probe(*r) for r in of))))


def _light(df: DataFrame, size: Column) -> DataFrame:
    """A written table, marked for broadcast if its rows and its ``size`` in bytes, both summed over all rows, are small."""
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES else df


def _found(docs: DataFrame, items: DataFrame, width: int, threshold: int) -> DataFrame:
    """doc_id, _key of its text, item_id, item_shingles, common of every contained item."""
    shingled = written(item_shingles(items, width), "items")
    keys = written(sketches(shingled, threshold).distinct(), "sketches")
    rows = docs.select("doc_id", "text").withColumn("_key", text_key(F.col("text")))
    words = once(rows, "_w", F.split(normal(F.col("text")), " "))
    hits = probed(words.drop("text"), "_w", keys, threshold).join(sized(keys), ["width", "class", "h"])
    found = written(hits.select("doc_id", "_key", "item_id").distinct(), "candidates")

    lists = shingled.groupBy("item_id", "n").agg(F.collect_list("shingle").alias("_shingles"))  # as long as an item
    lists = lists.withColumnRenamed("item_id", "_item")
    size = F.aggregate("_shingles", F.lit(0).cast("bigint"), lambda total, x: total + F.octet_length(x))
    pairs = found.join(_light(written(lists, "lists"), size), F.col("item_id").eqNullSafe(F.col("_item"))).select(
        F.col("doc_id").alias("_id"), F.col("_key").alias("_of"), "item_id", "n", "_shingles")
    pairs = _light(written(pairs, "pairs"), size)
    checked = rows.join(pairs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of")))
    padded = once(checked, "_text", F.concat(F.lit(" "), normal(F.col("text")), F.lit(" ")))
    common = F.size(F.filter("_shingles", lambda s: F.contains(F.col("_text"), F.concat(F.lit(" "), s, F.lit(" ")))))
    counted = once(padded, "common", common.cast("long")).select("doc_id", "_key", "item_id", F.col("n").alias("item_shingles"), "common")
    return counted.filter(F.col("common") * 100 >= F.col("item_shingles") * threshold)


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """One row per document and contained item: doc_id, item_id, item_shingles, common.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are ignored. Null and empty texts contain nothing
    and items without a word are contained nowhere. An item of fewer than ``width`` words is contained where its words
    stand in a row. Repeated rows give one row; where one id has several texts the best counts. Empty tables give an empty result.
    Ids may be null.
    """
    found = _found(docs, items, width, threshold)
    return found.groupBy("doc_id", "item_id", "item_shingles").agg(F.max("common").alias("common"))


def clean_documents(docs: DataFrame, items: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` whose text contains no item, with all columns and repeated rows; null texts stay."""
    key = fresh(docs, "_text_key")
    bad = _found(docs, items, width, threshold).select(F.col("doc_id").alias("_bad"), F.col("_key").alias("_bad_key")).distinct()
    bad = sized(written(bad, "contaminated"))
    marked = docs.withColumn(key, text_key(F.col("text")))
    bad = bad.toDF(fresh(docs, "_bad_id"), fresh(docs, "_bad_key"))
    same = marked["doc_id"].eqNullSafe(bad[bad.columns[0]]) & (marked[key] == bad[bad.columns[1]])
    return marked.join(bad, same, "left_anti").drop(key)
