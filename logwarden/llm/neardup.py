"""Near-duplicates by fast similarity sketches, banding and exact verification on full shingle sets.

A sketch has one coordinate per bin. Round by round every shingle is hashed to a bin and a value, and an empty bin keeps the smallest
value of the first round that fills it; from the ``bins``-th round on all shingles go to one bin each, so after twice as many
rounds every coordinate is full. Two sketches agree in a coordinate with the similarity of their sets as probability, and their
share of agreement keeps as close to it as with independent hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .batches import cut
from .components import components
from .frames import fresh, sized, text_key, written
from .words import MIX, mixed, shingles, word_hashes

_FULL = np.uint64(2 ** 64 - 1)
SKETCHED = "doc_id long, n long, f1 long, f2 long, bands array<long>"
#: Shingles that one task compares at once, and documents.
BLOCK_SHINGLES, BLOCK_DOCUMENTS = 400_000, 512


def fast_sketches(elements: np.ndarray, edges: np.ndarray, bins: int) -> np.ndarray:
    """The sketch of each set of 64-bit hashes, a row each; the row of an empty set is full of the largest number."""
    sets = len(edges) - 1
    out = np.full(sets * bins, _FULL)
    of = np.repeat(np.arange(sets), np.diff(edges))
    with np.errstate(over="ignore"):
        for k in range(2 * bins):
            if not len(of):
                break
            h = mixed(elements + np.uint64((k + 1) * MIX[0] % 2 ** 64))
            spot = ((h >> np.uint64(40)) % np.uint64(bins)).astype(np.int64) if k < bins else np.int64(k - bins)
            np.minimum.at(out, of * bins + spot, (h & np.uint64(2 ** 40 - 1)) | np.uint64(k << 40))
            open_sets = (out.reshape(sets, bins) == _FULL).any(axis=1)[of]
            of, elements = of[open_sets], elements[open_sets]
    return out.reshape(sets, bins)


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of texts whose words are lower-cased in A-Z only, and their edges."""
    return shingles(*word_hashes(texts, lower=True), size)


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of consecutive coordinates."""
    rows = sketch.shape[1] // bands
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], len(sketch), axis=0)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mixed(key + sketch[:, r::rows] * np.uint64(MIX[0]))
    return key.view(np.int64)


def _print(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set, as two signed numbers."""
    raw = xxhash.xxh3_128_digest(elements.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def sketched(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, set size, fingerprint of the set and band keys of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, "text"):
                elements, edges = shingle_sets(batch.column("text").to_pylist(), size)
                keys = band_keys(fast_sketches(elements, edges, bands * rows), bands)
                prints = [_print(elements[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(edges)), *(pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1)),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), pa.array(keys.ravel()))],
                    names=["doc_id", "n", "f1", "f2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCHED)


def shared_buckets(reps: DataFrame) -> DataFrame:
    """Written rows (id, n, f1, f2, bucket, parts): who meets whom, and in how many parts a bucket is compared.

    A bucket all of whose members have one other, larger bucket in common is left out, as its pairs are compared there.
    """
    rows = reps.select("id", "n", "f1", "f2", F.posexplode("bands").alias("band", "key")).withColumn("bucket", F.xxhash64("band", "key"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).filter("m > 1")
    shared = written(rows.select("id", "n", "f1", "f2", "bucket").join(sizes, "bucket"), "buckets")
    homes = shared.groupBy("id").agg(F.max(F.struct("m", "bucket")).alias("home"))
    homed = shared.select("id", "bucket").join(homes, "id").groupBy("bucket").agg(F.min("home.bucket").alias("h1"), F.max("home.bucket").alias("h2"))
    needed = homed.filter("h1 <> h2 or h1 = bucket").select("bucket")
    kept = shared.join(needed, "bucket")
    return written(kept.select("id", "n", "f1", "f2", "bucket", _parts("m", "total").alias("parts")), "members")


def _parts(m: str, total: str) -> Column:
    return F.ceil(F.greatest(F.col(m) / BLOCK_DOCUMENTS, F.col(total) / BLOCK_SHINGLES)).cast("int")


def _part(parts: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")


def leading_blocks(members: DataFrame) -> DataFrame:
    """id, f1, f2 and block: each member in one part of its bucket, and in all parts the bucket's leader, its smallest id."""
    own = members.select("id", "f1", "f2", F.xxhash64("bucket", _part("parts")).alias("block"))
    leaders = members.filter("parts > 1").groupBy("bucket", "parts").agg(F.min(F.struct("id", "f1", "f2")).alias("lead"))
    everywhere = leaders.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return own.union(everywhere.select("lead.id", "lead.f1", "lead.f2", F.xxhash64("bucket", "part").alias("block")))


def remaining_blocks(members: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks of the pairs in buckets of several parts that no path connects so far; ``found`` has (id, component).

    Members of a bucket's commonest component are connected with each other already. All others are compared in parts with each
    other and with the parts of that component, so a text is copied once per part of the others, and not at all where
    there are none.
    """
    large = members.filter("parts > 1").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    groups = large.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    most = groups.groupBy("bucket").agg(
        F.max(F.struct("m", "component")).alias("most"), F.max_by("total", F.struct("m", "component")).alias("main_total"),
        F.sum("m").alias("m"), F.sum("total").alias("total"))
    apart = most.select("bucket", F.col("most.component").alias("main"), F.col("most.m").alias("main_m"), "main_total",
                        (F.col("m") - F.col("most.m")).alias("rest_m"), (F.col("total") - F.col("main_total")).alias("rest_total")).filter("rest_m > 0")
    cuts = apart.select("bucket", "main", _parts("main_m", "main_total").alias("main_parts"), _parts("rest_m", "rest_total").alias("rest_parts"))
    rows = large.join(sized(written(cuts, "cuts")), "bucket").withColumn("rest", F.col("component") != F.col("main"))
    own = F.when(F.col("rest"), _part("rest_parts")).otherwise(_part("main_parts"))

    def to(parts: str, pair) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(parts) - 1), pair)

    main_pair = lambda a, b: F.xxhash64(F.lit("main"), a, b)
    rest_pair = lambda k: F.xxhash64(F.lit("rest"), F.least("own", k), F.greatest("own", k))
    pairs = F.when(F.col("rest"), F.concat(
        to("rest_parts", rest_pair), to("main_parts", lambda k: main_pair(F.col("own"), k)))).otherwise(
        to("rest_parts", lambda k: main_pair(k, F.col("own"))))
    return rows.withColumn("own", own).withColumn("pair", F.explode(pairs)).select("id", "f1", "f2", F.xxhash64("bucket", "pair").alias("block"))


def linked_within(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(id, smallest id linked to it over any path within the block) for every document that has a link here.

    Intersections of all pairs are counted exactly, as a product of the block's membership matrix with itself, some columns at a time.
    """
    m = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    held = np.bincount(column)
    several = held[column] > 1  # what one document alone has is in no intersection
    number = np.cumsum(held > 1) - 1
    row, column = row[several], number[column[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((m, m), np.float32)
    wide = max(1, 8_000_000 // m)
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, wide):
        a, b = np.searchsorted(column, [at, at + wide])
        part = np.zeros((m, min(wide, total - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        common += part @ part.T  # counts below 2^24 are exact
    common = common.astype(np.int64)
    link = 100 * common >= percent * (sizes[:, None] + sizes[None] - common)
    np.fill_diagonal(link, True)
    label = np.arange(m)  # ids ascend
    while True:
        least = np.where(link, label[None], m).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    return [(int(ids[i]), int(ids[label[i]])) for i in range(m) if label[i] != i]


def verified_links(docs: DataFrame, blocks: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) that connect exactly the documents linked in some block; sets are made anew from the whole texts."""

    def compare(held: list[tuple]) -> list[tuple[int, int]]:
        known = {}
        for doc, text, f1, f2 in held:
            known.setdefault(doc, []).append((text, f1, f2))
        ids, texts, prints = [], [], []
        for doc in sorted(known):
            for text, f1, f2 in known[doc]:
                ids.append(doc), texts.append(text), prints.append((f1, f2))
        elements, edges = shingle_sets(texts, size)
        sets = [elements[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        fit = [i for i in range(len(ids)) if _print(sets[i]) == prints[i] and (i == 0 or ids[i] != ids[i - 1] or prints[i] != prints[i - 1])]
        return linked_within(np.array([ids[i] for i in fit]), [sets[i] for i in fit], percent) if len(fit) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def told(edges):
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for whole in batches:
            for batch in cut(whole, "text"):
                columns = [batch.column(c).to_pylist() for c in ("block", "id", "text", "f1", "f2")]
                for own, *rest in zip(*columns):
                    if own != block:
                        if len(held) > 1:
                            yield told(compare(held))
                        block, held = own, []
                    held.append(tuple(rest))
        if len(held) > 1:
            yield told(compare(held))

    named = docs.select(F.col("doc_id").alias("id"), "text")
    rows = named.join(sized(blocks), "id").select("block", "id", "text", "f1", "f2")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def linked_components(docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, component) of the documents with a link, in two rounds: within parts and with leaders, then what is still apart."""
    members = shared_buckets(reps)
    found = components(verified_links(docs, written(leading_blocks(members).distinct(), "blocks"), size, percent))
    if members.filter("parts > 1").isEmpty():
        return found
    blocks = written(remaining_blocks(members, found).distinct(), "blocks")
    more = verified_links(docs, blocks, size, percent)
    return components(found.toDF("a", "b").union(more))


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, bands: int = 24, rows: int = 5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles, component_id and kept.

    Words are lower-cased in A-Z and split at ASCII white space; a text of fewer than ``size`` words has one shingle, all of it. Documents
    are linked if their sets overlap by ``percent`` of their union or more. A null, empty or blank text has no shingle and is linked
    with nothing, and so is a row without an id (component_id null, kept). Equal sets are one class, represented by the smallest id;
    classes are sketched, banded and compared exactly, and no number of candidates or partners is limited. A bucket is compared in parts,
    each with the bucket's leader; what is still apart then is compared across parts. Two sets just at
    the limit share no band with a chance of (1 - (percent / 100) ^ rows) ^ bands. Repeated rows have equal results; an
    empty table gives an empty result; other columns are ignored.
    """
    known = written(sketched(docs, size, bands, rows), "sketches")
    filled = known.filter("n > 0 and doc_id is not null")
    classes = written(filled.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id")), "classes")
    chosen = filled.withColumnRenamed("doc_id", "id").join(classes, ["f1", "f2", "n", "id"], "left_semi").dropDuplicates(["f1", "f2", "n", "id"])
    found = linked_components(docs, chosen, size, percent)
    named = classes.join(found, "id", "left").select("f1", "f2", "n", F.coalesce("component", "id").alias("_component"))
    return known.join(named, ["f1", "f2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 24, rows: int = 4) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, with all columns; of rows with one id, one text stays."""
    found = near_duplicates(docs.select("doc_id", "text"), size, percent, bands, rows)
    gone = sized(written(found.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "duplicates"))
    gone = gone.toDF(fresh(docs, "_gone"))
    left = docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")
    # rows that come again are looked for by narrow keys, so that texts of the others need not move
    key = fresh(left, "_text_key")
    again = left.select("doc_id", text_key(F.col("text")).alias("k")).groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("n"))
    again = sized(written(again.filter("n > 1 and doc_id is not null").select("doc_id").distinct(), "repeated")).toDF(fresh(left, "_again"))
    same = left["doc_id"] == again[again.columns[0]]
    once = left.join(again, same, "left_anti")
    more = left.join(again, same, "left_semi").withColumn(key, text_key(F.col("text"))).dropDuplicates(["doc_id", key]).drop(key)
    return once.unionByName(more)
