"""Merge of monitor logs into stored tables, batch by batch.

Layout under the job's folder: ``<kind>/n=<batch>`` has the new rows of a batch; the keys stored so far are read from there. A batch of one kind is
read from its files as often as it is needed, once for headers and once for rows, and its lines are neither stored nor cached; only a batch of several kinds is cached.
Where a kind has a key, the parsed rows wait in ``staged/<kind>/n=<batch>``, in slices of the key's hash, and go through the keys a round of slices after
the other: what a round shuffled is removed when it ends, as are its slices, so that the disk holds the rows of a batch about once and not three times.
Batch ``n`` is decided by the rows of batches before ``n`` alone and writes its own folder anew, so a repeated batch stores the same rows again and none twice.
Every ``FOLD`` batches the keys so far become one table, ``keys/<kind>/upto=<batch>``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import monitor as mo

#: Column that identifies a row, for the kinds whose rows have one of their own.
KEYS = {"conn": "uid", "files": "fuid"}
#: Slots of the filter that is sent to the stored keys: a bound on its rows, whatever the batch.
SLOTS = 1 << 20
FOLD = 64
#: Slices of a staged batch, and rows from which a round takes no further slice.
SLICES, ROUND_ROWS = 16, 1_000_000
#: Shuffle files go when their statement ends, not when the driver next happens to collect garbage; slices are written side by side, unsorted.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": str(SLICES)}


def table(kind: str, rows: DataFrame, as_of: Column) -> DataFrame:
    """The typed table of a log kind from its text columns."""
    if kind == "ssl":
        return mo.ssl_table(rows, as_of)
    return {"conn": mo.conn_table, "dns": mo.dns_table, "http": mo.http_table, "files": mo.files_table, "notice": mo.notice_table}[kind](rows)


def located(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path and file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, fs = located(spark, path)
    return fs.exists(folder)


def folders(spark: SparkSession, path: str, mark: str) -> list[int]:
    """Numbers of the sub-folders ``mark=<number>`` of ``path``."""
    folder, fs = located(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(x.split("=")[1]) for x in names if x.startswith(f"{mark}="))


def drop(spark: SparkSession, path: str) -> None:
    folder, fs = located(spark, path)
    fs.delete(folder, True)


def slot(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def slice_of(key: str) -> Column:
    """Part of a staged batch that a row belongs to: by the highest bits of its key's hash; rows without a key are dealt around."""
    return F.when(F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SLICES))).otherwise(
        F.pmod(F.shiftright(F.xxhash64(key), 32), F.lit(SLICES))).cast("int")


def stored_keys(spark: SparkSession, keys: str, data: str, key: str, n: int) -> DataFrame | None:
    """Keys stored by batches before ``n``: the newest fold before it, and those of the rows that came since."""
    upto = max((m for m in folders(spark, keys, "upto") if m < n), default=-1)
    parts = [f"{keys}/upto={upto}"] if upto >= 0 else []
    parts += [f"{data}/n={m}" for m in folders(spark, data, "n") if upto < m < n]
    return spark.read.schema(f"`{key}` string").parquet(*parts).filter(F.col(key).isNotNull()) if parts else None


def fold_keys(spark: SparkSession, keys: str, data: str, key: str, n: int) -> None:
    known = stored_keys(spark, keys, data, key, n)
    if known is not None:
        write(known, f"{keys}/upto={n - 1}")


def write(rows: DataFrame, path: str, mode: str = "overwrite", *parts: str) -> None:
    rows.write.mode(mode).option("compression", "zstd").partitionBy(*parts).parquet(path)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Statements in this block run under ``SETTINGS``; none of their frames is run twice."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rounds(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Slices in order, a list per round: as many as hold ``most`` rows, one at least. No rows are one round, so that an empty table is written."""
    out, held = [[]], 0
    for part in sorted(sizes):
        if out[-1] and held + sizes[part] > most:
            out.append([])
            held = 0
        out[-1].append(part)
        held += sizes[part]
    return out


def unseen(rows: DataFrame, stored: DataFrame | None, key: str) -> DataFrame:
    """Rows with a key that ``stored`` lacks, one per key (the first in time, then by its other columns), and all rows without a key.

    Rows and stored keys meet in one shuffle, in the order of the key's hash, which is cheaper to sort than text; a row without a key is a group of its own.
    ``rows`` are read once, and their keys once more where there are stored ones: a small filter goes out to those first, so that only stored keys
    whose slot some row of the batch has take part, and a long history is read but neither moved nor sorted.
    """
    order = ["timestamp", *[c for c in rows.columns if c != "timestamp"]]
    group = F.when(F.col(key).isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(key))
    each = rows.select(group.alias("_group"), F.col(key).alias("_key"), F.struct(F.lit(1).alias("_new"), *order).alias("row"))
    if stored is not None:
        slots = rows.filter(F.col(key).isNotNull()).select(slot(key).alias("_slot")).distinct()  # at most SLOTS rows
        near = stored.withColumn("_slot", slot(key)).join(F.broadcast(slots), "_slot", "left_semi")
        blank = F.struct(F.lit(0).alias("_new"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order])
        each = each.unionByName(near.select(F.xxhash64(key).alias("_group"), F.col(key).alias("_key"), blank.alias("row")))
    first = each.groupBy("_group", "_key").agg(F.min("row").alias("row"))
    return first.filter("row._new = 1").select("row.*").select(*rows.columns)


def store_unseen(rows: DataFrame, n: int, kind: str, key: str, out: str) -> None:
    """Store the rows of batch ``n`` whose key is new. They are parsed once, into slices; see :mod:`.ingest`."""
    spark, staged, data = rows.sparkSession, f"{out}/staged/{kind}/n={n}", f"{out}/{kind}/n={n}"
    if n and n % FOLD == 0:
        fold_keys(spark, f"{out}/keys/{kind}", f"{out}/{kind}", key, n)
    stored = stored_keys(spark, f"{out}/keys/{kind}", f"{out}/{kind}", key, n)
    write(rows.withColumn("_slice", slice_of(key)), staged, "overwrite", "_slice")
    waiting = spark.read.schema(rows.withColumn("_slice", F.lit(0)).schema).parquet(staged)
    sizes = {r["_slice"]: r["count"] for r in waiting.groupBy("_slice").count().collect()}
    for k, parts in enumerate(rounds(sizes, ROUND_ROWS)):
        own = waiting.filter(F.col("_slice").isin(parts)).drop("_slice")
        known = None if stored is None else stored.filter(slice_of(key).isin(parts))
        # in the order of the key's hash, columns would hardly compress
        write(unseen(own, known, key).sortWithinPartitions("source_ip", "timestamp"), data, "append" if k else "overwrite")
        for part in parts:
            drop(spark, f"{staged}/_slice={part}")
    drop(spark, staged)


def store_batch(batch: DataFrame, n: int, kinds: list[str], out: str, as_of: Column) -> None:
    """Store one micro-batch of lines (log, line, file) under ``out``."""
    held = batch.persist(StorageLevel.MEMORY_AND_DISK) if len(kinds) > 1 else batch
    with tidied(batch.sparkSession):
        for kind in kinds:
            lines = held.filter(F.col("log") == kind)
            rows = table(kind, mo.parse_auto(lines.select("line", "file"), mo.FIELDS[kind]), as_of)
            if kind in KEYS:
                store_unseen(rows, n, kind, KEYS[kind], out)
            else:
                write(rows, f"{out}/{kind}/n={n}")
    if held is not batch:
        held.unpersist()
