"""Greedy cool-down: of a key's times, fire the first and then each first time
at least ``cooldown`` after the last fired one.

The choice depends on order, so a plain window cannot make it, and one task
per key would read all times of a hot key. Time is cut into chunks of many
cool-downs instead:

1. every (key, chunk) reports where its chain ends for each possible entry
   (only times in the chunk's first cool-down can differ as entries): a step
   function from entry to exit;
2. the functions of ``FAN`` neighbours are composed into one, ``LEVELS`` times
   over, so a group never holds more than ``FAN`` short reports;
3. a pass per key over the few functions at the top finds their entries, which
   then go down the same tree to the chunks;
4. every (key, chunk) fires its chain from its entry.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

CHUNK = 64
#: Neighbours that are composed at once, and how often: a top node spans CHUNK * FAN ** LEVELS cool-downs.
FAN, LEVELS = 64, 2

_REPORT = "key string, node bigint, cd bigint, upto bigint, last bigint"


def _next_index(us: np.ndarray, cooldown: int) -> np.ndarray:
    return np.searchsorted(us, us + cooldown, side="left")


def _chunk_report(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry thresholds of one chunk and the last fired time for each."""
    pdf = pdf.sort_values("us")
    us, cd = pdf["us"].to_numpy(), int(pdf["cd"].iloc[0])
    nxt, end = _next_index(us, cd), np.arange(len(us))
    for i in range(len(us) - 1, -1, -1):
        if nxt[i] < len(us):
            end[i] = end[nxt[i]]
    start = int(pdf["chunk"].iloc[0]) * cd * CHUNK
    entries = max(1, min(len(us), int(np.searchsorted(us, start + cd, side="left")) + 1))
    last = us[end[:entries]]
    keep = np.append(last[:-1] != last[1:], True)
    return pd.DataFrame({
        "key": pdf["key"].iloc[0], "node": pdf["chunk"].iloc[0], "cd": cd,
        "upto": us[:entries][keep], "last": last[keep],
    })


def _children(pdf: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Number, entry thresholds and exits of each node of a group, in order."""
    pdf = pdf.sort_values(["node", "upto"])
    return [(int(node), part["upto"].to_numpy(), part["last"].to_numpy()) for node, part in pdf.groupby("node", sort=True)]


def _through(children: list[tuple[int, np.ndarray, np.ndarray]], ready: int, cd: int) -> int | None:
    """The last fired time when a chain that may fire from ``ready`` on goes through all children."""
    fired = None
    for _, upto, last in children:
        i = int(np.searchsorted(upto, ready, side="left"))
        if i < len(upto):
            fired = int(last[i])
            ready = fired + cd
    return fired


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The function of a parent: entries can differ inside its first child; beyond that child they are all the same."""
    children, cd = _children(pdf), int(pdf["cd"].iloc[0])
    upto = [*children[0][1].tolist(), *(children[1][1][:1].tolist() if len(children) > 1 else [])]
    last = np.array([_through(children, u, cd) for u in upto], np.int64)
    keep = np.append(last[:-1] != last[1:], True)
    return pd.DataFrame({
        "key": pdf["key"].iloc[0], "node": int(pdf["parent"].iloc[0]), "cd": cd, "upto": np.array(upto, np.int64)[keep], "last": last[keep],
    })


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Walk the nodes of a group in order, handing each the earliest time it may fire; the first gets the group's own ``ready``."""
    ready, cd, rows = int(pdf["ready"].iloc[0]), int(pdf["cd"].iloc[0]), []
    for child in _children(pdf):
        rows.append((pdf["key"].iloc[0], child[0], ready))
        fired = _through([child], ready, cd)
        ready = ready if fired is None else fired + cd
    return pd.DataFrame(rows, columns=["key", "node", "ready"])


def _fire(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("us")
    us, cd, ready = pdf["us"].to_numpy(), int(pdf["cd"].iloc[0]), pdf["ready"].iloc[0]
    nxt, i, fired = _next_index(us, cd), int(np.searchsorted(us, ready, side="left")), []
    while i < len(us):
        fired.append(i)
        i = int(nxt[i])
    return pdf.iloc[fired][["key", "us"]]


def fire_times(times: DataFrame) -> DataFrame:
    """``times``: key string, us bigint, cd bigint (microseconds, > 0). Returns fired (key, us)."""
    cut = times.select("key", "us", "cd").distinct().withColumn("chunk", F.floor(F.col("us") / (F.col("cd") * CHUNK)))
    parent = F.floor(F.col("node") / FAN)
    reports = [cut.groupBy("key", "chunk").applyInPandas(_chunk_report, _REPORT)]
    for _ in range(LEVELS):
        reports.append(reports[-1].withColumn("parent", parent).groupBy("key", "parent").applyInPandas(_composed, _REPORT))
    entries = "key string, node bigint, ready bigint"
    first = F.lit(-(1 << 62)).cast("bigint")
    entry = reports.pop().withColumn("ready", first).groupBy("key").applyInPandas(_entries, entries)
    while reports:
        above = entry.withColumnRenamed("node", "parent")
        entry = reports.pop().withColumn("parent", parent).join(above, ["key", "parent"]).groupBy("key", "parent").applyInPandas(_entries, entries)
    return cut.join(entry.withColumnRenamed("node", "chunk"), ["key", "chunk"]).groupBy("key", "chunk").applyInPandas(_fire, "key string, us bigint")


def with_cooldown(rows: DataFrame, key: str, ts_us: str, cooldown_us: str, tie: str) -> DataFrame:
    """Rows that fire; of rows at the same time the one with the smallest ``tie``. No cool-down, no thinning."""
    free = rows.filter(F.col(cooldown_us) <= 0)
    held = rows.filter(F.col(cooldown_us) > 0)
    fired = fire_times(
        held.select(F.col(key).cast("string").alias("key"), F.col(ts_us).alias("us"), F.col(cooldown_us).alias("cd"))
    ).withColumnRenamed("key", "_key").withColumnRenamed("us", "_us")
    first = (
        held.groupBy(key, ts_us)
        .agg(F.min_by(F.struct(*[F.col(c) for c in held.columns]), tie).alias("row"))
        .withColumn("_k", F.col(key).cast("string"))
        .select("_k", "row")
    )
    chosen = first.join(
        fired, (F.col("_k") == F.col("_key")) & (F.col(f"row.{ts_us}") == F.col("_us")), "left_semi"
    ).select("row.*")
    return free.unionByName(chosen)
