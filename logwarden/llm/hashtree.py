"""Sharding by a weighted hash tree: region, rack and shard are drawn level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

#: (region, rack, shard, weight) of each leaf.
Leaf = tuple[str, str, int, float]


def topology(shards: int = 8, base: int = 8, racks: int = 2, per_rack: int = 2) -> list[Leaf]:
    """The tree of ``shards`` leaves of weight 1.

    The first ``base`` fill racks of ``per_rack`` and regions of ``racks``. Each shard beyond them comes as a region of its own,
    so that the only subtree whose weight changes is the new one.
    """
    leaves = []
    for s in range(shards):
        if s < base:
            rack = s // per_rack
            leaves.append((f"r{rack // racks}", f"r{rack // racks}.k{rack % racks}", s, 1.0))
        else:
            leaves.append((f"r+{s}", f"r+{s}.k0", s, 1.0))
    return leaves


def _levels(leaves: list[Leaf]) -> list[dict[str, dict[str, float]]]:
    """Per level: parent -> child -> summed weight; leaves without weight take no rows."""
    out: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for region, rack, shard, weight in leaves:
        if weight < 0:
            raise ValueError("weights must not be negative")
        if weight:
            for level, parent, child in ((0, "", region), (1, region, rack), (2, rack, str(shard))):
                group = out[level].setdefault(parent, {})
                group[child] = group.get(child, 0.0) + weight
    if not out[0]:
        raise ValueError("the tree has no leaf with a weight")
    return out


def _draw(key: Column, children: dict[str, float]) -> Column:
    """The child with the smallest exponential draw; raising one weight moves rows into that child only."""
    def cost(child: str, weight: float) -> Column:
        head = F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(child))), 1, 12), 16, 10).cast("double")
        return F.struct((-F.log((head + 0.5) / float(16 ** 12)) / weight).alias("cost"), F.lit(child).alias("child"))

    if len(children) == 1:
        return F.lit(next(iter(children)))
    return F.least(*(cost(c, w) for c, w in sorted(children.items())))["child"]


def placed(df: DataFrame, key: str, leaves: list[Leaf], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row as column ``out``, decided by ``key`` and the tree alone.

    A null key counts as the empty text. Each level costs one hash per child of the subtree already chosen.
    """
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    at: Column = F.lit("")
    for level in _levels(leaves):
        (parent, children), *rest = sorted(level.items())
        chosen = _draw(text, children)
        for parent, children in rest:
            chosen = F.when(at == parent, _draw(text, children)).otherwise(chosen)
        df = df.withColumn(out, chosen)
        at = F.col(out)
    return df.withColumn(out, F.col(out).cast("int"))


def slotted(df: DataFrame, group: str, key: str, order: list[str], out: str = "slot", digits: int = 3) -> DataFrame:
    """``df`` with a gapless position from 0 within ``group``.

    Rows are ordered by a hash of ``key``, then by ``order``. A group is cut at the first ``digits`` hexadecimal digits of that hash;
    the pieces are counted first, and a row's place is its rank in the piece plus the rows of earlier pieces. So no task
    holds a whole group. ``df`` is read twice; only ``key`` and ``group`` matter in the first reading.
    """
    hashed = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    cut = df.withColumn("_hash", hashed).withColumn("_piece", F.substring("_hash", 1, digits))
    before = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    base = (cut.groupBy(group, "_piece").agg(F.count(F.lit(1)).alias("_n"))
            .select(group, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    inside = Window.partitionBy(group, "_piece").orderBy("_hash", *order)
    ranked = cut.withColumn("_rank", F.row_number().over(inside) - 1)
    return (ranked.join(base, [group, "_piece"]).withColumn(out, (F.col("_base") + F.col("_rank")).cast("long"))
            .drop("_hash", "_piece", "_rank", "_base"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Size, checksum, shard, slot and shard after growth by one, for each row of ``docs`` (``doc_id``, ``text``).

    Null texts have size 1 and the checksum of no bytes; null ids are one key; repeated rows each get a slot of their own; an
    empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = placed(placed(rows, "doc_id", topology(shards)), "doc_id", topology(shards + 1), "grown_shard")
    return slotted(rows, "shard", "doc_id", ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
