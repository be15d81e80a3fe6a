"""Packing of tokenised documents into sequences: first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import cut, texts
from .bpe import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


class Bins:
    """Open bins under a tournament tree: each inner node holds the largest free room below it."""

    def __init__(self, room: int, most: int):
        self.room, self.width = room, 1 << max(0, most - 1).bit_length()
        self.tree = [room] * (2 * self.width)

    def put(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size``, and the place in it."""
        tree, node = self.tree, 1
        while node < self.width:
            node *= 2
            if tree[node] < size:
                node += 1
        place = self.room - tree[node]
        tree[node] -= size
        leaf = node - self.width
        node //= 2
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            larger = left if left > right else right
            if tree[node] == larger:
                break
            tree[node] = larger
            node //= 2
        return leaf, place


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each length, which are taken longest first and, where equal, in the order given."""
    bins = Bins(room, max(1, len(lengths)))
    at, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        at[i], place[i] = bins.put(int(lengths[i]))
    return at, place


def pieces(docs: DataFrame, tokenizer: str, room: int, end: int) -> DataFrame:
    """The pieces of each document's ids: full sequences from its start, then what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for whole in batches:
            for batch in cut(whole, "text"):
                ids, edges = encode(texts(batch), end)
                raw = memoryview(ids.astype("<u4").tobytes())
                sizes = np.diff(edges)
                of = np.repeat(np.arange(len(sizes)), -(-sizes // room))
                first = np.concatenate([[0], np.cumsum(-(-sizes // room))])[:-1]
                start = (np.arange(len(of)) - first[of]) * room
                length = np.minimum(room, sizes[of] - start)
                begin = (edges[of] + start) * 4
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()).take(pa.array(of)), *map(pa.array, (start, length, np.array(sums, np.int64), sizes[of]))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def packed_documents(docs: DataFrame, tokenizer: str, room: int = 2048, end: int = 1, group: int = 4096) -> DataFrame:
    """Each piece of each row of ``docs`` (doc_id, text) with its sequence and offset there.

    Ids are those of the tokenizer and ``end``; a null text is an empty one and so has one id. A document longer than ``room`` is
    cut at multiples of it. Documents fall into about ``rows / group`` groups by a hash of id and content, and each group is
    packed by itself, so a task holds the lengths of one group only. Sequence ids are unique, not gapless. Rows of one id, and
    repeated rows, are packed each on its own; an empty table gives an empty result; other columns are ignored.
    """
    groups = max(1, math.ceil(docs.count() / group))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32", "doc_tokens"], kind="stable")
        at, place = first_fit_decreasing(rows["length"].to_numpy(), room)
        return rows.drop(columns="_group").assign(sequence_id=key[0] * 2 ** 32 + at, offset=place)

    cut_up = pieces(docs, tokenizer, room, end)
    hashed = F.pmod(F.xxhash64("doc_id", "doc_tokens", F.when(F.col("doc_id").isNull(), F.col("ids_crc32"))), F.lit(groups))
    return cut_up.withColumn("_group", hashed).groupBy("_group").applyInPandas(pack, PACKED)
