"""Token ids in a binary format of its own, compressed by a pair grammar per shard.

A file is a row of shards, each ended by a line feed. A shard holds whole documents in ascending id order. Its ids are compressed by
rounds until no pair is frequent: adjacent pairs inside documents are counted, the most frequent become nonterminals, and every
non-overlapping occurrence is replaced from the left. Rules and their expansion lengths are stored, and where each document's symbols and ids
begin, so one document is decoded without the others.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from ..session import shared_dir
from .batches import cut, texts
from .bpe import encoder, gathered
from .frames import written

MAGIC = b"RPG2"
#: A file is read back as one value, so its size is bounded: a shard has about a million ids.
SHARDS_PER_FILE = 256
_HEAD = struct.Struct("<4sIIIIQQ")  # magic, checksum of what follows, documents, terminals, rules, symbols, ids
DECODED = "doc_id long, path string, shard long, local long, n_tokens long, ids_crc32 long"


def compress(ids: np.ndarray, edges: np.ndarray, terminals: int, per_round: int = 4096, least: int = 8):
    """Symbols, the documents' edges among them, and the rules (pairs) of nonterminals ``terminals``, ``terminals`` + 1, ...

    Pairs never span two documents. A pair becomes a rule if it occurs ``least`` times at its round; rounds follow until none does.
    """
    kind = np.uint32 if terminals <= 1 << 16 else np.uint64
    seq = ids.astype(kind)
    last = np.zeros(len(seq), bool)
    last[edges[1:][edges[1:] > edges[:-1]] - 1] = True
    # Where a pair may begin that occurs often: a pair of old symbols only gets rarer, so one that was rare is not counted again.
    live = ~last
    doc_at = edges.copy()
    rules, made = [np.empty((0, 2), np.uint32)], 0
    while True:
        at = np.flatnonzero(live)
        shift = kind(16 if kind is np.uint32 else 32)
        keys = (seq[at] << shift) | seq[at + 1]
        ranked = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)])
        counts = np.diff(np.append(first, len(ranked)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            return seq, doc_at, np.concatenate(rules)
        frequent, counts = ranked[first[often]], counts[often]
        chosen = frequent
        if len(often) > per_round:
            chosen = frequent[np.sort(np.argsort(-counts, kind="stable")[:per_round])]
        # a small table of hashes tells most other pairs apart: what it lets through is counted again, or searched for
        spot = _spot(keys)
        live[at] = _among(frequent)[spot]
        near = np.flatnonzero(_among(chosen)[spot])
        rank = np.minimum(np.searchsorted(chosen, keys[near]), len(chosen) - 1)
        same = chosen[rank] == keys[near]
        hits, rank = at[near[same]], rank[same]
        new_run = np.concatenate([[True], np.diff(hits) > 1])
        run_start = hits[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
        odd = (hits - run_start) % 2 == 0
        hits, rank = hits[odd], rank[odd]
        rules.append(np.stack([chosen >> shift, chosen & kind((1 << int(shift)) - 1)], 1).astype(np.uint32))
        if kind is np.uint32 and terminals + made + len(chosen) > 1 << 16:
            kind, seq = np.uint64, seq.astype(np.uint64)
        seq[hits] = (rank + terminals + made).astype(kind)
        made += len(chosen)
        last[hits] = last[hits + 1]
        live[hits] = True
        keep = np.ones(len(seq), bool)
        keep[hits + 1] = False
        before = np.zeros(len(seq) + 1, np.int64)
        np.cumsum(keep, out=before[1:])
        doc_at = before[doc_at]
        seq, last, live = seq[keep], last[keep], live[keep]
        behind = before[hits]
        live[behind[behind > 0] - 1] = True
        live &= ~last


def _among(pairs: np.ndarray) -> np.ndarray:
    """Which hashes ``pairs`` have."""
    out = np.zeros(1 << 16, bool)
    out[_spot(pairs)] = True
    return out


def _spot(keys: np.ndarray) -> np.ndarray:
    """A 16-bit hash of each pair."""
    with np.errstate(over="ignore"):
        return (keys * keys.dtype.type(0x9E3779B1 if keys.itemsize == 4 else 0x9E3779B97F4A7C15)) >> keys.dtype.type(8 * keys.itemsize - 16)


def rule_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each rule expands to; a rule uses earlier ones only."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - terminals] if a >= terminals else 1) + (out[b - terminals] if b >= terminals else 1))
    return np.array(out, np.uint32)


def expansions(rules: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids behind every symbol: all of them in a row, where each symbol's begin, and their number."""
    out: list[list[int]] = []
    for a, b in rules.tolist():
        out.append((out[a - terminals] if a >= terminals else [a]) + (out[b - terminals] if b >= terminals else [b]))
    lengths = np.concatenate([np.ones(terminals, np.int64), np.array([len(x) for x in out], np.int64)])
    flat = np.concatenate([np.arange(terminals), np.array([i for x in out for i in x], np.int64)]).astype(np.uint32)
    return flat, np.cumsum(lengths) - lengths, lengths


def _high(kinds: int) -> range:
    """The bits from the 17th on that numbers below ``kinds`` need; each is stored as a plane of its own behind the lower 16."""
    return range(16, (kinds - 1).bit_length())


def pack_shard(doc_ids: list[int | None], ids: np.ndarray, edges: np.ndarray, terminals: int) -> bytes:
    symbols, doc_at, rules = compress(ids, edges, terminals)
    body = b"".join([
        np.array([i is None for i in doc_ids], np.uint8).tobytes(), np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
        edges.astype("<u8").tobytes(), doc_at.astype("<u8").tobytes(), rules.astype("<u4").tobytes(),
        rule_lengths(rules, terminals).astype("<u4").tobytes(), (symbols & symbols.dtype.type(0xFFFF)).astype("<u2").tobytes(),
        *(np.packbits(((symbols >> symbols.dtype.type(k)) & symbols.dtype.type(1)).astype(bool)).tobytes() for k in _high(terminals + len(rules)))])
    rest = struct.pack("<IIIQQ", len(doc_ids), terminals, len(rules), len(symbols), len(ids))
    return MAGIC + struct.pack("<I", zlib.crc32(rest + body)) + rest + body


class Shard:
    """One shard of a file's bytes from ``at`` on; raises ValueError where they are no whole shard."""

    def __init__(self, raw: memoryview, at: int = 0):
        if len(raw) - at < _HEAD.size:
            raise ValueError("a shard's head is cut off")
        magic, check, docs, self.terminals, rules, symbols, tokens = _HEAD.unpack_from(raw, at)
        if magic != MAGIC:
            raise ValueError("no shard begins here")
        high = _high(self.terminals + rules)
        sizes = [docs, 8 * docs, 8 * docs + 8, 8 * docs + 8, 8 * rules, 4 * rules, 2 * symbols, *[(symbols + 7) // 8] * len(high)]
        begin = at + _HEAD.size
        self.end = begin + sum(sizes)
        if self.end > len(raw) or zlib.crc32(raw[at + 8 : self.end]) != check:
            raise ValueError("a shard's bytes do not match its checksum")
        spots = np.cumsum([begin, *sizes])
        read = lambda k, kind: np.frombuffer(raw[spots[k] : spots[k + 1]], kind)
        null, ids = read(0, np.uint8), read(1, "<i8")
        self.doc_ids = [None if n else i for n, i in zip(null.tolist(), ids.tolist())]
        self.edges, self.doc_at = read(2, "<u8").astype(np.int64), read(3, "<u8").astype(np.int64)
        self.rules, self.lengths = read(4, "<u4").reshape(-1, 2), read(5, "<u4")
        self.symbols = read(6, "<u2")
        if high:
            self.symbols = self.symbols.astype(np.uint32)
            for k, bit in enumerate(high):
                self.symbols |= np.unpackbits(read(7 + k, np.uint8), count=symbols).astype(np.uint32) << np.uint32(bit)
        if self.edges[-1] != tokens or self.doc_at[-1] != symbols:
            raise ValueError("a shard's documents do not fill it")
        self.table = expansions(self.rules, self.terminals)
        if not np.array_equal(self.table[2][self.terminals :], self.lengths):
            raise ValueError("a shard's rules do not have their lengths")

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; nothing else is decoded."""
        flat, starts, lengths = self.table
        symbols = self.symbols[self.doc_at[k] : self.doc_at[k + 1]]
        return gathered(flat, starts[symbols], lengths[symbols])[0]

    def all(self) -> np.ndarray:
        """The ids of all documents."""
        flat, starts, lengths = self.table
        return gathered(flat, starts[self.symbols], lengths[self.symbols])[0]

    def token(self, k: int, i: int) -> int:
        """The i-th id of the k-th document, by the expansion lengths alone."""
        for s in self.symbols[self.doc_at[k] : self.doc_at[k + 1]].tolist():
            n = int(self.lengths[s - self.terminals]) if s >= self.terminals else 1
            if i < n:
                while s >= self.terminals:
                    left, right = (int(x) for x in self.rules[s - self.terminals])
                    n = int(self.lengths[left - self.terminals]) if left >= self.terminals else 1
                    s, i = (left, i) if i < n else (right, i - n)
                return s
            i -= n
        raise IndexError("the document has fewer ids")


def write_ids(docs: DataFrame, tokenizer: str, path: str, end: int = 1, shard_ids: int = 1 << 20) -> None:
    """Write the ids of all rows of ``docs`` (doc_id, text) under ``path``, in ascending doc_id order over shards and files.

    A shard takes documents until it holds ``shard_ids`` ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        terminals = max(encode.tokenizer.get_vocab_size(), end + 1)
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            names = [i for part in held for i in part[0]]
            edges = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(part[2]) for part in held]))])
            blob = pack_shard(names, np.concatenate([part[1] for part in held]), edges, terminals)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["value"])

        for whole in batches:
            for batch in cut(whole, "text"):
                ids, edges = encode(texts(batch), end)
                held.append((batch.column("doc_id").to_pylist(), ids, edges))
                size += len(ids)
                if size >= shard_ids:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(run, "value binary")
    writer = shards.select(F.col("value").cast("string")).write.option("compression", "none").option("lineSep", "\n")
    writer.option("maxRecordsPerFile", SHARDS_PER_FILE).text(path)


def file_order(path: str) -> Column:
    """Place of a part file in the order of the ids: the number of its task, then the number of the file within the task.

    The job's uuid stands between the two and may itself hold ``-c`` and digits; the file's number is the last part of the name.
    """
    number = lambda pattern: F.regexp_extract(path, pattern, 1).try_cast("long")
    return F.struct(number(r"/part-(\d+)[^/]*$").alias("task"), F.coalesce(number(r"-c(\d+)(?:\.[^/]*)?$"), F.lit(0)).alias("file"))


def read_ids(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files under ``path``; ``start`` counts all ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = memoryview(content.as_buffer())
                at = number = 0
                while at < len(raw):
                    shard = Shard(raw, at)
                    if raw[shard.end : shard.end + 1] != b"\n":
                        raise ValueError("a shard does not end with a line feed")
                    n = len(shard.doc_ids)
                    ids, edges = memoryview(shard.all().astype("<u4").tobytes()), (4 * shard.edges).tolist()
                    sums = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1], edges[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids, pa.int64()), pa.array([name] * n), pa.array([number] * n, pa.int64()),
                         pa.array(shard.edges[:-1]), pa.array(np.diff(shard.edges)), pa.array(sums, pa.int64())],
                        names=["doc_id", "path", "shard", "local", "n_tokens", "ids_crc32"])
                    at, number = shard.end + 1, number + 1

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    rows = written(files.mapInArrow(run, DECODED), "decoded")
    # a row per shard, then one per file: parts are numbered in the order of the range
    shards = rows.groupBy("path", "shard").agg(F.sum("n_tokens").alias("n"))
    inside = Window.partitionBy("path").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("in_file", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    across = Window.orderBy(file_order("path")).rowsBetween(Window.unboundedPreceding, -1)
    files_n = rows.groupBy("path").agg(F.sum("n_tokens").alias("of_file"))
    files_n = files_n.withColumn("before", F.coalesce(F.sum("of_file").over(across), F.lit(0))).select("path", "before")
    base = shards.join(files_n, "path").select("path", "shard", (F.col("before") + F.col("in_file")).alias("base"))
    return rows.join(base, ["path", "shard"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def encoded_documents(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Write the ids of ``docs`` to files in the shared folder and read them back, a row per row of ``docs``.

    A null text is an empty one and has the id ``end`` alone. Null ids come first; rows of one id stand next to each other, by text;
    an empty table gives an empty result; other columns are ignored.
    """
    path = shared_dir(docs.sparkSession, "token-ids")
    write_ids(docs, tokenizer, path, end)
    return read_ids(docs.sparkSession, path)
