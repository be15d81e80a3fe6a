import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from logwarden.llm import packing, repair, warc
from logwarden.llm.bpe import Encoder
from logwarden.session import shared_dir
from tests.llm.cases import frame, prose, texts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
_ALPHABET = ["a", "b", "A", "Thé", "ñ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'s", "'M", "É", "ß", "́", " ", "\x1c", "\x85", "　", "​",
             "<|endoftext|>", "1", "23", "-", "!!", "İ", "中", "×", "÷", "\x00", "😀", " ", "."]
ENCODERS = {p: (Encoder(p), Tokenizer.from_file(p)) for p in (WORD, BYTE)}


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_ALPHABET), max_size=12).map("".join), min_size=1, max_size=6))
def test_pieces_give_the_ids_of_the_whole(path, rows):
    mine, whole = ENCODERS[path]
    ids, edges = mine(rows, 1)
    want = [e.ids + [1] for e in whole.encode_batch(rows, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])] == want


def test_first_fit_decreasing_equals_the_plain_loop():
    rng = random.Random(4)
    for _ in range(30):
        lengths = np.array([rng.choice([1, 7, 100, 512, 1024, 2047, 2048, rng.randint(1, 2048)]) for _ in range(rng.randint(1, 90))])
        at, place = packing.first_fit_decreasing(lengths, 2048)
        room: list[int] = []
        for i in np.argsort(-lengths, kind="stable"):
            k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
            if k == len(room):
                room.append(2048)
            assert (at[i], place[i]) == (k, 2048 - room[k])
            room[k] -= lengths[i]


def test_packed_documents(spark):
    rows = texts()
    got = packing.packed_documents(frame(spark, rows), BYTE, group=4).collect()
    whole = ENCODERS[BYTE][1]
    want = Counter()
    for (i, t), e in zip(rows, whole.encode_batch([t or "" for _, t in rows], add_special_tokens=False)):
        ids = np.array(e.ids + [1], "<u4")
        for a in range(0, len(ids), 2048):
            want[(i, a, min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.packed_documents(frame(spark, []), BYTE).count() == 0


def test_token_files_come_back(spark):
    rows = texts() + [(500 + k, prose(k, 40)) for k in range(40)]
    got = sorted((tuple(r) for r in repair.encoded_documents(frame(spark, rows), WORD).collect()), key=lambda r: r[1])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for (i, _), e in zip(order, ENCODERS[WORD][1].encode_batch([t or "" for _, t in order], add_special_tokens=False)):
        ids = np.array(e.ids + [1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert repair.encoded_documents(frame(spark, []), WORD).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), min_size=1, max_size=8), st.integers(1, 4))
def test_grammar_round_trip_and_random_access(docs, times):
    docs = docs * times
    ids = np.array([x for d in docs for x in d], np.uint32)
    edges = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    for terminals in (6, 70_000):
        shard = repair.Shard(memoryview(repair.pack_shard([*range(len(docs) - 1), None], ids, edges, terminals)))
        assert shard.all().tolist() == ids.tolist() and shard.doc_ids[-1] is None
        for k, d in enumerate(docs):
            assert shard.document(k).tolist() == d
            assert [shard.token(k, i) for i in range(len(d))] == d


def test_pairs_become_rules():
    ids = np.array([1, 2, 3, 4] * 500 + [7], np.uint32)
    symbols, _, rules = repair.compress(ids, np.array([0, len(ids)]), 10)
    assert len(symbols) < len(ids) / 3 and [1, 2] in rules.tolist()


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 50, 300)
    docs = [np.concatenate([passage, rng.integers(0, 50, 40)]) for _ in range(64)] + [np.full(5000, 7)]
    ids = np.concatenate(docs).astype(np.uint32)
    edges = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    for terminals, per_round in ((50, 4096), (50, 20), (65_500, 4096), (70_000, 4096)):
        symbols, doc_at, rules = repair.compress(ids, edges, terminals, per_round)
        left = Counter(p for a, b in zip(doc_at[:-1], doc_at[1:]) for p in zip(symbols[a:b].tolist(), symbols[a + 1 : b].tolist()))
        assert max(left.values()) < 8
        assert repair.rule_lengths(rules, terminals).max() > 64
        shard = repair.Shard(memoryview(repair.pack_shard([*range(len(docs))], ids, edges, terminals)))
        assert shard.all().tolist() == ids.tolist() and shard.document(5).tolist() == docs[5].tolist()


def test_damaged_shards_are_refused():
    raw = bytearray(repair.pack_shard([1], np.array([1, 2], np.uint32), np.array([0, 2]), 10))
    for broken in (raw[:10], b"XXXX" + raw[4:], raw[:-1], raw[:-1] + bytes([raw[-1] ^ 1])):
        with pytest.raises(ValueError):
            repair.Shard(memoryview(bytes(broken)))


def page_rows():
    same = "<p>" + "é" * 600
    return [(1, "http://a/", same), (2, "http://b/ c\r\n", same), (2, "http://b/", same), (3, None, None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"),
            (None, "u", same), (7, "u", "x" * 1000), (8, "u", "x" * 1000), (9, "u", "y" * 999), (10, "u", "y" * 999), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 200)]


def test_archives_come_back(spark):
    import hashlib
    rows = page_rows()
    got = warc.archived_pages(spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")).collect()
    largest = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            largest[b] = max(i, largest.get(b, i))
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        to = largest.get(b) if b in largest and i != largest[b] else None
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to)] += 1
    assert Counter(tuple(r) for r in got) == want
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def archive(records, known=b"some bytes to know, WARC/1.1"):
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(known))
    return struct.pack("<II", warc.DICT_MAGIC, len(known)) + known + b"".join(packer.compress(r) + warc.SEPARATOR.encode() for r in records)


def test_reader_checks_frames_headers_and_lengths():
    good = warc.record(1, "http://a/", b"<p>x</p>", "0" * 40, None, "2024-01-01T00:00:00Z")
    raw = archive([good, good])
    assert [b for _, b in warc.read_records(memoryview(raw))][0].endswith(b"<p>x</p>")
    packed = zstandard.ZstdCompressor().compress(b"some bytes to know, WARC/1.1")
    assert len(list(warc.read_records(memoryview(struct.pack("<II", warc.DICT_MAGIC, len(packed)) + packed + raw[36:])))) == 2
    for bad in (raw[8:], raw[:-12], raw[:20], raw + b"\x01\x02", raw + b"abcdefgh"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_records(memoryview(bad)))
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: ", b"Content-Length: 1"), (b"WARC-Type: response\r\n", b""), (b"<p>x", b"<p>y"), (b"WARC-Date:", b"WARC-Date")):
        with pytest.raises(ValueError):
            list(warc.read_records(memoryview(archive([good.replace(old, new, 1)]))))


def test_files_are_ordered_by_their_numbers(spark):
    names = [f"file:/x/part-9/part-{n:05d}-4f-c-9b-c{c:03d}.txt" for n in (0, 7, 99_998, 99_999, 100_000, 100_001, 1_000_000) for c in (0, 2, 10, 999, 1000)]
    rows = spark.createDataFrame([(k, name) for k, name in enumerate(names)], "at long, path string").repartition(5)
    assert [r["at"] for r in rows.orderBy(repair.file_order("path")).collect()] == list(range(len(names)))


def test_files_are_ordered_by_their_numbers_whatever_the_uuid(spark):
    uuids = ["3f1c0a52-c9b4-4f7e-9d10-c41f2e6a7b88", "00000000-c123-4c45-8c67-c00000000000", "3f1c0a52-09b4-4f7e-9d10-041f2e6a7b88"]
    for uuid in uuids:
        names = [f"file:/x-c7/part-{n:05d}-{uuid}-c{c:03d}{end}" for n in (0, 1, 100_000) for c, end in ((0, ".txt"), (2, ".txt.gz"), (10, ""), (1000, ".txt"))]
        rows = spark.createDataFrame([(k, name) for k, name in enumerate(names)], "at long, path string").repartition(5)
        got = rows.select("at", repair.file_order("path").alias("place")).orderBy("place").collect()
        assert [r["at"] for r in got] == list(range(len(names)))
        assert len({(r["place"]["task"], r["place"]["file"]) for r in got}) == len(names)


def test_ids_in_several_files_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(repair, "SHARDS_PER_FILE", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    rows = [(k, prose(k, 40)) for k in range(60)]
    path = shared_dir(spark, "several")
    repair.write_ids(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), public_tokenizers.path("word_bpe_49k.json"), path, 1, shard_ids=300)
    assert spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).count() > 3
    got = sorted(tuple(r) for r in repair.read_ids(spark, path).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    start = 0
    for (i, _), (doc, at, n, _) in zip(rows, got):
        assert (doc, at) == (i, start)
        start += n


@pytest.mark.parametrize("path, first, then", [(WORD, "alpha , ( ) - x", "Alpha, (ALPHA) x-alpha"), (BYTE, "alpha alpha,x-x alpha", "alpha alpha, alpha-alpha")])
def test_words_are_learnt_apart_from_what_stands_around_them(path, first, then):
    encode, whole = Encoder(path), Tokenizer.from_file(path)
    encode([first])
    known = encode.known
    encode([then])
    assert encode.known == known
    marks = ["{}", "{},", "({})", "{}.{}", "7{}", "{}42!", "'{}'", "{}'s", "\n{}", " {}", "\n\n {},", "-'{}", "{}\n!"]
    texts = [m.format(w, w) for m in marks for w in ("alpha", "Été", "s", "x9y", "don't", "")]
    ids, edges = encode(texts)
    for text, a, b in zip(texts, edges[:-1], edges[1:]):
        assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids, text
