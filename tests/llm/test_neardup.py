import numpy as np
import pytest

from logwarden.llm import neardup
from logwarden.llm.components import components
from logwarden.llm.words import word_hashes
from tests.llm.cases import edited, frame, prose, texts, words

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size=3, percent=85):
    sets = []
    for i, t in rows:
        w = words((t or "").translate(_LOW))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if None not in (i, j) and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets)), key=str)


def chain():
    """Copies of which neighbours are linked and the ends are not, and a family just below the limit."""
    out, text = [], prose(5, 90)
    for k in range(12):
        out.append((100 + k, text))
        text = edited(text, 7 * k + 3, f"w{k}")
    rng = np.random.default_rng(3)
    for k in range(40):
        text = prose(6, 100)
        for at in rng.choice(100, 6, replace=False):
            text = edited(text, int(at), f"x{k}{at}")
        out.append((200 + k, text))
    return out


def test_components_of_awkward_rows_equal_brute_force(spark):
    rows = texts() + chain()
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_blocks_smaller_than_a_group_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCUMENTS", 7)
    rows = chain()
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def family(seed, first, many, words=100, edits=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(many):
        text = prose(seed, words)
        for at in rng.choice(words, edits, replace=False):
            text = edited(text, int(at), f"y{seed}{k}{at}")
        out.append((first + k, text))
    return out


def test_a_large_group_of_copies_moves_each_text_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCUMENTS", 10)
    rows = family(21, 1000, 200)
    known = neardup.sketched(frame(spark, rows), 3, 24, 5).withColumnRenamed("doc_id", "id")
    members = neardup.shared_buckets(known)
    biggest = members.groupBy("bucket").count().orderBy("count", ascending=False).first()
    assert biggest["count"] > 100
    one = members.filter(members["bucket"] == biggest["bucket"])
    assert neardup.leading_blocks(one).count() < 1.2 * biggest["count"]
    first = neardup.components(neardup.verified_links(frame(spark, rows), neardup.leading_blocks(members), 3, 85))
    assert neardup.remaining_blocks(members, first).count() == 0
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_pairs_across_parts_and_components_are_compared(spark, monkeypatch):
    """Every bucket holds all, so that what is linked depends on the blocks alone; families overlap at, above and below the limit."""
    monkeypatch.setattr(neardup, "BLOCK_DOCUMENTS", 4)
    rows = family(31, 0, 30, 90, 2) + family(32, 100, 25, 90, 3) + chain() + [(300 + k, prose(40 + k, 50)) for k in range(9)]
    docs = frame(spark, rows)
    reps = neardup.sketched(docs, 3, 1, 1).selectExpr("doc_id as id", "n", "f1", "f2", "array(1L) as bands")
    found = {r["id"]: r["component"] for r in neardup.linked_components(docs, reps, 3, 85).collect()}
    want = {r[0]: r[2] for r in brute(rows)}
    assert {i: found.get(i, i) for i in want} == want and len(set(want.values())) > 20


def test_empty_table(spark):
    assert neardup.near_duplicates(frame(spark, [])).collect() == []
    assert neardup.first_of_each(frame(spark, [])).columns == frame(spark, []).columns


def test_stage_keeps_one_of_each_group_with_all_columns(spark):
    docs = frame(spark)
    kept = neardup.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 4 in ids and not {5, 6, 7, 9} & set(ids) and {1, 2, 3, 8, 10, 11, -3} <= set(ids) and ids.count(None) == 2


def test_sketches_fill_and_agree_like_their_sets():
    rng = np.random.default_rng(1)
    same = rng.integers(0, 2 ** 63, 400, dtype=np.uint64)
    a, b = np.concatenate([same[:300], same[300:350]]), np.concatenate([same[:300], same[350:]])
    one = rng.integers(0, 2 ** 63, 1, dtype=np.uint64)
    out = neardup.fast_sketches(np.concatenate([a, b, one]), np.array([0, 350, 700, 701]), 512)
    assert (out != 2 ** 64 - 1).all()
    assert abs((out[0] == out[1]).mean() - 300 / 400) < 0.08


def test_word_hashes_tell_words_apart():
    ws = [prose(k, 50) for k in range(30)] + ["", None, "A a"]
    got, edges = word_hashes(ws, lower=True)
    want = [w for t in ws for w in words((t or "").translate(_LOW))]
    assert len(got) == len(want) and len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))
    assert np.diff(edges).tolist() == [len(words(t)) for t in ws]


@pytest.mark.parametrize("n", [2, 65])
def test_components_of_a_path(spark, n):
    edges = spark.createDataFrame([(k + 1, k) for k in range(n)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(k, 0) for k in range(n + 1)}
