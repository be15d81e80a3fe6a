import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from logwarden.llm import lce, periodic
from logwarden.llm.queries import QUERIES, with_planted_runs
from tests.llm.cases import frame, prose, texts, words


def brute(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            long = j > i and j + q - i >= max(least, times * q)
            if long and all(any(w[k] != w[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted(out)


def kept_of(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


def planted(i, text):
    """The words of a text as the query has them."""
    w = words(text)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g = h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return w[:a] + [w[a + (k - a) % p] for k in range(a, len(w))]


def some_words(rng):
    w = [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 70))]
    for _ in range(rng.randint(0, 2)):
        if len(w) > 4:
            p, s = rng.randint(1, 9), rng.randint(0, len(w) - 1)
            for i in range(s + p, rng.randint(s, len(w))):
                w[i] = w[i - p]
    for _ in range(rng.randint(0, 3)):
        if w:
            w[rng.randrange(len(w))] = rng.randint(100, 130)
    return w


def test_runs_equal_brute_force():
    rng = random.Random(7)
    for _ in range(1500):
        w = some_words(rng)
        assert periodic.maximal_runs(w) == brute(w)
        assert periodic.maximal_runs(w, 2, 2) == brute(w, 2, 2)
        assert periodic.collapsed(w, brute(w)) == kept_of(w, brute(w))


def test_no_run_lies_outside_the_stretches():
    rng = random.Random(8)
    for _ in range(300):
        w = some_words(rng)
        parts = periodic.stretches(w)
        assert all(any(a <= s and s + n <= b for a, b in parts) for s, n, _ in brute(w))
        assert all(b < c for (_, b), (c, _) in zip(parts, parts[1:]))


@pytest.mark.parametrize("symbols", [1, 2, 4])
def test_extensions_and_order_of_suffixes(symbols):
    rng = random.Random(symbols)
    text = [rng.randrange(symbols) for _ in range(60)] + [symbols]
    ext = lce.Extensions(text, symbols + 1)
    assert np.argsort(ext.rank).tolist() == sorted(range(61), key=lambda i: text[i:])
    a, b = np.array([(i, j) for i in range(61) for j in range(i)]).T
    want = [next(k for k in range(61) if text[i + k] != text[j + k]) for i, j in zip(a.tolist(), b.tolist())]
    assert ext.common(a, b).tolist() == want


def test_tree_has_every_suffix_as_a_path():
    rng = random.Random(3)
    text = [rng.randrange(3) for _ in range(40)] + [3]
    tree = lce.SuffixTree(text, 4)
    for i in range(len(text)):
        node, at = 0, i
        while at < len(text):
            child = tree.edges[node * 4 + text[at]]
            label = text[tree.start[child] : tree.end[child]]
            assert text[at : at + len(label)] == label
            node, at = child, at + len(label)
    assert len(tree.start) <= 2 * len(text)


def awkward():
    long = prose(4, 40) + " " + " ".join(["tick", "tock", "tick"] * 9000)
    more = [(100 + k, prose(k, 30 + k)) for k in range(60)]
    return [*texts(), (50, "a " * 6), (51, "a " * 5), (51, "a " * 5), (52, "x y z w " * 4 + "x y"), (53, long), (None, "b b b b b b b"), *more]


def test_operator_on_awkward_rows(spark):
    rows = awkward()
    docs = frame(spark, rows).withColumnRenamed("_key", "runs")
    out = periodic.periodic_runs(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.columns[-2:] == ["runs_1", "collapsed_text"]
    got = sorted(((r["doc_id"], r["text"], [tuple(x) for x in r["runs_1"]], r["collapsed_text"]) for r in out.collect()), key=str)
    want = []
    for i, t in rows:
        runs = brute(words(t)) if len(words(t)) < 3000 else periodic.maximal_runs(words(t))
        want.append((i, t, runs, " ".join(kept_of(words(t), runs) if len(words(t)) < 3000 else periodic.collapsed(words(t), runs))))
    assert got == sorted(want, key=str)
    assert next(r for r in got if r[0] == 53)[2] == [(40, 27000, 3)]
    assert periodic.periodic_runs(frame(spark, [])).count() == 0


def test_planted_texts_are_those_of_the_contract(spark):
    rows = [(i, t) for i, t in awkward() if i != 53]
    got = sorted(((r["doc_id"], words(r["text"])) for r in with_planted_runs(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((i, planted(i, t)) for i, t in rows), key=str)


def test_query_equals_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, small).collect()}
    assert len(got) == len(rows)
    some = 0
    for i, t in rows:
        w = planted(i, t)
        runs = brute(w) if len(w) < 1200 else periodic.maximal_runs(w)
        some += bool(runs)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, " ".join(kept_of(w, runs)))]
        assert got[i] == (len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], *digest), i
    assert some > 5
    assert all(re.fullmatch("[0-9a-f]{64}", r[-1]) for r in got.values())
