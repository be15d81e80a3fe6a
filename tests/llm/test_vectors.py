import math
import random
from fractions import Fraction

import numpy as np
import pytest

from logwarden.llm import multiindex, whitening
from logwarden.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, n long, a int, query string, x string, count long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "q", "x", 4) for i, v in rows], SCHEMA)


def vectors(n, wide, seed=0, first=0):
    rng = np.random.default_rng(seed)
    return [(first + k, [float(x) for x in rng.normal(size=wide).astype(np.float32)]) for k in range(n)]


def odd(wide):
    fill = [0.5] * (wide - 1)
    return [(9001, None), (9002, []), (9003, [None, *fill]), (9004, [math.nan, *fill]), (9005, [math.inf, *fill]), (9006, [1.0])]


# ---- multi-index


def brute(rows, nearest=5, every=50):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    x = np.array([v for _, v in rows])
    score = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    out = {}
    for k, (i, v) in enumerate(rows):
        if i % every == 0:
            best = sorted((-round(score[k, j], 12), o) for j, (o, _) in enumerate(rows) if o != i)[:nearest]
            out[i, v] = [(o, -s) for s, o in best]
    return out


def searched(spark, rows, **own):
    out = {}
    for r in multiindex.nearest_neighbours(table(spark, rows), **own).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {k: sorted(v) for k, v in out.items()}


def test_small_table_is_searched_whole(spark):
    base = vectors(30, 4)
    rows = [*base, (30, base[0][1]), (31, base[0][1]), (31, base[0][1]), (32, [2 * x for x in base[1][1]]), (33, [0.0] * 4), (None, base[2][1]), *odd(4)]
    got, want = searched(spark, rows), brute([r for r in rows if r[0] not in (9006,)])
    assert set(got) == {0}
    (best,) = want.values()
    assert [(i, round(s, 12)) for _, i, s in got[0]] == [(i, round(s, 12)) for i, s in best]
    assert [r for r, _, _ in got[0]] == [1, 2, 3, 4, 5]
    assert got[0][0][1:] == (30, 1.0) or abs(got[0][0][2] - 1) < 1e-15


def test_copies_go_to_smaller_ids_and_few_rows_give_all(spark):
    copies = [(k, [1.0, 2.0, 3.0]) for k in range(200)]
    got = searched(spark, copies)
    assert [i for _, i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for _, i, _ in got[150]] == [0, 1, 2, 3, 4]
    assert len({s for v in got.values() for _, _, s in v}) == 1
    assert searched(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])[0][0][1] == 2
    assert len(searched(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])[0]) == 1
    assert searched(spark, [(0, [1.0, 0.0])]) == {} and searched(spark, []) == {} and searched(spark, odd(3)[:5]) == {}
    assert searched(spark, [(k, [float(k + 1)]) for k in range(7)])[0][0][1:] == (1, 1.0)


@pytest.mark.parametrize("pieces", [4096, 50])
def test_recall_on_clusters_with_a_hot_group(spark, monkeypatch, pieces):
    monkeypatch.setattr(multiindex, "PIECE_ENTRIES", pieces)
    monkeypatch.setattr(multiindex, "PIECE_QUERIES", 5)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    at = np.where(rng.random(1500) < 0.33, 0, rng.integers(0, 20, 1500))
    x = (centres[at] + rng.normal(scale=0.3, size=(1500, 16))).astype(np.float32)
    rows = [(k, [float(v) for v in x[k]]) for k in range(1500)]
    got, want = searched(spark, rows), brute(rows)
    hits = [len({i for _, i, _ in got[q]} & {i for i, _ in best}) / 5 for (q, _), best in want.items()]
    assert len(hits) == 30 and np.mean(hits) >= 0.9
    for q, found in got.items():
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(i != q for _, i, _ in found)
        assert [s for _, _, s in found] == sorted((s for _, _, s in found), reverse=True)
        for _, i, s in found:
            assert abs(s - float(x[q].astype(float) @ x[i] / np.linalg.norm(x[q].astype(float)) / np.linalg.norm(x[i].astype(float)))) < 1e-12


def test_query_has_recall(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got, want = {}, brute(rows)
    for r in QUERIES["op11_inverted_multi_index"](spark, small).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {i for i, _ in best}) / 5 for (q, _), best in want.items()]) >= 0.9


def test_pairs_leave_the_heap_by_rising_distance():
    rng = np.random.default_rng(1)
    index = multiindex.MultiIndex(rng.normal(size=(6, 3)), rng.normal(size=(5, 2)), 1.0)
    held = rng.integers(0, 4, (6, 5))
    for _ in range(50):
        q = rng.normal(size=5)
        near, far = multiindex.distances(q[None, :3], index.first)[0], multiindex.distances(q[None, 3:], index.second)[0]
        pairs = sorted((near[a] + far[b], a, b) for a in range(6) for b in range(5))
        need, met, want = int(rng.integers(1, 60)), 0, set()
        for _, a, b in pairs:
            if met >= need:
                break
            met += held[a, b]
            want.add((a, b))
        order = np.argsort(far, kind="stable").tolist()
        assert {(a, order[j]) for a, n in index.reach(q, held, need).items() for j in range(n)} == want
        assert [index.turns(q[None])[0][b] for b in order] == list(range(5))


# ---- whitening


def integers(rows, wide):
    good = [(i, v) for i, v in rows if v and len(v) == wide and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, [max(-(2 ** 63), min(2 ** 63 - 1, math.floor(Fraction(256) * Fraction(float(np.float32(c)))))) for c in v]) for i, v in good]


def whitened(spark, rows, **own):
    out = {}
    for r in whitening.whitened_vectors(table(spark, rows), **own).collect():
        out.setdefault((r["vec_id"], r["component"]), []).append(r)
    return out


@pytest.mark.parametrize("scale", [1.0, 300.0, 1e12])
def test_whitening_equals_exact_figures(spark, scale):
    rows = [(i, [float(np.float32(x * scale * (1 + k))) for k, x in enumerate(v)]) for i, v in vectors(150, 6, seed=4)]
    rows += [(700, rows[0][1]), (701, rows[0][1]), (701, rows[0][1]), (None, rows[3][1]), *odd(6)]
    x = integers(rows, 6)
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(v[k] for v in fit) for k in range(6)]
    cov = np.array([[float(Fraction(sum((n * v[a] - sums[a]) * (n * v[b] - sums[b]) for v in fit), n ** 3)) for b in range(6)] for a in range(6)])
    value, vector = np.linalg.eigh(cov)
    got = whitened(spark, rows)
    assert sum(map(len, got.values())) == 4 * len(x)
    for i, v in x:
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        for c in range(1, 5):
            r = next(r for r in got[i, c] if r["n"] == n)
            z = sum(float(Fraction(n * a - s, n)) * w for a, s, w in zip(v, sums, vector[:, -c])) / math.sqrt(value[-c])
            assert abs(abs(r["whitened"]) - abs(z)) < 1e-6
            assert abs(r["explained"] - value[-c] / np.trace(cov)) < 1e-9
            assert (r["deviation"], r["deviation_digits"]) == ((deviation, None) if deviation < 2 ** 63 else (None, str(deviation)))
            assert r["identity_error"] < 1e-9


def test_bit_planes_give_exact_products():
    rng = random.Random(2)
    for least, most, rows in ((-5, 5, 1), (0, 0, 3), (-2 ** 63, 2 ** 63 - 1, 70), (-300, 300, 1000), (2 ** 40, 2 ** 40 + 9, 130)):
        block = [[rng.randint(least, most) for _ in range(3)] for _ in range(rows)]
        sums, products = whitening.scatter(np.array(block, np.int64))
        assert sums.tolist() == [sum(r[a] for r in block) for a in range(3)]
        assert products.tolist() == [[sum(r[a] * r[b] for r in block) for b in range(3)] for a in range(3)]


def test_degenerate_tables(spark):
    assert whitened(spark, []) == {} and whitened(spark, odd(3)[:5]) == {}
    one = whitened(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert set(one) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for v in one.values() for r in v} == {(1, 0, None, None, None)}
    flat = whitened(spark, [(1, [0.5, 1.0]), (2, [0.5, 2.0])])
    assert [(flat[1, c][0]["whitened"] is None, flat[1, c][0]["explained"]) for c in (1, 2)] == [(False, 1.0), (True, 0.0)]
    assert flat[1, 1][0]["identity_error"] < 1e-12
    huge = whitened(spark, [(1, [3e38, 1.0]), (2, [-3e38, 1.0])])
    assert huge[1, 1][0]["deviation"] is None and abs(abs(huge[1, 1][0]["whitened"]) - 1) < 1e-12


def test_one_whitening_for_all_rows_of_the_table(spark, small):
    got = QUERIES["op13_bit_sliced_whitening"](spark, small).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert len(got) == 4 * len(rows)
    fit = np.array(sorted({tuple(v) for _, v in integers(rows, 64)}))
    assert {r["n"] for r in got} == {len(fit)} and max(r["identity_error"] for r in got) <= 1e-4
    z = {}
    for r in got:
        z.setdefault(r["vec_id"], [0.0] * 4)[r["component"] - 1] = r["whitened"]
    value, vector = np.linalg.eigh(np.cov(fit.T, bias=True))
    plain = (np.array([v for _, v in integers(rows, 64)]) - fit.mean(axis=0)) @ vector[:, -1:-5:-1] / np.sqrt(value[-1:-5:-1])
    mine = np.array([z[i] for i, _ in rows])
    sign = np.sign((plain * mine).sum(axis=0))
    assert np.abs(plain * sign - mine).max() < 1e-8
