"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is read as lower-case words of letters with a boundary before and behind. A model counts character n-grams inside words, over
all training texts, in Spark; probabilities of all seen n-grams, interpolated down to single characters, and the weights of all seen
contexts stand in arrays sorted by hash. The language with the lowest cross-entropy per character is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .batches import cut
from .frames import sized, written
from .words import MIX, distinct_keys, mixed

NAMED = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"
UNKNOWN = "und"
_TOP = (1 << 63) - 1


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


class Letters:
    """Code points of texts in lower case, each run of others than letters made one boundary 0; remembers which are letters."""

    def __init__(self):
        self.known = np.zeros(0x110000, np.int8)  # 1: letter, 2: none

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts in a row, and the number of the text each is in. Every text begins with a boundary."""
        parts = [np.frombuffer(("\0" + (t or "").lower() + "\0").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        codes = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        text_of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        kind = self.known[codes]
        if (kind == 0).any():
            for c in np.unique(codes[kind == 0]).tolist():
                self.known[c] = 1 if chr(c).isalpha() else 2
            kind = self.known[codes]
        codes = np.where(kind == 1, codes, 0)
        keep = (codes != 0) | np.concatenate([[True], (codes[:-1] != 0) | (text_of[1:] != text_of[:-1])])
        return codes[keep], text_of[keep]


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 .. ``order`` the hash of the k symbols that end at each place."""
    out = []
    value = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, order + 1):
            back = np.zeros(len(codes), np.uint64)
            back[k - 1 :] = codes[: len(codes) - k + 1]
            value = mixed(value + (back + np.uint64(1)) * np.uint64(MIX[0]))
            out.append(value)
    return out


def depths(codes: np.ndarray, order: int) -> np.ndarray:
    """How many symbols the longest n-gram has that ends at each place and does not reach behind the boundary before; 0 at a first boundary."""
    at = np.arange(len(codes))
    edge = np.where(codes == 0, at, 0)
    before = np.concatenate([[-1], np.maximum.accumulate(edge)[:-1]]) if len(codes) else edge
    first = (codes == 0) & np.concatenate([[True], codes[:-1] == 0]) if len(codes) else edge
    return np.where(first, 0, np.minimum(order, at - before + 1))


def counted(docs: DataFrame, order: int) -> DataFrame:
    """lang, gram, n: how often each longest n-gram occurs in the texts of each language; counts are combined in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held = Letters(), {}

        def told():
            rows = [(lang, g, n) for lang, own in held.items() for g, n in own.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                               pa.array([r[2] for r in rows], pa.int64())], names=["lang", "gram", "n"])

        for whole in batches:
            for batch in cut(whole, "text"):
                langs, texts = np.array(batch.column("lang").to_pylist(), object), batch.column("text").to_pylist()
                for lang in sorted(set(langs)):
                    codes, _ = letters([texts[i] for i in np.flatnonzero(langs == lang)])
                    depth, grams, own = depths(codes, order), gram_hashes(codes, order), held.setdefault(lang, {})
                    for k in range(1, order + 1):
                        at = np.flatnonzero(depth == k)
                        _, first, n = np.unique(grams[k - 1][at], return_index=True, return_counts=True)
                        windows = np.stack([codes[at[first] - k + 1 + j] for j in range(k)], axis=1).astype("<u4") if len(first) else []
                        for w, c in zip(windows, n.tolist()):
                            g = w.tobytes().decode("utf-32-le", "surrogatepass").replace("\0", " ")
                            own[g] = own.get(g, 0) + c
                if sum(map(len, held.values())) > 500_000:
                    yield told()
        if held:
            yield told()

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted hashes of seen n-grams with their log-probability, and of seen contexts with the log-weight of what is below, per order."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float

    @classmethod
    def fitted(cls, grams: dict[str, int], order: int) -> Model:
        """Interpolated Kneser-Ney from counts of longest n-grams; those that begin at a boundary count as often as they occur."""
        levels: list[dict[str, int]] = [{} for _ in range(order + 1)]
        for g, n in grams.items():
            levels[len(g)][g] = levels[len(g)].get(g, 0) + n
        for k in range(order, 1, -1):  # how many symbols an n-gram follows
            for g in levels[k]:
                if not g[1:].startswith(" ") or len(g) == 2:
                    levels[k - 1][g[1:]] = levels[k - 1].get(g[1:], 0) + 1
        letters = len(levels[1]) + 1
        below: dict[str, float] = {}
        out_g, out_c = [], []
        floor = 1.0 / letters
        for k in range(1, order + 1):
            level = levels[k]
            ones, twos = sum(n == 1 for n in level.values()), sum(n == 2 for n in level.values())
            off = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
            total: dict[str, int] = {}
            kinds: dict[str, int] = {}
            for g, n in level.items():
                total[g[:-1]] = total.get(g[:-1], 0) + n
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            weight = {h: off * kinds[h] / total[h] for h in total}
            here = {}
            for g, n in level.items():
                h = g[:-1]
                low = floor if k == 1 else below.get(g[1:], 0.0) or floor
                here[g] = max(n - off, 0.0) / total[h] + weight[h] * low
            out_g.append(_sorted({g: np.log(p) for g, p in here.items()}, k))
            out_c.append(_sorted({h: np.log(w) for h, w in weight.items()}, k - 1))
            below = here
        return cls(out_g, out_c, float(np.log(floor)))

    def log_probabilities(self, hashes: list[np.ndarray], before: list[np.ndarray], depth: np.ndarray) -> np.ndarray:
        """Of the symbol at each place after those in front of it, from the longest order seen down."""
        out = np.zeros(len(depth))
        done = depth == 0
        order = len(self.grams)
        for k in range(order, 0, -1):
            at = np.flatnonzero(~done & (depth >= k))
            if not len(at):
                continue
            found, value = _found(*self.grams[k - 1], hashes[k - 1][at])
            out[at[found]] += value[found]
            done[at[found]] = True
            rest = at[~found]
            if k > 1:
                seen, value = _found(*self.contexts[k - 1], before[k - 2][rest])
                out[rest[seen]] += value[seen]
            else:
                _, weight = self.contexts[0]
                out[rest] += self.floor + (weight[0] if len(weight) else 0.0)
        return out


def _hashes(grams: list[str], length: int) -> np.ndarray:
    """The hash of each of ``grams``, all of ``length`` symbols."""
    value = np.zeros(len(grams), np.uint64)
    if not length:
        return value
    flat = "".join(grams).replace(" ", "\0").encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(flat, np.uint32).reshape(-1, length)
    with np.errstate(over="ignore"):
        for j in range(length - 1, -1, -1):
            value = mixed(value + (codes[:, j].astype(np.uint64) + np.uint64(1)) * np.uint64(MIX[0]))
    return value


def _sorted(values: dict[str, float], length: int) -> tuple[np.ndarray, np.ndarray]:
    value = _hashes(list(values), length)
    order = np.argsort(value)
    return value[order], np.array(list(values.values()))[order]


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


class Scorer:
    """Cross-entropies per character of whole texts under every model; each distinct word of the texts at hand is scored once.

    What a symbol costs depends on the longest n-gram that ends there alone, so the costs of at most about ``limit`` n-grams are remembered.
    """

    def __init__(self, models: dict[str, Model], order: int, limit: int = 500_000):
        self.models, self.order, self.letters, self.limit = models, order, Letters(), limit
        self._reset()

    def _reset(self) -> None:
        # ascending hashes of n-grams, and under each model the log-probability of their last symbol
        self.keys, self.values = np.empty(0, np.uint64), [np.empty(0) for _ in self.models]

    def _symbols(self, own: np.ndarray, depth: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Under each model the log-probabilities of known n-grams, and for each place of ``own`` which of these is its own."""
        hashes = gram_hashes(own, self.order)
        key = np.where(depth > 0, np.stack(hashes)[depth - 1, np.arange(len(own))], np.uint64(0))
        distinct, first, number = distinct_keys(key)
        if len(self.keys) > self.limit:
            self._reset()
        spot = np.searchsorted(self.keys, distinct)
        seen = np.zeros(len(distinct), bool)
        inside = spot < len(self.keys)
        seen[inside] = self.keys[spot[inside]] == distinct[inside]
        new = np.flatnonzero(~seen)
        if len(new):
            at = first[new]
            here = [h[at] for h in hashes]
            before = [np.where(at > 0, h[at - 1], np.uint64(0)) for h in hashes]
            for j, model in enumerate(self.models.values()):
                self.values[j] = np.insert(self.values[j], spot[new], model.log_probabilities(here, before, depth[at]))
            self.keys = np.insert(self.keys, spot[new], distinct[new])
            spot = np.searchsorted(self.keys, distinct)
        return self.values, spot[number]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """texts x languages cross-entropies, and the number of characters they are over (0: no letter)."""
        codes, text_of = self.letters(texts)
        depth = depths(codes, self.order)
        # a word: its letters and the boundary behind; places of one word stand together
        inside = depth > 0
        begins = inside & (np.concatenate([[0], codes[:-1]]) == 0) if len(codes) else inside
        start = np.flatnonzero(begins)
        if not len(start):
            return np.zeros((len(texts), len(self.models))), np.zeros(len(texts), np.int64)
        stop = np.append(start[1:], len(codes))
        lasts = np.flatnonzero(inside)
        length = np.diff(np.append(np.searchsorted(lasts, start), len(lasts)))
        del stop
        with np.errstate(over="ignore"):
            spot = lasts - np.repeat(start, length)
            key = np.add.reduceat(mixed((codes[lasts].astype(np.uint64) << np.uint64(32)) + spot.astype(np.uint64) + np.uint64(MIX[0])),
                                  np.cumsum(length) - length)
        _, first, back = distinct_keys(key)
        # the distinct words in a row, each with the boundary before it
        width = length[first] + 1
        ends = np.cumsum(width)
        at = np.repeat(start[first] - 1 - (ends - width), width) + np.arange(ends[-1])
        own = codes[at].copy()
        own[ends - width] = 0
        place = np.arange(len(own)) - np.repeat(ends - width, width)
        own_depth = np.where(place == 0, 0, np.minimum(self.order, place + 1))
        values, number = self._symbols(own, own_depth)
        words_of = text_of[start]
        size = np.bincount(words_of, weights=length, minlength=len(texts)).astype(np.int64)
        out = np.zeros((len(texts), len(self.models)))
        for j, value in enumerate(values):
            each = np.add.reduceat(value[number], ends - width)
            out[:, j] = -np.bincount(words_of, weights=each[back], minlength=len(texts)) / np.maximum(1, size)
        return out, size


def levels(grams: DataFrame, order: int) -> list[DataFrame]:
    """For k = 1 .. ``order`` lang, gram, n of the n-grams of k symbols: as often as they occur if they begin at a boundary, else how
    many symbols they follow. ``grams`` is what ``counted`` gives, written."""
    of = lambda k: grams.filter(F.char_length("gram") == k)
    out = [written(of(order), "level")]
    for k in range(order, 1, -1):
        shorter = F.substring("gram", 2, k - 1)
        follows = out[0].filter(~shorter.startswith(" ") | F.lit(k == 2)).select("lang", shorter.alias("gram"), F.lit(1).cast("long").alias("n"))
        out.insert(0, written(of(k - 1).unionByName(follows).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "level"))
    return out


def weighed(grams: DataFrame, order: int) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """lang and floor of each model, and per order lang, gram, p of all seen n-grams and lang, h, weight of all seen contexts: as ``Model.fitted``."""
    counts = levels(grams, order)
    floors = sized(written(counts[0].groupBy("lang").agg((F.lit(1.0) / (F.count(F.lit(1)) + 1)).alias("floor")), "floors"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k, level in enumerate(counts, 1):
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        off = F.when(ones + twos > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.1), ones / (ones + 2 * twos)))).otherwise(F.lit(0.5))
        offs = sized(written(level.groupBy("lang").agg(off.alias("off")).join(floors, "lang"), "discounts"))
        rows = level.withColumn("h", F.substring("gram", 1, k - 1) if k > 1 else F.lit(""))
        contexts = rows.groupBy("lang", "h").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).join(offs, "lang")
        contexts = written(contexts.withColumn("weight", F.col("off") * F.col("kinds") / F.col("total")), "contexts")
        here = rows.join(contexts, ["lang", "h"])
        if out:
            below = out[-1][0].select("lang", F.col("gram").alias("_low"), F.col("p").alias("_p"))
            here = here.withColumn("_low", F.substring("gram", 2, k - 1)).join(below, ["lang", "_low"], "left")
        low = F.coalesce("_p", "floor") if out else F.col("floor")
        p = F.greatest(F.col("n") - F.col("off"), F.lit(0.0)) / F.col("total") + F.col("weight") * low
        out.append((written(here.select("lang", "gram", p.alias("p")), "probabilities"), contexts.select("lang", "h", "weight")))
    return floors, out


def _hashed(rows: DataFrame, length: int, k: int, context: bool) -> DataFrame:
    """lang, k, context, hash and logarithm from rows of lang, n-gram and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            values = np.log(batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, context)),
                 pa.array(_hashes(batch.column(1).to_pylist(), length).view(np.int64)), pa.array(values)],
                names=["lang", "k", "context", "hash", "value"])

    return rows.mapInArrow(run, "lang string, k int, context boolean, hash long, value double")


def fit_models(train: DataFrame, order: int) -> dict[str, Model]:
    """A model per language from all rows and all n-grams of ``train``; the driver only takes the finished arrays, a language at a time."""
    floors, orders = weighed(written(counted(train, order), "grams"), order)
    tables = [_hashed(t, length, k, c) for k, (p, w) in enumerate(orders, 1) for t, length, c in ((p, k, False), (w, k - 1, True))]
    arrays, models = written(reduce(DataFrame.unionByName, tables), "models"), {}
    for lang, floor in floors.orderBy("lang").collect():
        own = arrays.filter(F.col("lang") == lang).select("k", "context", "hash", "value").toArrow()
        ks, contexts, hashes, values = (c.to_numpy() for c in own.columns)
        hashes = hashes.view(np.uint64)
        parts: dict[bool, list] = {False: [], True: []}
        for k in range(1, order + 1):
            for c in parts:
                at = np.flatnonzero((ks == k) & (contexts == c))
                at = at[np.argsort(hashes[at])]
                parts[c].append((hashes[at], values[at]))
        models[lang] = Model(parts[False], parts[True], float(np.log(floor)))
    return models


def _scored(docs: DataFrame, models: dict[str, Model], order: int) -> DataFrame:
    """``docs`` with entropies per language (in the order of the models) and characters."""
    names = [f for f in docs.schema.fields if f.name != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, order)
        for whole in batches:
            for batch in cut(whole, "text"):
                entropy, size = scorer(batch.column("text").to_pylist())
                wide = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * entropy.shape[1], pa.int32()), pa.array(entropy.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in names), wide, pa.array(size)], names=[*(f.name for f in names), "entropy", "size"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    return docs.mapInArrow(run, f"{kept}, entropy array<double>, size long")


def calibrated(rows: DataFrame, langs: list[str]) -> tuple[float, list[float]]:
    """The sharpness that makes the chosen language's share of belief likeliest, and each language's largest entropy that is accepted.

    ``rows`` (lang, entropy) are scored texts of ``langs``; all of them count, in one aggregate per language.
    """
    if not langs:
        return 1.0, []
    steps = [float(s) for s in np.geomspace(1, 100, 25)]
    own = F.get("entropy", F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1)
    best = F.array_min("entropy")
    rows = rows.select("lang", own.alias("own"), F.transform("entropy", lambda x: x - best).alias("over"), (own - best).alias("behind"))
    fits = [F.sum(-F.col("behind") * s - F.log(F.aggregate("over", F.lit(0.0), lambda a, x: a + F.exp(x * F.lit(-s))))).alias(f"fit_{k}") for k, s in enumerate(steps)]
    found = {r["lang"]: r for r in rows.groupBy("lang").agg(F.avg("own").alias("mean"), F.stddev_pop("own").alias("dev"), *fits).collect()}
    limit = [found[x]["mean"] + 6 * found[x]["dev"] + 0.5 if x in found else float("inf") for x in langs]
    if not found:
        return 10.0, limit
    return max((sum(found[x][f"fit_{k}"] for x in langs if x in found), s) for k, s in enumerate(steps))[1], limit


def calibration_sample(train: DataFrame, share: float, rows: int) -> DataFrame:
    """doc_id, lang, text of about ``share`` of the distinct rows, by a hash of id and text; never more than 2 * ``rows``.

    For a look at the rows; nothing is learnt from it.
    """
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    return train.filter(hashed <= F.lit(min(_TOP, int(share * 2.0**63)))).select("doc_id", "lang", "text").distinct().limit(2 * rows)


def identified_documents(docs: DataFrame, order: int = 5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): held_out, lang_pred, score, cross_entropy (nats per character) and rejected.

    Learnt from the text and lang of all rows that are not held out and have both; scored are all rows, once, by their text alone. ``und``
    with score 0 stands for a null text, a text without a letter, and for every text if nothing could be learnt. ``rejected`` marks texts
    less likely under the chosen model than its own texts are, calibrated with the sharpness of ``score`` on all training
    rows. Ties go to the first language by name. Repeated rows and null ids have a result each (a null
    id is not held out); an empty table gives an empty result; other columns are ignored.
    """
    learnt = ~held_out(F.col("doc_id")) & F.col("lang").isNotNull()
    models = fit_models(docs.filter(learnt & F.col("text").isNotNull()).select("lang", "text"), order)
    langs = list(models)
    rows = written(_scored(docs.select("doc_id", "lang", "text"), models, order), "entropies")
    sharp, limit = calibrated(rows.filter(learnt & (F.col("size") > 0)).select("lang", "entropy"), langs)
    best = F.array_min("entropy")
    at = F.array_position("entropy", best).cast("int")
    named = F.array(*map(F.lit, langs)) if langs else F.array(F.lit(UNKNOWN))
    belief = F.lit(1.0) / F.aggregate("entropy", F.lit(0.0), lambda a, x: a + F.exp((best - x) * sharp))
    known = (F.col("size") > 0) & F.lit(bool(langs))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(known, F.get(named, at - 1)).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(known, belief).otherwise(F.lit(0.0)).alias("score"), F.when(known, best).alias("cross_entropy"),
        F.when(known, best > F.get(F.array(*map(F.lit, limit or [0.0])), at - 1)).otherwise(F.lit(True)).alias("rejected"))
