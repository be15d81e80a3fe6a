"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Inputs of a word are a vector of its own and the mean vector of its character trigrams. A text is cut into overlapping windows of words,
all of which are scored; the text's score is that of its most toxic window, calibrated. Training knows labels of whole texts only:
the first pass learns from windows of short texts, later ones from the windows that the network so far finds most toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .batches import cut
from .frames import fresh
from .samples import labelled_sample
from .words import MIX, _bytes, mixed, run_hashes, runs

WINDOW, STRIDE = 32, 24
WORDS, GRAMS, DIM, HIDDEN, POOL = 1 << 14, 1 << 12, 8, 8, 8

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Words:
    """The distinct words of some texts, and the windows of each text as rows of word numbers, -1 where there is no word."""

    def __init__(self, texts: list[str | None]):
        raw, edges = _bytes(texts)
        begin, end = runs(raw, ~_WORD[raw])
        hashes = run_hashes(raw, begin, end, True)
        distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        self.word = (distinct % np.uint64(WORDS)).astype(np.int64)
        low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint64)
        # character trigrams of each distinct word, with a mark before and behind
        b, n = begin[first], (end - begin)[first]
        self.size = n
        self.at = np.concatenate([[0], np.cumsum(n)])[:-1]
        place = np.arange(int(n.sum())) - np.repeat(self.at, n)
        here = np.repeat(b, n) + place
        left = np.where(place == 0, 1, low[here - 1]) if len(here) else low[:0]
        right = np.where(place == np.repeat(n, n) - 1, 2, low[np.minimum(here + 1, len(raw) - 1)]) if len(here) else low[:0]
        with np.errstate(over="ignore"):
            gram = mixed(((left << np.uint64(16)) | (low[here] << np.uint64(8)) | right).astype(np.uint64) + np.uint64(MIX[0]))
        self.gram = (gram % np.uint64(GRAMS)).astype(np.int64)
        # windows
        word_at = np.searchsorted(begin, edges)
        count = np.diff(word_at)
        many = np.where(count > 0, 1 + -(-np.maximum(count - WINDOW, 0) // STRIDE), 0)
        self.text_of = np.repeat(np.arange(len(texts)), many)
        self.edges = np.concatenate([[0], np.cumsum(many)])
        start = word_at[:-1][self.text_of] + (np.arange(len(self.text_of)) - self.edges[self.text_of]) * STRIDE
        spot = start[:, None] + np.arange(WINDOW)
        inside = spot < word_at[1:][self.text_of][:, None]
        self.windows = np.where(inside, number[np.minimum(spot, max(0, len(number) - 1))] if len(number) else 0, -1)


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    """Word vectors begin at zero, so that words never trained on say nothing."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    net = {"word": np.zeros((WORDS, DIM)), "gram": rng.normal(0, 0.3, (GRAMS, DIM)), "pool": draw(2 * HIDDEN, POOL), "mark": draw(POOL, 1)[:, 0],
           "out": draw(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1)}
    for way in "fb":
        net |= {f"{way}W": draw(2 * DIM, 3 * HIDDEN), f"{way}U": draw(HIDDEN, 3 * HIDDEN), f"{way}b": np.zeros(3 * HIDDEN)}
    return {k: v.astype(np.float32) for k, v in net.items()}


def _inputs(net: dict, words: Words) -> np.ndarray:
    """words x inputs, and a last row of zeros for no word."""
    x = np.zeros((len(words.word) + 1, 2 * DIM), np.float32)
    if len(words.word):
        x[:-1, :DIM] = net["word"][words.word]
        x[:-1, DIM:] = np.add.reduceat(net["gram"][words.gram], words.at, axis=0) / words.size[:, None]
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(net: dict, fed: dict[str, np.ndarray], windows: np.ndarray, keep: bool = False):
    """Logit of each window; ``fed`` has the words' inputs times W, by direction."""
    n, length = windows.shape
    mask = (windows >= 0).astype(np.float32)
    states = np.empty((length, n, 2 * HIDDEN), np.float32)
    saved: dict[str, list] = {"f": [None] * length, "b": [None] * length}
    for d, way in enumerate("fb"):
        h = np.zeros((n, HIDDEN), np.float32)
        for t in range(length) if way == "f" else range(length - 1, -1, -1):
            x, u = fed[way][windows[:, t]], h @ net[f"{way}U"]
            gates = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r, un = gates[:, :HIDDEN], gates[:, HIDDEN:], u[:, 2 * HIDDEN :]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * un)
            new = (c + z * (h - c)) * mask[:, t, None]
            if keep:
                saved[way][t] = (h, z, r, c, un)
            h = new
            states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
    inner = np.tanh(states @ net["pool"])
    weight = inner @ net["mark"] + (mask.T - 1) * 1e9
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    logit = pooled @ net["out"] + net["bias"][0]
    return (logit, mask, states, saved, inner, weight, pooled) if keep else logit


def _backward(net: dict, words: Words, x: np.ndarray, windows: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean loss over ``windows``."""
    fed = {w: x @ net[f"{w}W"] + net[f"{w}b"] for w in "fb"}
    logit, mask, states, saved, inner, weight, pooled = _forward(net, fed, windows, True)
    n, length = windows.shape
    d_logit = ((_sigmoid(logit) - label) / n).astype(np.float32)
    grad = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * net["out"]
    d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_inner = d_score[..., None] * net["mark"] * (1 - inner ** 2)
    grad["mark"] = np.einsum("tn,tnp->p", d_score, inner)
    grad["pool"] = np.einsum("tnh,tnp->hp", states, d_inner)
    d_states = weight[..., None] * d_pooled + d_inner @ net["pool"].T
    d_x = np.zeros_like(x)
    for d, way in enumerate("fb"):
        d_fed = np.zeros((len(x), 3 * HIDDEN), np.float32)
        d_u = np.zeros_like(net[f"{way}U"])
        carry = np.zeros((n, HIDDEN), np.float32)
        for t in range(length - 1, -1, -1) if way == "f" else range(length):
            h, z, r, c, un = saved[way][t]
            g = (carry + d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN]) * mask[:, t, None]
            d_c = g * (1 - z) * (1 - c ** 2)
            d_z = g * (h - c) * z * (1 - z)
            d_r = d_c * un * r * (1 - r)
            d_gate = np.concatenate([d_z, d_r, d_c], axis=1)
            into_u = np.concatenate([d_z, d_r, d_c * r], axis=1)
            d_u += h.T @ into_u
            np.add.at(d_fed, windows[:, t], d_gate)
            carry = g * z + into_u @ net[f"{way}U"].T
        grad[f"{way}U"], grad[f"{way}W"], grad[f"{way}b"] = d_u, x.T @ d_fed, d_fed[:-1].sum(axis=0)
        d_x += d_fed @ net[f"{way}W"].T
    grad["word"], grad["gram"] = np.zeros_like(net["word"]), np.zeros_like(net["gram"])
    used = np.unique(windows[windows >= 0])
    np.add.at(grad["word"], words.word[used], d_x[used, :DIM])
    spots = np.repeat(words.at[used], words.size[used]) + np.arange(int(words.size[used].sum())) - np.repeat(np.cumsum(words.size[used]) - words.size[used], words.size[used])
    np.add.at(grad["gram"], words.gram[spots], np.repeat(d_x[used, DIM:] / words.size[used, None], words.size[used], axis=0))
    return grad


def window_logits(net: dict, words: Words, at_once: int = 4096) -> np.ndarray:
    x = _inputs(net, words)
    fed = {w: (x @ net[f"{w}W"] + net[f"{w}b"]).astype(np.float32) for w in "fb"}
    parts = [_forward(net, fed, words.windows[k : k + at_once]) for k in range(0, len(words.windows), at_once)]
    return np.concatenate(parts) if parts else np.empty(0, np.float32)


def _largest(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The largest value of each text's windows, the smallest number where it has none."""
    out = np.full(len(edges) - 1, -np.inf)
    has = np.flatnonzero(np.diff(edges) > 0)
    if len(has):
        out[has] = np.maximum.reduceat(values, edges[:-1][has])
    return out


def train(sample: list[tuple[str, int]], share: float, epochs: int = 5, batch: int = 128, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """A network fitted to (text, toxic) pairs, with the calibration of a text's largest logit; ``share`` is that of toxic texts outside.

    Without both labels the score is ``share`` for every text with a word.
    """
    rng, net = np.random.default_rng(seed), initial(seed)
    label = np.array([y for _, y in sample])
    flat = {"slope": np.zeros(1), "shift": np.array([np.log((share + 1e-3) / (1 - share + 1e-3))])}
    if len(set(label.tolist())) < 2:
        return net | flat
    words = Words([t for t, _ in sample])
    toxic = label[words.text_of] == 1
    many = np.diff(words.edges)[words.text_of]
    m1, m2 = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}
    step = 0
    for epoch in range(epochs):
        logits = window_logits(net, words) if epoch else np.zeros(len(toxic))
        if epoch:
            top = _largest(logits, words.edges)[words.text_of]
            good = toxic & (logits >= np.maximum(top - 1.0, np.where(logits == top, -np.inf, 0.0)))
            bad = ~toxic & ((logits >= top) | (rng.random(len(toxic)) < 2 / np.maximum(many, 1)))
        else:
            good = toxic & (many <= max(3, np.sort(many[toxic])[min(toxic.sum() - 1, 600)]))
            bad = ~toxic & (rng.random(len(toxic)) < 3 / np.maximum(many, 1))
        x = _inputs(net, words)
        order = np.concatenate([np.flatnonzero(good), np.flatnonzero(bad)])
        rng.shuffle(order)
        size = min(batch, max(16, len(order) // 50))  # few windows make small steps, not few
        for k in range(0, len(order), size):
            part = order[k : k + size]
            used, local = np.unique(words.windows[part], return_inverse=True)
            sub = _Part(words, used[used >= 0])
            rows = local.reshape(len(part), -1) - (used[0] < 0)
            x = _inputs(net, sub)
            grad = _backward(net, sub, x, rows, toxic[part].astype(np.float32))
            step += 1
            for name, g in grad.items():
                g = g + 1e-5 * net[name]
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.99 * m2[name] + 0.01 * g * g
                net[name] = net[name] - (rate * (m1[name] / (1 - 0.9 ** step)) / (np.sqrt(m2[name] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    best = _largest(window_logits(net, words), words.edges)
    seen = np.isfinite(best)
    y, v = label[seen], best[seen]
    weigh = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    slope, shift = 1.0, 0.0
    for _ in range(200):  # weighted logistic regression on one number, with a little pull to slope 1
        p = _sigmoid(slope * v + shift)
        w = weigh * p * (1 - p) + 1e-9
        g = np.array([(weigh * (y - p) * v).sum() - 1e-3 * (slope - 1), (weigh * (y - p)).sum()])
        h = np.array([[(w * v * v).sum() + 1e-3, (w * v).sum()], [(w * v).sum(), w.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        slope, shift = max(0.05, slope + move[0]), shift + move[1]
    return net | {"slope": np.array([slope]), "shift": np.array([shift])}


class _Part:
    """Some of the words of others, numbered anew."""

    def __init__(self, words: Words, used: np.ndarray):
        self.word, self.size = words.word[used], words.size[used]
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1].astype(np.int64)
        spots = np.repeat(words.at[used] - self.at, self.size) + np.arange(int(self.size.sum()))
        self.gram = words.gram[spots]


def text_scores(net: dict, texts: list[str | None]) -> np.ndarray:
    """0 to 1 per text; 0 for a text without a word."""
    words = Words(texts)
    best = _largest(window_logits(net, words), words.edges)
    out = np.zeros(len(best))
    seen = np.isfinite(best)
    out[seen] = _sigmoid(net["slope"][0] * best[seen] + net["shift"][0])
    return out


def fitted(docs: DataFrame, labels: DataFrame, per_label: int = 700, most_bytes: int = 20_000) -> dict[str, np.ndarray]:
    """A network trained on about ``per_label`` texts of each label, of at most ``most_bytes`` bytes, none of them held out."""
    known = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null")
    learnt = known.filter(~held_out(F.col("doc_id")))
    n, bad = learnt.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    sample = [x for y in (0, 1) for x in labelled_sample(docs, known.filter(F.col("toxic") == y), "toxic", per_label, most_bytes, 4, 2)]
    return train(sample, bad / n if n else 0.0)


def with_scores(docs: DataFrame, labels: DataFrame, out: str) -> DataFrame:
    """``docs`` with the score of each text as a last column ``out``."""
    net = fitted(docs.select("doc_id", "text"), labels)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, "text"):
                scores = text_scores(shared.value, batch.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, out])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kept}, `{out}` double")


def scored_documents(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): held_out, score and predicted (score at least ``limit``).

    Null and empty texts and texts without a word have score 0. Repeated rows and null ids (never held out) have a result each; without
    labels of both kinds every text with a word has the share of toxic labels as score; an empty table gives an empty result;
    other columns are ignored.
    """
    rows = with_scores(docs.select("doc_id", "text"), labels, "score")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``limit``, with all columns and repeated rows."""
    score = fresh(docs, "_score")
    return with_scores(docs, labels, score).filter(F.col(score) < limit).drop(score)
