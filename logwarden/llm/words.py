"""Words, word hashes and shingle hashes of whole texts, for code that runs inside tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd

#: Odd multipliers of the 64-bit mixing step (fixed values).
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_SEED = 20240229


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX[2])
    x ^= x >> np.uint64(31)
    return x


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ``keys`` ascending, the first place of each and the number of each key: ``np.unique``, but only distinct ones are sorted."""
    number, distinct = pd.factorize(keys)
    first = np.empty(len(distinct), np.int64)
    first[number[::-1]] = np.arange(len(keys) - 1, -1, -1)
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], first[order], rank[number]


def ascii_words(text: str | None) -> list[bytes]:
    """Maximal runs without the six ASCII white-space characters, as UTF-8 bytes; none for a null text."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    base = MIX[0] | 1
    with np.errstate(over="ignore"):
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


@lru_cache(maxsize=2)
def _values(lower: bool) -> np.ndarray:
    """A random 64-bit number per byte, the same for A-Z and a-z if ``lower``."""
    table = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64)
    if lower:
        table[65:91] = table[97:123]
    return table


def _bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts, a line feed behind each, and where each begins, with the total last."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8) if parts else np.empty(0, np.uint8), edges


def runs(raw: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of bytes that are not ``apart``; the last byte is."""
    change = np.flatnonzero(np.diff(apart.view(np.int8), prepend=np.int8(1)))
    return change[0::2], change[1::2]


def run_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of stretches of bytes: random values of the bytes in a polynomial, by running sums, mixed with the length."""
    if not len(raw):
        return np.empty(0, np.uint64)
    size = 1 << max(21, len(raw).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_values(lower)[raw] * up[: len(raw)], out=total[1:])
        return mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without the six ASCII white-space characters) of the texts in turn, and the texts' edges among them."""
    raw, edges = _bytes(texts)
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    begin, end = runs(raw, _WHITE[raw])
    return run_hashes(raw, begin, end, lower), np.searchsorted(begin, edges)


def shingles(hashes: np.ndarray, edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all runs of ``size`` words of each text, in turn, and their edges.

    ``hashes`` are the words of several texts, ``edges`` where each begins, with the total last. A text of fewer words has one run, all
    of them; a text without words has none.
    """
    counts = np.diff(edges)
    width = np.minimum(counts, size)
    number = np.where(counts > 0, counts - width + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(number)])
    at = np.repeat(edges[:-1] - bounds[:-1], number) + np.arange(bounds[-1])
    wide = np.repeat(width, number)
    out = wide.astype(np.uint64)
    short = bool((width[counts > 0] < size).any())
    with np.errstate(over="ignore"):
        for k in range(size):
            if short:
                some = np.flatnonzero(wide > k)
                out[some] = mixed(out[some] + hashes[at[some] + k] * np.uint64(MIX[0]))
            else:
                out = mixed(out + hashes[at + k] * np.uint64(MIX[0]))
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        one = np.sort(out[a:b])
        sets.append(one[np.concatenate([[True], one[1:] != one[:-1]])] if b > a else one)
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else out), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
