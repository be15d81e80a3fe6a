"""Maximal periodic runs of words, found from Lyndon roots that are extended both ways by suffix-tree queries, and texts without them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import cut
from .frames import fresh
from .lce import Extensions

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Least length of a run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def stretches(words: list, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> list[tuple[int, int]]:
    """Ascending parts (begin, end) of ``words`` outside which no run can be.

    A run of ``times`` periods holds each of its words ``times`` times, so none goes over a word that is rarer; a part so
    cut is counted again by itself, until it has no rare word.
    """
    found, todo = [], [(0, len(words))]
    while todo:
        begin, end = todo.pop()
        if end - begin < least:
            continue
        part = words[begin:end]
        count = Counter(part)
        rare = {w for w, n in count.items() if n < times}
        if not rare:
            found.append((begin, end))
        elif len(rare) < len(count):
            cuts = [begin - 1, *(begin + k for k, w in enumerate(part) if w in rare), end]
            todo.extend((a + 1, b) for a, b in zip(cuts, cuts[1:]) if b - a > least)
    return sorted(found)


def _next_beyond(rank: list[int], smaller: bool) -> list[int]:
    """For each suffix the next one to its right that is smaller (or larger) in order, else the end."""
    out, waiting = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while waiting and (rank[waiting[-1]] > r) == smaller:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


def maximal_runs(words: list, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """All (start, length, smallest period) of runs of at least ``least`` words and ``times`` (2 or more) periods, by start, then period.

    Some period of every run is the longest Lyndon word at its position, in the order of the words or the opposite one, and that word ends
    where the next smaller suffix begins. So each position gives two candidates; a common extension of the two suffixes a period
    apart, and one of the reversed prefixes, give the stretch over which the period holds.
    """
    parts = stretches(words, least, times)
    if not parts:
        return []
    known: dict = {}
    text, places = [], []
    for begin, end in parts:
        text.extend(known.setdefault(w, len(known)) for w in words[begin:end])
        text.append(-1)
        places.extend(range(begin, end + 1))
    ends = [i for i, x in enumerate(text) if x < 0]  # each part ends with a symbol of its own
    for k, i in enumerate(ends):
        text[i] = len(known) + k
    symbols, size = len(known) + len(parts) + 1, len(text)
    front = Extensions(text, symbols)
    back = Extensions([*text[:-1][::-1], symbols - 1], symbols)
    rank = front.rank.tolist()
    begin = np.concatenate([np.arange(size), np.arange(size)])
    follow = np.array(_next_beyond(rank, True) + _next_beyond(rank, False))
    period = follow - begin
    fit = (follow < size - 1) & (times * period < size)
    begin, follow, period = begin[fit], follow[fit], period[fit]
    right = front.common(begin, follow)
    far = period + right
    left = np.zeros(len(begin), np.int64)
    some = np.flatnonzero(begin > 0)
    left[some] = back.common(size - 1 - begin[some], size - 1 - follow[some])
    length = left + far
    good = length >= np.maximum(least, times * period)
    start = begin[good] - left[good]
    return sorted({(places[s], n, p) for s, n, p in zip(start.tolist(), length[good].tolist(), period[good].tolist())})


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that any run has after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> DataFrame:
    """``docs`` with ``runs``, an array of (start, length, period) in words, and ``collapsed_text``, the words outside repeated periods.

    Words are runs without the six ASCII white-space characters, numbered from 0; the collapsed text joins its words by one space. A null
    or blank text has no run and an empty collapsed text. Each row is handled by itself, in order of the input: repeated rows
    and null ids have results of their own, an empty table gives an empty result, and no shuffle is needed. Other columns stay; where
    one has the name of a new column, the new one gets a number. The trees of a text take memory in proportion to its
    words that are frequent enough to lie in a run (about 0.5 kB each), one text at a time.
    """
    out = {name: fresh(docs, name) for name in ("runs", "collapsed_text")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, "text"):
                found, kept = [], []
                for text in batch.column("text").to_pylist():
                    words = text.encode().split() if text else []
                    runs = maximal_runs(words, least, times)
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    kept.append(b" ".join(collapsed(words, runs)).decode())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(found, RUNS), pa.array(kept, pa.string())],
                    names=[*batch.schema.names, *out.values()])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{out['runs']}` array<struct<start: long, length: long, period: long>>, `{out['collapsed_text']}` string")
