"""Operators on keyed state that take each key's rows in event-time order.

Micro-batches bring rows in any order within the watermark's delay. A key's rows therefore wait in its state until the
watermark has passed them; then an operator gets them in order, with a short list of numbers that it remembers from before,
and says which rows go out, what to remember and when to be called again although no row comes. So the outcome is that of the
whole input in order, however it was cut into batches and wherever the job was stopped and started again. Spark drops rows that come after
the watermark and counts them; an idle key leaves the state store.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "numbers binary, sizes array<int>, packs array<binary>, memory array<bigint>"
FOUND = "key string, kind string, us bigint, until bigint, row string"
FOUND_COLUMNS = ["key", "kind", "us", "until", "row"]
PACK = 1000  #: rows whose JSON is packed together
SPREAD = 64  #: keys for rows of one key that need no order
NONE = -(1 << 63)  #: stands for a missing time or tie

Row = tuple[int, int, int, int]  #: time in microseconds, tie, argument, and a handle that stands for the row's JSON


@dataclass
class Outcome:
    """What an operator makes of the rows that are due."""

    found: list[tuple[str, int, int, int | str]] = field(default_factory=list)  # kind, time, until, handle of the row or a text
    memory: list[int] = field(default_factory=list)
    wake: int | None = None  #: time at which ``memory`` has to be looked at again
    skip_before: int | None = None  #: rows before this time cannot matter any more


Operator = Callable[[Sequence[Row], list[int], int], Outcome]


def apart(key: Column, alone: Column, *parts: Column | str) -> Column:
    """``key`` for rows that depend on each other; rows that stand ``alone`` are spread over ``SPREAD`` keys by ``parts``."""
    return F.concat(key.cast("string"), F.when(alone, F.concat(F.lit("/"), F.pmod(F.xxhash64(*parts), F.lit(SPREAD)).cast("string"))).otherwise(F.lit("")))


def packed(texts: list[str]) -> bytes:
    """Lines of JSON, which hold no line break of their own."""
    return zlib.compress("\n".join(texts).encode(), 1)


def unpacked(pack: bytes) -> list[str]:
    return zlib.decompress(pack).decode().split("\n")


class Held:
    """Rows of a key: time, tie and argument as numbers, their JSON in packs of some ``PACK`` rows that are opened one at a time."""

    def __init__(self, numbers: bytes = b"", sizes: Sequence[int] = (), packs: Sequence[bytes] = ()) -> None:
        self.parts = [np.frombuffer(zlib.decompress(numbers), np.int64).reshape(3, -1).T] if numbers else [np.zeros((0, 3), np.int64)]
        self.sizes, self.packs = list(sizes), [bytes(p) for p in packs]

    def add(self, part: pd.DataFrame) -> None:
        part = part[part["us"] != NONE]
        texts = part["row"].tolist()
        self.parts.append(part[["us", "tie", "arg"]].to_numpy(np.int64))
        self._pack(texts)

    def _pack(self, texts: list[str]) -> None:
        for at in range(0, len(texts), PACK):
            self.sizes.append(len(texts[at:at + PACK]))
            self.packs.append(packed(texts[at:at + PACK]))

    @property
    def numbers(self) -> np.ndarray:
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        return self.parts[0]

    def stored(self) -> tuple[bytes, list[int], list[bytes]]:
        """What goes into the state; numbers by column, as they pack better."""
        return zlib.compress(self.numbers.T.tobytes(), 1), self.sizes, self.packs

    def texts(self, handles: np.ndarray) -> Iterator[tuple[int, str]]:
        """Places in ``handles`` and the JSON they stand for, pack by pack."""
        order = np.argsort(handles, kind="stable")
        ends = np.searchsorted(handles[order], np.cumsum([0, *self.sizes]))
        start = 0
        for size, pack, first, last in zip(self.sizes, self.packs, ends, ends[1:]):
            if last > first:
                lines = unpacked(pack)
                for place in order[first:last].tolist():
                    yield place, lines[int(handles[place]) - start]
            start += size

    def in_time(self, known: int) -> np.ndarray:
        """Handles of the rows up to ``known`` by time, tie, argument and JSON."""
        due = np.flatnonzero(self.numbers[:, 0] <= known)
        due = due[np.lexsort([self.numbers[due, c] for c in (2, 1, 0)])]
        equal = np.ones(max(len(due) - 1, 0), bool)
        for c in range(3):
            equal &= np.diff(self.numbers[due, c]) == 0
        if equal.any():
            tied = np.flatnonzero(np.append(equal, False) | np.append(False, equal))
            run = np.cumsum(np.append(True, ~equal))[tied]
            text = dict(self.texts(due[tied]))
            due[tied] = due[tied][sorted(range(len(tied)), key=lambda i: (run[i], text[i]))]
        return due

    def kept(self, which: np.ndarray) -> Held:
        """The rows marked; what is left of opened and of small packs is packed anew."""
        out, rest, whole, ends = Held(), [], [], np.cumsum([0, *self.sizes])
        for size, pack, start, end in zip(self.sizes, self.packs, ends, ends[1:]):
            mine = np.flatnonzero(which[start:end]) + start
            if len(mine) == size and 2 * size > PACK:
                whole.append(mine)
                out.sizes.append(size)
                out.packs.append(pack)
            elif len(mine):
                rest.append(mine)
        left = np.concatenate(rest) if rest else np.zeros(0, np.int64)
        out.parts = [self.numbers[np.concatenate([*whole, left])]]
        out._pack([text for _, text in self.texts(left)])  # ``left`` rises, so its texts come in its order
        return out


class Due(Sequence):
    """Rows of a :class:`Held` in the order of their handles; a row is made when it is asked for."""

    def __init__(self, held: Held, handles: np.ndarray) -> None:
        self.numbers, self.handles = held.numbers, handles

    def __len__(self) -> int:
        return len(self.handles)

    def __getitem__(self, at):
        if isinstance(at, slice):
            return [(*row, h) for row, h in zip(self.numbers[self.handles[at]].tolist(), self.handles[at].tolist())]
        return (*self.numbers[self.handles[at]].tolist(), int(self.handles[at]))

    def __iter__(self) -> Iterator[Row]:
        for at in range(0, len(self), 10 * PACK):
            yield from self[at:at + 10 * PACK]


def opened(found: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """``found`` with the columns ``fields`` that its rows carried instead of their JSON, whose names are short: a task reads a key's rows as text."""
    row = F.from_json("row", ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)))
    others = [c for c in found.columns if c != "row"]
    return found.select(*others, row.alias("row")).select(*others, *[F.col(f"row.c{i}").alias(f.name) for i, f in enumerate(fields)])


def take(key: str, parts: Iterator[pd.DataFrame], state: GroupState, operator: Operator) -> Iterator[pd.DataFrame]:
    """What ``operator`` finds among a key's rows that the watermark has passed; rows that it has not passed wait in the state."""
    numbers, sizes, packs, memory = state.get if state.exists else (b"", [], [], [])
    held = Held(numbers, sizes, packs)
    for part in parts:
        held.add(part)
    known = state.getCurrentWatermarkMs() * 1000
    done = operator(Due(held, held.in_time(known)), list(memory), known)
    us = held.numbers[:, 0]
    waiting = held.kept((us > known) & (us >= (NONE if done.skip_before is None else done.skip_before)))
    calls = [int(waiting.numbers[:, 0].min())] if len(waiting.numbers) else []
    calls += [done.wake] if done.wake is not None else []
    if len(waiting.numbers) or done.memory:
        state.update((*waiting.stored(), [int(m) for m in done.memory]))
        state.setTimeoutTimestamp(max(known // 1000 + 1, -(-min(calls, default=known) // 1000)))
    elif state.exists:
        state.remove()
    ready = [(key, *f) for f in done.found if isinstance(f[3], str)]
    found = [f for f in done.found if not isinstance(f[3], str)]
    for place, text in held.texts(np.array([f[3] for f in found], np.int64)):
        ready.append((key, *found[place][:3], text))
        if len(ready) >= 10 * PACK:
            yield pd.DataFrame(ready, columns=FOUND_COLUMNS)
            ready = []
    if ready:
        yield pd.DataFrame(ready, columns=FOUND_COLUMNS)


def in_order(rows: DataFrame, key: Column, ts: str, operator: Operator, tie: Column | None = None, arg: Column | None = None,
             carried: list[str] | None = None) -> DataFrame:
    """Key, kind, us, until and row (see :func:`opened`) of what ``operator`` finds; ``rows`` have a watermark on ``ts``.

    Rows without a key move the watermark and are else left out: a filter on the key would be pushed below the watermark.

    ``operator`` gets the due rows as (us, tie, arg, handle), sorted, its memory, and the time up to which all rows are known. A key is
    one group of a micro-batch, whose rows a task holds packed (24 bytes and the packed JSON each): choose the trigger so that a batch of
    the hottest key fits.
    """
    zero, none = F.lit(0).cast("bigint"), F.lit(NONE)
    carried = rows.columns if carried is None else carried
    narrow = rows.select(
        key.cast("string").alias("key"), F.col(ts).alias("_ts"), F.coalesce(F.unix_micros(ts), none).alias("us"), (zero if tie is None else F.coalesce(tie.cast("bigint"), none)).alias("tie"),
        (zero if arg is None else arg.cast("bigint")).alias("arg"), F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)])).alias("row"),
    )

    def call(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is None or key[0] != key[0]:
            return
        yield from take(key[0], parts, state, operator)

    return narrow.groupBy("key").applyInPandasWithState(call, FOUND, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def cooldown(due: list[Row], memory: list[int], known: int) -> Outcome:
    """Greedy cool-down, ``arg`` microseconds long: the first row fires, then each first one at or after the end. None is no thinning."""
    ready, found = (memory[0] if memory else None), []
    for us, _, cd, row in due:
        if cd <= 0:
            found.append(("fired", us, us, row))
        elif ready is None or us >= ready:
            found.append(("fired", us, us + cd, row))
            ready = us + cd
    if ready is None or ready <= known:
        return Outcome(found)
    return Outcome(found, [ready], ready, ready)


def jail(retry: int, find_us: int, ban_us: int) -> Operator:
    """A ban starts with the row that makes ``retry`` within ``find_us``, and ends by the clock of the rows; one at a time per key.

    Memory: the end of the ban (0 for none) and the last ``retry`` times, which decide whether the next row trips.
    """

    def run(due: list[Row], memory: list[int], known: int) -> Outcome:
        until, log, found = (memory[0] if memory else 0), memory[1:], []
        for at, (us, _, _, row) in enumerate(due):
            log = [*log, us][-retry:]
            if at + 1 < len(due) and due[at + 1][0] == us:
                continue  # rows of one time count together
            if until and us >= until:
                found.append(("unban", until, until, ""))
                until = 0
            if not until and len(log) == retry and log[0] > us - find_us:
                until = us + ban_us
                found.append(("ban", us, until, row))
        if until and until <= known:
            found.append(("unban", until, until, ""))
            until = 0
        log = [us for us in log if us > known - find_us]
        if not until and not log:
            return Outcome(found)
        return Outcome(found, [until, *log], min(t for t in (until, log[-1] + find_us if log else 0) if t))

    return run


def attempts(failures: int, span_us: int) -> Operator:
    """Each row goes out as ``login``; a failed one (``arg`` 1) that makes ``failures`` within ``span_us`` goes out as ``brute`` as well."""

    def run(due: list[Row], memory: list[int], known: int) -> Outcome:
        log, found, at = memory, [], 0
        while at < len(due):
            us, end = due[at][0], at
            while end < len(due) and due[end][0] == us:
                end += 1
            together = due[at:end]  # rows of one time count together
            log = [*log, *(us for r in together if r[2])][-failures:]
            tripped = len(log) == failures and log[0] > us - span_us
            for r in together:
                found.append(("login", us, us, r[3]))
                if tripped and r[2]:
                    found.append(("brute", us, us, r[3]))
            at = end
        log = [us for us in log if us > known - span_us]
        return Outcome(found, log, log[-1] + span_us if log else None)

    return run
