"""Whole texts to token ids with a given tokenizer file, remembering the ids of pieces that come again.

Texts are cut where the tokenizer itself never joins characters, each distinct piece at hand is looked up once, and a text's ids are
those of its pieces in turn. Texts in which such cuts are not safe are encoded whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import xxhash

from .words import _WHITE, _bytes, distinct_keys, run_hashes, runs

_SPACED = re.compile(r"[ \n]?\S+|\s+(?=\s\S)|\s+")
#: White space to one of the two regex dialects only, so that cuts at it may differ.
_UNSURE = re.compile("[\x1c-\x1f\x85᠎​]")

#: Texts of printable ASCII, blanks, line feeds and Latin-1 letters, for which it is known how tokenizers fold, split and spell.
_PLAIN = re.compile("[ \n\x21-\x7eÀ-ÖØ-öø-ÿ]*")
_DROPPING = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
_KEEPING = re.compile("'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\\s+(?!\\S)|\\s+")


def _spelling() -> dict[int, str]:
    """Byte-level spelling: visible bytes stand for themselves, the others for characters from 256 on; UTF-8 for Latin-1 letters."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return {c: "".join(byte[b] for b in chr(c).encode()) for c in range(256)}


_SPELT = _spelling()

#: Bytes of plain texts by what the patterns above keep together: letters 1, digits 2, others 3; white space 0.
_CLASS = np.full(256, 3, np.int8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58], _CLASS[_WHITE] = 2, 0


def _words(text: str) -> list[str]:
    """Pieces between ASCII white space, which a tokenizer that drops white space never crosses."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


class Encoder:
    """Ids of texts by one tokenizer file; about ``limit`` stretches of text are remembered."""

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        pre = str(self.tokenizer.pre_tokenizer)
        self.drops_space = "invert=True" in pre or "Removed" in pre
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self._reset()

    def _reset(self) -> None:
        # sorted hashes of known stretches and their numbers; by number, where the ids stand
        self.keys, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.starts, self.lengths, self.known = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0
        self.flat, self.used = np.zeros(4096, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32), 0

    def _plain(self, text: str) -> bool:
        return bool(_PLAIN.fullmatch(text)) and not any(t in text for t in self.added)

    def _stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of plain texts, begin and end of the stretches they are cut into, and the edges of the texts among these.

        A stretch is a run that is not white; a tokenizer that keeps white space gets the last blank or line feed before it too,
        and the white space before that as a stretch of its own. A run without an apostrophe, where the patterns depend on what
        stands around, is cut further between letters, digits and others, so that fewer stretches are distinct.
        """
        raw, edges = _bytes(texts)
        begin, end = runs(raw, _WHITE[raw])
        kind = _CLASS[raw]
        apart = kind[1:] != kind[:-1]
        if self.drops_space:  # each digit stands alone
            apart |= kind[1:] == 2
        inner = np.flatnonzero(apart & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        if len(inner):
            marked = np.zeros(len(begin) + 1, bool)
            marked[np.searchsorted(begin, np.flatnonzero(raw == 39), side="right") - 1] = True
            inner = inner[~marked[np.searchsorted(begin, inner, side="right") - 1]]
        if self.drops_space and len(inner):
            begin, end = np.sort(np.concatenate([begin, inner])), np.sort(np.concatenate([end, inner]))
            inner = inner[:0]
        if not self.drops_space:
            text_of = np.searchsorted(edges, begin, side="right") - 1
            first = edges[text_of]
            before = np.maximum(np.concatenate([[0], end[:-1]]), first) if len(begin) else begin
            lead = begin - (begin > first)
            tails = np.maximum(edges[:-1], np.concatenate([[0], end])[np.searchsorted(begin, edges[1:])])
            all_begin = np.concatenate([before, lead, tails])
            all_end = np.concatenate([lead, end, edges[1:] - 1])
            some = all_end > all_begin
            begin, end = np.sort(np.concatenate([all_begin[some], inner])), np.sort(np.concatenate([all_end[some], inner]))
        return raw, begin, end, np.searchsorted(begin, edges)

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text that is not plain."""
        if any(t in text for t in self.added):
            return [text]
        if self.drops_space:
            return _words(text)
        return [text] if _UNSURE.search(text) else _SPACED.findall(text)

    def _spelt(self, stretches: list[str]) -> list[list[int]]:
        """The ids of stretches of plain text: they are split as the tokenizer does; the merges are the tokenizer's own."""
        tokenize = self.tokenizer.model.tokenize
        split = _DROPPING.findall if self.drops_space else _KEEPING.findall
        return [[t.id for w in (split(x) if "'" in x or x[0] == "\n" else (x,)) for t in tokenize(w.translate(_SPELT))] for x in stretches]

    def _learn(self, lists: list[list[int]]) -> np.ndarray:
        """New numbers for stretches with these ids."""
        lengths = np.fromiter(map(len, lists), np.int32, len(lists))
        n, top = int(lengths.sum()), self.known + len(lists)
        if top > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * top), np.resize(self.lengths, 2 * top)
        if self.used + n > len(self.flat):
            self.flat = np.resize(self.flat, 3 * (self.used + n) // 2)
        self.flat[self.used : self.used + n] = np.fromiter(chain.from_iterable(lists), self.flat.dtype, n)
        ends = self.used + np.cumsum(lengths, dtype=np.int64)
        self.starts[self.known : top], self.lengths[self.known : top] = ends - lengths, lengths
        new = np.arange(self.known, top, dtype=np.int32)
        self.known, self.used = top, self.used + n
        return new

    def _numbers(self, keys: np.ndarray, ids_of) -> np.ndarray:
        """The numbers of ascending distinct keys; ``ids_of`` gives the ids of those at the given places."""
        spot = np.searchsorted(self.keys, keys)
        seen = np.zeros(len(keys), bool)
        inside = spot < len(self.keys)
        seen[inside] = self.keys[spot[inside]] == keys[inside]
        new = np.flatnonzero(~seen)
        if len(new):
            numbers = self._learn(ids_of(new.tolist()))
            self.keys, self.numbers = np.insert(self.keys, spot[new], keys[new]), np.insert(self.numbers, spot[new], numbers)
            spot = np.searchsorted(self.keys, keys)
        return self.numbers[spot]

    def __call__(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin, with the total last; ``end`` is put behind each text's ids."""
        if self.known > self.limit:
            self._reset()
        plain = [i for i, t in enumerate(texts) if self._plain(t)]
        raw, begin, stop, edges = self._stretches([texts[i] for i in plain])
        distinct, first, number = distinct_keys(run_hashes(raw, begin, stop, self.drops_space))  # which lowers A-Z too
        b, e = begin[first].tolist(), stop[first].tolist()

        def spelt(places: list[int]) -> list[list[int]]:
            flat = raw.tobytes()
            own = [flat[b[i] : e[i]].decode() for i in places]
            return self._spelt("\n".join(own).lower().split("\n") if self.drops_space else own)

        at = self._numbers(distinct, spelt)[number]
        text_of = np.repeat(np.array(plain, np.int64), np.diff(edges))
        rest = sorted(set(range(len(texts))) - set(plain))
        if rest:
            lists = [self._pieces(texts[i]) for i in rest]
            pieces = [p for own in lists for p in own]
            encode = self.tokenizer.encode
            hashes = np.array([xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) for p in pieces], np.uint64)
            distinct, one, number = np.unique(hashes, return_index=True, return_inverse=True)
            at = np.concatenate([at, self._numbers(distinct, lambda places: [encode(pieces[one[i]], add_special_tokens=False).ids for i in places])[number]])
            text_of = np.concatenate([text_of, np.repeat(rest, [len(own) for own in lists])])
        if end is not None:  # one more piece behind each text
            mark = np.array([xxhash.xxh3_64_intdigest(f"end {end}", seed=1)], np.uint64)
            at = np.concatenate([at, np.repeat(self._numbers(mark, lambda places: [[end]]), len(texts))])
            text_of = np.concatenate([text_of, np.arange(len(texts))])
        if rest or end is not None:
            order = np.argsort(text_of, kind="stable")
            at, text_of = at[order], text_of[order]
        ids, ends = gathered(self.flat, self.starts[at], self.lengths[at])
        return ids.astype(np.uint32), ends[np.searchsorted(text_of, np.arange(len(texts) + 1))]


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` in turn, and the running total of their lengths from 0."""
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    shift = np.repeat(starts - ends[:-1], lengths)
    return flat[shift + np.arange(ends[-1])], ends


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process; tasks that follow find its pieces again."""
    return Encoder(path)
