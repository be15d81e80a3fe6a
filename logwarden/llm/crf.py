"""Quality rules with line labels: a linear-chain conditional random field marks lines as content or boilerplate.

The field is fitted by gradient ascent on its likelihood, from a bounded sample of documents with quality labels: a first round takes each
line's label from its document without transitions, a second fits the whole field to the lines as the first one sees them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import cut
from .samples import labelled_sample
from .words import MIX, _bytes, mixed, run_hashes, runs

JUDGED = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, n_lines long, n_content_lines long, content_share double")


def _class(chars: str | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars] if isinstance(chars, str) else chars] = True
    return out


WHITE, SYMBOL, UPPER, DIGIT = _class("\t\n\x0b\x0c\r "), _class("#*$%&|<>"), _class([*range(65, 91)]), _class([*range(48, 58)])
LETTER = _class([*range(65, 91), *range(97, 123), *range(128, 256)])
CONTINUED = _class([*range(128, 192)])
STOP = _class(".!?:;\"')")
LINE_END = _class("\n")


@dataclass
class Lines:
    """Base figures of texts, and the features of their lines with a word."""

    base: np.ndarray  # texts x (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)
    features: np.ndarray  # lines x features
    size: np.ndarray  # characters of each line's words
    edges: np.ndarray  # of the texts among the lines


def _counts(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])


def _first_seen(keys: np.ndarray) -> np.ndarray:
    """Whether each key is the first of its kind."""
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


def read_lines(texts: list[str | None]) -> Lines:
    """Figures and features of whole texts, over all of them at once."""
    raw, edges = _bytes(texts)
    white = WHITE[raw]
    begin, end = runs(raw, white)
    word_at = np.searchsorted(begin, edges)
    n_words = np.diff(word_at)
    starts = _counts(~white & ~CONTINUED[raw])
    symbols = _counts(SYMBOL[raw])
    hashes = run_hashes(raw, begin, end, False)
    text_of = np.repeat(np.arange(len(texts)), n_words)
    # three-word windows inside one text that come twice or more
    with np.errstate(over="ignore"):
        own = mixed(text_of.astype(np.uint64) + np.uint64(MIX[0]))
        repeated = np.zeros(len(hashes), bool)
        if len(hashes) > 2:
            key = own[:-2] ^ mixed(mixed(mixed(hashes[:-2]) + hashes[1:-1]) + hashes[2:])
            inside = text_of[2:] == text_of[:-2]
            _, back, times = np.unique(key, return_inverse=True, return_counts=True)
            often = np.flatnonzero((times[back] > 1) & inside)
            for k in range(3):
                repeated[often + k] = True
        # lines, the ends of texts among them
        stops = np.flatnonzero(LINE_END[raw])
        line_begin = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
        first = np.searchsorted(begin, line_begin)
        words = np.searchsorted(begin, stops) - first
        has = words > 0
        line_begin, line_end, first, words = line_begin[has], stops[has], first[has], words[has]
        line_text = np.searchsorted(edges, line_begin, side="right") - 1
        line_key = run_hashes(raw, line_begin, line_end, False) ^ mixed(line_text.astype(np.uint64) + np.uint64(MIX[0]))
    again = ~_first_seen(line_key)
    line_edges = np.searchsorted(line_begin, edges)
    per_text = lambda counts, at: np.diff(counts[at])
    base = np.stack([n_words, per_text(starts, edges), per_text(symbols, edges), per_text(_counts(again), line_edges),
                     per_text(_counts(repeated), word_at)], axis=1)

    def share(table: np.ndarray, of: np.ndarray) -> np.ndarray:
        c = _counts(table[raw])
        return (c[line_end] - c[line_begin]) / of

    chars = starts[line_end] - starts[line_begin]
    size = np.maximum(1, chars)
    rep = _counts(repeated)
    last_word = first + words - 1
    features = np.stack([
        np.ones(len(words)), np.log1p(words), words < 4, size / words / 10, share(UPPER, size), share(DIGIT, size), share(SYMBOL, size) * 3,
        1 - np.minimum(1, share(LETTER, size)), STOP[raw[end[last_word] - 1]], UPPER[raw[begin[first]]], again,
        (rep[first + words] - rep[first]) / words, share(SYMBOL, words) > 0.3], axis=1).astype(np.float64)
    return Lines(base, features, chars, line_edges)


@dataclass
class Field:
    """Weights of the label content per feature, and the scores of label pairs of neighbouring lines (boilerplate 0, content 1)."""

    weights: np.ndarray
    steps: np.ndarray

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The likeliest labels of one text's lines."""
        gain = (features @ self.weights).tolist()
        if not gain:
            return np.zeros(0, bool)
        (bb, bc), (cb, cc) = self.steps.tolist()
        b, c, back = 0.0, gain[0], []
        for g in gain[1:]:
            b_from_c, c_from_b = c + cb > b + bb, b + bc > c + cc
            back.append((b_from_c, c_from_b))
            b, c = (c + cb if b_from_c else b + bb), (b + bc if c_from_b else c + cc) + g
        now = c >= b
        out = [now]
        for b_from_c, c_from_b in reversed(back):
            now = (not c_from_b) if now else b_from_c
            out.append(now)
        return np.array(out[::-1])


def _gradient(field: Field, features: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient of the log-likelihood by forward and backward sums over padded texts (texts x lines), and its value."""
    texts, lines = mask.shape
    unary = np.zeros((texts, lines, 2))
    unary[..., 1] = features @ field.weights
    ahead, behind = np.zeros((texts, lines, 2)), np.zeros((texts, lines, 2))
    ahead[:, 0] = unary[:, 0]
    for t in range(1, lines):
        here = np.logaddexp(ahead[:, t - 1, :1] + field.steps[0], ahead[:, t - 1, 1:] + field.steps[1]) + unary[:, t]
        ahead[:, t] = np.where(mask[:, t, None], here, ahead[:, t - 1])
    for t in range(lines - 2, -1, -1):
        nxt = unary[:, t + 1] + behind[:, t + 1]
        here = np.logaddexp(field.steps[:, 0] + nxt[:, :1], field.steps[:, 1] + nxt[:, 1:])
        behind[:, t] = np.where(mask[:, t + 1, None], here, behind[:, t + 1])
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    p = np.exp(ahead[..., 1] + behind[..., 1] - total[:, None]) * mask
    weights = np.einsum("tl,tlf->f", (labels - p) * mask, features)
    both = mask[:, 1:] & mask[:, :-1]
    steps = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            joint = np.exp(ahead[:, :-1, a] + field.steps[a, b] + unary[:, 1:, b] + behind[:, 1:, b] - total[:, None])
            seen = (labels[:, :-1] == a) & (labels[:, 1:] == b)
            steps[a, b] = ((seen - joint) * both).sum()
    chosen = (unary[..., 1] * labels * mask).sum() + (field.steps[labels[:, :-1], labels[:, 1:]] * both).sum()
    return weights, steps, float(chosen - total.sum())


def fit(sample: list[tuple[str, int]], rounds: int = 80, rate: float = 0.15, decay: float = 1.0, most_lines: int = 100) -> Field:
    """A field fitted to (text, quality) pairs; without both labels in the sample every line is content.

    Texts of more than ``most_lines`` lines are left out of the fit.
    """
    read = [(read_lines([t]), q) for t, q in sample]
    read = [(x.features, q) for x, q in read if 0 < len(x.features) <= most_lines]
    width = read_lines([""]).features.shape[1]
    field = Field(np.zeros(width), np.zeros((2, 2)))
    if len({q for _, q in read}) < 2:
        return Field(np.eye(1, width)[0], np.zeros((2, 2)))
    lines = max(len(f) for f, _ in read)
    features = np.zeros((len(read), lines, width))
    mask = np.zeros((len(read), lines), bool)
    labels = np.zeros((len(read), lines), np.int64)
    for i, (f, q) in enumerate(read):
        features[i, : len(f)], mask[i, : len(f)], labels[i, : len(f)] = f, True, q
    for chained in (False, True):
        if chained:
            labels = (((features @ field.weights) > 0) & mask).astype(np.int64)
        m1, m2 = np.zeros(width + 4), np.zeros(width + 4)
        for k in range(1, rounds + 1):
            weights, steps, _ = _gradient(field, features, mask, labels)
            slope = np.concatenate([weights - decay * field.weights, (steps - decay * field.steps).ravel() * chained])
            m1, m2 = 0.9 * m1 + 0.1 * slope, 0.99 * m2 + 0.01 * slope ** 2
            move = rate * (m1 / (1 - 0.9 ** k)) / (np.sqrt(m2 / (1 - 0.99 ** k)) + 1e-9)
            field = Field(field.weights + move[:width], field.steps + move[width:].reshape(2, 2))
    return field


def judged_documents(docs: DataFrame, labels: DataFrame, share: float = 0.5, sample_rows: int = 800, sample_bytes: int = 20_000) -> DataFrame:
    """Base figures, failure and verdict of each row of ``docs`` (doc_id, text), with its lines and its content share.

    Kept are texts that pass the base rules and whose content lines hold at least ``share`` of their words' characters. The field is
    fitted on about ``sample_rows`` labelled texts of at most ``sample_bytes`` bytes. Null, empty and blank texts have no words and
    fail; repeated rows and null ids have a result each; an empty table gives an empty result; other columns are ignored.
    """
    field = fit(labelled_sample(docs, labels, "quality", sample_rows, sample_bytes, 0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, "text"):
                x = read_lines(batch.column("text").to_pylist())
                content = [field.viterbi(x.features[a:b]) for a, b in zip(x.edges[:-1].tolist(), x.edges[1:].tolist())]
                marked = np.concatenate(content)
                lines = np.diff(x.edges)
                good = np.diff(_counts(marked)[x.edges])
                held = np.diff(np.concatenate([[0], np.cumsum(x.size * marked)])[x.edges])
                of = np.diff(np.concatenate([[0], np.cumsum(x.size)])[x.edges])
                part = np.where(of > 0, held / np.maximum(of, 1), 0.0)
                n_words, repeats = x.base[:, 0], x.base[:, 4]
                failed = (n_words < 50) | (100 * repeats > 50 * n_words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), *(pa.array(c.astype(np.int64)) for c in x.base.T), pa.array(failed),
                     pa.array(~failed & (part >= share)), pa.array(lines), pa.array(good.astype(np.int64)), pa.array(part.astype(np.float64))],
                    names=[c.split()[0] for c in JUDGED.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, JUDGED)
