"""Small awkward tables shared by the tests of this folder."""

from __future__ import annotations

import random
import re

WHITE = "\x20\x09-\x0D"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, score double, _key string, kind string"


def words(text: str | None) -> list[str]:
    return re.findall(f"[^{WHITE}]+", text or "")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["an", "er", "th", "on", "ing", "re", "tion", "ea", "or", "ha"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def edited(text: str, at: int, word: str = "altered") -> str:
    own = text.split(" ")
    own[at] = word
    return " ".join(own)


def texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empties, repeated rows, ties, copies, very long and odd texts."""
    base = prose(1, 120)
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (5, base), (6, edited(base, 60)), (7, base.upper()),
        (8, "one two"), (9, "one two"), (10, "é ß ñ ü \x1c x\x85y   z  end \r\n\n"), (None, base), (None, None), (11, prose(2, 30_000)),
        (12, "a b c a b c\na b c a b c\n"), (13, "<|endoftext|> what  <|endoftext|>"), (14, "it's I'M 12 a!!b"), (-3, prose(3, 60)),
    ]
    return rows


def frame(spark, rows=None):
    """The table with columns whose names clash with those the operators use."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 0.5, "k", "x") for i, t in rows], SCHEMA)
