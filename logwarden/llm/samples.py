"""Bounded samples of labelled rows on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .frames import sized


def _among(share: float) -> Column:
    """Whether the id's hash lies in the ``share`` of all hashes."""
    return F.abs(F.xxhash64("doc_id") / 2.0 ** 63) <= share


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int, most_bytes: int, fold: int, left_out: int) -> list[tuple[str, int]]:
    """About ``rows`` pairs (text, label) by a hash of the id, of texts of at most ``most_bytes`` bytes.

    Rows whose crc32 of the id as text leaves ``left_out`` modulo ``fold`` are never among them (``fold`` 0: none is left out). Only
    the sampled ids are sent to the executors and only their texts, at most about ``rows * most_bytes`` bytes, to the driver. An error is
    raised if labels are there and the sample is empty, unless no labelled document has so short a text.
    """
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    if fold:
        known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) != left_out)
    number = known.count()
    share = min(1.0, rows / max(1, number))
    short = docs.select("doc_id", "text").filter(F.octet_length("text") <= most_bytes)
    chosen = known.filter(_among(share)).dropDuplicates(["doc_id"])
    out = short.filter(_among(share)).join(sized(chosen), "doc_id").select("doc_id", "text", "label").limit(2 * rows).collect()
    if not out and number > rows and not short.join(known, "doc_id", "left_semi").isEmpty():
        raise ValueError(f"no labelled document among a share of {share} of {number}")
    return [(r["text"], r["label"]) for r in sorted(out, key=lambda r: (r["doc_id"], r["text"]))]
