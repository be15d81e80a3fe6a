"""The thin queries that apply each operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, functions as F

from . import checks, crf, decontamination, hashtree, language, multiindex, neardup, packing, periodic, repair, secrets, toxicity, warc, whitening
from .registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("op1_crf_line_quality")
def op1(spark, sf_dir):
    return crf.judged_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_warc_archives", checks.WARC)
def op2(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


@query("op3_gru_toxicity")
def op3(spark, sf_dir):
    return toxicity.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_decontamination", checks.CONTAINED)
def op4(spark, sf_dir):
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_minhash_near_duplicates", checks.NEAR_DUPLICATES)
def op5(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6(spark, sf_dir):
    return language.identified_documents(table(spark, sf_dir, "documents"))


@query("op7_repair_ids")
def op7(spark, sf_dir):
    return repair.encoded_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_hash_tree_shards", checks.SHARDS)
def op8(spark, sf_dir):
    return hashtree.shard_documents(table(spark, sf_dir, "documents"))


@query("op9_packing")
def op9(spark, sf_dir):
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_secret_scan", checks.SECRETS)
def op10(spark, sf_dir):
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


@query("op11_inverted_multi_index")
def op11(spark, sf_dir):
    return multiindex.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, by a checksum of the id, repeat a stretch of their words to the end."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(checksum / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        begin = F.pmod(g, n)
        period = F.floor((n - begin) / (F.lit(3) + g % 8)) + 1
        place = lambda i: begin + F.pmod(i - begin, period)
        tail = F.transform(F.sequence(begin, n.cast("long") - 1), lambda i: F.get(words, place(i).cast("int")))
        return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.concat(F.slice(words, F.lit(1), begin.cast("int")), tail), " "))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = F.get(F.transform(F.array(words), repeated), F.lit(0))  # the words are made once for all places that need them
    return docs.select("doc_id", F.when((checksum % 10 == 0) & F.col("text").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    found = periodic.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.get(F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"]).when(
        a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"]).cast("int")), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")


@query("op13_bit_sliced_whitening")
def op13(spark, sf_dir):
    return whitening.whitened_vectors(table(spark, sf_dir, "embeddings"))
