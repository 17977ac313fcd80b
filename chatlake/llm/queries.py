"""Registered queries of the training-data operators and their oracles.

Each ``opN_`` query applies operator N with production parameters to its whole
table and derives the digest columns of its contract from the operator's
own output.
"""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..session import ship_package
from ..sources.tables import table
from . import collocations, decontam, kdshard, langid, linededup, packing, quality, rollup, simhash, suffixdedup, tokens, trie, urls, warc
from .common import cut, shared_folder
from .oracles import ORACLE  # noqa: F401


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_url_filter(spark, sf_dir):
    r = urls.judge(table(spark, sf_dir, "pages"))
    return r.select("page_id", "host", "path", "rule", "verdict")


def op3_token_rollup(spark, sf_dir):
    """All documents are inserted as counted by two tokenizers, exact copies deleted, and the counts of
    the second revised; the second and third batch are delivered twice."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "text", F.md5(text).alias("digest"), F.size(F.split(text, " ")).cast("long").alias("n_spaced"),
        F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+")).cast("long").alias("n_words"))
    docs = cut(tokens.counted(docs))
    least = docs.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    least = cut(least.select(F.col("digest").alias("d"), "least"))
    docs = docs.join(least, F.col("digest") == F.col("d"), "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))

    def changes(op, version, rows, new, old=None):
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"),
                           F.col(new).alias("n_tokens"), (F.col(old) if old else F.lit(None)).cast("long").alias("old_tokens"))

    r = rollup.Rollup(spark, shared_folder(spark, "token-rollup"))
    both = (("word_bpe_49k", "n_tokens"), ("words", "n_spaced"))
    load = [changes("insert", v, docs, n) for v, n in both]
    gone = [changes("delete", v, docs.where("copy"), n) for v, n in both]
    r.commit("load", load[0].union(load[1]))
    r.commit("copies", gone[0].union(gone[1]))
    r.compact()
    for batch in ("recount", "copies", "recount"):
        r.commit(batch, changes("revise", "words", docs.where("NOT copy"), "n_words", "n_spaced"))
    return r.totals()


def op4_kd_sharding(spark, sf_dir):
    r = kdshard.shard(table(spark, sf_dir, "documents"), shards=24)
    return r.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    model = langid.train(docs.where(rest != 0))
    return langid.identify(docs, model).select(
        "doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0).alias("held_out"), "lang_pred", "score")


def op6_line_dedup(spark, sf_dir):
    r = linededup.report(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_lines", "n_removed", "n_chunks", F.sha2("text", 256).alias("kept_sha256"))


def op7_simhash(spark, sf_dir):
    r = simhash.near_copies(table(spark, sf_dir, "documents"))
    return r.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_decontamination(spark, sf_dir):
    r = decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_suffix_dedup(spark, sf_dir):
    r = suffixdedup.dedup(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                    F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_rules(spark, sf_dir):
    r = quality.judge(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_warc_archive(spark, sf_dir):
    r = warc.archive(table(spark, sf_dir, "pages"))
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_prefix_trie(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))


def _shipped(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (
    op1_best_fit_packing, op2_url_filter, op3_token_rollup, op4_kd_sharding, op5_language_id, op6_line_dedup, op7_simhash, op8_decontamination, op9_suffix_dedup,
    op10_quality_rules, op11_warc_archive, op12_prefix_trie, op13_collocations)}
