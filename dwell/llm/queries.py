"""Registered queries of the text operators; __spark_entry__ adds them if this package is there."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from dwell.llm import ann, licenses
from dwell.llm.bpe import bpe_round_trip
from dwell.llm.chat import format_chat, read_chat
from dwell.llm.common import documents
from dwell.llm.langid import fit_dictionaries, held_out, identify_languages
from dwell.llm.line_dedup import line_dedup
from dwell.llm.mixing import mix_sources
from dwell.llm.negatives import hard_negatives
from dwell.llm.quality import quality_rules
from dwell.llm.similarity_join import jaccard_components
from dwell.llm.spelling import count_words, spelling_groups
from dwell.llm.substring_dedup import substring_dedup
from dwell.llm.suffix_dedup import suffix_dedup


def op1_substring_dedup(spark, sf_dir):
    out = substring_dedup(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return out.select("doc_id", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), kept.alias("kept_sha256"), "spans")


def op2_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    labelled = docs.filter(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    out = identify_languages(docs.select("doc_id", "text"), fit_dictionaries(labelled))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op3_suffix_array_dedup(spark, sf_dir):
    out = suffix_dedup(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_rules(spark, sf_dir):
    # The SQL has the verdicts alone.
    return quality_rules(documents(spark, sf_dir)).drop("text")


def op5_byte_bpe(spark, sf_dir, vocabulary=None):
    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe_round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_mix_sources(spark, sf_dir):
    return mix_sources(documents(spark, sf_dir))[0]


def op7_nearest_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op8_license_scan(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return licenses.scan(docs, licenses.fit(docs))


def op9_line_dedup(spark, sf_dir):
    out = line_dedup(documents(spark, sf_dir), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir), words=4, num=85, den=100)


def op11_chat_format(spark, sf_dir):
    said = F.lit("\\### Assistant: </turn> ok")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(tricky)
    return read_chat(format_chat(turns))


def op12_spelling_variants(spark, sf_dir):
    return spelling_groups(count_words(documents(spark, sf_dir), min_chars=5, min_count=3, slip=97), ratio=2)


def op13_hard_negatives(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, moved)


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_language_id,
        op3_suffix_array_dedup,
        op4_quality_rules,
        op5_byte_bpe,
        op6_mix_sources,
        op7_nearest_neighbours,
        op8_license_scan,
        op9_line_dedup,
        op10_ngram_jaccard_join,
        op11_chat_format,
        op12_spelling_variants,
        op13_hard_negatives,
    )
}
