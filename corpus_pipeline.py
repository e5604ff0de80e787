"""A training-corpus pipeline over the documents table: filter, dedup, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm.bpe import bpe_round_trip
from dwell.llm.common import DOCUMENT_COLUMNS, cut, forget
from dwell.llm.line_dedup import line_dedup
from dwell.llm.mixing import apply_mix
from dwell.llm.quality import pass_quality
from dwell.llm.similarity_join import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and lines over the limits; n_chars follows the text.

    Null, empty and very short texts fail the base rules and go. Texts may be of any length. Rows
    that repeat each other count as documents of their own and all stay or all go; so do rows
    with equal doc_id, text and source. A null source is a host of its own; a null doc_id stays
    null. Only the columns of documents are used; an empty table gives an empty one.
    """
    return pass_quality(docs.select(*DOCUMENT_COLUMNS), max_docs=1000)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more have go; n_chars follows the text.

    Every row stays, with a null text as an empty one. A repeated row is a document of its own.
    Empty lines stay. Texts may be of any length. Only the columns of documents are used; an
    empty table gives an empty one.
    """
    out = line_dedup(docs.select(*DOCUMENT_COLUMNS), carry=("lang", "source"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest doc_id, null last.

    Null and empty texts and those without words are no duplicates and stay. Of rows that repeat
    a doc_id and text one stays; ties between rows without an id go by a hash of their text.
    Texts may be of any length. Only the columns of documents are used; an empty table gives an
    empty one.
    """
    return one_of_each(docs.select(*DOCUMENT_COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target takes them, in the order of the schedule.

    Null, empty and wordless texts have nothing to take and go. Rows that repeat each other are
    documents of their own; a null source is a source. Very long texts span many blocks. Only the
    columns of documents are used; an empty table gives an empty one.
    """
    return apply_mix(docs.select(*DOCUMENT_COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (array<int>) of each document of the mix.

    Null and empty texts have no ids; texts may be of any length; each row is encoded alone, so
    null and repeated ids and repeated rows do no harm; an empty table gives an empty one.
    """
    ids = bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing sources to target weights", mix), ("byte-level BPE", encode)]

#: Neither the mix's hash order nor BPE can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what the one before has written, which is deleted when it has been read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
            if before is not None:
                forget(before)
            before = docs
    return docs
