"""The pipeline's stages, each on its own input, and all of them."""

import collections
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from dwell.llm import bpe
from dwell.llm.common import DOCUMENT_COLUMNS
from test_text_operators import corpus, components

DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), "extra") for i, t, s in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _r1 string")


def test_stages_return_documents(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == DOCUMENT_COLUMNS
        assert stage(spark, docs.limit(0), DIR).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DIR).count() == 0


def test_quality_keeps_clean_documents(spark, docs):
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, DIR).collect()}
    assert {70, 80, 90, 100, 101, 102, 200} <= kept and not {0, 1, 2, 3, 201, 202} & kept


def test_near_duplicates_leave_one_of_each(spark, docs):
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect() if r["doc_id"] is not None)
    c = components(corpus(), 5, 4, 5)
    assert got == sorted({x for _, n, x in c if n and x is not None} | {d for d, n, _ in c if not n and d is not None})


def test_run(spark):
    out = corpus_pipeline.run(spark, DIR).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    v = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert out and {r["doc_id"] for r in out} <= set(docs)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    often = collections.Counter(r["doc_id"] for r in out)
    assert max(often.values()) <= 2
    for r in out:
        text = v.decode(r["ids"]).decode()
        assert r["n_tokens"] == len(r["ids"]) and library.encode_ordinary(text) == r["ids"]
        words = collections.Counter(WORD.findall(docs[r["doc_id"]]["text"]))
        assert not collections.Counter(WORD.findall(text)) - words
