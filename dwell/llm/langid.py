"""Language ID by compression against per-language dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"


def fit_dictionaries(labelled: DataFrame, docs_per_language: int = 64, chars_per_doc: int = 2000, max_chars: int = 25_600_000) -> dict[str, bytes]:
    """Raw-content dictionaries from a bounded sample: columns doc_id, text and lang, the last two not null.

    For each language about ``docs_per_language`` documents are drawn by a hash of doc_id and text that
    keeps the same fraction everywhere, and up to ``chars_per_doc`` characters of each go into
    the dictionary. Every language is learned; where their dictionaries would have more than
    ``max_chars`` characters together, each document gives fewer.
    """
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return {}
    one, share = 1 << 30, max_chars // len(counts)
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id", "text"), F.lit(one))
    rates = [(r["lang"], int(one * min(1.0, docs_per_language / r["n"])) + 1, max(1, min(chars_per_doc, share // min(r["n"], docs_per_language)))) for r in counts]
    known = labelled.sparkSession.createDataFrame(rates, "lang string, below long, chars int")
    sample = labelled.join(F.broadcast(known), "lang").filter(draw < F.col("below")).orderBy(draw, "text").limit(4 * docs_per_language * len(counts))
    sample = sample.select("lang", F.expr("substring(text, 1, chars)").alias("text"))
    parts: dict[str, list[str]] = {}
    for lang, text in sorted(map(tuple, sample.collect())):
        parts.setdefault(lang, []).append(text)
    # zstd ignores dictionaries of under 8 bytes.
    return {lang: "\n".join(texts).lower().encode().ljust(8, b" ") for lang, texts in sorted(parts.items())}


def _encoded_size(compressor: zstandard.ZstdCompressor, data: bytes, block: int) -> int:
    return sum(len(compressor.compress(data[i : i + block])) for i in range(0, len(data), block))


def identify_languages(docs: DataFrame, dictionaries: dict[str, bytes], block: int = 2048, level: int = 9, min_margin: float = 0.02) -> DataFrame:
    """Language of every whole text: that whose dictionary encodes it smallest.

    A text is lower-cased and encoded in blocks of ``block`` bytes that know only the dictionary, so a long
    text isn't judged by what it has said itself. Columns: those of docs without text, then
    lang_pred, score (how much smaller the best encoding is than the second, 0 to 1; 1 with one
    language alone) and accepted (false where the score is under ``min_margin``, a tie included,
    or the text has no language). Null texts, texts without a letter, and all texts if nothing
    was learned, get ``und`` with score 0. Ties go to the smaller language code. docs needs a
    text column; each row is judged alone, so repeated rows and null ids do no harm, and texts
    may be of any length. Columns of docs that are named as a result give way to it. An empty
    table gives an empty one.
    """
    own = ("lang_pred", "score", "accepted")
    others = [f for f in docs.schema.fields if f.name not in ("text", *own)]
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    names = [f.name for f in others]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {}
        for lang, data in shared.value.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            models[lang] = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)
        for batch in batches:
            pred, score = [], []
            for text in batch.column("text").to_pylist():
                if not models or text is None or not any(map(str.isalpha, text)):
                    pred.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                data = text.lower().encode()
                ranked = sorted((_encoded_size(c, data, block), lang) for lang, c in models.items())
                pred.append(ranked[0][1])
                score.append(1.0 if len(ranked) < 2 else (ranked[1][0] - ranked[0][0]) / ranked[1][0])
            ok = [p != UNDETERMINED and s >= min_margin for p, s in zip(pred, score)]
            cols = [batch.column(n) for n in names] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "lang_pred", "score", "accepted"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["lang_pred string", "score double", "accepted boolean"])
    return docs.mapInArrow(judge, schema)


def held_out(doc_id: str = "doc_id"):
    """True for the third of documents that nothing is learned from; null ids are not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
