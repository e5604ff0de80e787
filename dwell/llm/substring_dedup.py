"""Substring dedup by hashing lines and sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.llm.common import cut, forget, row_key

#: Full stops of all scripts that have one, and the closing marks that follow those of Chinese and Japanese.
STOPS = ".!?。！？｡．।॥؟۔։።፧။។៕།᠃"
SENTENCE = re.compile(rf"[^{STOPS}]+(?:[{STOPS}]+[」』）】》〉〕]*\s*)*")
#: Thai and Lao have no full stop: white space within them ends a sentence.
GAP = re.compile(r"(?<=[\u0e00-\u0eff])\s+(?=[\u0e00-\u0eff])")
#: Scripts without spaces, by the characters that count as a word: Chinese and Japanese 2; Thai, Lao, Tibetan, Burmese and Khmer 4.
DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
LOOSE = re.compile(r"[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff]")
UNIT_SCHEMA = "_r1 long, _r2 long, doc_id {kind}, start int, stop int, h1 long, h2 long"


def sentences(line: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each sentence of a line; white space that follows belongs to it."""
    for m in SENTENCE.finditer(line):
        a, b = m.span()
        if not line.isascii():
            for g in GAP.finditer(line, a, b):
                yield a, g.end()
                a = g.end()
        yield a, b


def long_enough(words: list[str], min_words: int) -> bool:
    if len(words) >= min_words:
        return True
    text = "".join(words)
    return not text.isascii() and len(DENSE.findall(text)) / 2 + len(LOOSE.findall(text)) / 4 >= min_words


def text_units(text: str, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of each line and of each sentence that isn't its whole line.

    Offsets count code points and take in the white space that follows the unit. Units are
    normalised by lower case and single spaces. Every line is a unit that isn't empty then, and
    every sentence of ``min_words`` words; see long_enough for scripts without spaces. Lines
    and sentences have digests of one space, so a line of one sentence is found within a longer
    line too.
    """
    at = 0
    for line in text.split("\n"):
        stop = min(at + len(line) + 1, len(text))
        words = line.lower().split()
        if words:
            yield at, stop, xxhash.xxh3_128_digest(" ".join(words).encode())
        if long_enough(words, min_words):
            for a, b in sentences(line):
                if b - a < len(line):
                    words = line[a:b].lower().split()
                    if long_enough(words, min_words):
                        yield at + a, at + b, xxhash.xxh3_128_digest(" ".join(words).encode())
        at += len(line) + 1


def _units(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    own = list(text_units(text, min_words))
                    rows += own
                    take += [i] * len(own)
            keys = batch.select(["_r1", "_r2", "doc_id"]).take(pa.array(take, pa.int64()))
            h = [(int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)) for _, _, d in rows]
            cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([x[0] for x in h], pa.int64()), pa.array([x[1] for x in h], pa.int64())]
            yield pa.RecordBatch.from_arrays([*keys.columns, *cols], ["_r1", "_r2", "doc_id", "start", "stop", "h1", "h2"])

    return run


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, all_spans = [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["stop"]) for x in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            if merged:
                ends = [0, *(x for s in merged for x in s), len(text)]
                text = "".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
            texts.append(text)
            all_spans.append([{"start": a, "stop": b} for a, b in merged])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(all_spans, kind)], ["doc_id", "text", "spans"])


def substring_dedup(docs: DataFrame, min_words: int = 6) -> DataFrame:
    """Removes every line, and every sentence of ``min_words`` words, that an earlier-ranked place already has.

    Units are lines and the sentences within them, so that a passage put into the middle of a
    line is found as well, also where it is a line of its own elsewhere. A line may be of any length; shorter sentences
    within a line stay, as prose repeats them. In scripts without spaces, two characters
    (Chinese, Japanese) or four (Thai, Lao, Tibetan, Burmese, Khmer) count as a word. Units with the same
    digest (128 bits of the normalised unit) are one group; its first occurrence by doc_id (null last), then by offset,
    stays, and all others go, in other documents as in the same one. Returns for each row of
    docs: doc_id, text (what is left; null stays null) and spans, array<struct<start, stop>>,
    the removed stretches as offsets in code points of the original text. Rows with equal
    doc_id and text are one document that occurs again and are treated alike. Empty texts have
    no units; texts may be of any length; an empty table gives an empty table; other columns are
    ignored.

    Units are made once and written. The groups' firsts are found by an aggregation that combines
    before the shuffle; units meet them in a join, whose hot keys the engine may split, and only
    units that go are then gathered per document.
    """
    d = docs.select("doc_id", "text", *row_key())
    kind = d.schema["doc_id"].dataType.simpleString()
    units = cut(d.mapInArrow(_units(min_words), UNIT_SCHEMA.format(kind=kind)))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_r1", "_r2", "start")
    firsts = units.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = units.join(firsts, ["h1", "h2"]).filter((F.col("_r1") != F.col("first._r1")) | (F.col("_r2") != F.col("first._r2")) | (F.col("start") != F.col("first.start")))
    spans = cut(later.groupBy("_r1", "_r2").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    forget(units)
    joined = d.join(spans, ["_r1", "_r2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut_spans, f"doc_id {kind}, text string, spans array<struct<start: int, stop: int>>")
