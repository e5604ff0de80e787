"""Quality rules with cross-document line frequency (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.llm.common import ascii_lower, bind, cut, digest, distinct_structs, forget, keyed, row_key, strip_ws, without, words

#: Symbols of the symbol count, a fixed value of the contract.
SYMBOLS = "[#*$%&|<>]"


def _repeat_words(starts: Column, size: int) -> Column:
    """Words under windows of ``size`` that begin at ``starts`` (ascending)."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.least(F.lit(size), s - acc["last"])).cast("long").alias("n"), s.alias("last")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def base_metrics(docs: DataFrame, window: int = 5) -> DataFrame:
    """Adds the per-document counts to ``docs`` (which must have text); null text counts as none.

    Windows are compared by 64-bit hashes within one document. An array of window hashes
    without a repeat, which most texts have, needs no sorting.
    """
    d = docs.withColumn("_w", words(F.col("text"))).withColumn("n_words", F.size("_w").cast("long"))
    last = F.greatest(F.size("_w") - window, F.lit(0))
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(window)]))
    d = d.withColumn("_g", F.when(F.size("_w") > window, grams))
    d = d.withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long"))
    d = d.withColumn("_rep", F.coalesce(F.size(F.array_distinct("_g")) < F.size("_g"), F.lit(False)))
    d = d.withColumn("_s", F.when(F.col("_rep"), F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    twice = F.filter("_s", lambda x, j: F.coalesce(F.get("_s", j - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("_s", j + 1)["g"] == x["g"], F.lit(False)))
    d = d.withColumn("_st", F.when(F.col("_rep"), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    d = d.withColumn("n_repeat_words", F.when(F.col("_rep"), _repeat_words(F.col("_st"), window)).otherwise(0).cast("long"))
    text = F.coalesce("text", F.lit(""))
    d = d.withColumn("n_symbols", (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"))
    d = d.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: strip_ws(x) != ""))
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop("_w", "_g", "_rep", "_s", "_st")


def _verdicts(docs: DataFrame, min_docs: int, max_share: float, min_kept: float, max_docs: int | None) -> tuple[DataFrame, DataFrame]:
    """Verdict on every document by its own counts and by the lines it shares with its host; and the written table that it reads.

    Non-empty lines are normalised (white space at both ends off, A-Z lower-cased) and hashed;
    per host (``source``, null is a host of its own) the documents of each line are counted. A
    line in more than ``min_docs`` documents and in more than ``max_share`` of its host's
    documents is removed as boilerplate, and so is one in more than ``max_docs`` documents
    whatever its share, where that is set. A document that keeps under ``min_kept`` of its
    characters is depleted. ``kept`` is false if the base rules fail or the document is depleted.

    One row for each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, line_chars, removed_chars, kept, gone (the removed lines by their
    number among the non-empty lines, from 0; null for none), and source and key. Null text has no words, so it
    fails. Every row counts as a document, also one that repeats another; rows with equal
    doc_id, text and source get the same verdict. Other columns are ignored; an empty table
    gives an empty table.
    """
    keep = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    base = base_metrics(docs.select("doc_id", "text", "source"))
    norm = F.transform("_lines", lambda x: ascii_lower(strip_ws(x)))
    hashed = F.transform(norm, lambda x: F.struct(*[h.alias(n) for h, n in zip(digest(x), ("h1", "h2"))], F.char_length(x).alias("c")))
    narrow = cut(base.select("doc_id", "source", *row_key(), *keep, hashed.alias("keys")))
    host = ["source", "h1", "h2"]
    counts = narrow.select("source", F.explode(distinct_structs(F.col("keys"))).alias("k")).groupBy("source", "k.h1", "k.h2").agg(F.count("*").alias("n"))
    hosts = narrow.groupBy(F.col("source").alias("s2")).agg(F.count("*").alias("n_host"))
    over = (
        counts.filter(F.col("n") > min_docs)
        .join(hosts, F.col("source").eqNullSafe(F.col("s2")))
        .filter((F.col("n") > F.col("n_host") * max_share) | (F.col("n") > F.lit(max_docs) if max_docs is not None else F.lit(False)))
        .select(F.col("source").alias("s2"), F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    )
    each = narrow.select("_r1", "_r2", "source", F.posexplode("keys").alias("i", "k"))
    hit = each.join(over, (F.col("k.h1") == F.col("a1")) & (F.col("k.h2") == F.col("a2")) & F.col("source").eqNullSafe(F.col("s2")), "left_semi")
    lost = hit.groupBy("_r1", "_r2", F.col("source").alias("s3")).agg(F.sort_array(F.collect_set("i")).alias("gone"))
    # Rows that repeat each other share a key, and so the lines that they lose.
    same = narrow.join(lost.select(F.col("_r1").alias("b1"), F.col("_r2").alias("b2"), "s3", "gone"), (F.col("_r1") == F.col("b1")) & (F.col("_r2") == F.col("b2")) & F.col("source").eqNullSafe(F.col("s3")), "left")
    chars = F.aggregate("keys", F.lit(0).cast("long"), lambda acc, k: acc + k["c"])
    removed = F.aggregate("gone", F.lit(0).cast("long"), lambda acc, i: acc + F.get("keys", i)["c"])
    out = same.withColumn("line_chars", chars).withColumn("removed_chars", F.coalesce(removed, F.lit(0).cast("long")))
    depleted = (F.col("removed_chars") > 0) & (F.col("line_chars") - F.col("removed_chars") < min_kept * F.col("line_chars"))
    return out.select("doc_id", "source", "_r1", "_r2", *keep, "line_chars", "removed_chars", (~F.col("base_failed") & ~depleted).alias("kept"), "gone"), narrow


def _without(text: Column, gone: Column) -> Column:
    """text without the lines in gone (ascending numbers among the non-empty lines); all other lines stay as they are."""
    full = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(strip_ws(x) != "", i)), lambda i: i.isNotNull())
    left = bind(F.split(text, "\n", -1), lambda lines: bind(bind(full(lines), lambda at: F.transform(gone, lambda g: F.get(at, g))), lambda drop: without(lines, drop)))
    return F.when(gone.isNull(), text).otherwise(F.array_join(left, "\n"))


def _same_row() -> Column:
    return (F.col("_k1") == F.col("_r1")) & (F.col("_k2") == F.col("_r2")) & F.col("_source").eqNullSafe(F.col("_s"))


def quality_rules(docs: DataFrame, min_docs: int = 20, max_share: float = 0.01, min_kept: float = 0.3, max_docs: int | None = None) -> DataFrame:
    """Verdicts for each row of ``docs``, and its text without the lines over the limits: see _verdicts."""
    v, _ = _verdicts(docs, min_docs, max_share, min_kept, max_docs)
    v = v.withColumnRenamed("source", "_s").distinct()
    text = _without(F.col("_row.text"), F.col("gone")).alias("text")
    return keyed(docs).join(v, _same_row()).select("_row.doc_id", *[c for c in v.columns if c not in ("doc_id", "_s", "_r1", "_r2", "gone")], text)


def pass_quality(docs: DataFrame, min_docs: int = 20, max_share: float = 0.01, min_kept: float = 0.3, max_docs: int | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; text is without the lines over the limits and n_chars follows it.

    Rows are met by a digest of doc_id and text and by source. The keys of the rows that are
    rejected or lose lines are broadcast while there are few of them, by count; otherwise both
    sides are shuffled.
    """
    v, narrow = _verdicts(docs, min_docs, max_share, min_kept, max_docs)
    v = v.filter("not kept or gone is not null")
    v = cut(v.select(F.col("source").alias("_s"), "_r1", "_r2", "kept", "gone").distinct())
    forget(narrow)
    held = v.agg(F.sum(F.lit(1) + F.coalesce(F.array_size("gone"), F.lit(0)))).first()[0] or 0
    side = F.broadcast(v) if held <= 500_000 else v
    row, text = F.col("_row"), _without(F.col("_row.text"), F.col("gone"))
    new = row.withField("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = new.withField("n_chars", F.char_length(text).cast(kind))
    out = keyed(docs).join(side, _same_row(), "left").filter("coalesce(kept, true)")
    return out.select(F.when(F.col("gone").isNull(), row).otherwise(new).alias("_row")).select("_row.*")
