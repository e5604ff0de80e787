"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwell.llm.common import cut, digest, n_words

#: 2**31 divided by the golden ratio, made odd: multiples of it modulo 2**31 are golden-ratio points.
GOLDEN_31 = 1327217885
ONE = 1 << 31


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: source, source_size. Adds ord (from 0, by code point, null last), weight and target.

    The sources share ``share`` times all words by weight; none takes over ``most`` times its
    own. With sources in the order of cap / weight, the level at which the water stands is fixed
    by how many of the first are full. The windows here run over one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("ord", (F.row_number().over(order) - 1).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("ord") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * most)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "ord")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("_open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_all", F.sum("source_size").over(everything) * share)
    level = (F.col("_all") - F.col("_full")) / F.col("_open")
    s = s.withColumn("_level", F.when(level <= F.col("cap") / F.col("weight"), level))
    # The first row whose level is under its own cap gives the level of all.
    s = s.withColumn("_level", F.min_by("_level", F.when(F.col("_level").isNotNull(), F.struct(F.col("cap") / F.col("weight"), F.col("ord")))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", "ord", "weight", target.alias("target"))


def slot_schedule(targets: DataFrame, block: int) -> DataFrame:
    """The order in which the mix takes blocks: slot, ord (of the source), rank (of the slot in its source).

    Slot j's point frac(j / golden ratio) falls into one source's stretch of the cumulative
    targets; any run of slots thus holds every source close to its share. A source needs
    ceil(target / block) slots: surplus ones are left out, and those that the sequence still owes
    a source, a few at most, follow at the end. A grid over [0, 1) turns the search for the
    stretch into an equi-join. Ranks are made of two sums, over chunks of slots and within one.
    """
    spark = targets.sparkSession
    total, n = targets.agg(F.sum("target"), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], "slot long, ord long, rank long")
    slots, grid = math.ceil(total / block), max(1024, 4 * n)
    upto = F.sum("target").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    t = targets.filter("target > 0").withColumn("need", F.ceil(F.round("target") / block).cast("long"))
    t = t.withColumn("_hi", F.round(upto / total * ONE).cast("long"))
    t = t.withColumn("_lo", F.lag("_hi", 1, 0).over(Window.orderBy("ord"))).filter("_lo < _hi or need > 0")
    width = ONE // grid + 1
    cells = t.filter("_lo < _hi").select("ord", "need", "_lo", "_hi", F.explode(F.expr(f"sequence(_lo div {width}, (_hi - 1) div {width})")).alias("_cell"))
    j = spark.range(slots).select(F.col("id").alias("slot"), F.pmod((F.col("id") % ONE) * GOLDEN_31, F.lit(ONE)).alias("_x"))
    at = j.withColumn("_cell", F.expr(f"_x div {width}")).join(cells, "_cell").filter("_lo <= _x and _x < _hi")
    at = at.select("slot", "ord", "need", F.expr("slot div 16384").alias("_chunk"))
    chunks = at.groupBy("ord", "_chunk").agg(F.count("*").alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.partitionBy("ord").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = chunks.select("ord", "_chunk", first.alias("_first"))
    inner = F.row_number().over(Window.partitionBy("ord", "_chunk").orderBy("slot")) - 1
    ranked = at.withColumn("_inner", inner).join(chunks, ["ord", "_chunk"])
    ranked = ranked.select("slot", "ord", (F.col("_first") + F.col("_inner")).alias("rank"), "need").filter("rank < need").drop("need")
    had = at.groupBy("ord").agg(F.count("*").alias("_had"))
    owed = t.join(had, "ord", "left").select("ord", "need", F.coalesce("_had", F.lit(0)).alias("_had")).filter("_had < need")
    owed = owed.select("ord", F.explode(F.expr("sequence(_had, need - 1)")).alias("rank"))
    return ranked.unionByName(owed.select((F.lit(slots) + F.col("rank")).alias("slot"), "ord", "rank"))


def shuffled_streams(sized: DataFrame, targets: DataFrame, buckets: int) -> DataFrame:
    """Puts each source's documents in hash order and adds start, the words before it in its source.

    Sums are made per source and hash bucket first, so no task holds a whole source.
    """
    s = sized.withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    sums = s.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), first.alias("_first"))
    inner = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "_h2", "size").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    s = s.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    t = targets.withColumnRenamed("source", "_s")
    s = s.join(F.broadcast(t) if targets_small(targets) else t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return s.withColumn("start", F.col("_first") + F.col("_inner")).drop("_first", "_inner", "_bucket")


def targets_small(targets: DataFrame, most: int = 50_000) -> bool:
    """A source is one row of a few numbers and a name: up to this many may be broadcast."""
    return targets.limit(most + 1).count() <= most


def _mixed(docs: DataFrame, block: int, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, DataFrame]:
    """Returns (documents with what the mix takes of them, the mix itself).

    A source's documents, in an order fixed by their hashes, form a stream of words that repeats
    up to ``most`` times and is cut into blocks of ``block`` words. The schedule's slot of rank r
    in a source takes block r; the last block ends at the source's target. taken is the number
    of a document's words in blocks taken, first_slot the slot that first takes some of them
    (null if none does) and n_slots how many do. The first frame has doc_id, size, source_size,
    target, taken, first_slot and n_slots for each row of docs (null text has size 0; a null
    doc_id stays null; rows that repeat each other are documents of their own). The second has
    slot, ord, rank, doc_id, pass (from 0), from_word and n_words for each piece of a document
    that a slot takes, in the documents' words. An empty table gives empty frames; texts may be of
    any length. Other columns are ignored.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *[h.alias(n) for h, n in zip(digest(F.col("doc_id").cast("string"), F.col("text")), ("_h", "_h2"))])
    sized = cut(sized)
    targets = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).coalesce(1))
    buckets = max(16, sized.count() // 5000)
    placed = shuffled_streams(sized.filter("size > 0"), targets, buckets)
    goal = F.round("target").cast("long")
    passes = placed.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    passes = passes.withColumn("_from", F.col("start") + F.col("_pass") * F.col("source_size"))
    passes = passes.withColumn("_to", F.least(F.col("_from") + F.col("size"), goal))
    inside = passes.filter("_from < _to").withColumn("rank", F.explode(F.expr(f"sequence(_from div {block}, (_to - 1) div {block})")))
    lo, hi = F.greatest("_from", F.col("rank") * block), F.least("_to", (F.col("rank") + 1) * block)
    pieces = inside.withColumn("from_word", lo - F.col("_from")).withColumn("n_words", hi - lo)
    mix = pieces.join(slot_schedule(targets, block), ["ord", "rank"])
    taken = mix.groupBy("ord", "start").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("n_slots"))
    got = placed.join(taken, ["ord", "start"], "left").select(
        "doc_id", "size", "source_size", "target", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) if c != "first_slot" else F.col(c) for c in ("taken", "first_slot", "n_slots")], "_h", "_h2"
    )
    t = targets.withColumnRenamed("source", "_s")
    none = sized.filter("size = 0").join(t, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), F.lit(0).cast("long").alias("n_slots"), "_h", "_h2")
    return got.unionByName(none), mix.select("slot", "ord", "rank", "doc_id", F.col("_pass").alias("pass"), "from_word", "n_words", "start", "size", "_h", "_h2")


def mix_sources(docs: DataFrame, block: int = 512, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of each document, and the mix: see _mixed."""
    taken, mix = _mixed(docs, block, weights, share, most)
    return taken.drop("_h", "_h2"), mix.drop("start", "size", "_h", "_h2")


def first_words(text: Column, n: Column) -> Column:
    """text up to the end of its n-th word, white space as it is."""
    ends = F.split(text, "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    return F.array_join(F.slice(ends, 1, n), "")


def apply_mix(docs: DataFrame, block: int = 512, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mixed rows of docs (all have its columns), in the order of the mix.

    Each pass of the mix over a document gives one row, at the slot that first takes words of it.
    Where the mix stops within a document (the last of its source), its row has the text up to the
    last word taken; n_chars, if there, follows the text. Rows that repeat each other are
    documents of their own; a null or empty text is never taken; an empty table gives an empty
    one; texts may be of any length.
    """
    _, mix = _mixed(docs, block, weights, share, most)
    # A document's pieces of one pass, and which of the rows that repeat each other it is.
    copies = mix.groupBy("_h", "_h2", "ord", "start", "pass").agg(F.min("slot").alias("_slot"), F.sum("n_words").cast("int").alias("_n"), F.first("size").alias("_size"))
    copies = cut(copies.select("_h", "_h2", "_slot", "_n", (F.col("_n") < F.col("_size")).alias("_part")))
    key = [h.alias(n) for h, n in zip(digest(F.col("doc_id").cast("string"), F.col("text")), ("_h", "_h2"))]
    rows = docs.select(F.struct("*").alias("_row"), *key)
    rn = F.row_number().over(Window.partitionBy("_h", "_h2").orderBy("_h"))
    j = rows.withColumn("_rn", rn).filter("_rn = 1").join(copies, ["_h", "_h2"])
    row, text = F.col("_row"), first_words(F.col("_row.text"), F.col("_n"))
    new = row.withField("text", text)
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    out = j.select("_slot", "_h", F.when(F.col("_part"), new).otherwise(row).alias("_row"))
    return out.orderBy("_slot", "_h").select("_row.*")
