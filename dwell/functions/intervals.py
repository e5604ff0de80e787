"""Interval helpers: bucket split, overlap join, span algebra, nested pairing, greedy onsets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwell.functions.settled import settled

NONE = 2**62  # stands for no later moment


def split_to_buckets(df: DataFrame, lo: int, hi: int, width: int, start: str = "start", end: str = "ts") -> DataFrame:
    """One row for each bucket of [lo, hi) that [start, end) meets, with bucket, b_lo and b_hi."""
    a, b = F.greatest(F.col(start), F.lit(lo)), F.least(F.col(end), F.lit(hi))
    d = df.withColumn("_a", a).withColumn("_b", b).filter("_a < _b")
    d = d.withColumn("bucket", F.explode(F.expr(f"sequence((_a - {lo}) div {width}, (_b - 1 - {lo}) div {width})")))
    edge = F.col("bucket") * width + lo
    return d.withColumn("b_lo", F.greatest(F.col("_a"), edge)).withColumn("b_hi", F.least(F.col("_b"), edge + width)).drop("_a", "_b")


def overlap_candidates(a: DataFrame, b: DataFrame, keys: list[str], width: int, most: int = 64) -> DataFrame:
    """The pairs that overlap_join tests: all that share a bin, each at one level.

    A row's own level is the first whose bins are wide enough for it to meet at most ``most``.
    A pair meets at the wider level of its two rows, which is the own level of one of them: as
    role 0 where that is a's (b is then put into bins of that level too), as role 1 where it is
    b's alone. So narrow rows never meet each other in wide bins.
    """
    widths = [width * most**k for k in range(4)]
    top = len(widths) - 1

    def binned(d: DataFrame, s: str, e: str, roles: Column) -> DataFrame:
        length, lv = F.col(e) - F.col(s), F.lit(top)
        for k in reversed(range(top)):
            lv = F.when(length <= widths[k] * (most - 1), k).otherwise(lv)
        d = d.withColumn("_lv", lv).select("*", F.inline(roles))
        w = F.element_at(F.array(*[F.lit(x).cast("long") for x in widths]), F.col("_at") + 1)
        d = d.withColumn("_w", w)
        bins = F.expr(f"sequence(cast(floor({s} / _w) as long), cast(floor(greatest({e} - 1, {s}) / _w) as long))")
        return d.withColumn("_bin", F.explode(bins)).drop("_lv")

    def roles(own: int) -> Column:
        """(level, role) of a row: role ``own`` at its own level alone, the other also at wider ones."""
        meet = lambda lo, role: F.transform(F.sequence(lo, F.lit(top)), lambda k: F.struct(k.alias("_at"), F.lit(role).alias("_role")))
        wider = F.when(F.col("_lv") < top, meet(F.least(F.col("_lv") + 1, F.lit(top)), 1 - own)).otherwise(F.array().cast("array<struct<_at:int,_role:int>>"))
        one = F.array(F.struct(F.col("_lv").alias("_at"), F.lit(own).alias("_role")))
        same = F.array(F.struct(F.col("_lv").alias("_at"), F.lit(1 - own).alias("_role"))) if own else F.array().cast("array<struct<_at:int,_role:int>>")
        return F.concat(one, same, wider)

    x = binned(a, "a_start", "a_end", roles(0))
    y = binned(b, "b_start", "b_end", roles(1)).drop("_w")
    return x.join(y, [*keys, "_at", "_role", "_bin"])


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int, most: int = 64) -> DataFrame:
    """Pairs of rows with equal keys whose [a_start, a_end) and [b_start, b_end) overlap.

    Both sides are put into bins and joined on key and bin; a pair counts in the bin where the
    later one begins, so it comes once. Rows over more than ``most`` bins use bins that are
    ``most`` times as wide, level by level, so that a long row is never copied more than that
    often (beyond the widest bins it is copied into each that it meets). See overlap_candidates.
    """
    j = overlap_candidates(a, b, keys, width, most)
    j = j.filter(F.col("_bin") == F.floor(F.greatest("a_start", "b_start") / F.col("_w")))
    return j.filter("a_start < b_end and b_start < a_end").drop("_at", "_role", "_bin", "_w")


def carried(d: DataFrame, keys: list[str], at: str, order: list[str], chunk: int | None, sums: dict[str, str] | None = None, highs: dict[str, str] | None = None) -> DataFrame:
    """Running sums (this row included) and running maxima of the rows before, per key in order.

    sums and highs name the new columns and what they are made of. ``order`` starts with
    ``at``. With a chunk, each key's rows are dealt over stretches of ``at`` of that width; every
    stretch is summed up on its own and takes over one row of totals of the stretches before it,
    so a key of any size is worked on by many tasks.
    """
    sums, highs = sums or {}, highs or {}
    part = [*keys, "_chunk"] if chunk else keys
    d = d.withColumn("_chunk", F.expr(f"floor({at} / {chunk})")) if chunk else d
    w = Window.partitionBy(*part).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    out = d.select("*", *[F.sum(c).over(upto).alias(n) for n, c in sums.items()], *[F.max(c).over(before).alias(n) for n, c in highs.items()])
    if not chunk:
        return out
    t = d.groupBy(*part).agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())], *[F.max(c).alias(f"_m{i}") for i, c in enumerate(highs.values())])
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(*part, *[F.coalesce(F.sum(f"_t{i}").over(wc), F.lit(0)).alias(f"_t{i}") for i in range(len(sums))], *[F.max(f"_m{i}").over(wc).alias(f"_m{i}") for i in range(len(highs))])
    out = out.join(t, part)
    for i, n in enumerate(sums):
        out = out.withColumn(n, F.col(n) + F.col(f"_t{i}"))
    for i, n in enumerate(highs):
        out = out.withColumn(n, F.greatest(n, f"_m{i}"))
    return out.drop("_chunk", *[f"_t{i}" for i in range(len(sums))], *[f"_m{i}" for i in range(len(highs))])


def overlapped(windows: DataFrame, spans: DataFrame, keys: list[str], lo: str, hi: str, time: str, number: str, chunk: int | None = None, weight: Column | None = None) -> DataFrame:
    """windows with the summed length of their overlaps with spans (keys, s, e) of equal keys, and how many of these (by ``weight``) they meet.

    Spans may overlap; each counts. A window's overlaps are what lies of all spans before its end less what
    lies before its start, and it meets those that begin before its end less those that ended by its start,
    so windows and spans are rows of one sweep and no pair of them is made. Windows that don't end after they begin have none.
    With a chunk, a key's rows are dealt over stretches of time: see carried.
    """
    one, none = (F.lit(1) if weight is None else weight).cast("long"), F.lit(0).cast("long")
    wide = lambda c: c.cast("decimal(20,0)")
    point = lambda at, order, d, begun, ended: F.struct(F.col(at).alias("_at"), F.lit(order).alias("_order"), F.lit(d).cast("long").alias("_d"), begun.alias("_begun"), ended.alias("_ended"))
    # At one moment ends come first, then windows, then starts.
    ends = spans.filter("s < e").dropna(subset=keys).select(*keys, F.inline(F.array(point("s", 3, 1, one, none), point("e", 0, -1, none, one))))
    asked = windows.select("*", F.inline(F.array(point(lo, 1, 0, none, none), point(hi, 2, 0, none, none)))).withColumn("_at", F.coalesce("_at", F.lit(0)))
    d = asked.unionByName(ends, allowMissingColumns=True).withColumn("_dt", (wide(F.col("_d")) * wide(F.col("_at"))).cast("decimal(28,0)"))
    d = carried(d, keys, "_at", ["_at", "_order"], chunk, sums={"_n": "_d", "_m": "_dt", "_b": "_begun", "_e": "_ended"}).filter("_order in (1, 2)")
    before = (wide(F.col("_n")) * wide(F.col("_at")) - F.col("_m")).cast("long")
    at = lambda order, c: F.max(F.when(F.col("_order") == order, c))
    g = d.groupBy(*windows.columns).agg((at(2, before) - at(1, before)).alias("_time"), (at(2, F.col("_b")) - at(1, F.col("_e"))).alias("_number"))
    some = F.coalesce(F.col(lo) < F.col(hi), F.lit(False))
    return g.select(*windows.columns, *[F.coalesce(F.when(some, F.col(c)), F.lit(0)).cast("long").alias(n) for c, n in (("_time", time), ("_number", number))])


def best_beyond(points: DataFrame, asked: DataFrame, keys: list[str], chunk: int, leaf: int = 7) -> DataFrame:
    """asked with ``best``: the greatest ``value`` of the points with equal keys whose x is at most, and whose y at least, the row's.

    Points have a place by x, and a row asks for all places below its own. These are one block of 2, 4, 8 ... places
    for each bit set in it, in which a running maximum by y, from the top, answers; within the last 2**leaf places points are compared.
    So the work grows with rows times the logarithm of the points, however many of them a row could meet. A block's rows are
    dealt over stretches of x and y of width ``chunk``: see carried. Rows that find nothing are left out.
    """
    ident = [c for c in asked.columns if c not in ("x", "y")]
    d = points.select(*keys, "x", "y", "value", F.lit(0).alias("_ask")).unionByName(asked.select(*keys, "x", "y", F.struct(*ident).alias("_row"), F.lit(1).alias("_ask")), allowMissingColumns=True)
    # Of equal x points come first; whatever is left open by the order is the same row.
    d = carried(d.withColumn("_one", (1 - F.col("_ask")).cast("long")), keys, "x", ["x", "_ask", "y", "value"], chunk, sums={"_place": "_one"})
    d = settled(d.withColumn("_place", F.col("_place") - F.col("_one")).drop("_one", "x").withColumn("_at", -F.col("y")))
    bits = (d.agg(F.max("_place")).first()[0] or 0).bit_length()
    found = lambda e: e.filter("best is not null").select(*keys, "_row", "best")
    # A point is in the lower half of a block by a bit that isn't set, and is asked for by rows in its upper half.
    levels = d.withColumn("_k", F.explode(F.expr(f"filter(sequence({leaf}, {max(bits, leaf)}), k -> shiftright(_place, k) % 2 = _ask)")))
    levels = carried(levels.withColumn("_block", F.expr("shiftright(_place, _k + 1)")), [*keys, "_k", "_block"], "_at", ["_at", "_ask"], chunk, highs={"best": "value"}).filter("_ask = 1")
    of = d.withColumn("_leaf", F.expr(f"shiftright(_place, {leaf})"))
    near = of.filter("_ask = 1").select(*keys, "_leaf", "_row", "_place", "y")
    near = near.join(of.filter("_ask = 0").select(*keys, "_leaf", F.col("_place").alias("_p"), F.col("y").alias("_y"), F.col("value").alias("best")), [*keys, "_leaf"]).filter("_p < _place and _y >= y")
    g = found(levels).unionByName(found(near)).groupBy(*keys, "_row").agg(F.max("best").alias("best"))
    return g.select("_row.*", "best")


def coalesce_spans(df: DataFrame, keys: list[str], start: str = "s", end: str = "e", chunk: int | None = None) -> DataFrame:
    """Merges spans that overlap or touch, per key. Empty spans are left out.

    With a chunk, a key's spans are dealt over stretches of time: see carried. Each such pass reads its rows twice, so
    they are written between the two; else the plan would hold the input four times, and grow by that with every step.
    """
    d = carried(df.filter(F.col(start) < F.col(end)).select(*keys, start, end), keys, start, [start, end], chunk, highs={"_before": end})
    d = d.withColumn("_new", F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before")), 1).otherwise(0)).drop("_before")
    d = carried(settled(d) if chunk else d, keys, start, [start, end], chunk, sums={"_island": "_new"})
    return d.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def subtract_spans(a: DataFrame, b: DataFrame, keys: list[str], ident: list[str], width: int, chunk: int | None = None) -> DataFrame:
    """What is left of each row of a (ident, keys, s, e) outside the spans of b (keys, s, e).

    A row of a meets each span once; the pieces before the first, between two and after the last
    of its overlaps are its remains. With a chunk, rows of a are cut at its multiples first, so
    no row meets more than a chunk's spans, and remains that touch there are not merged again.
    """
    spans = coalesce_spans(b.select(*keys, "s", "e"), keys, chunk=chunk).select(*keys, F.col("s").alias("b_start"), F.col("e").alias("b_end"))
    rows = a.filter("s < e")
    if chunk:
        rows = rows.withColumn("_c", F.explode(F.expr(f"sequence(cast(floor(s / {chunk}) as long), cast(floor((e - 1) / {chunk}) as long))")))
        rows = rows.withColumn("s", F.greatest("s", F.col("_c") * chunk)).withColumn("e", F.least("e", (F.col("_c") + 1) * chunk)).drop("_c")
    rows = rows.withColumn("a_start", F.col("s")).withColumn("a_end", F.col("e"))
    same = list(dict.fromkeys([*keys, *ident]))
    hit = overlap_join(rows.select(*same, "a_start", "a_end"), spans, keys, width).distinct()
    w = Window.partitionBy(*same, "a_start", "a_end").orderBy("b_start")
    nxt = F.coalesce(F.lead("b_start").over(w), F.col("a_end"))
    first = F.when(F.lag("b_start").over(w).isNull(), F.col("b_start"))
    cuts = hit.select(*same, "a_start", "a_end", F.col("b_end").alias("_s"), nxt.alias("_e"), first.alias("_f"))
    # The piece before the first overlap comes with the first one.
    pieces = F.array(F.struct(F.col("_s").alias("_s"), F.col("_e").alias("_e")), F.struct(F.col("a_start").alias("_s"), F.col("_f").alias("_e")))
    cuts = cuts.select(*same, "a_start", "a_end", F.inline(pieces))
    d = rows.join(cuts, [*same, "a_start", "a_end"], "left")
    met = F.col("_s").isNotNull()
    d = d.withColumn("s", F.when(met, F.col("_s")).otherwise(F.col("s"))).withColumn("e", F.when(met, F.col("_e")).otherwise(F.col("e")))
    return d.filter("s < e").drop("_s", "_e", "a_start", "a_end")


def pair_lifo(df: DataFrame, keys: list[str], order: list[str], start: Column, end: Column, reset: Column) -> DataFrame:
    """Pairs nested starts with their ends as a stack would; an end without a start is dropped.

    Adds kind ('start' or 'end'), level, epoch, and to starts the closing row's order columns as
    c_<name> (null if a reset or nothing closes it) and closed_by ('end', 'reset' or null).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("kind", F.when(reset, "reset").when(start, "start").when(end, "end")).filter("kind is not null")
    d = d.withColumn("epoch", F.sum(F.when(F.col("kind") == "reset", 1).otherwise(0)).over(upto))
    # The reset that closes an epoch is the first row of the next one.
    resets = [F.first(F.when(F.col("kind") == "reset", F.col(c)), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias(f"r_{c}") for c in order]
    d = d.select("*", *resets).filter("kind <> 'reset'")
    we = Window.partitionBy(*keys, "epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_raw", F.sum(F.when(F.col("kind") == "start", 1).otherwise(-1)).over(we))
    d = d.withColumn("_floor", F.least(F.lit(0), F.min("_raw").over(we)))
    d = d.withColumn("_depth", F.col("_raw") - F.col("_floor"))
    # An end that lowers the floor has no start.
    d = d.withColumn("_orphan", (F.col("kind") == "end") & (F.col("_floor") < F.coalesce(F.lag("_floor").over(Window.partitionBy(*keys, "epoch").orderBy(*order)), F.lit(0))))
    d = d.filter("not _orphan").withColumn("level", F.when(F.col("kind") == "start", F.col("_depth")).otherwise(F.col("_depth") + 1))
    wl = Window.partitionBy(*keys, "epoch", "level").orderBy(*order)
    d = d.withColumn("_next", F.lead("kind").over(wl))
    d = d.withColumn("closed_by", F.when(F.col("kind") == "start", F.when(F.col("_next") == "end", "end").when(F.col(f"r_{order[0]}").isNotNull(), "reset")))
    for c in order:
        d = d.withColumn(f"c_{c}", F.when(F.col("closed_by") == "end", F.lead(c).over(wl)).when(F.col("closed_by") == "reset", F.col(f"r_{c}")))
    return d.drop("_raw", "_floor", "_depth", "_orphan", "_next", *[f"r_{c}" for c in order])


def distinct_ahead(df: DataFrame, keys: list[str], t: str, actor: str, width: int, chunk: int | None = None) -> DataFrame:
    """For each moment on which an actor enters, how many distinct ones do from then on within ``width``: keys, t, actors.

    In the stretch that begins at some moment an actor counts by its first entry there. So an
    entry counts for all moments after the actor's entry before, and from ``width`` before
    it up to itself; these intervals are summed by a sweep, which takes time in line with the entries.
    """
    e = df.select(*keys, F.col(t).cast("long").alias("t"), actor).distinct()
    e = e.withColumn("_prev", F.lag("t").over(Window.partitionBy(*keys, actor).orderBy("t")))
    since = F.greatest(F.col("t") - width, F.coalesce(F.col("_prev") + 1, F.col("t") - width))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    point = lambda at, d, entry: F.struct(at.alias("t"), d.alias("_d"), F.lit(entry).alias("_entry"))
    ends = e.select(*keys, F.inline(F.array(point(since, one, 0), point(F.col("t") + 1, -one, 0), point(F.col("t"), none, 1))))
    ends = ends.groupBy(*keys, "t").agg(F.sum("_d").alias("_d"), F.max("_entry").alias("_entry"))
    out = carried(ends, keys, "t", ["t"], chunk, sums={"actors": "_d"})
    return out.filter("_entry = 1").select(*keys, "t", F.col("actors").cast("int").alias("actors"))


def greedy_apart(moments: DataFrame, keys: list[str], width: int, chunk: int) -> DataFrame:
    """Per key the moments (column t, distinct) that a pass in order takes: the first, then always the first more than ``width`` later.

    Each moment points to the one that would be taken after it. Tasks follow the pointers within
    stretches of ``chunk``, from each moment on to the first in a later stretch. Moments more than
    ``width`` after the one before them are taken whatever came before; from these, the first moment
    taken in each stretch is found by pointers of 2, 4, 8 ... stretches. Then each stretch is
    passed on its own. So no task meets more than a stretch, however long it goes without a break.
    """
    c = settled(moments)
    probe = c.select(*keys, (F.col("t") + width).alias("at"), F.lit(0).alias("_kind"), F.col("t").alias("_from"), F.lit(None).cast("long").alias("_t"))
    d = probe.unionByName(c.select(*keys, F.col("t").alias("at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_from"), (-F.col("t")).alias("_t")))
    # Backwards, the first moment after a point is the last one before it.
    d = carried(d.withColumn("_back", -F.col("at")), keys, "_back", ["_back", "_kind"], chunk, highs={"_next": "_t"})
    d = d.filter("_kind = 0").select(*keys, F.col("_from").alias("t"), F.coalesce(-F.col("_next"), F.lit(NONE)).alias("next"))
    last = carried(c.withColumn("_x", F.col("t")), keys, "t", ["t"], chunk, highs={"_last": "_x"})
    head = F.col("_last").isNull() | (F.col("t") > F.col("_last") + width)
    stretch = lambda x: F.floor(F.col(x) / chunk)
    d = d.join(last.select(*keys, "t", head.alias("head")), [*keys, "t"]).withColumn("_c", stretch("t"))
    kinds = ", ".join(f"`{k}` {c.schema[k].dataType.simpleString()}" for k in keys)

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a stretch from its end: where the pass leaves it from each moment."""
        of, at = None, {}
        for pdf in batches:
            to = []
            for *key, t, nxt in zip(*(pdf[k].tolist() for k in (*keys, "_c", "t", "next"))):
                if key != of:
                    of, at = key, {}
                at[t] = at.get(nxt, nxt)
                to.append(at[t])
            yield pdf.assign(to=to)[[*keys, "t", "to", "head"]]

    d = settled(d.repartition(*keys, "_c").sortWithinPartitions(*keys, "_c", F.desc("t")).mapInPandas(exits, f"{kinds}, t long, to long, head boolean"))
    d = d.withColumn("to", F.when(F.col("to") < NONE, F.col("to")))
    enter = d.filter("to is not null").select(*keys, F.col("to").alias("t")).unionByName(d.filter("head").select(*keys, "t")).distinct()
    hop = settled(d.join(enter, [*keys, "t"]).select(*keys, F.col("t").alias("_at"), F.col("to").alias("_to"), "head"))
    taken, hop = settled(hop.filter("head").select(*keys, F.col("_at").alias("t"))), hop.drop("head").filter("_to is not null")
    while not hop.isEmpty():
        step = taken.withColumnRenamed("t", "_at").join(hop, [*keys, "_at"]).select(*keys, F.col("_to").alias("t"))
        taken = settled(taken.unionByName(step).distinct())
        ahead = hop.select(*keys, F.col("_at").alias("_to"), F.col("_to").alias("_far"))
        hop = settled(hop.join(ahead, [*keys, "_to"]).select(*keys, "_at", F.col("_far").alias("_to")))
    marked = c.join(taken.withColumn("_start", F.lit(True)), [*keys, "t"], "left").withColumn("_c", stretch("t"))

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, until = None, None
        for pdf in batches:
            keep = []
            for *key, t, start in zip(*(pdf[k].tolist() for k in (*keys, "_c", "t", "_start"))):
                if key != of:
                    of, until = key, None
                ok = start is True or (until is not None and t > until)
                until = t + width if ok else until
                keep.append(ok)
            yield pdf[keep][[*keys, "t"]]

    return marked.repartition(*keys, "_c").sortWithinPartitions(*keys, "_c", "t").mapInPandas(passed, f"{kinds}, t long")


def greedy_onsets(df: DataFrame, keys: list[str], t: str, actor: str, width: int, least: int, chunk: int | None = None) -> DataFrame:
    """Onsets: from each moment on which at least ``least`` actors entered within ``width``, greedily
    and without overlap. Returns keys, onset and actors.

    Work is dealt over stretches of time (64 times ``width``, or ``chunk``): see distinct_ahead and greedy_apart.
    """
    chunk = chunk or 64 * max(1, width)
    c = settled(distinct_ahead(df, keys, t, actor, width, chunk).filter(F.col("actors") >= least))
    on = greedy_apart(c.select(*keys, "t"), keys, width, chunk)
    return c.join(on, [*keys, "t"]).select(*keys, F.col("t").alias("onset"), "actors")


def state_ranges(spans: Iterable[tuple[str, DataFrame]], lo: int, hi: int, chunk: int | None = None) -> DataFrame:
    """Partition of [lo, hi) by which of the named span sets (columns s, e) cover each stretch.

    Returns s, e and one boolean for each name. The sweep runs over the endpoints alone, and by
    a thousandth of [lo, hi) at a time (or ``chunk``), so it is not one task's work.
    """
    named = list(spans)
    chunk = chunk or max(1, (hi - lo) // 1000)
    names = [f"d{i}" for i in range(len(named))]
    ends = None
    for k, (_, d) in enumerate(named):
        c = d.select(F.lit(0).alias("_k"), F.greatest("s", F.lit(lo)).alias("s"), F.least("e", F.lit(hi)).alias("e")).filter("s < e")
        up = [F.lit(int(i == k)).cast("long").alias(n) for i, n in enumerate(names)]
        down = [F.lit(-int(i == k)).cast("long").alias(n) for i, n in enumerate(names)]
        part = c.select("_k", F.inline(F.array(F.struct(F.col("s").alias("t"), *up), F.struct(F.col("e").alias("t"), *down))))
        ends = part if ends is None else ends.unionByName(part)
    # One row at the start of every chunk, so that each chunk knows where the next begins.
    spark, first, last = named[0][1].sparkSession, lo // chunk, -(-hi // chunk)
    marks = spark.range(first, last + 1).select(F.lit(0).alias("_k"), F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("id") * chunk)).alias("t"), *[F.lit(0).cast("long").alias(n) for n in names])
    ends = ends.unionByName(marks).groupBy("_k", "t").agg(*[F.sum(n).alias(n) for n in names])
    ends = carried(ends, ["_k"], "t", ["t"], chunk, sums={f"n{i}": n for i, n in enumerate(names)})
    c = F.expr(f"floor(t / {chunk})")
    upto = F.least(F.lit(hi), (c + 1) * chunk)
    w = Window.partitionBy(c).orderBy("t")
    out = ends.select(F.col("t").alias("s"), F.coalesce(F.lead("t").over(w), upto).alias("e"), *[(F.col(f"n{i}") > 0).alias(n) for i, (n, _) in enumerate(named)])
    out = out.filter("s < e")
    # Stretches that a chunk's edge alone has cut are put together again.
    flags = [n for n, _ in named]
    return coalesce_spans(out, flags, chunk=chunk).select("s", "e", *flags)
