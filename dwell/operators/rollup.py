"""Rollups over fixed ticks, built from annotated rows, and what is answered from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwell.functions.rules import CLASS_NAMES, class_of, clip, is_idle
from dwell.operators.aggregates import HIST, cumulative, histogram, hist_percentile, zero


#: Ticks that an actor's rows are dealt by, and into how many parts: a task aggregates its own part of them, whatever reads the rollup.
STRETCH, PARTS = 24, 384


def build(df: DataFrame, tick: int, unit: int) -> DataFrame:
    """One row per tick, state, actor and query: time within the tick, and count, longest and histogram
    of the exact rows that close in it. Markers and io workers are left out.

    Rows are dealt by actor and stretch of ticks before they are cut at each tick, so what is shuffled
    is about one row for each given one, and no task holds the ticks of more than one part.
    """
    d = df.filter("marker is null and (backend is null or backend <> 'io_worker')")
    key = ["tick", "old_event", "pid", "query_id"]
    # An exact row also meets the tick in which it closes, where it may have no time.
    begin, closes = F.least("start", "ts"), F.expr("not is_sample")
    last = F.when(closes, F.col("ts")).otherwise(F.col("ts") - 1)
    d = d.select("old_event", "pid", "query_id", "dur", "ts", begin.alias("start"), closes.alias("_closes"), last.alias("_last")).filter("start <= _last")
    part = lambda t: f"cast(floor(({t} div {tick}) / {STRETCH}) as bigint)"
    d = d.withColumn("_part", F.explode(F.expr(f"sequence({part('start')}, {part('_last')})"))).repartition(PARTS, "pid", "_part")
    d = d.withColumn("tick", F.explode(F.expr(f"sequence(greatest(start div {tick}, _part * {STRETCH}), least(_last div {tick}, _part * {STRETCH} + {STRETCH - 1}))")))
    time = F.least(F.col("ts"), (F.col("tick") + 1) * tick) - F.greatest(F.col("start"), F.col("tick") * tick)
    dur = F.when(F.col("_closes") & (F.col("tick") == F.expr(f"ts div {tick}")), F.col("dur"))
    d = d.select(*key, "_part", time.alias("time"), dur.alias("dur"))
    # Grouped by the part as well, which the tick fixes, so that rows stay where they are.
    g = d.groupBy("_part", *key).agg(F.sum("time").alias("time"), F.count("dur").alias("n"), F.sum("dur").alias("full"), F.max("dur").alias("longest"), *histogram(F.col("dur"), unit))
    return g.select(*key, *[zero(F.col(x)).alias(x) for x in ("time", "n", "full", "longest", *[f"h{i}" for i in range(HIST)])])


def write(rollup: DataFrame, path: str, per_part: int) -> None:
    """``per_part`` ticks go into one partition folder."""
    rollup.withColumn("part", F.expr(f"tick div {per_part}")).repartition("part").write.partitionBy("part").parquet(path)


def aas(r: DataFrame, tick: int, lo: int, hi: int, ticks_per_bucket: int) -> DataFrame:
    """lo and hi must be whole ticks."""
    d = r.filter((F.col("tick") >= lo // tick) & (F.col("tick") < hi // tick)).filter(~is_idle(F.col("old_event"))).withColumn("class", class_of(F.col("old_event")))
    b = F.expr(f"(tick - {lo // tick}) div {ticks_per_bucket}")
    g = d.groupBy(b.alias("bucket")).agg(*[F.sum(F.when(F.col("class") == c, F.col("time")).otherwise(0)).alias(c) for c in CLASS_NAMES], F.sum("time").alias("total"))
    width = tick * ticks_per_bucket
    every = r.sparkSession.range(-(-(hi - lo) // width)).select(F.col("id").alias("bucket"))
    return every.join(g, "bucket", "left").select("bucket", *[(zero(F.col(c)) / width).alias(c) for c in (*CLASS_NAMES, "total")])


def time_model(r: DataFrame, tick: int, lo: int, hi: int) -> DataFrame:
    d = r.filter((F.col("tick") >= lo // tick) & (F.col("tick") < hi // tick))
    return d.groupBy(F.when(is_idle(F.col("old_event")), "Idle").otherwise(class_of(F.col("old_event"))).alias("label")).agg(F.sum("time").alias("time"))


def top_events(r: DataFrame, tick: int, lo: int, hi: int, unit: int) -> DataFrame:
    d = r.filter((F.col("tick") >= lo // tick) & (F.col("tick") < hi // tick))
    g = d.groupBy("old_event").agg(F.sum("n").alias("n"), F.sum("time").alias("time"), F.max("longest").alias("max_dur"), *[F.sum(f"h{i}").alias(f"h{i}") for i in range(HIST)])
    g = cumulative(g)
    return g.select("old_event", "n", "time", F.when(F.col("n") > 0, F.col("max_dur")).alias("max_dur"), hist_percentile(0.95, unit).alias("p95"))


def top_sessions(r: DataFrame, tick: int, lo: int, hi: int) -> DataFrame:
    d = r.filter((F.col("tick") >= lo // tick) & (F.col("tick") < hi // tick)).filter(~is_idle(F.col("old_event")))
    return d.groupBy("pid").agg(F.sum("time").alias("db_time"), zero(F.sum(F.when(F.col("old_event") == 0, F.col("time")))).alias("cpu")).filter("db_time > 0")


def top_queries(r: DataFrame, tick: int, lo: int, hi: int) -> DataFrame:
    d = r.filter((F.col("tick") >= lo // tick) & (F.col("tick") < hi // tick)).filter(~is_idle(F.col("old_event")) & (F.col("query_id") != 0))
    return d.groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("time").alias("time"))


def heatmap(r: DataFrame, tick: int, lo: int, hi: int, ticks_per_bucket: int) -> DataFrame:
    d = r.filter((F.col("tick") >= lo // tick) & (F.col("tick") < hi // tick) & (F.shiftright("old_event", 24) != 0x05))
    stack = ", ".join(f"{i}, h{i}" for i in range(HIST))
    h = d.selectExpr(f"(tick - {lo // tick}) div {ticks_per_bucket} as bucket", f"stack({HIST}, {stack}) as (latency, n)")
    return h.groupBy("bucket", "latency").agg(F.sum("n").alias("n")).filter("n > 0")


def transition_rollup(moves: DataFrame, tick: int) -> DataFrame:
    """Count and time of each pair of states by the tick of the close."""
    return moves.groupBy(F.expr(f"ts div {tick}").alias("tick"), "old_event", "new_event").agg(F.count("*").alias("n"), F.sum("dur").alias("time"))


def transitions(r: DataFrame, moves: DataFrame, tick: int, lo: int, hi: int) -> DataFrame:
    """Whole ticks from the rollup, the edges of the window from the rows."""
    first, last = -(-lo // tick), hi // tick
    t = F.col("ts")
    edge = moves.filter((t >= lo) & (t < hi) & ((t < first * tick) | (t >= last * tick))).select("old_event", "new_event", F.lit(1).cast("long").alias("n"), F.col("dur").alias("time"))
    whole = r.filter((F.col("tick") >= first) & (F.col("tick") < last)).select("old_event", "new_event", "n", "time")
    return whole.union(edge).groupBy("old_event", "new_event").agg(F.sum("n").alias("n"), F.sum("time").alias("time"))


def nodes(r: DataFrame, moves: DataFrame, tick: int, lo: int, hi: int) -> DataFrame:
    """Per state how often it was left and entered and its time, from the same transitions; and the time of
    samples in the window apart, as these are no transitions."""
    t = transitions(r, moves.filter("not is_sample"), tick, lo, hi)
    left = t.select(F.col("old_event").alias("event"), "n", "time", F.lit(0).cast("long").alias("entered"), F.lit(0).cast("long").alias("sampled_time"))
    into = t.select(F.col("new_event").alias("event"), F.lit(0).cast("long"), F.lit(0).cast("long"), "n", F.lit(0).cast("long"))
    sampled = moves.filter("is_sample").select(F.col("old_event"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), clip(F.col("start"), F.col("ts"), lo, hi))
    return left.union(into).union(sampled).groupBy("event").agg(*[F.sum(c).alias(c) for c in ("n", "time", "entered", "sampled_time")])


def trailing(df: DataFrame, at: int, lengths: dict[str, int], first: int) -> DataFrame:
    """Time per state over several windows that end at ``at``, side by side; null where history is too short."""
    d = df.filter("marker is null").filter(F.col("ts") > at - max(lengths.values()))
    cols = [F.sum(clip(F.col("start"), F.col("ts"), at - n, at)).alias(k) for k, n in lengths.items()]
    g = d.groupBy("old_event").agg(*cols)
    return g.select("old_event", *[(F.col(k) if first <= at - n else F.lit(None).cast("long")).alias(k) for k, n in lengths.items()])


def snapshot_delta(snapshots: DataFrame, lag: int) -> DataFrame:
    """Growth of cumulative counters (tick, old_event, total) over ``lag`` ticks, never below zero."""
    w = Window.partitionBy("old_event").orderBy("tick")
    return snapshots.select("tick", "old_event", F.greatest(F.col("total") - F.lag("total", lag).over(w), F.lit(0)).alias("delta"))
