"""Comparison of windows, whole-capture report, estimator validation, additivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwell.functions.rules import CLASS_NAMES, class_of, clip, is_idle
from dwell.operators.aggregates import aas, time_model, top_events, top_queries, top_sessions, zero


def compare(a: DataFrame, b: DataFrame, key: str, value: str = "time", floor_share: float = 0.01, floor: int = 50_000) -> DataFrame:
    """Two windows' totals per entity: delta, ratio (null if one side has none), status, and how many fall
    below the larger of ``floor_share`` of A's total and ``floor``."""
    x = a.groupBy(key).agg(F.sum(value).alias("a"))
    y = b.groupBy(key).agg(F.sum(value).alias("b"))
    j = x.join(y, key, "full_outer").withColumn("status", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").otherwise("both"))
    j = j.withColumn("a", zero(F.col("a"))).withColumn("b", zero(F.col("b")))
    least = F.greatest(floor_share * F.sum("a"), F.lit(float(floor)))
    j = j.join(F.broadcast(j.agg(least.alias("least"))))
    big = F.greatest("a", "b") >= F.col("least")
    return j.select(key, "a", "b", (F.col("b") - F.col("a")).alias("delta"), F.abs(F.col("b") - F.col("a")).alias("change"), F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("b") / F.col("a")).alias("ratio"), "status", (~big).alias("below_floor"))


def baseline_presets(first: int, last: int, window: int) -> list[int]:
    """Offsets at 25, 50 and 100 percent of the history that can still hold the window, rounded."""
    room = max(0, last - first - window)
    return [round(room * p) for p in (0.25, 0.5, 1.0) if room]


def bucket_difference(df: DataFrame, lo: int, hi: int, offset: int, n: int) -> DataFrame:
    """Per bucket and class: the window less the window ``offset`` earlier."""
    a, b = aas(df, lo, hi, n), aas(df, lo - offset, hi - offset, n)
    b = b.select("bucket", *[F.col(c).alias(f"b_{c}") for c in CLASS_NAMES])
    return a.join(b, "bucket").select("bucket", *[(F.col(c) - F.col(f"b_{c}")).alias(c) for c in CLASS_NAMES])


def report(df: DataFrame, lo: int, hi: int, unit: int) -> DataFrame:
    """Time model, states, actors and queries of a whole capture as rows (section, label, time)."""
    parts = [
        time_model(df, lo, hi).select(F.lit("time_model").alias("section"), F.concat_ws("/", "parent", "label").alias("label"), "time"),
        top_events(df, lo, hi, unit).select(F.lit("events").alias("section"), F.col("old_event").cast("string").alias("label"), "time"),
        top_sessions(df, lo, hi).select(F.lit("sessions").alias("section"), F.col("pid").cast("string").alias("label"), F.col("db_time").alias("time")),
        top_queries(df, lo, hi).select(F.lit("queries").alias("section"), F.col("query_id").cast("string").alias("label"), "time"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cross_validate(exact: DataFrame, samples: DataFrame, lo: int, hi: int) -> DataFrame:
    """Per state its share of load by exact rows and by samples, and the gap in percentage points."""

    def shares(d: DataFrame, name: str) -> DataFrame:
        s = d.filter("marker is null").filter(~is_idle(F.col("old_event"))).groupBy("old_event").agg(F.sum(clip(F.col("start"), F.col("ts"), lo, hi)).alias("t"))
        return s.join(F.broadcast(s.agg(F.sum("t").alias("all")))).select("old_event", (100.0 * F.col("t") / F.col("all")).alias(name))

    j = shares(exact, "exact_pct").join(shares(samples, "sampled_pct"), "old_event", "full_outer")
    return j.select("old_event", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("exact_pct", "sampled_pct")]).withColumn("gap", F.abs(F.col("exact_pct") - F.col("sampled_pct")))


def cross_summary(gaps: DataFrame, least: float = 1.0, top: int = 5) -> DataFrame:
    """One row for cross_validate's result: the largest gap among states with a share of ``least`` percent
    either way, that of whole classes, and how many of the ``top`` states both ways have in common."""
    e, s = F.col("exact_pct"), F.col("sampled_pct")
    place = lambda c: F.row_number().over(Window.partitionBy().orderBy(c.desc(), "old_event"))  # noqa: E731  # a row for each state
    d = gaps.withColumn("_e", place(e)).withColumn("_s", place(s)).withColumn("class", class_of(F.col("old_event")))
    seen = F.greatest(e, s) >= least
    by_class = d.groupBy("class").agg(F.abs(F.sum("exact_pct") - F.sum("sampled_pct")).alias("g")).agg(F.max("g").alias("max_class_gap"))
    one = d.agg(F.max(F.when(seen, F.col("gap"))).alias("max_gap"), F.sum(F.when((F.col("_e") <= top) & (F.col("_s") <= top), 1).otherwise(0)).alias("common_top"))
    return one.join(F.broadcast(by_class))


def additivity(df: DataFrame, cuts: list[int], unit: int) -> DataFrame:
    """States whose closes or time over adjoining windows don't add up to the whole window: empty if all do."""
    whole = top_events(df, cuts[0], cuts[-1], unit).select("old_event", "n", "time")
    parts = None
    for lo, hi in zip(cuts, cuts[1:]):
        p = top_events(df, lo, hi, unit).select("old_event", "n", "time")
        parts = p if parts is None else parts.unionByName(p)
    total = parts.groupBy("old_event").agg(F.sum("n").alias("n"), F.sum("time").alias("time"))
    return whole.exceptAll(total).union(total.exceptAll(whole))
