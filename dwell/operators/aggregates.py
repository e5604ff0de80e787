"""Aggregations over a window of interval rows (see dwell.sources.intervals for the columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwell.functions.intervals import split_to_buckets
from dwell.functions.rules import CLASS_NAMES, bucket_edge, class_of, clip, cpu_share, is_idle, latency_bucket

HIST = 16


def zero(c) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def bucket_width(lo: int, hi: int, n: int) -> int:
    return -(-(hi - lo) // n)


def on_cpu(lo: Column, hi: Column) -> Column:
    """What of [lo, hi) counts under a row's own state: the measured CPU of a row on CPU, at most
    the stretch itself, and the whole stretch of any other row (waits, and CPU not measured)."""
    whole = hi - lo
    measured = (F.col("old_event") == 0) & F.col("cpu").isNotNull()
    return F.when(measured, F.least(cpu_share(F.col("cpu"), F.col("start"), F.col("dur"), lo, hi), whole)).otherwise(whole)


def load(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows that aren't markers, with class, idle, wall (their length within the window), used (see
    on_cpu; wall less used is time that waited for a core) and measured (their CPU is known)."""
    d = df.filter(F.col("marker").isNull()).withColumn("wall", clip(F.col("start"), F.col("ts"), lo, hi))
    d = d.withColumn("class", class_of(F.col("old_event"))).withColumn("idle", is_idle(F.col("old_event")))
    a, b = F.greatest("start", F.lit(lo)), F.least("ts", F.lit(hi))
    d = d.withColumn("used", F.when(F.col("wall") > 0, on_cpu(a, b)).otherwise(0).cast("long"))
    return d.withColumn("measured", (F.col("old_event") == 0) & F.col("cpu").isNotNull() & (F.col("wall") > 0))


def not_io_worker(df: DataFrame) -> DataFrame:
    """Rows of io workers are left out, where the table knows them."""
    return df.filter("backend is null or backend <> 'io_worker'") if "backend" in df.columns else df


def aas(df: DataFrame, lo: int, hi: int, n: int = 120) -> DataFrame:
    """Average active actors: bucket, one column per class, off_cpu and total.

    Idle states and io workers are no load. cpu is measured CPU where that is known, and off_cpu
    what is left of those rows; the total has both.
    """
    width = bucket_width(lo, hi, n)
    d = split_to_buckets(not_io_worker(load(df, lo, hi).filter("not idle")), lo, hi, width)
    d = d.withColumn("_wall", F.col("b_hi") - F.col("b_lo")).withColumn("_used", on_cpu(F.col("b_lo"), F.col("b_hi")))
    sums = [F.sum(F.when(F.col("class") == c, F.col("_used")).otherwise(0)).alias(c) for c in CLASS_NAMES]
    sums = d.groupBy("bucket").agg(*sums, F.sum(F.col("_wall") - F.col("_used")).alias("off_cpu"), F.sum("_wall").alias("total"))
    every = df.sparkSession.range(-(-(hi - lo) // width)).select(F.col("id").alias("bucket"))
    out = every.join(sums, "bucket", "left")
    return out.select("bucket", *[(zero(F.col(c)) / width).alias(c) for c in (*CLASS_NAMES, "off_cpu", "total")])


def aas_peak(df: DataFrame, lo: int, hi: int, n: int = 120) -> DataFrame:
    return aas(df, lo, hi, n).agg(F.max("total").alias("max_aas"))


def aas_by_event(df: DataFrame, lo: int, hi: int, n: int = 120, top: int = 16) -> DataFrame:
    """Series of the ``top`` states with the most time in the window (ties to the smaller id)."""
    width = bucket_width(lo, hi, n)
    d = load(df, lo, hi).filter("not idle")
    best = d.groupBy("old_event").agg(F.sum("wall").alias("total")).orderBy(F.desc("total"), "old_event").limit(top).select("old_event")
    s = split_to_buckets(d.join(F.broadcast(best), "old_event", "left_semi"), lo, hi, width)
    return s.groupBy("old_event", "bucket").agg((F.sum(F.col("b_hi") - F.col("b_lo")) / width).alias("aas"))


def aas_by_category(df: DataFrame, lo: int, hi: int, n: int = 120) -> DataFrame:
    width = bucket_width(lo, hi, n)
    s = split_to_buckets(load(df, lo, hi).filter("not idle"), lo, hi, width)
    return s.groupBy("category", "bucket").agg((F.sum(F.col("b_hi") - F.col("b_lo")) / width).alias("aas"))


def time_model(df: DataFrame, lo: int, hi: int, per_class: int = 5) -> DataFrame:
    """Rows DB Time, each class with its largest states, and Idle with its states.

    label, parent, time, pct of DB Time (null for idle) and aas. Where CPU was measured it has
    two rows, running and waiting for a core; else all of it is CPU*. Classes without time are
    left out. Idle states of background loops (Activity) are one remainder row. io workers are
    neither load nor idle.
    """
    e = not_io_worker(load(df, lo, hi)).groupBy("class", "idle", "old_event").agg(
        F.sum("wall").alias("time"), F.sum("used").alias("used"), F.max("measured").alias("measured")
    ).filter("time > 0")
    total = F.sum(F.when(~F.col("idle"), F.col("time"))).over(Window.partitionBy())  # a row for each state
    cpu = F.col("class") == "cpu"
    parent = F.when(F.col("idle"), "Idle").otherwise(F.col("class"))
    name = F.when(F.col("class") == "activity", "Other idle").otherwise(F.col("old_event").cast("string"))
    e = e.withColumn("_db", zero(total)).withColumn("_rn", F.row_number().over(Window.partitionBy(parent).orderBy(F.desc("time"), "old_event")))
    running = F.when(F.col("measured"), "CPU (running)").otherwise("CPU*")
    row = lambda label, up, t: F.struct(label.alias("label"), F.lit(up).alias("parent") if isinstance(up, str) else up.alias("parent"), t.alias("time"))
    # Each state adds to the rows above it.
    rows = F.array(
        F.when(~F.col("idle"), row(F.lit("DB Time"), "", F.col("time"))),
        F.when(~F.col("idle"), row(F.when(cpu, running).otherwise(F.col("class")), "DB Time", F.col("used"))),
        F.when(cpu & F.col("measured"), row(F.lit("CPU (waiting for a core)"), "DB Time", F.col("time") - F.col("used"))),
        F.when(~F.col("idle") & ~cpu & (F.col("_rn") <= per_class), row(F.col("old_event").cast("string"), F.col("class"), F.col("time"))),
        F.when(F.col("idle"), row(F.lit("Idle"), "", F.col("time"))),
        F.when(F.col("idle"), row(name, "Idle", F.col("time"))),
    )
    out = e.select("_db", F.inline(F.filter(rows, lambda x: x.isNotNull())))
    out = out.groupBy("label", "parent").agg(F.sum("time").alias("time"), F.max("_db").alias("_db"))
    idle = (F.col("label") == "Idle") | (F.col("parent") == "Idle")
    pct = F.when(~idle & (F.col("_db") > 0), 100.0 * F.col("time") / F.col("_db"))
    return out.select("label", "parent", "time", pct.alias("pct"), (F.col("time") / (hi - lo)).alias("aas"))


def category_time(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Time per backend category, and how busy io workers were in percent."""
    d = load(df, lo, hi).filter("not idle")
    return d.groupBy("backend").agg(F.sum("wall").alias("time"), F.count_distinct("pid").alias("pids")).select("backend", "time", "pids", F.when(F.col("backend") == "io_worker", 100.0 * F.col("time") / (F.col("pids") * (hi - lo))).alias("busy_pct"))


def cpu_checks(df: DataFrame) -> DataFrame:
    """CPU measured beyond a row's length, CPU measured inside waits, and time off CPU in CPU rows."""
    d = df.filter("marker is null and cpu is not null")
    cpu, dur = F.col("cpu"), F.col("dur")
    return d.agg(
        zero(F.sum(F.when(cpu > dur, cpu - dur))).alias("clamped"),
        zero(F.sum(F.when(F.col("old_event") != 0, F.least(cpu, dur)))).alias("in_waits"),
        zero(F.sum(F.when(F.col("old_event") == 0, F.greatest(dur - cpu, F.lit(0))))).alias("off_cpu"),
    )


def histogram(dur: Column, unit: int) -> list[Column]:
    b = latency_bucket(dur, unit, HIST)
    return [F.sum(F.when(dur.isNotNull() & (b == i), 1).otherwise(0)).alias(f"h{i}") for i in range(HIST)]


def cumulative(df: DataFrame) -> DataFrame:
    """Adds _cum, the running sums of h0, h1, ..."""
    d = df.withColumn("_h", F.array(*[F.col(f"h{i}").cast("long") for i in range(HIST)]))
    add = lambda acc, x: acc + x
    return d.withColumn("_cum", F.transform(F.sequence(F.lit(1), F.lit(HIST)), lambda n: F.aggregate(F.slice("_h", 1, n), F.lit(0).cast("long"), add)))


def hist_percentile(p: float, unit: int) -> Column:
    """Upper edge of the bucket that holds the nearest-rank percentile, from _cum; the open last
    bucket gives its lower edge."""
    total = F.element_at("_cum", HIST)
    rank = F.greatest(F.lit(1), F.ceil(total * p))
    edges = F.array(*[F.lit(bucket_edge(min(b, HIST - 2), unit)).cast("long") for b in range(HIST)])
    return F.when(total > 0, F.element_at(edges, F.size(F.filter("_cum", lambda x: x < rank)) + 1))


def hist_above(p: float) -> Column:
    """Whether the percentile lies in the open last bucket: hist_percentile is then no more than a lower bound."""
    total = F.element_at("_cum", HIST)
    return F.when(total > 0, F.element_at("_cum", HIST - 1) < F.greatest(F.lit(1), F.ceil(total * p)))


def top_events(df: DataFrame, lo: int, hi: int, unit: int) -> DataFrame:
    """Per state: closes, time in the window, latencies of exact closes, share of DB time (null if idle), aas.

    The row of state 0 has the measured CPU where that is known, as in time_model.
    """
    d = load(df, lo, hi)
    closes = ~F.col("is_sample") & (F.col("ts") >= lo) & (F.col("ts") < hi)
    d = d.withColumn("_d", F.when(closes, F.col("dur")))
    e = d.groupBy("old_event", "idle").agg(F.count("_d").alias("n"), F.sum("used").alias("time"), F.sum("wall").alias("_wall"), F.avg("_d").alias("avg_dur"), F.max("_d").alias("max_dur"), *histogram(F.col("_d"), unit))
    e = cumulative(e.withColumn("db", zero(F.sum(F.when(~F.col("idle"), F.col("_wall"))).over(Window.partitionBy()))))  # a row for each state
    ps = [hist_percentile(p, unit).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)] + [hist_above(p).alias(f"p{round(p * 100)}_above") for p in (0.5, 0.95, 0.99)]
    return e.select("old_event", "n", "time", "avg_dur", "max_dur", *ps, F.when(~F.col("idle") & (F.col("db") > 0), 100.0 * F.col("time") / F.col("db")).alias("pct"), (F.col("time") / (hi - lo)).alias("aas"))


def top_sessions(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Per actor: DB time, CPU (measured where known) and wait percent of it, time off CPU, and its
    largest wait ('CPU*' is null here). The percents leave out what waited for a core."""
    d = not_io_worker(load(df, lo, hi).filter("not idle"))
    e = d.groupBy("pid", "old_event").agg(F.sum("wall").alias("t"), F.sum("used").alias("u"))
    wait = F.col("old_event") != 0
    best = F.max_by(F.when(wait, F.col("old_event")), F.when(wait & (F.col("t") > 0), F.struct("t", -F.col("old_event"))))
    s = e.groupBy("pid").agg(
        F.sum("t").alias("db_time"), zero(F.sum(F.when(~wait, F.col("u")))).alias("cpu"), zero(F.sum(F.when(wait, F.col("t")))).alias("waits"), F.sum(F.col("t") - F.col("u")).alias("off_cpu"), best.alias("top_wait")
    ).filter("db_time > 0")
    part = lambda c: (100.0 * F.col(c) / F.col("db_time"))
    return s.select("pid", "db_time", part("cpu").alias("cpu_pct"), part("waits").alias("wait_pct"), "off_cpu", "top_wait")


def top_queries(df: DataFrame, lo: int, hi: int, top: int | None = 16) -> DataFrame:
    """Per query id: closes, average of exact closes, time, share of all attributed time, time by class,
    largest state (null: CPU) and the ``top`` largest states (None: all)."""
    d = not_io_worker(load(df, lo, hi).filter("not idle and query_id <> 0"))
    closes = ~F.col("is_sample") & (F.col("ts") >= lo) & (F.col("ts") < hi)
    e = d.groupBy("query_id", "class", "old_event").agg(F.sum("wall").alias("t"), F.sum(F.when(closes, 1).otherwise(0)).alias("n"), F.sum(F.when(closes, F.col("dur"))).alias("d"))
    order = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("t")).alias("neg"), "old_event"))), lambda x: x["old_event"])
    largest = F.struct("t", F.col("old_event") != 0, -F.col("old_event"))  # CPU has to be above every wait
    q = e.groupBy("query_id").agg(
        F.sum("n").alias("n"), (F.sum("d") / F.sum("n")).alias("avg_dur"), F.sum("t").alias("time"),
        *[zero(F.sum(F.when(F.col("class") == c, F.col("t")))).alias(f"{c}_time") for c in CLASS_NAMES],
        F.max_by(F.when(F.col("old_event") != 0, F.col("old_event")), F.when(F.col("t") > 0, largest)).alias("top_wait"),
        (order if top is None else F.slice(order, 1, top)).alias("events"),
    )
    total = q.agg(F.sum("time").alias("all_time"))
    q = q.join(F.broadcast(total)).withColumn("pct", 100.0 * F.col("time") / F.col("all_time"))
    return q.select("query_id", "n", "avg_dur", "time", "pct", *[f"{c}_time" for c in CLASS_NAMES], "top_wait", F.array_join(F.col("events").cast("array<string>"), ",").alias("events"))


def query_totals(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """One row: time of rows with a query (theirs or filled in), what of it was filled in, and time and
    closes of foreground rows that have none. df comes from annotate.attribute_queries."""
    d = not_io_worker(load(df, lo, hi).filter("not idle"))
    has = F.col("attributed_id") != 0
    none = ~has & (F.col("backend") == "foreground")
    closes = (F.col("ts") >= lo) & (F.col("ts") < hi)
    return d.agg(
        zero(F.sum(F.when(has, F.col("wall")))).alias("db_time"),
        zero(F.sum(F.when(has & (F.col("attribution") != "own"), F.col("wall")))).alias("backfilled_time"),
        zero(F.sum(F.when(none, F.col("wall")))).alias("unattributed_time"),
        zero(F.sum(F.when(none & closes, 1))).alias("unattributed_count"),
    )


def heatmap(df: DataFrame, lo: int, hi: int, unit: int, n: int = 200) -> DataFrame:
    """Closes per time bucket and latency bucket, without io workers; sparse."""
    width = bucket_width(lo, hi, n)
    d = not_io_worker(df).filter("marker is null and not is_sample").filter((F.col("ts") >= lo) & (F.col("ts") < hi) & (F.shiftright("old_event", 24) != 0x05))
    return d.groupBy(F.expr(f"(ts - {lo}) div {width}").alias("bucket"), latency_bucket(F.col("dur"), unit).alias("latency")).agg(F.count("*").alias("n"))


def event_histogram(df: DataFrame, lo: int, hi: int, unit: int) -> DataFrame:
    """Per state and latency bucket: closes, percent and cumulative percent."""
    d = df.filter("marker is null and not is_sample").filter((F.col("ts") >= lo) & (F.col("ts") < hi))
    c = d.groupBy("old_event", latency_bucket(F.col("dur"), unit).alias("latency")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("old_event")
    cum = F.sum("n").over(w.orderBy("latency").rowsBetween(Window.unboundedPreceding, 0))
    return c.select("old_event", "latency", "n", (100.0 * F.col("n") / F.sum("n").over(w)).alias("pct"), (100.0 * cum / F.sum("n").over(w)).alias("cum_pct"))


def query_event(df: DataFrame, lo: int, hi: int, query_id: int | None = None, event: int | None = None) -> DataFrame:
    """Time and closes per query and state; for one state or one query if given."""
    d = load(df, lo, hi).filter("not idle and query_id <> 0")
    if query_id is not None:
        d = d.filter(F.col("query_id") == query_id)
    if event is not None:
        d = d.filter(F.col("old_event") == event)
    return d.groupBy("query_id", "old_event").agg(F.sum(F.when((F.col("ts") >= lo) & (F.col("ts") < hi), 1).otherwise(0)).alias("n"), F.sum("wall").alias("time"))


def record_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("ts").alias("last"), F.count_distinct("pid").alias("pids"))
