"""Sources: interval tables, dimensions, scenarios, sample decoding, exact-wins merge, clocks; sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwell.functions.intervals import subtract_spans
from dwell.functions.rules import class_of

#: Canonical columns of an interval table; a row stands for [start, ts).
COLUMNS = ["capture", "seq", "ts", "start", "dur", "pid", "old_event", "new_event", "query_id", "cpu", "is_sample", "marker"]

BACKENDS = "pid long, type string, user string, db string, leader_pid long, dbid long, userid long"
QUERY_TEXTS = "q string, d long, u long, s string, t string, ts long, v string"
SCENARIO = (
    "backends array<struct<pid: bigint, type: string, user: string, db: string>>, "
    "queries array<struct<id: bigint, text: string>>, "
    "events array<struct<pid: bigint, ts: bigint, dur: bigint, old: bigint, new: bigint, qid: bigint, cpu: bigint>>, "
    "sample_period_ns bigint, samples array<struct<pid: bigint, ts: bigint, event: bigint, qid: bigint>>"
)


def read_intervals(
    spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None, pids: list[int] | None = None, hour: int | None = None, longest: int | None = None, lookback: int = 0
) -> DataFrame:
    """Rows that overlap [lo, hi]; the conditions on ts, start and pid reach the Parquet scan.

    hour is the folder length that write_intervals was given: folders that close before lo are
    then not read, nor those that begin more than ``longest`` (the length of the longest row)
    after hi. lookback adds rows that closed up to so long before lo, for what carries over an edge.
    """
    d = spark.read.parquet(path)
    if lo is not None:
        d = d.filter(F.col("ts") >= lo - lookback)
        d = d.filter(F.col("hour") >= (lo - lookback) // hour) if hour else d
    if hi is not None:
        d = d.filter(F.col("start") <= hi)
        d = d.filter(F.col("hour") <= (hi + longest) // hour) if hour and longest is not None else d
    d = d.filter(F.col("pid").isin(pids)) if pids is not None else d
    return d.drop("hour") if hour else d


def read_dimension(spark: SparkSession, path: str, schema: str = BACKENDS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_scenario(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A hand-written case: one JSON document with backends, queries, events and samples."""
    doc = spark.read.schema(SCENARIO).option("multiLine", True).json(path)
    e = doc.select(F.posexplode("events").alias("seq", "e")).select("seq", "e.*")
    events = intervals(e, "seq", "ts", "dur", "pid", "old", "new", "qid", cpu=F.col("cpu"))
    samples = doc.select("sample_period_ns", F.posexplode("samples").alias("seq", "s")).select("sample_period_ns", "seq", "s.*")
    return {"backends": doc.select(F.explode("backends").alias("b")).select("b.*"), "queries": doc.select(F.explode("queries").alias("q")).select("q.*"), "events": events, "samples": samples}


def intervals(df: DataFrame, seq: str, ts: str, dur: str, pid: str, old: str, new: str, query_id: str, cpu: Column | None = None, capture: str = "main") -> DataFrame:
    """Canonical table from transitions (identified by the end of the state)."""
    none = F.lit(None)
    return df.select(
        F.lit(capture).alias("capture"), F.col(seq).cast("long").alias("seq"), F.col(ts).cast("long").alias("ts"), (F.col(ts) - F.col(dur)).cast("long").alias("start"),
        F.col(dur).cast("long").alias("dur"), F.col(pid).cast("long").alias("pid"), F.col(old).cast("long").alias("old_event"), F.col(new).cast("long").alias("new_event"),
        F.coalesce(F.col(query_id), F.lit(0)).cast("long").alias("query_id"), (none if cpu is None else cpu).cast("long").alias("cpu"), F.lit(False).alias("is_sample"), none.cast("string").alias("marker"),
    )


def possible(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine): a record longer than its own timestamp is refused, never repaired."""
    bad = F.col("dur") > F.col("ts")
    return df.filter(~bad), df.filter(bad)


def uniform_filter(df: DataFrame, wait_class: str | None = None, event: int | None = None, pid: int | None = None, query_id: int | None = None) -> DataFrame:
    """Conjunction of the given conditions (None: no condition, 0 is a value); drops markers and impossible rows."""
    d = df.filter(F.col("marker").isNull() & (F.col("dur") <= F.col("ts")))
    if wait_class is not None:
        d = d.filter(class_of(F.col("old_event")) == wait_class.lower())
    for name, value in (("old_event", event), ("pid", pid), ("query_id", query_id)):
        if value is not None:
            d = d.filter(F.col(name) == value)
    return d


def instants(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows counted in a window: exact ones that close in [lo, hi), samples up to hi, markers up to hi."""
    late = F.col("is_sample") | F.col("marker").isNotNull()
    return df.filter((F.col("ts") >= lo) & ((F.col("ts") < hi) | (late & (F.col("ts") == hi))))


def decode_samples(samples: DataFrame, first_weight: int, most: int = 60_000_000_000) -> DataFrame:
    """Gives each sample the stretch since the tick before it, of its capture (columns capture, ts,
    seq, pid, event, query_id). The first tick has the nominal weight; a stall is credited up to ``most``."""
    w = Window.partitionBy("capture").orderBy("ts")
    ticks = samples.select("capture", "ts").distinct().withColumn("dur", F.least(F.coalesce(F.col("ts") - F.lag("ts").over(w), F.lit(first_weight)), F.lit(most)).cast("long"))
    s = samples.join(ticks, ["capture", "ts"])
    return s.select(
        "capture", "seq", "ts", (F.col("ts") - F.col("dur")).alias("start"), "dur", "pid", F.col("event").alias("old_event"), F.col("event").alias("new_event"), "query_id",
        F.lit(None).cast("long").alias("cpu"), F.lit(True).alias("is_sample"), F.lit(None).cast("string").alias("marker"),
    )


def exact_wins(exact: DataFrame, samples: DataFrame, coverage: DataFrame, width: int) -> DataFrame:
    """Exact rows and what samples add outside exact coverage (capture, s, e).

    A sample's stretch is cut around the coverage. Only the piece that ends at the sample's own
    instant counts as an occurrence (counts); the others keep their time alone.
    """
    a = samples.withColumn("s", F.col("start")).withColumn("e", F.col("ts")).withColumn("t0", F.col("ts"))
    left = subtract_spans(a, coverage, ["capture"], ["seq", "t0"], width)
    left = left.withColumn("counts", F.col("e") == F.col("t0")).withColumn("start", F.col("s")).withColumn("ts", F.col("e")).withColumn("dur", F.col("e") - F.col("s"))
    cols = [*COLUMNS, "counts"]
    return exact.withColumn("counts", F.lit(True)).select(*cols).unionByName(left.select(*cols))


def to_wall(df: DataFrame, offsets: DataFrame) -> DataFrame:
    """Monotonic to wall time by the offset of each row's capture (offsets: capture, wall_offset).

    offsets has one row for each capture and is joined as the engine sees fit.
    """
    d = df.join(offsets, "capture")
    return d.withColumn("ts", F.col("ts") + F.col("wall_offset")).withColumn("start", F.col("start") + F.col("wall_offset")).drop("wall_offset")


def write_intervals(df: DataFrame, path: str, hour: int) -> None:
    """Sink by hour of the close; ``hour`` is its length in the table's units. start is stored for pruning."""
    df.withColumn("hour", F.floor(F.col("ts") / hour)).repartition("hour").sortWithinPartitions("ts").write.partitionBy("hour").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.json(path)
