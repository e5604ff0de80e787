"""Interval tables that the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR
LO = 1_704_067_200_000_000
HI = LO + 30 * DAY
UNIT = 60_000_000
WIDTH = 6 * HOUR

#: The state and the marker that each event type of the table stands for.
STATES = {"view": 0, "click": 0x0A000015, "error": 0x03000000, "purchase": 0x01000049, "signup": 0x06000000}
MARKERS = {"click": "EXEC_START", "purchase": "EXEC_END", "signup": "CMD_START", "error": "CMD_END"}
BACKENDS = {"BUILDING": "client", "AUTOMOBILE": "parallel_worker", "MACHINERY": "io_worker", "HOUSEHOLD": "autovac_worker", "FURNITURE": "walwriter"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(name: str):
    """Files hold timestamps without a zone; they are taken as UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({name} as timestamp_ntz))")


def mapped(column, values: dict):
    out = F.when(F.lit(False), F.lit(next(iter(values.values()))))
    for k, v in values.items():
        out = out.when(F.col(column) == k, v)
    return out


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as states that last from one event to the next."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("us"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = e.withColumn("start", F.lag("us").over(w)).withColumn("old", F.lag("event_type").over(w)).filter("start is not null")
    dur = F.col("us") - F.col("start")
    return e.select(
        F.lit("main").alias("capture"), (2 * F.col("event_id")).alias("seq"), F.col("us").alias("ts"), "start", dur.alias("dur"), F.col("user_id").alias("pid"),
        mapped("old", STATES).cast("long").alias("old_event"), mapped("event_type", STATES).cast("long").alias("new_event"), F.col("k").alias("query_id"),
        F.when(mapped("old", STATES) == 0, F.floor(dur * F.col("value") / 500)).cast("long").alias("cpu"), F.lit(False).alias("is_sample"), F.lit(None).cast("string").alias("marker"),
    )


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin(*MARKERS))
    us, none = micros("ts"), F.lit(None).cast("long")
    return e.select(
        F.lit("main").alias("capture"), (2 * F.col("event_id") + 1).alias("seq"), us.alias("ts"), us.alias("start"), F.lit(0).cast("long").alias("dur"), F.col("user_id").alias("pid"),
        F.lit(0).cast("long").alias("old_event"), F.lit(0).cast("long").alias("new_event"), F.get_json_object("props", "$.k").cast("long").alias("query_id"), none.alias("cpu"),
        F.lit(False).alias("is_sample"), mapped("event_type", MARKERS).alias("marker"),
    )


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves(spark, sf_dir).unionByName(markers(spark, sf_dir))


def backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("pid"), mapped("c_mktsegment", BACKENDS).alias("type"), F.col("c_name").alias("user"), F.col("c_nationkey").cast("string").alias("db"))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dwell.operators.annotate import tag_backend

    return tag_backend(moves(spark, sf_dir), backends(spark, sf_dir))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as spans of one capture, an hour late: exact coverage for the tests of fidelity."""
    m = moves(spark, sf_dir).filter(F.col("old_event") == STATES["purchase"])
    return m.select(F.col("pid").cast("string").alias("capture"), (F.col("start") + HOUR).alias("s"), (F.col("ts") + HOUR).alias("e"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window per order, by its customer: half a day in the month of the events."""
    o = table(spark, sf_dir, "orders")
    lo = LO + (F.col("o_orderkey") * 7919 % (30 * 24)) * HOUR
    return o.select(F.col("o_custkey").cast("string").alias("capture"), F.col("o_orderkey").alias("window_id"), lo.alias("lo"), (lo + 12 * HOUR).alias("hi"))
