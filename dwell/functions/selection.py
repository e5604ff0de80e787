"""Values at given places of sorted groups, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwell.functions.settled import settled

BITS = 16


def nth_values(df: DataFrame, keys: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """keys, which and value: the value at place ``rank`` (from 0) of each group's sorted values.

    value holds longs from 0; ranks: keys, which (its name), rank. Values are counted first, so
    that equal ones are one row. Then the range in which each place lies is narrowed by 16 bits
    a pass: counts by the next bits of the values in it, and running sums over these at most 65,536 counts. No
    group is sorted or met by one task. Groups without that many values have no row.
    """
    counted = settled(df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n")))
    most = counted.agg(F.max("_v")).first()[0] or 0
    state = ranks.select(*keys, "which", F.lit(0).cast("long").alias("_at"), F.col("rank").cast("long").alias("_rank"))
    for shift in reversed(range(0, max(1, most.bit_length()), BITS)):
        d = counted.select(*keys, F.shiftright("_v", shift + BITS).alias("_at") if shift + BITS < 63 else F.lit(0).cast("long").alias("_at"), F.shiftright("_v", shift).alias("_bin"), "_n")
        d = d.join(state.select(*keys, "_at").distinct(), [*keys, "_at"], "left_semi").groupBy(*keys, "_at", "_bin").agg(F.sum("_n").alias("_n"))
        d = d.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys, "_at").orderBy("_bin")))
        j = state.join(d, [*keys, "_at"]).filter("_rank < _upto and _rank >= _upto - _n")
        state = settled(j.select(*keys, "which", F.col("_bin").alias("_at"), (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank")))
    return state.select(*keys, "which", F.col("_at").alias("value"))
