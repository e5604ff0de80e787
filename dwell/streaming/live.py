"""Streaming forms: rollup, live states, sampler ticks, duplicates and late rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.functions.rules import is_idle, is_session_idle

ACTIVE = "pid long, ts timestamp, state string, event long, db_time long"


def live_rollup(stream: DataFrame, window: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Closes and time per window of the close and state; at is the close as a timestamp."""
    d = stream.withWatermark("at", late).filter("marker is null")
    return d.groupBy(F.window("at", window).alias("w"), "old_event").agg(F.count("*").alias("n"), F.sum("dur").alias("time")).select(F.col("w.start").alias("w_start"), "old_event", "n", "time")


def trailing_windows(stream: DataFrame, length: str, slide: str, late: str) -> DataFrame:
    d = stream.withWatermark("at", late).filter("marker is null")
    return d.groupBy(F.window("at", length, slide).alias("w"), "old_event").agg(F.sum("dur").alias("time")).select(F.col("w.end").alias("w_end"), "old_event", "time")


def active_batch(df: DataFrame) -> DataFrame:
    """Per actor its latest state and its time under load so far."""
    d = df.filter("marker is null")
    load = F.when(~is_idle(F.col("old_event")), F.col("dur")).otherwise(0)
    g = d.groupBy("pid").agg(F.max_by(F.struct("ts", "new_event"), F.struct("ts", "seq")).alias("l"), F.sum(load).alias("db_time"))
    e = F.col("l.new_event")
    return g.select("pid", F.col("l.ts").alias("since"), F.when(e == 0, "on_cpu").when(is_session_idle(e), "idle").otherwise("waiting").alias("state"), e.alias("event"), "db_time")


def active_stream(stream: DataFrame) -> DataFrame:
    """Live form: a row for each actor whenever it moves (columns pid, seq, at, old_event, new_event, dur)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        total = store.get[0] if store.exists else 0
        last = None
        for p in parts:
            idle = (p["old_event"] // (1 << 24) == 0x05) | (p["old_event"] == 0x06000000)
            total += int(p.loc[~idle, "dur"].sum())
            top = p.sort_values(["at", "seq"]).iloc[-1]
            last = top if last is None or (top["at"], top["seq"]) > (last["at"], last["seq"]) else last
        store.update((total,))
        if last is not None:
            e = int(last["new_event"])
            state = "on_cpu" if e == 0 else "idle" if e >> 24 == 0x05 or e == 0x06000000 else "waiting"
            yield pd.DataFrame([(int(key[0]), last["at"], state, e, total)], columns=["pid", "ts", "state", "event", "db_time"])

    return stream.select("pid", "seq", "at", "old_event", "new_event", "dur").groupBy("pid").applyInPandasWithState(run, ACTIVE, "total long", "update", "NoTimeout")


def once(stream: DataFrame, late: str, key: tuple[str, ...] = ("file", "block", "record")) -> DataFrame:
    """Drops rows of the same physical position, and only those."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(list(key))


def late_rows_sink(path: str, is_late) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows for which ``is_late`` holds go to a table of their own, with the batch."""

    def run(batch: DataFrame, number: int) -> None:
        batch.filter(is_late).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return run
