from pyspark.sql import functions as F

from dwell.operators import anomaly
from dwell.streaming import live

SCHEMA = "seq long, pid long, old_event long, new_event long, dur long, marker string, at timestamp"


def stream(spark, tmp_path, rows, schema=SCHEMA):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).select(*[F.col(c) for c in spark.createDataFrame([], schema).columns]).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def rows(spark):
    t = [spark.sql(f"select timestamp'2024-01-01 00:00:{s:02d}'").first()[0] for s in (1, 2, 2, 50)]
    return [(1, 7, 0, 0x0A000001, 5, None, t[0]), (2, 7, 0x0A000001, 0, 6, None, t[1]), (3, 8, 0, 0x06000000, 7, None, t[2]), (4, 8, 0x06000000, 0, 9, None, t[3])]


def test_live_rollup_closes_windows(spark, tmp_path):
    got = run(live.live_rollup(stream(spark, tmp_path, rows(spark)), "10 seconds", "5 seconds"), "rolled", "update")
    assert {(r["old_event"], r["n"], r["time"]) for r in got} == {(0, 2, 12), (0x0A000001, 1, 6), (0x06000000, 1, 9)}


def test_active_states(spark, tmp_path):
    got = run(live.active_stream(stream(spark, tmp_path, rows(spark))), "active", "update")
    assert {(r["pid"], r["state"], r["db_time"]) for r in got} == {(7, "on_cpu", 11), (8, "on_cpu", 7)}


def test_stream_anomalies_equal_batch(spark, tmp_path):
    schema = "capture string, tick double, aas double, lock_fraction double, cpu_aas double, capacity double"
    ticks = [("c", float(t), 1.0 if t < 8 else 9.0, 0.0, 0.0, None) for t in range(14)]
    got = run(anomaly.stream_anomalies(stream(spark, tmp_path, ticks, schema)), "anomalies", "append")
    want = anomaly.anomalies(spark.createDataFrame(ticks, schema)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and "FIRE" in {r["action"] for r in got}


def test_duplicates_and_late_rows(spark, tmp_path):
    schema = "file string, block long, record long, at timestamp"
    t = spark.sql("select timestamp'2024-01-01 00:00:00'").first()[0]
    got = run(live.once(stream(spark, tmp_path, [("f", 1, 1, t), ("f", 1, 1, t), ("f", 1, 2, t)], schema), "10 seconds"), "once", "append")
    assert len(got) == 2
    sink = live.late_rows_sink(str(tmp_path / "late"), F.col("record") > 1)
    sink(spark.createDataFrame([("f", 1, 1, t), ("f", 1, 2, t)], schema), 3)
    assert [r["batch"] for r in spark.read.parquet(str(tmp_path / "late")).collect()] == [3]
