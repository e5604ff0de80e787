from datetime import UTC, datetime

from pyspark.sql import functions as F

from dwell.functions import rules


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_classes_and_idleness(spark):
    ids = {"cpu": 0, "io": 0x0A000015, "lock": 0x03000000, "client": 0x06000000, "activity": 0x05000001, "unknown": 0x7F000000}
    assert one(spark, **{k: rules.class_of(F.lit(v)) for k, v in ids.items()}) == {k: k for k in ids}
    idle = {k: rules.is_idle(F.lit(v), pacing=(2,)) for k, v in {**ids, "paced": 0x09000002, "timer": 0x09000003}.items()}
    assert {k for k, v in one(spark, **idle).items() if v} == {"client", "activity", "paced"}


def test_latency_buckets(spark):
    values = {0: 0, 999: 0, 1000: 1, 1999: 1, 2000: 2, 16_383_999: 14, 16_384_000: 15, 10**12: 15}
    got = one(spark, **{f"v{k}": rules.latency_bucket(F.lit(k), 1000) for k in values})
    assert list(got.values()) == list(values.values())


def test_clip(spark):
    got = one(spark, inside=rules.clip(F.lit(2), F.lit(5), 0, 10), left=rules.clip(F.lit(2), F.lit(5), 4, 10), none=rules.clip(F.lit(2), F.lit(5), 5, 10), open=rules.clip(F.lit(2), F.lit(5), None, None))
    assert got == {"inside": 3, "left": 1, "none": 0, "open": 3}


def test_cpu_share_adds_up_and_rounds_half_up(spark):
    row = spark.createDataFrame([(5, 100, 7)], "cpu long, start long, dur long")
    parts = [rules.cpu_share(F.col("cpu"), F.col("start"), F.col("dur"), F.lit(100 + i), F.lit(101 + i)).alias(f"p{i}") for i in range(7)]
    got = list(row.select(*parts).first())
    assert sum(got) == 5 and got == [1, 0, 1, 1, 1, 0, 1]
    zero = spark.createDataFrame([(None, 0, 7), (4, 0, 0)], "cpu long, start long, dur long")
    assert [r[0] for r in zero.select(rules.cpu_share(F.col("cpu"), F.col("start"), F.col("dur"), F.lit(0), F.lit(7))).collect()] == [None, 0]


def test_parse_time():
    now = datetime(2024, 1, 2, tzinfo=UTC)
    assert rules.parse_time("2024-01-01") == 1704067200 * 10**6
    assert rules.parse_time("-1h", now) == rules.parse_time("now", now) - 3600 * 10**6


def test_cpu_share_is_not_rounded_up_just_below_a_whole(spark):
    dur = 10_000_000
    got = one(spark, below=rules.cpu_share(F.lit(4_999_999), F.lit(0), F.lit(dur), F.lit(0), F.lit(1)), at=rules.cpu_share(F.lit(5_000_000), F.lit(0), F.lit(dur), F.lit(0), F.lit(1)))
    assert got == {"below": 0, "at": 1}
