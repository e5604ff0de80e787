import random

import pytest
from pyspark.sql import functions as F

from dwell.functions.intervals import carried, coalesce_spans, distinct_ahead, greedy_onsets, overlap_candidates, overlap_join, pair_lifo, split_to_buckets, state_ranges, subtract_spans
from dwell.operators import coverage


def test_overlap_join_gives_each_pair_once(spark):
    rnd = random.Random(1)
    rows = [[(i, rnd.randint(0, 1), s, s + rnd.choice([0, 1, 5, 40, 900, 20_000])) for i, s in enumerate(rnd.sample(range(20_000), 150))] for _ in range(2)]
    a = spark.createDataFrame(rows[0], "i int, k int, a_start long, a_end long")
    b = spark.createDataFrame(rows[1], "j int, k int, b_start long, b_end long")
    got = sorted(map(tuple, overlap_join(a, b, ["k"], 10, most=4).select("i", "j").collect()))
    want = sorted((x[0], y[0]) for x in rows[0] for y in rows[1] if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert got == want


def test_narrow_rows_meet_in_narrow_bins_alone(spark):
    """Rows of about one bin: what is tested grows with the rows that share a bin, not with all pairs."""
    rows = [(i, 0, 10 * i, 10 * i + 9) for i in range(2000)]
    a = spark.createDataFrame(rows, "i int, k int, a_start long, a_end long")
    b = spark.createDataFrame(rows + [(-1, 0, 0, 20_000)], "j int, k int, b_start long, b_end long")
    assert overlap_candidates(a, b.filter("j >= 0"), ["k"], 10).count() <= 2000
    # One wide row meets every narrow one once, and makes no narrow ones meet.
    assert overlap_candidates(a, b, ["k"], 10).count() <= 4500
    assert overlap_join(a, b, ["k"], 10).count() == 4000


def test_chunks_carry_over(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), t, rnd.randint(0, 9)) for t in rnd.sample(range(500), 120)]
    d = spark.createDataFrame(rows, "k string, t long, v long")
    one = sorted(map(tuple, carried(d, ["k"], "t", ["t"], None, {"n": "v"}, {"m": "v"}).collect()), key=str)
    assert sorted(map(tuple, carried(d, ["k"], "t", ["t"], 40, {"n": "v"}, {"m": "v"}).select("k", "t", "v", "n", "m").collect()), key=str) == one
    spans = spark.createDataFrame([(rnd.choice("ab"), s, s + rnd.choice([0, 1, 9, 200])) for s in rnd.sample(range(2000), 150)], "k string, s long, e long")
    want = sorted(map(tuple, coalesce_spans(spans, ["k"]).collect()))
    assert sorted(map(tuple, coalesce_spans(spans, ["k"], chunk=50).collect())) == want
    whole = spark.createDataFrame([("a", 1, 0, 2500), ("b", 2, 700, 701)], "k string, id int, s long, e long")
    left = subtract_spans(whole, spans, ["k"], ["id"], 30)
    cut = subtract_spans(whole, spans, ["k"], ["id"], 30, chunk=64)
    assert sorted(map(tuple, coalesce_spans(cut.select("k", "s", "e"), ["k"]).collect())) == sorted(map(tuple, left.select("k", "s", "e").collect()))


def test_spans(spark):
    d = spark.createDataFrame([("a", 0, 5), ("a", 5, 8), ("a", 2, 3), ("a", 10, 12), ("a", 12, 12), ("b", 1, 2)], "k string, s long, e long")
    assert sorted(map(tuple, coalesce_spans(d, ["k"]).collect())) == [("a", 0, 8), ("a", 10, 12), ("b", 1, 2)]
    whole = spark.createDataFrame([("a", 1, -5, 11), ("b", 2, 0, 1), ("c", 3, 0, 4), ("a", 4, 2, 7)], "k string, id int, s long, e long")
    got = sorted(map(tuple, subtract_spans(whole, d, ["k"], ["id"], 3).select("id", "s", "e").collect()))
    assert got == [(1, -5, 0), (1, 8, 10), (2, 0, 1), (3, 0, 4)]
    r = state_ranges([("x", d.filter("k = 'a'").select("s", "e")), ("y", d.filter("k = 'b'").select("s", "e"))], 0, 20)
    assert [tuple(x) for x in r.orderBy("s").collect()] == [(0, 1, True, False), (1, 2, True, True), (2, 8, True, False), (8, 10, False, False), (10, 12, True, False), (12, 20, False, False)]


def test_split_to_buckets(spark):
    d = spark.createDataFrame([(1, -5, 3), (2, 8, 25), (3, 30, 30), (4, 29, 99)], "i int, start long, ts long")
    got = sorted(map(tuple, split_to_buckets(d, 0, 30, 10).select("i", "bucket", "b_lo", "b_hi").collect()))
    assert got == [(1, 0, 0, 3), (2, 0, 8, 10), (2, 1, 10, 20), (2, 2, 20, 25), (4, 2, 29, 30)]


def stack(rows):
    out, open_ = {}, []
    for seq, m in rows:
        if m == "S":
            open_.append(seq)
        elif m == "E" and open_:
            out[open_.pop()] = (seq, "end")
        elif m == "R":
            out.update({s: (seq, "reset") for s in open_})
            open_ = []
    out.update({s: (None, None) for s in open_})
    return out


def test_pair_lifo_is_a_stack(spark):
    rnd = random.Random(2)
    rows = [(k, i, rnd.choice("SSEER")) for k in range(20) for i in range(40)]
    d = spark.createDataFrame(rows, "k int, seq int, m string")
    got = pair_lifo(d, ["k"], ["seq"], F.col("m") == "S", F.col("m") == "E", F.col("m") == "R").filter("kind = 'start'")
    got = {(r["k"], r["seq"]): (r["c_seq"], r["closed_by"]) for r in got.collect()}
    want = {(k, s): v for k in range(20) for s, v in stack([(i, m) for kk, i, m in rows if kk == k]).items()}
    assert got == want


def test_greedy_onsets(spark):
    rows = [("e", t, p) for t, p in [(0, 1), (1, 2), (2, 3), (3, 4), (50, 1), (51, 1), (52, 1), (100, 1), (104, 2), (105, 3)]]
    got = greedy_onsets(spark.createDataFrame(rows, "k string, t long, p long"), ["k"], "t", "p", 5, 3)
    assert sorted(map(tuple, got.collect())) == [("e", 0, 4), ("e", 100, 3)]


def plain_onsets(rows, width, least):
    out = set()
    for k in {r[0] for r in rows}:
        at = {t: len({p for q, u, p in rows if q == k and t <= u <= t + width}) for q, t, _ in rows if q == k}
        until = None
        for t in sorted(at):
            if at[t] >= least and (until is None or t > until):
                out.add((k, t, at[t]))
                until = t + width
    return out


@pytest.mark.parametrize(("width", "least", "chunk", "spread"), [(5, 3, None, 2000), (5, 3, 8, 2000), (7, 2, 20, 300), (30, 6, 40, 2500), (0, 1, 1, 60)])
def test_onsets_equal_a_plain_pass(spark, width, least, chunk, spread):
    """Long stretches without a break, several states, actors that enter twice at one moment."""
    rnd = random.Random(width)
    rows = [(rnd.choice(["e", "f"]), rnd.randrange(spread) + (10_000 if i % 4 == 0 else 0), rnd.randrange(9)) for i in range(700)] + [("g", 1, 1)] + [("h", 3, p) for p in range(6)]
    df = spark.createDataFrame(rows, "k string, t long, p long")
    got = [tuple(r) for r in greedy_onsets(df, ["k"], "t", "p", width, least, chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_onsets(rows, width, least) and len(got) > 3
    ahead = {(r["k"], r["t"]): r["actors"] for r in distinct_ahead(df, ["k"], "t", "p", width, chunk).collect()}
    assert ahead == {(k, t): len({p for q, u, p in rows if q == k and t <= u <= t + width}) for k, t, _ in rows}


def test_no_onsets_without_rows(spark):
    assert greedy_onsets(spark.createDataFrame([], "k string, t long, p long"), ["k"], "t", "p", 5, 3).count() == 0


def test_merging_does_not_multiply_the_plan(spark):
    spans = spark.createDataFrame([(0, 0, 4), (0, 3, 6), (0, 6, 9), (0, 12, 14), (0, 40, 41), (0, 13, 13)], "k int, s long, e long")
    once = lambda d: d._jdf.queryExecution().analyzed().collectLeaves().size()
    merged = coalesce_spans(spans, ["k"], chunk=5)
    again = coalesce_spans(coalesce_spans(merged, ["k"], chunk=5), ["k"], chunk=5)
    assert sorted(tuple(r) for r in again.collect()) == [(0, 0, 9), (0, 12, 14), (0, 40, 41)]
    assert once(again) == once(merged) <= 2
    other = spans.select(F.col("s") + 8, F.col("e") + 10).toDF("s", "e")
    ranges = coverage.fidelity_ranges(spans, other, 0, 60, 1, 5)
    assert sorted((r["s"], r["e"], r["kind"]) for r in ranges.collect()) == [(0, 9, "exact"), (9, 12, "sampled"), (12, 14, "exact"), (14, 19, "sampled"), (19, 20, "none"), (20, 24, "sampled"), (24, 40, "none"), (40, 41, "exact"), (41, 48, "none"), (48, 51, "sampled"), (51, 60, "none")]
    assert once(ranges) < 20
