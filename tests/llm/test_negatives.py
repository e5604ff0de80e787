"""Hard negatives against brute force, and the bounds that decide which rows get a score."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwell.llm import negatives
from dwell.llm.negatives import Coded, encode, exact, hard_negatives, interval

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v int, rank int, part string, key int"


def brute(rows, positives=5, count=10):
    ok = {}
    for i, e, l, *_ in rows:  # noqa: E741
        if None not in (i, e, l) and len(e) and all(x is not None and math.isfinite(x) for x in e):
            v = (l, [math.floor(256 * x) for x in e])
            ok[i] = min(ok.get(i, v), v)
    width = max(sorted({len(v) for _, v in ok.values()}), key=lambda n: (sum(len(v) == n for _, v in ok.values()), n), default=0)
    ok = {i: r for i, r in ok.items() if len(r[1]) == width}
    out = set()
    for a in (i for i in ok if i % 10 == 0):
        score = {i: sum(x * y for x, y in zip(ok[a][1], v, strict=True)) for i, (_, v) in ok.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if ok[i][0] == ok[a][0]][:positives]:
            fit = [i for i in order if ok[i][0] != ok[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out |= {(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[:count])}
    return out


def table(width, n=400, seed=1):
    rng, rnd = np.random.default_rng(seed), random.Random(seed)
    centres = rng.standard_normal((6, width)) / math.sqrt(width)
    rows = []
    for i in range(n):
        e = (centres[rnd.randrange(6)] + 0.4 * rng.standard_normal(width) / math.sqrt(width)).tolist()
        rows.append((i, e, 1 if i % 3 == 0 else rnd.randrange(5)))
    rows += [(n + k, rows[10][1], k % 3) for k in range(60)]  # copies of an anchor: ties
    rows += [(20, rows[1][1], 4), (20, rows[2][1], 0), (900, None, 1), (901, [], 1), (902, [1.0, None] * (width // 2), 1), (903, [float("nan")] * width, 1), (904, [float("inf")] * width, 2)]
    rows += [(905, rows[3][1], None), (None, rows[3][1], 1), (910, [0.0] * width, 2), (920, [1.0] * (width + 1), 1), (930, [-x for x in rows[30][1]], 1)]
    return [(*r, "id", 1, 2, "p", 3) for r in rows]


@pytest.mark.parametrize(("width", "block"), [(64, 4096), (64, 37), (6, 50), (130, 60)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, width, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    rows = table(width)
    got = [tuple(r) for r in hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 10 == 0).collect()]
    want = brute(rows)
    assert len(got) == len(want) > 400 and set(got) == want


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0], 1, "", 1, 1, "", 1), (1, [0.9, 0.1], 1, "", 1, 1, "", 1), (2, [0.5, 0.5], 2, "", 1, 1, "", 1)]
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert {tuple(r) for r in got.collect()} == brute(rows) and len(brute(rows)) == 1
    assert hard_negatives(spark.createDataFrame(rows[:0], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0


def coded(v):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(v)), pa.int64()), pa.array([0] * len(v), pa.int64()), pa.array(v.tolist(), pa.list_(pa.float64()))], ["id", "label", "v"])
    return Coded.read(pa.Table.from_batches(list(encode(iter([batch])))))


@pytest.mark.parametrize("width", [1, 5, 64, 200])
def test_bounds_hold_the_scores(width):
    rng = np.random.default_rng(width)
    v = np.floor(256 * np.vstack([rng.standard_normal((80, width)), np.eye(width)[:1] * 3, np.zeros((1, width)), -np.ones((1, width))]))
    c = coded(v)
    low, high = interval(c, c)
    score = v @ v.T
    assert (low <= score).all() and (score <= high).all() and (exact(c, c) == score.astype(int)).all()


def test_bounds_leave_out_what_is_far():
    """With many dimensions and groups that lie apart, most rows of other groups need no score."""
    rng = np.random.default_rng(0)
    centres = np.eye(8).repeat(64, axis=1)
    v = np.floor(256 * (centres[np.arange(400) % 8] + 0.01 * rng.standard_normal((400, 512))))
    c = coded(v)
    low, high = interval(c, c)
    same = (np.arange(400) % 8)[:, None] == (np.arange(400) % 8)[None, :]
    assert (low[same].min() > 0) and (high[~same] < np.median((v @ v.T)[same])).mean() > 0.9


def test_scores_beyond_doubles_stay_exact():
    c = coded(np.array([[2.0**40 + 1, 3.0], [2.0**40, 1.0]]))
    assert exact(c, c)[0].tolist() == [(1 << 63) - 1] * 2  # clipped
    c = coded(np.array([[2.0**29 + 1, 1.0], [2.0**29 + 3, 1.0]]))
    assert exact(c, c)[0].tolist() == [(2**29 + 1) ** 2 + 1, (2**29 + 1) * (2**29 + 3) + 1]
