import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwell.functions import pair_times
from dwell.functions.rules import EXIT
from dwell.functions.selection import nth_values
from dwell.operators import aggregates, annotate, anomaly, compare, coverage, rollup, sequences, texts
from dwell.sources import intervals as src

S = 1_000_000_000
CPU, IO, LOCK, LW, READ = 0, 0x0A000001, 0x03000000, 0x01000001, 0x06000000
SCHEMA = "capture string, seq long, ts long, start long, dur long, pid long, old_event long, new_event long, query_id long, cpu long, is_sample boolean, marker string"


def rows(spark, *items):
    """(pid, ts, dur, old, new, query) or (pid, ts, marker) tuples, in their order."""
    out = []
    for i, x in enumerate(items):
        pid, ts, rest = x[0], x[1], x[2:]
        if isinstance(rest[0], str):
            out.append(("main", i, ts, ts, 0, pid, 0, 0, rest[1] if len(rest) > 1 else 0, None, False, rest[0]))
        else:
            dur, old, new, q = (*rest, CPU, 0)[:4] if len(rest) < 4 else rest
            out.append(("main", i, ts, ts - dur, dur, pid, old, new, q, None, False, None))
    return spark.createDataFrame(out, SCHEMA)


def backed(d, kind="foreground"):
    return d.withColumn("backend", F.lit(kind))


def test_four_busy_actors_make_four(spark):
    d = backed(rows(spark, *[(p, 5 * S, 5 * S, e) for p, e in enumerate([CPU, IO, LOCK, LW])]))
    one = aggregates.aas(d, 0, 5 * S, 1).first()
    assert (one["total"], one["cpu"], one["io"], one["lock"], one["lwlock"]) == (4.0, 1.0, 1.0, 1.0, 1.0)
    assert aggregates.aas(backed(d, "io_worker"), 0, 5 * S, 1).first()["total"] == 0
    assert [r["total"] for r in aggregates.aas(d, 0, 10 * S, 2).orderBy("bucket").collect()] == [4.0, 0.0]


def test_time_model_splits_load_and_idle(spark):
    d = rows(spark, (1, 4 * S, 4 * S, IO), (1, 10 * S, 6 * S, READ), (2, 3 * S, 3 * S, CPU))
    t = {(r["parent"], r["label"]): (r["time"], r["pct"]) for r in aggregates.time_model(d, 0, 10 * S).collect()}
    assert t["", "DB Time"] == (7 * S, 100.0) and t["", "Idle"] == (6 * S, None) and t["Idle", str(READ)][0] == 6 * S and t["io", str(IO)] == (4 * S, pytest.approx(400 / 7))


def measured(d):
    """Rows on CPU ran for a quarter of their time, those of actor 3 for an unknown part."""
    return d.withColumn("cpu", F.when((F.col("old_event") == 0) & (F.col("pid") != 3), (F.col("dur") / 4).cast("long")))


def test_measured_cpu_leaves_time_off_cpu(spark):
    d = measured(rows(spark, (1, 8, 8, CPU), (2, 8, 8, IO), (3, 8, 8, CPU)))
    t = {r["label"]: r["time"] for r in aggregates.time_model(d, 0, 8).collect()}
    assert t == {"DB Time": 24, "CPU (running)": 10, "CPU (waiting for a core)": 6, "io": 8, str(IO): 8}
    plain = {r["label"]: r["time"] for r in aggregates.time_model(d.filter("pid = 3"), 0, 8).collect()}
    assert plain == {"DB Time": 8, "CPU*": 8}
    # All of it waited for a core: the running row stays, with nothing.
    none = {r["label"]: r["time"] for r in aggregates.time_model(d.filter("pid = 1").withColumn("cpu", F.lit(0).cast("long")), 0, 8).collect()}
    assert none == {"DB Time": 8, "CPU (running)": 0, "CPU (waiting for a core)": 8}
    b = [(r["cpu"], r["off_cpu"], r["io"], r["total"]) for r in aggregates.aas(backed(d), 0, 8, 2).orderBy("bucket").collect()]
    assert b == [(1.25, 0.75, 1.0, 3.0)] * 2
    e = {r["old_event"]: (r["time"], r["pct"]) for r in aggregates.top_events(d, 0, 8, 1).collect()}
    assert e == {CPU: (10, pytest.approx(1000 / 24)), IO: (8, pytest.approx(800 / 24))}
    s = {r["pid"]: (r["cpu_pct"], r["wait_pct"], r["off_cpu"], r["top_wait"]) for r in aggregates.top_sessions(d, 0, 8).collect()}
    assert s == {1: (25.0, 0.0, 6, None), 2: (0.0, 100.0, 0, IO), 3: (100.0, 0.0, 0, None)}
    assert compare.additivity(d, [0, 1, 3, 8], 1).count() == 0


def test_io_workers_are_no_load(spark):
    d = rows(spark, (1, 8, 8, CPU), (2, 8, 8, IO)).withColumn("backend", F.when(F.col("pid") == 2, "io_worker").otherwise("foreground"))
    assert {r["label"] for r in aggregates.time_model(d, 0, 8).collect()} == {"DB Time", "CPU*"}
    assert aggregates.heatmap(d, 0, 9, 1, 1).agg(F.sum("n")).first()[0] == 1


def test_query_totals(spark):
    d = rows(spark, (1, 0, "CMD_START"), (1, 2, 2, IO, CPU, 0), (1, 4, 2, IO, CPU, 9), (2, 5, 5, LOCK, CPU, 0))
    t = aggregates.query_totals(annotate.attribute_queries(backed(d)), 0, 100).first()
    assert tuple(t) == (4, 2, 5, 1)


def test_window_edges(spark):
    d = rows(spark, (1, 10, 5, IO), (1, 20, 10, IO), (1, 30, 10, LOCK))
    e = {r["old_event"]: r for r in aggregates.top_events(d, 10, 30, 1).collect()}
    assert (e[IO]["n"], e[IO]["time"]) == (2, 10) and (e[LOCK]["n"], e[LOCK]["time"]) == (0, 10)
    assert compare.additivity(d, [0, 7, 15, 21, 31], 1).count() == 0
    assert [r["seq"] for r in src.instants(d, 10, 30).orderBy("seq").collect()] == [0, 1]


def test_impossible_rows_are_refused(spark):
    d = rows(spark, (1, 10, 20, IO), (1, 10, 10, IO))
    good, bad = src.possible(d)
    assert (good.count(), bad.count()) == (1, 1)
    assert src.uniform_filter(d, event=IO).count() == 1 and src.uniform_filter(d, event=0).count() == 0


def test_samples_fill_only_what_is_uncovered(spark):
    s = spark.createDataFrame([("c", 1, 10, 7, IO, 0), ("c", 2, 20, 7, IO, 0), ("c", 3, 50, 7, IO, 0)], "capture string, seq long, ts long, pid long, event long, query_id long")
    w = src.decode_samples(s, 10, 25)
    assert [(r["ts"], r["dur"]) for r in w.orderBy("ts").collect()] == [(10, 10), (20, 10), (50, 25)]
    cover = spark.createDataFrame([("c", 12, 15), ("c", 20, 60)], "capture string, s long, e long")
    m = src.exact_wins(w.limit(0), w, cover, 10)
    assert sorted((r["start"], r["ts"], r["counts"]) for r in m.collect()) == [(0, 10, True), (10, 12, False), (15, 20, True)]


def test_phases_and_commands(spark):
    d = rows(spark, (1, 0, "CMD_START"), (1, 1, "EXEC_START"), (1, 5, 4, IO), (1, 6, "EXEC_END"), (1, 8, 2, CPU), (1, 9, "CMD_END"), (1, 20, 11, CPU), (2, 20, 20, CPU))
    t = annotate.tag_in_command(annotate.tag_phase(backed(d)), 100, 10)
    got = {r["seq"]: (r["in_exec"], r["in_command"]) for r in t.filter("marker is null").collect()}
    assert got == {2: (True, True), 4: (False, True), 6: (False, False), 7: (False, None)}
    ids = {r["seq"]: r["old_event"] for r in annotate.relabel_cpu(t).filter("marker is null").collect()}
    assert ids[6] not in (CPU,) and ids[4] == CPU and ids[7] == CPU


def test_query_attribution(spark):
    d = rows(spark, (1, 0, "CMD_START"), (1, 2, 2, IO, CPU, 0), (1, 4, 2, IO, CPU, 9), (1, 6, 2, LOCK, CPU, 0), (1, 8, 2, READ, CPU, 0), (1, 9, 1, IO, CPU, 0), (1, 10, "CMD_START"), (1, 11, 1, IO, CPU, 0), (1, 12, 1, IO, EXIT, 0))
    got = {r["seq"]: (r["attributed_id"], r["attribution"]) for r in annotate.attribute_queries(backed(d)).collect()}
    assert got == {1: (9, "later"), 2: (9, "own"), 3: (9, "earlier"), 4: (0, "none"), 5: (0, "none"), 7: (0, "none"), 8: (0, "none")}
    other = {r["attribution"] for r in annotate.attribute_queries(backed(d, "background")).collect()}
    assert other == {"own", "none"}


def test_transitions_and_nodes(spark):
    d = rows(spark, (1, 5, 5, IO, LOCK), (1, 9, 4, LOCK, CPU), (1, 12, 3, CPU, IO), (1, 14, 2, IO, EXIT))
    assert sorted(map(tuple, sequences.transitions(d, 0, 99).collect())) == sorted([(IO, LOCK, 1, 5), (LOCK, CPU, 1, 4), (CPU, IO, 1, 3)])
    n = {r["event"]: (r["n"], r["entered"]) for r in sequences.transition_nodes(d, 0, 99).collect()}
    assert n == {IO: (1, 1), LOCK: (1, 1), CPU: (1, 1)}


def test_executions_and_plans(spark):
    d = rows(spark, (1, 1, "PLAN_START", 7), (1, 3, "PLAN_END", 7), (1, 4, "EXEC_START", 7), (1, 5, 1, IO, CPU, 7), (1, 6, "EXEC_START", 8), (1, 9, 4, IO, CPU, 8), (1, 10, "CMD_END"), (1, 12, "EXEC_START", 9))
    got = {r["e_seq"]: (r["e_end"], r["end_inferred"], r["plan_dur"], r["n_events"]) for r in sequences.executions(d, 0, 99, 10).collect()}
    assert got == {2: (10, True, 2, 2), 4: (10, True, None, 1), 7: (None, False, None, 0)}


def test_loops_fold():
    assert sequences.collapse_loops([1, 2, 1, 2, 1, 2, 3])[:2] == ([1, 2, 3], 7 / 3)
    assert sequences.collapse_loops([5, 5, 5])[:2] == ([5], 3.0)
    assert sequences.collapse_loops([])[:2] == ([], 0.0)


def test_variants(spark):
    items = []
    for k in range(3):
        t = 100 * k
        items += [(1, t, "EXEC_START", 7), (1, t + 10, 10, IO, LW), (1, t + 20, 10, LW, IO), (1, t + 30, 10, IO, LW), (1, t + 40, 10, LW, CPU), (1, t + 40, "EXEC_END", 7)]
    got = sequences.variants(rows(spark, *items), "EXEC", 10).collect()
    assert [(r["pattern"], r["n"], r["queries"], r["loop_factor"], r["p95"], r["step_avg"]) for r in got] == [(f"{IO}>{LW}", 3, 1, 2.0, 40, [10.0, 10.0])]
    assert sequences.collapse_loops([1, 2, 2, 1, 2, 3]) == ([1, 2, 3], 2.0, [0, 1, 1, 0, 1, 2])


def test_values_at_places_of_large_groups(spark):
    rnd = random.Random(6)
    values = {"a": [rnd.randrange(1 << 40) for _ in range(800)], "b": [7] * 50 + [8], "c": [0], "d": [rnd.randrange(3) + (1 << 33) for _ in range(100)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v long")
    ranks = [(k, w, r) for k, vs in values.items() for w, r in (("low", 0), ("mid", len(vs) // 2), ("top", len(vs) - 1), ("beyond", len(vs)))]
    got = {(r["k"], r["which"]): r["value"] for r in nth_values(df, ["k"], "v", spark.createDataFrame(ranks, "k string, which string, rank long")).collect()}
    assert got == {(k, w): sorted(values[k])[r] for k, w, r in ranks if r < len(values[k])}


def test_concurrency_bursts_and_blockers(spark):
    d = rows(spark, (1, 20, 15, LOCK), (2, 20, 12, LOCK), (3, 18, 18, CPU), (4, 20, 4, CPU))
    assert [tuple(r) for r in sequences.concurrency(d, 0, 20, 2).orderBy("bucket").collect()] == [(0, 2, LOCK), (1, 2, LOCK)]
    chain = {r["waiter"]: (r["holder"], r["overlap"]) for r in sequences.lock_chains(d, 7).collect()}
    assert chain == {1: (3, 13), 2: (3, 10)}
    assert [tuple(r) for r in sequences.interference(d, 7).collect()] == [(1, 2, 12, 1.0, LOCK)]


def pairs_of_all(rows):
    """Each row of an actor that waits against every one of any other."""
    out, top = {}, {}
    waits = [r for r in rows if r["old_event"] != CPU]
    for a in waits:
        for b in waits:
            if a["pid"] < b["pid"] and (a["capture"], a["old_event"]) == (b["capture"], b["old_event"]) and a["start"] < b["ts"] and b["start"] < a["ts"]:
                key, over = (a["pid"], b["pid"]), min(a["ts"], b["ts"]) - max(a["start"], b["start"])
                out[key] = out.get(key, 0) + over
                top[key] = max(top.get(key, (over, -a["old_event"])), (over, -a["old_event"]))
    return {k: (v, -top[k][1]) for k, v in out.items()}


def some_waits(spark, seed):
    rnd = random.Random(seed)
    items = [(rnd.randrange(150), rnd.randrange(60), rnd.choice((-2, 0, 1, 3, 3, 8, 20)), rnd.choice((CPU, LOCK, LOCK + 1, 0x0A000015))) for _ in range(500)]
    items += [(200, t, 1, LOCK) for t in range(40)]
    return rows(spark, *items).withColumn("capture", F.when(F.col("seq") % 3 == 0, "other").otherwise("main"))


def test_interference_never_shuffles_pairs(spark):
    d = some_waits(spark, 3)
    want = pairs_of_all(d.collect())
    most = max(v for v, _ in want.values())
    out = sequences.interference(d, 7)
    assert "hashpartitioning(pid_a" not in out._jdf.queryExecution().executedPlan().toString()
    # Actors with many rows are joined with the others.
    for got in (out, sequences.interference(d, 7, many=30)):
        got = got.collect()
        assert len(got) == len(want)
        assert {(r["pid_a"], r["pid_b"]): (r["overlap"], r["top_event"]) for r in got} == want
        assert all(r["score"] == r["overlap"] / most for r in got)
    first = sorted(want, key=lambda k: (-want[k][0], k))[:5]
    assert sorted((r["pid_a"], r["pid_b"]) for r in sequences.interference(d, 7, max_rows=5).collect()) == sorted(first)


def test_pairs_in_small_steps(spark, monkeypatch):
    d = [r for r in some_waits(spark, 4).filter("pid < 80").collect() if r["old_event"] != CPU]
    monkeypatch.setattr(pair_times, "CELLS", 90)
    monkeypatch.setattr(pair_times, "STEP", 3)
    parts = {}
    for r in d:
        parts.setdefault((r["capture"], r["old_event"]), ([], []))[0].append(tuple(np.array([r[c]]) for c in ("pid", "start", "ts")))
    got = [x for part in pair_times._summed(parts, 80, 80, True, True) for x in zip(*(c.tolist() for c in part))]
    assert {(a, b): (t, e) for a, b, t, e in got} == pairs_of_all(d) and len(got) > 100


def chains_by_pairs(d):
    """Each Lock wait against every CPU row."""
    all_rows = [r for r in d.collect() if r["marker"] is None]
    out = {}
    for a in (r for r in all_rows if r["old_event"] >> 24 == 3):
        hits = [(min(a["ts"], b["ts"]) - max(a["start"], b["start"]), -b["pid"], -b["seq"]) for b in all_rows if b["old_event"] == 0 and b["pid"] != a["pid"] and a["start"] < b["ts"] and b["start"] < a["ts"]]
        if hits:
            out[a["seq"], a["pid"]] = (-max(hits)[1], max(hits)[0])
    return out


@pytest.mark.parametrize("seed, span, longest, actors", [(1, 30, 6, 200), (2, 400, 90, 200), (3, 4000, 15, 200), (4, 60, 12, 5), (5, 3000, 2500, 200)])
def test_lock_chains_equal_all_pairs(spark, seed, span, longest, actors):
    """Ties, rows without length, sparse and dense time, and (few actors) rows of one actor that overlap."""
    rnd = random.Random(seed)
    d = rows(spark, *[(rnd.randrange(actors), rnd.randrange(span), rnd.randrange(longest), rnd.choice([CPU, LOCK])) for _ in range(700)])
    got = {(r["wait_seq"], r["waiter"]): (r["holder"], r["overlap"]) for r in sequences.lock_chains(d, 7).collect()}
    assert got == chains_by_pairs(d)


def test_lock_chains_make_no_pairs(spark, monkeypatch):
    def pairs(*_):
        raise AssertionError("pairs of waits and CPU rows")

    monkeypatch.setattr(sequences, "overlap_join", pairs)
    d = rows(spark, *[(p, 1000 + p % 7, 900 + p, LOCK if p % 2 else CPU) for p in range(60)])
    assert {(r["wait_seq"], r["waiter"]): (r["holder"], r["overlap"]) for r in sequences.lock_chains(d, 7).collect()} == chains_by_pairs(d)


def test_workers_of_executions(spark):
    runs = spark.createDataFrame([(1, 5, 10, 20), (1, 6, 30, None)], "pid long, e_seq long, e_start long, e_end long")
    w = measured(rows(spark, (2, 14, 8, CPU), (2, 18, 4, IO), (3, 32, 20, CPU))).withColumn("leader_pid", F.lit(1))
    got = {(r["e_seq"], r["pid"]): (r["n"], r["time"], r["cpu"]) for r in sequences.execution_workers(w, runs, 40, 5).collect()}
    assert got == {(5, 2): (2, 8, 1), (5, 3): (1, 8, None), (6, 3): (1, 2, None)}
    slices = sequences.execution_slices(w.withColumn("pid", F.lit(1)), runs, 40, 5, None)
    assert sorted((r["e_seq"], r["s"], r["e"], r["cpu"]) for r in slices.collect() if r["dur"] == 8) == [(5, 10, 14, 1)]


def test_bursts_by_bucket(spark):
    o = spark.createDataFrame([(IO, 3, 5), (IO, 8, 9), (LOCK, 9, 9), (IO, 25, 4), (IO, 99, 7)], "old_event long, onset long, actors int")
    assert sorted(map(tuple, sequences.burst_buckets(o, 0, 30, 3).collect())) == [(0, 3, IO, 9), (2, 1, IO, 4)]


def test_sampling_summary(spark):
    g = spark.createDataFrame([(IO, 50.0, 40.0, 10.0), (IO + 1, 30.0, 35.0, 5.0), (LOCK, 19.9, 24.5, 4.6), (LW, 0.1, 0.5, 0.4)], "old_event long, exact_pct double, sampled_pct double, gap double")
    r = compare.cross_summary(g, top=2).first()
    assert (r["max_gap"], round(r["max_class_gap"], 6), r["common_top"]) == (10.0, 5.0, 2)


def test_backend_spans(spark):
    d = rows(spark, (1, 0, "CMD_START"), (1, 5, 5, IO), (1, 6, "CMD_END"), (1, 9, 3, READ), (1, 10, "CMD_START"), (1, 12, "CMD_START"), (2, 4, "CMD_END"))
    gaps = spark.createDataFrame([("main", 2, 3)], "capture string, s long, e long")
    s = {(r["pid"], r["span"]): (r["dur"], r["closure"], r["measure"], r["reason"]) for r in sequences.backend_spans(d, gaps, 5).collect()}
    first = rows(spark, (3, 4, 3, IO), (3, 5, "PLAN_START", 7), (3, 9, "CMD_START"), (3, 12, 1, IO), (3, 15, "CMD_END"), (3, 17, 1, IO), (3, 18, "EXEC_START", 8), (3, 19, "ESCALATE_START"), (3, 20, "CMD_END"), (3, 22, 1, READ), (3, 23, "EXEC_END"))
    got = [(r["span"], r["c_start"], r["records"], r["execs"], r["plans"], r["closure"], r["measure"], r["reason"], r["queries"]) for r in sequences.backend_spans(first, gaps.limit(0), 5).orderBy("span").collect()]
    assert got == [(1, None, 1, 0, 1, "unknown", "unmeasured", "no_command", [7]), (2, 9, 1, 0, 0, "closed", "measured", None, []), (3, None, 0, 1, 0, "closed", "partial", "escalation", [8])]
    assert s == {(1, 1): (6, "closed", "partial", "gap"), (1, 2): (None, "unknown", "partial", "malformed"), (1, 3): (None, "in_flight", "partial", "no_end"), (2, 1): (None, "closed", "partial", "no_start")}


def test_span_picks(spark):
    d = rows(spark, (1, 0, "CMD_START"), (1, 1, "EXEC_START", 7), (1, 6, "CMD_END"), (1, 7, "CMD_START"), (1, 8, "EXEC_START", 7), (2, 1, "CMD_START"), (2, 2, "EXEC_START", 8), (2, 9, "CMD_END"))
    s = sequences.backend_spans(d, spark.createDataFrame([], "capture string, s long, e long"), 5)
    picks = {r["query_id"]: (r["pid"], r["closure"]) for r in sequences.span_per_query(s, 20).collect()}
    assert picks == {7: (1, "in_flight"), 8: (2, "closed")}
    assert [(r["pid"], r["span"], r["elapsed"]) for r in sequences.span_detail(s, 20, 10).orderBy("rank").collect()] == [(1, 2, 13), (2, 1, 8), (1, 1, 6)]


def test_worked_contract_rows(spark):
    big = 1 << 40
    lives = spark.createDataFrame([(1, 0, None), (2, 0, 10), (3, 0, 10)], "generation long, born long, died long")
    cover = spark.createDataFrame([(1, 0, 20), (2, 0, 10)], "generation long, s long, e long")
    waits = spark.createDataFrame([(1, "PgSleep", 0, 6, None), (1, "Lock", 6, 8, None), (1, "PgSleep", 8, 14, None), (2, "PgSleep", 8, 10, None), (3, "PgSleep", 8, 10, None)], "generation long, event string, s long, e long, as_of long")
    w = spark.createDataFrame([(1, i, "PgSleep", a, b) for i, (a, b) in enumerate([(4, 10), (4, 6), (6, 10), (6, 8)])] + [(2, 9, "PgSleep", 10, 12), (3, 10, "PgSleep", 10, 12)], "generation long, window_id long, event string, lo long, hi long")
    got = {r["window_id"]: (r["wait_time"] and int(r["wait_time"]) or 0, r["completed_waits"]) for r in coverage.wait_metrics(w, lives, cover, waits, 5).collect()}
    assert got == {0: (4, 1), 1: (2, 0), 2: (2, 1), 3: (0, 1), 9: (0, 1), 10: (0, None)} and big


def test_evidence_that_contradicts_itself(spark):
    lives = spark.createDataFrame([(g, 0, d) for g, d in enumerate([None, 50, 50, 50, 50, -1])], "generation long, born long, died long")
    cover = spark.createDataFrame([(0, 0, 20), (0, 20, 30), (1, 0, 20), (1, 10, 30), (2, 0, 30), (3, 0, 30), (4, 0, 15), (5, 0, 30)], "generation long, s long, e long")
    waits = [(0, "x", 0, 10, None), (0, "x", 10, 10, None), (0, "y", 10, 12, None), (0, "x", 12, None, 14), (2, "x", 0, 10, None), (2, "x", 9, 12, None), (3, "x", 0, 10, None), (3, "x", 9, None, 20), (4, "x", 40, 60, None)]
    waits = spark.createDataFrame(waits, "generation long, event string, s long, e long, as_of long")
    assert {r["generation"]: (r["bad_coverage"], r["bad_waits"]) for r in coverage.broken_evidence(lives, cover, waits).collect()} == {1: (True, False), 2: (False, True), 3: (False, True), 4: (False, True), 5: (True, False)}
    w = [(g, g, "x", 0, 30) for g in range(6)] + [(0, 7, "x", 5, 5), (0, 8, "", 0, 30), (0, 9, None, 9, 3)]
    w = spark.createDataFrame(w, "generation long, window_id long, event string, lo long, hi long")
    got = {r["window_id"]: (r["wait_time"] and int(r["wait_time"]), r["completed_waits"], r["covered"], r["reason"], r["invalid"]) for r in coverage.wait_metrics(w, lives, cover, waits, 5).collect()}
    evil = "invalid_evidence"
    assert got[0] == (12, 2, 30, None, "") and got[1] == (None, None, None, None, evil) and got[2] == (None, None, None, None, evil)
    # A gap that can be known shows even where the waits are wrong.
    assert got[4] == (None, None, None, "coverage_gap", evil) and got[5] == (None, None, None, None, evil)
    assert (got[7][4], got[8][4], got[9][4]) == ("invalid_window", "invalid_query", "invalid_query,invalid_window") and got[7][:2] == (None, None)


def test_release_order_and_ties(spark):
    m = spark.createDataFrame([("a", 1, 10, 1, 90, 7), ("a", 2, 12, 2, 90, 7), ("b", 1, 12, 1, 90, 7), ("b", 2, 12, 2, 90, 8), ("b", 3, 40, 3, 95, 7), ("b", 4, 93, 4, 95, 7)], "source string, o long, t long, q long, w long, gen long")
    assert [(r["source"], r["o"]) for r in coverage.released(m, 7).orderBy("position").collect()] == [("a", 1), ("b", 1), ("a", 2), ("b", 2), ("b", 3)]
    assert sorted((r["source"], r["o"], r["fault"]) for r in coverage.stream_faults(m, 2).collect()) == [("a", 2, "tie"), ("b", 1, "tie")]


def test_omissions_of_windows(spark):
    births = spark.createDataFrame([("b", 0, t) for t in (1, 2, 3, 11, 21, 31, 32, 33, 41, 51)], "boot string, boot_start long, fork long")
    certs = spark.createDataFrame([("b", 0, 3, 1, False), ("b", 1, 1, 0, False), ("b", 2, 1, 1, False), ("b", 3, 3, 2, False), ("b", 4, None, None, True), ("b", 6, 0, 0, False)], "boot string, k long, n long, u long, pending boolean")
    lost = spark.createDataFrame([("b", 1, 2, 4), ("b", 2, 31, 31), ("b", 3, 33, 45)], "boot string, id long, fork long, exit long")
    w = [(0, 0, 10), (1, 10, 20), (2, 5, 25), (3, 30, 40), (4, 38, 40), (5, 40, 44), (6, 50, 60), (7, 60, 61), (8, 5, 5)]
    w = spark.createDataFrame([("b", *x) for x in w], "boot string, window_id long, lo long, hi long")
    got = {r["window_id"]: (r["status"], r["affected"], r["time_at_most"]) for r in coverage.omission_verdicts(w, births, certs, lost, 10, 1, 20, 5, 4).collect()}
    assert got == {
        0: (None, 1, 2), 1: (None, 0, 0), 2: ("untraced_invalid", None, None), 3: ("untraced_limit", 1, 7), 4: ("untraced_limit", 1, 2),
        5: ("untraced_pending", None, None), 6: ("untraced_incomplete", None, None), 7: (None, 0, 0), 8: (None, None, None),
    }
    few = coverage.omission_verdicts(w.filter("window_id = 0"), births, certs, lost, 10, 1, 20, 2, 4).first()
    long = coverage.omission_verdicts(w.filter("window_id = 0"), births, certs, lost, 10, 1, 1, 5, 4).first()
    assert (few["status"], long["status"]) == ("untraced_unqualified", "untraced_limit")


def test_faults_and_frontier(spark):
    m = spark.createDataFrame([("a", 1, 10, 1, 9), ("a", 2, 12, 2, 12), ("a", 2, 12, 3, 12), ("a", 4, 11, 6, 20), ("b", 1, 5, 1, 15)], "source string, o long, t long, q long, w long")
    assert sorted((r["o"], r["fault"]) for r in coverage.stream_faults(m).collect()) == [(2, "duplicate"), (4, "clock"), (4, "gap")]
    assert sorted(r["t"] for r in coverage.frontier(m).collect()) == [5, 10, 11, 12, 12]


def test_rollup_equals_raw(spark):
    d = backed(rows(spark, (1, 25, 20, IO, LOCK, 3), (1, 40, 15, LOCK, CPU, 4), (2, 33, 33, READ, CPU, 0), (3, 40, 8, CPU, IO, 3)))
    r = rollup.build(d, 10, 1)
    raw = {x["old_event"]: (x["n"], x["time"]) for x in aggregates.top_events(d, 0, 50, 1).collect()}
    assert {x["old_event"]: (x["n"], x["time"]) for x in rollup.top_events(r, 10, 0, 50, 1).collect()} == raw
    a = [tuple(x) for x in rollup.aas(r, 10, 0, 50, 1).select("bucket", "io", "lock", "total").orderBy("bucket").collect()]
    assert a == [tuple(x) for x in aggregates.aas(d, 0, 50, 5).select("bucket", "io", "lock", "total").orderBy("bucket").collect()]


def tick(t, aas=1.0, locks=0.0, cpu=0.0, capacity=0.0, ok=True, changed=False, affinity=False, blocked=False):
    return SimpleNamespace(tick=float(t), aas=aas, lock_fraction=locks, cpu_aas=cpu, capacity=capacity, coverage_ok=ok, capacity_changed=changed, affinity_only=affinity, guard_blocked=blocked)


def test_load_rule():
    rules, state = anomaly.Rules(warmup_s=3), anomaly.State()
    assert {anomaly.step(rules, state, tick(t))[0] for t in range(5)} == {"NONE"}
    got = [anomaly.step(rules, state, tick(t, aas=9.0)) for t in range(5, 9)]
    assert got == [("NEAR", 1, 0), ("NEAR", 1, 0), ("FIRE", 0, 1), ("NEAR", 16, 1)] and state.baseline == pytest.approx(1.0)


def test_lock_rule_needs_a_convoy():
    rules = anomaly.Rules(warmup_s=0)
    assert [anomaly.step(rules, s := anomaly.State(baseline=5.0), tick(0, aas=1.0, locks=1.0))[0] for _ in range(4)] == ["NONE"] * 4 and s.locks == 0
    s = anomaly.State(baseline=5.0)
    assert [anomaly.step(rules, s, tick(t, aas=6.0, locks=0.5))[0] for t in range(3)] == ["NEAR", "NEAR", "FIRE"]


def test_cpu_rule_holds_resets_and_rearms():
    rules, s = anomaly.Rules(), anomaly.State()
    busy = dict(aas=4.0, cpu=4.0, capacity=2.0)
    sums = []
    for x in (tick(0, **busy), tick(1, **busy), tick(2, aas=1.0, cpu=0.2, capacity=2.0, ok=False), tick(3, **busy)):
        anomaly.step(rules, s, x)
        sums.append(round(s.cusum, 6))
    assert sums == [0.45, 0.9, 0.9, 1.35]  # the blind tick holds
    assert anomaly.step(rules, s, tick(4, **busy)) == ("FIRE", 0, 4) and (s.cusum, s.armed) == (0.0, 0)
    for t in range(200, 206):
        assert anomaly.step(rules, s, tick(t, **busy))[2] & 4 == 0  # not re-armed
    anomaly.step(rules, s, tick(206, cpu=0.1, capacity=2.0))
    anomaly.step(rules, s, tick(207, **busy))
    assert s.armed and s.cusum == pytest.approx(0.45)
    anomaly.step(rules, s, tick(208, **{**busy, "changed": True}))
    assert s.cusum == 0.0
    anomaly.step(rules, s, tick(209, **{**busy, "affinity": True}))
    assert s.cusum == pytest.approx(0.43)
    for t in (210, 211):
        anomaly.step(rules, s, tick(t))  # capacity unknown
    assert s.cusum == 0.0


def test_cusum_window_equals_the_rule(spark):
    ticks = spark.createDataFrame([("c", float(t), 4.0, 0.0, c, 4.0) for t, c in enumerate([0.0, 4.0, 3.0, 4.0, 5.0, 1.0, 1.0, 4.0])], "capture string, tick double, aas double, lock_fraction double, cpu_aas double, capacity double")
    rule = [r["cpu_cusum"] for r in anomaly.anomalies(ticks).orderBy("tick").collect()]
    plain = [r["cusum"] for r in anomaly.cusum(ticks, 0.8, 1.25).orderBy("tick").collect()]
    assert rule == pytest.approx(plain) and max(rule) > 0.7


@pytest.mark.parametrize(("seed", "stretch", "rules"), [(1, 90.0, anomaly.Rules()), (2, 60.0, anomaly.Rules(cooldown_s=9.0, ewma_s=4.0, learn_through_s=12.0))])
def test_stretches_of_ticks_equal_the_rule(spark, seed, stretch, rules):
    """Random loads with bursts, blind ticks and changes of capacity; ticks are missing here and there."""
    rnd = random.Random(seed)
    ticks = []
    for c in "ab":
        level = 1.0
        for t in range(200):
            level = rnd.choice([1.0, 2.0, 9.0]) if rnd.random() < 0.03 else level
            if rnd.random() < 0.05 or 120 <= t < 140:
                continue
            aas = level * rnd.uniform(0.5, 1.5)
            ticks.append((c, float(t), aas, rnd.choice([0.0, 0.2, 0.9]), aas * rnd.random() * 2, rnd.choice([None, 4.0, 4.0, 4.0]), rnd.random() > 0.2, rnd.random() < 0.02, rnd.random() < 0.3, rnd.random() < 0.02))
    schema = "capture string, tick double, aas double, lock_fraction double, cpu_aas double, capacity double, coverage_ok boolean, capacity_changed boolean, affinity_only boolean, guard_blocked boolean"
    want = []
    for c in "ab":
        state = anomaly.State()
        for x in ticks:
            if x[0] == c:
                tick = SimpleNamespace(**dict(zip(["capture", *schema.replace(",", "").split()[2::2]], x)))
                action, near, fired = anomaly.step(rules, state, tick)
                want.append((c, x[1], action, near, fired, state.baseline, state.cusum))
    got = [tuple(r) for r in anomaly.anomalies(spark.createDataFrame(ticks, schema).repartition(3), rules, stretch).collect()]
    assert sorted(got) == sorted(want) and len({w[2] for w in want}) == 3


def test_budgets_and_open_windows(spark):
    w = spark.createDataFrame([("c", 1, 0, 30), ("c", 2, 40, None), ("c", 3, 60, 70), ("c", 4, 200, 210)], "capture string, id long, s long, e long")
    got = lambda budget: {r["id"]: (r["used"], r["granted"]) for r in anomaly.budget_audit(w, 50, budget, 16).collect()}
    assert got(45) == {1: (0, 30), 2: (30, 15), 3: (40, 5), 4: (50, 0)}
    assert {i: g for i, (_, g) in got(0).items()} == dict.fromkeys(range(1, 5), 0)
    assert {i: g for i, (_, g) in got(None).items()} == {1: 30, 2: None, 3: 10, 4: 10}


def test_release_goes_by_time_actor_and_sequence(spark):
    m = spark.createDataFrame([("b", 1, 5, 1, 9, 20), ("a", 1, 5, 2, 1, 20), ("a", 2, 5, 1, 3, 20), ("b", 2, 4, 7, 4, 30)], "source string, o long, t long, pid long, q long, w long")
    assert [(r["source"], r["o"]) for r in coverage.released(m, 7).orderBy("position").collect()] == [("b", 2), ("a", 2), ("b", 1), ("a", 1)]


def test_query_texts(spark):
    assert texts.normalise("SELECT  a -- note\nFROM t WHERE b = 'it''s' AND c = 4.5 /* x */ AND d IS NULL") == "SELECT a FROM t WHERE b=? AND c=? AND d IS ?"
    assert texts.normalise("/* a /* b */ c */ select $1, 0x1F, \"q  'x' -- \" , a1, t.x, .5, 1..2, nullable") == "select $1,?,\"q  'x' -- \",a1,t.x,?,?..?,nullable"
    assert texts.normalise("$t$ a $ b $t$ , $$x$$, E'a\\'b', U&'x'") == "?,?,?,?"
    assert [texts.normalise(t) for t in ("", "a /* b /* c */", 'a "b', "a $x$ b")] == ["", None, None, None]
    d = spark.createDataFrame([("select 1",), ("select 2",), ("select 1",), (None,)], "text string")
    assert [(r["normal"], r["n_rows"], r["n_texts"]) for r in texts.text_keys(d).collect()] == [("select ?", 3, 2)]
    two = d.withColumn("db", F.lit("x")).union(d.withColumn("db", F.lit("y"))).unionByName(spark.createDataFrame([("select 'x", "x"), ("a /*", "x")], "text string, db string"))
    keys = {(r["db"], r["normal"]): r["key"] for r in texts.text_keys(two, ["db"]).collect()}
    assert len(set(keys.values())) == 3 and keys["x", None] == 0


def test_runs_of_words_are_one_token(spark):
    assert [m[0] for m in texts.TOKEN.finditer("select a_1 from t$x  where null")] == ["select a_1 from t$x", "  ", "where", " ", "null"]
    assert texts.normalise("a b E'x' e u&'y' u 'z' True truex x1'2' $t$ a $T$  b\nc") == "a b ? e ? u ? ? truex x1? ? b c"


def test_compare(spark):
    a = spark.createDataFrame([("x", 100), ("y", 50)], "k string, time long")
    b = spark.createDataFrame([("x", 150), ("z", 1)], "k string, time long")
    got = {r["k"]: (r["delta"], r["ratio"], r["status"], r["below_floor"]) for r in compare.compare(a, b, "k", floor=10).collect()}
    assert got == {"x": (50, 1.5, "both", False), "y": (-50, None, "gone", False), "z": (1, None, "new", True)}
    assert compare.baseline_presets(0, 100, 20) == [20, 40, 80]


def test_rollup_rows_are_dealt_before_they_are_cut(spark):
    d = backed(rows(spark, (1, 700, 690, IO, LOCK, 3), (1, 700, 0, IO, CPU, 3), (2, -35, 290, LOCK, CPU, 0), (2, 250, 10, CPU, IO, 4)))
    r = rollup.build(d, 10, 1)
    got = {(x["tick"], x["old_event"]): (x["time"], x["n"], x["longest"]) for x in r.filter("pid = 1").collect()}
    assert got == {**{(k, IO): (10, 0, 0) for k in range(1, 70)}, (70, IO): (0, 2, 690)}
    assert {x["tick"] for x in r.filter("pid = 2 and old_event <> 0").collect()} == set(range(-32, -2))
    assert [(x["tick"], x["time"], x["n"]) for x in r.filter("pid = 2 and old_event = 0").orderBy("tick").collect()] == [(24, 10, 0), (25, 0, 1)]
    # One shuffle before the ticks are cut, none after it.
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(pid") == 1 and plan.count("Exchange") == 1


def test_budgets_and_omissions_equal_all_pairs_without_making_them(spark):
    rng = random.Random(7)
    spans = [(i, s, s + rng.choice([0, 3, 40, 900])) for i in range(120) for s in [rng.randrange(1000)]]
    w = spark.createDataFrame([("c", i if i < 110 else 5, s, e if i % 9 else None) for i, s, e in spans], "capture string, id long, s long, e long")
    until = max(s for _, s, _ in spans) + 1
    real = [(i if i < 110 else 5, s, e if i % 9 else until) for i, s, e in spans]
    want = sorted((i, sum(max(0, min(f, s) - max(r, s - 50)) for j, r, f in real if j != i and r < f)) for i, s, _ in real)
    got = anomaly.budget_audit(w, 50, None, 16)
    assert sorted((r["id"], r["used"]) for r in got.collect()) == want
    assert "_role" not in got._jdf.queryExecution().toString()

    lost = spark.createDataFrame([("b", i if i < 100 else 3, s, e) for i, s, e in spans], "boot string, id long, fork long, exit long")
    births = spark.createDataFrame([("b", 0, s) for _, s, _ in spans], "boot string, boot_start long, fork long")
    certs = births.groupBy("boot", F.expr("fork div 100").alias("k")).agg(F.count("*").alias("n")).join(
        lost.groupBy("boot", F.expr("fork div 100").alias("k")).agg(F.count_distinct("id").alias("u")), ["boot", "k"]).withColumn("pending", F.lit(False))
    windows = [(i, lo, lo + rng.choice([0, 1, 60, 300])) for i in range(60) for lo in [rng.randrange(1500)]]
    w = spark.createDataFrame([("b", *x) for x in windows if x[1] < x[2]], "boot string, window_id long, lo long, hi long")
    got = {r["window_id"]: (r["affected"], r["time_at_most"]) for r in coverage.omission_verdicts(w, births, certs.filter("k < 20"), lost, 100, 1000, 10**6, 1000, 16).filter("status is null").collect()}
    named = [(i if i < 100 else 3, s, e) for i, s, e in spans]
    want = {i: (len({j for j, s, e in named if s < min(e, hi) and e > lo}), sum(max(0, min(e, hi) - max(s, lo)) for _, s, e in named)) for i, lo, hi in windows if lo < hi}
    assert len(got) > 20 and got == {i: want[i] for i in got}
