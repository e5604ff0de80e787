"""Sources and sinks: what is read back, what is pruned, and what is refused."""

import json

from dwell.operators import coverage
from dwell.sources import intervals as src


def table(spark, rows):
    d = spark.createDataFrame(rows, "i long, t long, d long, p long, o long, n long, q long")
    return src.intervals(d, "i", "t", "d", "p", "o", "n", "q")


def test_intervals_come_back_and_folders_are_pruned(spark, tmp_path):
    path, hour = str(tmp_path / "iv"), 100
    rows = [(i, 20 * i + 10, 15, i % 3, 0, 1, 7) for i in range(60)]
    src.write_intervals(table(spark, rows), path, hour)
    assert sorted(p.name for p in (tmp_path / "iv").glob("hour=*")) == sorted(f"hour={h}" for h in range(12))
    whole = src.read_intervals(spark, path).drop("hour")
    assert sorted(map(tuple, whole.select(*src.COLUMNS).collect())) == sorted(map(tuple, table(spark, rows).collect()))
    some = src.read_intervals(spark, path, 420, 500, hour=hour, longest=15)
    want = {i for i, t, d, *_ in rows if t >= 420 and t - d <= 500}
    assert {r["seq"] for r in some.collect()} == want
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hour" in plan and len(some.inputFiles()) and "PushedFilters" in plan
    before = src.read_intervals(spark, path, 420, 500, [1], hour, 15, lookback=100)
    assert {r["seq"] for r in before.collect()} == {i for i, t, d, p, *_ in rows if t >= 320 and t - d <= 500 and p == 1}


def test_scenarios_and_dimensions(spark, tmp_path):
    case = {
        "backends": [{"pid": 1, "type": "client", "user": "u", "db": "d"}],
        "queries": [{"id": 5, "text": "select 1"}],
        "events": [{"pid": 1, "ts": 50, "dur": 20, "old": 0, "new": 3, "qid": 5, "cpu": 7}, {"pid": 1, "ts": 60, "dur": 10, "old": 3, "new": 0}],
        "sample_period_ns": 10,
        "samples": [{"pid": 1, "ts": 70, "event": 3, "qid": 0}],
    }
    (tmp_path / "case.json").write_text(json.dumps(case, indent=1))
    got = src.read_scenario(spark, str(tmp_path / "case.json"))
    assert [(r["start"], r["ts"], r["query_id"], r["cpu"]) for r in got["events"].orderBy("seq").collect()] == [(30, 50, 5, 7), (50, 60, 0, None)]
    assert [tuple(r) for r in got["backends"].collect()] == [(1, "client", "u", "d")] and got["queries"].count() == 1
    assert [tuple(r) for r in got["samples"].collect()] == [(10, 0, 1, 70, 3, 0)]
    (tmp_path / "backends.json").write_text('{"pid": 3, "type": "walwriter"}\n{"pid": 4, "user": "x", "leader_pid": 3}\n')
    rows = src.read_dimension(spark, str(tmp_path / "backends.json")).orderBy("pid").collect()
    assert [(r["pid"], r["type"], r["leader_pid"]) for r in rows] == [(3, "walwriter", None), (4, None, 3)]


def test_report_sink_and_fidelity_gate(spark, tmp_path):
    d = table(spark, [(1, 10, 5, 1, 0, 1, 0)])
    src.write_report(d.select("pid", "dur"), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).select("pid", "dur").collect()] == [(1, 5)]
    assert coverage.exact_only(d, "mixed").select("status").first()[0] == "ok"
    gone = coverage.exact_only(d, "sampled").collect()
    assert len(gone) == 1 and gone[0]["status"] == "unavailable"
