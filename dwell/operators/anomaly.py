"""Tick metrics and the anomaly rules; the same state machine serves batch and streams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwell.functions.intervals import carried, overlapped, pair_lifo
from dwell.functions.rules import is_idle
from dwell.functions.settled import settled


def tick_metrics(samples: DataFrame) -> DataFrame:
    """Per capture and tick: actors under load, share of them on locks, and on CPU (io workers are out)."""
    d = samples.filter("backend is null or backend <> 'io_worker'").filter(~is_idle(F.col("old_event")))
    lock = F.shiftright("old_event", 24) == 0x03
    g = d.groupBy("capture", F.col("ts").alias("tick")).agg(F.count("*").alias("aas"), F.sum(F.when(lock, 1).otherwise(0)).alias("locks"), F.sum(F.when(F.col("old_event") == 0, 1).otherwise(0)).alias("cpu_aas"))
    return g.select("capture", "tick", F.col("aas").cast("double").alias("aas"), (F.col("locks") / F.col("aas")).alias("lock_fraction"), F.col("cpu_aas").cast("double").alias("cpu_aas"))


@dataclass(frozen=True)
class Rules:
    """Fixed defaults of the rules; times are in seconds."""

    hz: float = 1.0
    warmup_s: float = 5.0
    ewma_s: float = 60.0
    factor: float = 3.0
    min_aas: float = 2.0
    streak: int = 3
    learn_through_s: float = 900.0
    lock_share: float = 0.30
    cusum_clip: float = 1.25
    cusum_drift: float = 0.8
    cusum_fire: float = 1.5
    affinity_margin: float = 0.02
    blind_s: float = 2.0
    cooldown_s: float = 120.0


@dataclass
class State:
    seen: int = 0
    baseline: float = 0.0
    over: int = 0
    locks: int = 0
    cusum: float = 0.0
    blind: int = 0
    armed: int = 1
    last_fire: float = -1e18


#: Bits of the masks.
LOAD, LOCKS, CPU, WARMING, COOLING = 1, 2, 4, 8, 16


def _load(r: Rules, s: State, aas: float) -> bool:
    """Whether the load is over the baseline, which learns from ticks that aren't, and slowly from a
    load that has been over it for long."""
    s.seen += 1
    if s.seen <= r.warmup_s * r.hz:
        s.baseline += (aas - s.baseline) / s.seen
        return False
    high = aas >= r.min_aas and aas > r.factor * s.baseline
    s.over = s.over + 1 if high else 0
    rate = 1.0 / (r.ewma_s * r.hz)
    if not high:
        s.baseline += rate * (aas - s.baseline)
    elif s.over >= r.learn_through_s * r.hz:
        s.baseline += rate / 10 * (aas - s.baseline)
    return high


def _cpu(r: Rules, s: State, x, cooling: bool) -> tuple[bool, bool]:
    """(fires, climbs) of the CPU demand's CUSUM.

    An incomplete tick still proves demand that reaches the reference; one below it, or one
    without a known capacity, tells nothing: the sum is held, and dropped after blind_s of such
    ticks. After a fire the rule waits for a complete tick with demand below the drift.
    """
    demand = None if not x.capacity else min(max(x.cpu_aas / x.capacity, 0.0), r.cusum_clip)
    reference = r.cusum_drift + (r.affinity_margin if x.affinity_only else 0.0)
    proven = demand is not None and demand >= reference
    if demand is not None and x.coverage_ok and demand < r.cusum_drift:
        s.armed = 1
    useful = demand is not None and (x.coverage_ok or proven)
    s.blind = 0 if useful else s.blind + 1
    if s.blind >= r.blind_s * r.hz or x.capacity_changed or x.guard_blocked or cooling or (useful and not s.armed):
        s.cusum = 0.0
        return False, False
    before = s.cusum
    if useful:
        s.cusum = max(0.0, s.cusum + (demand - reference) / r.hz)
    return proven and s.cusum >= r.cusum_fire and x.cpu_aas >= r.min_aas, s.cusum > before


def step(r: Rules, s: State, x) -> tuple[str, int, int]:
    """Advances the state by one tick: action, what came near, and what asks for a fire (bits)."""
    cooling = x.tick - s.last_fire < r.cooldown_s
    cpu, climbs = _cpu(r, s, x, cooling)
    high = _load(r, s, x.aas)
    locked = x.lock_fraction > r.lock_share and x.lock_fraction * x.aas >= r.min_aas
    s.locks = s.locks + 1 if locked else 0
    fired = (LOAD if s.over >= r.streak else 0) | (LOCKS if s.locks >= r.streak else 0) | (CPU if cpu else 0)
    if fired and cooling:
        return "NEAR", COOLING, fired
    if fired:
        s.cusum, s.last_fire, s.armed = 0.0, x.tick, 0 if cpu else s.armed
        return "FIRE", 0, fired
    near = (LOAD if high else 0) | (LOCKS if locked else 0)
    near |= CPU if climbs and x.cpu_aas >= r.min_aas and s.cusum >= r.cusum_fire / 2 else 0
    near |= WARMING if s.seen <= r.warmup_s * r.hz and x.aas >= r.min_aas else 0
    return ("NEAR" if near else "NONE"), near, 0


DECISION = "capture string, tick double, action string, near_mask int, fired_mask int, baseline double, cpu_cusum double"
TICKS = ["capture", "tick", "aas", "lock_fraction", "cpu_aas", "capacity"]
#: Columns that a table of ticks may lack, with what then holds.
FLAGS = {"coverage_ok": True, "capacity_changed": False, "affinity_only": False, "guard_blocked": False}


def _with_flags(ticks: DataFrame) -> DataFrame:
    return ticks.select(*TICKS, *[F.col(c) if c in ticks.columns else F.lit(v).alias(c) for c, v in FLAGS.items()])


def decide(rules: Rules, state: State, pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for x in _ordered(pdf):
        action, near, fired = step(rules, state, x)
        out.append((x.capture, x.tick, action, near, fired, state.baseline, state.cusum))
    return pd.DataFrame(out, columns=["capture", "tick", "action", "near_mask", "fired_mask", "baseline", "cpu_cusum"])


def _at_edge(rules: Rules, state: State, tick: float) -> State:
    """The state before a stretch that begins at ``tick``, without what can no longer make a difference."""
    cooled = tick - state.last_fire >= rules.cooldown_s
    return replace(
        state, last_fire=State.last_fire if cooled else state.last_fire, blind=min(state.blind, math.ceil(rules.blind_s * rules.hz)),
        locks=min(state.locks, rules.streak), over=min(state.over, max(rules.streak, math.ceil(rules.learn_through_s * rules.hz))),
    )


STATE = ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in asdict(State()).items())
EDGE = f"capture string, stretch long, {STATE}"


def anomalies(ticks: DataFrame, rules: Rules = Rules(), stretch_s: float = 10_000.0) -> DataFrame:
    """Decision for each tick of each capture (one row for a tick; columns TICKS, tick in seconds).

    A capture is dealt over stretches of ``stretch_s``. Each is first run from a guess of the
    state before it: the true number of ticks, the mean load of the stretch before as
    baseline, and nothing pending. Stretches whose guess isn't exactly the state in which the one before them
    ended are run again from that, until none is left; the average forgets how it began, so that
    few rounds are needed. The result is the rule's own, tick by tick, and a task meets no more than a stretch.
    """
    t = settled(_with_flags(ticks).withColumn("stretch", F.floor(F.col("tick") / stretch_s)))
    w = Window.partitionBy("capture").orderBy("stretch")  # one row for each stretch
    known = t.groupBy("capture", "stretch").agg(F.count("*").alias("n"), F.avg("aas").alias("mean"), F.min("tick").alias("tick"))
    none = State()
    seen = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    guess = {**{k: F.lit(v) for k, v in asdict(none).items()}, "seen": seen, "baseline": F.coalesce(F.lag("mean").over(w), F.lit(0.0))}
    begin = settled(known.select("capture", "stretch", *[v.alias(k) for k, v in guess.items()]))
    first = settled(known.select("capture", "stretch", F.lead("stretch").over(w).alias("next"), F.lead("tick").over(w).alias("next_tick")))
    names = list(asdict(none))

    def ends(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The state that a stretch leaves for the one after it."""
        state = _state(right)
        for x in _ordered(left):
            step(rules, state, x)
        at = right.iloc[0]
        state = _at_edge(rules, state, at["next_tick"])
        return pd.DataFrame([(at["capture"], at["next"], *asdict(state).values())], columns=["capture", "stretch", *names])

    def decisions(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return decide(rules, _state(right), left)

    key = ["capture", "stretch"]
    todo = begin
    while True:
        # The last stretch of a capture leaves its state to none.
        asked = _renamed(todo.join(first.filter("next is not null"), key))
        left = settled(t.join(asked.select(*key), key, "left_semi").groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(ends, EDGE))
        same = F.lit(True)
        for k in names:
            same = same & (F.col(k) == F.col(f"_{k}"))
        old = begin.select(*key, *[F.col(k).alias(f"_{k}") for k in names])
        todo = settled(left.join(old, key).filter(~same).select(*key, *names))
        if todo.isEmpty():
            break
        begin = settled(begin.join(todo.select(*key), key, "left_anti").unionByName(todo))
    return t.groupBy(*key).cogroup(_renamed(begin).groupBy(*key)).applyInPandas(decisions, DECISION)


def _renamed(d: DataFrame) -> DataFrame:
    """d with new columns of the old names, for a cogroup with what d was made of."""
    return d.select(*[F.col(c).alias(c) for c in d.columns])


def _state(row: pd.DataFrame) -> State:
    return State(*[type(v)(row[k].iloc[0]) for k, v in asdict(State()).items()])


def _ordered(pdf: pd.DataFrame):
    return pdf.assign(capacity=pdf["capacity"].fillna(0.0)).sort_values("tick").itertuples()


def stream_anomalies(ticks: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """As anomalies, for a stream of ticks; a capture's state lives as long as the query."""
    def run(key: tuple, parts: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        state = State(*store.get) if store.exists else State()
        rows = list(parts)
        out = decide(rules, state, pd.concat(rows)) if rows else None
        store.update(tuple(asdict(state).values()))
        if out is not None:
            yield out

    return _with_flags(ticks).groupBy("capture").applyInPandasWithState(run, DECISION, STATE, "append", "NoTimeout")


def cusum(ticks: DataFrame, drift: float, clip: float, chunk: int = 100_000) -> DataFrame:
    """Plain CUSUM of cpu_aas / capacity per capture as a running sum less its running minimum.

    Each stretch of ``chunk`` ticks is summed up on its own, so one capture is many tasks' work.
    """
    u = F.least(F.col("cpu_aas") / F.col("capacity"), F.lit(clip)) - drift
    d = carried(ticks, ["capture"], "tick", ["tick"], chunk, highs={"_last": "tick"})
    d = d.withColumn("_x", (F.col("tick") - F.coalesce("_last", "tick")) * u)
    d = carried(d, ["capture"], "tick", ["tick"], chunk, sums={"_p": "_x"}).withColumn("_n", -F.col("_p"))
    d = carried(d, ["capture"], "tick", ["tick"], chunk, highs={"_low": "_n"})
    low = F.least(F.lit(0.0), F.col("_p"), F.coalesce(-F.col("_low"), F.lit(0.0)))
    return d.withColumn("cusum", F.col("_p") - low).drop("_p", "_x", "_n", "_low", "_last")


def escalations(df: DataFrame) -> DataFrame:
    """Windows between ESCALATE markers with the seconds and the reason packed into the start's id."""
    m = F.col("marker")
    p = pair_lifo(df.filter("marker is not null").select("capture", "ts", "seq", "marker", "query_id"), ["capture"], ["ts", "seq"], m == "ESCALATE_START", m == "ESCALATE_END", F.lit(False))
    s = p.filter("kind = 'start'")
    return s.select("capture", F.col("ts").alias("s"), F.col("c_ts").alias("e"), F.shiftright("query_id", 8).alias("seconds"), F.col("query_id").bitwiseAND(255).alias("reason"))


def budget_audit(windows: DataFrame, trailing: int, budget: int | None, width: int) -> DataFrame:
    """At the start of each window (capture, id, s, e): what others used within ``trailing`` before, and the grant.

    A window without an end is open and counts up to that start; it asks for all that is left. A budget of 0 denies
    all, and None grants all that is asked for (null for what is open).
    """
    # An open window is still open at the latest start, so it reaches all of them.
    last = windows.groupBy("capture").agg((F.max("s") + 1).alias("_last"))
    w = windows.join(last, "capture").withColumn("_e", F.coalesce("e", "_last"))
    a = w.select("capture", "id", F.col("s"), (F.col("s") - trailing).alias("_from"), (F.col("e") - F.col("s")).alias("want"))
    b = w.filter("id is not null").select("capture", "id", "s", F.col("_e").alias("e"))
    # All that was used, less what windows of the same id used; a window itself begins where the time asked for ends.
    j = overlapped(a, b.drop("id"), ["capture"], "_from", "s", "used", "_n", width)
    again = b.join(b.groupBy("capture", "id").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"), ["capture", "id"], "left_semi")
    j = overlapped(j.drop("_n"), again, ["capture", "id"], "_from", "s", "_own", "_n")
    j = j.withColumn("used", F.when(F.col("id").isNotNull(), F.col("used") - F.col("_own")).otherwise(0))
    granted = F.col("want") if budget is None else F.least("want", F.greatest(F.lit(0).cast("long"), budget - F.col("used")))
    return j.select("capture", "id", "used", granted.alias("granted"))
