"""Registered queries: one for each operator, over the whole given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dwell.functions.intervals import coalesce_spans, pair_lifo, split_to_buckets, subtract_spans
from dwell.functions.rules import class_of, clip, cpu_share, latency_bucket, off_cpu
from dwell.operators import aggregates as agg
from dwell.operators import annotate, anomaly, compare, coverage, evidence, rollup, sequences, texts, verdicts
from dwell.plans.base import DAY, HI, HOUR, LO, STATES, UNIT, WIDTH, annotated, backends, mapped, marked, micros, moves, spans, table, windows
from dwell.sources import intervals as src
from dwell.streaming import live

QUERIES = {}
MID = LO + 15 * DAY


def query(f):
    QUERIES[f.__name__] = f
    return f


# Sources, filters, windows


@query
def interval_window(spark, d):
    m = moves(spark, d)
    return m.filter((F.col("ts") >= MID) & (F.col("start") <= MID + DAY)).select("seq", "pid", "start", "ts", "old_event")


@query
def uniform_filter(spark, d):
    return src.uniform_filter(moves(spark, d), wait_class="IO").select("seq", "pid", "dur")


@query
def window_clip(spark, d):
    return moves(spark, d).groupBy("pid").agg(F.sum(clip(F.col("start"), F.col("ts"), MID, MID + DAY)).alias("wall"))


@query
def window_instants(spark, d):
    return src.instants(marked(spark, d), MID, MID + DAY).groupBy("pid").agg(F.count("*").alias("n"))


@query
def cpu_share_by_day(spark, d):
    s = split_to_buckets(moves(spark, d).filter("cpu is not null"), LO, HI, DAY)
    share = cpu_share(F.col("cpu"), F.col("start"), F.col("dur"), F.col("b_lo"), F.col("b_hi"))
    s = s.withColumn("share", share)
    return s.groupBy("bucket").agg(F.sum("share").alias("cpu"), F.sum(off_cpu(F.col("b_hi") - F.col("b_lo"), F.col("share"))).alias("off_cpu"))


def _samples(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("capture"), F.col("event_id").alias("seq"), F.expr("cast(0 as bigint)").alias("query_id"), F.col("user_id").alias("pid"), micros("ts").alias("us"))
    tick = F.expr(f"us div {UNIT * 10} * {UNIT * 10}")
    return e.select("capture", "seq", tick.alias("ts"), "pid", F.col("seq").alias("event"), "query_id")


@query
def sample_weights(spark, d):
    return src.decode_samples(_samples(spark, d), UNIT * 10, 24 * HOUR).select("capture", "seq", "ts", "dur")


def _own_captures(spark, d):
    return moves(spark, d).withColumn("capture", F.col("pid").cast("string"))


@query
def exact_wins_merge(spark, d):
    m = _own_captures(spark, d)
    samples = m.filter(F.col("old_event") != STATES["purchase"]).withColumn("is_sample", F.lit(True))
    out = src.exact_wins(m.filter(F.col("old_event") == STATES["purchase"]), samples, spans(spark, d), WIDTH)
    return out.select("seq", "pid", "start", "ts", "is_sample", "counts")


@query
def clock_mapping(spark, d):
    m = _own_captures(spark, d)
    offsets = m.groupBy("capture").agg((-F.min("start")).alias("wall_offset"))
    return src.to_wall(m, offsets).select("seq", "start", "ts")


@query
def class_and_latency(spark, d):
    return moves(spark, d).groupBy(class_of(F.col("old_event")).alias("class"), latency_bucket(F.col("dur"), UNIT).alias("latency")).agg(F.count("*").alias("n"))


# Annotation


@query
def backend_tags(spark, d):
    return annotated(spark, d).groupBy("backend").agg(F.count("*").alias("n"), F.sum("dur").alias("time"))


@query
def phase_tags(spark, d):
    t = annotate.tag_phase(annotate.tag_backend(marked(spark, d), backends(spark, d))).filter("marker is null")
    return t.select("seq", "in_plan", "in_exec", "category")


@query
def in_command_majority(spark, d):
    t = annotate.tag_in_command(marked(spark, d), HI, WIDTH).filter("marker is null")
    return t.select("seq", F.when(F.col("in_command"), "inside").when(~F.col("in_command"), "outside").otherwise("unknown").alias("in_command"))


@query
def cpu_relabel(spark, d):
    t = annotate.tag_in_command(annotate.tag_backend(marked(spark, d), backends(spark, d)), HI, WIDTH)
    return annotate.relabel_cpu(t).filter("marker is null").groupBy("old_event").agg(F.count("*").alias("n"), F.sum("dur").alias("time"))


def _few_ids(spark, d):
    """Rows with a short last step keep their query, others have none, as in a sparse trace."""
    m = marked(spark, d)
    m = m.withColumn("query_id", F.when((F.col("marker").isNull()) & (F.col("dur") > 6 * HOUR), 0).otherwise(F.col("query_id")))
    return annotate.tag_backend(m, backends(spark, d))


@query
def query_attribution(spark, d):
    return annotate.attribute_queries(_few_ids(spark, d)).select("seq", "attributed_id", "attribution")


@query
def query_totals(spark, d):
    return agg.query_totals(annotate.attribute_queries(_few_ids(spark, d)), LO, HI)


# Aggregates


@query
def aas(spark, d):
    return agg.aas(annotated(spark, d), LO, HI, 120)


@query
def aas_peak(spark, d):
    return agg.aas_peak(annotated(spark, d), LO, HI, 120)


@query
def aas_by_event(spark, d):
    return agg.aas_by_event(moves(spark, d), LO, HI, 60, 3)


@query
def aas_by_category(spark, d):
    t = annotate.tag_phase(annotate.tag_backend(marked(spark, d), backends(spark, d)))
    return agg.aas_by_category(t, LO, HI, 30)


@query
def time_model(spark, d):
    return agg.time_model(annotated(spark, d), LO, HI)


@query
def category_time(spark, d):
    return agg.category_time(annotated(spark, d), LO, HI)


@query
def cpu_checks(spark, d):
    return agg.cpu_checks(moves(spark, d))


@query
def top_events(spark, d):
    return agg.top_events(moves(spark, d), LO, HI, UNIT)


@query
def top_sessions(spark, d):
    return agg.top_sessions(moves(spark, d), LO, HI)


@query
def top_queries(spark, d):
    return agg.top_queries(moves(spark, d), LO, HI)


@query
def heatmap(spark, d):
    return agg.heatmap(annotated(spark, d), LO, HI, UNIT, 200)


@query
def event_histogram(spark, d):
    return agg.event_histogram(moves(spark, d), LO, HI, UNIT)


@query
def query_event_pairs(spark, d):
    return agg.query_event(moves(spark, d), LO, HI)


@query
def queries_of_event(spark, d):
    return agg.query_event(moves(spark, d), LO, HI, event=STATES["error"])


@query
def events_of_query(spark, d):
    return agg.query_event(moves(spark, d), LO, HI, query_id=7)


@query
def record_counts(spark, d):
    return agg.record_counts(moves(spark, d))


# Sequences and joins


@query
def transitions(spark, d):
    return sequences.transitions(moves(spark, d), LO, HI)


@query
def transition_nodes(spark, d):
    return sequences.transition_nodes(moves(spark, d), LO, HI)


@query
def transition_matrix(spark, d):
    return sequences.transition_matrix(moves(spark, d), LO, HI, 3)


@query
def graph_pruning(spark, d):
    return sequences.prune_graph(moves(spark, d), LO, HI, 95.0, keep_idle=False)


@query
def fingerprints(spark, d):
    return sequences.fingerprints(moves(spark, d), LO, HI)


@query
def concurrency_peaks(spark, d):
    return sequences.concurrency(moves(spark, d), LO, HI, 60)


@query
def bursts(spark, d):
    return sequences.bursts(moves(spark, d), 2 * HOUR, 4)


@query
def burst_buckets(spark, d):
    return sequences.burst_buckets(sequences.bursts(moves(spark, d), 2 * HOUR, 4), LO, HI, 60)


@query
def lock_chains(spark, d):
    return sequences.lock_chains(moves(spark, d), WIDTH)


@query
def interference(spark, d):
    return sequences.interference(moves(spark, d), WIDTH)


def _runs(spark, d):
    return sequences.executions(marked(spark, d), LO, HI, WIDTH)


@query
def executions(spark, d):
    return _runs(spark, d)


@query
def top_executions(spark, d):
    return sequences.top_executions(_runs(spark, d), HI).select("pid", "e_seq", "dur")


@query
def query_lifecycle(spark, d):
    return sequences.query_lifecycle(marked(spark, d))


@query
def execution_slices(spark, d):
    return sequences.execution_slices(marked(spark, d), _runs(spark, d), HI, WIDTH)


@query
def execution_scatter(spark, d):
    return sequences.execution_scatter(_runs(spark, d), LO, HI, 100, 5000)


@query
def variants(spark, d):
    return sequences.variants(marked(spark, d), "EXEC", WIDTH)


@query
def session_timeline(spark, d):
    return sequences.session_timeline(moves(spark, d), LO, HI, HOUR)


@query
def timeline_density(spark, d):
    return sequences.timeline_density(moves(spark, d), LO, HI, 60)


@query
def backend_spans(spark, d):
    return _spans(spark, d).drop("queries")


def _spans(spark, d):
    g = table(spark, d, "orders").select(F.lit("main").alias("capture"), (LO + F.expr("o_orderkey * 7919 % 43200000") * 60_000).alias("s"))
    return sequences.backend_spans(marked(spark, d), g.withColumn("e", F.col("s") + 60_000_000), HOUR)


@query
def span_per_actor(spark, d):
    return sequences.span_per_actor(_spans(spark, d), HI)


@query
def span_per_query(spark, d):
    return sequences.span_per_query(_spans(spark, d), HI)


@query
def span_detail(spark, d):
    return sequences.span_detail(_spans(spark, d), HI, 500)


def _workers(spark, d):
    m = annotated(spark, d)
    # Every other actor works for one of the foreground ones, by the remainder of its pid.
    leaders = m.filter("backend = 'foreground'").select(F.col("pid").alias("leader_pid")).distinct()
    leaders = leaders.withColumn("i", F.row_number().over(Window.orderBy("leader_pid")) - 1)
    n = leaders.agg(F.count("*").alias("n"))
    w = m.filter("backend <> 'foreground'").join(F.broadcast(n)).withColumn("i", (F.col("pid") % F.col("n")).cast("int")).join(leaders, "i")
    return w


@query
def worker_leaders(spark, d):
    return sequences.worker_leaders(_workers(spark, d), _runs(spark, d), HI, WIDTH)


@query
def execution_workers(spark, d):
    return sequences.execution_workers(_workers(spark, d), _runs(spark, d), HI, WIDTH)


def _texts(spark, d):
    p = table(spark, d, "part")
    kind = F.when(F.col("p_size") < 10, "full").when(F.col("p_size") < 30, "synthetic").otherwise("pgss")
    return p.select(F.col("p_brand").alias("db"), F.col("p_type").alias("user"), F.expr("p_partkey % 10").alias("query"), kind.alias("source"), F.col("p_name").alias("text"), F.col("p_partkey").alias("ts"))


@query
def text_by_context(spark, d):
    return sequences.resolve_texts(_texts(spark, d))[0].select("db", "user", "query", "text")


@query
def text_by_query(spark, d):
    t = _texts(spark, d).withColumn("query", F.col("ts"))
    return sequences.resolve_texts(t)[1]


@query
def query_contexts(spark, d):
    return sequences.query_contexts(moves(spark, d).withColumn("query_id", F.col("query_id") * 150 + F.col("pid")), backends(spark, d))


# Comparison and validation


@query
def ab_compare(spark, d):
    m = agg.load(moves(spark, d), LO, MID).filter("not idle").select(F.concat_ws(":", "pid", "old_event").alias("entity"), F.col("wall").alias("time")).filter("time > 0")
    n = agg.load(moves(spark, d), MID, HI).filter("not idle").select(F.concat_ws(":", "pid", "old_event").alias("entity"), F.col("wall").alias("time")).filter("time > 0")
    return compare.compare(m, n, "entity", floor_share=0.0005)


@query
def ab_bucket_difference(spark, d):
    return compare.bucket_difference(annotated(spark, d), MID, HI, 15 * DAY, 30)


@query
def capture_report(spark, d):
    return compare.report(moves(spark, d), LO, HI, UNIT)


@query
def sampled_vs_exact(spark, d):
    m = moves(spark, d)
    s = src.decode_samples(m.select("capture", "seq", "ts", "pid", F.col("old_event").alias("event"), "query_id"), UNIT, HOUR)
    return compare.cross_validate(m, s, LO, HI)


@query
def sampled_vs_exact_summary(spark, d):
    m = moves(spark, d)
    s = src.decode_samples(m.select("capture", "seq", "ts", "pid", F.col("old_event").alias("event"), "query_id"), UNIT, HOUR)
    out = compare.cross_summary(compare.cross_validate(m, s, LO, HI), top=3)
    return out.select(F.round("max_gap", 6).alias("max_gap"), F.round("max_class_gap", 6).alias("max_class_gap"), "common_top")


@query
def window_additivity(spark, d):
    return compare.additivity(moves(spark, d), [LO, LO + 3 * DAY, MID, HI], UNIT)


# Fidelity, coverage, contracts


def _exact(spark, d):
    return spans(spark, d).select(F.col("capture"), "s", "e")


def _sampled(spark, d):
    m = _own_captures(spark, d).filter(F.col("old_event") == STATES["view"])
    return m.select("capture", F.col("start").alias("s"), F.col("ts").alias("e"))


@query
def window_fidelity(spark, d):
    return coverage.window_fidelity(windows(spark, d), _exact(spark, d), _sampled(spark, d), WIDTH, HOUR)


def _sparse(spark, d, state, part):
    """The first part of each stretch of a state as a span of the whole capture, so that gaps are left between them."""
    return moves(spark, d).filter(F.col("old_event") == STATES[state]).select(F.col("start").alias("s"), (F.col("start") + F.expr(f"dur div {part}")).alias("e"))


@query
def fidelity_ranges(spark, d):
    return coverage.fidelity_ranges(_sparse(spark, d, "purchase", 40), _sparse(spark, d, "view", 40), LO, HI, UNIT, WIDTH)


@query
def exact_gaps(spark, d):
    r = moves(spark, d).filter(F.col("old_event") == STATES["error"]).select(F.col("pid").cast("string").alias("capture"), F.col("ts").alias("at"))
    return coverage.exact_gaps(_exact(spark, d), ["capture"], r, WIDTH)


@query
def uncovered_buckets(spark, d):
    return coverage.uncovered_buckets(_sparse(spark, d, "purchase", 8), LO, HI, 720, WIDTH)


@query
def span_coalesce(spark, d):
    s = table(spark, d, "lineitem").select("l_suppkey", micros("l_shipdate").alias("s")).withColumn("e", F.col("s") + 2 * DAY)
    return coalesce_spans(s, ["l_suppkey"])


@query
def span_subtract(spark, d):
    a = _sampled(spark, d).withColumn("id", F.col("s"))
    return subtract_spans(a, _exact(spark, d), ["capture"], ["id"], WIDTH)


@query
def wait_metrics(spark, d):
    m = moves(spark, d).withColumn("generation", F.col("pid"))
    w = windows(spark, d).select(F.col("capture").cast("long").alias("generation"), "window_id", "lo", "hi", F.lit(STATES["error"]).cast("long").alias("event"))
    lives = m.groupBy("generation").agg(F.min("start").alias("born"), F.max("ts").alias("died"))
    cover = m.filter("dur < 100000000000").select("generation", F.col("start").alias("s"), F.col("ts").alias("e"))
    waits = m.select("generation", F.col("old_event").alias("event"), F.col("start").alias("s"), F.col("ts").alias("e"), F.lit(None).cast("long").alias("as_of"))
    w = w.join(lives.select("generation"), "generation", "left_semi")
    return coverage.wait_metrics(w, lives, cover, waits, WIDTH).withColumn("wait_time", F.col("wait_time").cast("long"))


def _boots(spark, d):
    """A boot for each type of event, one after the other, and the events as what its files say; the fourth boot's clock is early."""
    e = table(spark, d, "events").withColumn("us", micros("ts")).select(F.col("event_type").alias("boot"), F.col("event_id").alias("seq"), F.expr(f"(us - {LO}) div 5").alias("t"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    b = e.groupBy("boot").agg(F.max("t").alias("last_obs"), F.min("seq").alias("first"), F.max("seq").alias("last")).withColumn("n", F.dense_rank().over(Window.orderBy("boot")).cast("long") - 1)
    e = e.join(b.select("boot", "n", "first", "last"), "boot")
    file = (F.col("seq") == F.col("first")) | (F.col("seq") % 41 == 0)
    kind = F.when(file, "FILE").when((F.col("seq") == F.col("last")) & F.col("n").isin(1, 3), "SEAL").when(F.col("seq") % 509 == 1, "BAD").when(F.col("seq") % 301 == 2, "GAP_OPEN").when((F.col("seq") % 301).between(10, 90) & (F.col("seq") % 3 == 0), "GAP_CLOSE").otherwise("WATERMARK")
    w = Window.partitionBy("boot").orderBy("seq")
    number = F.sum(F.when(file, F.when(F.col("seq") % 5 == 0, 2).otherwise(1))).over(w)
    e = e.withColumn("kind", kind).withColumn("number", number)
    minute = 60_000_000
    mark, gap = F.col("kind") == "WATERMARK", F.col("kind").isin("GAP_OPEN", "GAP_CLOSE")
    at = F.when(mark & (F.col("value") > 250), F.col("t") - 12 * HOUR).otherwise(F.col("t"))
    facts = e.select(
        "boot", "seq", "kind", at.alias("a"), F.when(F.col("kind") == "FILE", F.col("number")).when(mark, F.col("t") - F.col("k") * minute).alias("b"),
        F.when(F.col("kind") == "FILE", (F.col("seq") % 11 != 0).cast("long")).when(mark, F.col("t") - 2 * F.col("k") * minute).when(gap, F.floor(F.col("seq") / 301)).alias("c"),
    )
    n = F.col("n")
    boots = b.select(
        "boot", n.alias("ordinal"), F.lit(0).cast("long").alias("boot_start"), (LO + n * 6 * DAY - F.when(n == 3, 5 * HOUR).otherwise(0)).alias("wall_offset"),
        F.when(n != 2, F.floor(n / 2) + 1).alias("postmaster_start"), (n == 1).alias("closure_clean"), (n > 2).alias("same_kernel_boot"), F.when(n == 4, "match").otherwise("none").alias("status"), "last_obs",
    )
    return boots, facts


def _judge(f, spark, d):
    boots, facts = _boots(spark, d)
    legacy = spark.range(1).select(F.lit(LO - 3 * DAY).alias("s"), (F.lit(LO) + HOUR).alias("e"))
    return f(boots, facts, windows(spark, d).select("window_id", "lo", "hi"), HI, WIDTH, live_lag=DAY, legacy=legacy)


@query
def coverage_verdict(spark, d):
    return _judge(verdicts.coverage_verdict, spark, d)


@query
def uncovered_ranges(spark, d):
    return _judge(verdicts.uncovered_ranges, spark, d)


@query
def bounded_omission(spark, d):
    m = moves(spark, d)
    births = m.select(F.col("old_event").alias("boot"), F.lit(LO).alias("boot_start"), F.col("ts").alias("fork"))
    n = m.groupBy(F.col("old_event").alias("boot"), F.expr(f"(start - {LO}) div {DAY}").alias("k")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("dur") > 30 * HOUR, 1).otherwise(0)).alias("u"))
    return coverage.bounded_omission(births, n, DAY, 0.1)


@query
def omission_verdicts(spark, d):
    m = moves(spark, d).select(F.col("old_event").alias("boot"), F.lit(LO).alias("boot_start"), "seq", F.col("ts").alias("fork"), (F.col("ts") + F.col("dur")).alias("exit"), "dur")
    lost = m.filter("seq % 31 = 0").select("boot", F.col("seq").alias("id"), "fork", "exit")
    k = F.expr(f"(fork - {LO}) div {DAY}").alias("k")
    c = m.groupBy("boot", k).agg(F.count("*").alias("n"), F.sum(F.when(F.col("seq") % 31 == 0, 1).otherwise(0)).alias("u"))
    c = c.filter("k % 29 <> 5").withColumn("u", F.col("u") + F.when(F.col("k") % 29 == 7, 1).otherwise(0)).withColumn("pending", F.col("k") % 29 == 9)
    boots = list(STATES.values())
    w = windows(spark, d).select(F.element_at(F.array(*[F.lit(b).cast("long") for b in boots]), (F.col("window_id") % len(boots) + 1).cast("int")).alias("boot"), "window_id", "lo", "hi")
    return coverage.omission_verdicts(w, m.select("boot", "boot_start", "fork"), c, lost, DAY, 4, 30 * HOUR, 90, WIDTH)


@query
def phase_capability(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("phase"), micros("ts").alias("start"), F.when(F.col("event_type") != "error", F.when(F.col("value") > 20, "available").otherwise("unavailable")).alias("state"))
    return coverage.capability(e, LO, HI)


def _messages(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("o"), micros("ts").alias("t"), F.col("user_id").alias("gen"), F.col("user_id").alias("pid"))
    q = F.row_number().over(Window.partitionBy("source").orderBy("o"))
    return e.withColumn("q", (q + F.when(F.col("o") % 97 == 0, 1).otherwise(0)).cast("long")).withColumn("w", F.col("t") - HOUR)


@query
def source_frontier(spark, d):
    return coverage.released(_messages(spark, d), DAY).select("source", "o", "t", "position")


@query
def stream_faults(spark, d):
    return coverage.stream_faults(_messages(spark, d))


def _evidence_log(spark, d):
    """A capture for each user: their events as transitions, errors as frontiers, and signups as losses after which tracing is attached anew."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", micros("ts").alias("us"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = e.withColumn("start", F.lag("us").over(w)).withColumn("prev", F.lag("event_type").over(w))
    state = lambda c: F.when(F.col(c) != "view", F.col(c))
    counters, of = F.array(*[F.lit(0).cast("long")] * 15), [F.col("user_id").cast("string").alias("capture"), F.col("user_id").alias("pid")]
    at = lambda k: (4 * F.col("event_id") + k).alias("seq")
    parts = [
        e.groupBy("user_id").agg(F.min("event_id").alias("event_id")).select(*of, (-F.col("event_id") - 1).alias("seq"), F.lit("LIFE").alias("kind"), F.lit(LO).alias("t"), F.lit(0).cast("long").alias("start")),
        e.filter("start is not null").select(*of, at(0), F.lit("TRANS").alias("kind"), F.col("us").alias("t"), state("prev").alias("old"), state("event_type").alias("new"), (F.col("us") - F.col("start")).alias("duration")),
        e.filter("event_type = 'error'").select(*of, at(1), F.lit("FRONTIER").alias("kind"), F.col("us").alias("t"), counters.alias("counters")),
        e.filter("event_type = 'signup'").select(*of, at(1), F.lit("VOID").alias("kind"), F.col("us").alias("t"), counters.alias("counters"), F.when(F.col("k") == 7, F.col("us") - 2 * DAY).alias("invalid_from")),
        e.filter("event_type = 'signup'").select(*of, at(2), F.lit("ATTACH_OK").alias("kind"), F.col("us").alias("t"), counters.alias("counters"), F.lit("reread").alias("method"), state("event_type").alias("state")),
    ]
    long, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    log = spark.range(0).select(text.alias("capture"), long.alias("seq"), text.alias("kind"), long.alias("t"), long.alias("pid"), long.alias("fork"), long.alias("start"), long.alias("exit"), text.alias("method"), text.alias("state"), F.lit(None).cast("array<long>").alias("counters"), long.alias("invalid_from"), text.alias("old"), text.alias("new"), long.alias("duration"))
    for p in parts:
        log = log.unionByName(p, allowMissingColumns=True)
    captures = e.select(F.col("user_id").cast("string").alias("capture"), F.lit(True).alias("qualified"), counters.alias("counters")).distinct()
    return captures, log


@query
def evidence_waits(spark, d):
    return evidence.replay(*_evidence_log(spark, d), WIDTH)[2]


@query
def evidence_runs(spark, d):
    return evidence.replay(*_evidence_log(spark, d), WIDTH)[1].select("capture", "run", "a", "b", "event", "since")


@query
def open_waits(spark, d):
    return coverage.open_waits(moves(spark, d), HI)


# Rollups


def _rollup(spark, d):
    return rollup.build(annotated(spark, d), HOUR, UNIT)


@query
def rollup_build(spark, d):
    return _rollup(spark, d).select("tick", "old_event", "pid", "query_id", "time", "n", "full", "longest")


@query
def rollup_aas(spark, d):
    return rollup.aas(_rollup(spark, d), HOUR, LO, HI, 6)


@query
def rollup_time_model(spark, d):
    return rollup.time_model(_rollup(spark, d), HOUR, LO, HI)


@query
def rollup_top_events(spark, d):
    return rollup.top_events(_rollup(spark, d), HOUR, LO, HI, UNIT)


@query
def rollup_top_sessions(spark, d):
    return rollup.top_sessions(_rollup(spark, d), HOUR, LO, HI)


@query
def rollup_top_queries(spark, d):
    return rollup.top_queries(_rollup(spark, d), HOUR, LO, HI)


@query
def rollup_heatmap(spark, d):
    return rollup.heatmap(_rollup(spark, d), HOUR, LO, HI, 6)


@query
def rollup_transitions(spark, d):
    m = moves(spark, d)
    return rollup.transitions(rollup.transition_rollup(m, DAY), m, DAY, LO + HOUR, HI - HOUR)


@query
def rollup_nodes(spark, d):
    m = moves(spark, d)
    return rollup.nodes(rollup.transition_rollup(m, DAY), m, DAY, LO + HOUR, HI - HOUR)


@query
def trailing_windows(spark, d):
    return rollup.trailing(moves(spark, d), HI, {"d1": DAY, "d7": 7 * DAY, "d40": 40 * DAY}, LO)


@query
def snapshot_deltas(spark, d):
    m = moves(spark, d).groupBy("old_event", F.expr(f"ts div {DAY}").alias("tick")).agg(F.sum("dur").alias("t"))
    total = m.select("tick", "old_event", F.sum("t").over(Window.partitionBy("old_event").orderBy("tick")).alias("total"))
    return rollup.snapshot_delta(total, 7)


# Anomaly rules, live forms, texts


def _ticks(spark, d, captures=1):
    e = table(spark, d, "events").select(F.col("user_id").alias("pid"), "event_id", micros("ts").alias("us"), F.col("event_type"))
    name = F.lit("main") if captures == 1 else F.concat(F.lit("c"), F.col("pid") % captures)
    s = e.select(name.alias("capture"), F.expr(f"us div {6 * HOUR}").alias("ts"), "pid", mapped("event_type", STATES).cast("long").alias("old_event"))
    return anomaly.tick_metrics(annotate.tag_backend(s, backends(spark, d)))


@query
def tick_metrics(spark, d):
    return _ticks(spark, d)


@query
def anomaly_decisions(spark, d):
    t = _ticks(spark, d, 16).withColumn("tick", F.col("tick").cast("double")).withColumn("capacity", F.lit(3.0))
    return anomaly.anomalies(t, stretch_s=16.0)


@query
def cpu_cusum(spark, d):
    return anomaly.cusum(_ticks(spark, d).withColumn("capacity", F.lit(10.0)), 0.8, 1.25).select("capture", "tick", "cusum")


def _escalations(spark, d):
    m = marked(spark, d)
    kind = F.when(F.col("marker") == "EXEC_START", "ESCALATE_START").when(F.col("marker") == "EXEC_END", "ESCALATE_END")
    return m.withColumn("marker", kind).withColumn("capture", F.col("pid").cast("string"))


@query
def escalation_windows(spark, d):
    return anomaly.escalations(_escalations(spark, d))


@query
def budget_audit(spark, d):
    w = moves(spark, d).select(F.lit("main").alias("capture"), F.col("seq").alias("id"), F.col("start").alias("s"), F.col("ts").alias("e"))
    return anomaly.budget_audit(w, HOUR, 2 * HOUR, HOUR)


@query
def budget_audit_open(spark, d):
    """The same with windows that have no end yet, one in 29, and a budget of a fifth."""
    e = F.when(F.col("seq") % 29 != 0, F.col("ts"))
    w = moves(spark, d).select(F.lit("main").alias("capture"), F.col("seq").alias("id"), F.col("start").alias("s"), e.alias("e"))
    return anomaly.budget_audit(w, HOUR, 4000 * HOUR, HOUR)


@query
def active_states(spark, d):
    return live.active_batch(moves(spark, d))


@query
def query_texts(spark, d):
    return texts.text_keys(table(spark, d, "documents").select("text")).select("normal", "n_rows", "n_texts")


@query
def lifo_pairs(spark, d):
    m = marked(spark, d).filter("marker is not null")
    k = F.col("marker")
    p = pair_lifo(m.select("pid", "ts", "seq", "marker"), ["pid"], ["ts", "seq"], k == "EXEC_START", k == "EXEC_END", k == "CMD_END")
    return p.filter("kind = 'start'").select("pid", "seq", "level", "c_seq", "closed_by")
