"""DuckDB SQL for the registered queries, over the given tables alone.

Joins on time here are plain inequalities: they check the binned joins independently.
"""

from dwell.functions.rules import NON_COMMAND_CPU
from dwell.plans.base import BACKENDS, DAY, HI, HOUR, LO, MARKERS, STATES, UNIT

MID = LO + 15 * DAY
CLASSES = ["cpu", "io", "lock", "lwlock", "ipc", "client", "timeout", "bufferpin", "activity", "extension", "unknown"]
IDLE = STATES["signup"]


def case(column: str, values: dict) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    return f"case {column} " + " ".join(f"when '{k}' then {lit(v)}" for k, v in values.items()) + " end"


IV = f"""
ev as (select event_id, user_id, event_type, value, epoch_us(ts) as us, cast(json_extract_string(props, '$.k') as bigint) as k from events),
iv0 as (select *, lag(us) over w as start, lag(event_type) over w as prev from ev window w as (partition by user_id order by us, event_id)),
iv as (select 2 * event_id as seq, us as ts, start, us - start as dur, user_id as pid, cast({case('prev', STATES)} as bigint) as old_event,
              cast({case('event_type', STATES)} as bigint) as new_event, k as query_id,
              case when prev = 'view' then cast(floor((us - start) * value / 500) as bigint) end as cpu,
              {case('prev', dict(view='cpu', click='io', error='lock', purchase='lwlock', signup='client'))} as class, prev = 'signup' as idle
       from iv0 where start is not null),
mk as (select 2 * event_id + 1 as seq, us as ts, user_id as pid, k as query_id, {case('event_type', MARKERS)} as marker from ev where event_type <> 'view'),
be as (select c_custkey as pid, {case('c_mktsegment', BACKENDS)} as type, c_name as usr, cast(c_nationkey as varchar) as db from customer),
cat as (select iv.*, case when type is null then 'foreground' when type = 'io_worker' then 'io_worker' when type = 'autovac_worker' then 'maintenance'
                when type in ('client', 'parallel_worker') then 'foreground' else 'background' end as backend
        from iv left join be using (pid))"""


def lat(d: str, unit: int = UNIT) -> str:
    return "case " + " ".join(f"when {d} < {unit * (1 << b) if b else unit} then {b}" for b in range(15)) + " else 15 end"


def wall(lo, hi, s="start", e="ts") -> str:
    return f"greatest(least({e}, {hi}) - greatest({s}, {lo}), 0)"


def big(x: str) -> str:
    return f"cast({x} as bigint)"


def q(body: str, more: str = "") -> str:
    return f"with {IV.strip()}{more}\n{body}"


def buckets(src: str, width: int, lo: int = LO, hi: int = HI) -> str:
    """CTE sp: rows of src split over buckets, by an inequality join."""
    n = -(-(hi - lo) // width)
    return f""",
bk as (select b, {lo} + b * {width} as bs, least({lo} + (b + 1) * {width}, {hi}) as bn from range({n}) r(b)),
sp as (select x.*, b as bucket, least(ts, bn) - greatest(start, bs) as part, greatest(start, bs) as b_lo, least(ts, bn) as b_hi from {src} x join bk on start < bn and ts > bs)"""


W120, W60, W30 = (HI - LO) // 120, (HI - LO) // 60, (HI - LO) // 30


def aas_cols(width: int, alias: str = "") -> str:
    return ", ".join(f"coalesce(sum(part) filter (where class = '{c}'), 0) / cast({width} as double) as {alias}{c}" for c in CLASSES)


def measured(lo: str, hi: str) -> str:
    """Of [lo, hi), measured CPU where a row on CPU has it (cumulative, rounded half up, at most the stretch), else all."""
    upto = lambda t: f"(2 * cpu::hugeint * ({t} - start) + dur) // (2 * dur)"
    return f"(case when old_event = 0 and cpu is not null and dur > 0 then least({upto(hi)} - {upto(lo)}, {hi} - {lo}) else {hi} - {lo} end)"


LOAD = buckets("(select * from cat where not idle and backend <> 'io_worker')", W120)
AAS_WALL = q(f"select b as bucket, {aas_cols(W120)}, coalesce(sum(part), 0) / cast({W120} as double) as total from bk left join sp on b = bucket group by b", LOAD)


def used_cols(width: int) -> str:
    return ", ".join(f"{big(f"coalesce(sum(used) filter (where class = '{c}'), 0)")} / cast({width} as double) as {c}" for c in CLASSES)


USED = f", us as (select *, {measured('b_lo', 'b_hi')} as used from sp)"
AAS = q(
    f"""select b as bucket, {used_cols(W120)},
    {big('coalesce(sum(part - used), 0)')} / cast({W120} as double) as off_cpu, coalesce(sum(part), 0) / cast({W120} as double) as total from bk left join us on b = bucket group by b""",
    LOAD + USED,
)

SPANS = f""",
spans as (select cast(pid as varchar) as capture, start + {HOUR} as s, ts + {HOUR} as e from iv where class = 'lwlock'),
win as (select cast(o_custkey as varchar) as capture, o_orderkey as window_id, {LO} + (o_orderkey * 7919 % 720) * {HOUR} as lo, {LO} + (o_orderkey * 7919 % 720) * {HOUR} + 12 * {HOUR} as hi from orders)"""


def islands(src: str, keys: str, s: str = "s", e: str = "e", name: str = "isl") -> str:
    part = f"partition by {keys} " if keys else ""
    g = f"{keys}, " if keys else ""
    return f""",
{name}0 as (select *, max({e}) over ({part}order by {s}, {e} rows between unbounded preceding and 1 preceding) as before from (select distinct * from {src}) where {s} < {e}),
{name}1 as (select *, sum(case when before is null or {s} > before then 1 else 0 end) over ({part}order by {s}, {e} rows unbounded preceding) as g from {name}0),
{name} as (select {g}min({s}) as {s}, max({e}) as {e} from {name}1 group by {g}g)"""


def percentile(p: float) -> str:
    """Nearest rank over the exact values, then the upper edge of its bucket."""
    pick = f"list_sort(list(dur))[greatest(1, cast(ceil(count(*) * {p}) as bigint))]"
    return f"cast({UNIT} as bigint) << least({lat(pick)}, 14)"


def above(p: float) -> str:
    """Whether a percentile lies in the open last bucket, so that it is no more than a lower bound."""
    return f"list_sort(list(dur))[greatest(1, cast(ceil(count(*) * {p}) as bigint))] >= cast({UNIT} as bigint) << 14"


MOVES = f"(select * from iv where ts >= {LO} and ts < {HI})"

#: Pairs of nested starts and ends: an end belongs to the nearest start before it between which the depth is balanced.
LIFO = """,
x as (select *, sum(case when marker = 'CMD_END' then 1 else 0 end) over (partition by pid order by ts, seq rows unbounded preceding) as epoch from mk),
st as (select * from x where marker = 'EXEC_START'), en as (select * from x where marker = 'EXEC_END'),
bal as (select s.pid, s.seq as s_seq, e.seq as e_seq, e.ts as e_ts,
          (select count(*) from st y where y.pid = s.pid and y.epoch = s.epoch and (y.ts, y.seq) >= (s.ts, s.seq) and (y.ts, y.seq) < (e.ts, e.seq)) as n_s,
          (select count(*) from en y where y.pid = s.pid and y.epoch = s.epoch and (y.ts, y.seq) > (s.ts, s.seq) and (y.ts, y.seq) <= (e.ts, e.seq)) as n_e
        from st s join en e on s.pid = e.pid and s.epoch = e.epoch and (e.ts, e.seq) > (s.ts, s.seq)),
pr as (select pid, s_seq, min(e_seq) as e_seq, min(e_ts) as e_ts from bal where n_s = n_e group by pid, s_seq),
rs as (select s.pid, s.seq as s_seq, min(r.seq) as r_seq, min(r.ts) as r_ts from st s join mk r on r.pid = s.pid and r.marker = 'CMD_END' and (r.ts, r.seq) > (s.ts, s.seq) group by all),
runs as (select s.pid, s.seq as e_seq, s.ts as e_start, s.query_id, coalesce(pr.e_ts, rs.r_ts) as e_end, coalesce(pr.e_seq, rs.r_seq) as c_seq,
                case when pr.e_seq is not null then 'end' when rs.r_seq is not null then 'reset' end as closed_by
         from st s left join pr on pr.s_seq = s.seq left join rs on rs.s_seq = s.seq)"""

OV = "least(a.ts, b.ts) - greatest(a.start, b.start)"

ORACLES = {
    "interval_window": q(f"select seq, pid, start, ts, old_event from iv where ts >= {MID} and start <= {MID + DAY}"),
    "uniform_filter": q("select seq, pid, dur from iv where class = 'io' and dur <= ts"),
    "window_clip": q(f"select pid, {big('sum(' + wall(MID, MID + DAY) + ')')} as wall from iv group by pid"),
    "window_instants": q(f"select pid, count(*) as n from (select pid, ts from iv where ts >= {MID} and ts < {MID + DAY} union all select pid, ts from mk where ts >= {MID} and ts <= {MID + DAY}) group by pid"),
    "cpu_share_by_day": q(
        f"""select bucket, {big('sum(sh)')} as cpu, {big('sum(greatest(part - sh, 0))')} as off_cpu from (
        select *, (2 * cpu::hugeint * (b_hi - start) + dur) // (2 * dur) - (2 * cpu::hugeint * (b_lo - start) + dur) // (2 * dur) as sh from sp) group by bucket""",
        buckets("(select * from iv where cpu is not null)", DAY),
    ),
    "sample_weights": q(
        f"""select capture, seq, t.tick as ts, {big('least(coalesce(tick - prev, ' + str(UNIT * 10) + '), ' + str(24 * HOUR) + ')')} as dur from sm join t using (capture, tick)""",
        f""",
sm as (select event_type as capture, event_id as seq, us // {UNIT * 10} * {UNIT * 10} as tick from ev),
t as (select capture, tick, lag(tick) over (partition by capture order by tick) as prev from (select distinct capture, tick from sm))""",
    ),
    "clock_mapping": q("select seq, start - min(start) over (partition by pid) as start, ts - min(start) over (partition by pid) as ts from iv"),
    "class_and_latency": q(f"select class, {lat('dur')} as latency, count(*) as n from iv group by all"),
    "backend_tags": q(f"select backend, count(*) as n, {big('sum(dur)')} as time from cat group by backend"),
    "phase_tags": q(
        """select seq, false as in_plan, coalesce(e, false) as in_exec,
        case when backend <> 'foreground' then backend when coalesce(e, false) then 'exec' else 'command' end as category
        from (select cat.seq, backend, (select m.marker = 'EXEC_START' from mk m where m.pid = cat.pid and m.marker in ('EXEC_START', 'EXEC_END', 'CMD_END') and (m.ts, m.seq) < (cat.ts, cat.seq)
              order by m.ts desc, m.seq desc limit 1) as e from cat)"""
    ),
    "aas": AAS,
    "aas_peak": f"select max(total) as max_aas from ({AAS})",
    "aas_by_category": q(
        f"select category, bucket, sum(part) / cast({W30} as double) as aas from sp group by all",
        """,
ph as (select cat.*, (select m.marker = 'EXEC_START' from mk m where m.pid = cat.pid and m.marker in ('EXEC_START', 'EXEC_END', 'CMD_END') and (m.ts, m.seq) < (cat.ts, cat.seq)
              order by m.ts desc, m.seq desc limit 1) as e from cat),
ct as (select *, case when backend <> 'foreground' then backend when coalesce(e, false) then 'exec' else 'command' end as category from ph where not idle)""" + buckets("ct", W30),
    ),
    "aas_by_event": q(
        f"select old_event, bucket, sum(part) / cast({W60} as double) as aas from sp where old_event in (select old_event from iv where not idle group by 1 order by sum(dur) desc, 1 limit 3) group by all",
        buckets("(select * from iv where not idle)", W60),
    ),
    "time_model": q(
        f"""select label, parent, {big('time')} as time, case when label <> 'Idle' and parent <> 'Idle' then 100.0 * time::double / db::double end as pct, time::double / {HI - LO} as aas from (
        select 'DB Time' as label, '' as parent, sum(t) as time from s where not idle
        union all select class, 'DB Time', sum(t) from s where not idle and class <> 'cpu' group by class
        union all select case when m then 'CPU (running)' else 'CPU*' end, 'DB Time', u from c where u > 0 or (m and t > u)
        union all select 'CPU (waiting for a core)', 'DB Time', t - u from c where m
        union all select cast(old_event as varchar), class, t from (select old_event, class, sum(t) as t, row_number() over (partition by class order by sum(t) desc, old_event) as rn from s where not idle and class <> 'cpu' group by old_event, class) where rn <= 5
        union all select 'Idle', '', sum(t) from s where idle
        union all select case when class = 'activity' then 'Other idle' else cast(old_event as varchar) end, 'Idle', sum(t) from s where idle group by all), (select sum(t) as db from s where not idle)""",
        f""", s as (select *, ts - start as t, {measured('start', 'ts')} as u from cat where backend <> 'io_worker'),
        c as (select sum(t) as t, sum(u) as u, bool_or(cpu is not null and t > 0) as m from s where class = 'cpu')""",
    ),
    "category_time": q(
        f"""select backend, {big('sum(dur)')} as time, count(distinct pid) as pids, case when backend = 'io_worker' then 100.0 * sum(dur)::double / (count(distinct pid) * {HI - LO}) end as busy_pct from cat where not idle group by backend"""
    ),
    "cpu_checks": q(f"select {big('coalesce(sum(greatest(cpu - dur, 0)), 0)')} as clamped, {big('0')} as in_waits, {big('coalesce(sum(greatest(dur - cpu, 0)), 0)')} as off_cpu from iv where cpu is not null"),
    "top_events": q(
        f"""select old_event, count(*) as n, {big('sum(u)')} as time, avg(dur) as avg_dur, max(dur) as max_dur, {percentile(.5)} as p50, {percentile(.95)} as p95, {percentile(.99)} as p99,
        {above(.5)} as p50_above, {above(.95)} as p95_above, {above(.99)} as p99_above,
        case when not bool_or(idle) then 100.0 * sum(u)::double / (select sum(dur) from iv where not idle) end as pct, sum(u)::double / {HI - LO} as aas from (select *, {measured('start', 'ts')} as u from iv) group by old_event"""
    ),
    "top_sessions": q(
        f"""select pid, {big('sum(t)')} as db_time, 100.0 * coalesce(sum(u) filter (where old_event = 0), 0)::double / sum(t) as cpu_pct, 100.0 * coalesce(sum(t) filter (where old_event <> 0), 0)::double / sum(t) as wait_pct,
        {big('sum(t - u)')} as off_cpu, first(old_event order by t desc, old_event) filter (where old_event <> 0 and t > 0) as top_wait
        from (select pid, old_event, sum(dur) as t, sum({measured('start', 'ts')}) as u from iv where not idle group by all) group by pid having sum(t) > 0"""
    ),
    "top_queries": q(
        f"""select query_id, {big('sum(n)')} as n, sum(d)::double / sum(n) as avg_dur, {big('sum(t)')} as time, 100.0 * sum(t)::double / (select sum(t) from g) as pct,
        {', '.join(big("coalesce(sum(t) filter (where class = '" + c + "'), 0)") + f' as {c}_time' for c in CLASSES)},
        nullif(first(old_event order by t desc, old_event = 0, old_event), 0) as top_wait, string_agg(cast(old_event as varchar), ',' order by t desc, old_event) as events from g group by query_id""",
        ", g as (select query_id, class, old_event, sum(dur) as t, count(*) as n, sum(dur) as d from iv where not idle and query_id <> 0 group by all)",
    ),
    "heatmap": q(f"select (ts - {LO}) // {-(-(HI - LO) // 200)} as bucket, {lat('dur')} as latency, count(*) as n from cat where backend <> 'io_worker' group by all"),
    "event_histogram": q(
        """select old_event, latency, n, 100.0 * n / sum(n) over (partition by old_event)::double as pct,
        100.0 * sum(n) over (partition by old_event order by latency)::double / sum(n) over (partition by old_event)::double as cum_pct from h""",
        f", h as (select old_event, {lat('dur')} as latency, count(*) as n from iv group by all)",
    ),
    "query_event_pairs": q(f"select query_id, old_event, count(*) as n, {big('sum(dur)')} as time from iv where not idle and query_id <> 0 group by all"),
    "queries_of_event": q(f"select query_id, old_event, count(*) as n, {big('sum(dur)')} as time from iv where old_event = {STATES['error']} and query_id <> 0 group by all"),
    "events_of_query": q(f"select query_id, old_event, count(*) as n, {big('sum(dur)')} as time from iv where not idle and query_id = 7 group by all"),
    "record_counts": q("select count(*) as n, min(start) as first, max(ts) as last, count(distinct pid) as pids from iv"),
    "transitions": q(f"select old_event, new_event, count(*) as n, {big('sum(dur)')} as time from {MOVES} group by all"),
    "transition_nodes": q(
        f"""select event, {big('coalesce(n, 0)')} as n, {big('coalesce(time, 0)')} as time, {big('coalesce(entered, 0)')} as entered, {big('0')} as sampled, event = {IDLE} as idle
        from (select old_event as event, count(*) as n, sum(dur) as time from iv group by 1) full join (select new_event as event, count(*) as entered from iv group by 1) using (event)"""
    ),
    "transition_matrix": q(
        f"""select old_event, new_event, n, time, {big('(select sum(n) from t) - sum(n) over ()')} as hidden from t where old_event in (select event from best) and new_event in (select event from best)""",
        f""",
t as (select old_event, new_event, count(*) as n, {big('sum(dur)')} as time from iv group by all),
best as (select event from (select old_event as event, n from t union all select new_event, n from t where old_event <> new_event) group by 1 order by sum(n) desc, 1 limit 3)""",
    ),
    "graph_pruning": q(
        f"""select old_event, new_event, n, time, {big('(select count(*) from t where n * 100.0 < m * 95.0)')} as hidden_edges, {big('(select coalesce(sum(n), 0) from t where n * 100.0 < m * 95.0)')} as hidden_n,
        (select e from nd where not k order by n desc, e limit 1) as hidden_node, (select e from nd order by time desc, e limit 1) as longest_node from t where n * 100.0 >= m * 95.0""",
        f""", t as (select *, max(n) over () as m from (select old_event, new_event, count(*) as n, {big('sum(dur)')} as time from iv where old_event <> {IDLE} and new_event <> {IDLE} group by all)),
        nd as (select e, sum(n) as n, sum(time) as time, bool_or(k) as k from (select old_event as e, n, time, n * 100.0 >= m * 95.0 as k from t union all select new_event, n, 0, n * 100.0 >= m * 95.0 from t) group by e)""",
    ),
    "fingerprints": q(
        """select query_id, signature, shares, coalesce(n, 0) as n, top_transition from (
          select query_id, string_agg(class, '>' order by pct desc, class) as signature, string_agg(cast(m as varchar), ',' order by pct desc, class) as shares from (
            select query_id, class, 100.0 * sum(dur)::double / sum(sum(dur)) over (partition by query_id)::double as pct, cast(1000 * sum(dur) // sum(sum(dur)) over (partition by query_id) as bigint) as m from iv where query_id <> 0 group by query_id, class) where pct >= 1 group by query_id)
        left join (select query_id, cast(sum(n) as bigint) as n, first(old_event || '>' || new_event order by n desc, old_event, new_event) as top_transition
                   from (select query_id, old_event, new_event, count(*) as n from iv group by all) group by query_id) using (query_id)"""
    ),
    "concurrency_peaks": q(
        "select bucket, max(pids) as peak, first(old_event order by pids desc, old_event) as event from (select bucket, old_event, count(distinct pid) as pids from sp group by all) group by bucket",
        buckets("(select * from iv where old_event <> 0 and not idle)", W60),
    ),
    "lock_chains": q(
        f"""select wait_seq, waiter, holder, overlap from (select a.seq as wait_seq, a.pid as waiter, b.pid as holder, {OV} as overlap,
        row_number() over (partition by a.seq order by {OV} desc, b.pid, b.seq) as rn from iv a join iv b on a.class = 'lock' and b.class = 'cpu' and a.pid <> b.pid and a.start < b.ts and b.start < a.ts) where rn = 1"""
    ),
    "interference": q(
        f"""select pid_a, pid_b, {big('sum(o)')} as overlap, sum(o)::double / max(sum(o)) over ()::double as score, first(old_event order by o desc, old_event) as top_event
        from (select a.pid as pid_a, b.pid as pid_b, a.old_event, {OV} as o from iv a join iv b on a.old_event = b.old_event and a.old_event <> 0 and not a.idle and a.pid < b.pid and a.start < b.ts and b.start < a.ts) group by all"""
    ),
    "lifo_pairs": q("select r.pid, e_seq as seq, level, c_seq, closed_by from runs r join lv on lv.seq = r.e_seq", LIFO + """,
ow as (select s_seq, pid, e_seq from pr),
lv as (select s.seq, 1 + (select count(*) from runs o where o.pid = s.pid and (o.e_start, o.e_seq) < (s.ts, s.seq) and (o.c_seq is null or o.c_seq > s.seq)) as level from st s)"""),
    "query_lifecycle": q(
        """select query_id, 'EXEC' as phase, count(*) as n, cast(sum(d) as bigint) as time, avg(d) as avg_dur,
        list_sort(list(d))[1 + case when count(*) > 20 then cast(floor((count(*) - 1) * cast(0.95 as double)) as bigint) else count(*) - 1 end] as p95,
        list_sort(list(d))[1 + case when count(*) > 100 then cast(floor((count(*) - 1) * cast(0.99 as double)) as bigint) else count(*) - 1 end] as p99
        from (select query_id, e_end - e_start as d from runs where closed_by = 'end' and query_id <> 0) group by query_id""",
        LIFO,
    ),
    "execution_slices": q(
        f"""select r.pid, r.e_seq, iv.seq, old_event, greatest(e_start, start) as s, least(coalesce(e_end, {HI}), ts) as e, dur,
        case when cpu is not null then {measured('greatest(e_start, start)', f'least(coalesce(e_end, {HI}), ts)')} end as cpu, count(*) over (partition by r.e_seq) as total
        from runs r join iv on iv.pid = r.pid and start < coalesce(e_end, {HI}) and ts > e_start where e_start < coalesce(e_end, {HI})""",
        LIFO,
    ),
    "session_timeline": q(
        f"""select pid, class, min(start) as s, max(ts) as e, count(*) as n from (select *, sum(new) over (partition by pid order by start, seq rows unbounded preceding) as bar from (
        select *, case when lag(class) over w = class and start - max(ts) over (partition by pid order by start, seq rows between unbounded preceding and 1 preceding) <= {HOUR} then 0 else 1 end as new
        from iv window w as (partition by pid order by start, seq))) group by pid, bar, class"""
    ),
    "timeline_density": q(
        f"select pid, bucket, class, {big('sum(part)')} as time, count(*) as spans, {big('sum(sum(part)) over (partition by pid, bucket)')} as column_time, sum(part)::double / sum(sum(part)) over (partition by pid, bucket)::double as share from sp group by pid, bucket, class",
        buckets("(select * replace (greatest(ts, start + 1) as ts) from iv)", W60),
    ),
    "text_by_context": """select db, "user", query, text from (select p_brand as db, p_type as "user", p_partkey % 10 as query, p_name as text,
        row_number() over (partition by p_brand, p_type, p_partkey % 10 order by case when p_size < 10 then 0 when p_size < 30 then 1 else 2 end, p_partkey desc, p_name) as rn from part) where rn = 1""",
    "text_by_query": "select p_partkey as query, min(p_name) as text from part group by 1 having count(distinct p_name) = 1",
    "query_contexts": q(
        """select query_id * 150 + pid as query_id, case when not bool_or(db is null) then min(db) end as db, case when not bool_or(db is null) then min(usr) end as "user", bool_or(db is null) as ambiguous
        from (select distinct query_id * 150 + pid as qq, query_id, pid from iv where query_id * 150 + pid <> 0) left join be using (pid) group by 1"""
    ),
    "ab_compare": q(
        f"""select entity, a, b, b - a as delta, abs(b - a) as change, case when a > 0 and b > 0 then b / a::double end as ratio, status, greatest(a, b) < greatest(cast(0.0005 as double) * sum(a) over (), 50000) as below_floor from (
        select entity, {big('coalesce(x, 0)')} as a, {big('coalesce(y, 0)')} as b, case when x is null then 'new' when y is null then 'gone' else 'both' end as status from
        (select pid || ':' || old_event as entity, sum({wall(LO, MID)}) as x from iv where not idle and start < {MID} and ts > {LO} group by 1)
        full join (select pid || ':' || old_event as entity, sum({wall(MID, HI)}) as y from iv where not idle and start < {HI} and ts > {MID} group by 1) using (entity))"""
    ),
    "window_additivity": "select cast(0 as bigint) as old_event, cast(0 as bigint) as n, cast(0 as bigint) as time where false",
    "window_fidelity": q(
        f"""select capture, window_id, ex as exact, sa as sampled, case when ex >= hi - lo - {HOUR} then 'exact' when ex <= {HOUR} and sa > 0 then 'sampled' when ex + sa > 0 then 'mixed' else 'none' end as fidelity
        from (select win.*, {big('coalesce((select sum(least(e, hi) - greatest(s, lo)) from xi where xi.capture = win.capture and s < hi and e > lo), 0)')} as ex,
              {big('coalesce((select sum(least(e, hi) - greatest(s, lo)) from si where si.capture = win.capture and s < hi and e > lo), 0)')} as sa from win)""",
        SPANS + islands("spans", "capture", name="xi") + ",\nsm as (select cast(pid as varchar) as capture, start as s, ts as e from iv where class = 'cpu')" + islands("sm", "capture", name="si"),
    ),
    "exact_gaps": q(
        """select capture, e as g_start, nx as g_end, case when exists (select 1 from iv where class = 'lock' and cast(pid as varchar) = capture and ts between e and nx) then 'restart' else 'coverage' end as reason
        from (select *, lead(s) over (partition by capture order by s) as nx from xi) where nx is not null""",
        SPANS + islands("spans", "capture", name="xi"),
    ),
    "span_coalesce": "with sh as (select l_suppkey, epoch_us(l_shipdate) as s, epoch_us(l_shipdate) + " + str(2 * DAY) + " as e from lineitem)" + islands("sh", "l_suppkey") + " select * from isl",
    "span_subtract": q(
        """select capture, id, p.s, p.e from (select a.capture, a.s as id, unnest(list_transform(range(len(cuts) + 1),
             lambda k: {'s': case when k = 0 then a.s else cuts[k].e end, 'e': case when k = len(cuts) then a.e else cuts[k + 1].s end})) as p
           from (select sm.*, coalesce((select list({'s': x.s, 'e': x.e} order by x.s) from xi x where x.capture = sm.capture and x.s < sm.e and x.e > sm.s), []) as cuts from sm) a) where p.s < p.e""",
        SPANS + islands("spans", "capture", name="xi") + ",\nsm as (select cast(pid as varchar) as capture, start as s, ts as e from iv where class = 'cpu')",
    ),
    "uncovered_buckets": q(
        f"""select b as bucket from range(720) r(b) where {HOUR} > coalesce((select sum(least(e, {LO} + (b + 1) * {HOUR}) - greatest(s, {LO} + b * {HOUR})) from isl where s < {LO} + (b + 1) * {HOUR} and e > {LO} + b * {HOUR}), 0)""",
        f",\nsx as (select start as s, start + dur // 8 as e from iv where class = 'lwlock')" + islands("sx", ""),
    ),
    "bounded_omission": q(
        f"""select boot, k, {big('coalesce(seen, 0)')} as seen, n, u, case when n is null then 'uncertified' when u = 0 then 'complete' when u <= cast(0.1 as double) * n then 'bounded' else 'exceeded' end as verdict
        from (select old_event as boot, (start - {LO}) // {DAY} as k, count(*) as n, {big('count(*) filter (where dur > ' + str(30 * HOUR) + ')')} as u from iv group by all)
        full join (select old_event as boot, (ts - {LO}) // {DAY} as k, count(*) as seen from iv group by all) using (boot, k)"""
    ),
    "source_frontier": q(f"select event_type as source, event_id as o, us as t, row_number() over (order by us, user_id, n, event_type, event_id) as position from (select *, row_number() over (partition by event_type order by event_id) + case when event_id % 97 = 0 then 1 else 0 end as n from ev) where us < (select min(m) from (select max(us) - {HOUR} as m from ev group by event_type))"),
    "stream_faults": q(
        """select source, o, unnest(list_filter([case when q > pq + 1 then 'gap' end, case when q <= pq then 'reuse' end, case when t < pt then 'clock' end, case when tie then 'tie' end], lambda x: x is not null)) as fault
        from (select *, lag(q) over w as pq, lag(t) over w as pt from (select event_type as source, event_id as o, us as t, min(event_type) over (partition by user_id, us) < max(event_type) over (partition by user_id, us) as tie,
          row_number() over (partition by event_type order by event_id) + case when event_id % 97 = 0 then 1 else 0 end as q from ev) window w as (partition by source order by o))"""
    ),
    "open_waits": q(f"select pid, event, since, {HI} - since as open_time from (select pid, new_event as event, ts as since, row_number() over (partition by pid order by ts desc, seq desc) as rn from iv) where rn = 1"),
    "rollup_build": q(
        f"""select tick, old_event, pid, query_id, {big('coalesce(t, 0)')} as time, {big('coalesce(n, 0)')} as n, {big('coalesce(f, 0)')} as "full", {big('coalesce(l, 0)')} as longest from
        (select tick, old_event, pid, query_id, sum(least(ts, (tick + 1) * {HOUR}) - greatest(start, tick * {HOUR})) as t from (select *, unnest(range(start // {HOUR}, (ts - 1) // {HOUR} + 1)) as tick from cat where backend <> 'io_worker') group by all)
        full join (select ts // {HOUR} as tick, old_event, pid, query_id, count(*) as n, sum(dur) as f, max(dur) as l from cat where backend <> 'io_worker' group by all) using (tick, old_event, pid, query_id)"""
    ),
    "rollup_aas": AAS_WALL,
    "rollup_time_model": q(f"select case when idle then 'Idle' else class end as label, {big('sum(dur)')} as time from cat where backend <> 'io_worker' group by 1"),
    "rollup_top_events": q(f"select old_event, count(*) as n, {big('sum(dur)')} as time, max(dur) as max_dur, {percentile(.95)} as p95 from cat where backend <> 'io_worker' group by 1"),
    "rollup_top_sessions": q(f"select pid, {big('sum(dur)')} as db_time, {big('coalesce(sum(dur) filter (where old_event = 0), 0)')} as cpu from cat where backend <> 'io_worker' and not idle group by 1 having sum(dur) > 0"),
    "rollup_top_queries": q(f"select query_id, count(*) as n, {big('sum(dur)')} as time from cat where backend <> 'io_worker' and not idle and query_id <> 0 group by 1"),
    "rollup_heatmap": q(f"select (ts // {HOUR} - {LO // HOUR}) // 6 as bucket, {lat('dur')} as latency, count(*) as n from cat where backend <> 'io_worker' group by all"),
    "rollup_transitions": q(f"select old_event, new_event, count(*) as n, {big('sum(dur)')} as time from iv where ts >= {LO + HOUR} and ts < {HI - HOUR} group by all"),
    "rollup_nodes": q(
        f"""select event, {big('sum(n)')} as n, {big('sum(time)')} as time, {big('sum(entered)')} as entered, {big('0')} as sampled_time from (
        select old_event as event, 1 as n, dur as time, 0 as entered from w union all select new_event, 0, 0, 1 from w) group by event""",
        f", w as (select * from iv where ts >= {LO + HOUR} and ts < {HI - HOUR})",
    ),
    "trailing_windows": q(f"select old_event, {big('sum(' + wall(HI - DAY, HI) + ')')} as d1, {big('sum(' + wall(HI - 7 * DAY, HI) + ')')} as d7, cast(null as bigint) as d40 from iv group by 1"),
    "snapshot_deltas": q(
        f"""select tick, old_event, {big('greatest(total - lag(total, 7) over (partition by old_event order by tick), 0)')} as delta from (select old_event, tick, sum(t) over (partition by old_event order by tick) as total
        from (select old_event, ts // {DAY} as tick, sum(dur) as t from iv group by all))"""
    ),
    "tick_metrics": q(
        f"""select 'main' as capture, tick, count(*)::double as aas, count(*) filter (where event_type = 'error') / count(*)::double as lock_fraction, (count(*) filter (where event_type = 'view'))::double as cpu_aas
        from (select us // {6 * HOUR} as tick, event_type, type from ev left join be on be.pid = ev.user_id) where coalesce(type, '') <> 'io_worker' and event_type <> 'signup' group by tick"""
    ),
    "escalation_windows": q("select cast(pid as varchar) as capture, e_start as s, case when closed_by = 'end' then e_end end as e, query_id >> 8 as seconds, query_id & 255 as reason from runs", LIFO.replace("case when marker = 'CMD_END' then 1 else 0 end", "0").replace("left join rs on rs.s_seq = s.seq", "left join rs on false")),
    "budget_audit": q(
        f"""select 'main' as capture, id, used, least(e - s, greatest({2 * HOUR} - used, 0)) as granted from (select a.seq as id, a.start as s, a.ts as e,
        {big('coalesce((select sum(least(a.start, b.ts) - greatest(a.start - ' + str(HOUR) + ', b.start)) from w b where b.seq <> a.seq and b.start < a.start and b.ts > a.start - ' + str(HOUR) + '), 0)')} as used from w a)""",
        ",\nw as (select * from iv)",
    ),
    "active_states": q(
        f"""select pid, since, case when event = 0 then 'on_cpu' when event = {IDLE} then 'idle' else 'waiting' end as state, event, db_time from
        (select pid, first(ts order by ts desc, seq desc) as since, first(new_event order by ts desc, seq desc) as event, {big('coalesce(sum(dur) filter (where not idle), 0)')} as db_time from iv group by pid)"""
    ),
}

RUNS = """
select r.pid, r.e_seq, e_start, e_end, query_id, level, coalesce(closed_by = 'reset', false) as end_inferred, cast(null as bigint) as plan_dur,
       (select count(*) from iv where iv.pid = r.pid and start < coalesce(e_end, {hi}) and ts > e_start and e_start < coalesce(e_end, {hi})) as n_events, e_start < {lo} as before_window
from runs r join (select s.seq, 1 + (select count(*) from runs o where o.pid = s.pid and (o.e_start, o.e_seq) < (s.ts, s.seq) and (o.c_seq is null or o.c_seq > s.seq)) as level from st s) lv on lv.seq = r.e_seq
where e_start < {hi} and (e_end is null or e_end >= {lo})""".format(lo=LO, hi=HI)

LEFT = """
select {cols} from (select a.*, unnest(list_transform(range(len(cuts) + 1),
     lambda k: {{'s': case when k = 0 then a.s else cuts[k].e end, 'e': case when k = len(cuts) then a.e else cuts[k + 1].s end}})) as p
   from (select sm.*, coalesce((select list({{'s': x.s, 'e': x.e}} order by x.s) from xi x where x.capture = sm.capture and x.s < sm.e and x.e > sm.s), []) as cuts from sm) a) where p.s < p.e"""

ORACLES |= {
    "executions": q(RUNS, LIFO),
    "top_executions": q(f"select pid, e_seq, coalesce(e_end, {HI}) - e_start as dur from ({RUNS}) order by 3 desc, 1, 2 limit 100", LIFO),
    "exact_wins_merge": q(
        "select seq, pid, start, ts, false as is_sample, true as counts from iv where class = 'lwlock' union all" + LEFT.format(cols="seq, pid, p.s as start, p.e as ts, true as is_sample, p.e = e as counts"),
        SPANS + islands("spans", "capture", name="xi") + ",\nsm as (select seq, pid, cast(pid as varchar) as capture, start as s, ts as e from iv where class <> 'lwlock')",
    ),
    "in_command_majority": q(
        f"""select seq, case when state is null then 'unknown' when case when dur > 0 and least(ts, {HI}) > start then 2 * inside >= least(ts, {HI}) - start else state = 'CMD_START' end then 'inside' else 'outside' end as in_command from (select iv.*,
        (select m.marker from cm m where m.pid = iv.pid and (m.ts, m.seq) < (iv.ts, iv.seq) order by m.ts desc, m.seq desc limit 1) as state,
        coalesce((select sum(least(iv.ts, {HI}, coalesce(nx, {HI})) - greatest(iv.start, m.ts)) from cm m where m.pid = iv.pid and marker = 'CMD_START' and m.ts < least(iv.ts, {HI}) and coalesce(nx, {HI}) > iv.start), 0) as inside from iv)""",
        ",\ncm as (select *, lead(ts) over (partition by pid order by ts, seq) as nx from mk where marker in ('CMD_START', 'CMD_END'))",
    ),
    "ab_bucket_difference": q(
        "select bucket, " + ", ".join(f"a.{c} - b.{c} as {c}" for c in CLASSES) + " from a join b using (bucket)",
        buckets("(select * from cat where not idle and backend <> 'io_worker')", DAY // 2)
        + USED
        + f",\nal as (select b as bucket, {used_cols(DAY // 2)} from bk left join us on b = bucket group by b),\na as (select bucket - 30 as bucket, * exclude (bucket) from al where bucket >= 30),\nb as (select * from al where bucket < 30)",
    ),
    "sampled_vs_exact": q(
        """select old_event, coalesce(x, 0) as exact_pct, coalesce(s, 0) as sampled_pct, abs(coalesce(x, 0) - coalesce(s, 0)) as gap from
        (select old_event, 100.0 * sum(dur)::double / sum(sum(dur)) over ()::double as x from iv where not idle group by 1)
        full join (select old_event, 100.0 * sum(w)::double / sum(sum(w)) over ()::double as s from (select iv.*, least(greatest(ts - w0, {lo}), {hi}) as a, least(ts, {hi}) - greatest(ts - w0, {lo}) as w from iv join tk using (ts)) where not idle group by 1) using (old_event)""".format(lo=LO, hi=HI),
        f",\ntk as (select ts, least(coalesce(ts - lag(ts) over (order by ts), {UNIT}), {HOUR}) as w0 from (select distinct ts from iv))",
    ),
    "fidelity_ranges": q(
        """select kind, min(s) as s, max(e) as e from (select *, sum(case when kind = pk then 0 else 1 end) over (order by s) as g from (select *, lag(kind) over (order by s) as pk from (
        select s, e, case when exists (select 1 from xi where xi.s <= seg.s and xi.e >= seg.e) then 'exact' when exists (select 1 from sc where sc.s <= seg.s and sc.e >= seg.e) then 'sampled' else 'none' end as kind from seg))) group by g, kind""",
        f",\nsx as (select start as s, start + dur // 40 as e from iv where class = 'lwlock')"
        + islands("sx", "", name="xi")
        + f",\nsy as (select start as s, start + dur // 40 as e from iv where class = 'cpu')"
        + islands("sy", "", name="yi")
        + f""",
sc as (select * from yi where e - s > coalesce((select sum(least(xi.e, yi.e) - greatest(xi.s, yi.s)) from xi where xi.s < yi.e and xi.e > yi.s), 0) + {UNIT}),
pt as (select distinct least(greatest(t, {LO}), {HI}) as t from (select s as t from xi union all select e from xi union all select s from sc union all select e from sc union all select {LO} union all select {HI})),
seg as (select * from (select t as s, lead(t) over (order by t) as e from pt) where e is not null)""",
    ),
    "phase_capability": "with " + f"""
r as (select cast(user_id as varchar) as phase, epoch_us(ts) as start, case when event_type <> 'error' then case when value > 20 then 'available' else 'unavailable' end end as state from events),
l as (select *, lead(start) over w as nx, lead(state) over w as ns from r window w as (partition by phase order by start)),
h as (select phase, start as s, coalesce(nx, {HI}) as e, case when state is null or (nx is not null and ns is null) then 'unknown' else state end as state from l
      union all select phase, {LO}, min(start), 'unknown' from r group by phase),
c as (select phase, state, greatest(s, {LO}) as s, least(e, {HI}) as e from h)""" + islands("c", "phase, state") + " select * from isl",
    "wait_metrics": q(
        f"""select generation, window_id, case when covered = required then closed end as wait_time, case when covered = required and not (died >= lo and died < hi and not certified) then closes end as completed_waits,
        closed as closed_time, {big('0')} as open_time, covered, required, case when covered <> required then 'coverage_gap' when died >= lo and died < hi and not certified then 'exit_uncertified' end as reason, '' as invalid
        from (select *, {big('greatest(least(hi, died) - greatest(lo, born), 0)')} as required,
          {big('coalesce((select sum(least(e, hi, died) - greatest(s, lo, born)) from ci where ci.generation = w.generation and s < least(hi, died) and e > greatest(lo, born)), 0)')} as covered,
          {big('coalesce((select sum(least(ts, hi) - greatest(start, lo)) from iv where pid = w.generation and class = ' + chr(39) + 'lock' + chr(39) + ' and start < hi and ts > lo), 0)')} as closed,
          (select count(*) from iv where pid = w.generation and class = 'lock' and ts >= lo and ts < hi) as closes,
          exists (select 1 from iv where pid = w.generation and ts = w.died and dur < 100000000000) as certified
        from (select generation, window_id, lo, hi, born, died from (select cast(capture as bigint) as generation, window_id, lo, hi from win) join (select pid as generation, min(start) as born, max(ts) as died from iv group by 1) using (generation)) w)""",
        SPANS + ",\nck as (select pid as generation, start as s, ts as e from iv where dur < 100000000000)" + islands("ck", "generation", name="ci"),
    ),
}

IN_COMMAND = ORACLES["in_command_majority"]

ORACLES |= {
    "cpu_relabel": q(
        f"""select case when backend = 'foreground' and old_event = 0 and in_command = 'outside' then {NON_COMMAND_CPU} else old_event end as old_event, count(*) as n, {big('sum(dur)')} as time
        from cat join ({IN_COMMAND}) using (seq) group by 1"""
    ),
    "query_attribution": q(
        """select seq, case how when 'own' then qid when 'later' then l.q when 'earlier' then e.q else 0 end as attributed_id, how as attribution from (
          select *, case when qid <> 0 then 'own' when qid = 0 and backend = 'foreground' and not idle and l is not null and (nb is null or (l.ts, l.seq) < (nb.ts, nb.seq)) then 'later'
                         when qid = 0 and backend = 'foreground' and not idle and e is not null and (pb is null or (pb.ts, pb.seq) <= (e.ts, e.seq)) then 'earlier' else 'none' end as how from (
            select *, first_value(case when carry then p end ignore nulls) over (w rows between 1 following and unbounded following) as l,
                      last_value(case when carry then p end ignore nulls) over (w rows between unbounded preceding and 1 preceding) as e,
                      first_value(case when idle or marker = 'CMD_START' or (marker = 'CMD_END' and qid = 0) then p end ignore nulls) over (w rows between 1 following and unbounded following) as nb,
                      last_value(case when idle or marker = 'CMD_START' then p end ignore nulls) over (w rows between unbounded preceding and 1 preceding) as pb
            from (select *, {'ts': ts, 'seq': seq, 'q': qid} as p, qid <> 0 and coalesce(marker, '') <> 'CMD_START' as carry from u) window w as (partition by pid order by ts, seq)))
        where marker is null""",
        f""",
u as (select seq, ts, pid, case when dur > {6 * HOUR} then 0 else query_id end as qid, cast(null as varchar) as marker, idle, backend from cat
      union all select seq, ts, pid, query_id, marker, false, '' from mk)""",
    ),
}

ORACLES["query_totals"] = q(
    f"""select {big('coalesce(sum(dur) filter (where attributed_id <> 0), 0)')} as db_time, {big("coalesce(sum(dur) filter (where attributed_id <> 0 and attribution <> 'own'), 0)")} as backfilled_time,
    {big("coalesce(sum(dur) filter (where attributed_id = 0 and backend = 'foreground'), 0)")} as unattributed_time, count(*) filter (where attributed_id = 0 and backend = 'foreground') as unattributed_count
    from ({ORACLES['query_attribution']}) a join cat using (seq) where not idle and backend <> 'io_worker'"""
)

ORACLES["capture_report"] = (
    f"select 'time_model' as section, concat_ws('/', parent, label) as label, time from ({ORACLES['time_model'].replace("cat where backend <> 'io_worker'", "iv")}) union all select 'events', cast(old_event as varchar), time from ({ORACLES['top_events']})"
    f" union all select 'sessions', cast(pid as varchar), db_time from ({ORACLES['top_sessions']}) union all select 'queries', cast(query_id as varchar), time from ({ORACLES['top_queries']})"
)

ORACLES["worker_leaders"] = q(
    f"""select leader, e_seq, count(distinct a.pid) as workers, {big(f'sum(least(a.ts, coalesce(r.e_end, {HI})) - greatest(a.start, r.e_start))')} as time
    from wk a join ({RUNS}) r on r.pid = a.leader and a.start < coalesce(r.e_end, {HI}) and r.e_start < a.ts group by leader, e_seq""",
    LIFO + ",\nfg as (select pid, row_number() over (order by pid) - 1 as i, count(*) over () as n from (select distinct pid from cat where backend = 'foreground')),\nwk as (select cat.*, fg.pid as leader from cat join fg on fg.i = cat.pid % fg.n where backend <> 'foreground' and start < ts)",
)

#: Commands: a CMD_START opens a span; so do, where none is open, a CMD_END, an EXEC_START and, before the first command, any record.
CMD = """,
al as (select pid, ts, seq, marker, query_id, 0 as dur, 0 as old_event from mk union all select pid, ts, seq, null, query_id, dur, old_event from iv),
b0 as (select *, count(*) filter (where marker = 'CMD_END') over (partition by pid order by ts, seq rows between unbounded preceding and 1 preceding) as ends from al),
b1 as (select *, count(*) filter (where marker = 'CMD_START') over (partition by pid, ends order by ts, seq rows unbounded preceding) as starts from b0),
b2 as (select *, bool_or(starts > 0 or coalesce(marker, '') in ('EXEC_START', 'PLAN_START', 'CMD_END') or (marker is null and ends = 0)) over (partition by pid, ends, starts order by ts, seq rows unbounded preceding) as inside from b1),
b3 as (select pid, ends, starts, row_number() over (partition by pid order by ends, starts) as span, coalesce(min(ts - dur) filter (where marker is null), min(ts)) as first, coalesce(max(ts) filter (where marker is null), max(ts)) as last,
         max(ts) filter (where marker = 'CMD_START') as c_start, max(ts) filter (where marker = 'CMD_END') as c_end,
         count(*) filter (where marker = 'EXEC_START') as execs, count(*) filter (where marker = 'PLAN_START') as plans, count(*) filter (where marker is null) as records,
         cast(coalesce(sum(dur) filter (where marker is null and old_event >> 24 = 6), 0) as bigint) as client_pause,
         list_sort(list_distinct(list(query_id) filter (where query_id <> 0 and (marker is null or marker in ('EXEC_START', 'PLAN_START'))))) as queries from b2 where inside group by pid, ends, starts),
gp as (select s, s + 60000000 as e from (select """ + str(LO) + """ + (o_orderkey * 7919 % 43200000) * 60000 as s from orders)),
b4 as (select *, coalesce(lead(ends) over (partition by pid order by ends, starts) = ends, false) as bad,
         exists (select 1 from gp where gp.s < coalesce(c_end, last) and gp.e > coalesce(c_start, first) and coalesce(c_start, first) < coalesce(c_end, last)) as gap from b3),
cs as (select pid, span, c_start, c_end, c_end - c_start as dur, execs, plans, records, client_pause, queries,
         case when c_end is not null then 'closed' when c_start is not null and not bad then 'in_flight' else 'unknown' end as closure,
         case when c_start is not null and c_end is not null and not gap then 'measured' when c_start is null and c_end is null then 'unmeasured' else 'partial' end as measure,
         case when c_start is null and c_end is null then 'no_command' when bad then 'malformed' when gap then 'gap' when c_start is null then 'no_start' when c_end is null then 'no_end' end as reason from b4),
pk as (select *, case when closure = 'in_flight' then """ + str(HI) + """ - c_start else dur end as elapsed,
         case when closure = 'in_flight' then 0 when closure = 'closed' and measure = 'measured' then 1 else 2 end as kind from cs)"""
SPAN = "pid, span, c_start, c_end, dur, execs, plans, records, client_pause, closure, measure, reason"
ORACLES["backend_spans"] = q(f"select {SPAN} from cs", CMD)
ORACLES["span_per_actor"] = q(f"select {SPAN} from pk qualify row_number() over (partition by pid order by kind, coalesce(elapsed, 0) desc, span desc) = 1", CMD)
ORACLES["span_per_query"] = q(
    f"select {SPAN}, query_id from (select *, unnest(queries) as query_id from pk) qualify row_number() over (partition by query_id order by kind, coalesce(elapsed, 0) desc, span desc, pid) = 1", CMD
)
ORACLES["span_detail"] = q(
    f"select {SPAN}, elapsed, rank from (select *, row_number() over (order by case when closure = 'in_flight' then 0 else 1 end, elapsed desc nulls last, pid, span) as rank from pk) where rank <= 500", CMD
)

ORACLES["execution_workers"] = q(
    f"""select leader, e_seq, a.pid, count(*) as n, {big(f'sum(least(a.ts, coalesce(r.e_end, {HI})) - greatest(a.start, r.e_start))')} as time,
    {big(f"sum(case when cpu is not null then {measured('greatest(start, e_start)', f'least(ts, coalesce(e_end, {HI}))')} end)")} as cpu
    from wk a join (select pid as rpid, e_seq, e_start, e_end from ({RUNS})) r on r.rpid = a.leader and a.start < coalesce(r.e_end, {HI}) and r.e_start < a.ts group by leader, e_seq, a.pid""",
    LIFO + ",\nfg as (select pid, row_number() over (order by pid) - 1 as i, count(*) over () as n from (select distinct pid from cat where backend = 'foreground')),\nwk as (select cat.*, fg.pid as leader from cat join fg on fg.i = cat.pid % fg.n where backend <> 'foreground' and start < ts)",
)
ORACLES["execution_scatter"] = q(
    f"""select pid, e_seq, e_start, dur, reserved from (select *, sum(case when reserved then 0 else 1 end) over (order by reserved, e_seq * 7919 % 10007, pid, e_seq rows unbounded preceding) as k from (
      select pid, e_seq, e_start, e_end - e_start as dur, row_number() over (partition by (e_start - {LO}) // {-(-(HI - LO) // 100)} order by e_end - e_start desc, pid, e_seq) = 1 as reserved
      from ({RUNS}) where e_end is not null)) where reserved or k <= 4900""",
    LIFO,
)
#: Onsets one after the other: the first moment with enough actors ahead, then the first one after its stretch.
BURSTS = f"""select g.old_event, g.onset, c.actors from (
  with recursive g as (select old_event, min(t) as onset from cand group by old_event
    union all select * from (select g.old_event, (select min(c.t) from cand c where c.old_event = g.old_event and c.t > g.onset + {2 * HOUR}) as onset from g) where onset is not null)
  select * from g) g join cand c on c.old_event = g.old_event and c.t = g.onset"""
CAND = f""",
en as (select distinct old_event, start as t, pid from iv where not idle and old_event <> 0),
cand as (select a.old_event, a.t, cast(count(distinct b.pid) as int) as actors from (select distinct old_event, t from en) a join en b on b.old_event = a.old_event and b.t between a.t and a.t + {2 * HOUR} group by all having count(distinct b.pid) >= 4)"""
ORACLES["bursts"] = q(BURSTS, CAND)
ORACLES["burst_buckets"] = q(
    f"""select (onset - {LO}) // {-(-(HI - LO) // 60)} as bucket, count(*) as onsets, first(old_event order by actors desc, onset, old_event) as old_event, first(actors order by actors desc, onset, old_event) as actors
    from ({BURSTS}) where onset >= {LO} and onset < {HI} group by 1""",
    CAND,
)
ORACLES["sampled_vs_exact_summary"] = f"""select round(max(gap) filter (where greatest(exact_pct, sampled_pct) >= 1), 6) as max_gap,
  round((select max(g) from (select abs(sum(exact_pct) - sum(sampled_pct)) as g from ({ORACLES['sampled_vs_exact']}) group by old_event >> 24, old_event = 0)), 6) as max_class_gap,
  count(*) filter (where e <= 3 and s <= 3) as common_top
  from (select *, row_number() over (order by exact_pct desc, old_event) as e, row_number() over (order by sampled_pct desc, old_event) as s from ({ORACLES['sampled_vs_exact']}))"""

ORACLES["omission_verdicts"] = q(
    f"""select boot, window_id, case rank when 0 then 'untraced_invalid' when 1 then 'untraced_incomplete' when 2 then 'untraced_pending' when 3 then 'untraced_unqualified' when 4 then 'untraced_limit' end as status,
      case when rank > 2 then n end as affected, case when rank > 2 then t end as time_at_most from (select w.boot, w.window_id,
        (select min(coalesce(rank, 1)) from (select k from (select unnest(range((w.lo - {LO}) // {DAY}, (w.hi - 1 - {LO}) // {DAY} + 1)) as k union
           select k from lost where lost.boot = w.boot and lost.fork < w.hi and lost.exit > w.lo and lost.fork < lost.exit)) r left join (select * from ce) ce on ce.boot = w.boot and ce.k = r.k) as rank,
        (select count(*) from lost where lost.boot = w.boot and lost.fork < w.hi and lost.exit > w.lo and lost.fork < lost.exit) as n,
        {big('coalesce((select sum(least(lost.exit, w.hi) - greatest(lost.fork, w.lo)) from lost where lost.boot = w.boot and lost.fork < w.hi and lost.exit > w.lo and lost.fork < lost.exit), 0)')} as t
      from w)""",
    SPANS
    + f""",
w as (select [{', '.join(map(str, STATES.values()))}][window_id % {len(STATES)} + 1] as boot, window_id, lo, hi from win),
bi as (select old_event as boot, seq, ts as fork, ts + dur as exit, (ts - {LO}) // {DAY} as k, seq % 31 = 0 as gone from iv),
lost as (select * from bi where gone),
ce as (select boot, k, case when k % 29 = 9 then 2 when k % 29 = 7 then 0 when k % 29 = 5 then 1 when n > 90 then 3 when u > 4 or longest > {30 * HOUR} then 4 else 5 end as rank
       from (select boot, k, count(*) as n, count(*) filter (where gone) as u, max(exit - fork) filter (where gone) as longest from bi group by all))""",
)

#: Coverage by the rule itself: a walk record by record, and every stretch between two endpoints judged on its own.
WALK = f"""with recursive e0 as (select event_type as boot, event_id as seq, (epoch_us(ts) - {LO}) // 5 as t, value, cast(json_extract_string(props, '$.k') as bigint) as k from events),
b0 as (select boot, max(t) as last_obs, min(seq) as first_seq, max(seq) as last_seq, dense_rank() over (order by boot) - 1 as n from e0 group by boot),
bt as (select boot, n, last_obs, {LO} + n * {6 * DAY} - case when n = 3 then {5 * HOUR} else 0 end as off, case when n <> 2 then n // 2 + 1 end as pm, n = 1 as clean, n > 2 as same from b0),
e1 as (select e0.*, n, case when seq = first_seq or seq % 41 = 0 then 'FILE' when seq = last_seq and n in (1, 3) then 'SEAL' when seq % 509 = 1 then 'BAD'
              when seq % 301 = 2 then 'GAP_OPEN' when seq % 301 between 10 and 90 and seq % 3 = 0 then 'GAP_CLOSE' else 'WATERMARK' end as kind, row_number() over (partition by boot order by seq) as i from e0 join b0 using (boot)),
fx as (select boot, n, i, kind, case when kind = 'WATERMARK' and value > 250 then t - {12 * HOUR} else t end as a, t - k * 60000000 as fl, seq // 301 as gap, seq % 11 <> 0 as readable,
              sum(case when kind = 'FILE' then case when seq % 5 = 0 then 2 else 1 end else 0 end) over (partition by boot order by i) as no from e1),
w as (select boot, cast(0 as bigint) as i, cast(null as hugeint) as no, false as dead, cast(null as bigint) as w, cast(0 as bigint) as fl, cast(null as bigint) as hole, cast(null as bigint) as lo, cast(null as bigint) as hi, false as ok from bt
      union all
      select boot, i, case when file then fno else no end, case when file then not readable else dead or bad end, case when file or dead or bad or kind <> 'WATERMARK' then w else a end,
             case when file or dead or bad or kind <> 'WATERMARK' then fl else ffl end, case when file and readable then null when file or (not dead and bad) then opened else hole end,
             case when file and readable then opened end, case when file and readable and opened is not null then a end, not file and not dead and not bad
      from (select f.boot, f.i, f.kind, f.a, f.fl as ffl, f.no as fno, f.readable, w.no, w.dead, w.w, w.fl, w.hole, f.kind = 'FILE' as file,
                   f.kind = 'BAD' or (f.kind = 'WATERMARK' and w.w is not null and f.a < w.w) as bad,
                   case when w.hole is not null then w.hole when f.kind <> 'FILE' or not f.readable or (w.no is not null and f.no <> w.no + 1) then w.fl end as opened
            from w join fx f on f.boot = w.boot and f.i = w.i + 1)),
ok as (select fx.* from fx join w using (boot, i) where w.ok),
gaps as (select boot, coalesce((select arg_max(fl, i) from ok m where m.boot = g.boot and m.kind = 'WATERMARK' and m.a <= g.a), 0) as s,
                coalesce((select arg_min(a, i) from ok c where c.boot = g.boot and c.kind = 'GAP_CLOSE' and c.gap = g.gap and c.i > g.i), {2**62}) as e from ok g where kind = 'GAP_OPEN'),
holes as (select boot, lo as s, hi as e from w where hi is not null union all select boot, hole, {2**62} from w where hole is not null and i = (select max(i) from fx where fx.boot = w.boot)),
bad as (select boot, n, r, s + off as s, case when e = {2**62} then e else e + off end as e from (select *, 'capture_loss' as r from gaps union all select *, 'missing_file' from holes) join bt using (boot) where s < e),
lastw as (select boot, arg_max(a, i) as w, arg_max(fl, i) as fl from ok where kind = 'WATERMARK' group by boot),
seals as (select boot, arg_max(a, i) as sealed_w from ok where kind = 'SEAL' group by boot),
p0 as (select bt.*, w + off as w, fl + off as fl, clean and sealed_w is not null as sealed, sealed_w + off as sealed_w, (select arg_min(a, i) from fx where fx.boot = bt.boot) + off as s from bt left join lastw using (boot) left join seals using (boot)),
p1 as (select *, not sealed and same and {HI} - (last_obs + off) <= {DAY} as live from p0),
p as (select *, case when sealed then sealed_w when live then w else fl end as e, lead(greatest(s, off)) over (order by n) as next_s, lead(pm) over (order by n) as next_pm from p1),
pc as (select boot, n, s, e from p where s < e),
twice as (select greatest(x.s, y.s) as s, least(x.e, y.e) as e from pc x join pc y on x.n < y.n and x.s < y.e and y.s < x.e),
win as (select o_orderkey as window_id, {LO} + (o_orderkey * 7919 % 720) * {HOUR} as lo, {LO} + (o_orderkey * 7919 % 720) * {HOUR} + 12 * {HOUR} as hi from orders),
wd as (select distinct lo, hi from win),
free as (select lo, x.n, x.live, x.fl, x.w, upto from (select lo, hi, p.*, least(hi, p.e) as upto from wd join p on p.s <= lo and p.e > lo) x
         where not exists (select 1 from bad where bad.n = x.n and bad.s < upto and bad.e > lo) and not exists (select 1 from twice where twice.s < upto and twice.e > lo)),
jd as (select lo, min(f.n) filter (where upto = hi) as whole, min(f.n) filter (where live and upto < hi and hi - upto <= {DAY}) as edge from wd join free f using (lo) group by lo),
sp as (select r, s, e from bad union all select 'unclean_end', e, coalesce(next_s, {2**62}) from p where not sealed and not live and e is not null union all select 'retention', off, s from p
       union all select 'restart', e, next_s from p where next_s is not null and e is not null union all select 'clock_step', s, e from twice union all select 'not_yet_covered', e, {2**62} from p where live and e is not null
       union all select 'not_recorded', {LO - 3 * DAY}, {LO + HOUR}),
pt as (select distinct t from (select s as t from sp union all select e from sp union all select s from pc union all select e from pc union all select unnest([{LO - DAY}, {HI + 2 * DAY}]))),
sg as (select t as s, lead(t) over (order by t) as e from pt qualify e is not null),
why as (select s, e, case when not exists (select 1 from twice where twice.s <= sg.s and twice.e >= sg.e)
                 and exists (select 1 from pc where pc.s <= sg.s and pc.e >= sg.e and not exists (select 1 from bad where bad.n = pc.n and bad.s <= sg.s and bad.e >= sg.e)) then null
               else coalesce((select arg_min(r, list_position({['capture_loss', 'missing_file', 'unclean_end', 'retention', 'restart', 'clock_step', 'not_yet_covered', 'not_recorded']}, r)) from sp where sp.s <= sg.s and sp.e >= sg.e), 'not_captured') end as reason from sg),
ug as (select lo, hi, greatest(s, lo) as s, least(e, hi) as e, reason from wd join why on s < hi and e > lo where reason is not null and lo not in (select lo from jd where whole is not null or edge is not null)),
u1 as (select *, case when lag(e) over (partition by lo, reason order by s) = s then 0 else 1 end as new from ug),
u2 as (select *, sum(new) over (partition by lo, reason order by s rows unbounded preceding) as g from u1),
ur as (select lo, reason, min(s) as s, max(e) as e from u2 group by lo, reason, g)
"""
ORACLES["uncovered_ranges"] = WALK + "select window_id, reason, s, e from win join ur using (lo)"


def _cause(a: str, b: str) -> str:
    return f"case when {a} is null or {b} is null then 'unknown' when {a} <> {b} then 'postgres' else 'daemon' end"


ORACLES["coverage_verdict"] = WALK + f"""select window_id, verdict, 'none' as error, case when verdict = 'live_edge' then (select w from p where p.n = edge) end as covered_to,
  case when verdict = 'incomplete' then reasons else '' end as reasons, case when verdict = 'incomplete' then cause else 'none' end as restart_cause,
  verdict <> 'incomplete' and exists (select 1 from p where p.n = coalesce(whole, edge) and live and fl < hi) as excludes_in_flight
from win join (select lo, whole, edge, case when whole is not null then 'complete' when edge is not null then 'live_edge' else 'incomplete' end as verdict,
  array_to_string(list_filter({['capture_loss', 'missing_file', 'unclean_end', 'retention', 'restart', 'clock_step', 'not_yet_covered', 'not_recorded', 'not_captured']},
    lambda r: list_contains(list_concat(coalesce(rs, []), case when len(met) > 1 then ['restart'] else [] end), r)), ',') as reasons,
  coalesce((select arg_min({_cause('pm', 'next_pm')}, n) from p where first_at is not null and p.e <= first_at and first_at < p.next_s),
           case when len(met) > 1 then {_cause('(select pm from p where p.n = met[1])', '(select pm from p where p.n = met[2])')} end, 'none') as cause
  from (select wd.lo, wd.hi, whole, edge, (select list(distinct reason) from ur where ur.lo = wd.lo) as rs, (select min(s) from ur where ur.lo = wd.lo and reason = 'restart') as first_at,
               (select list(n order by n) from pc where pc.s < wd.hi and pc.e > wd.lo) as met from wd left join jd using (lo))) using (lo)"""

#: The state machine tick by tick, with the rules' default numbers and a capacity of 3.
ORACLES["anomaly_decisions"] = q(
    """select capture, cast(tick as double) as tick, case when fired > 0 then case when cooling then 'NEAR' else 'FIRE' end when near > 0 then 'NEAR' else 'NONE' end as action,
      cast(case when fired > 0 then case when cooling then 16 else 0 end else near end as integer) as near_mask, cast(fired as integer) as fired_mask, baseline, cusum as cpu_cusum from m where i > 0""",
    f""",
tk as (select *, row_number() over (partition by capture order by tick) as i from (
  select 'c' || (user_id % 16) as capture, tick, count(*)::double as aas, count(*) filter (where event_type = 'error') / count(*)::double as lf, (count(*) filter (where event_type = 'view'))::double as cpu
  from (select us // {6 * HOUR} as tick, event_type, type, user_id from ev left join be on be.pid = ev.user_id) where coalesce(type, '') <> 'io_worker' and event_type <> 'signup' group by all)),
m as (select distinct capture, 0::bigint as i, 0::bigint as tick, 0::double as baseline, 0::bigint as over, 0::bigint as locks, 0::double as cusum, 1 as armed, (-1e18)::double as last_fire, 0 as fired, 0 as near, false as cooling from tk
  union all
  select capture, i, tick, baseline, over, locks, case when fired > 0 and not cooling then 0 else cusum end, case when fired & 4 > 0 and not cooling then 0 else armed end, case when fired > 0 and not cooling then tick else last_fire end,
         fired, near, cooling
  from (select *, (case when over >= 3 then 1 else 0 end) | (case when locks >= 3 then 2 else 0 end) | (case when proven and ready and cusum >= 1.5 and cpu >= 2 then 4 else 0 end) as fired,
               (case when high then 1 else 0 end) | (case when locked then 2 else 0 end) | (case when cusum > before and ready and cpu >= 2 and cusum >= 0.75 then 4 else 0 end) | (case when i <= 5 and aas >= 2 then 8 else 0 end) as near
        from (select capture, i, tick, aas, cpu, high, locked, proven, ready, armed, cooling, last_fire, cusum as before, case when ready then greatest(0::double, cusum + (demand - 0.8::double)) else 0 end as cusum,
                     case when i <= 5 then over when high then over + 1 else 0 end as over, case when locked then locks + 1 else 0 end as locks,
                     case when i <= 5 then baseline + (aas - baseline) / i when not high then baseline + (1::double / 60) * (aas - baseline) when over + 1 >= 900 then baseline + (1::double / 60) / 10 * (aas - baseline) else baseline end as baseline
              from (select *, not cooling and armed = 1 as ready from (
                      select t.capture, t.i, t.tick, t.aas, t.cpu, t.demand, t.demand >= 0.8::double as proven, t.tick - m.last_fire < 120 as cooling, case when t.demand < 0.8::double then 1 else m.armed end as armed,
                             t.i > 5 and t.aas >= 2 and t.aas > 3 * m.baseline as high, t.lf > 0.3::double and t.lf * t.aas >= 2 as locked, m.baseline, m.over, m.locks, m.cusum, m.last_fire
                      from m join (select *, least(greatest(cpu / 3, 0), 1.25::double) as demand from tk) t on t.capture = m.capture and t.i = m.i + 1)))))""",
).replace("with ev as", "with recursive ev as", 1)
ORACLES["cpu_cusum"] = q(
    "select capture, tick, cusum from c",
    f""",
tk as (select *, row_number() over (order by tick) as i from ({ORACLES["tick_metrics"].replace("with ev as", "with ev as", 1)})),
c as (select 'main' as capture, tick, i, 0::double as cusum from tk where i = 1
  union all select 'main', t.tick, t.i, greatest(0::double, c.cusum + (t.tick - c.tick) * (least(t.cpu_aas / 10, 1.25::double) - 0.8::double)) from c join tk t on t.i = c.i + 1)""",
).replace("with ev as", "with recursive ev as", 1)

#: Runs between losses, by the certificates that no later loss takes back.
RUNS = f""",
mv as (select user_id, event_id, us as t, start, case when prev <> 'view' then prev end as old, case when event_type <> 'view' then event_type end as new from iv0 where start is not null),
sg as (select user_id, event_id, us, k, lead(us) over (partition by user_id order by event_id) as until from ev where event_type = 'signup'),
fr as (select user_id, us as f from ev where event_type = 'error' and not exists (select 1 from sg where sg.user_id = ev.user_id and sg.k = 7 and sg.event_id > ev.event_id and sg.us - {2 * DAY} <= ev.us)),
ax as (select s.user_id, 4 * s.event_id + 2 as run, s.us as a, (select max(f) from fr where fr.user_id = s.user_id and f > s.us and (s.until is null or f < s.until)) as b
       from sg s where not exists (select 1 from sg d where d.user_id = s.user_id and d.k = 7 and d.event_id <= s.event_id)),
ed as (select ax.run, ax.a, ax.b, mv.*, row_number() over (partition by run order by t, event_id) as i from ax join mv on mv.user_id = ax.user_id and t > a and t <= b)"""
ORACLES["evidence_waits"] = q("select cast(user_id as varchar) as capture, run, old as event, start as s, t as e from ed where i > 1 and old is not null", RUNS)
ORACLES["evidence_runs"] = q("select cast(min(user_id) as varchar) as capture, run, min(t) filter (where i = 1) + 1 as a, min(b) as b, arg_max(struct_pack(x := new), i).x as event, case when arg_max(struct_pack(x := new), i).x is not null then max(t) end as since from ed group by run having min(t) filter (where i = 1) + 1 <= min(b)", RUNS)

ORACLES["budget_audit_open"] = q(
    f"""select 'main' as capture, id, used, case when want is null then greatest({4000 * HOUR} - used, 0) else least(want, greatest({4000 * HOUR} - used, 0)) end as granted
        from (select a.seq as id, a.e - a.start as want, {big("coalesce(sum(least(b.until, a.start) - greatest(b.start, a.start - " + str(HOUR) + ")) filter (where b.seq is not null), 0)")} as used
              from wo a left join wo b on a.seq <> b.seq and b.start < a.start and b.until > a.start - {HOUR} and b.until > b.start group by all)""",
    """,
wo as (select seq, start, case when seq % 29 <> 0 then ts end as e, case when seq % 29 <> 0 then ts else (select max(start) from iv) + 1 end as until from iv)""",
)
