"""Scalar rules over states: classes, idleness, categories, latency buckets and window clips.

Times are integers of one unit, whichever the source has (the registered queries use
microseconds). A row stands for [start, ts). State ids carry their class in the top byte.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class name by the top byte of a state id; id 0 is CPU.
CLASSES = {0x0A: "io", 0x03: "lock", 0x01: "lwlock", 0x08: "ipc", 0x06: "client", 0x09: "timeout", 0x04: "bufferpin", 0x05: "activity", 0x07: "extension"}
CLASS_NAMES = ["cpu", *CLASSES.values(), "unknown"]
CLIENT_READ = 0x06000000
EXIT = 0xFFFFFFFF
#: Fixed value: id that marks CPU outside any command, which counts as idle.
NON_COMMAND_CPU = 0x05FFFFFF
FOREGROUND = ("client", "parallel_worker", "unknown")


def class_of(event: Column) -> Column:
    out = F.when(event == 0, "cpu")
    for byte, name in CLASSES.items():
        out = out.when(F.shiftright(event, 24) == byte, name)
    return out.otherwise("unknown")


def is_hidden(event: Column) -> Column:
    return F.shiftright(event, 24) == 0x05


def is_session_idle(event: Column) -> Column:
    return is_hidden(event) | (event == CLIENT_READ)


def is_idle(event: Column, pacing: tuple[int, ...] = ()) -> Column:
    """Not load: Activity, Client:ClientRead, and the Timeout ids in ``pacing`` (none if unknown)."""
    out = is_session_idle(event)
    for i in pacing:
        out = out | (event == (0x09 << 24 | i))
    return out


def backend_category(kind: Column) -> Column:
    kind = F.coalesce(kind, F.lit("unknown"))
    return F.when(kind == "io_worker", "io_worker").when(kind == "autovac_worker", "maintenance").when(kind.isin(*FOREGROUND), "foreground").otherwise("background")


def record_category(backend: Column, in_plan: Column, in_exec: Column) -> Column:
    """The first that applies: io_worker, maintenance, background, plan, exec, command."""
    return (
        F.when(backend.isin("io_worker", "maintenance", "background"), backend).when(in_plan, "plan").when(in_exec, "exec").otherwise("command")
    )


def latency_bucket(dur: Column, unit: int, buckets: int = 16) -> Column:
    """0 for under one unit, then one bucket for each power of two, the last one open."""
    out = F.when(dur < unit, 0)
    for b in range(1, buckets - 1):
        out = out.when(dur < unit * (1 << b), b)
    return out.otherwise(buckets - 1)


def bucket_edge(bucket: int, unit: int) -> int:
    """Upper edge of a latency bucket."""
    return unit << bucket


def clip(start: Column, end: Column, lo, hi) -> Column:
    """Length of [start, end) within [lo, hi); a bound of None is open."""
    a = start if lo is None else F.greatest(start, lo if isinstance(lo, Column) else F.lit(lo))
    b = end if hi is None else F.least(end, hi if isinstance(hi, Column) else F.lit(hi))
    return F.greatest(b - a, F.lit(0).cast("long"))


def cpu_share(cpu: Column, start: Column, dur: Column, lo: Column, hi: Column) -> Column:
    """CPU of a record within [lo, hi): F(hi) - F(lo), with F rounded half up, so that adjoining
    windows add up. Null where the record has no measured CPU; products are decimals, and the remainder
    goes before they are divided, as a quotient of so many digits keeps six decimals alone and is rounded."""
    wide = lambda c: c.cast("decimal(20,0)")

    def upto(t: Column) -> Column:
        inside = F.least(F.greatest(t - start, F.lit(0).cast("long")), dur)
        n, by = (wide(cpu) * wide(inside) * 2 + wide(dur)).cast("decimal(38,0)"), wide(dur) * 2
        return ((n - F.pmod(n, by)) / by).cast("decimal(38,0)")

    return F.when(dur > 0, upto(hi) - upto(lo)).otherwise(F.when(cpu.isNotNull(), 0)).cast("long")


def off_cpu(gap: Column, cpu: Column) -> Column:
    return F.greatest(gap - cpu, F.lit(0).cast("long"))


def parse_time(text: str, now: datetime | None = None) -> int:
    """Microseconds since the epoch of '2024-01-01 10:00:00', 'now', or '-15m' before now."""
    now = now or datetime.now(UTC)
    if text == "now":
        at = now
    elif text[:1] == "-" and text[-1:] in "smhd":
        at = now - timedelta(**{{"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}[text[-1]]: float(text[1:-1])})
    else:
        at = datetime.fromisoformat(text)
        at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return round((at - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))
