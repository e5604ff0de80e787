"""Annotation of interval rows in the order of each actor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwell.functions.intervals import overlap_join
from dwell.functions.rules import EXIT, NON_COMMAND_CPU, backend_category, is_session_idle, record_category

ORDER = ["ts", "seq"]


def tag_backend(df: DataFrame, backends: DataFrame) -> DataFrame:
    """Adds backend, the category of each row's actor; actors that the dimension lacks count as unknown."""
    b = backends.select("pid", F.col("type").alias("_type"))
    return df.join(b, "pid", "left").withColumn("backend", backend_category(F.col("_type"))).drop("_type")


def tag_phase(df: DataFrame) -> DataFrame:
    """Adds in_plan and in_exec: the last such marker before a row was a start and no command has ended since."""
    w = Window.partitionBy("capture", "pid").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)

    def state(name: str):
        m = F.col("marker")
        flag = F.when(m == f"{name}_START", True).when(m.isin(f"{name}_END", "CMD_END"), False)
        return F.coalesce(F.last(flag, ignorenulls=True).over(w), F.lit(False))

    d = df.withColumn("in_plan", state("PLAN")).withColumn("in_exec", state("EXEC"))
    return d.withColumn("category", record_category(F.col("backend"), F.col("in_plan"), F.col("in_exec"))) if "backend" in df.columns else d


def command_windows(df: DataFrame) -> DataFrame:
    """capture, pid, c_start, c_end (null: still open) of each CMD_START to the next command marker."""
    w = Window.partitionBy("capture", "pid").orderBy(*ORDER)
    m = df.filter(F.col("marker").isin("CMD_START", "CMD_END")).withColumn("c_end", F.lead("ts").over(w))
    return m.filter("marker = 'CMD_START'").select("capture", "pid", F.col("ts").alias("c_start"), "c_end")


def tag_in_command(df: DataFrame, hi: int, width: int) -> DataFrame:
    """Adds in_command: half of the row's time up to ``hi``, or more, lies within commands.

    Rows of no length take the state at their instant. Before an actor's first command marker
    it is null.
    """
    w = Window.partitionBy("capture", "pid").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("marker").isin("CMD_START", "CMD_END"), F.col("marker")), ignorenulls=True).over(w)
    d = df.withColumn("_state", seen)
    rows = d.filter("marker is null and dur > 0").select("capture", "pid", "seq", F.col("start").alias("a_start"), F.least("ts", F.lit(hi)).alias("a_end")).filter("a_start < a_end")
    cmd = command_windows(df).select("capture", "pid", F.col("c_start").alias("b_start"), F.coalesce("c_end", F.lit(hi)).alias("b_end"))
    hit = overlap_join(rows, cmd, ["capture", "pid"], width)
    inside = hit.groupBy("capture", "pid", "seq").agg(F.sum(F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).alias("_in"))
    d = d.join(inside, ["capture", "pid", "seq"], "left")
    long = F.least("ts", F.lit(hi)) - F.col("start")
    share = F.when((F.col("dur") > 0) & (long > 0), 2 * F.coalesce("_in", F.lit(0)) >= long).otherwise(F.col("_state") == "CMD_START")
    return d.withColumn("in_command", F.when(F.col("_state").isNotNull() & F.col("marker").isNull(), share)).drop("_state", "_in")


def relabel_cpu(df: DataFrame) -> DataFrame:
    """CPU of foreground actors outside commands becomes an idle state of its own."""
    away = (F.col("backend") == "foreground") & (F.col("old_event") == 0) & (F.col("in_command") == F.lit(False))
    return df.withColumn("old_event", F.when(away, NON_COMMAND_CPU).otherwise(F.col("old_event")))


def attribute_queries(df: DataFrame) -> DataFrame:
    """Adds attributed_id and attribution ('own', 'later', 'earlier', 'none') to rows that aren't markers.

    A foreground row without id takes the first id reported later in the same command, else
    the last one earlier. Forward search ends at CMD_START, a CMD_END without id, a row idle
    for the session, and exit; backward search at CMD_START, an idle sample or row, and exit.
    Other backends' rows without id stay without; io workers are left alone.
    """
    m, q = F.col("marker"), F.col("query_id")
    idle = F.col("marker").isNull() & is_session_idle(F.col("old_event"))
    leave = F.col("new_event") == EXIT
    w = Window.partitionBy("capture", "pid").orderBy(*ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(upto)
    bound_f = (m == "CMD_START") | ((m == "CMD_END") & (q == 0)) | idle | F.coalesce(F.lag(leave).over(w), F.lit(False))
    bound_b = (m == "CMD_START") | idle | F.coalesce(F.lag(leave).over(w), F.lit(False))
    d = df.withColumn("_f", one(F.coalesce(bound_f, F.lit(False)))).withColumn("_b", one(F.coalesce(bound_b, F.lit(False))))
    carries = (q != 0) & ~F.coalesce(m.isin("ESCALATE_START", "ESCALATE_END", "CMD_START"), F.lit(False))
    given = F.when(carries, q)
    wf = Window.partitionBy("capture", "pid", "_f").orderBy(*ORDER).rowsBetween(1, Window.unboundedFollowing)
    wb = Window.partitionBy("capture", "pid", "_b").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_later", F.first(given, ignorenulls=True).over(wf)).withColumn("_earlier", F.last(given, ignorenulls=True).over(wb))
    open_ = (q == 0) & (F.col("backend") == "foreground") & ~idle
    how = F.when(q != 0, "own").when(open_ & F.col("_later").isNotNull(), "later").when(open_ & F.col("_earlier").isNotNull(), "earlier").otherwise("none")
    d = d.filter("marker is null").withColumn("attribution", how)
    value = F.when(how == "own", q).when(how == "later", F.col("_later")).when(how == "earlier", F.col("_earlier")).otherwise(0)
    return d.withColumn("attributed_id", value.cast("long")).drop("_f", "_b", "_later", "_earlier")
