"""The tables that analysts work on, with their contracted columns, from a trace that was run through a workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators import report, requests, stats, variables
from tracewright.plans.engine import Trace

_SIZES = ("len_paces", "len_main_paces", "len_threads", "len_threadinss", "len_targets", "len_hosts")


def seconds(us: Column) -> Column:
    return us / F.lit(1_000_000.0)


def clock_time(us: Column) -> Column:
    """H:M:S.f of the day, as it is printed."""
    second = F.floor(us / 1_000_000)
    part = lambda size, n: F.lpad((F.floor(second / size) % n).cast("string"), 2, "0")
    return F.concat_ws(":", part(3600, 24), part(60, 60), F.concat(part(1, 60), F.lit("."), F.lpad((us - second * 1_000_000).cast("string"), 6, "0")))


def targets(t: Trace) -> DataFrame:
    """target, component, host: one row a target."""
    return t.lines.groupBy("target").agg(F.min("component").alias("component"), F.min("host").alias("host"))


def _named(t: Trace, x: DataFrame) -> DataFrame:
    return x.join(t.requests.select("group_id", "request", "request_type"), "group_id")


def _ends(x: DataFrame, p: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """An interval's two lines, by their own times."""
    for side in ("from", "to"):
        x = x.join(p.select(F.col("pace_id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in columns if f"{side}_{c}" not in x.columns]), f"{side}_id")
    return x


def _timed(x: DataFrame) -> DataFrame:
    for side in ("from", "to"):
        x = x.withColumn(f"{side}_seconds", seconds(F.col(f"{side}_us"))).withColumn(f"{side}_time", clock_time(F.col(f"{side}_us")))
    x = x.withColumn("lapse", F.col("to_seconds") - F.col("from_seconds"))
    return requests.occurrence(x, ["group_id", "path"], ["from_us", "to_us", "from_id"])


_FIRST = ("request", "request_type", "int_name", "lapse", "path", "from_seconds", "to_seconds", "from_time", "to_time", "from_keyword", "to_keyword", "int_type", "desc", "order", "is_main")


def join_intervals(t: Trace) -> DataFrame:
    """Link intervals of the valid requests, one row a link."""
    x = _ends(_named(t, t.join_intervals.drop("request_name")), t.paces, ("keyword", "thread"))
    x = report.described(_timed(x))
    return x.select(*_FIRST, "remote_type", "from_target", "to_target", "from_host", "to_host", "hosts", "from_component", "to_component", "from_thread", "to_thread")


def thread_intervals(t: Trace) -> DataFrame:
    """Intervals inside the instances of the valid requests."""
    x = _timed(_ends(_named(t, t.thread_intervals), t.paces, ("keyword",)))
    desc = F.concat(F.col("path"), F.lit(": "), F.col("from_keyword"), F.lit(" -> "), F.col("to_keyword"))
    return x.withColumn("desc", desc).select(*_FIRST, "target", "host", "component", "thread")


def request_table(t: Trace) -> DataFrame:
    """The valid requests: from the first line of the start to the end that their state names, and to the last line of all."""
    p = t.paces.join(t.members.where("is_member").select("ti_id", "group_id"), "ti_id")
    end = p.where("request_state is not null").groupBy("group_id").agg(F.min("us").alias("to_us"), F.min_by("keyword", "us").alias("to_keyword"), F.min_by("edge", "us").alias("to_edge"))
    start = p.where("request_type is not null and seq = 0").groupBy("group_id").agg(F.min("us").alias("start_us"), F.min_by("keyword", "us").alias("from_keyword"), F.min_by("edge", "us").alias("from_edge"))
    x = t.requests.join(end, "group_id").join(start, "group_id").withColumn("from_us", F.col("start_us"))
    for side in ("from", "to", "last"):
        x = x.withColumn(f"{side}_seconds", seconds(F.col(f"{side}_us"))).withColumn(f"{side}_time", clock_time(F.col(f"{side}_us")))
    x = x.withColumn("lapse", F.col("to_seconds") - F.col("from_seconds")).withColumn("int_name", F.col("request_type")).withColumn("int_type", F.lit("request"))
    x = x.withColumn("path", stats.path(F.col("from_edge"), F.col("int_name"), F.col("to_edge")))
    return x.select("request", "request_type", "int_name", "lapse", "path", "from_seconds", "to_seconds", "from_time", "to_time", "from_keyword", "to_keyword", "int_type", "request_state", "last_seconds", "last_time", *_SIZES)


def request_vars(t: Trace, keys: list[str]) -> DataFrame:
    """request and a column for each of the keys that has one value in every request; a request that lacks it has null.

    The keys are given, as columns must be known; one that is multi-valued anywhere raises.
    """
    v = t.request_vars.select("group_id", "key", F.explode("values").alias("value"))
    one = variables.single_valued(v.where(F.col("key").isin(keys)), "group_id", "key", "value")
    several = v.where(F.col("key").isin(keys)).select("key").distinct().join(one.select("key").distinct(), "key", "left_anti").limit(1).collect()
    if several:
        raise ValueError(f"{several[0]['key']} has several values in a request")
    wide = one.groupBy("group_id").pivot("key", sorted(keys)).agg(F.first("value"))
    return t.requests.select("group_id", "request").join(wide, "group_id", "left").drop("group_id")
