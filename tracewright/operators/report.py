"""What a report says of requests and intervals: distributions, shares, matrices, single requests and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import stats

SIZES = ("len_targets", "len_hosts", "len_threads", "len_threadinss", "len_paces")
#: Names of the link kinds as a report counts them.
KINDS = {"thread": "td", "inner": "innerjoin", "cross_in": "crossjoin", "cross_out": "crossjoin", "request": "requestjoin", "nested": "requestjoin"}


def dist(value: Column | str) -> Column:
    """An aggregate: `min[p25|p50|p75]max`, `=v` for a constant, `=0` for none."""
    v = F.col(value) if isinstance(value, str) else value
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return stats.dist_text(F.min(v), q[0], q[1], q[2], F.max(v), F.count(v))


def sizes_by_type(requests: DataFrame, sizes: tuple[str, ...] = SIZES) -> DataFrame:
    """(request_type, size, n, lo, p25, p50, p75, hi) of each size of the requests of a type."""
    long_ = requests.select("request_type", F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.col(s).cast("long").alias("v")) for s in sizes])).alias("x"))
    return stats.five_numbers(long_.select("request_type", "x.size", "x.v"), ["request_type", "size"], "v")


def kind_counts(intervals: DataFrame) -> DataFrame:
    """(request_type, kind, n): intervals by td, innerjoin, crossjoin, requestjoin; an interval of no such kind raises."""
    kind = F.coalesce(*[F.when(F.col("int_type") == k, F.lit(v)) for k, v in KINDS.items()], F.raise_error(F.concat(F.lit("no kind of interval: "), F.col("int_type"))).cast("string"))
    return intervals.groupBy("request_type", kind.alias("kind")).agg(F.count("*").alias("n"))


def share_of_main_path(threads: DataFrame, joins: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_type, part, total, share): main-path time by component, local, remote_l, remote_r and nest, of all request time.

    threads: request_type, component, is_main, lapse; joins: request_type, int_type, remote_type, is_main, lapse; requests:
    request_type, lapse. Components are taken by type, like the other parts.
    """
    remote = F.when(F.col("int_type") == "nested", "nest").when(F.col("remote_type") == "local", "local").when(F.col("remote_type") == "local_remote", "remote_l").otherwise("remote_r")
    x = threads.where("is_main").select("request_type", F.col("component").alias("part"), "lapse")
    x = x.unionAll(joins.where("is_main").select("request_type", remote.alias("part"), "lapse"))
    whole = requests.groupBy("request_type").agg(F.sum("lapse").alias("whole"))
    got = x.groupBy("request_type", "part").agg(F.sum("lapse").alias("total"))
    return got.join(whole, "request_type").select("request_type", "part", "total", F.try_divide("total", "whole").alias("share"))


def links_per_target_pair(joins: DataFrame, remote_only: bool = False) -> DataFrame:
    """(from_component, to_component, mean_links): links by pair of targets, then their mean by pair of components."""
    x = joins.where("remote_type = 'remote'") if remote_only else joins
    per = x.groupBy("from_target", "to_target", "from_component", "to_component").agg(F.count("*").alias("n"))
    return per.groupBy("from_component", "to_component").agg(F.avg("n").alias("mean_links"))


def group_stats(intervals: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, busy, added, span, mean, ratio): intervals, length of their union, summed length, from first to last, mean, busy by n."""
    union = stats.union_measure(intervals, by).select(*by, "busy", "added")
    span = intervals.groupBy(*by).agg(F.count("*").alias("n"), (F.max("to_us") - F.min("from_us")).alias("span"))
    got = span.join(union, by)
    return got.select(*by, "n", "busy", "added", "span", F.try_divide("added", "n").alias("mean"), F.try_divide("busy", "n").alias("ratio"))


def described(joins: DataFrame) -> DataFrame:
    """Link intervals with `desc` (path and keywords) and `hosts`."""
    desc = F.concat(F.col("path"), F.lit(": "), F.col("from_keyword"), F.lit(" -> "), F.col("to_keyword"))
    return joins.withColumn("desc", desc).withColumn("hosts", F.concat(F.col("from_host").cast("string"), F.lit(" -> "), F.col("to_host").cast("string")))


def colour_class(int_type: Column, remote_type: Column, component: Column, ignore_local_remote: bool = False) -> Column:
    """The class that an interval is drawn as: its component, nested, interface, or how remote it is."""
    remote = F.when(remote_type == "local_remote", F.lit("remote" if ignore_local_remote else "local_remote")).when(remote_type == "remote", "remote").otherwise("local")
    return F.when(int_type == "thread", component).when(int_type == "nested", "nested").when(int_type == "request", "interface").otherwise(remote)


def nested_counts(links: DataFrame, callee_ti: DataFrame) -> DataFrame:
    """(group_id, n): calls into each request. links: kind, from_ti, to_ti; callee_ti: ti_id, group_id. Ways in and ways out must be as many."""
    x = callee_ti.select(F.col("ti_id"), "group_id")
    into = links.where("kind = 'cross_in'").select(F.col("to_ti").alias("ti_id"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    out = links.where("kind = 'cross_out'").select(F.col("from_ti").alias("ti_id"), F.lit(0), F.lit(1))
    per = into.unionAll(out).join(x, "ti_id").groupBy("group_id").agg(F.sum("l").alias("n"), F.sum("r").alias("r"))
    return per.select("group_id", F.when(F.col("n") == F.col("r"), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("calls in and out differ: "), F.col("group_id"))).cast("long")).alias("n"))


def request_detail(group: str, groups: DataFrame, request_vars: DataFrame, intervals: DataFrame) -> DataFrame:
    """(section, ord, key, value) of one request: its columns, its variables, its intervals in time."""
    g = groups.where(F.col("group_id") == group)
    own = g.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in groups.columns])).alias("ord", "x")).select(F.lit("request").alias("section"), F.col("ord").cast("long").alias("ord"), "x.key", "x.value")
    v = request_vars.where(F.col("group_id") == group)
    vars_ = v.select(F.lit("vars").alias("section"), F.row_number().over(Window.partitionBy("group_id").orderBy("key")).cast("long").alias("ord"), "key", F.array_join("values", ",").alias("value"))
    i = intervals.where(F.col("group_id") == group)
    rows = i.select(F.lit("interval").alias("section"), F.row_number().over(Window.partitionBy("group_id").orderBy("from_us", "to_us", "path")).cast("long").alias("ord"), F.col("path").alias("key"), F.col("lapse").cast("string").alias("value"))
    return own.unionAll(vars_).unionAll(rows)


def context(lines: DataFrame, marked: DataFrame, before: int = 3, after: int = 7) -> DataFrame:
    """Lines around marked ones of the same thread: (mark, offset, ...), offset 0 being the marked line itself.

    lines: source, target, thread, lino, ...; marked: source, target, thread, lino. Lines are counted in their thread.
    """
    key = ["source", "target", "thread"]
    n = lines.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("lino")))
    at = n.join(marked.select(*key, "lino").distinct(), [*key, "lino"], "left_semi").select(*key, F.col("lino").alias("mark"), F.explode(F.sequence(F.col("_n") - before, F.col("_n") + (after - 1))).alias("_n"), F.col("_n").alias("_at"))
    return n.join(at, [*key, "_n"]).withColumn("offset", (F.col("_n") - F.col("_at")).cast("int")).drop("_n", "_at")
