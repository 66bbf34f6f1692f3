"""Requests: groups of linked thread instances, their main path, order and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.components import contract
from tracewright.session import partitions, stage


def groups(instances: DataFrame, links: DataFrame) -> DataFrame:
    """(ti_id, group_id): instances linked at any remove, and those that share a request id, are one group.

    links: from_ti, to_ti (links inside an instance are ignored). instances: ti_id and, if there, request.
    """
    edges = links.select(F.col("from_ti").alias("a"), F.col("to_ti").alias("b"))
    if "request" in instances.columns:
        named = instances.where("request is not null")
        head = named.groupBy("request").agg(F.min("ti_id").alias("b"))
        edges = edges.unionByName(named.join(head, "request").select(F.col("ti_id").alias("a"), "b"))
    roots = contract(edges)
    got = instances.select("ti_id").join(roots.withColumnRenamed("node", "ti_id"), "ti_id", "left")
    got = stage(got.select("ti_id", F.coalesce("root", "ti_id").alias("root")), "roots")
    least = got.groupBy("root").agg(F.min("ti_id").alias("group_id"))
    return got.join(least, "root").select("ti_id", "group_id")


def reached(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(ti_id) of the instances that directed links reach from the start instances; the rest of a group is stray.

    Breadth first, a written round a level, until the front is empty: as many rounds as the longest way has links.
    """
    step = stage(links.select("from_ti", "to_ti").where("from_ti <> to_ti").distinct(), "ways")
    seen = front = stage(starts.select("ti_id").distinct(), "seen")
    while not front.isEmpty():
        to = step.join(front.withColumnRenamed("ti_id", "from_ti"), "from_ti").select(F.col("to_ti").alias("ti_id")).distinct()
        front = stage(to.join(seen, "ti_id", "left_anti"), "front")
        seen = seen.unionAll(front)
    return seen


def members(instances: DataFrame, group_of: DataFrame, links: DataFrame) -> DataFrame:
    """Instances with their group and whether they belong to its request: reached from its one start instance.

    In a group without exactly one start nothing is a request, and all instances count as its members.
    """
    x = instances.join(group_of, "ti_id")
    starts = x.where("request_type is not null").groupBy("group_id").agg(F.count("*").alias("n"), F.min("ti_id").alias("ti_id")).where("n = 1")
    one = starts.select("group_id", F.lit(True).alias("one"))
    got = reached(starts, links).withColumn("reached", F.lit(True))
    x = x.join(one, "group_id", "left").join(got, "ti_id", "left")
    return x.withColumn("is_member", F.col("one").isNull() | F.coalesce("reached", F.lit(False))).drop("one", "reached")


def build(members_: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """One row a group: its type, state, times, sizes, strays, and why it is no valid request (an empty list if it is one).

    members_: ti_id, group_id, is_member, request_type, request_state, is_complete, from_us, to_us, n_paces, host, target,
    thread. verdicts (of main_paths): group_id, failure, len_main_paces. A group with no or several starts is judged no
    further. Strays are a warning: they take no part in states, times and sizes.
    """
    m, stray = F.col("is_member"), ~F.col("is_member")
    own = lambda c: F.when(m, F.col(c))
    got = members_.groupBy("group_id").agg(
        F.max(own("request_type")).alias("request_type"),
        F.max(own("request_state")).alias("request_state"),
        F.count("request_type").alias("n_starts"),
        F.count(own("request_state")).alias("n_ends"),
        F.count(F.when(m & ~F.col("is_complete"), 1)).alias("n_incomplete"),
        F.count(F.when(stray, 1)).alias("n_strays"),
        F.min(own("from_us")).alias("from_us"),
        F.max(own("to_us")).alias("last_us"),
        F.count(F.when(m, 1)).alias("len_threadinss"),
        F.sum(F.when(m, F.col("n_paces") - 1)).alias("len_paces"),
        F.count_distinct(own("thread")).alias("len_threads"),
        F.count_distinct(own("target")).alias("len_targets"),
        F.count_distinct(own("host")).alias("len_hosts"),
    )
    failure = F.lit(None).cast("string")
    if verdicts is not None:
        got = got.join(verdicts.select("group_id", "failure", "len_main_paces"), "group_id", "left")
        failure = F.when((F.col("n_ends") == 1) & F.col("failure").isNotNull(), F.concat(F.lit("main path: "), "failure"))
    further = F.array(
        F.when(F.col("n_ends") == 0, "no end").when(F.col("n_ends") > 1, "several ends"),
        F.when(F.col("n_incomplete") > 0, "incomplete"),
        failure,
    )
    start = F.when(F.col("n_starts") == 0, "no start").when(F.col("n_starts") > 1, "several starts")
    return got.withColumn("errors", F.when(start.isNotNull(), F.array(start)).otherwise(F.array_compact(further))).drop("failure")


def auto_names(requests: DataFrame, kind: str = "request_type", order: tuple[str, ...] = ("from_us", "group_id")) -> DataFrame:
    """Unnamed requests are numbered within their type, by start.

    Rows are dealt by ranges of their order, numbered in their range, and moved on by the sizes of the ranges before, so
    that no task ranks a whole type.
    """
    x = requests.repartitionByRange(partitions(requests.sparkSession), kind, *order).withColumn("_part", F.spark_partition_id())
    x = stage(x, "ranged")
    before = F.sum("_n").over(Window.partitionBy(kind).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = x.groupBy(kind, "_part").agg(F.count("*").alias("_n")).select(kind, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy(kind, "_part").orderBy(*order)) + F.col("_before")
    x = x.join(sizes, [kind, "_part"])
    return x.withColumn("request", F.concat(F.col(kind), number.cast("string"))).drop("_part", "_before")


def main_paths(paces: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The path that leads to each group's end, from its start on, and what became of it.

    paces: group_id, pace_id, ti_id, seq, is_start, is_end; links: from_id, to_id. Walked backward from the end pace: the
    incoming link where a pace has one, else the pace before in the same instance. First (group_id, pos, kind, from_id,
    to_id): thread and link intervals in order, of sound paths alone. Second, for each group that has one end, (group_id,
    failure, len_main_paces): failure is null, `revisited`, `several links` (into one pace), or `no start` (the walk ends
    elsewhere than at a start pace); len_main_paces counts the activities, which are one more than the paces.

    The part of a way that lies in one instance is a window's matter: every pace knows the last one up to it that a link
    enters. What is left is a chain from link to link, marked by pointer doubling: as many joins as the logarithm of the
    longest chain of links, for all groups at once, and no group is gathered anywhere.
    """
    into = links.groupBy("to_id").agg(F.min("from_id").alias("joined"), F.count("*").alias("n_in"))
    x = paces.join(into.withColumnRenamed("to_id", "pace_id"), "pace_id", "left")
    w = Window.partitionBy("ti_id").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    entry = F.last(F.when(F.col("joined").isNotNull(), F.struct("seq", "pace_id", "joined", "n_in")), ignorenulls=True).over(upto)
    x = x.select("group_id", "pace_id", "ti_id", "seq", "is_end", F.lag("pace_id").over(w).alias("before"), F.first("is_start").over(upto).alias("from_start"), F.first("seq").over(upto).alias("first_seq"), entry.alias("entry"))
    x = stage(x, "ways")
    ends = x.where("is_end").groupBy("group_id").agg(F.min("pace_id").alias("node"), F.count("*").alias("n")).where("n = 1").select("group_id", "node")
    nodes = ends.select("node").unionAll(links.select(F.col("from_id").alias("node"))).distinct()
    jump = stage(x.join(nodes.withColumnRenamed("node", "pace_id"), "pace_id", "left_semi").where("entry is not null").select(F.col("pace_id").alias("node"), F.col("entry.joined").alias("next")), "jumps")
    jumps, most = [], jump.count()
    while not jump.isEmpty() and 1 << len(jumps) <= 2 * most:
        jumps.append(jump)
        far = jump.select(F.col("node").alias("next"), F.col("next").alias("far"))
        jump = stage(jump.join(far, "next").select("node", F.col("far").alias("next")), "jumps")
    endless = jump.select("node")  # longer than all there are: the way comes round
    marked = stage(ends.join(endless, "node", "left_anti").select("group_id", "node", F.lit(0).cast("long").alias("step")), "marked")
    for k in reversed(range(len(jumps))):
        moved = marked.join(jumps[k], "node").select("group_id", F.col("next").alias("node"), (F.col("step") + (1 << k)).alias("step"))
        marked = stage(marked.unionAll(moved), "marked")
    parts = marked.join(x.drop("group_id").withColumnRenamed("pace_id", "node"), "node")
    parts = parts.select("group_id", "step", "ti_id", F.coalesce("entry.seq", "first_seq").alias("lo"), F.col("seq").alias("hi"), "entry", "from_start")
    parts = stage(parts, "parts")
    per = parts.groupBy("group_id").agg(
        F.max_by("from_start", "step").alias("sound"), F.max("entry.n_in").alias("most_in"), F.sum(F.col("hi") - F.col("lo") + 1).alias("n")
    )
    failure = F.when(F.col("n").isNull(), "revisited").when(F.col("most_in") > 1, "several links").when(~F.col("sound"), "no start")
    verdicts = stage(ends.select("group_id").join(per, "group_id", "left").select("group_id", failure.alias("failure"), (F.col("n") + 1).alias("len_main_paces")), "verdicts")
    parts = parts.join(verdicts.where("failure is null").select("group_id"), "group_id", "left_semi")
    inside = parts.select("group_id", "step", "ti_id", "lo", "hi").join(x.select("ti_id", "seq", "before", "pace_id"), "ti_id").where("seq > lo and seq <= hi")
    inside = inside.select("group_id", "step", F.col("seq").cast("long").alias("at"), F.lit("thread").alias("kind"), F.col("before").alias("from_id"), F.col("pace_id").alias("to_id"))
    across = parts.where("entry is not null").select("group_id", "step", F.lit(-1).cast("long").alias("at"), F.lit("link").alias("kind"), F.col("entry.joined").alias("from_id"), F.col("entry.pace_id").alias("to_id"))
    order = Window.partitionBy("group_id").orderBy(F.desc("step"), "at")
    path = inside.unionAll(across).select("group_id", (F.row_number().over(order) - 1).alias("pos"), "kind", "from_id", "to_id")
    return path, verdicts


def occurrence(path: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """`order`: the how-manieth interval of its path in the request this is."""
    return path.withColumn("order", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
