"""The workflow of a request type: a trie of main paths, folded into a small acyclic graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import stats


def trie(intervals: DataFrame, request: str, order: str, label: str = "to_edge", value: str = "lapse") -> DataFrame:
    """Intervals grouped by the sequence of labels that leads to them: (prefix, depth, n, total)."""
    return prefixed(intervals, request, order, label).groupBy("prefix").agg(F.count("*").alias("n"), F.sum(value).alias("total")).withColumn("depth", F.size(F.split("prefix", ">")))


def prefixed(intervals: DataFrame, request: str, order: str, label: str = "to_edge") -> DataFrame:
    """Intervals with the labels that lead to them as `prefix`."""
    w = Window.partitionBy(request).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return intervals.withColumn("prefix", F.concat_ws(">", F.collect_list(label).over(w)))


def bands(intervals: DataFrame, request: str, order: str, lo: str = "from_us", hi: str = "to_us") -> DataFrame:
    """Step functions (depth, prefix, x, level) of each group of the trie, after a blank one that leads to the first groups."""
    x = prefixed(intervals, request, order).withColumn("depth", F.size(F.split("prefix", ">")))
    blank = x.where("depth = 1").select(F.lit(0).alias("depth"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias(lo), F.col(lo).alias(hi))
    return stats.steps(x.select("depth", "prefix", lo, hi).unionAll(blank), ["depth", "prefix"], lo, hi)


def fold(groups: list[tuple[str, str | None, str, int]]) -> dict[str, str]:
    """Merge groups of one label where the graph stays acyclic: (name, parent, label, weight) to name -> merged name.

    Labels are taken by descending weight, then name; within a label, groups merge into the first. The groups of a trie
    are as many as there are distinct paths, which is what a person looks at; they are folded on the driver.
    """
    into = {g[0]: g[0] for g in groups}
    parent = {g[0]: g[1] for g in groups}

    def acyclic() -> bool:
        after: dict[str, set[str]] = {}
        for name, above in parent.items():
            if above is not None and into[above] != into[name]:
                after.setdefault(into[above], set()).add(into[name])
            elif above is not None:
                return False
        left = {n: 0 for n in set(into.values())}
        for targets in after.values():
            for t in targets:
                left[t] += 1
        free, done = [n for n, k in left.items() if k == 0], 0
        while free:
            done += 1
            for t in after.get(free.pop(), ()):
                left[t] -= 1
                if left[t] == 0:
                    free.append(t)
        return done == len(left)

    weight: dict[str, int] = {}
    for _, _, label, w in groups:
        weight[label] = weight.get(label, 0) + w
    for label in sorted(weight, key=lambda x: (-weight[x], x)):
        same = sorted((g for g in groups if g[2] == label), key=lambda g: (-g[3], g[0]))
        for other in same[1:]:
            was = dict(into)
            for n, to in was.items():
                if to == was[other[0]]:
                    into[n] = was[same[0][0]]
            if not acyclic():
                into = was
    return into


def folded(t: DataFrame) -> DataFrame:
    """(prefix, merged) of a trie."""
    rows = t.select("prefix", "n").collect()
    groups = [(r["prefix"], r["prefix"].rpartition(">")[0] or None, r["prefix"].rpartition(">")[2], r["n"]) for r in rows]
    return t.sparkSession.createDataFrame(sorted(fold(groups).items()), "prefix string, merged string")
