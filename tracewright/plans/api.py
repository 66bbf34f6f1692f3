"""Lazy chains over requests and intervals: each step returns another chain, nothing runs before a frame is asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import stats


@dataclass(frozen=True)
class Intervals:
    """Thread and link intervals on their common columns."""

    frame: DataFrame

    @classmethod
    def union(cls, threads: DataFrame, joins: DataFrame) -> Intervals:
        common = [c for c in threads.columns if c in joins.columns and c != "kind"]
        a, b = threads.select(F.lit("thread").alias("kind"), *common), joins.select(F.lit("link").alias("kind"), *common)
        return cls(a.unionByName(b))

    @property
    def mains(self) -> Intervals:
        return Intervals(self.frame.where("is_main"))

    @property
    def joins(self) -> Intervals:
        return Intervals(self.frame.where("kind = 'link'"))

    @property
    def threads(self) -> Intervals:
        return Intervals(self.frame.where("kind = 'thread'"))

    def one_kind(self) -> Intervals | None:
        """The intervals, if they are all of threads or all of links; None if there are none; ValueError if they are mixed."""
        kinds = [r["kind"] for r in self.frame.select("kind").distinct().limit(3).collect()]
        if len(kinds) > 1:
            raise ValueError("thread and link intervals are mixed")
        return self if kinds else None

    def by_path(self, path: str) -> Intervals:
        return Intervals(self.frame.where(F.col("path") == path))

    def by_iname(self, name: str) -> Intervals:
        return Intervals(self.frame.where(F.col("int_name") == name))

    def by_order(self, order: int) -> Intervals:
        return Intervals(self.frame.where(F.col("order") == order))

    def names(self) -> DataFrame:
        return self.frame.select("int_name").distinct().orderBy("int_name")

    def orders(self) -> DataFrame:
        return self.frame.select("order").distinct().orderBy("order")

    def paths(self) -> DataFrame:
        return self.frame.select("path").distinct().orderBy("path")

    def lapse_by(self, dimension: str) -> DataFrame:
        return stats.five_numbers(self.frame, [dimension], "lapse").orderBy(F.desc("p50"), dimension)

    def longest(self) -> DataFrame:
        return stats.extreme(self.frame, "lapse", "path")

    def shortest(self) -> DataFrame:
        return stats.extreme(self.frame, "lapse", "path", largest=False)


@dataclass(frozen=True)
class Requests:
    """Requests, with their variables and intervals."""

    frame: DataFrame
    intervals: Intervals | None = None

    def by_name(self, name: str) -> DataFrame:
        """One request; KeyError if there is none."""
        got = self.frame.where(F.col("request") == name)
        if got.isEmpty():
            raise KeyError(name)
        return got

    def by_type(self, kind: str) -> Requests:
        return Requests(self.frame.where(F.col("request_type") == kind), self.intervals)

    def by_kv(self, key: str, value: str) -> Requests:
        return Requests(self.frame.where(F.element_at("vars", F.lit(key)) == value), self.intervals)

    def names(self) -> DataFrame:
        return self.frame.select("request").distinct().orderBy("request")

    def keys(self) -> DataFrame:
        """The variables' names."""
        return self.frame.select(F.explode(F.map_keys("vars")).alias("key")).distinct().orderBy("key")

    def longest(self) -> DataFrame:
        return stats.extreme(self.frame.withColumn("lapse", F.col("last_us") - F.col("from_us")), "lapse", "request")

    def shortest(self) -> DataFrame:
        return stats.extreme(self.frame.withColumn("lapse", F.col("last_us") - F.col("from_us")), "lapse", "request", largest=False)

    def most_complex(self) -> DataFrame:
        return stats.extreme(self.frame, "len_paces", "request")

    def simplest(self) -> DataFrame:
        return stats.extreme(self.frame, "len_paces", "request", largest=False)

    def distribution(self, key: str, most: int = 20) -> DataFrame:
        """Counts where a key has few values, else its five numbers."""
        few = self.frame.select(key).distinct().limit(most + 1).count() <= most
        return stats.value_counts(self.frame, [key]) if few else stats.five_numbers(self.frame, [], key)
