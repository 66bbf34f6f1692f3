"""Variables of lines and instances: folding, versions of recycled ids, look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(p: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Per group and key: the value if there is one, else the set of conflicting ones."""
    got = p.where(F.col(value).isNotNull()).groupBy(group, key).agg(F.sort_array(F.collect_set(value)).alias("seen"))
    one = F.size("seen") == 1
    return got.select(group, key, F.when(one, F.col("seen")[0]).alias("single"), F.when(~one, F.col("seen")).alias("several"))


def refresh(lines: DataFrame, target: str, order: list, key: str, value: str, is_refresh: Column) -> DataFrame:
    """Version a recycled id: `<count>:<value>` once its key was refreshed in the target so far; before, the raw value.

    count is the number of refreshes of that value so far (0 for one never refreshed). Both are running windows, so a
    line's version needs its target's earlier lines only.
    """
    by_value = Window.partitionBy(target, key, value).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    by_key = Window.partitionBy(target, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(is_refresh, 1).otherwise(0)
    count, seen = F.sum(mark).over(by_value), F.max(mark).over(by_key)
    return lines.withColumn("versioned", F.when(seen == 1, F.concat(count.cast("string"), F.lit(":"), F.col(value))).otherwise(F.col(value)))


def lookup(key: str, line_vars: str = "vars", instance_vars: str = "ti_vars") -> Column:
    """A pace's variable: the line's own, else the instance's; missing ones raise."""
    got = F.coalesce(F.element_at(line_vars, F.lit(key)), F.element_at(instance_vars, F.lit(key)))
    return F.coalesce(got, F.raise_error(F.lit(f"variable {key} is missing")))


def visible_from(p: DataFrame, group: str, key: str, order: list) -> DataFrame:
    """Whether the key is set at or before each line of its group."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumn("visible", F.max(F.col(key).isNotNull().cast("int")).over(w) == 1)


def single_valued(v: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, key, value) of the keys that are single-valued in every group."""
    per = v.where(F.col(value).isNotNull()).groupBy(group, key).agg(F.count_distinct(value).alias("n"), F.min(value).alias("value"))
    keys = per.groupBy(key).agg(F.max("n").alias("most")).where("most = 1").select(key)
    return per.join(keys, key, "left_semi").select(group, key, "value")
