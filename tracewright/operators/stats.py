"""Interval tables and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import few, stage


def thread_intervals(paces: DataFrame) -> DataFrame:
    """Intervals between consecutive paces of an instance: n paces, n - 1 intervals."""
    w = Window.partitionBy("ti_id").orderBy("seq")
    x = paces.withColumn("to_us", F.lead("us").over(w)).withColumn("to_edge", F.lead("edge").over(w)).where("to_us is not null")
    return x.select("*", F.col("us").alias("from_us"), F.col("edge").alias("from_edge"), F.col("to_node").alias("int_name"), (F.col("to_us") - F.col("us")).alias("lapse")).withColumn(
        "path", path(F.col("from_edge"), F.col("int_name"), F.col("to_edge"))
    )


def path(from_edge: Column, name: Column, to_edge: Column) -> Column:
    """`from[name]to`; an open side is a bar."""
    return F.concat(F.coalesce(from_edge, F.lit("|")), F.lit("["), name, F.lit("]"), F.coalesce(to_edge, F.lit("|")))


def five_numbers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, minimum, quartiles (exact, interpolated) and maximum."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("lo"), q.alias("q"), F.max(value).alias("hi"))
    return got.select(*by, "n", "lo", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "hi")


def dist_text(lo: Column, p25: Column, p50: Column, p75: Column, hi: Column, n: Column) -> Column:
    """`min[p25|p50|p75]max`, `=v` for a constant, `=0` for none."""
    f = lambda c: F.format_string("%.2f", c.cast("double"))
    return F.when(n == 0, "=0").when(lo == hi, F.concat(F.lit("="), f(lo))).otherwise(F.concat(f(lo), F.lit("["), f(p25), F.lit("|"), f(p50), F.lit("|"), f(p75), F.lit("]"), f(hi)))


def totals(df: DataFrame, by: str, value: str) -> DataFrame:
    """Sum, mean and share of the whole by group."""
    got = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return got.withColumn("share", F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy())))


def union_measure(df: DataFrame, by: list[str], lo: str = "from_us", hi: str = "to_us") -> DataFrame:
    """Length of the union of intervals, their summed length, and the ratio of the two (concurrency)."""
    x = df.where(F.col(hi) >= F.col(lo))
    w = Window.partitionBy(*by).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest(F.col(lo), F.max(hi).over(w))
    x = x.select(*by, (F.col(hi) - F.col(lo)).alias("_all"), F.greatest(F.lit(0), F.col(hi) - begin).alias("_new"))
    got = x.groupBy(*by).agg(F.sum("_new").alias("busy"), F.sum("_all").alias("added"))
    return got.withColumn("concurrency", F.try_divide("added", "busy"))


def steps(df: DataFrame, by: list[str], lo: str = "from_us", hi: str = "to_us") -> DataFrame:
    """Concurrency as a step function: the number of open intervals from each x on."""
    ends = df.select(*by, F.col(lo).alias("x"), F.lit(1).alias("d")).unionAll(df.select(*by, F.col(hi).alias("x"), F.lit(-1).alias("d")))
    moves = ends.groupBy(*by, "x").agg(F.sum("d").alias("d")).where("d <> 0")
    return moves.withColumn("level", F.sum("d").over(Window.partitionBy(*by).orderBy("x"))).drop("d")


def aligned(stepped: DataFrame, series: str, bucket: str | None = None) -> DataFrame:
    """Several step functions at each other's x, carried forward (0 before a series begins).

    The result has a row for each x and series. The series are sent about if they are counted to be few. bucket: a column
    under which functions are aligned, so that no window spans the whole table.
    """
    by = [bucket] if bucket else []
    x = stepped.select(*by, "x").distinct()
    s = stepped.select(*by, series).distinct()
    grid = x.join(s, by) if by else x.withColumn("_", F.lit(1)).join(few(stage(s, "series").withColumn("_", F.lit(1))), "_").drop("_")
    w = Window.partitionBy(*by, series).orderBy("x")
    got = grid.join(stepped, [*by, series, "x"], "left")
    return got.withColumn("level", F.coalesce(F.last("level", ignorenulls=True).over(w), F.lit(0)))


def value_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts and per cent of all rows."""
    got = df.groupBy(*by).agg(F.count("*").alias("n"))
    return got.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def matrix(df: DataFrame, rows: str, cols: str, values: list) -> DataFrame:
    """Counts by row and column; the columns are given, so no extra pass finds them."""
    return df.groupBy(rows).pivot(cols, values).count().na.fill(0)


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts by bin of equal width; outside values go to the bins 0 and bins + 1."""
    return df.groupBy(F.expr(f"width_bucket(cast({value} as double), {lo}d, {hi}d, {bins})").alias("bin")).agg(F.count("*").alias("n"))


def top_by_median(df: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """The k groups of largest median."""
    return df.groupBy(by).agg(F.percentile(value, 0.5).alias("median"), F.count("*").alias("n")).orderBy(F.desc("median"), by).limit(k)


def extreme(df: DataFrame, value: str, tie: str, largest: bool = True) -> DataFrame:
    """The row of the largest or smallest value; of equal ones the least `tie`."""
    return df.orderBy(F.desc(value) if largest else F.asc(value), tie).limit(1)


def padding(df: DataFrame, by: str, owner: str, tie: str, lo: str = "from_us", hi: str = "to_us") -> DataFrame:
    """Occupied and blank bands by `by` and layer: (band, by, layer, from, to).

    Layer n holds each owner's n-th interval. The blanks before a layer lead from the ends of the layer below (from 0
    before the first) to its starts, both in order of time; an end without a start leads to the last end of all.
    """
    nth = Window.partitionBy(owner, by).orderBy(lo, tie)
    x = df.select(by, lo, hi, (F.row_number().over(nth) - 1).alias("layer"))
    starts = x.select(by, "layer", F.col(lo).alias("_to"), F.row_number().over(Window.partitionBy(by, "layer").orderBy(lo)).alias("_rank"))
    ends = x.select(by, (F.col("layer") + 1).alias("layer"), F.col(hi).alias("_from"), F.row_number().over(Window.partitionBy(by, "layer").orderBy(hi)).alias("_rank"))
    ends = ends.join(starts.select(by, "layer").distinct(), [by, "layer"], "left_semi")
    between = ends.join(starts, [by, "layer", "_rank"], "left").select(by, "layer", "_from", F.coalesce("_to", df.agg(F.max(hi)).scalar()).alias("_to"))
    first = starts.where("layer = 0").select(by, "layer", F.lit(0).cast("long").alias("_from"), "_to")
    blank = first.unionAll(between).select(F.lit("blank").alias("band"), by, "layer", F.col("_from").alias(lo), F.col("_to").alias(hi))
    return x.select(F.lit("occupied").alias("band"), by, "layer", lo, hi).unionAll(blank)


def dense_index(df: DataFrame, first: str, rest: list[str], name: str = "y") -> DataFrame:
    """The distinct (first, *rest), numbered from 1 in their order.

    Each value of `first` is numbered for itself and moved on by the sizes of those before it, so that no task sorts all.
    """
    x = df.select(first, *rest).distinct()
    inside = F.row_number().over(Window.partitionBy(first).orderBy(*rest))
    sizes = x.groupBy(first).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("_in", inside).join(sizes.select(first, before.alias("_before")), first).select(first, *rest, (F.col("_before") + F.col("_in")).alias(name))
