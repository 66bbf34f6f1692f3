"""Host clock offsets from violated orders: pair bounds in Spark, the small system of hosts on the driver."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host pairs that the solver takes; a trace has hosts, not documents.
MOST_PAIRS = 1_000_000


def violations(links: DataFrame) -> DataFrame:
    """Links that arrive before they leave."""
    return links.where("from_us > to_us")


def pair_bounds(links: DataFrame) -> DataFrame:
    """(host_a, host_b, low, high) for remote links, host_a < host_b: low <= offset_a - offset_b <= high."""
    x = links.where("from_host <> to_host")
    ahead = F.col("from_host") < F.col("to_host")
    lapse = F.col("to_us") - F.col("from_us")
    return x.groupBy(F.least("from_host", "to_host").alias("host_a"), F.greatest("from_host", "to_host").alias("host_b")).agg(
        F.max(F.when(~ahead, -lapse)).alias("low"), F.min(F.when(ahead, lapse)).alias("high")
    )


def violated_pairs(bounds: DataFrame) -> DataFrame:
    """Pairs whose bounds exclude equal clocks."""
    return bounds.where("low > 0 or high < 0")


class _Range:
    """What is known of a host's offset, and the pairs that it stands in."""

    def __init__(self):
        self.low, self.high = -math.inf, math.inf
        self.pairs: list[list] = []

    def narrow(self, low: float, high: float) -> bool:
        low, high = max(self.low, low), min(self.high, high)
        if low > high:
            raise ValueError("bounds contradict each other")
        changed = (low, high) != (self.low, self.high)
        self.low, self.high = low, high
        return changed

    def choose(self, slack: float) -> float:
        """The middle of a range too tight for the slack on both sides, else the value nearest zero that keeps it."""
        if math.isfinite(self.low) and math.isfinite(self.high) and self.low + 2 * slack > self.high:
            return (self.low + self.high) / 2
        return min(max(0.0, self.low + slack), self.high - slack)


def solve(bounds: list[tuple[str, str, float | None, float | None]]) -> dict[str, float]:
    """Offsets that meet all bounds (host a, host b, low, high: low <= a - b <= high); contradictory ones raise ValueError.

    Interval relaxation. The slack is half of the narrowest pair's width (0 if every pair is open). Hosts are taken by
    descending number of pairs, then name: first one that is bounded on both sides, else one bounded on one side, else
    any (0). After each choice all ranges are narrowed along the pairs until nothing changes.
    """
    hosts: dict[str, _Range] = {}
    slack = math.inf
    for a, b, low, high in bounds:
        pair = [a, b, -math.inf if low is None else low, math.inf if high is None else high]
        if pair[2] > pair[3]:
            raise ValueError("bounds contradict each other")
        slack = min(slack, (pair[3] - pair[2]) / 2)
        for h in (a, b):
            hosts.setdefault(h, _Range()).pairs.append(pair)
    slack = slack if math.isfinite(slack) else 0.0
    open_ = sorted(hosts, key=lambda h: (-len(hosts[h].pairs), h))

    def sides(h: str) -> int:
        return math.isfinite(hosts[h].low) + math.isfinite(hosts[h].high)

    while open_:
        host = max(open_, key=sides)  # the first of those bounded on most sides
        open_.remove(host)
        x = hosts[host].choose(slack)
        hosts[host].narrow(x, x)
        changed = deque([host])
        while changed:
            for pair in hosts[changed.popleft()].pairs:
                a, b, low, high = pair
                x, y = hosts[a], hosts[b]
                if x.narrow(y.low + low, y.high + high):
                    changed.append(a)
                if y.narrow(x.low - high, x.high - low):
                    changed.append(b)
    return {h: r.low for h, r in hosts.items()}


def offsets(links: DataFrame) -> DataFrame:
    """(host, offset) that make every remote link go forward in time."""
    spark = links.sparkSession
    rows = pair_bounds(links).limit(MOST_PAIRS + 1).collect()
    if len(rows) > MOST_PAIRS:
        raise ValueError("more host pairs than the solver takes")
    got = solve([(r["host_a"], r["host_b"], r["low"], r["high"]) for r in rows])
    return spark.createDataFrame([(h, float(x)) for h, x in sorted(got.items())], "host string, offset double")


def corrected(time: Column, offset: Column) -> Column:
    return time + F.coalesce(offset, F.lit(0.0))


def apply_offsets(lines: DataFrame, offsets_: DataFrame, targets: DataFrame | None = None, time: str = "us") -> DataFrame:
    """Lines in corrected time. targets: (target) of valid requests, whose clocks alone are set; all, if it is not given.

    There are as many offsets as hosts, and as many targets as processes; both joins leave it to the planner whether
    they are small enough to be sent about.
    """
    off = offsets_.select(F.col("host").alias("_host"), F.col("offset").alias("_off"))
    x = lines.join(off, F.col("host").cast("string") == F.col("_host"), "left")
    set_ = F.lit(True)
    if targets is not None:
        x = x.join(targets.select("target").distinct().withColumn("_set", F.lit(True)), "target", "left")
        set_ = F.coalesce("_set", F.lit(False))
    kind = lines.schema[time].dataType
    return x.withColumn(time, corrected(F.col(time), F.when(set_, F.col("_off"))).cast(kind)).select(lines.columns)


def still_violated(links: DataFrame, offsets_: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Remote links that arrive before they leave in corrected time: none, if the offsets are right."""
    a, b = (offsets_.select(F.col("host").alias(f"_{s}"), F.col("offset").alias(f"_{s}_off")) for s in ("from", "to"))
    x = links.where("from_host <> to_host").join(a, F.col("from_host").cast("string") == F.col("_from"), "left").join(b, F.col("to_host").cast("string") == F.col("_to"), "left")
    late = corrected(F.col("from_us"), F.col("_from_off")) > corrected(F.col("to_us"), F.col("_to_off")) + tolerance
    return x.where(late).select(links.columns)


def zero_base(times: DataFrame, start: Column) -> DataFrame:
    """All times from the earliest start on."""
    return times.withColumn("us", F.col("us") - times.agg(F.min(start)).scalar())


def span(requests: DataFrame) -> DataFrame:
    """(mark, us, time) of the earliest start, the latest end and the latest last line of requests, as numbers and printed.

    requests: from_us, to_us, last_us, in microseconds.
    """
    one = requests.agg(F.min("from_us").alias("start"), F.max("to_us").alias("end"), F.max("last_us").alias("last"))
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mark"), F.col(m).alias("us")) for m in ("start", "end", "last")])).alias("r")).select("r.*")
    second = F.expr("us div 1000000")
    part = lambda size, n: F.lpad(F.expr(f"((us div 1000000) div {size}) % {n}").cast("string"), 2, "0")
    clock = F.concat(part(3600, 24), F.lit(":"), part(60, 60), F.lit(":"), part(1, 60), F.lit("."), F.lpad((F.col("us") - second * 1_000_000).cast("string"), 6, "0"))
    return rows.withColumn("time", clock)
