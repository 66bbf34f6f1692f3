"""A driver: what a user gives to have a folder of logs read and run through a workflow."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.plans.engine import Trace
from tracewright.plans.spec import Master
from tracewright.sources import tracelog

_RESERVED = ("host", "target", "component", "thread", "request", "keyword", "time", "seconds", "target_alias")
_PARSED = "source string, lino long, vars map<string,string>"


class DriverError(RuntimeError):
    """A driver that fails; prints its causes one below the other, each further in."""

    def __init__(self, message: str, cause: Exception | None = None):
        super().__init__(message)
        self.cause = cause

    def __str__(self) -> str:
        lines, at, depth = [], self, 0
        while at is not None:
            lines.append("> " * depth + (at.args[0] if isinstance(at, DriverError) else repr(at)))
            at, depth = getattr(at, "cause", None), depth + 1
        return "\n".join(lines)


def _read_lines(accept: Callable[[str, dict], bool]) -> Callable:
    """(source, lino, line, file vars) through a user's function, which accepts a line and sets its variables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for source, lino, line, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found: dict = {}
                try:
                    ok = accept(line, found)
                except Exception as e:
                    raise DriverError(f"{source}@{lino}: {line}", e) from e
                if ok:
                    told = {k: str(v) for k, v in found.items() if v is not None and v != ""}
                    for k, v in own or ():
                        if told.setdefault(k, v) != v:
                            raise DriverError(f"{source}@{lino}: line and file differ on {k}")
                    out.append((source, lino, list(told.items())))
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(cols, names=["source", "lino", "vars"])

    return run


@dataclass
class Driver:
    """A workflow, and how its logs are read.

    accept_file(folder, name, vars) tells whether a file is read, and may set variables of all its lines; it runs on the
    driver over the list of files. accept_line(line, vars) does the same for a line, in Python, over Arrow batches;
    parse, a function of the scanned frame that returns columns (source, lino, vars), does it in columns instead, which is
    the faster way.
    """

    master: Master
    accept_line: Callable[[str, dict], bool] | None = None
    accept_file: Callable[[str, str, dict], bool] | None = None
    parse: Callable[[DataFrame], DataFrame] | None = None
    extensions: tuple[str, ...] = field(default=("log",))

    def lines(self, spark: SparkSession, folder: str) -> DataFrame:
        """The accepted lines: source, lino, the reserved columns, us, and vars with the free variables."""
        chosen: dict[str, dict[str, str]] = {}
        for path, name in tracelog.files(spark, folder, self.extensions):
            told: dict = {}
            try:
                ok = self.accept_file is None or self.accept_file(folder, name, told)
            except Exception as e:
                raise DriverError(f"file {name}", e) from e
            if ok:
                chosen[path] = tracelog.check_file_vars({k: str(v) for k, v in told.items() if v is not None and v != ""})
        if not chosen:
            raise DriverError(f"no log file in {folder}")
        got = tracelog.scan(spark, list(chosen))
        if self.parse is not None:
            got = self.parse(got)
        else:
            schema = "source string, vars array<struct<k:string,v:string>>"
            rows = [(path.rsplit("/", 1)[-1].rsplit(".", 1)[0], list(v.items())) for path, v in chosen.items()]
            own = spark.createDataFrame(rows, schema).select("source", F.map_from_entries("vars").alias("own"))
            got = got.join(own, "source").select("source", "lino", "line", "own").mapInArrow(_read_lines(self.accept_line), _PARSED)
        at = lambda k: F.element_at("vars", F.lit(k))
        got = got.select("source", "lino", *[at(k).alias(k) for k in _RESERVED], F.map_filter("vars", lambda k, _: ~k.isin(*_RESERVED)).alias("vars"))
        got = self._resolved(tracelog.check_lines(got), spark)
        return got.withColumn("us", F.round(F.col("seconds").cast("double") * 1_000_000).cast("long"))

    def _resolved(self, x: DataFrame, spark: SparkSession) -> DataFrame:
        """Mandatory variables there, components registered, the alias in place of the target, host and component filled by target."""
        bad: Column = F.concat(F.col("source"), F.lit("@"), F.col("lino").cast("string"), F.lit(": "))
        checked = F.when(F.size("missing") > 0, F.raise_error(F.concat(bad, F.lit("lacks "), F.array_join("missing", ", "))).cast("string")).otherwise(F.col("thread"))
        x = x.withColumn("thread", checked).drop("missing")
        x = tracelog.with_alias(x).withColumn("target", F.when(F.col("alias_ok"), F.col("alias")).otherwise(F.raise_error(F.concat(bad, F.lit("alias on some lines only"))).cast("string")))
        fixed = x.groupBy("target").agg(*[F.when(F.count_distinct(c) > 1, F.raise_error(F.concat(F.lit(f"{c} of a target changes: "), F.first("target"))).cast("string")).otherwise(F.min(c)).alias(f"_{c}") for c in ("host", "component")])
        x = x.join(fixed, "target").withColumn("host", F.col("_host"))
        known = F.array(*map(F.lit, self.master.registry.components))
        name = F.when(F.array_contains(known, F.col("_component")), F.col("_component")).otherwise(F.raise_error(F.concat(F.lit("unknown component "), F.coalesce("_component", F.lit("null")))).cast("string"))
        return x.withColumn("component", name).drop("_host", "_component", "alias", "alias_ok", "target_alias")

    def load(self, spark: SparkSession, folder: str, **options) -> Trace:
        """The trace of a folder; every registered component must appear."""
        lines = self.lines(spark, folder)
        registered = spark.createDataFrame([(c,) for c in self.master.registry.components], "component string")
        if missing := sorted(r["component"] for r in tracelog.missing_components(lines, registered).collect()):
            raise DriverError(f"no line of {', '.join(missing)}")
        return Trace(lines, self.master, **options)


def register_driver(master: Master, **how) -> Driver:
    """A driver for a workflow; see Driver for its parts."""
    return Driver(master, **how)
