"""Thread segmentation: each thread's lines, in order, through the pushdown automaton of its component."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewright.plans.spec import Automaton
from tracewright.session import partitions

_RESULT = pa.schema(
    [
        ("status", pa.string()), ("ti", pa.int32()), ("seq", pa.int32()), ("start_node", pa.string()), ("request_type", pa.string()), ("edge", pa.string()),
        ("from_node", pa.string()), ("to_node", pa.string()), ("request_state", pa.string()), ("mark", pa.string()), ("is_complete", pa.bool_()),
        ("is_finish", pa.bool_()), ("position", pa.string()), ("failed_on", pa.string()), ("is_error", pa.bool_()),
    ]
)
_SPARK = (
    "status string, ti int, seq int, start_node string, request_type string, edge string, from_node string, to_node string, request_state string, "
    "mark string, is_complete boolean, is_finish boolean, position string, failed_on string, is_error boolean"
)
_STATUS, _COMPLETE, _FINISH = 0, 10, 11
_KEY = ("source", "target", "thread")


class TraceError(RuntimeError):
    """A trace that the workflow forbids."""


class Walker:
    """One thread's way through the automaton: a row a line, as lists that are final once their instance is closed.

    A line steps the current instance, else starts one (closing the other), else is dangling and abandons the instance
    (unless `proceed`). Where a line does not fit, position names where the thread stood, failed_on the keyword; dangling
    lines after it are affected by the same failure, of which it alone is_error.
    """

    def __init__(self, automaton: Automaton, proceed: bool = False):
        self.automaton, self.proceed = automaton, proceed
        self.ti, self.seq, self.states = -1, 0, 0
        self.at: tuple | None = None  # node, stack, start name, request type, last edge
        self.rows: list[list] = []  # of the open instance
        self.failure: tuple[str, str] | None = None

    def _close(self, finish: bool) -> None:
        node = self.at[0]
        for r in self.rows:
            r[_COMPLETE], r[_FINISH] = node in self.automaton.end, finish
        self.rows, self.at = [], None

    def _entered(self, status: str, source: int, name: str, kind: str | None, edge: str, target: int, stack: tuple) -> list:
        a = self.automaton
        state = a.state.get(target)
        self.states += state is not None
        if self.states > 1:
            raise TraceError("two end states in one thread instance")
        self.at = (target, stack, name, kind, edge)
        row = [status, self.ti, self.seq, name, kind, edge, a.names[source], a.names[target], state, a.mark.get(target), False, False, None, None, None]
        self.rows.append(row)
        return row

    def feed(self, component: str, keyword: str) -> list:
        a, at = self.automaton, self.at
        if at is not None and (got := a.step(at[0], at[1], keyword)) is not None:
            self.seq += 1
            self.failure = None
            return self._entered("step", at[0], at[2], at[3], *got)
        position = "thread start" if at is None else f"{at[4]}->{a.names[at[0]]}"
        start = a.start(component, keyword)
        if start is not None:
            complete = at is None or a.complete(at[0], at[1])
            if at is not None:
                self._close(complete)
            self.ti, self.seq, self.states, self.failure = self.ti + 1, 0, 0, None
            node, name, kind, edge, target, stack = start
            row = self._entered("start", node, name, kind, edge, target, stack)
            if not complete:
                row[12:] = [position, keyword, True]
            return row
        first = self.failure is None
        self.failure = self.failure or (position, keyword)
        if at is not None and not self.proceed:
            self._close(a.complete(at[0], at[1]))
        return ["dangling", *[None] * 11, *self.failure, first]

    def end(self) -> None:
        if self.at is not None:
            self._close(self.automaton.complete(self.at[0], self.at[1]))


def run_thread(automaton: Automaton, components: list, keywords: list, proceed: bool = False) -> list[tuple]:
    """One row a line of a thread, in order: status, ti, seq, start, request type, edge, from, to, state, mark, complete, finish, position, failed on, error."""
    walker = Walker(automaton, proceed)
    out = [walker.feed(c, k) for c, k in zip(components, keywords, strict=True)]
    walker.end()
    return [tuple(r) for r in out]


def _segmented(automaton: Automaton, proceed: bool, names: list[str]) -> Callable:
    """Lines sorted by thread and lino, with what they are in their thread's instances. An open instance is held, no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # lines that wait for their instance to close
        rows: list[list] = []
        walker, key = Walker(automaton, proceed), None

        def give(n: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            if not n:
                return
            lines = pa.Table.from_batches(held).combine_chunks()
            result = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[:n], strict=True), _RESULT, strict=True)], schema=_RESULT)
            both = pa.Table.from_arrays([*lines.slice(0, n).columns, *result.columns], names=names + _RESULT.names)
            yield from both.combine_chunks().to_batches()
            held, rows = [b for b in lines.slice(n).to_batches() if b.num_rows], rows[n:]

        for b in batches:
            if not b.num_rows:
                continue
            keys = zip(*(b.column(names.index(k)).to_pylist() for k in _KEY), strict=True)
            for k, component, keyword in zip(keys, *(b.column(names.index(c)).to_pylist() for c in ("component", "keyword")), strict=True):
                if k != key:
                    walker.end()
                    walker, key = Walker(automaton, proceed), k
                rows.append(walker.feed(component, keyword or ""))
            held.append(b)
            opened = walker.rows[0] if walker.rows else None
            yield from give(len(rows) if opened is None else next(i for i, r in enumerate(rows) if r is opened))
        walker.end()
        yield from give(len(rows))

    return run


def segment(lines: DataFrame, automaton: Automaton, proceed: bool = False) -> DataFrame:
    """Each line, whole, with its part in a thread instance: status start, step or dangling.

    lines: source, target, thread, lino, component, keyword, and any other columns. One shuffle, by thread; a task reads
    its threads sorted by lino and holds the lines of one open instance, however long a thread is.
    """
    dealt = lines.repartition(partitions(lines.sparkSession), *_KEY).sortWithinPartitions(*_KEY, "lino")
    schema = StructType([*lines.schema.fields, *StructType.fromDDL(_SPARK).fields])
    return dealt.mapInArrow(_segmented(automaton, proceed, lines.columns), schema)


def with_ids(segmented: DataFrame) -> DataFrame:
    """Accepted lines with the ids of their instance and of their own."""
    ti = F.concat_ws("#", *_KEY, F.col("ti").cast("string"))
    return segmented.where("status <> 'dangling'").withColumn("ti_id", ti).withColumn("pace_id", F.concat_ws("#", *_KEY, F.col("lino").cast("string")))


def paces(lines: DataFrame, automaton: Automaton, proceed: bool = False) -> DataFrame:
    """Accepted lines with their instance's id and all columns of the line."""
    return with_ids(segment(lines, automaton, proceed))


def error_digest(segmented: DataFrame) -> DataFrame:
    """Failures by position and keyword: errors, lines affected (the failing one and dangling ones after it), first line."""
    bad = segmented.where("position is not null")
    got = bad.groupBy("position", F.col("failed_on").alias("keyword"))
    return got.agg(F.count(F.when(F.col("is_error"), 1)).alias("errors"), F.count("*").alias("affected"), F.min(F.when(F.col("is_error"), F.col("lino"))).alias("first_lino"))


def instances(p: DataFrame, time: str = "us") -> DataFrame:
    """One row a thread instance."""
    return p.groupBy("ti_id", "source", "target", "thread").agg(
        F.min("start_node").alias("start_node"),
        F.max("request_type").alias("request_type"),
        F.max("request_state").alias("request_state"),
        F.max("is_complete").alias("is_complete"),
        F.max("is_finish").alias("is_finish"),
        F.count("*").alias("n_paces"),
        F.min(time).alias("from_us"),
        F.max(time).alias("to_us"),
    )


def coverage(p: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared edges that no line has taken."""
    return declared.join(p.select("edge").distinct(), "edge", "left_anti")
