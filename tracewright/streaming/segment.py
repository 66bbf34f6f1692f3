"""Thread segmentation over a stream: the automaton's configuration is each thread's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.plans.spec import Automaton

_OUT = "thread string, lino long, status string, ti int, edge string, to_node string"


def segment_stream(lines: DataFrame, automaton: Automaton) -> DataFrame:
    """(thread, lino, status, ti, edge, to_node) of a stream of thread, lino, component, keyword.

    Lines of one thread are taken in the order of lino within a micro-batch; one whose lino is not beyond that of the
    batches before comes too late to change what they gave out: its status is `late`, and the automaton does not see it.
    The state is a node, a call stack, a counter and the last lino, whatever the thread's length.
    """

    def kernel(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        node, stack, ti, last = state.get if state.exists else (-1, "", -1, -1)
        current = None if node < 0 else (node, tuple(int(x) for x in stack.split(",") if x))
        p = pd.concat(list(batches)).sort_values("lino", kind="stable")
        if len(p):
            rows, before = [], last
            for lino, component, keyword in zip(p["lino"], p["component"], p["keyword"], strict=True):
                if lino <= before:
                    rows.append((key[0], lino, "late", None, None, None))
                    continue
                last = lino
                got = automaton.step(*current, keyword) if current else None
                if got:
                    current = got[1:]
                    rows.append((key[0], lino, "step", ti, got[0], automaton.names[got[1]]))
                elif start := automaton.start(component, keyword):
                    ti, current = ti + 1, start[4:]
                    rows.append((key[0], lino, "start", ti, start[3], automaton.names[start[4]]))
                else:
                    current = None
                    rows.append((key[0], lino, "dangling", None, None, None))
            yield pd.DataFrame(rows, columns=["thread", "lino", "status", "ti", "edge", "to_node"]).astype({"ti": "Int32"})
        state.update((current[0] if current else -1, ",".join(map(str, current[1])) if current else "", ti, int(last)))

    return lines.groupBy("thread").applyInPandasWithState(kernel, _OUT, "node int, stack string, ti int, last long", "append", GroupStateTimeout.NoTimeout)
