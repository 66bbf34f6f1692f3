"""Connected components of an undirected edge table, by randomised contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import stage

#: Edges that one task finishes; a graph is contracted by all tasks until so few are left.
ONE_TASK = 50_000


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) edges, all of them, to (node, to): the least node of each component, by label passing and pointer jumping."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    edges = pa.Table.from_batches(got).combine_chunks()
    kind = edges.schema.field(0).type
    ends = np.concatenate([edges.column(i).to_numpy() for i in range(2)])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes.tolist(), kind), pa.array(nodes[label].tolist(), kind)], names=["node", "to"])


def contract(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200, one_task: int = ONE_TASK) -> DataFrame:
    """Return (node, root): root is one node of the component, the same for all its nodes. Nodes without edges are absent.

    Each round, every node hooks to the neighbour (or itself) with the least hash under that round's salt, edges are
    rewritten to the hooks and loops dropped, so the graph shrinks by a constant factor in expectation whatever its
    shape (a plain minimum needs one round per node on a sorted path). Every step is a grouped minimum, which combines
    on the map side, or an equi-join that adaptive execution can split at a hot hub. Once `one_task` edges or fewer are
    left, one task finishes them, which saves the many small stages of the last rounds. Each round is written to the
    shared folder, which cuts the lineage. Rows with a null end and loops are ignored; repeated edges count once.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = stage(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    kind = e.schema["a"].dataType.simpleString()
    hooks: list[DataFrame] = []
    for salt in range(max_rounds):
        left = e.count()
        if left == 0:
            break
        if left <= one_task:
            hooks.append(stage(e.coalesce(1).mapInArrow(_finish, f"node {kind}, to {kind}"), "hooks"))
            break
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(salt)).alias("h"), "b")).alias("m"))
        own = F.struct(F.xxhash64("a", F.lit(salt)).alias("h"), F.col("a").alias("b"))
        hook = stage(near.select(F.col("a").alias("node"), F.least(F.col("m"), own)["b"].alias("to")), "hooks")
        hooks.append(hook)
        x = e.join(hook.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
        x = x.join(hook.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b").where("ta <> tb")
        e = stage(x.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not contract")
    if not hooks:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = hooks[0].withColumnRenamed("to", "root")
    for hook in hooks[1:]:
        out = out.join(hook.select(F.col("node").alias("root"), "to"), "root", "left")
        out = out.select("node", F.coalesce("to", "root").alias("root"))
    return out if len(hooks) == 1 else stage(out, "roots")
