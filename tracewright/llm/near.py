"""Near copies by the exact Jaccard similarity of word shingles, found by covering SimHash and completed by prefixes.

First the method of op7: fingerprints of the same shingles meet in the tables of the covering masks, so all pairs within
three bits are proposed, and those of similarity t or more are linked. That settles most of a crowd of near copies
cheaply, but not all: pairs of similarity 0.8 differ in ten bits of 64 on average, and covering so many takes thousands
of tables. So the rest is found by prefix filtering. Two sets of similarity t or more share at least t of either set, so
whatever the order of all shingles, the first n - ceil(t n) + 1 shingles of each have one in common. Documents meet in
the buckets of those shingles; pairs that are linked by now are left out, and those that their sizes, their positions or
their bitmaps of 1,024 parities rule out (two sets differ in as many shingles at least as their bitmaps in bits). The
others are verified on the whole sets: every pair of similarity t is linked, with certainty, and no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import simhash
from tracewright.operators.components import contract
from tracewright.session import FEW, discard, few, lean, partitions, release, stage

WIDTH, LEAST = 5, 0.8
#: Members up to which a bucket's pairs are all looked at; members of a larger one that meet all others in a round, those
#: outside its largest group before the others (each further round has eight times as many).
SMALL, CENTRES = 16, 16
#: Large buckets before a row's own, in the order of its set, that the row names: two sets that name one in common meet there.
EARLIER = 16
#: Cells in which shingles are counted, and the fullest ones that are told apart: they only order the shingles.
CELLS, FULLEST = 1 << 20, 1 << 16
#: Shingles of the sets that a task holds at once to verify pairs (16 MB; a longer text is a block with each that it meets).
TOGETHER = 1 << 21
#: Pairs of texts that hang together above which several tasks verify them.
PAIRS = 20_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PAIR = "a long, b long"


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of the word shingles, repeats included; shorter texts are one shingle, texts without words share one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h[:width]), np.uint64)
    for k in range(min(width, len(h))):
        out = (out ^ (out >> np.uint64(29))) * _ODD + h[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * _ODD
    return out ^ (out >> np.uint64(29))


def _node(s: np.ndarray) -> int:
    """Signed 64-bit hash of a sorted set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


#: Numbers of a bitmap.
_WORDS = 16
_PRINT = "doc_id long, th long, node long, fp long, size int, bits array<long>, cells binary, cell long, n long"
#: Shingles from which a text keeps its counts, too: parities tell nothing about some 2,000 shingles and more.
LONG = 1000


def _counts(s: np.ndarray) -> np.ndarray:
    """How many of a set fall into each of 1,024 cells, modulo 256; two sets differ in as many as their counts at least."""
    return np.bincount(((s * _ODD) >> np.uint64(54)).astype(np.int64), minlength=64 * _WORDS).astype(np.uint8)


def _bitmap(counts: np.ndarray) -> np.ndarray:
    """1,024 parities of a set, as 16 numbers."""
    return np.packbits(counts & 1).view(np.int64)


def _printed(width: int):
    """(doc_id, th, text) to what of each text is kept: the hash of its set, its fingerprint and bitmap; and once a task
    the fullest cells of the shingles in it (the other columns null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PRINT.split(", ")]
        full = np.zeros(CELLS, np.int64)
        for b in batches:
            n = len(b)
            node, fp, size, bits = np.empty(n, np.int64), np.empty(n, np.uint64), np.empty(n, np.int32), np.empty((n, _WORDS), np.int64)
            cells = []
            for k, t in enumerate(b.column(2)):  # a text's shingles are not kept beyond its turn
                all_ = shingles(t.as_py(), width)
                own = np.unique(all_)
                np.add.at(full, _cell(own.view(np.int64)), 1)
                counts = _counts(own)
                node[k], fp[k], size[k], bits[k] = _node(own), simhash.majority(all_), len(own), _bitmap(counts)
                cells.append(counts.tobytes() if len(own) >= LONG else None)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * _WORDS), pa.array(bits.ravel()))
            cols = [b.column(0), b.column(1), pa.array(node), pa.array(fp.view(np.int64)), pa.array(size), lists, pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.int64())], names=names)
        top = np.argsort(-full, kind="stable")[:FULLEST]
        top = top[full[top] > 1]
        types = [*[pa.int64()] * 4, pa.int32(), pa.list_(pa.int64()), pa.binary()]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(top), t) for t in types), pa.array(top.astype(np.int64)), pa.array(full[top])], names=names)

    return run


def _cell(s: np.ndarray) -> np.ndarray:
    return s & (CELLS - 1)


def _prefixes(shared, width: int, least: float):
    """(text) to the rows (key, node, n, pos) of its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = shared.value
        full = np.zeros(CELLS, np.int64)
        full[cells] = counts
        for b in batches:
            key, node, size, pos = [], [], [], []
            for t in b.column(0):
                u = np.unique(shingles(t.as_py(), width))
                s = u.view(np.int64)
                head = len(s) - math.ceil(least * len(s) - 1e-9) + 1
                # rare shingles first: what thousands of texts share is met last
                first = s[np.lexsort((s, full[_cell(s)]))][:head]
                key.append(first)
                node.append(np.full(len(first), _node(u), np.int64))
                size.append(np.full(len(first), len(s), np.int32))
                pos.append(np.arange(len(first), dtype=np.int32))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (key, node, size, pos)], names=["key", "node", "n", "pos"])

    return run


def _pairs(centres: int | None, least: float):
    """Scan rows (key, node, n, pos, root[, earlier, bitmap]) sorted by key, node: pairs (a, b, None...), and the rows of buckets that are not done.

    Without `centres` buckets of at most SMALL members are done, and larger ones passed on; with it, larger ones are. Two
    sets that name an earlier large bucket in common are left to that one: near copies meet in a hundred buckets, and
    would come as a pair from each. In the first bucket in which two sets meet they name none in common.
    """
    names = ["a", "b", "key", "node", "n", "pos", "earlier"][: 6 if centres is None else 7]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())][: len(names) - 2]

    def pairs(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), t) for t in types)], names=names)

    def rest(cols):
        none = pa.nulls(len(cols[0]), pa.int64())
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * EARLIER), pa.array(c.ravel())) for c in cols[4:]]
        return pa.RecordBatch.from_arrays([none, none, *map(pa.array, cols[:4]), *lists], names=names)

    def needed(n, m):
        """Shingles that sets of these sizes must share."""
        return np.ceil(least / (1 + least) * (n.astype(np.float64) + m) - 1e-9)

    def may(n, pos, m, q):
        """Whether sets of these sizes that meet at these places of their prefixes can be alike."""
        return (np.minimum(pos, q) + 1 + np.minimum(n - pos - 1, m - q - 1) >= needed(n, m)) & (np.minimum(m, n) >= least * np.maximum(m, n) - 1e-9)

    def small(node, n, pos, root, row, after):
        """All pairs of small buckets: of rows k places apart, for each k. after: rows of the bucket behind each."""
        for k in range(1, SMALL):
            row = row[after[row] >= k]
            if not len(row):
                return
            to = row + k
            got = (root[row] != root[to]) & may(n[row], pos[row], n[to], pos[to])
            if got.any():
                yield pairs(node[row[got]], node[to[got]])

    def large(key, node, n, pos, root, earlier=None, bits=None):
        """Members outside the largest group so far meet all others; those who have met all are done with the bucket."""
        if (root == root[0]).all():
            return
        if centres is None:
            yield rest((key, node, n, pos))
            return
        _, group, count = np.unique(root, return_inverse=True, return_counts=True)
        some = np.flatnonzero(group != count.argmax())[:centres]
        left = np.ones(len(node), bool)
        for i in some:
            left[i] = False
            to = np.flatnonzero(left & (root != root[i]))
            to = to[may(n[i], pos[i], n[to], pos[to])]
            differ = np.bitwise_count((bits[to] ^ bits[i]).view(np.uint64)).sum(1, dtype=np.int64)  # of a signed number it counts the absolute value's
            to = to[differ <= n[i] + n[to] - 2 * needed(n[i], n[to])]
            to = to[~np.isin(earlier[to], earlier[i]).any(1)]
            if len(to):
                yield pairs(np.full(len(to), node[i]), node[to])
        if (root[left] != root[left][0]).any():
            yield rest([c[left] for c in (key, node, n, pos, earlier)])

    def found(cols):
        key, node = cols[:2]
        once = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]  # equal sets come once
        cols = [c[once] for c in cols]
        cut = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
        lo, hi = np.r_[0, cut], np.r_[cut, len(cols[0])]
        size = hi - lo
        if centres is None:
            after = np.repeat(hi, size) - np.arange(len(cols[0])) - 1
            yield from small(*cols[1:5], np.flatnonzero(np.repeat(size <= SMALL, size)), after)
        big = size > SMALL if centres is None else size > 1
        for s, e in zip(lo[big].tolist(), hi[big].tolist(), strict=True):
            yield from large(*(c[s:e] for c in cols))

    def emit(cols):
        held, rows = [], 0
        for r in found(cols):
            held.append(r)
            rows += r.num_rows
            if rows > 1 << 16:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            cols = [c.flatten().to_numpy().reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy() for c in b.columns]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(p) for p in zip(held, cols, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield from emit([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None and len(held[0]):
            yield from emit(held)

    return run


def _after(rows: DataFrame) -> DataFrame:
    """Rows (key, node, n, pos) of large buckets with `earlier`: the last EARLIER keys of the node before this one, filled up by the node itself."""
    keys = F.collect_list("key").over(Window.partitionBy("node").orderBy("pos").rowsBetween(-EARLIER, -1))
    return rows.withColumn("earlier", F.concat(keys, F.array_repeat("node", F.lit(EARLIER) - F.size(keys))))


def _possible(some: DataFrame, p: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, long) that sizes and bitmaps do not rule out; long: both have counts."""
    of = p.select("node", "size", "bits").dropDuplicates(["node"])
    for side in "ab":
        some = some.join(of.select(F.col("node").alias(side), F.col("size").alias(f"n{side}"), F.col("bits").alias(f"bits{side}")), side)
    both = (F.col("na") + F.col("nb")).cast("double")
    differ = F.aggregate(F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    fits = F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - F.lit(1e-9)
    return some.where(fits & (differ <= both - F.lit(2) * F.ceil(F.lit(least / (1 + least)) * both - F.lit(1e-9)))).select("a", "b", (F.least("na", "nb") >= LONG).alias("long"))


def _counted_apart(least: float):
    """Scan rows (block, a, b, n, cells) sorted by block and by a null `a` first: the counts of texts `b`, then pairs (a, b). Yields the pairs that they do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, of = None, {}
        for batch in batches:
            got = []
            for at, a, b, n, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != block:
                    block, of = at, {}
                if a is None:
                    of[b] = n, np.frombuffer(cells, np.uint8)
                    continue
                (n, x), (m, y) = of[a], of[b]
                differ = int(np.abs((x - y).view(np.int8).astype(np.int16)).sum(dtype=np.int64))
                if differ <= n + m - 2 * math.ceil(least / (1 + least) * (n + m) - 1e-9):
                    got.append((a, b))
            a, b = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _sifted(some: DataFrame, p: DataFrame, least: float, together: int) -> DataFrame:
    """The pairs (a, b) whose counts, where both are long, do not rule them out; the counts go to blocks as texts do later."""
    short, long_ = some.where("not long").select("a", "b"), some.where("long").select("a", "b")
    if long_.isEmpty():
        return short
    blocks = stage(_blocks(long_, p, together), "blocks")
    ends = blocks.select("block", F.explode(F.array("a", "b")).alias("b")).distinct()
    of = p.where("cells is not null").groupBy(F.col("node").alias("b")).agg(F.first("size").alias("n"), F.first("cells").alias("cells"))
    counts = ends.join(of, "b").select("block", F.lit(None).cast("long").alias("a"), "b", "n", "cells")
    rows = counts.unionAll(blocks.select("block", "a", "b", F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("cells")))
    dealt = rows.repartition(partitions(p.sparkSession), "block").sortWithinPartitions("block", F.col("a").asc_nulls_first())
    left = stage(dealt.mapInArrow(lean(_counted_apart(least)), _PAIR), "sifted")
    discard(blocks)
    return short.unionAll(left)


def _alike(width: int, least: float):
    """Scan rows (block, a, b, text) sorted by block and by a null `a` first: a block's texts, then the pairs (a, b) among them. Yields the pairs whose sets are alike, but none that those before link already."""

    def top(of: dict[int, int], x: int) -> int:
        while of[x] != x:
            of[x] = x = of[of[x]]
        return x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets, of = None, {}, {}
        for batch in batches:
            got = []
            for at, a, b, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if at != block:
                    block, sets, of = at, {}, {}
                if a is None:
                    own = np.unique(shingles(t.as_py(), width))
                    node = _node(own)
                    sets[node], of[node] = own, node
                    continue
                i, j = top(of, a), top(of, b)
                if i == j:
                    continue
                x, y = sets[a], sets[b]
                common = len(x) + len(y) - len(np.union1d(x, y))
                if common >= least * (len(x) + len(y) - common) - 1e-9:
                    got.append((a, b))
                    of[i] = j
            a, b = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _blocks(some: DataFrame, p: DataFrame, together: int) -> DataFrame:
    """(block, a, b): pairs that hang together are one block, and of more than `together` shingles or PAIRS pairs several.

    A text is then sent once, with all its pairs. A larger group is cut into cells by hash, and a block has the pairs
    between two cells: a text goes to as many blocks as there are cells, or as it has pairs, at most.
    """
    groups = contract(some)
    sizes = p.join(groups, "node").groupBy("root", "node").agg(F.first("size").alias("size")).groupBy("root").agg(F.sum("size").alias("size"))
    counts = some.join(groups.select(F.col("node").alias("a"), "root"), "a").groupBy("root").agg(F.count("*").alias("pairs"))
    cells = F.greatest(F.ceil(F.lit(2.0) * F.col("size") / F.lit(together)), F.ceil(F.lit(2.0) * F.sqrt(F.col("pairs") / F.lit(float(PAIRS)))))
    cells = groups.join(sizes.join(counts, "root"), "root").select("node", "root", cells.alias("cells"))
    cells = cells.select("node", "root", F.when(F.col("cells") <= 2, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("cells"))).alias("cell"))
    both = some.join(cells.select(F.col("node").alias("a"), "root", F.col("cell").alias("x")), "a")
    both = both.join(cells.select(F.col("node").alias("b"), F.col("cell").alias("y")), "b")
    return both.select(F.xxhash64("root", F.least("x", "y"), F.greatest("x", "y")).alias("block"), "a", "b")


def _verified(some: DataFrame, d: DataFrame, p: DataFrame, width: int, least: float, together: int, most: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike.

    Texts go to the blocks of their pairs, as texts, and become sets there: a fifth of what sets would take that meet in
    joins. The list of texts is sent to the tasks that read them; one of more than `most` rows is done in parts, so texts
    are never shuffled to it and only a part's texts are on disk.
    """
    spark = d.sparkSession
    possible = stage(_possible(some, p, least), "possible")
    blocks = stage(_blocks(_sifted(possible, p, least, together), p, together), "blocks")
    ends = blocks.select("block", F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = stage(ends.join(p.groupBy("node").agg(F.min("th").alias("th")), "node").select("block", "th"), "texts")
    parts = max(1, -(-texts.count() // most))
    discard(possible)
    release(spark)
    links = None
    for k in range(parts):
        mine = F.pmod(F.xxhash64("block"), F.lit(parts)) == k
        own = d.select("th", "text").join(F.broadcast(texts.where(mine)), "th").select("block", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "text")
        rows = own.unionAll(blocks.where(mine).select("block", "a", "b", F.lit(None).cast("string").alias("text")))
        dealt = rows.repartition(partitions(spark), "block").sortWithinPartitions("block", F.col("a").asc_nulls_first())
        got = stage(dealt.mapInArrow(lean(_alike(width, least)), _PAIR), "links")
        links = got if links is None else links.unionAll(got)
        del own, rows, dealt
        release(spark)
    discard(blocks, texts)
    return links


def _covered(p: DataFrame) -> DataFrame:
    """Pairs of different sets whose fingerprints are equal or meet in a covering table within the radius."""
    of = stage(p.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")), "prints")
    same = p.select("fp", "node").distinct().join(of.where("first <> last"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    at = of.select("fp", "first")
    near = simhash.links(at.select("fp")).where("a <> b")
    near = near.join(at.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(at.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return same.unionAll(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def _linked(docs: DataFrame, width: int, least: float, centres: int, together: int = TOGETHER, most: int = FEW) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The texts (doc_id, th, text), what is kept of them (doc_id, th, node, ...), and (node, root) of sets that are linked, if any."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    kept = stage(d.mapInArrow(lean(_printed(width)), _PRINT), "prints")
    p = kept.where("node is not null")
    pairs = stage(_covered(p), "pairs")
    links = _verified(pairs, d, p, width, least, together, most // 2)
    discard(pairs)
    roots = None if links.isEmpty() else contract(links)
    top = kept.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cell").limit(FULLEST).toArrow()
    shared = spark.sparkContext.broadcast((top["cell"].to_numpy(), top["n"].to_numpy()))
    rows = d.select("text").mapInArrow(lean(_prefixes(shared, width, least)), "key long, node long, n int, pos int")
    row = ["key", "node", "n", "pos"]
    bits, many, met = p.select("node", "bits").dropDuplicates(["node"]), None, None
    while True:
        # the first rows are a fifth of all shingles: only a broadcast list of roots is joined to them, pairs to a longer one
        late = many is None and roots is not None and roots.limit(most + 1).count() > most
        if roots is None or late:
            rows = rows.withColumn("root", F.col("node"))
        else:
            rows = rows.join(few(roots, most), "node", "left").select(*row, F.coalesce("root", "node").alias("root"))
        if many is not None:
            rows = rows.join(bits, "node").select(*row[:4], "root", "earlier", "bits")
        dealt = rows.repartition(partitions(spark), "key").sortWithinPartitions("key", "node")
        before, met = met, stage(dealt.mapInArrow(lean(_pairs(many, least)), f"{_PAIR}, key long, node long, n int, pos int" + ", earlier array<long>" * (many is not None)), "met")
        del rows, dealt
        if before is not None:
            discard(before)
        release(spark)
        some = met.where("a is not null").select("a", "b").distinct()
        if late:
            for side in "ab":
                some = some.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
            some = some.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
        some = stage(some, "pairs")
        if not some.isEmpty():
            new = _verified(some, d, p, width, least, together, most // 2)
            if not new.isEmpty():
                links = links.unionAll(new)
                roots = contract(links)
        discard(some)
        rows = met.where("a is null").select(*row)
        if rows.isEmpty():
            discard(met)
            return d, p, roots
        if many is None:
            rows, row = _after(rows), [*row, "earlier"]
        many = centres if many is None else many * 8


def _classes(p: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(doc_id, th, root)."""
    ids = p.select("doc_id", "th", "node")
    of = ids.withColumnRenamed("node", "root") if roots is None else ids.join(roots, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))
    return stage(of, "classes")


def near_components(docs: DataFrame, width: int = WIDTH, least: float = LEAST, centres: int = CENTRES) -> DataFrame:
    """doc_id, component_id (the smallest doc_id linked, at any remove), one row per row.

    Linked are texts whose sets of `width`-word shingles (ASCII case aside) have a Jaccard similarity of `least` or
    more, compared by 64-bit hashes. Defined cases: a null text is empty; texts without words are alike; a text of fewer
    words is one shingle of them all. A null doc_id is never a component's id unless all its members' ids are null.
    Other columns are not read. No rows in, none out.

    Scale: a fifth of the shingles (at 0.8) is shuffled, and the texts that the pairs to be verified name, once each
    unless a group of them is large. In a large bucket `centres` members (eight times as many each round) meet all others, and only pairs that pass
    the bitmap leave the task, once from all buckets in which they meet; rounds go on until every bucket is exhausted or its members are linked.
    """
    _, p, roots = _linked(docs, width, least, centres)
    of = _classes(p, roots)
    return of.join(of.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def without_near_copies(docs: DataFrame, width: int = WIDTH, least: float = LEAST, centres: int = CENTRES) -> DataFrame:
    """The rows of `docs`, whole, one of each group of near copies: that of the smallest doc_id, a null one last.

    Groups and defined cases are those of near_components. Of rows that repeat an id the text of least hash stays, and of
    rows that repeat both id and text one, so no row stays beside one that it is linked to. Scale: rows to drop are found
    by id and text hash on rows of 24 bytes; only a long list of them makes the join shuffle texts.
    """
    _, p, roots = _linked(docs, width, least, centres)
    of = _classes(p, roots)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    keep = of.groupBy("root").agg(F.min(first).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    id_ = lambda c: F.coalesce(c, F.lit(-(2**63)))
    gone = of.join(keep.select("root", "first"), "root").where(~first.eqNullSafe(F.col("first")))
    gone = stage(gone.select(id_(F.col("doc_id")).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("th").alias("_th")).distinct(), "gone")
    own = F.struct("*").alias("row")
    rows = docs.select(own, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("row", id_(F.col("doc_id")).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.xxhash64("text").alias("_th"))
    left = rows.join(few(gone), ["_id", "_none", "_th"], "left_anti")
    again = of.join(gone.select(F.col("_id").alias("doc_id"), F.col("_th").alias("th")), ["doc_id", "th"], "left_anti").groupBy("doc_id", "th").count().where("count > 1")
    if not again.isEmpty():
        left = left.groupBy("_id", "_none", "_th").agg(F.first("row").alias("row"))
    return left.select("row.*")
