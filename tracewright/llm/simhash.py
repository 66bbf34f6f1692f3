"""SimHash near-duplicates with covering locality-sensitive hashing.

Every bit position i of the 64 gets a nonzero vector m(i) of r+1 = 4 bits. Table v (one of the 15 nonzero vectors) keeps
the positions with <m(i), v> odd. Three differing positions span at most three dimensions, so some v is orthogonal to
all of them: in that table the two fingerprints agree on every kept bit. Each pair within the radius therefore meets in
at least one table, with certainty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.components import contract
from tracewright.session import partitions, stage

RADIUS = 3
#: Buckets above this many distinct fingerprints are covered again on their free bits.
DIRECT = 1024
_CHUNK = 1 << 18


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash over word shingles, as an unsigned integer; 0 if there are no words."""
    # bytes split at 0x20 and 0x09-0x0D, and lower only A-Z
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    # one buffer of words a space apart: shingles are its slices
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - width + 1)
    lo, hi = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], 42) for a, b in zip(lo, hi, strict=True)], np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(h), _CHUNK):
        votes += np.unpackbits(h[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits in a signed long."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_prints, "doc_id long, fp long")


# ---------------------------------------------------------------------------------------------------------------------
# Covering masks
# ---------------------------------------------------------------------------------------------------------------------
def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks over the given bit positions that cover every difference of at most radius of them."""
    top = 1 << (radius + 1)
    vector = {b: 1 + k % (top - 1) for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1) for v in range(1, top)]


MASKS = covering_masks(list(range(64)))
#: For a table's bucket that is too large: masks over the bits that its table leaves free.
FINER = [[m | f for f in covering_masks([b for b in range(64) if not m >> b & 1])] for m in MASKS]


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _tree(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning tree of each connected group of a bucket, of links within the radius: fewer than fingerprints, never all pairs."""
    left, a, b = np.ones(len(fp), bool), [], []
    for i in range(len(fp)):
        if not left[i]:
            continue
        left[i] = False
        front = [i]
        while front:
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            at = fp[front.pop()]
            near = np.bitwise_count(fp[rest] ^ at) <= radius
            got = rest[near]
            left[got] = False
            a.append(np.full(len(got), at, np.uint64))
            b.append(fp[got])
            front += got.tolist()
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _bucketed(direct: int | None, radius: int = RADIUS):
    """Scan rows (t, key, fp) sorted by t, key: links (t=-1, fp, other), or whole rows of buckets above `direct`."""

    def emit(t, key, fp):
        """Buckets that are complete in these arrays."""
        out_t, out_a, out_b = [], [], []
        cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        lo, hi = np.r_[0, cut], np.r_[cut, len(t)]
        size = hi - lo
        two = lo[size == 2]
        x, y = fp[two], fp[two + 1]
        near = np.bitwise_count(x ^ y) <= radius
        out_a.append(x[near])
        out_b.append(y[near])
        out_t.append(np.full(int(near.sum()), -1, np.int32))
        for s, e in zip(lo[size > 2].tolist(), hi[size > 2].tolist(), strict=True):
            if direct is not None and e - s > direct:
                out_a.append(fp[s:e])
                out_b.append(fp[s:e])
                out_t.append(t[s:e])
                continue
            p, q = _tree(fp[s:e], radius)
            out_a.append(p)
            out_b.append(q)
            out_t.append(np.full(len(p), -1, np.int32))
        cols = [np.concatenate(out_t), np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1]), pa.array(cols[2])], names=["t", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last bucket so far; it may go on in the next batch
        passing = None  # a large bucket whose rows are passed on as they come
        for b in batches:
            t, key, fp = (b.column(i).to_numpy() for i in range(3))
            fp = fp.view(np.uint64)
            if held is not None:
                t, key, fp = (np.concatenate(p) for p in zip(held, (t, key, fp), strict=True))
            held = None
            if not len(t):
                continue
            if passing is not None:
                more = (t == passing[0]) & (key == passing[1])
                n = len(t) if more.all() else int(np.argmin(more))
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(t[:n], pa.int32()), pa.array(fp[:n].view(np.int64)), pa.array(fp[:n].view(np.int64))], names=["t", "a", "b"])
                t, key, fp = t[n:], key[n:], fp[n:]
                if not len(t):
                    continue
                passing = None
            last = int(np.flatnonzero((t != t[-1]) | (key != key[-1]))[-1]) + 1 if ((t != t[-1]) | (key != key[-1])).any() else 0
            if last:
                yield emit(t[:last], key[:last], fp[:last])
            held = (t[last:], key[last:], fp[last:])
            if direct is not None and len(held[0]) > direct:
                passing = (held[0][0], held[1][0])
                yield emit(*held)
                held = None
        if held is not None and len(held[0]):
            yield emit(*held)

    return run


def _met(rows: DataFrame, direct: int | None) -> DataFrame:
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(_bucketed(direct), "t int, a long, b long")


def links(distinct: DataFrame, direct: int = DIRECT) -> DataFrame:
    """(a, b) links between distinct fingerprints `fp` that connect exactly what radius 3 connects.

    A bucket of more than `direct` fingerprints (near copies of one text by the thousand) is dealt again by the 15 masks
    that cover its table's free bits; a bucket then has at most 2^17 fingerprints whatever the corpus, as that few bits
    remain free, and is searched whole. Nothing is capped.
    """
    wide = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(MASKS)])).alias("x"))
    first = stage(_met(wide.select("x.t", "x.key", "fp"), direct), "met")
    again = first.where("t >= 0").select("t", F.col("a").alias("fp")).distinct()
    finer = F.lit(None)
    for t, masks in reversed(list(enumerate(FINER))):
        finer = F.when(F.col("t") == t, F.array(*[F.struct(F.lit(len(MASKS) + t * len(masks) + k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])).otherwise(finer)
    deep = again.select("fp", F.explode(finer).alias("x")).select("x.t", "x.key", "fp")
    return first.where("t < 0").select("a", "b").unionAll(_met(deep, None).select("a", "b")).distinct()


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id linked, at any remove), one row per row.

    Defined cases: a null text is empty; texts without words have fingerprint zero and are linked like any other. Equal
    rows share a component. A null doc_id is never a component's id unless all its members' ids are null. Other columns
    are not read. No rows in, none out.

    Scale: copies collapse to one row per fingerprint before any search; a bucket yields a spanning tree, never its
    pairs; components contract in written rounds; ids find their component by a join that adaptive execution may split.
    """
    p = stage(fingerprints(docs), "prints")
    distinct = stage(p.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = contract(links(distinct))
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stage(of.join(least, "root").select("fp", "component_id"), "classes")
    return p.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
