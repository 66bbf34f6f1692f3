"""Removal of repeated 100-byte strings through a sampled suffix array with deep-shallow sorting.

Every 100-byte string has one anchor: the 40-byte gram of least hash in it (rightmost on ties). Equal strings have equal
anchors at equal places, so equal strings always meet under one anchor hash. A segment is a maximal run of strings with
the same anchor occurrence. Only the first segment of each distinct content matters to others; its suffixes are sorted
against those of the other distinct segments under the same anchor: multikey quicksort to a shallow depth, and a blind
trie for groups that are still tied there and not simply equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import partitions, release, stage

LENGTH = 100
GRAM = 40
_WINDOW = LENGTH - GRAM + 1
#: Strings handled at once, and anchors gathered before repeats among them are settled on the spot.
_BLOCK = 1 << 16
_GATHER = 1 << 20
#: Partly equal segments of one anchor beyond which its strings are dealt out one by one; strings gathered for that.
CROWDED = 20_000
_STRINGS = 1 << 17
SHALLOW = 64
#: Odd multipliers of the gram hash, one a level, and of its finaliser.
_MULT = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


# ---------------------------------------------------------------------------------------------------------------------
# Anchors
# ---------------------------------------------------------------------------------------------------------------------
def _grams(b: np.ndarray) -> np.ndarray:
    """64-bit hash of the 40 bytes from each position, by doubling: 1, 2, 4, 8, 16, 32, then 32 + 8."""
    h, size, eight = b.astype(np.uint64) + np.uint64(1), 1, None
    for m in _MULT[:5]:
        h = h[:-size] * m + h[size:]
        size *= 2
        if size == 8:
            eight = h
    h = h[: len(h) - 8] * _MULT[5] + eight[32 : 32 + len(h) - 8]
    h ^= h >> np.uint64(32)
    h *= _MULT[0]
    h ^= h >> np.uint64(29)
    return h


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first string, number of strings) of each segment of a byte array of at least 100 bytes."""
    h = _grams(b)
    n = len(b) - LENGTH + 1
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    v = (h >> bits << bits) | (np.uint64(len(h)) - np.arange(len(h), dtype=np.uint64))
    m = v
    for step in (1, 2, 4, 8, 16):
        m = np.minimum(m[:-step], m[step:])
    m = np.minimum(m[:n], m[_WINDOW - 32 : _WINDOW - 32 + n])
    at = len(h) - (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return h[at[first]], first, np.diff(np.r_[first, n])


def _segments(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, segment hash, first string, strings) by blocks, so that a long document needs little memory."""
    b = np.frombuffer(raw, np.uint8)
    for lo in range(0, len(b) - LENGTH + 1, _BLOCK):
        h, a, n = anchors(b[lo : lo + _BLOCK + LENGTH - 1])
        a = a + lo
        digest = xxhash.xxh3_64_intdigest
        seg = np.array([digest(raw[s:e]) for s, e in zip(a.tolist(), (a + n + LENGTH - 1).tolist(), strict=True)], np.uint64)
        yield h, seg, a, n


#: place holds the first string's offset, their number and the kind: a row is small, as there is one for 30 bytes of text.
_SEG = "h long, seg long, doc long, th long, place long"


def _rows(kind, h, seg, doc, th, a, n) -> pa.RecordBatch:
    place = (a.astype(np.int64) << 8) | (n.astype(np.int64) << 1) | np.asarray(kind, np.int64)
    cols = [pa.array(h.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(doc), pa.array(th), pa.array(place)]
    return pa.RecordBatch.from_arrays(cols, names=["h", "seg", "doc", "th", "place"])


def _settled(h, seg, doc, th, a, n) -> Iterator[pa.RecordBatch]:
    """Rows with kind 1 for the first of each (h, seg) among them, and kind 0, surely repeated, for the others."""
    order = np.lexsort((a, th, doc, seg, h))
    h, seg, doc, th, a, n = (x[order] for x in (h, seg, doc, th, a, n))
    new = np.r_[True, (h[1:] != h[:-1]) | (seg[1:] != seg[:-1])]
    # a copy needs no meeting any more: it is dealt out by its own place
    h = np.where(new, h, (doc * 1_000_003 + a).view(np.uint64) * _MULT[1])
    for k in range(0, len(h), 100_000):
        yield _rows(*(x[k : k + 100_000] for x in (new, h, seg, doc, th, a, n)))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the documents; kind 1: the first of its content among some, kind 0: a later copy, surely repeated."""
    held: list[tuple] = []
    size = 0
    for b in batches:
        for doc, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            for h, seg, a, n in _segments(text.as_buffer().to_pybytes() if text.is_valid else b""):
                held.append((h, seg, np.full(len(h), doc, np.int64), np.full(len(h), th, np.int64), a, n))
                size += len(h)
                if size >= _GATHER:
                    yield from _settled(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
    if held:
        yield from _settled(*(np.concatenate(x) for x in zip(*held, strict=True)))


_STRING = "p long, s binary, doc long, th long, a int"


def _string_rows(p, s, doc, th, a) -> pa.RecordBatch:
    cols = [pa.array(p, pa.int64()), pa.array(s, pa.binary()), pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(a, pa.int32())]
    return pa.RecordBatch.from_arrays(cols, names=["p", "s", "doc", "th", "a"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (h, doc, th, a, n, bytes) taken apart: one row a string, with its bytes and the hash that it is dealt by.

    Of equal strings gathered here only the earliest keeps its bytes; the others are surely repeated, and are dealt by
    their own place.
    """
    first: dict[bytes, tuple[int, int, int]] = {}
    later: list[tuple[int, int, int]] = []

    def settled() -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        if first:
            p = np.fromiter(map(digest, first), np.uint64, len(first)).view(np.int64)
            yield _string_rows(p, list(first), *zip(*first.values(), strict=True))
        for k in range(0, len(later), 100_000):
            doc, th, a = np.array(later[k : k + 100_000], np.int64).T
            yield _string_rows((doc * 1_000_003 + a) * 31, [None] * len(a), doc, th, a)

    for b in batches:
        for doc, th, a, n, raw in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
            for k in range(n):
                s, place = raw[k : k + LENGTH], (doc, th, a + k)
                was = first.setdefault(s, place)
                if was != place:
                    first[s] = min(was, place)
                    later.append(max(was, place))
            if len(first) + len(later) >= _STRINGS:
                yield from settled()
                first, later = {}, []
    yield from settled()


def _met_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings sorted by hash, bytes and place: those that equal the one before them, byte for byte, as runs (doc, th, a, n)."""
    last = None
    for b in batches:
        s = b.column(1).to_pylist()
        again = np.array([x is None or x == y for x, y in zip(s, [last, *s[:-1]], strict=True)], bool)
        last = s[-1] if s else last
        doc, th, a = (b.column(i).to_numpy()[again] for i in (2, 3, 4))
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), pa.array(a), pa.array(np.ones(len(a), np.int32))], names=["doc", "th", "a", "n"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, content and place: kind 0 for repeated segments, kind 1 for the first of each content if contents differ."""
    last = None  # the last first-of-its-content row, and whether it was given out
    for b in batches:
        h, seg, doc, th, place = (c.to_numpy() for c in b.columns)
        if not len(h):
            continue
        kind, n, a = place & 1, (place >> 1) & 127, place >> 8
        yield _rows(0, *(x[kind == 0] for x in (h, seg, doc, th, a, n)))
        h, seg, doc, th, a, n = (x[kind == 1] for x in (h, seg, doc, th, a, n))
        if not len(h):
            continue
        ph, ps = (last[0][0], last[0][1]) if last else (~h[0], ~seg[0])
        new = (h != np.r_[ph, h[:-1]]) | (seg != np.r_[ps, seg[:-1]])
        yield _rows(0, *(x[~new] for x in (h, seg, doc, th, a, n)))
        f = [x[new] for x in (h, seg, doc, th, a, n)]
        if not len(f[0]):
            continue
        same_as_last = last is not None and f[0][0] == last[0][0]
        if same_as_last and not last[1]:
            yield _rows(1, *(np.array([x]) for x in last[0]))
        peer = np.r_[same_as_last, f[0][1:] == f[0][:-1]]
        peer |= np.r_[f[0][1:] == f[0][:-1], False]
        yield _rows(1, *(x[peer] for x in f))
        last = (tuple(x[-1] for x in f), bool(peer[-1]))


# ---------------------------------------------------------------------------------------------------------------------
# Deep-shallow sorting
# ---------------------------------------------------------------------------------------------------------------------
class BlindTrie:
    """Sorts strings by their branching bytes alone: one full comparison an insertion. Equal strings share a leaf."""

    def __init__(self, length: int):
        self.length = length
        self.root: list | None = None  # inner node: [depth, {byte: node}]; leaf: (string, [members])

    def insert(self, s: bytes, member: int) -> None:
        if self.root is None:
            self.root = (s, [member])
            return
        node, path = self.root, []
        while isinstance(node, list):  # blind descent: bytes between branches are not looked at
            path.append(node)
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if s == other:
            node[1].append(member)
            return
        x = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        lcp = self.length - (x.bit_length() + 7) // 8
        above = None
        for inner in path:
            if inner[0] >= lcp:
                break
            above = inner
        below = self.root if above is None else above[1][other[above[0]]]
        if isinstance(below, list) and below[0] == lcp:
            below[1][s[lcp]] = (s, [member])
            return
        inner = [lcp, {other[lcp]: below, s[lcp]: (s, [member])}]
        if above is None:
            self.root = inner
        else:
            above[1][other[above[0]]] = inner

    def classes(self) -> Iterator[list[int]]:
        """Members of each distinct string, in the strings' order."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def deep_shallow(buf: np.ndarray, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of `length` bytes at `starts`, and for each place in that order whether a new string begins.

    The multikey quicksort takes eight bytes as one character and parts all groups that are open at once: around a pivot
    of its own each falls into three, less, equal and greater, and the equal part goes on with its next character.
    Strings alone in their group are not looked at again.
    """
    n = len(starts)
    order = np.arange(n)
    buf = np.concatenate([buf, np.zeros(16, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(buf, 8)

    def word(at: np.ndarray, depth) -> np.ndarray:
        w = np.ascontiguousarray(eights[at + depth]).view(">u8").ravel().astype(np.uint64)
        return w >> (np.uint64(8) * np.maximum(depth + 8 - length, 0).astype(np.uint64))

    group, depth = np.zeros(n, np.int64), np.zeros(n, np.int64)  # of each place: where its group begins, bytes that are equal in it
    open_ = np.arange(n if n > 1 else 0)
    while len(open_):
        g = group[open_]
        begins = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[begins, len(open_)])
        w = word(starts[order[open_]], depth[open_])
        pivot = np.repeat(w[begins + size // 2], size)
        side = (w > pivot).astype(np.int8) - (w < pivot)
        by = np.lexsort((side, g))
        order[open_], side = order[open_[by]], side[by]
        depth[open_[side == 0]] += 8
        new = np.r_[True, (g[1:] != g[:-1]) | (side[1:] != side[:-1])]
        group[open_] = open_[np.flatnonzero(new)[np.cumsum(new) - 1]]
        size = np.bincount(np.cumsum(new) - 1)
        open_ = open_[np.repeat(size > 1, size) & (depth[open_] < shallow)]
    new = np.r_[True, group[1:] != group[:-1]][:n]
    size = np.bincount(np.cumsum(new) - 1, minlength=1)
    open_ = np.flatnonzero(np.repeat(size > 1, size)) if n else open_
    if not len(open_):
        return order, new
    # tied groups: most are equal throughout, which one vectorised comparison with the group's first shows
    head = group[open_]
    differs = np.zeros(len(open_), bool)
    for at in range(shallow, length, 8):
        differs |= word(starts[order[open_]], np.int64(at)) != word(starts[order[head]], np.int64(at))
    raw = buf.tobytes()
    for h in np.unique(head[differs]).tolist():
        places = open_[head == h] if len(open_) < 64 else open_[np.searchsorted(head, h) : np.searchsorted(head, h, side="right")]
        trie = BlindTrie(length - shallow)
        for i in order[places].tolist():
            s = int(starts[i])
            trie.insert(raw[s + shallow : s + length], i)
        at = h
        for members in trie.classes():
            order[at : at + len(members)] = members
            new[at] = True
            new[at + 1 : at + len(members)] = False
            at += len(members)
    return order, new


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (h, doc, th, a, n, bytes) sorted by h: the strings of which an earlier one is the same, as runs (doc, th, a, n)."""

    def runs(rows: list[tuple]) -> pa.RecordBatch:
        h, doc, th, a, n = (np.concatenate([r[i] for r in rows]) for i in range(5))
        raw = b"".join([s for r in rows for s in r[5]])
        lengths = n + LENGTH - 1
        base = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(n)), n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(base, n) + inside
        order, new = deep_shallow(np.frombuffer(raw, np.uint8), starts)
        cls = np.empty(len(starts), np.int64)
        cls[order] = np.cumsum(new) - 1
        place = np.lexsort((inside + a[owner], th[owner], doc[owner], cls))
        first = np.r_[True, cls[place][1:] != cls[place][:-1]]
        repeated = np.zeros(len(starts), bool)
        repeated[place] = ~first
        hit = np.flatnonzero(repeated)
        if not len(hit):
            return _found(doc[:0], th[:0], a[:0], n[:0])
        begins = np.r_[True, (hit[1:] != hit[:-1] + 1) | (owner[hit][1:] != owner[hit][:-1])]
        at = hit[begins]
        count = np.diff(np.r_[np.flatnonzero(begins), len(hit)])
        o = owner[at]
        return _found(doc[o], th[o], a[o] + inside[at], count)

    def _found(doc, th, a, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc", "th", "a", "n"])

    held: list[tuple] = []
    size = 0
    for b in batches:
        cols = [b.column(i).to_numpy() for i in range(5)]
        strings = b.column(5).to_pylist()
        lo = 0
        if size >= 20_000 and len(strings):  # enough is gathered: stop where an anchor ends
            h = cols[0]
            last = held[-1][0][-1]
            change = np.flatnonzero(np.r_[last, h[:-1]] != h)
            if len(change):
                lo = int(change[0])
                if lo:
                    held.append((*(c[:lo] for c in cols), strings[:lo]))
                yield runs(held)
                held, size = [], 0
        if lo < len(strings):
            held.append((*(c[lo:] for c in cols), strings[lo:]))
            size += len(strings) - lo
    if held:
        yield runs(held)


# ---------------------------------------------------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------------------------------------------------
def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, th, text, spans[a, n]) with segments' hashes to (h, doc, th, a, n, bytes)."""
    for b in batches:
        out: list[list] = [[], [], [], [], [], []]
        for doc, th, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            for s in spans:
                for col, v in zip(out, (s["h"], doc, th, s["a"], s["n"], raw[s["a"] : s["a"] + s["n"] + LENGTH - 1]), strict=True):
                    col.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["h", "doc", "th", "a", "n", "bytes"])


def remove_spans(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal removed runs) for covered [begin, end) spans in any order."""
    if not spans:
        return raw, 0, 0
    lo, hi = np.array(sorted(spans), np.int64).T
    top = np.maximum.accumulate(hi)
    new = np.r_[True, lo[1:] > top[:-1]]
    begin, end = lo[new], top[np.r_[np.flatnonzero(new)[1:] - 1, len(lo) - 1]]
    edges = [0, *np.column_stack([begin, end]).ravel().tolist(), len(raw)]
    kept = b"".join([raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)])
    return kept, len(raw) - len(kept), len(begin)


def _finish(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, removed, runs, sha, left = [], [], [], [], []
            for text, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid and len(text.as_py()) else b""
                kept, gone, count = remove_spans(raw, [(s["a"], s["a"] + s["n"] + LENGTH - 1) for s in spans or ()])
                size.append(len(raw))
                removed.append(gone)
                runs.append(count)
                sha.append(hashlib.sha256(kept).hexdigest())
                left.append(kept if with_text else None)
            cols = [b.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(left, pa.binary())] if with_text else [])], names=[*names, *["kept"] * with_text])

    return run


def _placed(met: DataFrame, kind: int) -> DataFrame:
    a, n = F.shiftright("place", 8).cast("int").alias("a"), F.shiftright("place", 1).bitwiseAND(F.lit(127)).cast("int").alias("n")
    return met.where(F.col("place").bitwiseAND(F.lit(1)) == kind).select("h", "doc", "th", a, n)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of one anchor side by side, those that are surely repeated first, then by content and place."""
    kind = F.col("place").bitwiseAND(F.lit(1))
    return rows.repartition(partitions(rows.sparkSession), "h").sortWithinPartitions(kind, "h", "seg", "doc", "th", "place")


def _all_met(d: DataFrame) -> DataFrame:
    """Repeated segments, and those whose strings have to be compared."""
    long_ = d.where(F.octet_length("text") >= LENGTH).select("doc", "th", "text")
    return stage(_dealt(long_.mapInArrow(_scan, _SEG)).mapInArrow(_meet, _SEG), "met")


def _all_resolved(d: DataFrame, met: DataFrame, crowded: int) -> DataFrame:
    """Runs of repeated strings in the segments that are equal to others in part."""
    open_ = _placed(met, 1)
    many = stage(open_.groupBy("h").count().where(F.col("count") > crowded).select("h", F.lit(True).alias("many")), "crowded")
    none = many.isEmpty()
    open_ = open_.withColumn("many", F.lit(False)) if none else open_.join(many, "h", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    spans = open_.groupBy("doc", "th").agg(F.collect_list(F.struct("h", "a", "n", "many")).alias("spans"))
    cut = "h long, doc long, th long, a int, n int, bytes binary"

    def pieces(of_crowded: bool) -> DataFrame:
        picked = spans if none else spans.withColumn("spans", F.filter("spans", lambda s: s["many"] == of_crowded)).where(F.size("spans") > 0)
        return d.select("doc", "th", "text").join(picked, ["doc", "th"]).mapInArrow(_cut_out, cut)

    rows = pieces(False).repartition(partitions(d.sparkSession), "h").sortWithinPartitions("h")
    found = stage(rows.mapInArrow(_resolve, "doc long, th long, a int, n int"), "found")
    if none:
        return found
    apart = pieces(True).mapInArrow(_strings, _STRING).repartition(partitions(d.sparkSession), "p").sortWithinPartitions("p", "s", "doc", "th", "a")
    return found.unionAll(stage(apart.mapInArrow(_met_strings, "doc long, th long, a int, n int"), "apart"))


def _repeated(d: DataFrame) -> bool:
    """Whether whole rows repeat; they are one document."""
    return not d.groupBy("doc", "th").count().where("count > 1").isEmpty()


def remove_repeats(docs: DataFrame, with_text: bool = False, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept], one row per row.

    Removed: every byte that a 100-byte string covers which also starts earlier (in a smaller doc_id, or earlier in the
    same document), judged on the input. Defined cases: a null text is empty; texts under 100 bytes stay whole; rows that
    repeat both doc_id and text are one document and give the same row each; rows that repeat a doc_id with another text
    are ordered by a hash of the text; a null doc_id stands before all others. Other columns are not read.

    Scale: about one row in 30 bytes is shuffled (anchor and content hashes, place), copies within a task are settled
    there, so a passage that a third of all documents share costs a few rows a task. Two 64-bit hashes, of the anchor
    and of the segment, decide equality of whole segments; partly equal ones are sorted and compared byte by byte. An
    anchor with more than `crowded` partly equal segments would not fit one task: its strings are taken apart, one row
    each with its bytes, dealt by hash over all tasks, sorted there outside memory and compared byte by byte as well.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.select("doc_id", key.alias("doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), "text")
    if d.select("doc", "th").groupBy("doc").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo <> hi").isEmpty():
        d = d.withColumn("th", F.lit(0).cast("long"))  # each id has one text: nothing more tells documents apart
    once = d.select("doc", "th", "text")
    if _repeated(d):
        once = once.groupBy("doc", "th").agg(F.first("text").alias("text"))
    met = _all_met(once)
    release(spark)
    found = _all_resolved(once, met, crowded)
    release(spark)
    both = _placed(met, 0).select("doc", "th", "a", "n").unionAll(found)
    gone = both.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "n")).alias("spans"))
    out = d.join(gone, ["doc", "th"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return out.mapInArrow(_finish(with_text), schema)
