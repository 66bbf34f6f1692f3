"""Exact deduplication: a static binary-fuse filter per immutable snapshot screens incoming digests.

A snapshot holds one row per distinct text, dealt to buckets by digest. Each bucket has one three-wise binary-fuse
filter of 8-bit fingerprints (about 1.13 bytes a key, 1/256 false positives, no false negatives). A batch is first
grouped within itself; its distinct digests are then screened bucket by bucket, and only the positives are joined to the
snapshot's texts, where the bytes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import FEW, few, lean, release, stage

#: Distinct digests to a bucket, and so to one filter.
BUCKET_KEYS = 200_000


# ---------------------------------------------------------------------------------------------------------------------
# Binary-fuse filter
# ---------------------------------------------------------------------------------------------------------------------
def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _layout(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of start segments for n keys."""
    if n <= 1:
        return 4, 1
    length = min(1 << 18, 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
    return length, max(1, int(np.ceil(n * factor / length)) - 2)


def _slots(keys: np.ndarray, seed: int, length: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, in three consecutive segments, and its fingerprint."""
    h = _mix(keys + np.uint64(seed))
    at = ((h >> np.uint64(32)) * np.uint64(starts * length)) >> np.uint64(32)
    mask = np.uint64(length - 1)
    out = np.empty((3, len(keys)), np.int64)
    out[0] = at
    out[1] = (at + np.uint64(length)) ^ ((h >> np.uint64(18)) & mask)
    out[2] = (at + np.uint64(2 * length)) ^ (h & mask)
    return out, (_mix(h) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, start segments, table) for distinct uint64 keys, by peeling in vectorised rounds.

    A peeling round takes every slot that one key alone still touches. Two keys of a round never share such a slot, so
    a round is assigned at once; rounds are assigned in reverse. A seed whose graph has a core is replaced by the next.
    """
    keys = np.unique(keys)
    length, starts = _layout(len(keys))
    size = (starts + 2) * length
    for seed in range(1, 200):
        slots, prints = _slots(keys, seed * 0x9E3779B97F4A7C15 & (2**64 - 1), length, starts)
        count, mixed = np.zeros(size, np.int32), np.zeros(size, np.int64)
        for s in slots:
            np.add.at(count, s, 1)
            np.bitwise_xor.at(mixed, s, np.arange(len(keys)))
        rounds, left = [], len(keys)
        front = np.flatnonzero(count == 1)
        while len(front):
            who, first = np.unique(mixed[front], return_index=True)
            rounds.append((who, front[first]))
            left -= len(who)
            for s in slots[:, who]:
                np.add.at(count, s, -1)
                np.bitwise_xor.at(mixed, s, who)
            touched = np.unique(slots[:, who])
            front = touched[count[touched] == 1]
        if left:
            continue
        table = np.zeros(size, np.uint8)
        for who, own in reversed(rounds):
            s = slots[:, who]
            table[own] = prints[who] ^ table[s[0]] ^ table[s[1]] ^ table[s[2]] ^ table[own]
        return seed, length, starts, table.tobytes()
    raise RuntimeError("no seed peels")


def probe_filter(keys: np.ndarray, seed: int, length: int, starts: int, table: bytes) -> np.ndarray:
    """True where a key may be in the filter; never False for one that is."""
    t = np.frombuffer(table, np.uint8)
    s, prints = _slots(keys, seed * 0x9E3779B97F4A7C15 & (2**64 - 1), length, starts)
    return (t[s[0]] ^ t[s[1]] ^ t[s[2]]) == prints


def _keys(digests: pd.Series) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)


# ---------------------------------------------------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------------------------------------------------
def _digest_columns(norm: pa.Array) -> list[pa.Array]:
    raw = norm.cast(pa.binary()).to_pylist()
    sha = pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())
    return [sha, pa.array(np.array([xxhash.xxh64_intdigest(x, 42) for x in raw], np.uint64).view(np.int64), pa.int64())]


def _digested(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norm = pc.ascii_lower(pc.fill_null(b.column(1), ""))
            yield pa.RecordBatch.from_arrays([b.column(0), *_digest_columns(norm), *([norm] if with_text else [])], names=["doc_id", "digest", "chk", "norm"][: 3 + with_text])

    return run


def digests(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, digest, chk[, norm]): SHA-256 and a second hash of the text with A-Z lower-cased; null counts as empty."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_digested(with_text), "doc_id long, digest binary, chk long" + ", norm string" * with_text)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rest, doc_id, text) with the text as its lower-cased form and the bits of its capitals, null for a null text."""
    for b in batches:
        text = b.column(2)
        norm = pc.ascii_lower(pc.fill_null(text, ""))
        pairs = zip(text.cast(pa.binary()).to_pylist(), norm.cast(pa.binary()).to_pylist(), strict=True)
        bits = [None if t is None else np.packbits(np.frombuffer(t, np.uint8) != np.frombuffer(n, np.uint8)).tobytes() for t, n in pairs]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_digest_columns(norm), norm, pa.array(bits, pa.binary())], names=["rest", "doc_id", "digest", "chk", "norm", "capitals"])


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rest, norm, capitals) to (rest, text)."""
    for b in batches:
        out = []
        for norm, bits in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
            raw = np.frombuffer(norm, np.uint8)
            out.append(None if bits is None else (raw - 32 * np.unpackbits(np.frombuffer(bits, np.uint8), count=len(raw))).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()).cast(pa.string())], names=["rest", "text"])


def build_filters(snapshot: DataFrame) -> DataFrame:
    """One filter a bucket of the snapshot's distinct (bucket, digest)."""

    def build(p: pd.DataFrame) -> pd.DataFrame:
        seed, length, starts, table = build_filter(_keys(p["digest"]))
        return pd.DataFrame({"bucket": [p["bucket"].iloc[0]], "seed": [seed], "length": [length], "starts": [starts], "bits": [table]})

    return snapshot.select("bucket", "digest").groupBy("bucket").applyInPandas(build, "bucket int, seed int, length int, starts int, bits binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The incoming (bucket, digest) that their bucket's filter does not rule out."""

    def probe(p: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if p.empty or f.empty:
            return p[["digest"]].iloc[:0]
        r = f.iloc[0]
        return p[["digest"]][probe_filter(_keys(p["digest"]), int(r["seed"]), int(r["length"]), int(r["starts"]), r["bits"])]

    return incoming.select("bucket", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "digest binary")


@dataclass(frozen=True)
class Snapshot:
    """What an immutable snapshot keeps for later batches: its distinct texts, dealt to buckets, and a filter a bucket.

    texts: bucket, digest, chk, norm, keep (largest doc_id), n (rows). filters: bucket, seed, length, starts, bits.
    """

    texts: DataFrame
    filters: DataFrame
    buckets: int

    @classmethod
    def of(cls, texts: DataFrame, bucket_keys: int = BUCKET_KEYS, path: str | None = None) -> Snapshot:
        """From one row a distinct text; with a path, written there once, to be opened for every batch that comes."""
        buckets = max(1, -(-texts.count() // bucket_keys))
        texts = texts.withColumn("bucket", _bucket(buckets))
        filters = build_filters(texts.select("bucket", "digest").distinct())
        if path is None:
            return cls(texts, stage(filters, "filters"), buckets)
        spark = texts.sparkSession
        texts.select("bucket", "digest", "chk", "norm", "keep", "n").write.parquet(f"{path}/texts")
        filters.write.parquet(f"{path}/filters")
        spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/size")
        return cls.open(spark, path)

    @classmethod
    def build(cls, docs: DataFrame, path: str, bucket_keys: int = BUCKET_KEYS) -> Snapshot:
        """The snapshot of a table, written to `path`."""
        reps = digests(docs, with_text=True).groupBy("digest", "chk", "norm").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n"))
        return cls.of(stage(reps, "texts"), bucket_keys, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Snapshot:
        return cls(spark.read.parquet(f"{path}/texts"), spark.read.parquet(f"{path}/filters"), spark.read.parquet(f"{path}/size").first()["buckets"])

    def matches(self, batch: DataFrame) -> DataFrame:
        """(digest, chk, old_keep, old_n, new_keep, new_n) of the batch's distinct texts that the snapshot holds, byte for byte.

        batch: digest, chk, norm, keep, n, one row a distinct text. Only texts that the filters let through meet the
        snapshot's texts.
        """
        positive = stage(screen(batch.select(_bucket(self.buckets).alias("bucket"), "digest").distinct(), self.filters), "positives")
        hit = batch.join(positive, "digest", "left_semi").select("digest", "chk", F.col("norm").alias("new_norm"), F.col("keep").alias("new_keep"), F.col("n").alias("new_n"))
        old = self.texts.join(positive, "digest", "left_semi").select("digest", F.col("norm").alias("old_norm"), F.col("keep").alias("old_keep"), F.col("n").alias("old_n"))
        same = hit.join(old, "digest").where("new_norm = old_norm")
        return stage(same.select("digest", "chk", "old_keep", "old_n", "new_keep", "new_n"), "same")

    def screened(self, docs: DataFrame) -> DataFrame:
        """doc_id, keep_id, new of a later batch: keep_id is the snapshot's id of an equal text, else the batch's own largest one.

        new tells that the row is the one that stays of a text which the snapshot lacks. The snapshot itself is not
        changed. Null texts are empty; a null doc_id is new only where no other row of the text has an id.
        """
        d = digests(docs, with_text=True)
        batch = stage(d.groupBy("digest", "chk", "norm").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n")), "batch")
        known = self.matches(batch).select("digest", "chk", F.col("old_keep"), F.lit(True).alias("known"))
        of = batch.select("digest", "chk", "keep").join(known, ["digest", "chk"], "left")
        out = digests(docs).join(of, ["digest", "chk"])
        known_ = F.coalesce("known", F.lit(False))
        return out.select("doc_id", F.when(known_, F.col("old_keep")).otherwise(F.col("keep")).alias("keep_id"), (~known_ & F.col("doc_id").eqNullSafe(F.col("keep"))).alias("new"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def _half() -> Column:
    """Half of the ids, by hash."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(2)) == 0


def exact_dedup(docs: DataFrame, is_snapshot: Column | None = None, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Group equal texts (A-Z lower-cased) of a snapshot and of a batch that comes in after it.

    is_snapshot: a Column telling which rows the snapshot was made of; by default half of the ids, by hash. (A snapshot
    that is kept for many batches: Snapshot.build, then Snapshot.open(...).screened(batch).)
    Returns doc_id, keep_id, group_size, kept, text_sha256: one row per input row. The largest doc_id of a group stays.

    Defined cases: a null text is the empty text; empty texts are equal to each other. Repeated rows count in
    group_size, and rows that repeat the id that stays are all kept. A null doc_id never beats another; alone in its
    group it is kept with a null keep_id. Other columns are not read, so clashing names do no harm. No rows in, none out.

    Scale: a group is collapsed on the map side before its text is shuffled, so a third of all rows being copies of one
    text costs one row a map task; ids find their group by a join of 50-byte rows that adaptive execution may split.
    Two SHA-256-equal texts of different bytes stay apart.
    """
    spark = docs.sparkSession
    d = digests(docs, with_text=True)
    old = _half() if is_snapshot is None else is_snapshot
    reps = d.groupBy(old.alias("old"), "digest", "chk", "norm").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n"))
    reps = stage(reps, "texts")
    release(spark)
    snapshot = Snapshot.of(reps.where("old").drop("old"), bucket_keys)
    same = snapshot.matches(reps.where(~F.coalesce("old", F.lit(False))))
    same = same.select("digest", "chk", F.greatest("old_keep", "new_keep").alias("all_keep"), (F.col("old_n") + F.col("new_n")).alias("all_n"))
    release(spark)

    alone = reps.select("digest", "chk", "keep", "n").join(same.select("digest", "chk"), ["digest", "chk"], "left_anti").where("n > 1")
    groups = stage(alone.unionAll(same), "groups")
    out = digests(docs).join(groups, ["digest", "chk"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The rows of `docs`, whole, one of each group of equal texts: that of the largest doc_id.

    The method and the defined cases of exact_dedup; but of rows that repeat id and text one stays, so the result holds
    no two equal texts, whatever the ids. Scale: a row's text is shuffled once, lower-cased, with a bit a byte for its
    capitals; what the filters prove to be alone is not joined to anything.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c != "text"]
    d = docs.select(F.struct(*rest).alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = d.schema["rest"].dataType.simpleString()
    d = d.mapInArrow(lean(_folded), f"rest {kind}, doc_id long, digest binary, chk long, norm string, capitals binary")
    best = F.max_by(F.struct("rest", "capitals"), F.struct("doc_id", F.col("capitals").isNotNull(), F.xxhash64("capitals"))).alias("best")
    reps = stage(d.groupBy(_half().alias("old"), "digest", "chk", "norm").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n"), best), "texts")
    release(spark)
    snapshot = Snapshot.of(reps.where("old").drop("old", "best"), bucket_keys)
    same = snapshot.matches(reps.where(~F.coalesce("old", F.lit(False))).drop("best"))
    old_stays = F.col("new_keep").isNull() | F.coalesce(F.col("old_keep") > F.col("new_keep"), F.lit(False))
    lost = few(stage(same.select("digest", "chk", (~old_stays).alias("lost_old")), "lost"), FEW // 4)  # rows of 41 bytes
    is_old = F.coalesce("old", F.lit(False)).alias("lost_old")
    kept = reps.select("*", is_old).join(lost, ["digest", "chk", "lost_old"], "left_anti")
    out = kept.select("best.rest", "norm", "best.capitals").mapInArrow(lean(_unfolded), f"rest {kind}, text string")
    return out.select(*["text" if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])
