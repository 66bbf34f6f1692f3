"""Document fingerprints by winnowing, in DataFrame functions only.

A token is a word of at most 16 characters between blanks; a longer run without blanks (a script that has none, an
encoded line) counts character by character, so that no shift inside it changes its tokens. Every eight consecutive
tokens are a k-gram. Its hash is the polynomial of its token hashes modulo a prime (Karp-Rabin), rolled along the array
by doubling: the hash of a gram is that of its first half, moved on, plus that of its second half, whose hashes every
position has already. Of each window of eight consecutive k-grams the least hash is kept, the rightmost on ties, with
its position. Two texts that share fifteen consecutive tokens share a kept hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import partitions

#: Tokens of a k-gram (a power of two) and k-grams of a window.
GRAM, WINDOW = 8, 8
TOKEN = r"(?<!\S)\S{1,16}(?!\S)|\S"
#: The polynomial's base and prime modulus; products stay below 2^62.
BASE, PRIME = 1_000_003, (1 << 31) - 1
#: Documents to a block of neighbouring ids, and the most blocks there are.
BLOCK_ROWS, MOST_BLOCKS = 1000, 65_536
_LOW = 0xFFFFFFFF


def _tokens(text: Column) -> Column:
    """31-bit hashes of the tokens, modulo the prime."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t).bitwiseAND(F.lit(0x7FFFFFFF)) % F.lit(PRIME))


def _later(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.size(a))


def _joined(moved: int):
    """The hash of a gram from those of its halves."""
    return lambda a, b: (a * F.lit(moved).cast("long") + F.coalesce(b, F.lit(0).cast("long"))) % F.lit(PRIME)


def winnow(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the kept k-grams of a text in order: hash (31 bits) in the high half of a long, 2^32 - 1 - position in the low half.

    Each array that a step reads twice is a column of its own: inside one expression it would be made anew.
    """
    keep = df.columns
    g, n = F.col("_g"), F.col("_n")
    df = df.select(*keep, _tokens(F.col(text)).alias("_g")).withColumn("_n", F.size("_g"))
    short = F.array(F.aggregate(g, F.lit(0).cast("long"), lambda acc, x: (acc * F.lit(BASE) + x) % F.lit(PRIME)))
    df = df.withColumn("_short", F.when((n > 0) & (n < GRAM), short))
    for half in (1 << k for k in range(GRAM.bit_length() - 1)):
        # past the end there is no second half, and the gram is dropped below
        df = df.withColumn("_g", F.zip_with(g, _later(g, half), _joined(pow(BASE, half, PRIME))))
    whole = F.slice(g, F.lit(1), F.greatest(n - (GRAM - 1), F.lit(0)))
    df = df.withColumn("_g", F.coalesce("_short", whole)).drop("_short").withColumn("_n", F.size("_g"))
    df = df.withColumn("_g", F.transform(g, lambda x, i: F.shiftleft(x, 32).bitwiseOR(F.lit(_LOW) - i.cast("long"))))
    for step in (1 << k for k in range(WINDOW.bit_length() - 1)):  # windows of 2, 4, 8; past the end, least() takes what is there
        df = df.withColumn("_g", F.zip_with(g, _later(g, step), lambda a, b: F.least(a, b)))
    windows = F.when(n == 0, 0).otherwise(F.greatest(n - (WINDOW - 1), F.lit(1)))
    return df.select(*keep, F.array_distinct(F.slice(g, F.lit(1), windows)).alias(out))


def hashes(kept: Column) -> Column:
    """The set of kept hashes."""
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, 32).cast("int")))


def positions(kept: Column) -> Column:
    """The k-gram positions (in tokens, from 0) of the kept hashes, in order."""
    return F.transform(kept, lambda x: (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).cast("int"))


def as_string(kept: Column) -> Column:
    """Eight hex digits a kept hash, in the order of the text."""
    return F.array_join(F.transform(kept, lambda x: F.lower(F.lpad(F.hex(F.shiftright(x, 32)), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Resemblance of two hash sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), union)).cast("double")


def _blocked(d: DataFrame) -> DataFrame:
    """Add `block`, ascending along (down, th): as many rows in one block as in another, whatever the ids.

    Bounds are quantiles of `down`, found by a search that is unrolled into expressions. A value that takes up several
    quantiles (an id that many rows repeat) is dealt to as many blocks by its rows' text hashes.
    """
    count = d.count()
    blocks = min(MOST_BLOCKS, max(1, -(-count // BLOCK_ROWS)))
    if blocks == 1:
        return d.withColumn("block", F.lit(0))
    at = ",".join(repr(k / blocks) for k in range(1, blocks))
    bounds = d.agg(F.expr(f"percentile_approx(down, array({at}), {max(10_000, 2 * blocks)})")).first()[0]
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    d = d.withColumn("_below", F.lit(0)).withColumn("_upto", F.lit(0))
    for step in (1 << k for k in reversed(range((blocks - 1).bit_length()))):
        for name, passed in (("_below", F.get(table, F.col("_below") + (step - 1)) < F.col("down")), ("_upto", F.get(table, F.col("_upto") + (step - 1)) <= F.col("down"))):
            d = d.withColumn(name, F.when(passed, F.col(name) + step).otherwise(F.col(name)))
    several = F.col("_upto") - F.col("_below")
    share = F.col("th") / F.lit(float(1 << 64)) + F.lit(0.5)
    return d.withColumn("block", F.col("_below") + F.least(F.floor(share * (several + 1)).cast("int"), several)).drop("_below", "_upto")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit, whose last third comes from the next document by descending doc_id.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, positions,
    edited_positions (of the kept k-grams, in tokens): one row per row. Defined cases: a null text is empty (no hashes;
    empty string; likeness 1 to another without tokens, else 0). A text of fewer than eight tokens has one k-gram of them
    all. Rows that repeat a doc_id follow each other in the order of a hash of their texts. A null doc_id stands last, as
    the least long does. A lone document is its own next. Other columns are not read.

    Scale: rows are dealt to blocks of about a thousand neighbours (at most 65,536 blocks, so the table of their first
    rows is broadcast with a known bound). Each block's first text is sent once more, to the block before it; every text
    is shuffled once, no order over the whole table is made.
    """
    n = partitions(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    down = F.bitwise_not(F.coalesce("doc_id", F.lit(-(2**63))))
    d = _blocked(d.select("*", down.alias("down"), F.xxhash64("text").alias("th")))
    # the first row of each block goes to the end of the block before it, the very first to the end of the last
    rank = F.struct("down", "th")
    tops = d.groupBy("block").agg(F.min(rank).alias("top"))
    by = Window.orderBy("block")
    tops = tops.select("top", F.coalesce(F.lag("block").over(by), F.max("block").over(Window.partitionBy())).alias("to"))
    ghosts = d.withColumn("top", rank).join(F.broadcast(tops), "top").groupBy(F.col("to").alias("block")).agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "down", "th")])
    rows = d.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    rows = winnow(rows.repartition(n, "block"), "text", "kept")
    w = Window.partitionBy("block").orderBy("ghost", "down", "th")
    rows = rows.select("doc_id", "text", "kept", "ghost", F.lead("text").over(w).alias("next"), F.lead("kept").over(w).alias("next_kept")).where(~F.col("ghost"))
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - third), F.substring(F.col("next"), F.lit(1), third))
    rows = rows.select("doc_id", "kept", "next_kept", size.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = winnow(rows, "edited", "edited_kept")
    rows = rows.select("*", *[hashes(F.col(c)).alias(f"_{c}") for c in ("kept", "next_kept", "edited_kept")])
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("kept")).alias("fingerprint"),
        as_string(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("_kept"), F.col("_edited_kept")).alias("near_edited"),
        likeness(F.col("_kept"), F.col("_next_kept")).alias("near_next"),
        positions(F.col("kept")).alias("positions"),
        positions(F.col("edited_kept")).alias("edited_positions"),
    )
