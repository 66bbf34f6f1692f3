"""The bounded sample of labelled rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def least_hashed(known: DataFrame, label: str, rows: int, counts: dict) -> DataFrame:
    """Distinct (doc_id, label) of the `rows` rows a label whose ids have the least hash.

    counts: rows of each label. They tell below which hash half as many rows again as are wanted must lie, so what is
    ranked does not grow with the table, however many rows a label has.
    """
    enough = 1.5 * rows + 64
    bound = F.lit(2**63 - 1)
    for value, n in counts.items():
        if n > enough:
            bound = F.when(F.col(label) == F.lit(value), F.lit(int(enough / n * 2**64) - 2**63)).otherwise(bound)
    near = known.select("doc_id", label).where(F.xxhash64("doc_id") <= bound).distinct()
    w = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    return near.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= rows).select("doc_id", label)


def labelled_texts(docs: DataFrame, label: str, rows: int) -> DataFrame:
    """(label, doc_id, text) of at most `rows` distinct ids a label, by least hash, whole texts; never a held-out row.

    The bound is a parameter of a fit alone, and one of rows: texts of any length take part. Rows that repeat an id and
    a label give one text (the least). Rows without id, label or text teach nothing. Rows are counted first and ids
    chosen below a hash that the counts give, so a label that holds most rows is not gathered.
    """
    known = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    ids = least_hashed(known, label, rows, counts)
    return known.join(F.broadcast(ids), ["doc_id", label], "left_semi").groupBy(label, "doc_id").agg(F.min("text").alias("text"))
