"""The corpus pipeline: toxicity, exact copies, near copies, mixing, tokens. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe, exact_dedup, mixing, near, toxicity
from tracewright.llm.queries import vocabulary
from tracewright.session import ship, small_batches, stage


def _ready(spark: SparkSession) -> None:
    ship(spark)
    small_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity score rejects go; each is judged by its own text, so null and repeated ids are as any other."""
    _ready(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (ASCII case aside; null is empty) the row with the largest doc_id stays, and one alone of rows that repeat."""
    _ready(spark)
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a five-word Jaccard similarity of 0.8 or more the row of the smallest doc_id stays, a null one last.

    Covering SimHash tables propose pairs, prefix filtering proposes those they miss, and whole sets decide.
    """
    _ready(spark)
    return near.without_near_copies(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages mixed upward to tempered weights: every document stays, and stands as often as its rate says.

    A row that stands twice is meant to be seen twice in training; it is no copy that the stages before overlooked. Rows
    without a language teach the classifier nothing and are mixed by their posteriors like all others.
    """
    labelled = docs.select("doc_id", "text", F.col("lang").alias("domain"))
    mixed = mixing.mix(docs, labelled, whole=True, carry=True)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), "copies"))).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row that is left; a null text has no tokens."""
    _ready(spark)
    return bpe.bpe_encode(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("bpe", tokenize),
]

#: Classifiers, fingerprints and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
