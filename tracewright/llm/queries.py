"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe, exact_dedup, language, mixing, pages, pii, simhash, substrings, toxicity, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the public word-level vocabulary (49,408 tokens)."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of whole texts, through the snapshot's filters."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of texts and of their edits."""
    return winnowing.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by repeated 100-byte strings."""
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(_table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.bpe_encode(_table(spark, sf_dir, "documents"), vocabulary())


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced. The key here serves tests and checks; a deployment passes its own."""
    return pii.surrogates(_table(spark, sf_dir, "documents"), key="example key")


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components within three bits."""
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of every document for languages at tempered weights."""
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs, docs.select("doc_id", "text", F.col("lang").alias("domain")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_winnowing,
        op3_substring_dedup,
        op4_html_main_text,
        op5_bpe,
        op6_pii_surrogates,
        op7_simhash_components,
        op8_toxicity,
        op9_language,
        op10_mixing,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS norm FROM documents)
        WINDOW g AS (PARTITION BY norm)
    """,
}
