"""The corpus pipeline: documents that stay, cleaned, packed into sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir). A stage's result is written as Parquet and
read back as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import minhash, packing, pii, suffix, toxicity
from cadenza.llm.common import Scratch
from cadenza.llm.queries import PII_KEY, labels, vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 3: documents that the chain rejects go. Models are fitted on the labelled documents of the corpus.

    Null and empty texts stay; repeated rows share their fate; null ids are scored like others; columns pass unchanged.
    """
    chain = toxicity.fit(docs, labels(spark, sf_dir))
    return toxicity.keep_clean(docs, chain)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 1: of each group of near-duplicates (five-word shingles, similarity 0.8) the row of the smallest doc_id stays.

    Rows are compared, whatever their ids: of repeated rows one stays, a null id counts as the largest, and ties go to
    any one row. Null texts and texts without words are duplicates of nothing.
    """
    scratch = Scratch(spark, "minhash_stage")
    row = F.monotonically_increasing_id().alias("row")
    numbered = scratch.table(docs.select(row, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), "numbered")
    keyed = numbered.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").alias("text"))
    groups = minhash.near_duplicates(keyed, id_col="row", words=5, num=80, den=100).select(F.col("doc_id").alias("row"), "component_id")
    named = groups.join(keyed.select("row", "doc_id").hint("merge"), "row")
    stays = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
    kept = numbered.join(stays.select(F.col("first.row").alias("row")).hint("merge"), "row", "left_semi")
    return kept.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 6: bytes of repeated passages go; a cut character goes whole. n_chars follows the text.

    Null texts and rows with a null id stay as they are; repeated rows of an id and a text are cut alike.
    """
    kept = suffix.without_repeats(docs, length=100)
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 8: personal data are replaced; n_chars follows the text.

    Null and empty texts stay as they are; texts are matched by content, so ids and repeated rows make no difference.
    """
    out = pii.surrogates(docs, PII_KEY)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 10: sequences of at most 2048 tokens. Every row is packed, null and empty texts as their end id alone."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_dedup", minhash_stage),
    ("suffix_array_dedup", suffix_stage),
    ("pii_surrogates", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: Model fitting and bin completion are beyond SQL: tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
