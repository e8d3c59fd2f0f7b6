"""The corpus pipeline: language ID, near-duplicate removal, secret redaction, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. run() writes each stage's result as Parquet to the shared folder
and reads it back as the next one's docs; a result goes when the stages after the next have no use
for it, the last with the application.

Defined results, by stage; all keep extra columns as they are, whatever their names, and give no rows
for an empty table, the last one reading doc_id and text only:

* language ID: documents with null, empty or letterless texts go, as do those whose score is under
  LEAST_SCORE; documents without a lang are judged like others; repeated rows are judged each.
* near-dedup: see without_near_duplicates(): of equal or near texts the smallest doc_id stays (null
  last); documents without words are no duplicates of each other unless their rows are equal.
* secret scans: all rows stay; n_chars is that of the masked text, and that of the row where the text
  is null.
* packing: a null text is packed as its end mark alone; repeated rows are packed each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.functions.shipping import ship
from roadlens.llm.common import cut, forget, table
from roadlens.llm.languages import UNKNOWN, fit, identify
from roadlens.llm.minhash import without_near_duplicates
from roadlens.llm.packing import best_fit, byte_lengths
from roadlens.llm.secrets import redacted

LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: neither without letters nor scored as a mere guess."""
    ship(spark)
    judged = identify(docs.select("text", F.struct(*docs.columns).alias("doc")), fit(docs))
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    ship(spark)
    return without_near_duplicates(docs, k=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars of the masked text."""
    ship(spark)
    length = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return docs.withColumn("text", redacted(F.col("text"))).withColumn("n_chars", length)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of every document, in byte tokens."""
    ship(spark)
    return best_fit(byte_lengths(docs))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", packing),
]

ORACLE_SQL = None  # language ID, MinHash groups and packing are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"stage{k}")
        forget(before)  # tables read from sf_dir aren't cut() ones and stay
    return STAGES[-1][1](spark, docs, sf_dir)
