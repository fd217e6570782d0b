"""The corpus pipeline: documents through language ID, near and exact dedup, mixing and tokenizing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever others there
are. An empty table gives no rows. Null keys and repeated rows are rows like any other unless a stage says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import langid, mixing, sentencepiece_scan, simhash, suffix_dedup
from tracewell.llm.common import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a null lang gets the one found. Null and empty texts, and those without a letter, go."""
    judged = langid.predict(docs, langid.fit(docs))
    return judged.where("not rejected").withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest key: five-word shingles, similarity 0.8. Null and empty texts are one group; of repeated rows one stays."""
    return simhash.near_dedup(docs).select(COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that also occur elsewhere. Parts of a character at a cut go too. Null texts become empty; repeated rows of that length lose all."""
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times. A null source is a source; texts without words follow their source."""
    return mixing.mixed(docs).select(COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids; null and empty texts have none."""
    ids = sentencepiece_scan.encode(docs, sentencepiece_scan.read_model())
    return ids.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").alias("n_pieces"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", exact_dedup),
    ("mixing", mixing_),
    ("sentencepiece", sentencepiece),
]

#: SQL has no fingerprints, centroids or subword pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
