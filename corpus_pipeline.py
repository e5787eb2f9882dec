"""The corpus pipeline: language identification, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.  The
stages take nulls in any column, empty texts, repeated rows, empty tables and further columns (which go).  Texts that a
stage changes get their n_chars anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, minhash, packing, pii, suffixes
from lodestone.llm.common import materialize, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MAX_TOKENS = 1024


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; lang is the one identified.  Those without letters or in no known language go.

    The declared language and the source, as host, are evidence besides the text; where either is null the rest decides.
    Null and empty texts go.  Equal posteriors give the language that comes first by name.  Texts are read whole.
    """
    found = langid.identify(docs.select(*COLUMNS), "text", "lang", F.col("source"))
    return found.where(~F.col("language_rejected")).withColumn("lang", F.col("language")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id; of rows that share a doc_id the least.

    Documents without words are in no group and stay, as do rows without a doc_id.
    """
    return minhash.one_of_each(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also start earlier; what a cut leaves of a broken character goes with it.

    A document of which nothing is left goes; one that had no text stays, and so do rows without a doc_id.  Of equal passages
    the one in the least doc_id stays.  Very long texts are cut like any other, one row at a time.
    """
    docs = docs.select(*COLUMNS)
    cut = suffixes.cut(docs, suffixes.repeated_windows(docs), COLUMNS)
    changed = F.col("n_removed") > 0
    left = cut.where((F.col("n_removed") == 0) | (F.col("left") != ""))
    text = F.when(changed, F.col("left")).otherwise(F.col("text"))
    return left.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length("left").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind.

    Null and empty texts stay as they are.  Where spans overlap, see pii.redact.
    """
    found = pii.redact(pii.find_spans(docs.select(*COLUMNS)))
    changed = F.size("pii_spans") > 0
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of MAX_TOKENS ids.

    A null or empty text is one piece of the end id; long texts are cut into pieces, each placed once.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), MAX_TOKENS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Trigram posteriors, MinHash buckets and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
