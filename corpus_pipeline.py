"""The cleaning pipeline of the text corpus, stage by stage over the table of documents.

Every stage gets what its predecessor kept and returns a DataFrame; run() writes each stage's rows
as Parquet in the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import bpe, decontam, pii, quality_rules, simhash
from footfall.llm.common import stored
from footfall.llm.queries import PSEUDONYM_KEY, table, vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
POLICY = "web-1"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps."""
    entries = quality_rules.ledger(docs.select(*COLUMNS))
    return entries.where(quality_rules.keeps(POLICY)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints of four-word shingles linked at 4 bits or fewer: the one with the least doc_id."""
    return simhash.first_of_each(docs.select(*COLUMNS), width=4, distance=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    found = decontam.flagged(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms for personal data; n_chars follows the text."""
    made = pii.pseudonymise(docs.select(*COLUMNS), PSEUDONYM_KEY)
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of the text, their count and digest, and the digest of what they decode to."""
    coded = bpe.encode(docs.select("doc_id", "text"), vocabulary_path("word_bpe_49k.json"))
    return bpe.summary(coded, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("encoding", encoding),
]

#: Hash votes, BM25, keyed permutations and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
