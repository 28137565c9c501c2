"""A corpus from raw documents to training tokens: five stages, each on all rows that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Defined results: extra columns of the input are left out; null texts fail the quality rules (they have no words); of documents that repeat or resemble
each other the one with the smallest doc_id stays; bytes that repeat across what is left are removed, and n_chars follows;
a document that the mix takes twice is in its output twice, one that it doesn't take is not; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cloakframe.llm import bpe, jaccard, mixing, quality, suffix
from cloakframe.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Strings of so many bytes, and shorter ones of so many words (passages of over 50 words), that repeat are removed.
REPEAT_BYTES, REPEAT_WORDS = 240, 51


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject."""
    return quality.judged(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more over five-word shingles connect."""
    groups = jaccard.joined(docs)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"))
    kept = docs.select(*COLUMNS).join(first, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that also start anywhere else."""
    cut = suffix.deduplicated(docs.select(*COLUMNS), REPEAT_BYTES, with_text=True, words=REPEAT_WORDS)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of training positions."""
    rows = docs.select(*COLUMNS).withColumn("size", mixing.word_count(F.col("text")))
    taken = mixing.mixed(rows).select(*COLUMNS, F.explode("positions").alias("__at"))
    return taken.orderBy("__at", "doc_id").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every text, and digests of them and of what they decode to."""
    return bpe.encoded(docs, bpe.vocabulary_path(), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixed_sources),
    ("BPE encoding and decoding", tokens),
]
#: Learned rules, hashes of strings and tokenizers have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
