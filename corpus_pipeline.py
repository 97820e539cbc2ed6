"""A training corpus from documents: known languages, repeated lines, near-duplicates, benchmark items, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on; run() writes each as Parquet in the shared folder and reads it again.
The rows of run() can't be told by SQL, as the language model and the packing are iterative; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordlog.llm import decontamination, language_id, line_dedup, packing, simhash
from ordlog.llm.common import saved, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter and those of no likely language go: null and empty texts with them. Repeated rows
    stay or go each, other columns stay, an empty table gives no rows."""
    return language_id.keep_known(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that have occurred before, in order of doc_id and line, go, and documents of which nothing but white space is left. Null and empty
    texts and rows without doc_id stay as they are; rows of equal doc_id and text are one document; other columns stay, and n_chars follows the
    text. An empty table gives no rows."""
    return line_dedup.deduplicate(docs, drop_empty=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles, with a similarity of 0.8 or more, stays: the one of the least doc_id. Texts
    without words are one group, null among them; of equal rows one stays; rows without doc_id stay; other columns stay. An empty table
    gives no rows."""
    return simhash.deduplicate_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; equal rows go together; rows without doc_id go by their text; other
    columns stay. Without documents there are no rows, and without items all stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their places in sequences. Null and empty texts are a piece of the end token; repeated rows are packed each;
    other columns go. An empty table gives no rows."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of the documents that the stages leave. What each stage does with nulls, empty and very long texts, ties, repeated rows, other columns
    and empty tables holds here too: whole texts are read, however long, and an empty table of documents gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
