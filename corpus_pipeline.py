"""The corpus pipeline: language ID, line dedup, near-duplicate groups,
benchmark decontamination, packing.

A stage takes (spark, docs, sf_dir), where ``docs`` has the columns of
``documents``, works on all of it and returns what it keeps, with the same
columns; the last returns the packed pieces.  Clean documents pass unchanged,
but for a null lang, which becomes the predicted language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstream.llm import decontamination, jaccard, language_id, line_dedup, packing
from fleetstream.llm.common import release, stored, table


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go; where lang
    is null, the predicted language is written.  Where no row can be learned from,
    every text with a letter stays.  No margin rejects a text with a letter: text
    of no learned language, and junk of letters, pass."""
    return language_id.identified(docs, language_id.fit(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of two lines or more go; a document goes
    when it had such lines only."""
    out = line_dedup.dedup_lines(docs, min_lines=2)
    changed = F.col("n_removed") > 0
    return (out.filter(~changed | (F.col("n_removed") < F.col("n_lines")))
            .withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
            .select(*docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    return jaccard.one_of_each(docs, threshold=80, size=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row with a benchmark item go."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"), window=10)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, capacity=2048)


STAGES = [
    ("language ID", identify_languages),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
        release(spark, keep=f"pipeline-{k}")  # what the stage has read, and stored for itself
    return docs


#: Token ids, and the components of similar documents, are not for SQL: tests hold run() against plain Python.
ORACLE_SQL = None
