"""The corpus pipeline: documents through five stages, each written as Parquet and read again as the next one's input.

All stages but the last return the columns of documents; the last returns the places of all kept documents in sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, language, lines, pack, similar, simhash
from quarry.llm._base import materialize, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: null, empty and letterless texts, and those that no learnt mixture explains.

    A null id or label is no reason to go. Each of repeated rows is judged by its own text, so copies stay or go together; other
    columns pass through whatever their names; an empty table stays empty; without any label all documents with letters stay.
    """
    return language.keep_identified(docs)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate on their site go from the texts; n_chars follows.

    No document goes. A null source is a site of its own; a null text stays null; repeated rows are pages each; a line at the ratio
    itself stays; other columns pass through whatever their names; an empty table stays empty.
    """
    kept, dropped = lines.drop_boilerplate(docs), lines.count_names(docs)[1]
    return kept.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity 0.8 of 5-word shingles) the document with the smallest doc_id stays.

    A null id comes after all others, ties go by a hash of the row. Rows are told apart by id and text: unlike texts under one id, or
    without one, are decided for themselves, and of rows that agree in both one stays. Texts without words are copies of each
    other. Other columns pass through whatever their names; an empty table stays empty.
    """
    return simhash.keep_one(docs, similar.groups).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or rephrased, go.

    Each row is judged by its own text, whatever its id, so a null or shared id takes no other row along, and copies go together. Null and
    empty texts stay; other columns pass through whatever their names; an empty table stays empty; an empty benchmark
    takes nothing.
    """
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: its place in sequences of at most 2048 tokens.

    A null or empty text is a document of one id; a null doc_id stays null; repeated rows are packed each; ties between pieces of one
    length are by their place in the table; longer documents are cut; an empty table gives no rows.
    """
    return pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("lines", drop_boilerplate_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("benchmark", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Language inference, similarity, latent retrieval and tokenizing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
