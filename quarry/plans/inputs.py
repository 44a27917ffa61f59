"""The driver's tables as the engine's: documents and chunks, questions, entities with mentions, and a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import fixed

#: Words of this length stand for entities in these tables, which have none of their own.
ENTITY_LENGTH = 12


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def chunks(spark, sf_dir) -> DataFrame:
    """Each document is a chunk; its vector is that of the same number, where there is one."""
    docs, vectors = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    return docs.join(vectors, docs["doc_id"] == vectors["vec_id"], "left").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("ordinal"), F.col("text").alias("content"), F.col("source").alias("section_path"), "embedding")


def plain_chunks(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def vectors(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def documents(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("url"))


def vector_questions(spark, sf_dir) -> DataFrame:
    """Every fiftieth vector is a question, asked of all."""
    return read(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def benchmark_questions(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _long_words(spark, sf_dir) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[ \n]+"), lambda w: F.length(w) >= ENTITY_LENGTH)
    return read(spark, sf_dir, "documents").select("doc_id", words.alias("w"))


def mentions(spark, sf_dir) -> DataFrame:
    return _long_words(spark, sf_dir).select(F.explode("w").alias("entity_key"), F.col("doc_id").alias("chunk_id")).distinct()


def word_edges(spark, sf_dir) -> DataFrame:
    """Neighbouring entities of a chunk are related."""
    pairs = F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b")))
    rows = _long_words(spark, sf_dir).filter(F.size("w") > 1).select("doc_id", pairs.alias("p"))
    return rows.select(F.col("p.a").alias("source_key"), F.col("p.b").alias("target_key"), F.lit(fixed.DEFAULT_RELATION).alias("type"), F.col("doc_id").alias("chunk_id"), F.lit("").alias("evidence"))


def graph_nodes(spark, sf_dir) -> DataFrame:
    def of(table, key, name, kind):
        prefix = table + ":"
        return read(spark, sf_dir, table).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("key"), F.col(name).alias("name"), F.lit(kind).alias("type"), F.lit(1).cast("long").alias("mentions"))

    return of("region", "r_regionkey", "r_name", "Lugar").unionByName(of("nation", "n_nationkey", "n_name", "Lugar")).unionByName(of("supplier", "s_suppkey", "s_name", "Organizacao")).unionByName(of("customer", "c_custkey", "c_name", "Organizacao")).unionByName(of("part", "p_partkey", "p_name", "Produto"))


def graph_edges(spark, sf_dir) -> DataFrame:
    """Places of nations, suppliers and customers; a supplier supplies a part once for each order line, which is the evidence."""

    def of(rows, source, target, kind, chunk, evidence):
        return rows.select(source.alias("source_key"), target.alias("target_key"), F.lit(kind).alias("type"), chunk.cast("string").alias("chunk_id"), evidence.cast("string").alias("evidence"))

    key = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    nation, supplier, customer, line = (read(spark, sf_dir, t) for t in ("nation", "supplier", "customer", "lineitem"))
    return (
        of(nation, key("nation", "n_nationkey"), key("region", "n_regionkey"), "LOCALIZADA_EM", F.lit("n"), F.col("n_name"))
        .unionByName(of(supplier, key("supplier", "s_suppkey"), key("nation", "s_nationkey"), "LOCALIZADA_EM", F.lit("s"), F.col("s_name")))
        .unionByName(of(customer, key("customer", "c_custkey"), key("nation", "c_nationkey"), "LOCALIZADA_EM", F.lit("c"), F.col("c_name")))
        .unionByName(of(line, key("supplier", "l_suppkey"), key("part", "l_partkey"), "FORNECE_PARA", F.col("l_orderkey"), F.col("l_linenumber")))
    )
