"""Entity resolution and the graph's tables: clusters by name key, votes, acronym merge, edge rewrite, mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import fixed, text

MENTION = "name string, type string, chunk_id string, seq long"


def flatten_entities(extractions: DataFrame) -> DataFrame:
    """name, type, chunk_id, seq from extractions(chunk_id, seq, entities array<struct<name,type>>)."""
    rows = extractions.select("chunk_id", "seq", F.posexplode("entities").alias("pos", "e"))
    return rows.select(F.trim("e.name").alias("name"), text.coerce(F.col("e.type"), fixed.ENTITY_TYPES, fixed.DEFAULT_ENTITY).alias("type"), "chunk_id", (F.col("seq") * 100_000 + F.col("pos")).alias("seq")).filter("name <> ''")


def flatten_relations(extractions: DataFrame) -> DataFrame:
    """source, target, type, evidence, chunk_id of the relations whose ends are entities of the same chunk and differ."""
    keys = F.transform("entities", lambda e: text.name_key(e["name"]))
    rows = extractions.select("chunk_id", keys.alias("_keys"), F.explode("relations").alias("r"))
    source, target = text.name_key(F.col("r.source")), text.name_key(F.col("r.target"))
    kept = rows.filter(F.array_contains("_keys", source) & F.array_contains("_keys", target) & (source != target))
    return kept.select("r.source", "r.target", text.coerce(F.col("r.type"), fixed.RELATION_TYPES, fixed.DEFAULT_RELATION).alias("type"), F.coalesce("r.evidence", F.lit("")).alias("evidence"), "chunk_id")


def variants(mentions: DataFrame) -> DataFrame:
    """key, name, type with their counts and first place. mentions: name, type, seq."""
    return mentions.withColumn("key", text.name_key(F.col("name"))).filter("key <> ''").groupBy("key", "name", "type").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


def merge_acronyms(found: DataFrame) -> DataFrame:
    """variants with the keys of acronyms replaced by the key of their long form, where exactly one key has it.

    A long form that is merged away itself is no target, so a chain of merges can't arise.
    """
    names = found.groupBy("key", "name").agg(F.min("first").alias("first"))
    long = names.filter(F.trim("name").contains(" ")).select(text.acronym(F.col("name")).alias("acronym"), F.col("key").alias("target")).filter(F.length("acronym") >= 2).distinct()
    short = names.filter(text.looks_like_acronym(F.col("name"))).select("key", F.upper(F.trim("name")).alias("acronym"), "first")
    pairs = short.join(long, "acronym").filter("target <> key")
    sole = pairs.groupBy("key", "acronym").agg(F.min("first").alias("first"), F.count_distinct("target").alias("n"), F.min("target").alias("target")).filter("n = 1")
    chosen = sole.groupBy("key").agg(F.min_by("target", F.struct("first", "acronym")).alias("target"))
    ends = chosen.join(chosen.select(F.col("key").alias("_moved")), F.col("target") == F.col("_moved"), "left_anti")
    return found.join(ends, "key", "left").withColumn("key", F.coalesce("target", "key")).drop("target")


def nodes(found: DataFrame) -> DataFrame:
    """key, name, type, aliases, mentions: the most frequent spelling (then the longest) and type (then one that says something)."""
    names = found.groupBy("key", "name").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    by_name = names.groupBy("key").agg(F.max_by("name", F.struct("n", F.length("name"), -F.col("first"))).alias("name"), F.sum("n").alias("mentions"), F.collect_list("name").alias("names"))
    types = found.groupBy("key", "type").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    by_type = types.groupBy("key").agg(F.max_by("type", F.struct("n", F.col("type") != fixed.DEFAULT_ENTITY, -F.col("first"))).alias("type"))
    return by_name.join(by_type, "key").select("key", "name", "type", F.array_sort(F.array_except("names", F.array("name"))).alias("aliases"), "mentions")


def resolve(mentions: DataFrame) -> DataFrame:
    return nodes(merge_acronyms(variants(mentions)))


def alias_keys(found_nodes: DataFrame) -> DataFrame:
    """alias_key, key: every spelling's key, and the node's own, lead to the node. One map serves edges and mentions."""
    spelled = found_nodes.select("key", F.explode(F.array_union(F.array("name"), "aliases")).alias("spelling")).select(text.name_key(F.col("spelling")).alias("alias_key"), "key")
    return spelled.unionByName(found_nodes.select(F.col("key").alias("alias_key"), "key")).groupBy("alias_key").agg(F.min("key").alias("key"))


def rewrite_edges(found_nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """source_key, target_key, type, chunk_id, evidence, dropped: those with an unknown end, or with both in one node, are dropped."""
    known = alias_keys(found_nodes)
    ends = relations.withColumns({"_s": text.name_key(F.col("source")), "_t": text.name_key(F.col("target"))})
    one = ends.join(known.select(F.col("alias_key").alias("_s"), F.col("key").alias("source_key")), "_s", "left")
    both = one.join(known.select(F.col("alias_key").alias("_t"), F.col("key").alias("target_key")), "_t", "left")
    lost = F.col("source_key").isNull() | F.col("target_key").isNull() | (F.col("source_key") == F.col("target_key"))
    return both.select("source_key", "target_key", "type", "chunk_id", "evidence", F.coalesce(lost, F.lit(True)).alias("dropped"))


def mention_table(found_nodes: DataFrame, mentions: DataFrame) -> DataFrame:
    known = alias_keys(found_nodes)
    return mentions.select(text.name_key(F.col("name")).alias("alias_key"), "chunk_id").join(known, "alias_key").select(F.col("key").alias("entity_key"), "chunk_id").distinct()


def evaluate_extraction(expected: DataFrame, found: DataFrame, item: str = "item") -> DataFrame:
    """Precision, recall and F1 of sets by case. Nothing expected: recall 1; nothing found either: all 1."""
    e = expected.select("case_id", item).distinct().withColumn("e", F.lit(1))
    f = found.select("case_id", item).distinct().withColumn("f", F.lit(1))
    sums = e.join(f, ["case_id", item], "full_outer").groupBy("case_id").agg(F.count("e").alias("e"), F.count("f").alias("f"), F.count(F.col("e") + F.col("f")).alias("both"))
    p = F.when(F.col("f") == 0, F.when(F.col("e") == 0, 1.0).otherwise(0.0)).otherwise(F.col("both") / F.col("f"))
    r = F.when(F.col("e") == 0, 1.0).otherwise(F.col("both") / F.col("e"))
    return sums.select("case_id", p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
