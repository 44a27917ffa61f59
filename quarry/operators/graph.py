"""The property graph as two tables: nodes(key, name, type, aliases, mentions), edges(source_key, target_key, type, chunk_id, evidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import fixed, text
from quarry.sources.shared import materialize


def neighbours(nodes: DataFrame, edges: DataFrame, key: str, depth: int = 1, limit: int = 50) -> DataFrame:
    """One row for each edge out of and into a node, with its evidence; beyond one hop the directed reach without evidence."""
    depth, limit = max(1, min(3, depth)), max(1, min(200, limit))
    named = nodes.filter(F.trim("name") != "").select("key", "name", F.col("type").alias("node_type"))

    def side(at: str, to: str, direction: str) -> DataFrame:
        found = edges.filter(F.col(at) == key).select(F.col(to).alias("key"), F.col("type").alias("relation"), "evidence", "chunk_id")
        return found.join(named, "key").select("name", "node_type", "relation", F.lit(direction).alias("direction"), "evidence", "chunk_id").orderBy("relation", "name", "chunk_id", "evidence").limit(limit)

    out = side("source_key", "target_key", fixed.OUTGOING).unionByName(side("target_key", "source_key", fixed.INCOMING))
    if depth > 1:
        out = out.unionByName(far_neighbours(named, edges, key, depth, limit))
    return out


def far_neighbours(named: DataFrame, edges: DataFrame, key: str, depth: int, limit: int) -> DataFrame:
    links = edges.select("source_key", "target_key").distinct()
    at = links.filter(F.col("source_key") == key).select(F.col("target_key").alias("at")).distinct()
    reached = None
    for _ in range(depth - 1):
        at = at.join(links, at["at"] == links["source_key"]).select(F.col("target_key").alias("at")).distinct()
        reached = at if reached is None else reached.unionByName(at).distinct()
    found = named.join(reached.filter(F.col("at") != key), F.col("key") == F.col("at")).select("name", "node_type").distinct()
    return found.select("name", "node_type", F.lit(fixed.DEFAULT_RELATION).alias("relation"), F.lit(fixed.OUTGOING).alias("direction"), F.lit("").alias("evidence"), F.lit(None).cast("string").alias("chunk_id")).orderBy("name", "node_type").limit(limit)


STEP = "array<struct<source:string,target:string,relation:string,evidence:string>>"


def shortest_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, max_hops: int = 4, directed: bool = False, avoid_types: tuple[str, ...] = ("Lugar",)) -> DataFrame:
    """One row (hops, path of keys, relations, evidence) or none: breadth first, the lexicographically least among the shortest.

    Of each frontier node only the least way there is kept, so a frontier never holds more rows than there are nodes, and a
    node that was reached before isn't entered again. Nodes of avoided types can't be passed, only ended at. A hop is one scan of the
    edges that leave the frontier; parallel edges are reduced after it, so edges elsewhere are never shuffled for their own sake.
    """
    max_hops = max(1, min(5, max_hops))
    seq = F.struct("type", "evidence")
    one = edges.select(F.col("source_key").alias("a"), F.col("target_key").alias("b"), seq.alias("edge"))
    both = one if directed else one.unionByName(edges.select(F.col("target_key").alias("a"), F.col("source_key").alias("b"), seq.alias("edge")))
    links = both.filter("a <> b")
    barred = nodes.filter(F.col("type").isin(*avoid_types)).select("key") if avoid_types else None
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(source, [source], [])], "at string, path array<string>, steps array<struct<type:string,evidence:string>>")
    seen = frontier.select("at")
    for hop in range(1, max_hops + 1):
        moved = frontier.join(links, frontier["at"] == links["a"]).join(seen.withColumnRenamed("at", "_seen"), F.col("b") == F.col("_seen"), "left_anti")
        way = F.struct(F.concat("path", F.array("b")).alias("path"), F.concat("steps", F.array("edge")).alias("steps"))
        if hop == max_hops:  # nothing follows but the end itself
            moved = moved.filter(F.col("b") == target)
        reached = materialize(moved.groupBy(F.col("b").alias("at")).agg(F.min(way).alias("way")).select("at", "way.path", "way.steps"), "frontier")
        hit = reached.filter(F.col("at") == target)
        if hit.take(1):
            return hit.select(F.lit(hop).alias("hops"), "path", F.col("steps.type").alias("relations"), F.col("steps.evidence").alias("evidence"))
        seen = seen.unionByName(reached.select("at"))
        frontier = reached if barred is None else reached.join(barred, reached["at"] == barred["key"], "left_anti")
    return spark.createDataFrame([], "hops int, path array<string>, relations array<string>, evidence array<string>")


def collapse_edges(edges: DataFrame, order: str = "chunk_id") -> DataFrame:
    """Parallel edges as one: how many, and the first one's evidence."""
    return edges.groupBy("source_key", "target_key", "type").agg(F.min_by("evidence", F.struct(order, "evidence")).alias("evidence"), F.count("*").alias("edges"))


def degree(edges: DataFrame) -> DataFrame:
    """Of each node: how often it is an end of a collapsed edge."""
    flat = edges.select("source_key", "target_key", "type").distinct()
    ends = flat.select(F.col("source_key").alias("key")).unionByName(flat.select(F.col("target_key").alias("key")))
    return ends.groupBy("key").agg(F.count("*").alias("degree"))


def page(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes of the graph page: those with an edge, by degree."""
    return nodes.join(degree(edges), "key")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")))


def find_key(nodes: DataFrame, name: str) -> str | None:
    """The key of a name, by key or by alias."""
    spark = nodes.sparkSession
    key = spark.range(1).select(text.name_key(F.lit(name)).alias("k")).first().k
    hit = nodes.filter((F.col("key") == key) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: text.name_key(a) == key)).orderBy(F.col("key") != key, "key").select("key").first()
    return hit.key if hit else None


def export_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes and collapsed edges as two folders of JSON lines: each executor writes its part."""
    nodes.select("key", "name", "type", "mentions").write.mode("overwrite").json(f"{path}/nodes")
    collapse_edges(edges).write.mode("overwrite").json(f"{path}/edges")


def schema_card(nodes: DataFrame, edges: DataFrame) -> str:
    counts = stats(nodes, edges).first()
    return "\n".join(["# Grafo", "", f"- entidades: {counts.nodes}", f"- relacoes: {counts.edges}", "", "## Tipos de entidade", *[f"- {t}" for t in fixed.ENTITY_TYPES], "", "## Tipos de relacao", *[f"- {t}" for t in fixed.RELATION_TYPES]])
