"""Retrieval: vector and lexical search, rank fusion, expansion over the graph, hybrid search and reranking.

Every operator takes and gives (query_id, chunk_id, score, rank), so that many questions run in one plan; texts and titles
join last. Total orders end in chunk_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.functions import fixed, text
from quarry.operators import blocks

HITS = ("query_id", "chunk_id", "score", "rank")
#: Questions that are broadcast.
QUERY_BLOCK = 256
#: Questions that one task of an exact search by vectors holds.
QUERIES_HELD = 1 << 14


def top(scored: DataFrame, limit: int, *tie: str) -> DataFrame:
    """The best ``limit`` of each query, ranked from 1. Spark cuts each group before its shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *[F.col(t) for t in (tie or ("chunk_id",))])
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return dot / (_norm(a) * _norm(b))


def vector_search(chunks: DataFrame, queries: DataFrame | Column, limit: int = fixed.POOL) -> DataFrame:
    """Exact cosine search. chunks: chunk_id, embedding; queries: query_id, embedding.

    Where the questions are rows themselves, queries may be a column of chunks: the question's id, null for other rows. The table is then
    read once, not twice side by side.

    The rows are dealt evenly to slices, and each slice meets the questions in blocks of bounded size. A task multiplies them in
    blocks and keeps each question's best only, so what it holds and sends on grows with the questions, not with the pairs.
    Rows without an embedding take no part, and vectors of unlike lengths don't meet. Floats travel as floats and are widened where they
    are multiplied. An id may be a struct that begins with the key: what else it holds comes along with the hit.
    """
    own = isinstance(queries, Column)
    asking = chunks.select(queries.alias("query_id")).filter("query_id IS NOT NULL") if own else queries
    parts = max(1, -(-asking.count() // QUERIES_HELD))
    slices = 4 * chunks.sparkSession.sparkContext.defaultParallelism
    asked, found = asking.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType
    kinds = {df.schema["embedding"].dataType.simpleString() for df in ((chunks,) if own else (chunks, queries))}
    v = F.col("embedding").cast("array<float>" if kinds == {"array<float>"} else "array<double>").alias("v")
    nothing, block = F.lit(None), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int") * slices
    slice_ = F.pmod(F.xxhash64("chunk_id"), F.lit(slices)).cast("int")
    to_rows = F.sequence(slice_, slice_ + (parts - 1) * slices, F.lit(slices))
    to_questions = F.sequence(block, block + slices - 1)
    rows = chunks.withColumn("query_id", queries if own else nothing.cast(asked)).filter("embedding IS NOT NULL").select("query_id", "chunk_id", v)
    if own:  # a row goes to its own cells as a row, and to its block's as a question
        cells = lambda at, is_row: F.transform(at, lambda c: F.struct(c.alias("cell"), F.lit(is_row).alias("is_row")))
        both = F.when(F.col("query_id").isNull(), cells(to_rows, True)).otherwise(F.concat(cells(to_rows, True), cells(to_questions, False)))
        all_ = rows.select("query_id", "chunk_id", "v", F.inline(both))
    else:
        q = queries.filter("embedding IS NOT NULL").select("query_id", nothing.cast(found).alias("chunk_id"), v)
        all_ = q.select("*", F.explode(to_questions).alias("cell"), F.lit(False).alias("is_row")).unionByName(rows.select("*", F.explode(to_rows).alias("cell"), F.lit(True).alias("is_row")))
    met = all_.select(F.col("cell").cast("long"), F.size("v").alias("width"), "is_row", "query_id", "chunk_id", "v").repartition(parts * slices, "cell").sortWithinPartitions("cell", "width", "is_row", "chunk_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).cast(pa.int64()).to_numpy() for i in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges, edges[1:]):
                if tuple(keys[lo, :2]) != key:
                    if best:
                        yield from best.result()
                    key, best = tuple(keys[lo, :2]), blocks.Best(limit)
                part = batch.slice(lo, hi - lo)
                values = part.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(hi - lo, -1)
                best.rows(part.column(4), values) if keys[lo, 2] else best.ask(part.column(3), values)
        if best:
            yield from best.result()

    schema = StructType([StructField("query_id", asked), StructField("chunk_id", found), StructField("score", DoubleType())])
    return top(met.mapInArrow(run, schema), limit).select(*HITS)


def vector_topk(chunks: DataFrame, vector: list[float], limit: int = fixed.POOL) -> DataFrame:
    """One question: a scan and a top-k, no join and no shuffle of rows."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = chunks.filter(F.col("embedding").isNotNull()).select(F.lit(0).alias("query_id"), "chunk_id", cosine(F.col("embedding").cast("array<double>"), q).alias("score"))
    best = scored.orderBy(F.desc("score"), "chunk_id").limit(limit)
    return top(best, limit).select(*HITS)


def postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, tf, length: the inverted index. Written once, bucketed or partitioned by term, it serves all searches."""
    return chunks.select("chunk_id", F.explode(text.terms(F.col("content"))).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def matching_postings(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """postings() of the questions' words only, where no index is kept: other words are dropped before anything is counted or shuffled.

    Of more questions than a block, all postings are made: they serve many.
    """
    if not _few(queries):
        return postings(chunks)
    wanted = [r.term for r in query_terms(queries).select("term").distinct().collect()]  # the words of one block of questions
    words = chunks.select("chunk_id", F.explode(text.words(F.col("content"))).alias("term"))  # filtered as rows, inside generated code
    return words.filter(F.col("term").isin(wanted) if wanted else F.lit(False)).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def lengths(chunks: DataFrame) -> DataFrame:
    """chunk_id, len: how many words count, for chunks that have any."""
    counted = chunks.select("chunk_id", F.size(text.terms(F.col("content"))).cast("long").alias("len"))
    return counted.withColumn("len", F.nullif("len", F.lit(0))).filter("len IS NOT NULL")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: distinct words of the questions; one of stop words alone has none."""
    return queries.select("query_id", F.explode(F.array_distinct(text.terms(F.col("text")))).alias("term"))


def lexical_search(index: DataFrame, queries: DataFrame, limit: int = fixed.POOL, weight: float = 0.1) -> DataFrame:
    """Any word may match; the rank adds weight for each matching place. index: postings(); queries: query_id, text."""
    hits = index.join(F.broadcast(query_terms(queries)) if _few(queries) else query_terms(queries), "term")
    scored = hits.groupBy("query_id", "chunk_id").agg((F.lit(weight) * F.sum("tf")).alias("score"))
    return top(scored, limit).select(*HITS)


def _few(queries: DataFrame) -> bool:
    """Questions of which at most one block are there: checked, not assumed."""
    return len(queries.limit(QUERY_BLOCK + 1).select("query_id").collect()) <= QUERY_BLOCK


def bm25_search(index: DataFrame, sizes: DataFrame, queries: DataFrame, limit: int = fixed.POOL, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """index: postings() or matching_postings(); sizes: lengths(). Either may be a kept table.

    The words' weights are added as decimals, whose sum doesn't depend on the order of the rows: copies of a text tie, and go by chunk_id.
    """
    totals = sizes.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    wanted = F.broadcast(query_terms(queries)) if _few(queries) else query_terms(queries)
    hits = index.join(wanted, "term")
    df = hits.select("term", "chunk_id").distinct().groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = hits.join(df, "term").join(sizes, "chunk_id").join(F.broadcast(totals)).groupBy("query_id", "chunk_id").agg(F.sum(weight.cast("decimal(28,17)")).cast("double").alias("score"))
    return top(scored, limit).select(*HITS)


def fuse(rankings: list[tuple[DataFrame, float]], k: int = fixed.RRF_K, limit: int | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion. A ranking without weight is left out of the plan."""
    if k < 1:
        raise ValueError("k must be 1 at least")
    used = [(r, w) for r, w in rankings if w > 0]
    if not used:
        return rankings[0][0].select(*HITS).limit(0)
    parts = [r.select("query_id", "chunk_id", (F.lit(w) / (k + F.col("rank"))).alias("part"), F.lit(i).alias("list")) for i, (r, w) in enumerate(used)]
    fused = reduce(DataFrame.unionByName, parts).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), F.min("list").alias("first_list"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.col("chunk_id").cast("string"))
    ranked = fused.withColumn("rank", F.row_number().over(order))
    return (ranked if limit is None else ranked.filter(F.col("rank") <= limit)).select(*HITS, "first_list")


def hub_ceiling(mentions: DataFrame) -> DataFrame:
    """One row: how many chunks an entity may be mentioned in without being a hub."""
    total = F.greatest(F.lit(1), F.countDistinct("chunk_id"))
    return mentions.agg(F.greatest(F.lit(fixed.HUB_FLOOR), F.floor(total * F.lit(fixed.HUB_RATIO))).alias("ceiling"))


def seed_entities(mentions: DataFrame, hits: DataFrame, limit: int = fixed.SEED_LIMIT) -> DataFrame:
    """query_id, entity_key of the entities that the hits share and the corpus doesn't: frequent here, no hub there."""
    local = mentions.join(hits.select("query_id", "chunk_id"), "chunk_id").groupBy("query_id", "entity_key").agg(F.count("*").alias("local"))
    overall = mentions.join(local.select("entity_key").distinct(), "entity_key", "left_semi").groupBy("entity_key").agg(F.count("*").alias("overall"))
    found = local.join(overall, "entity_key").join(F.broadcast(hub_ceiling(mentions))).filter("overall <= ceiling")
    order = Window.partitionBy("query_id").orderBy(F.desc("local"), F.desc("overall"), "entity_key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "entity_key", "local", "overall", "rank")


def neighbour_keys(edges: DataFrame, seeds: DataFrame, depth: int = 1, fanout: int = fixed.FANOUT) -> DataFrame:
    """query_id, entity_key within depth (1 or 2) of a seed in either direction, at most fanout for each seed, in order of key."""
    depth = max(1, min(2, depth))
    both = edges.select(F.col("source_key").alias("a"), F.col("target_key").alias("b")).unionByName(edges.select(F.col("target_key").alias("a"), F.col("source_key").alias("b"))).filter("a <> b").distinct()
    at = seeds.select("query_id", F.col("entity_key").alias("seed"), F.col("entity_key").alias("at"))
    reached = None
    for _ in range(depth):
        at = at.join(both, at["at"] == both["a"]).select("query_id", "seed", F.col("b").alias("at")).distinct()
        reached = at if reached is None else reached.unionByName(at).distinct()
    order = Window.partitionBy("query_id", "seed").orderBy("at")
    kept = reached.filter(F.col("at") != F.col("seed")).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= fanout)
    return kept.select("query_id", F.col("at").alias("entity_key")).distinct()


def chunks_of_entities(mentions: DataFrame, keys: DataFrame, exclude: DataFrame | None, limit: int = fixed.POOL) -> DataFrame:
    """Chunks that mention the entities, by how many of them they mention."""
    found = mentions.join(keys.select("query_id", "entity_key"), "entity_key")
    if exclude is not None:
        found = found.join(exclude.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return top(found.groupBy("query_id", "chunk_id").agg(F.countDistinct("entity_key").cast("double").alias("score")), limit).select(*HITS)


def expand(mentions: DataFrame, edges: DataFrame, hits: DataFrame, depth: int = 1, max_entities: int = fixed.SEED_LIMIT, limit: int = fixed.POOL) -> DataFrame:
    """From hits over their entities and those entities' neighbours to further chunks."""
    seeds = seed_entities(mentions, hits, max_entities)
    near = neighbour_keys(edges, seeds, depth).join(seeds.select("query_id", "entity_key"), ["query_id", "entity_key"], "left_anti")
    return chunks_of_entities(mentions, near, hits, limit)


def guides(mentions: DataFrame, hits: DataFrame, limit: int = fixed.SEED_LIMIT) -> list[str]:
    """The entities that an expansion of the first hits starts from, best first: limit at most."""
    return [r.entity_key for r in seed_entities(mentions, hits.filter("rank <= 5"), limit).orderBy("rank").collect()]


MODES = ("vector", "lexical", "graph", "hybrid")


def hybrid(vector: DataFrame | None, lexical: DataFrame | None, mentions: DataFrame | None, edges: DataFrame | None, mode: str = "hybrid", limit: int = 5, pool: int = fixed.POOL, graph_weight: float = 0.5) -> DataFrame:
    """All modes as one plan. vector, lexical: rankings of the pool's size.

    The base fusion's first five hits seed the expansion; a second fusion joins both. Without weight there is no expansion.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    pool = max(pool, limit)
    if mode in ("vector", "lexical"):
        return (vector if mode == "vector" else lexical).filter(F.col("rank") <= limit).select(*HITS)
    lists = [(vector, 1.0)] if mode == "graph" else [(vector, 1.0), (lexical, 1.0)]
    base = fuse(lists, limit=pool).select(*HITS)
    if graph_weight <= 0 or edges is None:
        return base.filter(F.col("rank") <= limit)
    more = expand(mentions, edges, base.filter("rank <= 5"), limit=pool)
    return fuse([(base, 1.0), (more, graph_weight)], limit=limit).select(*HITS)


def with_payload(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The texts and citations of ranked ids. Only the few hits meet the wide tables."""
    found = hits.join(chunks.drop("embedding"), "chunk_id").join(documents.select(F.col("id").alias("document_id"), "title", "url"), "document_id")
    return found.withColumn("citation", text.citation(F.col("title"), F.col("section_path"), F.col("url")))


def rerank(hits: DataFrame, questions: DataFrame, scorer, limit: int | None = None) -> DataFrame:
    """hits with content, ordered anew by a provider's scores of (question, content). limit 0 or None: all."""
    pairs = hits.join(F.broadcast(questions.select("query_id", F.col("text").alias("_question"))) if _few(questions) else questions.select("query_id", F.col("text").alias("_question")), "query_id")
    scored = pairs.withColumn("score", scorer(F.col("_question"), F.col("content"))).drop("_question", "rank")
    return top(scored, limit or 1 << 30)


def trace_summary(vector: int, lexical: int, graph: int, fused: int, reranked: int) -> str:
    return f"vetorial={vector} lexical={lexical} grafo={graph} fundidos={fused} rerankeados={reranked}"
