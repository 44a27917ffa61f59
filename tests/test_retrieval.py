import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry import providers
from quarry.operators import retrieval as R


def ranking(spark, *ids, query=0):
    return spark.createDataFrame([(query, c, 1.0 / i, i) for i, c in enumerate(ids, 1)], "query_id int, chunk_id string, score double, rank int")


def fused(df):
    return [(r.chunk_id, r.score) for r in df.orderBy("rank").collect()]


def test_one_item_scores_one_over_61(spark):
    assert fused(R.fuse([(ranking(spark, "a"), 1.0)])) == [("a", pytest.approx(1 / 61))]


def test_agreement_beats_one_first_place(spark):
    got = fused(R.fuse([(ranking(spark, "x", "b", "c"), 1.0), (ranking(spark, "y", "b", "d"), 1.0)]))
    assert got[0][0] == "b" and [c for c, _ in got[1:3]] == ["x", "y"]


def test_weights_and_limits(spark):
    a, b = ranking(spark, "a"), ranking(spark, "b")
    assert [c for c, _ in fused(R.fuse([(a, 0.1), (b, 1.0)]))] == ["b", "a"]
    assert [c for c, _ in fused(R.fuse([(a, 0.0), (b, 1.0)]))] == ["b"]
    assert fused(R.fuse([(a, 0.0)])) == []
    assert len(fused(R.fuse([(ranking(spark, "a", "b", "c"), 1.0)], limit=2))) == 2
    with pytest.raises(ValueError):
        R.fuse([(a, 1.0)], k=0)


@pytest.mark.parametrize("block", [256, 1])
def test_vector_search_agrees_with_single_question(spark, monkeypatch, block):
    monkeypatch.setattr(R, "QUERY_BLOCK", block)
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0 - i % 2, 0.5]) for i in range(20)] + [(99, None)], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0, 0.5]), (8, [0.0, 1.0, 0.0])], "query_id int, embedding array<float>")
    many = {(r.query_id, r.rank): r.chunk_id for r in R.vector_search(rows, q, 4).collect()}
    one = {r.rank: r.chunk_id for r in R.vector_topk(rows, [1.0, 0.0, 0.5], 4).collect()}
    assert {k: v for (n, k), v in many.items() if n == 7} == one and len(many) == 8


def test_vector_search_holds_each_questions_best_only(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (700, 8)).astype(float)  # small whole numbers: many copies, and ties between others
    v[5], v[6], v[7:60], v[650] = 0, 2 * v[8], v[8], 0
    for name, size in (("QUESTIONS", 7), ("ROWS", 16), ("PAIRS", 40), ("BATCH", 9)):
        monkeypatch.setattr(R.blocks, name, size)
    best = R.blocks.Best(9)
    best.ask(pa.array([f"q{i}" for i in range(30)]), v[:30])
    for lo in (0, 1, 100, 350):
        best.rows(pa.array(range(lo, {0: 1, 1: 100, 100: 350, 350: 700}[lo])), v[lo : {0: 1, 1: 100, 100: 350, 350: 700}[lo]])
    got = [r for batch in best.result() for r in batch.to_pylist()]
    for i in range(30):
        dot, own, other = ([sum(a * b for a, b in zip(x, y)) for x, y in pairs] for pairs in (((v[i], r) for r in v), ((v[i], v[i]) for r in v), ((r, r) for r in v)))
        score = [max(-1.0, min(1.0, d / (a * b) ** 0.5)) if a * b else math.inf for d, a, b in zip(dot, own, other)]
        want = sorted(range(700), key=lambda c: (-score[c], c))[:9]
        mine = [r for r in got if r["query_id"] == f"q{i}"]
        assert [r["chunk_id"] for r in mine] == want
        assert [math.inf if math.isnan(r["score"]) else r["score"] for r in mine] == [score[c] for c in want]


@pytest.mark.parametrize("held", [1 << 14, 7])
def test_vector_search_in_slices_and_blocks(spark, monkeypatch, held):
    monkeypatch.setattr(R, "QUERIES_HELD", held)
    rows = spark.range(3000).select(F.col("id").alias("chunk_id"), F.array(F.cos("id"), F.sin("id"), F.lit(0.25)).alias("embedding"))
    q = rows.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    zero = spark.createDataFrame([(5000, [0.0, 0.0, 0.0]), (5001, None), (5002, [1.0])], "chunk_id long, embedding array<double>")
    found = R.vector_search(rows.unionByName(zero), q, 3).collect()
    assert len(found) == 180 and {r.chunk_id for r in found if r.rank == 1} == {5000}  # no number comes first, as in SQL
    assert sorted(r.query_id for r in found if r.rank == 2 and r.query_id == r.chunk_id) == list(range(0, 3000, 50))


def test_lexical_any_word_and_stop_words_only(spark):
    chunks = spark.createDataFrame([(1, "aço minério aço"), (2, "minério"), (3, "papel")], "chunk_id int, content string")
    index = R.postings(chunks)
    ask = lambda t: [(r.chunk_id, round(r.score, 6)) for r in R.lexical_search(index, spark.createDataFrame([(0, t)], "query_id int, text string")).orderBy("rank").collect()]
    assert ask("Aço do MINERIO") == [(1, 0.3), (2, 0.1)]
    assert ask("de o que") == []


def test_equal_bm25_scores_go_by_chunk_id_whatever_the_order_of_the_rows(spark):
    counts = list(itertools.permutations([1, 2, 3, 5, 8]))  # the same weights, in each order
    chunks = spark.createDataFrame([(c, " ".join(f"w{c}x{j} " * n for j, n in enumerate(p))) for c, p in enumerate(counts)], "chunk_id long, content string")
    asked = spark.createDataFrame([(0, " ".join(f"w{c}x{j}" for c in range(len(counts)) for j in range(5)))], "query_id int, text string")
    got = R.bm25_search(R.postings(chunks), R.lengths(chunks), asked, limit=len(counts)).orderBy("rank").collect()
    assert len({r.score for r in got}) == 1 and [r.chunk_id for r in got] == list(range(len(counts)))


@pytest.fixture(scope="module")
def graph(spark):
    mentions = spark.createDataFrame([("seed", "c1"), ("seed", "c2"), ("near", "c3"), ("near", "c4"), ("other", "c4"), *[("hub", f"c{i}") for i in range(1, 9)]], "entity_key string, chunk_id string")
    edges = spark.createDataFrame([("seed", "near"), ("other", "seed"), ("near", "far")], "source_key string, target_key string")
    return mentions, edges


def test_expansion_skips_hubs_and_seeds(spark, graph):
    mentions, edges = graph
    hits = ranking(spark, "c1")
    assert [r.entity_key for r in R.seed_entities(mentions, hits).collect()] == ["seed"]
    assert [(r.chunk_id, r.score) for r in R.expand(mentions, edges, hits).orderBy("rank").collect()] == [("c4", 2.0), ("c3", 1.0)]


def test_depth_two_reaches_further(spark, graph):
    _, edges = graph
    seeds = spark.createDataFrame([(0, "seed")], "query_id int, entity_key string")
    assert {r.entity_key for r in R.neighbour_keys(edges, seeds, 1).collect()} == {"near", "other"}
    assert {r.entity_key for r in R.neighbour_keys(edges, seeds, 9).collect()} == {"near", "other", "far"}
    assert len(R.neighbour_keys(edges, seeds, 2, fanout=1).collect()) == 1


def test_hybrid_modes(spark, graph):
    mentions, edges = graph
    v, lex = ranking(spark, "c1", "c5"), ranking(spark, "c6")
    ids = lambda **k: [r.chunk_id for r in R.hybrid(v, lex, mentions, edges, **k).orderBy("rank").collect()]
    assert ids(mode="vector") == ["c1", "c5"] and ids(mode="lexical") == ["c6"]
    assert "c4" in ids(mode="graph") and "c4" in ids(mode="hybrid") and "c4" not in ids(graph_weight=0)
    with pytest.raises(ValueError):
        ids(mode="other")


def test_rerank_orders_by_scorer(spark):
    hits = ranking(spark, "a", "b").withColumn("content", F.when(F.col("chunk_id") == "b", "aço").otherwise("papel"))
    asked = spark.createDataFrame([(0, "aço")], "query_id int, text string")
    assert [r.chunk_id for r in R.rerank(hits, asked, providers.overlap_scorer).orderBy("rank").collect()] == ["b", "a"]
    assert R.rerank(hits, asked, providers.overlap_scorer, 1).count() == 1
