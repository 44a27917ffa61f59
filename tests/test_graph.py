import json

import pytest

from quarry.operators import graph as G
from quarry.operators import resolution as E
from quarry.sources import store


@pytest.fixture(scope="module")
def tables(spark):
    nodes = spark.createDataFrame([("alfa", "Alfa", "Organizacao", ["AF"], 2), ("beta", "Beta", "Organizacao", [], 1), ("gama", "Gama", "Organizacao", [], 1), ("cidade", "Cidade", "Lugar", [], 1), ("vazio", " ", "Outro", [], 1)], store.SCHEMAS["nodes"])
    edges = spark.createDataFrame([("alfa", "beta", "CONTROLA", "c1", "Alfa controla Beta"), ("beta", "gama", "FORNECE_PARA", "c2", "Beta fornece"), ("alfa", "cidade", "LOCALIZADA_EM", "c1", "em Cidade"), ("gama", "cidade", "LOCALIZADA_EM", "c3", "em Cidade"), ("alfa", "vazio", "PRODUZ", "c1", "")], store.SCHEMAS["edges"])
    return nodes, edges


def test_neighbours_by_direction(tables):
    rows = {(r.name, r.direction, r.relation) for r in G.neighbours(*tables, "beta").collect()}
    assert rows == {("Alfa", "entrando", "CONTROLA"), ("Gama", "saindo", "FORNECE_PARA")}
    assert all(r.name.strip() for r in G.neighbours(*tables, "alfa").collect())


def test_far_neighbours_have_no_evidence(tables):
    far = [r for r in G.neighbours(*tables, "alfa", depth=2).collect() if r.relation == "RELACIONADA_A"]
    assert {r.name for r in far} == {"Gama"} and all(r.evidence == "" for r in far)


def test_shortest_path_avoids_places_in_between(tables):
    row = G.shortest_path(*tables, "alfa", "gama").first()
    assert row.hops == 2 and row.path == ["alfa", "beta", "gama"] and row.relations == ["CONTROLA", "FORNECE_PARA"]
    assert G.shortest_path(*tables, "alfa", "gama", avoid_types=()).first().path == ["alfa", "beta", "gama"]
    assert G.shortest_path(*tables, "gama", "alfa", directed=True).count() == 0
    assert G.shortest_path(*tables, "alfa", "cidade").first().hops == 1
    assert G.shortest_path(*tables, "alfa", "nowhere").count() == 0


def test_export_collapses_parallel_edges(spark, tables, tmp_path):
    twice = tables[1].unionByName(spark.createDataFrame([("alfa", "beta", "CONTROLA", "c9", "de novo")], store.SCHEMAS["edges"]))
    row = G.collapse_edges(twice).filter("source_key = 'alfa' AND target_key = 'beta'").first()
    assert row.edges == 2 and row.evidence == "Alfa controla Beta"
    G.export_json(tables[0], twice, str(tmp_path))
    assert json.loads(next((tmp_path / "nodes").glob("*.json")).read_text().splitlines()[0])["key"]


def test_find_key_by_alias_and_degree(tables):
    assert G.find_key(tables[0], "ALFA S.A.") == "alfa" == G.find_key(tables[0], "AF") and G.find_key(tables[0], "nada") is None
    assert {r.key: r.degree for r in G.degree(tables[1]).collect()}["alfa"] == 3


def test_edge_upsert_is_idempotent_and_needs_both_ends(spark, tables):
    nodes, edges = tables
    once = store.upsert_edges(None, edges, nodes)
    assert store.upsert_edges(once, edges, nodes).count() == once.count() == 5
    assert store.upsert_edges(None, spark.createDataFrame([("alfa", "xx", "PRODUZ", "c", "e")], store.SCHEMAS["edges"]), nodes).count() == 0


def mentions(spark, *rows):
    return spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(rows)], "name string, type string, seq long")


def test_votes_and_names(spark):
    rows = mentions(spark, ("Vale", "Outro"), ("VALE S.A.", "Organizacao"), ("Vale", "Organizacao"), ("Vale", "Outro"))
    (node,) = E.resolve(rows).collect()
    assert (node.name, node.type, node.aliases, node.mentions) == ("Vale", "Organizacao", ["VALE S.A."], 4)


def test_acronym_merges_only_without_ambiguity(spark):
    rows = [("Companhia Siderúrgica Nacional", "Organizacao"), ("COMPANHIA SIDERURGICA NACIONAL", "Organizacao"), ("CSN", "Organizacao")]
    assert E.resolve(mentions(spark, *rows)).count() == 1
    assert E.resolve(mentions(spark, *rows, ("Centro Social Norte", "Organizacao"))).count() == 3


def test_relations_need_both_entities_of_the_chunk(spark):
    x = spark.createDataFrame([("c", 0, [("Alfa", "Organizacao"), ("Beta", "?")], [("Alfa", "BETA", "CONTROLA", "e"), ("Alfa", "Zeta", "CONTROLA", "e"), ("Alfa", "alfa", "x", "e"), ("Beta", "Alfa", "x", None)])], "chunk_id string, seq long, entities array<struct<name:string,type:string>>, relations array<struct<source:string,target:string,type:string,evidence:string>>")
    assert {(r.source, r.target, r.type) for r in E.flatten_relations(x).collect()} == {("Alfa", "BETA", "CONTROLA"), ("Beta", "Alfa", "RELACIONADA_A")}
    assert {r.type for r in E.flatten_entities(x).collect()} == {"Organizacao", "Outro"}


def test_precision_recall(spark):
    e = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "case_id int, item string")
    f = spark.createDataFrame([(1, "a"), (3, "x")], "case_id int, item string")
    got = {r.case_id: (r.precision, r.recall, round(r.f1, 3)) for r in E.evaluate_extraction(e, f).collect()}
    assert got == {1: (1.0, 0.5, 0.667), 2: (0.0, 0.0, 0.0), 3: (0.0, 1.0, 0.0)}
