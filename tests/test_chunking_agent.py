import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions import fixed
from quarry.operators import agent, chunking, evaluate

TEXT = "Lead.\n\n== Historia ==\nAntes.\n\n=== Inicio ===\nPrimeiro ano.\n\n=== Fim ===\nUltimo ano.\n\n== Hoje ==\nAgora."


def test_trails():
    assert [(path, p) for path, ps in chunking.layout(TEXT) for p in ps] == [("", "Lead."), ("Historia", "Antes."), ("Historia > Inicio", "Primeiro ano."), ("Historia > Fim", "Ultimo ano."), ("Hoje", "Agora.")]
    assert chunking.cut("") == []


def test_markdown_headings_only_when_asked():
    assert chunking.cut("# A\nb", chunking.Sizes(markdown=True)) == [("A", "b")]
    assert chunking.cut("# A\nb") == [("", "# A\nb")]


def test_overlap_and_short_tail():
    sizes = chunking.Sizes(most=100, overlap=20, least=10)
    a, b = "a" * 70, "b" * 60
    got = chunking.cut(f"{a}\n\n{b}\n\n{'c' * 5}", sizes)
    assert got[1][1].startswith("a" * 20 + "\n\n" + "b" * 60) and got[1][1].endswith("c" * 5)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB. \n=", max_size=600), st.integers(20, 120))
def test_no_chunk_is_too_long_and_nothing_is_lost(body, most):
    sizes = chunking.Sizes(most=most, overlap=0, least=10)
    got = chunking.cut(body, sizes)
    assert all(len(c) <= most for _, c in got)
    kept = "".join("".join(c.split()) for _, c in got)
    assert kept == "".join("".join(p.split()) for _, ps in chunking.layout(body) for p in ps)


def test_chunk_ids_and_ordinals(spark):
    docs = spark.createDataFrame([("d", "s", "x", TEXT), ("e", "s", "y", None)], "id string, source string, external_id string, content string")
    rows = chunking.chunk_documents(docs).collect()
    assert [r.ordinal for r in rows] == list(range(5)) and len({r.chunk_id for r in rows}) == 5


ROUTES = {
    "Qual a ligação entre o Bradesco e a Previ?": "relacional",
    "Quais empresas dependem da mesma matéria-prima que a X?": "relacional",
    "As concessões envolvidas na operação da PetroReconcavo": "relacional",
    "Qual o valor da operação?": "factual",
    "Qual a incorporação de ações?": "factual",
    "Quais empresas foram privatizadas?": "sintese",
    "Resuma o setor elétrico": "sintese",
    "Onde fica a sede da Petrobras?": "factual",
}


def test_routes(spark):
    df = agent.routed(spark.createDataFrame([(q,) for q in ROUTES], "text string"))
    assert {r.text: r.kind for r in df.collect()} == ROUTES
    row = df.filter("kind = 'relacional'").first()
    assert (row.limit, row.candidate_pool, row.graph_weight, row.rerank) == fixed.STRATEGIES["relacional"]
    assert agent.strategy(spark, "x", lambda q: ("sintese", "modelo", ["A"])).kind == "sintese"
    assert agent.strategy(spark, "Onde fica?", lambda q: None).kind == "factual"


def test_citations_are_checked(spark):
    ok = agent.check_answer(spark, "A [2] e  B [1] [7].", ["s1", "s2"])
    assert ok.text == "A [2] e B [1] ." and ok.sources == ["s1", "s2"] and ok.grounded and "[7]" in ok.warning
    none = agent.check_answer(spark, "Sem fonte.", ["s1"])
    assert not none.grounded and none.warning == fixed.UNCITED_WARNING
    assert agent.check_answer(spark, "[1][1]", ["s1"]).warning is None


def test_path_steps_become_context():
    steps = [{"source": "A", "target": "B", "relation": "CONTROLA", "evidence": "A manda"}, {"source": "B", "target": "C", "relation": "PRODUZ", "evidence": ""}]
    got = agent.path_context(steps, [{"content": "x", "citation": "c", "score": 0.5}])
    assert len(got) == 2 and got[0]["citation"] == "grafo: A ~ B" and got[1]["content"] == "x"
    assert agent.path_context(steps, []) == []


def test_metrics(spark):
    q = spark.createDataFrame([(1, "factual", ["Vale"]), (2, "multihop", ["aço", "nada"]), (3, "multihop", [])], "query_id int, kind string, anchors array<string>")
    hits = spark.createDataFrame([(1, 1, "x"), (1, 5, "a VALE"), (2, 1, "Aco"), (3, 1, "y")], "query_id int, rank int, content string")
    judged = evaluate.judge(q, hits)
    m = {r.kind: r for r in evaluate.metrics(judged).collect()}
    assert m["factual"].recall == 1.0 and m["factual"].mrr == pytest.approx(0.2) and m["multihop"].recall == pytest.approx(0.75) and m[None].questions == 3
    assert "| factual |" in evaluate.format_table([("v", judged, 1.0)]).replace("factual | multihop", "factual | x")
    assert evaluate.verdict({"recall": 1.0, "mrr": 0.8}, {"recall": 1.0, "mrr": 0.9}) == "keep" and evaluate.verdict({"recall": 0.5, "mrr": 0}, {"recall": 0.5, "mrr": 1}) == "revert"


def test_multihop_questions_need_a_split_bridge(spark):
    chunks = spark.createDataFrame([("Alfa compra",), ("Alfa e Beta",), ("Gama aqui",), ("Beta ali",)], "content string")
    q = spark.createDataFrame([(1, "Alfa", "Beta"), (2, "Gama", "Beta"), (3, "Zeta", "Beta")], "query_id int, anchor string, bridge string")
    assert [r.query_id for r in evaluate.multihop_valid(q, chunks).collect()] == [2]
