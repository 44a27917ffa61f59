"""The tools over messages and pages, model clients on saved responses, tables that survive a broken write."""

import io
import json
import urllib.request

import pytest

from quarry import clients, mcp, server
from quarry.config import Settings
from quarry.engine import Engine
from quarry.functions import fixed
from quarry.operators import evaluate
from quarry.sources import remote
from quarry.sources.store import Store

DOCS = [
    ("s", "1", "Fornecedor", None, "A Alfa Minas Cia fornece para a Beta Norte Cia. O contrato vale dez anos e trata de minério.", {}),
    ("s", "2", "Comprador", None, "A Beta Norte Cia controla a Gama Sul Cia. A sede trata de aço.", {}),
]
SCHEMA = "source string, external_id string, title string, url string, content string, metadata map<string,string>"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, Settings(store=str(tmp_path_factory.mktemp("store"))))
    e.ingest(spark.createDataFrame(DOCS, SCHEMA))
    e.build_graph()
    return e


def ask(engine, method, **params):
    return mcp.answer(engine, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))


def test_tools_over_messages(engine):
    assert {t["name"] for t in ask(engine, "tools/list")["result"]["tools"]} == {"search_knowledge", "graph_stats", "explore_entity", "find_connection", "answer_question", "list_documents", "ingest_document"}
    found = ask(engine, "tools/call", name="search_knowledge", arguments={"question": "minério da Alfa", "limit": 99})["result"]
    assert found["structuredContent"]["hits"][0]["citation"] == "Fornecedor" and "vetorial=" in found["structuredContent"]["note"]
    path = ask(engine, "tools/call", name="find_connection", arguments={"a": "Alfa Minas Cia", "b": "Gama Sul Cia"})["result"]["structuredContent"]
    assert path["found"] and path["hops"] == 2
    assert ask(engine, "tools/call", name="explore_entity", arguments={"name": "Beta Norte Cia", "depth": 1})["result"]["structuredContent"]["neighbors"]
    assert ask(engine, "tools/call", name="ingest_document", arguments={"reference": "x.txt"})["result"]["structuredContent"]["ok"] is False
    text = ask(engine, "resources/read", uri=mcp.SCHEMA_URI)["result"]["contents"][0]["text"]
    assert all(t in text for t in fixed.ENTITY_TYPES + fixed.RELATION_TYPES)


def test_messages_that_cant_be_served(engine):
    code = lambda r: r["error"]["code"]
    assert code(mcp.answer(engine, "{")) == -32700 and code(mcp.answer(engine, "[]")) == mcp.INVALID and code(ask(engine, "nothing")) == mcp.UNKNOWN
    for name, arguments in (("nothing", {}), ("search_knowledge", {}), ("search_knowledge", {"question": " "}), ("search_knowledge", {"question": "x", "mode": "y"}), ("search_knowledge", {"question": "x", "limit": "3"}), ("graph_stats", {"a": 1})):
        assert code(ask(engine, "tools/call", name=name, arguments=arguments)) == mcp.BAD_PARAMS
    out = io.StringIO()
    mcp.serve(engine, ['{"jsonrpc": "2.0", "method": "notifications/initialized"}\n', "\n", '{"jsonrpc": "2.0", "id": 7, "method": "ping"}\n'], out)
    assert json.loads(out.getvalue()) == {"jsonrpc": "2.0", "id": 7, "result": {}}


def test_pages_and_graph(engine):
    import threading

    web = server.serve(engine, 0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{web.server_port}{p}").read().decode()
    try:
        assert "<form>" in get("/") and "/api/graph" in get("/graph")
        view = json.loads(get("/api/graph"))
        assert len(view["nodes"]) == 3 and len(view["edges"]) == 2
    finally:
        web.shutdown()


def test_traces_tell_what_guided_the_expansion(engine):
    found, trace = engine.traced("minério da Alfa", limit=2)
    assert trace["vector"] == 2 and trace["lexical"] == 1 and trace["fused"] == 2 and trace["reranked"] == 2 and "beta norte" in trace["entities"] and found.count() == 2


def test_kept_postings_are_those_of_the_chunks(spark, engine):
    from quarry.operators import retrieval

    kept = {(r.term, r.chunk_id, r.tf) for r in engine.store.table("postings").collect()}
    assert kept == {(r.term, r.chunk_id, r.tf) for r in retrieval.postings(engine.store.table("chunks")).collect()}


def test_runs_over_all_modes(spark, engine):
    asked = spark.createDataFrame([("q1", "minério da Alfa", "factual", ["minerio"]), ("q2", "sede de aço", "factual", ["Gama", "nada"])], "query_id string, text string, kind string, anchors array<string>")
    runs = engine.evaluate(asked, limit=2)
    assert [r.label for r in runs] == ["vector", "lexical", "graph", "hybrid", "hybrid + rerank", "roteado"]
    assert runs[3].share(None) == 0.75 and evaluate.format_table(runs).splitlines()[0] == "| estrategia | recall geral | factual | MRR | seg |"


def test_a_broken_write_changes_nothing(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.apply_schema()
    rows = spark.createDataFrame([(f"k{i}", f"n{i}", "Outro", [], 1) for i in range(200)], "key string, name string, type string, aliases array<string>, mentions long")
    s.replace("nodes", rows)
    before = s._generations("nodes")[-1][1]
    one = rows.filter("key = 'k7'")
    s.rewrite("nodes", one, lambda old: old.withColumn("mentions", old["mentions"] + 1))
    after = s._generations("nodes")[-1][1]
    assert len(before) == 32 and sum(before[p] != after[p] for p in before) == 1 and s.table("nodes").count() == 200
    (tmp_path / "store/nodes/generation-00000099.json").write_text('{"0": ')  # a write that broke off
    (tmp_path / "store/nodes/data-lost").mkdir()
    assert s.table("nodes").count() == 200 and s.table("nodes").agg({"mentions": "sum"}).first()[0] > 200
    s.replace("nodes", rows.limit(3))
    assert s.table("nodes").count() == 3 and not (tmp_path / "store/nodes/data-lost").exists()


def saved(*said):
    asked, answers = [], list(said)

    def post(path, body, seconds):
        asked.append((path, body))
        got = answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    return post, asked


def message(content):
    return {"message": {"content": content if isinstance(content, str) else json.dumps(content)}}


def test_embeddings_are_checked():
    post, asked = saved({"embeddings": [[1.0, 0.0]] * 16}, {"embeddings": [[0.0, 1.0]]})
    assert len(clients.Embedder(post, "m", 2).embed(["x"] * 17)) == 17 and [len(b["input"]) for _, b in asked] == [16, 1]
    for wrong in ({"embeddings": []}, {"embeddings": [[1.0]]}):
        with pytest.raises(RuntimeError):
            clients.Embedder(saved(wrong)[0], "m", 2).embed(["x"])


def test_extractions_keep_to_the_schema():
    good = {"entities": [{"name": "A", "type": "Organizacao"}, {"name": "B", "type": "Nada"}], "relations": [{"source": "A", "target": "B", "type": "CONTROLA", "evidence": "e"}, {"source": "A", "target": "C", "type": "CONTROLA"}]}
    post, asked = saved(message(good), message("no json"), message({"entities": 1}))
    found = clients.Extractor(post, "m").extract("text", "title")
    assert found["entities"][1]["type"] == "Outro" and [r["target"] for r in found["relations"]] == ["B"] and asked[0][1]["format"] == clients.EXTRACTION
    assert clients.Extractor(post, "m").extract("x") == {"entities": [], "relations": []} == clients.Extractor(post, "m").extract("x")


def test_routes_fall_back_and_answers_cite():
    post, _ = saved(message({"kind": "sintese", "reason": "r", "entities": ["A"]}), message({"kind": "x", "reason": "", "entities": []}), OSError("down"))
    route = clients.Classifier(post, "m")
    assert route("q") == ("sintese", "r", ["A"]) and route("q") is None and route("q") is None
    post, asked = saved(message(" Sim [1]. "))
    assert clients.Answerer(post, "m")("q", [{"citation": "c", "content": "t" * 5000}]) == "Sim [1]." and len(asked[0][1]["messages"][0]["content"]) < 2000


def test_hosted_models_need_a_key():
    with pytest.raises(ValueError):
        clients.providers(Settings(provider="hosted"))
    assert set(clients.providers(Settings(provider="server"))) == {"embedder", "extractor", "classify", "answerer", "scorer"}


def test_demonstration_pages(spark, tmp_path):
    e = Engine(spark, Settings(store=str(tmp_path)))

    def opener(p):
        page = {"title": p["titles"], "extract": f"{p['titles']} fica aqui."} if p["prop"] == "extracts" else {"title": p["titles"], "links": []}
        return json.dumps({"query": {"pages": {"1": page}}})

    assert e.ingest_encyclopedia(opener)["new"] == len(fixed.DEMO_CORPUS) and remote.WIKI_URL
