import json

import pytest

from quarry import cli, server
from quarry.config import Settings
from quarry.engine import Engine
from quarry.sources import store
from quarry.streaming.ingest import changed_documents, watch_folder

DOCS = [
    ("s", "1", "Fornecedor", None, "A Alfa Minas Cia fornece para a Beta Norte Cia. O contrato vale dez anos e trata de minério.", {}),
    ("s", "2", "Comprador", None, "A Beta Norte Cia controla a Gama Sul Cia. A sede trata de aço.", {}),
]
SCHEMA = "source string, external_id string, title string, url string, content string, metadata map<string,string>"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("root")
    (root / "n.txt").write_text("A Delta Oeste Cia adquiriu a Gama Sul Cia.")
    e = Engine(spark, Settings(store=str(tmp_path_factory.mktemp("store")), ingest_root=str(root)))
    assert e.ingest(spark.createDataFrame(DOCS, SCHEMA)) == {"new": 2, "skipped": 0, "chunks": 2}
    e.build_graph()
    return e


def test_equal_content_is_skipped(spark, engine):
    assert engine.ingest(spark.createDataFrame(DOCS, SCHEMA)) == {"new": 0, "skipped": 2, "chunks": 0}
    assert engine.ingest(spark.createDataFrame(DOCS, SCHEMA), force=True)["chunks"] == 2


def test_second_build_uses_the_cache(engine):
    before = engine.graph_stats()
    report = engine.build_graph()
    assert report["extracted"] == 0 and report["errors"] == 0 and engine.graph_stats() == before and before["nodes"] >= 3 and before["edges"] == 2


def test_search_and_tools(engine):
    hits = engine.search_knowledge("minério da Alfa", limit=1)["hits"]
    assert len(hits) == 1 and hits[0]["citation"] == "Fornecedor"
    assert engine.explore_entity("Beta Norte Cia")["neighbors"]
    found = engine.find_connection("Alfa Minas Cia", "Gama Sul Cia")
    assert found["found"] and found["hops"] == 2 and all(s["evidence"] for s in found["path"])
    assert not engine.find_connection("Alfa Minas Cia", "Nada")["found"]


def test_answers_cite_the_path(engine):
    r = engine.ask("Qual a ligação entre a Alfa e a Gama?")
    assert r.strategy.kind == "relacional" and r.answer.grounded and r.answer.sources


def test_ingest_tool_rejects_and_accepts(engine):
    assert not engine.ingest_document("../x.txt")["ok"] and not engine.ingest_document("https://evil.com/")["ok"]
    assert engine.ingest_document("n.txt")["chunks"] == 1 and engine.ingest_document("n.txt")["message"].endswith("sem mudancas")
    assert engine.list_documents()["documents"]


def test_http_contract(engine):
    assert server.ask(engine, b'{"question": " "}')[0] == 400 and server.ask(engine, b"{")[0] == 400 and server.ask(engine, json.dumps({"question": "x" * 501}).encode())[0] == 400
    code, body = server.ask(engine, json.dumps({"pergunta": "Quem fornece minério?"}).encode())
    assert code == 200 and body["hits"] and server.stats(engine)[0] == 200 and server.stats(None)[0] == 503


def test_cli(engine, spark, monkeypatch, capsys, tmp_path):
    monkeypatch.setenv("QUARRY_STORE", engine.settings.store)
    assert cli.main(["stats"], spark) == 0 and '"documents"' in capsys.readouterr().out
    assert cli.main(["connect", "Alfa Minas Cia", "Nada"], spark) == 1


def test_streamed_files_are_ingested_once(engine, spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "z.txt").write_text("Um texto novo sobre papel.")
    before = engine.store.table("documents").count()
    for _ in range(2):
        watch_folder(spark, engine, folder.as_uri(), str(tmp_path / "cp")).awaitTermination()
    assert engine.store.table("documents").count() == before + 1


def test_stream_of_versions_drops_repeats(spark, tmp_path):
    spark.createDataFrame([("a", "x", "2024-01-01 00:00:00"), ("a", "x", "2024-01-01 00:01:00"), ("a", "y", "2024-01-01 00:02:00")], "external_id string, content string, ts string").selectExpr("external_id", "content", "timestamp(ts) ts").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("external_id string, content string, ts timestamp").parquet(str(tmp_path / "s"))
    q = changed_documents(stream).writeStream.format("memory").queryName("versions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("versions").count() == 2


def test_settings():
    s = Settings.load({"QUARRY_INGEST_HOSTS": "a.org, b.org", "QUARRY_EMBEDDING_DIM": "8", "QUARRY_API_KEY": "k", "QUARRY_PROVIDER": "x"})
    assert s.ingest_hosts == ("a.org", "b.org") and s.embedding_dim == 8 and s.require_key() == "k" and "k'" not in repr(s)
    with pytest.raises(ValueError):
        Settings(embedding_dim=0)
    with pytest.raises(ValueError):
        Settings(provider="x").require_key()


def test_upsert_states(spark):
    old = spark.createDataFrame([("i", "s", "1", "a", "x")], "id string, source string, external_id string, content string, content_hash string")
    new = spark.createDataFrame([("s", "1", "b"), ("s", "2", "c"), ("s", "2", "c")], "source string, external_id string, content string")
    assert {r.external_id: r.status for r in store.upsert_documents(old, new).collect()} == {"1": "updated", "2": "inserted"}
