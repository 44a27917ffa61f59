import json

from quarry.operators import corpus
from quarry.sources import remote


def test_pages(spark):
    def opener(p):
        if p["titles"] == "Nada":
            return json.dumps({"query": {"pages": {"-1": {"title": "Nada", "missing": ""}}}})
        page = {"title": "Vale S.A."} | ({"extract": "Texto."} if p["prop"] == "extracts" else {"links": [{"ns": 0, "title": "Aço"}, {"ns": 4, "title": "Ajuda"}]})
        return json.dumps({"query": {"pages": {"7": page}}})

    (row,) = remote.fetch_wiki(spark, ["Vale", "Nada"], opener).collect()
    assert row.title == "Vale S.A." and row.url.endswith("/Vale_S.A.") and row.content == "Texto." and json.loads(row.metadata["links"]) == ["Aço"]


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("A", "s", "c", "d", "p1", "u", 0), ("B", "s", "c", "d", "p2", "u", 1), ("B2", "s", "c", "d", "p2", "u", 2)], "company string, subject string, category string, date string, protocol string, url string, seq long")
    remote.write_manifest(str(tmp_path / "m" / "m.json"), 2025, [{"protocol": "p2", "company": "B", "date": "d"}, {"protocol": "gone", "company": "X", "date": "d"}, {"protocol": "p1", "company": "A", "date": "d"}])
    assert [r.company for r in remote.read_manifest(str(tmp_path / "m" / "m.json"), rows).collect()] == ["B2", "A"]
    assert corpus.by_manifest(rows, []).count() == 0


def test_filing_download(tmp_path):
    target = str(tmp_path / "x" / "f.pdf")

    def fails(_):
        raise OSError

    assert not remote.download_filing("u", target, fails) and not remote.download_filing("u", target, lambda u: b"<html>")
    assert remote.download_filing("u", target, lambda u: b"%PDF-1") and remote.download_filing("u", target, fails)


def test_golden_questions(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps([{"id": "a", "question": "Q?", "kind": "multihop", "anchors": ["x", "y"], "bridge_entity": "b"}]))
    (row,) = remote.golden_questions(spark, str(path)).collect()
    assert (row.query_id, row.anchors, row.bridge) == ("a", ["x", "y"], "b")
