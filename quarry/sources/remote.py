"""Sources behind a network: encyclopedia pages and filings. Access is an ``opener`` that the caller gives, so they work on saved responses, too."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import corpus

#: The part of a page query's response that counts, whatever the page's number.
RESPONSE = "struct<query:struct<pages:map<string,struct<title:string,extract:string,missing:string,links:array<struct<ns:int,title:string>>>>>>"
WIKI_URL = "https://pt.wikipedia.org/wiki/"


def wiki_documents(responses: DataFrame, column: str = "value") -> DataFrame:
    """Documents from saved page responses (JSON): extract, canonical title, and links to articles. Missing and empty pages go."""
    pages = responses.select(F.explode(F.map_values(F.from_json(F.col(column), RESPONSE)["query"]["pages"])).alias("p")).select("p.*")
    by_title = pages.groupBy("title").agg(F.max("extract").alias("content"), F.flatten(F.collect_list(F.coalesce("links", F.array().cast("array<struct<ns:int,title:string>>")))).alias("links"))
    names = F.transform(F.filter("links", lambda x: x["ns"] == 0), lambda x: x["title"])
    return by_title.filter("content <> ''").select(F.lit("wikipedia").alias("source"), F.col("title").alias("external_id"), "title", F.concat(F.lit(WIKI_URL), F.replace("title", F.lit(" "), F.lit("_"))).alias("url"), "content", F.create_map(F.lit("links"), F.to_json(names)).alias("metadata"))


def fetch_wiki(spark: SparkSession, titles: list[str], opener) -> DataFrame:
    """opener(parameters) -> response text. One title a request: extracts of several come back empty but for the first."""
    common = {"action": "query", "format": "json", "redirects": "1"}
    asked = [common | {"prop": "extracts", "explaintext": "1", "titles": t} for t in titles] + [common | {"prop": "links", "pllimit": "500", "plnamespace": "0", "titles": t} for t in titles]
    return wiki_documents(spark.createDataFrame([(opener(p),) for p in asked], "value string"))


def write_manifest(path: str, year: int, chosen: list[dict]) -> None:
    """Which filings make the corpus, so that it can be built again from a live table that grows."""
    rows = [{"protocolo": r["protocol"], "empresa": r["company"], "data": r["date"]} for r in chosen]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({"ano": year, "documentos": rows}, ensure_ascii=False, indent=2), encoding="utf-8")


def read_manifest(path: str, filings: DataFrame) -> DataFrame:
    """The manifest's filings in its order; those that the table has no longer are left out."""
    return corpus.by_manifest(filings, [d["protocolo"] for d in json.loads(Path(path).read_text(encoding="utf-8"))["documentos"]])


def download_filing(url: str, target: str, opener) -> bool:
    """Whether the target is there in the end. What doesn't begin as a PDF is an error page, whatever its header says."""
    path = Path(target)
    if path.exists() and path.stat().st_size:
        return True
    try:
        body = opener(url)
    except OSError:
        return False
    if not body.startswith(b"%PDF"):
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body)
    return True


def golden_questions(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text, kind, anchors, bridge of a JSON array of questions."""
    rows = spark.read.schema("id string, question string, kind string, anchors array<string>, bridge_entity string, note string").json(path, multiLine=True)
    return rows.select(F.col("id").alias("query_id"), F.col("question").alias("text"), "kind", "anchors", F.col("bridge_entity").alias("bridge"))
