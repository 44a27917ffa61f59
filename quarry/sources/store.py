"""Tables of the engine as Parquet folders with idempotent writes. One writer at a time, any number of readers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import fixed, text

SCHEMAS = {
    "documents": "id string, source string, external_id string, title string, url string, content string, content_hash string, metadata map<string,string>, ingested_at timestamp",
    "chunks": "chunk_id string, document_id string, ordinal int, content string, section_path string, embedding array<float>",
    "postings": "term string, chunk_id string, tf long, document_id string",
    "nodes": "key string, name string, type string, aliases array<string>, mentions long",
    "edges": "source_key string, target_key string, type string, chunk_id string, evidence string",
    "mentions": "entity_key string, chunk_id string",
    "cache": "fingerprint string, chunk_id string, payload string, created_at timestamp",
}


def upsert_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All documents after the write, with status: unchanged (equal content: nothing is written), updated, inserted or kept."""
    key = ["source", "external_id"]
    # of several versions that come at once the last counts: by position, where there is one, then by content
    last = F.struct(*([F.col("position")] if "position" in incoming.columns else []), F.col("content_hash"))
    hashed = incoming.withColumn("content_hash", text.content_hash(F.col("content")))
    rest = [c for c in hashed.columns if c not in (*key, "position")]
    new = hashed.groupBy(*key).agg(F.max_by(F.struct(*rest), last).alias("_v")).select(*key, "_v.*")
    old = existing.withColumn("_old", F.lit(True))
    joined = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), key, "full_outer")
    same = F.col("o.content_hash").eqNullSafe(F.col("n.content_hash"))
    status = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    take = lambda c: F.when(F.col("status").isin("inserted", "updated"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    ident = F.coalesce("o.id", F.sha2(F.concat_ws("|", *key), 256)).alias("id")
    rest = [c for c in ("title", "url", "content", "content_hash", "metadata") if c in existing.columns and c in new.columns]
    return joined.withColumn("status", status).select(ident, *key, *[take(c) for c in rest], "status")


def replace_chunks(existing: DataFrame, fresh: DataFrame, rewritten: DataFrame | None = None) -> DataFrame:
    """Chunks after the documents of ``fresh`` (and of rewritten: document_id) were cut anew."""
    gone = fresh.select("document_id")
    if rewritten is not None:
        gone = gone.unionByName(rewritten.select("document_id"))
    return existing.join(gone.distinct(), "document_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert_nodes(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    return existing.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def upsert_edges(existing: DataFrame | None, fresh: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends exist, once for each (source, target, type, chunk, first characters of the evidence)."""
    cut = fresh.withColumn("evidence", F.substring(F.coalesce("evidence", F.lit("")), 1, fixed.EVIDENCE_CHARS))
    keys = nodes.select("key")
    ok = cut.join(keys.withColumnRenamed("key", "source_key"), "source_key", "left_semi").join(keys.withColumnRenamed("key", "target_key"), "target_key", "left_semi")
    columns = ["source_key", "target_key", "type", "chunk_id", "evidence"]
    both = ok.select(columns) if existing is None else existing.select(columns).unionByName(ok.select(columns))
    return both.dropDuplicates(columns)


def replace_mentions(existing: DataFrame, fresh: DataFrame, processed: DataFrame) -> DataFrame:
    """Mentions of the processed chunks (chunk_id) are replaced, others stay."""
    return existing.join(processed.select("chunk_id").distinct(), "chunk_id", "left_anti").unionByName(fresh).distinct()


def prune_edges(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    return edges.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


#: What deals the rows of a table into parts. Rows that change together lie together: a document's chunks and postings, a chunk's edges.
KEYS = {"documents": ("source", "external_id"), "chunks": ("document_id",), "postings": ("document_id",), "nodes": ("key",), "edges": ("chunk_id",), "mentions": ("chunk_id",), "cache": ("fingerprint",)}
PARTS = 32


def part_of(table: str) -> Column:
    return F.pmod(F.xxhash64(*KEYS[table]), F.lit(PARTS)).cast("int")


class Store:
    """Named tables below one path that driver and executors share.

    A table is a list of parts, and the newest whole generation file says where each part lies. A write puts the parts that it
    changes into a new folder and then one generation file beside the others: a crash before that leaves the table as it was, one
    after it as it is now. Folders that the last two generations don't name are removed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def _generations(self, name: str) -> list[tuple[int, dict[str, str]]]:
        """(number, {part: folder}) of the whole generations, the newest last."""
        found = []
        for file in self._names(f"{self.path}/{name}"):
            if not file.startswith("generation-"):
                continue
            fs, p = self._fs(f"{self.path}/{name}/{file}")
            stream = fs.open(p)
            try:
                said = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            try:
                found.append((int(file.removeprefix("generation-").removesuffix(".json")), json.loads(said)))
            except ValueError:  # a write that broke off
                continue
        return sorted(found, key=lambda x: x[0])

    def _commit(self, name: str, parts: dict[str, str]) -> None:
        known = self._generations(name)
        number = known[-1][0] + 1 if known else 0
        fs, p = self._fs(f"{self.path}/{name}/generation-{number:08d}.json")
        out = fs.create(p, False)  # two writers can't make the same generation
        try:
            out.write(bytearray(json.dumps(parts).encode()))
        finally:
            out.close()
        named = {folder.partition("/")[0] for _, made in [*known[-1:], (number, parts)] for folder in made.values()}
        for old in self._names(f"{self.path}/{name}"):
            if old.startswith("data-") and old not in named or old.startswith("generation-") and old not in (f"generation-{n:08d}.json" for n in (number, number - 1)):
                fs.delete(self._fs(f"{self.path}/{name}/{old}")[1], True)

    def apply_schema(self) -> None:
        for name in SCHEMAS:
            if not self._generations(name):
                self._commit(name, {})

    def table(self, name: str, parts: list[int] | None = None) -> DataFrame:
        known = self._generations(name)
        folders = [f"{self.path}/{name}/{folder}" for part, folder in (known[-1][1] if known else {}).items() if parts is None or int(part) in parts]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[name])

    def rewrite(self, name: str, touched: DataFrame, make: Callable[[DataFrame], DataFrame]) -> None:
        """Only the parts that the keys of ``touched`` lie in: make gets their rows and gives what they shall hold. Other parts stay as they are."""
        parts = [r.part for r in touched.select(part_of(name).alias("part")).distinct().collect()]  # PARTS at most
        if parts:
            self._write(name, make(self.table(name, parts)), parts)

    def replace(self, name: str, rows: DataFrame) -> None:
        self._write(name, rows, range(PARTS))

    def _write(self, name: str, rows: DataFrame, parts) -> None:
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).withColumn("_part", part_of(name))
        folder = f"data-{uuid.uuid4().hex}"
        inner = ["term"] if name == "postings" else []  # so that a search reads few pages
        full.repartition(PARTS, "_part").sortWithinPartitions("_part", *inner).write.partitionBy("_part").parquet(f"{self.path}/{name}/{folder}")
        made = {int(x.removeprefix("_part=")): f"{folder}/{x}" for x in self._names(f"{self.path}/{name}/{folder}") if x.startswith("_part=")}
        known = self._generations(name)
        kept = {p: f for p, f in (known[-1][1] if known else {}).items() if int(p) not in parts}
        self._commit(name, kept | {str(p): f for p, f in made.items()})

    def clear_graph(self) -> None:
        for name in ("nodes", "edges", "mentions"):
            self.replace(name, self.spark.createDataFrame([], SCHEMAS[name]))

    def stats(self) -> dict[str, int]:
        chunks = self.table("chunks").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded_chunks")).first()
        return {"documents": self.table("documents").count(), "chunks": chunks.chunks, "embedded_chunks": chunks.embedded_chunks, "nodes": self.table("nodes").count(), "edges": self.table("edges").count()}
