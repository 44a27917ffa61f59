"""The engine: ingest, graph build, search, graph questions and answers over a store. Its methods are the tools that servers and the CLI expose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import clients, providers
from quarry.config import Settings
from quarry.functions import fixed, text
from quarry.operators import agent, chunking, evaluate, graph, resolution, retrieval
from quarry.sources import policy, remote, store
from quarry.sources.shared import materialize


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, embedder=None, extractor=None, scorer=None, answerer=None, classify=None):
        self.spark, self.settings = spark, settings or Settings.load()
        self.store = store.Store(spark, self.settings.store)
        given = clients.providers(self.settings) if self.settings.provider != "local" else {}
        self.embedder = embedder or given.get("embedder") or providers.HashEmbedder(self.settings.embedding_dim)
        self.extractor, self.scorer = extractor or given.get("extractor") or providers.RuleExtractor(), scorer or given.get("scorer") or providers.overlap_scorer
        self.answerer, self.classify = answerer or given.get("answerer") or providers.extractive_answer, classify or given.get("classify")
        self.store.apply_schema()

    # ---- ingest

    def ingest(self, documents: DataFrame, force: bool = False, sizes: chunking.Sizes = chunking.Sizes()) -> dict[str, int]:
        """documents: source, external_id, title, url, content, metadata. Equal content is skipped unless forced."""
        keys = documents.select("source", "external_id").distinct()
        touched = [r.part for r in keys.select(store.part_of("documents").alias("part")).distinct().collect()]
        merged = materialize(store.upsert_documents(self.store.table("documents", touched), documents), "upsert")
        new = merged.filter(F.col("status").isin("inserted", "updated", *(["unchanged"] if force else [])))
        cut = materialize(chunking.chunk_documents(new.select("id", "source", "external_id", "content"), sizes).withColumn("embedding", providers.embed(F.col("content"), self.embedder)), "chunks")
        ids = materialize(new.select(F.col("id").alias("document_id")), "changed")
        gone = materialize(self.store.table("chunks").join(ids, "document_id", "left_semi").join(cut.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id"), "gone")
        self.store.rewrite("documents", keys, lambda _: merged.withColumn("ingested_at", F.current_timestamp()))
        self.store.rewrite("chunks", ids, lambda old: store.replace_chunks(old, cut.drop("char_count"), ids))
        counted = retrieval.postings(cut).join(cut.select("chunk_id", "document_id"), "chunk_id")
        self.store.rewrite("postings", ids, lambda old: old.join(ids, "document_id", "left_anti").unionByName(counted))
        self.store.rewrite("edges", gone, lambda old: old.join(gone, "chunk_id", "left_anti"))
        counts = {r["status"]: r["count"] for r in merged.groupBy("status").count().collect()}
        return {"new": new.count(), "skipped": 0 if force else counts.get("unchanged", 0), "chunks": cut.count()}

    def ingest_document(self, reference: str, opener=None) -> dict:
        try:
            rows = policy.load(self.spark, self.settings.policy, reference, opener)
        except policy.Rejected as e:
            return {"ok": False, "message": str(e), "chunks": 0}
        report = self.ingest(rows)
        return {"ok": True, "message": "documento ja indexado, sem mudancas" if not report["new"] else "documento indexado", "chunks": report["chunks"]}

    def ingest_folder(self, folder: str, ocr=None) -> dict:
        read = materialize(policy.read_directory(self.spark, folder, ocr), "folder")
        report = self.ingest(read.filter("error IS NULL").drop("error"))
        return report | {"failures": {r.external_id: r.error for r in read.filter("error IS NOT NULL").select("external_id", "error").collect()}}

    def ingest_encyclopedia(self, opener, titles: list[str] | None = None) -> dict[str, int]:
        """Pages by title, the demonstration corpus without titles. opener(parameters) -> response text."""
        return self.ingest(remote.fetch_wiki(self.spark, list(titles or fixed.DEMO_CORPUS), opener))

    def evaluate(self, questions: DataFrame, limit: int = 5, modes: tuple[str, ...] = retrieval.MODES) -> list[evaluate.Run]:
        """A golden set in every mode without reranking, in hybrid mode with it, and as the router would have it."""
        runs = [evaluate.run(self.spark, mode, questions, lambda q, mode=mode: self.search(q, mode, limit, rerank=False)) for mode in modes]
        runs.append(evaluate.run(self.spark, "hybrid + rerank", questions, lambda q: self.search(q, "hybrid", limit)))

        def routed(q: str) -> DataFrame:
            plan = agent.strategy(self.spark, q, self.classify)
            return self.search(q, plan.mode, plan.limit, plan.candidate_pool, plan.graph_weight, plan.rerank)

        return [*runs, evaluate.run(self.spark, "roteado", questions, routed)]

    def list_documents(self) -> dict:
        rows = policy.available(self.spark, self.settings.policy)
        return {"root_configured": self.settings.ingest_root is not None, "documents": [r.asDict() for r in rows.collect()]}

    # ---- graph build

    def build_graph(self, limit: int | None = None, refresh: bool = False) -> dict[str, int]:
        """Extract from chunks that the cache doesn't know, resolve, rewrite, write. Only the processed chunks' mentions are replaced."""
        titles = self.store.table("documents").select(F.col("id").alias("document_id"), "title")
        chunks = self.store.table("chunks").join(titles, "document_id")
        chunks = chunks if limit is None else chunks.orderBy("title", "ordinal").limit(limit)
        chunks = materialize(chunks.select("chunk_id", "content", "title", "ordinal", text.fingerprint(F.col("content"), self.extractor.model, self.extractor.version).alias("fingerprint")), "build")
        cache = self.store.table("cache")
        todo = chunks if refresh else chunks.join(cache.select("fingerprint"), "fingerprint", "left_anti")
        made = materialize(providers.extract(todo.dropDuplicates(["fingerprint"]), self.extractor).join(chunks.select("chunk_id", "fingerprint"), "chunk_id"), "extracted")
        fresh = made.filter("error IS NULL").select("fingerprint", "chunk_id", "payload", F.current_timestamp().alias("created_at"))
        self.store.rewrite("cache", fresh, lambda old: old.join(fresh.select("fingerprint"), "fingerprint", "left_anti").unionByName(fresh))
        known = chunks.join(self.store.table("cache").select("fingerprint", "payload"), "fingerprint").withColumn("x", F.from_json("payload", providers.EXTRACTION)).filter("x.entities IS NOT NULL")
        order = F.xxhash64("title").bitwiseAND(F.lit((1 << 30) - 1)) * 1_000 + F.col("ordinal")
        extractions = materialize(known.select("chunk_id", order.alias("seq"), "x.entities", F.coalesce("x.relations", F.from_json(F.lit("[]"), "array<struct<source:string,target:string,type:string,evidence:string>>")).alias("relations")), "extractions")
        mentions = resolution.flatten_entities(extractions)
        nodes = materialize(resolution.resolve(mentions), "nodes")
        rewritten = materialize(resolution.rewrite_edges(nodes, resolution.flatten_relations(extractions)), "edges")
        self.store.rewrite("nodes", nodes, lambda old: store.upsert_nodes(old, nodes))
        kept = rewritten.filter("NOT dropped").drop("dropped")
        self.store.rewrite("edges", kept, lambda old: store.upsert_edges(old, kept, self.store.table("nodes")))
        self.store.rewrite("mentions", chunks, lambda old: store.replace_mentions(old, resolution.mention_table(nodes, mentions), chunks))
        return {"chunks": chunks.count(), "extracted": made.filter("error IS NULL").count(), "errors": made.filter("error IS NOT NULL").count(), "nodes": nodes.count(), "edges": rewritten.filter("NOT dropped").count(), "dropped": rewritten.filter("dropped").count()}

    # ---- search

    def search(self, question: str, mode: str = "hybrid", limit: int = 5, pool: int = fixed.POOL, graph_weight: float = 0.5, rerank: bool = True) -> DataFrame:
        """Ranked chunks with their citations."""
        return self.traced(question, mode, limit, pool, graph_weight, rerank)[0]

    def traced(self, question: str, mode: str = "hybrid", limit: int = 5, pool: int = fixed.POOL, graph_weight: float = 0.5, rerank: bool = True) -> tuple[DataFrame, dict]:
        """Ranked chunks, and how they came about: how many each way found, and which entities guided the expansion."""
        limit, pool = max(1, min(20, limit)), max(pool, limit)
        chunks, mentions, edges = (self.store.table(t) for t in ("chunks", "mentions", "edges"))
        asked = self.spark.createDataFrame([(0, question)], "query_id int, text string")

        def held(hits: DataFrame | None) -> tuple[DataFrame | None, int]:  # pool rows at most, so what follows needn't search again
            rows = hits.collect() if hits is not None else []
            return (self.spark.createDataFrame(rows, hits.schema) if hits is not None else None), len(rows)

        vector, by_vector = held(retrieval.vector_topk(chunks, self.embedder.embed([question])[0], pool) if mode != "lexical" else None)
        terms = [r.term for r in retrieval.query_terms(asked).collect()]
        index = self.store.table("postings").filter(F.col("term").isin(terms) if terms else F.lit(False))
        lexical, by_words = held(retrieval.lexical_search(index, asked, pool) if mode in ("lexical", "hybrid") else None)
        ids, fused = held(retrieval.hybrid(vector, lexical, mentions, edges, mode, pool if rerank else limit, pool, graph_weight))
        found = retrieval.with_payload(ids, chunks, self.store.table("documents"))
        if rerank:
            found = retrieval.rerank(found, asked, self.scorer, limit)
        spread, entities = 0, []
        if mode in ("graph", "hybrid") and graph_weight > 0:
            base = retrieval.fuse([(vector, 1.0)] if mode == "graph" else [(vector, 1.0), (lexical, 1.0)], limit=pool).select(*retrieval.HITS)
            entities = retrieval.guides(mentions, base)
            spread = retrieval.expand(mentions, edges, base.filter("rank <= 5"), limit=pool).count()
        trace = {"vector": by_vector, "lexical": by_words, "graph": spread, "fused": fused, "reranked": min(fused, limit) if rerank else 0, "entities": entities}
        return found, trace

    def search_knowledge(self, question: str, mode: str = "hybrid", limit: int = 5) -> dict:
        found, trace = self.traced(question, mode, limit)
        rows = found.orderBy("rank").collect()
        note = retrieval.trace_summary(**{k: v for k, v in trace.items() if k != "entities"})
        return {"hits": [{"content": r.content, "citation": r.citation, "score": round(r.score, 4)} for r in rows], "note": f"modo={mode} {note}", "entities": trace["entities"]}

    # ---- graph questions

    def graph_stats(self) -> dict:
        counts = self.store.stats()
        return counts | {"note": "" if counts["nodes"] else "o grafo esta vazio: rode a construcao do grafo"}

    def _key(self, name: str) -> str:
        nodes = self.store.table("nodes")
        return graph.find_key(nodes, name) or self.spark.range(1).select(text.name_key(F.lit(name)).alias("k")).first().k

    def explore_entity(self, name: str, depth: int = 1) -> dict:
        depth = max(1, min(3, depth))
        rows = graph.neighbours(self.store.table("nodes"), self.store.table("edges"), self._key(name), depth).collect()
        return {"entity": name, "neighbors": [r.asDict() for r in rows], "note": "alem de um salto nao ha evidencia" if depth > 1 else ""}

    def find_connection(self, a: str, b: str, max_hops: int = 4) -> dict:
        nodes = self.store.table("nodes")
        row = graph.shortest_path(nodes, self.store.table("edges"), self._key(a), self._key(b), max(1, min(5, max_hops))).first()
        if row is None:
            return {"found": False, "hops": 0, "path": []}
        names = {r.key: r.name for r in nodes.filter(F.col("key").isin(row.path)).select("key", "name").collect()}
        steps = [{"source": names.get(s, s), "target": names.get(t, t), "relation": r, "evidence": e} for s, t, r, e in zip(row.path, row.path[1:], row.relations, row.evidence)]
        return {"found": True, "hops": row.hops, "path": steps}

    # ---- answers

    def ask(self, question: str) -> agent.AgentResult:
        plan = agent.strategy(self.spark, question, self.classify)
        rows = self.search(question, plan.mode, plan.limit, plan.candidate_pool, plan.graph_weight, plan.rerank).orderBy("rank").collect()
        hits = [{"content": r.content, "citation": r.citation, "score": r.score} for r in rows]
        path = self.find_connection(*plan.entities[:2])["path"] if plan.kind == "relacional" and len(plan.entities) >= 2 else []
        context = agent.path_context(path, hits) if path else hits
        if not context:
            return agent.AgentResult(question, agent.Answer(fixed.NO_CHUNKS, [], False, fixed.NO_CHUNKS_WARNING), plan, [], path)
        try:
            said = self.answerer(question, context)
        except Exception as e:  # an answerer is remote in earnest: its failure is the answer's warning
            return agent.AgentResult(question, agent.Answer(fixed.NO_ANSWER, [], False, f"falha ao chamar o modelo: {e}"), plan, context, path)
        return agent.AgentResult(question, agent.check_answer(self.spark, said, [h["citation"] for h in context]), plan, context, path)

    def answer_question(self, question: str) -> dict:
        r = self.ask(question)
        return {"answer": r.answer.text, "sources": r.answer.sources, "grounded": r.answer.grounded, "strategy": r.strategy.kind, "warning": r.answer.warning}
