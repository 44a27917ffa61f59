"""Questions: routing, strategies, context, answers with checked citations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import fixed, text


def route(question: Column) -> Column:
    """The kind of a question. Relations come before syntheses: the link is the hard part of a question that asks for both."""
    rlike = lambda p: question.rlike("(?iu)" + p)
    return F.when(rlike(fixed.ROUTE_RELATION) | rlike(fixed.ROUTE_BRIDGE), "relacional").when(rlike(fixed.ROUTE_SYNTHESIS), "sintese").otherwise("factual")


def routed(questions: DataFrame) -> DataFrame:
    """questions with kind, mode, limit, candidate_pool, graph_weight, rerank and the proper nouns in them."""
    kind = F.col("kind")
    pick = lambda i: F.coalesce(*[F.when(kind == k, F.lit(v[i])) for k, v in fixed.STRATEGIES.items()])
    out = questions.withColumn("kind", route(F.col("text"))).withColumn("mode", F.lit("hybrid"))
    return out.withColumns({"limit": pick(0), "candidate_pool": pick(1), "graph_weight": pick(2), "rerank": pick(3), "entities": text.proper_nouns(F.col("text"))})


@dataclass(frozen=True)
class Strategy:
    kind: str
    limit: int
    candidate_pool: int
    graph_weight: float
    rerank: bool
    mode: str = "hybrid"
    reason: str = ""
    entities: tuple[str, ...] = ()


def strategy(spark: SparkSession, question: str, classify=None) -> Strategy:
    """classify: a provider giving (kind, reason, entities) or None; without an answer of it the patterns decide."""
    told = classify(question) if classify else None
    if told is None or told[0] not in fixed.STRATEGIES:
        row = routed(spark.createDataFrame([(question,)], "text string")).first()
        told = (row.kind, "padroes", row.entities)
    limit, pool, weight, rerank = fixed.STRATEGIES[told[0]]
    return Strategy(told[0], limit, pool, weight, rerank, reason=told[1], entities=tuple(told[2]))


def render_context(hits: DataFrame, most: int = fixed.CONTEXT_CHARS) -> DataFrame:
    """query_id, context, n: numbered chunks with their citations. hits: query_id, rank, citation, content."""
    piece = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.col("citation"), F.lit(")\n"), F.substring("content", 1, most)).alias("text"))
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.count("*").cast("int").alias("n")).select("query_id", F.array_join("p.text", "\n\n").alias("context"), "n")


def checked(answers: DataFrame, answer: str = "answer", citations: str = "citations") -> DataFrame:
    """answers(answer, citations array<string>) with text, sources, grounded, warning: cited numbers are held against the list."""
    n = F.size(citations)
    found = F.array_distinct(text.cited(F.col(answer)))
    bad = F.array_sort(F.filter(found, lambda x: (x < 1) | (x > n)))
    good = F.array_sort(F.filter(found, lambda x: (x >= 1) & (x <= n)))
    label = lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))
    clean = F.aggregate("_bad", F.col(answer), lambda t, x: F.replace(t, label(x), F.lit("")))
    head, tail = fixed.INVENTED_WARNING.split("{}")
    invented = F.when(F.size("_bad") > 0, F.concat(F.lit(head), F.array_join(F.transform("_bad", label), ", "), F.lit(tail)))
    uncited = F.when(F.size("_good") == 0, F.lit(fixed.UNCITED_WARNING))
    out = answers.withColumns({"_bad": bad, "_good": good})
    out = out.withColumns({"text": F.trim(F.regexp_replace(clean, r"(?U)\s{2,}", " ")), "sources": F.transform("_good", lambda x: F.element_at(F.col(citations), x)), "grounded": F.size("_good") > 0})
    warning = F.nullif(F.concat_ws("; ", invented, uncited), F.lit(""))
    return out.withColumn("warning", warning).drop("_bad", "_good")


@dataclass
class Answer:
    text: str
    sources: list[str]
    grounded: bool
    warning: str | None = None


@dataclass
class AgentResult:
    question: str
    answer: Answer
    strategy: Strategy
    hits: list[dict] = field(default_factory=list)
    path: list[dict] = field(default_factory=list)


def check_answer(spark: SparkSession, answer: str, citations: list[str]) -> Answer:
    row = checked(spark.createDataFrame([(answer, citations)], "answer string, citations array<string>")).first()
    return Answer(row.text, list(row.sources), row.grounded, row.warning)


def path_context(path: list[dict], hits: list[dict]) -> list[dict]:
    """The steps of a path with evidence as citable chunks before the hits. Without hits there are none."""
    if not hits:
        return []
    steps = [s for s in path if s["evidence"]]
    return [hits[0] | {"content": f"{s['source']} —[{s['relation']}]— {s['target']}: {s['evidence']}", "citation": f"grafo: {s['source']} ~ {s['target']}", "score": 1.0} for s in steps] + hits
