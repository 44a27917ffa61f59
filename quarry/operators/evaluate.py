"""Retrieval quality: anchors against hits, recall, hit rate, reciprocal rank; router confusion; multihop validity."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text

#: Questions that are broadcast at a time.
QUESTION_BLOCK = 1000


def judge(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, kind, found, expected, rank. questions: query_id, kind, anchors; hits: query_id, rank, content.

    An anchor is found if a hit's folded text holds the folded anchor; rank is the first hit that holds any.
    Hits grow with the questions, so both sides are sorted and none is collected for a broadcast.
    """
    anchors = questions.select("query_id", "kind", F.size("anchors").alias("expected"), F.explode_outer("anchors").alias("anchor"))
    bodies = hits.select("query_id", "rank", text.fold(F.col("content")).alias("body"))
    pairs = anchors.join(bodies.hint("merge"), "query_id", "left")
    holds = F.col("body").contains(text.fold(F.col("anchor")))
    by_anchor = pairs.groupBy("query_id", "kind", "expected", "anchor").agg(F.min(F.when(holds, F.col("rank"))).alias("rank"))
    return by_anchor.groupBy("query_id", "kind", "expected").agg(F.count("rank").alias("found"), F.min("rank").alias("rank"))


def metrics(judged: DataFrame) -> DataFrame:
    """kind (null: all), questions, recall, hit_rate, mrr. Nothing expected counts as recalled."""
    share = F.when(F.col("expected") == 0, 1.0).otherwise(F.col("found") / F.col("expected"))
    return judged.rollup("kind").agg(F.count("*").alias("questions"), F.avg(share).alias("recall"), F.avg((F.col("found") > 0).cast("double")).alias("hit_rate"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def run(spark: SparkSession, label: str, questions: DataFrame, search: Callable[[str], DataFrame]) -> Run:
    """A golden set against one way of searching. search: question -> hits (rank, content); questions: query_id, text, kind, anchors."""
    began, hits = time.monotonic(), []
    for q in questions.select("query_id", "text").toLocalIterator():  # a golden set: tens of questions
        hits += [(q.query_id, r["rank"], r.content) for r in search(q.text).select("rank", "content").collect()]
    seconds = time.monotonic() - began
    found = spark.createDataFrame(hits, f"query_id {questions.schema['query_id'].dataType.simpleString()}, rank int, content string")
    return Run(label, {r.kind: r for r in metrics(judge(questions, found)).collect()}, seconds)


class Run(NamedTuple):
    label: str
    by_kind: dict
    """Metrics by kind of question; None: all."""
    seconds: float

    def share(self, kind: str | None, measure: str = "recall") -> float:
        return (self.by_kind[kind][measure] or 0.0) if kind in self.by_kind else 0.0


def format_table(runs: list[tuple[str, DataFrame, float] | Run]) -> str:
    """Markdown: a row for each run, a column for each kind that the data hold. runs: Run, or label, judged, seconds."""
    runs = [r if isinstance(r, Run) else Run(r[0], {m.kind: m for m in metrics(r[1]).collect()}, r[2]) for r in runs]
    kinds = sorted({k for r in runs for k in r.by_kind} - {None})
    columns = {"estrategia": lambda r: r.label, "recall geral": lambda r: f"{r.share(None):.0%}"}
    columns |= {k: (lambda r, k=k: f"{r.share(k):.0%}") for k in kinds}
    columns |= {"MRR": lambda r: f"{r.share(None, 'mrr'):.3f}", "seg": lambda r: f"{r.seconds:.0f}"}
    rows = [list(columns), ["---"] * len(columns), *([cell(r) for cell in columns.values()] for r in runs)]
    return "\n".join("| " + " | ".join(row) + " |" if i != 1 else "|" + "|".join(row) + "|" for i, row in enumerate(rows))


def confusion(questions: DataFrame) -> DataFrame:
    """kind x route counts. questions: kind, route."""
    return questions.groupBy("kind").pivot("route", ["factual", "relacional", "sintese"]).count().na.fill(0)


def multihop_valid(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions whose anchor stands somewhere, but in no chunk together with the bridge entity. questions: query_id, anchor, bridge."""
    q = questions.select("query_id", text.fold(F.col("anchor")).alias("a"), text.fold(F.col("bridge")).alias("b"))
    bodies = chunks.select(text.fold(F.col("content")).alias("body"))
    parts = max(1, -(-questions.count() // QUESTION_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    valid = None
    for i in range(parts):  # containment has no key to join by, so the questions are broadcast in blocks of bounded size
        met = bodies.join(F.broadcast(q.filter(block == i)), F.col("body").contains(F.col("a")))
        ok = met.groupBy("query_id").agg(F.max(F.col("body").contains(F.col("b"))).alias("together")).filter("NOT together").select("query_id")
        valid = ok if valid is None else valid.unionByName(ok)
    return questions.join(valid, "query_id", "left_semi")


def multihop_questions(pairs: DataFrame, chunks: DataFrame, most: int | None = None) -> DataFrame:
    """Questions that need two documents: query_id, text, kind, anchors, bridge. pairs: query_id, text, anchor, bridge; the ones whose
    answer stands together with the bridge are left out.
    """
    good = multihop_valid(pairs, chunks).select("query_id", "text", F.lit("multihop").alias("kind"), F.array("anchor").alias("anchors"), "bridge")
    return good if most is None else good.orderBy("query_id").limit(most)


def verdict(before: dict, after: dict) -> str:
    """Which router stays: by recall, unless both are saturated, then by reciprocal rank; a tie keeps the old one."""
    key = "mrr" if min(before["recall"], after["recall"]) >= 0.999 else "recall"
    gain = after[key] - before[key]
    return "keep" if gain > 1e-9 else "revert"
