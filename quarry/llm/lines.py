"""Operator 9: line dedup by site-relative frequency, and operator 5: substring dedup by hashing units.

Both keep whole lines or sentences as the unit and group only digests, never texts.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._base import BROADCAST_MB, broadcast_if_small, documents, materialize, memory_mb, text_chunks

#: A line that stands on a single page of its host isn't repeated, whatever its share.
LEAST_PAGES = 2
#: Tasks that share the pages of one host where the boilerplate is too large for a broadcast.
SALTS = 16


# ---- operator 9 ---------------------------------------------------------------------------------------------------


def _digest(line: Column) -> Column:
    """96 bits of a line, without outer spaces."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.hash(F.trim(line)).alias("b"))


def boilerplate(docs: DataFrame, host: Column, text_col: str = "text", ratio: float = 0.2) -> DataFrame:
    """(host, lines): digests of the lines on more than ratio of the host's pages, and on more than one of them.

    A host has at most (mean lines of a page / ratio) such lines, so the array does not grow with the host. A null host is a host of
    its own; a null text is a page without lines; a line counts once for each page; repeated rows are pages each; an empty table
    gives no rows.
    """
    pages = docs.select(host.alias("host"), F.col(text_col).alias("text"))
    lines = pages.filter(F.col("text").isNotNull()).select("host", F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _digest))).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    return counts.join(totals, counts["host"].eqNullSafe(totals["host"])).filter(F.col("n") > ratio * F.col("pages")).groupBy(counts["host"]).agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.2) -> DataFrame:
    """docs with their boilerplate lines dropped from the text, and _lines and _dropped: how many lines there were and went.

    A null text stays null; a null host is a host of its own; blank lines are kept; repeated rows are pages each; an empty
    table stays empty. All other columns pass through; where docs has a column _lines or _dropped, those added have one more
    underscore in front, until no name is taken.
    """
    bad = materialize(boilerplate(docs, docs[host_col], text_col, ratio).select(F.col("host").alias("at"), F.col("lines").alias("bad")), "boilerplate")
    # the row as one column, so that none of its names meets those used here
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[host_col].alias("host"), F.split(docs[text_col], "\n").alias("lines"))
    if memory_mb(bad) <= BROADCAST_MB:
        joined = rows.join(F.broadcast(bad), F.col("host").eqNullSafe(F.col("at")), "left")
    else:  # the pages of one host are shared among tasks
        dealt = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("mine", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        joined = rows.join(dealt, F.col("host").eqNullSafe(F.col("at")) & (F.col("mine") == F.col("salt")), "left")
    kept = F.filter("lines", lambda x: ~F.array_contains("bad", _digest(x)))
    joined = joined.select("row", "lines", F.when(F.col("bad").isNull(), F.col("lines")).otherwise(kept).alias("kept"))
    own = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    n_lines, n_dropped = count_names(docs)
    return joined.select(*own, F.coalesce(F.size("lines"), F.lit(0)).alias(n_lines), F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).alias(n_dropped))


def count_names(docs: DataFrame) -> tuple[str, str]:
    """The names under which drop_boilerplate adds its counts."""
    taken, names = {c.lower() for c in docs.columns}, ("_lines", "_dropped")
    while taken & set(names):
        names = ("_" + names[0], "_" + names[1])
    return names


LINE_SQL = """
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
seen AS (SELECT source, line, count(*) AS n FROM (
  SELECT source, unnest(list_distinct(list_transform(lines, lambda x: trim(x)))) AS line FROM pages) WHERE line <> '' GROUP BY source, line),
bad AS (SELECT seen.source, list(line) AS lines FROM seen JOIN totals ON seen.source IS NOT DISTINCT FROM totals.source
  WHERE n >= 2 AND n > 0.2 * pages GROUP BY seen.source),
kept AS (SELECT doc_id, pages.lines AS before, list_filter(pages.lines, lambda x: NOT coalesce(list_contains(bad.lines, trim(x)), false)) AS after
  FROM pages LEFT JOIN bad ON pages.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, CAST(coalesce(len(before), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(before) - len(after), 0) AS INTEGER) AS n_dropped,
  sha256(array_to_string(after, chr(10))) AS kept_sha256 FROM kept
"""


def line_report(docs: DataFrame) -> DataFrame:
    kept = drop_boilerplate(docs.select("doc_id", "source", "text"))
    return kept.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


# ---- operator 5 ---------------------------------------------------------------------------------------------------

UNITS = "doc_id long, row long, start long, end long, words int, hi long, lo long"
#: Characters of scripts that set no spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_UNIT = {
    "line": re.compile(r"[^\n]+"),
    "paragraph": re.compile(r"\S(?:[^\n]|\n(?!\s*\n))*"),
    # a sentence ends at ., ! or ? before white space, and always at the end of its line
    "sentence": re.compile(r"[^\s](?:[^\n.!?]|[.!?](?!\s|\Z))*[.!?]?"),
}


def units_of(text: str, unit: str, min_words: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, normal form) of the units that count: lower case, white space collapsed, min_words words at least."""
    for m in _UNIT[unit].finditer(text):
        words = m.group().lower().split()
        if len(words) >= min_words:
            yield m.start(), m.end(), len(words), " ".join(words).encode("utf-8", "surrogatepass")


def weigh(normal: bytes) -> int:
    """Length in words where spaces don't tell: eight characters of a long string or two of a script without spaces count as a word."""
    weight = sum(max(1, len(w) // 8) for w in normal.split(b" "))
    return weight if normal.isascii() else max(weight, len(_UNSPACED.findall(normal.decode("utf-8", "surrogatepass"))) // 2)


def hash_units(docs: DataFrame, unit: str = "sentence", min_words: int = 8) -> DataFrame:
    """A row for each unit: where it stands (code points) and 128 bits of its normal form. row tells repeated ids apart.

    A null or empty text has no units; a null doc_id stays null; each of repeated rows has its own; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        for ids, texts in text_chunks(batches, 1_000_000):
            out = []
            for doc, text in zip(ids, texts):
                row += 1
                for start, end, words, normal in units_of(text, unit, min_words):
                    h = xxhash.xxh3_128_intdigest(normal)
                    out.append((doc, row, start, end, words, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in UNITS.split(", ")])

    return documents(docs).mapInArrow(run, UNITS)


def repeated_units(docs: DataFrame, unit: str = "sentence", min_words: int = 8) -> DataFrame:
    """The units to remove: all but the earliest occurrence, ranked by (doc_id, row, start), with their original offsets.

    A null text has no units; a null doc_id ranks before all ids; a repeated row repeats its units, so the later row loses
    them; an empty table gives no rows.
    """
    units = materialize(hash_units(docs, unit, min_words), "units")
    place = F.struct("doc_id", "row", "start")
    firsts = materialize(units.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "firsts")
    found = units.join(broadcast_if_small(firsts), ["hi", "lo"])  # written first: a very common unit's rows can then be shared among tasks
    return found.filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "row", "start", "end", "words", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"), "copies")


WINDOWS = "doc_id long, row long, start long, end long, before int, through int, hi long, lo long"


def windows_of(weights: list[int], least: int) -> Iterator[tuple[int, int]]:
    """(first, last): the shortest runs of units from each one on, and up to each one where none of those ends, that weigh least together."""
    total = [0, *itertools.accumulate(weights)]
    ends, last = set(), 0
    for first in range(len(weights)):
        last = max(last, first)
        while last < len(weights) and total[last + 1] - total[first] < least:
            last += 1
        if last == len(weights):
            break
        ends.add(last)
        yield first, last
    first = 0
    for last in range(len(weights)):
        while total[last + 1] - total[first + 1] >= least and first < last:
            first += 1
        if last not in ends and total[last + 1] - total[first] >= least:
            yield first, last


def hash_windows(docs: DataFrame, least: int) -> DataFrame:
    """A row for each window of sentences; before and through: words of the text before its start and up to its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        kinds = (*(pa.int64(),) * 4, *(pa.int32(),) * 2, pa.int64(), pa.int64())
        for ids, texts in text_chunks(batches, 500_000):
            out = []
            for doc, text in zip(ids, texts):
                row += 1
                units = list(units_of(text, "sentence", 1))
                words = [0, *itertools.accumulate(u[2] for u in units)]
                for a, b in windows_of([weigh(u[3]) for u in units], least):
                    h = xxhash.xxh3_128_intdigest(units[a][3] if a == b else b"\n".join(u[3] for u in units[a : b + 1]))
                    out.append((doc, row, units[a][0], units[b][1], words[a], words[b + 1], (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in WINDOWS.split(", ")])

    return documents(docs).mapInArrow(run, WINDOWS)


def repeated_passages(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """The passages to remove: what runs of neighbouring sentences cover that stand earlier in the same order, min_words long together.

    Sentences of any length count, over ends of lines, so copied code, lists and dialogue go whole; a long sentence is a run
    by itself. Spans are disjoint; kept_doc_id and kept_start tell where the first run of a span stands, copies how often.
    Rows, nulls and order are as in repeated_units.
    """
    windows = materialize(hash_windows(docs, min_words), "windows")
    place = F.struct("doc_id", "row", "start")
    firsts = materialize(windows.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "firsts")
    later = windows.join(broadcast_if_small(firsts), ["hi", "lo"]).filter(~place.eqNullSafe(F.col("first"))).drop("hi", "lo")
    order = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = later.withColumn("new", F.when(F.col("start") < reached, 0).otherwise(1))
    spans = apart.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lead = F.min(F.struct("start", "end", "first", "copies")).alias("lead")
    merged = spans.groupBy("row", "span").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), (F.max("through") - F.min("before")).alias("words"), lead)
    return merged.select("doc_id", "row", "start", "end", "words", F.col("lead.first.doc_id").alias("kept_doc_id"), F.col("lead.first.start").alias("kept_start"), F.col("lead.copies").alias("copies"))


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (doc_id, text and other columns) with the spans (doc_id, start, end; disjoint) cut out of the text; others unchanged.

    doc_id tells rows apart; a null one matches spans without an id. A null text stays null; other columns pass through whatever
    their names; without spans, or rows, nothing changes.
    """
    cuts = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts")).withColumnRenamed("doc_id", "of")
    # the row as one column, so that none of its names meets those used here
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"), docs["text"].alias("body"))
    joined = rows.join(cuts, F.col("id").eqNullSafe(F.col("of")), "left")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("cuts.end"))
    starts = F.concat(F.col("cuts.start"), F.array(F.length("body").cast("long")))
    pieces = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.substring(F.col("body"), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")))
    text = F.when(F.col("cuts").isNull(), F.col("body")).otherwise(F.array_join(pieces, ""))
    return joined.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
