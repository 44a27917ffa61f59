"""Section-aware chunking. Each document is cut by itself, so the operator is a map over partitions without a shuffle.

A document is laid out first: its headings divide the lines into sections, blank lines divide those into paragraphs, and a paragraph
that is too long into runs of sentences. Then the parts of each section are packed in order.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import fixed

_EQUALS = re.compile(fixed.HEADING)
_SHARPS = re.compile(r"(#{1,6})\s+(.+?)\s*#*$")
_BREAK = re.compile(fixed.SENTENCE_BREAK)
_GAP = "\n\n"


@dataclass(frozen=True)
class Sizes:
    """Limits in characters. A tail shorter than least joins the chunk before it where that fits."""

    most: int = 1800
    overlap: int = 200
    least: int = 80
    markdown: bool = False
    """Whether '#' headings count, too."""


def heading(line: str, markdown: bool) -> tuple[int, str] | None:
    """(depth from 0, title) of a line that is a heading."""
    if m := _EQUALS.match(line):
        return len(m[1]) - 2, m[2]
    if markdown and (m := _SHARPS.match(line)):
        return len(m[1]) - 1, m[2]
    return None


def layout(text: str, markdown: bool = False) -> list[tuple[str, list[str]]]:
    """(section path, paragraphs) of the sections that hold text, in order; neighbours under one path are one section."""
    lines = [line.rstrip() for line in text.splitlines()]
    marks = [(i, found) for i, line in enumerate(lines) if (found := heading(line.strip(), markdown))]
    paths = list(itertools.accumulate((found for _, found in marks), lambda path, found: (*path[: found[0]], found[1]), initial=()))
    starts = [0, *(i + 1 for i, _ in marks)]
    ends = [*(i for i, _ in marks), len(lines)]
    bodies = ("\n".join(lines[a:b]) for a, b in zip(starts, ends))
    split = ((" > ".join(path), [p for p in map(str.strip, re.split("\n{2,}", body)) if p]) for path, body in zip(paths, bodies))
    filled = (section for section in split if section[1])
    return [(path, [p for _, group in same for p in group]) for path, same in itertools.groupby(filled, key=lambda section: section[0])]


def sentence_runs(paragraph: str, most: int) -> list[str]:
    """The paragraph in parts of at most so many characters: as many whole sentences as fit; a longer sentence is cut first."""
    if len(paragraph) <= most:
        return [paragraph]
    pieces = [s[i : i + most] for s in _BREAK.split(paragraph) for i in range(0, len(s), most)]
    reach = [0, *itertools.accumulate(len(p) + 1 for p in pieces)]  # each with the space that follows it
    out, at = [], 0
    while at < len(pieces):
        end = max(at + 1, bisect.bisect_right(reach, reach[at] + most + 1) - 1)
        out.append(" ".join(pieces[at:end]).strip() if end > at + 1 else pieces[at])
        at = end
    return out


def packed(parts: list[str], sizes: Sizes) -> list[str]:
    """Chunks of one section: parts together while they fit, each chunk begun with the end of the one before it where that fits."""
    chunks: list[list[str]] = [[]]
    room = sizes.most
    for part in parts:
        if len(part) + len(_GAP) * bool(chunks[-1]) > room and chunks[-1]:
            tail = _GAP.join(chunks[-1])[-sizes.overlap :] if sizes.overlap else ""
            chunks.append([tail] if tail and len(tail) + len(_GAP) + len(part) <= sizes.most else [])
            room = sizes.most - len(tail) * bool(chunks[-1])
        room -= len(part) + len(_GAP) * bool(chunks[-1])
        chunks[-1].append(part)
    whole = [_GAP.join(c) for c in chunks if c]
    if len(whole) > 1 and len(whole[-1]) < sizes.least and len(whole[-2]) + len(_GAP) + len(whole[-1]) <= sizes.most:
        whole[-2:] = [_GAP.join(whole[-2:])]
    return whole


def cut(text: str, sizes: Sizes = Sizes()) -> list[tuple[str, str]]:
    """(section path, chunk): no chunk is longer than most, none crosses sections."""
    return [(path, chunk) for path, paragraphs in layout(text, sizes.markdown) for chunk in packed([part for p in paragraphs for part in sentence_runs(p, sizes.most)], sizes)]


def chunk_documents(documents: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """chunk_id, document_id, ordinal, content, section_path, char_count. documents: id, source, external_id, content."""
    schema = "document_id string, source string, external_id string, ordinal int, content string, section_path string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, s, e, n, content, trail) for i, s, e, body in zip(*(c.to_pylist() for c in batch.columns)) for n, (trail, content) in enumerate(cut(body or "", sizes))]
            if rows:
                kinds = (pa.string(),) * 3 + (pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in schema.split(", ")])

    made = documents.select(F.col("id").cast("string"), F.col("source").cast("string"), F.col("external_id").cast("string"), F.col("content").cast("string")).mapInArrow(run, schema)
    key = F.sha2(F.concat_ws("|", "source", "external_id", F.col("ordinal").cast("string")), 256)
    return made.select(key.alias("chunk_id"), "document_id", "ordinal", "content", "section_path", F.length("content").alias("char_count"))
