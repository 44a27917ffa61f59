"""Model boundaries: embedder, extractor, reranker, answerer, with deterministic defaults that need no network.

The defaults are for plumbing and tests; they make no claim to model quality.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import fixed, text


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Words hashed to signed coordinates, unit length. Texts that share words are near."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        place: dict[str, int] = {}  # each distinct word is hashed once
        words = [[place.setdefault(w, len(place)) for w in re.findall(r"\w+", t.lower())] for t in texts]
        digests = [hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in place]
        at = np.array([int.from_bytes(h[:4], "little") % self.dimensions for h in digests], np.int64)
        sign = np.array([1 if h[4] & 1 else -1 for h in digests], np.float32)
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, found in zip(out, words):
            if found:
                row += np.bincount(at[found], sign[found], self.dimensions)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


def embed(content: Column, embedder: Embedder, batch: int = 256) -> Column:
    """An array<float> column; the embedder is set up once for each task."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts, out = part.fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                made = embedder.embed(texts[i : i + batch])
                if len(made) != len(texts[i : i + batch]) or any(len(v) != embedder.dimensions for v in made):
                    raise ValueError("the embedder gave another number of vectors or dimensions")
                out += made
            yield pd.Series(out, index=part.index)

    return run(content)


class Extractor(Protocol):
    model: str
    version: str

    def extract(self, content: str, context: str) -> dict: ...


class RuleExtractor:
    """Runs of capitalised words are entities; a relation word between two of them relates them."""

    model, version = "rules", "1"
    _NAME = re.compile(r"\b[A-ZÀ-Ý][\wÀ-ÿ&.-]*(?:\s+(?:d[aeo]s?\s+)?[A-ZÀ-Ý][\wÀ-ÿ&.-]*)*")
    _VERBS = (("controla", "CONTROLA"), ("adquiriu", "ADQUIRIU"), ("fornece", "FORNECE_PARA"), ("concorre", "CONCORRE_COM"), ("produz", "PRODUZ"), ("localizada", "LOCALIZADA_EM"), ("atua", "ATUA_EM"))

    def extract(self, content: str, context: str = "") -> dict:
        entities, relations = {}, []
        for sentence in re.split(r"(?<=[.!?])\s+", content):
            found = list(self._NAME.finditer(sentence))
            names = [re.sub(r"^(?:As?|Os?|Uma?)\s+(?=\S)", "", m.group()).strip(" .") for m in found]
            for n in names:
                entities.setdefault(n, {"name": n, "type": "Organizacao" if re.search(r"S\.?A|Cia|Banco|Ltda", n) else "Outro"})
            for (a, b), (s, t) in zip(zip(found, found[1:]), zip(names, names[1:])):
                between = sentence[a.end() : b.start()].lower()
                for word, kind in self._VERBS:
                    if word in between:
                        relations.append({"source": s, "target": t, "type": kind, "evidence": sentence.strip()})
                        break
        return {"entities": [e for e in entities.values() if e["name"]], "relations": relations}


EXTRACTION = "struct<entities:array<struct<name:string,type:string>>,relations:array<struct<source:string,target:string,type:string,evidence:string>>>"


def extract(chunks: DataFrame, extractor: Extractor) -> DataFrame:
    """chunk_id, payload (JSON) or error. chunks: chunk_id, content, title. One chunk's failure is its own row."""
    import json

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    rows.append((r.chunk_id, json.dumps(extractor.extract(r.content or "", r.title or ""), ensure_ascii=False), None))
                except Exception as e:  # reported, not fatal
                    rows.append((r.chunk_id, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["chunk_id", "payload", "error"])

    return chunks.select(F.col("chunk_id").cast("string"), "content", "title").mapInPandas(run, "chunk_id string, payload string, error string")


def overlap_scorer(question: Column, content: Column) -> Column:
    """A reranker's stand-in: the share of the question's words that the chunk has. A model comes as a pandas_udf of the same two columns."""
    q = F.array_distinct(text.terms(question))
    return F.size(F.array_intersect(q, text.terms(content))) / F.greatest(F.size(q), F.lit(1))


def extractive_answer(question: str, hits: list[dict]) -> str:
    """An answerer's stand-in: the first sentence of each of the first two chunks, cited."""
    return " ".join(f"{re.split(fixed.SENTENCE_BREAK, h['content'].strip())[0][:300]} [{i}]" for i, h in enumerate(hits[:2], 1))
