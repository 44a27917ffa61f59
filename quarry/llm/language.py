"""Operator 8: language identification as the inference of a multilingual mixture.

Each language has a distribution over hashed letter trigrams, counted over all learning documents. A document is a mixture:
expectation-maximisation estimates the proportions of the languages from the n-gram likelihoods of its words, and languages
leave the set as long as the penalised likelihood gains by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import few_parts, text_chunks, tree_sum

BUCKETS = 1 << 16
SLICE = 1 << 10
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, languages string"
NONE = "und"


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: its simple lower case, and whether it is a letter."""
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, bool)
    find = regex.compile(r"\p{L}+")
    for lo in range(0, 0x110000, 0x10000):
        for m in find.finditer("".join(map(chr, range(lo, lo + 0x10000)))):
            letter[lo + m.start() : lo + m.end()] = True
            for i, c in enumerate(m.group()):
                if len(low := c.lower()) == 1:
                    lower[lo + m.start() + i] = ord(low)
    return lower, letter


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram around each letter, its place in the concatenation, where each text ends there)."""
    lower, letter = tables()
    points = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[points]
    c = np.where(is_letter, lower[points], 32).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    h = c[at - 1] * np.uint64(0x9E3779B97F4A7C15) + c[at] * np.uint64(0xC2B2AE3D27D4EB4F) + c[at + 1] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(48)).astype(np.int32), at, np.cumsum([len(t) + 1 for t in texts])


def learn(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Log-probabilities of the buckets by language. labelled: text, lang. Counts are summed in slices, never in one task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def texts_of(lang_by_batch):
            for batch in lang_by_batch:
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0)], names=["lang", "text"])

        for langs, texts in text_chunks(texts_of(batches)):
            bucket, at, ends = trigrams(texts)
            names, code = np.unique(np.array(langs, dtype=object), return_inverse=True)
            of = code[np.searchsorted(ends, at, side="right").clip(0, len(code) - 1)]
            both = np.bincount(of.astype(np.int64) * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for name, row in zip(names, both):
                counts[name] = counts.get(name, 0) + row
        for name, row in counts.items():
            parts = row.astype("<i8").reshape(-1, SLICE)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["lang", "slice", "counts"])

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # rows of a key follow each other
        held = None
        for frame in frames:
            for row in frame.itertuples(index=False):
                values = np.frombuffer(row.counts, "<i8")
                if held and held[:2] == [row.lang, row.slice]:
                    held[2] += values
                else:
                    if held:
                        yield pd.DataFrame([(*held[:2], held[2].tobytes())], columns=["lang", "slice", "counts"])
                    held = [row.lang, row.slice, values.copy()]
        if held:
            yield pd.DataFrame([(*held[:2], held[2].tobytes())], columns=["lang", "slice", "counts"])

    schema = "lang string, slice int, counts binary"
    summed = tree_sum(few_parts(labelled.select("text", "lang")).mapInArrow(count, schema), ["lang", "slice"], add)
    model: dict[str, np.ndarray] = {}
    for row in summed.collect():  # BUCKETS counts for each language
        model.setdefault(row["lang"], np.zeros(BUCKETS))[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(bytes(row["counts"]), "<i8")
    return {k: np.log((v + 0.5) / (v.sum() + 0.5 * BUCKETS)).astype(np.float32) for k, v in sorted(model.items()) if v.sum()}


def infer(texts: list[str], logs: np.ndarray, rounds: int = 8, penalty: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(proportions, chosen set, documents with letters) for the texts; logs: languages x buckets."""
    return mixture(texts, logs, rounds, penalty)[:3]


def mixture(texts: list[str], logs: np.ndarray, rounds: int = 8, penalty: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What infer() gives, and documents with letters that the chosen set explains, rather than the background of equal trigrams.

    Background takes the place of the whole set where the words gain by it more than the price of a language. A word counts
    with log(BUCKETS) at most for either side, so that one long string doesn't outweigh a text. Without any languages all
    documents with letters are explained.
    """
    k = len(logs)
    share, active, has, explained = np.zeros((len(texts), k)), np.zeros((len(texts), k), bool), np.zeros(len(texts), bool), np.zeros(len(texts), bool)
    bucket, at, ends = trigrams(texts)
    if not k:
        explained[np.searchsorted(ends, at, side="right").clip(0, len(texts) - 1)] = True
    if not len(at) or not k:
        return share, active, has, explained
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))  # words
    doc = np.searchsorted(ends, at[first], side="right").clip(0, len(texts) - 1)
    words = np.stack([np.add.reduceat(row[bucket], first) for row in logs])  # languages x words
    top = words.max(axis=0)
    words -= top
    p = np.exp(words).astype(np.float64)
    here, begin, of = np.unique(doc, return_index=True, return_inverse=True)  # documents' words follow each other
    n = np.add.reduceat(np.ones(len(doc)), begin)
    pi, on = np.full((k, len(here)), 1.0 / k), np.ones((k, len(here)), bool)

    def improve(times: int) -> None:
        nonlocal pi
        for _ in range(times):
            joint = pi[:, of] * p
            joint /= joint.sum(axis=0) + 1e-300
            pi = np.add.reduceat(joint, begin, axis=1) / n

    improve(rounds)
    price = penalty * np.log(n) + 1
    for _ in range(k - 1):
        joint = pi[:, of] * p
        whole = joint.sum(axis=0)
        lost = np.full((k, len(here)), np.inf)
        for j in range(k):
            rest = np.log((whole - joint[j]).clip(1e-300) / (1 - pi[j]).clip(1e-12)[of]) - np.log(whole.clip(1e-300))
            lost[j] = -np.add.reduceat(rest, begin)
        lost[~on] = np.inf
        j = lost.argmin(axis=0)
        leave = (lost[j, np.arange(len(here))] < price) & (on.sum(axis=0) > 1)
        if not leave.any():
            break
        on[j[leave], np.flatnonzero(leave)] = False
        pi = np.where(on, pi, 0)
        pi /= pi.sum(axis=0)
        improve(1)
    improve(2)
    letters = np.diff(np.append(first, len(at)))
    gain = np.log((pi[:, of] * p).sum(axis=0).clip(1e-300)) + top + letters * np.log(BUCKETS)
    gain = np.add.reduceat(gain.clip(-np.log(BUCKETS), np.log(BUCKETS)), begin)
    share[here], active[here], has[here], explained[here] = pi.T, on.T, True, gain >= -price
    return share, active, has, explained


def _learnt(own: DataFrame) -> tuple[list[str], np.ndarray, int]:
    """(languages, log-probabilities, characters of a batch) from own: doc_id, text, lang, held_out."""
    known = learn(own.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~F.col("held_out")))
    names = list(known)
    logs = np.stack([known[n] for n in names]) if names else np.zeros((0, BUCKETS), np.float32)
    return names, logs, max(100_000, 3_000_000 // max(4, len(names)))


def _own(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    out = F.coalesce(F.crc32(docs[id_col].cast("long").cast("string")) % 4 == 2, F.lit(False))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), out.alias("held_out"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Language of every whole text, learnt from those documents with a label whose crc32(id) mod 4 is not 2.

    lang_pred is ``und`` with score 0 for a null text, one without letters, or where nothing could be learnt. A null id is
    never learnt from and not held out. Repeated rows each give a row; an empty table gives none.
    """
    own = _own(docs, id_col, text_col, lang_col)
    names, logs, chars = _learnt(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(_paired(batches), chars):
            share, active, has = infer(texts, logs)
            best = share.argmax(axis=1) if names else np.zeros(len(texts), int)
            kinds = [names[b] if h else NONE for b, h in zip(best, has)]
            score = [min(1.0, float(share[i, b])) if has[i] else 0.0 for i, b in enumerate(best)]
            sets = [",".join(f"{names[j]}:{share[i, j]:.3f}" for j in np.argsort(-share[i], kind="stable") if active[i, j]) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in ids], pa.int64()), pa.array([o for _, o in ids]), pa.array(kinds), pa.array(score), pa.array(sets)], names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    return own.select("doc_id", "text", "held_out").mapInArrow(run, PREDICTED)


class _Pair:
    """An id with the flag that goes with it, as text_chunks expects of an Arrow scalar."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def as_py(self):
        return self.value


class _Batch:
    def __init__(self, batch: pa.RecordBatch):
        self._columns = [[_Pair(x) for x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())], batch.column(1)]

    def column(self, i: int):
        return self._columns[i]


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[_Batch]:
    return map(_Batch, batches)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents whose words a set of learnt languages explains, with their own columns: a map over the rows, which are neither joined nor shuffled.

    Where no label could be learnt, documents with letters stay. A null text, an empty one and one without letters go; a null id
    is neither learnt from nor a reason to go; each of repeated rows is judged, and alike; an empty table stays empty.
    """
    names, logs, chars = _learnt(_own(docs, id_col, text_col, lang_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], names=["doc_id", "text"])
            kept = [i for ids, texts in text_chunks([rows], chars) for i, explained in zip(ids, mixture(texts, logs)[3]) if explained]
            if kept:
                yield batch.take(pa.array(kept, pa.int64()))

    return docs.mapInArrow(run, docs.schema)
