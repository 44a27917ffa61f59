"""Near-duplicates by similarity: Jaccard of at least SIMILARITY between the sets of WORDS-word shingles.

Candidates are, first, what the fingerprints of the same shingles connect by the generalised pigeonhole principle (simhash.links, as it is):
all sets of a component. These can't be all: sets of similarity 0.8 differ in 15 % of all bits, 10 of 64 on average, and a radius
that finds 999 in 1000 of them (19 bits) leaves no partition that the pigeonhole principle could probe for less than all pairs.

So candidates are also what shares a band of MinHash values: BANDS bands of ROWS values miss a pair at SIMILARITY with a probability of
(1 - SIMILARITY ** ROWS) ** BANDS, 7 in a million, and closer pairs with less. Every candidate is verified on the whole sets.
A bucket gives the links of a spanning forest, not all pairs. Equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm._base import broadcast_if_small, materialize, text_chunks
from quarry.llm.components import connected

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
#: Sets of a bucket that one task compares; a larger bucket is dealt out in pairs of blocks of half the size.
BUCKET = 4096

_rng = np.random.default_rng(11)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Distinct XXH64 of the shingles, in order; a shorter text is one shingle, one without words the empty one."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = map(join, zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else [join(words)]
    return np.unique(np.fromiter((digest(s, 42) for s in runs), np.uint64))


def bands(h: np.ndarray) -> np.ndarray:
    """A key for each band: equal for texts whose least values under the band's permutations are equal."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(h), 1024):
        least = np.minimum(least, (h[lo : lo + 1024, None] * _TIMES + _PLUS).min(axis=0))
    least ^= least >> np.uint64(31)
    keys = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    return keys ^ (keys >> np.uint64(29))


def sketches(rows: DataFrame) -> DataFrame:
    """row, doc_id, code (of the set of shingles), print (its SimHash) and bands of every whole text. rows: row, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            sets = [shingles(t) for t in texts]
            codes = np.fromiter((xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets), np.uint64).view(np.int64)
            prints = np.fromiter(map(simhash.majority, sets), np.uint64).view(np.int64)
            keys = np.concatenate([bands(h) for h in sets]).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            yield pa.RecordBatch.from_arrays([pa.array([i["row"] for i in ids], pa.int64()), pa.array([i["doc_id"] for i in ids], pa.int64()), pa.array(codes), pa.array(prints), keys], names=["row", "doc_id", "code", "print", "bands"])

    return rows.select(F.struct("row", "doc_id").alias("id"), "text").mapInArrow(run, "row long, doc_id long, code long, print long, bands array<long>")


def with_components(nodes: DataFrame) -> DataFrame:
    """nodes whose bands have one key more: the component that op3's links of their fingerprints give. nodes: print, bands."""
    prints = materialize(nodes.select(F.col("print").alias("code"), F.col("print").alias("least")).distinct(), "fingerprints")
    roots = connected(prints, simhash.links(prints.select("code"))).withColumnRenamed("code", "print")
    return nodes.join(broadcast_if_small(roots), "print").withColumn("bands", F.array_append("bands", F.xxhash64(F.lit("print"), "component_id"))).drop("component_id")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(key, rows) of each run of equal values in the first column."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]).tolist()
        for lo, hi in zip(edges, edges[1:]):
            if held and keys[lo] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = keys[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def buckets(nodes: DataFrame) -> DataFrame:
    """bucket, codes: the codes that share a band, two at least; the same codes once. nodes: code, bands, a row for each code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def whole() -> pa.RecordBatch:
            keys = [xxhash.xxh3_64_intdigest(c.tobytes()) for c in found]
            return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(found, pa.list_(pa.int64()))], names=["bucket", "codes"])

        last, tail = None, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, code = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            if len(tail) and key[0] != last:
                found += dealt(tail)
                tail = tail[:0]
            many = np.flatnonzero(np.diff(edges)[:-1] > 1).tolist()
            if len(edges) > 2 and len(tail):  # the run held back ends in this batch
                found += dealt(np.concatenate([tail, code[: edges[1]]]))
                tail, many = tail[:0], [i for i in many if i]
            for i in many:
                found += dealt(code[edges[i] : edges[i + 1]])
            last, tail = key[-1], np.concatenate([tail, code[edges[-2] :]])
            if len(found) > 2000:
                yield whole()
                found = []
        found += dealt(tail)
        if found:
            yield whole()

    def dealt(codes: np.ndarray) -> list[np.ndarray]:
        codes = np.unique(codes)
        if len(codes) <= BUCKET:
            return [codes] if len(codes) > 1 else []
        blocks = [codes[i : i + BUCKET // 2] for i in range(0, len(codes), BUCKET // 2)]
        return [np.concatenate([a, b]) for i, a in enumerate(blocks) for b in blocks[i + 1 :]]

    parted = nodes.select(F.explode("bands").alias("band"), "code").repartition("band").sortWithinPartitions("band")
    return parted.mapInArrow(run, "bucket long, codes array<long>").dropDuplicates(["bucket"])


def forest(codes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of a spanning forest of the codes whose sets are similar enough."""
    sizes = np.array([len(s) for s in sets])
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(place, np.cumsum(sizes)[:-1])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flag = np.zeros(int(place.max()) + 1, bool)
    left, out, counted = np.ones(len(sets), bool), [], len(sets)
    while left.any():
        waiting = [int(left.argmax())]
        left[waiting[0]] = False
        while waiting and left.any():
            i = waiting.pop()
            if left.sum() * 2 < counted:  # those reached aren't counted again
                counted = int(left.sum())
                stay = left[owner]
                owner, place = owner[stay], place[stay]
            flag[own[i]] = True
            both = np.bincount(owner[flag[place]], minlength=len(sets))
            flag[own[i]] = False
            near = np.flatnonzero(left & (both >= SIMILARITY * (sizes + sizes[i] - both) - 1e-9))
            out += [(int(codes[i]), int(codes[j])) for j in near]
            left[near] = False
            waiting.extend(near.tolist())
    return out


def groups(rows: DataFrame) -> DataFrame:
    """row, doc_id, group: equal for what similar texts connect. rows: row (equal only for equal id and text), doc_id, text."""
    prints = materialize(sketches(rows), "sketches")
    nodes = materialize(prints.groupBy("code").agg(F.min("row").alias("row"), F.first("print").alias("print"), F.first("bands").alias("bands")), "nodes")
    found = materialize(buckets(with_components(nodes)), "buckets")
    members = found.select("bucket", F.explode("codes").alias("code"))
    wanted = materialize(nodes.join(members.select("code").distinct(), "code", "left_semi").select("row", "code"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array([shingles(t).tobytes() for t in texts], pa.binary())], names=["code", "shingles"])

    whole = rows.join(broadcast_if_small(wanted), "row").select("code", "text").mapInArrow(sets, "code long, shingles binary")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _runs(batches):
            texts = dict(zip(held.column(1).to_pylist(), held.column(2)))  # a repeated row brings its set again
            links = forest(np.array(list(texts), np.int64), [np.frombuffer(s.as_py(), np.uint64) for s in texts.values()])
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = members.join(whole, "code").select("bucket", "code", "shingles").repartition("bucket").sortWithinPartitions("bucket")
    links = dealt.mapInArrow(verify, "a long, b long").distinct()
    roots = connected(nodes.select("code", F.col("code").alias("least")), links)
    return prints.join(broadcast_if_small(roots), "code").select("row", "doc_id", F.col("component_id").alias("group"))
