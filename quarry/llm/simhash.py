"""Operator 3: SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints link at RADIUS or fewer differing bits. The bits are dealt to partitions so that correlated ones share a
partition; a dynamic programme gives each partition its own threshold, from candidate counts estimated on the histograms of
all fingerprints. The thresholds of m partitions sum to RADIUS - m + 1 (-1: the partition is not probed), so two linked
fingerprints are within the threshold in one partition at least. Every fingerprint stands in the buckets of its own values and
probes those around them; buckets are verified on all bits. A bucket gives the links of a spanning forest, not all pairs. A
large one is first dealt out again by its remaining bits, in the same way; what is large even then is parted by the bits that
still vary, again and again, in the task that holds it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import broadcast_if_small, documents, materialize, text_chunks
from quarry.llm.components import connected

RADIUS = 3
PARTITIONS = 4
#: Fingerprints of a bucket that one task compares; buckets beyond it are dealt out again.
BUCKET = 4096
#: Fingerprints that are held against each other one by one; more are parted by their bits first.
BLOCK = 1024


def fingerprint(text: str) -> int:
    """A bit is 1 if it is set in over half the XXH64 (seed 42) of the 3-word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # both of bytes: A-Z, and the six ASCII spaces
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = map(join, zip(words, words[1:], words[2:])) if len(words) > 2 else [join(words)]
    return majority(np.fromiter((digest(s, 42) for s in shingles), np.uint64))


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of h."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, code (the fingerprint as a signed long) of every whole text; a null text counts as empty, with code 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            codes = np.fromiter(map(fingerprint, texts), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes)], names=["doc_id", "code"])

    return documents(docs).mapInArrow(run, "doc_id long, code long")


def correlated_partitions(joint: np.ndarray, n: int, parts: int = PARTITIONS) -> list[list[int]]:
    """Bits dealt to partitions of equal width, each grown from the free bit of least entropy by the bits that correlate most with it.

    joint: how often two bits are both set. Correlated bits together leave the other partitions with more distinct values.
    """
    ones = np.diag(joint) / max(1, n)
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    tied = np.abs(joint / max(1, n) - np.outer(ones, ones)) / np.outer(spread, spread)
    free, out = set(range(64)), []
    for _ in range(parts):
        group = [min(free, key=lambda b: (spread[b], b))]
        free.remove(group[0])
        while len(group) < 64 // parts:
            b = max(free, key=lambda b: (tied[b, group].mean(), -b))
            group.append(b)
            free.remove(b)
        out.append(sorted(group))
    return out


def allocate(histograms: list[np.ndarray], radius: int = RADIUS) -> list[int]:
    """Thresholds by dynamic programming: least estimated candidates, plus a little for each probe, at the sum that the principle needs."""
    m = len(histograms)
    costs = []
    for h in histograms:
        width = int(len(h)).bit_length() - 1
        values = np.arange(len(h))
        cost, at = {-1: 0.0}, np.zeros(len(h))
        probes = 0
        for t in range(radius + 1):
            for bits in itertools.combinations(range(width), t) if t <= 2 else ():
                at = at + h[values ^ sum(1 << b for b in bits)]
                probes += 1
            if t <= 2:
                cost[t] = float((h * at).sum()) + 0.5 * probes * float(h.sum())
        costs.append(cost)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (price, chosen) in best.items():
            for t, c in cost.items():
                if (k := total + t) not in step or price + c < step[k][0]:
                    step[k] = (price + c, [*chosen, t])
        best = step
    return best[radius - m + 1][1]


def gather(codes: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value of each code in a partition."""
    out = np.zeros(len(codes), np.int64)
    for i, b in enumerate(bits):
        out |= ((codes >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    return out


def balls(width: int, radius: int) -> np.ndarray:
    """All masks of up to radius of width bits, the empty one first."""
    return np.array([sum(1 << b for b in c) for t in range(radius + 1) for c in itertools.combinations(range(width), t)], np.int64)


def _statistics(codes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are and how often two bits are both set, over all of them: one partial sum for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, joint = 0, np.zeros((64, 64), np.int64)
        for batch in batches:
            c = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(c), 1 << 15):
                x = np.unpackbits(c[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                joint += (x.T @ x).astype(np.int64)
            n += len(c)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([joint.tobytes()], pa.binary())], names=["n", "joint"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, joint = 0, np.zeros((64, 64), np.int64)
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, joint = n + a, joint + np.frombuffer(b, np.int64).reshape(64, 64)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([joint.tobytes()], pa.binary())], names=["n", "joint"])

    schema = "n long, joint binary"
    partial = codes.select("code").mapInArrow(run, schema).repartition(8).mapInArrow(add, schema).collect()  # 8 rows of 32 KB
    return sum(r.n for r in partial), sum((np.frombuffer(bytes(r.joint), np.int64).reshape(64, 64) for r in partial), np.zeros((64, 64), np.int64))


def forest(codes: np.ndarray, own: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a spanning forest of what can be reached from own codes; codes are distinct.

    Each code is held against those not yet reached, so the links are fewer than the codes.
    """
    out: list[tuple[int, int]] = []
    while own.any():
        i = int(own.argmax())
        waiting = [codes[i]]
        codes, own = np.delete(codes, i), np.delete(own, i)
        while waiting and len(codes):
            x = waiting.pop()
            close = np.bitwise_count(codes ^ x) <= radius
            if close.any():
                reached = codes[close]
                out += [(int(x), int(y)) for y in reached]
                waiting.extend(reached)
                codes, own = codes[~close], own[~close]
    return out


def near(codes: np.ndarray, own: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what is within radius of own codes; codes are distinct.

    Many codes are parted by radius + 1 groups of the bits in which they vary: linked ones agree on one group, so only codes that do
    are held against each other. Each part varies in fewer bits, so the parts come to an end.
    """
    varying = int(np.bitwise_or.reduce(codes ^ codes[0]))
    bits = [b for b in range(64) if varying >> b & 1]
    if len(codes) <= BLOCK or len(bits) <= radius:
        return forest(codes, own, radius)
    out: list[tuple[int, int]] = []
    for g in range(radius + 1):
        mask = np.uint64(sum(1 << b for b in bits[g :: radius + 1]))
        order = np.argsort(codes & mask, kind="stable")
        value = (codes & mask)[order]
        edges = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1, [len(value)]])
        for lo, hi in zip(edges[:-1][np.diff(edges) > 1].tolist(), edges[1:][np.diff(edges) > 1].tolist()):
            part = order[lo:hi]
            if own[part].any():
                out += near(codes[part], own[part], radius)
    return out


def links(codes: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column code, one row each) that connect all that are within RADIUS."""
    spark = codes.sparkSession
    n, joint = _statistics(codes)
    parts = correlated_partitions(joint, n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(parts), 1 << (64 // PARTITIONS)), np.int64)
        for batch in batches:
            c = batch.column(0).to_numpy().view(np.uint64)
            for p, bits in enumerate(parts):
                total[p] += np.bincount(gather(c, bits), minlength=total.shape[1])
        p, v = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(v), pa.array(total[p, v])], names=["part", "value", "n"])

    counted = codes.mapInArrow(count, "part int, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "histograms")
    histograms = [np.zeros(1 << (64 // PARTITIONS)) for _ in parts]
    for row in counted.toLocalIterator():  # at most PARTITIONS x 65536 rows
        histograms[row.part][row.value] = row.n
    thresholds = allocate(histograms)
    large = {(p, int(v)) for p, h in enumerate(histograms) for v in np.flatnonzero(h * len(balls(64 // PARTITIONS, max(0, thresholds[p]))) > BUCKET)}
    return _bucket_links(codes, parts, thresholds, large, spark)


def _bucket_links(codes: DataFrame, parts: list[list[int]], thresholds: list[int], large: set, spark) -> DataFrame:
    masks = [balls(len(bits), t) if t >= 0 else np.array([], np.int64) for bits, t in zip(parts, thresholds)]
    # the bits outside a partition, in RADIUS + 1 groups: linked codes agree on one group, so a large bucket splits by it
    rest = [[[b for b in range(64) if b not in bits][g :: RADIUS + 1] for g in range(RADIUS + 1)] for bits in parts]
    is_large = [np.zeros(1 << len(bits), bool) for bits in parts]
    for p, v in large:
        is_large[p][v] = True

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(whole), 20_000):
                c = whole[lo : lo + 20_000]
                for p, bits in enumerate(parts):
                    value = gather(c, bits)
                    for i, mask in enumerate(masks[p]):
                        v = value ^ mask
                        hot = is_large[p][v]
                        keys, rows, own = [], [], []
                        if (cold := np.flatnonzero(~hot)).size:
                            keys.append((v[cold] << 22) | p)
                            rows.append(cold)
                        if (warm := np.flatnonzero(hot)).size:
                            for g, some in enumerate(rest[p]):
                                keys.append((v[warm] << 22) | (gather(c[warm], some) << 6) | (1 << 5) | (g << 3) | p)
                                rows.append(warm)
                        at = np.concatenate(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(c[at].view(np.int64)), pa.array(np.full(len(at), i == 0))], names=["bucket", "code", "own"])

    dealt = codes.mapInArrow(deal, "bucket long, code long, own boolean")
    # a bucket of one holds no link, and its rows need not be sorted together with others
    parted = dealt.repartition("bucket").sortWithinPartitions("bucket", "own")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes_, own in _groups(batches):
            if len(codes_) < 2:
                continue
            found = near(codes_, own)
            if found:
                a, b = np.array(found, np.uint64).T
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return parted.mapInArrow(verify, "a long, b long").distinct()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The codes and own flags of each bucket, from rows in order of bucket; codes are distinct, own ones first."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    key = None

    def whole() -> tuple[np.ndarray, np.ndarray]:
        codes, own = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(~own, kind="stable")
        codes, own = codes[order], own[order]
        _, first = np.unique(codes, return_index=True)
        first.sort()
        return codes[first], own[first]

    for batch in batches:
        bucket, code, own = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
        if not len(bucket):
            continue
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        for lo, hi in zip(edges, edges[1:]):
            if held and bucket[lo] != key:
                yield whole()
                held = []
            key = bucket[lo]
            held.append((code[lo:hi], own[lo:hi]))
    if held:
        yield whole()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links.

    Null texts and texts without words have the zero fingerprint, which links like any other. A null doc_id is never the
    smallest unless its whole component has none. Repeated rows each give a row; an empty table gives none.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(prints.groupBy("code").agg(F.min("doc_id").alias("least")), "codes")
    edges = links(nodes.select("code"))
    roots = connected(nodes, edges)
    hexed = F.lower(F.lpad(F.hex("code"), 16, "0"))
    return prints.join(broadcast_if_small(roots), "code").select("doc_id", hexed.alias("fingerprint"), F.col("component_id"))


def row_key(docs: DataFrame) -> Column:
    """Tells rows apart by id and text, so that unrelated texts under a null or repeated id are rows of their own."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def fingerprint_groups(rows: DataFrame) -> DataFrame:
    """row, doc_id, group: equal for what fingerprints connect. rows: row (equal only for equal id and text), doc_id, text."""
    coded = materialize(fingerprints(rows.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row"), "fingerprints")
    nodes = materialize(coded.groupBy("code").agg(F.min("row").alias("least")), "codes")
    roots = connected(nodes, links(nodes.select("code")))
    ids = rows.select("row", "doc_id").distinct()
    return coded.join(broadcast_if_small(roots), "code").join(ids, "row").select("row", "doc_id", F.col("component_id").alias("group"))


def keep_one(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = fingerprint_groups) -> DataFrame:
    """One row of each group: the one with the smallest doc_id, a null one last, ties by a hash of id and text. All columns stay.

    Rows are told apart by id and text: under a null or repeated id each text is decided for itself, and of rows that agree in both
    one stays, as they are copies. Null and empty texts are a group by the rules of ``groups``. An empty table stays empty.

    What goes is a small part, so its keys meet the texts by a broadcast where their size allows, and the texts aren't shuffled.
    """
    prints = documents(docs).select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    found = materialize(groups(prints), "groups")
    best = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"), F.count("*").alias("n"))
    best = materialize(best.filter("n > 1").select("group", "best"), "best")  # written first: a large group's rows can then be shared among tasks
    gone = materialize(found.join(broadcast_if_small(best), "group").filter(F.col("row") != F.col("best.row")).select("row", "doc_id").distinct(), "gone")
    twice = materialize(found.groupBy("row", "doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("row", "doc_id"), "repeated")
    # the row as one column, so that none of its names meets those used here
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), row_key(docs).alias("key"), docs["doc_id"].cast("long").alias("id"))

    def same(keys: DataFrame) -> Column:
        return (F.col("key") == keys["row"]) & F.col("id").eqNullSafe(keys["doc_id"])

    kept = whole.join(broadcast_if_small(gone), same(gone), "left_anti")
    if twice.take(1):
        again = kept.join(broadcast_if_small(twice), same(twice), "left_semi")
        kept = kept.join(broadcast_if_small(twice), same(twice), "left_anti").unionByName(again.dropDuplicates(["key", "id"]))
    return kept.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])
