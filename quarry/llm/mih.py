"""Operator 1: approximate nearest neighbours by multi-index hashing, for largest inner products.

Vectors are extended by one coordinate to equal length, so that the largest inner product is the smallest angle; a rotation
learnt on a bounded sample makes codes of BITS bits; codes are split into substrings, each with an inverted index. A code within
Hamming radius r of the query's is within floor(r / SUBSTRINGS) in one substring, so probing the values around the query's
substrings retrieves every code within r. Only retrieved rows have their inner products computed. r grows until the k-th product
found says that a closer vector would have its code inside with high probability. Where a radius needs so many probes that they
would meet more entries than there are rows, the codes themselves are scanned: that retrieves the same rows for less.

Equal vectors are searched once and come out under all their ids. Index rows lie in shards, queries in blocks, both of bounded
bytes; each pair of shard and block is one unit of work.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._base import materialize

BITS, SUBSTRINGS = 256, 16
WIDTH = BITS // SUBSTRINGS
#: Rows that the rotation is learnt on, at most.
SAMPLE = 8_000
#: Rows of a shard, queries of a block, and bytes of the vectors of either.
SHARD, BLOCK, PART_BYTES = 32_768, 8_192, 32 << 20
#: How many standard deviations of a code's distance the radius covers beyond its mean at the k-th angle.
MARGIN = 1.5
#: Bits of a substring that are probed at most; beyond that a scan is always cheaper.
DEEPEST = 4


def learn_rotation(x: np.ndarray, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Directions by iterative quantisation: rotations under which signs fit the sample best. x: unit rows.

    Fewer dimensions than bits have several rotations. The hyperplanes go through the origin, so that the share of differing bits
    follows the angle.
    """
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    if d >= BITS:  # the directions of most variance, rotated
        _, vectors = np.linalg.eigh(x.T @ x)
        return _rotated(x, vectors[:, ::-1][:, :BITS], rounds, rng)
    return np.concatenate([_rotated(x, np.eye(d), rounds, rng) for _ in range(-(-BITS // d))], axis=1)[:, :BITS]


def _rotated(x: np.ndarray, basis: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """The basis under one learnt rotation, from a random start."""
    v, d = x @ basis, basis.shape[1]
    r = np.linalg.qr(rng.standard_normal((d, d)))[0]
    for _ in range(rounds if len(x) else 0):
        u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return basis @ r


def codes_of(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Rows of BITS / 64 words."""
    return np.packbits(x @ directions > 0, axis=1, bitorder="little").view(np.uint64).reshape(len(x), -1)


_RINGS = [np.array([sum(1 << b for b in c) for c in itertools.combinations(range(WIDTH), t)], np.int64) for t in range(DEEPEST + 1)]


class Index:
    """The rows of one shard: codes, their substring tables, and the vectors of which products are asked."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray):
        self.vectors, self.codes = vectors, codes
        self.columns = np.ascontiguousarray(codes.T)
        self.products = 0  # how many were computed
        self._tables: list[tuple[np.ndarray, np.ndarray]] = []
        self._start = 0  # the ring that queries before needed

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each substring the rows in order of its value, and where each value begins."""
        if not self._tables:
            sub = self.codes.view(np.uint16)
            for j in range(SUBSTRINGS):
                value = np.ascontiguousarray(sub[:, j])
                self._tables.append((np.argsort(value, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << WIDTH))])))
        return self._tables

    def probe(self, code: np.ndarray, t: int) -> np.ndarray:
        """Rows that differ in exactly t bits of some substring."""
        found = []
        for (order, start), value in zip(self.tables(), code.view(np.uint16).astype(np.int64)):
            at = _RINGS[t] ^ value
            lo, n = start[at], start[at + 1] - start[at]
            if total := int(n.sum()):
                n_, lo_ = n[n > 0], lo[n > 0]
                found.append(order[np.repeat(lo_ - np.cumsum(n_) + n_, n_) + np.arange(total)])
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def distances(self, code: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        out = 0
        for column, word in zip(self.columns, code):
            out = out + np.bitwise_count((column if rows is None else column[rows]) ^ word).astype(np.int16)
        return out

    def _products(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        self.products += len(rows)
        return np.einsum("ij,j->i", self.vectors[rows], q)

    def search(self, code: np.ndarray, q: np.ndarray, scale: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, products): all that reach the k-th largest product among the codes within a radius that fits it, ties included.

        scale: the query's length times the common length of the rows. Where products tie up to the k-th, all rows are taken, since a
        code of equal product may lie outside any radius.
        """
        n = len(self.codes)
        if n <= k:
            return np.arange(n), self._products(np.arange(n), q)
        seen, t = np.zeros(n, bool), self._start
        for ring in range(t + 1):
            if self._dear(ring):
                break
            seen[self.probe(code, ring)] = True
        known, has = np.zeros(n), np.zeros(n, bool)
        while not self._dear(t):
            rows = np.flatnonzero(seen)
            distance, radius = self.distances(code, rows), SUBSTRINGS * (t + 1) - 1
            rows = rows[distance <= radius]
            if len(rows) >= k:
                new = rows[~has[rows]]
                known[new], has[new] = self._products(new, q), True
                products = known[rows]
                if self.radius(products, scale, k) <= radius:
                    self._start = max(0, t - 1)
                    return self._top(rows, products, q, k)
            t += 1
            if not self._dear(t):
                seen[self.probe(code, t)] = True
        self._start = t
        distance = self.distances(code)
        # the k closest codes tell of a k-th product; what could be nearer is within its radius
        guess = np.argpartition(distance, k)[: 2 * k]
        radius = self.radius(self._products(guess, q), scale, k)
        rows = np.flatnonzero(distance <= max(radius, int(np.partition(distance, k)[k])))
        return self._top(rows, self._products(rows, q), q, k)

    def _dear(self, t: int) -> bool:
        """Probing ring t meets more entries than there are rows."""
        return t > DEEPEST or len(_RINGS[t]) * SUBSTRINGS * len(self.codes) >> WIDTH > len(self.codes)

    def radius(self, products: np.ndarray, scale: float, k: int) -> int:
        kth = np.partition(products, len(products) - k)[len(products) - k]
        p = np.arccos(np.clip(kth / scale, -1, 1)) / np.pi
        return int(np.ceil(BITS * p + MARGIN * np.sqrt(BITS * p * (1 - p))))

    def _top(self, rows: np.ndarray, products: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        best = np.sort(products)[::-1][: k + 1]
        if len(rows) < len(self.codes) and (best[1:] == best[:-1]).any():
            rows = np.arange(len(self.codes))
            products = self._products(rows, q)
        kth = np.partition(products, len(products) - k)[len(products) - k]
        keep = products >= kth
        return rows[keep], products[keep]


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: vectors without null or non-finite components, and not zero."""
    v = F.col("v")
    rows = table.select(table[id_col].cast("long").alias("id"), table[vector_col].cast("array<double>").alias("v"))
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(v.isNotNull() & (F.size(v) > 0)).filter(good)


def packed_vectors(rows: DataFrame) -> DataFrame:
    """id, vector (doubles as bytes, minus zero as zero), vkey, dim. rows: id, v (array<double>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            flat, ends = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0, np.cumsum([len(x) for x in v])
            body, starts = flat.tobytes(), np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([body[8 * a : 8 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())], names=["id", "vector"])

    made = rows.mapInArrow(run, "id long, vector binary")
    return made.select("id", "vector", F.unhex(F.md5("vector")).alias("vkey"), (F.length("vector") / 8).cast("int").alias("dim"))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """vkey, vector, dim and the ``keep`` least ids of each distinct vector: no more can be among the nearest of any query.

    Ids are cut in each task before the shuffle, so a very common vector gathers little in one place.
    """
    order = Window.partitionBy("vkey").orderBy("id")
    least = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)
    return least.groupBy("vkey").agg(F.first("vector").alias("vector"), F.first("dim").alias("dim"), F.array_sort(F.collect_list("id")).alias("ids"))


def nearest(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row whose id is divisible by ``every``, itself excluded.

    Rows with a null id or vector, with null or non-finite components, or all zero take no part. Vectors of different lengths have
    no inner product: each length is searched by itself. Ties go to the smaller id; repeated rows (same id and vector) count
    as one; an id with several vectors is a row for each, and never found by itself. An empty table gives no rows.
    """
    spark = table.sparkSession
    rows = materialize(packed_vectors(usable(table, id_col, vector_col).filter(F.col("id").isNotNull())).dropDuplicates(["id", "vkey"]), "rows")
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).select("id", "vkey", "dim")
    # an id's own rows are found and left out again: as many more are kept
    own = asked.groupBy("id").count().agg(F.max("count")).first()[0] or 1
    vectors = materialize(distinct_vectors(rows, k + own), "vectors")
    found = None
    for row in vectors.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").toLocalIterator():
        part = _search(vectors.filter(F.col("dim") == row["dim"]), asked.filter(F.col("dim") == row["dim"]), row["dim"], row["n"], k, k + own)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def _search(vectors: DataFrame, asked: DataFrame, dim: int, n: int, k: int, keep: int) -> DataFrame:
    """Of the queries among vectors of one length. vectors: vkey, vector, ids; asked: id, vkey."""

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stack(batch.column(0).to_pylist(), dim)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(axis=1)).max())])], names=["m"])

    longest = vectors.select("vector").mapInArrow(norms, "m double").agg(F.max("m")).first()[0]
    # by hash, so that the sample is the same however the table is dealt out; expected SAMPLE rows, and never more than twice as many
    share = min(1.0, SAMPLE / n)
    sample = vectors.filter(F.pmod(F.xxhash64("vkey"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vector").limit(2 * SAMPLE).collect()
    directions = learn_rotation(extend(_stack(sorted(bytes(r.vector) for r in sample), dim), longest))

    fit = max(1, PART_BYTES // (8 * dim))
    shards = -(-n // min(SHARD, fit))
    wanted = materialize(vectors.join(asked.select("vkey").distinct(), "vkey", "left_semi"), "queries")
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-wanted.count() // min(BLOCK, fit)), min(2 * cores // shards, n // 256))
    index = _packed(vectors, shards, "shard").select("shard", "body", "ids")
    grid = _packed(wanted, blocks, "block").select("block", F.col("vkeys").alias("q_keys"), F.col("body").alias("q_body"))
    # every block of the stated queries goes to every shard: units of work of bounded size
    pairs = index.join(grid.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))), "shard").select("body", "ids", "q_keys", "q_body", "shard", "block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, ids, q_keys, q_body, _, _ in zip(*batch.columns):
                x, q = _matrix(body.as_py(), dim), _matrix(q_body.as_py(), dim)
                table = Index(x, codes_of(extend(x, longest), directions))
                codes, norm = codes_of(extend(q, longest, query=True), directions), np.linalg.norm(q, axis=1) * longest
                ids, hits, scores = ids.as_py(), [], []
                for i in range(len(q)):
                    rows, products = table.search(codes[i], q[i], float(norm[i]), keep)
                    flat = sorted((-s, v) for r, s in zip(rows.tolist(), products.tolist()) for v in ids[r])[:keep]
                    hits.append([v for _, v in flat])
                    scores.append([-s for s, _ in flat])
                yield pa.RecordBatch.from_arrays([pa.array(q_keys.as_py(), pa.binary()), pa.array(hits, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], names=["vkey", "hits", "scores"])

    partial = pairs.repartition(max(1, min(shards * blocks, 100_000)), "shard", "block").mapInArrow(work, "vkey binary, hits array<long>, scores array<double>")
    order = F.transform(F.arrays_zip("hits", "scores"), lambda x: F.struct((-x["scores"]).alias("s"), x["hits"].alias("v")))
    best = partial.select("vkey", F.explode(order).alias("b")).select("vkey", "b.s", "b.v")
    cut = best.withColumn("n", F.row_number().over(Window.partitionBy("vkey").orderBy("s", "v"))).filter(F.col("n") <= keep)
    best = cut.groupBy("vkey").agg(F.array_sort(F.collect_list(F.struct("s", "v"))).alias("best"))
    joined = asked.join(best, "vkey")
    ranked = joined.select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda x: x["v"] != F.col("id")), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.v").alias("vec_id"), (-F.col("col.s")).alias("score"))


def _packed(vectors: DataFrame, parts: int, name: str) -> DataFrame:
    """Rows dealt evenly into so many parts, each one row: vkeys, body (the vectors one after another), ids."""
    part = F.pmod(F.xxhash64("vkey", F.lit(1)), F.lit(parts)).cast("int").alias(name)
    schema = f"{name} int, vkeys array<binary>, body binary, ids array<array<long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [])

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([held[0]], pa.list_(pa.binary())), pa.array([b"".join(held[1])], pa.binary()), pa.array([held[2]], pa.list_(pa.list_(pa.int64())))], names=[name, "vkeys", "body", "ids"])

        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if p != at:
                    if held[0]:
                        yield whole()
                    at, held = p, ([], [], [])
                for column, value in zip(held, row):
                    column.append(value)
        if held[0]:
            yield whole()

    return vectors.select(part, "vkey", "vector", "ids").repartition(min(parts, 100_000), name).sortWithinPartitions(name, "vkey").mapInArrow(run, schema)


def _stack(bodies: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(bodies), np.float64).reshape(-1, dim)


def _matrix(body: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(body, np.float64).reshape(-1, dim)


def extend(x: np.ndarray, longest: float, query: bool = False) -> np.ndarray:
    """Unit rows with one more coordinate: for the index what is missing to the longest row, for a query nothing."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    if query:
        return np.concatenate([x / np.maximum(norm, 1e-300), np.zeros((len(x), 1))], axis=1)
    rest = np.sqrt(np.maximum(0, longest * longest - norm * norm))
    return np.concatenate([x, rest], axis=1) / longest
