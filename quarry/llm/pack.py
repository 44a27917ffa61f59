"""Operator 10: best-fit packing of tokenised documents by linear grouping.

The histogram of piece lengths has at most ``capacity`` entries, however many documents there are, so the whole plan is
made on the driver from counts alone: large lengths are rounded up within groups of equal cardinality, configurations of
the few group sizes are optimised by column generation, actual documents take the rounded places, and the remaining and
the small ones are packed best-fit into what is left. Documents then find their place by their rank among those of the
same length, without any list of documents in one place.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._base import BROADCAST_MB, documents, materialize, memory_mb, text_chunks

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, seq long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class ByteBpe:
    """Ids as the ``tokenizers`` library gives them for a byte-level BPE file, made by the faster ``tiktoken`` from the same vocabulary.

    Special strings inside a text become their ids, as that library does by default.
    """

    def __init__(self, json_path: str):
        import json

        import tiktoken

        from public_tokenizers import PATTERN

        spec = json.load(open(json_path))
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = _byte_alphabet()
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self._special}
        self._special_text = re.compile("|".join(map(re.escape, self._special)) or r"(?!)")
        self._full = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self._special)
        # Without the lookahead, which matters only where two white-space characters meet, the pattern needs no backtracking.
        self._plain = tiktoken.Encoding("byte_bpe_plain", pat_str=PATTERN.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={})
        self._spaces = re.compile(r"\s\s")

    def __call__(self, text: str) -> np.ndarray:
        if not (runs := [m.span() for m in _LONG_GAP.finditer(text)]):
            return self._encode(text)
        # a long gap is one pre-token but for its last character, which goes with what follows: the pattern need not look for its end
        out, done = [], 0
        for lo, hi in runs:
            out.append(self._encode(text[done:lo]))
            done = hi if hi == len(text) or self._special_text.match(text, hi) else hi - 1
            out.append(self._plain.encode_to_numpy(text[lo:done], disallowed_special=()))
        return np.concatenate([*out, self._encode(text[done:])])

    def _encode(self, text: str) -> np.ndarray:
        if self._special_text.search(text):
            return self._full.encode_to_numpy(text, allowed_special="all")
        return (self._full if self._spaces.search(text) else self._plain).encode_to_numpy(text, disallowed_special=())


#: White space that would be too long for the pattern's lookahead, which goes back over it step by step.
_LONG_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@lru_cache(2)
def encoder(json_path: str) -> ByteBpe:
    """Loaded once in each worker, however many tasks it runs."""
    return ByteBpe(json_path)


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: printable ones as themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: longer ones are cut into full pieces, the first takes the remainder."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity
    starts = [0] * bool(first) + list(range(first, total, capacity))
    return [(s, (first if s == 0 and first else capacity)) for s in starts]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document. part and seq number the pieces of one length within a task, for ranks later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        context = TaskContext.get()
        part, seen = context.partitionId() if context else 0, np.zeros(capacity + 1, dtype=np.int64)
        for ids, texts in text_chunks(batches):
            out: list[tuple] = []
            for doc, text in zip(ids, texts):
                tokens = np.append(encode(text).astype("<u4"), np.uint32(0))
                for piece, (start, length) in enumerate(cut(len(tokens), capacity)):
                    out.append((doc, piece, start, length, zlib.crc32(tokens[start : start + length].astype("<u4").tobytes()), part, int(seen[length])))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "seq"])

    return documents(docs).mapInArrow(run, PIECES)


# ---- the plan, on counts ------------------------------------------------------------------------------------------


def configurations(sizes: list[int], demand: list[int], capacity: int, unit: int = 8, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations of a few sizes with their whole multiplicities: column generation for the cutting-stock relaxation.

    Sizes are rounded up to units for the pricing knapsack, so that each configuration fits. Multiplicities are rounded down.
    """
    k, room = len(sizes), capacity // unit
    w = np.array([-(-s // unit) for s in sizes])
    if k == 0 or (w > room).any():
        return []
    basis = np.diag(room // w).astype(float)
    x = np.array(demand, float) / np.diag(basis)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, choice = np.zeros(room + 1), np.full(room + 1, -1)
        for c in range(1, room + 1):
            best[c], choice[c] = best[c - 1], -1
            fit = np.flatnonzero(w <= c)
            if len(fit):
                value = best[c - w[fit]] + price[fit]
                i = int(value.argmax())
                if value[i] > best[c] + 1e-12:
                    best[c], choice[c] = value[i], fit[i]
        if best[room] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), room
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                column[choice[c]] += 1
                c -= w[choice[c]]
        step = np.linalg.solve(basis, column)
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        leave = int(ratio.argmin())
        x = np.maximum(0, x - ratio[leave] * step)
        basis[:, leave], x[leave] = column, ratio[leave]
    return [(basis[:, j].astype(int), int(x[j] + 1e-9)) for j in range(k) if int(x[j] + 1e-9)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 64, large: int | None = None) -> tuple[dict[int, list[tuple[int, int, int, int, int]]], int]:
    """Where the pieces of each length go, and how many sequences there are.

    For a length: (first rank, end rank, first sequence, copies in each, offset of the first) in order of rank.
    """
    large = capacity * 7 // 16 if large is None else large
    places: dict[int, list] = {n: [] for n in histogram}
    taken = dict.fromkeys(histogram, 0)
    runs: list[list] = []  # [sequences, first sequence, filled]
    total = 0

    def put(length: int, n: int, first: int, copies: int, at: int) -> None:
        places[length].append((taken[length], taken[length] + n, first, copies, at))
        taken[length] += n

    if n := histogram.get(capacity):
        put(capacity, n, 0, 1, 0)
        total = n
    order = sorted((n for n in histogram if large < n < capacity), reverse=True)
    count = sum(histogram[n] for n in order)
    if count:
        groups = min(groups, count, len(order))
        ends = [count * (g + 1) // groups for g in range(groups)]
        members: list[list[list[int]]] = [[] for _ in range(groups)]  # of each group: [length, how many], large to small
        g = done = 0
        for n in order:
            left = histogram[n]
            while left:
                while done >= ends[g]:
                    g += 1
                step = min(left, ends[g] - done)
                members[g].append([n, step])
                done, left = done + step, left - step
        sizes = [m[0][0] for m in members]
        for config, times in configurations(sizes, [sum(c for _, c in m) for m in members], capacity):
            slots = [g for g in range(groups) for _ in range(config[g])]
            drawn = []
            for g in slots:  # the next documents of the group take the rounded place; a group may have run short by rounding
                need, mine = times, []
                while need and members[g]:
                    step = min(need, members[g][0][1])
                    mine.append((members[g][0][0], step))
                    members[g][0][1] -= step
                    need -= step
                    if not members[g][0][1]:
                        members[g].pop(0)
                drawn.append(mine)
            borders = sorted({0, times, *(int(e) for mine in drawn for e in np.cumsum([c for _, c in mine]) if e <= times)})
            for lo, hi in zip(borders, borders[1:]):
                filled = 0
                for mine in drawn:
                    at = 0
                    for n, c in mine:
                        if at <= lo < at + c:
                            put(n, hi - lo, total, 1, filled)
                            filled += n
                            break
                        at += c
                runs.append([hi - lo, total, filled])
                total += hi - lo
    free: dict[int, list[list]] = {}
    for run in runs:
        free.setdefault(capacity - run[2], []).append(run)
    rooms = sorted(free)

    def give(run: list) -> None:
        room = capacity - run[2]
        if room not in free:
            bisect.insort(rooms, room)
            free[room] = []
        free[room].append(run)

    for n in sorted(histogram, reverse=True):
        left = histogram[n] - taken[n]
        while left:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                copies = capacity // n
                bins = -(-left // copies)
                give([bins, total, 0])
                total += bins
                continue
            room = rooms[i]
            run = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.pop(i)
            copies = room // n
            bins = min(run[0], left // copies)
            if not bins:  # fewer than fill one sequence
                copies, bins = left, 1
            if bins < run[0]:
                give([run[0] - bins, run[1] + bins, run[2]])
            put(n, bins * copies, run[1], copies, run[2])
            left -= bins * copies
            give([bins, run[1], run[2] + copies * n])
    return places, total


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most capacity tokens; one row for each piece.

    Null text is an empty document of one id; a null doc_id stays null; repeated rows are packed each; an empty table gives none.
    """
    pieces = materialize(tokenize(docs, tokenizer, capacity), "pieces")
    counts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    places, _ = plan(histogram, capacity)
    tables = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for n, rows in places.items() if rows}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranks = F.broadcast(ranks) if memory_mb(counts) <= BROADCAST_MB else ranks.hint("merge")  # on disk they are far smaller than in memory
    ranked = pieces.join(ranks, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("seq")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                lo, _, first, copies, at = tables[int(n)]
                i = np.searchsorted(lo, rank[mine], side="right") - 1
                k = rank[mine] - lo[i]
                sequence[mine] = first[i] + k // copies[i]
                offset[mine] = at[i] + k % copies[i] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PLACED)
