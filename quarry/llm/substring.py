"""Operator 7: exact substring dedup by longest-previous-factor arrays over sampled suffixes.

Every string of LEAST bytes has an anchor: its k-gram of least hash, leftmost (winnowing). Equal strings have equal anchors at
equal places, so each start of a text belongs to the anchor of the string of LEAST bytes that begins there, and only starts whose
anchors' k-grams occur twice can repeat. Starts of one k-gram meet in one group, with the bytes around their anchors.

Within a group, sorting what follows the anchors gives the suffix order and its LCP array. Moving left byte by byte refines
it to the suffix order of the starts at each distance from the anchor. There the previous and the next smaller text positions
give the longest previous factor of each start; a start whose factor reaches LENGTH is a later copy. The LCP with either
neighbour in suffix order tells whether it repeats at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import BROADCAST_MB, broadcast_if_small, documents, materialize, memory_mb

LENGTH = 400
#: The shortest repeated strings that are found; what reaches LENGTH is removed, all are counted.
LEAST = 256
GRAM = 48
#: Anchors of a k-gram that stay together. Those of more frequent ones are parted by what their strings have in common, and starts
#: that still meet too many others are compared by digests of their strings, which need no common place.
GROUP = 500
#: Starts of so many neighbouring distances from an anchor of a frequent k-gram go together.
RANGE = 32
#: Rows that are solved together, and bytes of a long text whose anchors are found at a time.
ROWS, BLOCK = 5_000, 1 << 19
#: Classes of very common strings that each task looks up for itself.
HELD = 200_000


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit polynomial hashes of all grams, mixed. Prefix sums of bytes times powers of an odd base, which has an inverse."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], dtype=np.uint64)])
    h = (total[gram:] - total[:-gram]) * inverse[:n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


_BASE = 0x5851F42D4C957F2D
_held: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_held.get("p", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _held[name] = np.cumprod(x, dtype=np.uint64)
    return _held["p"], _held["i"]


#: The low bits of a key hold the place, so that the least key is the leftmost least hash. The top bit marks periodic grams.
_PLACE, _PERIODIC = np.uint64((1 << 28) - 1), np.uint64(1 << 63)
PERIOD = GRAM // 2


def runs_of_period(data: np.ndarray, gram: int, most: int = PERIOD) -> list[tuple[int, int, int]]:
    """(begin, end, period) of the maximal stretches that repeat themselves at a distance of at most ``most`` bytes, of a gram's length at least.

    A sample of every fourth byte tells first whether there can be any.
    """
    out = []
    for p in range(1, min(most, gram // 2) + 1):
        if len(data) < gram:
            break
        some = data[:-p:4] == data[p::4]
        need = max(1, (gram - p) // 4)  # so many neighbours of the sample fall into any such stretch
        if need > 1:
            width = 1
            while width * 2 <= need and len(some) > width:
                some = some[:-width] & some[width:]
                width *= 2
            if width < need and len(some) > need - width:
                some = some[: -(need - width)] & some[need - width :]
        if not some.any():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (data[:-p] == data[p:]).astype(np.int8), [0]])))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if hi - lo + p >= gram:
                out.append((lo, hi + p, p))
    return out


def anchors(data: np.ndarray, length: int = LENGTH, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(anchor, its hash, first and end start that belong to it) of the strings of ``least`` bytes, and long periodic stretches.

    A gram with a short period of its own comes after all others, so it is chosen only within long periodic stretches. There only the
    strings of the first period have anchors: those after it repeat them, which the stretch itself says.
    """
    if len(data) > 2 * BLOCK:  # in blocks that share a string but for its first byte, so no start is missed
        parts = [(i, anchors(data[i : i + BLOCK + least - 1], length, least, gram)) for i in range(0, len(data), BLOCK)]
        columns = [np.concatenate([p[c] + (0 if c == 1 else i) for i, p in parts]) for c in range(4)]
        return columns[0], columns[1].view(np.uint64), columns[2], columns[3], [(a + i, b + i, p) for i, part in parts for a, b, p in part[4]]
    h = gram_hashes(data, gram)
    w = least - gram + 1
    n = len(h) - w + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, h[:0], none, none, []
    stretches = runs_of_period(data, gram)
    rows = -(-len(h) // w)
    keys = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    keys[: len(h)] = ((h >> np.uint64(1)) & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    for lo, hi, _ in stretches:
        keys[lo : hi - gram + 1] |= _PERIODIC
    grid = keys.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    place = (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & _PLACE).astype(np.int64)
    long = [(lo, hi, p) for lo, hi, p in stretches if hi - lo >= least + p]
    for lo, hi, p in long:
        if hi - lo >= length + p:
            place[lo + p : hi - length + 1] = -1
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    end = np.append(first[1:], n)
    told = place[first] >= 0
    first, end = first[told], end[told]
    return place[first], h[place[first]], first, end, long


ANCHORS = "gram long, digest binary, at int, first int, end int, period int"
CONTEXTS = "grp binary, kind int, rank long, digest binary, at int, lo int, hi int, lft binary, rgt binary"
STRINGS = "cls binary, kind int, rank long, digest binary, start int"
FLAGGED = "digest binary, begin int, end int, kind int"
#: What a span says: it repeats over LENGTH, it does so after an earlier place, it repeats over LEAST. EITHER: a row for all of them.
REMOVED, LATER, SHORT, EITHER = 0, 1, 2, 3
#: Ranks a text without an id after all others.
LAST = 1 << 62


def _batch(rows: list[tuple], kinds: tuple, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in names.split(", ")])


def find_anchors(texts: DataFrame, length: int, least: int, gram: int) -> DataFrame:
    """A row for each anchor of each text, and one without gram for each long periodic stretch. texts: digest, body (binary)."""
    kinds = (pa.int64(), pa.binary(), *(pa.int32(),) * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for digest, body in zip(batch.column(0), batch.column(1)):
                body = body.as_py()
                if len(body) < least:
                    continue
                places, h, first, end, long = anchors(np.frombuffer(body, np.uint8), length, least, gram)
                key, none = digest.as_py(), [None] * len(long)
                for column, values in zip(rows, (h.view(np.int64).tolist() + none, [key] * (len(places) + len(long)), places.tolist() + none, first.tolist() + [x[0] for x in long], end.tolist() + [x[1] for x in long], [None] * len(places) + [x[2] for x in long])):
                    column += values
                if len(rows[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=[c.split()[0] for c in ANCHORS.split(", ")])
                    rows = [[], [], [], [], [], []]
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=[c.split()[0] for c in ANCHORS.split(", ")])

    return texts.mapInArrow(run, ANCHORS)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def contexts(texts: DataFrame, length: int, least: int) -> DataFrame:
    """The surroundings of repeated anchors. texts: digest, rank, body, found (array of (at, gram, first, end, hot); at is null where
    a periodic stretch tells that the starts repeat).

    A string of ``length`` can repeat only where all strings of ``least`` in it do, so other starts need no longer surroundings.
    Starts lo <= a < hi to the left of an anchor are to be judged. Those of a frequent k-gram come in ranges, each in a group
    of those that share what all strings of the range have in common, so such a group falls apart.
    """
    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def rows_of(digest: bytes, rank: int, body: bytes, found: list[dict]) -> Iterator[tuple]:
        open_ = np.zeros(max(0, len(body) - least + 1) + 1, np.int64)
        for a in found:
            open_[a["first"] : a["end"]] = 1
        whole = np.concatenate([[0], np.cumsum(open_)])
        long = np.zeros(len(open_), bool)
        n = len(body) - length + 1
        if n > 0:
            long[:n] = whole[length - least + 1 : length - least + 1 + n] - whole[:n] == length - least + 1
        for a in found:
            at = a["at"]
            if at is None:
                continue
            gram = a["gram"].to_bytes(8, "little", signed=True)
            lo, hi = at - a["end"] + 1, at - a["first"] + 1  # distances of the starts from the anchor
            wanted = np.flatnonzero(long[a["first"] : a["end"]])
            if not a["hot"]:
                reach = length if len(wanted) else least
                yield gram, EITHER, rank, digest, at, lo, hi, body[at - hi + 1 : at], body[at : at - lo + reach]
                continue
            spans = [(SHORT, least, lo, hi)]
            if len(wanted):
                spans.append((REMOVED, length, at - a["first"] - int(wanted[-1]), at - a["first"] - int(wanted[0]) + 1))
            for kind, size, low, high in spans:
                for begin in range(low - low % RANGE, high, RANGE):
                    # what all strings that start at these distances contain, the same for every text, however it cuts the range
                    core = body[max(0, at - begin) : at - begin - RANGE + 1 + size] if at >= begin else b""
                    group = gram + bytes((kind, begin // RANGE)) + xxhash.xxh3_128_digest(core)
                    x, y = max(low, begin), min(high, begin + RANGE)
                    yield group, kind, rank, digest, at, x, y, body[at - y + 1 : at], body[at : at - x + size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for digest, rank, body, found in zip(*batch.columns):
                for row in rows_of(digest.as_py(), rank.as_py(), body.as_py(), found.as_py()):
                    out.append(row)
                    if len(out) >= 2000:
                        yield _batch(out, kinds, CONTEXTS)
                        out = []
        if out:
            yield _batch(out, kinds, CONTEXTS)

    return texts.mapInArrow(run, CONTEXTS)


def smaller_before(position: np.ndarray, lcp: np.ndarray, longest: int) -> np.ndarray:
    """For each suffix, the LCP with the nearest one before it in suffix order that stands earlier in the text; -1 without one.

    lcp: with the suffix before, -1 where a class begins. longest: the size of the largest class. All at once: least positions and
    LCPs over powers of two, then a descent over them.
    """
    n = len(position)
    levels = max(1, int(longest).bit_length())
    least, low = [position], [lcp]
    for k in range(levels - 1):
        step = 1 << k
        p, m = least[-1].copy(), low[-1].copy()
        np.minimum(p[step:], least[-1][:-step], out=p[step:])
        np.minimum(m[step:], low[-1][:-step], out=m[step:])
        m[:step], p[:step] = -1, -1  # reaches over the beginning
        least.append(p)
        low.append(m)
    at, reached = np.arange(n) - 1, lcp.copy()
    for k in range(levels - 1, -1, -1):
        safe = np.maximum(at, 0)
        skip = (at >= 0) & (reached >= 0) & (least[k][safe] > position)
        reached = np.where(skip, np.minimum(reached, low[k][safe]), reached)
        at = np.where(skip, at - (1 << k), at)
    ok = (at >= 0) & (reached >= 0)
    ok[ok] = position[at[ok]] < position[ok]
    return np.where(ok, reached, -1)


def previous_factors(position: np.ndarray, lcp: np.ndarray, longest: int) -> np.ndarray:
    """LPF: the larger of the LCPs with the previous and the next smaller text position in suffix order; -1 without one."""
    back = np.concatenate([lcp[1:], [-1]])[::-1]
    return np.maximum(smaller_before(position, lcp, longest), smaller_before(position[::-1], back, longest)[::-1])


def judge(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, lefts: list[bytes], rights: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each distance a < hi of a start from its anchor: the longest match with any other place, and with an earlier
    one (the longest previous factor); 0 without one. Rows come in order of their position in the corpus.

    Matches are cut where a row's bytes end, which is where they say all that is asked.
    """
    n, reach, depth = len(group), int(hi.max()), max(map(len, rights))
    right, size = np.zeros((n, depth), np.uint8), np.array([len(r) for r in rights])
    left = np.full((n, reach), 256, np.int16)
    for i, (b, r) in enumerate(zip(lefts, rights)):
        right[i, : len(r)] = np.frombuffer(r, np.uint8)
        if b:
            left[i, : len(b)] = np.frombuffer(b, np.uint8)[::-1]
    # the suffix order at the anchors: by group, bytes that follow, then size, so that a suffix comes after its own prefixes
    keyed = np.concatenate([group.astype(">u8").view(np.uint8).reshape(n, 8), right, size.astype(">u8").view(np.uint8).reshape(n, 8)], axis=1)
    rows = np.argsort(np.ascontiguousarray(keyed).view(f"V{keyed.shape[1]}").ravel(), kind="stable")
    name, held = np.unique(group[rows], return_inverse=True)[1], np.zeros(n, np.int64)
    nearest, factor = np.zeros(n, np.int64), np.zeros(n, np.int64)
    matched, previous = np.zeros((n, reach), np.int16), np.zeros((n, reach), np.int16)
    for a in range(reach):
        if a:
            stay = hi[rows] > a
            rows, name, held, nearest, factor = rows[stay], name[stay], held[stay], nearest[stay], factor[stay]
            if not len(rows):
                break
            name = np.unique(name * 512 + left[rows, a - 1], return_inverse=True)[1]
            if (name[1:] < name[:-1]).any():
                order = np.argsort(name, kind="stable")
                rows, name, held, nearest, factor = rows[order], name[order], held[order], nearest[order], factor[order]
        count = np.bincount(name)
        stay = count[name] > 1  # what shares its left bytes with nothing has no matches further to the left
        if not stay.any():
            break
        rows, name, held, nearest, factor = rows[stay], name[stay], held[stay], nearest[stay], factor[stay]
        new = count[name] != held  # the suffix order of a class changes only where it loses rows
        if new.any():
            mine, of = rows[new], name[new]
            lcp = np.full(len(mine), -1, np.int64)
            inside = np.flatnonzero(of[1:] == of[:-1]) + 1
            x, y = mine[inside], mine[inside - 1]
            differ = right[x] != right[y]
            lcp[inside] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), depth), np.minimum(size[x], size[y]))
            nearest[new] = np.maximum(lcp, np.append(lcp[1:], -1))
            factor[new] = previous_factors(mine, lcp, int(count.max()))
            held[new] = count[name[new]]
        use = lo[rows] <= a
        matched[rows[use], a] = nearest[use] + a
        previous[rows[use], a] = np.where(factor[use] >= 0, factor[use] + a, 0)
    return matched, previous


def flagged(rows: DataFrame, length: int, least: int) -> DataFrame:
    """Covered ranges of each text: unions of strings of one kind."""

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        names: dict[bytes, int] = {}
        group = np.array([names.setdefault(r[0], len(names)) for r in held], np.int64)
        lo, hi = (np.array([r[i] for r in held], np.int64) for i in (5, 6))
        matched, previous = judge(group, lo, hi, [r[7] for r in held], [r[8] for r in held])
        kinds, out = np.array([r[1] for r in held]), []
        for kind, found, size in ((REMOVED, matched, length), (LATER, previous, length), (SHORT, matched, least)):
            asked = (kinds == EITHER) | (kinds == (SHORT if kind == SHORT else REMOVED))
            flags = np.pad((found >= size) & asked[:, None], ((0, 0), (1, 1))).astype(np.int8)
            edges = np.diff(flags, axis=1)
            # the strings that start at the distances x <= a < y, both ends of each run in order of rows
            for (i, x), (_, y) in zip(np.argwhere(edges == 1).tolist(), np.argwhere(edges == -1).tolist()):
                at = held[i][4]
                out.append((held[i][3], at - y + 1, at - x + size, kind))
        if out:
            yield _batch(out, (pa.binary(), pa.int32(), pa.int32(), pa.int32()), FLAGGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:6] == held[-1][:6]:
                    continue  # the same place of the same text, from a repeated row
                if len(held) >= ROWS and row[0] != held[-1][0]:
                    yield from solve(held)
                    held = []
                held.append(row)
        if held:
            yield from solve(held)

    return rows.repartition("grp").sortWithinPartitions("grp", "rank", "digest", "at", "lo").mapInArrow(run, FLAGGED)


def starts_of(row: tuple, length: int, least: int) -> Iterator[tuple[bytes, int]]:
    """(digest of the string, its start) for each single start of a context row."""
    _, kind, _, _, at, lo, hi, lft, rgt = row
    around, size = lft + rgt, least if kind == SHORT else length
    for a in range(hi - 1, lo - 1, -1):  # in order of the text
        begin = len(lft) - a
        if begin + size <= len(around):
            yield xxhash.xxh3_128_digest(around[begin : begin + size]), at - a


def strings(rows: DataFrame, length: int, least: int) -> DataFrame:
    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(cls, row[1], row[2], row[3], start) for row in zip(*(c.to_pylist() for c in batch.columns)) for cls, start in starts_of(row, length, least)]
            if out:
                yield _batch(out, kinds, STRINGS)

    return rows.mapInArrow(run, STRINGS)


def string_classes(rows: DataFrame, length: int, least: int) -> DataFrame:
    """The classes of equal strings with two places at least: cls, kind, and the first place. Equal strings are combined in each batch,
    so a very common one gives few rows.
    """
    kinds = (pa.binary(), pa.int32(), *(pa.int64(), pa.binary(), pa.int32()) * 2)
    schema = "cls binary, kind int, rank long, digest binary, start int, rank2 long, digest2 binary, start2 int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, int], list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for cls, start in starts_of(row, length, least):
                    place = (row[2], row[3], start)
                    ends = held.setdefault((cls, row[1]), [place, place])
                    ends[0], ends[1] = min(ends[0], place), max(ends[1], place)
            if len(held) > 50_000:
                yield _batch([(*key, *first, *last) for key, (first, last) in held.items()], kinds, schema)
                held = {}
        if held:
            yield _batch([(*key, *first, *last) for key, (first, last) in held.items()], kinds, schema)

    first, last = F.struct("rank", "digest", "start"), F.struct(F.col("rank2").alias("rank"), F.col("digest2").alias("digest"), F.col("start2").alias("start"))
    both = rows.mapInArrow(run, schema).groupBy("cls", "kind").agg(F.min(first).alias("leader"), F.max(last).alias("last"))
    return both.filter(F.col("leader") != F.col("last")).select("cls", "kind", F.col("leader.digest").alias("first_text"), F.col("leader.start").alias("first_start"))


def flagged_strings(rows: DataFrame, length: int, least: int) -> DataFrame:
    """What flagged() gives, for groups of any size: classes of equal strings are counted, never held together.

    In the suffix order of whole strings a class is a run of equal ones, and the previous factor of all but the first in the text is
    the whole string. So many classes as HELD are looked up by each task, which gives a row for each run of starts; more are joined.
    """
    classes = materialize(string_classes(rows, length, least), "classes")
    if classes.limit(HELD + 1).count() <= HELD:
        known = rows.sparkSession.sparkContext.broadcast({(bytes(r.cls), r.kind): bytes(r.first_text) + r.first_start.to_bytes(4, "little") for r in classes.collect()})  # HELD rows at most

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaders = known.value
            for batch in batches:
                out: list[list] = []
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    kind, digest, size, last = row[1], row[3], least if row[1] == SHORT else length, {}
                    for cls, start in starts_of(row, length, least):
                        leader = leaders.get((cls, kind))
                        if leader is None:
                            continue
                        for what in (kind, LATER) if kind == REMOVED and leader != digest + start.to_bytes(4, "little") else (kind,):
                            if what in last and last[what][2] - size >= start - 1:
                                last[what][2] = start + size
                            else:
                                last[what] = [digest, start, start + size, what]
                                out.append(last[what])
                if out:
                    yield _batch(out, (pa.binary(), pa.int32(), pa.int32(), pa.int32()), FLAGGED)

        return rows.mapInArrow(look_up, FLAGGED)
    found = strings(rows, length, least).join(classes, ["cls", "kind"])
    end = F.col("start") + F.when(F.col("kind") == SHORT, least).otherwise(length)
    every = found.select("digest", F.col("start").alias("begin"), end.alias("end"), "kind")
    first = (F.col("digest") == F.col("first_text")) & (F.col("start") == F.col("first_start"))
    later = found.filter((F.col("kind") == REMOVED) & ~first).select("digest", F.col("start").alias("begin"), end.alias("end"), F.lit(LATER).alias("kind"))
    return every.unionByName(later)


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed string, n_later long, n_repeated long"


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, least: int | None = None) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, digest of the rest, and the runs as start:end of bytes.

    keep_first=False removes every string of ``length`` that repeats anywhere; True only later copies, by the longest previous factor in
    order of the least doc_id of a text. n_later counts the bytes of later copies either way, n_repeated those in any string
    of ``least`` bytes (LEAST, where length allows) that stands elsewhere, too.

    A null text counts as empty; a null doc_id stays null and comes last; repeated rows are copies of each other; an
    empty table gives none.
    """
    least = min(length, LEAST) if least is None else least
    own = documents(docs).select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    own = own.withColumn("digest", F.unhex(F.md5("body")))
    # equal texts count once, by the least id: of two copies all strings repeat, so only one of them is searched
    rank = F.coalesce(F.col("doc_id"), F.lit(LAST))
    groups = materialize(own.filter(F.length("body") >= least).select("digest", rank.alias("rank")).groupBy("digest").agg(F.min("rank").alias("rank"), F.count("*").alias("copies")), "texts")
    copied = materialize(groups.filter("copies > 1").select(F.col("digest").alias("_copy"), F.col("rank").alias("_first")), "copied")
    alone = own.join(broadcast_if_small(copied), F.col("digest") == F.col("_copy"), "left").filter(F.col("_copy").isNull() | (rank == F.col("_first")))
    every = materialize(find_anchors(alone.select("digest", "body"), length, least, gram), "anchors")
    found = every.filter("gram IS NOT NULL")
    stretches = every.filter("gram IS NULL").select("digest", "first", "end", "period").distinct()
    place = F.struct("digest", "at")
    frequent = found.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).filter(F.col("a") != F.col("b")).select("gram", (F.col("n") > GROUP).alias("hot"))
    frequent = broadcast_if_small(materialize(frequent, "frequent"))
    # a stretch tells that the starts after its first period repeat
    told = stretches.filter(F.col("end") - F.col("first") >= length + F.col("period")).select("digest", F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("gram"), (F.col("first") + F.col("period")).alias("first"), (F.col("end") - F.lit(length - 1)).alias("end"), F.lit(False).alias("hot")).alias("x"))
    repeated = found.join(frequent, "gram").select("digest", F.struct("at", "gram", "first", "end", "hot").alias("x"))
    wanted = repeated.unionByName(told).groupBy("digest").agg(F.collect_set("x").alias("found")).join(groups.select("digest", "rank"), "digest")
    searched = alone.select(F.col("digest").alias("_digest"), rank.alias("_rank"), "body").join(wanted, (F.col("_digest") == F.col("digest")) & (F.col("_rank") == F.col("rank")))
    around = materialize(contexts(searched.select("digest", "rank", "body", "found"), length, least), "contexts")
    # of a frequent k-gram's groups, those that are still too large for one place
    large = materialize(around.filter(F.col("kind") != EITHER).groupBy("grp").count().filter(F.col("count") > GROUP).select("grp"), "large")
    spans = flagged(around.join(broadcast_if_small(large), "grp", "left_anti"), length, least)
    if large.take(1):
        spans = spans.unionByName(flagged_strings(around.filter(F.col("kind") != EITHER).join(broadcast_if_small(large), "grp", "left_semi"), length, least))
    # the strings of a periodic stretch repeat within it; those of its first period are its earliest
    size = F.col("end") - F.col("first") - F.col("period")
    reaches = size >= length
    within = F.array(
        F.when(reaches, F.struct("first", "end", F.lit(REMOVED).alias("kind"))),
        F.when(reaches, F.struct((F.col("first") + F.col("period")).alias("first"), "end", F.lit(LATER).alias("kind"))),
        F.struct("first", "end", F.lit(SHORT).alias("kind")),
    )
    periodic = stretches.select("digest", F.explode(within).alias("s")).filter("s IS NOT NULL").select("digest", F.col("s.first").alias("begin"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"))
    merged = united(spans.unionByName(periodic)).groupBy("digest").agg(F.collect_list(F.struct("begin", "end", "kind")).alias("spans"))
    known = materialize(groups.join(merged, "digest", "left").filter("copies > 1 OR spans IS NOT NULL"), "spans")
    small = memory_mb(known) <= BROADCAST_MB
    known = known.select(F.col("digest").alias("_digest"), "rank", "copies", "spans")
    joined = own.join(F.broadcast(known) if small else known, own["digest"] == F.col("_digest"), "left").select("doc_id", "body", "rank", "copies", "spans")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cover(size: int, spans: list[dict], kind: int, whole: bool) -> np.ndarray:
            edge = np.zeros(size + 1, np.int32)
            for s in spans:
                if s["kind"] == kind:
                    edge[s["begin"]] += 1
                    edge[s["end"]] -= 1
            return (np.cumsum(edge[:-1]) > 0) | whole

        kinds = (pa.int64(),) * 4 + (pa.string(), pa.string()) + (pa.int64(),) * 2
        for batch in batches:
            out = []
            for doc, body, rank, copies, spans in zip(*(c.to_pylist() for c in batch.columns)):
                n, spans, copied = len(body), spans or [], copies is not None and copies > 1
                # a copied text repeats as a whole, if a string of the length asked fits into it
                later = cover(n, spans, LATER, copied and n >= length and doc != rank)
                gone = later if keep_first else cover(n, spans, REMOVED, copied and n >= length)
                short = cover(n, spans, SHORT, copied and n >= least)
                kept, at, parts = hashlib.sha256(), 0, _runs(gone)
                for a, b in parts:
                    kept.update(body[at:a])
                    at = b
                kept.update(body[at:])
                out.append((doc, n, int(gone.sum()), len(parts), kept.hexdigest(), ",".join(f"{a}:{b}" for a, b in parts), int(later.sum()), int(short.sum())))
            if out:
                yield _batch(out, kinds, REPORT)

    return joined.mapInArrow(report, REPORT)


def united(spans: DataFrame) -> DataFrame:
    """Spans of each kind with those that overlap as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32())
        for batch in batches:
            out = []
            for digest, begin, end, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0] == digest and held[3] == kind and begin <= held[2]:
                    held[2] = max(held[2], end)
                else:
                    if held:
                        out.append(tuple(held))
                    held = [digest, begin, end, kind]
            if out:
                yield _batch(out, kinds, FLAGGED)
        if held:
            yield _batch([tuple(held)], kinds, FLAGGED)

    return spans.select("digest", "begin", "end", "kind").repartition("digest").sortWithinPartitions("digest", "kind", "begin").mapInArrow(run, FLAGGED)
