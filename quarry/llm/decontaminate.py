"""Operator 2: benchmark decontamination by latent semantic retrieval.

Passages are blocks of words as TF-IDF rows over hashed terms. One pass over all documents sums, for each task, document
frequencies and the sketch T'(T omega) of the count matrix T; the weights are applied to the sketch afterwards, and the
Nystroem form of the randomised SVD turns it into term vectors in the latent space. A second pass projects overlapping windows, takes
those with a high cosine to a window of a benchmark item, and holds the text around them against the item by longest common
subsequence of words, with a check that the item's answer is there, too.

A weight is (1 + log of the term frequency) times (1 + log of the inverse document frequency). Before the subsequences are computed,
a signature of the words around a window bounds them from above: what it rejects could not have matched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import documents, few_parts, materialize, text_chunks, tree_sum

TERMS = 1 << 14
SKETCH = 64
BLOCK = 20
#: Words from one window of an item to the next.
STEP = 10
#: Candidates have this cosine at least; matches this share of the item's words in order, or the lower share with the answer.
COSINE, WHOLE, WITH_ANSWER = 0.25, 0.55, 0.5
ANSWER_WORDS = 8
#: Bits of the signature of a block's words.
MARKS = 2048
#: Benchmark text that a task holds at a time; a larger benchmark is dealt into parts, which one scan of the documents meets in turn.
ITEMS_MB = 8
SLICES = 64
MATCHES = "doc_id long, item_id long, cosine double, lcs double, answer_found boolean, first_word long, last_word long"

_BASE = 0x5851F42D4C957F2D
_held: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_held.get("p", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _held[name] = np.cumprod(x, dtype=np.uint64)
    return _held["p"], _held["i"]


_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of the lower-cased texts, where each text's words end). Punctuation separates words."""
    bodies = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([b"", *bodies, b""]), np.uint8)
    solid = _WORD[data]
    edge = np.diff(solid.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    powers, inverse = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], dtype=np.uint64)])
    h = (total[ends] - total[starts]) * inverse[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    limits = np.cumsum([len(b) + 1 for b in bodies])
    return h, np.searchsorted(starts, limits)


def terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TERMS.bit_length() + 1)).astype(np.int64)


def blocks(h: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of so many words; a document's last may be shorter. (first word, document) of each, then its terms: (block, term,
    weight) of each entry and where a block's entries begin. The weight is 1 + log of the term frequency, so that a word that is repeated
    over and over doesn't outweigh all others.
    """
    begins = np.concatenate([[0], ends[:-1]])
    n = -(-(ends - begins) // size)
    doc = np.repeat(np.arange(len(ends)), n)
    first = begins[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * size
    return (first, doc, *entries(h, first, np.append(first[1:], len(h)) if len(first) else first))


def entries(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, weight) of each term of the passages h[first:end], and where a passage's entries begin."""
    n = end - first
    of = np.repeat(np.arange(len(first)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    entry = np.sort(of * TERMS + terms(h[at]))
    begin = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.zeros(0, np.int64)
    tf = np.diff(np.append(begin, len(entry)))
    entry = entry[begin]
    return entry // TERMS, entry % TERMS, _damped(tf), np.searchsorted(entry, np.arange(len(first)) * TERMS)


def _damped(tf: np.ndarray) -> np.ndarray:
    weight = np.ones(len(tf), np.float32)
    more = np.flatnonzero(tf > 1)
    weight[more] += np.log(tf[more]).astype(np.float32)
    return weight


def segment_sums(rows: np.ndarray, index: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """rows[:, index] times weight, summed over the segments that begin at starts; row by row, so that each stays in the cache."""
    out = np.empty((len(rows), len(starts)), rows.dtype)
    for row, into in zip(rows, out):
        part = row.take(index)
        part *= weight
        np.add.reduceat(part, starts, out=into)
    return out


def omega() -> np.ndarray:
    """The test matrix, a row for each column of the sketch: sums over segments run along rows."""
    if "omega" not in _held:
        _held["omega"] = np.random.default_rng(7).standard_normal((SKETCH, TERMS)).astype(np.float32)
    return _held["omega"]


def sketch(docs: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(passages, document frequency, T'(T omega)) over all passages of all documents, summed in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, z, df, passages = omega(), np.zeros((SKETCH, TERMS), np.float32), np.zeros(TERMS, np.int64), 0
        for _, texts in text_chunks(batches, 1_000_000):
            h, ends = words(texts)
            if not len(h):
                continue
            first, _, block, term, weight, starts = blocks(h, ends, 2 * BLOCK)
            y = segment_sums(test, term, weight, starts)
            order = np.argsort(term.astype(np.uint16), kind="stable")
            t = term[order]
            at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            z[:, t[at]] += segment_sums(y, block[order], weight[order], at)
            df += np.bincount(term, minlength=TERMS)
            passages += len(first)
        if not passages:
            return
        zs, dfs = np.ascontiguousarray(z.T).reshape(SLICES, -1), df.reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([passages] * SLICES, pa.int64()), pa.array([x.tobytes() for x in dfs], pa.binary()), pa.array([x.tobytes() for x in zs], pa.binary())], names=["slice", "passages", "df", "z"])

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for frame in frames:
            for r in frame.itertuples(index=False):
                held = sums.setdefault(r.slice, [0, 0, 0])
                held[0] += r.passages
                held[1] = held[1] + np.frombuffer(r.df, np.int64)
                held[2] = held[2] + np.frombuffer(r.z, np.float32).astype(np.float64)
        if sums:
            yield pd.DataFrame([(k, n, a.tobytes(), b.astype(np.float32).tobytes()) for k, (n, a, b) in sums.items()], columns=["slice", "passages", "df", "z"])

    schema = "slice int, passages long, df binary, z binary"
    rows = tree_sum(few_parts(documents(docs)).mapInArrow(run, schema), ["slice"], add).collect()  # TERMS x SKETCH floats in all
    df, z, n = np.zeros((SLICES, TERMS // SLICES), np.int64), np.zeros((SLICES, TERMS // SLICES * SKETCH), np.float32), 0
    for r in rows:
        n, df[r.slice], z[r.slice] = r.passages, np.frombuffer(bytes(r.df), np.int64), np.frombuffer(bytes(r.z), np.float32)
    return n, df.reshape(-1), z.reshape(TERMS, SKETCH)


def latent(n: int, df: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Weighted term vectors as columns: a passage's latent coordinates, scaled towards equal variance, are the sum over its terms.

    With A = T diag(idf), diag(idf) z is A'A times the test matrix omega / idf; Nystroem gives the leading right singular vectors.
    """
    idf = 1 + np.log((n + 1) / (df + 1))
    test = omega().T.astype(np.float64) / idf[:, None]
    y = z.astype(np.float64) * idf[:, None]
    shift = 1e-7 * (np.linalg.norm(y) + 1e-9)
    y += shift * test
    core = test.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values[-1] * 1e-10
    u, s, _ = np.linalg.svd(y @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    s = np.sqrt(np.maximum(0, s * s - shift))
    real = s > 1e-3 * s[0]  # a corpus of few passages has no more directions than that
    u, s = u[:, real], s[real]
    # damped by the median, so that directions of little variance, which tell near copies apart, aren't blown up
    s = np.sqrt(s * s + np.median(s) ** 2) if len(s) else s
    return np.ascontiguousarray((idf[:, None] * u / s).T.astype(np.float32))


def project(h: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(unit vectors, first word, document) of windows of two blocks, one beginning at each block, and the signatures of all blocks with
    their documents; a short document is one window.
    """
    if not len(h):
        none = np.zeros(0, np.int64)
        return np.zeros((0, len(table)), np.float32), none, none, (np.zeros((0, MARKS // 64), np.uint64), none, none)
    first, doc, of, term, weight, starts = blocks(h, ends, BLOCK)
    x = np.ascontiguousarray(segment_sums(table, term, weight, starts).T)
    more = np.concatenate([doc[1:] == doc[:-1], [False]])
    lone = ~more & np.concatenate([[True], doc[1:] != doc[:-1]])
    windows = x.copy()
    windows[more] += x[1:][more[:-1]]
    use = more | lone
    return unit(windows[use]), first[use], doc[use], (signatures(term, of, len(first)), doc, np.flatnonzero(use))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def probe(h: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, item) of the windows of items: two blocks of words, one beginning every STEP words, so that wherever the blocks of
    a document fall in a copy of the item, some window of the item holds nearly the same words.
    """
    first, end, of = [], [], []
    for i, e in enumerate(ends.tolist()):
        b = int(ends[i - 1]) if i else 0
        for at in range(b, max(b + 1, e - 2 * BLOCK + STEP), STEP):
            first.append(at)
            end.append(min(e, at + 2 * BLOCK))
            of.append(i)
    if not first or not len(h):
        return np.zeros((0, len(table)), np.float32), np.zeros(0, np.int64)
    first, end, of = (np.array(x, np.int64) for x in (first, end, of))
    full = end > first
    first, end, of = first[full], end[full], of[full]
    _, term, weight, starts = entries(h, first, end)
    return unit(np.ascontiguousarray(segment_sums(table, term, weight, starts).T)), of


def signatures(term: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """A bit for each term of each of n passages."""
    marks = np.zeros((n, MARKS), np.uint8)
    marks[of, term % MARKS] = 1
    return np.packbits(marks, axis=1).view(np.uint64)


def folded(marks: np.ndarray) -> np.ndarray:
    """A quarter of the bits, each set where one of four is: an item's folded bits that a text lacks are at most those that it lacks."""
    return np.bitwise_or.reduce(marks.reshape(len(marks), 4, -1), axis=1)


class Item:
    """A benchmark item: bit masks of its words for bit-parallel longest common subsequences."""

    def __init__(self, key: int, h: np.ndarray, answer: np.ndarray):
        self.key, self.size = key, len(h)
        self.masks: dict[int, int] = {}
        for i, w in enumerate(h.tolist()):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        self.words = np.unique(h)
        self.answer = Item(key, answer, answer[:0]) if len(answer) else None

    def common(self, text: list[int]) -> int:
        """Length of the longest common subsequence with the item."""
        full = (1 << self.size) - 1
        v = full
        for w in text:
            if m := self.masks.get(w):
                u = v & m
                v = (v + u | v - u) & full
        return self.size - v.bit_count()

    def best(self, h: np.ndarray, lo: int, hi: int) -> tuple[float, bool, int, int]:
        """(share of the item's words in order, answer found, first and end word) in the span of h[lo:hi] that holds most of its words."""
        region = h[lo:hi]
        span = min(len(region), self.size + self.size // 4 + 2)
        at = np.searchsorted(self.words, region)
        at[at == len(self.words)] = 0
        hits = np.concatenate([[0], np.cumsum(self.words[at] == region)])
        held = hits[span:] - hits[: len(region) - span + 1]
        at = int(held.argmax())
        if held[at] < WITH_ANSWER * self.size:  # no longer common subsequence than that
            return 0.0, False, lo + at, lo + at + span
        text = region[at : at + span].tolist()
        share = self.common(text) / self.size
        answer = self.answer is not None and share >= WITH_ANSWER and self.answer.common(text) >= 0.75 * self.answer.size
        return share, answer, lo + at, lo + at + span


class Searcher:
    """Some benchmark items in the latent space, ready to be held against texts."""

    def __init__(self, items: list[tuple], table: np.ndarray):
        """items: (id, text, answer or None)."""
        self.table, self.items = table, []
        h, ends = words([r[1] for r in items])
        a, a_ends = words([r[2] or "" for r in items])
        for i, r in enumerate(items):
            mine = h[ends[i - 1] if i else 0 : ends[i]]
            answer = a[a_ends[i - 1] if i else 0 : a_ends[i]]
            self.items.append(Item(r[0], mine, answer if len(answer) else mine[-ANSWER_WORDS:]))
        self.probes, self.of = probe(h, ends, table)
        self.size = np.array([x.size for x in self.items])
        of = np.repeat(np.arange(len(items)), self.size)
        self.marks = signatures(terms(h), of, len(items))
        self.folded = folded(self.marks)
        self.reach = -(-self.size // BLOCK)

    def find(self, texts: list[str]) -> dict[tuple[int, int], tuple]:
        """{(text, item): (cosine, share in order, answer found, first and end word)} of all matches."""
        h, ends = words(texts)
        x, first, doc, (marks, owner, block) = project(h, ends, self.table)
        best: dict[tuple[int, int], tuple] = {}
        if not len(x) or not len(self.probes):
            return best
        begins = np.concatenate([[0], ends[:-1]])
        around: dict[int, tuple] = {}
        for lo in range(0, len(x), 8192):
            cosine = x[lo : lo + 8192] @ self.probes.T
            window, probed = np.nonzero(cosine >= COSINE)
            item, value = self.of[probed], cosine[window, probed]
            window += lo
            may = np.zeros(len(item), bool)
            for reach in np.unique(self.reach[item]).tolist():
                if reach not in around:
                    wide = spread(marks, owner, reach)
                    around[reach] = folded(wide), wide
                mine = np.flatnonzero(self.reach[item] == reach)
                for own, there in zip((self.folded, self.marks), around[reach]):  # a coarse bound for all, the fine one for what is left
                    lost = np.bitwise_count(own[item[mine]] & ~there[block[window[mine]]]).sum(axis=1, dtype=np.int64)
                    mine = mine[lost <= (1 - WITH_ANSWER) * self.size[item[mine]] + 1e-9]
                may[mine] = True
            may = np.flatnonzero(may)
            # of a window and an item once, with the highest cosine of the item's windows
            may = may[np.lexsort((-value[may], item[may], window[may]))]
            pair = window[may] * len(self.items) + item[may]
            may = may[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(may) else may
            for w, i, c in zip(window[may].tolist(), item[may].tolist(), value[may].tolist()):
                d, own, at = int(doc[w]), self.items[i], int(first[w])
                share, answer, a, b = own.best(h, max(int(begins[d]), at - own.size), min(int(ends[d]), at + 2 * BLOCK + own.size))
                if (share >= WHOLE or answer) and ((d, i) not in best or share > best[d, i][1]):
                    best[d, i] = (c, share, answer, a - int(begins[d]), b - int(begins[d]))
        return best


def spread(marks: np.ndarray, owner: np.ndarray, reach: int) -> np.ndarray:
    """Of each block, the signature of a window that begins there and of so many blocks of its document on either side."""
    out = marks.copy()
    for k in [*range(-reach, 0), *range(1, reach + 2)]:
        lo, hi = max(0, -k), len(marks) - max(0, k)
        if hi > lo:
            out[lo:hi] |= np.where((owner[lo:hi] == owner[lo + k : hi + k])[:, None], marks[lo + k : hi + k], np.uint64(0))
    return out


def searchers(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, answer_col: str | None) -> Iterator[Callable[[], Searcher]]:
    """Makers of searchers that together hold all items with words; each is small enough for any task."""
    n, df, z = sketch(docs)
    table = latent(n, df, z)
    wanted = benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[text_col].cast("string").alias("text"), (benchmark[answer_col].cast("string") if answer_col else F.lit(None).cast("string")).alias("answer"))
    wanted = materialize(wanted.filter("text IS NOT NULL"), "items")
    held, size = [], 0

    def made(items: list[tuple]) -> Callable[[], Searcher]:
        sent = docs.sparkSession.sparkContext.broadcast((items, table))
        return lambda: Searcher(*sent.value)

    for r in wanted.toLocalIterator():  # a part at a time
        if any(_WORD[b] for b in r.text.lower().encode("utf-8", "surrogatepass")):
            held.append((r.item, r.text, r.answer))
            size += len(r.text)
        if size > ITEMS_MB << 20:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def matches(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """(document, item) pairs where the document holds the item's text, as it is or rephrased.

    Without answer_col an item's answer is its last words. Null and empty texts match nothing; a null doc_id stays null; repeated
    rows each match, as do repeated items; an empty table of documents or of items gives no rows. Whole texts are searched,
    however long. first_word and last_word tell where in the text.
    """
    parts = list(searchers(docs, benchmark, item_col, text_col, answer_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [part() for part in parts]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64())
        for ids, texts in text_chunks(batches, 500_000):
            rows = [(ids[d], one.items[i].key, *v) for one in search for (d, i), v in one.find(texts).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in MATCHES.split(", ")])

    return documents(docs).mapInArrow(run, MATCHES)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents that match no benchmark item, with their own columns: a map over the rows, which are neither joined nor shuffled.

    Each row is judged by its own text, whatever its id: rows under a null or repeated id stay or go for themselves, copies alike. Null
    and empty texts stay; an empty table stays empty; without items all stay.
    """
    parts, at = list(searchers(docs, benchmark, "item_id", "text", None)), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [part() for part in parts]
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], names=["doc_id", "text"])
            bad: set[int] = set()
            for ids, texts in text_chunks([rows], 500_000):
                bad |= {ids[d] for one in search for d, _ in one.find(texts)}
            if bad:
                batch = batch.take(pa.array([i for i in range(batch.num_rows) if i not in bad], pa.int64()))
            if batch.num_rows:
                yield batch

    return docs.mapInArrow(run, docs.schema)
