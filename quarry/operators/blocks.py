"""The best rows of many questions by cosine, from blocks of products: what one task of an exact search keeps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Questions and rows that are multiplied at a time, pairs that are scored at a time, questions whose best make a batch.
QUESTIONS, ROWS, PAIRS, BATCH = 1024, 2048, 1 << 18, 1 << 12
#: Products may differ from scores by rounding; what comes this near to a question's last place is scored.
MARGIN = 1e-9


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the columns of a and b, added component by component: equal columns give equal sums wherever they stand."""
    out = np.zeros(a.shape[1])
    for x, y in zip(a, b):
        out += x * y
    return out


def unit(v: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return v / np.linalg.norm(v, axis=1, keepdims=True)


class Best:
    """Each question's ``limit`` best rows: by score, then as they came. All questions come first.

    Products in blocks tell which rows can matter; those are scored anew, x.y / sqrt(x.x * y.y) within -1 and 1, and only scores decide.
    A score that isn't a number (a vector of zeros) counts as the largest, as in SQL.
    """

    def __init__(self, limit: int):
        self.limit, self.asked, self.vectors, self.found, self.seen = limit, [], [], [], 0
        self.blocks: list[tuple] = []

    def ask(self, ids: pa.Array, vectors: np.ndarray) -> None:
        self.asked.append(ids)
        self.vectors.append(vectors)

    def _begin(self) -> None:
        q = np.concatenate(self.vectors)
        self.vectors = []
        for lo in range(0, len(q), QUESTIONS):
            own = q[lo : lo + QUESTIONS]
            columns = np.ascontiguousarray(own.T)
            self.blocks.append((unit(own), columns, in_order(columns, columns), np.full((len(own), self.limit), -np.inf), np.full((len(own), self.limit), -1)))

    def rows(self, ids: pa.Array, vectors: np.ndarray) -> None:
        if not self.asked:
            return
        if self.vectors:
            self._begin()
        self.found.append(ids)
        for lo in range(0, len(vectors), ROWS):
            x = vectors[lo : lo + ROWS]
            units, columns = unit(x), np.ascontiguousarray(x.T)
            squares = in_order(columns, columns)
            for block in self.blocks:
                self._meet(block, units, columns, squares)
            self.seen += len(x)

    def _meet(self, block: tuple, units: np.ndarray, columns: np.ndarray, squares: np.ndarray) -> None:
        q, q_columns, q_squares, scores, places = block
        with np.errstate(all="ignore"):
            products = q @ units.T
        products[np.isnan(products)] = np.inf
        last = scores[:, -1]
        if len(units) > self.limit and not np.isfinite(last).all():
            last = np.maximum(last, np.partition(products, -self.limit, axis=1)[:, -self.limit])
        i, j = np.nonzero(products >= (last - MARGIN)[:, None])
        for lo in range(0, len(i), PAIRS):
            self._keep(scores, places, i[lo : lo + PAIRS], j[lo : lo + PAIRS], q_columns, q_squares, columns, squares)

    def _keep(self, scores, places, i, j, q_columns, q_squares, columns, squares) -> None:
        dots = np.zeros(len(i))
        for x, y in zip(q_columns, columns):
            dots += x[i] * y[j]
        with np.errstate(all="ignore"):
            score = np.clip(dots / np.sqrt(q_squares[i] * squares[j]), -1.0, 1.0)
        score[np.isnan(score)] = np.inf
        better = score > scores[i, -1]  # rows come in order, so an equal one comes behind
        i, j, score = i[better], j[better], score[better]
        if not len(i):
            return
        met = np.unique(i)
        owner = np.concatenate([np.repeat(met, self.limit), i])
        score, place = np.concatenate([scores[met].ravel(), score]), np.concatenate([places[met].ravel(), j + self.seen])
        order = np.lexsort((place, -score, owner))
        owner, score, place = owner[order], score[order], place[order]
        starts = np.searchsorted(owner, met)
        kept = starts[:, None] + np.arange(self.limit)
        scores[met], places[met] = score[kept], place[kept]

    def result(self) -> Iterator[pa.RecordBatch]:
        """query_id, chunk_id, score; of each question as many as it has."""
        if not self.blocks:
            return
        asked, found = pa.chunked_array(self.asked), pa.chunked_array(self.found)
        scores, places = np.concatenate([b[3] for b in self.blocks]), np.concatenate([b[4] for b in self.blocks])
        for lo in range(0, len(scores), BATCH):
            owner, k = np.nonzero(places[lo : lo + BATCH] >= 0)
            owner += lo
            score = scores[owner, k]
            score[np.isinf(score)] = np.nan
            ids = [a.take(pa.array(at)).combine_chunks() for a, at in ((asked, owner), (found, places[owner, k]))]
            yield pa.RecordBatch.from_arrays([*(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in ids), pa.array(score)], names=["query_id", "chunk_id", "score"])
