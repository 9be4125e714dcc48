"""The k nearest rows of a stream for a block of queries: what one task of `vector.knn_join` does.

Matrix products give a lower bound on each distance; only rows whose bound is within a query's k-th distance are
measured, element by element in the order of the vector, as `vector.l2` and `vector.cosine` do. So equal vectors have equal
distances, and ties go by the order of arrival. Memory is that of the block, PAIRS bounds and MEASURED numbers at a time.

Defined results: NaN is the greatest distance (vectors with a null or NaN element); the cosine distance of a zero vector
is 1; vectors of different lengths are an error.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

ROWS = 2048  # rows compared at once
PAIRS = 1 << 20  # bounds computed at once
MEASURED = 1 << 20  # numbers subtracted at once


def _ordered_sum(terms):
    return np.cumsum(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))


class Nearest:
    """The k nearest rows seen so far for each query."""

    def __init__(self, queries, k: int, metric: str = "l2", chunk: int = 4096):
        self.q, self.k, self.cosine, self.step = queries, k, metric != "l2", max(1, min(chunk, PAIRS // ROWS))
        self.slack = 4 * (queries.shape[1] + 8) * np.finfo(float).eps  # bounds the rounding of both ways to a distance, relative to the squared norms
        self.left, self.own, self.width, self.odd, self.norm = self._terms(queries)
        self.left = self.left * (-1.0 if self.cosine else -2.0)
        self.own = self.own + (1.0 - self.slack if self.cosine else 0.0)
        self.dist, self.at, self.seen = np.full((len(queries), k), np.nan), np.full((len(queries), k), np.iinfo(np.int64).max), 0

    def _terms(self, v):
        """Of vectors: the factor of the product, the part of the lower bound and of its width that is their own, which have no bound, norms."""
        with np.errstate(all="ignore"):
            square = _ordered_sum(v * v)
            norm = np.sqrt(square)
            odd = ~(square <= 1e300) | ((square > 0) & (square < 1e-280))
            if self.cosine:
                return v / np.where(norm > 0, norm, 1.0)[:, None], np.zeros(len(v)), np.full(len(v), self.slack), odd, norm
            return v, square * (1 - self.slack), 2 * self.slack * square, odd, norm

    def add(self, x) -> None:
        """See the rows of x, in their order."""
        if x.shape[1] != self.q.shape[1]:
            raise ValueError(f"vectors of lengths {self.q.shape[1]} and {x.shape[1]}")
        for i in range(0, len(x), ROWS):
            part = x[i : i + ROWS]
            terms = self._terms(part)
            for j in range(0, len(self.q), self.step):
                self._compare(slice(j, j + self.step), part, *terms)
            self.seen += len(part)

    def _compare(self, s, x, right, own, width, odd, norm) -> None:
        with np.errstate(all="ignore"):
            low = self.left[s] @ right.T
            low += own
            low[:, odd] = low[self.odd[s]] = -np.inf
            reach = self._reach(s, low, width[~odd].max(initial=0.0))
            qi, xi = np.nonzero(low <= reach[:, None])
            if not len(qi):
                return
            d = np.empty(len(qi))
            n = max(1, MEASURED // max(1, x.shape[1]))
            for i in range(0, len(qi), n):
                d[i : i + n] = self._measure(qi[i : i + n] + s.start, xi[i : i + n], x, norm)
        touched, of = np.unique(qi, return_inverse=True)
        rows, k = touched + s.start, self.k
        of = np.concatenate([np.repeat(np.arange(len(rows)), k), of])
        d = np.concatenate([self.dist[rows].ravel(), d])
        at = np.concatenate([self.at[rows].ravel(), xi + self.seen])
        order = np.lexsort((at, d, of))
        best = order[np.searchsorted(of[order], np.arange(len(rows)))[:, None] + np.arange(k)]
        self.dist[rows], self.at[rows] = d[best], at[best]

    def _reach(self, s, low, width):
        """For each query the greatest lower bound (less its own part) that a row among its k nearest can have."""
        if self.seen >= self.k:
            kth = self.dist[s, self.k - 1]
            kth = kth if self.cosine else kth * kth
            reach = kth + 8 * np.finfo(float).eps * abs(kth) + 1e-300 - self.own[s]
        elif low.shape[1] >= self.k:  # k of these rows are nearer than the k-th bound and its width
            reach = np.partition(np.where(low == -np.inf, np.inf, low), self.k - 1, axis=1)[:, self.k - 1] + self.width[s] + width
        else:
            reach = np.full(len(low), np.inf)
        return np.where(np.isnan(reach), np.inf, reach)

    def _measure(self, qi, xi, x, norm):
        if self.cosine:
            norms = norm[xi] * self.norm[qi]
            return np.where(norms == 0, 1.0, 1.0 - _ordered_sum(x[xi] * self.q[qi]) / norms)
        t = x[xi] - self.q[qi]
        return np.sqrt(_ordered_sum(t * t))

    def best(self):
        """Numbers of queries, numbers of rows by arrival and distances, by query, nearest first; some queries at a time."""
        n = min(self.seen, self.k)
        for j in range(0, len(self.q), self.step):
            at = self.at[j : j + self.step, :n]
            yield np.repeat(np.arange(j, j + len(at)), n), at.ravel(), self.dist[j : j + self.step, :n].ravel()


def _matrix(column):
    import pyarrow.compute as pc

    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if (sizes != sizes[0]).any():
        raise ValueError(f"vectors of lengths {sizes.min()} and {sizes.max()}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), sizes[0])


def best_of_cell(batches, k: int, metric: str, chunk: int, names: list[str]):
    """Of batches of (is base, query id, base id, vector), queries first: query id, base id and distance of each query's k best."""
    import pyarrow as pa

    def kept(column, i):  # a copy: a slice would keep its whole batch
        return column.take(pa.array(np.arange(i.start, i.stop)))

    queries, vectors, ids, found = [], [], [], None
    for b in batches:
        rows = b.num_rows
        n = rows - int(np.count_nonzero(b.column(0).to_numpy(zero_copy_only=False)))
        if n:
            queries.append(kept(b.column(1), slice(0, n)))
            vectors.append(_matrix(b.column(3).slice(0, n)))
        if n == rows or not queries:
            continue
        if found is None:
            found, vectors = Nearest(np.concatenate(vectors), k, metric, chunk), []
        ids.append(kept(b.column(2), slice(n, rows)))
        for i in range(n, rows, ROWS):
            found.add(_matrix(b.column(3).slice(i, ROWS)))
    if found is None:
        return
    queries, ids = pa.chunked_array(queries), pa.chunked_array(ids)
    for q, at, d in found.best():
        columns = [queries.take(pa.array(q)), ids.take(pa.array(at)), pa.chunked_array([pa.array(d)])]
        yield from pa.table(columns, names=names).to_batches()
