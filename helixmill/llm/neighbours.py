"""Exact nearest neighbours by TF-IDF cosine over a block-max inverted index.

Examples are kept in blocks. For every feature the index knows the largest weight it has in
each block, so one sum over a query's features bounds the cosine of all examples of a block.
The blocks of the largest bounds are scored first; then all whose bound reaches the k-th best
cosine found. What is skipped cannot be among the k nearest.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle

BLOCK = 32
#: Blocks scored before the first pruning.
FIRST = 4


class BlockMaxIndex:
    def __init__(self, rows: Sequence[Sequence[int]], idf: np.ndarray) -> None:
        self.idf = idf
        self.n = len(rows)
        vectors = [weigh(r, idf) for r in rows]
        lengths = np.array([len(c) for c, _ in vectors], dtype=np.int64)
        cols = np.concatenate([c for c, _ in vectors]) if self.n else np.zeros(0, np.int64)
        vals = np.concatenate([v for _, v in vectors]) if self.n else np.zeros(0, np.float32)
        example = np.repeat(np.arange(self.n), lengths)
        self.blocks = -(-self.n // BLOCK)
        # postings by feature, within it by block: the examples and their weights
        order = np.lexsort((example, cols))
        c, self.examples, self.weights = cols[order], example[order].astype(np.int32), vals[order]
        block = self.examples // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (block[1:] != block[:-1])])) if len(c) else np.zeros(0, np.int64)
        self.within = np.concatenate([first, [len(c)]]).astype(np.int64)
        self.post_block = block[first].astype(np.int32)
        self.post_max = np.maximum.reduceat(self.weights, first) if len(c) else np.zeros(0, np.float32)
        self.post_ptr = np.searchsorted(c[first], np.arange(len(idf) + 1)).astype(np.int64)

    def nearest(self, row: Sequence[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices and cosines of the ``k`` nearest examples that share a feature, nearest first."""
        cols, vals = weigh(row, self.idf)
        entries, at = _ranges(self.post_ptr[cols], self.post_ptr[cols + 1])
        weight = vals[at]
        bound = np.bincount(self.post_block[entries], weights=weight * self.post_max[entries], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        done = np.zeros(self.blocks, dtype=bool)
        done[order[:FIRST]] = True
        sims = self._cosines(entries, weight, done)
        if len(order) > FIRST:
            # the bound is rounded otherwise than the sum; a hair of slack keeps the search exact
            floor = np.partition(sims, -k)[-k] - 1e-5 if self.n > k else 0.0
            more = order[FIRST:][bound[order[FIRST:]] >= max(floor, 0.0)]
            if len(more):
                done[:] = False
                done[more] = True
                sims += self._cosines(entries, weight, done)
        found = np.flatnonzero(sims > 1e-6)
        best = found[np.lexsort((found, -sims[found]))[:k]]
        return best, sims[best].astype(np.float32)

    def nearest_many(self, rows: Sequence[Sequence[int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self.nearest(r, k) for r in rows]

    def _cosines(self, entries: np.ndarray, weight: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Cosines of the examples in the wanted blocks, 0 elsewhere."""
        keep = wanted[self.post_block[entries]]
        entries = entries[keep]
        places, at = _ranges(self.within[entries], self.within[entries + 1])
        return np.bincount(self.examples[places], weights=weight[keep][at] * self.weights[places].astype(np.float64), minlength=self.n)


def _ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and of which range each is."""
    size = end - first
    at = np.repeat(np.arange(len(size)), size)
    return np.arange(int(size.sum())) + (first - (np.cumsum(size) - size))[at], at


def weigh(row: Sequence[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a row and their weights, of length 1 together."""
    cols, tf = np.unique(np.asarray(row, dtype=np.int64), return_counts=True)
    vals = (1 + np.log(tf)) * idf[cols]
    norm = np.sqrt((vals * vals).sum())
    return cols, (vals / norm if norm else vals).astype(np.float32)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
