"""Scores of blocks of queries against batches of rows in numpy, with the best rows of each query held per task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries and rows that are multiplied at a time.
SIDE, ROWS = 512, 4096
#: More than what another order of adding changes in a score.
SLACK = 1e-7


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """x to so many digits, halves away from zero, by the product with a power of ten."""
    y = x * 10.0**digits
    t = np.trunc(y)
    return (t + np.where(np.abs(y - t) >= 0.5, np.sign(y), 0.0)) / 10.0**digits


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b at the same places, added from the first element to the last."""
    s = np.zeros(len(a))
    for i in range(a.shape[1]):
        s += a[:, i] * b[:, i]
    return s


def matrix(col, width: int) -> np.ndarray:
    """An Arrow column of lists, each of width numbers, as rows."""
    return np.asarray(col.flatten(), np.float64).reshape(len(col), width)


def ids_of(col) -> np.ndarray:
    return np.array(col.to_pylist(), object) if col.null_count or not pa.types.is_integer(col.type) else col.to_numpy(zero_copy_only=False)


class Best:
    """The k best (score, id) of each of n queries; ties by id, null ids first."""

    def __init__(self, n: int, k: int, digits: int):
        self.k, self.digits, self.n, self.slack = k, digits, n, SLACK
        self.score: list = [None] * n
        self.ids: list = [None] * n
        self.low = np.full(n, -np.inf)  # a row below can no longer be among the best

    def candidates(self, scores: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (query from first on, row) in scores that may be among the best."""
        low = self.low[first : first + len(scores)]
        if scores.shape[1] > self.k and np.isinf(low).any():
            kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
            low = np.maximum(low, kth - 10.0**-self.digits - self.slack)
        return np.nonzero(scores >= low[:, None])

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Rounded scores; query ascends."""
        cuts = np.flatnonzero(np.diff(query)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(query)], strict=True):
            if a == z:
                continue
            q = int(query[a])
            s, i = score[a:z], ids[a:z]
            if self.score[q] is not None:
                s, i = np.concatenate([self.score[q], s]), np.concatenate([self.ids[q], i])
            if i.dtype == object:
                top = np.array(sorted(range(len(s)), key=lambda n: (-s[n], i[n] is not None, i[n])))[: self.k]
            else:
                top = np.lexsort((i, -s))[: self.k]
            self.score[q], self.ids[q] = s[top], i[top]
            if len(top) == self.k:
                self.low[q] = s[top[-1]] - 10.0**-self.digits - self.slack

    def batch(self, query_ids, id_type) -> pa.RecordBatch:
        full = [q for q in range(self.n) if self.score[q] is not None]
        which = np.repeat(np.array(full, np.int64), [len(self.score[q]) for q in full])
        ids = [x for q in full for x in self.ids[q].tolist()]
        score = np.concatenate([self.score[q] for q in full]) if full else np.zeros(0)
        return pa.RecordBatch.from_arrays([query_ids.take(pa.array(which)), pa.array(ids, id_type), pa.array(score)], ["query_id", "id", "score"])


def add_products(best: Best, asked: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
    """Inner products of all queries with rows; those that may be among the best are added again in order."""
    longest = [np.sqrt((x * x).sum(axis=1).max(initial=0.0)) for x in (asked, rows)]
    best.slack = max(best.slack, 1e-12 * longest[0] * longest[1])
    for a in range(0, len(rows), ROWS):
        part, own = rows[a : a + ROWS], ids[a : a + ROWS]
        for q in range(0, len(asked), SIDE):
            i, j = best.candidates(asked[q : q + SIDE] @ part.T, q)
            for c in range(0, len(i), 1 << 16):  # many in the first batch and among copies
                x, y = i[c : c + (1 << 16)] + q, j[c : c + (1 << 16)]
                best.add(x, rounded(in_order(asked[x], part[y]), best.digits), own[y])


def cosines(asked: np.ndarray, rows: np.ndarray, digits: int) -> np.ndarray:
    """Rounded cosines of all queries with all rows as if added in order; a length of zero counts as 1."""
    length = np.sqrt(in_order(asked, asked)[:, None] * in_order(rows, rows)[None, :])
    length[length == 0] = 1.0
    x = (asked @ rows.T) / length
    y = x * 10.0**digits
    i, j = np.nonzero(np.abs(np.abs(y - np.trunc(y)) - 0.5) < 10.0**digits * 1e-12)
    x[i, j] = in_order(asked[i], rows[j]) / length[i, j]
    return rounded(np.clip(x, -1.0, 1.0), digits)


class Questions:
    """Weighted terms of queries: scores of batches of token lists by BM25."""

    def __init__(self, terms: pa.Array, query: np.ndarray, term: np.ndarray, qn: np.ndarray, idf: np.ndarray, n: int):
        order = np.lexsort((query, term))
        self.terms, self.n, self.idf = terms, n, idf
        self.query, self.qn = query[order], qn[order].astype(np.float64)
        self.first = np.searchsorted(term[order], np.arange(len(terms) + 1))

    def scores(self, lists, avgdl: float, k1: float, b: float) -> np.ndarray:
        """(queries, rows) for an Arrow column of token lists."""
        n_rows, n_terms = len(lists), len(self.terms)
        off = lists.offsets.to_numpy()
        found = pc.index_in(lists.flatten(), value_set=self.terms)
        dl = np.diff(off) if not lists.null_count else np.array([len(x) if x is not None else 0 for x in lists.to_pylist()])
        at = found.fill_null(-1).to_numpy()
        row = np.repeat(np.arange(n_rows), dl)
        row, at = row[at >= 0], at[at >= 0]
        key, tf = np.unique(row * n_terms + at, return_counts=True)
        row, at = np.divmod(key, max(n_terms, 1))
        gain = self.idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
        asked = np.diff(self.first)
        out = np.zeros((self.n, n_rows))
        # terms of many rows and queries as matrices, the others one by one
        often = np.bincount(at, minlength=n_terms) * asked > 0.01 * n_rows * self.n
        for some in np.array_split(np.flatnonzero(often), -(-int(often.sum()) // 256) or 1):
            if len(some):
                place = np.full(n_terms, -1)
                place[some] = np.arange(len(some))
                left = np.zeros((self.n, len(some)))
                for t in some:
                    left[self.query[self.first[t] : self.first[t + 1]], place[t]] += self.qn[self.first[t] : self.first[t + 1]]
                mine = place[at] >= 0
                right = np.zeros((len(some), n_rows))
                right[place[at[mine]], row[mine]] = gain[mine]
                out += left @ right
        rare = ~often[at]
        row, at, gain = row[rare], at[rare], gain[rare]
        count = asked[at]
        which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[at], count)
        np.add.at(out.reshape(-1), self.query[which] * n_rows + np.repeat(row, count), self.qn[which] * np.repeat(gain, count))
        return out
