"""The best k of each query, kept while a task's rows pass by in blocks of scores."""

from __future__ import annotations

import numpy as np

#: Scores held at once; a block's temporary arrays are a few times 8 bytes of these.
CELLS = 1 << 20


class Best:
    """Per query the k largest scores, rounded to `digits`, ties to the smaller id; NaN is the largest, as in SQL.

    exact: hand on the scores as they were before rounding.
    """

    def __init__(self, queries: int, k: int, digits: int, exact: bool = False) -> None:
        self.k, self.digits = k, digits
        self.score = np.full((queries, k), -np.inf)
        self.whole = self.score.copy() if exact else self.score
        self.id: np.ndarray | None = None
        self.count = np.zeros(queries, dtype=np.int64)

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray | None = None) -> None:
        """scores: of queries at, at + 1, ... (rows) for ids (columns); valid: which of them count."""
        k = self.k
        if self.id is None:
            self.id = np.empty(self.score.shape, dtype=ids.dtype)
        n = len(scores)
        least = self.score[at : at + n, k - 1].copy()
        full = self.count[at : at + n] == k
        least[~full] = -np.inf
        if valid is not None:
            scores = np.where(valid, scores, -np.inf)
        if not full.all() and scores.shape[1] > k:
            own = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            least = np.where(full, least, own)
        # what may equal the least one after rounding stays in
        with np.errstate(invalid="ignore"):
            least = least - 2 * 10.0**-self.digits - 8 * np.spacing(np.abs(least))
        chosen = ~(scores < np.where(np.isnan(least), -np.inf, least)[:, None])
        if valid is not None:
            chosen &= valid
        rows, columns = np.nonzero(chosen)
        if not len(rows):
            return
        whole = scores[rows, columns]
        values = np.round(whole, self.digits)
        hit = np.unique(rows)
        old = np.arange(k)[None] < self.count[at + hit][:, None]
        rows = np.concatenate([np.repeat(hit, old.sum(axis=1)), rows])
        values, whole = np.concatenate([self.score[at + hit][old], values]), np.concatenate([self.whole[at + hit][old], whole])
        names = np.concatenate([self.id[at + hit][old], ids[columns]])
        order = np.lexsort((_ranks(names), -values, ~np.isnan(values), rows))
        rows, values, whole, names = rows[order], values[order], whole[order], names[order]
        start = np.searchsorted(rows, hit)
        place = np.arange(len(rows)) - np.repeat(start, np.diff([*start, len(rows)]))
        keep = place < k
        rows, place = rows[keep] + at, place[keep]
        if self.whole is not self.score:
            self.whole[rows, place] = whole[keep]
        self.score[rows, place], self.id[rows, place] = values[keep], names[keep]
        self.count[at + hit] = np.minimum(np.diff([*start, len(order)]), k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and scores of all that is kept."""
        found = np.arange(self.k)[None] < self.count[:, None]
        return np.repeat(np.arange(len(self.count)), self.count), self.id[found] if self.id is not None else np.array([]), self.whole[found]


def _ranks(names: np.ndarray) -> np.ndarray:
    return names if names.dtype != object else np.unique(names, return_inverse=True)[1]
