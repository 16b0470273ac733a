"""The nearest chunks of many queries in one pass over the chunks, by matrix products and exact scores of what they leave open."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Pairs whose products are held at once, and pairs that are scored exactly at once.
TILE, SLICE = 4 << 20, 1 << 17
MOST = np.finfo(np.float64).max


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of rows, added from left to right as Spark's aggregate adds them."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class Side:
    """Vectors of equal width: their rows, squared lengths, and which of them matrix products score well."""

    def __init__(self, rows: np.ndarray, m: np.ndarray, metric: str):
        with np.errstate(all="ignore"):
            self.rows, self.m, self.squares = rows, m, products(m, m)
            self.fine = np.isfinite(self.squares) & (self.squares < 1e280) & ((self.squares > 1e-280) | (metric != "cosine"))


def by_owner(of: pd.Series) -> dict[str, np.ndarray]:
    return {str(k): np.asarray(v) for k, v in of.reset_index(drop=True).groupby(of.to_numpy(), sort=False).indices.items()}


def by_width(vectors: list, rows: np.ndarray, metric: str) -> dict[int, Side]:
    """The rows that have a vector, by its width."""
    widths = np.array([-1 if vectors[i] is None else len(vectors[i]) for i in rows], dtype=np.int64)
    out = {}
    for w in set(widths.tolist()) - {-1}:
        own = rows[widths == w]
        out[w] = Side(own, np.array([vectors[i] for i in own], dtype=np.float64).reshape(len(own), w), metric)
    return out


def sortable(ids: pd.Series) -> np.ndarray:
    return np.array(ids.tolist(), dtype=str) if ids.dtype == object else ids.to_numpy()


def some_copies(m: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest ids of every vector, ascending: no other copy can be among anyone's k best."""
    if len(m) <= k or not m.shape[1]:
        return np.arange(len(m))
    order = np.argsort(ids, kind="stable")
    _, group = np.unique(np.ascontiguousarray(m[order]).view(f"V{8 * m.shape[1]}").ravel(), return_inverse=True)
    run = np.argsort(group, kind="stable")
    first = np.searchsorted(group[run], group[run])
    return np.sort(order[run[np.arange(len(run)) - first < k]])


class Nearest:
    """The k best chunks of every query among those seen, ties to the smaller id.

    ``asked`` has query_id, vector and of; a query meets the chunks of its ``of``. A pair's score is the one of Spark's
    column functions, to the last bit. A pair is scored only if a bound from above on its score, a matrix product
    with its rounding error, reaches the query's k-th best score so far. ``nulls``: pairs without a score
    (no vector, another width, by cosine length zero) rank last; without it they, and scores that aren't finite, are left out
    and the ends of all scores are kept.
    """

    def __init__(self, asked: pd.DataFrame, k: int, metric: str, nulls: bool = True):
        self.k, self.metric, self.nulls = k, metric, nulls
        self.query_ids, vectors = asked["query_id"].reset_index(drop=True), asked["vector"].tolist()
        self.groups = {of: (rows, by_width(vectors, rows, metric)) for of, rows in by_owner(asked["of"]).items()}
        self.kth, self.low, self.high = (np.full(len(asked), x) for x in (-np.inf, np.inf, -np.inf))
        self.best: list[np.ndarray] | None = None  # query, id, distance, whether it is null
        self.found: list[tuple] = []

    def see(self, chunks: pd.DataFrame) -> None:
        """``chunks``: id, vector, of."""
        ids, vectors = sortable(chunks["id"]), chunks["vector"].tolist()
        with np.errstate(all="ignore"):
            for of, rows in by_owner(chunks["of"]).items():
                asked, sides = self.groups.get(of, (None, {}))
                if asked is None:
                    continue
                held = by_width(vectors, rows, self.metric)
                for w, q in sides.items():
                    scored = np.zeros(0, dtype=np.int64)
                    if w in held:
                        scored = held[w].rows
                        self.meet(q, held[w], ids)
                    if self.nulls:
                        self.fill(q.rows, np.setdiff1d(rows, scored), ids)
                if self.nulls:
                    without = np.setdiff1d(asked, np.concatenate([np.zeros(0, dtype=np.int64), *[q.rows for q in sides.values()]]))
                    self.fill(without, rows, ids)
            self.keep()

    def fill(self, asked: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        """Pairs without a score, for queries that have no k scores yet."""
        asked, some = asked[self.kth[asked] == -np.inf], np.sort(ids[rows])[: self.k]
        if len(asked) and len(some):
            n = len(asked) * len(some)
            self.found.append((np.repeat(asked, len(some)), np.tile(some, len(asked)), np.full(n, np.nan), np.ones(n, dtype=bool)))

    def meet(self, q: Side, x: Side, ids: np.ndarray) -> None:
        some = some_copies(x.m, ids[x.rows], self.k)
        x_fine, x_odd = some[x.fine[some]], some[~x.fine[some]]
        q_fine, q_odd = np.flatnonzero(q.fine), np.flatnonzero(~q.fine)
        for left, right in ((q_odd, some), (q_fine, x_odd)):
            step = max(1, SLICE // max(1, len(right)))
            for at in range(0, len(left) if len(right) else 0, step):
                part = left[at : at + step]
                self.take(q, x, np.repeat(part, len(right)), np.tile(right, len(part)), ids, ends=True)
        if not len(q_fine) or not len(x_fine):
            return
        c = 4 * (x.m.shape[1] + 8) * 2.0**-53  # several times the rounding error of a sum of products
        b, bb = x.m[x_fine], x.squares[x_fine]
        if self.metric == "cosine":
            b = b / np.sqrt(bb)[:, None]
        elif self.metric == "dot":
            b = np.column_stack([b, c * np.sqrt(bb)])
        else:
            b = np.column_stack([2 * b, -(1 - c) * bb])
        for at in range(0, len(q_fine), max(1, TILE // len(b))):
            part = q_fine[at : at + max(1, TILE // len(b))]
            a, aa, kth = q.m[part], q.squares[part], self.kth[q.rows[part]]
            if self.metric == "cosine":
                s = (a / np.sqrt(aa)[:, None]) @ b.T + 0.0
            else:
                s = np.column_stack([a, np.sqrt(aa) if self.metric == "dot" else np.ones(len(a))]) @ b.T
            if not self.nulls:
                self.widen(q.rows[part], self.from_keys(s.min(1), aa), self.from_keys(s.max(1), aa))
            open_ = np.flatnonzero(np.isneginf(kth))
            if len(open_) and len(b) > self.k:  # the k best by product of the first columns set a first bound
                first = np.argpartition(-s[open_, : max(1024, 4 * self.k)], self.k - 1, axis=1)[:, : self.k]
                for lo in range(0, len(open_), max(1, SLICE // self.k)):
                    r = open_[lo : lo + max(1, SLICE // self.k)]
                    near, _ = self.distances(q, x, np.repeat(part[r], self.k), x_fine[first[lo : lo + len(r)].ravel()])
                    kth[r] = self.scores(near).reshape(len(r), self.k).min(1)
            rows, columns = np.nonzero(s >= self.to_keys(kth, aa, c)[:, None])
            for lo in range(0, len(rows), SLICE):
                self.take(q, x, part[rows[lo : lo + SLICE]], x_fine[columns[lo : lo + SLICE]], ids)

    def to_keys(self, kth: np.ndarray, aa: np.ndarray, c: float) -> np.ndarray:
        """What the matrix product of a pair is at least if its score reaches ``kth``."""
        if self.metric == "cosine":
            return kth - c
        if self.metric == "dot":
            return kth - 1e-300
        return np.where(kth > 0, aa - (1 / kth - 1) - c * (2 + aa + 1 / kth), -np.inf)

    def from_keys(self, s: np.ndarray, aa: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.maximum(aa - s, 0)) if self.metric not in ("cosine", "dot") else s

    def widen(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        np.minimum.at(self.low, rows, low)
        np.maximum.at(self.high, rows, high)

    def distances(self, q: Side, x: Side, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance, whether it is null) of pairs."""
        a, b = q.m[r], x.m[c]
        if self.metric == "cosine":
            size = np.sqrt(q.squares[r]) * np.sqrt(x.squares[c])
            return 1 - products(a, b) / size, size == 0
        if self.metric == "dot":
            return -products(a, b), np.zeros(len(r), dtype=bool)
        return products(a - b, a - b), np.zeros(len(r), dtype=bool)

    def scores(self, distance: np.ndarray) -> np.ndarray:
        if self.metric == "cosine":
            return 1 - distance
        return -distance if self.metric == "dot" else 1 / (1 + distance)

    def take(self, q: Side, x: Side, r: np.ndarray, c: np.ndarray, ids: np.ndarray, ends: bool = False) -> None:
        """Pairs of places in both sides are scored and become candidates."""
        distance, null = self.distances(q, x, r, c)
        score, rows = self.scores(distance), q.rows[r]
        use = np.ones(len(r), dtype=bool) if self.nulls else np.isfinite(score) & ~null
        if ends and not self.nulls:
            self.widen(rows[use], score[use], score[use])
        use &= order_of(score, null) >= self.kth[rows]
        self.found.append((rows[use], ids[x.rows[c[use]]], distance[use], null[use]))
        if sum(len(f[0]) for f in self.found) > 4 * SLICE:
            self.keep()

    def keep(self) -> None:
        """The k best of each query among the candidates."""
        if not self.found:
            return
        parts = [np.concatenate(x) for x in zip(*([tuple(self.best)] if self.best else []), *self.found, strict=True)]
        self.found = []
        q, ids, order = parts[0], parts[1], order_of(self.scores(parts[2]), parts[3])
        by = np.lexsort((ids, -order, q))
        place = np.arange(len(by)) - np.searchsorted(q[by], q[by])
        last = by[place == self.k - 1]
        self.kth[q[last]] = order[last]
        self.best = [x[by[place < self.k]] for x in parts]

    def rows(self) -> pd.DataFrame:
        """query_id, id, distance, score, low, high."""
        if not self.best:
            return pd.DataFrame({"query_id": self.query_ids[:0], "id": [], "distance": [], "score": [], "low": [], "high": []})
        q, ids, distance, null = self.best
        with np.errstate(all="ignore"):
            shown = {name: pa.array(x, mask=null) for name, x in (("distance", distance), ("score", self.scores(distance)))}
        shown = {name: pd.Series(x, dtype=pd.ArrowDtype(pa.float64())) for name, x in shown.items()}
        return pd.DataFrame({"query_id": self.query_ids.to_numpy()[q], "id": ids, **shown, "low": self.low[q], "high": self.high[q]})


class Sharing(Nearest):
    """As ``Nearest`` by cosine, among pairs that share a pattern in some table only.

    ``own`` gives the patterns (one a table) of rows of a matrix, ``probed`` those that a query looks into. The pairs of a
    pattern are a matrix product of at most ``block`` rows and queries; a pair that meets in several tables is kept once.
    """

    def __init__(self, asked: pd.DataFrame, k: int, width: int, own: Callable, probed: Callable, block: int):
        super().__init__(asked, k, "cosine")
        self.own, self.block = own, block
        self.side = Side(np.arange(len(asked)), np.array(asked["vector"].tolist(), dtype=np.float64).reshape(len(asked), width), "cosine")
        self.unit = self.units(self.side)
        patterns = [probed(self.side.m[a : a + 512]) for a in range(0, len(asked), 512)]
        self.tables = [by_pattern(t) for t in np.concatenate(patterns).transpose(1, 0, 2)] if patterns else []

    def units(self, side: Side) -> np.ndarray:
        return side.m / np.sqrt(np.where(side.fine, side.squares, 1.0))[:, None]

    def see(self, chunks: pd.DataFrame) -> None:
        """``chunks``: id, vector, all of the usual width."""
        ids = sortable(chunks["id"])
        with np.errstate(all="ignore"):
            x = Side(np.arange(len(ids)), np.array(chunks["vector"].tolist(), dtype=np.float64).reshape(len(ids), -1), "cosine")
            units, slack = self.units(x), 4 * (x.m.shape[1] + 8) * 2.0**-53
            patterns = np.concatenate([self.own(x.m[a : a + 4096]) for a in range(0, len(ids), 4096)])
            left, right, n = [], [], 0
            for (asked, starts), own in zip(self.tables, patterns.T, strict=True):
                held, begins = by_pattern(own[:, None])
                for p in starts.keys() & begins.keys():
                    qs, xs = asked[slice(*starts[p])], held[slice(*begins[p])]
                    for a in range(0, len(qs), self.block):
                        for b in range(0, len(xs), self.block):
                            q, c = qs[a : a + self.block], xs[b : b + self.block]
                            may = self.unit[q] @ units[c].T >= (self.kth[q] - slack)[:, None]
                            if not (self.side.fine[q].all() and x.fine[c].all()):
                                may |= ~self.side.fine[q][:, None] | ~x.fine[c]
                            rows, columns = np.nonzero(may)
                            left.append(q[rows])
                            right.append(c[columns])
                            n += len(rows)
                            if n > SLICE:
                                left, right, n = self.meet_pairs(x, left, right, ids)
            self.meet_pairs(x, left, right, ids)

    def meet_pairs(self, x: Side, left: list, right: list, ids: np.ndarray) -> tuple[list, list, int]:
        if left:
            r, c = np.concatenate(left), np.concatenate(right)
            both = np.unique(r * len(ids) + c)
            for a in range(0, len(both), SLICE):
                r, c = np.divmod(both[a : a + SLICE], len(ids))
                self.take(self.side, x, r, c, ids)
                self.keep()
        return [], [], 0

    def keep(self) -> None:
        """Pairs that are kept and found again count once."""
        if self.best and self.found:
            q, i, d = (np.concatenate([f[n] for f in self.found]) for n in (0, 1, 2))
            old = pd.MultiIndex.from_arrays([self.best[0], self.best[1], self.best[2]])
            new = ~pd.MultiIndex.from_arrays([q, i, d]).isin(old)
            self.found = [tuple(np.concatenate([f[n] for f in self.found])[new] for n in range(4))]
        super().keep()


def by_pattern(patterns: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """(rows in the order of their patterns, where in it each pattern lies) from some patterns a row."""
    flat = patterns.ravel()
    order = np.argsort(flat, kind="stable")
    found, first = np.unique(flat[order], return_index=True)
    return order // patterns.shape[1], dict(zip(found.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(flat)], strict=True), strict=True))


def order_of(score: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Spark's order of doubles as numbers: NaN above all, null below all."""
    return np.where(null, -np.inf, np.where(np.isnan(score), np.inf, np.clip(score, -MOST, MOST)))


def over_sharing(near: Sharing, batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """As ``over``, of at most ``most`` chunks (and a batch) at once, so that patterns have many rows."""
    held: list[pd.DataFrame] = []
    for chunks in batches:
        held.append(chunks)
        if sum(map(len, held)) >= most:
            near.see(pd.concat(held))
            held = []
    if sum(map(len, held)):
        near.see(pd.concat(held))
    yield near.rows()


def over(asked: pd.DataFrame, k: int, metric: str, nulls: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The k best of each query among all batches of a task."""
    near = Nearest(asked, k, metric, nulls)
    for chunks in batches:
        near.see(chunks)
    yield near.rows()
