"""Folds over the ordered rows of a key that give every row the number of its run, in parallel within one large key.

Keys of a bounded size are dealt by key and folded in one pass. The rows of larger keys are dealt
by ranges of key and order and written once, so a key of any size spreads over tasks. A run that starts at a given row ends at a row that the values alone decide; only the run
that is open where a task's rows begin depends on the rows before. So a first pass gives, for each
task, a summary of its first key: for every place where the open run may end, how many runs follow
and what is open at the end. One scan over these summaries (a row a task) finds what is open at
each task's start, and a second pass numbers the rows of all tasks at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from quarry.operators.written import kept_in_place, written

WITHOUT_LIMIT = 1 << 60
#: Rows of a key that one task folds; the rows of larger keys are dealt to many.
MOST_OF_KEY = 1_000_000


class Packed:
    """Runs of units packed up to a room of characters with separators, at most ``most`` a run.

    Values: length, room (of the key), alone (1: a run of its own). Open: (characters, units).
    """

    def __init__(self, separator: int, most: int | None = None):
        self.separator, self.most = separator, most or WITHOUT_LIMIT

    def ends(self, v: list[np.ndarray]) -> np.ndarray:
        """For a run from each row, the row behind it."""
        n, room, alone = v
        place, size = np.arange(len(n)), n + self.separator
        total = np.cumsum(size)
        fits = np.searchsorted(total, total - size + room + self.separator, "right")
        at = np.flatnonzero(alone)
        following = np.append(at, len(n))[np.searchsorted(at, place, "right")]
        end = np.minimum(np.minimum(fits, place + min(self.most, len(n))), following)
        return np.maximum(np.where(alone > 0, place + 1, end), place + 1)

    def reach(self, v: list[np.ndarray]) -> np.ndarray:
        """Characters behind each row that an open run could take at most."""
        n, room, alone = v
        total = np.cumsum(n + self.separator)
        first = np.flatnonzero(alone[:1] if alone[0] else alone)
        return total[: min(int(np.searchsorted(total, room[0], "right")), int(first[0]) if len(first) else len(n))]

    def taken(self, reach: np.ndarray, v0: list[int], open_: tuple) -> int:
        """How many of the next rows the open run takes."""
        return min(int(np.searchsorted(reach, v0[1] - open_[0], "right")), max(self.most - open_[1], 0))

    def opened(self, v: list[np.ndarray], start: int, before: tuple | None) -> tuple:
        """What is open behind all rows: a run from ``start``, or the one from before."""
        if before is None and v[2][start]:
            return (0, self.most)  # takes nothing more
        size = int((v[0][start:] + self.separator).sum())
        return (size - self.separator, len(v[0]) - start) if before is None else (before[0] + size, before[1] + len(v[0]))


class Anchored:
    """Windows of ``span``, each from the first value that the one before doesn't hold. Values: a rising number. Open: its start."""

    def __init__(self, span: int):
        self.span = span

    def ends(self, v: list[np.ndarray]) -> np.ndarray:
        return np.maximum(np.searchsorted(v[0], v[0] + self.span, "left"), np.arange(1, len(v[0]) + 1))

    def reach(self, v: list[np.ndarray]) -> np.ndarray:
        return v[0][: int(np.searchsorted(v[0], v[0][0] + self.span, "left"))]

    def taken(self, reach: np.ndarray, v0: list[int], open_: tuple) -> int:
        return int(np.searchsorted(reach, open_[0] + self.span, "left"))

    def opened(self, v: list[np.ndarray], start: int, before: tuple | None) -> tuple:
        return (int(v[0][start]),) if before is None else before


def summary(rule: Packed | Anchored, v: list[np.ndarray]) -> dict:
    """What a block does to any open run: (runs that follow, what is open at the end) for every place where that run may end."""
    reach, ends, n = rule.reach(v), rule.ends(v).tolist(), len(v[0])
    runs, last = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        runs[i] = runs[ends[i]] + 1
        last[i] = last[ends[i]] if ends[i] < n else i
    whole = {s: rule.opened(v, s, None) for s in {last[i] for i in range(min(len(reach) + 1, n))}}
    size = int((v[0] + rule.separator).sum()) if isinstance(rule, Packed) else 0
    return {"n": n, "reach": reach, "first": [int(x[0]) for x in v], "size": size, "after": [(runs[i], whole[last[i]]) for i in range(min(len(reach) + 1, n))]}


def passed(rule: Packed | Anchored, s: dict, state: tuple | None) -> tuple:
    """(number of the last run, what is open) behind a summarised block, from the same before it."""
    if state is None:
        runs, open_ = s["after"][0]
        return runs - 1, open_
    number, open_ = state
    p = rule.taken(s["reach"], s["first"], open_)
    if p >= s["n"]:
        return number, ((open_[0] + s["size"], open_[1] + s["n"]) if isinstance(rule, Packed) else open_)
    runs, after = s["after"][p]
    return number + runs, after


def replayed(rule: Packed | Anchored, v: list[np.ndarray], state: tuple | None) -> tuple[np.ndarray, tuple]:
    """(number of each row's run, state behind the rows)."""
    n, number = len(v[0]), -1 if state is None else state[0]
    at = 0 if state is None else rule.taken(rule.reach(v), [int(x[0]) for x in v], state[1])
    ends, starts = rule.ends(v).tolist(), []
    while at < n:
        starts.append(at)
        at = ends[at]
    new = np.zeros(n, dtype=np.int64)
    new[starts] = 1
    numbers = number + np.cumsum(new)
    open_ = rule.opened(v, starts[-1], None) if starts else rule.opened(v, 0, state[1])
    return numbers, (int(numbers[-1]), open_)


def changes(batch: pa.RecordBatch, keys: int) -> list[int]:
    """Rows of a batch whose key is another than that of the row before; nulls are equal."""
    found = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
    for c in batch.columns[:keys]:
        a, b = c.slice(0, max(len(c) - 1, 0)), c.slice(1)
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        found |= differs.to_numpy(zero_copy_only=False).astype(bool)
    return (np.flatnonzero(found) + 1).tolist()


def pieces(batches: Iterator[pa.RecordBatch], keys: int, values: slice) -> Iterator[tuple[pa.RecordBatch, tuple, list[np.ndarray]]]:
    """(rows, key, values) of the runs of equal key in each batch."""
    for batch in batches:
        cuts = [0, *changes(batch, keys), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                part = batch.slice(a, b - a)
                yield part, tuple(c[0].as_py() for c in part.columns[:keys]), [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in part.columns[values]]


def numbered(rows: DataFrame, keys: list[str], order: list[str], values: list[str], rule: Packed | Anchored, name: str, weight: Column | None = None) -> DataFrame:
    """``rows`` with ``name``: the number (from 0) of each row's run within its key, in the order of ``order``.

    Rows of equal key and order lie in any order. ``values`` are whole numbers, not null. A key whose
    rows count more than ``MOST_OF_KEY`` (a row counts 1, or its ``weight``) is folded by many tasks.
    """
    size = F.count("*") if weight is None else F.sum(weight)
    large = written(rows.groupBy(*keys).agg(size.alias("_size")).where(F.col("_size") > MOST_OF_KEY).select(*[F.col(c).alias(f"_{c}") for c in keys]))
    if large.isEmpty():
        return folded_by_key(rows, keys, order, values, rule, name)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    small = folded_by_key(rows.join(F.broadcast(large), same, "left_anti"), keys, order, values, rule, name)  # of n rows at most n / MOST_OF_KEY are keys of large
    return small.unionByName(folded_in_blocks(rows.join(F.broadcast(large), same, "left_semi"), keys, order, values, rule, name))


def laid_first(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return rows.select(*keys, *values, *[c for c in rows.columns if c not in (*keys, *values)])


def folded_by_key(rows: DataFrame, keys: list[str], order: list[str], values: list[str], rule: Packed | Anchored, name: str) -> DataFrame:
    """As ``numbered``; the rows of a key are folded by one task, batch after batch."""
    laid = laid_first(rows, keys, values).repartition(*keys).sortWithinPartitions(*keys, *order)
    k, own = len(keys), slice(len(keys), len(keys) + len(values))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = [0, *changes(batch, k), batch.num_rows]
            v = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[own]]
            numbers = np.zeros(batch.num_rows, dtype=np.int64)
            first = tuple(c[0].as_py() for c in batch.columns[:k])
            state = state if first == last else None
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a and b - a == 1 and b < batch.num_rows:
                    continue  # the only row of its key
                numbers[a:b], state = replayed(rule, [x[a:b] for x in v], state if not a else None)
            last = tuple(c[batch.num_rows - 1].as_py() for c in batch.columns[:k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int32())], [*batch.schema.names, name])

    return laid.mapInArrow(fold, f"{kinds(laid.schema)}, `{name}` int").select(*rows.columns, name)


def kinds(fields: Iterable[StructField]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def folded_in_blocks(rows: DataFrame, keys: list[str], order: list[str], values: list[str], rule: Packed | Anchored, name: str) -> DataFrame:
    """As ``numbered``; the rows of a key are folded by many tasks."""
    laid = kept_in_place(laid_first(rows, keys, values).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order))
    laid = laid.withColumn("_task", F.spark_partition_id())
    k, own = len(keys), slice(len(keys), len(keys) + len(values))
    fields = [f for f in laid.schema if f.name != "_task"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, head, current, held, s = None, None, None, [], None
        for part, key, v in pieces(batches, k, own):
            task = part.column(part.num_columns - 1)[0].as_py()
            if current is not None and key != current:
                if s is None:
                    s = summary(rule, [np.concatenate(c) for c in zip(*held, strict=True)])
                held = []
            head = key if current is None else head
            current = key
            held.append(v)
        if current is not None:
            v = [np.concatenate(c) for c in zip(*held, strict=True)]
            only = s is None
            s = summary(rule, v) if only else s
            row = (head, s, None if only else (current, replayed(rule, v, None)[1]))
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([pickle.dumps(row)], pa.binary())], ["task", "seen"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            tasks, states = [], []
            for task, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head, s, last = pickle.loads(seen)
                before = state if key == head else None
                if before is not None:
                    tasks.append(task)
                    states.append(pickle.dumps(before))
                key, state = (head, passed(rule, s, before)) if last is None else last
            yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.int32()), pa.array(states, pa.binary())], ["task", "state"])

    seen = laid.select(*keys, *values, "_task").mapInArrow(first, "task int, seen binary")
    entered = seen.repartition(1).sortWithinPartitions("task").mapInArrow(scan, "task int, state binary")
    states = {r.task: pickle.loads(r.state) for r in entered.collect()}  # at most one a task

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, begun = None, None, False
        for part, key, v in pieces(batches, k, own):
            if not begun:
                state, begun = states.get(part.column(part.num_columns - 1)[0].as_py()), True
            elif key != current:
                state = None
            current = key
            numbers, state = replayed(rule, v, state)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(numbers, pa.int32())], [*part.schema.names[:-1], name])

    return laid.mapInArrow(second, f"{kinds(fields)}, `{name}` int").select(*rows.columns, name)
