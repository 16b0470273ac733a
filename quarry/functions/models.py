"""The two places where a user's model is called."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed_words(dims: int = 64) -> Callable[[Column], Column]:
    """A deterministic embedding by hashed words, JVM-side: the stand-in where no model is given."""

    def embed(c: Column) -> Column:
        words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        at = F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(dims)).cast("int"))
        zero = F.array_repeat(F.lit(0.0), dims)
        return F.aggregate(at, zero, lambda acc, i: F.transform(acc, lambda v, k: F.when(k == i, v + 1.0).otherwise(v)))

    return embed


class Calls:
    """Calls of a model for the items of a task: in small batches, several at a time, answers in order.

    Only items that time out are asked again, each at most ``tries`` times in all. A function tells of them by an
    instance of TimeoutError in an item's place; where it raises TimeoutError for a whole batch,
    its items are asked one by one, so that a slow one doesn't repeat the others. Any other error ends the task.
    """

    def __init__(self, fn: Callable[[list], list], batch: int, tries: int):
        self.fn, self.batch, self.tries = fn, batch, tries

    def answers(self, items: list) -> list:
        """One answer an item; a TimeoutError where it never came."""
        out: list = [TimeoutError("never asked")] * len(items)
        groups, used = [list(range(len(items)))], 0
        while groups and used < self.tries:
            used += 1
            slow: list[list[int]] = []
            for group in groups:
                try:
                    found = self.fn([items[i] for i in group])
                except TimeoutError as e:
                    found = [e] * len(group)
                    slow += [[i] for i in group]
                else:
                    if len(found) != len(group):
                        raise ValueError(f"{len(found)} answers to {len(group)} items")
                    again = [i for i, x in zip(group, found, strict=True) if isinstance(x, TimeoutError)]
                    slow += [again] if again else []
                for i, x in zip(group, found, strict=True):
                    out[i] = x
            groups = slow
        return out

    def stream(self, items: list, window: int) -> Iterator:
        """Answers to all items in their order; at most ``window`` batches are asked at once."""
        parts = [items[i : i + self.batch] for i in range(0, len(items), self.batch)]
        with ThreadPoolExecutor(window) as pool:
            open_: deque = deque()
            for part in parts:
                if len(open_) == window:
                    yield from open_.popleft().result()
                open_.append(pool.submit(self.answers, part))
            while open_:
                yield from open_.popleft().result()


def model_embedding(fn: Callable[[list[str]], list[list[float]]], batch: int = 10, retries: int = 2, window: int = 4) -> Callable[[Column], Column]:
    """A column function that embeds in small batches, at most ``window`` of a task at a time; see ``Calls``.

    A text that times out is asked again ``retries`` times, and then stops the job. A null text is
    embedded as an empty one. ``fn`` must bear being called by several threads if ``window`` is over one.
    """

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        calls = Calls(fn, batch, retries + 1)
        for s in series:
            out = []
            for x in calls.stream(s.fillna("").tolist(), window):
                if isinstance(x, TimeoutError):
                    raise x
                out.append(x)
            yield pd.Series(out)

    return run


def ask(df: DataFrame, fn: Callable[[str, str], str], system: str, column: str) -> DataFrame:
    """``df`` with reply and note; after three failures in a row a task stops calling."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", reply string, note string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failures = 0
        for g in batches:
            replies, notes = [], []
            for text in g[column]:
                reply = None
                for _ in range(2):
                    if failures >= 3:
                        break
                    try:
                        reply, failures = fn(system, text), 0
                        break
                    except Exception:
                        failures += 1
                replies.append(reply)
                notes.append(None if reply is not None else "llm-unavailable")
            yield g.assign(reply=replies, note=notes)

    return df.mapInPandas(run, schema)
