"""Exact top-k search by inner product over a vector-approximation file.

Vectors are turned into integers. Their approximations hold, for every dimension, one of 64 cells
between fixed edges; a scan of the cells bounds every product from below and above. A vector can be
among a query's k best only if its upper bound reaches the k-th best lower bound. Exact vectors
are then read in the order of their upper bounds, until the k-th exact score is no smaller than the
next bound: a first few of each query, then all whose bound still reaches its k-th score.

Vectors and queries meet in blocks: every block of queries is sent to every block of vectors once,
with the bounds that a first block of vectors gave.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import cut, table
from quarry.llm.embedding_dedup import lists

CELLS = 64
#: Vectors and queries of one block.
VECTORS, QUERIES = 8192, 1024
#: Exact vectors read per query before the rest is looked at.
FIRST = 24
#: What integers and scores must lie within.
LIMIT = 1 << 63
#: Products of doubles count as inexact by this share of the sum of their sizes.
SLACK = 2.0**-48


def integers(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (packed int64): floor(scale * x); vectors that take no part are left out. Beyond 64 bits is an error."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id is not null")
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if x is None or not np.isfinite(x).all() else whole(scale, x).tobytes() for x in lists(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["vec_id", "v"])

    return rows.mapInArrow(run, f"vec_id {kind}, v binary").where("v is not null")


def whole(scale: int, x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = np.floor(scale * x)
    if np.abs(v).max(initial=0.0) >= LIMIT:
        raise OverflowError("a component is beyond 64 bits")
    return v.astype("<i8")


def matrix(column: list[bytes] | pd.Series, width: int) -> np.ndarray:
    """Rows of packed integers; shorter vectors count as padded with zeros."""
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, x in enumerate(column):
        out[i, : len(x) // 8] = np.frombuffer(x, "<i8")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices; one beyond 64 bits is an error."""
    size = np.abs(a.astype(np.float64)) * np.abs(b.astype(np.float64))
    out = (a * b).sum(axis=1)
    for i in np.flatnonzero(size.sum(axis=1) >= 2.0**62):  # in 64 bits these could run over
        exact = sum(x * y for x, y in zip(a[i].tolist(), b[i].tolist(), strict=True))
        if not -LIMIT <= exact < LIMIT:
            raise OverflowError("a score is beyond 64 bits")
        out[i] = exact
    return out


def cell_edges(vectors: DataFrame) -> np.ndarray:
    """Edges (dimension, CELLS + 1) from each dimension's mean, deviation, least and greatest value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(0).to_pylist()
            if not packed or not (width := max(map(len, packed)) // 8):
                continue
            x = matrix(packed, width).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, float(len(x)))), pa.array(x.sum(0)), pa.array((x * x).sum(0)), pa.array(x.min(0)), pa.array(x.max(0))], ["d", "n", "s", "q", "lo", "hi"])

    stats = vectors.select("v").mapInArrow(run, "d int, n double, s double, q double, lo double, hi double")
    rows = stats.groupBy("d").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")], F.min("lo"), F.max("hi")).orderBy("d").collect()  # one row per dimension
    edges = []
    for _, n, s, q, lo, hi in rows:
        mean, dev = s / n, math.sqrt(max(q / n - (s / n) ** 2, 0.0))
        lo, hi = min(lo, 0.0), max(hi, 0.0)  # shorter vectors are zero here
        inner = np.floor(np.linspace(max(lo, mean - 4 * dev), min(hi, mean + 4 * dev), CELLS + 1)[1:-1])
        edges.append(np.concatenate([[lo], np.clip(inner, lo, hi), [hi]]))
    return np.array(edges).reshape(-1, CELLS + 1)


def approximations(vectors: DataFrame, edges: np.ndarray) -> DataFrame:
    """vec_id, cells: one byte per dimension."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1).to_pylist(), len(edges))
            cells = np.stack([np.searchsorted(e[1:-1], x[:, d], side="left") for d, e in enumerate(edges)], axis=1).astype(np.uint8) if len(edges) else np.zeros((len(x), 0), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in cells], pa.binary())], ["vec_id", "cells"])

    return vectors.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, cells binary")


def candidates(queries: DataFrame, cells: DataFrame, edges: np.ndarray, k: int, blocks: int, of: tuple[int, int]) -> DataFrame:
    """(query_id, vec_id, low, high): what each block of vectors cannot rule out.

    ``queries``: vec_id, v, b (block), bound (the k-th best lower bound known so far, or null);
    ``cells``: vec_id, cells, c (block, from the first to the last in ``of``). Each block of vectors
    meets all ``blocks`` blocks of queries.
    """
    left = queries.withColumn("c", F.explode(F.sequence(F.lit(of[0]).cast("long"), F.lit(of[1]).cast("long"))))
    right = cells.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    low_edge, high_edge = edges[:, :-1].copy(), edges[:, 1:].copy()
    kind = queries.schema["vec_id"].dataType.simpleString()

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = [[], [], [], []]
        if len(q) and len(x):
            width = len(low_edge)
            cell = np.frombuffer(b"".join(x["cells"]), np.uint8).reshape(len(x), width)
            d = np.arange(width)
            lo, hi = low_edge[d, cell].T, high_edge[d, cell].T
            far = np.maximum(np.abs(lo), np.abs(hi))
            ids, own = x["vec_id"].to_numpy(), q["vec_id"].to_numpy()
            known = q["bound"].to_numpy(dtype=np.float64, na_value=-np.inf)
            known = np.where(np.isnan(known), -np.inf, known)
            values = matrix(q["v"], width).astype(np.float64)
            for s in range(0, len(q), 128):
                plus, minus = np.maximum(values[s : s + 128], 0), np.minimum(values[s : s + 128], 0)
                slack = SLACK * ((plus - minus) @ far)
                high, low = plus @ hi + minus @ lo + slack, plus @ lo + minus @ hi - slack
                self_at = own[s : s + 128, None] == ids[None, :]
                low[self_at] = high[self_at] = -np.inf
                kth = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(low), -np.inf)
                kth = np.maximum(kth, known[s : s + 128])
                r, col = np.nonzero((high >= kth[:, None]) & (high > -np.inf))
                for o, y in zip(out, (own[s : s + 128][r], ids[col], low[r, col], high[r, col]), strict=True):
                    o.append(y)
        return pd.DataFrame({n: np.concatenate(o) if o else np.empty(0, np.int64 if i < 2 else float) for i, (n, o) in enumerate(zip(("query_id", "vec_id", "low", "high"), out, strict=True))})

    return left.groupBy("c", "b").cogroup(right.groupBy("c", "b")).applyInPandas(run, f"query_id {kind}, vec_id {kind}, low double, high double")


def scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` with the exact product."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("q").to_pylist(), batch.column("v").to_pylist()
            width = max(map(len, [*a, *b]), default=0) // 8
            s = products(matrix(a, width), matrix(b, width))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    both = pairs.join(vectors, "vec_id").join(vectors.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return both.select("query_id", "vec_id", "q", "v").mapInArrow(run, f"query_id {kind}, vec_id {kind}, score long")


def top_k(df: DataFrame, k: int = 5, scale: int = 256, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of every row whose id is divisible by ``every``.

    Ties go to the smaller vec_id. Null vectors, and those with null or non-finite components, take
    no part, nor do rows without id; of rows that repeat an id one counts, whatever its place, and a
    row is never its own answer. Integers and scores are exact; one beyond 64 bits is an error.
    Other columns are ignored; an empty table gives an empty table.
    """
    all_rows = cut(integers(df, scale, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")))
    # Of equal vectors only the k + 1 smallest ids can be among anyone's k best.
    useful = all_rows.withColumn("_n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= k + 1).drop("_n")
    vectors = cut(useful)
    edges = cell_edges(vectors)
    queries = all_rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    parts, blocks = max(1, math.ceil(vectors.count() / VECTORS)), max(1, math.ceil(queries.count() / QUERIES))
    queries = cut(queries.withColumn("b", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))))
    cells = cut(approximations(vectors, edges).withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(parts))))
    best = W.partitionBy("query_id")

    def kth_low(found: DataFrame) -> DataFrame:
        ranked = found.withColumn("_n", F.row_number().over(best.orderBy(F.desc("low"), "vec_id")))
        return ranked.where(F.col("_n") <= k).groupBy("query_id").agg(F.count("*").alias("_n"), F.min("low").alias("bound")).where(F.col("_n") == k).select("query_id", "bound")

    # What a first block of vectors shows bounds what the others send.
    found = cut(candidates(queries.withColumn("bound", F.lit(None).cast("double")), cells.where("c = 0"), edges, k, blocks, (0, 0)))
    if parts > 1:
        told = queries.join(kth_low(found).withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
        found = found.unionByName(cut(candidates(told, cells.where("c > 0"), edges, k, blocks, (1, parts - 1))))
    alive = cut(found.join(kth_low(found), "query_id", "left").where("bound is null or high >= bound").select("query_id", "vec_id", "high"))
    lead = alive.withColumn("_n", F.row_number().over(best.orderBy(F.desc("high"), "vec_id"))).where(F.col("_n") <= FIRST)
    first = cut(scores(lead, all_rows))
    kth = first.withColumn("_n", F.row_number().over(best.orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") == k).select("query_id", F.col("score").alias("kth"))
    rest = alive.join(kth, "query_id", "left").where("kth is null or high >= kth").join(first.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")
    every_score = first.unionByName(scores(rest, all_rows))
    out = every_score.withColumn("rank", F.row_number().over(best.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every 50th embedding against all others."""
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
