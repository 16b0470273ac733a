"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, components.

Equal vectors of a label form a class; one representative of each goes on. In every table, a
representative's bucket is the sign pattern of its products with random hyperplanes. Buckets are
compared within tasks, block against block, by exact cosines in double precision. A task returns
for each vector the number of vectors linked in this bucket (a pair counts only in the first table
where it meets) and its local component: never the pairs themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, table
from quarry.llm.components import components

#: Probability that a pair just at the threshold meets in no table.
MISS = 1e-5
BLOCK = 512
MOST_BITS = 24


def tables_for(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(hyperplanes per table, tables): buckets stay small as n grows, the miss probability as set."""
    bits = max(6, min(MOST_BITS, math.ceil(math.log2(max(n, 2))) - 5))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def lists(column: pa.Array) -> list[np.ndarray | None]:
    """The numbers of each list as float64; None for null lists and lists with nulls."""
    out = []
    for x in column:
        v = x.values
        out.append(None if v is None or v.null_count else v.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0)
    return out


def packed(v: np.ndarray) -> bytes:
    """A vector as 32-bit floats if these hold it exactly, else as 64-bit floats; the first byte tells which."""
    with np.errstate(over="ignore"):
        short = v.astype("<f4")
    return b"4" + short.tobytes() if (short == v).all() else b"8" + v.astype("<f8").tobytes()


def units(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length 1 in double precision, padded with zeros; their widths) from packed ones."""
    widths = np.array([(len(u) - 1) // int(u[:1]) for u in column], dtype=np.int64)
    x = np.zeros((len(column), widths.max(initial=0)))
    kinds = np.array([(len(u), u[0]) for u in column]).reshape(-1, 2)
    for size, kind in np.unique(kinds, axis=0).tolist():
        own = np.flatnonzero((kinds == (size, kind)).all(axis=1))
        flat = np.frombuffer(b"".join([column[i][1:] for i in own]), "<f4" if kind == ord("4") else "<f8")
        x[own, : widths[own[0]]] = flat.reshape(len(own), -1)
    x /= np.abs(x).max(axis=1, initial=0.0, keepdims=True)  # no overflow or underflow of the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], widths


def prepared(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, print (of label and vector), unit (packed vector); print is null for vectors that link with nothing."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, vectors = [], []
            for label, v in zip(batch.column(1).to_pylist(), lists(batch.column(2)), strict=True):
                top = np.abs(v).max(initial=0.0) if v is not None else 0.0
                if label is None or not 0 < top < np.inf:
                    prints.append(None)
                    vectors.append(None)
                else:
                    prints.append(hashlib.blake2b(v.tobytes(), digest_size=16, key=hashlib.blake2b(label.encode("utf-8", "surrogatepass"), digest_size=32).digest()).digest())
                    vectors.append(packed(v))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "label", "print", "unit"])

    return rows.mapInArrow(run, f"vec_id {kind}, label string, print binary, unit binary")


def hashed(reps: DataFrame, bits: int, tables: int, vectors: bool = True, seed: int = 3) -> DataFrame:
    """(key, at, rep, m, unit, signs): one row per table; key is the bucket, signs the bits of all tables.

    Without ``vectors`` only the keys.
    """
    kind = reps.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            x, sizes = units(batch.column("unit").to_pylist())
            positive = np.empty((len(x), tables * bits), dtype=bool)
            for d in np.unique(sizes):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, tables * bits))
                own = np.flatnonzero(sizes == d)
                positive[own] = (x[own, :d] @ planes[d]) > 0
            sign = positive.reshape(len(x), tables, bits) @ (1 << np.arange(bits))
            take = pa.array(np.repeat(np.arange(len(x)), tables))
            own = [pa.array(np.tile(np.arange(tables, dtype=np.int32), len(x))), pa.array(sign.ravel().astype(np.int32)), pa.array(np.repeat(sizes, tables).astype(np.int32)), batch.column("label").take(take)]
            names = ["at", "sign", "dim", "label"]
            if vectors:
                all_signs = pa.array([row.tobytes() for row in np.packbits(positive, axis=1)], pa.binary())
                own += [*[batch.column(c).take(take) for c in ("rep", "m", "unit")], all_signs.take(take)]
                names += ["rep", "m", "unit", "signs"]
            yield pa.RecordBatch.from_arrays(own, names)

    rows = reps.select("label", "rep", "m", "unit").mapInArrow(run, "at int, sign int, dim int, label string" + (f", rep {kind}, m long, unit binary, signs binary" if vectors else ""))
    return rows.select(F.xxhash64("label", "dim", "at", "sign").alias("key"), *(["at", "rep", "m", "unit", "signs"] if vectors else []))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        new = root.copy()
        least = np.minimum(root[a], root[b])
        for end in (a, b):
            np.minimum.at(new, end, least)
            np.minimum.at(new, root[end], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def links_in_buckets(dealt: DataFrame, threshold: float, bits: int, tables: int) -> DataFrame:
    """(rep, add, low) per vector and block: linked vectors that first meet here, smallest of its local component.

    ``dealt`` (key, p, q, i, at, rep, m, unit, signs) is sorted within its partitions.
    """
    kind = dealt.schema["rep"].dataType.simpleString()

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        key, p, q, i = (t.column(c).to_numpy() for c in ("key", "p", "q", "i"))
        rep, m, at = (t.column(c).to_numpy() for c in ("rep", "m", "at"))
        order = np.lexsort((rep, i, q, p, key))
        key, p, q, i, rep, m, at = (x[order] for x in (key, p, q, i, rep, m, at))
        vectors, coded = t.column("unit").to_pylist(), t.column("signs").to_pylist()
        x = units([vectors[k] for k in order])[0]
        positive = np.unpackbits(np.frombuffer(b"".join([coded[k] for k in order]), np.uint8).reshape(len(order), -1), axis=1, count=tables * bits)
        signs = positive.reshape(len(order), tables, bits) @ (1 << np.arange(bits))
        group = np.cumsum(np.append(0, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
        a, b = [], []
        for shift in range(1, int(np.bincount(group).max())):
            left = np.flatnonzero(group[shift:] == group[:-shift])
            left = left[(p[left] == q[left]) | (i[left] != i[left + shift])]
            for s in range(0, len(left), 65536):
                part = left[s : s + 65536]
                ok = np.einsum("ij,ij->i", x[part], x[part + shift]) >= threshold
                a.append(part[ok])
                b.append(part[ok] + shift)
        if not a or not len(a := np.concatenate(a)):
            return None
        b = np.concatenate(b)
        differ = rep[a] != rep[b]
        a, b = a[differ], b[differ]
        earlier = np.arange(signs.shape[1]) < at[a][:, None]
        first = ~((signs[a] == signs[b]) & earlier).any(axis=1)
        add = np.bincount(a[first], weights=m[b[first]], minlength=len(rep)) + np.bincount(b[first], weights=m[a[first]], minlength=len(rep))
        root = local_roots(len(rep), a, b)
        low = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(low, root, rep.astype(np.int64))
        some = np.unique(np.concatenate([a, b]))
        return pa.RecordBatch.from_arrays([pa.array(rep[some].astype(np.int64)), pa.array(add[some].astype(np.int64)), pa.array(low[root[some]])], ["rep", "add", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            ends = [batch.column(c).to_numpy() for c in ("key", "p", "q")]
            same = np.ones(batch.num_rows, dtype=bool)
            for x in ends:
                same &= x == x[-1]
            begin = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0  # of the last group
            if begin == 0:
                before = [c[-1].as_py() for c in (kept[-2].column(k) for k in ("key", "p", "q"))] if len(kept) > 1 else None
                if before is None or before == [x[-1].item() for x in ends]:
                    continue  # one group so far
            whole = pa.Table.from_batches([*kept[:-1], batch.slice(0, begin)])
            kept = [batch.slice(begin)]
            if whole.num_rows and (out := compare(whole)) is not None:
                yield out
        if kept and (out := compare(pa.Table.from_batches(kept))) is not None:
            yield out

    return dealt.mapInArrow(run, f"rep {kind}, add long, low {kind}" if kind == "bigint" else "rep long, add long, low long")


def near_embeddings(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; ids are 64-bit integers.

    Only vectors of equal, non-null labels and equal width are compared. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing and stay. Rows with equal
    vectors are linked copies of each other, repeated rows too. A pair at the threshold is missed
    with probability ``miss``. Other columns are ignored; an empty table gives an empty table.
    """
    rows = cut(prepared(df, id_col, vector_col, label_col))
    reps = cut(rows.where("print is not null and vec_id is not null").groupBy("label", "print").agg(F.count("*").alias("m"), F.min(F.struct("vec_id", "unit")).alias("x")).select("label", "print", "m", F.col("x.vec_id").alias("rep"), F.col("x.unit").alias("unit")))
    n = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0  # the largest label fills the largest buckets
    bits, tables = tables_for(n, threshold, miss)
    # Keys alone are grouped first: only vectors that meet another one are sent, once a table.
    sizes = cut(hashed(reps, bits, tables, vectors=False).groupBy("key").count().where("count > 1"))
    members = hashed(reps, bits, tables).join(sizes, "key").withColumn("n", F.ceil(F.col("count") / BLOCK).cast("int")).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    dealt = members.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("key", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "at", "rep", "m", "unit", "signs")
    found = cut(links_in_buckets(dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q"), threshold, bits, tables))
    links = found.groupBy("rep").agg(F.sum("add").alias("add"))
    labelled = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    classes = reps.select("print", "rep", "m").join(links, "rep", "left").join(labelled.withColumnRenamed("node", "rep"), "rep", "left")
    classes = cut(classes.select("print", (F.col("m") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = rows.select("vec_id", "print").join(classes, "print", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings of equal label at a cosine of 0.93."""
    return near_embeddings(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(node, component) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.component FROM reach r JOIN links l ON l.a = r.node),
c AS (SELECT node, min(component) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
