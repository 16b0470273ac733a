"""Product codes of vectors with exact integer distances, by limb-split matrix products.

Components become integers and vectors are cut into equal parts; every part position has a codebook.
Products of parts with codebook entries are computed by BLAS in float64: integers are broken into
limbs small enough that a sum of limb products stays below 2**53, where float64 is exact; the
products are put together in int64, and the first least distance wins. Codebooks are small (entries
times dimensions) and travel with each pass; tasks return sums per entry, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, table, unused
from quarry.llm.whitening import integers, matrix

#: Vectors of one matrix product.
ROWS = 2048
#: Bytes of label totals that are broadcast; more are joined over salted labels.
MOST_BYTES, SALTS = 32 << 20, 32


def limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 arrays with a = sum of limb[j] * 2**(bits * j); all but the last lie in [0, 2**bits), the last is below 2**bits in size."""
    out = []
    while np.abs(a).max(initial=0) >= 1 << bits:
        out.append((a & ((1 << bits) - 1)).astype(np.float64))
        a = a >> bits
    return [*out, a.astype(np.float64)]


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products (parts, rows, entries) of int64 arrays (parts, rows, width) and (parts, entries, width) whose sums fit 63 bits."""
    bits = (53 - max(x.shape[2] - 1, 1).bit_length()) // 2
    right = [b.transpose(0, 2, 1) for b in limbs(c, bits)]
    out = np.zeros((x.shape[0], x.shape[1], c.shape[1]), dtype=np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            out += (a @ b).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance), each (parts, rows): the nearest entry of every part, the first of equal ones."""
    apart = np.einsum("pkw,pkw->pk", books, books)[:, None, :] - 2 * dots(x, books)
    best = apart.argmin(axis=2)
    return best, np.take_along_axis(apart, best[:, :, None], 2)[:, :, 0] + np.einsum("prw,prw->pr", x, x)


def in_parts(column: pa.Array, parts: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, (parts, rows, width)) of blocks of packed vectors."""
    for a in range(0, len(column), ROWS):
        part = column.slice(a, ROWS)
        x = matrix(part, parts * width, 0)
        if parts * width * (2.0 * np.abs(x).max(initial=0)) ** 2 >= 2.0**62:
            raise OverflowError("distances beyond 64 bits")
        yield a, np.ascontiguousarray(x.reshape(len(part), parts, width).transpose(1, 0, 2))


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: every used entry is the floor of its parts' mean. One pass, one row per entry and task shuffled."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, most = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64), 0.0
        for batch in batches:
            for _, x in in_parts(batch.column(0), parts, width):
                most += np.abs(x).max(initial=0) * float(x.shape[1])
                if most >= 2.0**62:
                    raise OverflowError("sums beyond 64 bits")
                at = (nearest(x, books)[0] + np.arange(parts)[:, None] * entries).ravel()
                np.add.at(sums, at, x.reshape(-1, width))
                counts += np.bincount(at, minlength=parts * entries)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts * entries, dtype=np.int32)), pa.array(counts), *[pa.array(sums[:, w]) for w in range(width)]], ["entry", "n", *[f"s{w}" for w in range(width)]])

    names = ["n", *[f"s{w}" for w in range(width)]]
    found = rows.select("x").mapInArrow(run, "entry int, " + ", ".join(f"{c} long" for c in names)).groupBy("entry").agg(*[F.sum(c).alias(c) for c in names]).where("n > 0")
    new = books.reshape(-1, width).copy()
    for r in found.collect():  # one row per entry
        new[r[0]] = [s // r[1] for s in r[2:]]
    return new.reshape(books.shape)


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` with code (two hex digits a part) and error (squared distance to the entries) in place of x. Narrow."""
    parts, _, width = books.shape
    kept = [f for f in rows.schema if f.name != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("x")
            for a, x in in_parts(batch.column(at), parts, width):
                best, apart = nearest(x, books)
                text = best.T.astype(np.uint8).tobytes().hex()
                codes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                own = [c.slice(a, len(codes)) for i, c in enumerate(batch.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*own, pa.array(codes, pa.string()), pa.array(apart.sum(0), pa.int64())], [*[f.name for f in kept], "code", "error"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", code string, error long")


def with_totals(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over equal ``key`` (nulls together).

    Totals are joined back: broadcast where they are few bytes, else over salted keys, so that no
    task gets all rows of a frequent key.
    """
    salt, own, total = unused(rows, "_salt", "_key", "_total")
    totals = cut(rows.groupBy(F.col(key).alias(own)).agg(F.sum(value).alias(total)))
    size = totals.agg(F.sum(F.coalesce(F.octet_length(F.col(own).cast("string")), F.lit(0)) + 32)).first()[0] or 0
    if size <= MOST_BYTES:
        joined = rows.join(F.broadcast(totals), F.col(key).eqNullSafe(F.col(own)), "left")
    else:
        spread = totals.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = rows.withColumn(f"{salt}l", F.floor(F.rand(13) * SALTS).cast("int"))
        joined = left.join(spread, F.col(key).eqNullSafe(F.col(own)) & (F.col(f"{salt}l") == F.col(salt)), "left")
    return joined.select(*rows.columns, F.col(total).alias(name))


def product_codes(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row per vector that takes part.

    Null vectors and those with null or non-finite components are dropped. Vectors shorter than the
    longest count as filled up with zeros, as do all up to a multiple of ``parts``. Codebooks start
    from the vectors of the ``entries`` smallest ids (null ids never; of equal ids by value; fewer
    rows: fewer entries; none: one entry of zeros). Null and repeated ids stay, each row by itself; other columns are
    ignored, whatever their names. An empty table gives no rows. Distances beyond 64 bits are an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code holds one byte a part")
    rows = cut(integers(df, scale, 0, id_col, vector_col, label_col).withColumnRenamed("m0", "label"))
    longest = (rows.agg(F.max(F.octet_length("x"))).first()[0] or 0) // 8
    width = max(1, -(-longest // parts))
    first = rows.where("vec_id is not null").orderBy("vec_id", "x").limit(entries).select("x").toArrow().column(0).combine_chunks().cast("binary")
    books = next(in_parts(first, parts, width), (0, np.zeros((parts, 1, width), np.int64)))[1]
    for _ in range(rounds):
        books = refined(rows, books)
    spelt = ",".join(map(str, books.ravel().tolist()))
    found = with_totals(cut(coded(rows, books)), "label", "error", "label_error")
    return found.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(spelt.encode()).hexdigest()).alias("codebooks_sha256"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every embedding."""
    return product_codes(table(spark, sf_dir, "embeddings"))


def _round(i: int) -> str:
    """Assignment to codebook ``i`` and the codebook after it."""
    return f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, part, x, arg_min(k, d * 64 + k) AS k, min(d) AS d FROM (
    SELECT p.vec_id, p.part, p.x, c.k, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.c[i]) * (p.x[i] - c.c[i])))::BIGINT AS d
    FROM p JOIN c{i} c ON p.part = c.part)
  GROUP BY vec_id, part, x
), c{i + 1} AS MATERIALIZED (
  SELECT c.part, c.k, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (
    SELECT part, k, list(v ORDER BY i) AS c FROM (
      SELECT part, k, i, floor(sum(x[i]) / count(*))::BIGINT AS v FROM a{i}, range(1, len(x) + 1) t(i) GROUP BY part, k, i)
    GROUP BY part, k) m ON c.part = m.part AND c.k = m.k
)"""


ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, part, list_slice(e, part * (len(e) // 16) + 1, (part + 1) * (len(e) // 16)) AS x FROM v, range(16) t(part)
), c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, x AS c FROM p QUALIFY k < 64
),{_round(0)},{_round(1)},{_round(2)}, h AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM c2
), f AS (
  SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN v USING (vec_id), h
"""
