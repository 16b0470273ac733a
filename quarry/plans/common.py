"""The tables as the engine sees them, and the registering of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, text, doc_id, lang, source."""
    return table(spark, sf_dir, "documents").withColumn("source_file", F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt")))


def registering() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """(queries, oracle SQL, decorator that adds a function and its SQL under the function's name)."""
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


DOCS = "docs AS (SELECT source || '/doc-' || doc_id || '.txt' AS source_file, text, doc_id, lang, source FROM documents)"
#: Windows of 1000 characters at stride 800, a last one under 300 merged into the one before.
CHUNKS = (
    DOCS
    + r""", sized AS (SELECT source_file, text, doc_id, lang, source, length(text) AS len, (CASE WHEN length(text) <= 0 THEN 0 ELSE 1 + greatest(0, ceil((length(text) - 1000) / 800.0)) END)::INT AS c FROM docs WHERE regexp_matches(text, '\S')),
merged AS (SELECT *, c - (CASE WHEN c > 1 AND len - (c - 1) * 800 < 300 AND 1000 + len - (c - 1) * 800 - 200 <= 6000 THEN 1 ELSE 0 END) AS n FROM sized),
chunks AS (SELECT source_file, doc_id, lang, source, i::INT AS chunk_index, CASE WHEN i = n - 1 THEN substring(text, i * 800 + 1) ELSE substring(text, i * 800 + 1, 1000) END AS content FROM merged, unnest(range(n)) t(i))"""
)
