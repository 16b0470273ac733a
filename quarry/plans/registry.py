"""Every query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import chunking, corpus, operations, records

QUERIES = chunking.QUERIES | corpus.QUERIES | operations.QUERIES | records.QUERIES
ORACLE_SQL = chunking.ORACLE_SQL | corpus.ORACLE_SQL | operations.ORACLE_SQL | records.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks of all documents, counted and measured per source."""
    return QUERIES["chunk_counts"](spark, sf_dir)
