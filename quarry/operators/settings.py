"""Ingest and retrieval settings: their bounds, and what holds where none are saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names and bounds of settings, and their defaults.
STRATEGIES = ("fixed", "overlap", "language", "context_aware", "semantic")
MODES = ("hnsw", "flat", "hybrid", "semantic")
FORMATS = ("end_user", "engineer")
INGEST = {"chunking_strategy": "overlap", "chunk_size": 1000, "chunk_overlap": 200, "similarity_threshold": None, "min_chunk_size": 100}
RETRIEVAL = {"retrieval_mode": "hnsw", "top_k": 5, "alpha": 0.75, "ef": None, "response_format": "end_user"}
LEAST_EF, MOST_EF = 16, 512


def outside(name: str, low: float | None, high: float | None, optional: bool = False) -> Column:
    """The setting's name if its value is null (unless optional), not a number or out of bounds."""
    c = F.col(name)
    bad = F.isnan(c.cast("double"))
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    return F.when(F.lit(False) if optional else c.isNull(), name).when(c.isNotNull() & bad, name)


def unknown(name: str, allowed: tuple[str, ...]) -> Column:
    return F.when(F.col(name).isNull() | ~F.col(name).isin(*allowed), name)


def validate_ingest_settings(df: DataFrame) -> DataFrame:
    """``df`` with violations: the settings out of bounds, and overlap where it isn't smaller than the size."""
    windows = F.col("chunking_strategy").isin("overlap", "language")
    rule = F.when(windows & (F.col("chunk_overlap") >= F.col("chunk_size")), "overlap")
    found = [unknown("chunking_strategy", STRATEGIES), outside("chunk_size", 50, 6000), outside("chunk_overlap", 0, None), outside("similarity_threshold", 0, 1, True), outside("min_chunk_size", 0, 6000), rule]
    return df.withColumn("violations", F.array_compact(F.array(*found)))


def validate_retrieval_settings(df: DataFrame) -> DataFrame:
    """``df`` with violations, and ef cleared to null where it is an integer out of bounds (``cleared_ef`` keeps it)."""
    legacy = F.col("ef").isNotNull() & (F.col("ef") == F.floor("ef")) & ((F.col("ef") < LEAST_EF) | (F.col("ef") > MOST_EF))
    out = df.withColumn("cleared_ef", F.when(legacy, F.col("ef"))).withColumn("ef", F.when(~F.coalesce(legacy, F.lit(False)), F.col("ef")))
    whole = F.when(F.col("ef").isNotNull() & (F.isnan(F.col("ef").cast("double")) | (F.col("ef") != F.floor("ef"))), "ef")
    found = [unknown("retrieval_mode", MODES), outside("top_k", 1, 50), outside("alpha", 0, 1), whole, unknown("response_format", FORMATS)]
    return out.withColumn("violations", F.array_compact(F.array(*found)))


def resolve_settings(collections: DataFrame, saved: DataFrame, defaults: dict) -> DataFrame:
    """collection, the settings and is_default of every collection: what is saved over the defaults.

    A null or absent field of a saved row has its default; a collection without a row has all of them.
    """
    fields = [f for f in defaults if f in saved.columns]
    s = saved.select("collection", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_saved"))
    out = collections.select("collection").join(s, "collection", "left")
    held = [F.coalesce(F.col(f"_{f}"), F.lit(defaults[f])).alias(f) if f in fields else F.lit(defaults[f]).alias(f) for f in defaults]
    return out.select("collection", *held, F.col("_saved").isNull().alias("is_default"))
