"""Latency, job, request and audit analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.folds import Anchored, numbered
from quarry.operators.quantiles import SMALL, percentiles

# Upper bounds of the duration histogram in seconds, and cells that a spreadsheet takes for formulas.
BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120, 300]
HOT_CELL = "^[=+\\-@\\t\\r]"


def filter_audit(df: DataFrame, since=None, until=None, **exact: str) -> DataFrame:
    """``since`` inclusive, ``until`` exclusive, other columns equal."""
    out = df
    if since is not None:
        out = out.where(F.col("ts") >= F.lit(since))
    if until is not None:
        out = out.where(F.col("ts") < F.lit(until))
    for name, value in exact.items():
        out = out.where(F.col(name) == value)
    return out


def latency_summary(metrics: DataFrame, by: list[str], columns: list[str], small: int = SMALL) -> DataFrame:
    """Per group: count, and p50, p95, p99 (exact, interpolated) and mean of each column, rounded half-even; zeros without values.

    A group's values are sorted by one task only up to ``small`` rows; larger groups are narrowed down by counts.
    """
    more = [F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in columns]]
    found = percentiles(metrics, by, columns, [0.5, 0.95, 0.99], more, small)
    told = [F.bround(F.coalesce(n, F.lit(0.0)), 1).alias(n) for c in columns for n in (f"{c}_p50", f"{c}_p95", f"{c}_p99", f"{c}_mean")]
    return found.select(*by, "n", *told)


def ingest_counters(events: DataFrame, job: str, flags: dict[str, Column]) -> DataFrame:
    return events.groupBy(job).agg(*[F.sum(c.cast("long")).alias(n) for n, c in flags.items()])


def job_status(files: DataFrame, job: str, failed: Column) -> DataFrame:
    bad = F.sum(failed.cast("int"))
    status = F.when(bad == 0, "completed").when(bad == F.count("*"), "failed").otherwise("partial")
    return files.groupBy(job).agg(status.alias("status"), F.count("*").alias("files"))


def duration_histogram(points: DataFrame, value: str, dims: list[str]) -> DataFrame:
    """dims, bucket (0 to the number of bounds), count, sum."""
    bucket = sum(((F.col(value) > b).cast("int") for b in BOUNDS), F.lit(0))
    return points.groupBy(*dims, bucket.alias("bucket")).agg(F.count("*").alias("count"), F.sum(value).alias("sum"))


def admit_points(points: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Points with all keys and allowed values and a finite, non-negative value; ``partial`` counts as error."""
    out = points.where((F.col("value") >= 0) & ~F.isnan("value") & (F.abs("value") < float("inf")))
    for key, values in allowed.items():
        out = out.where(F.col(key).isin(values))
    return out.withColumn("outcome", F.when(F.col("outcome") == "partial", "error").otherwise(F.col("outcome")))


def request_counters(points: DataFrame, dims: list[str]) -> DataFrame:
    """dims, count, active (sum of the steps in ``delta``), errors (points with an error type)."""
    return points.groupBy(*dims).agg(F.count("*").alias("count"), F.sum(F.coalesce("delta", F.lit(0))).alias("active"), F.count("error_type").alias("errors"))


def errors_by_type(points: DataFrame, dims: list[str]) -> DataFrame:
    return points.where("error_type is not null").groupBy(*dims, "error_type").agg(F.count("*").alias("count"))


def safe_attributes(attributes: Column, allowed: dict[str, list[str]]) -> Column:
    """The map's entries whose key is known and whose value is in its vocabulary, or a 32-digit token."""
    def ok(k: Column, v: Column) -> Column:
        known = F.lit(False)
        for key, values in allowed.items():
            known = known | ((k == key) & (v.isin(values) if values else v.rlike("^[0-9a-f]{32}$")))
        return known

    return F.map_filter(attributes, ok)


def recent_jobs(jobs: DataFrame, now: Column, owner: str | None = None, newest: int = 20, hours: int = 24) -> DataFrame:
    """Running jobs, and the newest finished ones of the last hours, newest start first; a principal sees only its own."""
    own = jobs if owner is None else jobs.where(F.col("owner") == owner)
    running = own.where("status = 'running'")
    done = own.where((F.col("status") != "running") & (F.col("finished") > now - F.expr(f"interval {hours} hours")) & (F.col("finished") <= now))
    best = done.orderBy(F.desc("finished"), "id").limit(newest)
    started = F.coalesce("created_at", "finished") if "created_at" in jobs.columns else F.col("finished")
    return running.unionByName(best).orderBy(started.desc_nulls_last(), "id")


def recent_metrics(metrics: DataFrame, keep: Column, n: int, ring: int = 500) -> DataFrame:
    """Of the last ``ring`` records, those to keep; of these the last n, oldest first."""
    last = metrics.orderBy(F.desc("ts"), F.desc("id")).limit(ring)
    return last.where(keep).orderBy(F.desc("ts"), F.desc("id")).limit(n).orderBy("ts", "id")


def audit_page(df: DataFrame, before: int | None, limit: int) -> DataFrame:
    """A page, newest first, with next_before where more follow."""
    out = df if before is None else df.where(F.col("id") < before)
    page = out.orderBy(F.desc("id")).limit(limit + 1)
    n = F.count("*").over(W.partitionBy(F.lit(1)))  # of limit + 1 rows
    place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("id")))
    low = F.min(F.when(F.col("_p") <= limit, F.col("id"))).over(W.partitionBy(F.lit(1)))
    return page.withColumn("_n", n).withColumn("_p", place).withColumn("next_before", F.when(F.col("_n") > limit, low)).where(F.col("_p") <= limit).drop("_n", "_p")


def csv_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(c.rlike(HOT_CELL), F.concat(F.lit("'"), c)).otherwise(c)


def classify_requests(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """``requests`` (method, path) with the template that matches, its parameters by name, and the first of them.

    Templates are split by method and number of path parts, so the match is an equi join. What is not
    a parameter is compared as it is written.
    """
    parts, names = F.split("template", "/"), r"^\{([^}]+)\}$"
    t = templates.select("method", "template", F.size(parts).alias("_parts"), parts.alias("_t"))
    out = requests.withColumn("_p", F.split("path", "/")).withColumn("_parts", F.size("_p")).join(t, ["method", "_parts"])
    both = F.arrays_zip(F.col("_t").alias("t"), F.col("_p").alias("p"))
    named = F.filter(both, lambda x: x["t"].rlike(names))
    fits = F.forall(both, lambda x: F.when(x["t"].rlike(names), x["p"] != "").otherwise(x["t"] == x["p"]))
    values = F.transform(named, lambda x: F.struct(F.regexp_extract(x["t"], names, 1).alias("key"), x["p"].alias("value")))
    out = out.where(fits).withColumn("parameters", F.map_from_entries(values)).withColumn("parameter", F.get(values, F.lit(0))["value"])
    return out.drop("_p", "_parts", "_t")


def collapse_failed_logins(events: DataFrame, seconds: int = 60) -> DataFrame:
    """key, first, count, last: the first failure of a key opens a window; later ones within it are counted.

    ``events``: key, ts (seconds). Windows are anchored at their first failure, so where one begins
    depends on all before it: times are counted per second first, and then folded in blocks, so that
    one key's times are worked on by all tasks. Null times are left out; a null key is a key.
    """
    counted = events.where("ts is not null").groupBy("key", F.col("ts").cast("long").alias("ts")).agg(F.count("*").alias("n"))
    rows = numbered(counted, ["key"], ["ts"], ["ts"], Anchored(seconds), "window")
    out = rows.groupBy("key", "window").agg(F.min("ts").alias("first"), (F.sum("n") - 1).cast("int").alias("count"), F.max("ts").alias("last"))
    return out.select("key", "first", "count", "last")
