"""Exact interpolated percentiles of groups of any size.

A small group is sorted by one task. Of a large one only counts and sketches travel: a sketch gives an
equi-depth histogram, counts say exactly in which of its ranges a wanted rank lies, and the values
strictly within that range go on to the next round, a small share of the ones before. When few
enough are left they are sorted. No task ever holds a large group's values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.written import written

#: Values that one task sorts, and ranges of a histogram.
SMALL, RANGES = 1_000_000, 200


def selected(values: DataFrame, targets: DataFrame, small: int) -> DataFrame:
    """(t, v): the value of each target's rank (from 0) among its group's.

    ``values``: g, v (not null); ``targets``: t, g, rank, few.
    """
    found = None
    while True:
        grid = F.percentile_approx("v", [i / RANGES for i in range(RANGES + 1)], 100 * RANGES)
        edges = values.groupBy("g").agg(grid.alias("_e"), F.count("*").alias("_n"))
        at = F.floor((F.col("rank") + 0.5) / F.col("_n") * RANGES).cast("int")
        told = F.broadcast(targets.join(edges, "g").select("t", "g", "rank", F.element_at("_e", F.greatest(at, F.lit(1))).alias("_lo"), F.element_at("_e", F.least(at + 3, F.lit(RANGES + 1))).alias("_hi")))
        met = values.join(told, "g")

        def number(rule: Column) -> Column:
            return F.sum(F.when(rule, 1).otherwise(0))

        v, lo, hi = F.col("v"), F.col("_lo"), F.col("_hi")
        counts = met.groupBy("t", "rank", "_lo", "_hi").agg(number(v < lo).alias("below"), number(v == lo).alias("at_lo"), number((v > lo) & (v < hi)).alias("between"), number((v == hi) & (lo < hi)).alias("at_hi"))
        rest = F.col("rank") - F.col("below")
        place = F.when((rest >= 0) & (rest < F.col("at_lo")), "lo").when((rest >= F.col("at_lo")) & (rest < F.col("at_lo") + F.col("between")), "between").when((rest >= 0) & (rest < F.col("at_lo") + F.col("between") + F.col("at_hi")), "hi").otherwise("outside")
        judged = counts.select("t", "_lo", "_hi", (rest - F.col("at_lo")).alias("_rank"), "between", place.alias("place")).collect()  # a row for each target
        if any(r.place == "outside" for r in judged):
            raise ArithmeticError("a sketch of values was less exact than it says")
        spark = values.sparkSession
        ends = [(r.t, r["_lo"] if r.place == "lo" else r["_hi"]) for r in judged if r.place != "between"]
        out = spark.createDataFrame(ends, "t long, v double")
        found = out if found is None else found.union(out)
        going = [r for r in judged if r.place == "between"]
        if not going:
            return found
        brackets = F.broadcast(spark.createDataFrame([(r.t, r["_lo"], r["_hi"]) for r in going], "t long, _lo double, _hi double"))
        owners = F.broadcast(targets.select("t", "g"))
        inside = values.join(owners, "g").join(brackets, "t").where("v > _lo and v < _hi").select(F.col("t").alias("g"), "v")
        values = written(inside)
        targets = spark.createDataFrame([(r.t, r.t, r["_rank"]) for r in going], "t long, g long, rank long")
        if max(r.between for r in going) <= small:
            order = F.row_number().over(W.partitionBy("g").orderBy("v")) - 1
            last = values.withColumn("_at", order).join(F.broadcast(targets), "g").where("_at = rank").select("t", "v")
            return found.union(last)


def percentiles(df: DataFrame, by: list[str], columns: list[str], shares: list[float], more: list[Column], small: int = SMALL) -> DataFrame:
    """``by``, <column>_p<100 * share> of every column and share, and the aggregates ``more``: a row for each group.

    Percentiles are exact and interpolated between the two nearest values; null without any value.
    Null values are left out; null is a group of its own. Groups over ``small`` rows are few (each holds
    that many), so their numbers are sent to all tasks; their values never meet in one.
    """
    names = [(c, p, f"{c}_p{round(100 * p)}") for c in columns for p in shares]
    own = [F.percentile(c, F.lit(p)).alias(n) for c, p, n in names]
    sizes = written(df.groupBy(*by).agg(*more, *[F.count(c).alias(f"_n{i}") for i, c in enumerate(columns)], F.count("*").alias("_rows")))
    large = sizes.where(F.col("_rows") > small)
    if large.isEmpty():
        return df.groupBy(*by).agg(*more, *own)
    if not by:
        return percentiles(df.withColumn("_all", F.lit(0)), ["_all"], columns, shares, more, small).drop("_all")
    told = F.broadcast(written(large.withColumn("_g", F.monotonically_increasing_id() * len(columns))))
    same = F.lit(True)
    for c in by:
        same = same & df[c].eqNullSafe(told[c])
    few = df.join(told, same, "left_anti").groupBy(*by).agg(*more, *own)
    many = df.join(told.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_g"), _all_equal(df, by), "inner")
    values = many.select(F.explode(F.array(*[F.struct((F.col("_g") + i).alias("g"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("x")).select("x.g", "x.v").where("v is not null")
    places = []
    for r in told.collect():  # large groups only
        for i, _ in enumerate(columns):
            places += [(r["_g"] + i, rank) for p in shares for at in [p * (r[f"_n{i}"] - 1)] for rank in {math.floor(at), math.ceil(at)} if r[f"_n{i}"]]
    places = sorted(set(places))
    spark = df.sparkSession
    targets = spark.createDataFrame([(t, g, rank) for t, (g, rank) in enumerate(places)], "t long, g long, rank long")
    value = {places[r.t]: r.v for r in selected(values, targets, small).collect()} if places else {}  # two for each percentile
    rows = []
    for r in told.collect():
        out = [r["_g"]]
        for c, p, _ in names:
            i = columns.index(c)
            at, g = p * (r[f"_n{i}"] - 1), r["_g"] + i
            low, high = math.floor(at), math.ceil(at)
            out.append(None if not r[f"_n{i}"] else value[g, low] if low == high else (high - at) * value[g, low] + (at - low) * value[g, high])
        rows.append(tuple(out))
    figures = spark.createDataFrame(rows, "_g long, " + ", ".join(f"`{n}` double" for _, _, n in names))
    return few.unionByName(told.join(F.broadcast(figures), "_g").select(*few.columns))


def _all_equal(df: DataFrame, by: list[str]) -> Column:
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & df[c].eqNullSafe(F.col(f"_k{i}"))
    return same
