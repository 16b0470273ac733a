import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions.text import distance, score
from quarry.operators import cleaning, nearest
from quarry.operators import retrieval as R

METRICS = ["cosine", "dot", "l2-squared"]


def all_pairs(q, c, k, metric):
    """The search as one row a pair, scored by column functions."""
    d = distance(F.col("_q"), F.col("vector"), metric)
    pairs = q.withColumnRenamed("vector", "_q").crossJoin(c).withColumn("distance", d).withColumn("score", score(F.col("distance"), metric))
    return R.top_k(pairs.select("query_id", "id", "distance", "score"), k)


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("most", [R.MOST_BYTES, 3000])
def test_nearest_are_those_of_all_pairs(spark, monkeypatch, metric, most):
    """Odd vectors of every kind, copies, scaled copies and ties: the same rows to the last bit."""
    rng = np.random.default_rng(2)
    v = [x.tolist() for x in rng.standard_normal((300, 5))]
    v += [v[3]] * 60 + [(np.array(v[4]) * 2.0**i).tolist() for i in range(20)] + [(np.array(v[5]) * (1 + i / 7)).tolist() for i in range(20)] + [[0.0] * 5] * 15
    v += [rng.integers(-1, 2, 5).astype(float).tolist() for _ in range(80)]
    v += [None, [], [1.0], [1.0] * 6, [1.0, None, 0.0, 0.0, 2.0], [float("nan")] * 5, [float("inf"), 1.0, 0.0, 0.0, 0.0], [float("-inf"), 1.0, 0.0, 0.0, 0.0], [1e200] * 5, [1e-200] * 5, [-0.0] * 5]
    order = rng.permutation(len(v))
    c = spark.createDataFrame([(int(i), v[j]) for i, j in enumerate(order)], "id long, vector array<double>").cache()
    q = c.where("id % 3 = 0").select(F.col("id").alias("query_id"), "vector").unionByName(c.where(F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e100)) | F.col("vector").isNull() | (F.size("vector") != 5)).selectExpr("id + 1000 as query_id", "vector"))
    monkeypatch.setattr(R, "MOST_BYTES", most)
    monkeypatch.setattr(nearest, "TILE", 2000)
    for k, chunks in ((7, c), (30, c), (7, c.where("id < 9"))):
        got = R.near_vector(q, chunks, k, metric).orderBy("query_id", "rank").collect()
        want = all_pairs(q, chunks, k, metric).orderBy("query_id", "rank").collect()
        assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]


@pytest.mark.parametrize("metric", METRICS)
def test_pairs_cost_a_product_each(metric):
    """Twenty million pairs of 64 numbers in one task: an expression a pair took more than a minute."""
    rng = np.random.default_rng(3)
    x = list(rng.standard_normal((20_000, 64)))
    started = time.process_time()
    near = nearest.Nearest(pd.DataFrame({"query_id": range(1000), "vector": x[:1000], "of": ""}), 10, metric)
    for at in range(0, 20_000, 5000):
        near.see(pd.DataFrame({"id": range(at, at + 5000), "vector": x[at : at + 5000], "of": ""}))
    assert len(near.rows()) == 10_000 and time.process_time() - started < 20


def test_keyword_scores_are_counted_in_rows(spark, monkeypatch):
    """Blocks of a bounded size; more asked terms than fit a list give the same scores."""
    texts = ["sun moon sun", "Sea", None, "", "moon sea star", "x y z", "sun"] * 5
    c = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    q = spark.createDataFrame([(0, "sun moon"), (1, "sea sun sun"), (2, "none"), (3, None)], "query_id long, question string")
    want = sorted(map(tuple, R.keyword_scores(q, c).collect()))
    monkeypatch.setattr(R, "MOST_DEALT", 3)
    assert R.keyword_scores(q, c).rdd.getNumPartitions() >= 12
    monkeypatch.setattr(R, "MOST_WORDS", 1)
    assert sorted(map(tuple, R.keyword_scores(q, c).collect())) == want and len(want) == 35


def test_hybrid_looks_up_few_pairs(spark, monkeypatch):
    """The k best by keyword set the bound too, so that most other hits need no vector."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, 12)), rng.standard_normal(8).tolist()) for i in range(2000)]
    c = spark.createDataFrame(rows, "id long, content string, vector array<double>").cache()
    q = spark.createDataFrame([(i, " ".join(rng.choice(words, 20)), rng.standard_normal(8).tolist()) for i in range(4)], "query_id long, question string, vector array<double>")
    sizes = []
    keep = R.written
    monkeypatch.setattr(R, "written", lambda df: sizes.append((set(df.columns), (out := keep(df)).count())) or out)
    assert R.hybrid(q, c, 0.5, 5).count() == 20
    pairs = [n for names, n in sizes if names == {"query_id", "id", "b"}]
    assert max(pairs) > 7000 and pairs[-1] < max(pairs) / 3, pairs


def test_equal_lists_of_fields_are_taken_apart_once(spark):
    """Fields keep the order in which they are first seen; a list that many records share is one row before it is taken apart."""
    rows = [("f", 1 + i // 600, i, f"k{i}", ["a", "b"] if i % 3 else ["c", "a", "c"]) for i in range(1000)] + [("g", 1, 0, "x", None), ("h", 1, 0, "y", [])]
    df = spark.createDataFrame(rows, "name string, part int, ordinal long, key string, fields array<string>")
    out = cleaning.label_record_parts(df)
    got = {(r.name, r.part): (r.of, r.records, r.summary) for r in out.collect()}
    assert got["f", 1] == (2, 600, "600 records. Fields: c, a, b. First: k0; last: k599.") and got["f", 2][2].startswith("400 records. Fields: c, a, b.") and len(got) == 4
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    made = plan[plan.index("Generate posexplode") :].split("\n")
    assert any("Aggregate [name" in line and "fields" in line for line in made[:4])


@pytest.mark.parametrize("most", [R.MOST_BYTES, 3000])
def test_shared_patterns_meet_as_products(spark, monkeypatch, most):
    """The rows that scoring every candidate pair gives, odd vectors and copies among them, without a row a pair."""
    rng = np.random.default_rng(4)
    v = [x.tolist() for x in rng.standard_normal((400, 6))]
    v += [v[3]] * 30 + [[0.0] * 6] * 3 + [[1e200] * 6, [1e-200] * 6, [float("nan")] * 6, None, [1.0], [1.0, None, 0.0, 0.0, 2.0, 1.0]]
    c = spark.createDataFrame(list(enumerate(v)), "id long, vector array<double>").cache()
    q = c.where("id % 5 = 0 or id > 425").select(F.col("id").alias("query_id"), "vector")
    monkeypatch.setattr(R, "MOST_BYTES", most)
    monkeypatch.setattr(nearest, "SLICE", 500)
    own = {"bits": 4, "tables": 3, "probes": 2}
    useful = c.where("id <= 3 or id >= 430 or id between 4 and 399 or id between 400 and 408")  # the ten smallest ids of equal vectors
    cosine = F.try_divide(F.aggregate(F.zip_with("_q", "vector", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b), F.col("_m") * F.col("_n"))
    pairs = R.candidate_pairs(q, useful, **own).select("query_id", "id", score(1 - cosine, "cosine").alias("score")).distinct()
    want = sorted(tuple(map(str, r)) for r in R.top_k(pairs, 10).collect())
    found = R.near_vector_approx(q, c, 10, **own, block=7)
    assert sorted(tuple(map(str, r)) for r in found.collect()) == want and len(want) > 700
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and ("MapInPandas" in plan or "CoGroup" in plan)
