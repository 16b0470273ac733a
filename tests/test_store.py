"""Verification by digests, tables of many versions, and calls of a model."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions.models import Calls, model_embedding
from quarry.operators import maintenance as M
from quarry.operators import store as S


def test_tables_are_compared_as_multisets(spark):
    schema = "id int, v array<double>, w string"
    rows = [(i, [float(i), None] if i % 3 else [float(i)], None if i % 2 else "x") for i in range(300)] + [(1, [1.0, None], None)] * 2
    before = spark.createDataFrame(rows, schema)
    assert S.verify_rebuild(before, spark.createDataFrame(rows[::-1], schema).repartition(7)).count() == 0
    changed = [r for r in rows if r[0] != 7] + [(8, [8.0, None], "x"), (9, [9.0, None], None), (4, [4.0], "x")]
    changed.remove((4, [4.0, None], "x"))
    changed.remove((1, [1.0, None], None))
    got = sorted((r.side, r.id, tuple(r.v), r.w) for r in S.verify_rebuild(before, spark.createDataFrame(changed, schema)).collect())
    assert got == [("after", 4, (4.0,), "x"), ("after", 8, (8.0, None), "x"), ("after", 9, (9.0, None), None), ("before", 1, (1.0, None), None), ("before", 4, (4.0, None), "x"), ("before", 7, (7.0, None), None)]


def test_equal_tables_are_not_joined(spark, tmp_path):
    spark.range(2000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("props"), F.lit("v").alias("vec")).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert S.verify_chunks(t, t).count() == 0
    other = t.withColumn("props", F.when(F.col("id") == 5, "p").otherwise(F.col("props"))).where("id <> 6").union(t.where("id = 7")).union(t.where("id = 8").withColumn("id", F.lit(5000).cast("long")))
    want = {(5, "property"), (6, "missing"), (7, "duplicate"), (5000, "unexpected")}
    assert {tuple(r) for r in S.verify_chunks(t, other).collect()} == want
    assert {tuple(r) for r in S.verify_chunks(t, other, exact=False).collect()} == want - {(5000, "unexpected")}


def test_many_versions_are_one_scan(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "source_file string, chunk_index int, content string"
    for n in range(6):
        S.write_chunks(spark.createDataFrame([(f"d{n % 3}", 0, f"v{n}"), (f"d{n % 3} (part 1)", 0, f"p{n}")], schema), path, names=spark.createDataFrame([(f"d{n % 3}",)], "source_file string"))
    now = S.read_chunks(spark, path, spark.createDataFrame([], schema).schema)
    assert {(r.source_file, r.content) for r in now.collect()} == {x for n in (3, 4, 5) for x in ((f"d{n % 3}", f"v{n}"), (f"d{n % 3} (part 1)", f"p{n}"))}
    plan = now._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation") <= 3
    then = S.read_chunks(spark, path, now.schema, 1)
    assert {r.content for r in then.collect()} == {"v0", "p0", "v1", "p1"}


def test_a_model_is_asked_once_for_each_text(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def fn(texts):
        calls.add(len(texts))
        return [[float(len(t)), time.time() % 1] for t in texts]  # never the same twice

    chunks = spark.createDataFrame([(f"d{i}", 0, "x" * i) for i in range(100)], "source_file string, chunk_index int, content string")
    sessions = spark.createDataFrame([("s", "News", False)], "session string, collection string, stale boolean")
    M.reembed_collection(str(tmp_path / "t"), "News", chunks, sessions, model_embedding(fn), 2)
    assert calls.value == 100


def test_only_slow_items_are_asked_again():
    asked: dict = {}
    lock, running, most = threading.Lock(), [0], [0]

    def fn(items):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
            for i in items:
                asked[i] = asked.get(i, 0) + 1
        time.sleep(0.02)
        with lock:
            running[0] -= 1
        return [TimeoutError("slow") if i == 7 and asked[i] < 3 or i == 13 else -i for i in items]

    got = list(Calls(fn, 4, 3).stream(list(range(40)), 3))
    assert [x for i, x in enumerate(got) if i != 13] == [-i for i in range(40) if i != 13] and isinstance(got[13], TimeoutError)
    assert {i: n for i, n in asked.items() if n > 1} == {7: 3, 13: 3} and 1 < most[0] <= 3


def test_a_batch_that_times_out_is_asked_item_by_item():
    asked: dict = {}

    def fn(items):
        for i in items:
            asked[i] = asked.get(i, 0) + 1
        if 2 in items:
            raise TimeoutError("slow")
        return [-i for i in items]

    got = Calls(fn, 4, 3).answers([0, 1, 2, 3])
    assert got[:2] + got[3:] == [0, -1, -3] and isinstance(got[2], TimeoutError) and asked == {0: 2, 1: 2, 2: 3, 3: 2}

    def broken(items):
        raise ValueError("no model")

    with pytest.raises(ValueError):
        Calls(broken, 4, 3).answers([1])
