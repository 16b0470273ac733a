"""Failed logins as a stream, out of order, against the batch operator."""

import random

from pyspark.sql import functions as F

from quarry.operators import analytics as A
from quarry.streaming import streams


def test_out_of_order_logins_are_the_batch_ones(spark, tmp_path):
    rng = random.Random(1)
    times = sorted((rng.choice("abc"), 1000 + rng.randint(0, 600)) for _ in range(120))
    batches = [[r for r in times if 1000 + 200 * i <= r[1] < 1200 + 200 * i] for i in range(3)] + [[r for r in times if r[1] >= 1600]]
    late = [("a", 1390), ("b", 1395), ("a", 1399)]  # after later ones of its key, within the watermark's delay
    batches[2] += late

    def put(rows, n):
        frame = spark.createDataFrame(rng.sample(rows, len(rows)), "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put(batches[0], 0)
    source = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    q = streams.stream_failed_logins(source, 60, "5 minutes").writeStream.format("memory").queryName("late_logins").outputMode("append").start()
    try:
        q.processAllAvailable()
        for n, rows in enumerate([*batches[1:], [("other", 90_000)]], 1):
            put(rows, n)
            q.processAllAvailable()
        assert spark.sql("select * from late_logins where key in ('a', 'b', 'c')").count() > 0  # keys without new rows
    finally:
        q.stop()
    got = sorted(tuple(r) for r in spark.sql("select key, first, count, last from late_logins").collect())
    every = spark.createDataFrame(times + late, "key string, ts long")
    assert got == sorted(tuple(r) for r in A.collapse_failed_logins(every, 60).collect())
