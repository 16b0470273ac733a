"""Small literal cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import analytics as A
from quarry.operators import chunking as C
from quarry.operators import cleaning as K
from quarry.operators import evaluation as G
from quarry.operators import retrieval as R
from quarry.operators import store as S
from quarry.plans import corpus
from quarry.sources import files as IO
from quarry.streaming import streams


def one(spark, value, f):
    return spark.range(1).select(f(F.lit(value)).alias("x")).first().x


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "source_file string, text string")


def test_normalise(spark):
    assert one(spark, "﻿a\r\nb\rc\x00\x7f\té", T.normalise_text) == "a\nb\nc\té"


def test_flatten(spark):
    text = '{"bill":{"number":"HR 1","sponsors":["A","B"]},"actions":[{"date":"2025-01-03"}],"n":1.50,"e":1e3,"o":{},"l":[],"z":null,"t":true}'
    want = "bill.number: HR 1\nbill.sponsors: A, B\nactions[0].date: 2025-01-03\nn: 1.50\ne: 1e3\nz: null\nt: true"
    assert one(spark, text, IO.flatten_json) == want


def test_overlap_rebuilds_the_text(spark):
    for text, size, overlap in (("x" * 10000, 1000, 200), ("z" * 1020, 1000, 10), ("line of text\n" * 600, 500, 100)):
        got = [r.content for r in C.chunk_overlap(docs(spark, text), size, overlap).orderBy("chunk_index").collect()]
        assert got[0] + "".join(c[overlap:] for c in got[1:]) == text
    assert C.chunk_overlap(docs(spark, " \n\t", None, "")).count() == 0


def test_scores(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    c = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id long, vector array<double>")
    assert [(r.id, r.score) for r in R.near_vector(q, c, 2, "dot").orderBy("rank").collect()] == [(1, 2.0), (2, 0.0)]
    assert [(r.id, r.score) for r in R.near_vector(q, c, 2, "l2-squared").orderBy("rank").collect()] == [(1, 0.5), (3, 0.5)]
    assert R.near_vector(q, c, 1).first().score == 1.0


def recall(got, want):
    """Mean and least share of each query's true hits that were found."""
    shares = [len(set(got.get(q, [])) & set(ids)) / len(ids) for q, ids in want.items()]
    return sum(shares) / len(shares), min(shares)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_approximate_search_finds_the_true_hits(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = sorted(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {int(i): ids[np.lexsort((ids, -np.round(u @ x, 12)))[:10]].tolist() for i, x in zip(ids, u, strict=True) if i % 50 == 0}
    got = {}
    for r in corpus.near_vector_approx(spark, d).collect():
        got.setdefault(r.query_id, []).append(r.id)
    mean, least = recall(got, want)
    print(sf, len(want), "queries, recall", round(mean, 3), "least", least)
    assert set(got) == set(want) and mean >= 0.9


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_exact_search_asks_with_every_50th_id(spark, metric):
    d = "/root/testdata/sf0.1"
    rows = sorted(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True) if metric == "cosine" else v
    score = {"cosine": lambda x: u @ x, "dot": lambda x: u @ x, "l2": lambda x: 1 / (1 + ((u - x) ** 2).sum(1))}[metric]
    want = {int(i): np.sort(score(x))[::-1][:10] for i, x in zip(ids, u, strict=True) if i % 50 == 0}
    got = {}
    for r in getattr(corpus, f"near_vector_{metric}")(spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.score)
    assert set(got) == set(want) and len(want) == 40
    assert all(np.allclose(got[q], want[q], atol=2e-6) for q in want)


def test_approximate_search_ignores_odd_vectors(spark):
    rows = [(0, None), (1, []), (2, [1.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [1.0, 0.0]), (6, [0.9, 0.1]), (7, [-1.0, 0.0])]
    c = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    got = R.near_vector_approx(c.select(F.col("id").alias("query_id"), "vector"), c, 2, tables=40).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {5, 6, 7} and [r.id for r in got if r.query_id == 5] == [5, 6]
    assert R.near_vector_approx(c.where("id < 5").selectExpr("id as query_id", "vector"), c.where("id < 2"), 2).count() == 0


def test_approximate_search_forms_only_pairs_that_share_a_key(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    plan = R.near_vector_approx(asked, rows, 10)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    formed = R.candidate_pairs(asked, rows).select("query_id", "id")
    share = formed.distinct().count() / (40 * 2000)
    assert 0.3 < share < 0.45 and formed.count() / (40 * 2000) < 0.65  # nearly uniform vectors: most of the cost is theirs


def test_approximate_search_of_clusters_and_copies(spark):
    """Vectors in tight clusters, a third of all of them equal: few pairs are formed and the hits are the true ones."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 32))
    v = np.concatenate([np.repeat(centres[:1], 1000, 0), (centres[rng.integers(0, 60, 2000)] + 0.15 * rng.standard_normal((2000, 32)))]).astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>").cache()
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = {i: np.lexsort((np.arange(3000), -np.round(u @ u[i], 12)))[:10].tolist() for i in range(0, 3000, 50)}
    got = {}
    own = {"bits": 12, "tables": 12, "probes": 2}
    for r in R.near_vector_approx(asked, rows, 10, block=64, **own).collect():  # buckets dealt as blocks
        got.setdefault(r.query_id, []).append(r.id)
    assert recall(got, want)[0] >= 0.95 and all(len(g) == 10 for g in got.values())
    useful = rows.where("id < 10 or id >= 1000")
    share = R.candidate_pairs(asked, useful, block=64, **own).select("query_id", "id").distinct().count() / (60 * 2010)
    assert share < 0.15
    same = R.candidate_pairs(asked, useful, block=10**6, **own).select("query_id", "id").distinct()
    assert same.exceptAll(R.candidate_pairs(asked, useful, block=64, **own).select("query_id", "id").distinct()).count() == 0


@pytest.mark.parametrize("alpha", [0.0, 0.3, 1.0])
def test_hybrid_on_a_grid_of_blocks(spark, monkeypatch, alpha):
    """Few queries at the chunks, or both dealt in blocks: the rows that all pairs and all hits give."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)]
    chunks = [(i, " ".join(rng.choice(words, 6)), rng.standard_normal(5).tolist() if i % 9 else [0.0] * 5) for i in range(300)]
    asked = [(i, " ".join(rng.choice(words, 4)), rng.standard_normal(5).tolist()) for i in range(12)]
    c = spark.createDataFrame(chunks, "id long, content string, vector array<double>")
    q = spark.createDataFrame(asked, "query_id long, question string, vector array<double>")
    keys = {(r.query_id, r.id): r.score for r in R.keyword_scores(q.drop("vector"), c.drop("vector")).collect()}
    want = []
    for i, _, v in asked:
        near = {j: float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)) for j, _, x in chunks if any(x)}
        own = {j: keys[i, j] for j, _, _ in chunks if (i, j) in keys}
        low, high, blow, bhigh = min(near.values()), max(near.values()), min(own.values()), max(own.values())
        mixed = {j: alpha * ((near[j] - low) / (high - low) if j in near else 0) + (1 - alpha) * ((own[j] - blow) / (bhigh - blow) if j in own else 0) for j in near.keys() | own.keys()}
        want += [(i, round(s, 6)) for s in sorted(mixed.values(), reverse=True)[:7]]
    for most in (R.MOST_BYTES, 200):
        monkeypatch.setattr(R, "MOST_BYTES", most)
        got = [(r.query_id, round(r.score, 6)) for r in R.hybrid(q, c, alpha, 7).orderBy("query_id", "rank").collect()]
        assert got == want


def test_parts(spark):
    for name, base in (("a.txt", "a.txt"), ("a.txt (part 1)", "a.txt"), ("a.txt (part 01)", "a.txt (part 01)"), ("a.txt (part 2) (part 1)", "a.txt (part 2)")):
        assert one(spark, name, T.base_of) == base


def test_failed_logins(spark):
    rows = [("a", t) for t in (0, 10, 59, 60, 61)] + [("b", 5)]
    got = A.collapse_failed_logins(spark.createDataFrame(rows, "key string, ts long")).orderBy("key", "first").collect()
    assert [tuple(r) for r in got] == [("a", 0, 2, 59), ("a", 60, 1, 61), ("b", 5, 0, 5)]


def test_percentiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "v double")
    assert A.latency_summary(df, [], ["v"]).select("v_p50", "v_p99").first() == (2.5, 9.8)


def test_removals(spark):
    lines = K.document_lines(docs(spark, "\n".join(["keep this line"] * 20 + ["12"]), "x" * 201 + "\nshort"))
    decisions = spark.createDataFrame([("d0", 20), ("d1", 0)], "source_file string, line int")
    got = {r.source_file: (r.removed_chars, r.fallback) for r in K.apply_removals(lines, decisions).collect()}
    assert got == {"d0": (3, None), "d1": (0, "removed-long-line")}


def test_no_chunk_over_the_cap(spark):
    got = C.cap_length(spark.createDataFrame([("d", 0, "word " * 3000)], "source_file string, chunk_index int, content string")).collect()
    assert max(len(r.content) for r in got) <= T.MOST_CHUNK and [r.chunk_index for r in got] == list(range(len(got)))


def test_sample_ignores_partitioning(spark):
    ids = spark.range(1, 161).select(F.lpad(F.lower(F.hex("id")), 32, "0").alias("uuid_hex"))
    assert len({tuple(r.uuid_hex for r in G.sample_chunks(ids.repartition(n), 10, 7).collect()) for n in (1, 7, 64)}) == 1


def test_replace_is_idempotent(spark):
    now = spark.createDataFrame([("a.txt", 1), ("a.txt (part 1)", 2), ("b.txt", 3)], "source_file string, v int")
    fresh = spark.createDataFrame([("a.txt", 9)], "source_file string, v int")
    once = S.replace_documents(now, fresh)
    assert sorted(map(tuple, S.replace_documents(once, fresh).collect())) == sorted(map(tuple, once.collect())) == [("a.txt", 9), ("b.txt", 3)]


def test_json_lines(spark):
    rows = [("a", 1, '{"x": 1}'), ("a", 2, ""), ("a", 3, "{}"), ("b", 1, "{}}"), ("c", 1, '{"x": NaN}'), ("d", 1, "[1]"), ("d", 2, "")]
    got = IO.jsonl_quality(spark.createDataFrame(rows, "source_file string, line long, record string")).orderBy("source_file").collect()
    assert [tuple(r) for r in got] == [("a", 2, "blank line"), ("b", 1, "invalid JSON"), ("c", 1, "not a number")]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\n\ntwo")
    got = IO.read_text_documents(spark, str(tmp_path / "in")).first()
    assert (got.source_file, got.source_type, got.text) == ("a.txt", "txt", "one\n\ntwo")
    chunks = spark.sql("select 'i' id, array(cast(1.5 as float)) vector, named_struct('content','c','source_file','f','source_type','txt','chunk_index',0,'chunk_strategy','fixed','chunk_size',1,'chunk_overlap',0,'created_at','t') properties, 's' source_sha256")
    IO.write_chunk_package(chunks, str(tmp_path / "package"))
    again = IO.read_chunk_package(spark, str(tmp_path / "package"))
    assert again.where("_corrupt_record is null").drop("_corrupt_record").collect() == chunks.collect()


def test_stream_latency_counts_all(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3).alias("ts"), F.lit("m").alias("mode"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "m"))
    stream = streams.stream_latency(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "m")))
    q = stream.writeStream.format("memory").queryName("latency").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from latency").first()[0] == 100


def test_stream_ingest_replaces(spark, tmp_path):
    docs(spark, "a" * 1500).withColumn("seq", F.lit(1)).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("source_file string, text string, seq int").parquet(str(tmp_path / "in"))
    q = streams.stream_ingest(source, str(tmp_path / "t"), str(tmp_path / "c"))
    q.processAllAvailable()
    docs(spark, "b" * 500).withColumn("seq", F.lit(2)).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "t") + "/version=1").collect()
    assert [r.content for r in got] == ["b" * 500]
