"""Operators against brute force and against odd inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import models
from quarry.functions import text as T
from quarry.operators import access as X
from quarry.operators import analytics as A
from quarry.operators import chunking as C
from quarry.operators import evaluation as G
from quarry.operators import maintenance as M
from quarry.operators import retrieval as R
from quarry.operators import store as S
from quarry.plans import corpus, records
from quarry.sources import files as IO
from quarry.streaming import streams

SF = "/root/testdata/sf0.001"


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "source_file string, text string")


def one(spark, value, f):
    return spark.range(1).select(f(F.lit(value)).alias("x")).first().x


def test_first_object_of_a_reply(spark):
    for reply, want in (
        ('{"a":{"b":{"c":1}}}', {"a": {"b": {"c": 1}}}),
        ('{"q":"use } brace","n":1} more', {"q": "use } brace", "n": 1}),
        ('an { object } like ```json\n{"x": [1, {"y": "{"}]}\n``` and {"z": 2}', {"x": [1, {"y": "{"}]}),
    ):
        assert json.loads(one(spark, reply, T.reply_object)) == want
    assert one(spark, "no {object}", T.reply_object) is None and one(spark, None, T.reply_object) is None
    assert one(spark, '{"remove": [3, 1, 1]}', lambda c: T.removal_lines(c, F.lit(3))) == [1, 3]
    assert one(spark, '{"remove": [4]}', lambda c: T.removal_lines(c, F.lit(3))) is None


def test_labels_of_records(spark):
    fields = F.array(*[F.lit(f"f{i}") for i in range(25)])
    got = spark.range(1).select(T.record_summary(F.lit(1234), fields, F.lit("a"), F.lit("b")).alias("s"), T.record_title(F.lit("n" * 200), F.lit(2), F.lit(3)).alias("t"), T.record_title(F.lit(" a  b "), F.lit(1), F.lit(1)).alias("u"), T.record_summary(F.lit(1), F.array().cast("array<string>"), F.lit("a"), F.lit("a")).alias("v")).first()
    assert got.s == "1,234 records. Fields: " + ", ".join(f"f{i}" for i in range(20)) + ", and 5 more. First: a; last: b."
    assert got.t == "n" * 134 + "…, part 2 of 3" and len(got.t) == 149 or len(got.t) <= 150
    assert got.u == "a b" and got.v == "1 record. Fields: none. First: a; last: a."
    for record, want in (('{"a": " x  y "}', "x y"), ('{"a": 1.50}', "1.50"), ('{"a": null}', "record 1,000"), ("[]", "record 1,000"), ("{", "record 1,000"), ('{"a": [1.0, "é"]}', '[1.0,"é"]')):
        assert one(spark, record, lambda c: T.json_record_key(c, F.lit(1000))) == want


def brute_cut(text, most):
    """Reads the rule literally: the last white space from the middle up to just behind the limit."""
    out = []
    while len(text) > most:
        spots = [i for i in range(most // 2, most + 1) if text[i] in " \n\t"]
        at = spots[-1] if spots and spots[-1] > 0 else most
        out.append(text[:at].rstrip())
        text = text[at:].lstrip()
    return [p for p in [*out, text] if p]


def test_long_chunks_are_cut_at_white_space():
    rng = np.random.default_rng(0)
    for _ in range(300):
        text = "".join(rng.choice(list("abcd \n\t"), rng.integers(1, 60), p=[0.2, 0.2, 0.2, 0.15, 0.15, 0.05, 0.05])).strip()
        assert C.cut_long(text, 10) == brute_cut(text, 10)
    assert C.cut_long("a" * 10 + " " + "b" * 5, 10) == ["a" * 10, "b" * 5]


def brute_pieces(text, limit):
    out = []
    while len(text) > limit:
        at = max((i for i in range(1, limit + 1) if text[i] == "\n"), default=0) or max((i for i in range(1, limit + 1) if text[i] in " \t\r"), default=limit)
        out.append(text[:at])
        text = text[at + 1 :] if text[at] in "\n \t\r" else text[at:]
    return [p for p in [*out, text] if p.strip()]


def test_units_are_cut_at_line_ends():
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = "".join(rng.choice(list("abc \n\r"), rng.integers(1, 50), p=[0.25, 0.25, 0.2, 0.15, 0.1, 0.05]))
        assert C.cut_text(text, 9) == brute_pieces(text, 9)
    assert C.cut_text("aaaa\rbbbb", 5) == ["aaaa", "bbbb"] and C.cut_text("ab  cd", 3) == ["ab ", "cd"]


def test_packing_with_and_without_a_shuffle_agree(spark):
    rng = np.random.default_rng(2)
    texts = ["\n".join("w" * n for n in rng.integers(1, 40, 30)) for _ in range(5)]
    rows = docs(spark, *texts, None, "")
    split = rows.where("text <> ''").select("source_file", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    one_way = C.pack_units(split, 100).select("source_file", F.col("part").alias("chunk_index"), "content")
    other = C.packed_texts(rows, lambda t: [x for x in t.split("\n") if x], 100)
    assert sorted(map(tuple, one_way.collect())) == sorted(map(tuple, other.collect()))
    assert C.pack_replay(split, 100).orderBy("source_file").collect() == one_way.groupBy("source_file").agg(F.count("*").alias("chunks")).orderBy("source_file").collect()
    assert C.pack_units(split.limit(0), 100).count() == 0


def test_tables_stand_alone(spark):
    units = spark.createDataFrame([("d", 0, "a", None), ("d", 1, "b", "Text"), ("d", 2, "t", "Table"), ("d", 3, "c", None), ("d", 4, " ", None)], "source_file string, pos int, text string, category string")
    assert [r.content for r in C.chunk_context_aware(units).orderBy("chunk_index").collect()] == ["a b", "t", "c"]
    assert C.pack_replay(units).first().chunks == 3


def test_csv_parts_repeat_their_header(spark):
    rows = [("f", i, [str(i), "x" * 6], f"{i},{'x' * 6}\n", "a,b\n") for i in range(5)] + [("f", 5, ["y" * 30, "z"], "y" * 30 + ",z\n", "a,b\n")]
    units = spark.createDataFrame(rows, "source_file string, pos int, cells array<string>, text string, header string")
    got = [r.content for r in C.pack_parts(units, 24, "csv", "header").orderBy("part").collect()]
    assert all(len(c) <= 24 and c.startswith("a,b\n") for c in got)
    assert "".join(c[4:] for c in got).replace("\n", "").count("y") == 30
    records_ = [r.units for r in C.pack_parts(units.select("source_file", "pos", "text"), 24, "record").orderBy("part").collect()]
    assert sum(records_) == 6


def test_documents_are_split_until_they_are_allowed(spark):
    text = "\n\n".join("p" * 400 for _ in range(60))
    parts, failed = C.split_documents(docs(spark, text, "short", "q" * 25000, None), "overlap", 50, 49)
    rows = parts.collect()
    by = {}
    for r in rows:
        by.setdefault(r.source_file, []).append(r)
    assert failed.count() == 0 and [(r.part, r.of) for r in by["d1"]] == [(0, 1)] and len(by["d0"]) > 1 and len(by["d2"]) > 1
    for name, whole in (("d0", text), ("d2", "q" * 25000)):
        held = [r.text for r in sorted(by[name], key=lambda r: r.part)]
        assert all(len(t) <= 10_049 for t in held) and all(r.of == len(held) for r in by[name])
        assert "".join(held).replace("\n", "") == whole.replace("\n", "")


def test_chunk_rows_are_refused_whole(spark):
    rows, failed = C.chunk_documents(docs(spark, "ab " * 200, "x" * 20_000), "overlap", 50, 49, 0)
    assert {r.source_file for r in failed.collect()} == {"d1"} and {r.source_file for r in rows.select("source_file").distinct().collect()} == {"d0"}
    assert rows.columns == ["content", "source_file", "source_type", "chunk_index", "chunk_strategy", "chunk_size", "chunk_overlap", "created_at"]
    rows, _ = C.chunk_documents(docs(spark, "word " * 3000), "fixed", 6000, 0, 0)
    assert rows.agg(F.max(F.char_length("content"))).first()[0] <= 6000
    for bad in (("overlap", 100, 100), ("fixed", 40, 0), ("other", 100, 0)):
        with pytest.raises(ValueError):
            C.chunk_documents(docs(spark, "a"), *bad)


def test_families(spark):
    names = ["a.txt", "a.txt (part 1)", "a.txt (part 1) (part 2)", "b.txt"]
    now = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "source_file string, v int")
    assert {r.v for r in S.filter_family(now, "a.txt").collect()} == {0, 1}
    assert {r.v for r in S.filter_family(now, "a.txt (part 1)").collect()} == {1, 2}
    part = spark.createDataFrame([("a.txt (part 1)", 9)], "source_file string, v int")
    assert {r.v for r in S.replace_documents(now, part).collect()} == {0, 3, 9}
    whole = spark.createDataFrame([("a.txt",)], "source_file string")
    assert {r.v for r in S.replace_documents(now, part, names=whole).collect()} == {2, 3, 9}
    with pytest.raises(ValueError):
        S.replace_documents(now, part, expected=2)


def test_versions_of_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "source_file string, chunk_index int, content string")
    first = rows(("a", 0, "one"), ("a (part 1)", 0, "part"), ("b", 0, "two"))
    assert S.write_chunks(first, path, expected=3, batch="x#0") == 0
    assert S.write_chunks(first, path, batch="x#0") == 0
    with pytest.raises(ValueError):
        S.write_chunks(rows(("b", 0, "lost")), path, expected=2)
    assert S.write_chunks(rows(("a", 0, "new")), path) == 1
    read = lambda v=None: {(r.source_file, r.content) for r in S.read_chunks(spark, path, first.schema, v).collect()}
    assert read() == {("a", "new"), ("b", "two")} and len(read(0)) == 3
    assert S.read_chunks(spark, str(tmp_path / "none"), first.schema).count() == 0


def test_a_new_stream_continues_the_table(spark, tmp_path):
    for n, (name, text) in enumerate((("d0", "a" * 1500), ("d1", "b" * 500), ("d0", "c" * 10))):
        d = str(tmp_path / f"in{n}")
        spark.createDataFrame([(name, text, n)], "source_file string, text string, seq int").write.parquet(d)
        source = spark.readStream.schema("source_file string, text string, seq int").parquet(d)
        q = streams.stream_ingest(source, str(tmp_path / "t"), str(tmp_path / f"c{n}"))
        q.processAllAvailable()
        q.stop()
    got = {r.source_file: r.content for r in streams.ingested(spark, str(tmp_path / "t")).collect()}
    assert got == {"d0": "c" * 10, "d1": "b" * 500}


def test_long_chains(spark):
    name = "Base" + "".join(f"__tuning_{i:032x}" for i in range(12))
    chain = one(spark, name, X.collection_chain)
    assert len(chain) == 13 and chain[0] == name and chain[-1] == "Base" and chain[-2] == "Base__tuning_" + "0" * 32
    assert one(spark, "plain", X.collection_chain) == ["plain"]


def test_logins_of_one_key_are_a_stream(spark):
    rng = np.random.default_rng(3)
    times = sorted(int(t) for t in rng.integers(0, 4000, 3000))
    want, first = [], None
    for t in times:
        if first is None or t >= first + 60:
            first = t
            want.append([t, 0, t])
        else:
            want[-1][1] += 1
            want[-1][2] = t
    df = spark.createDataFrame([("k", t) for t in times] + [(None, 5), ("z", None)], "key string, ts long")
    got = [[r["first"], r["count"], r["last"]] for r in A.collapse_failed_logins(df).where("key = 'k'").orderBy("first").collect()]
    assert got == want


def test_hybrid_is_brute_force(spark):
    rng = np.random.default_rng(4)
    words = ["sun", "moon", "star", "sea"]
    n = 60
    texts = [" ".join(rng.choice(words + ["x"] * 6, 8)) for _ in range(n)]
    v, qv = rng.standard_normal((n, 4)), rng.standard_normal((2, 4))
    c = spark.createDataFrame([(i, t, x.tolist()) for i, (t, x) in enumerate(zip(texts, v, strict=True))], "id long, content string, vector array<double>")
    q = spark.createDataFrame([(0, "sun moon", qv[0].tolist()), (1, "sea", qv[1].tolist())], "query_id long, question string, vector array<double>")
    b = {(r.query_id, r.id): r.score for r in R.keyword_scores(q, c).collect()}
    got = {}
    for r in R.hybrid(q, c, 0.5, 12).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for i in range(2):
        cos = v @ qv[i] / np.linalg.norm(v, axis=1) / np.linalg.norm(qv[i])
        vs = (cos - cos.min()) / (cos.max() - cos.min())
        own = {k: s for (q_, k), s in b.items() if q_ == i}
        low, high = min(own.values()), max(own.values())
        mixed = np.round([0.5 * vs[k] + 0.5 * ((own[k] - low) / (high - low) if k in own else 0) for k in range(n)], 9)
        assert got[i] == np.lexsort((np.arange(n), -mixed))[:12].tolist()


def test_many_queries_meet_on_a_grid(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((70, 3))
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    q = c.select(F.col("id").alias("query_id"), "vector")
    plain = R.near_vector(q, c, 3).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(R, "MOST_BYTES", 1000)
    assert R.near_vector(q, c, 3).orderBy("query_id", "rank").collect() == plain


def test_batch_query_is_its_parts(spark):
    got = {r.query_id: r for r in records.batch_query(spark, SF).collect()}
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    langs = [r.lang for r in docs_.select("lang").distinct().collect() if r.lang]
    asked = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert len(got) == asked.count() * 2 * len(langs)
    for key, r in got.items():
        _, user, lang = key.split("/")
        assert r.status == ("ok" if user == "a" or lang == "en" else "not found")
        if r.status == "ok":
            assert r.chunks_retrieved == len(r.citations) == (5 if lang == "fr" else 3)
            assert r.context.startswith("[1] (source: " if lang == "de" else "[1] ") and [c["rank"] for c in r.citations] == list(range(1, r.chunks_retrieved + 1))
        else:
            assert r.citations is None and r.context is None
    embed = models.hashed_words(32)
    en = docs_.where("lang = 'en'").select(F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"), "text")
    chunks = C.chunk_overlap(en, 1000, 200, 300).withColumn("id", F.regexp_extract("source_file", r"doc-(\d+)", 1).cast("long") * 100_000 + F.col("chunk_index")).withColumn("vector", embed(F.col("content")))
    near = R.near_vector(asked.select(F.col("item_id").alias("query_id"), embed(F.col("text")).alias("vector")), chunks, 3).join(chunks.select("id", "source_file", "chunk_index"), "id").collect()
    for r in near:
        cited = got[f"{r.query_id}/a/en"].citations[r.rank - 1]
        assert (cited["source_file"], cited["chunk_index"]) == (r.source_file, r.chunk_index)


def test_files_are_read_line_by_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes("﻿{\"x\": 1}\r\n\r\n[2]\n".encode())
    big = "\n".join(json.dumps({"n": i, "pad": "p" * 50}) for i in range(1, 4001)) + "\n"
    (tmp_path / "b.jsonl").write_text(big)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        rows = IO.read_jsonl_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = sorted((r.line, r.record) for r in rows if r.source_file == "a.jsonl")
    assert a == [(1, '{"x": 1}'), (2, ""), (3, "[2]")]
    b = [r for r in rows if r.source_file == "b.jsonl"]
    assert len(b) == 4000 and all(json.loads(r.record)["n"] == r.line for r in b)


def test_csv_rows_keep_their_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('policy,detail\none,"two\nlines"\n"say ""x""",\n')
    (tmp_path / "b.csv").write_text("k\nv\n")
    got = sorted((r.source_file, r.pos, r.cells, r.header) for r in IO.read_csv_rows(spark, str(tmp_path)).collect())
    assert got == [("a.csv", 1, ["one", "two\nlines"], ["policy", "detail"]), ("a.csv", 2, ['say "x"', ""], ["policy", "detail"]), ("b.csv", 1, ["v"], ["k"])]


def test_corrupt_lines_of_a_package(spark, tmp_path):
    chunks = spark.sql("select 'i' id, array(cast(1.5 as float)) vector, named_struct('content','c','source_file','f','source_type','txt','chunk_index',0,'chunk_strategy','fixed','chunk_size',1,'chunk_overlap',0,'created_at','t') properties, 's' source_sha256")
    path = str(tmp_path / "p")
    IO.write_chunk_package(chunks, path)
    told = spark.read.json(f"{path}/manifest").first()
    assert (told.chunk_count, told.dimensions, told.unresolved, told.fidelity) == (1, 1, 0, "with-sources")
    (tmp_path / "p" / "chunks" / "part-x.json").write_text('{"id": "j"}\n{"id": \n')
    assert [(r.line, r.record) for r in IO.corrupt_lines(spark, path).collect()] == [(2, '{"id": ')]


def test_logs_skip_torn_lines(spark, tmp_path):
    (tmp_path / "log").write_text('{"id": 1, "ts": "x"}\n{"id": 2, \n[1]\n{"ts": "y"}\n')
    assert [r.id for r in IO.read_log(spark, str(tmp_path / "log"), "id long, ts string", "id").collect()] == [1]


def test_flattened_json_is_bounded(spark, monkeypatch):
    big = json.dumps({"k" * 100: list(range(100)) + [{"a": 1}]})
    assert len(one(spark, big, IO.flatten_json)) > 10_000


def package(spark):
    row = lambda x, schema: spark.createDataFrame(x, schema)
    source = "text of a"
    digest = __import__("hashlib").sha256(source.encode()).hexdigest()
    return {
        "manifest": row([("news", "base", 2, 2)], "collection string, model string, dimensions int, chunk_count long"),
        "files": row([("chunks", "x")], "path string, sha256 string"),
        "actual": row([("chunks", "x")], "path string, sha256 string"),
        "chunks": row([("1", [1.0, 0.0], "one", "a", digest), ("2", [0.0, 1.0], "two", "a", None)], "id string, vector array<float>, content string, source_file string, source_sha256 string"),
        "sources": row([(digest, source)], "digest string, content string"),
        "settings": row([("news", "base", 2)], "collection string, model string, dimensions int"),
        "retrieval": row([("news", "flat", 5, 0.5, 999.0, "engineer")], "collection string, retrieval_mode string, top_k int, alpha double, ef double, response_format string"),
        "sessions": row([("s1", "news")], "session string, collection string"),
        "existing": row([("s1", "News"), ("s2", "Old")], "session string, collection string"),
        "taken": row([("News",), ("Old",)], "collection string"),
    }


def test_a_package_is_imported_or_refused(spark, tmp_path):
    p = package(spark)
    with pytest.raises(ValueError, match="exists"):
        M.import_package(str(tmp_path), **p)
    out = M.import_package(str(tmp_path), **p, on_conflict="rename")
    assert out["target"].startswith("News_imported_") and out["sessions"].first().session.startswith("imported-")
    assert S.read_chunks(spark, f"{tmp_path}/{out['target']}", p["chunks"].withColumn("collection", F.lit("x")).schema).count() == 2
    out = M.import_package(str(tmp_path), **p, on_conflict="replace")
    assert out["target"] == "News" and {r.session for r in out["orphaned"].where("orphaned").collect()} == {"s1"}
    for gate, name, wrong in (
        ("files", "actual", p["actual"].withColumn("sha256", F.lit("y"))),
        ("sources", "sources", p["sources"].withColumn("content", F.lit("other"))),
        ("chunks", "chunks", p["chunks"].withColumn("source_sha256", F.lit("z"))),
        ("embedding", "settings", p["settings"].withColumn("dimensions", F.lit(3))),
        ("sessions", "sessions", p["sessions"].withColumn("collection", F.lit("else"))),
        ("settings", "retrieval", p["retrieval"].withColumn("top_k", F.lit(0))),
    ):
        with pytest.raises(ValueError, match=f"unsound {gate}"):
            M.import_package(str(tmp_path / "not"), **{**p, name: wrong}, on_conflict="rename")
    assert not (tmp_path / "not").exists()


def test_import_names_are_free(spark):
    wanted = spark.createDataFrame([("News",)], "collection string")
    first = M.import_target(wanted, wanted, "rename").first().target
    second = M.import_target(wanted, wanted.unionByName(spark.createDataFrame([(first,)], "collection string")), "rename").first().target
    third = M.import_target(wanted, spark.createDataFrame([("News",), (first,), (second,)], "collection string"), "rename").first().target
    assert len({first, second, third}) == 3


def test_rebuilding_a_collection(spark, tmp_path):
    originals = docs(spark, "alpha " * 300, "beta " * 30)
    digest = F.sha2("text", 256)
    sources = originals.select(digest.alias("digest"), F.array("source_file").alias("filenames"))
    chunks = C.chunk_overlap(originals, 500, 50).withColumn("id", F.concat("source_file", F.lit("#"), F.col("chunk_index").cast("string")))
    sessions = spark.createDataFrame([("s", "News"), ("t", "Old")], "session string, collection string")
    path = str(tmp_path / "t")
    version, marked = M.rechunk_collection(path, "News", originals, chunks, sources, sessions, "fixed", size=100, least=0)
    assert {r.session: r.stale for r in marked.collect()} == {"s": True, "t": False} and version == 0
    with pytest.raises(ValueError, match="sources are missing"):
        M.rechunk(originals, chunks.unionByName(chunks.withColumn("source_file", F.lit("gone"))), sources, "fixed")
    embed = models.hashed_words(4)
    version, _ = M.reembed_collection(path, "News", chunks, sessions, embed, 4)
    assert version == 1
    with pytest.raises(Exception, match="wide"):
        M.reembed(chunks, embed, 5).collect()
    config = spark.createDataFrame([("News", "flat", "dot")], "collection string, index_type string, metric string")
    e = S.digests(chunks.withColumn("vector", embed(F.col("content"))), ["content"])
    assert M.reindex(config, "News", "hnsw", "cosine", e, e).first()[1:] == ("hnsw", "cosine")
    with pytest.raises(ValueError):
        M.reindex(config, "News", "hnsw", "cosine", e, e.limit(1))
    with pytest.raises(ValueError):
        M.reindex(config, "News", "tree", "cosine", e, e)


def test_models_are_called_as_told(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(1)
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(25)], "id long, content string").coalesce(1)
    got = df.select("id", models.model_embedding(embed)(F.col("content")).alias("v")).collect()
    assert all(r.v == [float(r.id), 1.0] for r in got) and calls.value == 3

    def reply(system, text):
        if len(text) % 2:
            raise TimeoutError
        return f"{system}:{len(text)}"

    out = {r.id: (r.reply, r.note) for r in models.ask(df.where("id < 3"), reply, "s", "content").collect()}
    assert out[0] == ("s:0", None) and out[1] == (None, "llm-unavailable")


def test_request_templates_are_literal(spark):
    requests = spark.createDataFrame([("GET", "/a.b"), ("GET", "/axb"), ("GET", "/x//y")], "method string, path string")
    templates = spark.createDataFrame([("GET", "/a.b"), ("GET", "/x/{n}/y")], "method string, template string")
    assert [r.path for r in A.classify_requests(requests, templates).collect()] == ["/a.b"]


def test_metrics_come_oldest_first(spark):
    m = spark.createDataFrame([(i, i // 2) for i in range(20)], "id long, ts long")
    assert [r.id for r in A.recent_metrics(m, F.lit(True), 4).collect()] == [16, 17, 18, 19]


@pytest.mark.parametrize("name", ["hybrid", "build_context"])
def test_context_holds_its_hits(spark, name):
    assert getattr(corpus, name)(spark, SF).count() > 0


def test_streamed_logins_are_the_batch_ones(spark, tmp_path):
    rows = [("a", 1000 + t) for t in (0, 10, 59, 60, 61)] + [("b", 1005), ("end", 100_000)]
    df = spark.createDataFrame(rows, "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    q = streams.stream_failed_logins(source).writeStream.format("memory").queryName("logins").outputMode("append").start()
    q.processAllAvailable()
    spark.createDataFrame([("end", 200_000)], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts")).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("select key, first, count, last from logins where key <> 'end'").collect())
    want = sorted(tuple(r) for r in A.collapse_failed_logins(df.select("key", F.unix_timestamp("ts").alias("ts"))).where("key <> 'end'").collect())
    assert got == want
    assert G.LOCAL_FIELDS == ("owner", "created_at", "finished_at")


def test_language_pieces_cover_the_text(spark):
    rng = np.random.default_rng(7)
    text = "".join(rng.choice(["alpha", "beta", " ", ". ", "\n", "\n\n"], 400, p=[0.25, 0.25, 0.3, 0.1, 0.05, 0.05]))
    got = [r.content for r in C.chunk_language(docs(spark, text), 60, 0).orderBy("chunk_index").collect()]
    assert all(0 < len(c) <= 60 for c in got) and "".join("".join(got).split()) == "".join(text.split())
    lapped, at = [r.content for r in C.chunk_language(docs(spark, text), 60, 20).orderBy("chunk_index").collect()], 0
    for c in lapped:
        at = text.index(c, at)
    assert all(len(c) <= 60 for c in lapped) and len(lapped) >= len(got)


def test_semantic_runs_are_brute_force(spark):
    embed = models.hashed_words(16)
    text = "sun and moon. moon and sun. the sea is deep. deep is the sea. nothing here\nof them. sun and moon"
    parts = [p.strip() for p in text.replace("\n", " ").split(". ") if p.strip()]
    v = [np.array(r.v) for r in spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "i int, s string").select("i", embed(F.col("s")).alias("v")).orderBy("i").collect()]
    runs = [[parts[0]]]
    for a, b, p in zip(v, v[1:], parts[1:]):
        if a @ b / np.linalg.norm(a) / np.linalg.norm(b) < 0.6:
            runs.append([])
        runs[-1].append(p)
    got = [r.content for r in C.chunk_semantic(docs(spark, text), embed, 0.6).orderBy("chunk_index").collect()]
    assert got == [". ".join(r) + "." for r in runs] and len(got) > 1


def test_fences_keep_blank_lines(spark):
    text = "# title\n\n```py\na\n\nb\n```\n\n\nlast"
    assert [r.text for r in C.paragraph_units(docs(spark, text), markdown=True).orderBy("pos").collect()] == ["# title", "```py\na\n\nb\n```", "last"]
    assert len(C.paragraph_units(docs(spark, text)).collect()) == 4


def test_parts_hold_whole_paragraphs(spark):
    rng = np.random.default_rng(8)
    paragraphs = ["p" * int(n) for n in rng.integers(1, 80, 40)]
    rows = C.split_over_limit(docs(spark, "\n\n".join(paragraphs), "short"), 100).orderBy("source_file", "part").collect()
    first = [r.text for r in rows if r.source_file == "d0"]
    assert "\n\n".join(first).split("\n\n") == paragraphs and all(len(t) <= 100 for t in first)
    assert all(len(a) + 2 + len(b.split("\n\n")[0]) > 100 for a, b in zip(first, first[1:])) and {r.of for r in rows} == {len(first), 1}


def test_near_text_is_brute_force(spark):
    embed = models.hashed_words(8)
    texts = ["sun moon", "sea", "moon", "star sea sun", "sun"]
    c = spark.createDataFrame(list(enumerate(texts)), "id long, content string").withColumn("vector", embed(F.col("content")))
    q = spark.createDataFrame([(0, "sun"), (1, "sea moon")], "query_id long, question string")
    v = {r.id: np.array(r.vector) for r in c.collect()}
    asked = {r.query_id: np.array(r.v) for r in q.select("query_id", embed(F.col("question")).alias("v")).collect()}
    for r in R.near_text(q, c, 5, embed).collect():
        order = sorted(v, key=lambda i: (-round(float(v[i] @ asked[r.query_id] / np.linalg.norm(v[i]) / np.linalg.norm(asked[r.query_id])), 12), i))
        assert order[r["rank"] - 1] == r.id
