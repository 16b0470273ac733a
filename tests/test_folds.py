"""Folds in blocks, windows of very long texts and cutters against plain loops."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import analytics as A
from quarry.operators import chunking as C
from quarry.operators import folds


def plain_packing(lengths, room, separator, most, alone):
    out, part, used, count, closed = [], -1, 0, 0, True
    for n, one in zip(lengths, alone, strict=True):
        if closed or one or used + separator + n > room or count >= most:
            part, used, count = part + 1, n, 1
        else:
            used, count = used + separator + n, count + 1
        closed = bool(one)
        out.append(part)
    return out


def plain_windows(times, span):
    out, number, first = [], -1, None
    for t in times:
        if first is None or t >= first + span:
            number, first = number + 1, t
        out.append(number)
    return out


def test_blocks_of_any_sizes_give_the_loop():
    rng = random.Random(0)
    for _ in range(800):
        n = rng.randint(1, 60)
        cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(rng.randint(0, 5)))})
        separator, most, room, span = rng.choice([0, 1, 2]), rng.choice([None, 1, 3, 5]), rng.choice([1, 5, 20, 100]), rng.choice([1, 5, 30])
        lengths, alone = [rng.randint(0, 12) for _ in range(n)], [int(rng.random() < rng.choice([0, 0.1])) for _ in range(n)]
        times = sorted(rng.randint(0, 100) for _ in range(n))
        cases = [(folds.Packed(separator, most), lambda a, b: [np.array(lengths[a:b]), np.full(b - a, room), np.array(alone[a:b])], plain_packing(lengths, room, separator, most or 10**9, alone)), (folds.Anchored(span), lambda a, b: [np.array(times[a:b])], plain_windows(times, span))]
        for rule, values, want in cases:
            read = scanned = None
            got = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                v = values(a, b)
                scanned = folds.passed(rule, folds.summary(rule, v), scanned)
                numbers, read = folds.replayed(rule, v, read)
                got += numbers.tolist()
                assert read == scanned
            assert got == want


@pytest.mark.parametrize("parts", [1, 7])
def test_one_key_is_folded_by_many_tasks(spark, parts):
    """A hot key over all partitions, small keys and the null key beside it."""
    rng = random.Random(parts)
    rows = [("hot", i, rng.randint(0, 30)) for i in range(3000)] + [(k, i, rng.randint(0, 30)) for k in ("a", "zz", None) for i in range(40)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        units = spark.createDataFrame([(k, i, "x" * n) for k, i, n in rows], "source_file string, pos int, text string")
        got = {(r.source_file, r.pos): r.part for r in C.unit_parts(units, ("source_file",), F.lit(100), 1).collect()}
        logins = A.collapse_failed_logins(spark.createDataFrame([(k, i * 3 + n) for k, i, n in rows], "key string, ts long"), 60).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for key in ("hot", "a", "zz", None):
        own = sorted((i, n) for k, i, n in rows if k == key)
        want = plain_packing([n for _, n in own], 100, 1, 10**9, [0] * len(own))
        assert [got[key, i] for i, _ in own] == want
        times = sorted(i * 3 + n for i, n in own)
        numbers = plain_windows(times, 60)
        held = {}
        for t, w in zip(times, numbers, strict=True):
            held.setdefault(w, []).append(t)
        assert sorted((r["first"], r["count"], r["last"]) for r in logins if r.key == key) == sorted((min(x), len(x) - 1, max(x)) for x in held.values())


ODD = ["", " ", "abc", "äöü" * 700, "日本語🙂" * 600, "﻿" * 1500, "a" * 1000 + "﻿b" + "é" * 999, "x" * 3001, "🙂" + "y" * 2000, "\n \t" * 800]


def test_windows_of_all_scripts(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate([*ODD, None])], "source_file string, text string")
    windows, slices = {}, {}
    for r in C.chunk_overlap(docs, 1000, 200, 100).orderBy("chunk_index").collect():
        windows.setdefault(r.source_file, []).append(r.content)
    for r in C.chunk_fixed(docs, 1000).orderBy("chunk_index").collect():
        slices.setdefault(r.source_file, []).append(r.content)
    for i, text in enumerate(ODD):
        whole = windows.get(str(i), [])
        assert (whole[0] + "".join(w[200:] for w in whole[1:]) if whole else "") == (text if text.strip() else "")
        assert slices.get(str(i), []) == [p for p in (text[a : a + 1000].strip(" \n\t\r\f\x0b") for a in range(0, len(text), 1000)) if p]


@pytest.mark.parametrize("letter", ["a", "é"])
@pytest.mark.parametrize("cut", [C.chunk_overlap, C.chunk_fixed, C.chunk_language])
def test_time_grows_with_the_length(spark, letter, cut):
    def seconds(n):
        docs = spark.createDataFrame([("d", letter * n)], "source_file string, text string").cache()
        docs.count()
        best = 99.0
        for _ in range(3):
            start = time.time()
            cut(docs).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - start)
        docs.unpersist()
        return best

    seconds(10_000)
    assert seconds(2_000_000) < 3.2 * seconds(500_000) + 0.5  # a square would be 16 times as much


def test_a_document_that_cannot_be_split_fails_whole(spark):
    """Windows of one character step by one, so no part below the limit of chunks is made of what has too few characters."""
    text = "\n\n".join(["ab " * 3000, "q" * 30_000])
    docs = spark.createDataFrame([("d", text), ("short", "x")], "source_file string, text string")
    parts, failed = C.split_documents(docs, "overlap", 50, 49)
    held = [r.text for r in parts.where("source_file = 'd'").orderBy("part").collect()]
    assert failed.count() == 0 and "".join(held).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")
    C_refused = C.refused
    try:  # nothing is ever small enough
        C.refused = lambda d, *a: d.where("text <> 'x'").select("source_file", F.lit("chunks").alias("kind"))
        parts, failed = C.split_documents(spark.createDataFrame([("d", "ab\n\ncd"), ("short", "x")], "source_file string, text string"), "overlap", 50, 49)
        assert [tuple(r) for r in failed.collect()] == [("d", "chunks")] and [r.source_file for r in parts.collect()] == ["short"]
    finally:
        C.refused = C_refused


def test_semantic_documents_have_a_limit_of_sentences(spark):
    docs = spark.createDataFrame([("few", "a. b. c."), ("many", "a. " * 100_001)], "source_file string, text string")
    rows, failed = C.chunk_documents(docs, "semantic", 50, 0, 0, embed=lambda c: F.array(F.lit(1.0)))
    assert [tuple(r) for r in failed.collect()] == [("many", "sentences")] and {r.source_file for r in rows.collect()} == {"few"}


@pytest.mark.parametrize("most", [100, 10**6])
def test_only_large_keys_are_folded_in_blocks(spark, monkeypatch, most):
    """Keys under the bound take one pass and are not written; a key over it is dealt to all tasks; both give the loop."""
    written = []
    keep = folds.kept_in_place
    monkeypatch.setattr(folds, "MOST_OF_KEY", most)
    monkeypatch.setattr(folds, "kept_in_place", lambda df: written.append(1) or keep(df))
    rng = random.Random(most)
    rows = [(k, i, rng.randint(0, 30)) for k, n in (("hot", 2000), ("a", 40), (None, 60), ("one", 1), ("two", 1), ("zz", 7)) for i in range(n)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # keys go on from batch to batch
    try:
        units = spark.createDataFrame([(k, i, "x" * n) for k, i, n in rows], "source_file string, pos int, text string")
        got = {(r.source_file, r.pos): r.part for r in C.unit_parts(units, ("source_file",), F.lit(100), 1).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and len(written) == (most == 100)
    for key in ("hot", "a", None, "one", "two", "zz"):
        own = sorted((i, n) for k, i, n in rows if k == key)
        assert [got[key, i] for i, _ in own] == plain_packing([n for _, n in own], 100, 1, 10**9, [0] * len(own))


def test_csv_rows_within_their_room_are_not_cut(spark):
    """Rows that fit pass no cutter in Python and keep their positions; one long row is cut as before."""
    rows = [(f, i, ["a" * i, "b"], f"{'a' * i},b\n", h) for f, h in (("x", "h,i\n"), ("y", None)) for i in range(9)]
    schema = "source_file string, pos int, cells array<string>, text string, header string"
    fits = C.pack_parts(spark.createDataFrame(rows, schema), 40, "csv", "header")
    assert "EvalPython" not in fits._jdf.queryExecution().toString()
    got = {(r.source_file, r.part): (r.content, r.units) for r in fits.collect()}
    assert got["x", 0] == ("h,i\n" + "".join(r[3] for r in rows[:6]), 6) and got["y", 0][1] == 6 and sum(n for _, n in got.values()) == 18
    long = C.pack_parts(spark.createDataFrame([*rows, ("x", 9, ["c" * 70, "d"], f"{'c' * 70},d\n", "h,i\n")], schema), 40, "csv", "header").where("source_file = 'x'").orderBy("part").collect()
    assert all(r.content.startswith("h,i\n") and len(r.content) <= 40 for r in long) and sum(r.content.count("c") for r in long) == 70


def test_a_batch_of_texts_is_taken_in_small_slices(spark):
    """A full batch never lies in Python as objects as a whole, nor does what is made of it; null texts give nothing."""
    import pyarrow as pa

    texts = [None if i % 50 == 7 else f"a{i}\n\n```\n\nb\n```\nc" for i in range(300)]
    made = C.per_text(lambda t: t.split("\n\n"), "string")
    slices = list(made.func(iter([pa.array(texts)])))
    assert max(map(len, slices)) <= C.MOST_HELD and [x for s in slices for x in s.to_pylist()] == [t.split("\n\n") if t else [] for t in texts]
    rows = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "source_file string, text string").coalesce(1)
    got = sorted((r.source_file, r.pos, r.text) for r in C.paragraph_units(rows, markdown=True).collect())
    assert got == sorted((f"f{i}", p, x) for i, t in enumerate(texts) if t for p, x in enumerate([f"a{i}", "```\n\nb\n```\nc"]))
