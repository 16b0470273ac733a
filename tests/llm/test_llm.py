"""The training-data operators against brute force, the tokenizers library, SQL and odd inputs."""

import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import bpe, embedding_dedup, html_text, langid, licenses, minhash, packing, registry, sharding, topk, toxicity
from quarry.llm.components import components, extended

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [None, "", " ", " \n\t ", "a", "A a", "It's  Ünïcode  \x1c x\x00y <|endoftext|> İΣΑΣ 123 é", "x" * 5000, "wörd " * 4000, "a  b   c \n d \n\n e\t f\r\n  x", "same text here again", "same text here again", "日本語 テスト 🙂"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 1, "x") for i, t in enumerate(ODD)], "doc_id long, text string, lang string, rep int, _n string").cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id < 0")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(registry.ORACLE_SQL[name]).df()[list(got.columns)]
    key = list(got.columns)
    pd.testing.assert_frame_equal(got.sort_values(key, ignore_index=True), want.sort_values(key, ignore_index=True))


def test_bpe_is_the_library(odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    ids = bpe.encode(odd, WORD)
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in bpe.decode(ids.select("doc_id", "ids"), WORD).collect()}
    for i, text in enumerate(ODD):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (want, t.decode(want, skip_special_tokens=False))
    assert bpe.encode(none, WORD).count() == 0


def test_byte_tokens_are_the_library():
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(BYTE), packing.Tokens(open(BYTE, encoding="utf-8").read())
    for text in ODD:
        assert np.frombuffer(own.encode(text or ""), "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


def check_packed(rows, length):
    assert all(0 <= r.offset and r.offset + r.length <= length for r in rows)
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
    return len(by)


def test_packing(odd, none):
    rows = packing.pack_documents(odd, BYTE, 64).collect()
    used = check_packed(rows, 64)
    assert used <= -(-sum(r.length for r in rows) // 64) + 1
    assert {r.doc_id for r in rows} == set(range(len(ODD)))
    assert packing.pack_documents(none, BYTE).count() == 0


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 2049, 5000), minlength=2049)
    plan = packing.plan(counts, 2048)
    used = np.zeros(2049, dtype=int)
    for lengths, times in plan:
        assert sum(lengths) <= 2048
        np.add.at(used, lengths, times)
    assert (used == counts).all()
    assert sum(t for _, t in plan) <= 1.01 * (counts * np.arange(2049)).sum() / 2048


def test_language(spark, odd, none):
    docs = spark.read.parquet(f"{SF.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    langs, model = langid.learn(docs.where(~out), "text", "lang")
    got = langid.identify(docs.where(out), langs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98
    assert [r.lang_pred for r in langid.identify(odd, langs, model).orderBy("doc_id").collect()[:4]] == ["und"] * 4
    assert langid.identify(none, langs, model).count() == 0
    empty = langid.learn(none, "text", "lang")
    assert {r.lang_pred for r in langid.identify(odd, *empty).collect()} == {"und"}


def test_mixture_finds_both_languages():
    x = np.repeat([[0.0, -9.0, -9.0], [-9.0, 0.0, -9.0]], [30, 10], axis=0)
    assert np.allclose(langid.proportions(x), [0.75, 0.25, 0], atol=0.02)


def labelled_rows(spark):
    rng = np.random.default_rng(1)
    words = [f"word{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    rows = []
    for i in range(900):
        text = list(rng.choice(words, 40))
        if i % 5 == 0:
            text[3] = text[9] = rng.choice(["nastyone", "vileword", "horridthing"])
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_toxicity(spark, odd, none):
    rows = labelled_rows(spark)
    chosen, index = toxicity.fit(rows.where("doc_id % 3 <> 1"))
    got = toxicity.score(rows.where("doc_id % 3 = 1"), chosen, index).join(rows.select("doc_id", "label"), "doc_id").toPandas()
    assert (got.predicted == got.label).mean() > 0.98
    assert toxicity.score(odd, chosen, index).count() == len(ODD) and toxicity.score(none, chosen, index).count() == 0
    bare = toxicity.fit(rows.where("doc_id < 0"))
    assert {r.score for r in toxicity.score(odd, *bare).collect()} == {0.0}


def test_block_max_is_exact(spark):
    rows = [(i, i % 2, {int(f): int(c) for f, c in zip(r.integers(0, 40, 5), r.integers(1, 4, 5), strict=True)}) for i in range(700) for r in [np.random.default_rng(i)]]
    index = toxicity.Index(40, rows, {0: 1.0, 1: 1.0})
    full = np.zeros((700, 40))
    for f in range(40):
        part = slice(index.begin[f], index.begin[f + 1])
        full[index.doc[part], f] = index.weight[part]
    for q in range(0, 700, 37):
        at, w = toxicity.unit(toxicity.Counter(rows[q][2]), index.idf)
        docs, scores = index.nearest(at, w, 10)
        want = full[:, at] @ w
        best = np.lexsort((np.arange(700), -want))[:10]
        assert np.allclose(scores, want[best])


def brute_groups(texts, words, percent):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_minhash_is_brute_force(spark, odd, none):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = list(enumerate(ODD))
    for i in range(60):  # a chain of near copies about the threshold
        text = list(base)
        for k in rng.integers(0, 120, rng.integers(1, 5)):
            text[k] = f"n{rng.integers(0, 5)}"
        rows.append((100 + i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == brute_groups(rows, 3, 85)
    assert minhash.near_duplicates(odd).count() == len(ODD) and minhash.near_duplicates(none).count() == 0


def test_components_in_two_steps(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    more = [(rng.randrange(80), rng.randrange(80)) for _ in range(15)]
    frames = [spark.createDataFrame(e, "a long, b long") for e in (edges, more)]
    got = {(r.node, r.component) for r in extended(components(frames[0]), frames[1]).collect()}
    want = {(r.node, r.component) for r in components(frames[0].unionByName(frames[1])).collect()}
    loops = {(n, n) for e in edges + more for n in e}  # a node with a loop only may be named or not
    assert got | loops == want | loops and {n for n, _ in got} >= {n for n, _ in want}
    assert {r.node: r.component for r in extended(components(frames[0].limit(0)), frames[1]).collect()} == {r.node: r.component for r in components(frames[1]).collect()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}


VECTORS = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [float("nan"), 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 2), (50, [2.0, 0.2], 1), (9, [], 1)]


def test_embedding_odd_inputs(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit("k"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_embeddings(df).collect()}
    linked = {0: (3, 0), 1: (3, 0), 2: (3, 0), 50: (3, 0)}
    assert got == {i: linked.get(i, (0, i)) for i, *_ in VECTORS}
    assert embedding_dedup.near_embeddings(df.where("vec_id < 0")).count() == 0
    best = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, 2).collect()}
    assert best[0, 1] == (50, 512 * 256) and best[50, 1] == (2, 512 * 256 + 51 * 25) and {q for q, _ in best} == {0, 50}
    assert topk.top_k(df.where("vec_id < 0")).count() == 0


def test_embedding_group_over_one_block(spark):
    rng = np.random.default_rng(5)
    x = np.array([1.0, 0, 0, 0, 0, 0, 0, 0]) + 0.13 * rng.standard_normal((1500, 8))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = ((u @ u.T) >= 0.93).sum(axis=1) - 1
    got = embedding_dedup.near_embeddings(df).orderBy("vec_id").toPandas()
    assert np.abs(got.n_links - want).sum() <= 2


def test_sharding(spark, odd, none):
    rows = sharding.slotted(odd)
    got = rows.orderBy("doc_id").collect()
    for r, t in zip(got, ODD, strict=True):
        raw = (t or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    sizes = sharding.slot_bytes(rows)
    mapped = sharding.slot_map(sizes, 4)
    out = sharding.placed(rows, mapped, sizes).toPandas()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard")) and len(out) == len(ODD)
    docs = sharding.slotted(spark.read.parquet(f"{SF}/documents.parquet"))
    sizes = sharding.slot_bytes(docs).cache()
    before = sharding.slot_map(sizes, 24).cache()
    after = sharding.rebalanced(before, sizes, 25)
    both = before.select("virtual_slot", F.col("shard").alias("old")).join(after, "virtual_slot").join(sizes, "virtual_slot").toPandas()
    moved = both[both.old != both.shard].bytes.sum() / both.bytes.sum()
    load = both.groupby("shard").bytes.sum()
    assert moved < 0.25 and len(load) == 25 and set(both.version) == {2} and load.max() < 1.3 * load.mean()
    assert sharding.placed(sharding.slotted(none), sharding.slot_map(sharding.slot_bytes(sharding.slotted(none)), 4), sharding.slot_bytes(sharding.slotted(none))).count() == 0


def test_map_versions_are_kept(spark, tmp_path):
    sizes = sharding.slot_bytes(sharding.slotted(spark.read.parquet(f"{SF}/documents.parquet"))).cache()
    path = str(tmp_path / "map")
    one = sharding.store_map(sharding.slot_map(sizes, 4), path)
    two = sharding.store_map(sharding.rebalanced(one, sizes, 5), path)
    assert {r.version for r in two.select("version").distinct().collect()} == {2}
    assert sharding.latest_map(spark, path, 1).count() == two.count() == sizes.count()


def test_licenses(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "code"), (3, "a/b/y.py", "text\n# Licensed under the Apache License, Version 2.0.\nmore"), (4, "c/z.py", None), (5, "a/b/d/COPYING", "Licensed under CC BY-NC 4.0."), (6, "a/b/d/e/f.txt", ""), (7, None, "no path"), (2, "a/b/x.py", "code")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = sorted((r.doc_id, r.license, r.evidence, r.from_dir) for r in licenses.license_scan(df).collect())
    assert got == [(1, "MIT", "own", None), (2, "MIT", "inherited", "a"), (2, "MIT", "inherited", "a"), (3, "Apache-2.0", "own", None), (4, None, "none", None), (5, "CC-BY-NC-4.0", "own", None), (6, "CC-BY-NC-4.0", "inherited", "a/b/d"), (7, None, "none", None)]
    assert licenses.license_scan(df.where("doc_id < 0")).count() == 0


def test_licenses_in_usual_forms(spark):
    bsd = "Copyright (c) 2024, ACME\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions must keep the notice.\n"
    more = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    cases = {
        "# Copyright 2024 ACME. Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Copyright (c) 2024 Jane Doe. Released under the MIT License.": "MIT",
        "A long paragraph of other words goes before it. " * 4 + "Licensed under CC BY-NC 4.0." + " And others come after it." * 4: "CC-BY-NC-4.0",
        "x\nLicensed under the\nApache License,\nVersion 2.0.\ny": "Apache-2.0",
        gpl: "GPL-3.0",
        gpl.replace("version 3", "version 2"): "GPL-2.0",
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "GPL-3.0",
        "text under a Creative Commons Attribution 4.0 International License, as this work is licensed under a Creative Commons Attribution 4.0 International License": "CC-BY-4.0",
        "// SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
        "// SPDX-License-Identifier: GPL-3.0-or-later\nint x;": "GPL-3.0",
        bsd: "BSD-2-Clause",
        bsd + more: "BSD-3-Clause",
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal": "MIT",
        "mit": None,
        "wir kommen alle mit": None,
        "the general version of this work is public and under a license of sorts": None,
    }
    df = spark.createDataFrame([(i, f"d{i}/x.txt", t) for i, t in enumerate(cases)], "doc_id long, path string, text string")
    got = {r.doc_id: r.license for r in licenses.license_scan(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.op9_html(spark, SF).collect()}
    same = 0
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        cut = [" ".join(html_text.html.unescape(re.sub(r"<[^>]+>", " ", re.sub("</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        same += got[r.page_id] == "\n\n".join(c for c in cut if c)
    assert same >= 0.98 * len(got)
    odd = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<p>unclosed <a href='x"), (4, "u", "plain &amp; simple")], "page_id long, url string, html string")
    made = html_text.Labeller()
    assert html_text.extract(odd, made).count() == 4 and html_text.extract(odd.where("page_id < 0"), made).count() == 0


def test_blocks():
    page = "<head><title>t</title></head><body><script>var a='</p>';</script><!-- <p>no</p> --><p>One &lt;b&gt;<br>two<p>three <a href=x>link</a><ul><li>x<li>y</ul>tail &copy;"
    assert [b.text for b in html_text.blocks(page)] == ["One <b> two", "three link", "x", "y", "tail ©"]


def test_lstm_gradients():
    made, rng = html_text.Labeller(), np.random.default_rng(0)
    x, mask, y = html_text.padded([(rng.random((n, html_text.WIDTH)), rng.integers(0, 2, n).astype(float)) for n in (4, 2)])

    def loss():
        z = made.logits(x, mask)[0]
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())

    g = made.gradients(x, mask, y)
    for k in ("xf", "hb", "cf", "o", "v"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = made.p[k][at]
        made.p[k][at] = old + 1e-5
        up = loss()
        made.p[k][at] = old - 1e-5
        down = loss()
        made.p[k][at] = old
        assert np.isclose((up - down) / 2e-5, g[k][at], rtol=1e-3)


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF).cache()
        assert kept.columns == docs.columns and kept.join(docs, docs.columns, "left_anti").count() == 0, name
        sizes.append(kept.count())
        docs = kept
    assert sizes[0] * 0.6 < sizes[-1] < sizes[0]
    groups = brute_groups([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert all(i == root for i, (_, root) in groups.items())
    packed = corpus_pipeline.run(spark, SF).collect()
    check_packed(packed, 2048)
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
