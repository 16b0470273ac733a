"""Odd inputs of the training-data operators and of the pipeline's stages, and brute force where SQL ends."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import common, embedding_dedup, html_text, langid, licenses, minhash, packing, topk, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _toxicity double, rep int, n long, label string"


def documents(spark, rows):
    """Rows (doc_id, text, lang) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, "s", 1, 0.5, 2, 3, "x") for i, t, g in rows], SCHEMA)


def written(df):
    """As the pipeline hands tables on."""
    return common.cut(df)


ENGLISH = "the quick brown fox jumps over the lazy dog and runs home through the green wood"
GERMAN = "der schnelle braune fuchs springt über den faulen hund und läuft nach hause durch den wald"


def learning(n=40):
    return [(1000 + i, f"{ENGLISH} {i}", "en") for i in range(n)] + [(2000 + i, f"{GERMAN} {i}", "de") for i in range(n)]


def test_language_stage_judges_rows(spark):
    odd = [(None, ENGLISH, None), (None, None, "en"), (5, ENGLISH, "en"), (5, ENGLISH, "en"), (5, "123 456", "en"), (6, "", "de"), (7, GERMAN * 2000, "de"), (8, "Жёлтый цветок растёт", None)]
    docs = written(documents(spark, learning() + odd))
    got = corpus_pipeline.language(spark, docs, SF)
    assert got.columns == docs.columns and got.schema == docs.schema
    kept = Counter((r.doc_id, r.text) for r in got.where("doc_id is null or doc_id < 1000").collect())
    assert kept == {(None, ENGLISH): 1, (5, ENGLISH): 2, (7, GERMAN * 2000): 1}
    assert corpus_pipeline.language(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), SF).count() == docs.count()


def toxic_table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_toxicity_stage_judges_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = [f"word{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, 30))
        if i % 4 == 0:
            text[3] = text[9] = text[11] = "horridthing"
        rows.append((i, " ".join(text), "en"))
        labels.append((i, 1, int(i % 4 == 0)))
    labels += [(None, 1, 1), (7, None, None), (8, 1, 3), (9, 1, 0), (9, 1, 0)]
    bad, good = "wordab horridthing wordcd horridthing wordef horridthing", "wordab wordcd wordef wordgh"
    odd = [(None, bad, "en"), (None, good, "en"), (700, None, "en"), (701, "", None), (1, good, "en"), (1, bad, "en"), (702, (good + " ") * 3000, "en")]
    docs = written(documents(spark, rows + odd))
    sf = toxic_table(spark, tmp_path, labels)
    got = corpus_pipeline.toxicity(spark, docs, sf)
    assert got.schema == docs.schema
    left = Counter((r.doc_id, r.text) for r in got.collect())
    assert left[None, good] == left[700, None] == left[701, ""] == left[1, good] == left[702, (good + " ") * 3000] == 1
    assert left[None, bad] == left[1, bad] == 0
    clean = sum(left[i, t] for i, t, _ in rows if i % 4)
    assert clean > 440 and sum(left[i, t] for i, t, _ in rows if i % 4 == 0) < 10
    assert corpus_pipeline.toxicity(spark, docs.limit(0), sf).count() == 0
    empty = toxic_table(spark, tmp_path / "none", [])
    assert corpus_pipeline.toxicity(spark, docs, empty).count() == docs.count()


def test_near_dedup_stage_keeps_one_row_of_a_group(spark):
    base = " ".join(f"w{i}" for i in range(100))
    near = base.replace("w50 ", "x ")
    rows = [(9, base, "en"), (4, near, "en"), (None, base, "en"), (None, base, "en"), (4, near, "en"), (4, "another text altogether of some words", "en"), (3, None, "en"), (3, None, "en"), (2, " \n", "en"), (None, "alone without an id in the table", "en"), (8, "b " * 50_000, "en"), (1, "b " * 50_000, "en")]
    docs = written(documents(spark, rows))
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.schema == docs.schema
    left = Counter((r.doc_id, r.text) for r in got.collect())
    assert left == {(4, near): 1, (4, "another text altogether of some words"): 1, (3, None): 2, (2, " \n"): 1, (None, "alone without an id in the table"): 1, (1, "b " * 50_000): 1}
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), SF).count() == 0


def test_packing_stage(spark):
    docs = written(documents(spark, [(1, None, "en"), (1, None, "en"), (None, "a b c", "en"), (2, "word " * 5000, "en"), (3, "", "en")]))
    rows = corpus_pipeline.packing(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == {1: 2, None: 1, 2: 1, 3: 1}
    assert max(r.offset + r.length for r in rows) <= 2048
    assert corpus_pipeline.packing(spark, docs.limit(0), SF).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    t = "one two three four five six"
    df = spark.createDataFrame([(None, t), (3, t), (7, t), (7, "other words that stand here for once"), (7, None), (None, "only here"), (2, " ")], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == {(None, 3, False): 1, (3, 3, True): 1, (7, 3, False): 1, (7, 7, True): 2, (None, None, True): 1, (2, 2, True): 1}


@pytest.mark.parametrize("limit", [0, 500_000])
def test_near_duplicates_beyond_the_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(minhash, "MOST_BROADCAST", limit)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"z{i % 3}"])) for i in range(12)] + [(50, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == {**{i: 0 for i in range(12)}, 50: 50}
    assert minhash.without_copies(df).count() == 2


def test_verification_blocks_hold_bounded_shingles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MOST_SHINGLES", 200)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[: 79 - i % 4], f"z{i}"])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(df, 3, 80).collect()} == {0}


# ------------------------------------------------------------------ toxicity


def test_only_visited_blocks_are_read():
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, {int(f): 1 for f in {i // 128, *rng.integers(20, 40, 2)}}) for i in range(128 * 10)]
    index = toxicity.Index(40, rows, {0: 1.0, 1: 1.0})
    read = []

    class Told(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                read.append(np.asarray(at))
            return np.asarray(super().__getitem__(at))

    index.doc = index.doc.view(Told)
    at, w = toxicity.unit(Counter({3: 1}), index.idf)
    docs, _ = index.nearest(at, w, 5)
    own = index.begin[4] - index.begin[3]
    assert len(docs) == 5 and sum(map(len, read)) <= own


def test_nearest_breaks_ties_by_id():
    rows = [(i, 0, {i % 3: 1}) for i in range(300)]
    index = toxicity.Index(3, rows[::-1], {0: 1.0})
    docs, scores = index.nearest(*toxicity.unit(Counter({1: 1}), index.idf), 7)
    assert index.example[docs].tolist() == [1, 4, 7, 10, 13, 16, 19] and np.allclose(scores, 1)


def test_calibration_is_monotone_and_near_the_rates():
    rng = np.random.default_rng(3)
    votes = rng.random(4000)
    labels = (rng.random(4000) < votes**3).astype(np.int64)
    index = toxicity.Index(1, [(0, 0, {0: 1}), (1, 1, {0: 1})], {0: 1.0, 1: 1.0})
    index.calibrate(votes, labels, np.ones(4000))
    at = np.linspace(0.05, 0.95, 50)
    got = np.array([index.calibrated(v) for v in at])
    assert (np.diff(got) > 0).all() and np.abs(got - at**3).max() < 0.12


def test_toxicity_finds_the_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op10_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert toxic.predicted.mean() > 0.65 and clean.predicted.mean() < 0.01
    for low, high in ((0, 0.3), (0.7, 1.01)):
        band = got[(got.score >= low) & (got.score < high)]
        assert abs(band.score.mean() - band.toxic.mean()) < 0.15


# ------------------------------------------------------------------ vectors


def test_large_components_are_exact(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6, 0.0]), (2, [5e5, 0.0]), (3, [-1e12, 7.0]), (4, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in topk.top_k(df, 5).where("query_id = 0").collect()}
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows}
    assert got == {i: max(-(1 << 63), sum(a * b for a, b in zip(v[0], v[i], strict=True))) for i in range(1, 5)}
    assert got[1] == 65_536_000_000_000_000 and got[2] == 32_768_000_000_000_000


def test_topk_ties_repeats_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(-3, 4, (400, 4)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    v = np.floor(256 * x).astype(int)
    want = {}
    for q in range(0, 400, 50):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        want[q] = [(int(i), int(s[i])) for i in order]
    monkeypatch.setattr(topk, "VECTORS", 60)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "FIRST", 6)
    df = spark.createDataFrame(rows + rows[:20], "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for r in topk.top_k(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def test_long_labels_are_told_apart(spark):
    a, b = "l" * 70 + "a", "l" * 70 + "b"
    rows = [(1, [1.0, 0.0], a), (2, [1.0, 0.0], b), (3, [1.0, 0.0], a)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted(map(tuple, embedding_dedup.near_embeddings(df).collect()))
    assert got == [(1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False)]


def test_equal_ids_and_doubles(spark):
    rows = [(1, [0.1, 0.2], 1), (1, [0.1, 0.2], 1), (2, [0.1 + 1e-12, 0.2], 1), (None, [0.1, 0.2], 1), (5, [5e-324, 0.0], 2), (6, [1e308, 1e308], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("unit", F.lit(1)).withColumn("at", F.lit(2))
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_embeddings(df).collect()), key=str)
    assert len(got) == 6 and {g[2] for g in got if g[0] in (1, 2)} == {1}


# ------------------------------------------------------------------ pages


def blocks(page):
    return [b.text for b in html_text.blocks(page)]


def test_long_attributes_and_deep_paths():
    assert blocks(f"<p data-x=\"{'a > b ' * 5000}\">text</p>") == ["text"]
    deep = "<div class='comments'>" + "<div>" * 40 + "<p>said</p>" + "</div>" * 41
    (b,) = html_text.blocks(f"<article>{deep}</article>")
    assert b.inner.outside and len(html_text.path(b.inner)) == 43
    assert html_text.told([b]) == [0]
    assert blocks("<div>" * 5000 + "x") == ["x"]


def test_hidden_and_odd_elements():
    assert blocks("<p>a <span hidden>no</span><span style='display: none'>no <span>no</span></span> b</p><div hidden><p>no</p></div><p>c</p>") == ["a b", "c"]
    assert blocks("<p>a <math><mi>x</mi></math> <svg><title>no</title><text>seen</text></svg></p>") == ["a x seen"]
    assert blocks("<p>before <video>film<p>after <canvas>c") == ["before film", "after c"]
    assert blocks("<template><p>no</p></template><p>yes<script>var x = '<p>'") == ["yes"]
    assert blocks("<p>one<noscript><p>two") == ["one", "two"]
    assert blocks(None) == blocks("") == blocks("<!-- x") == []


def test_training_pages_are_drawn_whatever_their_order(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    same = pages.limit(1).crossJoin(spark.range(300).select(F.col("id").alias("_i"))).drop("_i")
    drawn = [html_text.learn(x, limit=20).p["o"] for x in (pages, pages.orderBy(F.desc("page_id")).repartition(7), pages.unionByName(same))]
    assert np.allclose(drawn[0], drawn[1])
    assert html_text.learn(pages.limit(0)).p["o"].shape == drawn[2].shape


def test_unknown_names_keep_the_main_text(spark):
    made = html_text.learn(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    para = "Dies ist ein langer Absatz über das Wetter, der in ganzen Sätzen erzählt, was gestern geschah. Er endet mit einem Punkt."
    page = f"<html><body><div class='kopf'><a href='/'>Start</a> <a href='/a'>Mehr</a></div><div class='inhalt'>{''.join(f'<p>{para}</p>' for _ in range(5))}</div><div class='fusszeile'><a href='/i'>Impressum</a></div></body></html>"
    text = html_text.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), made).first().text
    assert text.count(para) == 5 and "Impressum" not in text


def test_long_pages_and_clashing_names(spark):
    made = html_text.Labeller()
    page = "<article>" + "<p>some words here.</p>" * 30_000 + "</article>"
    df = spark.createDataFrame([(1, None, page, "x"), (1, "u", page, "x")], "page_id long, url string, html string, text string")
    assert html_text.extract(df, made).count() == 2


# ------------------------------------------------------------------ licences


def brute_best(text, templates):
    """The best cosine over all lines and all runs of terms as long as a template, by the definition."""
    term = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
    bags = [(a, Counter(term.findall(b.lower()))) for a, b in dict.fromkeys(templates)]
    df = Counter(t for _, bag in bags for t in bag)
    idf = {t: math.log((len(bags) + 1) / (n + 1)) + 1 for t, n in df.items()}
    unknown = max(idf.values())
    words = term.findall(text.lower())
    runs = [term.findall(x.lower()) for x in re.split(r"[\n\r]+", text)]
    said = lambda x: (re.findall(licenses.VERSION, x) or [""])[0].removesuffix(".0").removesuffix(".0")
    stated = [said(b.lower()) for _, b in dict.fromkeys(templates)]
    for _, bag in bags:
        n = sum(bag.values())
        runs += [words[i : i + n] for i in range(max(1, len(words) - n + 1))]
    best = 0.0
    for run in runs:
        tf = Counter(run)
        size = math.sqrt(sum((n * idf.get(t, unknown)) ** 2 for t, n in tf.items()))
        for (_, bag), version in zip(bags, stated, strict=True):
            if len(set(tf) & set(bag)) < min(2, len(bag)) or version not in ("", said(" ".join(run))):
                continue
            other = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
            dot = sum(n * idf[t] * tf[t] * idf[t] for t, n in bag.items() if t in tf)
            best = max(best, dot / size / other if size else 0)
    return best


FILES = {
    "a/LICENSE": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    "b/LICENSE": ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    "c/COPYING": ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation"),
    "d/x.c": ("BSD-3-Clause", "/* SPDX-License-Identifier: BSD-3-Clause */\nint x;"),
    "e/x.c": ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only\nint x;"),
    "f/x.c": ("Zlib", "// SPDX-License-Identifier: Zlib\nint x;"),
    "g/x.txt": (None, "This file is not licensed under the MIT License. Ask first."),
    "h/x.txt": (None, "It is no longer\nreleased under the MIT License."),
    "i/x.txt": ("MIT", "Not only good: it is released under the MIT License."),
    "j/x.txt": (None, None),
    "k/x.txt": ("MIT", "word " * 60_000 + "\nReleased under the MIT License.\n" + "word " * 60_000),
}


def test_licences_of_files(spark):
    rows = [(i, p, t) for i, (p, (_, t)) in enumerate(FILES.items())]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("line", F.lit("clash")).withColumn("row", F.lit(1))
    got = {r.path: (r.license, r.score) for r in licenses.license_scan(df).collect()}
    assert {p: a for p, (a, _) in got.items()} == {p: a for p, (a, _) in FILES.items()}
    for p in ("a/LICENSE", "d/x.c", "e/x.c", "i/x.txt"):
        assert math.isclose(got[p][1], brute_best(FILES[p][1], licenses.TEMPLATES), abs_tol=1e-5)


def test_folder_licences_come_from_licence_files_only(spark):
    tree = {
        "p/one.py": "Released under the MIT License.",
        "p/two.py": "code",
        "p/q/three.py": None,
        "r/LICENSE": "Released under the ISC License.",
        "r/s/COPYING": "Ask the owner before any use.",
        "r/s/x.py": "code",
        "r/s/t/LICENSE": "",
        "r/s/t/y.py": "code",
        "r/u/LICENSE": "Unknown terms.",
        "r/u/COPYING": "Licensed under CC BY 4.0.",
        "r/u/v/z.py": "code",
        "r/w/z.py": "code",
        "LICENSE": "Nothing known.",
    }
    got = {r.path: (r.license, r.evidence, r.from_dir) for r in licenses.license_scan(spark.createDataFrame([(i, *x) for i, x in enumerate(tree.items())], "doc_id long, path string, text string")).collect()}
    none = (None, "none", None)
    assert got == {
        "p/one.py": ("MIT", "own", None),
        "p/two.py": none,
        "p/q/three.py": none,
        "r/LICENSE": ("ISC", "own", None),
        "r/s/COPYING": none,
        "r/s/x.py": none,
        "r/s/t/LICENSE": none,
        "r/s/t/y.py": none,
        "r/u/LICENSE": none,
        "r/u/COPYING": ("CC-BY-4.0", "own", None),
        "r/u/v/z.py": ("CC-BY-4.0", "inherited", "r/u"),
        "r/w/z.py": ("ISC", "inherited", "r"),
        "LICENSE": none,
    }


def test_versions_expressions_and_dual_notices(spark):
    lesser = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    cases = {
        lesser.format("2.1"): ("LGPL-2.1", ["LGPL-2.1"], None),
        lesser.format("3"): ("LGPL-3.0", ["LGPL-3.0"], None),
        lesser.format("4"): (None, None, None),
        "Licensed under the Apache License, Version 1.1.": (None, None, None),
        "Licensed under the Apache-2.0 license.": ("Apache-2.0", ["Apache-2.0"], None),
        "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS LICENSE": ("EPL-2.0", ["EPL-2.0"], None),
        "Eclipse Public License - v 1.0": ("EPL-1.0", ["EPL-1.0"], None),
        "Boost Software License - Version 1.0 - August 17th, 2003": ("BSL-1.0", ["BSL-1.0"], None),
        "# SPDX-License-Identifier: CC-BY-NC-SA-4.0": ("CC-BY-NC-SA-4.0", ["CC-BY-NC-SA-4.0"], "CC-BY-NC-SA-4.0"),
        "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */ int x;": ("Apache-2.0", ["Apache-2.0", "MIT"], "(MIT OR Apache-2.0)"),
        "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 AND ISC": ("GPL-2.0", ["GPL-2.0", "ISC"], "GPL-2.0-only WITH Classpath-exception-2.0 AND ISC"),
        "SPDX-License-Identifier: LicenseRef-Own": (None, None, None),
        "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.": ("Apache-2.0", ["Apache-2.0", "MIT"], None),
    }
    got = licenses.license_scan(spark.createDataFrame([(i, f"{i}/x", t) for i, t in enumerate(cases)], "doc_id long, path string, text string"))
    assert [(r.license, r.licenses, r.expression) for r in got.orderBy("doc_id").collect()] == list(cases.values())


def test_licences_are_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    got = {r.doc_id: (r.score or 0.0) * (r.evidence == "own") for r in licenses.op7_licenses(spark, SF).collect()}
    for r in docs.orderBy(F.xxhash64("doc_id")).collect()[:25]:
        if len(r.text) < 4000 and not re.search(licenses.DENIED, r.text):
            want = brute_best(r.text, licenses.TEMPLATES)
            assert math.isclose(got[r.doc_id], want, abs_tol=1e-5) or (want < licenses.LEAST and got[r.doc_id] == 0)


# ------------------------------------------------------------------ whole tables through their queries


def test_tokens_of_all_documents_are_the_library(spark):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from quarry.llm import bpe

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in bpe.op1_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pieces_of_all_documents_are_the_library(spark):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = {}
    for r in packing.op4_packing(spark, SF).collect():
        by.setdefault(r.doc_id, []).append(r)
    total = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        pieces = sorted(by[r.doc_id], key=lambda p: p.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    used = {p.sequence_id for ps in by.values() for p in ps}
    assert len(used) <= -(-total // 2048) * 1.02 + 1


def test_predicted_languages_are_the_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"), 4, 2)), "text", "lang")
    who = langid.Identifier(langs, model)
    want = {r.doc_id: who.predict(r.text)[:2] for r in docs.collect()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.op2_langid(spark, SF).collect()}
    assert {i: (a, round(b, 9)) for i, (a, b) in got.items()} == {i: (a, round(b, 9)) for i, (a, b) in want.items()}
