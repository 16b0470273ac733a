"""Piece encoding against the library, whitening and product codes against plain numpy."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quarry.llm import codes, pieces, whitening

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", " \n\t ", "a", "It's  Ünïcode  \x1c x\x00y <s> <0x0A> İΣΑΣ 123 é", "x" * 5000, "wörd " * 4000, "a  b   c \n d \n\n e\t f\r\n  x", "▁▁ ▁x", "日本語 テスト 🙂", "﻿a", " " * 100 + "abc" + " " * 33, "same", "same", "=" * 999, *[" " * i + "a~" for i in range(40)], *[" " * i for i in range(15, 50)]]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(MODEL)


def packed(model, texts):
    return [np.frombuffer(x, "<i4").tolist() for x in pieces.Encoder(model).encode(texts)]


def test_pieces_are_the_library(spark, library):
    odd = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids int, n_tokens string")
    found = pieces.encode(odd, MODEL)
    got = {r.doc_id: r for r in pieces.decode(found, MODEL).collect()}
    assert len(got) == len(ODD)
    for i, text in enumerate(ODD):
        want = library.encode(text or "")
        assert (got[i].ids, got[i].n_tokens, got[i].text) == (want, len(want), library.decode(want))
    assert pieces.decode(pieces.encode(odd.where("doc_id < 0"), MODEL), MODEL).count() == 0


def test_random_texts_are_encoded_as_the_library_does(library, model):
    rng = random.Random(1)
    spelt = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = ["".join(rng.choices("ab te\n▁é日本🙂xyz=-._0123ingtheron  ", k=rng.randint(0, 200))) for _ in range(3000)]
    texts += ["".join(rng.choices(spelt, k=rng.randint(0, 60))) for _ in range(3000)] + ["".join(rng.choices("etaoinshr", k=20000))]
    assert packed(model, texts) == [library.encode(t) for t in texts]


def test_a_merge_that_makes_a_lower_pair_waits_for_it():
    """Pieces whose order of merges is not that of their making: y z is merged, then (x, yz) goes before the next (y, z)."""
    own = object.__new__(pieces.Pieces)
    own.size = own.width = 10
    pairs = sorted([(1 * 10 + 2, 5, 3), (3 * 10 + 1, 2, 4), (4 * 10 + 2, 9, 5)])  # yz = 3; (yz, y) = 4 goes first
    own.keys, own.ranks, own.made = (np.array([p[i] for p in pairs]) for i in range(3))
    ids, words = own.merged(np.array([1, 2, 1, 2, 1, 2]), np.array([0, 0, 0, 0, 1, 1]))
    assert ids.tolist() == [5, 3] and words.tolist() == [0, 1]


def test_any_ids_are_decoded_as_the_library_does(library, model):
    rng = random.Random(2)
    for _ in range(4000):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(0, 260), rng.randint(190, 240)]) for _ in range(rng.randint(0, 8))]
        assert model.text(np.array(ids, dtype=int)) == library.decode(ids)


def test_decode_keeps_other_columns(spark, library):
    rows = spark.createDataFrame([(1, None, "a"), (2, [], "b"), (3, library.encode("x y"), "c")], "doc_id long, ids array<int>, Text string")
    got = pieces.decode(rows.withColumnRenamed("Text", "kept"), MODEL)
    assert got.columns == ["doc_id", "ids", "kept", "text"]
    assert {(r.doc_id, r.kept, r.text) for r in got.collect()} == {(1, "a", ""), (2, "b", ""), (3, "c", "x y")}
    assert pieces.decode(rows, MODEL).columns == ["doc_id", "ids", "text"]


def test_sentencepiece_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pieces.op11_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def whole(vectors):
    return [v for v in vectors if v is not None and None not in v and np.isfinite(v).all()]


def vectors_with_odd_rows(seed, n, d):
    x = (np.random.default_rng(seed).standard_normal((n, d)) * np.linspace(3, 0.1, d)).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 3) if i % 3 else None, "m") for i, v in enumerate(x)]
    odd = [(n, None), (n + 1, [1.0, None] + [0.0] * (d - 2)), (n + 2, [float("nan")] * d), (n + 3, [float("inf")] * d), (n + 4, rows[0][1]), (n + 4, rows[0][1]), (None, rows[1][1]), (n + 5, [1.5]), (n + 6, [])]
    return rows + [(i, v, 1, "m") for i, v in odd]


VECTORS = "vec_id long, embedding array<float>, label int, code string"


@pytest.mark.parametrize("n,d", [(300, 40), (50, 6), (3, 5)])
def test_whitening_is_the_eigenvectors(spark, n, d):
    rows = vectors_with_odd_rows(n, n, d)
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).toPandas()
    x = np.array([np.floor(1024 * np.pad(v, (0, d - len(v)))).astype(np.int64) + 100_000 for v in whole([r[1] for r in rows])])
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][: min(8, d)], vectors[:, ::-1][:, : min(8, d)]
    assert len(got) == n * len(values) and (got.n == n).all() and got.identity_error.nunique() == 1
    alive = values > 1e-12 * values[0]
    for j in np.flatnonzero(alive):
        own = got[got.component == j + 1]
        want = np.sort(c @ vectors[:, j] / np.sqrt(values[j]))
        assert min(np.abs(np.sort(own.whitened) - want).max(), np.abs(np.sort(-own.whitened) - want).max()) < 1e-8
        assert abs(own.explained.iloc[0] / (values[j] / np.trace(c.T @ c / n)) - 1) < 1e-9
    assert got[got.component.isin(np.flatnonzero(~alive) + 1)].whitened.isna().all()
    assert got.identity_error[0] < 1e-9
    assert sorted(got[got.component == 1].deviation) == sorted(((n * x - s) ** 2).sum(1).tolist())


def test_whitening_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], None, ""), (2, [1.0, 2.0], None, "")], VECTORS)
    got = whitening.whiten(rows).collect()
    assert len(got) == 4 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error == 0 for r in got)
    for none in (rows.where("vec_id > 2"), spark.createDataFrame([(1, [], 1, ""), (2, None, 1, "")], VECTORS)):
        assert whitening.whiten(none).count() == 0
    assert whitening.exact_deviation(np.array([[2**40, 5]]), 2**20, [2**60 - 1, 0]) == [1 + 25 * 2**40]
    with pytest.raises(OverflowError):
        whitening.exact_deviation(np.array([[2**40]]), 2**30, [0])


def test_leading_components_of_a_steep_and_a_flat_spectrum():
    rng = np.random.default_rng(5)
    for values in (np.r_[1e6, 1e3, np.linspace(2, 1, 98)], np.linspace(1.2, 1, 100), np.r_[np.ones(12), np.zeros(88)], np.r_[np.full(9, 5.0), np.full(91, 4.999)]):
        q = np.linalg.qr(rng.standard_normal((100, 100)))[0]
        v = q * values @ q.T
        found, vectors = whitening.leading(lambda y, v=v: v @ y, 100, 8)
        assert np.allclose(found, np.sort(values)[::-1][:8], rtol=1e-10)
        assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12) and np.linalg.norm(v @ vectors - vectors * found) < 1e-9 * values.max()


def plain_codes(rows, d, parts=4, entries=8, rounds=2):
    kept = [(i, np.floor(256 * np.pad(np.array(v, dtype=float), (0, d - len(v)))).astype(int), label) for i, v, label, _ in rows if v is not None and None not in v and np.isfinite(v).all()]
    x = np.array([v for _, v, _ in kept]).reshape(len(kept), parts, -1)
    order = sorted((i, j) for j, (i, *_ ) in enumerate(kept) if i is not None)
    books = np.array([x[j] for _, j in order[:entries]]).transpose(1, 0, 2)
    for turn in range(rounds + 1):
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        at = far.argmin(-1)
        if turn < rounds:
            for p in range(parts):
                for k in range(books.shape[1]):
                    own = x[at[:, p] == k, p]
                    if len(own):
                        books[p, k] = [sum(col) // len(own) for col in own.T.tolist()]
    error = far.min(-1).sum(-1)
    by = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by[label] = by.get(label, 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for k in a), int(e), by[label], digest) for (i, _, label), a, e in zip(kept, at, error, strict=True))


@pytest.mark.parametrize("most", [codes.MOST_BYTES, 0])
def test_codes_are_the_plain_ones(spark, monkeypatch, most):
    monkeypatch.setattr(codes, "MOST_BYTES", most)  # both ways to join the totals
    rows = vectors_with_odd_rows(4, 200, 8)
    frame = spark.createDataFrame(rows, VECTORS)
    got = codes.product_codes(frame, parts=4, entries=8)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == plain_codes(rows, 8)
    assert codes.product_codes(frame.where("vec_id < 0")).count() == 0
    few = codes.product_codes(frame.where("vec_id < 3"), parts=4, entries=8).collect()
    assert [r.error for r in few] == [0, 0, 0]


def test_large_integers_are_multiplied_exactly():
    rng = np.random.default_rng(0)
    x, c = rng.integers(-(2**29), 2**29, (2, 5, 3)), rng.integers(-(2**29), 2**29, (2, 7, 3))
    want = [[[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in c[p]] for r in x[p]] for p in range(2)]
    assert codes.dots(x, c).tolist() == want
    assert sum(len(codes.limbs(a, 25)) for a in (x, c)) == 4


@pytest.mark.parametrize("unit", ['<p title="x', '<p t="" u=">"', '<p a=">', "<p a='>", "<noscript>", "<a", "</a ", "<!x", "<p a=\"'>x", '<b "><'])
@pytest.mark.parametrize("tail", ["", ">", '"', "'"])
def test_unbalanced_markup_is_read_in_linear_time(unit, tail):
    import time

    from quarry.llm import html_text

    page = unit * (1_000_000 // len(unit)) + tail
    start = time.time()
    html_text.blocks(page)
    assert time.time() - start < 10  # a megabyte; a square would take minutes


def test_articles_with_lists_tables_and_code(spark):
    """Blocks of every kind within an article are told as main text in training, and read back whole."""
    import random

    from quarry.llm import html_text

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    page = (
        '<body><nav><ul class="menu"><li><a href="/">Home</a></li></ul></nav><article><h1>A long title here</h1><p>First paragraph of the article, which has words.</p>'
        "<ul><li>The first item is a whole sentence of its own.</li><li>Second item</li></ul><p>Another paragraph follows the list and says more.</p>"
        "<table><tr><th>Name</th></tr><tr><td>alpha</td></tr></table><pre>x = 1</pre><blockquote>Quoted words of someone.</blockquote><p>The last paragraph ends the text here.</p></article>"
        '<div class="sidebar"><ul><li>Other story</li></ul></div><footer><p>Copyright 2024 All rights</p></footer></body>'
    )
    found = html_text.blocks(page)
    own = html_text.told(found)
    assert [b.text for b, y in zip(found, own, strict=True) if not y] == ["Home", "Other story", "Copyright 2024 All rights"]
    kinds = {b.inner.name[0] for _ in range(60) for b, y in html_text.enriched(list(zip(found, own, strict=True)), ["a b c d e"], random.Random(_)) if y}
    assert {"li", "td", "pre", "blockquote", "figcaption", "dd"} <= kinds
    labels = html_text.learn(pages).label([found])[0]
    wrong = sum(bool(a) != bool(b) for a, b in zip(labels, own, strict=True))
    print("wrong blocks", wrong, "of", len(found))
    assert wrong <= 2


def test_scores_beyond_64_bits_are_an_error(spark):
    from quarry.llm import topk

    rows = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [-1e9, 0.5])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(rows, every=1).collect()
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(rows.withColumn("embedding", rows.embedding).limit(0).union(spark.createDataFrame([(0, [1e300])], "vec_id long, embedding array<double>")), every=1).collect()


def test_every_language_is_learned(spark):
    from quarry.llm import langid

    rows = spark.createDataFrame([(i, f"l{i % 150}", " ".join(f"{chr(97 + i % 150 % 26)}{chr(97 + i % 150 // 26)}xq" for _ in range(5))) for i in range(450)], "doc_id long, lang string, text string")
    langs, _ = langid.learn(rows, "text", "lang")
    assert langs == sorted({f"l{i}" for i in range(150)})
