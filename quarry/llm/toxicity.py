"""Toxicity by the nearest labelled examples.

Features are words and word beginnings associated with a label in one part of the labelled rows
(the selecting part). The other part (the examples) is indexed as TF-IDF vectors of these features:
an inverted index with the greatest weight of every block of examples. A text's nearest examples by
cosine are found exactly: blocks are visited in the order of their bounds, reading only their own
postings, until no bound can beat the k-th best. The examples vote with their cosines, weighted by
how many labelled rows each stands for, against a small weight of the base rate. Isotonic regression
over the examples' own votes, each without itself, turns votes into rates of label 1. A text without
features gets the rate of label 1 among examples without features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import annotated, cut, keyed_text, table
from quarry.llm.langid import held_out

#: Labelled rows learned from, per label and part, at most (rows are drawn by a hash of their ids).
SELECTING, EXAMPLES = 3000, 4000
MOST_FEATURES = 8192
#: What a feature needs: rows of the label, and log-odds between the labels.
LEAST_ROWS, LEAST_ODDS = 4, 2.0
NEAREST, BLOCK = 25, 128
#: Weight of the base rate among the votes.
BASE = 0.3
THRESHOLD = 0.7
CACHE_WORDS = 200_000
WORD = re.compile(r"[^\W\d_]+")


def features(piece: str) -> list[str]:
    """Words of a lower-case piece, and their beginnings of 4, 5 and 6 letters."""
    words = [piece] if piece.isalpha() else WORD.findall(piece)
    return [f for w in words for f in (w, *("^" + w[:n] for n in (4, 5, 6) if len(w) >= n))]


class Vectoriser:
    """Texts as counts of chosen features; remembers pieces that hold any."""

    def __init__(self, chosen: list[str]):
        self.number = {f: i for i, f in enumerate(chosen)}
        self.seen: set[str] = set()
        self.hits: dict[str, list[int]] = {}

    def counts(self, text: str | None) -> Counter[int]:
        pieces = (text or "").lower().split()
        fresh = set(pieces).difference(self.seen)
        if fresh:
            if len(self.seen) + len(fresh) > CACHE_WORDS:
                self.seen, self.hits, fresh = set(), {}, set(pieces)
            self.seen |= fresh
            for p in fresh:
                if found := [n for f in features(p) if (n := self.number.get(f)) is not None]:
                    self.hits[p] = found
        get = self.hits.get
        return Counter([n for p in pieces if (hit := get(p)) for n in hit])


def unit(counts: Counter[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.fromiter(counts, dtype=np.int64, count=len(counts))
    w = (1 + np.log(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))) * idf[at]
    return at, w / np.sqrt(w @ w)


class Index:
    """Block-max inverted index of labelled examples; exact nearest ones by cosine."""

    def __init__(self, n_features: int, rows: list[tuple[int, int, dict[int, int]]], stands_for: dict[int, float]):
        full = [r for r in rows if r[2]]
        df = np.bincount([f for r in full for f in r[2]], minlength=n_features)
        self.idf = np.log((1 + len(rows)) / (1 + df)) + 1
        self.example = np.array([r[0] for r in full], dtype=np.int64)
        self.label = np.array([r[1] for r in full], dtype=np.int64)
        self.vote = np.array([stands_for[r[1]] for r in full], dtype=np.float64)
        f, doc, w = [], [], []
        for i, r in enumerate(full):
            at, x = unit(Counter(r[2]), self.idf)
            f.append(at)
            doc.append(np.full(len(at), i))
            w.append(x)
        # Examples of the same heaviest feature lie together, so that bounds of blocks differ.
        order = sorted(range(len(full)), key=lambda i: (f[i][w[i].argmax()], full[i][1], full[i][0]))
        place = np.empty(len(full), dtype=np.int64)
        place[order] = np.arange(len(full))
        f, doc, w = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (f, doc, w))
        doc = place[doc]
        self.example, self.label, self.vote = self.example[order], self.label[order], self.vote[order]
        order = np.lexsort((doc, f))
        self.doc, self.weight = doc[order].astype(np.int64), w[order].astype(np.float64)
        self.begin = np.searchsorted(f[order], np.arange(n_features + 1))
        self.blocks = -(-len(full) // BLOCK)
        #: Where the postings of a feature in a block begin; those of its next block follow.
        self.at_block = np.searchsorted(f[order] * self.blocks + self.doc // BLOCK, np.arange(n_features * self.blocks + 1)).astype(np.int32)
        self.most = np.zeros((n_features, self.blocks))
        np.maximum.at(self.most, (f[order], self.doc // BLOCK), self.weight)
        weigh = lambda found: (sum(stands_for[r[1]] * r[1] for r in found), sum(stands_for[r[1]] for r in found))
        one, every = weigh(rows)
        self.rate = one / every if every else 0.0
        one, every = weigh([r for r in rows if not r[2]])
        self.bare = (one + self.rate) / (every + 1)
        self.curve: tuple[np.ndarray, np.ndarray] | None = None

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k best with a positive cosine, best first; ties to the smaller example id.

        Only the postings of visited blocks are read.
        """
        bound = w @ self.most[at]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        docs, scores = np.empty(0, np.int64), np.empty(0)
        done, step = 0, 4
        while done < len(order):
            if len(scores) >= k and scores[k - 1] > bound[order[done]] + 1e-12:
                break
            here = order[done : done + step]
            cell = (at[:, None] * self.blocks + here).ravel()
            begin = self.at_block[cell]
            n = self.at_block[cell + 1] - begin
            read = np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
            slot = np.repeat(np.tile(np.arange(len(here)), len(at)), n) * BLOCK + self.doc[read] % BLOCK
            total = np.bincount(slot, weights=np.repeat(np.repeat(w, len(here)), n) * self.weight[read], minlength=len(here) * BLOCK)
            some = np.flatnonzero(total)
            docs = np.concatenate([docs, here[some // BLOCK] * BLOCK + some % BLOCK])
            scores = np.concatenate([scores, total[some]])
            best = np.lexsort((self.example[docs], -scores))[:k]
            docs, scores = docs[best], scores[best]
            done, step = done + step, step * 4
        return docs, scores

    def voted(self, counts: Counter[int], leave: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """The weighted vote of the nearest examples, without the example of id ``leave``; None of them: the base rate."""
        docs, cosines = self.nearest(*unit(counts, self.idf), NEAREST + (leave is not None))
        if leave is not None:
            other = self.example[docs] != leave
            docs, cosines = docs[other][:NEAREST], cosines[other][:NEAREST]
        if not len(docs):
            return self.bare, docs, cosines
        votes = cosines * self.vote[docs]
        base = BASE * float(np.mean(self.vote[docs]))
        return float((votes @ self.label[docs] + base * self.rate) / (votes.sum() + base)), docs, cosines

    def calibrate(self, votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Fit the curve from votes to rates of label 1: isotonic regression over examples that didn't vote for themselves."""
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # weight, weighted vote, weighted label, rows
        for v, y, w in zip(votes[order], labels[order], weights[order], strict=True):
            pools.append([w, w * v, w * y, 1])
            while len(pools) > 1 and (pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0] or pools[-2][1] * pools[-1][0] == pools[-1][1] * pools[-2][0]):
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
        if pools:
            w, v, y, n = np.array(pools).T
            rate = np.maximum.accumulate((y / w * n + self.rate) / (n + 1))  # one row of the base rate in each pool
            self.curve = (v / w, rate)

    def calibrated(self, vote: float) -> float:
        """The rate of label 1 at a vote; a thousandth of the vote itself keeps the order of texts within a pool."""
        return vote if self.curve is None else 0.999 * float(np.interp(vote, *self.curve)) + 0.001 * vote

    def score(self, counts: Counter[int]) -> tuple[float, np.ndarray, np.ndarray]:
        if not counts or not len(self.label):
            return self.bare, np.empty(0, np.int64), np.empty(0)
        vote, docs, cosines = self.voted(counts)
        return (self.calibrated(vote) if len(docs) else vote), docs, cosines


def drawn(labels: DataFrame, selecting: int = SELECTING, examples: int = EXAMPLES) -> tuple[dict[int, int], DataFrame]:
    """Rows by label, and (doc_id, label, part) of the drawn ones: part 0 selects features, part 1 holds the examples.

    ``labels``: doc_id, label. Only these two columns are read, before any text is. Of each label the
    ``selecting`` smallest and the ``examples`` greatest hashes of ids are drawn, at most half of the
    rows for each part, so no row is in both. An id with several rows counts once, by its greatest
    label; rows without id or with another label than 0 and 1 count for nothing.
    """
    known = cut(labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label")))
    total = {r[0]: r[1] for r in known.groupBy("label").count().collect()}  # two rows at most
    draw = F.xxhash64("doc_id", F.lit("draw"))
    parts = []
    for y, n in sorted(total.items()):
        own = known.where(F.col("label") == y)
        parts.append(own.orderBy(draw, "doc_id").limit(min(selecting, n // 2)).withColumn("part", F.lit(0)))
        parts.append(own.orderBy(draw.desc(), F.desc("doc_id")).limit(min(examples, n // 2)).withColumn("part", F.lit(1)))
    if not parts:
        return total, known.withColumn("part", F.lit(0))
    return total, cut(reduce(DataFrame.unionByName, parts))


def learn(docs: DataFrame, labels: DataFrame, selecting: int = SELECTING, examples: int = EXAMPLES) -> tuple[list[str], Index]:
    """Features and index from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, label) names.

    At most 2 * (selecting + examples) texts are read, whatever the size of the tables: their ids are
    drawn from the labels alone and broadcast to the documents. Null texts count for nothing; of
    several texts of one id the smallest counts.
    """
    total, ids = drawn(labels, selecting, examples)
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")  # bounded by the limits above
    rows = cut(texts.groupBy("doc_id", "label", "part").agg(F.min("text").alias("text")).select("doc_id", "text", "label", "part"))
    part_a, part_b = rows.where("part = 0").drop("part"), rows.where("part = 1").drop("part")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())
        n = [0, 0]

        def rows() -> pa.RecordBatch:
            names = list(both[0].keys() | both[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([both[0][f] for f in names], pa.int64()), pa.array([both[1][f] for f in names], pa.int64())], ["feature", "n0", "n1"])

        for batch in batches:
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                both[y].update({f for p in set(text.lower().split()) for f in features(p)})
                n[y] += 1
                if len(both[0]) + len(both[1]) > 500_000:
                    yield rows()
                    both[0].clear(), both[1].clear()
        yield rows()
        yield pa.RecordBatch.from_arrays([pa.array([""], pa.string()), pa.array([n[0]], pa.int64()), pa.array([n[1]], pa.int64())], ["feature", "n0", "n1"])

    counted = part_a.mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = cut(counted.where(f"feature = '' or n1 >= {LEAST_ROWS} or n0 >= {LEAST_ROWS}"))
    n0, n1 = (counted.where("feature = ''").select("n0", "n1").first() or (0, 0))
    odds = F.log((F.col("n1") + 0.5) / (F.lit(n1 + 0.5) - F.col("n1") + 0.5)) - F.log((F.col("n0") + 0.5) / (F.lit(n0 + 0.5) - F.col("n0") + 0.5))
    best = counted.where("feature <> ''").withColumn("odds", odds).where(F.abs("odds") >= LEAST_ODDS).orderBy(F.desc(F.abs("odds") * F.sqrt(F.greatest("n0", "n1"))), "feature").limit(MOST_FEATURES)
    chosen = sorted(r[0] for r in best.select("feature").collect())
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Vectoriser(shared.value)
        for batch in batches:
            found = [make.counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array([list(c.items()) for c in found], pa.map_(pa.int64(), pa.int64()))], ["doc_id", "label", "counts"])

    rows_b = [tuple(r) for r in part_b.mapInArrow(vectors, "doc_id long, label int, counts map<bigint,bigint>").collect()]  # bounded by the examples drawn
    rows_b.sort(key=lambda r: r[:2])
    held = Counter(r[1] for r in rows_b)
    index = Index(len(chosen), rows_b, {y: total[y] / max(1, held[y]) for y in total})
    indexed = docs.sparkSession.sparkContext.broadcast((chosen, index))

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, index = indexed.value
        make = Vectoriser(chosen)
        for batch in batches:
            found = [(y, index.voted(c, i)[0]) for i, text, y in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if (c := make.counts(text))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64())], ["label", "vote"])

    votes = part_b.mapInArrow(left_out, "label int, vote double").orderBy("vote", "label").collect()  # bounded like the examples
    y = np.array([r[0] for r in votes], dtype=np.int64)
    index.calibrate(np.array([r[1] for r in votes], dtype=np.float64), y, np.array([total[k] / held[k] for k in y.tolist()], dtype=np.float64))
    return chosen, index


def fit(rows: DataFrame, selecting: int = SELECTING, examples: int = EXAMPLES) -> tuple[list[str], Index]:
    """As ``learn``, from rows that hold both text and label (doc_id, text, label)."""
    return learn(rows, rows.where("text is not null").select("doc_id", "label"), selecting, examples)


def scored_in_place(df: DataFrame, chosen: list[str], index: Index, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """``df`` with the score of each row as a further column ``name``, which ``df`` must not have. Narrow; null and empty texts as in ``score``."""
    shared = df.sparkSession.sparkContext.broadcast((chosen, index))  # bounded by MOST_FEATURES and EXAMPLES

    def make():
        chosen, index = shared.value
        vectoriser = Vectoriser(chosen)
        return lambda texts: [pa.array([min(1.0, max(0.0, index.score(vectoriser.counts(t))[0])) for t in texts], pa.float64())]

    return annotated(df, text_col, f"`{name}` double", make)


def score(df: DataFrame, chosen: list[str], index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, evidence (nearest examples: doc_id, label, cosine) of every row. Narrow.

    Null and empty texts get the score of texts without features; without labelled rows every score
    is 0; repeated rows stay; other columns are ignored.
    """
    docs = keyed_text(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast((chosen, index))  # bounded by MOST_FEATURES and EXAMPLES
    kind = docs.schema["doc_id"].dataType.simpleString()
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, index = shared.value
        make = Vectoriser(chosen)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                found = [index.score(make.counts(t)) for t in part.column(1).to_pylist()]
                why = [[{"doc_id": i, "label": y, "cosine": c} for i, y, c in zip(index.example[d[:3]].tolist(), index.label[d[:3]].tolist(), x[:3].tolist(), strict=True)] for _, d, x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([min(1.0, max(0.0, f[0])) for f in found], pa.float64()), pa.array(why, evidence)], ["doc_id", "score", "evidence"])

    scored = docs.mapInArrow(run, f"doc_id {kind}, score double, evidence array<struct<doc_id:bigint,label:int,cosine:double>>")
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, label of the rows of ``labels`` whose toxic mark is known."""
    return labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").alias("label"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of the other two folds."""
    docs = table(spark, sf_dir, "documents")
    labels = known_labels(table(spark, sf_dir, "labels")).where(~held_out(F.col("doc_id"), 3, 1))
    chosen, index = learn(docs, labels)
    scored = score(docs, chosen, index)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted", "evidence")
