"""Language identification by mixture inference.

A model holds, for each learned language, smoothed probabilities of hashed letter trigrams (word
edges included), counted by Spark over the labelled rows. A document is a mixture: its words are
drawn from languages with unknown proportions. Expectation-maximisation estimates the proportions
from the words' n-gram likelihoods, and the set of languages grows from the best single one as long
as the likelihood, less a penalty per language (half a log of the number of words), grows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import annotated, cut, keyed_text, table

BITS = 15
#: Labelled rows learned from, per language, as an expected number (rows are drawn by a hash).
ROWS = 4000
#: Languages whose shares are sent to every task; with more, rows are shuffled to them.
MOST_SHARES = 200_000
#: Likelihoods kept per task (words times languages); beyond it the cache starts anew.
CACHE_WORDS = 800_000
#: No word counts for more than this many nats in favour of one language.
MOST = 12.0
STEPS = 8
UNKNOWN = "und"
#: Log-likelihood of a trigram by chance: below it, on average, no learned language explains a text.
CHANCE = -BITS * math.log(2)


def trigrams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigram, number of its piece) of every letter; other characters count as space."""
    joined = " ".join(["", *pieces, ""])
    if not joined.isascii():
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        kinds, at = np.unique(codes, return_inverse=True)
        letter = np.array([chr(k).isalpha() for k in kinds])[at]
    else:
        codes = np.frombuffer(joined.encode(), dtype=np.uint8).astype(np.uint32)
        letter = ((codes >= 97) & (codes <= 122)) | ((codes >= 65) & (codes <= 90))
    gap = codes == 32
    codes = np.where(letter, codes, 32).astype(np.uint32)
    owner = np.cumsum(gap) - 1
    mid = np.flatnonzero(letter)
    x = codes[mid - 1] * np.uint32(0x9E3779B1) ^ codes[mid] * np.uint32(0x85EBCA77) + codes[mid + 1] * np.uint32(0xC2B2AE3D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (x >> np.uint32(32 - BITS)).astype(np.int64), owner[mid]


def learn(rows: DataFrame, text_col: str, lang_col: str, limit: int = ROWS, id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [trigram, language]) from rows with text and language.

    About ``limit`` rows of each language are drawn by a hash of their
    id; one table of trigram counts per language (2**15 numbers) comes to the driver. Rows whose text
    or language is null count for nothing; without rows no language is learned.
    """
    known = rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(limit)) / F.count("*")).alias("share"))
    share = cut(share)  # a row a language
    drawn = known.join(F.broadcast(share) if share.count() <= MOST_SHARES else share, "lang").where(F.pmod(F.xxhash64("i", F.lit("learn")), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in tables:
                    tables[lang] = np.zeros(1 << BITS, dtype=np.int64)
                tables[lang] += np.bincount(trigrams(text.lower().split())[0], minlength=1 << BITS)
        for lang, t in tables.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(t[at])], ["lang", "code", "n"])

    counted = drawn.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n")).collect()
    langs = sorted({r[0] for r in counted})
    tables = np.zeros((1 << BITS, len(langs)))
    of = {x: i for i, x in enumerate(langs)}
    for lang, code, n in counted:
        tables[code, of[lang]] = n
    smooth = tables + 0.5
    return langs, np.log(smooth / smooth.sum(axis=0)) if langs else smooth


def mixture(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the columns of x (log-likelihoods of words) and the log-likelihood of the mixture."""
    top = x.max(axis=1)
    p = np.exp(x - top[:, None])
    share = np.full(x.shape[1], 1 / x.shape[1])
    for _ in range(STEPS):
        r = p * share
        share = (r / r.sum(axis=1)[:, None]).mean(axis=0)
    return share, float(np.log(p @ share).sum() + top.sum())


def proportions(x: np.ndarray) -> np.ndarray:
    """Language proportions of a document from its words' log-likelihoods [word, language]."""
    single = x.sum(axis=0)
    chosen = [int(single.argmax())]
    share, best = np.ones(1), float(single.max())
    penalty = 0.5 * np.log(len(x)) + 2.0
    while len(chosen) < x.shape[1]:
        here = x[:, chosen].max(axis=1)
        gain = np.maximum(x - here[:, None], 0).sum(axis=0)  # no mixture gains more
        tries = [(mixture(x[:, [*chosen, j]]), j) for j in np.flatnonzero(gain > penalty) if j not in chosen]
        if not tries:
            break
        (new, value), j = max(tries, key=lambda t: t[0][1])
        if value - best <= penalty:
            break
        chosen.append(int(j))
        share, best = new, value
    out = np.zeros(x.shape[1])
    out[chosen] = share
    return out


class Identifier:
    """Predicts texts; remembers the likelihoods of words within one task."""

    def __init__(self, langs: list[str], model: np.ndarray):
        self.langs, self.model = langs, model
        self.reset()

    def reset(self, rows: int = 0) -> None:
        self.row: dict[str, int] = {}
        self.used = 0
        # The last column is a word's number of trigrams. One block for the whole cache: nothing is copied as it fills.
        self.table = np.zeros((max(rows, CACHE_WORDS // max(1, len(self.langs))), len(self.langs) + 1))

    def words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods [word, language] of the words that hold a letter, and their numbers of trigrams."""
        fresh = list(set(pieces).difference(self.row))
        if len(self.row) + len(fresh) > len(self.table):
            fresh = list(set(pieces))
            self.reset(len(fresh))
        if fresh:
            codes, owner = trigrams(fresh)
            x = np.zeros((len(fresh), len(self.langs)))
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
            if len(owner):
                x[owner[start]] = np.add.reduceat(self.model[codes], start, axis=0)
                x = np.maximum(x, x.max(axis=1, keepdims=True) - MOST)
            letters = np.zeros(len(fresh), dtype=bool)
            letters[owner] = True
            end = self.used + int(letters.sum())
            at = iter(range(self.used, end))
            self.row.update((w, next(at) if ok else -1) for w, ok in zip(fresh, letters.tolist(), strict=True))
            self.table[self.used : end, :-1] = x[letters]
            self.table[self.used : end, -1] = np.bincount(owner, minlength=len(fresh))[letters]
            self.used = end
        at = np.fromiter(map(self.row.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        found = self.table[at[at >= 0]]
        return found[:, :-1], found[:, -1]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, its proportion, and the mean log-likelihood of a trigram by each word's best language."""
        x, n = self.words(text.lower().split()) if text and self.langs else (np.empty((0, 0)), None)
        if not len(x):
            return UNKNOWN, 0.0, -math.inf
        share = proportions(x)
        at = int(share.argmax())
        return self.langs[at], float(min(1.0, share[at])), float(x.max(axis=1).sum() / n.sum())


def identify(df: DataFrame, langs: list[str], model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the proportion of that language) of every row. Narrow.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if no
    language was learned; repeated rows stay; other columns are ignored.
    """
    return identified(keyed_text(df, id_col, text_col), langs, model).select("doc_id", F.col("_lang_pred").alias("lang_pred"), F.col("_lang_share").alias("score"))


def identified(df: DataFrame, langs: list[str], model: np.ndarray, text_col: str = "text", names: tuple[str, str, str] = ("_lang_pred", "_lang_share", "_lang_fit")) -> DataFrame:
    """``df`` with the language, its share and the mean log-likelihood of a trigram of every row. Narrow.

    ``names`` are the new columns' names, which ``df`` must not have.
    """
    shared = df.sparkSession.sparkContext.broadcast((langs, model))  # 2**15 numbers a language

    def make():
        identifier = Identifier(*shared.value)

        def found(texts: list[str | None]) -> list[pa.Array]:
            each = [identifier.predict(t) for t in texts]
            return [pa.array([e[0] for e in each], pa.string()), pa.array([e[1] for e in each], pa.float64()), pa.array([e[2] for e in each], pa.float64())]

        return found

    return annotated(df, text_col, "`{}` string, `{}` double, `{}` double".format(*names), make)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the other three folds."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    langs, model = learn(docs.where(~out), "text", "lang")
    return identify(docs, langs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
