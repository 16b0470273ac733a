"""BPE encoding and decoding of whole texts with a word-end vocabulary.

Encoding: a text is split at the strings of special tokens, normalised, and cut into words. Words
that a task has not met yet are encoded together: the symbols of all of them lie in one flat
array, and each round finds the ranks of all adjacent pairs by binary search over the sorted pair
keys, then merges the lowest-ranked pair of every word at once. Every token of such a vocabulary
is made by one merge, so a merge never creates a pair of lower rank and a round may merge all
occurrences of a word's lowest pair.

Ids are packed as little-endian unsigned 32-bit integers. A null text counts as empty.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import keyed_text, table

#: Words kept per task; beyond it the cache starts anew, so memory stays bounded.
CACHE_WORDS = 500_000
#: Characters of text handled together.
GROUP_CHARS = 4_000_000
MOST_TOKENS = 1_000_000
NONE = np.iinfo(np.int64).max
SEPARATORS, WHITE = re.compile("[\x1c-\x1f]"), regex.compile(r"\p{White_Space}+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tables of a tokenizer file with word ends; small enough to broadcast (checked)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *specials.values()]) + 1
        if self.size > MOST_TOKENS:
            raise ValueError(f"vocabulary of {self.size} tokens; at most {MOST_TOKENS} are broadcast")
        self.tokens = [""] * self.size
        for t, i in [*vocab.items(), *specials.items()]:
            self.tokens[i] = t
        self.specials = specials
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.words = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")

    def pair_ranks(self, ids: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Rank of (ids[i], ids[i+1]), NONE where no merge exists or the two lie in different words."""
        key = ids[:-1] * self.size + ids[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(same & (self.keys[at] == key), self.ranks[at], NONE)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word, merged in rounds over one flat array."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ids, word = self.inner[flat], np.repeat(np.arange(len(raw)), sizes)
        last = np.cumsum(sizes) - 1
        ids[last] = self.final[flat[last]]
        done_ids, done_word = [], []
        while len(ids):
            same = word[:-1] == word[1:]
            rank = np.append(self.pair_ranks(ids, same), NONE)
            first = np.flatnonzero(np.append(True, ~same))
            least = np.minimum.reduceat(rank, first)
            span = np.diff(np.append(first, len(ids)))
            best = np.repeat(least, span)
            over = best == NONE
            if over.any():
                done_ids.append(ids[over])
                done_word.append(word[over])
                ids, word, rank, best = ids[~over], word[~over], rank[~over], best[~over]
                if not len(ids):
                    break
            merge = rank == best
            place = np.arange(len(ids))
            starts = merge & ~np.append(False, merge[:-1])
            merge &= (place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0  # aaa: the left pair
            ids = np.where(merge, self.made[np.where(merge, rank, 0)], ids)
            keep = ~np.append(False, merge[:-1])
            ids, word = ids[keep], word[keep]
        flat_ids, flat_word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(flat_word, kind="stable")
        packed = flat_ids[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(flat_word, minlength=len(words))) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def normalise(text: str) -> str:
    """NFC, then lower case letter by letter (no rule for a final sigma)."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


class Encoder:
    """Encodes texts; remembers the ids of white-space-separated pieces within one task."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.words = vocab, regex.compile(vocab.words)
        self.special = re.compile("(" + "|".join(map(re.escape, vocab.specials)) + ")") if vocab.specials else None
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > CACHE_WORDS:
            self.known = {}
        split = {p: [p] if p.isalpha() else self.words.findall(p) for p in pieces}
        fresh = list({w for ws in split.values() for w in ws})
        ids = dict(zip(fresh, self.vocab.encode_words(fresh), strict=True)) if fresh else {}
        self.known.update((p, b"".join([ids[w] for w in ws])) for p, ws in split.items())

    def segments(self, text: str) -> list[list[str] | bytes]:
        if self.special is None or not any(s in text for s in self.vocab.specials):
            return [pieces_of(normalise(text))]
        return [np.array([self.vocab.specials[s]], "<u4").tobytes() if i % 2 else pieces_of(normalise(s)) for i, s in enumerate(self.special.split(text))]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.segments(t) for t in texts]
        pieces = {p for segs in parts for s in segs if isinstance(s, list) for p in s}
        fresh = pieces.difference(self.known)
        if len(self.known) + len(fresh) > CACHE_WORDS:
            fresh = pieces  # the cache starts anew
        if fresh:
            self.learn(fresh)
        get = self.known.__getitem__
        return [b"".join([s if isinstance(s, bytes) else b"".join(map(get, s)) for s in segs]) for segs in parts]


def pieces_of(text: str) -> list[str]:
    """What white space separates; the information separators are no white space to the vocabulary."""
    if SEPARATORS.search(text):
        return [p for p in WHITE.split(text) if p]
    return text.split()


def groups(texts: list[str], chars: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``chars`` characters (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (packed), n_tokens. Narrow: no shuffle.

    Null and empty texts have no ids; repeated rows stay; other columns are ignored; an empty
    table gives an empty table.
    """
    docs = keyed_text(df, id_col, text_col)
    tables = df.sparkSession.sparkContext.broadcast(Vocabulary(vocab_path))
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in groups(texts):
                ids = encoder.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.mapInArrow(run, f"doc_id {id_type.simpleString()}, ids binary, n_tokens long")


def decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text; the tokens joined by spaces, special ones kept. Null ids: empty."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"), *[F.col(c) for c in df.columns if c not in (id_col, ids_col, "doc_id", "ids", "text")])
    tables = df.sparkSession.sparkContext.broadcast(Vocabulary(vocab_path))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = tables.value.tokens.__getitem__
        for batch in batches:
            packed = batch.column(1)
            for a in range(0, len(packed), 512):
                ids = packed.slice(a, 512).to_pylist()
                texts = [" ".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in ids]
                yield pa.RecordBatch.from_arrays([*[c.slice(a, 512) for c in batch.columns], pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return rows.mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str, vocab_path: str | None = None) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    path = vocab_path or public_tokenizers.path("word_bpe_49k.json")
    ids = encode(table(spark, sf_dir, "documents"), path)
    return decode(ids, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
