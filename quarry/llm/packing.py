"""Best-fit packing of tokenised documents into fixed-length sequences by length patterns.

Only the histogram of piece lengths (at most ``length`` numbers, whatever the corpus) reaches the
driver. There, patterns of two to five pieces that nearly fill a sequence are enumerated, a
non-negative least-squares fit finds how often each is to be used, the counts are rounded down,
and what remains is packed by the largest piece that still fits. The plan is a list of
(piece length, ranks from-to, first sequence, offset) intervals; pieces find their place by their
rank among the pieces of the same length. The ranks come from two levels (salted groups of each
length, and the running sums of the groups' sizes), so a length that a third of all pieces have is
spread over many tasks.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.bpe import byte_letters, groups
from quarry.llm.common import cut, keyed_text, table

LENGTH = 2048
#: Pieces of text whose ids a task remembers; beyond it the cache starts anew.
CACHE_PIECES = 250_000
#: Groups that the pieces of one length, and the full ones that long documents give, are spread over.
SALTS, FULL_SALTS = 64, 4096
#: Intervals of a plan up to this many are broadcast (about 60 MB); more are joined by a shuffle.
MOST_INTERVALS = 1_000_000
UNSAFE = re.compile(r"\s \s")


class Tokens:
    """Byte-level BPE of whole texts as the tokenizer file says; remembers pieces between spaces.

    A token never holds a space except as its first byte, so a text may be cut before its single
    spaces; a text where a space stands between other white space is encoded whole.
    """

    def __init__(self, spec: str):
        import public_tokenizers
        import tiktoken

        spec = json.loads(spec)
        byte = {c: b for b, c in enumerate(byte_letters())}
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in specials}
        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=specials)
        self.specials = specials
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")")
        self.known: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def segment(self, text: str) -> bytes:
        if UNSAFE.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        fresh = set(rest).difference(self.known)
        if len(self.known) + len(fresh) > CACHE_PIECES:
            self.known, fresh = {}, set(rest)
        letters = self.encoding._encode_single_piece  # letters after one space are one piece; no pattern needed
        self.known.update((p, array("I", letters(" " + p)).tobytes() if p.isalpha() else self.plain(" " + p)) for p in fresh)
        return self.plain(first) + b"".join(map(self.known.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        if not any(s in text for s in self.specials):
            return self.segment(text)
        return b"".join(np.array([self.specials[s]], "<u4").tobytes() if i % 2 else self.segment(s) for i, s in enumerate(self.special.split(text)))


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: all full but, perhaps, the first."""
    first = n % length or min(n, length)
    return [(0, first), *((s, length) for s in range(first, n, length))] if n else []


def tokenised_pieces(df: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (packed little-endian u32) of every document. Narrow.

    Every document ends with ``end_id``, so null and empty texts give one piece of one token.
    """
    docs = keyed_text(df, id_col, text_col)
    spec = df.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(spec.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in groups(texts):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for k in range(a, b):
                    ids = tokens.encode(texts[k]) + end
                    for piece, (s, n) in enumerate(cuts(len(ids) // 4, length)):
                        for out, x in zip(rows, (k, piece, s, n, ids[4 * s : 4 * (s + n)]), strict=True):
                            out.append(x)
                of = batch.column(0).take(pa.array(rows[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([of, pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return docs.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids binary")


def patterns(counts: np.ndarray, length: int, grid: int = 12) -> np.ndarray:
    """Patterns (rows of up to 5 lengths, 0 = none) of pieces that occur and nearly fill a sequence."""
    have = np.flatnonzero(counts[:length])
    have = have[have > 0]
    if not len(have):
        return np.zeros((0, 5), dtype=np.int64)

    def largest(gap: np.ndarray) -> np.ndarray:
        """The largest length that occurs and fits each gap; 0 if none."""
        at = np.searchsorted(have, gap, side="right") - 1
        return np.where(at >= 0, have[np.maximum(at, 0)], 0)

    made = []
    two = largest(length - have)
    made.append(np.stack([have, two], axis=1))
    for k in (1, 2):  # the next smaller partners
        at = np.searchsorted(have, two) - k
        made.append(np.stack([have, np.where(at >= 0, have[np.maximum(at, 0)], 0)], axis=1))
    some = have[np.unique(np.linspace(0, len(have) - 1, grid).astype(int))]
    for mids in ([b] for b in some):
        gap = length - have - sum(mids)
        made.append(np.stack([have, *[np.full(len(have), b) for b in mids], largest(gap)], axis=1)[gap >= 0])
    for i, b in enumerate(some):
        for c in some[: i + 1]:
            gap = length - have - b - c
            ok = gap >= 0
            third = largest(gap)
            made.append(np.stack([have, np.full(len(have), b), np.full(len(have), c), third, largest(gap - third) * (third > 0)], axis=1)[ok])
    rows = np.concatenate([np.pad(m, ((0, 0), (0, 5 - m.shape[1]))) for m in made])
    rows = np.unique(-np.sort(-rows, axis=1), axis=0)
    total = rows.sum(axis=1)
    # Keep, for every largest length, the patterns that fill best.
    order = np.lexsort((-total, rows[:, 0]))
    rows, total = rows[order], total[order]
    place = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
    return rows[(place < 24) & (total <= length)]


def fit(rows: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative x that nearly minimises |A x - counts|: accelerated projected gradient."""
    n = len(counts)

    def apply(x: np.ndarray) -> np.ndarray:
        y = np.bincount(rows.ravel(), weights=np.repeat(x, rows.shape[1]), minlength=n)
        y[0] = 0
        return y

    v = np.ones(len(rows))
    for _ in range(20):  # largest eigenvalue of A'A
        r = apply(v)
        v = r[rows].sum(axis=1)
        top = np.linalg.norm(v)
        v /= top
    target = counts.astype(float).copy()
    target[0] = 0
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        r = apply(y) - target
        r[0] = 0
        new = np.maximum(0, y - r[rows].sum(axis=1) / top)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(counts: np.ndarray, length: int) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, number of such sequences) that use every piece of the histogram once."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[list[int], int]] = []

    def use(lengths: np.ndarray, times: int) -> int:
        kinds, each = np.unique(lengths, return_counts=True)
        times = int(min(times, (left[kinds] // each).min()))
        if times > 0:
            left[kinds] -= each * times
            out.append((sorted(lengths.tolist(), reverse=True), times))
        return times

    if left[length]:
        use(np.array([length]), int(left[length]))
    if len(rows := patterns(left, length)):
        x = np.floor(fit(rows, left[:length]) + 1e-6).astype(np.int64)
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 1:
                break
            use(rows[i][rows[i] > 0], int(x[i]))
    while left.any():  # best fit of the rest: the largest piece first, then the largest that fits
        have = np.flatnonzero(left)
        chosen, gap, spare = [], length, left[have].copy()
        top = len(have) - 1
        while top >= 0:
            top = min(top, int(np.searchsorted(have, gap, side="right")) - 1)
            while top >= 0 and not spare[top]:
                top -= 1
            if top < 0:
                break
            take = int(min(spare[top], gap // have[top]))
            chosen += [int(have[top])] * take
            gap -= take * int(have[top])
            spare[top] -= take
            top -= 1
        use(np.array(chosen), int(left.sum()))
    return out


def intervals(packed: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank from, rank to, first sequence, offset): which ranks of a length go where."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in packed:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), used.get(n, 0) + times, sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return rows


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset added; ``length`` is at most the sequence's.

    ``pieces`` is read twice: pass a written table. An empty table stays empty; ties and repeated
    rows get different places.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.when(F.col("length") == length, FULL_SALTS).otherwise(SALTS)).cast("int"))
    sizes = salted.groupBy("length", "_salt").count().collect()  # at most length * SALTS + FULL_SALTS rows
    counts = np.zeros(length + 1, dtype=np.int64)
    before = []
    for n, s, c in sorted(tuple(r) for r in sizes):
        before.append((n, s, int(counts[n])))
        counts[n] += c
    rows = intervals(plan(counts, length))  # a few times length rows
    starts = spark.createDataFrame(before, "length long, _salt int, _before long")
    places = spark.createDataFrame(rows, "length long, _from long, _to long, _first long, offset long")
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece")).cast("long") - 1)
    ranked = ranked.join(F.broadcast(starts), ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    p = places.withColumnRenamed("length", "_length")
    placed = ranked.join(F.broadcast(p) if len(rows) <= MOST_INTERVALS else p, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select(*pieces.columns, (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    pieces = tokenised_pieces(docs, tokenizer_path, length).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(cut(pieces), length)


def op4_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"))
