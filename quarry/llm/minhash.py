"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes the set of its word shingles, as 64-bit hashes; texts with equal sets form a
   class, of which one representative goes on.
2. Signatures of 128 minima are banded; representatives that share a band lie in one bucket.
3. Every member of a bucket is compared with the bucket's smallest id (a star, never all pairs), in
   batches of 32 minima: after each batch the pair is dropped if the posterior probability that its
   similarity reaches the threshold is below the miss probability. Buckets whose members are not
   joined by survivors then are compared block by block in the same way; a task returns the edges
   of a spanning forest. The components of all survivors are the clusters.
4. Within clusters, links are verified on the full sets: each text with one partner first; clusters
   that are not one component then, block by block between components, again returning forests.

A pair of similarity J shares no band with probability (1 - J^5)^25: 4e-7 at 0.85, 5e-5 at 0.8.
"""

from __future__ import annotations

import hashlib

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, digest, drop, keyed_text, table, unused
from quarry.llm.components import components, extended
from quarry.llm.embedding_dedup import local_roots

HASHES, BANDS, ROWS, BATCH = 128, 25, 5, 32
#: Probability at which a pair counts as surely below the threshold.
MISS = 1e-6
#: Members of one bucket that are compared within one task.
BLOCK = 512
#: Ids with digests up to this many are broadcast (about 50 MB once hashed); more are joined by a
#: shuffle of the texts, with the same rows as result.
MOST_BROADCAST = 500_000
#: Shingles of one side of a block when links are verified (32 MB).
MOST_SHINGLES = 1 << 22
#: Shared shingles counted at once when a block is verified.
COLUMNS = 8192

_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20)
_LETTER = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    k, step = 1, base
    while k < n:  # doubling
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(step)
        step = step * step & _MASK
        k *= 2
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word shingles. Words: what stands between ASCII white space, A-Z in lower case."""

    def __init__(self, words: int):
        self.words, self.up, self.down = words, _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)

    def hashes(self, text: str) -> np.ndarray:
        """One hash per word: a polynomial over its bytes, from running sums over the whole text."""
        raw = np.frombuffer(text.encode("utf-8").lower(), dtype=np.uint8)
        if not len(raw):
            return np.empty(0, dtype=np.uint64)
        if len(raw) > len(self.up):
            self.up, self.down = _powers(_BASE, 2 * len(raw)), _powers(_INVERSE, 2 * len(raw))
        word = np.zeros(len(raw) + 2, dtype=np.int8)
        word[1:-1] = ~_SPACE[raw]
        edge = np.diff(word)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_LETTER[raw] * self.up[: len(raw)], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def set(self, text: str | None) -> np.ndarray:
        """Distinct shingles, sorted; a text of fewer words is one shingle, without words none."""
        w = self.hashes(text or "")
        n = min(self.words, len(w))
        if not n:
            return w
        x = np.full(len(w) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            x += w[i : len(w) - n + 1 + i] * _STEPS[i]
        return np.unique(mix(x))


def signature(shingles: np.ndarray) -> np.ndarray:
    keys = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(keys), 2048):
        np.minimum(least, (_A * keys[None, i : i + 2048] + _B).min(axis=1), out=least)
    return least


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For 32, 64, 96 and 128 compared minima: the matches below which P(J >= threshold) < miss.

    The prior of J is uniform, so the posterior is a Beta distribution, summed on a fine grid.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(logs - logs.max())
            if p[grid >= threshold].sum() >= miss * p.sum():
                out.append(m)
                break
    return out


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, digest, n_shingles, print (of the set), sig of every row; a row without words has no print."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                sets = [shingler.set(t) for t in part.column("text").to_pylist()]
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sigs = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(list(map(len, sets)), pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "digest", "n_shingles", "print", "sig"])

    return docs.mapInArrow(run, f"doc_id {id_type}, digest binary, n_shingles long, print binary, sig binary")


def bands(reps: DataFrame) -> DataFrame:
    """(key, rep): one row for every band of every representative."""
    mult = _STEPS[:ROWS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
            rows = sig[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = mix((rows * mult).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(_BASE))
            rep = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), rep], ["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key long, rep long")


def few(rows: DataFrame) -> DataFrame:
    """``rows`` (a table of ids and digests), marked to be broadcast if it is small; else joins shuffle."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def _sided(pairs: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with ``column`` of both ends as ``column``_a and ``column``_b."""
    for end in ("a", "b"):
        pairs = pairs.join(side.select(F.col("rep").alias(end), F.col(column).alias(f"{column}_{end}")), end)
    return pairs


def survivors(pairs: DataFrame, reps: DataFrame, least: list[int]) -> DataFrame:
    """The pairs that no batch of compared minima rules out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            alive = np.arange(len(x))
            found = np.zeros(len(x), dtype=np.int64)
            for k, m in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                found[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
                alive = alive[found[alive] >= m]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(alive)), batch.column("b").take(pa.array(alive))], ["a", "b"])

    return _sided(pairs, reps, "sig").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """(rep, shingles) of the representatives ``chosen`` (rep, doc_id, digest), of whose equal rows one is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingler.set(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["rep", "shingles"])

    chosen = chosen.select("rep", F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    texts = docs.join(few(chosen), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    return texts.groupBy("rep").agg(F.min("text").alias("text")).mapInArrow(run, "rep long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * |A & B| >= percent * |A | B|, on the full sets of both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                keep = []
                for p, q in zip(part.column("shingles_a"), part.column("shingles_b"), strict=True):
                    x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
                at = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([part.column("a").take(at), part.column("b").take(at)], ["a", "b"])

    return _sided(pairs, sets, "shingles").select("a", "b", "shingles_a", "shingles_b").mapInArrow(run, "a long, b long")


def local_edges(rep: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """A star for each component of the local graph: never more edges than vertices."""
    root = local_roots(len(rep), a, b)
    at = np.flatnonzero(root != np.arange(len(rep)))
    return pd.DataFrame({"a": rep[root[at]], "b": rep[at]})


def further(members: DataFrame, reps: DataFrame, least: list[int]) -> DataFrame:
    """Edges that join what survives the batches within buckets, block against block."""
    blocks = members.withColumn("_n", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("_i", F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int"))
    dealt = blocks.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select("key", F.least("_i", "_j").alias("_p"), F.greatest("_i", "_j").alias("_q"), "rep", "label")
    dealt = dealt.join(reps.select("rep", "sig"), "rep")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rep", ignore_index=True)
        sig = np.frombuffer(b"".join(g["sig"]), dtype=np.uint32).reshape(-1, HASHES)
        label, rep = g["label"].to_numpy(), g["rep"].to_numpy()
        left, right = [], []
        for start in range(0, len(rep), 64):
            x, y = (v.ravel() for v in np.meshgrid(np.arange(start, min(start + 64, len(rep))), np.arange(start, len(rep)), indexing="ij"))
            ok = (x < y) & (label[x] != label[y])
            x, y = x[ok], y[ok]
            found = np.zeros(len(x), dtype=np.int64)
            for k, m in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                found += (sig[x, part] == sig[y, part]).sum(axis=1)
                ok = found >= m
                x, y, found = x[ok], y[ok], found[ok]
            left.append(x)
            right.append(y)
        return local_edges(rep, np.concatenate(left), np.concatenate(right))

    return dealt.groupBy("key", "_p", "_q").applyInPandas(run, "a long, b long").distinct()


def exact_links(sets: list[np.ndarray], percent: int, different: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``different`` labels whose sets reach the similarity, from counts of shared shingles."""
    size = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(sets)), size)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    of, code = of[shared], code[shared]
    names, code = np.unique(code, return_inverse=True)
    count = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    of, code = of[order], code[order]
    for start in range(0, len(names), COLUMNS):
        part = slice(*np.searchsorted(code, [start, start + COLUMNS]))
        held = np.zeros((len(sets), min(COLUMNS, len(names) - start)), dtype=np.float32)
        held[of[part], code[part] - start] = 1
        count += held @ held.T
    count = count.astype(np.int64)
    ok = 100 * count >= percent * (size[:, None] + size[None, :] - count)
    x, y = np.nonzero(np.triu(ok & different, 1))
    return x, y


def within_clusters(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges that join exactly linked texts of different labels, in clusters that hold several labels.

    ``members``: rep, cluster, label, n_shingles. Blocks are bounded by texts and by shingles, of
    which one very long text makes a block of its own. A large label fills blocks of its own, small
    labels share blocks; two blocks of the same label are not compared.
    """
    sizes = members.groupBy("cluster", "label").agg(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / MOST_SHINGLES).alias("load"))
    small = sizes.where("load < 0.5").groupBy("cluster").agg(F.ceil(2 * F.sum("load")).alias("parts"))
    shape = cut(sizes.join(small, "cluster", "left"))
    alone = F.col("load") >= 0.5
    spread = F.pmod(F.xxhash64("rep"), F.ceil("load"))
    block = F.when(alone, F.xxhash64("label", spread)).otherwise(F.pmod(F.xxhash64("label"), F.col("parts")))
    dealt = cut(members.join(shape, ["cluster", "label"]).select("rep", "cluster", "label", block.alias("block"), F.when(alone, F.col("label")).alias("only")))
    every = cut(dealt.select("cluster", "block", "only").distinct())
    other = every.select("cluster", F.col("block").alias("block_b"), F.col("only").alias("only_b"))
    pairs = every.join(other, "cluster").where("block <= block_b and (only is null or only_b is null or only <> only_b)")
    pairs = pairs.select("cluster", F.col("block").alias("p"), F.col("block_b").alias("q"))
    sent = pairs.select("cluster", F.col("p").alias("block"), "p", "q").unionByName(pairs.where("p <> q").select("cluster", F.col("q").alias("block"), "p", "q"))
    rows = dealt.join(cut(sent), ["cluster", "block"]).select("cluster", "p", "q", "rep", "label").join(sets, "rep")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        label, rep = g["label"].to_numpy(), g["rep"].to_numpy()
        x, y = exact_links([np.frombuffer(v, np.uint64) for v in g["shingles"]], percent, label[:, None] != label[None, :])
        return local_edges(rep, x, y)

    return rows.groupBy("cluster", "p", "q").applyInPandas(run, "a long, b long").distinct()


def labelled(rows: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """``rows`` (rep, ...) with the component of rep as ``name``; its own id where it has none."""
    return rows.join(of.select(F.col("node").alias("rep"), F.col("component").alias(name)), "rep", "left").withColumn(name, F.coalesce(name, "rep"))


def near_rows(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the text), n_shingles, component_id, kept, grouped, stays of every row.

    Links: 100 * |A & B| >= percent * |A | B| of the sets of ``words``-word shingles. Rows are told
    apart by their texts, never by ids: a null id and repeated ids are fine. component_id is the
    smallest id of the row's group, null if no row of it has one; kept tells whether it is the row's
    own. A null or blank text has an empty set and is no part of a group (``grouped``). ``stays`` is
    true for the row of the smallest id of each group (of several, that of the smallest digest, and
    for all rows equal in both), and for rows without group.
    """
    docs = keyed_text(df, id_col, text_col).withColumn("digest", digest())
    least = least_matches(percent / 100)
    rows = cut(sketched(docs, words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "n_shingles", "sig")).alias("x")
    reps = rows.where("print is not null").groupBy("print").agg(first).select("print", "x.doc_id", "x.digest", "x.n_shingles", "x.sig")
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()))  # written at once, so the numbers stay
    one = reps.select("rep", "sig")
    banded = bands(one)
    hubs = cut(banded.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).where("n > 1"))
    members = cut(banded.join(hubs, "key"))
    stars = cut(survivors(members.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), one, least))
    clusters = cut(components(stars))
    named = labelled(members.where("n > 2"), clusters, "label")
    mixed = named.groupBy("key").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a != _b").select("key")
    more = cut(further(named.join(cut(mixed), "key", "left_semi"), one, least))
    if not more.isEmpty():
        clusters = cut(extended(clusters, more))
    about = cut(clusters.withColumnRenamed("node", "rep").join(reps.select("rep", "doc_id", "digest", "n_shingles"), "rep"))
    sets = cut(shingle_sets(docs, about, words))
    # One exact comparison for every text first: with the smallest partner it has, or its cluster's smallest number.
    partner = stars.groupBy("b").agg(F.min("a").alias("a"))
    lone = clusters.where("node <> component").select(F.col("node").alias("b"), F.col("component").alias("_c")).join(partner, "b", "left")
    links = cut(verified(lone.select(F.coalesce("a", "_c").alias("a"), "b"), sets, percent))
    labels = cut(components(links))
    inner = labelled(about.select("rep", F.col("component").alias("cluster"), "n_shingles"), labels, "label")
    several = inner.groupBy("cluster").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a != _b").select("cluster")
    rest = cut(within_clusters(cut(inner.join(cut(several), "cluster", "left_semi")), sets, percent))
    if not rest.isEmpty():
        labels = cut(extended(labels, rest))
    whose = reps.select("rep", "print", "doc_id", "digest").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    several = whose.where("component <> rep").select("component").distinct()
    heads = whose.join(several, "component", "left_semi").groupBy("component").agg(F.min(best).alias("head"))
    classes = cut(whose.join(few(cut(heads)), "component", "left").select("print", F.coalesce("head", best).alias("head")))
    for done in (hubs, members, stars, more, about, sets, links, rest, reps):
        drop(done)
    out = rows.select("doc_id", "digest", "n_shingles", "print").join(classes, "print", "left")
    grouped = F.col("head").isNotNull()
    component = F.when(grouped, F.col("head.doc_id")).otherwise(F.col("doc_id"))
    own = F.col("doc_id").eqNullSafe(component)
    stays = ~grouped | (own & (F.col("digest") == F.col("head.digest")))
    return out.select("doc_id", "digest", "n_shingles", component.alias("component_id"), own.alias("kept"), grouped.alias("grouped"), stays.alias("stays"))


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; the columns are those of ``near_rows``.

    A null or blank text links with nothing; a row without id takes part in groups and has their
    smallest id, or null; rows that repeat an id stay, each with the group of its own text. Other
    columns are ignored; an empty table gives an empty table.
    """
    return near_rows(df, words, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def without_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each group of near-duplicates.

    The row of the group's smallest id stays, of rows with equal id and text any one. Null and blank
    texts stay, each row of them.
    """
    decided = cut(near_rows(docs, words, percent, id_col, text_col).where("grouped").groupBy("doc_id", "digest").agg(F.max("stays").alias("stays"), F.count("*").alias("n")))
    own, other_id, other = unused(docs, "own_digest", "other_id", "other_digest")
    marked = docs.withColumn(own, digest(text_col))
    same = F.col(id_col).eqNullSafe(F.col(other_id)) & (F.col(own) == F.col(other))
    keys = [F.col("doc_id").alias(other_id), F.col("digest").alias(other)]
    apart = decided.where("not stays or n > 1").select(*keys)
    kept = marked.join(few(apart), same, "left_anti").drop(own)
    repeated = decided.where("stays and n > 1").select(*keys)
    if repeated.isEmpty():
        return kept
    once = marked.join(few(repeated), same, "left_semi").dropDuplicates([id_col, own]).drop(own)
    return kept.unionByName(once)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents: three words, a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g FROM w
), sets AS MATERIALIZED (SELECT doc_id, len(g) AS n, hash(list_sort(g)) AS h, g FROM s),
reps AS MATERIALIZED (SELECT h, min(doc_id) AS rep, any_value(n) AS n, arg_min(g, doc_id) AS g FROM sets WHERE n > 0 GROUP BY h),
e AS MATERIALIZED (SELECT rep, n, unnest(g) AS x FROM reps),
common AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c) UNION SELECT b, a FROM common WHERE 100 * c >= 85 * (na + nb - c)),
reach(node, component) AS (SELECT rep, rep FROM reps UNION SELECT l.b, r.component FROM reach r JOIN links l ON l.a = r.node),
label AS (SELECT node, min(component) AS component FROM reach GROUP BY node)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, coalesce(l.component, s.doc_id) AS component_id, coalesce(l.component, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN reps r ON r.h = s.h AND s.n > 0 LEFT JOIN label l ON l.node = r.rep
"""
