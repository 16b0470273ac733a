"""SentencePiece encoding and decoding of whole texts with a BPE model, by vectorised merge rounds.

A text gets a space in front, spaces become U+2581, and it is cut into segments: a run of U+2581
with what follows it, or a line break. No piece spans two segments (checked when a model is read),
so segments are encoded apart, and those that a task has not met yet together. Their symbols lie in
one flat array that is cut further wherever two characters are neighbours in no piece. Each round
takes the lowest pair rank of every word (a segmented minimum), merges its occurrences from the
left at once, and compacts the array, until no pair remains.

A merge may make a pair of lower or equal rank, which goes first. So a word's occurrences are
merged in one round only up to the first that makes such a pair; the next round sees it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import CACHE_WORDS, MOST_TOKENS, NONE, groups
from quarry.llm.common import keyed_text, table

SPACE = "▁"
#: What an unknown piece is written as, and bytes that are no UTF-8.
UNKNOWN, BROKEN = " ⁇ ".encode(), "�".encode()


class Pieces:
    """Tables of a model file; small enough to broadcast (checked)."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        piece, norm = pb.ModelProto.SentencePiece, model.normalizer_spec
        if len(model.pieces) > MOST_TOKENS:
            raise ValueError(f"model of {len(model.pieces)} pieces; at most {MOST_TOKENS} are broadcast")
        kinds = [p.type for p in model.pieces]
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or model.trainer_spec.treat_whitespace_as_suffix or {piece.USER_DEFINED, piece.UNUSED} & set(kinds):
            raise ValueError("only BPE models without own or unused pieces and with space in front of words are read")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that keep texts as they are, but for spaces, are read")
        self.prefix, self.size = norm.add_dummy_prefix, len(kinds)
        self.unknown = kinds.index(piece.UNKNOWN)
        self.bytes = np.full(256, self.unknown)
        self.surface, self.kind = [], kinds
        for i, p in enumerate(model.pieces):
            if p.type == piece.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
            self.surface.append(bytes([int(p.piece[1:-1], 16)]) if p.type == piece.BYTE else p.piece.replace(SPACE, " ").encode() if p.type == piece.NORMAL else UNKNOWN if p.type == piece.UNKNOWN else b"")
        self.fallback = model.trainer_spec.byte_fallback
        self.byte = np.array([k == piece.BYTE for k in kinds])
        self.control = np.array([k == piece.CONTROL for k in kinds])
        self.spaced = np.array([p.type == piece.NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == piece.NORMAL}
        scores = sorted({-model.pieces[i].score for i in normal.values()})
        place = {s: r for r, s in enumerate(scores)}
        rank = {p: place[-model.pieces[i].score] for p, i in normal.items()}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces with a space behind other characters are not read")
        self.symbols(normal)
        self.pairs(normal, rank)
        self.segment = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if not any("\n" in p for p in normal if len(p) > 1) else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.run = self.longest_run(rank)

    def longest_run(self, rank: dict[str, int]) -> int:
        """The longest run of spaces that is a piece, where longer ones are filled with it from the left; else 0.

        So it is if runs are merged last and all alike (thus from the left), and no word takes two spaces.
        """
        runs = {p for p in rank if len(p) > 1 and not p.strip(SPACE)}
        last = max(rank.values(), default=0)
        alike = runs and all((rank[p] == last) == (p in runs) for p in rank if len(p) > 1)
        if not alike or any(p.startswith(2 * SPACE) for p in rank.keys() - runs):
            return 0
        longest = max(map(len, runs))
        return longest if len(self.encode_segments([SPACE * longest])[0]) == 4 else 0

    def symbols(self, normal: dict[str, int]) -> None:
        """Symbol of each code point: its piece, else a number beyond the pieces, or -1 where no piece has it."""
        chars = sorted({c for p in normal for c in p})
        alone = [c for c in chars if c not in normal]
        self.extra = np.array([ord(c) for c in alone], dtype=np.int64)
        self.symbol = np.full(0x110000, -1, dtype=np.int32)
        for c in chars:
            self.symbol[ord(c)] = normal[c] if c in normal else self.size + alone.index(c)
        self.width = self.size + len(alone)

    def pairs(self, normal: dict[str, int], rank: dict[str, int]) -> None:
        """Sorted keys of all pairs of symbols that make a piece, and of neighbours within pieces."""
        known = normal | {chr(c): self.size + i for i, c in enumerate(self.extra.tolist())}
        found = [(known[p[:i]] * self.width + known[p[i:]], rank[p], n) for p, n in normal.items() for i in range(1, len(p)) if p[:i] in known and p[i:] in known]
        table = np.array(sorted(found), dtype=np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.made = (np.ascontiguousarray(table[:, i]) for i in range(3))
        self.near = np.array(sorted({known[a] * self.width + known[b] for p in normal for a, b in zip(p, p[1:], strict=False)}), dtype=np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of each pair of symbols; NONE where it makes no piece or ``may`` is false."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = may & (a >= 0) & (b >= 0) & (self.keys[at] == key) if len(self.keys) else np.zeros(len(key), bool)
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.made[at], -1)

    def cut(self, text: str) -> list[str]:
        """Parts that merge apart. Of a long run of spaces, whole runs go first: what is left has all that a word could take."""
        found = self.segment.findall(text)
        if not self.run or SPACE * (self.run + 1) not in text:
            return found
        out = []
        for s in found:
            whole = max(len(s) - len(s.lstrip(SPACE)) - 1, 0) // self.run
            out += [SPACE * self.run] * whole + [s[whole * self.run :]]
        return out

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Packed ids of each segment, merged in rounds over one flat array."""
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        point = np.frombuffer("".join(segments).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        ids, owner = self.symbol[point].astype(np.int64), np.repeat(np.arange(len(segments)), sizes)
        ids[ids < 0] = -1 - point[ids < 0]  # kept for their bytes
        key = ids[:-1] * self.width + ids[1:]
        at = np.minimum(np.searchsorted(self.near, key), max(len(self.near) - 1, 0))
        near = (self.near[at] == key) & (ids[:-1] >= 0) & (ids[1:] >= 0) & (owner[:-1] == owner[1:]) if len(self.near) else np.zeros(len(key), bool)
        word = np.cumsum(np.append(0, ~near)) if len(ids) else np.empty(0, np.int64)
        flat, order = self.merged(ids, word)
        own = owner[np.flatnonzero(np.append(True, ~near))][order] if len(ids) else owner
        flat, own = self.with_bytes(flat, own)
        ends = (np.cumsum(np.bincount(own, minlength=len(segments))) * 4).tolist()
        packed = flat.astype("<i4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merged(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, their words) when no word has a pair left."""
        rank, made = self.look_up(ids[:-1], ids[1:], word[:-1] == word[1:])
        rank, made = np.append(rank, NONE)[: len(ids)], np.append(made, -1)[: len(ids)]
        done: list[tuple[np.ndarray, np.ndarray]] = [(ids[:0], word[:0])]
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            span = np.diff(np.append(first, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, first), span)
            over = best == NONE
            if over.any():
                done.append((ids[over], word[over]))
                ids, word, rank, made, best = (x[~over] for x in (ids, word, rank, made, best))
                if not len(ids):
                    break
            merge = rank == best
            at = np.flatnonzero(merge)
            run = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
            at = at[(at - np.repeat(at[run], np.diff(np.append(run, len(at))))) % 2 == 0]  # aaa: the left pair
            at = self.before_lower(ids, word, made, best, at)
            ids[at] = made[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            new = (np.cumsum(keep) - 1)[at]
            ids, word, rank, made = (x[keep] for x in (ids, word, rank, made))
            changed = np.zeros(len(ids), bool)
            changed[new] = True
            changed[np.maximum(new - 1, 0)] = True
            fresh = np.flatnonzero(changed)
            inner = fresh[fresh < len(ids) - 1]
            rank[fresh], made[fresh] = NONE, -1
            rank[inner], made[inner] = self.look_up(ids[inner], ids[inner + 1], word[inner] == word[inner + 1])
        flat, words = (np.concatenate([d[i] for d in done]) for i in range(2))
        order = np.argsort(words, kind="stable")
        return flat[order], words[order]

    def before_lower(self, ids: np.ndarray, word: np.ndarray, made: np.ndarray, best: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The merges ``at``, of each word only up to the first that makes a pair which goes before the next."""
        last = len(ids) - 1
        left, right = np.maximum(at - 1, 0), np.minimum(at + 2, last)
        just = np.append(False, at[1:] == at[:-1] + 2)  # the symbol to the left has been merged before
        before = np.where(just, np.append(-1, made[at[:-1]]), ids[left])
        low, _ = self.look_up(before, made[at], (at > 0) & (word[left] == word[at]))
        high, _ = self.look_up(made[at], ids[right], (at + 2 <= last) & (word[right] == word[at]))
        stop = np.flatnonzero(np.minimum(low, high) <= best[at])
        if not len(stop):
            return at
        words, where = np.unique(word[at[stop]], return_index=True)
        end = np.searchsorted(words, word[at])
        end = np.minimum(end, len(words) - 1)
        return at[(words[end] != word[at]) | (at <= at[stop][where][end])]

    def with_bytes(self, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces replaced by the pieces of their bytes, or by the unknown piece."""
        odd = np.flatnonzero((ids < 0) | (ids >= self.size))
        if not len(odd):
            return ids, own
        point = np.where(ids[odd] < 0, -1 - ids[odd], self.extra[np.clip(ids[odd] - self.size, 0, None)] if len(self.extra) else 0)
        distinct, which = np.unique(point, return_inverse=True)
        spelt = [self.bytes[list(chr(c).encode())] if self.fallback else np.array([self.unknown]) for c in distinct.tolist()]
        times = np.ones(len(ids), dtype=np.int64)
        times[odd] = np.array([len(s) for s in spelt])[which]
        out, start = np.repeat(ids, times), (np.cumsum(times) - times)[odd]
        for k in range(4):
            has = times[odd] > k
            out[start[has] + k] = np.array([s[min(k, len(s) - 1)] for s in spelt])[which[has]]
        return out, np.repeat(own, times)

    def text(self, ids: np.ndarray) -> str:
        """The text of ids; control pieces are empty, bytes that are no UTF-8 become U+FFFD."""
        said = np.flatnonzero(~self.control[ids])
        spelt = list(map(self.surface.__getitem__, ids.tolist()))
        if len(said) and self.prefix and self.spaced[ids[said[0]]]:
            spelt[said[0]] = spelt[said[0]][1:]
        try:
            if b"" not in spelt:
                return b"".join(spelt).decode()
        except UnicodeDecodeError:
            pass
        whole = ~self.byte[ids]  # runs of bytes are read apart
        cuts = np.flatnonzero(whole[1:] | whole[:-1]) + 1
        return "".join(mended(b"".join(spelt[a:b])) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True))


def mended(raw: bytes) -> str:
    """UTF-8 with every byte that belongs to no character replaced by itself."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[at : at + e.start].decode(), BROKEN.decode()]
            at += e.start + 1
    return "".join(out)


class Encoder:
    """Encodes texts; remembers the packed ids of segments within one task."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.known: dict[str, bytes] = {}

    def segments(self, text: str) -> list[str]:
        """Parts of the text, spaces as U+2581, that merge apart; where spaces are single, line breaks may be left within."""
        if not text:
            return []
        if self.pieces.prefix and "  " not in text and text[0] != " " and SPACE not in text:
            return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")
        return self.pieces.cut((SPACE if self.pieces.prefix else "") + text.replace(" ", SPACE))

    def learn(self, fresh: set[str]) -> None:
        parts = {s: self.pieces.cut(s) for s in fresh if "\n" in s}
        new = list((fresh - parts.keys()).union(*parts.values()))
        ids = dict(zip(new, self.pieces.encode_segments(new), strict=True))
        self.known.update(ids)
        self.known.update((s, b"".join([ids[p] for p in ps])) for s, ps in parts.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian 32-bit integers) of each text."""
        parts = [self.segments(t) for t in texts]
        asked = set().union(*parts)
        fresh = asked.difference(self.known)
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known, fresh = {}, asked
        if fresh:
            self.learn(fresh)
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in parts]


def listed(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array of int), n_tokens. Narrow: no shuffle.

    Null and empty texts have no ids; repeated rows and null ids stay; other columns are ignored,
    whatever their names; very long texts are encoded whole; an empty table gives an empty table.
    """
    docs = keyed_text(df, id_col, text_col)
    tables = df.sparkSession.sparkContext.broadcast(Pieces(model_path))
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in groups(texts):
                ids = encoder.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), listed(ids), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.mapInArrow(run, f"doc_id {id_type.simpleString()}, ids array<int>, n_tokens long")


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with a further column ``text_col`` (which replaces one of that name): the text of its ids. Narrow.

    Null and empty ids give an empty text, null entries count as left out; ids that are no piece are
    an error. Every other column stays; an empty table gives an empty table.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != text_col.lower() or c == ids_col])
    if ids_col.lower() == text_col.lower():
        raise ValueError("ids and text need two names")
    tables = df.sparkSession.sparkContext.broadcast(Pieces(model_path))
    at, names = kept.columns.index(ids_col), [*kept.columns, text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = tables.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = []
                for x in part.column(at):
                    ids = x.values.drop_null().to_numpy() if x.is_valid else np.empty(0, np.int64)
                    if len(ids) and not 0 <= ids.min() <= ids.max() < pieces.size:
                        raise ValueError("an id is no piece of the model")
                    texts.append(pieces.text(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, `{text_col}` string")


def op11_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    ids = encode(table(spark, sf_dir, "documents"), path)
    spelt = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decode(ids, path).select("doc_id", "n_tokens", F.sha2(spelt.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
