"""Rebuilding, re-embedding and moving collections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import base_of, canonical_name
from quarry.operators.chunking import chunk_documents
from quarry.operators.evaluation import flag_sessions, import_sessions
from quarry.operators.settings import validate_retrieval_settings
from quarry.operators.store import chunk_source_integrity, digests, read_chunks, rebuildable_names, uncovered_sources, verify_chunks, verify_digests, write_chunks


def corpus_estimates(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """source_file, chars, paragraphs, sentences, fixed, overlap, flagged: worst-case chunk counts per document."""
    n = F.char_length("text")
    paragraphs = F.size(F.filter(F.split("text", r"\n\s*\n"), lambda x: F.trim(x) != ""))
    sentences = F.size(F.filter(F.split("text", r"\. "), lambda x: F.trim(x) != ""))
    out = docs.where("text is not null").select("source_file", n.alias("chars"), paragraphs.alias("paragraphs"), sentences.alias("sentences"), F.ceil(n / size).alias("fixed"), (1 + F.greatest(F.lit(0), F.ceil((n - size) / F.lit(size - overlap)))).alias("overlap"))
    return out.withColumn("flagged", (F.col("chars") > 7_000_000) | (F.greatest("fixed", "overlap") > 8000) | (F.col("chars") + (F.col("overlap") - 1) * overlap > 8_000_000))


def package_manifest(chunks: DataFrame, by: str, settings: DataFrame | None = None) -> DataFrame:
    """Per collection: chunk_count, dimensions, sources, unresolved, fidelity; chunks: vector, source_sha256.

    Where ``chunks`` have chunk_strategy, chunk_size and chunk_overlap: also those of the settings
    (collection and the same columns), else of the first chunk by source_file and chunk_index.
    """
    aggs = [F.count("*").alias("chunk_count"), F.max(F.size("vector")).alias("dimensions"), F.count_distinct("source_sha256").alias("source_documents"), F.sum(F.col("source_sha256").isNull().cast("long")).alias("unresolved")]
    told = ["chunk_strategy", "chunk_size", "chunk_overlap"]
    own = all(c in chunks.columns for c in told)
    if own:
        aggs.append(F.min(F.struct("source_file", "chunk_index", *told)).alias("_first"))
    out = chunks.groupBy(by).agg(*aggs).withColumn("fidelity", F.when(F.col("unresolved") == 0, "with-sources").otherwise("chunks-only"))
    if not own:
        return out
    if settings is None:
        return out.select("*", *[F.col(f"_first.{c}").alias(c) for c in told]).drop("_first")
    saved = settings.select(F.col("collection").alias(by), *[F.col(c).alias(f"_{c}") for c in told])
    out = out.join(saved, by, "left")
    return out.select(*[c for c in out.columns if not c.startswith("_")], *[F.coalesce(F.col(f"_{c}"), F.col(f"_first.{c}")).alias(c) for c in told])


def tune_options(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: uncovered, rebuildable, can_rechunk, reason; with ``collection`` on both sides one row a collection."""
    if "collection" in chunks.columns and "collection" in sources.columns:
        return _tune_options_each(chunks, sources)
    gaps = uncovered_sources(chunks, sources).agg(F.count("*").alias("uncovered"))
    names = rebuildable_names(chunks, sources).agg(F.count("*").alias("rebuildable"))
    return _judged(gaps.join(F.broadcast(names)))  # one row each


def _judged(out: DataFrame) -> DataFrame:
    reason = F.when(F.col("rebuildable") == 0, "nothing to rebuild").when(F.col("uncovered") > 0, "sources are missing")
    return out.withColumn("can_rechunk", reason.isNull()).withColumn("reason", reason)


def _tune_options_each(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Names are told apart by their collection, which is written before them."""
    sep = "\x1f"

    def within(name: Column) -> Column:
        return F.concat(F.col("collection"), F.lit(sep), F.coalesce(name, F.lit("")))

    c = chunks.withColumn("source_file", within(F.col("source_file")))
    listed = sources.withColumn("filenames", F.transform("filenames", within)).withColumn("digest", within(F.col("digest")))
    of = F.substring_index("source_file", sep, 1).alias("collection")
    gaps = uncovered_sources(c, listed).groupBy(of).agg(F.count("*").alias("uncovered"))
    names = rebuildable_names(c, listed).groupBy(of).agg(F.count("*").alias("rebuildable"))
    every = chunks.select("collection").distinct().join(gaps, "collection", "left").join(names, "collection", "left")
    return _judged(every.select("collection", F.coalesce("uncovered", F.lit(0)).cast("long").alias("uncovered"), F.coalesce("rebuildable", F.lit(0)).cast("long").alias("rebuildable")))


def stale_sessions(sessions: DataFrame, collection: str, reason: str) -> DataFrame:
    named = sessions.sparkSession.range(1).select(F.lit(collection).alias("collection"))
    return flag_sessions(sessions, named, "stale", reason)


def rechunk(originals: DataFrame, chunks: DataFrame, sources: DataFrame, strategy: str, **settings) -> DataFrame:
    """New chunk rows of every stored name; refused where an original is missing or over a limit."""
    gate = tune_options(chunks.drop("collection"), sources.drop("collection")).first()
    if not gate["can_rechunk"]:
        raise ValueError(gate["reason"])
    stored = chunks.select(base_of(F.col("source_file")).alias("source_file")).union(chunks.select("source_file")).distinct()
    rows, failed = chunk_documents(originals.join(stored, "source_file", "left_semi"), strategy, **settings)
    if (first := failed.first()) is not None:
        raise ValueError(f"{first['source_file']} is over its limit of {first['kind']}")
    return rows


def rechunk_collection(path: str, collection: str, originals: DataFrame, chunks: DataFrame, sources: DataFrame, sessions: DataFrame, strategy: str, **settings) -> tuple[int, DataFrame]:
    """(version, sessions): the rebuilt chunks as a verified version of the table; the collection's sessions become stale."""
    fresh = rechunk(originals, chunks, sources, strategy, **settings)
    names = fresh.select("source_file").union(chunks.select(base_of(F.col("source_file")).alias("source_file"))).distinct()
    version = write_chunks(fresh, path, names=names)
    return version, stale_sessions(sessions, collection, "the collection was re-chunked")


def reembed(chunks: DataFrame, embed: Callable[[Column], Column], dims: int | None = None) -> DataFrame:
    """``chunks`` with new vectors for the same texts; a vector of another width than ``dims`` stops it."""
    out = chunks.withColumn("vector", embed(F.col("content")))
    if dims is None:
        return out
    fits = F.when(F.size("vector") == dims, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit(f"a vector is not {dims} wide but "), F.size("vector").cast("string"))))
    return out.withColumn("vector", fits)


def reembed_collection(path: str, collection: str, chunks: DataFrame, sessions: DataFrame, embed: Callable[[Column], Column], dims: int) -> tuple[int, DataFrame]:
    """(version, sessions): the same texts under new vectors as a verified version; the sessions become stale."""
    fresh = reembed(chunks, embed, dims)
    return write_chunks(fresh, path, expected=chunks.count()), stale_sessions(sessions, collection, "the collection was re-embedded")


# Kinds of index, and the metrics each serves.
INDEXES = {"flat": ("cosine", "dot", "l2-squared"), "hnsw": ("cosine", "dot", "l2-squared")}


def reindex(configs: DataFrame, collection: str, index: str, metric: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """``configs`` with the collection's new index and metric, once its chunks are verified unchanged.

    ``before`` and ``after``: id, props, vec (``store.digests``). Sessions stay as they are.
    """
    if metric not in INDEXES.get(index, ()):
        raise ValueError(f"no index {index!r} with metric {metric!r}")
    if (wrong := verify_chunks(before, after).first()) is not None:
        raise ValueError(f"chunk {wrong['id']}: {wrong['problem']}")
    own = F.col("collection") == collection
    return configs.withColumn("index_type", F.when(own, index).otherwise(F.col("index_type"))).withColumn("metric", F.when(own, metric).otherwise(F.col("metric")))


def embedding_compatible(manifest: DataFrame, settings: DataFrame) -> DataFrame:
    """collection, violations: a package's model and width against the settings'."""
    s = settings.select("collection", F.col("model").alias("_m"), F.col("dimensions").alias("_d"))
    v = F.array_compact(F.array(F.when(~F.col("model").eqNullSafe(F.col("_m")), "model"), F.when(~F.col("dimensions").eqNullSafe(F.col("_d")), "width")))
    return manifest.join(s, "collection").select("collection", F.array_join(v, ",").alias("violations"))


def expired_packages(packages: DataFrame, now: Column, hours: int, busy: DataFrame) -> DataFrame:
    due = F.col("finished_at") + F.expr(f"interval {hours} hours") <= now
    return packages.where(due).join(busy.select("package"), "package", "left_anti")


def import_target(wanted: DataFrame, taken: DataFrame, on_conflict: str) -> DataFrame:
    """collection, target, refused: abort, the first free name with the import's id, or replace."""
    t = taken.select("collection").distinct().withColumn("_t", F.lit(True))
    hit = F.coalesce("_t", F.lit(False))
    free = F.concat(F.col("collection"), F.lit("_imported_"), F.substring(F.sha2(F.col("collection").cast("string"), 256), 1, 8))
    out = wanted.join(t, "collection", "left").withColumn("_hit", hit).withColumn("_free", free).drop("_t")
    # Imported before under that name too: numbered on, past the greatest number that is taken.
    used = taken.select(F.regexp_extract("collection", r"^(.*?)(?:_(\d+))?$", 1).alias("_free"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("collection", r"^(.*?_imported_[0-9a-f]{8})_(\d+)$", 2), F.lit("")), F.lit("999999999")), F.lit(1)).cast("long").alias("_n"))
    used = used.where(F.col("_free").rlike("_imported_[0-9a-f]{8}$")).groupBy("_free").agg(F.max("_n").alias("_n"))
    named = F.when(F.col("_n").isNull(), F.col("_free")).otherwise(F.concat(F.col("_free"), F.lit("_"), (F.col("_n") + 1).cast("string")))
    target = F.when(F.col("_hit") & F.lit(on_conflict == "rename"), named).otherwise(F.col("collection"))
    return out.join(used, "_free", "left").select("collection", target.alias("target"), (F.col("_hit") & F.lit(on_conflict == "abort")).alias("refused"))


def readable_packages(manifests: DataFrame) -> DataFrame:
    """filename, collection, chunk_count, fidelity, created_at, readable; ``manifests``: filename, manifest (JSON text).

    A manifest that is no JSON object, or has a field of a wrong type, is listed as not readable.
    """
    v = F.try_parse_json("manifest")

    def field(path: str) -> Column:
        return F.try_variant_get(F.col("_v"), path, "variant")

    def kind(c: Column) -> Column:
        return F.coalesce(F.schema_of_variant(c), F.lit("VOID"))

    out = manifests.select("filename", v.alias("_v"))
    texts = {"collection": "$.collection.name", "fidelity": "$.fidelity", "created_at": "$.created_at"}
    ok = F.coalesce(F.schema_of_variant("_v"), F.lit("VOID")).startswith("OBJECT") & (kind(field("$.collection")).startswith("OBJECT") | (kind(field("$.collection")) == "VOID"))
    for path in texts.values():
        ok = ok & kind(field(path)).isin("STRING", "VOID")
    ok = ok & kind(field("$.collection.chunk_count")).rlike(r"^(BIGINT|VOID|DECIMAL\(\d+,0\))$")
    shown = [F.when(ok, F.try_variant_get(F.col("_v"), p, "string")).alias(n) for n, p in texts.items()]
    count = F.when(ok, F.try_variant_get(F.col("_v"), "$.collection.chunk_count", "long")).alias("chunk_count")
    return out.select("filename", shown[0], count, shown[1], shown[2], ok.alias("readable"))


def package_problems(manifest: DataFrame, files: DataFrame, actual: DataFrame, chunks: DataFrame, sources: DataFrame, settings: DataFrame, retrieval: DataFrame, sessions: DataFrame) -> list[tuple[str, DataFrame]]:
    """The gates of an import in their order, each with the rows that fail it.

    Digests of files, identity of sources (their digest is that of their content), chunks' sources,
    embedding model and width, sessions (each of the package's collection), retrieval settings.
    """
    named = manifest.select("collection").distinct()
    return [
        ("files", verify_digests(files, actual)),
        ("sources", sources.where(F.col("content").isNotNull() & (F.sha2(F.col("content").cast("binary"), 256) != F.col("digest"))).select("digest")),
        ("chunks", chunk_source_integrity(chunks, sources).select("id", "source_sha256")),
        ("embedding", embedding_compatible(manifest, settings).where("violations <> ''")),
        ("sessions", sessions.join(named, "collection", "left_anti").select("session", "collection")),
        ("settings", validate_retrieval_settings(retrieval).where(F.size("violations") > 0)),
    ]


def import_package(path: str, manifest: DataFrame, files: DataFrame, actual: DataFrame, chunks: DataFrame, sources: DataFrame, settings: DataFrame, retrieval: DataFrame, sessions: DataFrame, existing: DataFrame, taken: DataFrame, on_conflict: str = "abort") -> dict:
    """Import one package's chunks under a free name; all gates are passed before anything is written.

    The result: target, version (of the table under ``path``/target), sessions (under free ids),
    settings (ingest settings by that name), orphaned (sessions of a collection that is replaced).
    """
    for gate, wrong in package_problems(manifest, files, actual, chunks, sources, settings, retrieval, sessions):
        if (first := wrong.first()) is not None:
            raise ValueError(f"unsound {gate}: {first.asDict()}")
    place = import_target(manifest.select(canonical_name(F.col("collection")).alias("collection")), taken, on_conflict).first()
    if place["refused"]:
        raise ValueError(f"the collection {place['collection']} exists")
    expected = manifest.first()["chunk_count"]
    target = place["target"]
    rows = chunks.withColumn("collection", F.lit(target))
    version = write_chunks(rows, f"{path}/{target}", expected=expected, names=rows.select("source_file").distinct())
    stored = read_chunks(rows.sparkSession, f"{path}/{target}", rows.schema, version)
    properties = [c for c in rows.columns if c not in ("id", "vector")]
    if (wrong := verify_chunks(digests(rows, properties), digests(stored, properties), exact=on_conflict != "replace").first()) is not None:
        raise ValueError(f"chunk {wrong['id']}: {wrong['problem']}")
    out = {"target": target, "version": version, "sessions": import_sessions(sessions, existing, target), "settings": retrieval.withColumn("collection", F.lit(target)), "orphaned": None}
    if on_conflict == "replace":
        out["orphaned"] = flag_sessions(existing, taken.where(F.col("collection") == target).select("collection"), "orphaned", "the collection was replaced")
    return out
