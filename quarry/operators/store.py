"""The chunk store: versions of documents, their sources, and what verifies them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions.text import base_of, in_family, property_digest, vector_digest
from quarry.operators.written import written


def index_sources(files: DataFrame) -> DataFrame:
    """digest, filenames (distinct, sorted), size, first_seen, last_seen; files: name, content, seen."""
    rows = files.select("name", "seen", F.sha2(F.col("content").cast("binary"), 256).alias("digest"), F.octet_length("content").cast("long").alias("size"))
    return rows.groupBy("digest").agg(F.array_sort(F.collect_set("name")).alias("filenames"), F.max("size").alias("size"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))


def listed_names(sources: DataFrame) -> DataFrame:
    """name, digests (how many list it), digest (one of them)."""
    return sources.select("digest", F.explode("filenames").alias("name")).groupBy("name").agg(F.count_distinct("digest").alias("digests"), F.min("digest").alias("digest"))


def ambiguous_names(sources: DataFrame) -> DataFrame:
    return listed_names(sources).where("digests > 1").select("name", "digests")


def link_chunks_to_sources(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """``chunks`` with source_sha256: the one digest that lists its name, or, if none does, its base name."""
    names = listed_names(sources)
    own = names.select(F.col("name").alias("source_file"), F.col("digests").alias("_n"), F.col("digest").alias("_d"))
    base = names.select(F.col("name").alias("_base"), F.col("digests").alias("_bn"), F.col("digest").alias("_bd"))
    out = chunks.withColumn("_base", base_of(F.col("source_file"))).join(own, "source_file", "left").join(base, "_base", "left")
    sha = F.when(F.col("_n") == 1, F.col("_d")).when(F.col("_n").isNull() & (F.col("_bn") == 1), F.col("_bd"))
    return out.withColumn("source_sha256", sha).drop("_base", "_n", "_d", "_bn", "_bd")


def chunk_source_integrity(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks whose source digest is not among the sources."""
    return chunks.where("source_sha256 is not null").join(sources.select(F.col("digest").alias("source_sha256")), "source_sha256", "left_anti")


def fetch_payload(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    return chunks.join(ids.select("id").distinct(), "id", "left_semi")


def last_wins(files: DataFrame, key: str = "name", order: str = "seq") -> DataFrame:
    """``files`` with replaced_by: null for the latest input of a name, else the next one's order."""
    return files.withColumn("replaced_by", F.lead(order).over(W.partitionBy(key).orderBy(order)))


def duplicate_names(files: DataFrame, key: str = "name", order: str = "seq") -> DataFrame:
    """Names given more than once, with their inputs in order."""
    return files.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("inputs")).where(F.size("inputs") > 1)


def filter_family(df: DataFrame, name: str) -> DataFrame:
    """Rows stored under the name itself or as one of its parts."""
    return df.where(in_family(F.col("source_file"), F.lit(name)))


def replace_documents(current: DataFrame, incoming: DataFrame, names: DataFrame | None = None, expected: int | None = None) -> DataFrame:
    """New chunks, and the current ones of families that the new names don't replace.

    A family is a name with its parts. ``names`` (source_file) are the names that are replaced; where
    documents arrive as parts these are their whole names. By default they are the names of
    ``incoming`` itself. With ``expected``, another number of new chunks stops it before anything goes.
    """
    if expected is not None and (n := incoming.count()) != expected:
        raise ValueError(f"{n} new chunks; {expected} were expected, so none is replaced")
    families = (names if names is not None else incoming).select(F.col("source_file").alias("_name")).distinct()
    kept = current.join(families, F.col("source_file") == F.col("_name"), "left_anti")
    kept = kept.withColumn("_base", F.when(base_of(F.col("source_file")) != F.col("source_file"), base_of(F.col("source_file")))).join(families.withColumnRenamed("_name", "_base"), "_base", "left_anti").drop("_base")
    return kept.unionByName(incoming)


def undo_version(current: DataFrame, name: str, created_at: Column) -> DataFrame:
    """Without the rows of one ingest of one document."""
    return current.where(~((F.col("source_file") == name) & (F.col("created_at") == created_at)) | F.col("source_file").isNull())


def digests(chunks: DataFrame, properties: list[str]) -> DataFrame:
    """id, props, vec: digests of each chunk's properties and vector; an invalid vector is an error."""
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in properties}
    return chunks.select("id", property_digest(kinds).alias("props"), vector_digest(F.col("vector")).alias("vec"))


#: Buckets by which tables are compared.
BUCKETS = 4096


def row_text(df: DataFrame) -> Column:
    """A row as text in which nulls, also within arrays, and types of different width show."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def differing(left: DataFrame, right: DataFrame, bucket: Column) -> DataFrame:
    """_b: buckets in which the two tables don't hold the same rows equally often.

    A bucket's digest is the number of its rows and the sums of two hashes of each, so it depends on
    no order, and repeated rows count. One aggregate a side, of which a few thousand rows are shuffled.
    """
    def digest(df: DataFrame, side: str) -> DataFrame:
        text = row_text(df)
        rows = df.select(bucket.alias("_b"), F.xxhash64(text).cast("decimal(20,0)").alias("_x"), F.xxhash64(F.concat(F.lit("#"), text)).cast("decimal(20,0)").alias("_y"))
        return rows.groupBy("_b").agg(F.count("*").alias(f"{side}_n"), F.sum("_x").alias(f"{side}_x"), F.sum("_y").alias(f"{side}_y"))

    both = digest(left, "l").join(digest(right, "r"), "_b", "full_outer")
    same = F.col("l_n").eqNullSafe(F.col("r_n")) & F.col("l_x").eqNullSafe(F.col("r_x")) & F.col("l_y").eqNullSafe(F.col("r_y"))
    return F.broadcast(both.where(~same).select("_b"))  # at most BUCKETS rows


def verify_chunks(expected: DataFrame, stored: DataFrame, exact: bool = True) -> DataFrame:
    """id, problem: missing, unexpected, duplicate, property or vector differs; inputs: id, props, vec.

    Buckets of ids are compared by digests first; only the rows of those that differ are joined.
    """
    columns, bucket = ["id", "props", "vec"], F.pmod(F.xxhash64("id"), F.lit(BUCKETS))
    wrong = differing(expected.select(*columns), stored.select(*columns), bucket)
    e, s = (x.select(*columns).withColumn("_b", bucket).join(wrong, "_b", "left_semi").drop("_b") for x in (expected, stored))
    e = e.select("id", F.col("props").alias("p1"), F.col("vec").alias("v1"))
    s = s.groupBy("id").agg(F.count("*").alias("n"), F.first("props").alias("p2"), F.first("vec").alias("v2"))
    both = e.withColumn("_e", F.lit(1)).join(s, "id", "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected" if exact else None).when(F.col("n") > 1, "duplicate").when(F.col("p1") != F.col("p2"), "property").when(F.col("v1") != F.col("v2"), "vector")
    return both.select("id", problem.alias("problem")).where("problem is not null")


def verify_digests(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """path, reason (missing or mismatch) of the manifest's files that fail; inputs: path, sha256."""
    a = actual.select("path", F.col("sha256").alias("found"))
    reason = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "mismatch")
    return manifest.join(a, "path", "left").select("path", reason.alias("reason")).where("reason is not null")


def verify_rebuild(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one side has, as often as it has them more; none if the rebuild kept everything.

    Equal tables cost one aggregate a side; rows are compared only in buckets whose digests differ.
    """
    after = after.select(*before.columns)

    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn("_b", F.pmod(F.xxhash64(row_text(df)), F.lit(BUCKETS)))

    wrong = differing(bucketed(before), bucketed(after), F.col("_b"))
    b, a = (bucketed(x).join(wrong, "_b", "left_semi").drop("_b") for x in (before, after))
    return b.exceptAll(a).withColumn("side", F.lit("before")).unionByName(a.exceptAll(b).withColumn("side", F.lit("after")))


def valid_vectors(df: DataFrame, dims: int, vector: str = "vector") -> DataFrame:
    most = 3.4028234663852886e38  # the largest float32
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= most))
    return df.where((F.size(vector) == dims) & finite)


def chunk_set_check(chunks: DataFrame) -> DataFrame:
    """source_file, complete: whether its indexes are 0 to n - 1, each once."""
    one = (F.count("*") == F.count_distinct("chunk_index")) & (F.min("chunk_index") == 0) & (F.max("chunk_index") == F.count("*") - 1)
    return chunks.groupBy("source_file").agg(one.alias("complete"))


def uncovered_sources(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored names that no single retained original rebuilds."""
    names = listed_names(sources)
    stored = chunk_set_check(chunks).withColumn("_base", base_of(F.col("source_file")))
    own = names.select(F.col("name").alias("source_file"), F.col("digests").alias("n"))
    base = names.select(F.col("name").alias("_base"), F.col("digests").alias("bn"))
    n = F.coalesce("n", "bn")
    reason = F.when(F.col("source_file").isNull(), "unnamed").when(~F.col("complete"), "incomplete").when(n.isNull(), "missing").when(n > 1, "ambiguous")
    out = stored.join(own, "source_file", "left").join(base, "_base", "left").select(F.coalesce("source_file", F.lit("<unknown>")).alias("source_file"), reason.alias("reason"))
    return out.where("reason is not null")


def rebuildable_names(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    return chunks.select("source_file").intersect(listed_names(sources).select(F.col("name").alias("source_file")))


def versions(spark: SparkSession, path: str) -> DataFrame:
    """version, batch of the committed versions of a chunk table; empty for a new one."""
    schema = "version long, batch string"
    try:
        return spark.read.schema(schema).json(f"{path}/commits")
    except AnalysisException:  # nothing was committed yet
        return spark.createDataFrame([], schema)


def write_chunks(chunks: DataFrame, path: str, expected: int | None = None, names: DataFrame | None = None, batch: str | None = None) -> int:
    """Write one version of a chunk table, verify it, and only then commit it; the number of the version.

    A version holds new chunks and the names (source_file) they replace, by default their own names;
    what it replaces is left out when read. Nothing that was written before is touched, so a failure
    at any point leaves the table as it was. Chunks are computed once and kept in the checkpoint folder; what is read
    back is compared with them by digests. A ``batch`` that was committed before is not written again.
    """
    spark = chunks.sparkSession
    before = versions(spark, path)
    if batch is not None and (old := before.where(F.col("batch") == batch).agg(F.max("version")).first()[0]) is not None:
        return old
    number = before.agg(F.coalesce(F.max("version"), F.lit(-1)) + 1).first()[0]
    chunks = written(chunks)  # a model among its steps is asked once
    own = (names if names is not None else chunks).select("source_file").distinct()
    at = f"{path}/version={number}"
    chunks.write.mode("overwrite").parquet(at)
    own.write.mode("overwrite").parquet(f"{path}/names/version={number}")
    again = spark.read.schema(chunks.schema).parquet(at)
    n = again.count()
    if expected is not None and n != expected:
        raise ValueError(f"{n} chunks were written; {expected} were expected")
    if not verify_rebuild(chunks, again).isEmpty():
        raise ValueError("the chunks read back differ from those written")
    spark.range(1).select(F.lit(number).cast("long").alias("version"), F.lit(batch).cast("string").alias("batch")).coalesce(1).write.mode("append").json(f"{path}/commits")
    return number


def read_chunks(spark: SparkSession, path: str, schema: StructType, version: int | None = None) -> DataFrame:
    """The chunks of a table as of a version, the latest by default: each family's rows of the version that named it last."""
    found = sorted(r[0] for r in versions(spark, path).select("version").collect())  # one row a version
    numbers = [n for n in found if version is None or n <= version]
    if not numbers:
        return spark.createDataFrame([], schema)
    # Version is a partition of both tables, so that any number of versions is one scan of each.
    def scan(at: str, fields: StructType) -> DataFrame:
        paths = [f"{at}/version={n}" for n in numbers]
        return spark.read.schema(StructType([*fields.fields]).add("version", "long")).option("basePath", at).parquet(*paths)

    every = scan(path, schema).withColumnRenamed("version", "_version")
    last = scan(f"{path}/names", StructType().add("source_file", "string")).groupBy(F.col("source_file").alias("_name")).agg(F.max("version").alias("_last"))
    own = every.join(last, F.col("source_file") == F.col("_name"), "left").drop("_name").withColumnRenamed("_last", "_own")
    base = F.when(base_of(F.col("source_file")) != F.col("source_file"), base_of(F.col("source_file")))
    both = own.withColumn("_base", base).join(last.withColumnRenamed("_name", "_base"), "_base", "left")
    return both.where(F.col("_version") >= F.greatest(F.coalesce("_own", F.lit(-1)), F.coalesce("_last", F.lit(-1)))).select(*schema.names)


def delete_collection(name: str, tables: list[DataFrame], sessions: DataFrame | None = None) -> list[DataFrame]:
    """The tables without a collection under both spellings; sessions, which come last, stay and are flagged orphaned."""
    spellings = F.array_distinct(F.array(F.concat(F.lit(name[:1].upper()), F.lit(name[1:])), F.concat(F.lit(name[:1].lower()), F.lit(name[1:]))))
    hit = F.coalesce(F.array_contains(spellings, F.col("collection")), F.lit(False))
    out = [t.where(~hit) for t in tables]
    if sessions is not None:
        had = F.coalesce("orphaned", F.lit(False)) if "orphaned" in sessions.columns else F.lit(False)
        out.append(sessions.withColumn("orphaned", had | hit))
    return out
