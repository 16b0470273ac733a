"""Queries on the chunk store, retrieval, evaluation and maintenance."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.models import hashed_words
from quarry.operators import chunking as C
from quarry.operators import evaluation as G
from quarry.operators import maintenance as M
from quarry.operators import retrieval as R
from quarry.operators import store as S
from quarry.operators.written import written
from quarry.plans.chunking import overlap_chunks
from quarry.plans.common import CHUNKS, DOCS, documents, registering, table
from quarry.sources import files as IO

QUERIES, ORACLE_SQL, query = registering()

#: Some names stand for several texts: documents are named by source and the last two digits of their id.
FILES = "files AS (SELECT source || '/' || (doc_id % 900) || '.txt' AS name, coalesce(text, '') AS content, doc_id AS seen FROM documents), sources AS (SELECT sha256(content) AS digest, list_sort(list_distinct(list(name))) AS filenames, max(strlen(content))::BIGINT AS size, min(seen) AS first_seen, max(seen) AS last_seen FROM files GROUP BY 1), names AS (SELECT name, count(DISTINCT sha256(content))::BIGINT AS digests, min(sha256(content)) AS digest FROM files GROUP BY 1)"
#: Every tenth chunk's document is named as a part of its file.
STORED = CHUNKS + ", " + FILES + ", stored AS (SELECT source || '/' || (doc_id % 900) || '.txt' || CASE WHEN doc_id % 10 = 0 THEN ' (part 1)' ELSE '' END AS source_file, chunk_index, doc_id FROM chunks)"
LINKED = STORED + r""", linked AS (SELECT s.*, CASE WHEN a.digests = 1 THEN a.digest WHEN a.name IS NULL AND b.digests = 1 THEN b.digest END AS source_sha256
FROM stored s LEFT JOIN names a ON a.name = s.source_file LEFT JOIN names b ON b.name = regexp_replace(s.source_file, ' \(part [1-9][0-9]*\)$', ''))"""


def files(s, d):
    return table(s, d, "documents").select(F.concat("source", F.lit("/"), (F.col("doc_id") % 900).cast("string"), F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).alias("content"), F.col("doc_id").alias("seen"))


def sources(s, d):
    return S.index_sources(files(s, d))


def stored(s, d):
    chunks = overlap_chunks(s, d).select("source_file", "chunk_index", F.regexp_extract("source_file", r"doc-(\d+)\.txt$", 1).cast("long").alias("doc_id"))
    part = F.when(F.col("doc_id") % 10 == 0, " (part 1)").otherwise("")
    return chunks.withColumn("source_file", F.concat(F.substring_index("source_file", "/", 1), F.lit("/"), (F.col("doc_id") % 900).cast("string"), F.lit(".txt"), part))


@query(f"WITH {FILES} SELECT digest, array_to_string(filenames, '|') AS filenames, size, first_seen, last_seen FROM sources")
def index_sources(s, d):
    return sources(s, d).withColumn("filenames", F.array_join("filenames", "|"))


@query(f"WITH {FILES} SELECT name, digests FROM names WHERE digests > 1")
def ambiguous_names(s, d):
    return S.ambiguous_names(sources(s, d))


@query(f"WITH {FILES} SELECT count(*)::BIGINT AS document_count, sum(size)::BIGINT AS total_bytes, count(*) > 0 AS has_sources FROM sources")
def source_stats(s, d):
    return sources(s, d).agg(F.count("*").alias("document_count"), F.sum("size").alias("total_bytes"), (F.count("*") > 0).alias("has_sources"))


@query(f"WITH {LINKED} SELECT source_file, doc_id, chunk_index, source_sha256 FROM linked")
def link_chunks_to_sources(s, d):
    return S.link_chunks_to_sources(stored(s, d), sources(s, d)).select("source_file", "doc_id", "chunk_index", "source_sha256")


@query(f"WITH {LINKED} SELECT l.source_sha256, source_file, doc_id, chunk_index FROM linked l WHERE source_sha256 IS NOT NULL AND source_sha256 NOT IN (SELECT digest FROM sources WHERE size > 1000)")
def chunk_source_integrity(s, d):
    linked = S.link_chunks_to_sources(stored(s, d), sources(s, d))
    return S.chunk_source_integrity(linked, sources(s, d).where("size > 1000")).select("source_sha256", "source_file", "doc_id", "chunk_index")


@query(f"WITH {LINKED} SELECT doc_id % 10 AS collection, count(*)::BIGINT AS chunk_count, max(CASE WHEN embedding IS NULL THEN -1 ELSE len(embedding) END)::INT AS dimensions, count(DISTINCT source_sha256)::BIGINT AS source_documents, sum((source_sha256 IS NULL)::INT)::BIGINT AS unresolved, CASE WHEN sum((source_sha256 IS NULL)::INT) = 0 THEN 'with-sources' ELSE 'chunks-only' END AS fidelity FROM linked LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1")
def package_manifest(s, d):
    held = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    linked = S.link_chunks_to_sources(stored(s, d), sources(s, d)).join(held, "doc_id", "left").select((F.col("doc_id") % 10).alias("collection"), "vector", "source_sha256")
    return M.package_manifest(linked, "collection")


@query(f"WITH {STORED} SELECT source_file, count(*) = count(DISTINCT chunk_index) AND min(chunk_index) = 0 AND max(chunk_index) = count(*) - 1 AS complete FROM stored GROUP BY 1")
def chunk_set_check(s, d):
    return S.chunk_set_check(stored(s, d))


UNCOVERED = STORED + r""", checked AS (SELECT source_file, count(*) = count(DISTINCT chunk_index) AND min(chunk_index) = 0 AND max(chunk_index) = count(*) - 1 AS complete FROM stored GROUP BY 1),
gaps AS (SELECT c.source_file, CASE WHEN NOT complete THEN 'incomplete' WHEN coalesce(a.digests, b.digests) IS NULL THEN 'missing' WHEN coalesce(a.digests, b.digests) > 1 THEN 'ambiguous' END AS reason
FROM checked c LEFT JOIN names a ON a.name = c.source_file LEFT JOIN names b ON b.name = regexp_replace(c.source_file, ' \(part [1-9][0-9]*\)$', ''))"""


@query(f"WITH {UNCOVERED} SELECT * FROM gaps WHERE reason IS NOT NULL")
def uncovered_sources(s, d):
    return S.uncovered_sources(stored(s, d), sources(s, d))


@query(f"WITH {STORED} SELECT source_file FROM stored INTERSECT SELECT name FROM names")
def rebuildable_names(s, d):
    return S.rebuildable_names(stored(s, d), sources(s, d))


@query(f"WITH {UNCOVERED}, g AS (SELECT count(*)::BIGINT AS uncovered FROM gaps WHERE reason IS NOT NULL), r AS (SELECT count(*)::BIGINT AS rebuildable FROM (SELECT source_file FROM stored INTERSECT SELECT name FROM names)) SELECT uncovered, rebuildable, rebuildable > 0 AND uncovered = 0 AS can_rechunk, CASE WHEN rebuildable = 0 THEN 'nothing to rebuild' WHEN uncovered > 0 THEN 'sources are missing' END AS reason FROM g, r")
def tune_options(s, d):
    return M.tune_options(stored(s, d), sources(s, d))


@query(f"WITH {FILES} SELECT name, seen, lead(seen) OVER (PARTITION BY name ORDER BY seen) AS replaced_by FROM files")
def last_wins(s, d):
    return S.last_wins(files(s, d).select("name", "seen"), "name", "seen")


@query(f"WITH {FILES} SELECT name, string_agg(seen::VARCHAR, ',' ORDER BY seen) AS inputs FROM files GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(s, d):
    return S.duplicate_names(files(s, d), "name", "seen").select("name", F.array_join(F.transform("inputs", lambda x: x.cast("string")), ",").alias("inputs"))


@query(rf"WITH {STORED}, fresh AS (SELECT source_file, chunk_index, -doc_id AS doc_id FROM stored WHERE source_file LIKE 'src1/%') SELECT source_file, chunk_index, doc_id FROM stored WHERE regexp_replace(source_file, ' \(part [1-9][0-9]*\)$', '') NOT IN (SELECT regexp_replace(source_file, ' \(part [1-9][0-9]*\)$', '') FROM fresh) UNION ALL SELECT * FROM fresh")
def replace_documents(s, d):
    now = stored(s, d)
    fresh = now.where(F.col("source_file").startswith("src1/")).withColumn("doc_id", -F.col("doc_id"))
    return S.replace_documents(now, fresh)


@query(f"WITH {STORED} SELECT source_file, chunk_index, doc_id FROM stored WHERE NOT (source_file = 'src1/1.txt' AND doc_id = 1)")
def undo_version(s, d):
    return S.undo_version(stored(s, d).withColumn("created_at", F.col("doc_id")), "src1/1.txt", F.lit(1)).drop("created_at")


@query(rf"WITH {STORED} SELECT source_file, count(*)::BIGINT AS chunks FROM stored WHERE source_file = 'src0/0.txt' OR regexp_extract(source_file, '^(.*) \(part [1-9][0-9]*\)$', 1) = 'src0/0.txt' GROUP BY 1")
def filter_family(s, d):
    return S.filter_family(stored(s, d), "src0/0.txt").groupBy("source_file").agg(F.count("*").alias("chunks"))


@query(f"WITH {STORED} SELECT source_file, chunk_index, doc_id FROM stored WHERE source_file = 'src1/1.txt'")
def filter_source(s, d):
    return stored(s, d).where(F.col("source_file") == "src1/1.txt").select("source_file", "chunk_index", "doc_id")


#: Stored copies of the vectors: some are missing, some changed, some unexpected, some twice.
@query("""WITH e AS (SELECT vec_id AS id, label, embedding FROM embeddings), st AS (SELECT id, label FROM e WHERE id % 7 <> 0 UNION ALL SELECT id, label FROM e WHERE id % 11 = 1 AND id % 7 <> 0 UNION ALL SELECT id + 1000000, label FROM e WHERE id % 50 = 3),
g AS (SELECT id, count(*) AS n, any_value(CASE WHEN id % 13 = 5 THEN label + 1 ELSE label END) AS l2 FROM st GROUP BY 1)
SELECT coalesce(e.id, g.id) AS id, CASE WHEN g.n IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'unexpected' WHEN g.n > 1 THEN 'duplicate' ELSE 'property' END AS problem FROM e FULL JOIN g ON g.id = e.id WHERE g.n IS NULL OR e.id IS NULL OR g.n > 1 OR g.l2 <> e.label""")
def verify_chunks(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    now = e.where("id % 7 <> 0").unionByName(e.where("id % 11 = 1 and id % 7 <> 0")).unionByName(e.where("id % 50 = 3").withColumn("id", F.col("id") + 1000000))
    now = now.withColumn("label", F.when(F.col("id") % 13 == 5, F.col("label") + 1).otherwise(F.col("label")))
    return S.verify_chunks(S.digests(e, ["label"]), S.digests(now, ["label"]))


@query("SELECT vec_id, label, 'before' AS side FROM embeddings WHERE label = 3 UNION ALL SELECT vec_id, label + 100, 'after' FROM embeddings WHERE label = 3")
def verify_rebuild(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label")
    return S.verify_rebuild(e, e.withColumn("label", F.when(F.col("label") == 3, F.col("label") + 100).otherwise(F.col("label"))))


@query("SELECT p_name || '/' || p_partkey AS path, CASE WHEN p_size % 5 = 0 THEN 'missing' ELSE 'mismatch' END AS reason FROM part WHERE p_size % 5 = 0 OR p_size % 7 = 0")
def verify_digests(s, d):
    p = table(s, d, "part").select(F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.sha2(F.col("p_name"), 256).alias("sha256"), "p_size")
    actual = p.where("p_size % 5 <> 0").withColumn("sha256", F.when(F.col("p_size") % 7 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")))
    return S.verify_digests(p.drop("p_size"), actual.drop("p_size"))


@query("SELECT label, count(*)::BIGINT AS n FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY 1")
def valid_vectors(s, d):
    return S.valid_vectors(table(s, d, "embeddings"), 64, "embedding").groupBy("label").agg(F.count("*").alias("n"))


def vectors(s, d):
    """Every vector whose id is divisible by 50 asks all vectors."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), e


def _near(score: str) -> str:
    return f"""WITH p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {score} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0), r AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM p) SELECT query_id, id, score, rank FROM r WHERE rank <= 10"""


def _nearest(s, d, metric):
    q, e = vectors(s, d)
    return R.near_vector(q, e, 10, metric).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(_near("list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"))
def near_vector_cosine(s, d):
    return _nearest(s, d, "cosine")


@query(_near("list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"))
def near_vector_dot(s, d):
    return _nearest(s, d, "dot")


@query(_near("1 / (1 + list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) ** 2)"))
def near_vector_l2(s, d):
    return _nearest(s, d, "l2-squared")


# Names of the whole searches from when the plain ones asked with a few ids only.
for _name in ("cosine", "dot", "l2"):
    QUERIES[f"near_vector_{_name}_50th"], ORACLE_SQL[f"near_vector_{_name}_50th"] = QUERIES[f"near_vector_{_name}"], ORACLE_SQL[f"near_vector_{_name}"]


@query()
def near_vector_approx(s, d):
    q, e = vectors(s, d)
    return R.near_vector_approx(q, e, 10)


def questions(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def contents(s, d):
    chunks = overlap_chunks(s, d)
    doc = F.regexp_extract("source_file", r"doc-(\d+)\.txt$", 1).cast("long")
    return chunks.select((doc * 100_000 + F.col("chunk_index")).alias("id"), "source_file", "chunk_index", "content")


BM25 = CHUNKS + r""", tok AS (SELECT doc_id * 100000 + chunk_index AS id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS t FROM chunks), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
terms AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark),
e AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok), tf AS (SELECT id, dl, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM terms) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
b AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM tf JOIN df USING (term) JOIN terms USING (term), st GROUP BY 1, 2)"""


def with_contents(s, d, hits):
    """Hits with their chunks: only the documents of hits are chunked again."""
    hits = written(hits)
    named = F.broadcast(hits.select(F.floor(F.col("id") / 100_000).alias("doc_id")).distinct())  # k hits a question
    chunks = C.chunk_overlap(documents(s, d).join(named, "doc_id", "left_semi"), 1000, 200, 300)
    doc = F.regexp_extract("source_file", r"doc-(\d+)\.txt$", 1).cast("long")
    return hits.join(chunks.withColumn("id", doc * 100_000 + F.col("chunk_index")), "id")


@query(f"WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM b) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def bm25(s, d):
    return R.bm25(questions(s, d), contents(s, d), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {BM25}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM b), top AS (SELECT query_id, rank, content FROM r JOIN (SELECT doc_id * 100000 + chunk_index AS id, content FROM chunks) USING (id) WHERE rank <= 3) SELECT query_id, string_agg('[' || rank || '] ' || content, chr(10) || chr(10) ORDER BY rank) AS context FROM top GROUP BY 1")
def build_context(s, d):
    return R.build_context(with_contents(s, d, R.bm25(questions(s, d), contents(s, d), 3)))


@query(f"WITH {BM25}, r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM b) SELECT query_id, rank, source_file, chunk_index, round_even(score, 4) AS score, substring(content, 1, 200) AS content FROM r JOIN (SELECT doc_id * 100000 + chunk_index AS id, source_file, chunk_index, content FROM chunks) USING (id) WHERE rank <= 5")
def citations(s, d):
    return R.citations(with_contents(s, d, R.bm25(questions(s, d), contents(s, d), 5)))


@query()
def hybrid(s, d):
    embed = hashed_words(32)
    asked = questions(s, d).withColumn("vector", embed(F.col("question")))
    return R.hybrid(asked, contents(s, d).select("id", "content", embed(F.col("content")).alias("vector")), 0.5, 10)


@query()
def near_text(s, d):
    embed = hashed_words(32)
    return R.near_text(questions(s, d), contents(s, d).select("id", embed(F.col("content")).alias("vector")), 10, embed)


@query("SELECT lpad(lower(hex(vec_id)), 32, '0') AS uuid_hex, sha256('rag-evaluation-sample-v1'::BLOB || '\\x00'::BLOB || 'seed'::BLOB || '\\x00'::BLOB || '7'::BLOB || '\\x00'::BLOB || unhex(lpad(hex(vec_id), 32, '0'))) AS priority FROM embeddings ORDER BY priority, uuid_hex LIMIT 25")
def sample_chunks(s, d):
    e = table(s, d, "embeddings").select(F.lpad(F.lower(F.hex("vec_id")), 32, "0").alias("uuid_hex"))
    return G.sample_chunks(e, 25, 7)


def pairs(s, d):
    c = table(s, d, "conversations")
    answer = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    asked = c.withColumn("answer", answer).where("role = 'user'")
    return asked.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("pair_id"), F.col("conv_id").alias("session"), F.col("text").alias("question"), "answer", F.when(F.col("turn") % 4 == 0, "approved").otherwise("pending").alias("status"))


PAIRS = "asked AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations), pairs AS (SELECT conv_id || '-' || turn AS pair_id, conv_id AS session, turn, text AS question, answer, CASE WHEN turn % 4 = 0 THEN 'approved' ELSE 'pending' END AS status FROM asked WHERE role = 'user')"


@query(f"WITH {PAIRS}, e AS (SELECT pair_id, CASE WHEN session % 3 = 0 THEN 'Edited.' WHEN session % 3 = 1 THEN ' ' END AS a, CASE WHEN session % 3 < 2 THEN 'edited' WHEN session % 2 = 0 THEN 'rejected' ELSE 'unknown' END AS s FROM pairs WHERE turn % 4 = 0), j AS (SELECT p.*, a, s, coalesce((a IS NOT NULL AND trim(a) = '') OR s NOT IN ('approved', 'edited', 'rejected', 'pending'), FALSE) AS refused FROM pairs p LEFT JOIN e USING (pair_id)) SELECT pair_id, session, question, CASE WHEN NOT refused THEN coalesce(a, answer) ELSE answer END AS answer, CASE WHEN NOT refused THEN coalesce(s, status) ELSE status END AS status, refused FROM j")
def apply_pair_edits(s, d):
    p = pairs(s, d)
    m = F.col("session") % 3
    status = F.when(m < 2, "edited").when(F.col("session") % 2 == 0, "rejected").otherwise("unknown")
    edits = p.where("status = 'approved'").select("pair_id", F.when(m == 0, "Edited.").when(m == 1, " ").alias("answer"), status.alias("status"))
    return G.apply_pair_edits(p, edits)


@query(f"WITH {PAIRS} SELECT session, sum((status = 'approved')::INT)::BIGINT AS saved, sum((status <> 'approved')::INT)::BIGINT AS excluded FROM pairs GROUP BY 1")
def eval_export_counts(s, d):
    return G.eval_export_counts(pairs(s, d))


@query(f"WITH {PAIRS} SELECT session, count(*)::BIGINT AS total, count(answer)::BIGINT AS completed, (count(*) - count(answer))::BIGINT AS failed, CASE WHEN count(answer) = 0 THEN 'failed' ELSE 'completed' END AS status FROM pairs GROUP BY 1")
def session_progress(s, d):
    p = pairs(s, d).withColumn("question", F.when(F.col("answer").isNotNull(), F.col("question"))).withColumn("error", F.when(F.col("answer").isNull(), "no answer"))
    return G.session_progress(p)


@query(f"WITH {PAIRS} SELECT question, answer, answer AS ground_truth FROM pairs WHERE status = 'approved'")
def eval_set(s, d):
    return G.eval_set(pairs(s, d).withColumn("contexts", F.array("question")).withColumn("ground_truth", F.col("answer"))).drop("contexts")


#: Every fifth session was stale before, for a reason of its own.
@query("""SELECT doc_id AS session, lang AS collection, lang IN ('en', 'de') OR doc_id % 5 = 0 AS stale, CASE WHEN lang IN ('en', 'de') THEN 'rebuilt' WHEN doc_id % 5 = 0 THEN 'old' END AS stale_reason FROM documents""")
def flag_sessions(s, d):
    sessions = table(s, d, "documents").select(F.col("doc_id").alias("session"), F.col("lang").alias("collection"), (F.col("doc_id") % 5 == 0).alias("stale"), F.when(F.col("doc_id") % 5 == 0, "old").alias("stale_reason"))
    named = sessions.where("collection in ('en', 'de')").select(T.canonical_name(F.col("collection")).alias("collection")).distinct()
    return G.flag_sessions(sessions, named, "stale", "rebuilt").select("session", "collection", "stale", "stale_reason")


@query("SELECT o_orderkey AS package FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate + INTERVAL 720 HOUR <= TIMESTAMP '1997-01-01' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def expired_packages(s, d):
    o = table(s, d, "orders")
    packages = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("package"), F.col("o_orderdate").alias("finished_at"))
    busy = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("package"))
    return M.expired_packages(packages, F.lit("1997-01-01").cast("timestamp_ntz"), 720, busy).select("package")


@query("SELECT c_custkey AS collection, CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'model,width' WHEN c_nationkey % 3 = 0 THEN 'model' WHEN c_custkey % 2 = 0 THEN 'width' ELSE '' END AS violations FROM customer")
def embedding_compatible(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("collection"), "c_nationkey")
    manifest = c.select("collection", F.when(F.col("c_nationkey") % 3 == 0, "other").otherwise("base").alias("model"), F.when(F.col("collection") % 2 == 0, 384).otherwise(768).alias("dimensions"))
    settings = c.select("collection", F.lit("base").alias("model"), F.lit(768).alias("dimensions"))
    return M.embedding_compatible(manifest, settings)


@query("SELECT p_name AS collection, CASE WHEN n > 1 THEN p_name || '_imported_' || substring(sha256(p_name), 1, 8) ELSE p_name END AS target, FALSE AS refused FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1)")
def import_target(s, d):
    p = table(s, d, "part").groupBy(F.col("p_name").alias("collection")).agg(F.count("*").alias("n"))
    return M.import_target(p.select("collection"), p.where("n > 1").select("collection"), "rename")


#: Objects of every shape: nested, numbers as written, scalar and mixed arrays, empty containers, literals.
@query("""SELECT event_id, CASE event_id % 4
WHEN 0 THEN 'k: ' || json_extract_string(props, '$.k')
WHEN 1 THEN 'a.b: 1.50' || chr(10) || 'a.id: ' || event_id || chr(10) || 'l: 1e3, x, true, null'
WHEN 2 THEN 'm[0].n: ' || user_id || chr(10) || 'm[1]: y' END AS text FROM events""")
def flatten_json(s, d):
    e, n = F.col("event_id").cast("string"), F.col("event_id") % 4
    made = (
        F.when(n == 0, F.col("props"))
        .when(n == 1, F.concat(F.lit('{"a": {"b": 1.50, "id": '), e, F.lit('}, "l": [1e3, "x", true, null], "e": {}, "f": []}')))
        .when(n == 2, F.concat(F.lit('{"m": [{"n": '), F.col("user_id").cast("string"), F.lit('}, "y"]}')))
        .otherwise(F.concat(F.lit('{"n": NaN, "id": '), e, F.lit("}")))
    )
    return table(s, d, "events").select("event_id", IO.flatten_json(made).alias("text"))


#: Arrays of records with numbers as written and items without text, scalar arrays, single objects, and what is no JSON.
@query("""WITH r AS (
SELECT event_id, 1 AS ordinal, props AS record FROM events WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 3, '{"v":1.50,"k":1e3, "id":' || event_id || '}' FROM events WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 1, '[1, ' || event_id || ', "x"]' FROM events WHERE event_id % 4 = 1
UNION ALL SELECT event_id, 1, '{"a": [], "b": "' || event_id || '"}' FROM events WHERE event_id % 4 = 2)
SELECT event_id, ordinal::BIGINT AS ordinal, record FROM r""")
def json_records(s, d):
    e, n = F.col("event_id").cast("string"), F.col("event_id") % 4
    made = (
        F.when(n == 0, F.concat(F.lit("[ "), F.col("props"), F.lit(' ,{}, {"v":1.50,"k":1e3, "id":'), e, F.lit("}]\n")))
        .when(n == 1, F.concat(F.lit("[1, "), e, F.lit(', "x"]')))
        .when(n == 2, F.concat(F.lit('{"a": [], "b": "'), e, F.lit('"}')))
        .otherwise(F.when(F.col("event_id") % 8 == 3, "[]").otherwise(F.concat(F.col("props"), F.lit(","), F.col("props"))))
    )
    return IO.json_records(table(s, d, "events").select("event_id", made.alias("text")))


#: Two values in a line, a constant outside and inside a string, a blank line, an open object.
@query("""WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line, count(*) OVER (PARTITION BY user_id) AS lines, event_id FROM events),
b AS (SELECT *, CASE WHEN event_id % 97 = 5 AND event_id % 2 = 0 THEN 'invalid JSON' WHEN event_id % 97 = 5 THEN 'invalid JSON' WHEN event_id % 89 = 7 THEN 'not a number' WHEN event_id % 83 = 2 AND line < lines THEN 'blank line' END AS reason FROM l)
SELECT user_id::VARCHAR AS source_file, min(line)::BIGINT AS line, arg_min(reason, line) AS reason FROM b WHERE reason IS NOT NULL GROUP BY 1""")
def jsonl_quality(s, d):
    n, e = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long"), F.col("event_id")
    last = F.max("event_id").over(W.partitionBy("user_id"))
    made = (
        F.when((e % 97 == 5) & (e % 2 == 0), F.concat("props", F.lit(","), "props"))
        .when(e % 97 == 5, F.concat("props", F.lit("}")))
        .when(e % 89 == 7, F.concat(F.lit('{"v": -Infinity, "p": '), "props", F.lit("}")))
        .when((e % 83 == 2) & (e < last), F.lit(" \t"))
        .when(e % 3 == 0, F.lit('{"t": "is NaN here, not Infinity"}'))
        .otherwise(F.col("props"))
    )
    rows = table(s, d, "events").withColumn("_last", last).select(F.col("user_id").cast("string").alias("source_file"), n.alias("line"), made.alias("record"))
    return IO.jsonl_quality(rows)


@query("""WITH n AS (SELECT source || '/' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'de' THEN '.pdf' WHEN 'fr' THEN '.MD' ELSE CASE doc_id % 5 WHEN 0 THEN '.xyz' WHEN 1 THEN '.txt.gz' WHEN 2 THEN '.json.gz' WHEN 3 THEN '.jsonl.gz' ELSE '' END END AS name, doc_id, lang FROM documents)
SELECT name, lang IN ('en', 'fr') OR (lang <> 'de' AND (doc_id % 5 = 3 OR (doc_id % 5 = 2 AND doc_id % 2 = 0))) AS accepted,
CASE WHEN lang IN ('en', 'fr') THEN NULL WHEN lang = 'de' THEN 'unsupported type ' || chr(39) || '.pdf' || chr(39) WHEN doc_id % 5 = 0 THEN 'unsupported type ' || chr(39) || '.xyz' || chr(39) WHEN doc_id % 5 = 1 OR (doc_id % 5 = 2 AND doc_id % 2 = 1) THEN 'unsupported type ' || chr(39) || '.gz' || chr(39) WHEN doc_id % 5 = 4 THEN 'unsupported type ' || chr(39) || 'none' || chr(39) END AS reason FROM n""")
def accepted_and_skipped(s, d):
    k = F.col("doc_id")
    odd = F.when(k % 5 == 0, ".xyz").when(k % 5 == 1, ".txt.gz").when(k % 5 == 2, ".json.gz").when(k % 5 == 3, ".jsonl.gz").otherwise("")
    suffix = F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "de", ".pdf").when(F.col("lang") == "fr", ".MD").otherwise(odd)
    return IO.accepted_and_skipped(table(s, d, "documents").select(F.concat("source", F.lit("/"), k.cast("string"), suffix).alias("name"), (k % 2 == 0).alias("archived")))


@query(rf"""WITH {DOCS}, x AS (SELECT source_file, doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS one FROM docs) SELECT source_file, CASE WHEN length(one) > 40 THEN substring(one, 1, 39) || '…' ELSE one END AS label, source_file || ' (part ' || (doc_id % 7 + 1) || ')' AS part, source_file AS base, upper(substring(source_file, 1, 1)) || substring(source_file, 2) AS canonical, 'txt' AS kind FROM x""")
def names_and_labels(s, d):
    part = T.part_name(F.col("source_file"), F.col("doc_id") % 7 + 1)
    return documents(s, d).select("source_file", T.label(F.col("text")).alias("label"), part.alias("part"), T.base_of(part).alias("base"), T.canonical_name(F.col("source_file")).alias("canonical"), T.source_type(F.col("source_file")).alias("kind"))
