"""Queries on records, replies, settings, packages and the parts of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.models import hashed_words
from quarry.operators import access as X
from quarry.operators import analytics as A
from quarry.operators import chunking as C
from quarry.operators import cleaning as K
from quarry.operators import evaluation as G
from quarry.operators import maintenance as M
from quarry.operators import retrieval as R
from quarry.operators import settings as P
from quarry.operators import store as S
from quarry.operators.written import written
from quarry.plans import corpus, operations
from quarry.plans.chunking import LINES
from quarry.plans.common import CHUNKS, DOCS, documents, registering, table

QUERIES, ORACLE_SQL, query = registering()


def text_of(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


# ------------------------------------------------------------------ replies


@query("""SELECT conv_id, turn, text AS q, turn::VARCHAR AS c, CASE WHEN turn % 3 = 2 THEN 'none' WHEN turn % 2 = 0 THEN 'use } brace {' ELSE 'plain' END AS note FROM conversations WHERE turn % 3 <> 2
UNION ALL SELECT conv_id, turn, NULL, NULL, 'none' FROM conversations WHERE turn % 3 = 2""")
def reply_objects(s, d):
    c = table(s, d, "conversations")
    note = F.when(F.col("turn") % 2 == 0, "use } brace {").otherwise("plain")
    held = F.to_json(F.struct(F.col("text").alias("q"), note.alias("note"), F.struct(F.struct(F.col("turn").alias("c")).alias("b")).alias("a")))
    reply = F.when(F.col("turn") % 3 == 2, "no { object } here {").otherwise(text_of("It looks like { this }:\n```json\n", held, "\n``` and so on }"))
    found = T.reply_object(reply)
    out = c.select("conv_id", "turn", F.get_json_object(found, "$.q").alias("q"), F.get_json_object(found, "$.a.b.c").alias("c"), F.coalesce(F.get_json_object(found, "$.note"), F.lit("none")).alias("note"))
    return out


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '1,' || (1 + event_id % 7 + 1) WHEN 1 THEN '' END AS lines FROM events""")
def removal_lines(s, d):
    e, n = table(s, d, "events"), (F.col("event_id") % 7 + 2).cast("string")
    m = F.col("event_id") % 5
    reply = (
        F.when(m == 0, text_of('Lines: {"remove": [', n, ", 1, ", n, '], "why": {"a": "}"}}'))
        .when(m == 1, '{"remove": []}')
        .when(m == 2, text_of('{"remove": [0, ', n, "]}"))
        .when(m == 3, '{"remove": "1"}')
        .otherwise('{"remove": [1, 99]} {"remove": [1]}')
    )
    return e.select("event_id", F.array_join(F.transform(T.removal_lines(reply, F.lit(8)), lambda x: x.cast("string")), ",").alias("lines"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN text END AS question, CASE WHEN turn % 3 < 2 THEN 'yes' END AS answer, CASE WHEN turn % 3 = 0 THEN 'yes' WHEN turn % 3 = 1 THEN 'truth' END AS ground_truth FROM conversations WHERE trim(text) <> ''""")
def usable_pairs(s, d):
    c = table(s, d, "conversations").where("trim(text) <> ''")
    fields = [F.col("text").alias("question"), F.when(F.col("turn") % 3 == 2, " \n").otherwise("yes").alias("answer"), F.when(F.col("turn") % 3 == 1, "truth").alias("ground_truth")]
    pair = T.usable_pair(text_of("Reply: ", F.to_json(F.struct(*fields))))
    return c.withColumn("p", pair).select("conv_id", "turn", "p.question", "p.answer", "p.ground_truth")


# ------------------------------------------------------------------ records and their parts


@query(r"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN event_type || ' one two' WHEN 1 THEN '1.50' WHEN 2 THEN 'record ' || format('{:,}', event_id * 1000) WHEN 3 THEN 'record ' || format('{:,}', event_id * 1000)
WHEN 4 THEN '[1,{"y":2.0}]' WHEN 5 THEN 'true' WHEN 6 THEN repeat('x', 39) || '…' ELSE 'record ' || format('{:,}', event_id * 1000) END AS key FROM events""")
def json_record_keys(s, d):
    m = F.col("event_id") % 8
    record = (
        F.when(m == 0, text_of('{"title": "', F.col("event_type"), '  one\\n two", "n": 1}'))
        .when(m == 1, '{"n": 1.50, "title": "later"}')
        .when(m == 2, '{"a": null, "b": "x"}')
        .when(m == 3, "[1, 2]")
        .when(m == 4, '{"x": [1, {"y": 2.0}]}')
        .when(m == 5, '{"x": true}')
        .when(m == 6, text_of('{"x": "', F.repeat(F.lit("x"), 60), '"}'))
        .otherwise('{"x": " \\t"}')
    )
    return table(s, d, "events").select("event_id", T.json_record_key(record, F.col("event_id") * 1000).alias("key"))


@query(rf"""WITH {DOCS}, x AS (SELECT source_file, doc_id, trim(regexp_replace(CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END, '\s+', ' ', 'g')) AS one FROM docs)
SELECT source_file, CASE WHEN one = '' THEN 'record ' || format('{{:,}}', doc_id + 1) WHEN length(one) > 40 THEN substring(one, 1, 39) || '…' ELSE one END AS key FROM x""")
def csv_record_keys(s, d):
    cell = F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("text"))
    return documents(s, d).select("source_file", T.record_key(cell, F.col("doc_id") + 1).alias("key"))


#: Records of one file per return flag, in parts of 500, whose fields have names of five words.
RECORDS = """r AS (SELECT l_returnflag AS name, (n // 500 + 1)::INT AS part, n AS ordinal, 'order ' || l_orderkey AS key, (2 + l_linenumber * 4)::INT AS fields
FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS n FROM lineitem))"""


def records(s, d):
    from pyspark.sql import Window as W

    # A flag's rows are numbered in ranges of order keys, behind the count of the ranges before.
    keyed = table(s, d, "lineitem").withColumn("_range", F.coalesce(F.floor(F.col("l_orderkey") / 1000), F.lit(-(1 << 62))))
    counts = keyed.groupBy(F.col("l_returnflag").alias("_flag"), F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("_flag").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    n = F.row_number().over(W.partitionBy("l_returnflag", "_range").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    names = F.transform(F.sequence(F.lit(1), (2 + F.col("l_linenumber") * 4).cast("int")), lambda i: F.concat(F.lit("field number "), i.cast("string"), F.lit(" of record")))
    ranged = keyed.withColumn("_i", n).join(before, F.col("l_returnflag").eqNullSafe(F.col("_flag")) & (F.col("_range") == F.col("_of")))
    rows = ranged.withColumn("n", F.col("_i") + F.col("_before") - 1)
    return rows.select(F.col("l_returnflag").alias("name"), (F.floor(F.col("n") / 500) + 1).cast("int").alias("part"), F.col("n").alias("ordinal"), text_of("order ", F.col("l_orderkey").cast("string")).alias("key"), names.alias("fields"))


@query(f"""WITH {RECORDS}, p AS (SELECT name, part, count(*) AS records, max(fields) AS fields, arg_min(key, ordinal) AS first, arg_max(key, ordinal) AS last FROM r GROUP BY 1, 2), q AS (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM p),
c AS (SELECT q.*, shown, format('{{:,}}', records) || (CASE WHEN records = 1 THEN ' record' ELSE ' records' END) || '. Fields: ' || array_to_string(list_transform(range(1, shown + 1), lambda i: 'field number ' || i || ' of record'), ', ') || (CASE WHEN fields > shown THEN ', and ' || (fields - shown) || ' more' ELSE '' END) || '. First: ' || first || '; last: ' || last || '.' AS summary FROM q, unnest(range(1, 21)) t(shown) WHERE shown <= fields),
best AS (SELECT *, row_number() OVER (PARTITION BY name, part ORDER BY len(string_split(summary, ' ')) > 80, shown DESC) AS rank FROM c)
SELECT name, part, n AS "of", records, CASE WHEN n > 1 THEN name || ' (part ' || part || ')' ELSE name END AS part_name, CASE WHEN n > 1 THEN name || ', part ' || part || ' of ' || n ELSE name END AS title, summary FROM best WHERE rank = 1""")
def label_record_parts(s, d):
    return K.label_record_parts(records(s, d))


@query("""SELECT doc_id, array_to_string(CASE WHEN doc_id % 3 = 0 THEN ['a/doc-' || doc_id || out] ELSE list_transform(range(1, doc_id % 3 + 2), lambda i: 'a/doc-' || doc_id || '-part-' || lpad(i::VARCHAR, 3, '0') || out) END, '|') AS names, kind
FROM (SELECT doc_id, CASE lang WHEN 'en' THEN '.md' WHEN 'de' THEN '.csv' WHEN 'fr' THEN '.jsonl' ELSE '.md' END AS out, CASE lang WHEN 'en' THEN 'text' WHEN 'de' THEN 'csv' WHEN 'fr' THEN 'jsonl' ELSE 'text' END AS kind FROM documents)""")
def prepared_names(s, d):
    suffix = F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "de", ".csv").when(F.col("lang") == "fr", ".JSONL.gz").otherwise(".PDF")
    name = text_of("a/doc-", F.col("doc_id").cast("string"), suffix)
    count = (F.col("doc_id") % 3 + 1).cast("int")
    return table(s, d, "documents").select("doc_id", F.array_join(T.prepared_names(name, count), "|").alias("names"), T.output_kind(T.source_type(name)).alias("kind"))


#: Found another way: of all numbers of windows, the one that lets a text be longest and has it in its own range.
@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice, CASE l_linenumber % 3 WHEN 0 THEN 'overlap' WHEN 1 THEN 'language' ELSE 'fixed' END AS strategy, (50 + l_partkey % 30 * 200)::BIGINT AS size, (l_suppkey % 10 * 5 + CASE WHEN l_partkey % 30 >= 4 THEN l_suppkey % 2 * 700 ELSE 0 END)::BIGINT AS ov FROM lineitem),
o AS (SELECT DISTINCT size, ov FROM x WHERE strategy = 'overlap'),
m AS (SELECT size, ov, max(l) AS most FROM (SELECT size, ov, w, least(size + (w - 1) * (size - ov), 10000000 - (w - 1) * ov) AS l FROM o, range(1, 10001) t(w)) WHERE w = 1 OR l > size + (w - 2) * (size - ov) GROUP BY 1, 2)
SELECT l_orderkey, l_extendedprice, strategy, size, ov AS overlap, CASE strategy WHEN 'overlap' THEN most WHEN 'language' THEN least(10000000, 10000 * (size - ov)) ELSE least(10000000, 10000 * size) END::BIGINT AS most FROM x LEFT JOIN m USING (size, ov)""")
def part_limits(s, d):
    m = F.col("l_linenumber") % 3
    strategy = F.when(m == 0, "overlap").when(m == 1, "language").otherwise("fixed")
    x = table(s, d, "lineitem").select("l_orderkey", "l_extendedprice", strategy.alias("strategy"), (50 + F.col("l_partkey") % 30 * 200).alias("size"), (F.col("l_suppkey") % 10 * 5 + F.when(F.col("l_partkey") % 30 >= 4, F.col("l_suppkey") % 2 * 700).otherwise(0)).alias("overlap"))
    return x.withColumn("most", T.part_limit(F.col("strategy"), F.col("size"), F.col("overlap")))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch(date_trunc('second', ts))::BIGINT WHEN 1 THEN epoch(date_trunc('second', ts))::BIGINT - 7200 WHEN 2 THEN epoch(date_trunc('second', ts))::BIGINT END::VARCHAR AS seconds FROM events""")
def iso_times(s, d):
    m = F.col("event_id") % 4
    one = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(m == 0, one).when(m == 1, F.concat(one, F.lit("+02:00"))).when(m == 2, F.concat(one, F.lit("Z"))).otherwise("the other day")
    return table(s, d, "events").select("event_id", F.unix_timestamp(T.parse_iso_utc(text)).cast("string").alias("seconds"))


@query(r"""WITH x AS (SELECT doc_id, 'Doc ' || doc_id || CASE WHEN doc_id % 7 = 0 THEN repeat(' long', 40) ELSE '' END AS title, CASE WHEN doc_id % 5 = 0 THEN repeat('word ', 81) ELSE repeat('word ', 20) END AS summary FROM documents)
SELECT doc_id, CASE WHEN length(title) <= 150 AND doc_id % 5 <> 0 THEN '# ' || title || chr(10) || chr(10) || summary END AS header FROM x""")
def document_headers(s, d):
    k = F.col("doc_id")
    title = text_of("Doc ", k.cast("string"), F.when(k % 7 == 0, " long" * 40).otherwise(""))
    summary = F.when(k % 5 == 0, "word " * 81).otherwise("word " * 20)
    return table(s, d, "documents").select("doc_id", T.document_header(title, summary).alias("header"))


@query("""SELECT event_id, array_to_string(list_sort(list_filter(['job=' || md5(event_id::VARCHAR), CASE WHEN event_type IN ('click', 'view') THEN 'kind=' || event_type END], lambda x: x IS NOT NULL)), ',') AS attributes FROM events""")
def safe_attributes(s, d):
    given = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("job"), F.md5(F.col("event_id").cast("string")))
    safe = A.safe_attributes(given, {"kind": ["click", "view"], "job": []})
    return table(s, d, "events").select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(safe), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",").alias("attributes"))


# ------------------------------------------------------------------ settings and packages


@query("""WITH x AS (SELECT l_orderkey, l_extendedprice, CASE l_linenumber % 4 WHEN 0 THEN 'overlap' WHEN 1 THEN 'language' WHEN 2 THEN 'fixed' ELSE 'other' END AS st, (l_partkey % 120)::INT AS size, (l_suppkey % 80 - 2)::INT AS ov, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 15 END AS th, (l_quantity * 200)::INT AS least FROM lineitem)
SELECT l_orderkey, l_extendedprice, concat_ws(',', CASE WHEN st = 'other' THEN 'chunking_strategy' END, CASE WHEN size < 50 THEN 'chunk_size' END, CASE WHEN ov < 0 THEN 'chunk_overlap' END, CASE WHEN th > 1 THEN 'similarity_threshold' END, CASE WHEN least > 6000 THEN 'min_chunk_size' END, CASE WHEN st IN ('overlap', 'language') AND ov >= size THEN 'overlap' END) AS violations FROM x""")
def validate_ingest_settings(s, d):
    m = F.col("l_linenumber") % 4
    st = F.when(m == 0, "overlap").when(m == 1, "language").when(m == 2, "fixed").otherwise("other")
    x = table(s, d, "lineitem").select("l_orderkey", "l_extendedprice", st.alias("chunking_strategy"), (F.col("l_partkey") % 120).cast("int").alias("chunk_size"), (F.col("l_suppkey") % 80 - 2).cast("int").alias("chunk_overlap"), F.when(m % 2 == 0, F.col("l_discount") * 15).alias("similarity_threshold"), (F.col("l_quantity") * 200).cast("int").alias("min_chunk_size"))
    return P.validate_ingest_settings(x).select("l_orderkey", "l_extendedprice", F.array_join("violations", ",").alias("violations"))


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'hnsw' WHEN 1 THEN 'flat' WHEN 2 THEN 'hybrid' WHEN 3 THEN 'semantic' ELSE 'none' END AS mode, (o_custkey % 60)::INT AS k, CASE WHEN o_orderkey % 4 = 0 THEN 1.5 ELSE 0.5 END AS alpha, CASE o_orderkey % 3 WHEN 0 THEN (o_custkey % 700)::DOUBLE WHEN 1 THEN 64.5 END AS ef, CASE WHEN o_orderstatus = 'P' THEN 'poem' ELSE 'engineer' END AS f FROM orders)
SELECT o_orderkey, CASE WHEN ef = 64.5 OR ef BETWEEN 16 AND 512 THEN ef END AS ef, CASE WHEN ef <> 64.5 AND NOT ef BETWEEN 16 AND 512 THEN ef END AS cleared_ef, concat_ws(',', CASE WHEN mode = 'none' THEN 'retrieval_mode' END, CASE WHEN k < 1 OR k > 50 THEN 'top_k' END, CASE WHEN alpha > 1 THEN 'alpha' END, CASE WHEN ef = 64.5 THEN 'ef' END, CASE WHEN f = 'poem' THEN 'response_format' END) AS violations FROM x""")
def validate_retrieval_settings(s, d):
    k = F.col("o_orderkey")
    mode = F.when(k % 5 == 0, "hnsw").when(k % 5 == 1, "flat").when(k % 5 == 2, "hybrid").when(k % 5 == 3, "semantic").otherwise("none")
    ef = F.when(k % 3 == 0, (F.col("o_custkey") % 700).cast("double")).when(k % 3 == 1, 64.5)
    x = table(s, d, "orders").select("o_orderkey", mode.alias("retrieval_mode"), (F.col("o_custkey") % 60).cast("int").alias("top_k"), F.when(k % 4 == 0, 1.5).otherwise(0.5).alias("alpha"), ef.alias("ef"), F.when(F.col("o_orderstatus") == "P", "poem").otherwise("engineer").alias("response_format"))
    return P.validate_retrieval_settings(x).select("o_orderkey", "ef", "cleared_ef", F.array_join("violations", ",").alias("violations"))


@query("""SELECT c_name AS collection, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'flat' ELSE 'hnsw' END AS retrieval_mode, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE 5 END::INT AS top_k, 0.75 AS alpha, NULL::DOUBLE AS ef, 'end_user' AS response_format, c_custkey % 3 <> 0 AS is_default FROM customer""")
def resolve_settings(s, d):
    c = table(s, d, "customer").withColumn("collection", F.col("c_name"))
    saved = c.where("c_custkey % 3 = 0").select("collection", F.when(F.col("c_custkey") % 2 == 0, "flat").alias("retrieval_mode"), F.col("c_nationkey").cast("int").alias("top_k"))
    return P.resolve_settings(c, saved, P.RETRIEVAL).withColumn("ef", F.col("ef").cast("double"))


@query("""SELECT p_partkey AS filename, CASE WHEN m IN (0, 5) THEN p_name END AS collection, CASE WHEN m = 0 THEN p_size END::VARCHAR AS chunk_count, CASE WHEN m IN (0, 5) THEN 'chunks-only' END AS fidelity, CASE WHEN m = 0 THEN '2024-01-01' END AS created_at, m IN (0, 5, 6) AS readable FROM (SELECT *, p_partkey % 8 AS m FROM part)""")
def readable_packages(s, d):
    m, name = F.col("p_partkey") % 8, F.col("p_name")
    manifest = (
        F.when(m == 0, text_of('{"collection": {"name": "', name, '", "chunk_count": ', F.col("p_size").cast("string"), '}, "fidelity": "chunks-only", "created_at": "2024-01-01"}'))
        .when(m == 1, '{"collection": {"name": 7}}')
        .when(m == 2, '{"collection": {"chunk_count": "7"}}')
        .when(m == 3, '{"collection": ["x"], "fidelity": "chunks-only"}')
        .when(m == 4, "not JSON")
        .when(m == 5, text_of('{"collection": {"name": "', name, '", "chunk_count": null}, "fidelity": "chunks-only"}'))
        .when(m == 6, '{"collection": null}')
        .otherwise('{"fidelity": true}')
    )
    out = M.readable_packages(table(s, d, "part").select(F.col("p_partkey").alias("filename"), manifest.alias("manifest")))
    return out.withColumn("chunk_count", F.col("chunk_count").cast("string"))


@query("SELECT label, count(*)::BIGINT AS chunk_count, max(len(embedding))::INT AS dimensions, count(DISTINCT CASE WHEN label % 2 = 0 OR vec_id % 3 > 0 THEN vec_id % 20 END)::BIGINT AS source_documents, sum((NOT (label % 2 = 0 OR vec_id % 3 > 0))::INT)::BIGINT AS unresolved, CASE WHEN sum((NOT (label % 2 = 0 OR vec_id % 3 > 0))::INT) = 0 THEN 'with-sources' ELSE 'chunks-only' END AS fidelity, 'overlap' AS chunk_strategy, CASE WHEN label % 3 = 0 THEN 77 ELSE arg_min(500 + vec_id, vec_id) END::INT AS chunk_size, CASE WHEN label % 3 = 0 THEN 7 ELSE 50 END::INT AS chunk_overlap FROM embeddings GROUP BY label")
def package_manifest_vectors(s, d):
    e = table(s, d, "embeddings")
    source = F.when((F.col("label") % 2 == 0) | (F.col("vec_id") % 3 > 0), (F.col("vec_id") % 20).cast("string"))
    chunks = e.select("label", F.col("embedding").alias("vector"), source.alias("source_sha256"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("source_file"), F.lit(0).alias("chunk_index"), F.lit("overlap").alias("chunk_strategy"), (500 + F.col("vec_id")).cast("int").alias("chunk_size"), F.lit(50).alias("chunk_overlap"))
    saved = e.where("label % 3 = 0").select(F.col("label").alias("collection")).distinct().select("collection", F.lit("overlap").alias("chunk_strategy"), F.lit(77).alias("chunk_size"), F.lit(7).alias("chunk_overlap"))
    return M.package_manifest(chunks, "label", saved)


TUNED = corpus.STORED + r""", c AS (SELECT (doc_id % 900) % 4 AS collection, source_file, chunk_index FROM stored), f AS (SELECT (doc_id % 900) % 4 AS collection, source || '/' || (doc_id % 900) || '.txt' AS name, sha256(coalesce(text, '')) AS digest FROM documents WHERE (doc_id % 900) % 4 <> 3),
nm AS (SELECT collection, name, count(DISTINCT digest) AS digests FROM f GROUP BY 1, 2), ck AS (SELECT collection, source_file, count(*) = count(DISTINCT chunk_index) AND min(chunk_index) = 0 AND max(chunk_index) = count(*) - 1 AS complete FROM c GROUP BY 1, 2),
g AS (SELECT ck.*, coalesce(a.digests, b.digests) AS digests FROM ck LEFT JOIN nm a ON a.collection = ck.collection AND a.name = ck.source_file LEFT JOIN nm b ON b.collection = ck.collection AND b.name = regexp_replace(ck.source_file, ' \(part [1-9][0-9]*\)$', '')),
r AS (SELECT collection, count(*) AS rebuildable FROM (SELECT DISTINCT collection, source_file FROM c INTERSECT SELECT collection, name FROM nm) GROUP BY 1), u AS (SELECT collection, sum((NOT complete OR digests IS NULL OR digests > 1)::INT) AS uncovered FROM g GROUP BY 1)"""


@query(f"WITH {TUNED} SELECT u.collection::VARCHAR AS collection, uncovered::BIGINT AS uncovered, coalesce(rebuildable, 0)::BIGINT AS rebuildable, coalesce(rebuildable, 0) > 0 AND uncovered = 0 AS can_rechunk, CASE WHEN coalesce(rebuildable, 0) = 0 THEN 'nothing to rebuild' WHEN uncovered > 0 THEN 'sources are missing' END AS reason FROM u LEFT JOIN r USING (collection)")
def tune_options_each(s, d):
    of = ((F.col("doc_id") % 900) % 4).cast("string").alias("collection")
    chunks = corpus.stored(s, d).select("source_file", "chunk_index", of)
    named = corpus.files(s, d).withColumn("collection", ((F.col("seen") % 900) % 4).cast("string")).where("collection <> '3'")
    sources = named.groupBy("collection", F.sha2(F.col("content").cast("binary"), 256).alias("digest")).agg(F.collect_set("name").alias("filenames"))
    return M.tune_options(chunks, sources)


# ------------------------------------------------------------------ families, versions, collections


@query(rf"WITH {corpus.STORED} SELECT source_file, count(*)::BIGINT AS chunks FROM stored WHERE source_file = 'src0/0.txt (part 1)' OR regexp_extract(source_file, '^(.*) \(part [1-9][0-9]*\)$', 1) = 'src0/0.txt (part 1)' GROUP BY 1")
def filter_family_of_part(s, d):
    return S.filter_family(corpus.stored(s, d), "src0/0.txt (part 1)").groupBy("source_file").agg(F.count("*").alias("chunks"))


@query(rf"""WITH {corpus.STORED}, now AS (SELECT source_file, chunk_index, doc_id FROM stored UNION ALL SELECT regexp_replace(source_file, ' \(part 1\)$', ''), chunk_index, doc_id FROM stored WHERE source_file LIKE '%(part 1)'),
fresh AS (SELECT source_file, chunk_index, -doc_id AS doc_id FROM stored WHERE source_file LIKE 'src1/%(part 1)')
SELECT * FROM now WHERE source_file NOT IN (SELECT source_file FROM fresh) UNION ALL SELECT * FROM fresh""")
def replace_parts_only(s, d):
    """A file whose own name is that of a part replaces itself, not the file it seems to be a part of."""
    stored = corpus.stored(s, d)
    part = F.col("source_file").endswith("(part 1)")
    now = stored.unionByName(stored.where(part).withColumn("source_file", T.base_of(F.col("source_file"))))
    fresh = stored.where(part & F.col("source_file").startswith("src1/")).withColumn("doc_id", -F.col("doc_id"))
    return S.replace_documents(now, fresh)


@query("SELECT 'chunks' AS kind, doc_id AS id, lang AS collection, NULL::BOOLEAN AS orphaned FROM documents WHERE lang <> 'de' UNION ALL SELECT 'session', doc_id, lang, lang = 'de' FROM documents WHERE doc_id % 2 = 0")
def delete_collection(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("collection"))
    chunks, sessions = S.delete_collection("De", [rows], rows.where("id % 2 = 0"))
    left = chunks.select(F.lit("chunks").alias("kind"), "id", "collection", F.lit(None).cast("boolean").alias("orphaned"))
    return left.unionByName(sessions.select(F.lit("session").alias("kind"), "id", "collection", "orphaned"))


@query(f"WITH {CHUNKS} SELECT doc_id * 100000 + chunk_index AS id, source_file, chunk_index, content FROM chunks WHERE (doc_id * 100000 + chunk_index) % 7 = 0")
def fetch_payload(s, d):
    chunks = corpus.contents(s, d)
    ids = chunks.where("id % 7 = 0").select("id")
    return S.fetch_payload(ids.unionByName(ids.withColumn("id", -1 - F.col("id"))), chunks)


@query("""SELECT n_name AS collection, n_nationkey % 2 = 0 AS indexed, count(c_custkey)::BIGINT AS object_count, CASE WHEN n_nationkey % 3 = 0 THEN 'day ' || n_nationkey END AS created_at FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 1 GROUP BY ALL""")
def collection_overview_visible(s, d):
    n = table(s, d, "nation").select(F.col("n_name").alias("collection"), "n_nationkey")
    _, _, grants, _, _ = operations.access(s, d)
    registry = n.where("n_nationkey % 3 = 0").select("collection", text_of("day ", F.col("n_nationkey").cast("string")).alias("created_at"))
    return X.collection_overview(n.select("collection", (F.col("n_nationkey") % 2 == 0).alias("indexed")), grants, registry, n.where("n_nationkey % 5 <> 1"))


# ------------------------------------------------------------------ pairs and sessions

EDITS = corpus.PAIRS + """, e AS (SELECT pair_id, CASE turn % 6 WHEN 0 THEN 'New?' WHEN 2 THEN ' ' END AS q, CASE turn % 6 WHEN 4 THEN 'New.' END AS a, CASE WHEN session % 4 = 3 THEN 'gone' WHEN turn % 6 = 4 AND session % 2 = 0 THEN 'approved' ELSE 'edited' END AS s FROM pairs),
why AS (SELECT *, CASE WHEN trim(coalesce(q, 'x')) = '' THEN 'blank content' WHEN s = 'gone' THEN 'unknown status' WHEN (q IS NOT NULL OR a IS NOT NULL) AND s <> 'edited' THEN 'content needs the status edited' END AS reason FROM e)"""


def edits(s, d):
    p = corpus.pairs(s, d).withColumn("turn", F.substring_index("pair_id", "-", -1).cast("int"))
    m = F.col("turn") % 6
    status = F.when(F.col("session") % 4 == 3, "gone").when((m == 4) & (F.col("session") % 2 == 0), "approved").otherwise("edited")
    return p.select("pair_id", F.when(m == 0, "New?").when(m == 2, " ").alias("question"), F.when(m == 4, "New.").alias("answer"), status.alias("status"))


@query(f"WITH {EDITS} SELECT pair_id, reason FROM why WHERE reason IS NOT NULL")
def rejected_edits(s, d):
    return G.rejected_edits(edits(s, d))


@query(f"WITH {EDITS} SELECT pair_id, session, CASE WHEN reason IS NULL THEN coalesce(q, question) ELSE question END AS question, CASE WHEN reason IS NULL THEN coalesce(a, answer) ELSE answer END AS answer, CASE WHEN reason IS NULL THEN s ELSE status END AS status, reason IS NOT NULL AS refused FROM pairs JOIN why USING (pair_id)")
def apply_all_edits(s, d):
    return G.apply_pair_edits(corpus.pairs(s, d), edits(s, d))


@query(f"WITH {corpus.PAIRS} SELECT session, count(*)::BIGINT AS total, count(*)::BIGINT AS attempted, count(answer)::BIGINT AS completed, (count(*) - count(answer))::BIGINT AS failed, CASE WHEN session % 5 = 0 THEN 'cancelled' WHEN count(answer) = 0 THEN 'failed' ELSE 'completed' END AS status FROM pairs GROUP BY 1")
def session_states(s, d):
    p = corpus.pairs(s, d).withColumn("question", F.when(F.col("answer").isNotNull(), F.col("question"))).withColumn("error", F.when(F.col("answer").isNull(), "no answer"))
    return G.session_progress(p.withColumn("cancelled", F.col("session") % 5 == 0))


@query(f"WITH {corpus.PAIRS} SELECT session, sum((status = 'approved')::INT)::BIGINT AS saved, sum((status <> 'approved')::INT)::BIGINT AS excluded, session % 3 = 0 OR session % 4 = 0 AS historical, session % 3 = 0 OR session % 4 = 0 AS refused FROM pairs GROUP BY 1")
def eval_export(s, d):
    p = corpus.pairs(s, d)
    sessions = p.select("session").distinct().select("session", (F.col("session") % 3 == 0).alias("stale"), (F.col("session") % 4 == 0).alias("orphaned"))
    return G.eval_export(p, sessions)


#: Even sessions exist already; of those divisible by four a copy was imported before, so new ids go on from its number.
@query(f"WITH {corpus.PAIRS}, x AS (SELECT DISTINCT session FROM pairs) SELECT CASE WHEN session % 2 = 0 THEN 'imported-' || substring(sha256(session::VARCHAR), 1, 32) || CASE WHEN session % 4 = 0 THEN '-2' ELSE '-1' END ELSE session::VARCHAR END AS session, session::VARCHAR AS origin, 'Old' AS collection FROM x")
def import_sessions(s, d):
    sessions = corpus.pairs(s, d).select("session").distinct().withColumn("owner", F.lit("me"))
    known = F.col("session").cast("string")
    before = sessions.where("session % 4 = 0").select(text_of("imported-", F.substring(F.sha2(known, 256), 1, 32), "-1").alias("session"))
    out = G.import_sessions(sessions, sessions.where("session % 2 = 0").select(known.alias("session")).union(before), "Old")
    return out.select("session", F.col("imported_from.session").alias("origin"), F.col("imported_from.collection").alias("collection"))


@query(f"WITH {CHUNKS} SELECT doc_id * 100000 + chunk_index AS id, CASE WHEN chunk_index % 3 = 0 THEN 'What is ' || length(content) || '?' END AS question, CASE WHEN chunk_index % 3 = 0 THEN 'It is {{' || length(content) || '}}.' END AS answer, CASE WHEN chunk_index % 3 = 0 THEN 'It is {{' || length(content) || '}}.' END AS ground_truth, CASE chunk_index % 3 WHEN 1 THEN 'ValueError' WHEN 2 THEN 'unusable reply' END AS error FROM chunks")
def generate_pairs(s, d):
    def answer(text: str) -> str:
        at, n = text.split(" ", 1)
        if at == "1":
            raise ValueError("no answer")
        return "no object" if at == "2" else f'Well { "{" } this:\n{{"question": "What is {n}?", "answer": "It is {{{n}}}."}} and more'

    c = corpus.contents(s, d)
    sample = c.select("id", text_of((F.col("chunk_index") % 3).cast("string"), " ", F.char_length("content").cast("string")).alias("content"))
    return G.generate_pairs(sample, answer)


#: Of sessions divisible by three the question, of those divisible by five the status was edited meanwhile.
@query(f"""WITH {corpus.PAIRS}, k AS (SELECT *, session % 2 = 0 AND session % 3 <> 0 AND session % 5 <> 0 AS hit FROM pairs)
SELECT pair_id, session, CASE WHEN hit THEN 'Fresh?' ELSE question END AS question, CASE WHEN hit THEN 'Fresh.' ELSE answer END AS answer, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN 'Fresh.' ELSE 'old truth' END AS ground_truth FROM k""")
def regenerate_pairs(s, d):
    p = corpus.pairs(s, d).withColumn("ground_truth", F.lit("old truth"))
    fresh = p.where("session % 2 = 0").select("pair_id", F.lit("Fresh?").alias("question"), F.lit("Fresh.").alias("answer"))
    seen = p.withColumn("question", F.when(F.col("session") % 3 == 0, "changed since").otherwise(F.col("question"))).withColumn("status", F.when(F.col("session") % 5 == 0, "was other").otherwise(F.col("status")))
    return G.regenerate_pairs(p, fresh, seen)


# ------------------------------------------------------------------ requests


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '/users/{user}/keys/{key}' WHEN event_id % 3 = 1 THEN '/users/{user}' ELSE '/a.b' END AS template, CASE WHEN event_id % 3 = 0 THEN 'key=k' || event_id || ',user=u' || user_id WHEN event_id % 3 = 1 THEN 'user=u' || user_id ELSE '' END AS parameters FROM events WHERE event_id % 3 < 2 OR event_id % 2 = 0")
def classify_all_parameters(s, d):
    k, who = F.col("event_id"), text_of("u", F.col("user_id").cast("string"))
    path = F.when(k % 3 == 0, text_of("/users/", who, "/keys/k", k.cast("string"))).when(k % 3 == 1, text_of("/users/", who)).when(k % 2 == 0, "/a.b").otherwise("/axb")
    templates = s.range(1).select(F.lit("GET").alias("method"), F.explode(F.array(*map(F.lit, ["/users/{user}/keys/{key}", "/users/{user}", "/a.b"]))).alias("template"))
    out = A.classify_requests(table(s, d, "events").select("event_id", F.lit("GET").alias("method"), path.alias("path")), templates)
    return out.select("event_id", "template", F.array_join(F.array_sort(F.transform(F.map_entries("parameters"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",").alias("parameters"))


def points(s, d):
    e = table(s, d, "events")
    step = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1)
    return e.select("event_type", (F.col("user_id") % 3).alias("status_class"), step.alias("delta"), F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "timeout").otherwise("refused")).alias("error_type"))


@query("SELECT status_class, count(*)::BIGINT AS count, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END)::BIGINT AS active, sum((event_type = 'error')::INT)::BIGINT AS errors FROM (SELECT *, user_id % 3 AS status_class FROM events) GROUP BY 1")
def request_activity(s, d):
    return A.request_counters(points(s, d), ["status_class"])


@query("SELECT user_id % 3 AS status_class, CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'refused' END AS error_type, count(*)::BIGINT AS count FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def errors_by_type(s, d):
    return A.errors_by_type(points(s, d), ["status_class"])


# ------------------------------------------------------------------ estimates, windows, chunk rows


@query(rf"""WITH {DOCS}, x AS (SELECT source_file, length(text)::BIGINT AS chars, ceil(length(text) / 5.0)::BIGINT AS fixed, (1 + greatest(0, ceil((length(text) - 5) / 4.0)))::BIGINT AS overlap FROM docs)
SELECT source_file, chars, fixed, overlap, chars > 7000000 OR greatest(fixed, overlap) > 8000 OR chars + (overlap - 1) > 8000000 AS flagged FROM x""")
def estimates_flagged(s, d):
    out = M.corpus_estimates(documents(s, d), 5, 1)
    return out.select("source_file", *[F.col(c).cast("long").alias(c) for c in ("chars", "fixed", "overlap")], "flagged")


@query(f"""WITH {DOCS}, x AS (SELECT source_file, length(text) AS n, 1 + greatest(0, length(text) - 50) AS w FROM docs) SELECT source_file, CASE WHEN w > 10000 THEN 'chunks' END AS kind FROM x WHERE w > 10000""")
def check_limits(s, d):
    return C.check_limits(documents(s, d), 50, 49)


WINDOWS = LINES + """, u AS (SELECT source_file, line::INT AS line, text, length(text) + 1 AS n FROM lines),
step(source_file, line, w, used) AS (
  SELECT source_file, line, 0, n FROM u WHERE line = 0
  UNION ALL
  SELECT u.source_file, u.line, CASE WHEN s.used + u.n > 3000 THEN s.w + 1 ELSE s.w END, CASE WHEN s.used + u.n > 3000 THEN u.n ELSE s.used + u.n END
  FROM step s JOIN u ON u.source_file = s.source_file AND u.line = s.line + 1),
wl AS (SELECT u.*, w AS "window" FROM u JOIN step USING (source_file, line))"""
WINDOWED = WINDOWS + """, k AS (SELECT source_file, line, trim(text) AS t FROM wl WHERE trim(text) <> ''), often AS (SELECT t FROM k GROUP BY t HAVING count(DISTINCT source_file) >= 3),
gone AS (SELECT DISTINCT source_file, line FROM k WHERE t IN (SELECT t FROM often) OR regexp_matches(t, '^(?i)(page )?[0-9]+( (of|/) [0-9]+)?$')),
per AS (SELECT l.source_file, "window", sum(n) AS chars, sum(CASE WHEN g.line IS NOT NULL THEN n ELSE 0 END) AS removed, max(CASE WHEN g.line IS NOT NULL THEN length(text) END) AS longest, count(g.line) AS gone_lines, count(*) AS lines FROM wl l LEFT JOIN gone g ON g.source_file = l.source_file AND g.line = l.line GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN longest > 200 THEN 'removed-long-line' WHEN removed > 0.2 * chars THEN 'removed-too-much' END AS fallback FROM per)"""


@query(f"""WITH RECURSIVE {WINDOWED} SELECT source_file, "window", (CASE WHEN fallback IS NOT NULL THEN lines ELSE lines - gone_lines END)::BIGINT AS kept_lines, (CASE WHEN fallback IS NOT NULL THEN 0 ELSE removed END)::BIGINT AS removed_chars, fallback FROM f""")
def window_removals(s, d):
    lines = K.window_lines(documents(s, d))
    return K.apply_removals(lines, K.boilerplate_decisions(lines, 3))


@query(f"""WITH RECURSIVE {WINDOWED} SELECT l.source_file, string_agg(text, chr(10) ORDER BY l.line) AS text FROM wl l JOIN f USING (source_file, "window") LEFT JOIN gone g ON g.source_file = l.source_file AND g.line = l.line WHERE f.fallback IS NOT NULL OR g.line IS NULL GROUP BY 1""")
def window_cleaned(s, d):
    lines = K.window_lines(documents(s, d))
    return K.cleaned_documents(lines, K.boilerplate_decisions(lines, 3))


@query(f"""WITH RECURSIVE {WINDOWS} SELECT source_file, count(DISTINCT "window")::BIGINT AS windows, count(DISTINCT "window") > 3 AS too_large FROM wl GROUP BY 1""")
def window_flags(s, d):
    return C.window_flags(C.line_windows(documents(s, d)), 3)


@query(f"WITH {CHUNKS} SELECT content, source_file, 'txt' AS source_type, chunk_index, 'overlap' AS chunk_strategy, 1000 AS chunk_size, 200 AS chunk_overlap, '2024-01-01 00:00:00' AS created_at FROM chunks")
def chunk_rows(s, d):
    rows, _ = C.chunk_documents(documents(s, d), "overlap", 1000, 200, 300, F.lit("2024-01-01 00:00:00"))
    return rows


#: Rows of a CSV file per supplier, in a fixed order; a part holds its header and rows up to 400 characters.
CSV = """u AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos, l_orderkey || ',' || l_linenumber || ',' || l_partkey || chr(10) AS text FROM lineitem)"""


@query(f"""WITH RECURSIVE {CSV}, step(k, pos, part, used) AS (SELECT k, pos, 0, length(text) FROM u WHERE pos = 1 UNION ALL
  SELECT u.k, u.pos, CASE WHEN s.used + length(u.text) > 383 THEN s.part + 1 ELSE s.part END, CASE WHEN s.used + length(u.text) > 383 THEN length(u.text) ELSE s.used + length(u.text) END FROM step s JOIN u ON u.k = s.k AND u.pos = s.pos + 1)
SELECT k::VARCHAR AS source_file, part, 'order,line,party' || chr(10) || string_agg(text, '' ORDER BY pos) AS content, count(*)::BIGINT AS units FROM u JOIN step USING (k, pos) GROUP BY 1, 2""")
def pack_csv(s, d):
    return C.pack_parts(csv_units(s, d), 400, "csv", "header")


def csv_units(s, d):
    from pyspark.sql import Window as W

    pos = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    cells = F.array(*[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")])
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("source_file"), pos.alias("pos"), cells.alias("cells"))
    return rows.withColumn("text", F.concat(F.array_join("cells", ","), F.lit("\n"))).withColumn("header", F.lit("order,line,party\n"))


@query(f"""WITH RECURSIVE {CSV}, t AS (SELECT k, pos, length(text) - 1 AS n FROM u), step(k, pos, part, used) AS (SELECT k, pos, 0, n FROM t WHERE pos = 1 UNION ALL
  SELECT t.k, t.pos, CASE WHEN s.used + 1 + t.n > 200 THEN s.part + 1 ELSE s.part END, CASE WHEN s.used + 1 + t.n > 200 THEN t.n ELSE s.used + 1 + t.n END FROM step s JOIN t ON t.k = s.k AND t.pos = s.pos + 1)
SELECT k::VARCHAR AS source_file, (max(part) + 1)::BIGINT AS chunks FROM step GROUP BY 1""")
def pack_replay(s, d):
    return C.pack_replay(csv_units(s, d), 200)


@query()
def split_documents(s, d):
    parts, _ = C.split_documents(documents(s, d), "overlap", 50, 45)
    return parts


@query()
def batch_query(s, d):
    """Every question as two users to all collections: a collection is a language, some with their own settings."""
    embed = hashed_words(32)
    lang = documents(s, d).select("source_file", F.col("lang").alias("collection"))
    chunks = corpus.contents(s, d).join(lang, "source_file").where("collection is not null").withColumn("vector", embed(F.col("content")))
    langs = lang.select("collection").distinct().where("collection is not null")
    k = F.col("query_id")
    users = F.explode(F.array(F.lit("a"), F.lit("b")))
    asked = corpus.questions(s, d).withColumn("user", users).join(F.broadcast(langs)).select(F.concat_ws("/", k, "user", "collection").alias("query_id"), "user", "collection", "question")
    allowed = langs.select(F.lit("a").alias("user"), "collection").unionByName(langs.where("collection = 'en'").select(F.lit("b").alias("user"), "collection"))
    saved = langs.where("collection <> 'fr'").select("collection", F.when(F.col("collection") == "de", "hybrid").alias("retrieval_mode"), F.lit(3).alias("top_k"), F.when(F.col("collection") == "de", "engineer").alias("response_format"))
    return R.batch_query(asked, written(chunks), allowed, P.resolve_settings(langs, saved, P.RETRIEVAL), embed)
