"""Queries on metrics, jobs, the audit log and access."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import access as X
from quarry.operators import analytics as A
from quarry.operators import settings as P
from quarry.plans.common import registering, table
from quarry.sources.files import audit_cells
from quarry.streaming.streams import window_latency as latency_by_window

QUERIES, ORACLE_SQL, query = registering()


def events(s, d):
    return table(s, d, "events")


@query("SELECT event_type AS mode, count(*)::BIGINT AS n, round_even(quantile_cont(value, 0.5), 1) AS value_p50, round_even(quantile_cont(value, 0.95), 1) AS value_p95, round_even(quantile_cont(value, 0.99), 1) AS value_p99, round_even(avg(value), 1) AS value_mean FROM events GROUP BY 1")
def latency_summary(s, d):
    return A.latency_summary(events(s, d).withColumnRenamed("event_type", "mode"), ["mode"], ["value"])


@query("SELECT strftime(time_bucket(INTERVAL 60 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS mode, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1, 2")
def window_latency(s, d):
    out = latency_by_window(events(s, d).withColumnRenamed("event_type", "mode"), 60)
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "mode", "n", F.round("mean", 6).alias("mean"), F.round("p95", 6).alias("p95"))


@query("SELECT o_orderkey AS job, sum((l_returnflag = 'N')::INT)::BIGINT AS stored, sum((l_returnflag = 'R')::INT)::BIGINT AS replaced, sum((l_linestatus = 'O')::INT)::BIGINT AS accepted FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def ingest_counters(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("job")).join(table(s, d, "lineitem").withColumnRenamed("l_orderkey", "job"), "job")
    return A.ingest_counters(rows, "job", {"stored": F.col("l_returnflag") == "N", "replaced": F.col("l_returnflag") == "R", "accepted": F.col("l_linestatus") == "O"})


@query("SELECT l_orderkey, CASE WHEN sum((l_returnflag = 'R')::INT) = 0 THEN 'completed' WHEN sum((l_returnflag = 'R')::INT) = count(*) THEN 'failed' ELSE 'partial' END AS status, count(*)::BIGINT AS files FROM lineitem GROUP BY 1")
def job_status(s, d):
    return A.job_status(table(s, d, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R")


@query("SELECT event_type, (" + " + ".join(f"(value > {b})::INT" for b in A.BOUNDS) + ")::INT AS bucket, count(*)::BIGINT AS count, round(sum(value), 4) AS sum FROM events GROUP BY 1, 2")
def duration_histogram(s, d):
    return A.duration_histogram(events(s, d), "value", ["event_type"]).withColumn("sum", F.round("sum", 4))


@query("SELECT event_type, user_id % 3 AS status_class, 'error' AS outcome, count(*)::BIGINT AS n FROM events WHERE event_type IN ('click', 'view') AND value >= 0 GROUP BY 1, 2")
def request_counters(s, d):
    points = events(s, d).select("event_type", (F.col("user_id") % 3).alias("status_class"), "value", F.lit("partial").alias("outcome"))
    return A.admit_points(points, {"event_type": ["click", "view"]}).groupBy("event_type", "status_class", "outcome").agg(F.count("*").alias("n"))


JOBS = "jobs AS (SELECT o_orderkey AS id, o_custkey AS owner, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'failed' ELSE 'completed' END AS status, o_orderdate AS finished FROM orders)"


def jobs(s, d):
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "failed").otherwise("completed")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), status.alias("status"), F.col("o_orderdate").alias("finished"))


@query(f"WITH {JOBS}, done AS (SELECT * FROM jobs WHERE status <> 'running' AND finished > TIMESTAMP '1997-03-01' - INTERVAL 24 HOUR AND finished <= TIMESTAMP '1997-03-01' ORDER BY finished DESC, id LIMIT 20) SELECT id, owner, status FROM jobs WHERE status = 'running' UNION ALL SELECT id, owner, status FROM done")
def recent_jobs(s, d):
    return A.recent_jobs(jobs(s, d), F.lit("1997-03-01").cast("timestamp_ntz")).select("id", "owner", "status")


@query("WITH last AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) SELECT event_id AS id, event_type, value FROM last WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_metrics(s, d):
    return A.recent_metrics(events(s, d).withColumnRenamed("event_id", "id"), F.col("event_type") == "click", 50).select("id", "event_type", "value")


@query("SELECT event_id AS id, event_type, min(event_id) OVER () AS next_before FROM (SELECT * FROM events WHERE event_id < 5000 ORDER BY event_id DESC LIMIT 20)")
def audit_page(s, d):
    return A.audit_page(events(s, d).select(F.col("event_id").alias("id"), "event_type"), 5000, 20)


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06' AND event_type = 'error'")
def filter_audit(s, d):
    ntz = lambda x: F.lit(x).cast("timestamp_ntz")
    e = events(s, d)
    return A.filter_audit(e.where((F.col("ts") >= ntz("2024-01-05")) & (F.col("ts") < ntz("2024-01-06"))), event_type="error").select("event_id", "user_id")


@query("""SELECT event_id::VARCHAR AS event_id, CASE WHEN event_id % 4 = 0 THEN '''=' || event_type WHEN event_id % 4 = 1 THEN '''-' || event_type ELSE event_type END AS action, '{"k":"' || json_extract_string(props, '$.k') || '"}' AS details FROM events""")
def audit_cells_csv(s, d):
    m = F.col("event_id") % 4
    e = events(s, d).select("event_id", F.concat(F.when(m == 0, "=").when(m == 1, "-").otherwise(""), F.col("event_type")).alias("action"), F.from_json("props", "map<string,string>").alias("details"))
    return audit_cells(e, ["event_id", "action", "details"], ("details",))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '/collections/{name}' WHEN event_id % 3 = 1 THEN '/collections/{name}/settings' ELSE '/health' END AS template, CASE WHEN event_id % 3 < 2 THEN 'u' || user_id END AS parameter FROM events WHERE event_type IN ('click', 'view')")
def classify_requests(s, d):
    m = F.col("event_id") % 3
    who = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    path = F.when(m == 0, F.concat(F.lit("/collections/"), who)).when(m == 1, F.concat(F.lit("/collections/"), who, F.lit("/settings"))).otherwise("/health")
    requests = events(s, d).select("event_id", F.when(F.col("event_type").isin("click", "view"), "GET").otherwise("POST").alias("method"), path.alias("path"))
    routes = ["/collections/{name}", "/collections/{name}/settings", "/health", "/collections"]
    templates = s.range(1).select(F.lit("GET").alias("method"), F.explode(F.array(*map(F.lit, routes))).alias("template"))
    return A.classify_requests(requests, templates).select("event_id", "template", "parameter")


@query("""WITH RECURSIVE f AS (SELECT user_id AS key, epoch(ts)::BIGINT AS ts, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT) AS i FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events WHERE event_type = 'error')),
step(key, i, w, first, last) AS (SELECT key, i, 0, ts, ts FROM f WHERE i = 1 UNION ALL SELECT f.key, f.i, CASE WHEN f.ts < s.first + 86400 THEN s.w ELSE s.w + 1 END, CASE WHEN f.ts < s.first + 86400 THEN s.first ELSE f.ts END, f.ts FROM step s JOIN f ON f.key = s.key AND f.i = s.i + 1)
SELECT key, first, (count(*) - 1)::INT AS count, max(last) AS last FROM step GROUP BY key, w, first""")
def collapse_failed_logins(s, d):
    failed = events(s, d).where("event_type = 'error'").select(F.col("user_id").alias("key"), F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("ts"))
    return A.collapse_failed_logins(failed, 86400)


@query("SELECT event_id, CASE WHEN user_id % 600 < 400 THEN 'success' WHEN user_id % 600 < 500 THEN 'refused' ELSE 'error' END AS http, CASE event_type WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'interrupted' END AS job FROM events")
def result_labels(s, d):
    status = F.when(F.col("event_type") == "click", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return events(s, d).select("event_id", T.http_result(F.col("user_id") % 600).alias("http"), T.job_result(status).alias("job"))


COPIES = "nations AS (SELECT n_nationkey AS k, n_name AS name FROM nation), cols AS (SELECT k, name AS collection, name AS original FROM nations UNION ALL SELECT k, name || '__tuning_' || md5(name), name FROM nations WHERE k % 2 = 0)"


def collections(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("collection"))
    return n.unionByName(n.where("k % 2 = 0").withColumn("collection", F.concat("collection", F.lit("__tuning_"), F.md5("collection"))))


@query(f"WITH {COPIES} SELECT collection, CASE WHEN collection = original THEN original ELSE collection || ',' || original END AS chain FROM cols")
def collection_chain(s, d):
    return collections(s, d).select("collection", F.array_join(X.collection_chain(F.col("collection")), ",").alias("chain"))


def access(s, d):
    c = table(s, d, "customer")
    n = table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("collection"))
    users = c.select(F.col("c_custkey").cast("string").alias("user"), F.when(F.col("c_mktsegment") == "MACHINERY", "engineer").otherwise("reader").alias("role"))
    grants = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("string").alias("user"), "collection")
    members = c.select(F.col("c_custkey").cast("string").alias("user"), (F.col("c_custkey") % 5).alias("grp"))
    group_grants = n.select((F.col("n_nationkey") % 5).alias("grp"), "collection").where("grp = 1")
    return users, n.where("n_nationkey % 3 = 0").select("collection"), grants, group_grants, members


@query(f"""WITH {COPIES}, restricted AS (SELECT name FROM nations WHERE k % 3 = 0), u AS (SELECT c_custkey, c_nationkey, c_mktsegment = 'MACHINERY' AS engineer FROM customer),
held AS (SELECT c_custkey, name FROM u JOIN nations ON k = c_nationkey UNION SELECT c_custkey, name FROM u JOIN nations ON k % 5 = 1 AND c_custkey % 5 = 1)
SELECT '*' AS "user", collection, 'open' AS via FROM cols WHERE original NOT IN (SELECT name FROM restricted)
UNION ALL SELECT DISTINCT c_custkey::VARCHAR, collection, 'grant' FROM held JOIN cols ON original = name WHERE name IN (SELECT name FROM restricted) AND c_custkey IN (SELECT c_custkey FROM u WHERE NOT engineer)
UNION ALL SELECT c_custkey::VARCHAR, '*', 'role' FROM u WHERE engineer""")
def visible_collections(s, d):
    users, restricted, grants, group_grants, members = access(s, d)
    return X.visible_collections(users, collections(s, d).select("collection"), restricted, grants, group_grants, members)


@query("SELECT DISTINCT n_name || '__copy' AS copy, c_custkey::VARCHAR AS \"user\" FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 3 = 0")
def narrowest_access(s, d):
    _, restricted, grants, _, _ = access(s, d)
    n = table(s, d, "nation")
    chains = n.select(F.concat("n_name", F.lit("__copy")).alias("copy"), F.explode(F.array("n_name", F.concat("n_name", F.lit("__copy")))).alias("link"))
    return X.narrowest_access(chains, restricted, grants)


@query("SELECT c_custkey::VARCHAR AS \"user\", n_name AS collection, 'removed' AS change FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 UNION ALL SELECT c_custkey::VARCHAR, n_name || '_new', 'added' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0")
def access_changes(s, d):
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    before = c.select(F.col("c_custkey").cast("string").alias("user"), F.col("n_name").alias("collection"))
    after = c.select(F.col("c_custkey").cast("string").alias("user"), F.concat("n_name", F.when(F.col("c_acctbal") < 0, "_new").otherwise("")).alias("collection"))
    return X.access_changes(before, after)


@query("SELECT n_name AS collection, CASE WHEN n_nationkey % 2 = 0 THEN 'flat' ELSE 'hnsw' END AS index_type, count(c_custkey)::BIGINT AS object_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def collection_overview(s, d):
    n = table(s, d, "nation").select(F.col("n_name").alias("collection"), F.when(F.col("n_nationkey") % 2 == 0, "flat").otherwise("hnsw").alias("index_type"))
    _, _, grants, _, _ = access(s, d)
    return X.collection_overview(n, grants)


@query("""SELECT s_suppkey, concat_ws(',', CASE WHEN s_suppkey % 100 < 50 THEN 'chunk_size' END, CASE WHEN s_suppkey % 7 >= s_suppkey % 100 THEN 'overlap' END) AS violations FROM supplier""")
def validate_settings(s, d):
    k = F.col("s_suppkey")
    x = table(s, d, "supplier").select("s_suppkey", F.lit("overlap").alias("chunking_strategy"), (k % 100).alias("chunk_size"), (k % 7).alias("chunk_overlap"), F.lit(0).alias("min_chunk_size"), F.lit(0.5).alias("similarity_threshold"))
    return P.validate_ingest_settings(x).select("s_suppkey", F.array_join("violations", ",").alias("violations"))
