"""Session, limit and tenant-table queries over ``events`` and the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import messages as m
from tidewell.operators import records as r
from tidewell.streaming import sessions as s

_R = lambda spark, d, name: spark.read.parquet(f"{d}/{name}.parquet")


def session_30min(spark, d):
    found = s.sessions(_R(spark, d, "events"))
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_events")


def session_numbers(spark, d):
    return s.session_numbers(_R(spark, d, "events")).select("event_id", "session_no")


def session_stats(spark, d):
    found = s.sessions(_R(spark, d, "events"))
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_events").alias("n_events"), F.max("n_events").alias("longest"))


_PATHS = "SELECT * FROM (VALUES ('/api/clients/x/query'), ('/api/query'), ('/api/chat/1'), ('/api/documents/upload'), ('/health'), ('/other')) AS p(path)"


def rate_limit_lookup(spark, d):
    kinds = _R(spark, d, "events").select(F.concat(F.lit("/api/"), "event_type", F.lit("/"), F.col("user_id") % 5).alias("path")).distinct()
    return kinds.unionByName(spark.sql(_PATHS)).select("path", m.rate_limit(F.col("path")).alias("per_minute"))


def rate_limit_log(spark, d):
    """Events as requests, an hour of event time counting as a minute."""
    e = _R(spark, d, "events").select("user_id", "event_id", "ts", F.lit(2).alias("limit"))
    return s.rate_limited(e, window=3600.0)


def tenant_doc_counts(spark, d):
    owners = _R(spark, d, "customer").select("c_custkey")
    return r.counts_per(owners, _R(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "n_documents")


def reconcile_anti(spark, d):
    """Customers that never ordered, as tenants on disk without a row."""
    return r.missing_rows(_R(spark, d, "customer").select("c_custkey"), _R(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")


def delete_documents(spark, d):
    gone = _R(spark, d, "labels").where("toxic = 1").select("doc_id")
    return r.delete_rows(_R(spark, d, "documents").select("doc_id", "lang"), gone, "doc_id")


def update_documents(spark, d):
    changes = _R(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "low").alias("lang"), F.when(F.col("toxic") == 1, "toxic").alias("source"))
    return r.update_rows(_R(spark, d, "documents").select("doc_id", "lang", "source"), changes, "doc_id", ["lang", "source"])


def append_numbered(spark, d):
    """Labelled documents are appended to the benchmark items; every second one lacks an id."""
    have = _R(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("chunk_id"), F.col("item_id").alias("key"))
    more = _R(spark, d, "labels").select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("own"), F.col("doc_id"))).alias("chunk_id"), F.col("doc_id").alias("key"))
    return r.append_numbered(have, more, [F.col("key")], F.floor(F.col("key") / 50_000))


def pagination(spark, d):
    return r.page_of(_R(spark, d, "orders").select("o_orderkey", "o_custkey"), [F.desc("o_custkey"), F.col("o_orderkey")], 100, 25)


def tenants_union(spark, d):
    a = _R(spark, d, "customer").select(F.col("c_nationkey").alias("slug"))
    return a.unionByName(_R(spark, d, "supplier").select(F.col("s_nationkey").alias("slug"))).distinct()


def ownership(spark, d):
    """Orders of customers in nation 3: a semi join on the owner."""
    mine = _R(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return _R(spark, d, "orders").select("o_orderkey", "o_custkey").join(mine, "o_custkey", "left_semi")


def cascade_delete(spark, d):
    """What is left of orders when the customers of nation 3 go."""
    gone = _R(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return r.delete_rows(_R(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


def crawl_manifest(spark, d):
    p = _R(spark, d, "pages")
    return p.agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.octet_length("html")).alias("n_bytes"), F.count_if(F.octet_length("html") > 1500).alias("n_large"))


_SESS = """(SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM (SELECT *, CASE WHEN lag(ts) OVER o IS NULL OR ts - lag(ts) OVER o > INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS fresh
    FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)))"""
_LIMIT = "CASE " + " ".join(f"WHEN contains(path, '{p}') THEN {n}" for p, n in m.LIMITS.items()) + f" ELSE {m.LIMIT_ELSE} END"

QUERIES = {
    "session_30min": (session_30min, f"SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n_events FROM {_SESS} GROUP BY user_id, session_no"),
    "session_numbers": (session_numbers, f"SELECT event_id, session_no FROM {_SESS}"),
    "session_stats": (session_stats, f"SELECT user_id, count(*) AS n_sessions, sum(n)::BIGINT AS n_events, max(n) AS longest FROM (SELECT user_id, session_no, count(*) AS n FROM {_SESS} GROUP BY 1, 2) GROUP BY 1"),
    "rate_limit_lookup": (rate_limit_lookup, f"SELECT path, {_LIMIT}::INT AS per_minute FROM (SELECT DISTINCT '/api/' || event_type || '/' || (user_id % 5) AS path FROM events UNION ALL {_PATHS})"),
    "rate_limit_log": (rate_limit_log, None),
    "tenant_doc_counts": (tenant_doc_counts, "SELECT c_custkey, count(o_orderkey) AS n_documents FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "reconcile_anti": (reconcile_anti, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "delete_documents": (delete_documents, "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "update_documents": (update_documents, "SELECT doc_id, coalesce(CASE WHEN quality = 0 THEN 'low' END, lang) AS lang, coalesce(CASE WHEN toxic = 1 THEN 'toxic' END, source) AS source FROM documents LEFT JOIN labels USING (doc_id)"),
    "append_numbered": (append_numbered, """SELECT 'b' || item_id AS chunk_id, item_id AS key FROM benchmark UNION ALL
        SELECT CASE WHEN doc_id % 2 = 0 THEN 'own' || doc_id ELSE 'doc_' || ((SELECT count(*) FROM benchmark) + row_number() OVER (ORDER BY doc_id) - 1) END, doc_id FROM labels"""),
    "pagination": (pagination, "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 25 OFFSET 100"),
    "tenants_union": (tenants_union, "SELECT c_nationkey AS slug FROM customer UNION SELECT s_nationkey FROM supplier"),
    "ownership": (ownership, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)"),
    "cascade_delete": (cascade_delete, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)"),
    "crawl_manifest": (crawl_manifest, "SELECT count(*) AS n_pages, sum(strlen(html))::BIGINT AS n_bytes, count(*) FILTER (WHERE strlen(html) > 1500) AS n_large FROM pages"),
}
