"""Versioned collections over ``documents``, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import retrieval as r
from tidewell.operators.sizes import checkpoint_folder
from tidewell.sources.collections import Collections

_R = lambda spark, d, name: spark.read.parquet(f"{d}/{name}.parquet")
TENANT = "t"
#: Folders of terms a segment.
BUCKETS = 16


def _store(spark: SparkSession) -> Collections:
    """A store of its own, which goes when the driver ends."""
    root = f"{checkpoint_folder(spark)}/tidewell-collections-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return Collections(spark, root, BUCKETS)


def _rows(spark: SparkSession, d: str, content_type: str) -> DataFrame:
    """A chunk a document, with a vector of two components."""
    text, n = F.coalesce("text", F.lit("")), F.char_length(F.coalesce("text", F.lit(""))).cast("float")
    return _R(spark, d, "documents").select(F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id"), F.col("doc_id").alias("document_id"), text.alias("text"), F.lit(content_type).alias("content_type"), F.array(n, n).alias("embedding"))


def collection_versions(spark, d):
    """Documents in three batches, one of them sent twice and some sent again with another text; every seventh updated, some deleted, all embedded anew.

    The third batch replaces documents of every fifteenth number; at the end no older version is kept.
    """
    store, rows = _store(spark), _rows(spark, d, "row")
    k = F.col("document_id")
    store.create(TENANT, 2)
    for batch in ("b0", "b1", "b1"):
        store.append(TENANT, rows.where(k % 3 == int(batch[1])), batch=batch)
    again = rows.where((k % 3 == 2) | (k % 15 == 0))
    store.replace_documents(TENANT, again.select("document_id"), again.withColumn("text", F.when(k % 15 == 0, F.concat(F.lit("again "), "text")).otherwise(F.col("text"))), batch="b2")
    store.update(TENANT, rows.where(k % 7 == 0).select("chunk_id", F.concat(F.lit("changed "), k.cast("string")).alias("text")), ["text"])
    store.delete(TENANT, rows.where(k % 5 == 1).select("document_id"))
    store.rebuild(TENANT, lambda old: old.withColumn("embedding", F.array(*[F.col("embedding")[0]] * 3)), 3, "three")
    store.vacuum(TENANT)
    return store.read(TENANT).select("chunk_id", "document_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("embedding").alias("dimension"))


def grown_store(spark: SparkSession, d: str) -> Collections:
    """A collection of ``documents`` that came in four batches of uneven size, without those of every ninth number and with every eleventh shortened."""
    store, rows = _store(spark), _rows(spark, d, "chunk")
    k = F.col("document_id")
    store.create(TENANT, 2)
    for part in (k % 2 == 0, k % 4 == 1, k % 8 == 3, k % 8 == 7):
        store.append(TENANT, rows.where(part))
    store.update(TENANT, rows.where(k % 11 == 0).select("chunk_id", F.lit("a short text of the plan").alias("text")), ["text"])
    store.delete(TENANT, rows.where(k % 9 == 0).select("document_id"))
    store.merge(TENANT)
    return store


def grown_index(spark, d):
    """Statistics of every term of an index that grew by appends, updates and deletes."""
    return grown_store(spark, d).keyword_index(TENANT).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def grown_bm25(spark, d):
    """The same index, asked for every whole benchmark item: the twenty best each."""
    asked = _R(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return r.bm25(asked, grown_store(spark, d).keyword_index(TENANT), 20).select("query_id", "chunk_id", F.round("bm25_score", 3).alias("bm25_score"))


_FINAL = """SELECT 'c' || doc_id AS chunk_id, doc_id, CASE WHEN doc_id % 11 = 0 THEN 'a short text of the plan' ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id % 9 <> 0"""
_BM25 = rf"""
tok AS MATERIALIZED (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM ({_FINAL})),
tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest(w) AS term FROM tok) GROUP BY term),
raws AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, tot),
idfs AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""

QUERIES = {
    "collection_versions": (collection_versions, """SELECT 'c' || doc_id AS chunk_id, doc_id AS document_id, md5(CASE WHEN doc_id % 7 = 0 THEN 'changed ' || doc_id WHEN doc_id % 15 = 0 THEN 'again ' || coalesce(text, '') ELSE coalesce(text, '') END) AS text_md5, 3 AS dimension
        FROM documents WHERE doc_id % 5 <> 1"""),
    "grown_index": (grown_index, f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idfs"),
    "grown_bm25": (grown_bm25, rf"""WITH {_BM25},
        qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark) GROUP BY ALL),
        sc AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25_score
            FROM (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY 1, 2, 3) t JOIN qt USING (term) JOIN idfs USING (term), tot GROUP BY 1, 2)
        SELECT query_id, chunk_id, round(bm25_score, 3) AS bm25_score FROM sc WHERE bm25_score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) <= 20"""),
}
