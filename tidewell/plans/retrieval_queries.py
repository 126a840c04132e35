"""Retrieval queries over ``documents`` and ``embeddings``, with their SQL."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import retrieval as r
from tidewell.operators.sizes import checkpoint_folder

_T = lambda spark, d, name: spark.read.parquet(f"{d}/{name}.parquet")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _T(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label")


def _of(column: str, n: int | None) -> Column:
    """Is it asked: the first ``n``, or for None the whole query set, every id divisible by 100."""
    return F.col(column) % 100 == 0 if n is None else F.col(column) < n


_indexes: dict[tuple[str, ...], str] = {}


def _fingerprint(spark: SparkSession, path: str) -> str:
    """The names, lengths and times of a table's files: another table, or the same one changed, has another."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return repr(sorted(found))


def keyword_index(spark: SparkSession, d: str) -> r.KeywordIndex:
    """The index of ``documents`` as it is now, written once for a session and state of the table."""
    key = spark.sparkContext.applicationId, _fingerprint(spark, f"{d}/documents.parquet")
    if key not in _indexes:
        path = f"{checkpoint_folder(spark)}/tidewell-bm25-{uuid.uuid4().hex}"
        r.write_keyword_index(_T(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), path)
        _indexes[key] = path
    return r.read_keyword_index(spark, _indexes[key])


def _asked(spark: SparkSession, d: str, n: int | None) -> DataFrame:
    return _T(spark, d, "embeddings").where(_of("vec_id", n)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents stand in for chunks; a document has a vector if one carries its number."""
    vec = _T(spark, d, "embeddings").select(F.col("vec_id").alias("v_id"), F.col("embedding").alias("vec"))
    docs = _T(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "source")
    return docs.join(vec, F.col("chunk_id") == F.col("v_id"), "left").drop("v_id")


def _questions(spark: SparkSession, d: str, n: int | None) -> DataFrame:
    """The first eight distinct tokens of each of the first ``n`` documents, with the vector of that number.

    For None, the whole text of every document of the whole query set, with its vector if it has one.
    """
    if n is None:
        asked = _T(spark, d, "documents").where(_of("doc_id", n)).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
        return asked.join(_asked(spark, d, n), "query_id", "left")
    text = F.array_join(F.slice(F.array_distinct(r.tokens(F.col("text"))), 1, 8), " ")
    return _T(spark, d, "documents").where(F.col("doc_id") < n).select(F.col("doc_id").alias("query_id"), text.alias("query_text")).join(_asked(spark, d, n), "query_id")


def _knn_sql(n: int, k: int, where: str = "TRUE", cosine: bool = False) -> str:
    score = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)" if cosine else "round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])^2, 6)"
    name, way = ("score", "DESC") if cosine else ("distance", "ASC")
    return f"""SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, {score} AS {name},
        row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} {way}, e.vec_id) AS rank
        FROM embeddings e, embeddings q WHERE q.vec_id < {n} AND {where} QUALIFY rank <= {k}"""


def vector_topk_l2(spark, d, n=1):
    return r.knn(_asked(spark, d, n), _vectors(spark, d), 10).select("query_id", "chunk_id", "distance", "rank")


def vector_topk_cosine(spark, d, n=1):
    return r.knn(_asked(spark, d, n), _vectors(spark, d), 10, metric="cosine").select("query_id", "chunk_id", "score", "rank")


def vector_topk_multi_query(spark, d, n=20):
    return r.knn(_asked(spark, d, n), _vectors(spark, d), 6).select("query_id", "chunk_id", "distance", "rank")


def metadata_filtered_topk(spark, d, n=5):
    return r.knn(_asked(spark, d, n), _vectors(spark, d), 5, keep=F.col("label") == 3).select("query_id", "chunk_id", "distance", "rank")


def distance_gate(spark, d, n=20):
    return r.distance_gate(r.knn(_asked(spark, d, n), _vectors(spark, d), 20, exclude_self=True)).select("query_id", "chunk_id", "distance", "rank")


def hard_gate(spark, d, n=50):
    return r.hard_gate(r.knn(_asked(spark, d, n), _vectors(spark, d), 3, exclude_self=True)).select("query_id", "chunk_id", "distance", "rank")


def similarity_display(spark, d, n=3):
    hits = r.knn(_asked(spark, d, n), _vectors(spark, d), 5)
    return hits.select("query_id", "chunk_id", F.round(1 / (1 + F.col("distance")), 6).alias("similarity"))


def tokenize_counts(spark, d):
    words = r.tokens(F.col("text"))
    return _T(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


def postings(spark, d):
    return r.postings(_T(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))


def bm25_stats(spark, d):
    return keyword_index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, d, n=5):
    return r.bm25(_questions(spark, d, n), keyword_index(spark, d), 20).select("query_id", "chunk_id", F.round("bm25_score", 4).alias("bm25_score"))


def minmax_normalize(spark, d, n=5):
    from pyspark.sql import Window

    hits = r.knn(_asked(spark, d, n), _vectors(spark, d), 8)
    per = Window.partitionBy("query_id")
    from tidewell.functions.scores import min_max

    return hits.select("query_id", "chunk_id", F.round(min_max(F.col("distance"), F.min("distance").over(per), F.max("distance").over(per)), 5).alias("normalised"))


def weighted_rrf_fusion(spark, d, n=5):
    near = r.knn(_asked(spark, d, n), _vectors(spark, d), 30)
    found = r.bm25(_questions(spark, d, n), keyword_index(spark, d), 30)
    return r.fuse(near, found).select("query_id", "chunk_id", "vector_rank", "bm25_rank", "hybrid_score")


def hybrid_topk(spark, d, n=3):
    """Question text and vector to the ten best documents with confidence and relevance."""
    hits = r.hybrid(_questions(spark, d, n), _chunks(spark, d), 10, keyword_index(spark, d))
    sure = r.confidence(hits)
    from tidewell.functions.scores import relevance

    return hits.join(sure, "query_id").select("query_id", "chunk_id", "rank", F.round("hybrid_score", 4).alias("hybrid_score"), "confidence", relevance(F.col("distance")).alias("relevance"))


def multi_query_rrf(spark, d, n=15):
    """Vectors 3i, 3i+1 and 3i+2 stand for the variations of question i; the first is the original."""
    asked = _asked(spark, d, n) if n is not None else _vectors(spark, d).where(F.floor(F.col("chunk_id") / 3) % 100 == 0).select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("query_vec"))
    hits = r.knn(asked, _vectors(spark, d), 10)
    ranked = hits.select(F.floor(F.col("query_id") / 3).cast("long").alias("query_id"), "chunk_id", (F.col("rank") - 1).alias("rank0"),
                         F.when(F.col("query_id") % 3 == 0, 1.5).otherwise(1.0).alias("weight"))
    return r.multi_query_rrf(ranked, 6).select("query_id", "chunk_id", "rrf_score", "appearances", F.round("avg_rank", 4).alias("avg_rank"), "best_rank")


def confidence_score(spark, d, n=50):
    return r.confidence(r.knn(_asked(spark, d, n), _vectors(spark, d), 3))


def relevance_labels(spark, d, n=20):
    from tidewell.functions.scores import relevance

    return r.knn(_asked(spark, d, n), _vectors(spark, d), 5).select("query_id", "chunk_id", relevance(F.col("distance")).alias("relevance"))


def citations(spark, d, n=10):
    docs = _T(spark, d, "documents").select(F.col("doc_id").alias("c_id"), "source", "lang")
    hits = r.knn(_asked(spark, d, n), _vectors(spark, d), 4).join(docs, F.col("chunk_id") == F.col("c_id"), "left")
    return r.citations(hits.select("query_id", "chunk_id", "rank", "distance", F.lit(None).cast("string").alias("filename"), "source",
                                   F.when(F.col("lang") != "en", F.col("lang")).alias("section"), F.lit(None).cast("string").alias("chunk_type")))


def parent_swap(spark, d, n=10):
    """Vectors of one label and tens group are children of one parent; groups divisible by four have none stored."""
    hits = r.knn(_asked(spark, d, n), _vectors(spark, d), 12)
    members = _vectors(spark, d).where((F.floor(F.col("chunk_id") / 10) % 4) != 0).select(
        "chunk_id", F.concat_ws("-", F.lit("p"), F.floor(F.col("chunk_id") / 10).cast("string")).alias("parent_id"))
    parents = members.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_children"))
    return r.parent_swap(hits, members, parents).select("query_id", "chunk_id", "parent_id", "n_children", "distance")


_W = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_BM25 = rf"""
tok AS MATERIALIZED (SELECT doc_id, {_W} AS w FROM documents),
tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM tok) GROUP BY term),
raws AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, tot),
idfs AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""


def _bm25_sql(n: int, k: int) -> str:
    return f"""{_BM25},
qs AS (SELECT doc_id AS query_id, list_filter(w, lambda x, i: list_position(w, x) = i)[:8] AS q FROM tok WHERE doc_id < {n} AND doc_id IN (SELECT vec_id FROM embeddings)),
qt AS (SELECT query_id, unnest(q) AS term FROM qs),
sc AS (SELECT query_id, doc_id AS chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25_score
       FROM (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY 1, 2, 3) t
       JOIN qt USING (term) JOIN idfs USING (term), tot GROUP BY 1, 2),
bm AS (SELECT query_id, chunk_id, bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS bm25_rank FROM sc WHERE bm25_score > 0 QUALIFY bm25_rank <= {k})"""


def _fuse_sql(near: str) -> str:
    return f"""
near AS ({near}),
v AS (SELECT query_id, chunk_id, distance, rank AS vector_rank, 1 - distance / (max(distance) OVER (PARTITION BY query_id) + 1e-6) AS s FROM near),
vs AS (SELECT query_id, chunk_id, distance, vector_rank, CASE WHEN max(s) OVER p = min(s) OVER p THEN 1.0 ELSE (s - min(s) OVER p) / (max(s) OVER p - min(s) OVER p) END AS vscore FROM v WINDOW p AS (PARTITION BY query_id)),
ws AS (SELECT query_id, chunk_id, bm25_rank, CASE WHEN max(bm25_score) OVER p = min(bm25_score) OVER p THEN 1.0 ELSE (bm25_score - min(bm25_score) OVER p) / (max(bm25_score) OVER p - min(bm25_score) OVER p) END AS kscore FROM bm WINDOW p AS (PARTITION BY query_id)),
fused AS (SELECT query_id, chunk_id, distance, vector_rank, bm25_rank,
  round(0.7 * coalesce(vscore, 0) + 0.3 * coalesce(kscore, 0) + 0.1 * (1.0 / (60 + coalesce(vector_rank, 1000)) + 1.0 / (60 + coalesce(bm25_rank, 1000))), 6) AS hybrid_score
  FROM vs FULL OUTER JOIN ws USING (query_id, chunk_id))"""


_RELEVANCE = "CASE WHEN coalesce(distance, 1.0) < 0.3 THEN 'Highly Relevant' WHEN coalesce(distance, 1.0) < 0.6 THEN 'Relevant' WHEN coalesce(distance, 1.0) < 1.0 THEN 'Moderately Relevant' ELSE 'Less Relevant' END"
_CONFIDENCE = "CASE WHEN m < 0.3 THEN 0.95 WHEN m < 0.5 THEN 0.85 WHEN m < 0.8 THEN 0.7 WHEN m < 1.2 THEN 0.5 ELSE 0.3 END"

QUERIES = {
    "vector_topk_l2": (vector_topk_l2, _knn_sql(1, 10)),
    "vector_topk_cosine": (vector_topk_cosine, _knn_sql(1, 10, cosine=True)),
    "vector_topk_multi_query": (vector_topk_multi_query, _knn_sql(20, 6)),
    "metadata_filtered_topk": (metadata_filtered_topk, _knn_sql(5, 5, "e.label = 3")),
    "distance_gate": (distance_gate, f"SELECT * FROM ({_knn_sql(20, 20, 'e.vec_id <> q.vec_id')}) WHERE distance <= 1.3 OR rank <= 1"),
    "hard_gate": (hard_gate, f"SELECT * FROM ({_knn_sql(50, 3, 'e.vec_id <> q.vec_id')}) QUALIFY min(distance) OVER (PARTITION BY query_id) <= 1.55"),
    "similarity_display": (similarity_display, f"SELECT query_id, chunk_id, round(1 / (1 + distance), 6) AS similarity FROM ({_knn_sql(3, 5)})"),
    "tokenize_counts": (tokenize_counts, f"SELECT doc_id, len({_W}) AS n_tokens, len(list_distinct({_W})) AS n_distinct FROM documents"),
    "postings": (postings, f"SELECT doc_id AS chunk_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_W}) AS term FROM documents) GROUP BY ALL"),
    "bm25_stats": (bm25_stats, f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idfs"),
    "bm25_topk": (bm25_topk, f"WITH {_bm25_sql(5, 20)} SELECT query_id, chunk_id, round(bm25_score, 4) AS bm25_score FROM bm"),
    "minmax_normalize": (minmax_normalize, f"SELECT query_id, chunk_id, round((distance - min(distance) OVER p) / (max(distance) OVER p - min(distance) OVER p), 5) AS normalised FROM ({_knn_sql(5, 8)}) WINDOW p AS (PARTITION BY query_id)"),
    "weighted_rrf_fusion": (weighted_rrf_fusion, f"WITH {_bm25_sql(5, 30)}, {_fuse_sql(_knn_sql(5, 30))} SELECT query_id, chunk_id, vector_rank, bm25_rank, hybrid_score FROM fused"),
    "hybrid_topk": (hybrid_topk, f"""WITH {_bm25_sql(3, 50)}, {_fuse_sql(f"SELECT * FROM ({_knn_sql(3, 100, 'e.vec_id IN (SELECT doc_id FROM documents)')}) WHERE distance <= 1.3 OR rank <= 1")},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, chunk_id) AS rank FROM fused QUALIFY rank <= 10),
        sure AS (SELECT query_id, {_CONFIDENCE} AS confidence FROM (SELECT query_id, round(avg(coalesce(distance, 1.0)), 6) AS m FROM ranked WHERE rank <= 3 GROUP BY 1))
        SELECT query_id, chunk_id, rank, round(hybrid_score, 4) AS hybrid_score, CAST(confidence AS DOUBLE) AS confidence, {_RELEVANCE} AS relevance FROM ranked JOIN sure USING (query_id)"""),
    "multi_query_rrf": (multi_query_rrf, f"""SELECT query_id, chunk_id, rrf_score, appearances, round(avg_rank, 4) AS avg_rank, best_rank FROM (
        SELECT query_id // 3 AS query_id, chunk_id, round(sum((CASE WHEN query_id % 3 = 0 THEN 1.5 ELSE 1.0 END)::DOUBLE / (60 + rank - 1)), 6) AS rrf_score, count(*) AS appearances, round(avg(rank - 1), 6) AS avg_rank, min(rank - 1) AS best_rank
        FROM ({_knn_sql(15, 10)}) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) <= 6"""),
    "confidence_score": (confidence_score, f"SELECT query_id, CAST({_CONFIDENCE} AS DOUBLE) AS confidence FROM (SELECT query_id, round(avg(distance), 6) AS m FROM ({_knn_sql(50, 3)}) GROUP BY 1)"),
    "relevance_labels": (relevance_labels, f"SELECT query_id, chunk_id, {_RELEVANCE} AS relevance FROM ({_knn_sql(20, 5)})"),
    "citations": (citations, f"""SELECT query_id, chunk_id, rank AS citation_id, 'Source ' || rank AS citation_label, round(distance, 3) AS distance, {_RELEVANCE} AS relevance,
        coalesce(source, 'Unknown') AS source_file, CASE WHEN lang <> 'en' THEN lang ELSE 'General' END AS section, 'standard' AS chunk_type FROM ({_knn_sql(10, 4)}) h LEFT JOIN documents ON chunk_id = doc_id"""),
    "parent_swap": (parent_swap, f"""WITH h AS ({_knn_sql(10, 12)}), m AS (SELECT vec_id, 'p-' || (vec_id // 10) AS parent_id FROM embeddings WHERE (vec_id // 10) % 4 <> 0),
        p AS (SELECT parent_id, count(*) AS n_children FROM m GROUP BY 1)
        SELECT query_id, chunk_id, parent_id, n_children, distance FROM h LEFT JOIN m ON chunk_id = vec_id LEFT JOIN p USING (parent_id)
        QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(parent_id, 'child:' || chunk_id) ORDER BY rank) = 1"""),
}

#: The searches whose SQL asks the first few ids; each is also registered with the whole query set, without SQL (the tests hold these against brute force).
SEARCHES = ("vector_topk_l2", "vector_topk_cosine", "vector_topk_multi_query", "metadata_filtered_topk", "distance_gate", "hard_gate", "similarity_display", "bm25_topk", "minmax_normalize",
            "weighted_rrf_fusion", "hybrid_topk", "multi_query_rrf", "confidence_score", "relevance_labels", "citations", "parent_swap")
QUERIES |= {f"{name}_whole": (partial(QUERIES[name][0], n=None), None) for name in SEARCHES}
