"""Retrieval for an assistant: transformed questions, gated candidates, reranking, and what the answer shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell import models
from tidewell.config import DEFAULT, EngineConfig
from tidewell.operators import retrieval as r
from tidewell.operators.sizes import cut, small

#: Chunks whose ids are broadcast to look their texts up.
MOST_PASSAGES = 200_000
#: Sources named below an answer, chunks previewed after indexing.
FOOTER_SOURCES, PREVIEWS, PREVIEW_CHARS = 3, 50, 100


def without_questions(hits: DataFrame) -> DataFrame:
    """Hits that are no generated questions; rows without a type stay."""
    return hits.where(~F.col("content_type").eqNullSafe("question"))


def search_text(question: Column, reply: Column, mode: str | None) -> Column:
    """What is searched for: a hypothetical answer (``hyde``), a guarded rewriting (``rewrite``) or the question itself; a blank answer gives the question."""
    if mode == "hyde":
        return F.when(F.trim(F.coalesce(reply, F.lit(""))) == "", question).otherwise(F.trim(reply))
    return models.guarded_rewrite(question, reply) if mode == "rewrite" else question


def optimised(queries: DataFrame, vector_hits: DataFrame, texts: DataFrame, index: r.KeywordIndex, *, mode: str | None = "rewrite", use_hybrid: bool = True, use_reranking: bool = True,
              k_initial: int = 50, k: int = 5, scorer: Callable[[Column, Column], Column] = models.rerank_column, config: EngineConfig = DEFAULT) -> DataFrame:
    """``queries(query_id, query_text, reply)`` and their ``vector_hits`` to ``(query_id, chunk_id, rank, hybrid_score)``, best ``k``.

    The transformed question is searched by keywords and fused with the vector hits to ``k_initial``
    candidates; where a question has more than ``k``, a scorer reorders them by its original text.
    ``texts(chunk_id, text)`` are looked up for candidates only.
    """
    if use_hybrid:
        said = queries.select("query_id", search_text(F.col("query_text"), F.col("reply"), mode).alias("query_text"))
        found = r.top(r.fuse(vector_hits, r.bm25(said, index, config=config), config), F.desc("hybrid_score"), k_initial)
    else:
        found = vector_hits.where(F.col("rank") <= k_initial).withColumn("hybrid_score", F.lit(None).cast("double"))
    found = found.select("query_id", "chunk_id", "rank", "hybrid_score")
    if not use_reranking:
        return found.where(F.col("rank") <= k)
    found = cut(found)  # used twice, and texts are read only for what it holds
    many = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    asked = queries.select(F.col("query_id").alias("q_id"), "query_text")
    passages = texts.select(F.col("chunk_id").alias("t_id"), "text").join(small(found.select(F.col("chunk_id").alias("t_id")).distinct(), MOST_PASSAGES), "t_id", "left_semi")
    with_text = many.where(F.col("n") > k).join(passages, F.col("chunk_id") == F.col("t_id"), "left").join(asked, F.col("query_id") == F.col("q_id"))
    better = r.rerank(with_text.select("query_id", "chunk_id", "rank", "hybrid_score", "text", "query_text"), scorer(F.col("query_text"), F.col("text")), k)
    return better.select("query_id", "chunk_id", "rank", "hybrid_score").unionByName(many.where(F.col("n") <= k).select("query_id", "chunk_id", "rank", "hybrid_score"))


def retrieved(queries: DataFrame, chunks: DataFrame, index: r.KeywordIndex, k: int, *, texts: DataFrame | None = None, mode: str | None = None, use_hybrid: bool = True, use_reranking: bool = True, config: EngineConfig = DEFAULT) -> DataFrame:
    """An assistant's context: ``queries(query_id, query_text, query_vec, reply)`` against ``chunks(chunk_id, vec, text, content_type)``.

    Ten times ``k`` nearest chunks, generated questions taken out, none at all beyond the hard cutoff,
    the others within the threshold; then ``optimised`` to ``k``.  ``texts(chunk_id, text)`` may stand in a table of their own.
    """
    near = r.knn(queries.select("query_id", "query_vec"), chunks.select("chunk_id", "vec", "content_type"), k * config.candidate_factor)
    kept = without_questions(near)
    ranked = r.top(kept.select("query_id", "chunk_id", "distance"), F.asc("distance"), k * config.candidate_factor)
    gated = r.distance_gate(r.hard_gate(ranked, config), config)
    found = optimised(queries, gated, chunks.select("chunk_id", "text") if texts is None else texts, index, mode=mode, use_hybrid=use_hybrid, use_reranking=use_reranking, k=k, config=config)
    # a question whose vectors are all beyond the cutoff gets nothing, whatever its words find
    return found.join(gated.select("query_id").distinct(), "query_id", "left_semi")


def multi_query(variations: DataFrame, chunks: DataFrame, k: int, *, each: int = 10, config: EngineConfig = DEFAULT) -> DataFrame:
    """``variations(query_id, variant_no, variant, original, query_vec)``: every variation's nearest ``each`` in one search, fused by weighted reciprocal ranks.

    The first variation weighs half as much again if it is the original question, case aside.
    """
    weight = F.when((F.col("variant_no") == 0) & (F.lower("variant") == F.lower("original")), 1.5).otherwise(1.0)
    asked = variations.select(F.struct("query_id", "variant_no").alias("query_id"), "query_vec")
    hits = r.knn(asked, chunks, each).select(F.col("query_id.query_id").alias("q"), F.col("query_id.variant_no").alias("v"), "chunk_id", "rank")
    weights = variations.select(F.col("query_id").alias("w_q"), F.col("variant_no").alias("w_v"), weight.alias("weight"))
    ranked = hits.join(weights, (F.col("q") == F.col("w_q")) & (F.col("v") == F.col("w_v"))).select(F.col("q").alias("query_id"), "chunk_id", (F.col("rank") - 1).alias("rank0"), "weight")
    return r.multi_query_rrf(ranked, k, config)


def open_gaps(gaps: DataFrame, answers: DataFrame) -> DataFrame:
    """``gaps(client_slug, position, ...)`` that still find nothing: those with a row in ``answers(client_slug, position)`` are healed."""
    return gaps.join(answers.select("client_slug", "position").distinct(), ["client_slug", "position"], "left_anti")


def message_text(content: Column) -> Column:
    """A model message as text: a JSON list of strings and of parts with ``text`` or ``content`` is joined, anything else stays; null is empty."""
    said = F.coalesce(content, F.lit(""))
    parts = F.from_json(said, "array<string>")
    part = lambda p: F.when(F.startswith(p, F.lit("{")), F.coalesce(F.nullif(F.get_json_object(p, "$.text"), F.lit("")), F.get_json_object(p, "$.content"), F.lit(""))).otherwise(p)
    return F.when(F.startswith(said, F.lit("[")) & parts.isNotNull(), F.array_join(F.transform(parts, part), "")).otherwise(said)


def with_sources(answer: Column, sources: Column) -> Column:
    """The answer and, if there are any, its first three sources by file name."""
    lines = F.transform(F.slice(sources, 1, FOOTER_SOURCES), lambda s, i: F.concat(F.lit("\n  "), (i + 1).cast("string"), F.lit(". "), F.substring_index(s, "/", -1)))
    body = F.regexp_replace(answer, r"^\s+|\s+$", "")
    return F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, F.concat(body, F.lit("\n\n📚 *Sources:*"), F.array_join(lines, ""))).otherwise(body)


def index_statistics(chunks: DataFrame) -> DataFrame:
    """One row a tenant of ``chunks(client_slug, document_id, chunk_id, text, embedding)``: files, chunks, embeddings and the first previews by chunk id."""
    order = F.row_number().over(Window.partitionBy("client_slug").orderBy("chunk_id"))
    first = chunks.select("client_slug", "chunk_id", F.left("text", F.lit(PREVIEW_CHARS)).alias("text")).withColumn("nth", order).where(F.col("nth") <= PREVIEWS) \
        .groupBy(F.col("client_slug").alias("p_slug")).agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]).alias("previews"))
    counts = chunks.groupBy("client_slug").agg(F.count_distinct("document_id").alias("n_files"), F.count(F.lit(1)).alias("n_chunks"), F.count("embedding").alias("n_embeddings"))
    return counts.join(first, F.col("client_slug") == F.col("p_slug")).drop("p_slug")
