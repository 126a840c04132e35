"""Indexing: documents to chunks, vectors and postings of a tenant's collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import models
from tidewell.config import DEFAULT, EngineConfig
from tidewell.operators import assistant, chunking, json_records, structure
from tidewell.sources import files
from tidewell.sources.collections import Collections


def chunked(docs: DataFrame, *, fields: list[str] | None = None, questions: bool = False, config: EngineConfig = DEFAULT) -> DataFrame:
    """``docs(document_id, text, ...)`` as ``(chunk_id, document_id, text, content_type, metadata)``; ``fields`` of the document win over a chunk's own.

    With ``questions``, two template questions a chunk are chunks beside it.
    """
    made = chunking.with_metadata(chunking.chunk_documents(docs, config, id_col="document_id"), docs, id_col="document_id", fields=fields or [])
    plain = made.select("chunk_id", "document_id", "text", F.lit("chunk").alias("content_type"), "metadata")
    if not questions:
        return plain
    asked = chunking.question_chunks(plain.select("chunk_id", "text")).where("content_type = 'question'")
    of = plain.select(F.col("chunk_id").alias("source"), "document_id", "metadata")
    return plain.unionByName(asked.join(of, F.col("source_chunk_id") == F.col("source")).select("chunk_id", "document_id", "text", "content_type", "metadata"))


def pdf_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(document_id, text)`` of PDF files: pages without their repeated first and last lines, joined."""
    pages = files.read_pdf_pages(spark, path).withColumnRenamed("file", "doc_id")
    return page_documents(pages)


def page_documents(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page, text)`` as ``(document_id, text)``: repeated first and last lines go, pages are joined in order."""
    bare = structure.remove_repeated_edges(pages)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n")
    return bare.groupBy(F.col("doc_id").alias("document_id")).agg(whole.alias("text"))


def object_documents(objects: DataFrame, text_fields: list[str], *, group: int = 5) -> DataFrame:
    """``objects(file, item_no, object)`` as ``(document_id, text, n_objects, original_text)``, ``group`` neighbours a document; ``original_text`` keeps the objects as they were."""
    texts = json_records.objects_as_text(objects, "object", text_fields)
    grouped = json_records.grouped(texts, group, order="item_no", per="file")
    raw = objects.withColumn("group_no", F.floor(F.col("item_no") / group).cast("int")).groupBy(F.col("file").alias("r_file"), F.col("group_no").alias("r_no")) \
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_no", "object"))), lambda x: x["object"]), "\n").alias("original_text"))
    return grouped.join(raw, (F.col("file") == F.col("r_file")) & (F.col("group_no") == F.col("r_no"))) \
        .select(F.concat_ws("#", "file", F.col("group_no").cast("string")).alias("document_id"), "text", "n_objects", "original_text")


def embedded(chunks: DataFrame, make: Callable[[], models.Embedder] = models.hash_embedder) -> DataFrame:
    return models.embedded(chunks, make)


def index_documents(store: Collections, tenant: str, docs: DataFrame, *, fields: list[str] | None = None, questions: bool = False, make: Callable[[], models.Embedder] = models.hash_embedder,
                    config: EngineConfig = DEFAULT, batch: str | None = None) -> DataFrame:
    """Chunk, embed and index ``docs(document_id, text, ...)`` in a tenant's collection, in one version; gives its statistics.

    Chunks that a document had before are replaced, so documents that come again leave no copies.  A ``batch`` that was indexed already changes nothing.
    """
    store.create(tenant)
    store.replace_documents(tenant, docs, embedded(chunked(docs, fields=fields, questions=questions, config=config), make), batch=batch)
    store.merge(tenant)
    return assistant.index_statistics(store.read(tenant))


def bulk_ingest(store: Collections, tenant: str, path: str, **settings) -> DataFrame:
    """Curated pages, JSON lines of ``url, title, content, category``, through one indexing call, so that keyword statistics cover them all."""
    found = store.spark.read.schema("url string, title string, content string, category string").json(path)
    docs = found.where(F.trim(F.coalesce("content", F.lit(""))) != "").select(F.left(F.sha1("url"), F.lit(16)).alias("document_id"), F.concat_ws("\n\n", "title", "content").alias("text"), "url", "category")
    return index_documents(store, tenant, docs, fields=["url", "category"], **settings)


def reindex(store: Collections, tenant: str, make: Callable[[], models.Embedder], *, model: str = "", batch: str | None = None) -> int:
    """Embed a tenant's stored texts again, in vectors of any length; the version of before, which stays readable, is returned.

    Readers have the old vectors until all new ones are written and checked; if that fails, nothing has changed.
    """
    before = store.snapshot(tenant).version
    size = store.spark.createDataFrame([("a",)], "text string").select(F.size(models.embed_column(F.col("text"), make))).first()[0]
    store.rebuild(tenant, lambda rows: embedded(rows.drop("embedding"), make), size, model, batch=batch)
    return before
