"""Indexing jobs, collections with a stored dimension, streams around the assistant, numbering by runs."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import models
from tidewell.operators import assistant, chunking, ingest, records, retrieval
from tidewell.sources import files
from tidewell.streaming import feeds

SMALL = lambda: models.hash_embedder(8)


@pytest.fixture()
def store(spark, tmp_path):
    return files.Collections(spark, f"file://{tmp_path}/chunks")


def test_collections_keep_their_dimension(spark, store):
    rows = spark.createDataFrame([("c1", "hello", [1.0, 2.0])], "chunk_id string, text string, embedding array<double>")
    with pytest.raises(ValueError):
        store.append("a", rows)
    assert store.create("a", 2) and not store.create("a", 3) and store.dimension("a") == 2 and store.dimension("b") is None
    store.append("a", rows)
    with pytest.raises(ValueError):
        store.append("a", rows, 3)
    assert store.clear("a") and store.dimension("a") == 2 and not store.clear("a")
    store.append("a", rows)
    assert store.drop("a") and store.dimension("a") is None


def test_documents_are_indexed_in_one_job(spark, store):
    docs = spark.createDataFrame([("d1", "Alpha beta gamma. " * 300, "x"), ("d2", "Delta words here.", None), ("d3", None, "y")], "document_id string, text string, source string")
    store.create("t", 8)
    stats = ingest.index_documents(store, "t", docs, fields=["source"], questions=True, make=SMALL).first()
    rows = store.read("t")
    chunks = rows.where("content_type = 'chunk'")
    assert (stats.n_files, stats.n_chunks, stats.n_embeddings) == (2, rows.count(), rows.count()) and len(stats.previews) == min(50, rows.count())
    assert chunks.count() > 2 and rows.where("content_type = 'question'").count() > 0
    assert {r.document_id: r.metadata.get("source") for r in chunks.collect()} == {"d1": "x", "d2": None}
    index = store.keyword_index("t")
    asked = spark.createDataFrame([(1, "delta")], "query_id int, query_text string")
    assert [r.chunk_id for r in retrieval.bm25(asked, index).collect()] == [r.chunk_id for r in chunks.where("document_id = 'd2'").collect()]
    before = ingest.reindex(store, "t", lambda: lambda texts: np.ones((len(texts), 8)))
    again = store.read("t").collect()
    assert {tuple(r.embedding) for r in again} == {(1.0,) * 8} and sorted(r.chunk_id for r in again) == sorted(r.chunk_id for r in store.read("t", before).collect())


def test_bulk_ingest_and_objects(spark, store, tmp_path):
    pages = [{"url": f"http://a/{i}", "title": f"T{i}", "content": "text " * i, "category": "c"} for i in range(3)]
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "p.json").write_text("\n".join(map(json.dumps, pages)))
    store.create("t", 8)
    assert ingest.bulk_ingest(store, "t", f"file://{tmp_path}/html/*.json", make=SMALL).first().n_files == 2
    objects = spark.createDataFrame([("f", i, json.dumps({"name": f"n{i}", "price": i})) for i in range(7)], "file string, item_no int, object string")
    got = {r.document_id: r for r in ingest.object_documents(objects, ["name"], group=5).collect()}
    assert got["f#0"].n_objects == 5 and got["f#1"].n_objects == 2 and json.loads(got["f#1"].original_text.split("\n")[0]) == {"name": "n5", "price": 5} and "n6" in got["f#1"].text
    book = spark.createDataFrame([("b", 1, "Head\none\nFoot"), ("b", 2, "Head\ntwo\nFoot"), ("b", 3, "Head\nthree\nFoot")], "doc_id string, page int, text string")
    assert ingest.page_documents(book).first().text == "one\n\ntwo\n\nthree"


def test_metadata_of_the_document_wins(spark):
    chunks = spark.createDataFrame([("d", "k", "abc", "own", "", 0)], "doc_id string, chunk_id string, text string, section_title string, subsection_title string, chunk_index int")
    docs = spark.createDataFrame([("d", "theirs", "x")], "doc_id string, section_title string, tag string")
    assert chunking.with_metadata(chunks, docs, fields=["section_title", "tag"]).first().metadata == {"section_title": "theirs", "tag": "x", "subsection_title": "", "chunk_index": "0", "chunk_size": "3"}


def test_webhook_feed_is_the_same_as_a_table(spark, tmp_path):
    message = lambda body: {"type": "text", "from": "94", "id": body, "text": {"body": body}}
    payload = lambda phone, *bodies: json.dumps({"entry": [{"changes": [{"value": {"metadata": {"phone_number_id": phone}, "messages": [message(b) for b in bodies]}}]}]})
    df = spark.createDataFrame([(payload("7", "hi", " Help"),), (payload("8", "no"),), (payload("7", "/reset"),)], "payload string")
    tenants = spark.createDataFrame([("7", "a", True), ("8", "b", False)], "wa_phone_id string, client_slug string, wa_enabled boolean")
    want = {tuple(r) for r in feeds.webhook_feed(df, tenants).collect()}
    assert want == {("a", "94", "hi", "hi", None), ("a", "94", " Help", " Help", "help"), ("a", "94", "/reset", "/reset", "clear")}
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = feeds.webhook_feed(stream, tenants).writeStream.format("memory").queryName("feed").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(60) and {tuple(r) for r in spark.table("feed").collect()} == want


def test_log_and_crawl_sinks_are_taken_up_again(spark, tmp_path):
    turns = lambda ids: spark.createDataFrame([(i, i % 2 == 0, False, None, None, None) for i in ids], "id int, no_kb_match boolean, escalated boolean, emotion string, intensity int, feedback string")
    source, log, check = (str(tmp_path / x) for x in ("turns", "log", "check"))
    for ids in (range(3), range(3, 5)):
        turns(ids).coalesce(1).write.mode("append").parquet(source)
        assert feeds.interaction_log(spark.readStream.schema(turns([0]).schema).parquet(source), log, check).awaitTermination(60)
    assert {(r.id, r.weak_reason) for r in spark.read.parquet(log).collect()} == {(i, None if i % 2 else "no_kb_match") for i in range(5)}

    pages, table, check = (str(tmp_path / x) for x in ("pages", "table", "check2"))
    schema = "url string, html string"
    for rows in ([("a", "1"), ("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(pages)
        assert feeds.crawl_sink(spark.readStream.schema(schema).parquet(pages), table, check).awaitTermination(60)
    assert sorted((r.url, r.html) for r in spark.read.parquet(table).collect()) == [("a", "1"), ("b", "2"), ("c", "4")]


def test_numbers_by_run_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("key")).repartition(5)
    got = records.numbered(rows, ["key"], F.floor(F.col("key") / 90)).collect()
    assert all(r.nth == r.key + 1 for r in got) and len(got) == 1000


def test_empty_replies_keep_the_question(spark):
    df = spark.createDataFrame([("q", None), ("q", " "), ("q", "answer text")], "q string, reply string")
    out = [r.x for r in df.select(assistant.search_text(F.col("q"), F.col("reply"), "hyde").alias("x")).collect()]
    assert out == ["q", "q", "answer text"]
