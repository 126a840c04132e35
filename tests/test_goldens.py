"""Hand-computed cases of scores, gates, fusion, text rules and records."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidewell.functions import messages as m, scores, text as t, urls as u, vectors as v
from tidewell.operators import records, retrieval as r, structure


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_vectors(spark):
    a, b, z = (F.array(*map(F.lit, x)) for x in ([3.0, 4.0], [0.0, 0.0], [6.0, 8.0]))
    assert one(spark, v.squared_l2(a, b)) == 25.0 and one(spark, v.cosine(a, b)) == 0.0 and abs(one(spark, v.cosine(a, z)) - 1) < 1e-12


def test_labels(spark):
    assert [one(spark, scores.relevance(F.lit(d))) for d in (0.29, 0.3, 0.6, 1.0)] == ["Highly Relevant", "Relevant", "Moderately Relevant", "Less Relevant"]
    assert one(spark, scores.relevance(F.lit(None).cast("double"))) == "Less Relevant"
    hits = spark.createDataFrame([(1, 1, 0.2, 1), (1, 2, 0.4, 2), (2, 1, None, 1)], "query_id int, chunk_id int, distance double, rank int")
    assert {x.query_id: x.confidence for x in r.confidence(hits).collect()} == {1: 0.85, 2: 0.5}
    assert one(spark, scores.confidence(F.lit(None).cast("double"))) == 0.0


def test_gates(spark):
    rows = [(1, 1, 1.2, 1), (1, 2, 1.3, 2), (1, 3, 1.31, 3), (2, 1, 1.4, 1), (2, 2, 1.5, 2), (3, 1, 1.55, 1), (4, 1, 1.56, 1)]
    hits = spark.createDataFrame(rows, "query_id int, chunk_id int, distance double, rank int")
    kept = {(x.query_id, x.chunk_id) for x in r.distance_gate(hits).collect()}
    assert kept == {(1, 1), (1, 2), (2, 1), (3, 1), (4, 1)}
    assert {x.query_id for x in r.hard_gate(hits).collect()} == {1, 2, 3}


def test_fusion(spark):
    near = spark.createDataFrame([(1, 10, 0.5, 1), (1, 11, 1.0, 2)], "query_id int, chunk_id int, distance double, rank int")
    words = spark.createDataFrame([(1, 10, 3.0, 1), (1, 12, 1.0, 2)], "query_id int, chunk_id int, bm25_score double, bm25_rank int")
    got = {x.chunk_id: x for x in r.fuse(near, words).collect()}
    assert got[10].hybrid_score == pytest.approx(1.0 + 0.1 * 2 / 61, abs=1e-6) and got[10].vector_score == 1.0 and got[11].vector_score == 0.0
    assert got[12].distance is None and got[12].hybrid_score == pytest.approx(0.1 * (1 / 1060 + 1 / 62), abs=1e-6)
    alone = r.fuse(near.where("chunk_id = 10"), words.where("false")).first()
    assert alone.hybrid_score == pytest.approx(0.7 + 0.1 * (1 / 61 + 1 / 1060), abs=1e-6)
    again = {x.chunk_id: x.hybrid_score for x in r.fuse(near.orderBy(F.desc("chunk_id")), words.orderBy("bm25_score")).collect()}
    assert again == {k: x.hybrid_score for k, x in got.items()}


def test_multi_query(spark):
    ranked = spark.createDataFrame([(1, 7, 0, 1.5), (1, 7, 2, 1.0), (1, 8, 0, 1.0)], "query_id int, chunk_id int, rank0 int, weight double")
    got = {x.chunk_id: x for x in r.multi_query_rrf(ranked, 5).collect()}
    assert got[7].rrf_score == pytest.approx(0.041129, abs=1e-6) and (got[7].appearances, got[7].avg_rank, got[7].best_rank, got[7]["rank"]) == (2, 1.0, 0, 1)


def test_bm25(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "cat dog"), (2, "cat"), (3, "bird bird fox")], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "bird bird"), (2, "cat"), (3, "none")], "query_id int, query_text string")
    index = r.write_keyword_index(chunks, f"file://{tmp_path}/all", buckets=3)
    got = {(x.query_id, x.chunk_id): x.bm25_score for x in r.bm25(asked, index).collect()}
    idf = math.log(2.5) - math.log(1.5)
    assert got[1, 3] == pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)), abs=1e-5)
    cat = math.log(1.5) - math.log(2.5)
    mean = (3 * idf + cat) / 4
    assert got[2, 2] == pytest.approx(0.25 * mean * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 1 / 2)), abs=1e-5)
    assert set(got) == {(1, 3), (2, 1), (2, 2)}
    assert {(x.query_id, x.chunk_id) for x in r.bm25(asked, index, only=chunks.where("chunk_id < 3")).collect()} == {(2, 1), (2, 2)}
    assert r.bm25(asked, r.write_keyword_index(chunks.where("chunk_id = 1"), f"file://{tmp_path}/one")).count() == 0
    assert r.bm25(asked, r.write_keyword_index(chunks.where("chunk_id = 9"), f"file://{tmp_path}/none")).count() == 0


def test_filter_before_search(spark):
    chunks = spark.createDataFrame([(1, [0.0], "a"), (2, [1.0], "b"), (3, [2.0], "b"), (4, None, "b"), (5, [1.0, 2.0], "b")], "chunk_id int, vec array<double>, label string")
    asked = spark.createDataFrame([(1, [0.0])], "query_id int, query_vec array<double>")
    assert [(x.chunk_id, x.distance) for x in r.knn(asked, chunks, 2, keep=F.col("label") == "b").orderBy("rank").collect()] == [(2, 1.0), (3, 4.0)]


def test_parent_swap(spark):
    hits = spark.createDataFrame([(1, 1, 0.1, 1), (1, 2, 0.2, 2), (1, 3, 0.3, 3)], "query_id int, chunk_id int, distance double, rank int")
    members = spark.createDataFrame([(1, "p"), (2, "p")], "chunk_id int, parent_id string")
    parents = spark.createDataFrame([("p", "all")], "parent_id string, parent_text string")
    assert sorted((x.chunk_id, x.parent_text, x.distance) for x in r.parent_swap(hits, members, parents).collect()) == [(1, "all", 0.1), (3, None, 0.3)]


def test_rerank_and_citations(spark):
    hits = spark.createDataFrame([(1, 1, 0.25, 1), (1, 2, None, 2)], "query_id int, chunk_id int, distance double, rank int").withColumns({c: F.lit(None).cast("string") for c in ("filename", "source", "section", "chunk_type")})
    assert [x.chunk_id for x in r.rerank(hits, F.col("chunk_id").cast("double"), 1).collect()] == [2]
    first = r.citations(hits).orderBy("citation_id").first()
    assert (first.citation_label, first.source_file, first.section, first.chunk_type, first.relevance) == ("Source 1", "Unknown", "General", "standard", "Highly Relevant")


def test_tokens_of_all_scripts(spark):
    assert one(spark, r.tokens(F.lit("සිංහල Plans"))) == ["ස", "හල", "plans"]


def test_text_rules(spark):
    assert one(spark, t.token_count(F.lit("x" * 11))) == 2 and one(spark, t.token_count(F.lit(None).cast("string"))) == 0
    assert one(spark, t.fix_ocr(F.lit("a–b “c” bro-\nken"))) == "a-b “c” broken"
    assert one(spark, t.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert one(spark, t.jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0.0
    assert [one(spark, t.parent_index(F.lit(i), F.lit(5), F.lit(2))) for i in range(5)] == [0, 0, 0, 1, 1]
    assert one(spark, t.sentences(F.lit("Mr. Silva came. He left!  then Rain?"))) == ["Mr. Silva came.", "He left! then Rain?"]
    assert one(spark, t.sentences(F.lit(" "))) == []
    assert one(spark, t.heading(F.lit("## Data Plans"))) == "Data Plans" and one(spark, t.heading(F.lit("no heading here."))) is None
    assert one(spark, t.keywords(F.array(*map(F.lit, ["b", "a", "a", "c", "b"])), 2)) == ["b", "a"]


def test_messages(spark):
    assert [one(spark, m.is_smalltalk(F.lit(x))) for x in ("hi", "Thanks!!", "hi there", "hi there friend", "")] == [True, True, True, False, True]
    assert [one(spark, m.needs_mood_check(F.lit(x))) for x in ("hello", "against", "OK", "HELP me")] == [True, True, False, True]
    assert one(spark, m.rate_limit(F.lit("/api/clients/7/query"))) == 60 and one(spark, m.rate_limit(F.lit("/api/query"))) == 30
    assert one(spark, m.reference_key(F.lit("tkt 1005"))) == "TKT1005"
    assert one(spark, m.clean_citations(F.lit("According to [Context 2], it works"))) == "It works"
    assert one(spark, m.mood_directive(F.lit("neutral"), F.lit(1), F.lit(False))) == ""
    assert "escalate_to_human" in one(spark, m.mood_directive(F.lit("angry"), F.lit(4), F.lit(False)))
    assert one(spark, m.is_noise(F.lit("?!..."))) and one(spark, m.is_slug(F.lit("a_b-1")))


def test_urls(spark):
    assert one(spark, u.normalize(F.lit("https://a.lk/x/?utm_source=f&b=1#t"))) == "https://a.lk/x?b=1"
    assert one(spark, u.normalize(F.lit("https://a.lk"))) == "https://a.lk/"
    assert one(spark, u.resolve(F.lit("https://a.lk/x/y?q"), F.lit("z.pdf"))) == "https://a.lk/x/z.pdf"
    assert len(one(spark, u.slug(F.lit("anything")))) == 16 and one(spark, u.category(F.lit("/"))) == "general"


def test_weak_flags(spark):
    rows = [(1, True, True, None, None, None), (2, False, False, "angry", 3, None), (3, False, False, "angry", 2, None), (4, False, False, None, None, "down")]
    df = spark.createDataFrame(rows, "id int, no_kb_match boolean, escalated boolean, emotion string, intensity int, feedback string")
    assert {x.id: x.weak_reason for x in records.weak_flags(df).collect()} == {1: "no_kb_match", 2: "negative_emotion", 3: None, 4: "thumbs_down"}
    turns = records.weak_flags(df.withColumn("feedback", F.lit(None).cast("string")))
    rated = spark.createDataFrame([(3, 1, "down"), (3, 2, "up")], "turn_id int, seq int, rating string")
    row = records.fold_feedback(turns, rated).where("id = 3").first()
    assert (row.feedback, row.is_weak, row.weak_reason) == ("up", True, "thumbs_down")


def test_accounts(spark):
    accounts = spark.createDataFrame([(1, "a", "0771234567"), (2, "b", "0771234567"), (3, "a", "Me@x.lk")], "account_id int, client_slug string, identifier string")
    asked = spark.createDataFrame([(1, "a", "077-123 4567"), (2, "a", " ME@x.lk "), (3, "a", "123"), (4, "a", "")], "ask_id int, client_slug string, asked_for string")
    assert sorted((x.ask_id, x.account_id, x.way) for x in records.match_accounts(asked, accounts).collect()) == [(1, 1, 2), (2, 3, 1)]


def test_repeated_edges(spark):
    pages = spark.createDataFrame([(1, p, f"Head\nbody {p}\nFoot") for p in (1, 2, 3)] + [(2, 1, "Head\nx"), (2, 2, "Head\ny")], "doc_id int, page int, text string")
    assert sorted(x.text for x in structure.remove_repeated_edges(pages).collect()) == ["Head\nx", "Head\ny", "body 1", "body 2", "body 3"]
