"""Neighbouring segments are compared in one pass, with the values of the column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as t
from tidewell.operators import structure as s

TEXTS = ["Red Fox runs runs fast", "red foxes and the Fox run fast fast", "", "éabc abc abcé Abc ABC a1bc x_abc", "the and of", "Kelvin Kelvin kelvin İzmir İ ΟΔΟΣ word-word word", "one two three one two three four",
         " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]


def test_likeness_is_that_of_the_expressions(spark):
    rows = [(i, j, a, b) for i, a in enumerate(TEXTS) for j, b in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "i int, j int, a string, b string").select("*", t.words(F.col("a")).alias("x"), t.words(F.col("b")).alias("y")).select("*", t.keywords(F.col("x")).alias("p"), t.keywords(F.col("y")).alias("q"))
    want = df.select("a", "b", t.jaccard(F.col("p"), F.col("q")).alias("keys"), t.weighted_similarity(F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("all")).collect()
    assert [(s.keyword_likeness(s.Said(r.a), s.Said(r.b)), s.weighted_likeness(s.Said(r.a), s.Said(r.b))) for r in want] == [(r["keys"], r["all"]) for r in want]


def test_words_are_not_shuffled(spark):
    parts = spark.createDataFrame([(1, 0, "red fox", "H"), (1, 2, "red fox runs", "H"), (1, 3, "blue sky", "I"), (2, 0, "alone", "")], "doc_id int, pos int, content string, heading string")
    near = s.adjacent(parts)
    assert sorted((r.doc_id, r.pos, r.similarity, r.boundary) for r in near.collect()) == [(1, 2, 0.666667, False), (1, 3, 0.0, True)]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan  # words of both sides, by a pattern in the plan
