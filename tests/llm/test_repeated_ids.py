"""The near-duplicate stage on repeated and missing ids."""

from __future__ import annotations

import corpus_pipeline


def test_one_row_of_each_class_stays(spark, sf):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(5, a), (5, a), (3, b), (7, b), (7, c), (None, c + " more"), (None, d), (None, d), (9, "..."), (2, a + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.without_near_copies(spark, docs, sf).collect()), key=str)
    assert got == sorted([(2, a + " more"), (3, b), (7, c), (None, d), (9, "...")], key=str)


def test_single_ids_keep_the_smallest(spark, sf):
    a = " ".join(f"a{i}" for i in range(40))
    docs = spark.createDataFrame([(4, a), (1, a + " more"), (8, "other words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, sf).collect()) == [1, 8]
