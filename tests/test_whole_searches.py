"""Searches over the whole query set, every id divisible by 100, against brute force; and query sets too large for a broadcast."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from tidewell.operators import retrieval as r
from tidewell.plans import retrieval_queries as q


@pytest.fixture(scope="module")
def vectors(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    return np.array([x.vec_id for x in rows]), np.array([x.embedding for x in rows], np.float64), np.array([x.label for x in rows])


def near(vectors, query, k, among=None):
    ids, x, _ = vectors
    d = ((x - x[ids == query][0]) ** 2).sum(1).round(6)
    among = np.ones(len(ids), bool) if among is None else among
    return [int(i) for i in ids[among][np.lexsort((ids[among], d[among]))][:k]]


def by_query(df, order="rank"):
    got = {}
    for x in sorted(df.collect(), key=lambda x: (x.query_id, x[order])):
        got.setdefault(x.query_id, []).append(x.chunk_id)
    return got


def whole(name):
    return q.QUERIES[f"{name}_whole"][0]


def test_every_hundredth_vector_is_asked(spark, sf, vectors):
    ids, _, labels = vectors
    asked = [int(i) for i in ids if i % 100 == 0]
    assert len(asked) > 1
    assert by_query(whole("vector_topk_l2")(spark, sf)) == {i: near(vectors, i, 10) for i in asked}
    assert by_query(whole("metadata_filtered_topk")(spark, sf)) == {i: near(vectors, i, 5, labels == 3) for i in asked}
    for name in ("vector_topk_cosine", "vector_topk_multi_query", "similarity_display", "minmax_normalize", "confidence_score", "relevance_labels", "citations", "parent_swap", "distance_gate"):
        assert {x.query_id for x in whole(name)(spark, sf).select("query_id").distinct().collect()} == set(asked), name
    best = {x.query_id: x.distance for x in r.knn(q._asked(spark, sf, None), q._vectors(spark, sf), 1, exclude_self=True).collect()}
    assert {x.query_id for x in whole("hard_gate")(spark, sf).collect()} == {i for i in asked if best[i] <= 1.55}
    assert {x.query_id for x in whole("multi_query_rrf")(spark, sf).collect()} == {int(i) // 3 for i in ids if i // 3 % 100 == 0}


def test_whole_texts_are_asked(spark, sf):
    docs = {x.doc_id: re.findall(r"\w+", (x.text or "").lower()) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for words in docs.values() for t in set(words))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: low if x < 0 else x for t, x in raw.items()}
    counts = {k: Counter(words) for k, words in docs.items()}
    got = {(x.query_id, x.chunk_id): x.bm25_score for x in whole("bm25_topk")(spark, sf).collect()}
    asked = [k for k in docs if k % 100 == 0]
    assert len(asked) > 1 and max(len(set(docs[k])) for k in asked) > 8
    for k in asked:
        want = {c: sum(m * idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(docs[c]) / mean)) for t, m in counts[k].items()) for c, tf in counts.items()}
        mine = {c: s for (a, c), s in got.items() if a == k}
        assert len(mine) == min(20, sum(s > 0 for s in want.values()))
        assert all(abs(s - want[c]) < 1e-3 for c, s in mine.items()) and min(mine.values()) >= sorted(want.values())[-len(mine)] - 1e-3
    vectors_asked = {x.query_id for x in q._asked(spark, sf, None).collect()}
    for name, want in (("weighted_rrf_fusion", vectors_asked | set(asked)), ("hybrid_topk", set(asked))):
        assert {x.query_id for x in whole(name)(spark, sf).collect()} == want, name


def test_large_query_sets_meet_the_chunks_in_blocks(spark, sf, vectors):
    asked = q._asked(spark, sf, 40)
    many = r.knn(asked, q._vectors(spark, sf), 5, most=7)
    assert "_block" in many._jdf.queryExecution().optimizedPlan().toString()
    assert by_query(many) == {i: near(vectors, i, 5) for i in range(40)}


def test_many_terms_give_the_same_scores(spark, sf, monkeypatch):
    want = {tuple(x) for x in whole("bm25_topk")(spark, sf).collect()}
    monkeypatch.setattr(r, "DEFAULT", r.EngineConfig(broadcast_rows=10))
    assert {tuple(x) for x in whole("bm25_topk")(spark, sf).collect()} == want
