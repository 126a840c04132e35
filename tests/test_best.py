"""Searches by blocks: the same hits as by every pair, and k rows a question from each task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import vectors
from tidewell.operators import best, sizes
from tidewell.operators import retrieval as r
from tidewell.plans import operations_queries


def every_pair(queries, chunks, k, metric, exclude_self):
    on = F.size("vec") == F.size("query_vec")
    pairs = chunks.crossJoin(queries).where(on & (F.col("chunk_id") != F.col("query_id")) if exclude_self else on)
    value = F.round(vectors.cosine(F.col("vec"), F.col("query_vec")) if metric == "cosine" else vectors.squared_l2(F.col("vec"), F.col("query_vec")), 6)
    order = F.desc("value") if metric == "cosine" else F.asc("value")
    hits = pairs.withColumn("value", value).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "chunk_id"))).where(F.col("rank") <= k)
    return sorted(repr((x.query_id, x.chunk_id, x.tag, x.more, x.value, x["rank"])) for x in hits.collect())


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(5)
    rows = [[float(x) for x in rng.integers(-4, 5, 3) / 2**9] for _ in range(120)] + [[float(x) for x in rng.normal(size=3)] for _ in range(120)]
    rows += [rows[3]] * 9 + [[0.0, 0.0, 0.0]] * 2 + [[1e-170, 0.0, 1e-170], [1e160, 1.0, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, None, 0.0], None, [], [1.0, 2.0], [1e8, 1e8 + 1e-4, 3.0]]
    return [(i, v, f"t{i % 3}") for i, v in enumerate(rows)]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_the_same_hits_as_by_every_pair(spark, odd, metric, exclude_self):
    for form in ("bigint", "string"):
        chunks = spark.createDataFrame(odd, "chunk_id long, vec array<double>, tag string").withColumn("chunk_id", F.col("chunk_id").cast(form)).repartition(3)
        queries = chunks.where((F.col("chunk_id").cast("long") % 6 == 0) | (F.col("chunk_id").cast("long") > 238)).select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("query_vec"), F.concat(F.lit("m"), "chunk_id").alias("more"))
        want = every_pair(queries, chunks, 4, metric, exclude_self)
        for most in (10_000, 7):
            got = r.knn(queries, chunks, 4, metric=metric, exclude_self=exclude_self, most=most)
            assert sorted(repr((x.query_id, x.chunk_id, x.tag, x.more, x["score" if metric == "cosine" else "distance"], x["rank"])) for x in got.collect()) == want, (form, most)


def test_a_task_gives_k_rows_a_question():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(5_000, 8)), np.tile(rng.normal(size=(1, 8)), (5_000, 1))])
    batches = [pa.RecordBatch.from_pydict({"chunk_id": np.arange(i, i + 2_500), "vec": [list(v) for v in x[i:i + 2_500]]}) for i in range(0, len(x), 2_500)]
    questions = pa.array([list(x[0]), list(x[-1])])
    out = pa.Table.from_batches(best.Nearest(questions, None, 5, "l2", 6, ["chunk_id"])(iter(batches)))
    assert sorted(zip(out["_q"].to_pylist(), out["chunk_id"].to_pylist()))[-5:] == [(1, i) for i in range(5_000, 5_005)] and len(out) == 10


def test_a_threshold_holds_from_the_first_block(monkeypatch):
    made, x = [], np.random.default_rng(4).normal(size=(3_000, 4))

    class Watched(best.Best):
        def __init__(self, *a):
            super().__init__(*a)
            made.append(self)

    monkeypatch.setattr(best, "Best", Watched)
    batches = [pa.RecordBatch.from_pydict({"chunk_id": np.arange(i, i + 1_000), "vec": [list(v) for v in x[i:i + 1_000]]}) for i in range(0, len(x), 1_000)]
    seen = []
    for metric in ("l2", "cosine"):
        search = best.Nearest(pa.array([list(v) for v in x[:5]]), pa.array(range(5)), 2, metric, 6, ["chunk_id"])
        out = pa.Table.from_batches(search(b for b in batches if seen.append(made[-1].limit.max()) or True))
        assert out.num_rows == 10
    assert np.isinf(seen[0]) and np.isfinite(seen[1:3] + seen[4:]).all()


@pytest.mark.parametrize("far", [0.0, 1e3, 1e16])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vectors_too_close_for_single_precision(metric, far):
    rng = np.random.default_rng(6)
    x = far + rng.normal(size=(5_000, 6)) * max(1.0, far / 1e6)
    x[1_000:1_200] = x[0] + rng.integers(-3, 4, (200, 6)) * 1e-3 * max(1.0, far / 1e6)
    asked = np.arange(0, 5_000, 5)
    batches = [pa.RecordBatch.from_pydict({"chunk_id": np.arange(i, i + 2_500), "vec": [list(v) for v in x[i:i + 2_500]]}) for i in range(0, len(x), 2_500)]
    out = pa.Table.from_batches(best.Nearest(pa.array([list(v) for v in x[asked]]), pa.array(asked), 3, metric, 6, ["chunk_id"])(iter(batches)))
    got = sorted(zip(out["_q"].to_pylist(), out["chunk_id"].to_pylist()))
    way, want = best._cosine if metric == "cosine" else best._squared_l2, []
    for q, i in enumerate(asked):
        value = best.half_up(way(x, np.broadcast_to(x[i], x.shape)), 6)
        value = -value if metric == "cosine" else value
        value[i] = np.inf
        want += [(q, int(c)) for c in np.lexsort((np.arange(len(x)), value))[:3]]
    assert got == sorted(want)


def test_one_large_file_is_spread(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(sizes, "SPREAD_BYTES", 0)  # any file is a large one
    spark.createDataFrame(odd, "chunk_id long, vec array<double>, tag string").coalesce(1).write.parquet(f"{tmp_path}/t")
    chunks = spark.read.parquet(f"{tmp_path}/t")
    found = r.knn(chunks.where("chunk_id < 9").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("query_vec")), chunks, 2)
    assert "RepartitionByExpression" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) or "Repartition " in plan
    assert found.count() == 18


def test_gaps_that_stay_open(spark, tmp_path):
    near = [[float(i % 7), 1.0, 0.0] for i in range(1, 100)]
    rows = [(i, v, 0) for i, v in enumerate(near, 1)] + [(100, [9.0, 9.0, 9.0], 0), (200, [3.5, 1.0, 0.0], 0), (300, None, 0), (400, [9.0, 9.0, 8.0], 0), (500, [50.0, 0.0, 0.0], 0), (600, [1.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(x.position for x in operations_queries.gap_self_heal(spark, str(tmp_path)).collect()) == [300, 500, 600]


def test_no_questions(spark):
    none = spark.createDataFrame([], "query_id long, query_vec array<double>")
    assert r.knn(none, spark.createDataFrame([(1, [1.0])], "chunk_id long, vec array<double>"), 3).count() == 0


def test_rounding_is_spark_s(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(0, 1 << 20, 2000) / 2**9, rng.integers(0, 10**7, 2000) / 1e7, [2.675e-4, 1.0000005, -0.0078125, 1e15 + 0.3, 1e22, np.inf]])
    want = [v.r for v in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", F.round("x", 6).alias("r")).orderBy("i").collect()]
    assert list(best.half_up(x, 6)) == want


def texts(spark, n):
    rng = np.random.default_rng(3)
    words = np.array(["the", "of", "and", *(f"w{i}" for i in range(400))])
    return spark.createDataFrame([(i, " ".join(words[np.minimum(rng.exponential(40, 30).astype(int), 402)]) if i % 9 else None) for i in range(n)], "chunk_id long, text string").repartition(3)


def test_blocks_of_questions_and_texts_give_the_same_hits(spark, tmp_path, monkeypatch):
    chunks = texts(spark, 700)
    index = r.write_keyword_index(chunks, f"file://{tmp_path}/i", buckets=4)
    asked = chunks.where("chunk_id % 10 = 1").select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query_text"))
    hits = lambda: sorted((x.query_id, x.chunk_id, x.bm25_rank, round(x.bm25_score, 5)) for x in r.bm25(asked, index, 6).collect())
    want = hits()
    every = index.postings.join(asked.select("query_id", F.explode(r.tokens(F.col("query_text"))).alias("term")), "term").join(index.terms.select("term", "idf"), "term").crossJoin(index.totals)
    score = F.round(F.sum(F.col("idf") * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))), 6)
    plain = r.top(every.groupBy("query_id", "chunk_id").agg(score.alias("s")).where("s > 0"), F.desc("s"), 6).collect()
    assert want == sorted((x.query_id, x.chunk_id, x["rank"], round(x.s, 5)) for x in plain) and len(want) > 300
    monkeypatch.setattr(r, "ASKED_ROWS", 200)
    assert hits() == want


def test_a_task_gives_k_texts_a_question(spark, tmp_path, monkeypatch):
    index = r.write_keyword_index(texts(spark, 700), f"file://{tmp_path}/i")
    batches = index.texts.toArrow().to_batches(100)
    asked = pa.table({"query_id": [1, 1, 2, 2], "term": ["the", "w0", "of", "w9"], "qtf": [1, 2, 1, 1], "idf": [0.5, 1.0, 0.25, 2.0]})
    out = [sorted(map(repr, pa.Table.from_batches(best.Scored(asked, 4, 1.5, 0.75, 30.0, 6)(iter(batches))).to_pylist()))]
    assert len(out[0]) == 8
    monkeypatch.setattr(best, "CELLS", 20)  # a few texts a block
    monkeypatch.setattr(best, "MOST_DENSE", 1)
    again = pa.Table.from_batches(best.Scored(asked, 4, 1.5, 0.75, 30.0, 6)(iter(batches))).to_pylist()
    assert sorted((x["query_id"], x["chunk_id"], round(x["bm25_score"], 9)) for x in again) == sorted((y["query_id"], y["chunk_id"], round(y["bm25_score"], 9)) for y in map(eval, out[0]))
