"""Vectors that many rows hold: of one task's batch only the rows that can be hits meet the questions, and the hits stay those of every pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from tests.test_best import every_pair
from tidewell.operators import best
from tidewell.operators import retrieval as r


def batches(x):
    ids = np.random.default_rng(2).permutation(len(x))
    return [pa.RecordBatch.from_pydict({"chunk_id": ids[i:i + 2_000], "vec": [list(v) for v in x[i:i + 2_000]]}) for i in range(0, len(x), 2_000)]


@pytest.mark.parametrize("common", ["same", "null", "nan"])
@pytest.mark.parametrize("own", [False, True])
def test_copies_are_not_valued_one_by_one(monkeypatch, common, own):
    x = np.random.default_rng(1).normal(size=(8_000, 8)).astype(object)
    x[2_000:, 0] = {"same": x[0, 0], "null": None, "nan": float("nan")}[common]
    if common == "same":
        x[2_000:] = x[0]
    asked, seen, add = x[np.r_[:20, 2_000:2_200]] if common == "same" else x[:220], [], best.Best.add
    monkeypatch.setattr(best.Best, "add", lambda self, question, *a: seen.append(len(question)) or add(self, question, *a))
    ids = pa.array(range(220)) if own else None
    out = pa.Table.from_batches(best.Nearest(pa.array([list(v) for v in asked]), ids, 5, "l2", 6, ["chunk_id"])(iter(batches(x))))
    assert len(out) == 220 * 5 and sum(seen) < 60 * len(asked)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("own", [False, True])
def test_the_same_hits_among_copies(spark, metric, own):
    nan = float("nan")
    made = [[0.5, 1.0, 2.0], [0.5, 1.0, None], [0.5, None, nan], [nan, 1.0, 2.0], [1.0, nan, 0.0], [0.0, 0.0, 0.0], [-0.0, 0.0, 0.0], [float("inf"), 1.0, 0.0], [1.0], []]
    rows = [((i * 37) % 200, made[i % len(made)], f"t{i % 3}") for i in range(200)]
    rows += [(i, [0.5, 1.0, 2.0 + i / 64], "t0") for i in range(200, 215)] + [(None, v, "t1") for v in made[:4]] * (own or 0)
    rows += [(3, [0.25, 1.0, 2.0], "t9"), (3, [0.25, 1.0, 2.0], "t9")]  # an id twice
    for form in ("bigint", "string"):
        chunks = spark.createDataFrame(rows, "chunk_id long, vec array<double>, tag string").withColumn("chunk_id", F.col("chunk_id").cast(form)).coalesce(1)
        queries = chunks.where("cast(chunk_id as long) % 7 = 0 or cast(chunk_id as long) > 212").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("query_vec"), F.concat(F.lit("m"), "chunk_id").alias("more"))
        want = every_pair(queries, chunks, 4, metric, own)
        got = r.knn(queries, chunks, 4, metric=metric, exclude_self=own)
        assert sorted(repr((x.query_id, x.chunk_id, x.tag, x.more, x["score" if metric == "cosine" else "distance"], x["rank"])) for x in got.collect()) == want, form
