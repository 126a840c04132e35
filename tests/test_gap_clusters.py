"""Clusters of open questions in rounds of any size against the fold over all of them."""

from __future__ import annotations

import numpy as np

from tidewell.operators import learning
from tidewell.plans import json_queries


def brute(rows, threshold):
    """Tenant by tenant, in order, all in one place."""
    out = []
    for slug in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == slug), key=lambda r: (-r[1], r[2]))
        width = max(len(r[3]) for r in mine if r[3] is not None)
        vectors = np.array([(r[3] or []) + [0.0] * (width - len(r[3] or [])) for r in mine])
        out += [(slug, i, *g) for i, g in enumerate(learning.clusters_of([r[2] for r in mine], vectors, threshold))]
    return out


def found(df):
    return sorted((r.client_slug, r.position, r.representative, r.n, list(r.examples)) for r in df.collect())


def test_rounds_equal_the_fold(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6))
    rows = [(f"t{int(rng.integers(0, 3) ** 2 // 2)}", k, ["How much", "how MUCH", "Why", "When is it"][int(rng.integers(0, 4))], (centres[int(rng.integers(0, 12))] + rng.normal(size=6) * 0.5).tolist()) for k in range(260)]
    rows += [("t0", 1000, "null", None), ("t0", 1001, "zero", [0.0] * 6), ("t0", 1002, "short", [1.0])]
    df = spark.createDataFrame(rows, "client_slug string, recency_key long, question string, vec array<double>")
    want = brute(rows, 0.8)
    assert len(want) > 30
    for block, part in ((5, 7), (40, 1000), (2048, 20_000)):
        assert found(learning.gap_clusters(df, 0.8, block=block, part=part)) == sorted(want)
    assert learning.gap_clusters(df.limit(0), 0.8).count() == 0


def test_the_registered_query(spark, sf):
    rows = [(f"t{r.vec_id % 8}", r.vec_id, f"Question {r.label}", list(map(float, r.embedding))) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted((r.client_slug, r.position, r.representative, r.n) for r in json_queries.gap_clusters(spark, sf).collect())
    assert got == sorted(x[:4] for x in brute(rows, 0.3))
