"""Approximate nearest neighbours by cosine: stable projections, kd-tree, chi-square stop (operator 1)."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import staged

#: Dimensions of the projection (even), and the level of the stopping test.
PROJECTED, CONFIDENCE = 10, 0.97
#: The upper kd-tree is fitted on this many projected vectors at most; its cells hold about CELL_ROWS, and there are MOST_CELLS at most.
SAMPLE, CELL_ROWS, MOST_CELLS = 1 << 16, 4096, 4096
#: Vectors of a leaf of a cell's own kd-tree; queries that share a copy of a cell.
LEAF_ROWS, QUERY_BLOCK = 128, 20_000
#: Points that are verified before the test is made again; from there on the steps double.
STEP = 32
SEED = 20_240_601


def chi2_cdf(x: float, m: int) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def chi2_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, m) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, m) < p else (low, mid)
    return high


def projection(dim: int, m: int, seed: int = SEED) -> np.ndarray:
    """Gaussian entries: a projected squared distance over the true one is chi-square with ``m`` degrees of freedom."""
    return np.random.default_rng(seed).standard_normal((dim, m))


class Tree:
    """A kd-tree: splits at medians of the widest dimension; leaves in order, with the boxes of their points' half-spaces."""

    def __init__(self, points: np.ndarray, leaf_rows: int, most_leaves: int = 1 << 30):
        m = points.shape[1]
        self.splits: list[tuple[int, float, int, int]] = []  # dimension, value, left, right; a negative child is leaf -1-child
        self.leaves: list[np.ndarray] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        depth = max(0, min(math.ceil(math.log2(max(1, len(points) / leaf_rows))), int(math.log2(most_leaves))))
        self.root = self._build(points, np.arange(len(points)), np.full(m, -np.inf), np.full(m, np.inf), depth)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, points, rows, low, high, depth) -> int:
        part = points[rows]
        if depth and len(rows) > 1:
            dim = int(np.argmax(part.max(0) - part.min(0)))
            value = float(np.median(part[:, dim]))
            left = part[:, dim] < value
            if left.any() and not left.all():
                at = len(self.splits)
                self.splits.append((dim, value, 0, 0))
                under, over = high.copy(), low.copy()
                under[dim] = over[dim] = value
                a = self._build(points, rows[left], low, under, depth - 1)
                b = self._build(points, rows[~left], over, high, depth - 1)
                self.splits[at] = dim, value, a, b
                return at
        self.leaves.append(rows)
        self.low.append(low)
        self.high.append(high)
        return -len(self.leaves)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            dim, value, a, b = self.splits[node]
            left = points[rows, dim] < value
            todo += [(a, rows[left]), (b, rows[~left])]
        return out

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Least squared distance of each point to each leaf's box."""
        gap = np.maximum(self.low[None] - points[:, None], 0) + np.maximum(points[:, None] - self.high[None], 0)
        return (gap * gap).sum(2)


def search_cell(vectors: np.ndarray, projected: np.ndarray, queries: np.ndarray, query_projected: np.ndarray, radius2: np.ndarray, k: int, stop: float):
    """For each query the ``k`` nearest of a cell, and how many vectors were verified for it.

    ``vectors`` and ``queries`` have unit length.  The kd-tree gives the cell's points one after
    another by growing projected distance: a leaf is opened when its box is the next nearest, and a
    point is due once no unopened box is nearer.  Due points are verified by true distance until the
    next one's makes a nearer vector improbable: projected² > stop x radius², ``stop`` a chi-square
    quantile and ``radius2`` the squared distance of the k-th neighbour known so far.
    """
    tree = Tree(projected, LEAF_ROWS)
    lows = [projected[rows] for rows in tree.leaves]
    for start in range(0, len(queries), 256):
        gaps = tree.distances(query_projected[start:start + 256])
        for i, gap in enumerate(gaps, start):
            best_d, best_at, radius, verified = np.zeros(0), np.zeros(0, np.int64), float(radius2[i]), 0
            wait_d, wait_at = np.zeros(0), np.zeros(0, np.int64)  # opened, not yet due
            order = np.argsort(gap, kind="stable")
            bounds = np.append(gap[order[1:]], np.inf)
            for leaf, near, bound in zip(order.tolist(), gap[order].tolist(), bounds.tolist(), strict=True):
                if min(near, wait_d.min(initial=np.inf)) > stop * radius:
                    break
                away = lows[leaf] - query_projected[i]
                wait_d, wait_at = np.concatenate([wait_d, (away * away).sum(1)]), np.concatenate([wait_at, tree.leaves[leaf]])
                due = wait_d <= bound
                if not due.any():
                    continue
                now_d, now_at = wait_d[due], wait_at[due]
                wait_d, wait_at = wait_d[~due], wait_at[~due]
                by_distance = np.argsort(now_d, kind="stable")
                now_d, now_at = now_d[by_distance], now_at[by_distance]
                at, step = 0, STEP
                while at < len(now_d) and now_d[at] <= stop * radius:
                    rows = now_at[at:at + step][now_d[at:at + step] <= stop * radius]
                    d = 2 - 2 * (vectors[rows] @ queries[i])
                    verified += len(rows)
                    close = d <= radius + 1e-12
                    if close.any():
                        best_d, best_at = np.concatenate([best_d, d[close]]), np.concatenate([best_at, rows[close]])
                        if len(best_d) > k:
                            # equal distances stay, for the ids to decide
                            cut = np.partition(best_d, k - 1)[k - 1] + 1e-12
                            keep = best_d <= cut
                            best_d, best_at, radius = best_d[keep], best_at[keep], min(radius, float(cut))
                    at, step = at + step, 2 * step
            yield i, best_at, verified


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding",
            projected: int = PROJECTED, confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` nearest vectors by cosine of every row that ``is_query`` picks: ``(query_id, rank, vec_id, score)``.

    Unit vectors are projected by a Gaussian matrix to ``projected`` dimensions and indexed by a
    kd-tree in two levels.  The upper tree's planes are fitted on a bounded sample; every vector goes
    into one of its cells.  A query first searches its own cell, which gives a radius, then every
    cell whose box could hold a nearer vector at the test's level.  In a cell a kd-tree of its own
    yields leaves by growing projected distance; their vectors are verified by true distance until
    the chi-square test holds.  Scores are cosines of the original vectors in double precision.

    Equal vectors are one entry of the index that keeps their ``k + 1`` smallest ids: ties go to
    smaller ids, so no query can need more.  That also keeps a vector of a third of all rows from
    heating a cell.  A cell of more than ``2 * cell_rows`` entries is dealt out in parts with kd-trees
    of their own, and one that more than ``query_block`` queries visit meets them in blocks, so no
    task grows with the table, and copies of a cell with its own queries only.

    Null, empty and zero vectors, vectors with null or non-finite components, and null ids take no part.
    Vectors of another length are a space of their own, searched in turn (a few lengths are expected).  An
    empty table gives no rows.  Repeated rows count once.  A query's own id
    is never its neighbour; fewer than ``k`` others give fewer ranks.  Other columns are ignored.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), is_query.alias("asks")).where(
        F.col("id").isNotNull() & (F.size("vec") > 0)
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0))
    lengths = sorted(r.n for r in rows.select(F.size("vec").alias("n")).distinct().collect()) or [1]
    return reduce(DataFrame.unionByName, (_nearest(rows.where(F.size("vec") == n), n, k, projected, confidence, cell_rows, query_block) for n in lengths))


def _nearest(rows: DataFrame, dim: int, k: int, projected: int, confidence: float, cell_rows: int, query_block: int) -> DataFrame:
    """The search among ``rows(id, vec, asks)`` of one length."""
    spark = rows.sparkSession
    rows = rows.select("id", "vec", "asks", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    nth = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id"))
    small = rows.select("h1", "h2", "id", "vec").withColumn("nth", nth).where(F.col("nth") <= k + 1)
    gauss = projection(dim, projected)

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                flat = pa.array((_unit(_matrix(batch.column("vec"))) @ gauss).ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, projected, dtype=np.int32), flat)], names=[*batch.schema.names, "low"])

    entries = small.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.first("vec").alias("vec")) \
        .mapInArrow(project, "h1 long, h2 long, ids array<long>, vec array<double>, low array<double>")
    entries = staged(entries, "ann-entries")
    n = entries.count()
    sample = _matrix(entries.orderBy("h1", "h2").limit(SAMPLE).select("low").toArrow()["low"])  # a bounded sample, at random by hash
    leaves = max(1, min(MOST_CELLS, 1 << max(0, math.ceil(math.log2(max(1, n / cell_rows))))))
    tree = Tree(sample if len(sample) else np.zeros((1, projected)), max(1, math.ceil(max(1, len(sample)) / leaves)), leaves)
    stop = chi2_quantile(confidence, projected)
    shared = spark.sparkContext.broadcast(tree)

    def cell_of(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.leaf_of(_matrix(batch.column("low"))), pa.int32())], names=[*batch.schema.names, "cell"])

    celled = entries.mapInArrow(cell_of, "h1 long, h2 long, ids array<long>, vec array<double>, low array<double>, cell int")
    asking = rows.where("asks").select(F.col("id").alias("query_id"), "h1", "h2").distinct()
    asked = staged(celled.join(asking.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").withColumn("radius2", F.lit(4.0 + 1e-9)), "ann-queries")
    # at most MOST_CELLS rows
    sizes = staged(celled.groupBy(F.col("cell").alias("s_cell")).agg(F.ceil(F.count(F.lit(1)) / (2 * cell_rows)).cast("int").alias("parts")), "ann-cells")

    def visit(points: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(points) and len(queries):
            p, q = _matrix(points["vec"]), _matrix(queries["vec"])
            ids = points["ids"].to_pylist()
            qk = list(zip(queries["h1"].to_pylist(), queries["h2"].to_pylist(), strict=True))
            norms = np.sqrt((p * p).sum(1))
            for i, at, _ in search_cell(_unit(p), _matrix(points["low"]), _unit(q), _matrix(queries["low"]), queries["radius2"].to_numpy(), k + 1, stop):
                if len(at):
                    scores = (p[at] * q[i]).sum(1) / (norms[at] * np.sqrt((q[i] * q[i]).sum()))
                    first = np.array([ids[a][0] for a in at])
                    for j in np.lexsort((first, -scores))[:k + 1]:
                        found.append((*qk[i], ids[at[j]], float(scores[j])))
        h1, h2, who, score = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.table({"h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "ids": pa.array(who, pa.list_(pa.int64())), "score": pa.array(score, pa.float64())})

    def visited(queries: DataFrame) -> DataFrame:
        each = F.broadcast(sizes.join(queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("blocks")), F.col("s_cell") == F.col("cell")).select("s_cell", "parts", "blocks"))
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        mine = celled.join(each, F.col("cell") == F.col("s_cell")).withColumn("part", F.pmod(F.xxhash64("h2"), F.col("parts"))).withColumn("block", numbers("blocks"))
        theirs = queries.join(each, F.col("cell") == F.col("s_cell")).withColumn("block", F.pmod(F.xxhash64("h1"), F.col("blocks"))).withColumn("part", numbers("parts"))
        keys = [F.col("cell"), F.col("part").cast("long").alias("part"), F.col("block").cast("long").alias("block")]
        mine, theirs = mine.select("h1", "h2", "ids", "vec", "low", *keys), theirs.select("h1", "h2", "vec", "low", "radius2", *keys)
        return mine.groupBy("cell", "part", "block").cogroup(theirs.groupBy("cell", "part", "block")).applyInArrow(visit, "h1 long, h2 long, ids array<long>, score double")

    home = staged(visited(asked), "ann-home")
    radius = home.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("score"), asc=False).alias("best")) \
        .select("h1", "h2", F.when(F.size("best") > k, 2 - 2 * F.get("best", F.lit(k)) + 1e-9).otherwise(F.lit(4.0 + 1e-9)).alias("radius2"))

    def cells_to_visit(batches):
        for batch in batches:
            if batch.num_rows:
                gaps = shared.value.distances(_matrix(batch.column("low")))
                go = gaps <= stop * batch.column("radius2").to_numpy()[:, None]
                go[np.arange(len(go)), batch.column("cell").to_numpy()] = False
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([np.flatnonzero(r).astype(np.int32) for r in go], pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    fields = "h1 long, h2 long, vec array<double>, low array<double>, cell int, radius2 double"
    out = asked.select("h1", "h2", "vec", "low", "cell").join(radius, ["h1", "h2"], "left").fillna(4.0 + 1e-9, ["radius2"]) \
        .select("h1", "h2", "vec", "low", "cell", "radius2").mapInArrow(cells_to_visit, fields + ", cells array<int>")
    away = visited(out.select("h1", "h2", "vec", "low", "radius2", F.explode("cells").alias("cell")))

    best = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), F.col("ids")[0]))
    lists = home.unionByName(away).withColumn("nth", best).where(F.col("nth") <= k + 1).select("h1", "h2", F.explode("ids").alias("vec_id"), "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return asking.join(lists, ["h1", "h2"]).where("vec_id <> query_id").withColumn("rank", rank).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
