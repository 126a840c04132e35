"""Sharding by longest-processing-time scheduling (operator 6)."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import staged, text_or_empty

#: The groups of the most rows get their shard by a broadcast of this many rows; no other group can hold more than 1/HOT_GROUPS of all rows.
HOT_GROUPS = 4096
#: Rows that are numbered in one window partition, about.
RUN_ROWS = 50_000


def deal(loads: np.ndarray, size: int, count: int) -> np.ndarray:
    """How many of ``count`` equal items each shard gets if every one goes to the least-loaded shard (ties: smaller shard).

    A heap of shards gives them out one by one; all items but the last few, fewer than there are
    shards, are given out at once: a shard's j-th item is taken at the load ``loads + j * size``, so
    those below the highest common level that ``count`` items can reach are taken in any case.
    """
    below = lambda level: np.maximum(0, -(-(level - loads) // size))  # noqa: E731  items that a shard takes at loads under the level
    low, high = int(loads.min()), int(loads.max()) + size * (count + 1)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if below(mid).sum() <= count else (low, mid)
    got = below(low)
    heap = [(int(load), shard) for shard, load in enumerate(loads + got * size)]
    heapq.heapify(heap)
    for _ in range(count - int(got.sum())):
        load, shard = heap[0]
        got[shard] += 1
        heapq.heapreplace(heap, (load + size, shard))
    return got


def schedule(classes: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, list[int]]]:
    """``(size, count, cuts)`` for each size class ``(size, count)``, largest first: its groups of rank below ``cuts[0]`` go to shard 0, and so on."""
    loads, out = np.zeros(n_shards, np.int64), []
    for size, count in sorted(classes, reverse=True):
        got = deal(loads, size, count)
        loads += got * size
        out.append((size, count, np.cumsum(got)[:-1].tolist()))
    return out


def lpt_shards(docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, hot_groups: int = HOT_GROUPS, run_rows: int = RUN_ROWS) -> DataFrame:
    """Give every document a shard of nearly equal bytes, equal texts together.

    Returns ``(<id_col>, size, text_crc32, shard, slot)``; ``size`` is the text's UTF-8 bytes plus
    ``overhead`` and ``slot`` numbers a shard's rows from 0 without gaps, in an order fixed by the id.

    The unit of scheduling is a group of equal texts.  Groups are scheduled longest first, each to
    the least-loaded shard, whatever their number: only the sizes and how many groups have each reach
    the driver (``n`` different sizes need ``n²/2`` bytes of text, so a petabyte has 45 million at
    the very most, and usual text lengths a few hundred thousand).  A class of equal groups is dealt
    out at once (``deal``), by the rank of the text's hash.  No group is ever split, so one that is larger
    than a shard's fair part makes its shard larger; longest-first then leaves it alone there.

    Group sums are pre-aggregated before the shuffle, so one group of a third of all rows costs one
    row a task; ranks and slots are counted in runs of ``run_rows`` and summed up.

    Null and empty texts are one group (``overhead`` bytes a row).  Repeated rows are rows of their own and
    get slots of their own.  An empty table gives an empty result.  Other columns are ignored, so
    their names can't clash.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = staged(docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("grp"),
    ), "shard-rows")
    groups = staged(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-groups")

    classes = [(r.bytes, r.n) for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
    plan = spark.createDataFrame([(size, -(-count // run_rows), cuts) for size, count, cuts in schedule(classes, n_shards)], "p_bytes long, runs long, cuts array<long>")
    dealt = groups.join(plan, F.col("bytes") == F.col("p_bytes")).withColumn("run", F.pmod(F.xxhash64("grp"), F.col("runs"))).select("grp", "n", "bytes", "cuts", "run")
    placed = staged(_numbered(dealt, ["bytes"], ["grp"]).select("grp", "n", F.size(F.filter("cuts", lambda c: c <= F.col("nth"))).alias("shard")), "shard-plan")

    hot = F.broadcast(placed.orderBy(F.desc("n"), "grp").limit(hot_groups).select(F.col("grp").alias("hot_grp"), F.col("shard").alias("hot_shard")))  # a bound by construction
    marked = rows.join(hot, F.col("grp") == F.col("hot_grp"), "left")
    rest = placed.join(hot, F.col("grp") == F.col("hot_grp"), "left_anti").select("grp", "shard")
    kept = ["id", "size", "crc", "shard"]
    put = marked.where("hot_shard IS NOT NULL").withColumn("shard", F.col("hot_shard")).select(kept).unionByName(
        marked.where("hot_shard IS NULL").select("id", "size", "crc", "grp").join(rest, "grp").select(kept))
    runs = max(1, -(-rows.count() // (run_rows * n_shards)))
    put = put.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(runs)))
    return _numbered(put, ["shard"], ["id", "crc", "size"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), F.col("nth").alias("slot"))


def _numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``nth``: its number from 0 within ``keys``, by ``run`` and then ``order``; counted in runs, then summed."""
    counts = df.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n_run"))
    before = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n_run").over(before), F.lit(0))).where("base > 0").select(*keys, "run", "base")
    within = Window.partitionBy(*keys, "run").orderBy(*order)
    return df.withColumn("in_run", F.row_number().over(within) - 1).join(bases, [*keys, "run"], "left") \
        .withColumn("nth", (F.coalesce("base", F.lit(0)) + F.col("in_run")).cast("long"))
