"""Knowledge gaps: greedy clusters of unanswered questions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.config import DEFAULT
from tidewell.operators.sizes import cut

#: Open questions of a tenant that a round folds, and those that meet its new clusters in one task.
BLOCK, PART = 2048, 20_000
EXAMPLES = 3


def clusters_of(questions: list[str], vectors: np.ndarray, threshold: float) -> list[tuple[str, int, list[str]]]:
    """First fit, in order, by cosine with each cluster's first member; largest first, ties in order.

    The representative is the commonest lower-case phrasing, as first spelt; examples are three distinct spellings.
    """
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(norms == 0, 1, norms)[:, None]
    heads: list[int] = []
    members: list[list[int]] = []
    for i in range(len(questions)):
        alike = np.flatnonzero(unit[heads] @ unit[i] >= threshold) if heads else []
        if len(alike):
            members[alike[0]].append(i)
        else:
            heads.append(i)
            members.append([i])
    out = []
    for group in members:
        said = [questions[i] for i in group]
        low = [q.lower() for q in said]
        common = max(dict.fromkeys(low), key=low.count)
        out.append((said[low.index(common)], len(said), list(dict.fromkeys(said))[:3]))
    return sorted(out, key=lambda g: -g[1])


def gap_clusters(questions: DataFrame, threshold: float = DEFAULT.gap_similarity, *, block: int = BLOCK, part: int = PART) -> DataFrame:
    """``questions(client_slug, recency_key, question, vec)``, newest (largest key) first, to ``(client_slug, position, representative, n, examples)``.

    First fit, as ``clusters_of`` folds it, for tenants of any size: a round takes each tenant's next ``block`` questions
    and folds them in one task; the clusters they open are then met by all the tenant's other open questions, in parts of ``part``,
    and what is alike joins the first of them.  So the next questions are alike to none so far, and every round's
    result is final.  A task holds ``block`` or ``part`` vectors, and one tenant spreads over as many tasks as it has parts.

    Ties of ``recency_key`` go by the question, then by chance.  Null and zero vectors are alike to nothing, shorter ones count as filled up with zeros.
    Null questions count as empty.  An empty table gives no rows.
    """
    rows = cut(questions.select("client_slug", "recency_key", F.coalesce("question", F.lit("")).alias("question"), F.col("vec").cast("array<double>").alias("vec")).withColumn("row_id", F.monotonically_increasing_id()))
    order = Window.partitionBy("client_slug").orderBy(F.desc("recency_key"), "question", "row_id")
    fields = "row_id long, leader long"
    left, found = rows, []

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth")
        ids = pdf["row_id"].to_numpy()
        heads = first_fit(_units(pdf["vec"]), threshold)
        return pd.DataFrame({"row_id": ids, "leader": ids[heads]})

    def meet(key: tuple, some: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        leaders = leaders.sort_values("nth")
        width = max([1, *(len(v) for v in [*some["vec"], *leaders["vec"]] if v is not None)])
        alike = _units(some["vec"], width) @ _units(leaders["vec"], width).T >= threshold
        first = alike.argmax(axis=1)
        return pd.DataFrame({"row_id": some["row_id"], "leader": pd.array(np.where(alike.any(axis=1), leaders["row_id"].to_numpy()[first], -1), "Int64")})

    while True:
        heads = cut(left.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= block))
        led = cut(heads.groupBy("client_slug").applyInPandas(fold, fields))
        found.append(led)
        rest = cut(left.join(heads.select("row_id"), "row_id", "left_anti"))
        if rest.isEmpty():
            break
        opened = heads.join(led.where("row_id = leader").select("row_id"), "row_id", "left_semi").select("client_slug", "row_id", "nth", "vec")
        parts = rest.groupBy(F.col("client_slug").alias("p_slug")).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
        mine = rest.join(parts, F.col("client_slug").eqNullSafe(F.col("p_slug"))).select("client_slug", "row_id", "vec", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int").alias("part"))
        theirs = opened.join(parts, F.col("client_slug").eqNullSafe(F.col("p_slug"))).select(*(F.col(c).alias(c) for c in ("client_slug", "row_id", "nth", "vec")), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        met = cut(mine.groupBy("client_slug", "part").cogroup(theirs.groupBy("client_slug", "part")).applyInPandas(meet, fields))
        found.append(met.where("leader >= 0"))
        left = cut(rest.join(met.where("leader < 0").select("row_id"), "row_id", "left_semi"))
        if left.isEmpty():
            break
    return summarised(rows, reduce(DataFrame.unionByName, found))


def summarised(rows: DataFrame, led: DataFrame) -> DataFrame:
    """Clusters of ``rows(client_slug, recency_key, question, row_id)`` by ``led(row_id, leader)``: largest first, then in order of their first questions."""
    at = F.struct((-F.col("recency_key")).alias("k"), "question", "row_id")
    members = rows.withColumn("at", at).join(led, "row_id").select("client_slug", "leader", "question", "at")
    spelt = members.groupBy("client_slug", "leader", "question").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    said = spelt.groupBy("client_slug", "leader", F.lower("question").alias("low")).agg(F.sum("n").alias("n"), F.min_by("question", "at").alias("question"), F.min("at").alias("at"))
    nth = F.row_number().over(Window.partitionBy("leader").orderBy("at"))
    examples = spelt.withColumn("nth", nth).where(F.col("nth") <= EXAMPLES).groupBy(F.col("leader").alias("e_leader")).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "question"))), lambda x: x["question"]).alias("examples"))
    commonest = F.min_by("question", F.struct((-F.col("n")).alias("m"), "at"))
    clusters = said.groupBy("client_slug", "leader").agg(commonest.alias("representative"), F.sum("n").cast("int").alias("n"), F.min("at").alias("at")).join(examples, F.col("leader") == F.col("e_leader"))
    position = F.row_number().over(Window.partitionBy("client_slug").orderBy(F.desc("n"), "at")) - 1
    return clusters.select("client_slug", position.alias("position"), "representative", "n", "examples")


def _units(vectors: pd.Series, width: int | None = None) -> np.ndarray:
    """Rows of length one; null and zero vectors are zero."""
    width = width or max([1, *(len(v) for v in vectors if v is not None)])
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        if v is not None:
            row[:len(v)] = np.nan_to_num(np.array(v, np.float64))
    norms = np.linalg.norm(out, axis=1)
    return out / np.where(norms == 0, 1, norms)[:, None]


def first_fit(unit: np.ndarray, threshold: float) -> np.ndarray:
    """Of each row, in order, the first row that opened a cluster and is alike; rows alike to none open one."""
    n = len(unit)
    leader, open_rows = np.full(n, -1), 0
    heads = np.empty_like(unit)
    of = np.empty(n, np.int64)
    for i in range(n):
        alike = np.flatnonzero(heads[:open_rows] @ unit[i] >= threshold)
        if len(alike):
            leader[i] = of[alike[0]]
        else:
            heads[open_rows], of[open_rows] = unit[i], i
            leader[i], open_rows = i, open_rows + 1
    return leader
