"""Interactions, insights, histories, accounts and tenants as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.config import DEFAULT, EngineConfig
from tidewell.functions import messages as m


def weak_flags(turns: DataFrame) -> DataFrame:
    """``turns(no_kb_match, escalated, emotion, intensity, feedback, ...)`` with ``weak_reason`` and ``is_weak``.

    No match comes before escalation, that before a negative mood of intensity 3 or more; a later
    thumbs down makes a turn weak if nothing else did, and a thumbs up doesn't undo it.
    """
    reason = F.when(F.col("no_kb_match"), "no_kb_match").when(F.col("escalated"), "escalated") \
        .when(F.col("emotion").isin("angry", "frustrated") & (F.coalesce("intensity", F.lit(0)) >= 3), "negative_emotion").when(F.col("feedback") == "down", "thumbs_down")
    return turns.withColumn("weak_reason", reason).withColumn("is_weak", F.col("weak_reason").isNotNull())


def newest(turns: DataFrame, n: int) -> DataFrame:
    """Each tenant's ``n`` newest turns by ``created_at``, ties by larger id."""
    order = Window.partitionBy("client_slug").orderBy(F.desc("created_at"), F.desc("id"))
    return turns.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= n)


def insights(turns: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Counts and rates of each tenant's newest turns; satisfaction is null without feedback."""
    t = weak_flags(newest(turns, config.insight_rows))
    up, down, n = F.count_if(F.col("feedback") == "up"), F.count_if(F.col("feedback") == "down"), F.count(F.lit(1))
    sessions = F.count_distinct(F.nullif(F.col("session_id").cast("string"), F.lit("")))
    escalated = F.count_if("escalated")
    return t.groupBy("client_slug").agg(
        F.when(sessions > 0, sessions).otherwise(n).alias("total_conversations"), n.alias("total_turns"), F.round((n - escalated) / n, 3).alias("deflection_rate"),
        F.round(escalated / n, 3).alias("escalation_rate"), F.round(up / F.nullif(up + down, F.lit(0)), 3).alias("satisfaction_rate"), up.alias("thumbs_up"), down.alias("thumbs_down"),
        F.count_if("is_weak").alias("weak_count"))


def emotion_breakdown(turns: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    return newest(turns, config.insight_rows).groupBy("client_slug", F.coalesce("emotion", F.lit("neutral")).alias("emotion")).agg(F.count(F.lit(1)).alias("n"))


def top_questions(turns: DataFrame, most: int = 10, config: EngineConfig = DEFAULT) -> DataFrame:
    """Each tenant's commonest questions, trimmed and lower-cased; ties by the newer one; blank ones go after the cut."""
    asked = newest(turns, config.insight_rows).where(F.coalesce("user_message", F.lit("")) != "").withColumn("question", F.lower(F.regexp_replace("user_message", r"^\s+|\s+$", "")))
    n = asked.groupBy("client_slug", "question").agg(F.count(F.lit(1)).alias("n"), F.min("recency").alias("first"))
    rank = F.row_number().over(Window.partitionBy("client_slug").orderBy(F.desc("n"), "first"))
    return n.withColumn("rank", rank).where(F.col("rank") <= most).where("question <> ''").drop("first")


def fold_feedback(turns: DataFrame, ratings: DataFrame) -> DataFrame:
    """``ratings(turn_id, seq, rating)`` onto turns: the last rating counts, any "down" leaves its mark."""
    folded = ratings.groupBy("turn_id").agg(F.max_by("rating", "seq").alias("rating"), F.max(F.col("rating") == "down").alias("ever_down"))
    joined = turns.join(folded, turns["id"] == folded["turn_id"], "left")
    reason = F.coalesce("weak_reason", F.when(F.col("ever_down"), "thumbs_down"))
    return joined.withColumns({"feedback": F.coalesce("rating", "feedback"), "weak_reason": reason, "is_weak": reason.isNotNull()}).drop("turn_id", "rating", "ever_down")


def last_messages(turns: DataFrame, n: int, *, per: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each conversation's last ``n`` messages, numbered backwards from 1."""
    return turns.withColumn("back", F.row_number().over(Window.partitionBy(per).orderBy(F.desc(order)))).where(F.col("back") <= n)


def transcript(turns: DataFrame, n: int = 8) -> DataFrame:
    """``(conv_id, transcript)`` of the last ``n`` messages as ``role: text`` lines."""
    part = last_messages(turns, n).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("line")))).alias("lines"))
    return part.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("transcript"))


def match_accounts(asked: DataFrame, accounts: DataFrame) -> DataFrame:
    """``asked(ask_id, client_slug, asked_for)`` to ``accounts(account_id, client_slug, identifier)`` of the same tenant.

    The trimmed lower-case identifier first, else equal digits if there are six or more; smallest id.
    """
    key = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")
    a = asked.select("ask_id", F.col("client_slug").alias("slug"), key(F.col("asked_for")).alias("k"), digits(F.col("asked_for")).alias("dg")).where("k <> ''")
    b = accounts.select("account_id", "client_slug", key(F.col("identifier")).alias("bk"), digits(F.col("identifier")).alias("bd"))
    exact = a.join(b, (F.col("slug") == F.col("client_slug")) & (F.col("k") == F.col("bk"))).select("ask_id", "account_id", F.lit(1).alias("way"))
    loose = a.where(F.char_length("dg") >= 6).join(b, (F.col("slug") == F.col("client_slug")) & (F.col("dg") == F.col("bd"))).select("ask_id", "account_id", F.lit(2).alias("way"))
    return exact.unionByName(loose).groupBy("ask_id").agg(F.min(F.struct("way", "account_id")).alias("hit")).select("ask_id", "hit.account_id", "hit.way")


def with_references(actions: DataFrame) -> DataFrame:
    """``reference`` by kind and number."""
    prefix = F.when(F.col("kind") == "ticket", "TKT").when(F.col("kind") == "callback", "CB").when(F.col("kind") == "account_change", "CHG")
    return actions.withColumn("reference", F.concat(prefix, F.lit("-"), (F.col("id") + 1000).cast("string")))


def find_by_reference(asked: DataFrame, actions: DataFrame) -> DataFrame:
    """``asked(ask_id, client_slug, text)`` to the same tenant's ``actions(id, client_slug, reference, ...)`` whose reference has the same letters and digits; of several the first id."""
    a = asked.select("ask_id", F.col("client_slug").alias("_slug"), m.reference_key(F.col("text")).alias("_k")).where("_k <> ''")
    known = actions.select(m.reference_key(F.col("reference")).alias("_rk"), F.struct("id", *(c for c in actions.columns if c != "id")).alias("_row"))
    first = known.groupBy(F.col("_row.client_slug").alias("_of"), "_rk").agg(F.min_by("_row", "_row.id").alias("_row"))
    return a.join(first, (F.col("_slug") == F.col("_of")) & (F.col("_k") == F.col("_rk"))).select("ask_id", "_row.*")


# ---- tables of tenants, documents, escalations: copy-on-write forms


def update_rows(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``changes`` values that aren't null replace those of ``rows``; keys that rows lack are ignored."""
    new = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(new, rows[key] == new["_key"], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop("_key", *(f"_{c}" for c in columns))


def delete_rows(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """True deletion: text, metadata and vector go together."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def missing_rows(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """What is found but not yet known: tenants on disk without a row, frontier pages not visited."""
    return found.select(key).distinct().join(known.select(key), key, "left_anti")


def counts_per(owner: DataFrame, items: DataFrame, key: str, name: str) -> DataFrame:
    """Every owner with the number of its items, 0 included, in one grouping."""
    n = items.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return owner.join(n, owner[key] == n["_key"], "left").withColumn(name, F.coalesce("_n", F.lit(0).cast("long"))).drop("_key", "_n")


def page_of(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def numbered(rows: DataFrame, order: list[Column | str], run: Column) -> DataFrame:
    """``rows`` with ``nth``, from 1 in ``order``.  ``run`` must grow with the order: rows are counted by run, and only the runs' totals meet in one task."""
    rows = rows.withColumn("_run", run)
    counts = rows.groupBy(F.col("_run").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_r", "_before")
    within = F.row_number().over(Window.partitionBy("_run").orderBy(*order))
    return rows.withColumn("_in", within).join(before, F.col("_run").eqNullSafe(F.col("_r"))).withColumn("nth", F.col("_before") + F.col("_in")).drop("_run", "_r", "_before", "_in")


def append_numbered(collection: DataFrame, added: DataFrame, order: list[Column], run: Column) -> DataFrame:
    """``added`` below ``collection(chunk_id, ...)``: rows without id get ``doc_<position>``, counted on from the collection's size; ``run`` as for ``numbered``."""
    had = collection.agg(F.count(F.lit(1)).alias("_had"))
    placed = numbered(added, order, run).crossJoin(F.broadcast(had))
    named = placed.withColumn("chunk_id", F.coalesce("chunk_id", F.concat(F.lit("doc_"), F.col("_had") + F.col("nth") - 1))).drop("_had", "nth")
    return collection.unionByName(named, allowMissingColumns=True)
