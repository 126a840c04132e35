"""An assistant that decides for itself when to search, act or hand over: rounds over all waiting turns at once.

A turn's state is a row.  Every round calls the model once for each batch of waiting turns, answers all their
tool calls by joins, and lets finished turns leave; the loop on the driver is over rounds, never over turns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import messages as m
from tidewell.operators import json_records, service, tickets
from tidewell.operators.sizes import cut, spread

#: Conversations (lists of ``{"role", "text"}``) in, replies out: ``{"text", "calls": [{"name", "args"}]}``, or None where the model fails.
Model = Callable[[list[list[dict]]], list[dict | None]]
#: ``(query_id, client_slug, query_text)`` in, ``(query_id, rank, chunk_id, text)`` out.
Search = Callable[[DataFrame], DataFrame]

ROUNDS, HISTORY, TRANSCRIPT, BATCH = 3, 6, 8, 32
#: Tool calls of one reply have numbers below this.
CALLS = 1000
# fixed values: names of tools, and what is said where nothing else is
SEARCH, ESCALATE = "search_knowledge_base", "escalate_to_human"
RULE = "\n\n---\n\n"
NOTHING_FOUND = "No relevant information was found in the knowledge base for this query."
ESCALATED = "Escalation created — a human agent has been notified and will follow up. Warmly reassure the customer that a human will reach out."
UNKNOWN_TOOL, REPHRASE, CONNECT = "Unknown tool.", "Could you rephrase that?", "Let me connect you with a human agent."
NEEDS_HUMAN, ASKED_FOR_HUMAN, ASKED_SUMMARY = "Customer needs human assistance", "Customer explicitly requested a human agent", "Customer asked to speak with a human. Latest message: "

MESSAGES = "array<struct<role: string, text: string>>"
REPLY = "struct<text: string, calls: array<struct<name: string, args: map<string, string>>>>"


@dataclass(frozen=True)
class Outcome:
    """What a batch of turns leads to."""

    answers: DataFrame  # turn_id, answer, sources, used_retrieval, escalated, no_kb_match, emotion, intensity, rounds
    escalations: DataFrame  # turn_id, client_slug, reason, summary, emotion, intensity, transcript
    requests: DataFrame
    accounts: DataFrame


def replies(conversation: Column, make: Callable[[], Model], batch: int = BATCH) -> Column:
    """The model's replies; it is made once a worker and gets ``batch`` conversations at a time.  A batch that fails is tried row by row; rows that fail give null."""
    @F.pandas_udf(REPLY)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()

        def ask(rows: list[list[dict]]) -> list[dict | None]:
            try:
                return model(rows)
            except Exception:  # a model's failure is an outcome
                return [None] if len(rows) == 1 else [x for row in rows for x in ask([row])]

        for series in batches:
            rows = [[{"role": x["role"], "text": x["text"]} for x in said] for said in series]
            got = [x for k in range(0, len(rows), batch) for x in ask(rows[k:k + batch])]
            yield pd.DataFrame({"text": [None if x is None else str(x.get("text") or "") for x in got],
                                "calls": [None if x is None else [{"name": c.get("name"), "args": {k: None if v is None else str(v) for k, v in (c.get("args") or {}).items()}} for c in x.get("calls") or []] for x in got]})

    return run(conversation)


def _message(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def _or(text: Column, otherwise: str | Column) -> Column:
    return F.coalesce(F.nullif(_trimmed(text), F.lit("")), F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def with_mood(turns: DataFrame, mood: Callable[[Column], Column] | None) -> DataFrame:
    """``turns(message)`` with ``mood``: neutral unless the message is no small talk and shows signs; only then ``mood``, a model's reply, is asked for."""
    neutral = F.struct(F.lit("neutral").alias("emotion"), F.lit(1).alias("intensity"), F.lit(False).alias("wants_human"))
    if mood is None:
        return turns.withColumn("mood", neutral)
    signs = ~m.is_smalltalk(F.col("message")) & m.needs_mood_check(F.col("message"))
    return turns.withColumn("mood", F.when(signs, json_records.mood_reply(mood(F.col("message")))).otherwise(neutral))


def run_turns(turns: DataFrame, accounts: DataFrame, requests: DataFrame, search: Search, make: Callable[[], Model], *, mood: Callable[[Column], Column] | None = None,
              system: str = "", rounds: int = ROUNDS) -> Outcome:
    """Answers of ``turns(turn_id, client_slug, domain, message, history)``; ``history`` holds ``(role, text)`` in order.

    The model sees ``system`` with the mood's directive, the last six messages and the message.  A reply without tool calls is
    the answer.  Calls are answered in their order: ``search_knowledge_base`` by ``search`` (an empty query asks the message itself), ``escalate_to_human`` by a
    record with the transcript, the tenant's actions by ``tickets.executed`` (a round's calls in order of ``turn_id``, over the state that the round before left), any other by a refusal.  After
    ``rounds`` the model has to answer with what it has.  A turn whose model fails gets an answer by one search and one more try without
    tools.  Whoever asks for a human has an escalation, whether the model made one or not.

    ``turn_id`` is a whole number, unique among the turns; nulls in texts count as empty.  An empty table gives no rows.
    """
    spread_turns = with_mood(spread(turns.select("turn_id", "client_slug", "domain", F.coalesce("message", F.lit("")).alias("message"), F.coalesce("history", F.array().cast(MESSAGES)).alias("history"))), mood)
    directive = m.mood_directive(F.col("mood.emotion"), F.col("mood.intensity"), F.col("mood.wants_human"))
    recent = F.filter(F.slice("history", F.greatest(F.size("history") - HISTORY, F.lit(0)) + 1, HISTORY), lambda x: x["role"].isin("user", "assistant"))
    said = F.concat(F.array(_message("system", F.concat(F.lit(system), F.coalesce(directive, F.lit(""))))), recent, F.array(_message("user", F.col("message")))).cast(MESSAGES)
    known = cut(spread_turns)
    state = known.select("turn_id", "client_slug", "domain", "message", said.alias("messages"), F.array().cast("array<struct<chunk_id: string, text: string>>").alias("found"), F.lit(False).alias("searched"), F.lit(False).alias("escalated"))
    done: list[DataFrame] = []
    handed: list[DataFrame] = []
    for k in range(1, rounds + 1):
        asked = cut(state.withColumn("reply", replies(F.col("messages"), make)).withColumn("rounds", F.lit(k)))
        waiting = asked.where(F.size("reply.calls") > 0)
        done.append(asked.where(F.size("reply.calls") == 0).withColumn("answer", _or(F.col("reply.text"), REPHRASE)))
        if not (failed := asked.where("reply.calls IS NULL")).isEmpty():
            done.append(_fallback(failed, search, make))
        if waiting.isEmpty():
            state = None
            break
        calls = waiting.select("turn_id", "client_slug", "domain", "message", F.posexplode("reply.calls").alias("call_no", "call")).select(
            (F.col("turn_id") * CALLS + F.col("call_no")).alias("id"), "turn_id", "client_slug", "domain", "message", "call.name", "call.args")
        calls = cut(_with_kind(calls))
        results = search(calls.where(F.col("name") == SEARCH).select(F.col("id").alias("query_id"), "client_slug", _or(F.col("args")["query"], _trimmed(F.col("message"))).alias("query_text")))
        found = results.groupBy(F.col("query_id").alias("s_id")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("chunk_id"), "text"))).alias("docs"))
        answered = calls.join(found, F.col("id") == F.col("s_id"), "left")
        if (actions := calls.where("kind IS NOT NULL")).isEmpty():
            answered = answered.withColumn("acted", F.lit(None).cast("string"))
        else:
            acted = tickets.executed(actions.select("id", "client_slug", F.col("name").alias("action"), "kind", "args"), accounts, requests)
            answered = answered.join(acted.messages.select(F.col("id").alias("a_id"), F.col("message").alias("acted")), F.col("id") == F.col("a_id"), "left")
            accounts, requests = cut(acted.accounts), cut(acted.requests)
        text = F.when(F.col("name") == SEARCH, F.coalesce(F.array_join(F.transform("docs", lambda x: F.coalesce(x["text"], F.lit(""))), RULE), F.lit(NOTHING_FOUND))) \
            .when(F.col("name") == ESCALATE, ESCALATED).when(F.col("kind").isNotNull(), F.col("acted")).otherwise(UNKNOWN_TOOL)
        by_turn = answered.groupBy(F.col("turn_id").alias("t_id")).agg(
            F.sort_array(F.collect_list(F.struct("id", text.alias("text"), "docs"))).alias("tools"), F.max(F.col("name").eqNullSafe(F.lit(SEARCH))).alias("now_searched"), F.max(F.col("name").eqNullSafe(F.lit(ESCALATE))).alias("now_escalated"))
        handed.append(calls.where(F.col("name") == ESCALATE).select("turn_id", "id", _or(F.col("args")["reason"], NEEDS_HUMAN).alias("reason"), _trimmed(F.col("args")["summary"]).alias("summary")))
        docs = F.flatten(F.transform("tools", lambda t: F.coalesce(F.transform(t["docs"], lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("text"))), F.array().cast("array<struct<chunk_id: string, text: string>>"))))
        new = F.concat(F.array(_message("assistant", F.col("reply.text"))), F.transform("tools", lambda t: _message("tool", t["text"]))).cast(MESSAGES)
        state = waiting.join(by_turn, F.col("turn_id") == F.col("t_id")).select("turn_id", "client_slug", "domain", "message", F.concat("messages", new).alias("messages"), F.concat("found", docs).alias("found"),
                                                                                (F.col("searched") | F.col("now_searched")).alias("searched"), (F.col("escalated") | F.col("now_escalated")).alias("escalated"))
    if state is not None:  # whoever is still waiting has to answer
        forced = cut(state.withColumn("reply", replies(F.col("messages"), make)).withColumn("rounds", F.lit(rounds + 1)))
        done.append(forced.where("reply IS NOT NULL AND reply.text IS NOT NULL").withColumn("answer", _or(F.col("reply.text"), CONNECT)))
        if not (failed := forced.where("reply IS NULL OR reply.text IS NULL")).isEmpty():
            done.append(_fallback(failed, search, make))
    ended = done[0]
    for more in done[1:]:
        ended = ended.unionByName(more)
    ended = cut(ended.select("turn_id", F.col("found").alias("sources"), "searched", "escalated", "rounds", m.clean_citations(F.col("answer")).alias("answer")))
    moods = known.select(F.col("turn_id").alias("k_id"), "client_slug", "message", "history", "mood")
    whole = ended.join(moods, F.col("turn_id") == F.col("k_id"))
    answers = whole.select("turn_id", "answer", F.transform("sources", lambda x: x["chunk_id"]).alias("sources"), (F.size("sources") > 0).alias("used_retrieval"), (F.col("escalated") | F.col("mood.wants_human")).alias("escalated"),
                           (F.col("searched") & (F.size("sources") == 0)).alias("no_kb_match"), "mood.emotion", "mood.intensity", "rounds")
    asked_for = whole.where("mood.wants_human AND NOT escalated").select("turn_id", F.lit(None).cast("long").alias("id"), F.lit(ASKED_FOR_HUMAN).alias("reason"), F.concat(F.lit(ASKED_SUMMARY), "message").alias("summary"))
    for more in handed:
        asked_for = asked_for.unionByName(more)
    lines = F.transform(F.slice("history", F.greatest(F.size("history") - TRANSCRIPT, F.lit(0)) + 1, TRANSCRIPT), lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit(": "), F.coalesce(x["text"], F.lit(""))))
    transcript = F.array_join(F.array_append(lines, F.concat(F.lit("user: "), F.col("message"))), "\n")
    escalations = asked_for.join(moods, F.col("turn_id") == F.col("k_id")).select("turn_id", "client_slug", "reason", "summary", "mood.emotion", "mood.intensity", transcript.alias("transcript"))
    return Outcome(answers, escalations, requests, accounts)


def _with_kind(calls: DataFrame) -> DataFrame:
    """Each call's ``kind`` of action, by what its tenant's domain has; null for other tools."""
    actions = service.available_actions(calls.select("domain").distinct()).select(F.col("domain").alias("a_domain"), F.col("action").alias("a_name"), "kind")
    return calls.join(F.broadcast(actions), F.col("domain").eqNullSafe(F.col("a_domain")) & (F.col("name") == F.col("a_name")), "left").drop("a_domain", "a_name")


def _fallback(failed: DataFrame, search: Search, make: Callable[[], Model]) -> DataFrame:
    """Turns whose model failed: one search, unless it is small talk, and one answer from what it finds; a model that fails again gives the offer of a human."""
    asks = failed.where(~m.is_smalltalk(F.col("message"))).select(F.col("turn_id").alias("query_id"), "client_slug", F.col("message").alias("query_text"))
    found = search(asks).groupBy(F.col("query_id").alias("s_id")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("chunk_id"), "text"))).alias("docs"))
    with_docs = failed.join(found, F.col("turn_id") == F.col("s_id"), "left")
    prompt = F.when(F.col("docs").isNull(), F.col("message")).otherwise(m.user_prompt(F.col("message"), F.transform("docs", lambda x: F.coalesce(x["text"], F.lit("")))))
    asked = with_docs.withColumn("reply", replies(F.array(_message("user", prompt)).cast(MESSAGES), make))
    docs = F.coalesce(F.transform("docs", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("text"))), F.array().cast("array<struct<chunk_id: string, text: string>>"))
    return asked.withColumn("answer", _or(F.col("reply.text"), CONNECT)).withColumn("found", docs).withColumn("searched", ~m.is_smalltalk(F.col("message"))).select(*failed.columns, "answer")
