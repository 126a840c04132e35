"""Agent rounds over ``conversations`` with a scripted model, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import agent
from tidewell.plans import conversation_queries as cq

_R = lambda spark, d, name: spark.read.parquet(f"{d}/{name}.parquet")
TURN_BITS = 20


def scripted() -> agent.Model:
    """By the message's length: answers at once, searches, hands over, logs a ticket, never stops calling tools, or fails."""
    def reply(said: list[dict]) -> dict:
        if said[0]["role"] == "user":
            return {"text": "Fallback: " + said[0]["text"]}
        text = [x["text"] for x in said if x["role"] == "user"][-1]
        tools = [x["text"] for x in said if x["role"] == "tool"]
        way = len(text) % 6
        if way == 5:
            raise ValueError("out of order")
        if way == 4:
            return {"text": " still ", "calls": [{"name": "dance", "args": {}}]}
        if way == 0 or tools:
            return {"text": ["Answer: " + text, "Found: " + (tools or [""])[-1], f"handed over, tools {len(tools)}", (tools or [""])[-1]][way]}
        return {"text": None, "calls": [[{"name": agent.SEARCH, "args": {"query": ""}}], [{"name": agent.ESCALATE, "args": {"summary": " s "}}, {"name": "dance"}], [{"name": "create_ticket", "args": {"subject": "S"}}]][way - 1]}

    return lambda batch: [reply(said) for said in batch]


def turns_of(conversations: DataFrame) -> DataFrame:
    """Every user message as a turn, with the messages of the eight turn numbers before it: each message goes to those after it, so no conversation meets in one task."""
    c = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    later = c.select(F.col("conv_id").alias("h_conv"), F.explode(F.sequence(F.col("turn") + 1, F.col("turn") + agent.TRANSCRIPT)).alias("h_turn"), F.struct("turn", "role", "text").alias("said"))
    history = later.groupBy("h_conv", "h_turn").agg(F.transform(F.sort_array(F.collect_list("said")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("history"))
    asked = c.where("role = 'user'").join(history, (F.col("conv_id") == F.col("h_conv")) & (F.col("turn") == F.col("h_turn")), "left")
    return asked.select(F.shiftleft("conv_id", TURN_BITS).bitwiseOR(F.col("turn")).alias("turn_id"), F.concat(F.lit("tenant"), F.col("conv_id") % 3).alias("client_slug"), F.lit("generic").alias("domain"), F.col("text").alias("message"), "history")


def _outcome(spark: SparkSession, d: str) -> agent.Outcome:
    known = _R(spark, d, "benchmark").select("item_id", "text")

    def search(queries: DataFrame) -> DataFrame:
        """The benchmark item whose number the question's length gives; lengths divisible by seven find nothing."""
        n = F.char_length("query_text")
        return queries.withColumn("key", F.when(n % 7 != 0, n % 50)).join(known, F.col("key") == F.col("item_id")).select("query_id", F.lit(1).alias("rank"), F.col("item_id").alias("chunk_id"), "text")

    accounts = spark.createDataFrame([], "account_id long, client_slug string, identifier string, name string, data map<string,string>, recent_changes array<string>")
    requests = spark.createDataFrame([], "id long, client_slug string, kind string, subject string, created date, status string, reference string")
    return agent.run_turns(turns_of(_R(spark, d, "conversations")), accounts, requests, search, scripted)


def agent_turns(spark, d):
    """Every user message answered by the scripted model."""
    done = _outcome(spark, d).answers
    return done.select(F.shiftright("turn_id", TURN_BITS).alias("conv_id"), (F.col("turn_id") % (1 << TURN_BITS)).alias("turn"), F.md5(F.col("answer").cast("binary")).alias("answer_md5"), "used_retrieval", "escalated", "no_kb_match", "rounds")


def agent_escalations(spark, d):
    """What the scripted model hands over, with the transcript so far."""
    done = _outcome(spark, d).escalations
    return done.select(F.shiftright("turn_id", TURN_BITS).alias("conv_id"), (F.col("turn_id") % (1 << TURN_BITS)).alias("turn"), "client_slug", "reason", "summary", F.md5(F.col("transcript").cast("binary")).alias("transcript_md5"))


_U = "(SELECT conv_id, turn, coalesce(text, '') AS msg, length(coalesce(text, '')) % 6 AS way FROM conversations WHERE role = 'user')"
_TRIM = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"

QUERIES = {
    "agent_turns": (agent_turns, f"""WITH u AS {_U}, talk AS ({cq.QUERIES['smalltalk'][1]}),
        s AS (SELECT u.*, b.text AS found, is_smalltalk FROM u LEFT JOIN benchmark b ON length({_TRIM('msg')}) % 7 <> 0 AND b.item_id = length({_TRIM('msg')}) % 50 JOIN talk ON talk.conv_id = u.conv_id AND talk.turn = u.turn),
        t AS (SELECT *, 1000 + row_number() OVER (PARTITION BY way ORDER BY conv_id, turn) AS ref FROM s),
        a AS (SELECT conv_id, turn, {_TRIM(f"CASE way WHEN 0 THEN 'Answer: ' || msg WHEN 1 THEN 'Found: ' || coalesce(found, '{agent.NOTHING_FOUND}') WHEN 2 THEN 'handed over, tools 2' WHEN 3 THEN 'Logged the request — reference TKT-' || ref || '. A human agent will follow up.' WHEN 4 THEN 'still' ELSE 'Fallback: ' || CASE WHEN is_smalltalk OR found IS NULL THEN msg ELSE 'Information:' || chr(10) || found || chr(10) || chr(10) || 'Question: ' || msg END END")} AS text,
            way = 1 AND found IS NOT NULL OR way = 5 AND NOT is_smalltalk AND found IS NOT NULL AS used_retrieval, way = 2 AS escalated, found IS NULL AND (way = 1 OR way = 5 AND NOT is_smalltalk) AS no_kb_match, CASE way WHEN 0 THEN 1 WHEN 5 THEN 1 WHEN 4 THEN 4 ELSE 2 END AS rounds FROM t)
        SELECT conv_id, turn, md5(upper(left(c, 1)) || substring(c, 2)) AS answer_md5, used_retrieval, escalated, no_kb_match, rounds FROM (SELECT *, {cq._CIT} AS c FROM a)"""),
    "agent_escalations": (agent_escalations, f"""SELECT u.conv_id, u.turn, 'tenant' || (u.conv_id % 3) AS client_slug, '{agent.NEEDS_HUMAN}' AS reason, 's' AS summary,
        md5(coalesce(string_agg(h.role || ': ' || coalesce(h.text, '') || chr(10), '' ORDER BY h.turn), '') || 'user: ' || any_value(msg)) AS transcript_md5
        FROM {_U} u LEFT JOIN conversations h ON h.conv_id = u.conv_id AND h.turn < u.turn AND h.turn >= u.turn - {agent.TRANSCRIPT} WHERE way = 2 GROUP BY u.conv_id, u.turn"""),
}
