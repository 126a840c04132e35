"""Agent rounds: what the model sees, how its calls are answered, and who is handed over."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import agent

TURNS = "turn_id long, client_slug string, domain string, message string, history array<struct<role: string, text: string>>"
ACCOUNTS = "account_id long, client_slug string, identifier string, name string, data map<string,string>, recent_changes array<string>"
REQUESTS = "id long, client_slug string, kind string, subject string, created date, status string, reference string"


def model():
    """Follows what the message asks for, and tells what it saw."""
    def one(said):
        if said[0]["role"] == "user":
            raise ValueError("fails even then")
        text = [x["text"] for x in said if x["role"] == "user"][-1]
        tools = [x["text"] for x in said if x["role"] == "tool"]
        if text.startswith("fail"):
            raise ValueError("down")
        if text.startswith("change") and len(tools) < 2:
            return {"text": "", "calls": [{"name": "update_account", "args": {"identifier": "077 1234567", "new_plan": "Gold"}}] if not tools else [{"name": "lookup_account", "args": {"identifier": "0771234567"}}]}
        if text.startswith("several") and not tools:
            return {"calls": [{"name": agent.SEARCH, "args": {"query": "two"}}, {"name": agent.SEARCH}, {"name": "create_ticket", "args": {"subject": None}}, {"name": agent.ESCALATE, "args": {"reason": " why "}}]}
        if text.startswith("book") and not tools:
            return {"calls": [{"name": "create_ticket"}, {"name": "book_advisor", "args": {"topic": "thesis"}}]}
        if text.startswith("show"):
            return {"text": " | ".join(f"{x['role']}={x['text']}" for x in said)}
        return {"text": " / ".join(tools)}

    return lambda batch: [one(said) for said in batch]


def test_rounds(spark):
    history = [(r, f"{r[0]}{i}") for i, r in enumerate(["user", "assistant", "system", "user", "assistant", "user", "assistant", "user", "assistant"])]
    turns = spark.createDataFrame([
        (1, "a", "telecom", "show me", history), (2, "a", "telecom", "change plan", None), (3, "b", "telecom", "change plan", []), (4, "a", "telecom", "several things!! now", history),
        (5, "a", "university", "book it", None), (6, "a", "generic", "fail please", None), (7, "a", "generic", None, None), (8, "a", None, "I want a HUMAN now!!", history[:1])], TURNS)
    accounts = spark.createDataFrame([(1, "a", "0771234567", "Al", {"plan": "Blue"}, None)], ACCOUNTS)
    requests = spark.createDataFrame([(7, "a", "ticket", "old", None, "open", "TKT-1007")], REQUESTS)

    def search(queries):
        """Two passages for what holds "two", none else."""
        hits = queries.where(F.contains("query_text", F.lit("two")))
        return hits.select("query_id", F.explode(F.array(*(F.struct(F.lit(n).alias("rank"), F.lit(f"c{n}").alias("chunk_id"), F.lit(f"passage {n}").alias("text")) for n in (2, 1)))).alias("h")).select("query_id", "h.*")

    mood = lambda text: F.when(F.contains(text, F.lit("HUMAN")), F.lit('{"emotion": "angry", "intensity": 4, "wants_human": true}')).otherwise(F.lit('{"emotion": "happy"}'))
    out = agent.run_turns(turns, accounts, requests, search, model, mood=mood, system="S")
    got = {r.turn_id: r for r in out.answers.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert got[1].answer == "System=S | user=u3 | assistant=a4 | user=u5 | assistant=a6 | user=u7 | assistant=a8 | user=show me" and (got[1].rounds, got[1].emotion) == (1, "neutral")
    assert "plan changed to Gold, confirmed. Reference CHG-1008." in got[2].answer and "plan: Gold" in got[2].answer and got[2].rounds == 3
    assert got[3].answer.count("No account was found for") == 2
    assert got[4].answer.startswith("Passage 1\n\n---\n\npassage 2 / " + agent.NOTHING_FOUND + " / Logged the request — reference TKT-1009.") and got[4].answer.endswith(agent.ESCALATED)
    assert (got[4].sources, got[4].used_retrieval, got[4].escalated, got[4].no_kb_match, got[4].emotion) == (["c1", "c2"], True, True, False, "happy")
    assert got[5].answer.startswith(agent.UNKNOWN_TOOL + " / Logged the callback — reference CB-10")
    assert (got[6].answer, got[6].no_kb_match, got[6].used_retrieval) == (agent.CONNECT, True, False)
    assert got[7].answer == agent.REPHRASE
    assert got[8].escalated and (got[8].emotion, got[8].intensity) == ("angry", 4)
    handed = {r.turn_id: r for r in out.escalations.collect()}
    assert sorted(handed) == [4, 8] and (handed[4].reason, handed[4].summary) == ("why", "") and handed[4].transcript.count("\n") == 8
    assert (handed[8].reason, handed[8].transcript) == (agent.ASKED_FOR_HUMAN, "user: u0\nuser: I want a HUMAN now!!")
    assert [(r.plan, r.n) for r in out.accounts.select(F.col("data")["plan"].alias("plan"), F.size("recent_changes").alias("n")).collect()] == [("Gold", None)] or out.accounts.first().data["plan"] == "Gold"
    assert sorted(r.reference for r in out.requests.collect()) == ["CB-1010", "CHG-1008", "TKT-1007", "TKT-1009"]
    assert agent.run_turns(turns.limit(0), accounts, requests, search, model).answers.count() == 0


def test_the_cap_forces_an_answer(spark):
    turns = spark.createDataFrame([(1, "a", "generic", "x", None), (2, "a", "generic", "y", None)], TURNS)
    make = lambda: lambda batch: [{"text": "more" if said[-1]["text"] != "y" and said[1]["text"] == "x" else "", "calls": [{"name": "dance"}]} for said in batch]
    none = lambda q: q.select("query_id", F.lit(1).alias("rank"), F.lit("c").alias("chunk_id"), F.lit("t").alias("text")).limit(0)
    out = agent.run_turns(turns, spark.createDataFrame([], ACCOUNTS), spark.createDataFrame([], REQUESTS), none, make)
    assert {r.turn_id: (r.answer, r.rounds) for r in out.answers.collect()} == {1: ("More", 4), 2: (agent.CONNECT, 4)}
