"""Escalations, action requests and accounts as copy-on-write tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import messages as m
from tidewell.operators import records as r, service as s

_PROGRAM = {"program": "BSc Computer Science", "application_status": "under review", "intake": "Fall 2026", "fees_due": "$1,200", "advisor": "Dr. Perera"}
# fixed values: the demo accounts of each domain
DEMO_ACCOUNTS = [
    ("telecom", "0771234567", "Alex Fernando", {"plan": "Value 20", "monthly_price": "$20", "balance": "$12.50", "due_date": "2026-07-20", "data_used": "14 GB of 25 GB", "status": "active"}),
    ("telecom", "0777654321", "Priya Kumar", {"plan": "Unlimited Pro", "monthly_price": "$45", "balance": "$0.00", "due_date": "2026-07-28", "data_used": "unlimited 5G", "status": "active"}),
    ("university", "APP-10234", "Sara Nimal", _PROGRAM),
    ("university", "sara.n@example.edu", "Sara Nimal", _PROGRAM),
    ("generic", "jamie@example.com", "Jamie Lee", {"plan": "Standard", "status": "active", "balance": "$0.00", "member_since": "2024"}),
]
OPEN, DONE = "open", "done"
# fixed values: the category of cards, and the title of a card without questions
LEARNED, NEW_TOPIC = "learned", "New topic"
#: Calls are numbered in runs of so many ids.
RUN = 1000


def escalations(turns: DataFrame, messages: DataFrame, *, last: int = 8) -> DataFrame:
    """``turns(conv_id, turn, client_slug, wants_human)``: each that wants a human becomes an open escalation.

    Its ``transcript`` is the ``last`` messages of ``messages(conv_id, turn, role, text)`` up to that turn, as ``role: text`` lines.
    """
    asked = turns.where("wants_human").select(F.col("conv_id").alias("e_conv"), F.col("turn").alias("e_turn"), "client_slug")
    near = asked.join(messages, (F.col("conv_id") == F.col("e_conv")) & (F.col("turn") <= F.col("e_turn")))
    back = F.row_number().over(Window.partitionBy("e_conv", "e_turn").orderBy(F.desc("turn")))
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    said = near.withColumn("back", back).where(F.col("back") <= last).groupBy("e_conv", "e_turn", "client_slug") \
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("transcript"))
    return said.select(F.col("e_conv").alias("conv_id"), F.col("e_turn").alias("turn"), "client_slug", F.lit(OPEN).alias("status"), "transcript")


def with_status(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the ``status`` that ``changes(key, status)`` states; a status that isn't open or done, and unknown keys, change nothing."""
    return r.update_rows(rows, changes.where(F.col("status").isin(OPEN, DONE)), key, ["status"])


def listed(rows: DataFrame, status: str | None = None) -> DataFrame:
    """The rows of one status (null: all) with their tenant's number of open ones, which the filter doesn't touch."""
    opened = rows.groupBy(F.col("client_slug").alias("_slug")).agg(F.count_if(F.col("status") == OPEN).alias("n_open"))
    kept = rows if status is None else rows.where(F.col("status") == status)
    return kept.join(opened, F.col("client_slug").eqNullSafe(F.col("_slug"))).drop("_slug")


# fixed values: what an action answers
ANSWERS = {
    "unknown": "That action isn't available.",
    "logged": "Logged the {what} — reference {reference}. A human agent will follow up.",
    "no_request": "No request was found with reference '{reference}'. Ask the customer to double-check the number.",
    "no_identifier": "I need the account identifier (phone/email/ID) first — please ask the customer for it.",
    "no_account": "No account was found for '{identifier}'. Double-check the details with the customer.",
    "changed": "Done — {change}, confirmed. Reference {reference}.",
    "plan": "plan changed to {plan}",
    "updated": "account updated",
}


def _said(answer: str, **values: Column) -> Column:
    """An answer with its values put in, as they are."""
    parts = re.split(r"{(\w+)}", ANSWERS[answer])
    return F.concat(*(values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def _given(args: Column, name: str) -> Column:
    """An argument, trimmed; null if there is none."""
    return F.nullif(F.regexp_replace(args[name], r"^\s+|\s+$", ""), F.lit(""))


def _some(args: Column, name: str) -> Column:
    """An argument as it is; null if it is empty."""
    return F.nullif(args[name], F.lit(""))


@dataclass(frozen=True)
class Executed:
    """What a batch of calls does."""

    messages: DataFrame  # id, kind, reference, message
    requests: DataFrame  # all requests, the new ones among them
    accounts: DataFrame  # all accounts, changes made


def executed(calls: DataFrame, accounts: DataFrame, requests: DataFrame) -> Executed:
    """What ``calls(id, client_slug, action, kind, args)`` do; ``args`` is a map of strings.

    Tickets and callbacks become open requests, and so do changes of an account that the tenant has; numbers go on from
    the largest of ``requests(id, client_slug, kind, subject, created, status, reference)`` in order of the calls.
    A change sets the ``plan`` to ``new_plan``, or else is one more of the account's five last ``recent_changes``.
    A status call looks up ``reference`` and account calls ``identifier``, among their own tenant's only.
    All calls see ``accounts(account_id, client_slug, identifier, name, data, recent_changes)`` and requests as
    they were before the batch; of several changes of an account, later ids follow earlier ones.  Unknown kinds are refused.
    """
    args = F.col("args")
    people = calls.where(F.col("kind").isin("account_lookup", "account_change")).select(F.col("id").alias("ask_id"), "client_slug", _given(args, "identifier").alias("asked_for"))
    hits = r.match_accounts(people, accounts).select(F.col("ask_id").alias("h_id"), F.col("account_id").alias("h_account"))
    found = calls.join(hits, F.col("id") == F.col("h_id"), "left").drop("h_id")
    change = F.when(_some(args, "new_plan").isNotNull(), _said("plan", plan=args["new_plan"])).otherwise(F.coalesce(_some(args, "change"), F.lit(ANSWERS["updated"])))
    makes = F.col("kind").isin("ticket", "callback") | (F.col("kind") == "account_change") & F.col("h_account").isNotNull()
    top = requests.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    made = r.numbered(found.where(makes), ["id"], F.floor(F.col("id") / RUN)).crossJoin(F.broadcast(top)).select(
        F.col("id").alias("call_id"), (F.col("top") + F.col("nth")).alias("id"), "client_slug", "kind", F.coalesce(_some(args, "subject"), _some(args, "topic"), "action").alias("subject"),
        F.lit(None).cast(requests.schema["created"].dataType).alias("created"), F.lit(OPEN).alias("status"))
    made = r.with_references(made)

    asked = calls.where("kind = 'request_status'").select(F.col("id").alias("ask_id"), "client_slug", args["reference"].alias("text"))
    known = r.find_by_reference(asked, requests).select("ask_id", F.col("reference").alias("k_reference"), s.status_line(F.col("reference"), F.col("subject"), F.col("created"), F.col("status")).alias("k_line"))
    lines = accounts.select(F.col("account_id").alias("l_id"), s.account_line(F.col("name"), F.col("identifier"), F.col("data"), F.col("recent_changes")).alias("line"))
    all_of = found.join(made.select("call_id", F.col("reference").alias("m_reference")), F.col("id") == F.col("call_id"), "left").join(known, F.col("id") == F.col("ask_id"), "left") \
        .join(lines, (F.col("h_account") == F.col("l_id")) & (F.col("kind") == "account_lookup"), "left")
    kind, identifier = F.col("kind"), _given(args, "identifier")
    message = F.when(kind == "ticket", _said("logged", what=F.lit("request"), reference=F.col("m_reference"))).when(kind == "callback", _said("logged", what=F.lit("callback"), reference=F.col("m_reference"))) \
        .when(kind == "request_status", F.coalesce("k_line", _said("no_request", reference=F.coalesce(_given(args, "reference"), F.lit(""))))) \
        .when(~F.coalesce(kind.isin("account_lookup", "account_change"), F.lit(False)), ANSWERS["unknown"]).when(identifier.isNull(), ANSWERS["no_identifier"]) \
        .when(F.col("h_account").isNull(), _said("no_account", identifier=identifier)).when(kind == "account_lookup", F.col("line")).otherwise(_said("changed", change=change, reference=F.col("m_reference")))
    messages = all_of.select("id", "kind", F.coalesce("m_reference", "k_reference").alias("reference"), message.alias("message"))

    changes = found.where(makes & (kind == "account_change")).select("id", "h_account", _some(args, "new_plan").alias("plan"), F.when(_some(args, "new_plan").isNull(), _some(args, "change")).alias("note"))
    newest = changes.groupBy(F.col("h_account").alias("c_id")).agg(F.max_by("plan", F.when(F.col("plan").isNotNull(), F.col("id"))).alias("c_plan"), F.transform(F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("id", "note")))), lambda x: x["note"]).alias("notes"))
    data = F.coalesce("data", F.create_map().cast("map<string,string>"))
    planned = F.when(F.map_contains_key(data, "plan"), F.transform_values(data, lambda k, v: F.when(k == "plan", F.col("c_plan")).otherwise(v))).otherwise(F.map_concat(data, F.create_map(F.lit("plan"), F.col("c_plan"))))
    with_plan = F.when(F.col("c_plan").isNotNull(), planned).otherwise(F.col("data"))
    recent = F.when(F.size("notes") > 0, s.with_changes(F.col("recent_changes"), F.col("notes"))).otherwise(F.col("recent_changes"))
    after = accounts.join(newest, F.col("account_id") == F.col("c_id"), "left").withColumns({"data": with_plan, "recent_changes": recent}).select(*accounts.columns)
    return Executed(messages, requests.unionByName(made.select(*requests.columns)), after)


def upsert_accounts(accounts: DataFrame, given: DataFrame) -> DataFrame:
    """``accounts(account_id, client_slug, identifier, name, data)`` with ``given(client_slug, identifier, name, data)`` merged in.

    What matches an account of the tenant (``records.match_accounts``) replaces its name and adds to its
    data, key by key; the rest are new accounts, numbered on from the largest id in order of tenant and
    identifier.  If several match one account, the last identifier's values win.
    """
    asked = given.withColumn("ask_id", F.struct("client_slug", "identifier"))
    hits = r.match_accounts(asked.select("ask_id", "client_slug", F.col("identifier").alias("asked_for")), accounts)
    matched = asked.join(hits.select("ask_id", "account_id"), "ask_id")
    newest = matched.groupBy("account_id").agg(F.max_by(F.struct("name", "data"), "identifier").alias("new")).select(F.col("account_id").alias("n_id"), F.col("new.name").alias("n_name"), F.col("new.data").alias("n_data"))
    none = F.create_map().cast("map<string,string>")
    new_keys = F.map_keys(F.coalesce("n_data", none))
    merged = F.map_concat(F.map_filter(F.coalesce("data", none), lambda k, v: ~F.array_contains(new_keys, k)), F.coalesce("n_data", none))
    kept = accounts.join(newest, F.col("account_id") == F.col("n_id"), "left").select("account_id", "client_slug", "identifier", F.coalesce("n_name", "name").alias("name"), merged.alias("data"))
    top = accounts.agg(F.coalesce(F.max("account_id"), F.lit(0)).alias("top"))  # one row
    unknown = asked.join(hits.select("ask_id"), "ask_id", "left_anti").dropDuplicates(["client_slug", "identifier"])
    added = r.numbered(unknown, ["client_slug", "identifier"], F.col("client_slug")).crossJoin(F.broadcast(top)) \
        .select((F.col("top") + F.col("nth")).alias("account_id"), "client_slug", "identifier", "name", "data")
    return kept.unionByName(added)


def demo_accounts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEMO_ACCOUNTS, "domain string, identifier string, name string, data map<string,string>")


def seed_accounts(accounts: DataFrame, clients: DataFrame) -> DataFrame:
    """The demo accounts of each of ``clients(client_slug, domain)`` in place of those it had; unknown domains get the generic ones."""
    demo = demo_accounts(accounts.sparkSession)
    known = [d for d in dict.fromkeys(x[0] for x in DEMO_ACCOUNTS)]
    domain = F.when(F.lower("domain").isin(known), F.lower("domain")).otherwise("generic")
    seeded = clients.select("client_slug", domain.alias("d")).join(F.broadcast(demo), F.col("d") == F.col("domain")).select("client_slug", "identifier", "name", "data")
    others = accounts.join(clients.select("client_slug").distinct(), "client_slug", "left_anti").select("client_slug", "identifier", "name", "data")
    return others.unionByName(seeded)


def knowledge_drafts(gaps: DataFrame, *, most: int = 8) -> DataFrame:
    """``gaps(client_slug, position, representative, examples)`` as prompts for a knowledge card: the first ``most`` questions of a gap, a line each."""
    listed = F.slice(F.array_distinct(F.concat(F.array("representative"), F.col("examples"))), 1, most)
    return gaps.select("client_slug", "position", "representative", F.concat(F.lit("Questions:\n- "), F.array_join(listed, "\n- ")).alias("prompt"))


def knowledge_cards(drafts: DataFrame, reply: Column) -> DataFrame:
    """Approved drafts as documents ``(client_slug, document_id, text, title, category, tags)``, of the category ``learned``.

    Title, content and tags are those of the reply's JSON.  A blank title gives way to the ``representative``, the
    gap's first question; replies without content are left out.
    """
    found = F.from_json(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0), "title string, content string, tags array<string>")
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    card = drafts.withColumn("card", found).withColumn("content", trimmed(F.col("card.content"))).where("content <> ''")
    card = card.withColumn("title", F.coalesce(F.nullif(trimmed(F.col("card.title")), F.lit("")), F.nullif("representative", F.lit("")), F.lit(NEW_TOPIC))).withColumn("tags", F.coalesce("card.tags", F.array().cast("array<string>")))
    text = F.concat_ws("\n", "title", "content", F.when(F.size("tags") > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", "))))
    return card.select("client_slug", F.concat(F.lit("kb_"), F.left(F.md5(text.cast("binary")), F.lit(12))).alias("document_id"), text.alias("text"), "title", F.lit(LEARNED).alias("category"), "tags")
