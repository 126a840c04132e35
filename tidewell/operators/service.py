"""Tenant templates, actions and their wording, routing, and behavioural checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: what a new tenant starts from, by domain; unknown domains use the first
TEMPLATES = [
    ("generic", "Generic Customer Care", "Support Assistant", "Hi! How can I help you today?", "general customer support documents"),
    ("telecom", "Telecommunications", "Customer Support", "Hi! I can help with packages, billing, and activation. What do you need?", "telecommunication packages, data plans, and billing policies"),
    ("university", "University / Education", "Student Assistant", "Hi! Ask me about courses, enrollment, fees, or university procedures.", "university courses, enrollment procedures, and admission requirements"),
]
# fixed values: actions by domain; other domains have the generic ones
ACTIONS = [("university", "create_request", "ticket"), ("university", "book_advisor", "callback"), ("university", "check_request", "request_status"), ("generic", "create_ticket", "ticket"),
           ("generic", "request_callback", "callback"), ("generic", "lookup_account", "account_lookup"), ("generic", "update_account", "account_change"), ("generic", "check_ticket", "request_status")]
CHANGES_KEPT = 4


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "domain string, display_name string, bot_name string, greeting string, normalization_context string")


def actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTIONS, "domain string, action string, kind string")


def with_template(clients: DataFrame) -> DataFrame:
    """``clients(domain, bot_name, greeting, ...)``: what a tenant leaves open comes from its domain's template, else the generic one."""
    t = F.broadcast(templates(clients.sparkSession).select(F.col("domain").alias("t_domain"), F.col("bot_name").alias("t_bot"), F.col("greeting").alias("t_greet")))
    first = TEMPLATES[0]
    joined = clients.join(t, F.lower(F.col("domain")) == F.col("t_domain"), "left")
    return joined.withColumns({"bot_name": F.coalesce("bot_name", "t_bot", F.lit(first[2])), "greeting": F.coalesce("greeting", "t_greet", F.lit(first[3]))}).drop("t_domain", "t_bot", "t_greet")


def available_actions(clients: DataFrame) -> DataFrame:
    """Each tenant's actions: its domain's, or the generic ones where the domain has none."""
    a = actions(clients.sparkSession)
    own = [d for d in dict.fromkeys(d for d, _, _ in ACTIONS)]
    key = F.when(F.lower(F.coalesce("domain", F.lit("generic"))).isin(own), F.lower(F.coalesce("domain", F.lit("generic")))).otherwise("generic")
    return clients.withColumn("_set", key).join(F.broadcast(a.withColumnRenamed("domain", "_domain")), F.col("_set") == F.col("_domain")).drop("_set", "_domain")


def account_line(name: Column, identifier: Column, data: Column, recent: Column | None = None) -> Column:
    """A map of account data as one line, ``recent`` changes last."""
    who = F.coalesce(F.nullif(name, F.lit("")), identifier)
    parts = F.coalesce(F.transform(F.map_entries(data), lambda e: F.concat(F.replace(e["key"], F.lit("_"), F.lit(" ")), F.lit(": "), F.coalesce(e["value"], F.lit("")))), F.array().cast("array<string>"))
    if recent is not None:
        parts = F.when(F.size(recent) > 0, F.array_append(parts, F.concat(F.lit("recent changes: ['"), F.array_join(recent, "', '"), F.lit("']")))).otherwise(parts)
    return F.when(F.size(parts) > 0, F.concat(F.lit("Account for "), who, F.lit(" — "), F.array_join(parts, "; "))).otherwise(F.concat(F.lit("Account for "), who, F.lit(" found.")))


def status_line(reference: Column, subject: Column, created: Column, status: Column) -> Column:
    state = F.when(status == "done", "completed").otherwise("open (being worked on)")
    return F.concat(reference, F.lit(" ("), subject, F.lit(") was logged on "), F.coalesce(F.date_format(created, "MMM dd, yyyy"), F.lit("recently")), F.lit(" and is currently "), state, F.lit("."))


def with_change(recent: Column, change: Column) -> Column:
    """The last changes of an account and the new one."""
    return with_changes(recent, F.array(change))


def with_changes(recent: Column, changes: Column) -> Column:
    """The same for several changes, one after the other."""
    both = F.concat(F.coalesce(recent, F.array().cast("array<string>")), changes)
    return F.slice(both, F.greatest(F.size(both) - CHANGES_KEPT - 1, F.lit(0)) + 1, F.lit(CHANGES_KEPT + 1))


def route(messages: DataFrame, tenants: DataFrame) -> DataFrame:
    """``messages(phone_number_id, ...)`` to enabled ``tenants(wa_phone_id, client_slug, wa_enabled)``; others are left out."""
    on = tenants.where("wa_enabled").select("wa_phone_id", "client_slug")
    return messages.join(on, F.col("phone_number_id") == F.col("wa_phone_id")).drop("wa_phone_id")


def passes(answer: Column, must_include: Column, must_avoid: Column, searched: Column, expected: Column) -> Column:
    """A behavioural case: of every group some string occurs, none of the avoided does, and retrieval was used as expected (null: either)."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    groups = F.forall(must_include, lambda g: F.exists(g, lambda s: F.contains(low, F.lower(s))))
    clean = ~F.exists(must_avoid, lambda s: F.contains(low, F.lower(s)))
    return groups & clean & (expected.isNull() | (expected == searched))
