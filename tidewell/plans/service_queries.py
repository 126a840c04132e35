"""Template, action, routing and behavioural-check queries; customers stand for tenants, orders for requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import service as s

_R = lambda spark, d, name: spark.read.parquet(f"{d}/{name}.parquet")
_DOMAINS = ["generic", "Telecom", "university", "bank"]


def _clients(spark, d):
    key = F.col("c_custkey")
    return _R(spark, d, "customer").select("c_custkey", F.get(F.array(*map(F.lit, _DOMAINS)), (key % 4).cast("int")).alias("domain"), F.when(key % 5 == 0, F.col("c_name")).alias("bot_name"), F.lit(None).cast("string").alias("greeting"))


def client_templates(spark, d):
    return s.with_template(_clients(spark, d)).select("c_custkey", "bot_name", "greeting")


def client_actions(spark, d):
    return s.available_actions(_clients(spark, d)).select("c_custkey", "action", "kind")


def domain_templates(spark, d):
    return s.templates(spark)


def account_lines(spark, d):
    data = F.when(F.col("c_custkey") % 6 != 0, F.create_map(F.lit("market_segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return _R(spark, d, "customer").select("c_custkey", s.account_line(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.col("c_custkey").cast("string"), data).alias("line"))


def request_status(spark, d):
    o = _R(spark, d, "orders")
    return o.select("o_orderkey", s.status_line(F.concat(F.lit("TKT-"), F.col("o_orderkey") + 1000), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")),
                                                F.when(F.col("o_orderstatus") == "F", "done").otherwise("open")).alias("line"))


def recent_changes(spark, d):
    """A customer's order priorities in order of key as changes; the last four and a new one stay."""
    had = _R(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("recent"))
    return had.select("o_custkey", F.array_join(s.with_change(F.col("recent"), F.lit("new plan")), "|").alias("changes"))


def message_routing(spark, d):
    """Events as messages to a phone id, suppliers as tenants."""
    messages = _R(spark, d, "events").select("event_id", (F.col("user_id") % 40).cast("string").alias("phone_number_id"))
    tenants = _R(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("wa_phone_id"), F.col("s_name").alias("client_slug"), (F.col("s_suppkey") % 2 == 0).alias("wa_enabled"))
    return s.route(messages, tenants).select("event_id", "client_slug")


def behaviour_checks(spark, d):
    """Assistant turns against one case."""
    c = _R(spark, d, "conversations").where("role = 'assistant'")
    words = lambda *x: F.array(*map(F.lit, x))
    ok = s.passes(F.col("text"), F.array(words("the", " le ", " der "), words("an", "en")), words("stupid"), F.col("turn") % 2 == 1, F.when(F.col("turn") > 3, F.lit(True)))
    return c.select("conv_id", "turn", ok.alias("passes"))


_C = "(SELECT c_custkey, c_name, ['generic', 'Telecom', 'university', 'bank'][c_custkey % 4 + 1] AS domain FROM customer)"
_T = "(VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in s.TEMPLATES) + ") AS t(domain, display_name, bot_name, greeting, normalization_context)"
_A = "(VALUES " + ", ".join(str(x) for x in s.ACTIONS) + ") AS a(domain, action, kind)"
_CASE = "contains(lower(text), '{0}')"

QUERIES = {
    "client_templates": (client_templates, f"SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 = 0 THEN c_name END, t.bot_name, 'Support Assistant') AS bot_name, coalesce(t.greeting, 'Hi! How can I help you today?') AS greeting FROM {_C} c LEFT JOIN {_T} ON lower(c.domain) = t.domain"),
    "client_actions": (client_actions, f"SELECT c_custkey, action, kind FROM {_C} c JOIN {_A} ON a.domain = CASE WHEN lower(c.domain) = 'university' THEN 'university' ELSE 'generic' END"),
    "domain_templates": (domain_templates, f"SELECT * FROM {_T}"),
    "account_lines": (account_lines, "SELECT c_custkey, 'Account for ' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_custkey::VARCHAR END || CASE WHEN c_custkey % 6 <> 0 THEN ' — market segment: ' || c_mktsegment || '; nation: ' || c_nationkey ELSE ' found.' END AS line FROM customer"),
    "request_status": (request_status, """SELECT o_orderkey, 'TKT-' || (o_orderkey + 1000) || ' (' || o_orderpriority || ') was logged on ' || CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%b %d, %Y') ELSE 'recently' END
        || ' and is currently ' || CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'open (being worked on)' END || '.' AS line FROM orders"""),
    "recent_changes": (recent_changes, "SELECT o_custkey, array_to_string(list_append(list(o_orderpriority ORDER BY o_orderkey)[-4:], 'new plan'), '|') AS changes FROM orders GROUP BY 1"),
    "message_routing": (message_routing, "SELECT event_id, s_name AS client_slug FROM events JOIN supplier ON (user_id % 40) = s_suppkey WHERE s_suppkey % 2 = 0"),
    "behaviour_checks": (behaviour_checks, f"""SELECT conv_id, turn, ({_CASE.format('the')} OR {_CASE.format(' le ')} OR {_CASE.format(' der ')}) AND ({_CASE.format('an')} OR {_CASE.format('en')}) AND NOT {_CASE.format('stupid')}
        AND (turn <= 3 OR turn % 2 = 1) AS passes FROM conversations WHERE role = 'assistant'"""),
}
