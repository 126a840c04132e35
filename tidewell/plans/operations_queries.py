"""Assistant, ticket, account and indexing queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import models
from tidewell.functions import text as t
from tidewell.operators import assistant, chunking, records as r, retrieval, tickets
from tidewell.plans import conversation_queries as cq, retrieval_queries as rq
from tidewell.streaming import feeds

_R = lambda spark, d, name: spark.read.parquet(f"{d}/{name}.parquet")


def _escalations(spark: SparkSession, d: str) -> DataFrame:
    c = _R(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("tenant"), F.col("conv_id") % 3).alias("client_slug"), (F.col("turn") % 4 == 2).alias("wants_human"))
    return tickets.escalations(asked, c)


def escalation_log(spark, d):
    """User turns of every fourth number ask for a human; what was said before is kept."""
    return _escalations(spark, d).select("conv_id", "turn", "client_slug", "status", F.md5(F.col("transcript").cast("binary")).alias("transcript_md5"))


def escalation_status(spark, d):
    """Escalations of even conversations are resolved; one change states no status at all."""
    rows = _escalations(spark, d).withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    changes = rows.select("key", F.when(F.col("conv_id") % 2 == 0, "done").when(F.col("conv_id") % 3 == 0, "lost").alias("status"))
    return tickets.listed(tickets.with_status(rows, changes, "key"), "done").select("conv_id", "turn", "client_slug", "status", "n_open")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    o = _R(spark, d, "orders")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "ticket").when(F.col("o_orderkey") % 3 == 1, "callback").otherwise("account_change")
    made = o.select(F.col("o_orderkey").alias("id"), kind.alias("kind"), F.concat(F.lit("tenant"), F.col("o_custkey") % 3).alias("client_slug"), F.col("o_orderpriority").alias("subject"), F.col("o_orderdate").alias("created"),
                    F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"))
    return r.with_references(made)


def request_transitions(spark, d):
    """Orders as requests: every fifth is set to open again, every seventh to a status that doesn't exist."""
    rows = _requests(spark, d)
    changes = rows.where("id % 5 = 0 OR id % 7 = 0").select("id", F.when(F.col("id") % 7 == 0, "closed").otherwise("open").alias("status"))
    return tickets.listed(tickets.with_status(rows, changes, "id")).select("id", "kind", "client_slug", "reference", "status", "n_open")


def _accounts(spark: SparkSession, d: str) -> DataFrame:
    c = _R(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("account_id"), F.concat(F.lit("tenant"), F.col("c_nationkey") % 3).alias("client_slug"), F.concat(F.lit("ACC-"), F.col("c_custkey") + 100000).alias("identifier"),
                    F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"), F.create_map(F.lit("market_segment"), F.col("c_mktsegment")).alias("data"))


def _executed(spark: SparkSession, d: str) -> tickets.Executed:
    """Customers' calls, one of each kind in turn.

    Status calls ask for tickets of the caller's own number, which may be another tenant's; account calls give
    their own identifier, one that nobody has, or none; changes state a plan, a note, or nothing.
    """
    c = _accounts(spark, d)
    i = F.col("account_id")
    of = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(k).alias("kind")) for a, k in (("create_ticket", "ticket"), ("request_callback", "callback"), ("update_account", "account_change"), ("check_ticket", "request_status"), ("lookup_account", "account_lookup"), ("dance", "dance"))))
    call = F.get(of, (i % 6).cast("int"))
    identifier = F.when(i % 21 == 2, " ").when(i % 7 == 3, " nobody ").otherwise(F.lower("identifier"))
    args = F.map_from_arrays(F.array(*map(F.lit, ("subject", "reference", "identifier", "new_plan", "change"))), F.array(
        F.when(i % 4 != 0, F.col("name")), F.when(i % 15 == 0, "none").otherwise(F.concat(F.lit("tkt "), i + 1000)), identifier, F.when(i % 4 == 0, F.concat(F.lit("P"), i)), F.when(i % 8 != 2, F.concat(F.lit("note "), i))))
    calls = c.select(i.alias("id"), "client_slug", call["action"].alias("action"), call["kind"].alias("kind"), args.alias("args"))
    # every fifth account has had five changes, some accounts are changed twice
    twice = calls.where("id % 24 = 14").withColumns({"id": F.col("id") + 100_000_000, "args": F.map_concat(F.map_filter("args", lambda k, v: ~k.isin("new_plan", "change")), F.create_map(F.lit("change"), F.lit("again")))})
    had = F.when(i % 5 == 0, F.array(*map(F.lit, "abcde")))
    return tickets.executed(calls.unionByName(twice), c.withColumn("recent_changes", had.cast("array<string>")), _requests(spark, d))


def executed_actions(spark, d):
    """What customers' calls answer."""
    return _executed(spark, d).messages


def executed_changes(spark, d):
    """Accounts and requests after customers' calls."""
    done = _executed(spark, d)
    data = F.array_join(F.transform(F.map_entries("data"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    accounts = done.accounts.select(F.lit("account").alias("kind"), F.col("account_id").alias("id"), "client_slug", F.concat(data, F.lit("|"), F.coalesce(F.array_join("recent_changes", ","), F.lit("-"))).alias("state"))
    return accounts.unionByName(done.requests.select("kind", "id", "client_slug", F.concat_ws("|", "reference", "subject", "status").alias("state")))


def account_upsert(spark, d):
    """Suppliers are merged into the customers' accounts: those of small numbers match by digits, the others are new."""
    s = _R(spark, d, "supplier")
    given = s.select(F.concat(F.lit("tenant"), F.col("s_nationkey") % 3).alias("client_slug"), F.concat(F.lit("No "), F.col("s_suppkey") + F.when(F.col("s_suppkey") % 2 == 0, 100000).otherwise(900000)).alias("identifier"),
                     F.col("s_name").alias("name"), F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("data"))
    out = tickets.upsert_accounts(_accounts(spark, d), given)
    return out.select("account_id", "client_slug", "identifier", "name", F.array_join(F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("data"))


def demo_accounts(spark, d):
    """Tenants 0 and 1 of the customers' accounts are seeded anew, one of them in a domain that has no accounts of its own."""
    clients = spark.sql("SELECT * FROM VALUES ('tenant0', 'Telecom'), ('tenant1', 'bank') AS t(client_slug, domain)")
    return tickets.seed_accounts(_accounts(spark, d), clients).select("client_slug", "identifier", "name", F.array_join(F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("data"))


def knowledge_cards(spark, d):
    """Benchmark items as gaps; the replies quote the prompt, every fourth one is blank, every fifth has no title and every sixth no tags."""
    gaps = _R(spark, d, "benchmark").select(F.concat(F.lit("tenant"), F.col("item_id") % 3).alias("client_slug"), F.col("item_id").alias("position"), F.concat(F.lit("Q"), F.col("item_id")).alias("representative"),
                                            F.array(F.concat(F.lit("Q"), F.col("item_id")), F.lit("another")).alias("examples"))
    drafts = tickets.knowledge_drafts(gaps)
    title, tags = F.when(F.col("position") % 5 == 0, " ").otherwise(" T "), F.when(F.col("position") % 6 != 0, F.array(F.lit("a"), F.lit("b")))
    reply = F.when(F.col("position") % 4 == 0, "no").otherwise(F.concat(F.lit("Sure "), F.to_json(F.struct(title.alias("title"), F.col("prompt").alias("content"), tags.alias("tags")))))
    return tickets.knowledge_cards(drafts, reply).select("client_slug", "document_id", "text", "title", "category", F.array_join("tags", ",").alias("tags"))


_PARTS = [("plain words", "plain words"), ('["a", {"text": "b", "content": "x"}, {"content": "c"}, {"other": 1}]', "abc"), ("[not json", "[not json"), (None, ""), ('[{"text": ""}, "z"]', "z")]


def message_flatten(spark, d):
    """Messages as they are, and as lists of a string and a part."""
    c = _R(spark, d, "conversations").select("conv_id", "turn", "text")
    listed = F.to_json(F.array(F.col("text"), F.to_json(F.struct(F.col("text").alias("text")))))
    some = spark.createDataFrame([(-1 - i, 0, x) for i, (x, _) in enumerate(_PARTS)], "conv_id long, turn long, content string")
    rows = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(listed).alias("content")).unionByName(some)
    return rows.select("conv_id", "turn", F.md5(assistant.message_text(F.col("content")).cast("binary")).alias("text_md5"))


def source_footer(spark, d):
    """Pages of a host as the sources of its answer, as many as its number says."""
    c = _R(spark, d, "conversations").where("role = 'assistant'")
    sources = F.transform(F.slice(F.array(*(F.lit(x) for x in ("docs/a.pdf", "b.json", "x/y/c.html", "d.pdf"))), F.lit(1), (F.col("turn") % 5).cast("int")), lambda x: x)
    return c.select("conv_id", "turn", F.md5(assistant.with_sources(F.col("text"), sources).cast("binary")).alias("answer_md5"))


def question_chunks(spark, d):
    """Two template questions for every benchmark item beside it; replies of a generator come first where there are any."""
    b = _R(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), "text")
    return chunking.question_chunks(b).select("chunk_id", "source_chunk_id", "content_type", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def given_questions(spark, d):
    b = _R(spark, d, "benchmark")
    reply = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Here:\n1. What is "), F.col("item_id"), F.lit("?\n- Why so?\nDone.\n3) When?\n4. Who?")))
    return b.select("item_id", F.array_join(chunking.given_questions(reply, F.col("text")), "|").alias("questions"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their vectors as chunks; those of label 1 are generated questions, some have no type."""
    e = _R(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), F.when(F.col("label") == 1, "question").when(F.col("label") != 2, "chunk").alias("content_type"))
    return e.join(_R(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id", "full_outer")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item, asked with the vector of its number; replies are the next item."""
    b = _R(spark, d, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("o_id"), F.col("text").alias("reply"))
    v = _R(spark, d, "embeddings").select(F.col("vec_id").alias("v_id"), F.col("embedding").alias("query_vec"))
    return b.join(other, F.col("item_id") == F.col("o_id"), "left").join(v, F.col("item_id") == F.col("v_id")).select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), "query_vec", "reply")


def _retrieved(mode, **settings):
    def query(spark, d):
        texts = _R(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
        return assistant.retrieved(_asked(spark, d), _typed(spark, d), rq.keyword_index(spark, d), 5, texts=texts, mode=mode, **settings).select("query_id", "chunk_id", "rank", F.round(F.col("hybrid_score") + 2.5e-7, 5).alias("hybrid_score"))
    return query


def multi_query_retrieval(spark, d):
    """Vectors 3i, 3i+1 and 3i+2 are the variations of question i, every one divisible by 100; the first is the original where i is even."""
    e = _R(spark, d, "embeddings").where(F.floor(F.col("vec_id") / 3) % 100 == 0)
    q = F.floor(F.col("vec_id") / 3).cast("long")
    variations = e.select(q.alias("query_id"), (F.col("vec_id") % 3).alias("variant_no"), F.concat(F.lit("Plan "), q, F.lit("-"), F.col("vec_id") % 3).alias("variant"),
                          F.concat(F.lit("PLAN "), q, F.when(q % 2 == 0, "-0").otherwise("-9")).alias("original"), F.col("embedding").alias("query_vec"))
    return assistant.multi_query(variations, rq._vectors(spark, d), 6).select("query_id", "chunk_id", "rrf_score", "appearances", "best_rank")


def gap_self_heal(spark, d):
    """Vectors of every hundredth number are open gaps of three tenants; those with another vector within the threshold are healed."""
    gaps = _R(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.concat(F.lit("t"), F.col("vec_id") % 3).alias("client_slug"), F.col("vec_id").alias("position"), F.col("embedding").alias("query_vec"))
    near = retrieval.knn(gaps.select(F.col("position").alias("query_id"), "query_vec"), rq._vectors(spark, d), 1, exclude_self=True).where("distance <= 1.2")
    healed = near.select(F.concat(F.lit("t"), F.col("query_id") % 3).alias("client_slug"), F.col("query_id").alias("position"))
    return assistant.open_gaps(gaps.drop("query_vec"), healed)


def index_statistics(spark, d):
    """Sources are tenants, documents their chunks; those without a vector of their number aren't embedded."""
    docs = _R(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("client_slug"), F.coalesce("lang", F.lit("none")).alias("document_id"), F.col("doc_id").alias("chunk_id"), "text")
    v = _R(spark, d, "embeddings").select(F.col("vec_id").alias("v_id"), "embedding")
    out = assistant.index_statistics(docs.join(v, F.col("chunk_id") == F.col("v_id"), "left"))
    return out.select("client_slug", "n_files", "n_chunks", "n_embeddings", F.md5(F.array_join("previews", "|").cast("binary")).alias("previews_md5"))


def active_sessions(spark, d):
    """Users who were active in the half hour before the middle of every day that has events."""
    e = _R(spark, d, "events")
    day = F.to_date("ts")
    active = feeds.active_by(e.withColumn("at", day.cast("timestamp") + F.expr("INTERVAL 12 HOURS")), "at")
    days = e.select(day.alias("day")).distinct()
    return days.join(active, F.col("day") == F.to_date("at"), "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"))


def command_messages(spark, d):
    """The fixture messages and every user turn, some of them commands."""
    c = _R(spark, d, "conversations").where("role = 'user'")
    said = F.when(F.col("turn") % 4 == 0, " HELP ").when(F.col("turn") % 4 == 2, F.concat(F.lit("/"), F.lit("reset"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", feeds.command(said).alias("command"))


_MSGS = "(SELECT conv_id, turn, role, text FROM conversations)"
_ESC = f"""(SELECT a.conv_id, a.turn, 'tenant' || (a.conv_id % 3) AS client_slug, string_agg(coalesce(m.role, '') || ': ' || coalesce(m.text, ''), chr(10) ORDER BY m.turn) AS transcript
    FROM (SELECT * FROM {_MSGS} WHERE role = 'user' AND turn % 4 = 2) a JOIN (SELECT x.conv_id, x.turn AS upto, y.turn, y.role, y.text, row_number() OVER (PARTITION BY x.conv_id, x.turn ORDER BY y.turn DESC) AS back
    FROM {_MSGS} x JOIN {_MSGS} y ON x.conv_id = y.conv_id AND y.turn <= x.turn WHERE x.role = 'user' AND x.turn % 4 = 2) m ON m.conv_id = a.conv_id AND m.upto = a.turn AND m.back <= 8 GROUP BY 1, 2, 3)"""
_REQ = """(SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'ticket' WHEN 1 THEN 'callback' ELSE 'account_change' END AS kind, 'tenant' || (o_custkey % 3) AS client_slug, o_orderpriority AS subject, o_orderdate AS created,
    CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'TKT-' WHEN 1 THEN 'CB-' ELSE 'CHG-' END || (o_orderkey + 1000) AS reference FROM orders)"""
_ACC = "(SELECT c_custkey AS account_id, 'tenant' || (c_nationkey % 3) AS client_slug, 'ACC-' || (c_custkey + 100000) AS identifier, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name, c_mktsegment AS segment FROM customer)"
#: Customers' calls, the accounts and requests that they find, and the numbers of the requests that they make.
_CALLS = f"""WITH one AS (SELECT account_id AS i, client_slug, ['create_ticket', 'request_callback', 'update_account', 'check_ticket', 'lookup_account', 'dance'][account_id % 6 + 1] AS action,
        ['ticket', 'callback', 'account_change', 'request_status', 'account_lookup', 'dance'][account_id % 6 + 1] AS kind, CASE WHEN account_id % 4 <> 0 THEN name END AS subject,
        CASE WHEN account_id % 15 = 0 THEN 'none' ELSE 'tkt ' || (account_id + 1000) END AS asked_reference, CASE WHEN account_id % 21 = 2 THEN '' WHEN account_id % 7 = 3 THEN 'nobody' ELSE lower(identifier) END AS identifier,
        CASE WHEN account_id % 4 = 0 THEN 'P' || account_id END AS new_plan, CASE WHEN account_id % 8 <> 2 THEN 'note ' || account_id END AS change FROM {_ACC}),
    calls AS (SELECT i AS id, * EXCLUDE (i) FROM one UNION ALL SELECT i + 100000000, client_slug, action, kind, subject, asked_reference, identifier, NULL, 'again' FROM one WHERE i % 24 = 14),
    met AS (SELECT c.*, a.account_id, a.name AS a_name, a.identifier AS a_identifier, a.segment AS a_segment, q.reference AS q_reference, q.subject AS q_subject, q.created AS q_created, q.status AS q_status,
        kind IN ('ticket', 'callback') OR kind = 'account_change' AND a.account_id IS NOT NULL AS makes
        FROM calls c LEFT JOIN {_ACC} a ON a.client_slug = c.client_slug AND lower(a.identifier) = c.identifier AND c.kind LIKE 'account%'
        LEFT JOIN (SELECT reference, subject, created, status, client_slug FROM {_REQ}) q ON c.kind = 'request_status' AND q.client_slug = c.client_slug AND q.reference = replace(upper(c.asked_reference), ' ', '-')),
    looked AS (SELECT *, CASE kind WHEN 'ticket' THEN 'TKT-' WHEN 'callback' THEN 'CB-' ELSE 'CHG-' END || (request_id + 1000) AS reference FROM
        (SELECT *, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (PARTITION BY makes ORDER BY id) AS request_id FROM met))"""
_DEMO = "(VALUES " + ", ".join(f"('{dom}', '{i}', '{n}', '{';'.join(f'{k}={v}' for k, v in sorted(data.items()))}')" for dom, i, n, data in tickets.DEMO_ACCOUNTS) + ") AS demo(domain, identifier, name, data)"
_W = rq._W
_QS = lambda n: rf"""list_filter(list_transform(list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[:{n}], lambda x, i: CASE WHEN len(regexp_split_to_array(x, '\s+')) >= 2
    THEN replace([{', '.join(f"'{q}'" for q in t.QUESTIONS)}][(i - 1) % 5 + 1], '{{}}', array_to_string(regexp_split_to_array(x, '\s+')[:5], ' ')) END), lambda x: x IS NOT NULL)"""  # noqa: E731
_STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _retrieved_sql(said: str) -> str:
    """Typed nearest chunks, gated, fused with the keywords of ``said``, reranked by shared words of the question."""
    near = f"""SELECT query_id, chunk_id, distance, rank FROM (SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank, min(distance) OVER (PARTITION BY query_id) AS best
        FROM (SELECT q.query_id, e.vec_id AS chunk_id, e.label, round(list_distance(e.embedding::DOUBLE[], q.vec::DOUBLE[])^2, 6) AS distance, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_distance(e.embedding::DOUBLE[], q.vec::DOUBLE[])^2, 6), e.vec_id) AS r0
        FROM embeddings e, q QUALIFY r0 <= 50) WHERE label <> 1) WHERE best <= 1.55 AND (distance <= 1.3 OR rank <= 1)"""
    words = lambda c: rf"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda w: w <> ''))"
    return rf"""WITH {rq._BM25},
q AS MATERIALIZED (SELECT b.item_id AS query_id, b.text AS query_text, o.text AS reply, e.embedding AS vec FROM benchmark b LEFT JOIN benchmark o ON o.item_id = b.item_id + 1 JOIN embeddings e ON e.vec_id = b.item_id),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower({said}), '[\p{{L}}\p{{N}}_]+')) AS term FROM q) GROUP BY ALL),
sc AS (SELECT query_id, doc_id AS chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25_score
       FROM (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY 1, 2, 3) x JOIN qt USING (term) JOIN idfs USING (term), tot GROUP BY 1, 2),
bm AS (SELECT query_id, chunk_id, bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS bm25_rank FROM sc WHERE bm25_score > 0 QUALIFY bm25_rank <= 50),
{rq._fuse_sql(near)},
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, chunk_id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM fused WHERE query_id IN (SELECT query_id FROM near) QUALIFY rank <= 50),
z AS (SELECT c.query_id, c.chunk_id, c.hybrid_score, c.rank AS r0, least(n, 50) AS n, round(len(list_intersect({words('query_text')}, {words("coalesce(d.text, '')")})) / greatest(1, len({words('query_text')})), 6) AS s FROM c JOIN q ON q.query_id = c.query_id LEFT JOIN documents d ON d.doc_id = c.chunk_id)
SELECT query_id, chunk_id, CASE WHEN n > 5 THEN row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) ELSE r0 END AS rank, round(hybrid_score + 2.5e-7, 5) AS hybrid_score FROM z QUALIFY rank <= 5"""


_GUARDED = rf"CASE WHEN {_STRIPPED.format("coalesce(reply, '')")} = '' OR length({_STRIPPED.format("coalesce(reply, '')")}) > 3 * length(query_text) THEN query_text ELSE {_STRIPPED.format("coalesce(reply, '')")} END"

QUERIES = {
    "escalation_log": (escalation_log, f"SELECT conv_id, turn, client_slug, 'open' AS status, md5(transcript) AS transcript_md5 FROM {_ESC}"),
    "escalation_status": (escalation_status, f"""SELECT * FROM (SELECT conv_id, turn, client_slug, CASE WHEN conv_id % 2 = 0 THEN 'done' ELSE 'open' END AS status, count(*) FILTER (WHERE conv_id % 2 <> 0) OVER (PARTITION BY client_slug) AS n_open FROM {_ESC}) WHERE status = 'done'"""),
    "request_transitions": (request_transitions, f"""SELECT id, kind, client_slug, reference, status, count(*) FILTER (WHERE status = 'open') OVER (PARTITION BY client_slug) AS n_open
        FROM (SELECT * REPLACE (CASE WHEN id % 5 = 0 AND id % 7 <> 0 THEN 'open' ELSE status END AS status) FROM {_REQ})"""),
    "executed_actions": (executed_actions, f"""{_CALLS}
        SELECT id, kind, CASE WHEN makes THEN reference WHEN kind = 'request_status' THEN q_reference END AS reference, CASE
            WHEN kind = 'ticket' THEN 'Logged the request — reference ' || reference || '. A human agent will follow up.'
            WHEN kind = 'callback' THEN 'Logged the callback — reference ' || reference || '. A human agent will follow up.'
            WHEN kind = 'request_status' AND q_reference IS NULL THEN 'No request was found with reference ' || chr(39) || asked_reference || chr(39) || '. Ask the customer to double-check the number.'
            WHEN kind = 'request_status' THEN q_reference || ' (' || q_subject || ') was logged on ' || strftime(q_created, '%b %d, %Y') || ' and is currently ' || CASE WHEN q_status = 'done' THEN 'completed' ELSE 'open (being worked on)' END || '.'
            WHEN kind = 'dance' THEN 'That action isn''t available.'
            WHEN identifier = '' THEN 'I need the account identifier (phone/email/ID) first — please ask the customer for it.'
            WHEN account_id IS NULL THEN 'No account was found for ' || chr(39) || identifier || chr(39) || '. Double-check the details with the customer.'
            WHEN kind = 'account_lookup' THEN 'Account for ' || coalesce(a_name, a_identifier) || ' — market segment: ' || a_segment || CASE WHEN account_id % 5 = 0 THEN '; recent changes: [''a'', ''b'', ''c'', ''d'', ''e'']' ELSE '' END
            ELSE 'Done — ' || CASE WHEN new_plan IS NOT NULL THEN 'plan changed to ' || new_plan ELSE coalesce(change, 'account updated') END || ', confirmed. Reference ' || reference || '.' END AS message FROM looked"""),
    "executed_changes": (executed_changes, f"""{_CALLS},
        notes AS (SELECT account_id, max_by(new_plan, id) FILTER (new_plan IS NOT NULL) AS plan, coalesce(list(change ORDER BY id) FILTER (new_plan IS NULL AND change IS NOT NULL), []) AS said FROM looked WHERE kind = 'account_change' AND makes GROUP BY 1),
        after AS (SELECT a.*, plan, CASE WHEN a.account_id % 5 = 0 OR len(said) > 0 THEN (CASE WHEN a.account_id % 5 = 0 THEN ['a', 'b', 'c', 'd', 'e'] ELSE [] END || coalesce(said, []))[-5:] END AS recent FROM {_ACC} a LEFT JOIN notes USING (account_id))
        SELECT 'account' AS kind, account_id AS id, client_slug, 'market_segment=' || segment || coalesce(';plan=' || plan, '') || '|' || coalesce(array_to_string(recent, ','), '-') AS state FROM after
        UNION ALL SELECT kind, id, client_slug, reference || '|' || subject || '|' || status FROM {_REQ}
        UNION ALL SELECT kind, request_id, client_slug, reference || '|' || coalesce(subject, action) || '|open' FROM looked WHERE makes"""),
    "account_upsert": (account_upsert, f"""WITH g AS (SELECT 'tenant' || (s_nationkey % 3) AS client_slug, 'No ' || (s_suppkey + CASE WHEN s_suppkey % 2 = 0 THEN 100000 ELSE 900000 END) AS identifier, s_name AS name, s_nationkey AS nation FROM supplier),
        h AS (SELECT g.*, a.account_id FROM g LEFT JOIN {_ACC} a ON a.client_slug = g.client_slug AND regexp_replace(a.identifier, '[^0-9]', '', 'g') = regexp_replace(g.identifier, '[^0-9]', '', 'g'))
        SELECT a.account_id, a.client_slug, a.identifier, coalesce(h.name, a.name) AS name, 'market_segment=' || segment || coalesce(';nation=' || nation, '') AS data FROM {_ACC} a LEFT JOIN h ON h.account_id = a.account_id
        UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY client_slug, identifier), client_slug, identifier, name, 'nation=' || nation FROM h WHERE account_id IS NULL"""),
    "demo_accounts": (demo_accounts, f"""SELECT client_slug, identifier, name, 'market_segment=' || segment AS data FROM {_ACC} WHERE client_slug NOT IN ('tenant0', 'tenant1')
        UNION ALL SELECT CASE domain WHEN 'telecom' THEN 'tenant0' ELSE 'tenant1' END, identifier, name, data FROM {_DEMO} WHERE domain IN ('telecom', 'generic')"""),
    "knowledge_cards": (knowledge_cards, """SELECT client_slug, 'kb_' || left(md5(text), 12) AS document_id, text, title, 'learned' AS category, tags FROM (SELECT *, title || chr(10) || 'Questions:' || chr(10) || '- Q' || item_id || chr(10) || '- another' || CASE WHEN tags = '' THEN '' ELSE chr(10) || 'Tags: a, b' END AS text
        FROM (SELECT item_id, 'tenant' || (item_id % 3) AS client_slug, CASE WHEN item_id % 5 = 0 THEN 'Q' || item_id ELSE 'T' END AS title, CASE WHEN item_id % 6 = 0 THEN '' ELSE 'a,b' END AS tags FROM benchmark WHERE item_id % 4 <> 0))"""),
    "message_flatten": (message_flatten, "SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN text ELSE text || text END) AS text_md5 FROM conversations UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, 0, md5('{x}'))" for i, (_, x) in enumerate(_PARTS)) + ") AS f(conv_id, turn, text_md5)"),
    "source_footer": (source_footer, f"""SELECT conv_id, turn, md5({_STRIPPED.format('text')} || CASE WHEN turn % 5 = 0 THEN '' ELSE chr(10) || chr(10) || '📚 *Sources:*' || array_to_string([chr(10) || '  1. a.pdf', chr(10) || '  2. b.json', chr(10) || '  3. c.html'][:least(turn % 5, 3)], '') END) AS answer_md5
        FROM conversations WHERE role = 'assistant'"""),
    "question_chunks": (question_chunks, f"""SELECT item_id::VARCHAR AS chunk_id, NULL::VARCHAR AS source_chunk_id, 'chunk' AS content_type, md5(text) AS text_md5 FROM benchmark
        UNION ALL SELECT item_id || '_q' || i, item_id::VARCHAR, 'question', md5(q) FROM (SELECT item_id, unnest(l) AS q, unnest(range(len(l))) AS i FROM (SELECT item_id, {_QS(2)} AS l FROM benchmark))"""),
    "given_questions": (given_questions, f"SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'What is ' || item_id || '?|Why so?|When?' ELSE array_to_string({_QS(3)}, '|') END AS questions FROM benchmark"),
    "agent_retrieval": (_retrieved(None), _retrieved_sql("query_text")),
    "hyde_retrieval": (_retrieved("hyde"), _retrieved_sql(r"CASE WHEN trim(coalesce(reply, '')) = '' THEN query_text ELSE trim(reply) END")),
    "rewritten_retrieval": (_retrieved("rewrite"), _retrieved_sql(_GUARDED)),
    "multi_query_retrieval": (multi_query_retrieval, f"""SELECT query_id, chunk_id, rrf_score, appearances, best_rank FROM (
        SELECT query_id // 3 AS query_id, chunk_id, round(sum((CASE WHEN query_id % 3 = 0 AND (query_id // 3) % 2 = 0 THEN 1.5 ELSE 1.0 END)::DOUBLE / (60 + rank - 1)), 6) AS rrf_score, count(*) AS appearances, min(rank - 1) AS best_rank
        FROM ({rq._knn_sql(1 << 60, 10, '(q.vec_id // 3) % 100 = 0')}) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) <= 6"""),
    "gap_self_heal": (gap_self_heal, f"SELECT 't' || (vec_id % 3) AS client_slug, vec_id AS position FROM embeddings WHERE vec_id % 100 = 0 AND vec_id NOT IN (SELECT query_id FROM ({rq._knn_sql(1 << 60, 1, 'e.vec_id <> q.vec_id AND q.vec_id % 100 = 0')}) WHERE distance <= 1.2)"),
    "index_statistics": (index_statistics, """WITH c AS (SELECT coalesce(source, 'none') AS client_slug, coalesce(lang, 'none') AS document_id, doc_id, text, vec_id FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
        p AS (SELECT client_slug, md5(string_agg(left(text, 100), '|' ORDER BY doc_id)) AS previews_md5 FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY client_slug ORDER BY doc_id) <= 50) GROUP BY 1)
        SELECT client_slug, count(DISTINCT document_id) AS n_files, count(*) AS n_chunks, count(vec_id) AS n_embeddings, any_value(previews_md5) AS previews_md5 FROM c JOIN p USING (client_slug) GROUP BY 1"""),
    "active_sessions": (active_sessions, """SELECT strftime(day, '%Y-%m-%d') AS day, count(DISTINCT user_id) FILTER (WHERE ts <= day + INTERVAL 12 HOURS AND ts > day + INTERVAL 690 MINUTES) AS n_active
        FROM (SELECT DISTINCT date_trunc('day', ts) AS day FROM events), events GROUP BY 1"""),
    "command_messages": (command_messages, "SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'help' WHEN turn % 4 = 2 THEN 'clear' WHEN lower(trim(text)) IN ('help', '/help') THEN 'help' END AS command FROM conversations WHERE role = 'user'"),
}
