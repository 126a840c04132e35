"""JSON, enrichment, chunking and model-guard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import models
from tidewell.operators import chunking, json_records as j

_R = lambda spark, d, name: spark.read.parquet(f"{d}/{name}.parquet")


def json_object_to_text(spark, d):
    e = _R(spark, d, "events")
    text = j.fields_as_text([F.col("event_type")], {"user_id": F.col("user_id"), "k": F.get_json_object("props", "$.k")})
    return e.select("event_id", text.alias("text"))


def json_open_schema(spark, d):
    """The same objects through the open-schema function."""
    e = _R(spark, d, "events").select("event_id", F.to_json(F.struct("event_type", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("obj"))
    return j.objects_as_text(e, "obj", ["event_type"]).select("event_id", "text")


def json_grouping(spark, d):
    return j.grouped(json_object_to_text(spark, d).join(_R(spark, d, "events").select("event_id", "user_id"), "event_id"), 5, order="event_id", per="user_id").select(
        "user_id", "group_no", "n_objects", "first_event_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_CATS, _TAGS = ["data", "social", "roaming", "other"], ["daily", "budget", "low_latency", "plain_tag"]


def semantic_enrichment(spark, d):
    """Parts as packages."""
    p = _R(spark, d, "part")
    pick = lambda names, c: F.get(F.array(*map(F.lit, names)), (c % len(names)).cast("int"))
    key = F.col("p_partkey")
    tags = F.when(key % 5 != 0, F.array(pick(_TAGS, key), pick(_TAGS, key + 1)))
    head = j.header(name=F.when(key % 11 != 0, F.col("p_name")), category=pick(_CATS, key), price=(F.col("p_partkey") * 7 % 2000), days=F.when(key % 3 == 0, F.lit(7)).when(key % 3 == 1, F.col("p_size")), tags=tags)
    return p.select("p_partkey", F.md5(j.enriched(F.col("p_type"), head).cast("binary")).alias("enriched_md5"))


def nested_metadata_filter(spark, d):
    """Every other event states its number as text, which the number 7 doesn't match."""
    k = F.get_json_object("props", "$.k")
    stated = lambda v: F.to_json(F.struct(F.struct(v.alias("k"), F.col("event_type").alias("kind")).alias("meta")))
    wrapped = F.when(F.col("event_id") % 2 == 0, stated(k)).otherwise(stated(k.cast("int")))
    return _R(spark, d, "events").where(j.matches(wrapped, {"meta.k": 7, "meta.kind": "click"})).select("event_id")


MOODS = ("neutral", "happy", "confused", "frustrated", "angry", "bored")


def mood_replies(spark, d):
    """A model's reply to every message: moods in turn, one of them unknown, intensities from 0 to 8; every fifth reply is the message itself."""
    c = _R(spark, d, "conversations")
    mood = F.get(F.array(*map(F.lit, MOODS)), (F.col("conv_id") % 6).cast("int"))
    stated = F.concat(F.lit('Sure: {"emotion": "'), mood, F.lit('", "intensity": '), F.col("conv_id") % 9, F.lit(', "wants_human": '), (F.col("turn") % 2 == 0).cast("string"), F.lit("}\nok"))
    return c.select("conv_id", "turn", j.mood_reply(F.when(F.col("turn") % 5 == 0, F.replace("text", F.lit("{"), F.lit(""))).otherwise(stated)).alias("m")).select("conv_id", "turn", "m.emotion", "m.intensity", "m.wants_human")


def rewrite_guard(spark, d):
    """Every benchmark item with its neighbour's text as the rewrite; those of every third number are asked as their first word, which most rewrites are too long for."""
    b = _R(spark, d, "benchmark").withColumn("asked", F.when(F.col("item_id") % 3 == 0, F.element_at(F.split("text", " "), 1)).otherwise(F.col("text")))
    other = b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("other"))
    said = models.guarded_rewrite(F.col("asked"), F.col("other"))
    return b.join(other, "item_id", "left").select("item_id", F.md5(said.cast("binary")).alias("said_md5"))


def variations_parse(spark, d):
    """Variations of a question for every message: numbered, quoted, repeated in capitals, too short, the question itself; every third reply is empty."""
    c = _R(spark, d, "conversations")
    query, n = F.concat(F.lit("Plan "), F.col("conv_id")), F.col("turn")
    reply = F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("1. more about "), n, F.lit("\n2) MORE About "), n, F.lit("\n\n3- \"best of "), n, F.lit("\"\nx\n4. plan "), F.col("conv_id"), F.lit("\nlast "), n))
    return c.select("conv_id", "turn", F.array_join(models.query_variations(query, reply, 3), "|").alias("variations"))


def topic_chunks(spark, d):
    return chunking.chunk_documents(_R(spark, d, "documents"))


def topic_chunk_stats(spark, d):
    from tidewell.operators.structure import chunk_statistics

    return chunk_statistics(chunking.chunk_documents(_R(spark, d, "documents")))


def parent_child_chunks(spark, d):
    parents, children = chunking.parent_child(_R(spark, d, "documents"))
    return children.join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id", "left").select("doc_id", "chunk_id", "parent_id", F.char_length("parent_text").alias("parent_chars"))


def embedded_chunks(spark, d):
    return models.embedded(_R(spark, d, "benchmark"), models.hash_embedder).select("item_id", F.size("embedding").alias("dimension"))


def gap_clusters(spark, d):
    """Every vector is an open question of one of eight tenants."""
    from tidewell.operators.learning import gap_clusters as fold

    e = _R(spark, d, "embeddings").select(F.concat(F.lit("t"), F.col("vec_id") % 8).alias("client_slug"), F.col("vec_id").alias("recency_key"), F.concat(F.lit("Question "), F.col("label")).alias("question"),
                                          F.col("embedding").cast("array<double>").alias("vec"))
    return fold(e, 0.3).select("client_slug", "position", "representative", "n")


def webhook_messages(spark, d):
    """Conversations wrapped as webhook envelopes and taken apart again."""
    from tidewell.sources.files import webhook_messages as parse

    c = _R(spark, d, "conversations").where("role = 'user'")
    message = F.struct(F.lit("text").alias("type"), F.col("conv_id").cast("string").alias("from"), F.col("turn").cast("string").alias("id"), F.struct(F.col("text").alias("body")).alias("text"))
    value = F.struct(F.struct(F.lit("77").alias("phone_number_id")).alias("metadata"), F.array(message).alias("messages"))
    payload = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(value.alias("value"))).alias("changes"))).alias("entry")))
    return parse(c.select(payload.alias("payload"))).select("phone_number_id", "sender", "message_id", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def page_texts(spark, d):
    from tidewell.sources.html import page_text

    return page_text(_R(spark, d, "pages"))


_PICK = lambda names, e: "[" + ", ".join(f"'{n}'" for n in names) + f"][({e}) % {len(names)} + 1]"
_CATW = "CASE c " + " ".join(f"WHEN '{k}' THEN ' ({', '.join(v)})'" for k, v in j.CATEGORY_WORDS.items()) + " ELSE '' END"
_TAGW = "CASE t " + " ".join(f"WHEN '{k}' THEN ' ({', '.join(v)})'" for k, v in j.TAG_WORDS.items()) + " ELSE '' END"
_TITLE = "array_to_string(list_transform(string_split(t, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"
_TAG_SQL = "array_to_string(list_transform(tags, lambda t: " + _TITLE + " || " + _TAGW + "), ' | ')"

QUERIES = {
    "json_object_to_text": (json_object_to_text, "SELECT event_id, event_type || chr(10) || 'User Id: ' || user_id || chr(10) || 'K: ' || (props->>'$.k') AS text FROM events"),
    "json_open_schema": (json_open_schema, "SELECT event_id, event_type || chr(10) || 'User Id: ' || user_id || chr(10) || 'K: ' || (props->>'$.k') AS text FROM events"),
    "json_grouping": (json_grouping, """WITH t AS (SELECT event_id, user_id, event_type || chr(10) || 'User Id: ' || user_id || chr(10) || 'K: ' || (props->>'$.k') AS text, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5)::INT AS group_no FROM events)
        SELECT user_id, group_no, count(*)::INT AS n_objects, min(event_id) AS first_event_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY event_id)) AS text_md5 FROM t GROUP BY 1, 2"""),
    "semantic_enrichment": (semantic_enrichment, f"""WITH p AS (SELECT *, {_PICK(_CATS, 'p_partkey')} AS c, p_partkey * 7 % 2000 AS price, CASE p_partkey % 3 WHEN 0 THEN 7 WHEN 1 THEN p_size END AS days, CASE WHEN p_partkey % 5 <> 0 THEN [{_PICK(_TAGS, 'p_partkey')}, {_PICK(_TAGS, 'p_partkey + 1')}] END AS tags FROM part)
        SELECT p_partkey, md5(concat_ws(chr(10), CASE WHEN p_partkey % 11 <> 0 THEN '📦 ' || p_name END, 'Category: ' || c || {_CATW}, '💰 Price: LKR ' || price || chr(10) || CASE WHEN price < 500 THEN '{j.PRICE_TIERS[0][1]}' WHEN price < 1500 THEN '{j.PRICE_TIERS[1][1]}' ELSE '{j.PRICE_TOP}' END,
        '⏱️ Validity: ' || CASE days WHEN 1 THEN '{j.VALIDITY[1]}' WHEN 7 THEN '{j.VALIDITY[7]}' WHEN 30 THEN '{j.VALIDITY[30]}' ELSE days || ' days' END, '🏷️ Features: ' || {_TAG_SQL}) || chr(10) || chr(10) || repeat('=', 60) || chr(10) || chr(10) || p_type) AS enriched_md5 FROM p"""),
    "nested_metadata_filter": (nested_metadata_filter, "SELECT event_id FROM events WHERE event_id % 2 <> 0 AND (props->>'$.k') = '7' AND event_type = 'click'"),
    "mood_replies": (mood_replies, """SELECT conv_id, turn, CASE WHEN turn % 5 = 0 OR conv_id % 6 = 5 THEN 'neutral' ELSE ['neutral', 'happy', 'confused', 'frustrated', 'angry'][conv_id % 6 + 1] END AS emotion,
        CASE WHEN turn % 5 = 0 THEN 1 ELSE greatest(least(conv_id % 9, 5), 1) END::INT AS intensity, turn % 5 <> 0 AND turn % 2 = 0 AS wants_human FROM conversations"""),
    "rewrite_guard": (rewrite_guard, r"""SELECT b.item_id, md5(CASE WHEN coalesce(s, '') = '' OR length(s) > 3 * length(asked) THEN asked ELSE s END) AS said_md5
        FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN string_split(text, ' ')[1] ELSE text END AS asked FROM benchmark) b
        LEFT JOIN (SELECT item_id + 1 AS item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM benchmark) o ON b.item_id = o.item_id"""),
    "variations_parse": (variations_parse, "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Plan ' || conv_id ELSE 'more about ' || turn || '|best of ' || turn || '|plan ' || conv_id || '|last ' || turn END AS variations FROM conversations"),
    "topic_chunks": (topic_chunks, None),
    "topic_chunk_stats": (topic_chunk_stats, None),
    "parent_child_chunks": (parent_child_chunks, None),
    "embedded_chunks": (embedded_chunks, "SELECT item_id, 384 AS dimension FROM benchmark"),
    "gap_clusters": (gap_clusters, None),
    "webhook_messages": (webhook_messages, "SELECT '77' AS phone_number_id, conv_id::VARCHAR AS sender, turn::VARCHAR AS message_id, md5(text) AS body_md5 FROM conversations WHERE role = 'user' AND text <> ''"),
    "page_texts": (page_texts, None),
}
