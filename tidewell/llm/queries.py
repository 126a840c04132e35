"""The registered ``opN_<name>`` queries: each runs its operator over its whole table with production parameters."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import (
    ann, chat, language_id, line_dedup, minhash_forest, packing, periodic_runs, piece_sampling, progressive_jpeg, repetition, sharding, token_counts, whitening)
from tidewell.llm.common import table, text_or_empty

N_SHARDS = 24
TOKEN_LIMIT = 512


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = progressive_jpeg.decode_media(progressive_jpeg.encode_payloads(table(spark, sf_dir, "documents")))
    tail = F.expr("substring(payload, -64, 64)")
    return media.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "height", "width"), F.array_join(F.transform("rgb_sums", lambda x: x.cast("string")), ","), F.hex(F.crc32("rgb"))).alias("feature"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.jaccard_classes(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    model = language_id.train(docs, usable=fold != 0)
    found = language_id.identify(docs, model, spans=False)
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.lpt_shards(table(spark, sf_dir, "documents"), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = r"</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT conv_id, turn, role, '{marked}' AS text FROM VALUES (-7L, 0L, 'user'), (-7L, 1L, 'assistant') AS t(conv_id, turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    windows = chat.format_windows(turns).select(
        "conv_id", "window", chat.parse_window(F.col("formatted"), F.col("n_repeated")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss"), F.char_length("formatted").alias("chars"))
    ordered = F.sort_array(F.collect_list(F.struct("window", "turns", "loss")))
    whole = windows.groupBy("conv_id").agg(ordered.alias("w"), F.sum("chars").alias("formatted_chars"))
    turns = F.flatten(F.transform("w", lambda x: x["turns"]))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("input_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                       F.sha2(text_or_empty().cast("binary"), 256).alias("kept_sha256"))


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = piece_sampling.sample_segmentations(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), decode=True)
    return decoded.select("doc_id", "sample", "n_pieces", F.crc32("input_ids").alias("ids_crc32"), "log_prob", "perturbed", "log_inclusion",
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def made_periodic(doc_id: int | None, words: list[str]) -> list[str]:
    """Words of every tenth document from some place on repeat with a period of some part of their number."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), prepare=made_periodic)
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judged(repetition.measure_repetition(table(spark, sf_dir, "documents"))).drop("longest_repeat")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def _op7_sql() -> str:
    rest = "|".join(re.sub(r"([|\]])", r"\\\1", c[1:]) for c in chat.CONTROL)
    escaped = lambda c: rf"regexp_replace(replace({c}, '\', '\\'), '([<\[])({rest})', '\1\\\2', 'g')"
    marks = len(chat.TURN) + len(chat.TEXT) + len(chat.END)
    return f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
    (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')),
w AS (SELECT *, {escaped('role')} || {escaped('text')} AS body FROM t),
s AS (SELECT *, length(body) + {marks} AS len, (strlen(body) + {marks} + 3) // 4 AS tok FROM w),
o AS (SELECT *, row_number() OVER c AS pos, sum(tok) OVER c - tok AS start FROM s WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
y AS (SELECT conv_id, min(pos) AS s_pos, min_by(len, pos) AS s_len, min_by(tok, pos) AS s_tok FROM o WHERE role = 'system' GROUP BY 1),
a AS MATERIALIZED (SELECT o.conv_id, pos, start, tok, len, start // {chat.BLOCK_BUDGETS * chat.BUDGET} AS block, greatest({chat.BUDGET - chat.HISTORY} - coalesce(s_tok, 0), 0) AS room, s_pos, s_len
    FROM o LEFT JOIN y ON o.conv_id IS NOT DISTINCT FROM y.conv_id),
r AS (SELECT conv_id, pos, block, pos AS win, start AS w_start, tok AS used FROM a WHERE pos = 1
    UNION ALL SELECT a.conv_id, a.pos, a.block, CASE WHEN fits THEN r.win ELSE a.pos END, CASE WHEN fits THEN r.w_start ELSE a.start END, CASE WHEN fits THEN r.used + a.tok ELSE a.tok END
    FROM r JOIN (SELECT * FROM a) a ON a.conv_id IS NOT DISTINCT FROM r.conv_id AND a.pos = r.pos + 1, LATERAL (SELECT a.block = r.block AND r.used > 0 AND r.used + a.tok <= a.room AS fits)),
b AS (SELECT conv_id, win, any_value(w_start) AS w_start, max(used) AS own FROM r GROUP BY 1, 2),
v AS (SELECT b.*, room, s_pos, s_len FROM b JOIN a ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.pos = b.win),
again AS (SELECT v.conv_id, sum(a.len) AS n FROM v JOIN a ON a.conv_id IS NOT DISTINCT FROM v.conv_id AND a.pos < v.win AND v.w_start - a.start <= {chat.HISTORY}
    WHERE own <= v.room AND NOT coalesce(a.pos = v.s_pos, false) GROUP BY 1),
sys AS (SELECT conv_id, sum(s_len) AS n FROM v WHERE s_pos < win GROUP BY 1),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss, sum(len) AS n FROM o GROUP BY 1)
SELECT g.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, (g.n + coalesce(again.n, 0) + coalesce(sys.n, 0))::BIGINT AS formatted_chars
FROM g LEFT JOIN again ON g.conv_id IS NOT DISTINCT FROM again.conv_id LEFT JOIN sys ON g.conv_id IS NOT DISTINCT FROM sys.conv_id
"""


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) s),
keys AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, keys.k IS NOT NULL AND l.doc_id <> keeper AS gone FROM lines l LEFT JOIN keys ON l.k = keys.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP12_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
p AS (SELECT r, len(words) AS n, words, unnest(range(1, len(words) + 1)) AS i FROM w),
k AS (SELECT p.*, v.k FROM p, (VALUES ({repetition.WINDOW}), ({repetition.MIN_REPEAT}), ({repetition.LONGEST + 1})) AS v(k) WHERE i + v.k - 1 <= n),
h AS (SELECT r, n, k, i, words[i:i + k - 1] AS piece FROM k),
twice AS (SELECT r, k, unnest(places) AS i FROM (SELECT r, k, list(i) AS places FROM h GROUP BY r, k, piece HAVING count(*) > 1)),
inside AS (SELECT p.r, p.i, s.k FROM p JOIN (SELECT r, k, i, coalesce(lead(i) OVER (PARTITION BY r, k ORDER BY i), n + 1) AS next FROM twice JOIN (SELECT r, len(words) AS n FROM w) USING (r)) s
    ON p.r = s.r AND p.i >= s.i AND p.i < least(s.i + s.k, s.next)),
counted AS (SELECT r, count(*) FILTER (k = {repetition.WINDOW}) AS n_repeat_words, count(*) FILTER (k = {repetition.MIN_REPEAT}) AS n_covered, count(*) FILTER (k = {repetition.LONGEST + 1}) AS n_long FROM inside GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_covered, 0)::BIGINT AS n_covered, coalesce(n_long, 0) AS n_long
    FROM w LEFT JOIN counted USING (r) LEFT JOIN lines USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, base_failed,
    NOT base_failed AND 100 * n_covered <= {repetition.COVERED_PERCENT} * n_words AND n_long = 0 AS kept
FROM (SELECT *, n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {repetition.BASE_PERCENT} * n_words AS base_failed FROM base)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_windows": _op7_sql(), "op9_line_dedup": OP9_SQL, "op12_repetition_rules": OP12_SQL}
