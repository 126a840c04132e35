"""Text, structure and keyword queries over ``documents`` (and a small fixture that makes every rule fire)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as t
from tidewell.operators import structure as s

_N = "' || chr(10) || '"
#: Texts that the driver's tables lack: headings, lists, tables, code, page numbers, contents, dashes; the same rows in both engines.
FIXTURES = [
    f"# Service Guide{_N}Our plans are simple – and fast.{_N}{_N}Data Plans{_N}- daily plan{_N}- weekly plan{_N}{_N}| name | price |{_N}| a | 2 |",
    f"BILLING{_N}Pay by card or cash. Mr. Silva knows more. Dr. Perera too!{_N}{_N}```code here```{_N}{_N}1. first{_N}2. second",
    f"Table of Contents{_N}Intro ........ 3{_N}Page 2 of 9{_N}The quick bro-{_N}wn fox   jumps over{_N}{_N}{_N}{_N}the lazy dog.{_N}12{_N}End",
    f"Chapter 1: Roaming{_N}Roaming data works abroad. Roaming data works daily.{_N}Section 2: Travel{_N}Travel data works abroad too. What is it? Nothing.",
    f"Work Experience{_N}Built things at Acme Corp. since then{_N}{_N}*{_N}{_N}---{_N}{_N}a) letter item",
]
_FIX = "SELECT * FROM (VALUES " + ", ".join(f"(CAST({-1 - i} AS BIGINT), '{x}')" for i, x in enumerate(FIXTURES)) + ") AS f(doc_id, text)"
_DOCS = f"(SELECT doc_id, text FROM documents UNION ALL {_FIX})"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").unionByName(spark.sql(_FIX))


def clean_text_steps(spark, d):
    c = t.clean(F.col("text"))
    return _docs(spark, d).select("doc_id", F.md5(c.cast("binary")).alias("clean_md5"), F.char_length(c).cast("long").alias("clean_chars"), F.md5(t.fix_ocr(F.col("text")).cast("binary")).alias("ocr_md5"))


def token_estimate(spark, d):
    return _docs(spark, d).select("doc_id", t.token_count(F.col("text")).alias("n_tokens"), F.md5(t.truncate_tokens(F.col("text"), 50).cast("binary")).alias("cut_md5"))


def _lines(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def heading_detect(spark, d):
    return _lines(spark, d).select("doc_id", "pos", t.heading(F.col("line")).alias("heading")).where("heading IS NOT NULL")


def list_table_predicates(spark, d):
    return _lines(spark, d).select("doc_id", "pos", t.is_list(F.col("line")).alias("is_list"), t.is_table(F.col("line")).alias("is_table"), t.is_code(F.col("line")).alias("is_code"))


def section_types(spark, d):
    return _docs(spark, d).select("doc_id", t.section_type(F.col("text")).alias("section_type"))


def structure_parse(spark, d):
    """A single line break separates blocks here; the documents have no blank lines."""
    return s.segments(_docs(spark, d), separator=r"\n").select("doc_id", "pos", "type", "heading", "subheading", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def keywords_topn(spark, d):
    return s.keyword_counts(_docs(spark, d))


def tfidf(spark, d):
    return s.tf_idf(_docs(spark, d))


def jaccard_adjacent(spark, d):
    return s.adjacent(s.segments(_docs(spark, d), separator=r"\n")).select("doc_id", "pos", "similarity")


def topic_boundaries(spark, d):
    return s.adjacent(s.segments(_docs(spark, d), separator=r"\n")).where("boundary").select("doc_id", "pos")


def weighted_similarity(spark, d):
    return s.adjacent(s.segments(_docs(spark, d), separator=r"\n"), weighted=True).select("doc_id", "pos", "similarity")


def sentence_split(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("sentence_no", "sentence"))


def simple_questions(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(t.simple_questions(F.col("text"))).alias("question_no", "question"))


def chunk_id_md5(spark, d):
    return _lines(spark, d).select("doc_id", "pos", t.chunk_id(F.col("doc_id"), F.col("pos"), F.col("line")).alias("chunk_id"))


def chunk_stats(spark, d):
    return s.chunk_statistics(_docs(spark, d))


def parent_assignment(spark, d):
    """Lines are children, every third of their number a parent."""
    n = F.size(F.split("text", "\n"))
    kids = _docs(spark, d).select("doc_id", n.alias("c"), F.posexplode(F.split("text", "\n")).alias("child", "line"))
    return kids.select("doc_id", "child", t.parent_index(F.col("child"), F.col("c"), F.ceil(F.col("c") / 3)).alias("parent"))


_PAGES = f"""SELECT * FROM (VALUES (1, 1, 'Annual Report{_N}First page text{_N}Confidential'), (1, 2, 'Annual Report{_N}Second page text{_N}Confidential'), (1, 3, 'Summary{_N}Third page text{_N}Confidential'),
  (1, 4, 'Annual Report'), (2, 1, 'Top{_N}a{_N}Bottom'), (2, 2, 'Top{_N}b{_N}Bottom'), (3, 1, 'x'), (3, 2, 'y'), (3, 3, 'z')) AS p(doc_id, page, text)"""


def header_footer_removal(spark, d):
    """Documents of one source are the pages of a book, beside a fixture that has repeated edges."""
    book = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("b-"), F.coalesce("source", F.lit(""))).alias("doc_id"), F.col("doc_id").alias("page"), "text")
    few = spark.sql(_PAGES).select(F.concat(F.lit("f-"), F.col("doc_id")).alias("doc_id"), F.col("page").cast("long").alias("page"), "text")
    return s.remove_repeated_edges(book.unionByName(few)).select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def markdown_tables(spark, d):
    """The nations of each region as a table; every row of an odd key lacks its last cell."""
    nation = spark.read.parquet(f"{d}/nation.parquet")
    cells = F.array(F.col("n_nationkey").cast("string"), F.concat(F.col("n_name"), F.lit("|x")), F.lit(None).cast("string"))
    rows = nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, cells).otherwise(F.slice(cells, 1, 2)).alias("r")))).alias("rows"))
    head = F.array(F.array(F.lit("key"), F.lit("name"), F.lit("note")))
    return rows.select("n_regionkey", t.markdown_table(F.concat(head, F.transform("rows", lambda x: x["r"]))).alias("markdown"))


_RW = r"[\p{L}\p{N}_]"
_OCR = rf"""replace(translate(regexp_replace(regexp_replace(regexp_replace(text, '({_RW}+)-\s*\n\s*({_RW}+)', '\1\2', 'g'), '  +', ' ', 'g'), '({_RW})\n({_RW})', '\1 \2', 'g'), '–—', '--'), '…', '...')"""
_CLEAN = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 regexp_replace(regexp_replace(regexp_replace({_OCR}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'),
 '(?i)\n\s*(?:Page\s*)?\d+\s*(?:of\s*\d+)?\s*\n', chr(10), 'g'), '(?m)^\s*\d{{1,3}}\s*$', '', 'g'),
 '(?im)^Table\s+of\s+Contents?\s*\n', '', 'g'), '(?m)^.+\.{{3,}}\s*\d+\s*$', '', 'g'), '^\s+|\s+$', '', 'g')"""
_LINES = f"(SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {_DOCS}))"
_STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_HEAD = lambda x: f"CASE WHEN {_STRIP(x)} <> '' AND length({_STRIP(x)}) <= 100 THEN {_STRIP('coalesce(' + ', '.join(f'''nullif(regexp_extract({_STRIP(x)}, '{p}', 1), '')''' for p in t.HEADINGS) + ')')} END"
_IS_LIST = lambda x: rf"regexp_matches({x}, '(?m)^\s*([-•*]|\d+[.)]|[a-z][.)])[ \t]+')"
_IS_TABLE = lambda x: rf"(regexp_matches({x}, '\|.+\|') OR regexp_matches({x}, '^\s*[-+]+\s*$'))"
_IS_CODE = lambda x: rf"regexp_matches({x}, '```[\s\S]*?```|`[^`]+`')"
_STOP = "[" + ", ".join(f"'{w}'" for w in t.STOPWORDS) + "]"
_WORDS = lambda x: rf"list_filter(regexp_extract_all(lower({x}), '{_RW}+'), lambda w: regexp_matches(w, '^[a-z]{{3,}}$') AND NOT list_contains({_STOP}, w))"
_UNIQ = lambda ws: f"list_filter({ws}, lambda x, i: list_position({ws}, x) = i)"
_JAC = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"
_SEG = f"""
blk AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p0) - 1 AS pos, b FROM (SELECT doc_id, pos AS p0, {_STRIP('line')} AS b FROM {_LINES}) WHERE b <> ''),
kin AS (SELECT doc_id, pos, b, h, CASE WHEN {_IS_CODE('b')} THEN 'code' WHEN {_IS_TABLE('b')} THEN 'table' WHEN h IS NOT NULL THEN 'heading' WHEN {_IS_LIST('b')} THEN 'list' ELSE 'paragraph' END AS kind
        FROM (SELECT *, {_HEAD('b')} AS h FROM blk)),
sta AS (SELECT *, kind = 'heading' AND (starts_with(b, '# ') OR (upper(b) = b AND lower(b) <> b)) AS great FROM kin),
seg AS (SELECT doc_id, pos, kind AS type, b AS content, hd AS heading, sub AS subheading FROM (
  SELECT *, coalesce(last_value(CASE WHEN great THEN h END IGNORE NULLS) OVER w, '') AS hd, coalesce(last_value(CASE WHEN great THEN '' WHEN kind = 'heading' THEN h END IGNORE NULLS) OVER w, '') AS sub
  FROM sta WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) WHERE kind <> 'heading')"""
_ADJ = f"""{_SEG},
sw AS (SELECT *, {_WORDS('content')} AS ws FROM seg),
sk AS (SELECT doc_id, pos, content, heading, list_transform(list_sort(list_transform({_UNIQ('ws')}, lambda w, i: {{'n': -len(list_filter(ws, lambda x: x = w)), 'i': i, 'w': w}}))[:15], lambda z: z.w) AS keys FROM sw),
adj AS (SELECT *, lag(content) OVER o AS previous, lag(keys) OVER o AS pk, lag(heading) OVER o AS ph FROM sk WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
sim AS (SELECT *, round({_JAC('pk', 'keys')}, 6) AS similarity FROM adj WHERE previous IS NOT NULL)"""
_ENT = lambda x: rf"list_distinct(list_filter(regexp_extract_all({x}, '{_RW}+'), lambda w: regexp_matches(w, '^[A-Z][a-z]+$')))"
_BI = lambda ws: f"list_distinct(list_transform(range(1, greatest(len({ws}), 1)), lambda i: {ws}[i] || '_' || {ws}[i + 1]))"
_ABBR = "(" + ", ".join(f"'{a}'" for a in t.ABBREVIATIONS) + ")"
_QUEST = "[" + ", ".join(f"'{q}'" for q in t.QUESTIONS) + "]"
_SECT = "CASE " + " ".join(f"WHEN regexp_matches(f, '(?i)^({p})') THEN '{n}'" for n, p in t.SECTIONS.items()) + " END"

QUERIES = {
    "clean_text_steps": (clean_text_steps, f"SELECT doc_id, md5(c) AS clean_md5, length(c) AS clean_chars, md5({_OCR}) AS ocr_md5 FROM (SELECT doc_id, text, {_CLEAN} AS c FROM {_DOCS})"),
    "token_estimate": (token_estimate, f"SELECT doc_id, length(text) // 4 AS n_tokens, md5(left(text, 200)) AS cut_md5 FROM {_DOCS}"),
    "heading_detect": (heading_detect, f"SELECT doc_id, pos, h AS heading FROM (SELECT doc_id, pos, {_HEAD('line')} AS h FROM {_LINES}) WHERE h IS NOT NULL"),
    "list_table_predicates": (list_table_predicates, f"SELECT doc_id, pos, {_IS_LIST('line')} AS is_list, {_IS_TABLE('line')} AS is_table, {_IS_CODE('line')} AS is_code FROM {_LINES}"),
    "section_types": (section_types, f"SELECT doc_id, {_SECT} AS section_type FROM (SELECT doc_id, {_STRIP('string_split(' + _STRIP('text') + ', chr(10))[1]')} AS f FROM {_DOCS})"),
    "structure_parse": (structure_parse, f"WITH {_SEG} SELECT doc_id, pos, type, heading, subheading, md5(content) AS content_md5 FROM seg"),
    "keywords_topn": (keywords_topn, f"""SELECT doc_id, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS rank
        FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (SELECT doc_id, {_WORDS('text')} AS ws FROM {_DOCS})) GROUP BY doc_id, word QUALIFY rank <= 15"""),
    "tfidf": (tfidf, f"""WITH l AS (SELECT doc_id, {_WORDS('text')} AS ws FROM {_DOCS}), tf AS (SELECT doc_id, n_all, word, count(*) AS n FROM (SELECT doc_id, len(ws) AS n_all, unnest(ws) AS word FROM l) GROUP BY ALL),
        df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1) SELECT doc_id, word, round(n / n_all * (ln((SELECT count(*) FROM l) / (df + 1)) + 1), 6) AS score FROM tf JOIN df USING (word)"""),
    "jaccard_adjacent": (jaccard_adjacent, f"WITH {_ADJ} SELECT doc_id, pos, similarity FROM sim"),
    "topic_boundaries": (topic_boundaries, f"WITH {_ADJ} SELECT doc_id, pos FROM sim WHERE similarity < 0.15 OR (ph <> heading AND heading <> '')"),
    "weighted_similarity": (weighted_similarity, f"""WITH {_ADJ}, w2 AS (SELECT doc_id, pos, previous, content, {_WORDS('previous')} AS a, {_WORDS('content')} AS b, {_ENT('previous')} AS ea, {_ENT('content')} AS eb FROM sim)
        SELECT doc_id, pos, round(0.5 * {_JAC('list_distinct(a)', 'list_distinct(b)')} + 0.3 * {_JAC(_BI('a'), _BI('b'))} + 0.2 * {_JAC('ea', 'eb')}, 6) AS similarity FROM w2"""),
    "sentence_split": (sentence_split, rf"""WITH w AS (SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split({_STRIP(r"regexp_replace(text, '\s+', ' ', 'g')")}, ' ') AS l FROM {_DOCS})),
        e AS (SELECT *, (regexp_matches(word, '[.!?]$') AND rtrim(word, '.!?') NOT IN {_ABBR} AND regexp_matches(coalesce(lead(word) OVER o, ''), '^\p{{Lu}}'))::INT AS ends FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        g AS (SELECT doc_id, i, word, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS sentence_no FROM e)
        SELECT doc_id, sentence_no, string_agg(word, ' ' ORDER BY i) AS sentence FROM g WHERE word <> '' GROUP BY 1, 2"""),
    "simple_questions": (simple_questions, rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda x: {_STRIP('x')}), lambda x: x <> '')[:3] AS l FROM {_DOCS}),
        q AS (SELECT doc_id, list_filter(list_transform(l, lambda x, i: CASE WHEN len(regexp_split_to_array(x, '\s+')) >= 2 THEN replace({_QUEST}[(i - 1) % 5 + 1], '{{}}', array_to_string(regexp_split_to_array(x, '\s+')[:5], ' ')) END), lambda x: x IS NOT NULL) AS qs FROM p)
        SELECT doc_id, unnest(qs) AS question, unnest(range(len(qs))) AS question_no FROM q"""),
    "chunk_id_md5": (chunk_id_md5, f"SELECT doc_id, pos, doc_id || '_chunk_' || pos || '_' || left(md5(doc_id || '_' || pos || '_' || left(line, 100)), 12) AS chunk_id FROM {_LINES}"),
    "chunk_stats": (chunk_stats, f"""SELECT count(*) AS total_chunks, sum(n)::BIGINT AS total_tokens, floor(avg(n))::BIGINT AS avg_tokens, min(n) AS min_tokens, max(n) AS max_tokens, sum(c)::BIGINT AS total_characters, floor(avg(c))::BIGINT AS avg_characters
        FROM (SELECT length(text) // 4 AS n, length(text) AS c FROM {_DOCS})"""),
    "parent_assignment": (parent_assignment, f"SELECT doc_id, pos AS child, least(pos * ((c + 2) // 3) // greatest(c, 1), (c + 2) // 3 - 1)::BIGINT AS parent FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM {_LINES})"),
    "header_footer_removal": (header_footer_removal, f"""WITH p AS (SELECT 'b-' || coalesce(source, '') AS doc_id, doc_id AS page, text FROM documents UNION ALL SELECT 'f-' || doc_id, page::BIGINT, text FROM ({_PAGES})),
        l AS (SELECT *, string_split({_STRIP('text')}, chr(10)) AS ls, count(*) OVER (PARTITION BY doc_id) AS n FROM p),
        e AS (SELECT *, left({_STRIP('ls[1]')}, 100) AS top, left({_STRIP('ls[-1]')}, 100) AS bottom FROM l),
        c AS (SELECT *, top <> '' AND count(*) OVER (PARTITION BY doc_id, top) >= 0.5 * n AND n >= 3 AS ct, bottom <> '' AND count(*) OVER (PARTITION BY doc_id, bottom) >= 0.5 * n AND n >= 3 AS cb FROM e)
        SELECT doc_id, page, md5(CASE WHEN n < 3 THEN text ELSE array_to_string(CASE WHEN cb AND len(k) > 0 THEN k[:-2] ELSE k END, chr(10)) END) AS text_md5 FROM (SELECT *, CASE WHEN ct THEN ls[2:] ELSE ls END AS k FROM c)"""),
    "markdown_tables": (markdown_tables, """SELECT n_regionkey, '| key | name | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name || '|x', '|', '\\|') || ' |  |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1"""),
}
