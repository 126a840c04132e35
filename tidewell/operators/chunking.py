"""Topic-coherent chunks, spoken pieces and message parts.

The order-dependent groupings come from ``folds``, which see sizes, headings and keywords only; the
patterns are those of ``functions.text``.  One pass over each document, in Arrow batches of bounded
bytes; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.config import DEFAULT, EngineConfig
from tidewell.functions import text as t
from tidewell.operators import folds
from tidewell.operators.sizes import byte_slices, cut, spread

# fixed values: question-and-answer forms (group 1 asks, group 2 answers)
FAQ = [r"^Q[:.\s]*(.+?)[\n]+A[:.\s]*(.+?)(?=\n\s*Q[:.\s]|\Z)", r"^\*\*Q[:.\s]*\*\*(.+?)[\n]+\*\*A[:.\s]*\*\*(.+?)(?=\n\s*\*\*Q|\Z)",
       r"^(?:Question|FAQ)[:.\s]*(.+?)[\n]+(?:Answer)[:.\s]*(.+?)(?=\n\s*(?:Question|FAQ)|\Z)"]
FAQ_LEAST = 3
# fixed values: marks of overlaps and continued parts
AGAIN, CONTINUED = "[...] ", " (continued)"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Piece:
    content: str
    heading: str = ""
    subheading: str = ""
    kind: str = "paragraph"


def tokens(text: str) -> int:
    return len(text) // 4


@cache
def _pattern(pattern: str, flags: str = "") -> regex.Pattern:
    return regex.compile(f"(?{flags}){pattern}" if flags else pattern)


def cleaned(text: str | None) -> str:
    """``functions.text.clean`` of the text in NFKC."""
    out = unicodedata.normalize("NFKC", text or "")
    for flags, pattern, to in [*t.OCR, *t.SPACES, *t.PAGE_NUMBERS, *t.CONTENTS]:
        out = _pattern(pattern, flags).sub(to.format(r"\0", r"\1", r"\2"), out)
    return out.strip(BLANKS)


def sentences(text: str) -> list[str]:
    """``functions.text.sentences``."""
    flat = _pattern(r"\s+").sub(" ", text.strip(BLANKS))
    return [s for s in _pattern(t.SENTENCE_END).sub(r"\1\n", flat).split("\n") if s]


def heading(line: str) -> str | None:
    """``functions.text.heading``."""
    line = line.strip(BLANKS)
    found = (m[1].strip(BLANKS) for form in t.HEADINGS if (m := _pattern(form).match(line)))
    return next(found, None) if line and len(line) <= 100 else None


_STOP = frozenset(t.STOPWORDS)


def keywords(text: str, most: int = 15) -> set[str]:
    """``functions.text.keywords`` of the text's words."""
    counts: dict[str, int] = {}
    for w in re.findall(r"\b[a-z]{3,}\b", text.lower()):
        if w not in _STOP:
            counts[w] = counts.get(w, 0) + 1
    return set(sorted(counts, key=counts.__getitem__, reverse=True)[:most])


def faq_pairs(body: str) -> list[tuple[str, str]]:
    if not re.search(r"(?m)^(?:\*\*)?(?:Q|FAQ)", body):
        return []
    return [(q.strip(BLANKS), a.strip(BLANKS)) for form in FAQ for q, a in re.findall(form, body, re.M | re.S)]


def block_kind(block: str) -> tuple[str, str | None]:
    """Kind by the first rule that fits, and the heading that the first line states."""
    found = heading(block.split("\n", 1)[0])
    rules = [("code", _pattern(t.CODE).search(block)), ("table", _pattern(t.TABLE_ROW).search(block) or _pattern(t.TABLE_RULE).search(block)),
             ("heading", found), ("list", _pattern(t.LIST_ITEM, "m").search(block))]
    return next((kind for kind, fits in rules if fits), "paragraph"), found


def segmented(body: str, separator: str) -> list[Piece]:
    """``structure.segments`` of one text."""
    blocks = [b for x in re.split(separator, body) if (b := x.strip(BLANKS))]
    kinds = [block_kind(b) for b in blocks]
    said = [(f, b.startswith("# ") or b.split("\n", 1)[0].isupper()) if k == "heading" else None for b, (k, f) in zip(blocks, kinds, strict=True)]
    # (heading, subheading) that hold from each block on
    held = list(accumulate(said, lambda now, s: now if s is None else (s[0], "") if s[1] else (now[0], s[0]), initial=("", "")))[1:]
    out = []
    for block, (kind, _), (top, sub) in zip(blocks, kinds, held, strict=True):
        content = block.partition("\n")[2].strip(BLANKS) if kind == "heading" else block
        if content:
            out.append(Piece(content, top, sub, "paragraph" if kind == "heading" else kind))
    return out


def topics(parts: list[Piece], config: EngineConfig) -> list[Piece]:
    """Runs of one topic, named by the first headings that they hold; those beyond the hard limit in sentences up to the target."""
    run = folds.alike([p.heading for p in parts], [keywords(p.content) for p in parts], config.min_topic_similarity) if len(parts) > 1 else [0] * len(parts)
    out = []
    for group in folds.together(parts, run):
        whole = Piece("\n\n".join(p.content for p in group), next((p.heading for p in group if p.heading), ""), next((p.subheading for p in group if p.subheading), ""))
        if tokens(whole.content) <= config.hard_max_tokens or config.preserve_blocks and all(p.kind != "paragraph" for p in group):
            out.append(whole)
            continue
        said = sentences(whole.content)
        packs = folds.together(said, folds.packed(list(map(tokens, said)), config.target_max_tokens))
        out += [replace(whole, content=" ".join(pack), subheading=whole.subheading + CONTINUED * (i > 0)) for i, pack in enumerate(packs)]
    return out


def merged(parts: list[Piece], config: EngineConfig) -> list[Piece]:
    """Small neighbours merged; a group's headings are those of its first piece that isn't small, else of its first."""
    group = folds.merged([len(p.content) for p in parts], [p.heading for p in parts], config.hard_min_tokens, config.hard_max_tokens)
    named = lambda g: next((p for p in g if tokens(p.content) >= config.hard_min_tokens), g[0])
    return [replace(named(g), content="\n\n".join(p.content for p in g)) for g in folds.together(parts, group)]


def tail(text: str, most: int) -> str:
    """The last whole sentences of a text, up to ``most`` tokens."""
    said = sentences(text)
    n = sum(size <= most for size in accumulate(tokens(s) for s in reversed(said)))
    return " ".join(said[len(said) - n:])


def labelled(p: Piece) -> str:
    text = f"[Topic: {p.heading}]\n{p.content}" if p.heading else p.content
    return f"[{p.subheading}]\n{text}" if p.subheading else text


def chunk_document(document_id: str, text: str | None, config: EngineConfig = DEFAULT) -> list[tuple]:
    """The chunks of one text as rows of ``CHUNK_SCHEMA``."""
    body = cleaned(text)
    pairs = faq_pairs(body)
    if len(pairs) >= FAQ_LEAST:
        parts = [Piece(f"Q: {q}\n\nA: {a}", "FAQ", q[:100]) for q, a in pairs]
        plain = full = [p.content for p in parts]
    else:
        parts = merged(topics(segmented(body, config.block_separator), config), config)
        plain = full = list(map(labelled, parts))
        if config.overlap_tokens > 0:
            laps = ["", *(tail(x, config.overlap_tokens) for x in plain[:-1])]
            full = [f"{AGAIN}{lap} {x}" if lap else x for lap, x in zip(laps, plain, strict=False)]
    key = lambda i, x: f"{document_id}_chunk_{i}_{hashlib.md5(f'{document_id}_{i}_{x[:100]}'.encode()).hexdigest()[:12]}"
    return [(key(i, before), i, len(parts), after, p.heading, p.subheading, tokens(after)) for i, (before, after, p) in enumerate(zip(plain, full, parts, strict=True))]


CHUNK_SCHEMA = "chunk_id string, chunk_index int, total_chunks int, text string, section_title string, subsection_title string, token_count int"


def chunk_documents(docs: DataFrame, config: EngineConfig = DEFAULT, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, chunk_id, chunk_index, total_chunks, text, section_title, subsection_title, token_count)`` of every whole text.

    Three or more question-and-answer pairs make a chunk each.  Otherwise neighbouring segments of one
    topic form a chunk, too long ones are split by sentences, too small ones merged, headings written
    on top; each chunk after the first begins with the last sentences of the one before.  Null and
    blank texts give no chunks; rows that repeat an id are documents of their own.
    """
    source = spread(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")))
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "body"):
            ids = part.column("id")
            found = [chunk_document(str(key), body, config) for key, body in zip(ids.to_pylist(), part.column("body").to_pylist(), strict=True)]
            at = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            columns = list(zip(*(r for rows in found for r in rows), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([ids.take(at), *(pa.array(c, kind) for c, kind in zip(columns, types, strict=True))], names=["id", *names])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, {CHUNK_SCHEMA}").withColumnRenamed("id", id_col)


def with_metadata(chunks: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", fields: list[str]) -> DataFrame:
    """Chunks with ``metadata``, a map of their own fields and the document's ``fields``, which win over them, plus ``chunk_size``."""
    own = F.create_map(F.lit("section_title"), F.col("section_title"), F.lit("subsection_title"), F.col("subsection_title"),
                       F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("chunk_size"), F.char_length("text").cast("string"))
    given = docs.select(F.col(id_col).alias("_id"), F.map_filter(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f).cast("string")))), lambda k, v: v.isNotNull()).alias("_given"))
    kept = F.map_filter(own, lambda k, v: ~F.map_contains_key(F.coalesce("_given", F.create_map().cast("map<string,string>")), k))
    return chunks.join(given, chunks[id_col] == F.col("_id"), "left").withColumn("metadata", F.map_concat(kept, F.coalesce("_given", F.create_map().cast("map<string,string>")))).drop("_id", "_given")


def parent_child(docs: DataFrame, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Large parents and default children of the same documents; child ``i`` of ``C`` belongs to parent ``min(i*P div C, P-1)``."""
    big = replace(config, target_min_tokens=800, target_max_tokens=1200, hard_max_tokens=1500, hard_min_tokens=400, overlap_tokens=150)
    parents = cut(chunk_documents(docs, big).withColumn("parent_id", F.concat_ws("_parent_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))))  # counted here, joined by callers
    children = chunk_documents(docs, config)
    n = parents.groupBy(F.col("doc_id").alias("p_doc")).agg(F.count(F.lit(1)).alias("n_parents"))
    placed = children.join(n, F.col("doc_id") == F.col("p_doc")).withColumn("parent_id", F.concat_ws("_parent_", F.col("doc_id").cast("string"),
                                                                                                     t.parent_index(F.col("chunk_index"), F.col("total_chunks"), F.col("n_parents")).cast("string")))
    return parents, placed.drop("p_doc", "n_parents")


def question_chunks(chunks: DataFrame, most: int = 2) -> DataFrame:
    """Chunks of questions beside their sources: ``(chunk_id, source_chunk_id, text, content_type)``; the questions are ``text.simple_questions``.

    A generator's lines can take their place: pass them through ``given_questions`` first.
    """
    own = chunks.select("chunk_id", F.lit(None).cast("string").alias("source_chunk_id"), "text", F.lit("chunk").alias("content_type"))
    asked = chunks.select(F.col("chunk_id").alias("source_chunk_id"), F.posexplode(t.simple_questions(F.col("text"), most)).alias("i", "text"))
    return own.unionByName(asked.select(F.concat("source_chunk_id", F.lit("_q"), F.col("i").cast("string")).alias("chunk_id"), "source_chunk_id", "text", F.lit("question").alias("content_type")))


def given_questions(reply: Column, text: Column, most: int = 3) -> Column:
    """The questions of a generator's reply, a line each, numbering taken off; without any, template questions about the text."""
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda x: t.strip(F.regexp_replace(t.strip(x), r"^(?:\d+[.)]|[-•*])\s*", ""))), lambda x: F.contains(x, F.lit("?")))
    return F.when(F.size(lines) > 0, F.slice(lines, 1, most)).otherwise(t.simple_questions(text, most))


def _texts(df: DataFrame, out: str, items: Column, number: Column, text_of, several: bool = False) -> DataFrame:
    """``df`` with ``out``: the text (or ``several``) of each group of ``items`` by a fold's numbers; helper columns go again."""
    df = df.withColumn("_items", items).withColumn("_group", number)
    whole = F.transform(folds.grouped(F.col("_items"), F.col("_group")), text_of)
    whole = F.flatten(whole) if several else whole
    return df.withColumn(out, F.when(F.size("_items") > 0, whole).otherwise(F.array().cast("array<string>"))).drop("_items", "_group")


def speech_sentences(df: DataFrame, text: str = "text", out: str = "sentences", most: int = 240, least: int = 40) -> DataFrame:
    """``df`` with pieces for speech: one after a line of under ``least`` characters joins it, long ones are cut at ``most``."""
    pieces = F.filter(F.transform(F.regexp_extract_all(t.strip(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0)), t.strip), lambda p: p != "")
    number = folds.column(lambda sizes: folds.filled(sizes, least, most), F.transform("_items", lambda p: F.char_length(p)))

    def lines(g: Column) -> Column:
        """Cut where the first item is too long; what joins it stays on its last line."""
        whole, last = F.array_join(g, " "), F.floor((F.char_length(g[0]) - 1) / most).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.when(i < last, F.substr(whole, i * most + 1, F.lit(most))).otherwise(F.substr(whole, i * most + 1)))

    df = _texts(df, "_lines", pieces, number, lines, several=True)
    whole = t.strip(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn(out, F.when(F.size("_lines") > 0, F.col("_lines")).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))).drop("_lines")


def speech_chunks(df: DataFrame, text: str = "text", out: str = "spoken", first: int = 180, rest: int = 400) -> DataFrame:
    """``df`` with what is spoken at once: a text of ``first`` characters whole; else its first sentence, then sentences packed up to ``rest``."""
    df = speech_sentences(df, text, "_said")
    number = folds.column(lambda sizes: folds.packed(sizes, rest, [1] * len(sizes), alone=1), F.transform("_items", lambda s: F.char_length(s)))
    df = _texts(df, out, F.filter(F.transform("_said", t.strip), lambda s: s != ""), number, lambda g: F.array_join(g, " "))
    whole = t.strip(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn(out, F.when(F.char_length(whole) > first, F.col(out)).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))).drop("_said")


def message_parts(df: DataFrame, text: str = "text", out: str = "parts", most: int = 4096) -> DataFrame:
    """``df`` with a message in parts within the limit: whole paragraphs, longer ones by sentences; several parts say which they are.

    A sentence that is longer than the limit stays whole.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    # an item: what stands between it and the one before, and whether it must start a part
    para = lambda p: F.array(F.struct(p.alias("s"), F.lit("\n\n").alias("glue"), F.lit(False).alias("starts")))
    cut = lambda p: F.transform(F.split(F.regexp_replace(p, r"([.!?]\s+)", "\u0000$1\u0000"), "\u0000"), lambda s, i: F.struct(s.alias("s"), F.lit("").alias("glue"), (i == 0).alias("starts")))
    items = F.flatten(F.transform(F.split(said, "\n\n"), lambda p: F.when(F.char_length(p) <= most, para(p)).otherwise(cut(p))))
    number = folds.column(lambda sizes, glue, starts: folds.packed(sizes, most, glue, starts), F.transform("_items", lambda x: F.char_length(x["s"])),
                          F.transform("_items", lambda x: F.char_length(x["glue"])), F.transform("_items", lambda x: x["starts"]))
    joined = lambda g: F.array_join(F.transform(g, lambda x, i: F.concat(F.when(i == 0, F.lit("")).otherwise(x["glue"]), x["s"])), "")
    df = _texts(df, "_parts", items, number, joined).withColumn("_parts", F.transform(F.filter("_parts", lambda p: p != ""), t.strip))
    n = F.size("_parts")
    numbered = F.transform("_parts", lambda p, i: F.concat(F.lit("*[Part "), (i + 1).cast("string"), F.lit("/"), n.cast("string"), F.lit("]*\n\n"), p))
    return df.withColumn(out, F.when(F.char_length(said) <= most, F.array(said)).when(n > 1, numbered).otherwise(F.col("_parts"))).drop("_parts")
