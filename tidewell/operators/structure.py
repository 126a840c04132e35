"""Structure of documents: blocks with running headings, repeated page lines, term weights."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.config import DEFAULT
from tidewell.functions import text as t

#: Keywords of a text.
MOST_KEYS = 15
_WORD, _NAME, _STOP = re.compile(r"\b[a-z]{3,}\b"), re.compile(r"\b[A-Z][a-z]+\b"), frozenset(t.STOPWORDS)


def segments(docs: DataFrame, *, separator: str = DEFAULT.block_separator) -> DataFrame:
    """``docs(doc_id, text)`` as ``(doc_id, pos, type, content, heading, subheading)``.

    Blocks are code, table, heading, list or paragraph, the first that fits.  A heading changes the
    state of what follows; upper-case and single-hash ones reset the subheading; its block leaves a
    paragraph only if lines follow.  ``pos`` numbers a document's blocks from 0, headings included.
    """
    blocks = docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), separator), t.strip), lambda b: b != "")).alias("pos", "block"))
    first = F.substring_index("block", "\n", 1)
    blocks = blocks.withColumns({"code": t.is_code(F.col("block")), "table": t.is_table(F.col("block")), "found": t.heading(first), "list": t.is_list(F.col("block"))})
    kind = F.when(F.col("code"), "code").when(F.col("table"), "table").when(F.col("found").isNotNull(), "heading").when(F.col("list"), "list").otherwise("paragraph")
    blocks = blocks.withColumn("kind", kind)
    head = F.col("kind") == "heading"
    great = head & (F.startswith(first, F.lit("# ")) | t.is_upper(first))
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    state = blocks.withColumns({
        "heading": F.coalesce(F.last(F.when(great, F.col("found")), ignorenulls=True).over(so_far), F.lit("")),
        "subheading": F.coalesce(F.last(F.when(great, F.lit("")).when(head, F.col("found")), ignorenulls=True).over(so_far), F.lit(""))})
    after = t.strip(F.expr("substring(block, nullif(position('\n' IN block), 0) + 1)"))
    content = F.when(head, F.nullif(F.coalesce(after, F.lit("")), F.lit(""))).otherwise(F.col("block"))
    return state.select("doc_id", "pos", F.when(head, "paragraph").otherwise(F.col("kind")).alias("type"), content.alias("content"), "heading", "subheading").where("content IS NOT NULL")


def adjacent(parts: DataFrame, *, weighted: bool = False) -> DataFrame:
    """``segments`` without their content, with the one before: keyword ``similarity`` (or ``weighted``) and whether a topic ``boundary`` lies between.

    Words are counted in one pass over Arrow batches; only contents and headings are shuffled, not their words.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    now = parts.withColumns({"previous": F.lag("content").over(order), "prev_heading": F.lag("heading").over(order)}).where("previous IS NOT NULL")
    kept = [c for c in now.columns if c not in ("content", "previous")]
    like = weighted_likeness if weighted else keyword_likeness

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, last, said = [], None, None
            for a, b in zip(batch.column("previous").to_pylist(), batch.column("content").to_pylist(), strict=True):
                before = said if a == last else Said(a)  # mostly the row above
                last, said = b, Said(b)
                found.append(like(before, said))
            yield batch.select(kept).append_column("similarity", pa.array(found, pa.float64()))

    near = now.mapInArrow(run, ", ".join([*(f"`{c}` {now.schema[c].dataType.simpleString()}" for c in kept), "similarity double"])).withColumn("similarity", F.round("similarity", 6))
    return near.withColumn("boundary", (F.col("similarity") < 0.15) | ((F.col("prev_heading") != F.col("heading")) & (F.col("heading") != "")))


class Said:
    """A text's ``functions.text.words`` and what is compared of them, each found when it is asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[str]:
        return [w for w in _WORD.findall(self.text.lower()) if w not in _STOP]

    @cached_property
    def keys(self) -> set[str]:
        counts: dict[str, int] = {}
        for w in self.words:
            counts[w] = counts.get(w, 0) + 1
        return set(sorted(counts, key=counts.__getitem__, reverse=True)[:MOST_KEYS])

    @cached_property
    def distinct(self) -> set[str]:
        return set(self.words)

    @cached_property
    def pairs(self) -> set[tuple[str, str]]:
        return set(pairwise(self.words))

    @cached_property
    def names(self) -> set[str]:
        return set(_NAME.findall(self.text))


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def keyword_likeness(a: Said, b: Said) -> float:
    """``functions.text.jaccard`` of both texts' keywords."""
    return _jaccard(a.keys, b.keys)


def weighted_likeness(a: Said, b: Said) -> float:
    """``functions.text.weighted_similarity``."""
    return 0.5 * _jaccard(a.distinct, b.distinct) + 0.3 * _jaccard(a.pairs, b.pairs) + 0.2 * _jaccard(a.names, b.names) if a.text and b.text else 0.0


def keyword_counts(docs: DataFrame, most: int = 15) -> DataFrame:
    """``(doc_id, word, n, rank)``: each document's commonest words, ties by first appearance."""
    each = docs.select("doc_id", F.posexplode(t.words(F.col("text"))).alias("at", "word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return each.withColumn("rank", rank).where(F.col("rank") <= most).drop("first")


def tf_idf(docs: DataFrame) -> DataFrame:
    """``(doc_id, word, score)``: share of the document's words times ln(documents / (documents with it + 1)) + 1."""
    listed = docs.select("doc_id", t.words(F.col("text")).alias("ws"))
    tf = listed.select("doc_id", F.size("ws").alias("total"), F.explode("ws").alias("word")).groupBy("doc_id", "total", "word").agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    size = docs.agg(F.count(F.lit(1)).alias("docs"))  # one row
    score = F.col("n") / F.col("total") * (F.log(F.col("docs") / (F.col("df") + 1)) + 1)
    return tf.join(df, "word").crossJoin(F.broadcast(size)).select("doc_id", "word", F.round(score, 6).alias("score"))


def remove_repeated_edges(pages: DataFrame, *, share: float = 0.5, least_pages: int = 3) -> DataFrame:
    """``pages(doc_id, page, text)`` without first and last lines that at least ``share`` of a document's pages repeat."""
    lines = F.split(t.strip(F.coalesce("text", F.lit(""))), "\n")
    edge = lambda line: F.left(t.strip(line), F.lit(100))
    p = pages.withColumns({"lines": lines, "top": edge(F.get(lines, F.lit(0))), "bottom": edge(F.element_at(lines, -1)), "n_pages": F.count(F.lit(1)).over(Window.partitionBy("doc_id"))})
    often = lambda c: (F.col(c) != "") & (F.count(F.lit(1)).over(Window.partitionBy("doc_id", c)) >= share * F.col("n_pages")) & (F.col("n_pages") >= least_pages)
    p = p.withColumns({"cut_top": often("top").cast("int"), "cut_bottom": often("bottom")})
    kept = F.slice(F.col("lines"), F.col("cut_top") + 1, F.size("lines"))
    # a page of one line that is both loses it once
    again = F.col("cut_bottom") & (F.size(kept) > 0)
    kept = F.when(again, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
    return p.select("doc_id", "page", F.when(F.col("n_pages") < least_pages, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """One row of counts over ``chunks(text)``; averages are rounded down."""
    n = chunks.select(t.token_count(F.col("text")).alias("tok"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("len"))
    return n.agg(F.count(F.lit(1)).alias("total_chunks"), F.sum("tok").alias("total_tokens"), F.floor(F.avg("tok")).alias("avg_tokens"), F.min("tok").alias("min_tokens"),
                 F.max("tok").alias("max_tokens"), F.sum("len").alias("total_characters"), F.floor(F.avg("len")).alias("avg_characters"))
