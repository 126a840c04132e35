"""A training corpus from ``documents``: language, repeated lines, near duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written and read again as the
next one's ``docs``.  All but the last return the columns of ``documents``, in their order, whatever
other columns are called.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import language_id, line_dedup, minhash_forest, packing
from tidewell.llm.common import carried, discard, few, restored, staged, table
from tidewell.llm.queries import vocabulary

#: A document whose largest language has less than this part of its letters, those of licence lines aside, is rejected: halves of two languages are.
LEAST_SCORE = 0.6


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of one recognised language: letterless texts, foreign scripts and those without a main language go.

    Short licence lines don't count, unless there is nothing else, so a text keeps its language beside a foreign one.
    The model is fitted on the documents' own labels; a document without a label gets the language that
    was found, other labels stay.  Null and empty texts have no letter and go.  Every row is judged by
    its text alone: repeated rows stay or go together, a null id doesn't matter.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    model = language_id.train(docs, usable=fold != 0)
    found = language_id.with_language(carried(docs, ("text",), text=F.col("text").cast("string")), model, spans=False, prepare=language_id.without_licence_lines)
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return restored(kept, docs.columns, text=F.col("text"), lang=F.coalesce(F.col("_row.lang"), F.col("lang_pred")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the long lines that five documents share; their largest id keeps them.

    Rows that share an id are one document for counting, but each loses lines of its own text only.
    Null and empty texts stay as they are, and so do rows without an id.  ``n_chars`` is counted anew.
    """
    kept = line_dedup.apply_bitmaps(carried(docs, doc_id=F.col("doc_id"), text=F.col("text")), line_dedup.keep_bitmaps(docs))
    return restored(kept, docs.columns, text=F.col("text"), n_chars=F.char_length("text").cast("long"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one of the smallest id, of each class of near duplicates.

    Rows are compared, not ids: of repeated rows one stays, rows that share an id but not a text are
    judged apart, and rows without an id are compared too and stay only if no row of their class has one.
    Texts without words (null and empty ones) have no copies and all stay.
    """
    rows = carried(docs, key=F.col("doc_id"), text=F.col("text"))
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        rows = staged(rows.orderBy(F.asc_nulls_last("key"), "text").withColumn("key", F.monotonically_increasing_id()), "rows")
    classes = minhash_forest.jaccard_classes(rows, id_col="key")
    gone = staged(classes.where(F.col("class_id") != F.col("key")).select(F.col("key").alias("gone")), "gone")
    return restored(rows.join(few(gone), F.col("key") == F.col("gone"), "left_anti"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in full windows: a row per piece, each id in one.

    Null and empty texts are documents of one closing id; rows that repeat an id, or have none, are documents of their own.
    """
    pieces = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("input_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


STAGES = [("language ID", by_language), ("line dedup", without_repeated_lines), ("n-gram Jaccard join", without_near_copies), ("packing", packed)]

#: Language models, signatures and vocabularies have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
