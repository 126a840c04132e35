"""Tables and body text of pages from where their words stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as t

#: Words whose tops differ by more are on other lines; words farther apart are in other cells; columns may be off by so much (points).
LINE_GAP, CELL_GAP, COLUMN_SLACK = 3.0, 12.0, 3.0
PAGE = ["doc_id", "page"]


def lined(words: DataFrame, line_gap: float = LINE_GAP) -> DataFrame:
    """``words(doc_id, page, x0, x1, top, bottom, text)`` with the ``line`` of the page that each stands on, from 1 downwards."""
    down = Window.partitionBy(*PAGE).orderBy("top", "x0", "text")
    starts = F.coalesce((F.col("top") - F.lag("top").over(down) > line_gap).cast("int"), F.lit(1))
    return words.withColumn("_starts", starts).withColumn("line", F.sum("_starts").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def rows_of(words: DataFrame, cell_gap: float = CELL_GAP) -> DataFrame:
    """``lined`` words as one row a line: its box, the texts of its ``cells`` from left to right and their left ends."""
    across = Window.partitionBy(*PAGE, "line").orderBy("x0", "x1", "text")
    reach = F.max("x1").over(across.rowsBetween(Window.unboundedPreceding, -1))
    apart = words.withColumn("_new", F.coalesce((F.col("x0") - reach > cell_gap).cast("int"), F.lit(0))).withColumn("cell", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))), lambda w: w["text"]), " ")
    cells = apart.groupBy(*PAGE, "line", "cell").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), said.alias("text"))
    inorder = F.sort_array(F.collect_list(F.struct("cell", "x0", "text")))
    return cells.groupBy(*PAGE, "line").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"),
                                            F.transform(inorder, lambda c: c["text"]).alias("cells"), F.transform(inorder, lambda c: c["x0"]).alias("lefts"))


def tables(words: DataFrame, *, line_gap: float = LINE_GAP, cell_gap: float = CELL_GAP, slack: float = COLUMN_SLACK) -> DataFrame:
    """``(doc_id, page, table_no, x0, x1, top, bottom, rows, markdown)`` of ``words(doc_id, page, x0, x1, top, bottom, text)``.

    A table is two or more neighbouring lines of as many cells, two at least, whose left ends agree within ``slack``;
    cells are parted by gaps of more than ``cell_gap``.  Tables are numbered downwards.  Windows are over one page's words or lines.
    Words without text or place are left out.  An empty table gives no rows.
    """
    placed = _placed(words)
    rows = rows_of(lined(placed, line_gap), cell_gap)
    down = Window.partitionBy(*PAGE).orderBy("line")
    before = F.lag("lefts").over(down)
    goes_on = (F.size("lefts") > 1) & (F.size("lefts") == F.size(before)) & F.forall(F.zip_with("lefts", before, lambda a, b: F.abs(a - b) <= slack), lambda x: x)
    runs = rows.withColumn("_on", F.coalesce(goes_on, F.lit(False))).withColumn("run", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.where(F.size("lefts") > 1).groupBy(*PAGE, "run").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"),
                                                                     F.transform(F.sort_array(F.collect_list(F.struct("line", "cells"))), lambda r: r["cells"]).alias("rows")).where("n > 1")
    nth = F.row_number().over(Window.partitionBy(*PAGE).orderBy("run"))
    return found.select(*PAGE, nth.alias("table_no"), "x0", "x1", "top", "bottom", "rows", t.markdown_table(F.col("rows")).alias("markdown"))


def body_words(words: DataFrame, found: DataFrame) -> DataFrame:
    """The words whose middle lies in no table's box."""
    boxes = found.select(F.col("doc_id").alias("b_doc"), F.col("page").alias("b_page"), F.col("x0").alias("b_x0"), F.col("x1").alias("b_x1"), F.col("top").alias("b_top"), F.col("bottom").alias("b_bottom"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    inside = (x >= F.col("b_x0")) & (x < F.col("b_x1")) & (y >= F.col("b_top")) & (y < F.col("b_bottom"))
    return words.join(boxes, F.col("doc_id").eqNullSafe(F.col("b_doc")) & F.col("page").eqNullSafe(F.col("b_page")) & inside, "left_anti")


def page_texts(words: DataFrame, *, line_gap: float = LINE_GAP, cell_gap: float = CELL_GAP, slack: float = COLUMN_SLACK) -> DataFrame:
    """``(doc_id, page, text)``: the body's lines without what tables hold, then each table in Markdown, a blank line between; pages of neither have no row."""
    placed = _placed(words)
    found = tables(placed, line_gap=line_gap, cell_gap=cell_gap, slack=slack)
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))), lambda w: w["text"]), " ")
    lines = lined(body_words(placed, found), line_gap).groupBy(*PAGE, "line").agg(said.alias("text"))
    body = lines.groupBy(*PAGE).agg(F.struct(F.lit(0).alias("table_no"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text")).alias("part"))
    parts = body.unionByName(found.select(*PAGE, F.struct(F.col("table_no").cast("int").alias("table_no"), F.col("markdown").alias("text")).alias("part")))
    return parts.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["text"]), "\n\n").alias("text"))


def _placed(words: DataFrame) -> DataFrame:
    return words.where((F.coalesce("text", F.lit("")) != "") & F.col("x0").isNotNull() & F.col("x1").isNotNull() & F.col("top").isNotNull() & F.col("bottom").isNotNull())
