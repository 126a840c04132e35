"""Tables from word boxes that are laid out from the customers' orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import layout

_HEAD = "named_struct('x0', {0}D, 'x1', {1}D, 'top', {2}D, 'text', '{3}')"


def order_words(spark: SparkSession, d: str) -> DataFrame:
    """A customer a document, a page a year: a heading of two words, then an order a line with number, two words of priority and date, in three columns.

    Every fifth order's number stands a little lower and to the right; a note of one cell follows the orders.
    """
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), F.year("o_orderdate").alias("page"), "o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"), F.lower("o_orderpriority").alias("priority"))
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("o_orderkey"))  # one page's orders
    placed = o.withColumn("nth", nth).withColumn("off", F.when(F.col("o_orderkey") % 5 == 0, 2.0).otherwise(0.0))
    word = lambda x0, x1, top, text: F.struct(x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), top.cast("double").alias("top"), text.alias("text"))
    top, at = F.col("nth") * 20.0 + 20, lambda x: F.lit(float(x))
    row = F.array(word(at(10) + F.col("off"), at(60), top + F.col("off"), F.col("o_orderkey").cast("string")), word(at(100), at(120), top, F.lit("prio")), word(at(125), at(160), top, F.col("priority")), word(at(300), at(350), top, F.col("day")))
    orders = placed.select("doc_id", "page", F.explode(row).alias("w"))
    ends = placed.groupBy("doc_id", "page").agg(F.max("nth").alias("n"))
    more = F.array(word(at(10), at(50), at(0), F.lit("Orders")), word(at(55), at(90), at(0), F.lit("overview")), word(at(10), at(70), F.col("n") * 20.0 + 60, F.lit("End")), word(at(72), at(90), F.col("n") * 20.0 + 60, F.lit("of"))
                   , word(at(92), at(120), F.col("n") * 20.0 + 60, F.lit("page")))
    words = orders.unionByName(ends.select("doc_id", "page", F.explode(more).alias("w")))
    return words.select("doc_id", "page", "w.x0", "w.x1", "w.top", (F.col("w.top") + 10).alias("bottom"), "w.text")


def layout_tables(spark, d):
    found = layout.tables(order_words(spark, d))
    return found.select("doc_id", "page", "table_no", "x0", "x1", "top", "bottom", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


def layout_pages(spark, d):
    return layout.page_texts(order_words(spark, d)).select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_O = """o AS (SELECT o_custkey AS doc_id, year(o_orderdate)::INT AS page, o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS nth, o_orderkey || ' | prio ' || lower(o_orderpriority) || ' | ' || strftime(o_orderdate, '%Y-%m-%d') AS line,
        CASE WHEN o_orderkey % 5 = 0 THEN 2.0 ELSE 0.0 END AS off FROM orders),
    g AS (SELECT doc_id, page, count(*) AS n, string_agg('| ' || line || ' |', chr(10) ORDER BY nth) FILTER (nth > 1) AS rest, any_value('| ' || line || ' |') FILTER (nth = 1) AS first, min(10 + off) AS x0, max(nth * 20 + 30 + off) AS bottom, string_agg(replace(line, ' | ', ' '), chr(10) ORDER BY nth) AS plain FROM o GROUP BY 1, 2),
    m AS (SELECT *, first || chr(10) || '| --- | --- | --- |' || chr(10) || rest AS markdown FROM g)"""

QUERIES = {
    "layout_tables": (layout_tables, f"WITH {_O} SELECT doc_id, page, 1 AS table_no, x0::DOUBLE AS x0, 350.0::DOUBLE AS x1, 40.0::DOUBLE AS top, bottom::DOUBLE AS bottom, md5(markdown) AS markdown_md5 FROM m WHERE n > 1"),
    "layout_pages": (layout_pages, f"WITH {_O} SELECT doc_id, page, md5(CASE WHEN n > 1 THEN 'Orders overview' || chr(10) || 'End of page' || chr(10) || chr(10) || markdown ELSE 'Orders overview' || chr(10) || plain || chr(10) || 'End of page' END) AS text_md5 FROM m"),
}
