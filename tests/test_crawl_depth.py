"""A crawl that stops at a depth, and pages that share an address."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import web


def visits(crawl):
    return [(x.url.rsplit("/", 1)[-1], x.depth) for x in crawl.visited.orderBy("visit_no").collect()]


def test_depth_and_pages_of_one_address(spark):
    link = lambda i: f'<a href="http://a.b/{i}">x</a>'
    rows = [(i, f"http://a.b/{i}", link(i + 1)) for i in range(4)] + [(9, "http://a.b/1", link("later")), (7, "http://a.b/1", link("late"))]
    everything = lambda domain: F.lit(True)
    for order in (rows, rows[::-1]):
        pages = spark.createDataFrame(order, "page_id long, url string, html string")
        seeds = pages.where("page_id = 0").select("url", F.col("page_id").alias("seed_no"))
        assert visits(web.crawl(pages, seeds, everything, 100)) == [("0", 0), ("1", 1), ("2", 2), ("3", 3), ("4", 4)]
        done = web.crawl(pages, seeds, everything, 100, 2)
        assert visits(done) == [("0", 0), ("1", 1), ("2", 2)] and not done.truncated
