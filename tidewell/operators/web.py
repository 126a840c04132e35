"""Crawl frontier, link tables and curation of pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import urls as u
from tidewell.operators import records
from tidewell.operators.sizes import cut, kept

#: Characters that a curated page has at least.
MIN_CHARS = 200
#: Addresses are numbered in runs of so many parents.
RUN = 1000


def link_table(pages: DataFrame) -> DataFrame:
    """``pages(url, html)`` as ``(src, dst, kind)``: normalised, distinct; pdf, skipped, asset, internal or offsite."""
    raw = pages.select("url", F.explode(u.links(F.col("html"))).alias("href"))
    full = raw.select(u.normalize(F.col("url")).alias("src"), u.normalize(u.resolve(F.col("url"), F.col("href"))).alias("dst"))
    kind = F.when(u.is_pdf(F.col("dst")), "pdf").when(u.is_skipped(F.col("dst")), "skipped").when(~u.is_page(F.col("dst")), "asset") \
        .when(u.domain(F.col("src")) == u.domain(F.col("dst")), "internal").otherwise("offsite")
    return full.where("dst <> ''").distinct().withColumn("kind", kind)


def ordered_links(pages: DataFrame) -> DataFrame:
    """``pages(url, html)`` as ``(src, dst, link_no)``: normalised; a target has the place of its first link on the page."""
    raw = pages.select("url", F.posexplode(u.links(F.col("html"))).alias("link_no", "href"))
    full = raw.select(u.normalize(F.col("url")).alias("src"), u.normalize(u.resolve(F.col("url"), F.col("href"))).alias("dst"), "link_no")
    return full.where("dst <> ''").groupBy("src", "dst").agg(F.min("link_no").alias("link_no"))


@dataclass(frozen=True)
class Crawl:
    """What a crawl took, and whether it left anything."""

    visited: DataFrame  # url, visit_no, depth, status: page, offsite, skipped or missing
    truncated: bool


def crawl(pages: DataFrame, seeds: DataFrame, allowed: Callable[[Column], Column], max_pages: int, max_depth: int | None = None) -> Crawl:
    """The first ``max_pages`` addresses that a first-come, first-served crawl from ``seeds(url, seed_no)`` visits, in its order.

    ``pages(url, html)`` stand for the sites; addresses without a page are ``missing``.  All that is visited counts, what is
    offsite or skipped too; only links that stay within ``allowed`` domains, are pages and aren't skipped are put in the queue,
    each when it is met first.  So an address comes after the page that it is met on first, in order of
    links: levels are numbered one after the other, by the place of the parent and of the link, which is the queue's order
    without a queue.  A level past the budget ends the crawl; what is left makes it ``truncated``.  Any budget gives the beginning of a larger one's order.

    Pages of one normalised address count as the first by their own, of several with that the one with the smallest ``page_id``,
    if pages have one, then the smallest text; seeds keep the smallest number.  No seeds give no rows.
    """
    first_of = F.struct("url", *(c for c in ("page_id",) if c in pages.columns), "html")
    one = pages.select(u.normalize(F.col("url")).alias("page"), first_of.alias("own")).groupBy("page").agg(F.min("own").alias("own")).select("page", "own.html")
    wanted = lambda c: allowed(u.domain(c)) & ~u.is_skipped(c)
    edges = kept(ordered_links(one.select(F.col("page").alias("url"), "html")).where(wanted(F.col("dst")) & u.is_page(F.col("dst")) & ~u.is_pdf(F.col("dst"))))  # texts are read once
    known = kept(one.select("page"))
    first = seeds.select(u.normalize(F.col("url")).alias("url"), "seed_no").groupBy("url").agg(F.min("seed_no").alias("seed_no"))
    frontier = kept(records.numbered(first, ["seed_no", "url"], F.floor(F.col("seed_no") / RUN)).select("url", F.col("nth").cast("long").alias("visit_no"), F.lit(0).alias("depth")))
    seen, total, truncated = frontier.select("url"), 0, False
    levels: list[DataFrame] = []
    while n := frontier.count():
        truncated = total + n > max_pages
        status = F.when(~allowed(u.domain(F.col("url"))), "offsite").when(u.is_skipped(F.col("url")), "skipped").when(F.col("page").isNull(), "missing").otherwise("page")
        level = kept(frontier.where(F.col("visit_no") <= max_pages).join(known, F.col("url") == F.col("page"), "left").withColumn("status", status).drop("page"))
        levels.append(level)
        total += n
        if truncated or max_depth is not None and len(levels) > max_depth:
            break
        met = level.where("status = 'page'").join(edges, F.col("url") == F.col("src")).groupBy("dst").agg(F.min(F.struct("visit_no", "link_no")).alias("at"))
        new = met.join(seen.select(F.col("url").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("url"), "at.visit_no", "at.link_no")
        placed = records.numbered(new, ["visit_no", "link_no", "url"], F.floor(F.col("visit_no") / RUN))
        frontier = kept(placed.select("url", (F.col("nth") + total).alias("visit_no"), F.lit(len(levels)).alias("depth")))
        seen = kept(seen.unionByName(frontier.select("url")))
    if not levels:
        return Crawl(frontier.withColumn("status", F.lit("")), False)
    return Crawl(reduce(DataFrame.unionByName, levels), truncated)


def depths(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(node, depth)`` from ``seeds(node)`` along ``edges(src, dst)``: breadth first, one join a level.

    The frontier loses visited nodes by an anti join; lineage is cut every level.  The search ends when
    a level finds no new node, or after ``max_depth`` levels if that is given.
    """
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        following = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        following = cut(following.withColumn("depth", F.lit(depth)))
        if following.isEmpty():
            break
        seen = cut(seen.unionByName(following))
        frontier = following
    return seen


def found_on(edges: DataFrame) -> DataFrame:
    """Each PDF with the sorted pages that link to it."""
    return edges.where("kind = 'pdf'").groupBy("dst").agg(F.sort_array(F.collect_set("src")).alias("found_on"))


def curation(pages: DataFrame) -> DataFrame:
    """``pages(url, text)`` with ``status`` (drop, empty, keep), ``category`` and ``slug``."""
    p = u.path(F.col("url"))
    status = F.when(~u.keeps_html(p), "drop").when(F.char_length(F.coalesce("text", F.lit(""))) < MIN_CHARS, "empty").otherwise("keep")
    return pages.withColumns({"status": status, "category": u.category(p), "slug": u.slug(F.col("url"))})
