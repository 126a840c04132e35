"""Breadth-first search deeper than any fixed number of levels, and over as many pages as the table has."""

from __future__ import annotations

from urllib.parse import urlsplit

import pytest

from tidewell.operators import web
from tidewell.plans import web_queries


def test_deep_chains_are_followed_to_their_end(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(55)] + [("55", "0"), ("x", "y")], "src string, dst string").coalesce(1)
    got = {x.node: x.depth for x in web.depths(edges.cache(), spark.createDataFrame([("0",)], "node string")).collect()}
    assert got == {str(i): i for i in range(56)}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_every_page_can_be_a_target(spark, size):
    d = f"/root/testdata/{size}"
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()
    to = {}
    for x in pages:
        host = urlsplit(x.url).netloc.lower()
        to.setdefault(f"p{x.page_id}", set()).add(host)
        to.setdefault(host, set()).add(f"p{(x.page_id * 7 + 3) % len(pages)}")
    want, level = {"p0": 0}, ["p0"]
    while level:
        level = sorted({b for a in level for b in to.get(a, ()) if b not in want})
        want |= dict.fromkeys(level, max(want.values()) + 1)
    assert {x.node: x.depth for x in web_queries.QUERIES["link_bfs_depth_whole"][0](spark, d).collect()} == want


def test_a_crawl_stops_at_any_budget(spark):
    """The queue itself, page by page, against the levels, for every budget."""
    from collections import deque

    from pyspark.sql import functions as F

    site = {f"http://a.lk/{k}": [f"http://a.lk/{(k * 3 + j * j) % 23}" for j in range(k % 5)] + (["http://b.lk/x", "/list?page=2", "doc.pdf", "pic.png"] if k % 4 == 0 else []) for k in range(0, 20)}
    rows = [(url, "".join(f'<a href="{x}">t</a>' for x in to)) for url, to in site.items()]
    pages = spark.createDataFrame(rows, "url string, html string")
    seeds = [("http://b.lk/seed", 0), ("http://a.lk/3/", 1), ("http://a.lk/7?page=1", 2), ("http://a.lk/3", 3), ("http://a.lk/8", 4)]

    def queue(most):
        left, queued, visited = deque(dict.fromkeys(s.rstrip("/") for s, _ in seeds)), set(), {}
        queued |= set(left)
        while left and len(visited) < most:
            url = left.popleft()
            status = "offsite" if "b.lk" in url else "skipped" if "page=" in url else "page" if url in site else "missing"
            visited[url] = len(visited) + 1, status
            for to in site.get(url, []) if status == "page" else []:
                if to.startswith("http://a.lk") and "page=" not in to and to not in queued:
                    queued.add(to)
                    left.append(to)
        return visited, bool(left)

    asked = spark.createDataFrame(seeds, "url string, seed_no int")
    for most in (0, 1, 4, 5, 9, 14, 1000):
        got = web.crawl(pages, asked, lambda domain: domain == "a.lk", most)
        want, left = queue(most)
        assert ({r.url: (r.visit_no, r.status) for r in got.visited.collect()}, got.truncated) == (want, left), most
    assert web.crawl(pages, asked.where(F.lit(False)), lambda domain: F.lit(True), 5).visited.count() == 0
