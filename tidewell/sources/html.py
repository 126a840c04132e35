"""Text of web pages by the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# fixed values: elements and classes or ids whose contents are dropped, where the main text is, elements without an end
DROP_TAGS = {"script", "style", "noscript", "nav", "header", "footer", "form", "iframe", "svg", "button"}
DROP_MARKS = {".region-header", ".region-footer", ".region-navigation", ".breadcrumb", "#navbar", "#footer", "#header", ".site-footer", ".site-header", ".menu", ".skip-link", ".sidebar",
              "#sidebar-first", "#sidebar-second", ".block-menu", ".social", ".search-block-form"}
MAIN_MARKS = ["main", "#content", ".region-content", "#main-content", ".main-content", "#block-system-main", ".node__content"]
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, set[str], bool]] = []  # tag, marks, dropped
        self.texts: dict[str, list[str]] = {"": []}  # by main mark (first element only); "": the body
        self.closed: set[str] = set()
        self.title: list[str] = []
        self.heading: list[str] = []
        self.canonical = ""

    def handle_starttag(self, tag, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "link" and a.get("rel", "").lower() == "canonical":
            self.canonical = self.canonical or a.get("href", "")
        if tag in VOID_TAGS:
            return
        marks = {tag, *(f".{c}" for c in a.get("class", "").split()), *([f"#{a['id']}"] if a.get("id") else [])}
        inside = bool(self.open and self.open[-1][2])
        self.open.append((tag, marks, inside or tag in DROP_TAGS or bool(marks & DROP_MARKS)))

    def handle_endtag(self, tag) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                for _, marks, _ in self.open[at:]:
                    self.closed |= {m for m in marks if m in self.texts}
                del self.open[at:]
                return

    def handle_data(self, data) -> None:
        tags = [t for t, _, _ in self.open]
        if "title" in tags:
            self.title.append(data)
            return
        if self.open and self.open[-1][2]:
            return
        if "h1" in tags:
            self.heading.append(data)
        self.texts[""].append(data)
        for mark in {m for _, marks, _ in self.open for m in marks if m in MAIN_MARKS} - self.closed:
            self.texts.setdefault(mark, []).append(data)


def read_page(html: str | None) -> tuple[str, str, str]:
    """Title, canonical address and text: non-blank stripped lines of the first main element, else of the whole page."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    where = next((m for m in MAIN_MARKS if m in reader.texts), "")
    lines = (line.strip() for line in "\n".join(reader.texts[where]).splitlines())
    title = re.sub(r"\s+", " ", "".join(reader.title)).strip() or "".join(reader.heading).strip()
    return title, reader.canonical, "\n".join(filter(None, lines))


def page_text(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` as ``(page_id, url, title, canonical, text)``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [read_page(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "title": [r[0] for r in read], "canonical": [r[1] for r in read], "text": [r[2] for r in read]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, canonical string, text string")
