"""Page parser: raw page to title, clean text, elements and links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_SKIP = {"script", "style", "template", "noscript"}
_BLOCK = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "br", "article", "nav", "section", "table"}

PARSED = (
    "page_id bigint, title string, text string, elements array<struct<tag:string,pos:int>>, "
    "links array<string>, error string"
)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] = []
        self.text: list[str] = []
        self.elements: list[tuple[str, int]] = []
        self.links: list[str] = []
        self._skip = 0
        self._in_title = False

    def handle_starttag(self, tag, attrs):
        self.elements.append((tag, len(self.elements)))
        if tag in _SKIP:
            self._skip += 1
        if tag == "title":
            self._in_title = True
        if tag in _BLOCK:
            self.text.append(" ")
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        if tag in _SKIP and self._skip:
            self._skip -= 1
        if tag == "title":
            self._in_title = False

    def handle_data(self, data):
        if self._in_title:
            self.title.append(data)
        elif not self._skip:
            self.text.append(data)


def parse_pages(pages: DataFrame, key: str = "page_id", body: str = "html", max_chars: int = 5_000_000) -> DataFrame:
    """One row per page. A page that fails or is over the size limit becomes an
    error row with no partial content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, html in zip(batch[key], batch[body]):
                try:
                    if html is None:
                        raise ValueError("empty page")
                    if len(html) > max_chars:
                        raise ValueError("page over size limit")
                    r = _Reader()
                    r.feed(html)
                    r.close()
                    elements = [{"tag": t, "pos": i} for t, i in r.elements]
                    rows.append((k, "".join(r.title).strip(), " ".join("".join(r.text).split()), elements, r.links, None))
                except Exception as exc:  # noqa: BLE001
                    rows.append((k, None, None, None, None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(rows, columns=["page_id", "title", "text", "elements", "links", "error"])

    return pages.select(F.col(key).cast("bigint").alias(key), body).mapInPandas(run, PARSED)


def page_elements(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is null").select("page_id", F.explode("elements").alias("e")).select("page_id", "e.tag", "e.pos")
