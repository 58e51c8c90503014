"""Text of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_RAW = ("script", "style", "iframe", "noembed", "noframes", "noscript", "xmp")
_HIDDEN = ("script", "style", "noscript")


class _TextNodes(HTMLParser):
    """Trimmed text nodes in document order; tags and comments separate them."""

    CDATA_CONTENT_ELEMENTS = _RAW

    def __init__(self, hidden: tuple[str, ...] = ()):
        super().__init__(convert_charrefs=True)
        self._hidden, self._skip, self._open, self.nodes = hidden, "", [], []

    def _flush(self) -> None:
        text = "".join(self._open).strip()
        self._open.clear()
        if text:
            self.nodes.append(text)

    def handle_data(self, data: str) -> None:
        if not self._skip:
            self._open.append(data)

    def handle_starttag(self, tag, attrs) -> None:
        self._flush()
        if tag in self._hidden and not self._skip:
            self._skip = tag

    def handle_endtag(self, tag) -> None:
        self._flush()
        if tag == self._skip:
            self._skip = ""

    def handle_comment(self, data) -> None:
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def text(self) -> str:
        self.close()
        self._flush()
        return " ".join(self.nodes)


def page_text(html: str | None, strip_scripts: bool = False) -> str | None:
    if html is None:
        return None
    parser = _TextNodes(_HIDDEN if strip_scripts else ())
    parser.feed(html)
    return parser.text()


def visible_text(html: Column, strip_scripts: bool = False) -> Column:
    """All text nodes joined by blanks, scripts and styles included unless
    stripped. The page is parsed whole, one Arrow batch at a time."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: page_text(page, strip_scripts))

    return run(html)
