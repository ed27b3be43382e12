"""Main text of landed pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_DROPPED = {"script", "style", "nav", "footer", "header", "aside", "form"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CONTENT = re.compile("content|body|article", re.IGNORECASE)


class _Area:
    """Text of one kind of container: its paragraphs, and all of it."""

    def __init__(self) -> None:
        self.paragraphs: list[list[str]] = []
        self.texts: list[str] = []
        self.depth = -1
        self.done = False


class _Reader(HTMLParser):
    """Follows the first article, main, content-like div and body at once; the first of these that exists is used."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.dropped = 0
        self.areas = {k: _Area() for k in ("article", "main", "div", "body")}
        self.paragraphs = 0

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        self.stack.append(tag)
        self.dropped += tag in _DROPPED
        if self.dropped:
            return
        kind = tag if tag in self.areas else None
        if tag == "div" and not any(_CONTENT.search(v or "") for k, v in attrs if k == "class"):
            kind = None
        if kind and self.areas[kind].depth < 0 and not self.areas[kind].done:
            self.areas[kind].depth = len(self.stack)
        if tag == "p":
            self.paragraphs += 1
            for area in self._open():
                area.paragraphs.append([])

    def _open(self):
        return [a for a in self.areas.values() if a.depth > 0]

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            for area in self._open():
                if area.depth == len(self.stack):
                    area.depth, area.done = -1, True
            top = self.stack.pop()
            self.dropped -= top in _DROPPED
            self.paragraphs -= top == "p" and not self.dropped and self.paragraphs > 0
            if top == tag:
                break

    def handle_data(self, data):
        if self.dropped:
            return
        for area in self._open():
            area.texts.append(data)
            if self.paragraphs and area.paragraphs:
                area.paragraphs[-1].append(data)


def page_text(html: str) -> str | None:
    """Boilerplate elements are left out; of the content area, paragraphs if there are any, else all lines."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    area = next((a for a in reader.areas.values() if a.done or a.depth > 0), None)
    if area is None:
        return None
    if area.paragraphs:
        joined = "\n\n".join(t for t in ("".join(p).strip() for p in area.paragraphs) if t)
    else:
        joined = "\n".join(area.texts)
    return "\n".join(line.strip() for line in joined.split("\n") if line.strip()) or None


@pandas_udf(T.StringType())
def extract_article_text(html: pd.Series) -> pd.Series:
    return html.map(lambda h: page_text(h) if h else None)


@pandas_udf(T.StringType())
def strip_tags(html: pd.Series) -> pd.Series:
    """All text of a fragment, without tags, trimmed; null if nothing is left."""

    def run(fragment: str | None) -> str | None:
        parts: list[str] = []
        parser = HTMLParser(convert_charrefs=True)
        parser.handle_data = parts.append
        parser.feed(fragment or "")
        parser.close()
        return "".join(parts).strip() or None

    return html.map(run)
