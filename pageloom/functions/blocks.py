"""Listing blocks of a page, read with an HTML parser because regexes see no nesting."""

from __future__ import annotations

import sys
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.fixed import BLOCK_CLASSES

# The parser travels inside the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_TAGS = ("div", "article", "section")
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCK = "array<struct<block_no:int,tag:string,class:string,text:string,is_outermost:boolean>>"


class _Blocks(HTMLParser):
    """Collects the text of the page's listing blocks once, and for each element whose class names a listing the place
    in it where the element begins and ends.

    An element that is never closed ends where the next listing opens, so a page of unclosed listings does not hold its
    text once for each of them.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict | None]] = []
        self.names: Counter[str] = Counter()
        self.found: list[dict] = []
        self.open: list[dict] = []
        self.parts: list[str] = []
        self.size = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = None
        classes = (dict(attrs).get("class") or "").lower()
        if tag in BLOCK_TAGS and any(word in classes for word in BLOCK_CLASSES):
            parent = self.open[-1] if self.open else None
            block = {"tag": tag, "class": classes, "begin": self.size, "end": None, "parent": parent}
            self.found.append(block)
            self.open.append(block)
        if tag not in VOID_TAGS:
            self.stack.append((tag, block))
            self.names[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if not self.names[tag]:
            return
        while self.stack:
            name, block = self.stack.pop()
            self.names[name] -= 1
            if block is not None:
                block["end"] = self.size
                self.open.pop()  # blocks close in the order of the stack
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.stack[-1][0] not in ("script", "style"):
            self.parts.append(data)
            self.size += len(data)


def _parse(html: str | None) -> list[dict]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    text = "".join(parser.parts)
    out: list[dict] = []
    for number, block in enumerate(parser.found):
        follows = parser.found[number + 1]["begin"] if number + 1 < len(parser.found) else len(text)
        closed, parent = block["end"] is not None, block["parent"]
        # What an unclosed element holds lies outside it.
        block["outer"] = parent is None or (parent["end"] is None and parent["outer"])
        cut = text[block["begin"] : block["end"] if closed else follows]
        out.append(
            {"block_no": number, "tag": block["tag"], "class": block["class"], "text": cut, "is_outermost": block["outer"]}
        )
    return out


def html_blocks(html: Column) -> Column:
    """array<struct<block_no, tag, class, text, is_outermost>> in document order."""

    @F.pandas_udf(BLOCK)
    def blocks(pages: pd.Series) -> pd.Series:
        return pages.map(_parse)

    return blocks(html)
