"""HTML pages to Markdown, with the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T

SKIP = {"script", "style", "meta", "head", "title"}
BLOCK = {"p", "div", "section", "article", "table", "ul", "ol", "blockquote", "figure", "header", "footer"}


class _Writer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.lists: list[list] = []
        self.link: list[tuple[str, int]] = []
        self.row: list[str] | None = None
        self.rows = 0
        self.pre = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in SKIP and tag != "meta":
            self.skip += 1
        if self.skip:
            return
        if tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * (len(self.lists) - 1) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "a":
            self.link.append((a.get("href") or "", len(self.out)))
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append("")
            self.out.append("\x00")
        elif tag in ("code",) and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "table":
            self.rows = 0
            self.out.append("\n\n")
        elif tag in BLOCK:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in SKIP and tag != "meta":
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n" if self.lists else "\n\n")
        elif tag == "a" and self.link:
            href, at = self.link.pop()
            label = "".join(self.out[at:])
            del self.out[at:]
            self.out.append(f"[{label}]({href})" if href else label)
        elif tag in ("td", "th") and self.row is not None:
            k = len(self.out) - 1
            while self.out[k] != "\x00":
                k -= 1
            self.row[-1] = " ".join("".join(self.out[k + 1 :]).split())
            del self.out[k:]
        elif tag == "tr" and self.row is not None:
            self.out.append("| " + " | ".join(self.row) + " |\n")
            self.rows += 1
            if self.rows == 1:
                self.out.append("|" + " --- |" * len(self.row) + "\n")
            self.row = None
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag in BLOCK or tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else data.replace("_", "\\_"))


def markdown(html: str) -> str:
    w = _Writer()
    w.feed(html)
    w.close()
    return "".join(w.out).replace("\x00", "")


def to_markdown(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The other columns and `markdown`: the page's body without technical noise, normalised; a null page stays null."""
    d = pages.withColumn("_h", T.without_noise(T.body(F.col(html_col)))).drop(html_col)

    def run(batches):
        for b in batches:
            md = [None if h is None else markdown(h) for h in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(md, pa.string())], names=[*b.schema.names[:-1], "markdown"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(run, f"{fields}, markdown string").withColumn("markdown", T.markdown_normalise(F.col("markdown")))
