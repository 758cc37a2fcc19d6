"""Markdown as blocks and back: headings, list runs, paragraphs; bold and links inside them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A block: kind (h1 to h3, p, ul, ol), and its lines, each a list of leaves: text, bold, url (null for no link).
BLOCKS = "array<struct<kind:string,lines:array<array<struct<text:string,bold:boolean,url:string>>>>>"


def blocks(markdown: Column, deepest: int = 3) -> Column:
    """The blocks of a markdown text, as BLOCKS; none for null and blank texts.

    A line of # signs and a blank is a heading, beyond `deepest` signs one of that depth; lines beginning with -, * or +
    are a list, lines beginning with a number and a dot or bracket an ordered one, and such lines next to each other are
    one block; other lines next to each other are a paragraph, joined by blanks; a blank line ends a block. Inside,
    **bold**, __bold__ and [text](url) are told; a mark that is not closed is text.
    """

    @F.pandas_udf(BLOCKS)
    def of(texts: pd.Series) -> pd.Series:
        import re

        head, bullet, number = re.compile(r"\s{0,3}(#+)\s+(.*?)\s*#*\s*$"), re.compile(r"\s*[-*+]\s+(.*)$"), re.compile(r"\s*\d+[.)]\s+(.*)$")
        inline = re.compile(r"\*\*(?P<b>.+?)\*\*|__(?P<u>.+?)__|\[(?P<t>[^\]]*)\]\((?P<url>[^()\s]*)\)")

        def leaves(line: str, bold: bool = False) -> list[dict]:
            out, at = [], 0
            for m in inline.finditer(line):
                if m.start() > at:
                    out.append({"text": line[at:m.start()], "bold": bold, "url": None})
                if m["url"] is not None:
                    out.append({"text": m["t"], "bold": bold, "url": m["url"]})
                else:
                    out += leaves(m["b"] or m["u"], True)
                at = m.end()
            return out + ([{"text": line[at:], "bold": bold, "url": None}] if at < len(line) else [])

        def parsed(text: str | None) -> list[dict]:
            out: list[dict] = []
            open_ = None  # the kind that the next line can go on with
            for line in (text or "").splitlines():
                if not line.strip():
                    open_ = None
                elif m := head.match(line):
                    out.append({"kind": f"h{min(len(m[1]), deepest)}", "lines": [leaves(m[2])]})
                    open_ = None
                else:
                    m, kind = (bullet.match(line), "ul") if bullet.match(line) else (number.match(line), "ol")
                    kind = kind if m else "p"
                    own = m[1].strip() if m else line.strip()
                    if kind == open_ and kind == "p":
                        out[-1]["text"] += " " + own
                    elif kind == open_:
                        out[-1]["lines"].append(leaves(own))
                    else:
                        out.append({"kind": kind, "lines": [leaves(own)]} if kind != "p" else {"kind": "p", "text": own})
                    open_ = kind
            return [{"kind": b["kind"], "lines": b["lines"] if "lines" in b else [leaves(b["text"])]} for b in out]

        return texts.map(parsed)

    return of(markdown)


def markdown_of(parsed: Column) -> Column:
    """The text that blocks reads back as the same blocks. Built-in functions only; Spark takes no Python function of such an
    expression, so write it as a column first."""
    def leaf(x: Column) -> Column:
        text = F.when(x["url"].isNotNull(), F.concat(F.lit("["), x["text"], F.lit("]("), x["url"], F.lit(")"))).otherwise(x["text"])
        return F.when(x["bold"], F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text)

    line = lambda leaves: F.array_join(F.transform(leaves, leaf), "")

    def block(b: Column) -> Column:
        mark = lambda i: F.when(b["kind"] == "ul", "- ").when(b["kind"] == "ol", F.concat((i + 1).cast("string"), F.lit(". "))).when(b["kind"] == "p", "").otherwise(F.concat(F.repeat(F.lit("#"), F.substring(b["kind"], 2, 1).cast("int")), F.lit(" ")))
        return F.array_join(F.transform(b["lines"], lambda ls, i: F.concat(mark(i), line(ls))), "\n")

    return F.array_join(F.transform(parsed, block), "\n\n")


def plain_text(parsed: Column) -> Column:
    """All leaves of the blocks joined by blanks, links followed by (url), white space evened out."""
    leaf = lambda x: F.concat(x["text"], F.when(x["url"].isNotNull(), F.concat(F.lit(" ("), x["url"], F.lit(")"))).otherwise(""))
    lines = F.flatten(F.transform(parsed, lambda b: b["lines"]))
    return F.trim(F.regexp_replace(F.array_join(F.transform(F.flatten(lines), leaf), " "), r"[\s\x{A0}]+", " "))
