"""HTML to text by one pass over the characters (T4).

A page is a row of tokens: text, tags, comments and declarations. The reader goes from one ``<`` to the
next and tells by what follows which token begins; a tag ends at the first ``>`` outside a quoted
attribute value. Scripts, styles and the like are raw text up to their own end tag. What is left
open at the end of a page is closed there. Character references of every kind are decoded in the
text only, so markup that a page writes out stays text.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose content is no visible text, elements with text but no tags inside.
UNSEEN = {"script", "style", "noscript", "template", "title", "iframe", "noembed", "noframes"}
LITERAL = {"textarea", "xmp"}
# Elements that begin or end a line.
LINES = {
    "p", "div", "br", "hr", "li", "ul", "ol", "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th",
    "table", "section", "article", "header", "footer", "nav", "main", "aside", "blockquote", "pre", "form", "figure",
}

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
# up to the end of the tag; a quote counts only where a value begins
REST = re.compile(r"""[^>=]*+(?:=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+[^>=]*+)*+(?:>|\Z)""")
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in UNSEEN | LITERAL}
BLANK = re.compile(r"[ \t\r\x0B\f\xa0]+")
GAP = re.compile(r" ?\n[ \n]*")


def visible(page: str) -> list[str]:
    """Pieces of visible text, references decoded, with a line feed for every tag that breaks the line."""
    out, at, size = [], 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        # a "<" that begins no markup is text: go on to the next one
        while mark < size and not (page[mark + 1:mark + 2].isascii() and page[mark + 1:mark + 2].isalpha()
                                   or page[mark + 1:mark + 2] in ("/", "!", "?")):
            mark = page.find("<", mark + 1)
            if mark < 0:
                mark = size
        if mark > at:
            out.append(html.unescape(page[at:mark]))
        if mark == size:
            break
        if page.startswith("<!--", mark):
            # "<!-->" and "<!--->" are whole comments
            short = 5 if page.startswith("<!-->", mark) else 6 if page.startswith("<!--->", mark) else 0
            end = page.find("-->", mark + 4)
            at = mark + short if short else size if end < 0 else end + 3
            continue
        name = NAME.match(page, mark + 1)
        if not name:  # a declaration, or an end tag without a name
            end = page.find(">", mark)
            at = size if end < 0 else end + 1
            continue
        at = REST.match(page, name.end()).end()
        tag = name[1].lower()
        if tag in LINES:
            out.append("\n")
        if page[mark + 1] != "/" and tag in CLOSING:
            closing = CLOSING[tag].search(page, at)
            end = closing.start() if closing else size
            if tag in LITERAL:
                out.append(html.unescape(page[at:end]) if tag == "textarea" else page[at:end])
            at = end
    return out


def plain(page: str | None) -> str | None:
    """Visible text of a page, one line per block, blanks joined."""
    if page is None:
        return None
    return GAP.sub("\n", BLANK.sub(" ", "".join(visible(page)))).strip(" \n")


@F.pandas_udf(T.StringType())
def page_text(pages: pd.Series) -> pd.Series:
    """T4: ``plain`` of every page; null stays null, a page without text gives an empty one."""
    return pages.map(plain, na_action="ignore")
