"""Functions no built-in expresses, as Arrow UDFs: composed form, markup to text, the first JSON object."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements whose text isn't part of a page's.
SKIPPED = frozenset(("script", "style", "nav", "header", "footer", "aside"))
#: Elements of a book's chapter that are dropped besides.
SKIPPED_IN_BOOKS = SKIPPED | frozenset(("sup", "sub", "figure", "figcaption"))
#: Elements without an end tag, which open nothing.
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode composed form; null stays null."""
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


class _Text(HTMLParser):
    def __init__(self, skipped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.skipped, self.inside, self.pieces = skipped, [], []

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID and (self.inside or tag in self.skipped):
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag) :]

    def handle_data(self, data):
        if not self.inside:
            self.pieces.append(data)


def html_text(page: str | bytes | None, skipped: frozenset[str] = SKIPPED, separator: str = "\n") -> str | None:
    """The text of a page's elements joined by the separator, without that of the skipped ones. Broken markup is read as far as it goes."""
    if page is None:
        return None
    parser = _Text(skipped)
    parser.feed(page.decode("utf-8", "replace") if isinstance(page, bytes) else page)
    parser.close()
    return separator.join(parser.pieces)


@F.pandas_udf(StringType())
def html_to_text(s: pd.Series) -> pd.Series:
    return s.map(html_text, na_action="ignore")


def _balanced(text: str) -> Iterator[str]:
    """The stretches from a brace that opens at balance zero to the one that brings the balance back to zero."""
    braces = list(re.finditer(r"[{}]", text))
    balance = list(accumulate(1 if m[0] == "{" else -1 for m in braces))
    opens = (m.start() for m, b in zip(braces, balance) if m[0] == "{" and b == 1)
    closes = (m.end() for m, b in zip(braces, balance) if m[0] == "}" and b == 0)
    return (text[i:j] for i, j in zip(opens, closes))


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def find_json(text: str | None) -> str | None:
    """The first well-formed JSON object in braces that balance; null if there is none.

    Braces inside strings count; a closing brace before any opening one leaves the balance off, as the rule has it.
    """
    return next(filter(_is_json, _balanced(text or "")), None)


@F.pandas_udf(StringType())
def first_json(s: pd.Series) -> pd.Series:
    return s.map(find_json, na_action="ignore")


#: Elements of wikitext that are dropped with what they hold.
_WIKI_DROPPED = re.compile(r"<!--.*?-->|<(ref|gallery|math|timeline|score|syntaxhighlight|nowiki|code|pre|imagemap)\b[^>]*?(?:/>|>.*?</\1\s*>)", re.S | re.I)
#: Two signs that open or close a template, a table or a link.
_WIKI_BRACKET = re.compile(r"\{\{|\}\}|\{\||\|\}(?!\})|\[\[|\]\]")
_WIKI_CLOSES = {"}}": "{{", "|}": "{|", "]]": "[["}
#: Namespaces whose links show no text of their own.
_WIKI_UNSHOWN = re.compile(r"\s*(?:file|image|immagine|category|categoria|[a-z]{2,3}(?=:[^ ]))\s*:", re.I)


def _wiki_link(inside: str) -> str:
    """What a link shows: its last part, or nothing of files, categories and other languages."""
    return "" if _WIKI_UNSHOWN.match(inside) else inside.rpartition("|")[2]


def wiki_plain(text: str | None) -> str | None:
    """The plain text of a page's wikitext: templates, tables, references and files are dropped, links leave what they show.

    Brackets that don't match stay as they are. Headings stay on their lines, for the cleaning of articles to drop.
    """
    if text is None:
        return None
    text = _WIKI_DROPPED.sub("", text)
    pieces: list[str] = [""]  # of the text outside, and of each bracket that is open
    opened: list[str] = []
    at = 0
    for m in _WIKI_BRACKET.finditer(text):
        pieces[-1] += text[at : m.start()]
        at = m.end()
        if m[0] not in _WIKI_CLOSES:
            opened.append(m[0])
            pieces.append("")
        elif _WIKI_CLOSES[m[0]] in opened:
            while opened[-1] != _WIKI_CLOSES[m[0]]:  # brackets left open inside
                inner, sign = pieces.pop(), opened.pop()
                pieces[-1] += sign + inner
            inside, sign = pieces.pop(), opened.pop()
            pieces[-1] += _wiki_link(inside) if sign == "[[" else ""
        else:
            pieces[-1] += m[0]
    pieces[-1] += text[at:]
    out = pieces[0] + "".join(sign + inner for sign, inner in zip(opened, pieces[1:]))
    out = re.sub(r"\[(?:https?:|ftp:)?//[^\s\]]+ ?([^\]\n]*)\]", r"\1", out)
    out = re.sub(r"'{2,}|__[A-Z]+__|</?[a-zA-Z][^<>]*>", "", out)
    out = re.sub(r"(?m)^[*#:;]+[ \t]*", "", out)
    return re.sub(r"\n{3,}", "\n\n", html.unescape(out)).strip()


@F.pandas_udf(StringType())
def wikitext(s: pd.Series) -> pd.Series:
    return s.map(wiki_plain, na_action="ignore")
