"""Main text of web pages as the maximum-scoring run of words and tags.

A page is a line of tokens. Words score positive and tags negative, with weights learned from
pages whose markup labels the article; the contiguous run with the largest sum is the content.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, by their part here.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template", "noscript")
BOILERPLATE = ("head", "nav", "footer", "aside", "form", "select", "button", "dialog", "menu", "svg", "canvas",
               "object", "audio", "video", "header")
BLOCKS = ("address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
          "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search",
          "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
ARTICLE = ("article", "main")
#: Words in class, id or role that mark a part of a page as no content, if the whole name is made of them and of ``PLACES``.
MARKS = ("ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
         "cookie", "consent", "disclaimer", "disqus", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter",
         "notice", "popup", "promo", "promoted", "related", "share", "sharing", "sidebar", "social", "sponsor",
         "sponsored", "subscribe", "toolbar", "widget")
#: Words that say only where or how large a part is: ``site-footer`` is a footer, but ``has-sidebar``, ``related-work``
#: and ``article-header`` say something else about what they hold.
PLACES = ("area", "bar", "block", "bottom", "box", "buttons", "container", "content", "fixed", "global", "icons", "inner", "left", "links", "list",
          "main", "page", "panel", "posts", "right", "section", "site", "slot", "sticky", "top", "wrap", "wrapper")
#: Elements whose end tag may be left out, with those that end them.
IMPLIED_END = {"p": BLOCKS, "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",),
               "td": ("td", "th", "tr"), "th": ("td", "th", "tr")}

BEGIN = re.compile(r"<(?:/?[A-Za-z]|[!?/])")
# Possessive, so that a tag is tried in one way from its beginning.
_NAME, _REST = r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)", r"<!--.*?(?:-->|\Z)|{}|<(?:[!?]|/(?![A-Za-z]))[^>]*+>"
TOKEN = re.compile(_REST.format(_NAME + r"((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"), re.S)
#: The same where a quote is never closed: a tag then ends at the first ``>``.
UNQUOTED = re.compile(_REST.format(_NAME + r"([^>]*+)>"), re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
LABEL = re.compile("<(?:article|main)", re.I)
NAME_PART = re.compile(r"[A-Za-z]+")
SPACE = re.compile(r"\s+")

#: Weights before any page is seen, and how many tokens they count for in the fit. Tags of running
#: text, and those in a part that is left out anyway, cost little.
PRIOR_WORD, PRIOR_TAG, PRIOR_TOKENS = 1.0, -3.0, 4.0
INLINE_TAG = -0.01
PROSE = ("a abbr b bdi bdo big blockquote br cite code del dfn em font h1 h2 h3 h4 h5 h6 i img ins kbd mark p pre q rp rt ruby s samp small "
         "span strike strong sub sup time tt u var wbr").split()
_RAW, _BOILER, _BLOCK, _VOID, _ARTICLE, _MARKS, _PLACES = map(frozenset, (RAW, BOILERPLATE, BLOCKS, VOID, ARTICLE, MARKS, PLACES))
_KNOWN = _RAW | _BOILER | _BLOCK | _VOID | frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output picture progress q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split())


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text) along a page: ``text`` runs, ``open`` / ``close`` tags; comments and raw elements are left out.

    Names outside the standard are given as ``other``, so the weights are a short table.
    """
    at, end, tag = 0, len(page), TOKEN
    while at < end:
        begin = BEGIN.search(page, at)
        m = tag.match(page, begin.start()) if begin else None
        if begin and m is None and tag is TOKEN:
            # A quote is never closed; from here on quotes are not looked at, so only one tag is read in vain.
            tag = UNQUOTED
            m = tag.match(page, begin.start())
        if m is None:
            # No tag ends behind this place.
            yield "text", "", page[at:].partition("<!--")[0]
            return
        if m.start() > at:
            yield "text", "", page[at:m.start()]
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in _RAW and not m[1] and not m[3].endswith("/"):
            # Up to its own end tag nothing in a raw element is markup.
            close = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = end if close is None else max(at, page.find(">", close.start()) + 1 or end)
            continue
        if name in _RAW:
            continue
        yield ("close" if m[1] else "open"), name, m[3] or ""


@lru_cache(maxsize=4096)
def _mark(name: str) -> bool:
    parts = {part.lower() for part in NAME_PART.findall(name)}
    return bool(parts & _MARKS) and parts <= _MARKS | _PLACES


def marked(attributes: str) -> bool:
    """Whether one of the names in class, id or role is made of ``MARKS`` and ``PLACES``, with a mark among them."""
    if "=" not in attributes:
        return False
    return any(_mark(name) for a in ATTRIBUTE.findall(attributes) for name in "".join(a).split())


class Scanner:
    """Adds to each token whether it stands in a part that is no content."""

    def __init__(self):
        self.skip, self.depth, self.article, self.seen = "", 0, 0, False

    def step(self, kind: str, name: str, attributes: str) -> bool:
        """Whether the token belongs to boilerplate; the body and the first article end an unclosed part.

        A part whose end tag may be left out also ends at the next element that ends it and with its parent.
        """
        if self.skip:
            implied = self.skip in IMPLIED_END
            if kind == "open":
                if name == "body" or name in _ARTICLE and not self.seen:
                    self.skip = ""
                elif implied and self.depth == 1 and name in IMPLIED_END[self.skip]:
                    self.skip = ""
                elif (name in _BLOCK and name not in IMPLIED_END if implied else name == self.skip) and name not in _VOID:
                    self.depth += 1
            elif kind == "close":
                if name == self.skip and (not implied or self.depth == 1):
                    self.depth -= 1
                    if not self.depth:
                        self.skip = ""
                        return True
                elif name in ("body", "html") or name in _ARTICLE and self.article:
                    self.skip = ""
                elif implied and name in _BLOCK and name not in IMPLIED_END:
                    self.depth -= 1
                    if not self.depth:
                        self.skip = ""
            if self.skip:
                return True
        if name in _ARTICLE:
            self.seen = True
            self.article = max(0, self.article + (1 if kind == "open" else -1 if kind == "close" else 0))
            # A reader's comment may be an article of its own.
            if kind == "open" and (self.article > 1 and name == "article" and marked(attributes)):
                self.skip, self.depth = name, 1
                self.article -= 1
                return True
            return False
        if kind == "open" and name not in _VOID and name not in ("html", "body"):
            if name in _BOILER and not (name == "header" and self.article) or marked(attributes):
                self.skip, self.depth = name, 1
                return True
        return False


SKIPPED = "skipped"


def _feature(kind: str, name: str, boiler: bool) -> str:
    if boiler:
        return SKIPPED
    return f"{'/' if kind == 'close' else ''}{name if name in _KNOWN else 'other'}"


def prior(feature: str) -> float:
    if feature == "word":
        return PRIOR_WORD
    return INLINE_TAG if feature == SKIPPED or feature.lstrip("/") in PROSE else PRIOR_TAG


def count_tokens(page: str, found: Counter) -> None:
    """Adds (feature, inside the labelled article or not) counts of a page that has such a label."""
    if not LABEL.search(page):
        return
    scan, inside = Scanner(), 0
    for kind, name, text in tokens(page):
        if kind == "text":
            boiler = bool(scan.skip)
            found["word", bool(inside) and not boiler] += len(text.split())
            continue
        if kind == "close" and name in _ARTICLE:
            inside = max(0, inside - 1)
        found[_feature(kind, name, scan.step(kind, name, text)), bool(inside) and not scan.skip] += 1
        if kind == "open" and name in _ARTICLE:
            inside += 1


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of a token inside and outside the labelled articles; words positive, tags negative.

    Tags that are commoner inside than outside, such as paragraphs, get ``INLINE_TAG``.
    Every feature starts from the prior weights, which alone hold where no page is labelled.
    """
    total = {side: sum(n for (_, s), n in counts.items() if s is side) + 1.0 for side in (True, False)}
    out = {"word": PRIOR_WORD}
    for feature in {f for f, _ in counts} - {SKIPPED}:
        n_in, n_out = counts.get((feature, True), 0), counts.get((feature, False), 0)
        odds = math.log((n_in + 0.5) / total[True]) - math.log((n_out + 0.5) / total[False])
        share = (n_in + n_out) / (n_in + n_out + PRIOR_TOKENS)
        w = share * odds + (1 - share) * prior(feature)
        out[feature] = max(w, 0.05) if feature == "word" else min(w, INLINE_TAG)
    return out


def content(page: str, weight: dict[str, float]) -> str:
    """The best run's blocks, joined by line ends; its boilerplate parts are left out."""
    word = weight["word"]
    # Kept runs of text with the number of their block, and a running sum that restarts below zero.
    runs: list[tuple[int, str]] = []
    block, score, begin, best, span = 0, 0.0, 0, 0.0, (0, 0)
    scan = Scanner()
    for kind, name, text in tokens(page):
        if kind == "text":
            if scan.skip:
                continue
            n = len(text.split())
            runs.append((block, text))
            score += n * word
            if score > best:
                best, span = score, (begin, len(runs))
            continue
        boiler = scan.step(kind, name, text)
        feature = _feature(kind, name, boiler)
        score += weight[feature] if feature in weight else prior(feature)
        if score < 0:
            score, begin = 0.0, len(runs)
        if name in _BLOCK:
            block += 1
        elif name == "br":
            runs.append((block, " "))
    lines: dict[int, list[str]] = {}
    for n, text in runs[slice(*span)]:
        lines.setdefault(n, []).append(text)
    # References are decoded once the block is whole, as one may end where a tag begins.
    blocks = (" ".join(html_lib.unescape("".join(parts)).split()) for parts in lines.values())
    return "\n".join(b for b in blocks if b)


def fit(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from all pages that mark their article; the counts are one short table per task."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for pdf in batches:
            for page in pdf["html"]:
                count_tokens(page, found)
        yield pd.DataFrame([(f, s, n) for (f, s), n in found.items()], columns=["feature", "inside", "n"])
    rows = (pages.select(F.coalesce(F.col(html_col), F.lit("")).alias("html"))
            .mapInPandas(count, "feature string, inside boolean, n long")
            .groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect())  # at most 4 rows per element name
    return weights({(r["feature"], r["inside"]): r["n"] for r in rows})


def extract(weight: dict[str, float], html_col: str = "html") -> Column:
    """The main text of each page: empty for null, for empty and for pages without words.

    Repeated pages give repeated results, an empty table an empty one; of equal runs the first is taken. No other
    column is read. A page of any length is read once, in linear time; a tag whose quotes never close ends at the first ``>``.
    """
    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([content(p, weight) if p else "" for p in pages], dtype=object)
    return of(F.col(html_col))
