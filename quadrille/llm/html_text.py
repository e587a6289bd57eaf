"""Operator 5: main text of a page as a maximum-scoring subsequence.

A page becomes a row of tokens: words, which score positive, tags, which score negative, and whole elements of a kind that may be boilerplate (by tag or by a word
of class, id or role), each of which scores by its kind.  Weights are log odds of a token's kind inside and outside the content, counted on labelled pages
(pages that mark their article) over a small prior.  One linear scan finds the contiguous region of the highest sum; an element that marks the article and that
the region touches is taken whole, so nothing of an article is given up.  Inside the region, the same weights decide on each element of a suspect kind:
it is left out where they are negative.  The blocks of what remains are returned.

Null and empty html, and pages without words outside such elements: an empty text.  Unclosed boilerplate ends where an article begins.  Ties: the first
region.  Very long pages: linear work, one string and one list of tokens each.  An empty table, or no labelled page: the prior alone gives the weights.  Repeated rows and
extra columns pass through; a column named as the result is replaced.
"""

import html as html_lib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import struct_udf, table

#: Labelled pages read for the weights at most, taken in a seeded order, of at most so many characters each.
LABELLED_PAGES = 200
LABELLED_CHARS = 200_000

RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "select", "title"}
DROPPED = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head", "label", "fieldset"}
MAIN = {"article", "main"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | DROPPED
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words in class, id or role that mark an element as no article text.
MARKS = {"nav", "navbar", "navigation", "menu", "header", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "newsletter", "subscribe", "subscription", "comment", "comments", "disqus", "reply", "replies", "respond", "social", "share", "sharing", "related", "breadcrumb", "breadcrumbs", "pagination", "pager", "widget", "login", "search", "contentinfo", "complementary", "alert", "dialog", "form"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
MARKED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
APART = re.compile(r"[^a-z0-9]+")


def suspicion(name: str, attributes: str) -> str:
    """The kind of boilerplate that an element may be, by its tag or a word of its class, id or role; empty if none."""
    if name in DROPPED:
        return name
    return next((w for m in MARKED.finditer(attributes) for w in APART.split((m[1] or m[2] or m[3] or "").lower()) if w in MARKS), "")


def tokens(page: str):
    """(kind, words, main, text) in page order.  kind: a tag's name, with a slash before it if it closes, or word, link (in a link) or a suspect element's with a question
    mark before it; main: the number of the article element that a token stands in, 0 outside."""
    at, end = 0, len(page)
    dropping, suspect, depth, links, main, mains, opened = "", "", 0, 0, 0, 0, []

    def text(a: int, b: int):
        raw = page[a:b]
        if "&" in raw:
            raw = html_lib.unescape(raw)
        n = len(raw.split())
        if raw:
            yield (suspect if dropping else "link" if links else "word"), n, main, raw

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            yield from text(at, end)
            return
        if m.start() > at:
            yield from text(at, m.start())
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield from text(m.start() + 9, m.end() - 3)
            continue
        closes, name, attributes = bool(m[1]), m[2].lower(), m[3]
        if not closes and name in RAW and not attributes.rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in MAIN or name == "body":
            dropping, depth = "", 0
        if dropping:
            if name == dropping and name not in VOID and not attributes.endswith("/"):
                depth += -1 if closes else 1
                if not depth:
                    dropping = ""
                    yield "/?", 0, main, None
            elif name in BLOCKS:
                yield "?block", 0, main, None
            continue
        if not closes and name not in VOID and name not in MAIN and name not in ("body", "html") and not attributes.endswith("/") and (why := suspicion(name, attributes)):
            dropping, suspect, depth = name, f"?{why}", 1
            yield suspect, 0, main, None
            continue
        if name in MAIN:
            if not closes:
                mains += 1
                opened.append(mains)
            elif opened:
                opened.pop()
            inside = opened[0] if opened else 0
            yield ("/" if closes else "") + name, 0, (inside if not closes else main), None
            main = inside
            continue
        if name == "a":
            links = 0 if closes else 1
        elif name in BLOCKS:
            links = 0
        yield ("/" if closes else "") + name, 0, main, None


#: Counts that all pages are taken to add to: (inside, outside) of a word, a word in a link, a suspect element and any other tag.
PRIOR = {"word": (30.0, 3.0), "link": (2.0, 4.0), "?": (0.5, 4.0), "": (1.0, 4.0)}


def prior(kind: str) -> tuple[float, float]:
    return PRIOR.get(kind) or PRIOR["?" if kind[0] == "?" else ""]


def weights_from(pages: list[str]) -> dict[str, float]:
    """Log odds of each kind of token inside and outside the marked article.  As the method has it, words score positive and tags negative, whatever the pages say."""
    inside, outside = Counter(), Counter()
    for page in pages:
        for kind, words, main, text in tokens(page):
            if kind in INNER:
                continue
            if text is None:
                # A suspect element is no content, wherever it stands on a labelled page.
                (inside if main and kind[0] != "?" else outside)[kind] += 1
            elif kind[0] != "?":
                (inside if main else outside)[kind] += words
    kinds = {"word", "link", "?", *inside, *outside}
    n, m = (sum(c.values()) + sum(prior(k)[side] for k in kinds) for side, c in enumerate((inside, outside)))
    w = {k: math.log((inside[k] + prior(k)[0]) / n) - math.log((outside[k] + prior(k)[1]) / m) for k in kinds}
    return {k: max(LEAST, min(3.0, v)) if k == "word" else min(0.0, max(-3.0, v)) if k == "link" else max(-3.0, min(-LEAST, v)) for k, v in w.items()}


#: Tokens that only mark blocks in a suspect element and its end.
INNER = ("?block", "/?")
#: How far from 0 the weights of words and tags are at least.
LEAST = 0.05


class Extractor:
    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def weight(self, kind: str) -> float:
        w = self.weights
        return w[kind] if kind in w else w.get("?", -1.0) if kind[0] == "?" else -0.25

    def scores(self, toks: list) -> list[float]:
        """A text scores by its words; a suspect element once, whatever it holds."""
        return [0.0 if kind in INNER else self.weight(kind) if text is None else 0.0 if kind[0] == "?" else self.weight(kind) * words for kind, words, _, text in toks]

    def region(self, toks: list) -> tuple[int, int]:
        """The first and the end of the maximum-scoring run of tokens."""
        best, run, start, found = 0.0, 0.0, 0, (0, 0)
        for k, score in enumerate(self.scores(toks)):
            if run <= 0:
                run, start = 0.0, k
            run += score
            if run > best:
                best, found = run, (start, k + 1)
        return found

    def extract(self, page: str | None) -> str:
        toks = list(tokens(page or ""))
        a, b = self.region(toks)
        touched = {main for _, words, main, _ in toks[a:b] if main and words}
        if touched:
            where = [k for k, t in enumerate(toks) if t[2] in touched]
            a, b = min(a, where[0]), max(b, where[-1] + 1)
        blocks, parts = [], []

        def flush():
            if line := " ".join("".join(parts).split()):
                blocks.append(line)
            parts.clear()

        for kind, _, _, text in toks[a:b]:
            if text is not None:
                if kind[0] != "?" or self.weight(kind) > 0:
                    parts.append(text)
            elif kind[0] == "?" or kind in INNER or kind.lstrip("/") in BLOCKS:
                flush()
            elif kind in ("br", "/br"):
                parts.append(" ")
        flush()
        return "\n".join(blocks)


def fit(pages: DataFrame, html: str = "html", key: str = "page_id") -> dict[str, float]:
    """Weights from a bounded sample of pages that mark their article."""
    marked = pages.select(F.xxhash64(key).alias("k"), F.col(html).alias("h")).where(F.col("h").rlike("(?i)<(article|main)[ >]") & (F.length("h") <= LABELLED_CHARS))
    # A share of the marked pages by hash, some times as many as needed, so that little is sent to the driver whatever the number of partitions.
    n = marked.count()
    share = 4 * LABELLED_PAGES / max(1, n)
    some = marked.where(F.col("k").cast("double") / float(1 << 64) + 0.5 < share)
    rows = some.orderBy("k", "h").limit(LABELLED_PAGES).collect()
    if len(rows) < min(LABELLED_PAGES, n):  # few keys, so that their hashes say little
        rows = marked.orderBy("k", "h").limit(LABELLED_PAGES).collect()
    return weights_from([r.h for r in rows])


def extract(pages: DataFrame, html: str = "html", out: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    w = fit(pages, html) if weights is None else weights

    def make():
        e = Extractor(w)
        return lambda arr: [[e.extract(x) for x in arr.to_pylist()]]

    return pages.withColumn(out, struct_udf(make, [("text", pa.string())])(F.col(html))["text"])


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
