"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page is a sequence of text runs and tags. Each word scores by where it
stands (its block element, and whether in a link), each tag costs something; a
linear scan finds the contiguous region with the greatest sum, and its text is
the result. The weights are log odds, counted on pages whose own <article> or
<main> element tells what is content; without such pages the prior weights
hold. Words inside a page's own <article> or <main> score as content, linked
or not.

Furniture counts as one tag, so content may go on behind it, and never gives
text: elements that are furniture by kind, and elements whose class, id or role
holds a name for it. A name is a whole token, such as `ad` or `cookie-banner`,
whose parts name furniture or a place and nothing else; `share-price` and
`related-work` are none. Of names that content has as well (`search`, `share`),
and of forms, an element is furniture only if most of its words are links; a
form that holds at least half of the page's words outside links isn't, nor is,
for its name, an element around the page's <article> or <main>, or around its
heading and that much. Labelled pages also decide on names that content has.

Nulls and edge cases: null or empty html gives the empty text, and so does a
page whose best sum isn't positive. Ties go to the first, then shortest
region. Unclosed elements last until their parent ends; an unclosed script runs
to the end; a tag that isn't closed before the next one is text. Repeated rows
stay, other columns are ignored, an empty table gives an empty result. Pages of
any length are read whole, in time that grows with their length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

#: Distinct labelled pages that the weights are fitted on, at most: those of the least hash.
LABELLED_PAGES = 2000
WORD, LINK_WORD, TAG = 1.0, -1.0, -0.3
LEAST_TAG, MOST = -0.05, 4.0
#: Log odds that decide, on either side, on names that content has as well.
SURE = 1.0

#: Elements of HTML by kind, and names that mark furniture.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "template", "noembed", "noframes"}
HIDDEN = {"head", "svg", "math", "object", "canvas", "select", "button", "option", "nav", "footer", "aside", "menu", "dialog", "audio", "video", "datalist"}
FORMS = {"form", "fieldset", "label"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
KEEP_OPEN = {"html", "body", "main", "article"}
CLOSED_BY_SAME = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
#: Names of furniture, names that content has as well, and what may stand beside them in a token.
NAMES = set("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors menu menus nav navbar navigation sidebar sidebars breadcrumb breadcrumbs footer header masthead comment comments replies reply respond disqus cookie cookies notice notices consent gdpr popup modal overlay newsletter pagination pager copyright disclaimer contentinfo complementary skip".split())
SHARED_NAMES = set("search share sharing social related recommended recommendations promo promotion promotions subscribe subscription widget widgets toolbar popular trending alert tags".split())
BESIDE = set("site page main top bottom left right global primary secondary wrapper wrap container box bar block section item items list list thread area inner outer body slot unit panel row col column group content form text links link post posts article entry blog user reader readers mobile desktop sticky fixed side".split())

TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>?)|<[!?][^>]*+>?")
MARKS = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
PARTS = re.compile(r"[a-z]+")


def names_of(attributes: str) -> list[str]:
    """The names for furniture among an element's class, id and role: the part of each token that is one."""
    found = []
    for marks in MARKS.findall(attributes):
        for token in next(filter(None, marks), "").lower().split():
            parts = PARTS.findall(token)
            named = [p for p in parts if p in NAMES] or [p for p in parts if p in SHARED_NAMES]
            if named and all(p in NAMES or p in SHARED_NAMES or p in BESIDE for p in parts):
                found.append(named[0])
    return found


class Page:
    """Events of a page: (feature, text, words, in its labelled content), and spans of events in elements that may be furniture."""

    def __init__(self, page: str):
        self.events: list[tuple[str, str, int, bool]] = []
        self.spans: list[tuple[int, int, str, list[str]]] = []  # first event, end, kind of element, names
        stack: list[tuple[str, int, list[str] | None]] = []  # tag, its first event, names if it may be furniture
        open_tags: Counter = Counter()
        blocks, never_closed = ["body"], set()
        at = 0

        def leave() -> str:
            tag, first, names = stack.pop()
            open_tags[tag] -= 1
            if tag not in INLINE:
                blocks.pop()
            if names is not None:
                self.spans.append((first, len(self.events), tag, names))
            return tag

        def enter(tag: str, attributes: str) -> None:
            names = names_of(attributes) if attributes and tag not in KEEP_OPEN else []
            if "header" in names and (open_tags["article"] or open_tags["main"]):
                names = [n for n in names if n != "header"]
            kind = tag in HIDDEN or tag in FORMS or (tag == "header" and not open_tags["article"])
            stack.append((tag, len(self.events), names if kind or names else None))
            open_tags[tag] += 1
            if tag not in INLINE:
                blocks.append(tag)

        begin = 0  # of the text that is pending
        while at <= len(page):
            m = TOKEN.search(page, at)
            if m and m[2] and not m[4]:
                at = m.end()
                continue
            if raw := page[begin : m.start() if m else len(page)]:
                found = entities.unescape(raw)
                self.events.append((f"{blocks[-1]}{' a' if open_tags['a'] else ''}", found, len(found.split()), bool(open_tags["article"] or open_tags["main"])))
            if not m:
                break
            at = begin = m.end()
            if m[0] == "<!--":
                end = page.find("-->", at)
                at = begin = end + 3 if end >= 0 else len(page)
                continue
            if not m[2]:
                continue
            tag, closing = m[2].lower(), m[1] == "/"
            labelled = bool(open_tags["article"] or open_tags["main"])
            if not closing and tag in RAW:
                end = None if tag in never_closed else re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
                if not end:
                    never_closed.add(tag)
                at = begin = end.end() if end else len(page) + 1
                continue
            if closing:
                if open_tags[tag]:
                    while leave() != tag:
                        pass
            else:
                if tag == "body":
                    while open_tags["head"]:
                        leave()
                if tag in CLOSED_BY_SAME and stack and stack[-1][0] == tag:
                    leave()
                if tag not in VOID:
                    enter(tag, m[3])
            if tag not in INLINE:
                self.events.append((f"<{tag}>", "", 0, labelled))
        while stack:
            leave()

    def furniture(self, odds: dict[str, float]) -> list[bool]:
        """For each event whether it is inside furniture, by the log odds of names."""
        n = len(self.events)
        links, words, articles, headings = np.zeros((4, n + 1), np.int64)
        for i, (feature, _, count, _) in enumerate(self.events):
            words[i + 1] = words[i] + count
            links[i + 1] = links[i] + (count if feature.endswith(" a") else 0)
            articles[i + 1] = articles[i] + (feature in ("<article>", "<main>"))
            headings[i + 1] = headings[i] + (feature == "<h1>")
        prose = int(words[n] - links[n])
        depth = np.zeros(n + 1, np.int64)
        for first, end, tag, names in self.spans:
            total, linked = int(words[end] - words[first]), int(links[end] - links[first])
            hidden = tag in HIDDEN or tag == "header"
            most = 2 * (total - linked) >= prose
            if not (articles[end] > articles[first] or (most and headings[end] > headings[first])):
                for name in names:
                    known = odds.get("." + name, 0.0)
                    hidden |= name in NAMES or known < -SURE or (known <= SURE and 2 * linked >= total)
            if tag in FORMS:
                hidden |= tag != "form" or not most
            if hidden:
                depth[first] += 1
                depth[end] -= 1
        return (np.cumsum(depth[:n]) > 0).tolist()


def weight(feature: str, weights: dict[str, float], labelled: bool = False) -> float:
    if feature.startswith("<"):
        return min(weights.get(feature, TAG), LEAST_TAG)
    own = weights.get(feature, LINK_WORD if feature.endswith(" a") else WORD)
    return max(own, WORD) if labelled else own


def scored(page: str, weights: dict[str, float]) -> tuple[list[str], list[float]]:
    """Texts of all events, a line feed for each tag, and their scores; a stretch of furniture is one event."""
    own = Page(page)
    texts, scores, before = [], [], False
    for (feature, text_, words, labelled), inside in zip(own.events, own.furniture(weights), strict=True):
        if inside:
            if not before:
                texts.append("\n")
                scores.append(weight("<furniture>", weights))
        else:
            tag = feature[0] == "<"
            texts.append("\n" if tag else text_)
            scores.append(weight(feature, weights, labelled) * (1 if tag else words))
        before = inside
    return texts, scores


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end of the contiguous region of the greatest positive sum, (0, 0) if there is none; the first, then the shortest."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best + 1e-9:
            best, span = total, (start, i + 1)
    return span


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The text of the page's best region."""
    if not page:
        return ""
    texts, scores = scored(page, weights)
    first, end = best_region(scores)
    return " ".join("".join(texts[first:end]).split())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by feature, tags, and words by name of furniture (behind a full stop), inside and outside of labelled content."""
    inside, outside = Counter(), Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            own = Page(page)
            for (feature, _, words, labelled), hidden in zip(own.events, own.furniture({}), strict=True):
                if not hidden:
                    (inside if labelled else outside)[feature] += 1 if feature[0] == "<" else words
            for first, end, _, names in own.spans:
                for name in names:
                    for _, _, words, labelled in own.events[first:end]:
                        (inside if labelled else outside)["." + name] += words
    names = sorted(inside.keys() | outside.keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[x] for x in names], pa.int64()), pa.array([outside[x] for x in names], pa.int64())], ["feature", "inside", "outside"])
    text.release()


def fit(pages: DataFrame, html_col: str = "html", limit: int = LABELLED_PAGES) -> dict[str, float]:
    """Log odds of being content for each feature, from at most limit distinct labelled pages."""
    rows = pages.select(F.col(html_col).alias("html")).where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    rows = rows.withColumn("h", F.xxhash64("html"))
    most = rows.select("h").distinct().orderBy("h").limit(limit).agg(F.max("h")).first()[0]  # hashes only: no task gathers pages
    rows = rows.where(F.col("h") <= (0 if most is None else most)).select("html")
    counts = rows.mapInArrow(_features, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    odds = {x["feature"]: float(np.log((x["i"] + 0.5) / (x["o"] + 0.5))) for x in counts.collect()}
    return {k: max(-MOST, min(MOST, v)) for k, v in odds.items()}


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    weights = fit(pages, html_col)

    @F.arrow_udf("string")
    def text_of(htmls: pa.Array) -> pa.Array:
        return pa.array([extract(x, weights) for x in htmls.to_pylist()], pa.string())

    got = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(F.col(html_col)).alias("text"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
