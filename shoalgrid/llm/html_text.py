"""Main text of web pages: the maximum-scoring run of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgrid.llm.store import in_slices

#: Labelled pages, about, that weights are learned from.
TRAIN_PAGES = 2_000
#: Elements that are no part of an article, and those whose content is no markup.
ASIDE_TAGS = frozenset("head nav header footer aside form menu dialog noscript template select button iframe object svg canvas audio video".split())
RAW_TAGS = frozenset("script style textarea title xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE_TAGS = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HEAD_TAGS = frozenset("head title meta link script style base noscript template".split())
FOREIGN_TAGS = frozenset(("svg", "math"))
#: A class, id or role marks an element as no part of an article if it is made of these words, with or without those that name a part of a page.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies"
    " disqus footer header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted"
    " promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe"
    " toolbar topbar widget alert complementary contentinfo".split()
)
PART_WORDS = frozenset(
    "area articles bar block box btn button buttons col column container content count form group icon icons inner item items left link links list"
    " main message outer page panel posts right row secondary section site slot stories thread tool tools top bottom unit wrap wrapper zone".split()
)
CONTENT_TAGS = ("article", "main")
#: Scores: of a word; of a tag that no labelled page has; the bounds of a learned one; of a tag on a page with an article.
WORD, DEFAULT_TAG, LEAST_TAG, MOST_TAG, INSIDE_TAG = 1.0, -0.05, -1.0, -0.02, -1e-6
#: Score of a word outside the article: small, so that what stands between two articles doesn't part them.
OUTSIDE_WORD = -1e-4
_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"[>\"']")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def marks(attributes: str) -> list[str]:
    """The classes, id and roles in a tag's attributes."""
    if "=" not in attributes:
        return []
    return " ".join(next(filter(None, m.groups()), "") for m in _MARKS.finditer(attributes)).split()


def is_aside(tag: str, own_marks: list[str]) -> bool:
    """Whether an element is no part of an article, by its name or by a class, id or role."""
    if tag in ASIDE_TAGS:
        return True
    if tag in ("html", "body", *CONTENT_TAGS):
        own_marks = [m for m in own_marks if m.lower() in ("comment", "comments", "ad", "advert", "advertisement")] if tag in CONTENT_TAGS else []
    for mark in own_marks:
        words = {w.lower() for w in _WORDS.findall(mark)}
        if not words.isdisjoint(ASIDE_WORDS) and words <= ASIDE_WORDS | PART_WORDS:
            return True
    return False


def _tag_end(page: str, at: int, none: dict[str, int]) -> int:
    """Place of the > that ends a tag, beyond quoted values; a quote without a second one is no quote. -1 if there is no >.

    none: from where on the page has no more of a character, so that no search for it is made twice.
    """
    i = at
    while True:
        m = _STOP.search(page, i)
        if not m:
            return -1
        if m[0] == ">":
            return m.start()
        j = page.find(m[0], m.end()) if m.end() < none.get(m[0], len(page)) else -1
        if j < 0:
            none[m[0]] = min(m.end(), none.get(m[0], len(page)))
            return page.find(">", at)
        i = j + 1


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """(tag name, with / for an end tag; '' for text) and the attributes or the text, in page order; raw elements and comments are gone."""
    at, text_from = 0, 0
    none: dict[str, int] = {}
    while True:
        m = _OPEN.search(page, at)
        if not m:
            break
        if m[2] is None:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            end = page.find(close, m.end() - (2 if close == "-->" and page.startswith("<!-->", m.start()) else 0))
            end = len(page) if end < 0 else end + len(close)
            tag, rest = "", ""
        else:
            end = _tag_end(page, m.end(), none)
            if end < 0:
                break
            tag, rest = m[1] + m[2].lower(), page[m.end() : end]
            end += 1
            if tag in RAW_TAGS:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, end)
                end = close.end() if close else len(page)
                tag = ""
        if m.start() > text_from:
            yield "", page[text_from : m.start()]
        if tag:
            yield tag, rest
        at = text_from = end
    if text_from < len(page):
        yield "", page[text_from:]


def segments(page: str) -> list[tuple[str, str, str, tuple[str, ...]]]:
    """(tag or '', text, where, marks) in page order.

    where: 'aside' in an element that is no part of an article, 'inside' in an article or main element, 'outside' if
    the page has such but not here, 'open' if it has none. marks: classes, ids and roles of the elements around, for
    texts. An element without an end tag ends with its parent, a head with the first element of the body, a foreign
    element with a slash at once.
    """
    out: list[tuple[str, str, str, tuple[str, ...]]] = []
    #: Tag, whether in an aside, whether in an article, marks of it and all around.
    stack: list[tuple[str, bool, bool, tuple[str, ...]]] = []
    opened: Counter = Counter()
    some = False

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    for tag, rest in tokens(page):
        aside, inside, around = stack[-1][1:] if stack else (False, False, ())
        name = tag.lstrip("/")
        if opened["head"] and name not in HEAD_TAGS and (tag or rest.strip()):
            while opened["head"]:
                pop()
            aside, inside, around = stack[-1][1:] if stack else (False, False, ())
        if tag[:1] == "/":
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
        elif tag and tag not in VOID_TAGS:
            if stack and stack[-1][0] == "p" and tag not in INLINE_TAGS:
                pop()
                aside, inside, around = stack[-1][1:] if stack else (False, False, ())
            own = marks(rest)
            foreign = tag in FOREIGN_TAGS or opened["svg"] or opened["math"]
            if not (foreign and rest.endswith("/")):
                aside = aside or is_aside(tag, own)
                inside = inside or (tag in CONTENT_TAGS and not aside)
                some = some or inside
                around = (*around[-20:], *own[:5]) if own else around
                stack.append((tag, aside, inside, around))
                opened[tag] += 1
        where = "aside" if aside else "inside" if inside else "open"
        out.append((tag, "" if tag else rest, where, () if tag else around))
    return [(t, x, "outside" if where == "open" else where, m) for t, x, where, m in out] if some else out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run of largest sum, the first of equals and as short as can be; (0, 0) if no sum is positive."""
    best, bounds, total, begin = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += x
        if total > best:
            best, bounds = total, (begin, i + 1)
    return bounds


def scores(parts: list[tuple[str, str, str, tuple[str, ...]]], weights: Mapping[str, float]) -> list[float]:
    """Score of each segment. An aside's words have none. A word counts WORD in an article and OUTSIDE_WORD outside one if
    the page has one; on a page without one, what the least learned mark around it weighs. Tags count their learned weight,
    next to nothing on a page with an article."""
    out = []
    for tag, text, where, around in parts:
        if tag:
            out.append(0.0 if where == "aside" else INSIDE_TAG if where != "open" else weights.get(tag.lstrip("/"), DEFAULT_TAG))
        else:
            word = {"aside": 0.0, "inside": WORD, "outside": OUTSIDE_WORD}.get(where)
            if word is None:
                word = min([WORD, *(weights[f".{m}"] for m in around if f".{m}" in weights)])
            out.append(len(text.split()) * word)
    return out


def main_text(page: str, weights: Mapping[str, float]) -> str:
    """Text of the best run of ``page``: the words in it that score positive."""
    parts = segments(page)
    scored = scores(parts, weights)
    a, b = best_run(scored)
    blocks, held = [], []
    for (t, text, _, _), score in zip([*parts[a:b], ("p", "", "", ())], [*scored[a:b], 0.0]):
        if not t:
            if score > 0 or not text.strip():
                held.append(text)
        elif t.lstrip("/") == "br":
            held.append(" ")
        elif t.lstrip("/") not in INLINE_TAGS:
            blocks.append(" ".join(html.unescape("".join(held)).split()))
            held = []
    return "\n".join(x for x in blocks if x)


def fit_weights(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> dict[str, float]:
    """Weights from pages that label their own content by an article or main element.

    A tag's weight is its log odds to be inside, held between LEAST_TAG and MOST_TAG so that tags stay negative. A
    class, id or role (with a dot before it) weighs the log odds of the words in such elements to be inside, held
    between -WORD and WORD; a word with none weighs WORD. About ``train_pages`` pages are read, those of least hash of the page.
    """
    labelled = pages.filter(F.lower("html").rlike(r"<(article|main)[\s>]"))
    n = labelled.count()
    if not n:
        return {}
    place = F.pmod(F.xxhash64("html"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        inside: Counter = Counter()
        outside: Counter = Counter()
        for batch in in_slices(batches):
            for page in batch.column(0).to_pylist():
                for t, text, where, around in segments(page):
                    seen = inside if where == "inside" else outside
                    if t:
                        seen[t.lstrip("/")] += 1
                    else:
                        for m in set(around):
                            seen[f".{m}"] += len(text.split())
        names = sorted({*inside, *outside})
        if names:
            columns = [pa.array(names), pa.array([inside[x] for x in names], pa.int64()), pa.array([outside[x] for x in names], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["tag", "inside", "outside"])

    sample = labelled.filter(place < min(1.0, train_pages / n)).select("html")
    sums = sample.mapInArrow(run, "tag string, inside long, outside long").groupBy("tag").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    odds = {r["tag"]: math.log((r["i"] + 1) / (r["o"] + 1)) for r in sums.filter("i + o > 0").collect()}
    return {t: min(WORD, max(-WORD, x)) if t[0] == "." else min(MOST_TAG, max(LEAST_TAG, x)) for t, x in odds.items() if t not in CONTENT_TAGS}


def extract(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text (main text, empty if none) and n_chars (its code points) of every whole page.

    Words score positive and tags negative, with weights from labelled pages: words in elements that are no part of an
    article (by name, class, id or role) score nothing, those outside the article of a page that has one negative. The best
    contiguous run, found by one scan, is the text; its words of positive score stay. Character references are
    decoded, white space inside a block is one space, and blocks stand on lines of their own.

    Null and empty pages have empty text; equal rows each come back; null ids and other columns make no difference.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    weights = fit_weights(rows, train_pages)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in in_slices(batches):
            texts = [main_text(page, weights) for page in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kind = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
