"""Main text of HTML pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; a linear scan finds the contiguous run of the highest sum,
the content region. The scores are log-odds of standing inside or outside the content, learned from labelled pages: those that mark their
content with an article element. Within the region, elements marked as no content (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) are left out; each costs once, as a negative score.

A mark is only a negative score, and its element stays, if the element holds the page's article or main element, or has far more words than
all that is unmarked on the page, or more words and the page's first heading: names such as `sidebar`, `ad` or `social` also stand in those of
wrappers. Menus, footers, asides and reader comments are never kept so.

Nulls: a null html is empty and gives an empty text; a null page_id or url is kept. Repeated rows give equal results. Very long pages are read
whole. Of runs with equal sums the first is taken. Without labelled pages DEFAULT is used. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import hash_sample, map_rows

#: Labelled pages that the scores are learned from at most.
SAMPLE = 400
#: Scores used without labelled pages, and of what they do not hold: of a word, a tag, and an element that its markup drops.
DEFAULT = {"word": 1.0, "link": -0.3, "tag": -0.5, "drop": -3.0}
LEAST_COST = -0.05

#: Fixed values of HTML: elements that end a block of text; elements without an end tag; elements whose content is no text.
BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|select|svg|iframe|title|object|canvas"
#: Elements and names in class, id or role that mark what is not content.
DROPPED = frozenset("nav footer aside form button menu dialog head header".split())
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert banner popup modal overlay newsletter subscribe subscription signup sidebar rail widget "
    "menu nav navbar navigation breadcrumb breadcrumbs footer toolbar comment comments disqus respond reply replies discussion share sharing social related recommended pagination pager login review reviews testimonial testimonials search complementary contentinfo".split()
)
OUTER_NAMES = frozenset("header masthead topbar".split())
KNOWN = BLOCKS | VOID | frozenset("a abbr b body button cite code del em head html i ins kbd label mark q s samp small span strong sub sup td th time title tr u var video audio".split())
HOLDERS = frozenset("html body main article".split())
#: Marked elements that no number of words keeps: by tag, and by name.
NEVER = frozenset("nav footer aside menu dialog button".split())
NEVER_NAMES = frozenset("comment comments reviews testimonials disqus respond reply replies discussion nav navbar navigation footer menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags of a text's own form, which cost little where nothing else is learned: lists, tables, letters. Elements that hold a line of text.
LIGHT = frozenset("li ul ol dl dt dd table thead tbody tfoot tr td th caption p br b i em strong span sub sup code pre blockquote u s q cite small mark abbr figure figcaption".split()) | HEADINGS
LINES = HEADINGS | frozenset("p li td th dt dd span em strong b i q cite code blockquote figcaption".split())
NEUTRAL = frozenset("with without has no is not show".split())

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>|</?[a-zA-Z][^>]*>|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"\w+")
_SPACE = re.compile(r"\s+")


#: A marked element stays if it has KEPT times the words of all that is unmarked.
KEPT = 3


def _names(tag: str) -> list[list[str]]:
    """The names in class, id and role, each in its parts, lower case."""
    out = []
    for m in _MARKS.finditer(tag):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [p.lower() for p in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if p]
            if parts and parts[0] not in NEUTRAL:
                out.append(parts)
    return out


def _mark(tag: str, token: str, inside: bool) -> str:
    """'' or, of an element marked as no content, 'weak' if what it holds may keep it, else 'strong'."""
    names = _names(token)
    if inside and tag in LINES:  # a line of the article: `notice-board` may be its subject, `board-notice` is no part of it
        names = [p[-1:] for p in names]
    named = any(NAMES.intersection(p) or (not inside and OUTER_NAMES.intersection(p)) for p in names)
    if not named and not (tag in DROPPED and not (tag == "header" and inside)):
        return ""
    return "strong" if tag in NEVER or any(len(p) == 1 and p[0] in NEVER_NAMES or p[-1] in ("comments", "reviews", "testimonials", "respond", "footer", "nav", "menu") for p in names) else "weak"


class _Element:
    """A marked element: where it starts and ends among the units, the marked element around it, what it holds outside marked elements."""

    def __init__(self, kind: str, start: int, outer: "_Element | None") -> None:
        self.kind, self.start, self.end, self.outer = kind, start, -1, outer
        self.words, self.heading, self.article = 0, False, 0


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(name, source, raw): name is 'word' for a run of text, else the tag's name, with / before that of an end tag; raw: no text inside."""
    last = page.rfind(">")  # no tag begins after it, and none is looked for: each look would go to the page's end
    for m in _TOKEN.finditer(page):
        if m.start() > last:
            yield "word", page[m.start() :].partition("<!--")[0], False
            return
        token = m[0]
        if m[1]:
            yield m[1].lower(), token, True
        elif not token.startswith(("<!", "<?")):
            name = _NAME.match(token)
            yield ("word", token, False) if not name else (("/" if token[1] == "/" else "") + name[1].lower(), token, False)


def units(page: str) -> list[tuple[str, str, bool, bool]]:
    """(name, text, dropped, inside) of each token; name: 'word' or, in an anchor outside headings, 'link' for text; dropped: it is in an element marked as no content; inside: in an article element."""
    out: list[tuple[str, str, _Element | None, bool]] = []
    stack: list[tuple[str, _Element | None]] = []
    marked: list[_Element] = []
    open_names: Counter = Counter()  # of the stack, so that no tag walks it in vain
    depth, level, unmarked, headings = 0, None, 0, 0
    articles: list[list] = []  # [words, the marked element around]
    open_articles: list[list] = []
    raw = _Element("strong", 0, None)
    linked = heading = False
    for name, token, is_raw in _tokens(page):
        if name.lstrip("/") == "a":
            linked = name == "a"
        elif name.lstrip("/") in HEADINGS:
            heading = name[0] != "/"
        elif name.lstrip("/") in BLOCKS:
            linked = heading = False
        if is_raw:
            out.append((name, "", raw, depth > 0))
        elif name == "word":
            n = len(_WORD.findall(token))
            if linked and not heading:
                name = "link"
            if level is None:
                unmarked += n
            else:
                level.words += n
            if open_articles and open_articles[-1][1] is level:
                open_articles[-1][0] += n
            out.append((name, token, level, depth > 0))
        elif name[0] == "/":
            was = level
            if open_names[name[1:]]:
                while True:
                    tag, outer = stack.pop()
                    open_names[tag] -= 1
                    if tag in ("article", "main"):
                        open_articles.pop()
                        depth -= tag == "article"
                    if outer is not level:
                        level.end = len(out)
                        level = outer
                    if tag == name[1:]:
                        break
            out.append((name, "", was, depth > 0))
        else:
            alone = token.endswith("/>") or name in VOID
            within = depth > 0 or open_names["main"] > 0
            mark = "" if alone or name in HOLDERS and name != "article" else _mark(name, token, within)
            outer = level
            if mark:
                level = _Element(mark, len(out), outer)
                marked.append(level)
            if name == "h1" and not headings:
                headings += 1
                if level is not None:
                    level.heading = True
            if not alone and (mark or name not in ("p", "li", "b", "i", "a", "span", "em", "strong", "td", "th", "tr", "dt", "dd", "option")):
                stack.append((name, outer))
                open_names[name] += 1
                depth += name == "article"
                if name in ("article", "main"):
                    open_articles.append([0, level])
                    if not mark:
                        articles.append(open_articles[-1])
            out.append((name, "", level, depth > 0))
    for e in marked:
        e.end = e.end if e.end >= 0 else len(out)
    kept = _kept(marked, articles, unmarked)
    dropped = {id(raw): True}
    for e in marked:  # outer elements come first
        dropped[id(e)] = id(e) not in kept or (e.outer is not None and dropped[id(e.outer)])
    return [(name, text, e is not None and dropped[id(e)], inside) for name, text, e, inside in out]


def _kept(marked: list[_Element], articles: list[list], unmarked: int) -> set[int]:
    """The ids of the marked elements that stay."""
    kept: set[int] = set()
    best = max(articles, key=lambda a: a[0], default=None)
    around = best[1] if best else None
    while around is not None:
        if around.kind == "strong":  # the article of a menu, an aside or the comments is none
            break
        kept.add(id(around))
        unmarked += around.words
        around = around.outer
    for e in marked:
        free = e.outer is None or id(e.outer) in kept
        if id(e) not in kept and e.kind == "weak" and free and e.words and (e.words >= KEPT * unmarked or (e.heading and e.words >= unmarked)):
            kept.add(id(e))
            unmarked += e.words
    return kept


def count(pages: list[str | None]) -> tuple[Counter, Counter]:
    """How often words and tags stand inside and outside an article element, in pages that have one. What markup drops is not counted, as it
    gives no text either way; names that HTML doesn't know are not either, so the counts are bounded."""
    inner, outer = Counter(), Counter()
    for page in pages:
        own = units(page or "")
        if not any(u[3] for u in own):
            continue
        for name, text, dropped, inside in own:
            if not dropped and (name in ("word", "link") or name.lstrip("/") in KNOWN):
                (inner if inside else outer)[name] += len(_WORD.findall(text)) if name in ("word", "link") else 1
    return inner, outer


def learn(inner: Counter, outer: Counter) -> dict[str, float]:
    """Scores: the log-odds of standing inside an article element, above 0 for words and below for tags."""
    if not inner or not outer:
        return dict(DEFAULT)
    total, other = sum(inner.values()), sum(outer.values())
    score = {}
    for name in {*inner, *outer}:
        odds = math.log((inner[name] + 0.5) / (total + 1)) - math.log((outer[name] + 0.5) / (other + 1))
        score[name] = min(1.0, max(0.2, odds)) if name == "word" else max(-8.0, min(LEAST_COST, odds))
    # words of links are no evidence for content where they stand alone, whatever their share on the learned pages
    score["link"] = max(-1.0, min(DEFAULT["link"], score.get("link", 0.0)))
    return DEFAULT | score


def extract(page: str | None, score: dict[str, float]) -> str:
    """The text of the page's content region: its blocks, joined by empty lines."""
    own = units(page or "")
    best, start, end = 0.0, 0, 0
    run, since, before = 0.0, 0, False
    for k, (name, text, dropped, _) in enumerate(own):
        if dropped:  # one cost for a dropped element, however large, as it gives no text
            run += 0.0 if before else score["drop"]
        elif name in ("word", "link"):
            run += score[name] * len(_WORD.findall(text))
        else:
            run += score.get(name, LEAST_COST if name.lstrip("/") in LIGHT else score["tag"])
        before = dropped
        if run <= 0:
            run, since = 0.0, k + 1
        elif run > best:
            best, start, end = run, since, k + 1
    blocks, parts = [], []
    for name, text, dropped, _ in [*own[start:end], ("p", "", False, False)]:
        if name in ("word", "link"):
            if not dropped:
                parts.append(html.unescape(text))
        elif name.lstrip("/") in BLOCKS:
            block = _SPACE.sub(" ", "".join(parts)).strip()
            if block:
                blocks.append(block)
            parts = []
        elif name in ("br", "td", "th", "/td", "/th") or dropped:
            parts.append(" ")
    return "\n\n".join(blocks)


def fit(pages: DataFrame) -> dict[str, float]:
    """Scores learned on SAMPLE pages with an article element, the first by a hash of page_id (one page an id). Ids alone are ranked; the
    pages are read where they are, and only counters of HTML's names reach the driver."""
    has = pages.filter(F.col("page_id").isNotNull() & F.col("html").contains("<article")).select("page_id", "html")
    ids = hash_sample(has.select("page_id").distinct().withColumn("_all", F.lit(1)), "page_id", "_all", SAMPLE).select("page_id")
    chosen = has.join(F.broadcast(ids), "page_id", "left_semi")

    def run(rows: dict[str, list]) -> dict[str, object]:
        found = [(k, name, n) for k, side in enumerate(count(rows["html"])) for name, n in side.items()]
        return {"side": [f[0] for f in found], "name": [f[1] for f in found], "n": [f[2] for f in found]}

    counts = map_rows(chosen.select("html"), "side int, name string, n long", run).groupBy("side", "name").agg(F.sum("n").alias("n")).collect()
    return learn(*[Counter({r["name"]: r["n"] for r in counts if r["side"] == side}) for side in (0, 1)])


def main_text(pages: DataFrame, score: dict[str, float]) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(rows: dict[str, list]) -> dict[str, object]:
        text = [extract(h, score) for h in rows["html"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": text, "n_chars": [len(t) for t in text]}

    return map_rows(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long", run)
