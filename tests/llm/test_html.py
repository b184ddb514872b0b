import html
import random
import re
import time

from gridloom.llm import html_text

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class=site><h2>Site name</h2></header><nav><a href=x>menu</a> <a href=y>more</a></nav>
<div class="cookie-notice">We use cookies <button>ok</button></div><!-- <p>no</p> --><div id="main"><div class="post"><h1>Head &amp; line</h1><p>First&nbsp;para of  text
that is <b>long</b> enough.<p>Second with <a href="x">link text</a> inside &lt;tag&gt; and more words.<script>var a = "</p><p>x";</script><ul><li>item one of them</li><li>item two of them</li></ul><div class="ad-box">Buy this now</div>
<p>Third para after the advert, in words.</div><aside>Side bar words</aside><form><input>Search this site</form><section id="comments"><p>Reader says a long comment that is no part</p></section></div><footer>&copy; foot</footer></body></html>"""


def test_page():
    want = "Head & line\n\nFirst para of text that is long enough.\n\nSecond with link text inside <tag> and more words.\n\nitem one of them\n\nitem two of them\n\nThird para after the advert, in words."
    assert html_text.extract(PAGE, html_text.DEFAULT) == want


def test_pages_of_the_tables(spark, medium):
    pages = spark.read.parquet(f"{medium}/pages.parquet")
    rows = {r["page_id"]: r for r in html_text.main_text(pages, html_text.fit(pages)).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", p["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        want = "\n\n".join(b for b in blocks if b)
        assert rows[p["page_id"]]["text"] == want and rows[p["page_id"]]["n_chars"] == len(want) and rows[p["page_id"]]["url"] == p["url"]


def best_run(scores):
    """The highest sum of a contiguous run, by all runs."""
    return max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)], default=0)


def test_the_scan_finds_the_best_run():
    r = random.Random(3)
    for _ in range(200):
        parts = [r.choice(["<x-a>", "<x-b>", "w ", "w w w ", "w w w w w w "]) for _ in range(r.randint(1, 14))]
        page, score = "".join(parts), html_text.DEFAULT | {"tag": -1.7}
        sums = [score["tag"] if p[0] == "<" else 1.0 * len(p.split()) for p in parts]
        n = len(html_text.extract(page, score).split())
        # words of the best run: its sum and its tags give them
        best = best_run(sums)
        assert any(abs(n - 1.7 * k - best) < 1e-6 for k in range(len(parts) + 1))


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>some words"), (4, "w", "<<<>>< a & b &amp &#x41; <p"), (5, "x", "<div>" * 3000 + "deep words here" + "</div>" * 3000), (6, "y", "<script>never closed"), (1, "u", None)]
    pages = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {(r["page_id"], r["url"]): r["text"] for r in html_text.main_text(pages, html_text.fit(pages)).collect()}
    assert got[1, "u"] == "" and got[2, None] == "" and got[None, "v"] == "some words" and got[5, "x"] == "deep words here" and got[6, "y"] == ""
    assert html_text.main_text(pages, html_text.DEFAULT).count() == 7
    assert html_text.main_text(pages.limit(0), html_text.fit(pages.limit(0))).collect() == []


ARTICLE = "<h1>Title of it</h1>" + "".join("<p>" + " ".join(f"word{i}x{j}" for j in range(35)) + "</p>" for i in range(4))
TEXT = "\n\n".join(["Title of it", *(" ".join(f"word{i}x{j}" for j in range(35)) for i in range(4))])
TOP = "<header><h2>Site</h2></header><nav><a href=x>one</a><a href=y>two</a></nav>"
FOOT = "<footer>foot words here</footer>"
COMMENTS = '<div id="comments">' + '<div class="comment"><p>' + "a reader says " * 200 + "</p></div></div>"
LAYOUTS = [
    "{top}<div>{it}</div>{foot}",
    '{top}<div class="content-sidebar-wrap">{it}</div>{foot}',
    '{top}<div class="content-sidebar-wrap"><div>{it}</div><aside>side words</aside></div>{foot}',
    '<form id="aspnetForm">{top}<div>{it}</div>{foot}</form>',
    '{top}<div class="layout ad-free">{it}</div>{foot}',
    '{top}<div class="social-policy-report">{it}</div>{foot}',
    '{top}<div class="page-with-sidebar"><main>{it}</main></div>{comments}{foot}',
    "{top}<div>{it}</div>{comments}{foot}",
    "{top}<article>{it}{comments}</article>{foot}",
    '<div class="cookie-notice"><p>' + "we use cookies " * 60 + "</p></div>{top}<div>{it}</div>{foot}",
    '{top}<article>{it}</article><div class="related"><article class="card">' + "another page of this site " * 5 + "</article></div>{foot}",
    '{top}<div class="page"><article>{it}</article><div class="comments"><article>' + "a reader says " * 200 + "</article></div></div>{foot}",
]


def test_layouts_and_their_marks():
    for layout in LAYOUTS:
        page = "<html><body>" + layout.format(top=TOP, foot=FOOT, it=ARTICLE, comments=COMMENTS) + "</body></html>"
        assert html_text.extract(page, html_text.DEFAULT) == TEXT, layout


def test_fit_counts_what_one_pass_counts(spark, medium, monkeypatch):
    pages = spark.read.parquet(f"{medium}/pages.parquet")
    monkeypatch.setattr(html_text, "SAMPLE", 10_000)
    assert html_text.fit(pages) == html_text.learn(*html_text.count([r["html"] for r in pages.collect()]))


def test_a_megabyte_of_unclosed_tags_is_linear():
    for page in ("<font>a " * 125_000, "<div>" * 100_000 + "words " + "</b>" * 100_000, "<a " * 330_000, "<!x " * 250_000, '<p class="' * 100_000, "<div class=nav>" * 60_000, "<article>" * 100_000 + "w"):
        began = time.time()
        html_text.extract(page, html_text.DEFAULT)
        assert time.time() - began < 8, page[:20]


def test_tables_and_marked_lines_of_an_article_stay():
    rows = "<table><tr><th>name</th><th>size</th></tr><tr><td>a1</td><td>b2</td></tr></table>"
    body = ARTICLE + '<p class="notice-board">The notice board of the town hall was painted in green last week.</p>' + rows
    for layout in ("{top}<article>{it}</article>{foot}", "{top}<div>{it}</div>{foot}"):
        page = "<html><body>" + layout.format(top=TOP, foot=FOOT, it=body) + "</body></html>"
        got = html_text.extract(page, html_text.DEFAULT)
        assert got.startswith(TEXT) and got.endswith("name size\n\na1 b2")
        assert ("notice board" in got) == ("<article>" in layout)
    reviews = "".join(f'<div class="user-reviews"><p>{"the reader has much to say of it " * 4}</p></div>' for _ in range(30))
    links = "<div>" + "".join(f"<p><a href=/{i}>another page of this site {i}</a></p>" for i in range(50)) + "</div>"
    for more in (reviews, links):
        assert html_text.extract(f"<html><body>{TOP}<div>{ARTICLE}</div>{more}{FOOT}</body></html>", html_text.DEFAULT) == TEXT
    assert html_text.extract(f"<body><article><h1><a href=x>A linked title</a></h1><p>{'words of it ' * 9}</p></article></body>", html_text.DEFAULT).startswith("A linked title")


def tree(r, depth):
    """(source, words with whether they are dropped) of a random tree of well-formed elements."""

    def make(depth, dropped):
        source, words = "", []
        for _ in range(r.randint(1, 4)):
            if depth == 0 or r.random() < 0.4:
                w = f"w{r.randrange(10**9)}"
                source += f" {w} "
                words.append((w, dropped))
            else:
                tag, marked = r.choice([("div", False), ("section", False), ("p class=x", False), ("div class='comments'", True), ("nav", True), ("aside", True), ("table", False), ("ul", False)])
                inner, own = make(depth - 1, dropped or marked)
                source += f"<{tag}>{inner}</{tag.split()[0]}>"
                words += own
        return source, words

    return make(depth, False)


def test_dropped_elements_equal_a_tree_walk():
    r = random.Random(9)
    for _ in range(400):
        source, words = tree(r, 5)
        got = [(w, dropped) for name, text, dropped, _ in html_text.units(source) for w in text.split()]
        assert got == words, source
