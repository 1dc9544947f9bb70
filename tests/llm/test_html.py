"""Extraction from pages whose main text is known."""

import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from quillon.llm.html_text import DROPPED, DROPPED_WORDS, extract_main_text, main_text

LONG = "This is a paragraph of the article, with commas, and enough words to count as prose, more or less."
CASES = [
    ("", ""),
    ("plain words", "plain words"),
    (f"<nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>{LONG}<p>a&nbsp;&lt;b&gt;\n\t c&#233;<br>d</article><footer>f</footer>", f"T & U\n\n{LONG}\n\na <b> cé d"),
    (f"<body><div class='ad'>buy</div><div id=content><p>{LONG}</p><ul><li>one</li><li>two</li></ul></div><div class=sidebar><p>{LONG} {LONG}</p></div></body>", f"{LONG}\n\none\n\ntwo"),
    (f"<article><p><b>bold<br><p>{LONG}</p><script>var x='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><form><p>{LONG}</p></form></article>", f"bold\n\n{LONG}"),
    (f"<article><p>{LONG}</p><section class='user-comments'><p>{LONG}</p></section></article><aside><p>{LONG}</p></aside>", LONG),
    (f"<html><head><title>no</title></head><body><main><p>{LONG}<div>{LONG}</main>", f"{LONG}\n\n{LONG}"),
    ("<p a='>'>x</p", "x"),
    (f"<article><header>by me</header><p>{LONG}</p><div role=dialog>cookie</div><p hidden>no</p><p style='display:none'>no</p></article>", LONG),
    ("<article><p>one</p></article><div class='comments'><p>" + LONG * 3 + "</p></div>", "one"),
]


@pytest.mark.parametrize("source,want", CASES)
def test_cases(source, want):
    assert main_text(source) == want


FEW = "Eight words, that is less than ten points."
SIBLINGS = [
    (f"<body><div><section><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section><section><p>{LONG}</p><p>{LONG}</p></section></div></body>", "\n\n".join([LONG] * 5)),
    (f"<body><div><h1>T</h1><p>Short.</p><div><p>{LONG}</p><p>{LONG}</p></div><h2>Next</h2><p>{FEW}</p></div></body>", f"T\n\nShort.\n\n{LONG}\n\n{LONG}\n\nNext\n\n{FEW}"),
    (f"<body><div><div><p>{LONG}</p><p>{LONG}</p></div><p><a href=x>Read on here</a></p><div><a href=y>{LONG}</a></div></div></body>", f"{LONG}\n\n{LONG}"),
]


@pytest.mark.parametrize("source,want", SIBLINGS)
def test_siblings(source, want):
    assert main_text(source) == want


NAMED = [
    (f"<div class='has-sidebar'><article><p>{LONG}</p></article></div>", LONG),
    (f"<div class='content no-sidebar'><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
    (f"<div class='sidebar layout'><article><p>{LONG}</p></article><div class=sidebar><p>{LONG}</p></div></div>", LONG),
    (f"<div id=login-page><div><p>{LONG}</p><p>{LONG}</p></div></div>", f"{LONG}\n\n{LONG}"),
    (f"<article><p>{LONG}</p><section id='discussion'><h2>Discussion</h2><p>{LONG}</p></section></article>", f"{LONG}\n\nDiscussion\n\n{LONG}"),
    (f"<article><p>{LONG}</p><div class=related><a href=x>{LONG}</a></div></article>", LONG),
    (f"<article><p>{LONG}</p></article><div class=related><article><p>{LONG}</p></article></div>", LONG),
    (f"<article><p>{LONG}</p></article><div id=comments><article class=comment><p>{LONG * 9}</p></article></div>", LONG),
    (f"<div class=ad>{LONG}</div><article><p>one</p></article>", "one"),
    (f"<p>{LONG}<span class=ad>buy</span> end</p>", f"{LONG} end"),
    (f"<main class=hidden><div class=widget><article><p>{LONG}</p></article></div></main>", LONG),
]


@pytest.mark.parametrize("source,want", NAMED)
def test_names_alone(source, want):
    assert main_text(source) == want


def test_odd_pages():
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 10) == "deep"
    assert main_text("<" * 5000) is not None
    assert main_text("<p>" + "word " * 20_000).count("word") == 20_000
    assert main_text("<a href='x" * 2000) is not None


def test_rows(spark):
    rows = [(1, "u", None), (2, None, "<p>x  y</p>"), (None, "v", "<p>é</p>"), (2, None, "<p>x  y</p>")]
    df = spark.createDataFrame([(a, b, c, "t", 1) for a, b, c in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract_main_text(df).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, "x y", 3), (2, None, "x y", 3), (None, "v", "é", 1)], key=str)
    assert extract_main_text(df.limit(0)).collect() == []


def test_formulas_and_drawings():
    assert main_text(f"<article><p>{LONG} E = <math><mi>m</mi><annotation>x^2</annotation></math> is known and <svg><title>t</title><text>drawn</text><path d='M'/></svg>.</p></article>") == f"{LONG} E = m is known and drawn."


@pytest.mark.parametrize("page", [lambda n: "<b>" * n + "</i>" * n, lambda n: "<b>" * n + "<div></div>" * n, lambda n: "<b>" * n + "<li>" * n, lambda n: "<ul><li>" * n + "</ul>" * n, lambda n: "<a href='x" * n, lambda n: "<" * n + "<p>" * n])
def test_linear_time(page):
    began = time.process_time()
    main_text(page(200_000))
    assert time.process_time() - began < 30


class Dom(HTMLParser):
    """Well-formed pages as nested nodes: [tag, words of class and id, children]."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.root = ["#root", set(), [], None]
        self.at = self.root
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, {w for k, v in attrs if k in ("class", "id") and v for w in v.lower().replace("-", " ").replace("_", " ").split()}, [], self.at]
        self.at[2].append(node)
        if tag not in ("br", "hr", "img", "input", "link", "meta"):
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node and node[0] != tag:
            node = node[3]
        self.at = node[3] if node else self.at

    def handle_data(self, data):
        self.at[2].append(data)


BLOCKS = set("article aside blockquote body div dl dt dd figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html li main nav ol p pre section table tbody td th tr ul".split())


def by_dom(source):
    """The method of the docstring, node by node, for well-formed pages without doubtful class words."""
    blocks, run = [], []  # (node, text, characters in links)

    def flush(node):
        text = " ".join("".join(t for t, _ in run).split())
        if text:
            blocks.append((node, text, sum(len("".join(t.split())) for t, link in run if link)))
        run.clear()

    def walk(node, block, link):
        if node[0] in DROPPED | {"script", "style", "title", "noscript", "iframe", "template"} or node[1] & DROPPED_WORDS and node[0] not in ("html", "body", "article", "main"):
            return
        if node[0] in BLOCKS:
            flush(block)
            block = node
        for child in node[2]:
            if isinstance(child, str):
                run.append((child, link))
            elif child[0] == "br":
                run.append((" ", False))
            else:
                walk(child, block, link or child[0] == "a")
        if node is block:
            flush(block)

    root = Dom(source).root
    walk(root, root, False)
    up = lambda n: [] if n is None else [n, *up(n[3])]
    score, chars, linked, nodes = {}, {}, {}, {}
    for node, text, links in blocks:
        for x in up(node):
            nodes[id(x)] = x
            chars[id(x)] = chars.get(id(x), 0) + len(text)
            linked[id(x)] = linked.get(id(x), 0) + links
        if len(text) > 1 and node[0] not in ("h1", "h2", "h3", "h4", "h5", "h6"):
            worth = (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - min(1, links / len(text)))
            first = node[3] if node[0] in ("p", "pre", "blockquote", "td", "li", "dd", "figcaption") else node
            for part, x in zip((1, 1 / 2, 1 / 3), [x for x in up(first) if x is not root], strict=False):
                score[id(x)] = score.get(id(x), 0) + worth * part
    score = {i: s * (1 - min(1, linked[i] / max(1, chars[i]))) * (1.25 if nodes[i][0] in ("article", "main") else 1) for i, s in score.items()}
    best = max(score, key=lambda i: score[i], default=id(root))
    wider = [x for x in up(nodes.get(best)) if x[0] in ("article", "main")]
    inner = next((x for x in wider if x[0] == "article"), wider[-1] if wider else nodes.get(best, root))
    kept = [inner]
    if inner[0] not in ("body", "html", "#root"):
        for x in inner[3][2]:
            if not isinstance(x, str) and x is not inner and id(x) in nodes and linked[id(x)] / max(1, chars[id(x)]) < 0.25 and (score.get(id(x), 0) > 0 and score[id(x)] >= 0.2 * score.get(id(inner), 0) or x[0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6")):
                kept.append(x)
    return "\n\n".join(t for n, t, _ in blocks if any(x is k for x in up(n) for k in kept))


def test_like_dom():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    texts = [(main_text(p), by_dom(p)) for p in pages if p]
    assert texts and [a for a, _ in texts] == [b for _, b in texts] and sum(len(a) > 200 for a, _ in texts) > len(texts) / 2
