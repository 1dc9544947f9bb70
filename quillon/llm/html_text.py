"""Main-text extraction from HTML by tree scoring.

A page is read in one pass over its tags into a flat tree and its text blocks.
Paragraphs pass points to their ancestors - one, one more a comma, one more for
each hundred characters up to three - whole to the parent, half to the
grandparent, a third beyond; points are discounted by the share of link text.
The container with most points is kept, widened to the article or main element
around it, with those siblings that have a fifth of its points, or that are
plain paragraphs or headings.  Within it, menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are left out, by
element, role, hidden state, or words of class and id (not if has, no or with
stand before them, as in has-sidebar).

Words of class and id alone don't drop an element that holds an article or main
of the page (unless there is another one outside, and more text), that holds
more than three quarters of the page's unlinked text (unless there is an article
or main outside), or that is a section of an article, has a name that articles
use too (``TOPICS``) and isn't mostly links; points and link density decide
there.  Of these, reader comments only stay if they hold the page's article.

A block's character references are decoded, its white space (no-break spaces
too) becomes one space, and its ends are trimmed; blocks that still have text
are joined in page order by two line feeds.  Nothing else is dropped or capped.

Nulls and edges: null or empty html, and pages without text, give an empty text
of 0 characters.  Unclosed, misnested and unknown tags are read as browsers
would, near enough: a block start ends an open paragraph, an end tag ends all it
encloses, stray end tags are ignored.  Text of formulas and drawings counts, their
annotations don't.  Of containers with equal points the first is kept.  Whole
pages are read, however long, in time that grows with their length.  Every row
gives one row, repeated rows too; an empty table gives none.  Columns other than
the three named are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import textkernel as tk
from quillon.llm.common import ship

TAG = re.compile(r"""<(?:!--(?:.*?(?:-->|\Z))|[!?][^>]*(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes annotation annotation-xml metadata".split())
BLOCK = frozenset("address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav header footer aside form menu dialog button select option object canvas audio video head".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
DROPPED_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice popup modal newsletter subscribe signup social share sharing related recommended comment comments commentlist disqus discussion replies respond pagination pager toolbar widget login copyright hidden".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
TOPICS = frozenset("discussion related navigation promotion copyright social sharing".split())
NEGATIONS = frozenset("no not non has with without".split())
ALWAYS_KEPT = frozenset("html body article main".split())
ENDS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "tbody": ("tr td th thead tbody", ("table",)), "tfoot": ("tr td th thead tbody", ("table",))}
PARAGRAPH_LIKE = frozenset("p pre blockquote td li dd figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _unwanted(tag: str, attributes: str) -> tuple[bool, frozenset[str]]:
    """Whether an element is dropped in any case, and the words of class and id that speak against it."""
    if tag in DROPPED:
        return True, frozenset()
    if not attributes:
        return False, frozenset()
    words: set[str] = set()
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(a or b or c)
        if name in ("class", "id"):
            for token in value.split():
                parts = [w.lower() for w in WORD.findall(token)]
                words.update(w for k, w in enumerate(parts) if w in DROPPED_WORDS and not (k and parts[k - 1] in NEGATIONS))
        elif tag not in ALWAYS_KEPT and (name == "role" and value.strip().lower() in DROPPED_ROLES or name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True, frozenset()
    return False, frozenset(words)


class Page:
    """Nodes by number (a parent's is smaller) and text blocks in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.drop = ["#root"], [-1], [False]
        self.words: dict[int, frozenset[str]] = {}  # of nodes that class or id speak against
        self._read_blocks: list[tuple[int, list[tuple[str, bool, int]]]] = []  # node, pieces of text with their nodes
        self._text: list[tuple[str, bool, int]] = []
        self._read(source)
        if self.words:
            self._judge()
        self.blocks = [b for node, pieces in self._read_blocks if (b := self._block(node, [x for x in pieces if not self.drop[x[2]]]))[1]]  # node, text, characters in links

    @staticmethod
    def _block(node: int, pieces: list[tuple[str, bool, int]]) -> tuple[int, str, int]:
        text = " ".join("".join(t for t, _, _ in pieces).split())
        return node, text, sum(len("".join(t.split())) for t, link, _ in pieces if link)

    def _flush(self, node: int) -> None:
        if self._text:
            self._read_blocks.append((node, self._text))
            self._text = []

    def _judge(self) -> None:
        """Which of the nodes that class or id speak against are dropped, with all they hold."""
        n = len(self.tag)
        unlinked, linked = [0] * n, [0] * n  # characters, without headings
        for node, pieces in self._read_blocks:
            if self.tag[node] not in HEADINGS:
                for t, link, at in pieces:
                    (linked if link else unlinked)[at] += len("".join(t.split()))
        for node in range(n - 1, 0, -1):
            unlinked[self.parent[node]] += unlinked[node]
            linked[self.parent[node]] += linked[node]
        # articles that class and id don't speak against, and those also outside of all that they speak against
        spoken, above = [False] * n, [0] * n  # above: free articles that hold the node
        holds, free = [False] * n, 0
        for i in range(1, n):
            up = self.parent[i]
            spoken[i] = spoken[up] or i in self.words
            above[i] = above[up]
            if self.tag[i] in ("article", "main") and i not in self.words and unlinked[i] and not self.drop[i]:
                holds[i] = True
                if not spoken[i]:
                    free += 1
                    above[i] += 1
        for i in range(n - 1, 0, -1):
            holds[self.parent[i]] = holds[self.parent[i]] or holds[i]
        whole = unlinked[0]
        for i in range(1, n):
            self.drop[i] = self.drop[i] or self.drop[self.parent[i]]
            if self.drop[i] or i not in self.words or self.tag[i] in ALWAYS_KEPT:
                continue
            words, other = self.words[i], free > above[i]
            keep = holds[i] and (not other or 2 * unlinked[i] > whole)
            keep = keep or not words & COMMENTS and not other and 4 * unlinked[i] > 3 * whole
            keep = keep or above[i] and words <= TOPICS and unlinked[i] and linked[i] < 0.25 * (linked[i] + unlinked[i])
            self.drop[i] = not keep

    def _read(self, source: str) -> None:
        stack, links, at, n = [0], 0, 0, len(source)
        blocks = [0]  # places in the stack that hold blocks
        places: dict[str, list[int]] = {}  # places in the stack by tag, so that no step searches the stack

        def pop(to: int) -> None:
            nonlocal links
            while len(stack) > to:
                node = stack[-1]
                if blocks[-1] == len(stack) - 1:
                    self._flush(node)
                    blocks.pop()
                links -= self.tag[node] == "a"
                places[self.tag[node]].pop()
                stack.pop()

        while at < n:
            m = TAG.search(source, at)
            text = source[at : m.start() if m else n]
            if text and not self.drop[stack[-1]]:
                self._text.append((html.unescape(text), links > 0, stack[-1]))
            if not m:
                break
            at = m.end()
            if m[1]:
                name = m[1].lower()
                if name == "br":
                    self._text.append((" ", False, 0))
                    continue
                if (held := places.get(name)) and (name in BLOCK or held[-1] > blocks[-1]):
                    pop(held[-1])
                continue
            name = (m[2] or m[4] or "").lower()
            if not name:
                continue
            attributes = m[3] or m[5] or ""
            if name in RAW:
                if not attributes.rstrip().endswith("/") or name in ("script", "style", "title", "textarea"):
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = end.end() if end else n
                continue
            if name == "br":
                self._text.append((" ", False, 0))
                continue
            if name in BLOCK:
                if self.tag[stack[blocks[-1]]] == "p":  # an open paragraph ends here
                    pop(blocks[-1])
                if name in ENDS:
                    closes, within = ENDS[name]
                    low = max((held[-1] for w in within if (held := places.get(w))), default=0)
                    inside = [held[k] for c in closes.split() if (held := places.get(c)) and (k := bisect_right(held, low)) < len(held)]
                    if inside:
                        pop(min(inside))
                self._flush(stack[blocks[-1]])
            if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
                continue
            self.tag.append(name)
            self.parent.append(stack[-1])
            dropped, words = _unwanted(name, attributes)
            self.drop.append(self.drop[stack[-1]] or dropped)
            stack.append(len(self.tag) - 1)
            places.setdefault(name, []).append(len(stack) - 1)
            if words:
                self.words[stack[-1]] = words
            if name in BLOCK:
                blocks.append(len(stack) - 1)
            links += name == "a"
        pop(0 + 1)
        self._flush(0)

    def main_text(self) -> str:
        n = len(self.tag)
        points, chars, linked = [0.0] * n, [0] * n, [0] * n
        for node, text, in_links in self.blocks:
            chars[node] += len(text)
            linked[node] += in_links
            if len(text) < 2 or self.tag[node] in HEADINGS:
                continue
            worth = (1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) // 100, 3)) * (1 - min(1.0, in_links / len(text)))
            up = self.parent[node] if self.tag[node] in PARAGRAPH_LIKE else node
            for part in (1.0, 0.5, 1 / 3):
                if up <= 0:
                    break
                points[up] += worth * part
                up = self.parent[up]
        for node in range(n - 1, 0, -1):
            chars[self.parent[node]] += chars[node]
            linked[self.parent[node]] += linked[node]
        score = [p * (1 - min(1.0, linked[i] / max(1, chars[i]))) * (1.25 if self.tag[i] in ("article", "main") else 1.0) for i, p in enumerate(points)]
        best = max(range(n), key=lambda i: (score[i], -i), default=0)
        if score[best] <= 0:
            named = [i for i in range(n) if self.tag[i] in ("article", "main") and chars[i] and not self.drop[i]]
            best = max(named, key=lambda i: chars[i]) if named else 0
        up = best
        while up > 0:
            if self.tag[up] in ("article", "main"):
                best = up
                if self.tag[up] == "article":
                    break
            up = self.parent[up]
        kept = {best}
        if best and self.tag[best] not in ("body", "html"):
            least = 0.2 * score[best]
            for i in range(1, n):
                if self.parent[i] != self.parent[best] or i == best or self.drop[i]:
                    continue
                density = linked[i] / max(1, chars[i])
                if density < 0.25 and (score[i] > 0 and score[i] >= least or self.tag[i] == "p" or self.tag[i] in HEADINGS) or self.tag[i] == "h1" and i < best:
                    kept.add(i)
        inside = [False] * n
        for i in range(n):
            inside[i] = i in kept or self.parent[i] >= 0 and inside[self.parent[i]]
        return "\n\n".join(text for node, text, _ in self.blocks if inside[node])


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    ship(pages.sparkSession)

    def run(batches):
        for b in batches:
            for part in tk.slices(b, "html"):
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
