"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page becomes a sequence of tokens: runs of words and tags. Each word scores positive, each tag negative, by weights learned from
labelled pages (LABELLED, small pages in the layouts of common publishing systems whose main elements carry the attribute data-main; other labelled
pages may be given). One linear scan finds the contiguous run of tokens with the largest sum, which is widened to whole blocks. If it lies in an article or main element and
has at least half of its words, or is a fragment of less than FRAGMENT words, that element's text is taken, so that a short heading or last paragraph isn't lost, nor a list of links; else the run's.

Elements that are no article text wherever they stand are one token each, with their own negative weight, so that one inside an article doesn't
cut it in two, and their text is dropped: by name (nav, header, footer, aside, form, script, ...), or by a class, id or role that names a menu, header,
footer, sidebar, notice, advert or reader comment. Names count on block containers only, not on headings, inline elements or inside pre, and
only if each of their parts is a word of layout, so that related-work or search-trees is none; names of a state (no-sidebar, menu-open) don't count. A name
marks nothing on an element around an article, main or h1, or, on a page without these and on an article itself, on one with most of the
page's words, unless it names comments. Inside an article or main element a name of words such as related or social marks only what is mostly links, as sections are named so
too. A form around an article or around most of the page's words is none. A tag or word that can't stand in a head ends it. The headings of a header inside an article or main element stay, as the article's title.

The operator is one pass without a shuffle, linear in a page's length. Defined cases: null and empty html give empty text; a page without tags is all text; unclosed
elements end where their parent ends; end tags without a start count as tags only, and those of inline elements close no block; a cut last tag counts
as a tag; quotes count after = only. Ties go to the first run. Rows that repeat are extracted each. White space is what Python's str.split() takes
for it. Columns other than page_id, url and html are left aside. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._shared import table

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

# Element and attribute names of HTML.
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE_OTHER = frozenset("button canvas iframe input noscript object option script select style svg template".split())
PARAGRAPH_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
OTHER = frozenset("aside button canvas dialog footer form head header iframe input menu nav noscript object option script select style svg template textarea title".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
NEVER = frozenset("html body main pre".split()) | HEADINGS | INLINE

# Words of names: what marks an element, and what else such a name may have.
COMMENTS = frozenset("comment comments disqus replies respond".split())
MARKS = COMMENTS | frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer gdpr header latest login masthead menu menubar modal nav navbar"
    " navigation newsletter notice notification outbrain pager pagination popular popup promo promotion recent recommended related search share sharing sidebar signup skip social sponsor"
    " sponsored subscribe taboola toolbar trending widget widgets".split()
)
#: Words that sections of an article are named by too: inside one they mark what is mostly links.
AMBIGUOUS = frozenset("latest popular recent recommended related search share sharing social trending".split())
LAYOUT = frozenset(
    "area article articles aside bar block blog body bottom box button buttons card cards center column component container content desktop entries entry fixed form global group header"
    " icon icons inner item items large left line link links list main message mobile module news outer page panel post posts primary region right row secondary section side site slot small"
    " sticky stories story text thread title trail unit user wrap wrapper zone".split()
)
#: Names that say what a layout has, lacks or shows.
STATE = re.compile(r"(?:no|not|has|with|without|hide|show)[_-].*|.*[_-](?:free|less|open|closed|collapsed|enabled|disabled)", re.I)
HOLDS = frozenset(("article", "main", "h1"))

#: A run of fewer words is no region of its own inside an article.
FRAGMENT = 5

LABELLED = (
    "<html><head><title>A day</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/a'>About us</a></li></ul></nav>"
    "<div class='ad'>Buy two and pay for one</div><article data-main><h1>A day at the lake</h1><p>We left early, before the sun was up, and walked to the lake.</p>"
    "<p>The water was <b>cold</b> but clear. <a href='/lake'>The lake</a> is deep.</p><p>Nobody else was there.</p></article><footer>All rights reserved</footer></body></html>",
    "<html><body><div id='top'><a href='/1'>One</a> <a href='/2'>Two</a> <a href='/3'>Three</a> <a href='/4'>Four</a></div><div class='content' data-main><h2>Bread</h2>"
    "<p>Flour, water, salt and time are all that bread needs.</p><ul><li>Mix the flour and the water and wait for an hour.</li><li>Add the salt and fold the dough.</li></ul>"
    "<blockquote>Good bread is slow bread, as my teacher used to say.</blockquote><p>Bake it hot.<br>Let it cool.</p></div><div class='sidebar'><ul><li><a href='/x'>More</a></li></ul></div>"
    "<table><tr><td><a href='/t'>Terms</a></td><td><a href='/p'>Privacy</a></td></tr></table></body></html>",
    "<body><header><div><span>The Daily</span></div><form><input name='q'><button>Go</button></form></header><main data-main><h1>Rain</h1><section><p>Rain fell for a week and the river rose.</p>"
    "<h3>What came after</h3><p>Then the sun returned, and <em>everyone</em> went out to look at the bridge that had held.</p><pre>level 3.2 m</pre></section></main>"
    "<section class='comments'><div><p>First!</p><p>I saw it too.</p></div></section><div><a href='/f'>Follow</a><a href='/s'>Share</a></div><footer><p>Imprint</p></footer></body>",
    "<div><div><a href='a'>Start</a> | <a href='b'>Shop</a> | <a href='c'>Help</a></div><div data-main><p>The shop sold clocks, and every clock told a different time; the owner liked it that way.</p>"
    "<p>People came to ask <i>which</i> one was right.</p><p>None, the owner said.</p></div><div><ul><li><a href='d'>Old</a></li><li><a href='e'>New</a></li></ul><img src='x.png'></div></div>",
    # A weblog's theme.
    "<body class='single'><div id='page'><div class='branding'><a href='/'>Garden notes</a></div><div class='tabs'><ul><li><a href='/a'>Archive</a></li><li><a href='/t'>Tags</a></li><li><a href='/m'>Mail</a></li></ul></div>"
    "<div class='post'><div class='entry-content' data-main><p>The beans came up in the second week of May, three days after the rain.</p><p>I had sown them <em>too deep</em>, as every year, and still most of them found the light.</p>"
    "<ol><li>Water in the evening.</li><li>Tie them up before they fall over.</li></ol><p>By July there were more than we could eat.</p></div><div class='tags'><a href='/1'>beans</a> <a href='/2'>May</a> <a href='/3'>rain</a></div></div>"
    "<div class='prevnext'><a href='/p'>Older</a> <a href='/q'>Newer</a></div><div id='archive'><h3>Archive</h3><ul><li><a href='/5'>May</a></li><li><a href='/6'>June</a></li><li><a href='/7'>July</a></li></ul></div></div></body>",
    # An encyclopedia's page.
    "<body><div id='jump'><a href='#n'>Jump</a></div><div id='content'><div data-main><p>The <b>marsh wren</b> is a small bird of wet meadows, known for its loud song.</p><table><tr><th>Length</th><td>12 cm</td></tr><tr><th>Weight</th><td>10 g</td></tr></table>"
    "<h2>Song</h2><p>Males sing by day and by night<sup><a href='#1'>[1]</a></sup> and build several nests, of which the female picks one.</p><h2>Range</h2><p>It breeds from the coast to the foot of the mountains, and leaves in <a href='/o'>October</a>.</p></div></div>"
    "<div><h3>Tools</h3><ul><li><a href='/w'>What links here</a></li><li><a href='/c'>Cite</a></li></ul><h3>Languages</h3><ul><li><a href='/d'>Deutsch</a></li><li><a href='/f'>Français</a></li></ul></div></body>",
    # A manual's page.
    "<body><div class='toc'><ul><li><a href='#i'>Install</a><ul><li><a href='#l'>Linux</a></li><li><a href='#m'>Mac</a></li></ul></li><li><a href='#u'>Use</a></li></ul></div><div class='document' data-main><h1>Install</h1>"
    "<p>Unpack the archive and run the script in its top folder.</p><pre>tar xf tool.tar\ncd tool\n./setup</pre><p>The script asks where to put the files; <code>/usr/local</code> is a good answer.</p><dl><dt>quiet</dt><dd>Print nothing but errors.</dd></dl></div>"
    "<div><a href='/prev'>Previous</a> <a href='/next'>Next</a> <a href='/source'>Source</a></div></body>",
    # A page laid out by tables.
    "<body><table><tr><td><font><a href='1.htm'>Start</a><br><a href='2.htm'>Pictures</a><br><a href='3.htm'>Guestbook</a><br><a href='4.htm'>Links</a></font></td><td data-main><font>Welcome to my page about kites. I have built them since I was nine years old."
    "<br><br>The first one was made of newspaper and broom straw, and it flew for a whole afternoon before the string broke.</font><p>Write to me if you build one too.</p></td></tr></table><center><font><a href='5.htm'>Mail</a> <a href='6.htm'>Map</a></font></center></body>",
    # A forum's first post.
    "<body><div><span>Forum</span> <span>Rules</span> <span>Members</span></div><div><div><span>anna</span><span>12 posts</span><span>Joined 2009</span></div><div data-main><p>My old radio hums as soon as I turn the volume up. I have already changed both capacitors.</p>"
    "<p>Could it be the transformer? It gets warm, but not hot, after about ten minutes.</p></div></div><div><span><a href='/r'>Reply</a></span><span><a href='/l'>Like</a></span><span><a href='/q'>Quote</a></span></div></body>",
    # A newspaper's page.
    "<body><div><a href='/'>The Courier</a><ul><li><a href='/w'>World</a></li><li><a href='/s'>Sport</a></li><li><a href='/c'>Culture</a></li></ul></div><article data-main><h1>Bridge to reopen in spring</h1><figure><img src='b.jpg'><figcaption>The bridge last week.</figcaption></figure>"
    "<p>The old bridge over the river will carry traffic again from April, the town said on Monday.</p><p>Work had stopped twice because the piers were weaker than the drawings showed.</p><p>Buses go first.</p></article>"
    "<div><h3>Read on</h3><ul><li><a href='/1'>Ferry timetable changes</a></li><li><a href='/2'>Fish return to the harbour</a></li></ul></div><div><span>Contact</span> <span>Terms</span></div></body>",
)


def marks(value: str) -> frozenset | None:
    """The words for which a class or id names something other than article text; None if there is none."""
    for name in value.split():
        if not STATE.fullmatch(name):
            words = [p for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+", name) for p in _parts(w.lower())]
            found = MARKS.intersection(words)
            if found and all(w in MARKS or w in LAYOUT or len(w) < 4 for w in words):
                return found
    return None


def _parts(word: str) -> list[str]:
    """A word of a name, in two parts if it is a word for comments and one of layout written together."""
    for c in COMMENTS:
        if word.startswith(c) and word[len(c) :] in LAYOUT:
            return [c, word[len(c) :]]
    return [word]


class Page:
    """Tokens of a page: (kind, value) with kind "text" or "tag" or "mark", and the article and main elements as token ranges."""

    def __init__(self, html: str):
        self.tokens: list[tuple[str, str]] = []
        self.words: list[int] = []
        self.holders: list[tuple[int, int]] = []
        self.main: list[bool] = []
        self._parts: list[tuple[str, str, bool]] = []
        #: First part, part behind the last, name, whether its name marks it, the words of its class or id that do, whether it is in an article or main.
        self._elements: list[list] = []
        self._parse(html)
        marked = self._marked()
        at, parts, place = 0, self._parts, [0] * (len(self._parts) + 1)
        while at < len(parts):
            kind, value, main = parts[at]
            after = at + 1
            if at in marked:
                after, kind = max(marked[at], after), "mark"
            place[at] = len(self.tokens)
            place[at + 1 : after] = [len(self.tokens) + 1] * (after - at - 1)
            self.tokens.append((kind, value))
            self.words.append(len(value.split()) if kind == "text" else 0)
            self.main.append(main)
            at = after
        place[len(parts)] = len(self.tokens)
        self.holders = [(place[a], place[b]) for a, b, name, *_ in self._elements if name in ("article", "main") and place[a] < place[b]]

    def _parse(self, html: str) -> None:
        parts, elements = self._parts, self._elements
        stack: list[int] = []  # open elements, by their numbers
        open_at: dict[str, list[int]] = defaultdict(list)  # places in the stack, by name
        blocks: list[int] = []  # places in the stack of elements that aren't inline
        main: list[bool] = []
        at, end = 0, len(html)

        def close(upto: int) -> None:
            while len(stack) > upto:
                e = elements[stack.pop()]
                e[1] = len(parts)
                open_at[e[2]].pop()
                main.pop()
                if blocks and blocks[-1] == len(stack):
                    blocks.pop()

        def text(value: str) -> None:
            if stack and elements[stack[-1]][2] == "head" and value.strip():  # words end the head
                close(len(stack) - 1)
            if value:
                parts.append(("text", unescape(value), bool(main) and main[-1]))

        while at < end:
            m = TOKEN.search(html, at)
            if not m:
                text(html[at:])
                break
            text(html[at : m.start()])
            at, name = m.end(), (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                parts.append(("tag", "/" + name, bool(main) and main[-1]))
                if open_at[name] and (name not in INLINE or not blocks or open_at[name][-1] > blocks[-1]):
                    close(open_at[name][-1])
                continue
            top = elements[stack[-1]][2] if stack else ""
            if top == "head" and name not in IN_HEAD:
                close(len(stack) - 1)
            if name in PARAGRAPH_ENDS and top == "p" or name == top and name in ("li", "p", "option", "dt", "dd"):
                close(len(stack) - 1)
            found: dict[str, str] = {}
            for a in ATTRIBUTE.findall(m[3]) if m[3] else ():
                found.setdefault(a[0].lower(), a[1] or a[2] or a[3])
            first, own = len(parts), "data-main" in found or bool(main) and main[-1]
            by_name = name in OTHER or name not in NEVER and found.get("role", "").lower() in ROLES
            named = None
            if name not in NEVER and not open_at["pre"]:
                named = marks(found["class"]) if "class" in found else None
                named = named or (marks(found["id"]) if "id" in found else None)
            holder = bool(open_at["article"] or open_at["main"])
            parts.append(("tag", name, own))
            elements.append([first, first + 1, name, by_name, named, holder])
            if name in RAW:
                gone = re.compile(rf"</{name}(?![a-z0-9])[^>]*>?", re.I).search(html, at)
                at = gone.end() if gone else end
                continue
            if name in VOID or m[3].endswith("/") and name not in PARAGRAPH_ENDS:
                continue
            if name not in INLINE:
                blocks.append(len(stack))
            open_at[name].append(len(stack))
            stack.append(len(elements) - 1)
            main.append(own)
        close(0)

    def _marked(self) -> dict[int, int]:
        """First part and part behind the last of what is dropped."""
        elements, words = self._elements, [0, *accumulate(len(v.split()) if kind == "text" else 0 for kind, v, _ in self._parts)]
        holds = [e[0] for e in elements if e[2] in HOLDS and not e[4]]
        bodies = [e[0] for e in elements if e[2] in ("article", "main") and not e[4]]
        headings = [e for e in elements if e[2] in HEADINGS]
        starts, marked = [e[0] for e in headings], {}
        inside = [0] * (len(self._parts) + 1)
        for a, b, name, *_ in elements:
            if name == "a":
                inside[a] += 1
                inside[b] -= 1
        linked = [0, *accumulate(words[k + 1] - words[k] if depth else 0 for k, depth in enumerate(accumulate(inside[:-1])))]

        def first_in(places: list[int], a: int, b: int) -> int | None:
            k = bisect_right(places, a)
            return places[k] if k < len(places) and places[k] < b else None

        for a, b, name, by_name, named, in_holder in elements:
            if not by_name and named is None:
                continue
            comments = bool(named and named & COMMENTS)
            if not by_name:
                if first_in(holds, a, b) is not None:
                    continue
                if not comments and (not holds or name == "article") and 2 * (words[b] - words[a]) > words[-1]:
                    continue
                if in_holder and named <= AMBIGUOUS and 2 * (linked[b] - linked[a]) < words[b] - words[a]:
                    continue
            elif name == "form" and (first_in(holds, a, b) is not None or 2 * (words[b] - words[a]) > words[-1]):  # a form around the page
                continue
            elif (body := first_in(bodies, a, b)) is not None:  # left open before the article
                b = body
            if in_holder and (name == "header" or named and "header" in named):
                for k in range(bisect_left(starts, a), bisect_left(starts, b)):
                    h = headings[k]
                    if h[0] > a:
                        marked.setdefault(a, h[0])
                    a = max(a, h[1])
            if a < b:
                marked[a] = max(b, marked.get(a, 0))
        return marked

    def inside_a_block(self, k: int) -> bool:
        """Whether the token is text or an inline tag."""
        kind, value = self.tokens[k]
        return kind == "text" or kind == "tag" and value.lstrip("/") in INLINE

    def text(self, first: int, last: int) -> str:
        out = []
        for kind, value in self.tokens[first:last]:
            if kind == "text":
                out.append(value)
            elif value.lstrip("/") not in INLINE and not (kind == "mark" and value in INLINE_OTHER):
                out.append(" ")
        return " ".join("".join(out).split())


class Weights:
    """word: score of a word; tag(name): score of a tag, by its name, for those seen in labelled pages; other: score of a dropped element."""

    def __init__(self, pages: Iterable[str] = (), *, word: float | None = None, tags: dict[str, float] | None = None):
        inside, outside = Counter(), Counter()
        for html in pages:
            page = Page(html)
            for (kind, value), n, main in zip(page.tokens, page.words, page.main):
                if kind == "mark":
                    continue
                name = "text" if kind == "text" else value.lstrip("/")
                (inside if main else outside)[name] += n if kind == "text" else value[0] != "/"
        odds = {name: math.log((inside[name] + 0.5) / (outside[name] + 0.5)) for name in {*inside, *outside}}
        prior = math.log((sum(inside.values()) + 1) / (sum(outside.values()) + 1))
        self.word = word or max(0.25, odds.get("text", 1.0))
        #: A tag mostly inside costs little; one mostly outside costs its log odds more.
        self.tags = {name: -max(0.05, 0.5 - 0.5 * v if v > 0 else 0.5 - v) for name, v in odds.items() if name != "text"}
        self.tags |= tags or {}
        self.unseen = self.tags.get("", -max(0.3, 0.5 - prior / 2))
        #: A dropped element stands inside articles too (an advert between paragraphs): one word more than pays for it.
        self.other = -self.word / 2

    def tag(self, name: str) -> float:
        return self.tags.get(name.lstrip("/"), self.unseen)

    def score(self, kind: str, value: str, words: int) -> float:
        return words * self.word if kind == "text" else self.other if kind == "mark" else self.tag(value)


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous run with the largest sum; (0, 0) if no sum is positive."""
    best = total = 0.0
    first = last = start = 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best + 1e-9:
            best, first, last = total, start, k + 1
    return first, last


def extract(html: str | None, weights: Weights) -> str:
    if not html:
        return ""
    page = Page(html)
    first, last = best_run([weights.score(kind, value, n) for (kind, value), n in zip(page.tokens, page.words)])
    if first == last:
        return ""
    while first and page.inside_a_block(first - 1):  # a block is taken whole
        first -= 1
    while last < len(page.tokens) and page.inside_a_block(last):
        last += 1
    around = [(b - a, a, b) for a, b in page.holders if a <= first and last <= b]
    if around:
        _, a, b = min(around)
        words = sum(page.words[first:last])
        if 2 * words >= sum(page.words[a:b]) or words < FRAGMENT:
            first, last = a, b
    return page.text(first, last)


def _extract(weights: Weights):
    def run(batches):
        for batch in batches:
            texts = [extract(h.as_py(), weights) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, labelled: Iterable[str] = LABELLED) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages. labelled: pages whose main elements have the attribute data-main."""
    pages = pages.select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(_extract(Weights(labelled)), f"page_id {kind}, url string, text string, n_chars bigint")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
