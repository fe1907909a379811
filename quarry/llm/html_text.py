"""Main text of web pages: flat blocks, classified by a small decision tree.

A page is cut into flat text blocks at block-level tags.  A block is described
by its number of words and link density, those of its neighbours, and where it
stands: its kind of tag, whether an element around it is page furniture by tag or
role, or the page's article (a form counts as a name does, as it may hold the page); how much of a name (class or id) around it speaks of
furniture, from 0 ("share-price" is half a name) to 1, and how much of the
page's words lie under such names, for a name that holds most of the page cannot
be furniture.  A decision tree, trained here on a small table of labelled blocks
(``LABELLED``: pages whose blocks begin with + for text and - for the rest),
keeps or drops each block.

Kept blocks have their character references decoded once, each piece of text by
itself, and white space made one space; they are joined by line feeds in page
order.  Markup may be broken: unclosed elements end with their container, end
tags without a start are skipped, an unfinished tag at the end is dropped, a
stray ``<`` is text, an unclosed comment or script runs to the end.

Cases: null or empty html gives an empty text; pages of any length are read
whole, in linear time; repeated rows are extracted each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import ship, table

# Fixed values of HTML: element names by role
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
SKIPPED = frozenset("script style noscript template textarea title iframe svg math object audio video canvas select button xmp noframes noembed".split())
#: Of these, what may close itself.
FOREIGN = frozenset("svg math".split())
CLOSED_BY_SAME = frozenset("p li dt dd option tr td th".split())
#: Block-level tags that end an open paragraph.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE_TAGS = frozenset("nav header footer aside menu dialog search".split())
#: Of elements that are furniture unless they hold the page, as a name would be; an article inside is none the less one
WRAPPERS = {"form": 0.9, "fieldset": 0.9}
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
TEXT_TAGS = frozenset("article main".split())
#: Parts of class and id names that page furniture goes by
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup privacy promo promoted promotion recommended related replies reply respond share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags taglist teaser toc toolbar topbar warning widget widgets".split()
)
TEXT_NAMES = frozenset("article body content entry main post story text".split())
#: Parts that say nothing of what a container holds
NEUTRAL_NAMES = frozenset(
    "area bar block bottom box btn button buttons col column container element group holder icon icons inner item items js left links list outer page panel primary right row secondary section site slot top unit wrap wrapper zone".split()
) | TEXT_NAMES | frozenset("articles posts stories".split())
#: Of the furniture's, those that as often name something that a text is about
AMBIGUOUS_NAMES = frozenset("banner discussion form header login menu privacy reply respond share sharing skip social tags toc warning".split())
#: What any other of them weighs against a word that is neither neutral nor furniture
PLAIN_WEIGHT = 4
#: A name with one of them tells of a state of the page
STATE_NAMES = frozenset("has with no without is not enable enabled disable disabled".split())

_TOKEN = re.compile(
    r"""<!--(?:.*?--!?>|.*\Z) | <!\[CDATA\[.*?(?:\]\]>|\Z) | <[!?][^>]*(?:>|\Z)
    | <(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>
    | </?[a-zA-Z][^>]*(?:>|\Z) | <(?=/)[^>]*(?:>|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in SKIPPED}
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    tag: str
    words: int
    links: float  # share of words inside links
    furniture: bool  # by tag, role or as hidden
    article: bool
    named: float  # share of furniture in the names around it


@dataclass(frozen=True)
class Place:
    """What is known of all that lies in an element."""

    furniture: bool = False
    article: bool = False
    named: float = 0.0


@lru_cache(1 << 14)
def _parts(name: str) -> frozenset[str]:
    """The words of a name: parted by signs and capitals, and where two known words, one of them furniture's, are written as one."""
    out = set()
    for part in _SPLIT.split(_CAMEL.sub("-", name).lower()):
        known = FURNITURE_NAMES | NEUTRAL_NAMES
        pairs = [(part[:i], part[i:]) for i in range(2, min(len(part), 40) - 1)] if part not in known else []
        two = next((p for p in pairs if p[0] in known and p[1] in known and any(x in FURNITURE_NAMES - AMBIGUOUS_NAMES and len(x) > 3 for x in p)), (part,))
        out.update(x for x in two if x)
    return frozenset(out)


def _named(names: list[str]) -> float:
    """How much of an element's names speaks of furniture."""
    best, text = 0.0, False
    for name in names:
        parts = _parts(name)
        if parts & STATE_NAMES:
            continue
        text |= bool(parts) and parts <= TEXT_NAMES
        told = parts & FURNITURE_NAMES
        if told:
            weight = sum(1 if x in AMBIGUOUS_NAMES else PLAIN_WEIGHT for x in told)
            best = max(best, weight / (weight + len(parts - FURNITURE_NAMES - NEUTRAL_NAMES)))
    return best / 2 if text else best


def _inside(outer: Place, name: str, attrs: str) -> Place:
    """The place inside an element with this tag."""
    names: list[str] = []
    furniture, article = name in FURNITURE_TAGS and not (name == "header" and outer.article), name in TEXT_TAGS
    for m in _ATTR.finditer(attrs) if attrs else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            names += value.split()
        elif key == "hidden" or (key == "style" and _UNSEEN.search(value)):
            furniture = True
        elif key == "role":
            furniture |= value.lower() in FURNITURE_ROLES
            article |= value.lower() in TEXT_TAGS
    own = 0.0 if name in ("html", "body") else max(_named(names), WRAPPERS.get(name, 0.0))
    before = 0.0 if article and outer.named < 1 else outer.named  # what half speaks of furniture cannot hold the article
    return Place(outer.furniture or furniture, outer.article or article, max(own, before))


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, Place]] = []  # open block elements and the place inside
    is_open: Counter[str] = Counter()
    nowhere = Place()
    place, tag = nowhere, ""
    pieces: list[str] = []
    link_words, in_link = 0, False
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal link_words
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                words = text.count(" ") + 1
                out.append(Block(text, tag, words, min(1.0, link_words / words), place.furniture, place.article, place.named))
        link_words = 0

    def add(raw: str) -> None:
        nonlocal link_words
        text = _html.unescape(raw)
        pieces.append(text)
        if in_link:
            link_words += len(text.split())

    def close() -> None:
        is_open[stack.pop()[0]] -= 1

    find = _TOKEN.search
    while at < n:
        m = find(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if not m["end"]:
            attrs = m["attrs"]
            if name in SKIPPED and not (name in FOREIGN and attrs.endswith("/")):
                end = _END[name].search(page, at)
                at = end.end() if end else n
                if name in BLOCK:
                    flush()
            elif name == "br":
                pieces.append(" ")
            elif name == "a":
                in_link = True
            elif name in BLOCK:
                flush()
                in_link = False
                if name == "hr":
                    continue
                if name in CLOSED_BY_SAME or name in HEADINGS:
                    while stack and stack[-1][0] in ("p", name):
                        close()
                elif stack and stack[-1][0] == "p":
                    close()
                place, tag = _inside(stack[-1][1] if stack else nowhere, name, attrs), name
                stack.append((name, place))
                is_open[name] += 1
        elif name == "a":
            in_link = False
        elif name in BLOCK:
            flush()
            in_link = False
            while is_open[name]:
                found = stack[-1][0] == name
                close()
                if found:
                    break
            tag, place = stack[-1] if stack else ("", nowhere)
    flush()
    return out


FEATURES = "furniture article outside named mass words links words_before links_before words_after links_after heading item".split()


def features(found: list[Block]) -> np.ndarray:
    """A row for each block; neighbours beyond the page's ends have no words and no links."""
    x = np.zeros((len(found), len(FEATURES)))
    if not found:
        return x
    article = np.array([b.article and not b.furniture for b in found])
    words, named = np.array([b.words for b in found]), np.array([b.named for b in found])
    links = np.array([b.links for b in found])
    x[:, 0], x[:, 1] = [b.furniture for b in found], article
    x[:, 2] = article.any() & ~article
    x[:, 3] = named
    x[:, 4] = words[named > 0].sum() / words.sum()
    x[:, 5], x[:, 6] = words, links
    x[1:, 7], x[1:, 8] = words[:-1], links[:-1]
    x[:-1, 9], x[:-1, 10] = words[1:], links[1:]
    x[:, 11] = [b.tag in HEADINGS for b in found]
    x[:, 12] = [b.tag in ("li", "td", "th", "dt", "dd") for b in found]
    return x


@dataclass
class Tree:
    """A binary decision tree; a leaf has no feature."""

    keep: bool
    feature: int = -1
    at: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def judge(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.keep)
        out = np.empty(len(x), bool)
        low = x[:, self.feature] <= self.at
        out[low], out[~low] = self.low.judge(x[low]), self.high.judge(x[~low])
        return out


def train(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 2) -> Tree:
    """CART by Gini impurity; ties go to the feature named first, then to the least threshold."""
    leaf = Tree(bool(y.mean() >= 0.5) if len(y) else False)
    if depth == 0 or len(y) < 2 * least or y.all() or not y.any():
        return leaf
    best = (2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for at in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= at
            a, b = y[low], y[~low]
            if min(len(a), len(b)) >= least:
                impurity = sum(len(s) * 2 * s.mean() * (1 - s.mean()) for s in (a, b)) / len(y)
                if impurity < best[0]:
                    best = (impurity, f, at)
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Tree(leaf.keep, best[1], float(best[2]), train(x[low], y[low], depth - 1, least), train(x[~low], y[~low], depth - 1, least))


def _prose(n: int, mark: str = "+") -> str:
    return mark + " ".join(["word"] * n)


_MENU = "<nav><ul><li><a href=/>-Home</a></li><li><a href=/n>-News</a></li><li><a href=/s>-All sport</a></li></ul></nav>"
_LINKS = "<ul><li><a href=1>-one two three</a></li><li><a href=2>-four five six seven</a></li><li><a href=3>-eight nine</a></li></ul>"
_FOOT = "<footer>-Copyright of the site <a href=/t>terms</a> <a href=/p>privacy</a></footer>"


def _paragraphs(*sizes: int, mark: str = "+") -> str:
    return "".join(f"<p>{_prose(n, mark)}</p>" for n in sizes)


#: The labelled table: + begins a block of the text, - any other block.
LABELLED = [
    f"<body>{_MENU}<article><h1>+A title of the text</h1>{_paragraphs(60, 3, 45, 1, 30)}</article>{_FOOT}",
    f"<body>{_MENU}<div class=ad>-Buy this now or never</div><article><h1>+Short</h1>{_paragraphs(1)}</article>{_FOOT}",
    f"<body><header><a href=/>-Site name</a><p>-What the site is about in a few words</p></header><main><h1>+Title here</h1>{_paragraphs(80, 2, 20)}<ul><li>+first point of the list</li><li>+second</li></ul><h2>+Part</h2>{_paragraphs(5, 40)}</main><aside>{_paragraphs(30, 12, mark='-')}</aside>{_FOOT}",
    f"<body>{_MENU}<div id=content><h1>+Title of this page</h1>{_paragraphs(70, 55, 40, 24)}</div><div class=sidebar><h3>-Latest</h3>{_LINKS}</div>{_FOOT}",
    f"<body>{_LINKS}<div><h1>+The title of it</h1>{_paragraphs(50, 35, 28, 44)}</div>{_LINKS}<div>-All rights reserved</div>",
    f"<body><div><a href=/>-Site</a> <a href=/b>blog</a> <a href=/c>about</a></div><div>{_paragraphs(90, 60, 75)}</div><div><a href=/x>-older posts</a> <a href=/y>newer posts</a></div>",
    f"<body><main><article>{_paragraphs(40, 8, 33)}<blockquote>+quoted words stand here</blockquote><table><tr><td>+cell</td><td>+other cell</td></tr></table></article><section id=comments><h2>-3 comments</h2>{_paragraphs(25, 40, 2, mark='-')}</section></main>{_FOOT}",
    f"<body><div class=cookie-notice>{_paragraphs(35, mark='-')}</div><article><h2>+Heading</h2>{_paragraphs(30, 2, 2)}<form>-Enter your mail address to subscribe</form>{_paragraphs(18)}<div class=related><h3>-Read also</h3>{_LINKS}</div></article>{_FOOT}",
    f"<body><p>-Menu</p>{_LINKS}<p>-Advertisement</p>{_paragraphs(65, 48)}<p>+short end</p>{_paragraphs(52)}<p>-Share</p>{_LINKS}",
    f"<body><article><p>+see <a href=1>this page</a> for more of it</p>{_paragraphs(12)}<p>+as <a href=1>two words</a> say</p></article><p>-Contact us today</p>{_paragraphs(22, mark='-')}",
    f"<body><article><h1>+Title</h1>{_paragraphs(20, 16)}{_LINKS}</article>{_FOOT}",
    f"<body>{_MENU}<article>{_paragraphs(2, 1, 4, 3)}</article><div>{_paragraphs(14, 26, mark='-')}</div>{_FOOT}",
    f"<body><div>-Log in <a href=/l>here</a></div><div>-Search</div><h1>+A heading of the text</h1>{_paragraphs(33, 47, 58)}<h2>+Next part</h2>{_paragraphs(41, 36)}<div>-Tags</div><div><a href=1>-one</a> <a href=2>two</a></div>",
    "<body><article><p>+x</p></article>",
    f"<body>{_MENU}<article><p>+x</p></article>{_FOOT}",
    f"<body>{_MENU}<article>+plain text<p>+q</p></article>{_FOOT}",
    f"<body>{_MENU}<main><h1>+T</h1><p>+a</p><p>+b c</p></main>{_FOOT}",
    f"<body>{_MENU}<article><p><a href=1>+all of it</a></p><p>+of</p><p><a href=2>+a linked line</a></p></article>{_FOOT}",
    f"<body>{_MENU}<article>{_paragraphs(1, 1, 2, 1)}<p><a href=3>+source of this</a></p></article>{_LINKS}",
    f"<body><article>{_paragraphs(11, 1)}</article><article class=comment>{_paragraphs(40, 9, mark='-')}</article><article class=comment>{_paragraphs(3, mark='-')}</article>",
    f"<body><div role=alert>{_paragraphs(16, 50, mark='-')}</div><aside>{_paragraphs(70, 1, mark='-')}</aside><article>{_paragraphs(2, 90)}</article><div id=comments>{_paragraphs(60, 33, mark='-')}</div><form>{_paragraphs(21, mark='-')}</form>",
    f"<body><div class=sidebar>{_paragraphs(44, 52, mark='-')}</div><div>{_paragraphs(38, 61, 4, 29)}</div><div class=advert>{_paragraphs(37, mark='-')}</div><footer>{_paragraphs(26, mark='-')}</footer>",
    "<body><p>+Nothing but this one paragraph of eleven words stands on it.</p>",
    # half a name says little: long blocks without links stay
    f"<body>{_MENU}<article>{_paragraphs(40, 30)}<div class=share-price>{_paragraphs(60)}</div><section class=warning-signs>{_paragraphs(55, 20)}</section>{_paragraphs(25)}</article>{_FOOT}",
    f"<body>{_MENU}<div class=share-price>{_paragraphs(60, 44)}</div>{_FOOT}",
    f"<body>{_MENU}<main><section class=login-history>{_paragraphs(13, 4, 35)}</section>{_paragraphs(22)}</main>{_FOOT}",
    f"<body><article>{_paragraphs(40, 30)}<div class=share-tools><a href=1>-Send it</a> <a href=2>print</a></div></article>{_FOOT}",
    # a whole name in the article tells
    f"<body>{_MENU}<article>{_paragraphs(50, 30)}<div class=newsletter-signup>{_paragraphs(28, mark='-')}</div>{_paragraphs(25)}<div class=related-posts>{_paragraphs(5, 44, 9, mark='-')}</div></article>{_FOOT}",
    f"<body>{_MENU}<article>{_paragraphs(50, 30)}<section id=reader-comments>{_paragraphs(41, 7, 66, mark='-')}</section></article>{_FOOT}",
    f"<body>{_MENU}<article>{_paragraphs(12, 30)}<div class=legal-notice>{_paragraphs(36, 19, mark='-')}</div>{_paragraphs(25, 4)}</article>{_FOOT}",
    f"<body>{_MENU}<article>{_paragraphs(20, 30)}<div class=comment-list>{_paragraphs(48, 60, 3, 90, 33, mark='-')}</div></article>{_FOOT}",
    f"<body><article>{_paragraphs(70)}</article><section class=comments>{_paragraphs(48, 60, 3, 90, 33, mark='-')}</section>",
    f"<body><div class=notice>{_paragraphs(42, mark='-')}</div><div>{_paragraphs(60, 33, 70)}</div><div class=comments>{_paragraphs(40, 25, mark='-')}</div>",
    f"<body>{_paragraphs(66, 58)}<div class=comments>{_paragraphs(38, 12, mark='-')}</div><div class=copyright>{_paragraphs(14, mark='-')}</div>",
    # a name that holds the page is no furniture
    f"<body>{_MENU}<div class=widget><h1>+Title of it</h1>{_paragraphs(80, 60, 44)}</div>{_FOOT}",
    f"<body><div class=notice>{_paragraphs(38, 90, 51, 27)}</div>{_FOOT}",
    # a form that holds the page, with an article or without
    f"<body><form id=aspnetForm>{_MENU}<div id=content><h1>+Title of this page</h1>{_paragraphs(70, 44, 9)}</div>{_FOOT}</form>",
    f"<body><form id=aspnetForm>{_MENU}<article>{_paragraphs(31, 3, 60)}</article>{_FOOT}</form>",
    f"<body><form method=post><div>{_paragraphs(52, 38, 41)}</div></form>",
    f"<body>{_MENU}<article>{_paragraphs(44, 35)}<form>{_paragraphs(12, 40, mark='-')}</form>{_paragraphs(21)}</article>{_FOOT}",
    # pages that end with their text
    f"<body><article>{_paragraphs(20, 5, 12)}</article>",
    f"<body>{_MENU}<article><h1>+T</h1>{_paragraphs(3, 2)}</article>",
    f"<body>{_MENU}<main>{_paragraphs(1, 2, 1)}</main>",
    f"<body><article>{_paragraphs(30, 1)}<section class=warning-signs>{_paragraphs(58)}</section></article>",
    f"<body><article><p>+see <a href=1>this page</a></p>{_paragraphs(2)}</article>",
    f"<body>{_MENU}<div>{_paragraphs(44, 31, 26)}</div>",
    f"<body>{_paragraphs(24, 51)}",
    # furniture by its tag, on pages without an article
    f"<body><header>{_paragraphs(18, mark='-')}</header><div>{_paragraphs(64, 45)}</div><aside>{_paragraphs(30, 41, 3, mark='-')}</aside><footer>{_paragraphs(35, 12, mark='-')}</footer>",
    f"<body><nav>{_paragraphs(26, 2, mark='-')}</nav>{_paragraphs(55, 39)}<form>{_paragraphs(33, mark='-')}</form><aside>{_paragraphs(77, mark='-')}</aside>",
    f"<body>{_paragraphs(81, 34)}<footer>{_paragraphs(48, mark='-')}</footer>",
    f"<body><aside>{_paragraphs(52, 60, mark='-')}</aside><p hidden>{_prose(31, '-')}</p><div role=alert>{_paragraphs(36, mark='-')}</div><div>{_paragraphs(47, 29)}</div>",
    f"<body><article>{_paragraphs(9)}<aside>{_paragraphs(40, 62, mark='-')}</aside>{_paragraphs(14, 3)}</article><footer>{_paragraphs(20, mark='-')}</footer>",
    f"<body class='page with-sidebar'>{_MENU}<div id=page class=has-sidebar><h1>+Title</h1>{_paragraphs(45, 61)}</div>{_FOOT}",
]


@lru_cache(1)
def tree() -> Tree:
    rows, labels = [], []
    for page in LABELLED:
        found = blocks(page)
        rows.append(features(found))
        labels += [b.text[0] == "+" for b in found]
    return train(np.concatenate(rows), np.array(labels))


def extract(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = tree().judge(features(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [extract(p.as_py()) for p in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
