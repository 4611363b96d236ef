"""Main text of a web page by tree scoring.

A page is parsed into a tree (scripts, styles, comments and the head are skipped while parsing).  Parts that say by tag, role, class
or id that they are not the article are cut off; where only a word of a longer name says so ("elementor-widget"), a part within the
article is cut off only if it is mostly links too.  Every paragraph earns points for its length and its commas and passes them to its
ancestors, less at each level; a container's points are discounted by its link density.  The best container is kept whole, and
around it, up to the body, everything that is not mostly links; inside an ``article`` or ``main`` element the whole element is kept.
The text comes out as blocks in page order.

Each page is parsed on its own in an Arrow map: no shuffle.  Defined cases: null or empty html gives the empty text; broken markup
is read as far as it goes (an unclosed tag or comment at the end is dropped); pages of any length are read whole; repeated
rows get equal results; of containers with equal points the first one found is the best; an empty table gives an empty result; columns other than those named are not read, so their names can't clash.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.base import arrow_rows
from starlens.llm.registry import register, table

# HTML element names by role, and words of class or id names that mark parts outside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg".split())
RAW_TEXT = frozenset({"xmp"})  # raw, but shown
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul xmp".split()
)
CLOSES_P = BLOCKS - frozenset("body caption dd dt html legend li optgroup option tbody td tfoot th thead tr".split()) | {"p"}
# an opening tag ends an open element of these names, unless a barrier comes first
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
OUTSIDE_TAGS = frozenset("nav footer aside form button select input dialog menu object embed audio video canvas map label fieldset annotation annotation-xml".split())
OUTSIDE_ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar status".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disclaimer disqus footer footnav gdpr header login masthead menu modal nav navbar navigation navi newsletter notice notices notification overlay pager "
    "pagination paywall popup promo promoted promotion recommended recommendations related replies reply respond share sharing shoutbox sidebar signin signup "
    "skip social sponsor sponsored sponsors subscribe subscription teaser toolbar topbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
# whole names of parts beside the article, however long they are
BESIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot breadcrumb breadcrumbs cookie cookies footer footnav gdpr nav navbar navi navigation sidebar".split()
)
# words that also name parts of an article: only a name of this one word is enough, except header
GENERIC_WORDS = frozenset("disclaimer header menu modal notice notices overlay related skip social teaser widget widgets".split())
CLEAR_WORDS = OUTSIDE_WORDS - GENERIC_WORDS
# words that add nothing to a name, as in "sidebar-left" or "related-posts"
FILLERS = frozenset(
    "area articles bar block body bottom box buttons col column container div inner item items left links list main page post posts right section site slot "
    "stories thread top unit wide wrap wrapper".split()
)
LAYOUT_WORDS = frozenset("has hide is no show with without".split())  # "no-sidebar" tells of the layout
KEPT_TAGS = frozenset("html body article main".split())
PARAGRAPHS = frozenset("p pre xmp td blockquote li dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DENSE = 0.5  # share of characters in links from which a block is mostly links
FEW_POINTS = 10
NEARLY = 0.9  # share of the page's points

TAG = re.compile(
    r"<!--(?:>|->)?+(?P<comment>.*?)(?:-->|--!>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<bogus>[!?/])[^>]*+>|<(?P<loose>/?[a-zA-Z][^>]*+)>", re.S
)
UNENDED = re.compile(r"<(?:[a-zA-Z/!?])[^>]*\Z")
ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[a-z]+|[0-9]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "score")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children, self.score = tag, attrs, parent, [], 0.0

    def attributes(self) -> dict[str, str]:
        return {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTR.findall(self.attrs)} if self.attrs else {}


def parse(page: str) -> Node:
    """The tree of a page; texts are children of type str, with character references decoded."""
    root = Node("#root")
    at, here, length = 0, root, len(page)
    # no tag ends behind the last bracket, so the search need not look there, but a comment that never ends begins anywhere
    ended = length if page.rfind("<!--") > page.rfind("-->") else page.rfind(">") + 1
    opened: Counter[str] = Counter()  # names from the root down to ``here``: an end tag without a start is known at once

    def up_to(node: Node | None) -> None:
        """Closes the elements below ``node``."""
        nonlocal here
        while here is not node:
            opened[here.tag] -= 1
            here = here.parent

    while at < length:
        m = TAG.search(page, at, ended) if at < ended else None
        text = page[at : m.start()] if m else page[at:]
        if not m:
            text = UNENDED.sub("", text)
        if text:
            here.children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name, attrs, ends = m["name"], m["attrs"], m["end"]
        if m["loose"]:  # quotes that do not pair up: the tag ends at the next bracket
            loose = m["loose"]
            ends, loose = ("/", loose[1:]) if loose[0] == "/" else ("", loose)
            name, _, attrs = (re.split(r"([\s/])", loose, maxsplit=1) + ["", ""])[:3]
        if not name:
            continue
        name = name.lower()
        if ends:
            if opened[name] > 0:
                up = here
                while up.tag != name:
                    up = up.parent
                up_to(up.parent)
            continue
        if name in CLOSES_P and opened["p"] > 0:
            up = here
            while up is not root and up.tag != "p" and up.tag not in BLOCKS:
                up = up.parent
            if up.tag == "p":
                up_to(up.parent)
        if name in IMPLIED:
            closes, barrier = IMPLIED[name]
            up, last, more = here, None, sum(opened[c] for c in closes)
            while more > 0 and up is not root and up.tag not in barrier:
                if up.tag in closes:
                    last, more = up, more - 1
                up = up.parent
            if last is not None:
                up_to(last.parent)
        if name in ("body", "html") and opened[name] > 0:
            continue
        node = Node(name, attrs, here)
        here.children.append(node)
        if name in VOID or attrs.endswith("/") and name in RAW:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if name in RAW_TEXT:
                node.children.append(page[at : close.start() if close else length])
            at = close.end() if close else length
            continue
        if name == "head":
            close = re.compile(r"</head(?=[\s/>])[^>]*>|<body(?=[\s/>])", re.I).search(page, at)
            if close:  # nothing of the head is text
                at = close.start()
        here = node
        opened[name] += 1
    return root


def marked_outside(node: Node, most: bool = False, inside: bool = False) -> str:
    """Whether the element says that it is not part of the article: "out", "perhaps" (a word of a longer name says so), "large" (its name
    says so, but it holds most of the page's text) or "".  ``most``: it holds most of the page's text, so that a name such as
    "with-sidebar" tells of the layout.  ``inside``: it is part of an article or main element."""
    if node.tag in KEPT_TAGS:
        return "out" if node.tag == "article" and node.attrs and any(t <= COMMENT_WORDS | FILLERS and t & COMMENT_WORDS for t in _names(node)) else ""
    if node.tag in OUTSIDE_TAGS or node.tag in RAW - RAW_TEXT or node.tag == "head":
        return "out"
    if not node.attrs:
        return ""
    a = node.attributes()
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in OUTSIDE_ROLES:
        return "out"
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return "out"
    if node.tag in HEADINGS or not _words(node, a) & OUTSIDE_WORDS:
        return ""
    names = _names(node, a)
    if most:
        return "large" if any(t <= COMMENT_WORDS | FILLERS and t & COMMENT_WORDS or len(t) == 1 and t <= BESIDE_WORDS for t in names) else ""
    for t in names:
        if len(t) == 1 and t <= OUTSIDE_WORDS and not (inside and t == {"header"}):
            return "out"
        if t <= {"notice", "notices"} | FILLERS and t & {"notice", "notices"}:
            return "out"
        if t <= OUTSIDE_WORDS | FILLERS and t & CLEAR_WORDS or t <= {"related"} | FILLERS and "related" in t or len(t & CLEAR_WORDS) > 1:
            return "out"
    return "out" if _led_outside(a) else "perhaps"


def _names(node: Node, a: dict[str, str] | None = None) -> list[set[str]]:
    """Words of each class name and of the id, without numbers."""
    a = node.attributes() if a is None else a
    return [{w.lower() for w in WORD.findall(n) if not w.isdigit()} for n in f"{a.get('class', '')} {a.get('id', '')}".split()]


def _led_outside(a: dict[str, str]) -> bool:
    """The first or the last word of a name, fillers aside, says what it names: "acme-footer" is a footer and "promo-card" an advert,
    "social-impact" is neither."""
    for n in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = [w.lower() for w in WORD.findall(n) if not w.isdigit()]
        while words and words[-1] in FILLERS:
            words.pop()
        while words and words[0] in FILLERS:
            words.pop(0)
        if words and words[0] not in LAYOUT_WORDS and (words[0] in CLEAR_WORDS or words[-1] in CLEAR_WORDS):
            return True
    return False


def _words(node: Node, a: dict[str, str] | None = None) -> set[str]:
    a = node.attributes() if a is None else a
    return {w.lower() for w in WORD.findall(f"{a.get('class', '')} {a.get('id', '')}")}


def _wrappers(root: Node, tags: tuple[str, ...]) -> set[int]:
    """Identities of the elements round an element of these tags."""
    out, stack = set(), [root]
    while stack:
        n = stack.pop()
        if n.tag in tags:
            up = n.parent
            while up is not None and id(up) not in out:
                out.add(id(up))
                up = up.parent
        stack += [c for c in n.children if isinstance(c, Node)]
    return out


def prune(root: Node) -> None:
    """Cuts off what is marked as outside the article; wrappers around an article or main element stay."""
    size = measure(root)
    half = size[id(root)][0] / 2
    large, perhaps, wrappers = [], [], _wrappers(root, ("article", "main"))
    stack = [(root, False, False)]
    while stack:
        node, inside, code = stack.pop()
        inside, code = inside or node.tag in ("article", "main"), code or node.tag in ("pre", "code")
        kept = []
        for c in node.children:
            if isinstance(c, Node):
                if c.tag == "header":  # a page's header goes, an article's own stays
                    out = "" if inside or id(c) in wrappers else "out"
                elif code and c.tag in ("span", "code"):  # names there tell of the program's text
                    out = ""
                else:
                    out = marked_outside(c, size[id(c)][0] > half, inside)
                    if out and c.tag not in RAW and c.tag not in ("head", "article") and id(c) in wrappers:
                        out = ""
                if out == "out":
                    continue
                if out == "large":
                    large.append(c)
                elif out:
                    perhaps.append((c, inside))
                stack.append((c, inside, code))
            kept.append(c)
        node.children = kept
    points = points_of(root) if large or perhaps else {}
    for c in large:  # out, unless the page has no other text
        if id(c) in points and points[id(c)] < points[id(root)] - 1e-9:
            _cut([c])
            points = points_of(root)
    if perhaps:
        size, place, holds = measure(root), root, set()  # the lowest element that holds nearly all points is where the article is
        while True:
            holds.add(id(place))
            inner = [c for c in place.children if isinstance(c, Node) and points[id(c)] >= NEARLY * points[id(root)] > 0]
            if not inner:
                break
            place = inner[0]
        within = points_of(place)
        cut = []
        for c, inside in perhaps:
            if id(c) in holds or id(c) not in points:
                continue
            linked = link_density(c, size) >= DENSE and points[id(c)] < FEW_POINTS
            if linked or not inside and id(c) not in within:
                cut.append(c)
        _cut(cut)


def _cut(nodes: list[Node]) -> None:
    out = {id(n) for n in nodes}
    for parent in {id(n.parent): n.parent for n in nodes}.values():
        parent.children = [c for c in parent.children if id(c) not in out]


def points_of(root: Node) -> dict[int, float]:
    """Points of the paragraphs and loose texts in every element, each less its link density, by identity."""
    size, out, order, stack = measure(root), {}, [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(order):
        out[id(n)] = paragraph_points(n, size) * (1 - link_density(n, size)) + sum(out[id(c)] for c in n.children if isinstance(c, Node))
    return out


def measure(node: Node) -> dict[int, tuple[int, int, int]]:
    """(characters, characters in links, commas) of every element, by identity; children before parents, without recursion."""
    out: dict[int, tuple[int, int, int]] = {}
    order, stack = [], [node]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(order):
        chars = links = commas = 0
        for c in n.children:
            if isinstance(c, Node):
                x, y, z = out[id(c)]
            else:
                t = SPACE.sub(" ", c)
                x, y, z = len(t) - (t == " "), 0, t.count(",") + t.count("，") + t.count("、")
            chars, links, commas = chars + x, links + y, commas + z
        out[id(n)] = (chars, chars if n.tag == "a" else links, commas)
    return out


def _own(n: Node) -> bool:
    return n.tag in PARAGRAPHS and not any(isinstance(c, Node) and c.tag in BLOCKS for c in n.children)


def _loose(n: Node) -> bool:
    return n.tag in ("div", "section", "article", "main", "body") and sum(len(c.strip()) for c in n.children if isinstance(c, str)) >= 25


def paragraph_points(n: Node, size: dict[int, tuple[int, int, int]]) -> float:
    """Points of a paragraph, or of a container with text of its own."""
    chars, _, commas = size[id(n)]
    return 1 + commas + min(chars / 100, 3) if chars >= 25 and _own(n) or _loose(n) else 0


def score(root: Node, size: dict[int, tuple[int, int, int]]) -> Node | None:
    """Points of all containers; returns the best one."""
    best, stack = None, [root]
    touched: list[Node] = []
    while stack:
        n = stack.pop()
        own, points = _own(n), paragraph_points(n, size)
        if points:
            loose = _loose(n)
            up, level = (n if loose and not own else n.parent), 0
            while up is not None and level < 6:
                if up.score == 0:
                    touched.append(up)
                up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                up, level = up.parent, level + 1
        if not own:
            stack += [c for c in n.children if isinstance(c, Node)]
    for n in dict.fromkeys(touched):
        chars, links, _ = size[id(n)]
        n.score *= 1 - links / chars if chars else 0
        if n.tag != "#root" and (best is None or n.score > best.score):
            best = n
    return best


def link_density(node: Node, size: dict[int, tuple[int, int, int]]) -> float:
    chars, links, _ = size[id(node)]
    return links / chars if chars else 0.0


def select(root: Node, size: dict[int, tuple[int, int, int]]) -> list[Node | str | None]:
    """The parts of the tree that make up the article, in page order."""
    best = score(root, size)
    if best is None:  # no paragraph worth points: an article element, or what the page holds
        for tag in ("article", "main", "body"):
            found = _first(root, tag)
            if found is not None:
                return [found]
        return [root]
    whole = best
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            whole = up
            if up.tag == "article":
                break
        up = up.parent
    if whole.tag in ("article", "main"):
        # several articles side by side with like scores are one text
        peers = [c for c in whole.parent.children if isinstance(c, Node) and c.tag == "article" and c.score >= 0.2 * whole.score] if whole.tag == "article" and whole.parent else [whole]
        return peers if whole in peers else [whole]
    if best.parent is None or best.tag == "body":
        return [best]
    return around(root, best, size)


def around(root: Node, best: Node, size: dict[int, tuple[int, int, int]]) -> list[Node | str | None]:
    """``best`` and what surrounds it, in page order, without blocks and lines that are mostly links; None ends a block."""
    path, up = set(), best.parent
    while up is not None:
        path.add(id(up))
        up = up.parent
    wide = _with_blocks(root)
    out: list[Node | str | None] = []
    line: list[Node | str] = []

    def end_line() -> None:
        chars, links = (sum(size[id(x)][i] if isinstance(x, Node) else len(x.strip()) * (i == 0) for x in line) for i in (0, 1))
        if chars and links / chars < DENSE:
            out.extend([*line, None])
        line.clear()

    stack: list = [root]
    while stack:
        c = stack.pop()
        if c is None:
            end_line()
        elif c is best:
            end_line()
            out.extend([c, None])
        elif isinstance(c, str) or id(c) not in wide and id(c) not in path:
            line.append(c)
        elif id(c) not in path and size[id(c)][0] and link_density(c, size) < DENSE:
            end_line()
            out.extend([c, None])
        else:  # an element round the best one, or one with so many links that its parts are looked at one by one
            end_line()
            stack.append(None)
            stack += reversed(c.children)
    end_line()
    return out


def _with_blocks(root: Node) -> set[int]:
    """Identities of the blocks and of the elements that hold one."""
    out, order, stack = set(), [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(order):
        if n.tag in BLOCKS or any(isinstance(c, Node) and id(c) in out for c in n.children):
            out.add(id(n))
    return out


def _first(root: Node, tag: str) -> Node | None:
    stack = [root]
    while stack:
        n = stack.pop()
        if n.tag == tag:
            return n
        stack += [c for c in reversed(n.children) if isinstance(c, Node)]
    return None


def blocks(parts: list[Node | str | None]) -> list[str]:
    """Texts of the blocks in page order, white space in each turned into one space."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            out.append(text)

    stack: list = list(reversed(parts))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in BLOCKS:
            flush()
            stack.append(None)
            stack += reversed(x.children)
        else:
            stack += reversed(x.children)
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of a page: blocks joined by an empty line."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return "\n\n".join(blocks(select(root, measure(root))))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of ``pages``: key, url, text, n_chars."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def row(k, u, p):
        text = extract(p)
        return {"page_id": k, "url": u, "text": text, "n_chars": len(text)}

    cut = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(page).cast("string"))
    return cut.mapInArrow(arrow_rows(row, schema), "page_id long, url string, text string, n_chars long")


@register("op1_html_extract")
def op1_html_extract(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))
