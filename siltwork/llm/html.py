"""Main text of web pages by scoring the tree.

Paragraphs give points for their length and commas to their ancestors, the parent in full, each further one
half as much as the one before; an element's points are discounted by its link density. The best
container and those of its siblings that score well or are prose are the article. Elements that are not content by
kind, class or state never count. A class is read word by word: ``has-sidebar`` or ``ad-free`` say nothing of the element, and an
element that only its class speaks against stays where it holds the page's heading, article or most of its prose. Work grows with
the length of the page, however deep its elements are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg math".split())
SKIPPED = frozenset("head script style noscript template nav header footer aside form button select option input textarea label fieldset iframe object embed applet canvas audio video svg math menu dialog map title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Starting one of these ends an open paragraph.
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"} | {"summary"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words of classes and ids. Of elements that are not content; of those that may be, within an article, where they are text;
# of reader comments; words that undo such a word; words that may follow one; and compounds.
STRONG = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar share sharing social cookie cookies consent gdpr popup modal newsletter subscribe signup login outbrain taboola pager pagination toolbar".split())
WEAK = frozenset("foot notice overlay search related recommend recommended recommendations widget widgets tags skip copyright legal disclaimer hidden".split())
COMMENTS = frozenset("comment comments disqus replies respond".split())
UNDO = frozenset("has no not with without free less is as enabled disabled".split())
CARRIERS = frozenset("list item items link links box container wrapper wrap section area block slot bar panel inner content widget unit banner top bottom left right main primary secondary form overlay footer header row group col column holder buttons button text title thread".split())
COMPOUNDS = frozenset("site-header page-header top-bar side-bar print-only skip-link".split())
#: Elements of text: within an article only strong words speak against them, against headings none.
TEXT = frozenset("p pre blockquote li dt dd td th tr table figure figcaption span a em strong b i u code q cite small abbr mark sub sup".split())
CONTENT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|footer|foot|masthead|site-?header|page-?header|top-?bar|comments?|disqus|replies|respond|share|sharing|social|cookies?|consent|notice|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|search|related|recommend\w*|outbrain|taboola|widget|pager|pagination|tags|toolbar|skip|copyright|legal|disclaimer|print-only|hidden)(?:$|[\s_-]|\d)",
    re.I,
)
CONTENT = re.compile(r"article|body|content|entry|main|page|post|text|story|blog", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<close>>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
LOOSE = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)(?P<close>>|\Z)", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("attrs", "children", "commas", "depth", "inside", "links", "name", "parent", "points", "size", "skip", "why")

    def __init__(self, name: str, parent: Node | None, attrs: str = ""):
        self.name, self.parent, self.children, self.points, self.size, self.links, self.commas = name, parent, [], 0.0, 0, 0, 0
        self.depth = parent.depth + 1 if parent else 0
        self.inside = bool(parent and (parent.inside or parent.name in ("article", "main")))
        self.attrs = {m[0].lower(): unescape(m[1] or m[2] or m[3]) for m in ATTR.findall(attrs)} if attrs.strip() else {}
        self.why, self.skip = not_content(self), False


def boilerplate(name: str) -> str:
    """What a word of a class or id says against its element: "strong", "weak", "comments", these with "?" in compounds, or nothing."""
    words = [w for w in re.split(r"[-_\d]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if len(w) > 1]
    if not words or UNDO.intersection(words):
        return ""
    if "-".join(words) in COMPOUNDS:
        return "strong?"
    # of "main-nav" the last word counts, of "nav-list" the first
    for w in (words[-1], *(words[:1] if words[-1] in CARRIERS else ())):
        for kind, known in (("comments", COMMENTS), ("strong", STRONG), ("weak", WEAK)):
            if w in known:
                return kind + ("?" if len(words) > 1 and kind != "comments" else "")
    return ""


def not_content(node: Node) -> str:
    """Why an element is not content: "kind" (for good), "form", or what :func:`boilerplate` says."""
    if node.name in SKIPPED:
        # an article may have a header of its own, with the heading
        return "" if node.name == "header" and node.inside else "form" if node.name == "form" else "kind"
    if not node.attrs or node.name in ("html", "body", "article", "main") and "hidden" not in node.attrs:
        return ""
    a = node.attrs
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return "kind"
    if node.name in HEADINGS:
        return ""
    said = {boilerplate(x) for x in f"{a.get('class', '')} {a.get('id', '')}".split()} - {""}
    if node.inside and node.name in TEXT:
        said -= {"weak", "weak?"}
    return next((x for x in ("comments", "strong", "weak", "strong?", "weak?") if x in said), "")


def decide(root: Node) -> None:
    """Set ``skip`` top down, once it is known what elements hold."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.children if isinstance(c, Node)]
    prose, marks = {}, {}
    for x in reversed(order):
        n, seen = 0, {x.name} if x.name in ("h1", "article", "main") else set()
        for c in x.children:
            if isinstance(c, Node):
                if c.why != "kind" and c.name != "a":
                    n += prose[id(c)]
                    seen |= marks[id(c)]
            else:
                n += len(c.strip())
        prose[id(x)], marks[id(x)] = n, seen
    for x in order:
        if x.parent and x.parent.skip:
            x.skip = True
        elif x.why in ("", "kind"):
            x.skip = bool(x.why)
        else:
            holds = marks[id(x)] - ({"article"} if x.why == "comments" else set())
            share = prose[id(x)] / max(prose[id(root)], 1)
            most = x.why in ("form", "strong?", "weak", "weak?") and share > 0.6
            x.skip = not (holds and not x.inside and share > 0.4 or most)


def ancestors(node: Node) -> Iterator[Node]:
    while node.parent:
        node = node.parent
        yield node


def parse(html: str) -> Node:
    """A tree of nodes and strings; tolerant of tags that are not closed or cut off."""
    root = here = Node("#root", None)
    opened: Counter[str] = Counter()

    def up_to(node: Node) -> Node:
        x = here
        while x is not node:
            opened[x.name] -= 1
            x = x.parent
        return node

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            here.children.append(html[at:])
            break
        m = TAG.match(html, lt)
        if m and m["name"] and not m["close"]:
            m = LOOSE.match(html, lt)  # a quote that is never closed
        if not m:
            here.children.append(html[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            here.children.append(html[at:lt])
        at = m.end()
        if not m["name"]:
            continue
        if not m["close"]:
            break  # cut off within a tag
        name = m["name"].lower()
        if m["end"]:
            node = here if opened[name] else None
            while node and node.parent and node.name != name:
                if node.name in ("td", "th", "table", "article", "section", "main", "body") and name not in BLOCKS:
                    node = None  # an inline end tag doesn't leave its block
                    break
                node = node.parent
            if node is not None and node.parent:
                here = up_to(node.parent)
            elif name == "p":
                here.children.append(Node("p", here))
            continue
        if name in ENDS_P and opened["p"]:
            node = here
            while node and node.name not in ("#root", "body", "div", "article", "section", "td", "th", "li", "table", "button"):
                if node.name == "p":
                    here = up_to(node.parent)
                    break
                node = node.parent
        if name in CLOSES and any(opened[x] for x in CLOSES[name]):
            node = here
            while node and node.parent and node.name not in SCOPES[name]:
                if node.name in CLOSES[name]:
                    here = up_to(node.parent)
                    break
                node = node.parent
        node = Node(name, here, m["attrs"])
        here.children.append(node)
        if name in VOID or m["attrs"].endswith("/") and name in ("path", "use"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            continue
        here = node
        opened[name] += 1
    return root


def measure(node: Node) -> None:
    """Sizes of text and of link text, commas, and points of paragraphs, all bottom up. No recursion."""
    order, stack = [], [node]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.children if isinstance(c, Node) and not c.skip]
    passed: dict[int, float] = {}
    for x in reversed(order):
        own = own_commas = 0
        for c in x.children:
            if isinstance(c, str):
                own += len(c.strip())
                own_commas += c.count(",")
            elif not c.skip:
                x.size += c.size
                x.links += c.links
                x.commas += c.commas
                x.points += passed.pop(id(c), 0.0)
        x.size += own
        x.commas += own_commas
        if x.name == "a":
            x.links = x.size
        passed[id(x)] = x.points / 2
        if x.size >= 25 and (x.name in PARAGRAPHS or own >= 25 and x.name in ("div", "section", "article", "main", "body", "b", "span", "font", "center")):
            points = 1 + (x.commas if x.name in PARAGRAPHS else own_commas) + min(x.size // 100, 3)
            passed[id(x)] += points
            if x.name not in PARAGRAPHS:  # a container that has the words itself keeps the points
                x.points += points
                passed[id(x)] -= points / 2


def density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def score(node: Node) -> float:
    bonus = {"article": 25.0, "main": 20.0, "div": 5.0, "section": 5.0, "blockquote": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "h1": -5.0}.get(node.name, 0.0)
    names = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    if CONTENT.search(names):
        bonus += 25.0
    return (node.points + (bonus if node.points > 0 else 0.0)) * (1 - density(node))


def containers(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.name not in ("#root", "html", "head") and not x.skip:
            out.append(x)
        stack += [c for c in reversed(x.children) if isinstance(c, Node)]
    return [x for x in out if x.name in BLOCKS and x.name not in PARAGRAPHS - {"td", "blockquote"}]


def chosen(root: Node) -> list[Node]:
    """The best container and its siblings that belong to it, in page order."""
    decide(root)
    measure(root)
    found = containers(root)
    scored = [x for x in found if x.points > 0]
    if not scored:
        named = [x for x in found if x.name in ("article", "main")]
        return named[:1] or [x for x in found if x.name == "body"][:1] or [root]
    best = max(scored, key=lambda x: (score(x), -x.depth))
    # an article within or around the best is the whole of it
    around = next((a for a in [best, *ancestors(best)] if a.name in ("article", "main") and not a.skip), None)
    best = around or best
    if best.parent is None or best.name in ("body", "article", "main"):
        return [best]
    least, out = max(10.0, 0.2 * score(best)), []
    for c in best.parent.children:
        if not isinstance(c, Node) or c.skip:
            continue
        same = bool(c.attrs.get("class")) and c.attrs.get("class") == best.attrs.get("class")
        prose = c.name == "p" and (c.size > 80 and density(c) < 0.25 or 0 < c.size <= 80 and c.links == 0 and _ends(c)) or c.name in HEADINGS and c.links == 0
        if c is best or c.points > 0 and score(c) + (0.2 * score(best) if same else 0) >= least or prose:
            out.append(c)
    return out


def _ends(node: Node) -> bool:
    return bool(re.search(r"[.!?…]\s*$", "".join(strings(node))))


def strings(node: Node) -> Iterator[str]:
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        elif not x.skip:
            stack += reversed(x.children)


def blocks_of(nodes: list[Node]) -> list[str]:
    """Texts of the blocks, decoded, white space as one space; empty ones are left out."""
    out, run = [], []

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    stack: list = [x for node in reversed(nodes) for x in (None, node, None)]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(unescape(x))  # a reference ends with its text
        elif not x.skip and x.name not in RAW:
            if x.name == "br":
                run.append(" ")
            inner = list(reversed(x.children))
            stack += [None, *inner, None] if x.name in BLOCKS else inner
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article's blocks joined by a line feed. Null, empty and blank pages: the empty string."""
    if not html or not html.strip():
        return ""
    return "\n".join(blocks_of(chosen(parse(html))))


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page instead of its ``html``; no shuffle.

    Other columns stay; a column named like ``text`` is replaced. Null, empty and blank pages have the empty text. Repeated rows
    are treated alike; an empty table returns no rows.
    """
    kept = [c for c in pages.columns if c not in (html, text)]
    schema = pages.select(*kept, F.lit("").cast("string").alias(text)).schema

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(texts, pa.string())], names=[*kept, text])

    return pages.select(*kept, F.col(html).cast("string").alias("__html")).mapInArrow(run, schema)
