"""Main text of HTML pages by tree scoring.

The page becomes a tree of elements. Every paragraph passes points for its length and its commas to its parent (in
full) and grandparent (half); a container's points are discounted by the share of its text that stands in links.
If the best container lies in an article element (or else in main), all of that is kept, and its siblings of the same kind
that score like it. Otherwise all that stands beside the container, and beside ancestors that hold half of its points, is
kept unless a quarter of its text is links. Inside what is kept, blocks that are not article text (menus, headers,
footers, sidebars, notices, adverts, forms, comments, scripts, styles) are left out. A form that holds an article, and an
element inside an article that only bears a doubtful name, stay if they have an article's amount of text besides links.

Null or empty pages give the empty text. Unclosed and misnested tags, a tag cut off at the end, unknown entities and
bare ``<`` are taken as browsers take them, roughly: they never fail. Text before any block forms a block of its own.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from riskloom.llm.common import append_columns

# Fixed values of HTML: elements without content, elements whose content is not markup, blocks, what closes what.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead title tr ul".split())
#: An opening tag of the key closes an open element of the value, unless one of SCOPE stands between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = frozenset("table ul ol dl menu article section div body html blockquote td th".split())
CLOSES_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head", "title"}
DROPPED = frozenset("nav aside footer form button select option label input fieldset dialog menu object audio video "
                    "canvas map search head".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
CONTAINERS = frozenset("article main div section td body blockquote".split())
PARAGRAPHS = frozenset("p pre li blockquote h1 h2 h3 h4 h5 h6 dd td".split())

# Words in class and id names that mark what is not article text, and what is.
_NEGATIVE = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|community|contact|cookies?|consent|"
    r"disqus|disclaimer|feedback|footer|gdpr|header|hidden|legal|masthead|menu|meta|modal|nav|navbar|navigation|newsletter|"
    r"notices?|outbrain|pager|pagination|popup|privacy|promo\w*|recommend\w*|related|replies|reply|respond|rss|share|sharing|"
    r"sidebar|signup|social|sponsor\w*|subscribe\w*|tags|taboola|teaser|toolbar|tools|warning|widgets?)(?:$|[-_\s\d])", re.I)
_NEVER_ARTICLE = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|comments?|promo\w*|related|replies|reply|respond|sponsor\w*|teaser|widgets?)(?:$|[-_\s\d])", re.I)
#: Names that parts of an article bear too. Inside one they only count where the text is short or mainly links.
_WEAK = re.compile(r"(?:^|[-_\s])(?:banner|community|contact|disclaimer|feedback|header|hidden|legal|meta|notices?|privacy|tags|tools|warning)(?:$|[-_\s\d])", re.I)
#: Characters of text from which an element of a weak name, or the paragraphs of a form, are article text.
ARTICLE_CHARS = 400
#: A class of its own that names the article outweighs others that do not (``content has-sidebar``).
_ARTICLE_NAMES = frozenset("article content entry main post story article-body article-content entry-content main-content post-body post-content".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_POSITIVE = re.compile(r"article|body|content|entry|main|page|post|story|text|blog", re.I)

#: A name, and a value in quotes or up to the next space: a quote inside an unquoted value is a letter like others.
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
    r"""((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+)(?:>|\Z)""", re.S)
_SPACE = re.compile(r"\s+")
COMMAS = re.compile(r"[,،、，]")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "weight", "points", "chars", "link_chars", "doubtful")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, weight: int = 0):
        self.tag, self.parent, self.children = tag, parent, []
        self.dropped, self.weight, self.points, self.chars, self.link_chars = dropped, weight, 0.0, 0, 0
        self.doubtful = False  # left out unless its text says that it belongs to the article


def _judge(tag: str, attributes: str) -> tuple[bool, bool, int]:
    """Whether the element is left out, whether its text decides about that, and points for its names."""
    if tag in DROPPED and tag != "form":
        return True, False, 0
    weight, doubtful = 0, tag == "form"
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), html.unescape(a or b or c)
            if name in ("class", "id"):
                value = _CAMEL.sub("-", value)
                worst = _NEVER_ARTICLE if tag in ("article", "main") else _NEGATIVE
                if tag not in ("body", "html") and worst.search(value) and not _ARTICLE_NAMES & {*value.lower().split()}:
                    if worst.search(_WEAK.sub(" ", value)) or value.lower().strip() == "hidden":
                        return True, False, 0
                    doubtful = True
                if _POSITIVE.search(value):
                    weight += 25
            elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return True, False, 0
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False, 0
    return False, doubtful, weight


def parse(page: str) -> Node:
    """The element tree of a page; strings among the children are text with its references decoded."""
    root = Node("#root", None)
    open_, at, size = [root], 0, len(page)
    counts: dict[str, int] = {}

    def close(tag: str) -> None:
        if counts.get(tag):
            while True:
                node = open_.pop()
                counts[node.tag] -= 1
                if node.tag == tag:
                    return

    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            rest = page[at:]
            open_[-1].children.append(html.unescape(rest))
            break
        if found.start() > at:
            open_[-1].children.append(html.unescape(page[at:found.start()]))
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            close(tag)
            continue
        if tag in CLOSES_P and counts.get("p"):
            # A paragraph ends where a block begins, also inside inline elements left open.
            for node in reversed(open_):
                if node.tag == "p":
                    close("p")
                    break
                if node.tag in SCOPE or node.tag == "#root":
                    break
        if tag in CLOSES:
            for node in reversed(open_):
                if node.tag in CLOSES[tag]:
                    close(node.tag)
                    break
                if node.tag in SCOPE or node.tag == "#root":
                    break
        attributes = found[3]
        dropped, doubtful, weight = _judge(tag, attributes)
        if tag == "header" and not counts.get("article") and not counts.get("main"):
            dropped = True  # the page's; an article's own header holds its title
        node = Node(tag, open_[-1], dropped, weight)
        node.doubtful = doubtful
        open_[-1].children.append(node)
        if tag in VOID or attributes.rstrip().endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        open_.append(node)
        counts[tag] = counts.get(tag, 0) + 1
    return root


def _score(root: Node) -> list[Node]:
    """Sums of text and links for every element, points for every container; returns the containers."""
    order, stack = [], [(root, False)]
    while stack:  # no recursion: pages nest deeply
        node, link = stack.pop()
        order.append(node)
        link = link or node.tag == "a"
        for child in node.children:
            if isinstance(child, str):
                n = len(_SPACE.sub(" ", child).strip())
                node.chars += n
                node.link_chars += n * link
            elif not child.dropped:
                stack.append((child, link))
    for node in reversed(order):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
    for node in order:
        if node.tag in PARAGRAPHS and node.chars >= 1 and node.parent is not None:
            own = "".join(c for c in node.children if isinstance(c, str))
            points = 1 + len(COMMAS.findall(own)) + min(node.chars / 100, 3.0)
            node.parent.points += points
            if node.parent.parent is not None:
                node.parent.parent.points += points / 2
    return [n for n in order if n.tag in CONTAINERS]


def _settle(root: Node) -> None:
    """Decide about doubtful elements, outermost first.

    A form stays if it holds an article or main element, or paragraphs with ``ARTICLE_CHARS`` of text besides links: some
    pages are one form. Of other elements those inside an article or main element stay that have so much text.
    """
    below, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        below.append((node, inside))
        inside = inside or node.tag in ("article", "main")
        stack += [(c, inside) for c in node.children if isinstance(c, Node) and not c.dropped]
    own: dict[int, tuple[int, bool]] = {}
    for node, inside in reversed(below):  # children come before their parents
        chars, holds = 0, node.tag in ("article", "main")
        if node.tag == "p":
            chars = _plain(node)
        else:
            for c in node.children:
                if isinstance(c, Node) and not c.dropped:
                    a, b = own[id(c)]
                    chars, holds = chars + a, holds or b
        own[id(node)] = (chars, holds)
        if node.doubtful:
            node.dropped = not (holds or chars >= ARTICLE_CHARS) if node.tag == "form" else not (inside and chars >= ARTICLE_CHARS)


def _plain(node: Node) -> int:
    """Characters of text besides links."""
    total, stack = 0, [node]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str):
                total += len(_SPACE.sub(" ", c).strip())
            elif not c.dropped and c.tag != "a":
                stack.append(c)
    return total


def _final(node: Node) -> float:
    bonus = node.weight + (30 if node.tag in ("article", "main") else 0)
    return (node.points + (bonus if node.points else 0)) * (1 - node.link_chars / max(node.chars, 1))


def _blocks(kept: list[Node]) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            out.append(text)

    stack: list = list(reversed(kept))
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            line.append(item)
        elif not item.dropped:
            block = item.tag in BLOCKS
            if block:
                end()
                stack.append(None)
            stack.extend(reversed(item.children))
    end()
    return out


def _named(best: Node) -> list[Node]:
    """The outermost article around the best container, or else main, and siblings of its kind that score like it."""
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    whole = next((n for tag in ("article", "main") for n in reversed(path) if n.tag == tag), None)
    if whole is None:
        return []
    least = max(10.0, 0.2 * _final(whole))
    return [n for n in whole.parent.children
            if n is whole or isinstance(n, Node) and not n.dropped and n.tag == whole.tag and _final(n) >= least]


def _around(best: Node) -> list[Node | str]:
    """The best container with all beside it that is not mainly links, in page order."""
    kept: list[Node | str] = [best]
    node = best
    while node.tag != "body" and node.parent is not None:
        parent, sides, run = node.parent, ([], []), []

        def end(side: list) -> None:
            chars = sum(len(_SPACE.sub(" ", n).strip()) if isinstance(n, str) else n.chars for n in run)
            if sum(n.link_chars for n in run if isinstance(n, Node)) < 0.25 * chars:
                side.extend(run)
            run.clear()

        side = sides[0]
        for child in parent.children:
            if isinstance(child, Node) and child.dropped:
                continue
            if isinstance(child, str) or child.tag not in BLOCKS or child.tag == "br":
                run.append(child)  # words of one line are judged together
                continue
            end(side)
            if child is node:
                side = sides[1]
            else:
                run.append(child)
                end(side)
        end(side)
        kept = [*sides[0], *kept, *sides[1]]
        if parent.points < best.points / 2:
            break
        node = parent
    return kept


def main_text(page: str | None) -> str:
    """Blocks of the article in page order, one to a line."""
    if not page:
        return ""
    root = parse(page)
    _settle(root)
    containers = _score(root)
    best = max(containers, key=_final, default=None)
    if best is None or _final(best) <= 0:
        return "\n".join(_blocks([root]))
    return "\n".join(_blocks(_named(best) or _around(best)))


def extract(df: DataFrame, page: str, out: str = "text") -> DataFrame:
    """Rows pass through whole, with ``out``: the main text."""
    def make():
        return lambda pages: [pa.array([main_text(p) for p in pages], pa.string())]

    return append_columns(df, page, StructType([StructField(out, StringType())]), make)


def page_texts(df: DataFrame, id_column: str, url: str, page: str) -> DataFrame:
    """page_id, url, text and its number of code points for every page."""
    rows = df.select(F.col(id_column).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    return extract(rows, "html").drop("html").withColumn("n_chars", F.length("text").cast("long"))
