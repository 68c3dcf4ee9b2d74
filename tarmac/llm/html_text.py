"""Main text of web pages by scoring the element tree.

Every paragraph passes points to its ancestors, one for being there, one for each comma and
one for each 100 characters (three at most), whole to its parent, half to the next container
and less beyond; a container's points are discounted by its link density (the share of its
text inside links).  The container with the most points is kept, or the ``article`` or ``main``
around it, else with those siblings that score at least a fifth of it or are plain paragraphs
of little link density, and what stands between them and isn't links.  Menus, page headers and
footers, sidebars, notices, adverts, forms, comments and invisible elements are taken out of the
tree before scoring.  Names of comments, adverts, notices and sign-up boxes in a class or id take
an element out whatever stands beside them.  Other unlikely names (sidebar, related, legal) take
nothing out that has a likely word of its own beside it or holds most of the page's paragraph
text.  Names that only describe an element (no-comments, has-sidebar, comments-open) count for
nothing.  Several articles beside each other are all kept, unless they are mostly links.

Defined results: null, empty or text-free html gives an empty text; unclosed and wrongly
closed elements are closed where the containing block ends; rows are independent, so repeated
rows repeat their result; a null page_id or url stays null; extra columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.inputs import arrow_schema, slices, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template".split())
#: Elements whose content is never main text.
DROPPED = frozenset(
    "script style noscript template iframe object embed canvas svg math video audio head title nav "
    "footer aside form button select option textarea input label fieldset menu dialog map noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
#: Words of class, id and role that mark what is not the article.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|"
    r"footer|foot|masthead|topbar|header|sidebar\w*|side|aside|widget\w*|comments?|comment-?list|respond|"
    r"discuss\w*|disqus\w*|replies|reply|cookie\w*|consent|gdpr|notice\w*|newsletter|subscribe|signup|login|"
    r"popup|modal|overlay|share|sharing|social|related|recommend\w*|pagination|pager|toolbar|skip|"
    r"search\w*|copyright|legal|disclaimer|alert|hidden)(?:$|[\s_-])", re.I)
#: Of these, what no likely word saves; on article and main, only what names reader comments.
NEVER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|comments?|comment-?list|respond|discuss\w*|disqus\w*|"
    r"replies|reply|cookie\w*|consent|gdpr|notice\w*|newsletter|subscribe|signup|login|popup|modal|overlay|hidden)(?:$|[\s_-])", re.I)
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies)(?:$|[\s_-])", re.I)
#: Names that say what an element has, not what it is.
DESCRIBES = re.compile(r"^(?:no|not|non|has|have|with|without|hide|show|allow|enable|disable)[-_]|[-_](?:open|opened|closed|enabled|disabled|on|off|free)$", re.I)
#: The head of an article is part of it.
OWN_HEADER = re.compile(r"(?:article|entry|post|story)[-_]*header", re.I)
LIKELY = re.compile(r"article|main|content|post|entry|story|body|text", re.I)
UNLIKELY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
#: What an open element of the key's kind is closed by, besides its own end.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
                   "h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]),
}


class Node:
    __slots__ = ("tag", "parent", "children", "gone", "hint", "score", "size", "linked", "own", "named")

    def __init__(self, tag, parent, gone=False, hint=0.0):
        self.tag, self.parent, self.children = tag, parent, []
        self.gone, self.hint, self.score, self.size, self.linked = gone, hint, 0.0, 0, 0
        self.own, self.named = gone, False  # gone by itself for what it is; for its class or id


def _element(tag: str, attrs: str, parent: Node) -> Node:
    gone, hint, named = tag in DROPPED, 0.0, False
    if tag == "header":  # of the page, unless it stands in an article
        up = parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        gone = up is None
    if attrs and not attrs.isspace():
        marks = []
        for name, value in ATTR.findall(attrs):
            name = name.lower()
            if name in ("class", "id"):
                marks.append(value.strip("\"'"))
            elif name == "role":
                gone |= value.strip("\"'").lower() in UNLIKELY_ROLES
            elif name == "hidden" or (name == "aria-hidden" and "true" in value.lower()):
                gone = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                gone = True
        mark = " ".join(marks)
        each = [x for x in OWN_HEADER.sub(" ", mark).split() if not DESCRIBES.search(x)]
        if tag in ("article", "main"):
            gone |= any(map(COMMENT.search, each))
        elif mark and tag not in ("html", "body"):
            if any(map(NEVER.search, each)):
                gone = True
            # A likely word of its own beside it saves an element.
            elif any(map(UNLIKELY.search, each)):
                named = not any(LIKELY.search(x) and not UNLIKELY.search(x) for x in each)
            elif LIKELY.search(mark):
                hint = 5.0
    if tag in ("article", "main"):
        hint += 10.0
    node = Node(tag, parent, gone, hint)
    node.named, node.gone = named, gone or named
    return node


def parse(source: str) -> Node:
    """The element tree; text is kept as strings, references decoded."""
    root = here = Node("#root", None)
    raw = None
    at, n = 0, len(source)
    while at < n:
        if raw is not None:  # nothing but its own end closes a raw element
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            stop = end.start() if end else n
            if stop > at and not here.gone:
                here.children.append(html.unescape(source[at:stop]))
            at = end.end() if end else n
            here, raw = here.parent, None
            continue
        m = TOKEN.match(source, at)
        at = m.end()
        text = m["text"] if m["text"] is not None else m["cdata"]
        if text is not None:
            here.children.append(html.unescape(text) if "&" in text else text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            up = here
            while up is not root and up.tag != tag:
                if up.tag in ("td", "th", "table", "article", "body") and tag in ("p", "li", "b", "i", "a", "span", "em", "strong"):
                    up = root  # the end of something outside this block: ignored
                    break
                up = up.parent
            if up is not root:
                here = up.parent
            continue
        # Blocks close what they cannot stand in, through open inline elements.
        closes = here
        while closes.tag in INLINE and closes.parent is not None:
            closes = closes.parent
        if tag in CLOSED_BY.get(closes.tag, ()):
            here = closes.parent
        node = _element(tag, m["attrs"], here)
        node.gone |= here.gone
        here.children.append(node)
        if tag in VOID or m["attrs"].endswith("/") and tag not in RAW and tag not in PARAGRAPHS and tag not in INLINE and tag != "div":
            continue
        here = node
        raw = tag if tag in RAW else None
    return root


def _spare(root: Node) -> None:
    """Take back what is gone by class or id alone but holds most of the page's paragraph text."""
    order, todo, named = [], [(root, False)], False
    while todo:
        node, inside = todo.pop()
        if node.own:
            continue
        inside |= node.tag in PARAGRAPHS
        named |= node.named
        order.append((node, inside))
        todo.extend((c, inside) for c in node.children if isinstance(c, Node))
    if not named:
        return
    held: dict[int, int] = {}
    for node, inside in reversed(order):
        held[id(node)] = sum(held.get(id(c), 0) if isinstance(c, Node) else inside * len(c.strip()) for c in node.children)
    for node, _ in order:  # parents first
        if node.named and 2 * held[id(node)] > held[id(root)]:
            node.named = False
        node.gone = node.named or (node.parent is not None and node.parent.gone)


def _measure(root: Node) -> list[Node]:
    """Sizes of texts and links of all kept elements; parents come before children."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.gone:
            continue
        order.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, Node):
                if not c.gone:
                    node.size += c.size
                    node.linked += c.size if c.tag == "a" else c.linked
            else:
                node.size += len(c) - c.count(" ") if not c.isspace() else 0
    return order


def _own_text(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            if not x.gone:
                todo.extend(reversed(x.children))
        else:
            out.append(x)
    return " ".join("".join(out).split())


def _holds_blocks(node: Node) -> bool:
    todo = [c for c in node.children if isinstance(c, Node)]
    while todo:
        x = todo.pop()
        if not x.gone and x.tag not in INLINE and x.tag != "br":
            return True
        todo.extend(c for c in x.children if isinstance(c, Node))
    return False


def best_container(root: Node) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    order = _measure(root)
    scored: dict[int, Node] = {}
    for node in order:
        if node.tag not in PARAGRAPHS and (node.tag not in ("div", "section", "article", "main", "body") or _holds_blocks(node)):
            continue
        text = _own_text(node)
        if not text:
            continue
        points = 1.0 + text.count(",") + min(3.0, len(text) / 100.0)
        up, share = node.parent, 1.0
        if node.tag not in PARAGRAPHS:
            up = node
        for level in range(4):
            if up is None:
                break
            if id(up) not in scored:
                scored[id(up)] = up
                up.score = up.hint
            up.score += points * share
            up, share = up.parent, (0.5 if level == 0 else share * 0.66)
    if not scored:
        return [root]
    density = lambda x: x.linked / x.size if x.size else 0.0
    best = max(scored.values(), key=lambda x: x.score * (1 - density(x)))
    floor = max(10.0, best.score * (1 - density(best)) * 0.2)
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    # A part of an article stands for the whole: what is not the article is out of the tree.
    up = best
    while up is not None:
        if up.tag == "article":
            # The others of its kind beside it, unless they are lists of links.
            return [c for c in up.parent.children if c is up or isinstance(c, Node) and c.tag == "article"
                    and not c.gone and c.size and density(c) < 0.25]
        if up.tag == "main":
            return [up]
        up = up.parent
    kept, children = [], best.parent.children
    for c in children:
        if c is best:
            kept.append(c)
        elif isinstance(c, Node) and not c.gone:
            if c.score * (1 - density(c)) >= floor:
                kept.append(c)
            elif c.tag == "p" and c.size and (density(c) < 0.25 if c.size > 80 else density(c) == 0):
                kept.append(c)
            elif c.tag in ("h1", "header") and c.size and density(c) < 0.25:
                kept.append(c)
    # What stands between kept siblings is of the same article, unless it is links.
    mine = {id(c) for c in kept}
    at = [i for i, c in enumerate(children) if id(c) in mine]
    return [c for c in children[at[0]:at[-1] + 1]
            if id(c) in mine or not isinstance(c, Node) or (not c.gone and c.size and density(c) < 0.25)]


def blocks_of(nodes: list[Node]) -> list[str]:
    """The texts of the blocks under some elements, in page order, white space made one space."""
    out: list[str] = []
    buffer: list[str] = []

    def flush():
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            out.append(text)

    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif not isinstance(x, Node):
            buffer.append(x)
        elif not x.gone:
            if x.tag == "br":
                buffer.append(" ")
            elif x.tag in INLINE:
                todo.extend(reversed(x.children))
            else:
                flush()
                todo.append(None)
                todo.extend(reversed(x.children))
    flush()
    return out


def main_text(source: str | None) -> str:
    if not source:
        return ""
    root = parse(source)
    _spare(root)
    return " ".join(blocks_of(best_container(root)))


EXTRACTED = "page_id long, url string, text string"


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """page_id, url and main text of each page."""
    schema = arrow_schema(EXTRACTED)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html", 4 << 20):
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()),
                     pa.array(texts, pa.string())], schema=schema)

    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                          F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, EXTRACTED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
