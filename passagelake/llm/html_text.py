"""Main text of web pages, with a site's templates removed.

Pages are parsed in the tasks. Every element subtree that is more than running text
is hashed (its tags and its text); Spark counts on how many different pages of a host
each hash stands, copies of a page once. A subtree that stands on at least MIN_PAGES
pages and MIN_SHARE of the host's pages, or on MANY_PAGES of any host, belongs to the
site's template and is deleted, unless it holds the page's main text. What is left is
extracted: the article (else the main part, else the body) without menus, forms,
notices and the like, which are known by their tags, roles and names.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, functions as F

from passagelake.llm.common import map_rows
from passagelake.session import reliable

MIN_PAGES = 5
MIN_SHARE = 0.2
#: Enough pages for a template whatever the host's size.
MANY_PAGES = 100

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option "
    "p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 pre blockquote body html article main".split())
DROPPED = set(
    "nav header footer aside form script style noscript template iframe button select textarea input svg canvas "
    "object embed audio video dialog menu title head search xmp noembed noframes fieldset".split()
)
DROPPED_ROLES = set(
    "navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split()
)
DROPPED_NAMES = set(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos "
    "promotion banner banners cookie cookies consent gdpr notice notices notification notifications newsletter "
    "subscribe subscription signup sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer "
    "header masthead comment comments commentlist disqus replies respond discussion related recommended share "
    "sharing social popup modal overlay pagination pager widget widgets copyright disclaimer login toolbar".split()
)
# What a name may hold beside these: words for a box or its place, which say nothing about the text in it.
BOX_NAMES = set(
    "area bar block bottom box button buttons col column container content group holder inner item items left link "
    "links list main outer page panel post region right row section site slot small large top unit wrap wrapper "
    "article entry primary secondary global".split()
)
# Names of these stand for parts of an article as well: inside one, they only count for boxes full of links.
WEAK_NAMES = set(
    "discussion related recommended share sharing social respond promotion menu menus login".split()
)
LINK_SHARE = 0.5
# An open element of the key is closed by a start tag among the values.
CLOSED_BY = {
    "p": BLOCKS - {"body", "html", "head", "option", "optgroup"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"},
    "tbody": {"tbody", "tfoot"},
}
# These keep an implied end from closing elements outside them.
SCOPES = {
    "li": {"ul", "ol", "menu", "dir"},
    "dt": {"dl"},
    "dd": {"dl"},
    "option": {"select"},
    "tr": {"table"},
    "td": {"table"},
    "th": {"table"},
    "thead": {"table"},
    "tbody": {"table"},
    "p": {"button", "table", "object", "td", "th", "caption"},
}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NEEDED = ("class", "id", "role", "hidden", "aria-hidden", "style")


class Element:
    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict, parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element | str] = []


def _attributes(source: str) -> dict[str, str]:
    found = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        if (name := name.lower()) in _NEEDED:
            found.setdefault(name, html.unescape(double or single or bare))
    return found


class _Open:
    """The open elements from the root on, and for each tag their places among them."""

    def __init__(self, root: Element):
        self.path = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Element) -> None:
        self.places.setdefault(node.tag, []).append(len(self.path))
        self.path.append(node)

    def last(self, tags) -> int:
        """The place of the innermost open element with one of the tags, 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.path) > place:
            self.places[self.path.pop().tag].pop()

    def end_implied(self, tag: str) -> None:
        """Close what a start tag of this name closes, unless a scope in between keeps it."""
        closers, keepers = _IMPLIED.get(tag, ((), ()))
        while (place := self.last(closers)) and place >= self.last(keepers):
            self.close(place)


# For each start tag the open elements it closes, and those that keep it from doing so.
_IMPLIED = {
    tag: (
        [t for t, ends in CLOSED_BY.items() if tag in ends],
        SCOPES["p"].union(*(scope for t, scope in SCOPES.items() if t != "p" and tag in CLOSED_BY[t])),
    )
    for tag in set().union(*CLOSED_BY.values())
}


def parse(source: str | None) -> Element:
    """A tree of the whole page. Anything is accepted: unclosed and stray tags, cut-off pages.

    The time grows with the page's length, however deep its elements are nested.
    """
    root = Element("html", {}, None)
    opened = _Open(root)
    source = source or ""
    place = 0
    while True:
        token = _TOKEN.search(source, place)
        at = opened.path[-1]
        if token is None:
            if place < len(source):
                at.children.append(source[place:])
            return root
        if token.start() > place:
            at.children.append(source[place : token.start()])
        place = token.end()
        tag = token["tag"] or token["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if token["end"] or token["end2"]:
            if found := opened.last((tag,)):
                opened.close(found)
            continue
        if tag == "html" or tag == "body" and opened.last((tag,)):
            continue
        opened.end_implied(tag)
        at = opened.path[-1]
        attributes = token["attributes"] or token["attributes2"] or ""
        node = Element(tag, _attributes(attributes), at)
        at.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, place)
            place = end.end() if end else len(source)
        elif tag not in VOID and (tag in BLOCKS or not attributes.endswith("/")):
            opened.push(node)


def _ancestors(node: Element | None):
    while node is not None:
        yield node
        node = node.parent


def _below(node: Element):
    """The element and all elements below it, in page order, without recursion."""
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Element))


def _hidden(node: Element) -> bool:
    style = node.attributes.get("style", "").replace(" ", "").lower()
    return (
        "hidden" in node.attributes
        or node.attributes.get("aria-hidden", "").lower() == "true"
        or "display:none" in style
    )


def _boilerplate_names(node: Element) -> set[str]:
    """The words for boilerplate in the element's class and id.

    A name counts if its other words only say that it is a box: ``ad-box`` does, ``ad-free`` does not.
    """
    found = set()
    for name in f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".split():
        words = set(re.findall("[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()))
        if words <= DROPPED_NAMES | BOX_NAMES:
            found |= words & DROPPED_NAMES
    return found


class Page:
    """A parsed page, with what its elements' names are judged by."""

    def __init__(self, source: str | None):
        self.root = parse(source)
        #: Elements around an article or main part, and inside one.
        self.around: set[int] = set()
        self.inside: set[int] = set()
        for node in _below(self.root):
            if node.parent is not None and (id(node.parent) in self.inside or node.parent.tag in ("article", "main")):
                self.inside.add(id(node))
            if node.tag in ("article", "main"):
                for outer in _ancestors(node.parent):
                    if id(outer) in self.around:
                        break
                    self.around.add(id(outer))
        self._links: dict[int, tuple[int, int]] = {}

    def link_share(self, node: Element) -> float:
        """The share of the element's text that stands in links."""
        if not self._links:
            for one in reversed(list(_below(self.root))):
                chars = sum(len(c.strip()) for c in one.children if isinstance(c, str))
                held = [self._links[id(c)] for c in one.children if isinstance(c, Element)]
                chars += sum(h[0] for h in held)
                self._links[id(one)] = chars, chars if one.tag == "a" else sum(h[1] for h in held)
        chars, links = self._links[id(node)]
        return links / chars if chars else 1.0

    def boilerplate(self, node: Element) -> bool:
        """Whether the element's tag, role or names say that it is not part of the article.

        Names do not count for an element that holds the article or the main part. Inside one,
        the weak names only count for boxes whose text is mostly links.
        """
        if node.tag in DROPPED or _hidden(node):
            return True
        if not node.attributes or node.tag in ("html", "body", "main") or id(node) in self.around:
            return False
        if node.attributes.get("role", "").lower() in DROPPED_ROLES:
            return True
        names = _boilerplate_names(node)
        if not names or id(node) not in self.inside or names - WEAK_NAMES:
            return bool(names)
        return self.link_share(node) >= LINK_SHARE


def subtree_hashes(root: Element) -> dict[int, int]:
    """Hash of each element that may be a template part, by ``id(element)``.

    The hash covers tags and text below; running text (paragraphs, headings, inline
    elements) and elements without text are no candidates.
    """
    import xxhash

    canonical: dict[int, str] = {}
    for node in reversed(list(_below(root))):
        if node.tag in RAW:
            canonical[id(node)] = ""
            continue
        parts = [
            canonical[id(c)] if isinstance(c, Element) else " ".join(html.unescape(c).split())
            for c in node.children
        ]
        inside = "".join(parts)
        # Long subtrees are carried as hashes, so deep pages cost no more than flat ones.
        if len(inside) > 256:
            inside = f"#{xxhash.xxh64_hexdigest(inside)}"
        canonical[id(node)] = f"<{node.tag}>{inside}</>" if inside else ""
    found = {}
    for node in _below(root):
        text = canonical[id(node)]
        if text and node.tag in BLOCKS and node.tag not in TEXTUAL:
            value = xxhash.xxh64_intdigest(text, 42)
            found[id(node)] = value - (1 << 64) if value >> 63 else value
    return found


def main_parts(page: Page, removed: set[int]) -> list[Element]:
    """Where the main text stands: the articles, else the main part, else the whole page."""

    def outermost(wanted) -> list[Element]:
        found, stack = [], [page.root]
        while stack:
            node = stack.pop()
            if id(node) in removed or page.boilerplate(node):
                continue
            if wanted(node):
                found.append(node)
            else:
                stack.extend(c for c in reversed(node.children) if isinstance(c, Element))
        return found

    for wanted in (
        lambda n: n.tag == "article" or n.attributes.get("role") == "article" or n.attributes.get("itemprop") == "articleBody",
        lambda n: n.tag == "main" or n.attributes.get("role") == "main",
    ):
        if parts := outermost(wanted):
            return parts
    return [page.root]


def text_blocks(page: Page, part: Element, removed: set[int]) -> list[str]:
    """Text of each block in page order; white space inside a block is one space."""
    blocks, held = [], []

    def end():
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            blocks.append(text)
        held.clear()

    stack: list[Element | str | None] = [part]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            held.append(item)
        elif id(item) not in removed and (item is part or not page.boilerplate(item)):
            if item.tag in BLOCKS:
                end()
                stack.append(None)
            elif item.tag == "br":
                held.append("\n")
            stack.extend(reversed(item.children))
    end()
    return blocks


def main_text(source: str | None, templates: set[int] = frozenset()) -> str:
    """The main text of a page, given the hashes of its site's template subtrees.

    A subtree that holds the article or main part is not deleted. If nothing would be
    left of the text, the deleted subtree with the most text is the page's main text.
    """
    page = Page(source)
    removed: set[int] = set()
    if templates:
        hashes = subtree_hashes(page.root)
        removed = {node for node, value in hashes.items() if value in templates}
    if removed:
        for part in main_parts(page, set()):
            removed.difference_update(id(node) for node in _ancestors(part))
    blocks = [b for part in main_parts(page, removed) for b in text_blocks(page, part, removed)]
    if removed and not blocks:
        deleted = [n for part in main_parts(page, set()) for n in _outermost(page, part, removed)]
        longest = max((text_blocks(page, n, set()) for n in deleted), key=lambda found: sum(map(len, found)), default=[])
        return " ".join(longest)
    return " ".join(blocks)


def _outermost(page: Page, part: Element, wanted: set[int]) -> list[Element]:
    """The wanted elements of a part that are in no other one, nor in boilerplate."""
    found, stack = [], [part]
    while stack:
        node = stack.pop()
        if id(node) in wanted:
            found.append(node)
        else:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Element) and not page.boilerplate(c))
    return [n for n in found if not page.boilerplate(n)]


def host_of(url):
    """Lower-case host of a URL, '' for none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_subtrees(pages: DataFrame) -> DataFrame:
    """Rows (host, page_key, content, hashes): the different candidate subtrees of each page."""

    def run(slices):
        for rows in slices:
            out: dict[str, list] = {"host": [], "page_key": [], "content": [], "hashes": []}
            for host, key, content, source in zip(rows["host"], rows["page_key"], rows["content"], rows["html"]):
                out["host"].append(host)
                out["page_key"].append(key)
                out["content"].append(content)
                out["hashes"].append(list(set(subtree_hashes(parse(source)).values())))
            yield out

    return map_rows(
        pages.select("host", "page_key", "content", "html"),
        run,
        "host string, page_key bigint, content bigint, hashes array<bigint>",
    )


def site_templates(
    subtrees: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES
) -> DataFrame:
    """Rows (host, hash) of the subtrees that recur across a host's different pages."""
    # Each task keeps one of its copies of a page, so a page with many copies fills no task.
    different = subtrees.groupBy("host", "content").agg(F.first("hashes").alias("hashes"))
    different = reliable(different)
    host_pages = different.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    each = different.select("host", F.explode("hashes").alias("hash"))
    counted = each.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    enough = F.least(F.col("pages") * min_share, F.lit(float(many_pages)))
    return counted.join(host_pages, "host").where(F.col("n") >= enough).select("host", "hash")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_templates (template subtrees on the page).

    Null or empty html gives an empty text. Pages whose url names no host share the
    host ''. Copies of a page count once towards templates, and every row is returned. Long
    and deep pages take time by their length. An empty table gives no rows; other columns
    are not looked at.
    """
    keyed = pages.select(
        "page_id",
        "url",
        "html",
        host_of(F.col("url")).alias("host"),
        F.xxhash64("page_id", "url", "html").alias("page_key"),
        F.xxhash64("html").alias("content"),
    )
    # Stored, so that counting and looking up parse the pages once.
    subtrees = reliable(page_subtrees(keyed))
    templates = site_templates(subtrees, min_pages, min_share)
    # One subtree can stand on a third of all pages: adaptive execution splits that join.
    hits = (
        subtrees.select("host", "page_key", F.explode("hashes").alias("hash"))
        .join(templates, ["host", "hash"])
        .groupBy("page_key")
        .agg(F.collect_set("hash").alias("templates"))
    )
    joined = keyed.select("page_id", "url", "html", "page_key").join(hits, "page_key", "left")

    def run(slices):
        for rows in slices:
            texts = [main_text(h, set(t or ())) for h, t in zip(rows["html"], rows["templates"])]
            yield {
                "page_id": rows["page_id"],
                "url": rows["url"],
                "text": texts,
                "n_chars": [len(t) for t in texts],
                "n_templates": [len(t or ()) for t in rows["templates"]],
            }

    return map_rows(
        joined.select("page_id", "url", "html", "templates"),
        run,
        "page_id bigint, url string, text string, n_chars bigint, n_templates bigint",
    )
