"""Main text of web pages by composite text density.

Every node of the page tree gets characters ``C``, tags ``T``, link characters ``LC`` and link tags ``LT`` of its subtree, and
from them the composite text density, which lowers characters per tag where much of the text is in links:

    C / T * log(C * T / (LC * LT)) / log(ln(C * LC / (C - LC) + C * LCbody / Cbody + e))

A node's density sum adds the densities of its children. The node of largest sum is the core; the least density on the
path from body to it is the threshold. The content is the core's nearest article or main element if it lies in one,
else the core. Up the path (with an article: up to its main element, or its parent) siblings are added that are no menus and
reach the threshold, or hold a good share of text outside links, or are headings above the content.
Elements that are no running text by their kind (menus, buttons, scripts ...) and hidden ones are no part of the tree; blocks of
links alone are no part of the content.

A form, a header, and an element whose role, class or id names furniture (adverts, notices, comments ...) is only marked, as
such words also name wrappers of whole pages. The largest marked element is a wrapper if hardly any text lies outside of all
marked ones, or if it holds the only article or main element and most of the text; then what it holds is looked at in the same way.
The core is sought outside of the other marked elements if there is text outside. In the content a form and an element named as
advert, notice or reader comments is left out; of the other marked ones, those with half of their text in links or a density below the
threshold, but for the header of the content.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Names of the HTML standard, and words that name page furniture in classes and ids.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset(
    "head nav footer aside button select input label option datalist dialog menu search canvas svg object embed audio video "
    "map math applet".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar side aside rail widget widgets header masthead topbar footer foot bottombar cookie cookies consent gdpr "
    "notice notices alert comment comments commentlist disqus reply replies respond discussion share sharing social follow "
    "subscribe subscription newsletter signup login popup modal overlay related recommended recommendations toolbar pagination pager "
    "skip skiplink hidden".split())
#: Of these, names that are hardly ever those of a wrapper or of a part of the article.
ALIEN = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo cookie cookies consent gdpr notice notices comment "
    "comments commentlist disqus reply replies respond subscribe subscription newsletter signup login popup".split())
HEADINGS = frozenset("h1 h2 h3 hgroup header".split())
# Tags that end an open element of the same group: paragraphs by any block, list items and cells by their like.
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPES = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_NAME = re.compile(r"[A-Za-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "block", "chars", "tags", "link_chars", "link_tags", "density", "sum", "in_link", "texts", "marked")

    def __init__(self, tag: str, parent, marked: int = 0):
        self.tag, self.parent, self.children, self.texts = tag, parent, [], []
        self.marked = marked
        self.in_link = tag == "a" or parent is not None and parent.in_link
        self.chars = self.link_chars = self.link_tags = 0
        self.tags, self.density, self.sum = 1, 0.0, 0.0


def _furniture(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether the element is no part of the tree, and whether it is marked (2: as a form or by an alien name)."""
    own = {"form": 2, "header": 1}.get(tag, 0)
    if tag in SKIPPED:
        return True, 0
    if not attributes.strip():
        return False, own
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True, 0
    if tag in ("html", "body", "article", "main"):
        return False, 0
    names = {w.lower() for key in ("class", "id") for w in _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", found.get(key, "")))}
    return False, max(own, 2 if names & ALIEN else 1 if names & FURNITURE or found.get("role", "").lower() in ROLES else 0)


def parse(page: str) -> tuple[Node, list[tuple[Node, int, str]]]:
    """The tree without skipped elements, and its runs of text as (node, number of the block, text)."""
    root = node = Node("body", None)
    runs: list[tuple[Node, int, str]] = []
    block, at, skipped = 0, 0, []  # skipped: open elements inside a skipped one
    find = _TOKEN.search
    while True:
        m = find(page, at)
        text = page[at:m.start() if m else len(page)]
        if text and not skipped:
            runs.append((node, block, text))
        if not m:
            return root, runs
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(m[1])
        if skipped:
            if closing:
                if tag in skipped:
                    while skipped.pop() != tag:
                        pass
                    block += not skipped
            elif tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID and not m[3].endswith("/"):
                skipped.append(tag)
            continue
        if closing:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            block += tag in BLOCK
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCK:
            block += 1
            up = node
            while up.parent is not None and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p" and up.parent is not None:
                node = up.parent  # a paragraph, with what is open in it, ends at the next block
        if tag in CLOSES:
            like, scope, up = CLOSES[tag].split(), SCOPES[tag].split(), node
            while up.parent is not None and up.tag not in scope:
                if up.tag in like:
                    node = up.parent
                    break
                up = up.parent
        if tag in VOID:
            if tag == "br":
                runs.append((node, block, " "))
            continue
        gone, marked = _furniture(tag, m[3])
        if gone:
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif not m[3].endswith("/"):
                skipped.append(tag)
            block += tag in BLOCK
            continue
        node = Node(tag, node, marked)
        node.parent.children.append(node)


def _measure(root: Node, runs) -> list[Node]:
    """Counts, densities and density sums of all nodes; returns them parents first."""
    for node, _, text in runs:
        n = len(text) - text.count(" ") - text.count("\n")
        node.chars += n
        if node.in_link:
            node.link_chars += n
    order = [root]
    for node in order:
        order.extend(node.children)
    for node in reversed(order):
        if node.tag == "a":
            node.link_tags += 1
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        c, lc = node.chars, node.link_chars
        if c:
            base = math.log(c * lc / max(c - lc, 1) + c * share + math.e)
            node.density = max(c / node.tags * math.log(max(c * node.tags / (max(lc, 1) * max(node.link_tags, 1)), 1.0)) / math.log(base + math.e - 1), 0.0)
        if node.parent is not None:
            node.parent.sum += node.density
    return order


def _menu(node: Node) -> bool:
    """Three links or more that hold three quarters of the text."""
    return node.link_tags >= 3 and 4 * node.link_chars >= 3 * node.chars and node.tag in BLOCK


def _plain(node: Node) -> int:
    return node.chars - node.link_chars


def _named(order: list[Node]) -> set[int]:
    """Marked elements that are no wrappers, and all in them."""
    wraps: set[int] = set()
    while True:
        named: set[int] = set()
        outer: list[Node] = []
        for node in order:
            within = node.parent is not None and id(node.parent) in named
            if within or node.marked and id(node) not in wraps:
                named.add(id(node))
                if not within:
                    outer.append(node)
        if not outer:
            return named
        best = max(outer, key=_plain)
        outside = _plain(order[0]) - sum(_plain(x) for x in outer)
        whole = [x for x in order if x.tag in ("article", "main")]
        only = any(_within(x, best) for x in whole) and not any(id(x) not in named for x in whole)
        share = 20 if best.marked == 2 else 1 if only else 4
        if _plain(best) <= share * outside or not any(x.tag in BLOCK for x in best.children):
            return named
        wraps.add(id(best))


def _within(node: Node | None, other: Node) -> bool:
    while node is not None and node is not other:
        node = node.parent
    return node is not None


def main_text(page: str | None) -> str:
    """Blocks of the main text in page order, joined by line feeds; empty if there is none."""
    if not page:
        return ""
    root, runs = parse(page)
    order = _measure(root, runs)
    named = _named(order)
    free = [node for node in order if id(node) not in named]
    # the text outside links that is in no marked element
    plain = sum(len(text.strip()) for node, _, text in runs if not node.in_link and id(node) not in named)
    for node in order if plain else ():
        if node.marked and id(node) in named:
            node.parent.sum -= node.density  # what is sought outside of it does not gain by it
    core = max(free if plain else order, key=lambda node: node.sum if node.children else node.density / 2)
    path, up = [], core
    while up is not None:
        path.append(up)
        up = up.parent
    first = next((i for i, node in enumerate(path) if node.tag in ("article", "main")), 0)
    whole = path[first]
    if whole.tag == "article":
        top = next((i for i, node in enumerate(path) if i > first and node.tag == "main"), first + 1)
    else:
        top = first if whole.tag == "main" else len(path) - 1
    threshold = min(node.density for node in path[:top + 1] if node.chars) if whole.tag == "article" and core.chars else min(node.density for node in path)
    chosen = {id(whole)}
    for node, up in zip(path[first:top], path[first + 1:top + 1]):
        before = True
        for x in up.children:
            before &= x is not node
            if x is node or not x.chars or id(x) in named or 2 * x.link_chars >= x.chars:
                continue
            # beside an article in its main element, text of about the article's characters per tag belongs to it
            like = path[top].tag == "main" and top > first and 2 * _plain(x) * whole.tags >= _plain(whole) * x.tags
            if like or x.density >= threshold or 2 * _plain(x) >= _plain(whole) and 4 * x.link_chars < x.chars or before and x.tag in HEADINGS:
                chosen.add(id(x))
    inside: dict[int, bool] = {}
    for node in order:
        up = node.parent
        kept = id(node) in chosen or up is not None and inside[id(up)]
        out = _menu(node)
        if node.marked and id(node) in named and node not in path:
            title = node.tag == "header" and node.marked == 1 and any(x.tag in HEADINGS for x in node.children)
            out |= 2 * node.link_chars >= node.chars or node.marked == 2 or node.density < threshold and not title
        inside[id(node)] = kept and not (out and id(node) not in chosen)
    blocks: dict[int, list[str]] = {}
    for node, block, text in runs:
        if inside[id(node)]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(_html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty html give an empty text; broken markup is read as far as browsers do (open elements end with the
    page); repeated rows are treated alike; other columns are ignored; an empty table gives no rows.
    """
    def run(batches):
        for batch in slices(batches, "html"):
            out = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()),
                                              pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
