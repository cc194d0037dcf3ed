"""Main text of web pages by tag-path ratios.

A page is read into blocks: runs of text that no block element or line break
divides. Each block stands at the end of a path of elements from the root. For
every path of a page the text length and the punctuation of its blocks are
summed and divided by the number of its blocks, less what stands in links; the
two ratios are fused, smoothed along the page, averaged again per path, and
paths above a threshold are content. The content lies in the narrowest element
that holds most of the text of such paths; everything in it is kept, so short
paragraphs and headings of an article stay, except parts that the page itself
marks as something else: navigation, page headers and footers, side bars,
notices, adverts, forms, scripts, styles and comments, by their element, role,
class or id. Where a page marks an article, paths compete within it only.

Pages are independent, so this is one pass without a shuffle, whose memory is
that of a page.

Defined cases: null or empty html and pages without text give an empty text;
text outside any element is a block of the root; tags that are never closed
end with their parent, comments and attributes that are never closed with the
page; stray closing tags only end a block; references are decoded as browsers
do, also without a semicolon; every row, also a repeated one, is judged alone;
extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweave.llm.batches import Step, map_batches

# Element names of the HTML standard and the names that pages commonly give to their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: An opening element ends an open one of these, looked for up to the given parents.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: An open paragraph is not looked for beyond these, and these paragraphs have the same path whatever their class.
CELLS = frozenset("button object table td th".split())
PARAGRAPHS = frozenset("p pre h1 h2 h3 h4 h5 h6 li".split())
OTHER_TAGS = frozenset("aside audio button canvas dialog footer form head header menu nav object select svg video".split()) | RAW
OTHER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "notification pager pagination popup promo promoted promotion recommendations recommended related replies respond search share sharing "
    "sidebar signup skip social sponsor sponsored subnav subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: Names that also hold when an article or the main part itself bears them.
OTHER_ARTICLES = frozenset("ad ads advert advertisement comment comments promo related reply sponsored teaser".split())
MAIN_ROLES = frozenset(["article", "main"])
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s|/)(class|id|role|itemprop|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/]|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: A name such as has-sidebar tells of the page, not of the part.
_MODIFIER = re.compile(r"(?:has|no|with|without|is|not)[-_]", re.I)


@lru_cache(1 << 14)
def described(tag: str, attributes: str) -> tuple[frozenset, frozenset, str, bool, bool]:
    """Names of a tag by its class and id, its whole class tokens, its role, whether it is marked as the body of an article, and hidden."""
    found = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(attributes)}
    tokens = [t for t in f"{found.get('class', '')} {found.get('id', '')}".split() if not _MODIFIER.match(t)]
    names = frozenset(w.lower() for t in tokens for w in _WORD.findall(t))
    hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
    return names, frozenset(t.lower() for t in tokens), found.get("role", "").lower(), found.get("itemprop") == "articleBody", hidden


_PLAIN = (frozenset(), frozenset(), "", False, False)
_TELLING = ("class", "id", "role", "itemprop", "hidden", "style")


class Element:
    """``path`` numbers the way from the root, ``main`` is the article around it, ``other`` marks what isn't content."""

    __slots__ = ("tag", "parent", "path", "main", "other", "link", "mass")

    def __init__(self, tag: str, parent: Element | None, attributes: str, paths: dict[tuple, int]):
        self.tag, self.parent, self.mass = tag, parent, 0.0
        if parent and parent.other is True:  # nothing in there can be content
            self.path, self.main, self.other, self.link = parent.path, None, True, False
            return
        names, tokens, role, body, hidden = _PLAIN
        if attributes:
            low = attributes.lower()
            if any(a in low for a in _TELLING):
                names, tokens, role, body, hidden = described(tag, attributes)
        inside, outside = (parent.main, parent.other) if parent else (None, False)
        marked = tag in MAIN_ROLES or role in MAIN_ROLES or body
        if marked:
            other = bool(tokens & OTHER_ARTICLES)
        elif tag == "header" or names & OTHER_NAMES == {"header"}:
            other = not inside  # the head of an article belongs to it
        else:
            other = tag not in ("html", "body") and (tag in OTHER_TAGS or role in OTHER_ROLES or not names.isdisjoint(OTHER_NAMES))
        if outside == "form" and marked and not other:
            outside = False  # a form may hold the whole page, so an article in it counts
        self.other = "form" if tag == "form" and not outside else bool(other or hidden) or outside
        self.main = self if marked and not self.other else inside
        self.link = tag == "a" or bool(parent and parent.link)
        if tag in INLINE:
            self.path = parent.path
        else:
            label = (parent.path if parent else -1, tag, names if tag not in PARAGRAPHS else None)
            self.path = paths.setdefault(label, len(paths))


def blocks(page: str) -> list[tuple[Element, str, int]]:
    """(innermost block element, text, characters in links) of each run of text that may be content, in page order."""
    paths: dict[tuple, int] = {}
    root = Element("", None, "", paths)
    stack, out = [root], []
    run: list[tuple[Element, str]] = []

    def end_run() -> None:
        text = " ".join("".join([t for _, t in run]).split())
        if text:
            holder = next(e for e, t in run if not t.isspace())
            while holder.tag in INLINE:
                holder = holder.parent
            out.append((holder, text, sum(len(t) for e, t in run if e.link)))
        run.clear()

    def close(names: frozenset, up_to: frozenset) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in names:
                del stack[at:]
                return
            if stack[at].tag in up_to:
                return

    at, size = 0, len(page)
    while at < size:
        tag = _TAG.search(page, at)
        text = page[at : tag.start() if tag else size]
        if text and not stack[-1].other:
            run.append((stack[-1], entities.unescape(text) if "&" in text else text))
        if not tag:
            break
        at = tag.end()
        closing, name, attributes = tag.groups()
        if not name:
            continue
        name = name.lower()
        inline = name in INLINE
        if run and not inline:
            end_run()
        if closing:
            if stack[-1].tag == name:
                stack.pop()
                continue
            if not inline:
                close(frozenset((name,)), CELLS if name in ("p", "li", "div") else frozenset())
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == name:
                    del stack[depth]
                    break
                if stack[depth].tag not in INLINE:
                    break
            continue
        if name in CLOSES_P:
            close(frozenset(("p",)), CELLS)
        if name in ENDS:
            close(*ENDS[name])
        if name in VOID:
            continue
        if name in RAW:
            ended = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = ended.start() if ended else size
            continue
        stack.append(Element(name, stack[-1], attributes, paths))
    end_run()
    return out


def path_scores(of: list[int], lengths: np.ndarray, links: np.ndarray, marks: np.ndarray, radius: int = 2) -> np.ndarray:
    """The score of each path: ratios per path, fused, smoothed over the blocks in page order, averaged per path."""
    path = np.array(of)
    nodes = np.bincount(path)
    text = np.bincount(path, np.maximum(lengths - links, 0))
    ratio, points = text / nodes, np.bincount(path, marks) / nodes
    fused = (ratio * (1 + points))[path]
    reach = np.arange(-radius, radius + 1)
    weights = np.exp(-0.5 * reach.astype(float) ** 2)
    padded = np.concatenate([np.repeat(fused[0], radius), fused, np.repeat(fused[-1], radius)])
    smooth = np.convolve(padded, weights / weights.sum(), mode="valid")
    return np.bincount(path, np.sqrt(smooth * fused)) / nodes


def content(found: list[tuple[Element, str, int]], most: float = 0.75) -> list[str]:
    """The texts of the blocks that belong to the page's content."""
    rest = [b for b in found if not b[0].other]
    if any(b[0].main for b in rest):
        rest = [b for b in rest if b[0].main]
    if not rest:
        return []
    paths: dict[int, int] = {}
    of = [paths.setdefault(b[0].path, len(paths)) for b in rest]
    lengths, links = np.array([len(b[1]) for b in rest], float), np.array([b[2] for b in rest], float)
    scores = path_scores(of, lengths, links, np.array([len(PUNCTUATION.findall(b[1])) for b in rest], float))
    threshold = min(float(scores.std()), 0.5 * float(scores.max()))
    weight = np.where(scores[of] >= threshold, lengths - np.minimum(links, lengths), 0.0)
    total = float(weight.sum())
    children: dict[Element, dict[Element, None]] = defaultdict(dict)
    top = None
    for (element, *_), w in zip(rest, weight.tolist(), strict=True):
        while element:
            element.mass += w
            if element.parent:
                children[element.parent][element] = None
            top, element = element, element.parent
    # the narrowest element with most of the content; an article isn't cut any further
    while total and not (top.main is top and top.tag != "main"):
        largest = max(children[top], key=lambda e: e.mass, default=None)
        if largest is None or largest.mass < most * total:
            break
        if largest.tag in PARAGRAPHS:
            break  # a single paragraph isn't all of its parent
        top = largest
    out = []
    for element, text, linked in rest:
        up = element
        while up is not top and up:
            up = up.parent
        # lists of links outside of a marked article are menus
        if up and (element.main or not total or linked <= 0.7 * len(text) or scores[paths[element.path]] >= threshold):
            out.append(text)
    return out


def extract(pages: DataFrame, html: Column | None = None) -> DataFrame:
    """page_id, url, text and n_chars, its code points."""

    def make() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [" ".join(content(blocks(page))) if page else "" for page in batch.column("html").to_pylist()]
            return pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

        return step

    rows = pages.select("page_id", "url", (F.col("html") if html is None else html).alias("html"))
    kinds = dict(rows.dtypes)
    return map_batches(rows, make, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
