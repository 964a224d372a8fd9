"""HTML extraction by tag-path ratios: which paths of the element tree carry the article.

A page is read once into blocks (runs of text between block borders), each with its path from the root. Per path the length of text
outside links and its punctuation are summed and divided by the number of blocks; the two ratios are fused into one score. Scores are
smoothed over the tree of paths, where the weight of another path halves with every step of the way to it, so that a short heading
beside long paragraphs counts as theirs. Paths below a share of the best score fall. What is left is completed inside the element
that holds nearly all of it: lists, tables and captions of the article come with its paragraphs.

Elements that never hold the article are set aside while reading: by their tag, their role, or a word of their class or id.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialake.llm.common import col, slices

DECAY, SHARE, WHOLE, LINKS = 0.5, 0.1, 0.9, 0.5
DEEPEST = 256  # elements nested deeper are read as neighbours, so that broken markup cannot make paths without end
FIRM, SOFT = 2, 1  # noise; an article inside soft noise counts again

# Elements and words of the web.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
NOISE_TAGS = {"head": FIRM, "footer": FIRM, "aside": FIRM, "nav": SOFT, "form": SOFT, "header": SOFT, "menu": SOFT, "search": FIRM, "dialog": FIRM, "button": FIRM,
              "select": FIRM, "option": FIRM, "datalist": FIRM, "svg": FIRM, "math": 0, "object": FIRM, "canvas": FIRM, "audio": FIRM, "video": FIRM, "label": FIRM}
NOISE_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices alert "
                        "popup modal overlay newsletter subscribe subscription signup login paywall nav navbar navigation menu breadcrumb breadcrumbs sidebar rail widget widgets "
                        "related recommended recommendations teaser share sharing social footer masthead topbar toolbar pagination pager copyright legal disclaimer search".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond responses discussion".split())
PREFIXES = frozenset("has no with without is js".split())  # `has-sidebar` tells about the page
CLOSED_BY = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
             "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
PEERS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"),
         "tfoot": ("thead", "tbody", "tfoot")}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
END_OF_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
PUNCTUATION = re.compile(r"[.,;:!?…、。！，：；？।،؟]")
NAME_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Element:
    """An open element: its path of labels, the noise it lies in and its place in the tree."""

    __slots__ = ("tag", "path", "noise", "parent", "link")

    def __init__(self, tag: str, label: str, noise: int, parent: Element | None, link: bool):
        self.tag, self.noise, self.parent, self.link = tag, noise, parent, link
        self.path = (*parent.path, label) if parent else ()


def _noise_of_name(name: str) -> int:
    words = [w.lower() for w in NAME_WORD.findall(name)]
    if not words or words[0] in PREFIXES or words[-1] in ("open", "closed"):
        return 0
    ends = (words[0], words[-1])
    return FIRM if any(w in COMMENT_WORDS for w in ends) else SOFT if any(w in NOISE_WORDS for w in ends) else 0


def _judge(tag: str, source: str, parent: Element) -> tuple[str, int]:
    """(path label, noise) of a new element."""
    noise, names, content = parent.noise, "", tag in ("article", "main")
    if content and noise == SOFT:
        noise = 0
    inside = _within(parent)
    if tag in NOISE_TAGS and not (tag == "header" and inside):
        noise = max(noise, NOISE_TAGS[tag])
    if source.strip():
        for name, *values in ATTRIBUTE.findall(source):
            name, value = name.lower(), next(filter(None, values), "")
            if name == "class":
                names = value
            if name in ("class", "id") and tag not in ("html", "body", "main"):
                found = max(map(_noise_of_name, value.split()), default=0)
                noise = max(noise, found if not content or found == FIRM else 0)
            elif name == "role" and value.lower() in NOISE_ROLES and not inside:
                noise = max(noise, SOFT)
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                noise = FIRM
    return (f"{tag}.{names}" if names else tag), noise


def _within(element: Element | None) -> Element | None:
    """The nearest article or main element around, or itself."""
    while element is not None and element.tag not in ("article", "main"):
        element = element.parent
    return element


class Block:
    __slots__ = ("element", "pieces", "linked", "text", "links", "points")

    def __init__(self, element: Element):
        self.element, self.pieces, self.linked = element, [], []


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order, without those in noise."""
    root = Element("", "", 0, None, False)
    top, made, block = root, [], None
    at = 0

    def add(piece: str) -> None:
        nonlocal block
        if top.noise or not piece:
            return
        if block is None:
            holder = top
            while holder.tag and holder.tag not in BLOCKS:
                holder = holder.parent
            block = Block(holder)
            made.append(block)
        block.pieces.append(piece)
        if top.link:
            block.linked.append(piece)

    while at < len(page):
        token = TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at:token.start()])
        at = token.end()
        closing, tag = token.group(1), (token.group(2) or "").lower()
        if not tag:
            continue
        if closing:
            holder = top
            while holder.tag and holder.tag != tag:
                holder = holder.parent
            if holder.tag:
                if tag in BLOCKS:
                    block = None
                    top = holder.parent
                else:  # a formatting element ends inside its block only
                    inner = top
                    while inner is not holder and inner.tag not in BLOCKS:
                        inner = inner.parent
                    top = holder.parent if inner is holder else top
            continue
        if tag in RAW:
            end = END_OF_RAW[tag].search(page, at)
            at = end.start() if end else len(page)
            close = page.find(">", at)
            at = close + 1 if close >= 0 else len(page)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            block = None
            holder = top  # an open paragraph ends where a block begins
            while holder.tag and holder.tag != "p" and holder.tag not in BLOCKS:
                holder = holder.parent
            if holder.tag == "p":
                top = holder.parent
        if tag in CLOSED_BY:
            holder, peers = top, PEERS.get(tag, (tag,))
            while holder.tag and holder.tag not in peers and holder.tag not in CLOSED_BY[tag]:
                holder = holder.parent
            if holder.tag in peers:
                top = holder.parent
        if tag in VOID:
            continue
        if tag in ("html", "body") and top.tag:
            holder = top
            while holder.tag and holder.tag not in ("head", tag):
                holder = holder.parent
            if holder.tag == tag:
                continue
            top = holder.parent if holder.tag else top  # a body ends an open head
        label, noise = _judge(tag, token.group(3), top)
        if not (token.group(3).endswith("/") and tag not in BLOCKS):
            parent = top.parent if len(top.path) >= DEEPEST else top
            top = Element(tag, label, noise, parent, parent.link or tag == "a")
    out = []
    for block in made:
        block.text = " ".join(html.unescape("".join(block.pieces)).split())
        if block.text:
            block.links = len(" ".join(html.unescape("".join(block.linked)).split()))
            block.points = len(PUNCTUATION.findall(block.text))
            out.append(block)
    return out


def path_scores(blocks: list[Block]) -> dict[tuple[str, ...], list[float]]:
    """path -> [blocks, text length, length in links, punctuation]."""
    totals: dict[tuple[str, ...], list[float]] = {}
    for block in blocks:
        total = totals.setdefault(block.element.path, [0, 0, 0, 0])
        for i, value in enumerate((1, len(block.text), block.links, block.points)):
            total[i] += value
    return totals


def smoothed(scores: dict[tuple[str, ...], float]) -> dict[tuple[str, ...], float]:
    """Mean of all scores, weighted by DECAY to the power of the steps between two paths in the tree of paths.

    One pass up and one pass down the tree give the sums for all paths, so the work grows with the paths and not with their pairs.
    """
    parents: dict[tuple[str, ...], tuple[str, ...] | None] = {(): None}
    for path in scores:
        for depth in range(1, len(path) + 1):
            parents.setdefault(path[:depth], path[:depth - 1])
    nodes = sorted(parents, key=len)
    under = {node: (scores.get(node, 0.0), float(node in scores)) for node in nodes}
    for node in reversed(nodes[1:]):
        up = under[parents[node]]
        under[parents[node]] = up[0] + DECAY * under[node][0], up[1] + DECAY * under[node][1]
    around = {(): under[()]}
    for node in nodes[1:]:
        own, up = under[node], around[parents[node]]
        around[node] = tuple(own[i] + DECAY * (up[i] - DECAY * own[i]) for i in (0, 1))
    return {path: around[path][0] / around[path][1] for path in scores}


def content_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks of the article, in page order."""
    totals = path_scores(blocks)
    fused = {path: (size - links) / n * (1 + points / n) for path, (n, size, links, points) in totals.items()}
    score = smoothed(fused)
    best = max(score.values(), default=0)
    if best <= 0:
        return []
    chosen = {path for path, value in score.items() if value >= SHARE * best and totals[path][2] <= LINKS * totals[path][1]}
    inside, weight = {}, 0
    for block in blocks:
        if block.element.path in chosen:
            weight += len(block.text)
            element = block.element
            while element is not None:
                inside[element] = inside.get(element, 0) + len(block.text)
                element = element.parent
    holder = max(inside, key=lambda e: (inside[e] >= WHOLE * weight, len(e.path)), default=None)
    article = _within(holder)
    holder = article or (holder if holder is not None and holder.tag not in ("", "html", "body") else None)
    kept = []
    for block in blocks:
        path = block.element.path
        within, element = False, block.element
        while holder is not None and element is not None and not within:
            within, element = element is holder, element.parent
        linked = totals[path][2] > LINKS * totals[path][1]
        if within and not linked or path in chosen and (article is None or block.element.tag == "h1"):
            kept.append(block)
    return kept


def article_of(page: str | None) -> str:
    """Main text of a page: its blocks in page order, one line each."""
    return "\n".join(block.text for block in content_blocks(blocks_of(page or "")))


def main_text(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the article of every page, one row per row of ``pages``.

    Null and empty pages, and pages without text outside noise, give an empty text. Character references are decoded, white space
    inside a block becomes one blank, blocks are joined by one line feed, nothing is cut off. Ids may repeat or be null; other columns
    are not read. Row by row, without a shuffle; work and memory grow with a page's length.
    """
    def extract(batches: Iterator) -> Iterator:
        for batch in slices(batches, "html"):
            texts = [article_of(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    narrow = pages.select(col(id_column).cast("bigint").alias("page_id"), col(url_column).cast("string").alias("url"), col(html_column).cast("string").alias("html"))
    found = narrow.mapInArrow(extract, "page_id bigint, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
