"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass looks at each
block alone: its links, its length, its share of stop words, and the elements it
stands in. Menus, headers, footers, sidebars, notices, adverts, forms and
comments named by an element or by a class or id are dropped; blocks of an
``article`` or ``main`` element are kept unless they are mostly links. What is
short or undecided is left to the second pass, where it takes the label of the
nearest decided block, and of the one before where two are equally near and
agree or not; where nothing is decided it is kept.

Pages are parsed one at a time inside Arrow batches: no page meets another, so
nothing is shuffled. Null html is empty. Unclosed elements end with the element
they stand in. The text of a page is all kept blocks; nothing is cut.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import free_name
from .words import slices

BLOCK_TAGS = frozenset(
    "address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu "
    "nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul video".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset(
    "head title script style noscript template iframe object applet svg math canvas audio video textarea select "
    "button datalist dialog".split()
)
RAW_TAGS = frozenset("script style noscript template iframe textarea title svg math xmp noembed noframes".split())
OUTSIDE_TAGS = frozenset("nav header footer aside form menu".split())
MAIN_TAGS = frozenset("article main".split())
#: Parts of class and id names that tell what is not the article.
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies copyright disclaimer disqus footer form gdpr header hidden login masthead menu "
    "menubar modal nav navbar navigation navi newsletter notice notices notification overlay pager pagination "
    "paywall popup promo promoted promotion related recommended replies respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget".split()
)
STOP_WORDS = frozenset(
    (
        "a about after all also an and are as at be because been but by can could did do for from had has have he her "
        "him his how i if in into is it its me more my no not of on one or our out over she so some than that the "
        "their them then there these they this to up was we were what when which who will with would you your "
        "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous ou par pas "
        "plus pour qu que qui sa sans se ses son sont sur te tu un une vous y "
        "aber als am auch auf aus bei bin bis das dass dem den der die du durch ein eine einem einen einer er es für "
        "hat ich ihr im ist kann mit nach nicht noch nur oder sich sie sind und uns von vor war wie wir wird zu zum zur "
        "al como con del el ella ellos ese esta este fue ha han hay lo los las más mi muy ni o para pero por porque "
        "sin sobre son su sus también todo una unos yo"
    ).split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>", re.S
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(frozen=True)
class Rules:
    short: int = 70
    long: int = 200
    stop_low: float = 0.15
    stop_high: float = 0.25
    links_high: float = 0.5


@dataclass
class Block:
    text: str
    link_chars: int
    outside: bool
    main: bool
    heading: bool


def _outside_by_name(attributes: str) -> bool:
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    for groups in _NAMES.findall(attributes):
        for part in _PARTS.findall("".join(groups)):
            if part.lower() in OUTSIDE_NAMES:
                return True
    return False


def blocks(html: str) -> list[Block]:
    """Blocks in page order, with what the elements around them say."""
    found: list[Block] = []
    #: Open elements as (name, dropped, outside, main, heading), each with what it inherits.
    stack: list[tuple[str, bool, bool, bool, bool]] = [("", False, False, False, False)]
    pieces: list[str] = []
    link_chars = links = 0

    def flush() -> None:
        nonlocal pieces, link_chars
        if pieces:
            if text := " ".join("".join(pieces).split()):
                _, _, outside, main, heading = stack[-1]
                found.append(Block(text, link_chars, outside, main, heading))
            pieces, link_chars = [], 0

    def add(raw: str) -> None:
        nonlocal link_chars
        if raw and not stack[-1][1]:
            text = unescape(raw)
            pieces.append(text)
            if links:
                link_chars += len("".join(text.split()))

    at, end = 0, len(html)
    while at < end:
        token = _TOKEN.search(html, at)
        if token is None:
            add(html[at:])
            break
        add(html[at : token.start()])
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if token[1]:
            if name == "a":
                links = 0
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth or name in BLOCK_TAGS:
                if name in BLOCK_TAGS or any(x[0] in BLOCK_TAGS for x in stack[depth:]):
                    flush()
            if depth:
                del stack[depth:]
            continue
        if name in BLOCK_TAGS:
            flush()
        if name in RAW_TAGS:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if name == "a":
            links = 1
            continue
        if name in VOID_TAGS or token[3].endswith("/") and name not in BLOCK_TAGS:
            continue
        _, dropped, outside, main, heading = stack[-1]
        if name == "p":  # ends an open paragraph with the inline elements left open in it
            depth = len(stack)
            while stack[depth - 1][0] and stack[depth - 1][0] not in BLOCK_TAGS:
                depth -= 1
            if stack[depth - 1][0] == "p":
                del stack[depth - 1 :]
                _, dropped, outside, main, heading = stack[-1]
        inside = main or name in MAIN_TAGS
        named = name not in ("html", "body", "main", "article") and _outside_by_name(token[3])
        if name in OUTSIDE_TAGS and not (name == "header" and main):
            named = True
        stack.append(
            (
                name,
                dropped or name in SKIPPED_TAGS,
                outside or named,
                inside,
                name in ("h1", "h2", "h3", "h4", "h5", "h6"),
            )
        )
    flush()
    return found


def first_pass(block: Block, rules: Rules) -> bool | None:
    """Kept, dropped, or undecided, from the block alone."""
    if block.outside:
        return False
    size = len(block.text)
    share = block.link_chars / max(1, size - block.text.count(" "))
    if block.main:
        return share < 0.9 or block.heading
    if share >= rules.links_high:
        return False
    if size < rules.short:
        return None if not share else False
    words = block.text.lower().split()
    stops = sum(w.strip(".,;:!?()\"'«»") in STOP_WORDS for w in words) / len(words)
    if stops >= rules.stop_high:
        return True if size >= rules.long else None
    if stops >= rules.stop_low:
        return None
    return False


def second_pass(labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided one."""
    n = len(labels)
    before: list[tuple[int, bool] | None] = []
    last = None
    for i, label in enumerate(labels):
        if label is not None:
            last = (i, label)
        before.append(last)
    out, following = [True] * n, None
    for i in range(n - 1, -1, -1):
        if labels[i] is not None:
            following = (i, labels[i])
            out[i] = labels[i]
        else:
            near = [(abs(i - x[0]), k, x[1]) for k, x in enumerate((before[i], following)) if x]
            out[i] = min(near)[2] if near else True
    return out


def main_text(html: str | None, rules: Rules = Rules()) -> str:
    """The kept blocks of a page, joined by one space."""
    found = blocks(html or "")
    kept = second_pass([first_pass(b, rules) for b in found])
    return " ".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``pages`` with the html column replaced by the main text of the page.

    The text's column is ``_text`` where another column is called ``text``.
    """
    others = [c for c in pages.columns if c != html]
    text, source = free_name(others, text), free_name(others, "_html")
    rows = pages.select(*[F.col(f"`{c}`") for c in others], F.col(html).alias(source))
    schema = pages.select(*[F.col(f"`{c}`") for c in others], F.lit("").alias(text)).schema

    def run(batches):
        for part in slices(batches, source):
            texts = [main_text(x, rules) for x in part.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*others, text])

    return rows.mapInArrow(run, schema)
