"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags.  The first pass decides each
block by its share of linked characters, its length and its density of stop
words; what stands in menus, notices, forms and the like is none.  Blocks
without a clear sign stay open: short ones, and those with few stop words (a
table, a list of names, a language that the list lacks).  In the second pass an
open block takes the label of the nearest decided neighbours.

``article`` and ``main`` elements are no proof.  Only if most of the text that
the first pass accepts (``MOST_IN_MAIN``) stands inside them, what stands
outside is taken for the page's frame; a page whose only ``article`` is a teaser
keeps its body.  Without such an element the innermost one that holds nearly all
accepted text (``MOST_IN_ONE``) takes its place, so that notices and comments
around the prose go without a name that tells them.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import free_name, prepare

MOST_LINKED = 0.5
SHORT_CHARS = 70
LONG_CHARS = 200
STOPS_NONE, STOPS_LOW, STOPS_HIGH = 0.05, 0.2, 0.3
MOST_IN_MAIN, MOST_IN_ONE = 2 / 3, 0.85

STOP_WORDS = frozenset(
    "the of and to a in that is was for it with as his on be at by i this had not are but from or have an they which you were her all she there would their we him been has when who will more no if out so "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son aux ou mais comme on elle nous cette ses leur "
    "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son".split()
)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold others; only these are tracked as open.
CONTAINERS = frozenset("address article aside blockquote body button center dialog dd details div dl dt fieldset figure footer form header html li main menu nav ol section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("aside button dialog fieldset footer form menu nav".split())
MAIN = frozenset(("article", "main"))
WHOLE = frozenset(("html", "body"))
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NAMES = frozenset(
    "ad ads adbox adslot advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)

#: Their content is text, not tags; without a closing tag it is the rest of the page.
_RAW = "script|style|textarea|title"
#: Their content is dropped, up to their own end or that of an element around them.
FOREIGN = frozenset(("svg", "math"))
DROPPED = FOREIGN | frozenset("canvas head iframe noscript object select template".split())
#: Start tags that leave a head open; elements of foreign content that hold blocks; other tags of blocks.
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
HOLDS_BLOCKS = frozenset(("annotation-xml", "desc", "foreignobject"))
BLOCKS = CONTAINERS | frozenset("h1 h2 h3 h4 h5 h6 hr p pre".split())
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<(?!title\s*/>)({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|</?[A-Za-z!?][^>]*(?:>|\Z)", re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    main: int
    never: bool
    heading: bool
    inside: tuple[int, ...] = ()
    label: bool | None = None


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape((v or "").strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)}


def unwanted(tag: str, raw: str, in_main: bool) -> bool:
    """Whether an element holds no main text, by its tag, role, class or id."""
    if tag in NEVER or tag == "header" and not in_main:
        return True
    if not raw.strip() or tag in ("html", "body") or tag in MAIN:
        return False
    own = attributes(raw)
    if "hidden" in own or own.get("aria-hidden") == "true" or own.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", own.get("style", "")):
        return True
    return bool(NAMES & set(re.split(r"[\s_-]+", f"{own.get('class', '')} {own.get('id', '')}".lower())))


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with all that the rules look at."""
    found: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int, int]] = []  # tag, unwanted, number of the main element or 0, own number
    linked, in_link, mains, heading, at, opens = 0, 0, 0, False, 0, 0
    dropped: int | None = None  # depth of the outermost dropped element that is open

    def close() -> None:
        nonlocal parts, linked, heading
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            found.append(Block(text, linked, stack[-1][2] if stack else 0, any(s[1] for s in stack[:dropped]), heading, tuple(s[3] for s in stack)))
        parts, linked = [], 0

    def leave(depth: int) -> None:
        nonlocal dropped
        del stack[depth:]
        if dropped is not None and depth <= dropped:
            dropped = None

    def opened(*tags: str) -> int | None:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in tags), None)

    def add(text: str) -> None:
        nonlocal linked
        if dropped is not None:
            if stack[-1][0] != "head" or not text.strip():
                return
            leave(len(stack) - 1)
        parts.append(text)
        if in_link:
            linked += len("".join(html.unescape(text).split()))

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if dropped is not None and not m[2]:
            if tag == "body" and (depth := opened("head")) is not None:
                leave(depth)
            elif stack[-1][0] == "head" and tag not in IN_HEAD:
                leave(len(stack) - 1)
            while dropped is not None and stack[-1][0] in FOREIGN and tag in BLOCKS:
                leave(len(stack) - 1)
        if tag in DROPPED or dropped is not None:
            if m[2]:
                if (tag in DROPPED or tag in CONTAINERS or tag in HOLDS_BLOCKS) and (depth := opened(tag)) is not None:
                    if dropped is not None and depth < dropped:
                        close()
                        in_link = 0
                    leave(depth)
            elif (tag in DROPPED or tag in CONTAINERS or tag in HOLDS_BLOCKS) and not m[4].endswith("/"):
                if dropped is None:
                    dropped = len(stack)
                stack.append((tag, True, stack[-1][2] if stack else 0, -1))
            continue
        if tag == "a":
            in_link = 0 if m[2] else 1
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        close()
        in_link = 0 if tag in CONTAINERS else in_link
        if re.fullmatch("h[1-6]", tag):
            heading = not m[2]
        elif tag in CONTAINERS or tag == "p":
            heading = False
        if tag not in CONTAINERS:
            continue
        if m[2]:
            if (depth := opened(tag)) is not None:
                leave(depth)
        elif not m[4].endswith("/"):
            inside = stack[-1][2] if stack else 0
            if tag in MAIN and not inside:
                mains += 1
                inside = mains
            opens += 1
            stack.append((tag, unwanted(tag, m[4], bool(inside)), inside, -1 if tag in WHOLE else opens))
    add(page[at:])
    close()
    return found


def density(b: Block) -> float:
    words = _WORD.findall(b.text.lower())
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def first_pass(b: Block, known: bool) -> bool | None:
    """``known``: whether the page is in a language of the stop words."""
    solid = len(b.text) - b.text.count(" ")
    if b.never or b.linked > MOST_LINKED * solid:
        return False
    if len(b.text) < SHORT_CHARS:
        return None
    stops = density(b)
    if stops >= STOPS_HIGH or stops >= STOPS_LOW and (b.main or len(b.text) >= LONG_CHARS):
        return True
    if len(b.text) >= LONG_CHARS and stops < STOPS_NONE and not b.main:
        return not known
    return None


def classified(found: list[Block]) -> None:
    """The first pass over a page's blocks."""
    content = [b for b in found if not b.never and len(b.text) >= SHORT_CHARS]
    known = any(density(b) >= STOPS_LOW for b in content)
    for b in found:
        b.label = first_pass(b, known)
    inside, outside = (sum(len(b.text) for b in found if b.label and bool(b.main) == m) for m in (True, False))
    if inside and inside >= MOST_IN_MAIN * (inside + outside) or not inside + outside and any(b.main and not b.never for b in found):
        for b in found:
            if not b.main:
                b.label = False
    elif (body := holder(found)) is not None:
        for b in found:
            if body in b.inside:
                b.main = b.main or -1
                b.label = first_pass(b, known)
            else:
                b.label = False


def holder(found: list[Block]) -> int | None:
    """The innermost element, but for the page itself, that holds nearly all text that the first pass accepts."""
    held: dict[int, int] = {}
    total = sum(len(b.text) for b in found if b.label)
    for b in found:
        if b.label:
            for e in {*b.inside} - {-1}:
                held[e] = held.get(e, 0) + len(b.text)
    return max((e for e, n in held.items() if n >= MOST_IN_ONE * total), default=None)


def second_pass(found: list[Block]) -> list[bool]:
    """Labels of all blocks: open ones follow the nearest decided ones of their main element or, outside any, of the page; menus and the like are nobody's neighbours."""
    n = len(found)
    before, after = [-1] * n, [n] * n
    for order, out in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, int] = {}
        for i in order:
            if (k := last.get(found[i].main)) is not None:
                out[i] = k
            if found[i].label is not None and not found[i].never:
                last[found[i].main] = i
    labels = []
    for i, b in enumerate(found):
        if b.label is not None:
            labels.append(b.label)
            continue
        up = found[before[i]].label if before[i] >= 0 else None
        down = found[after[i]].label if after[i] < n else None
        if up is None and down is None:
            labels.append(True)  # nothing speaks against it
        elif up is None or down is None or up == down:
            labels.append(bool(down if up is None else up))
        elif b.heading:
            labels.append(bool(down))
        else:
            labels.append(bool(b.main) if i - before[i] == after[i] - i else bool(up if i - before[i] < after[i] - i else down))
    return labels


def main_text(page: str | None) -> str:
    """The page's main blocks, one a line; empty if there are none."""
    found = blocks(page or "")
    classified(found)
    return "\n".join(b.text for b, keep in zip(found, second_pass(found), strict=True) if keep)


@F.arrow_udf(T.StringType())
def extracted(page: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in page.to_pylist()], pa.string())


def extract(df: DataFrame, html_column: str = "html", into: str = "text") -> DataFrame:
    """``df`` with the main text of each page in a new column (another name if ``into`` is taken).

    Every row comes back; a null or empty page has an empty text.  Equal pages
    have equal texts; a very long page is read whole, by one task.
    """
    prepare(df.sparkSession)
    return df.withColumn(free_name(df, into), extracted(F.col(html_column)))
