"""Main text of web pages: blocks judged by stop words, length and links, short ones by their neighbours.

A page is read once from left to right into blocks (runs of text between block-level tags). The first pass decides a
block by itself: its share of stop words, its length, its share of linked text and the region that holds it. What that
leaves open (short and middling blocks) takes, in the second pass, the label of the nearest decided blocks on both sides.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Most frequent function words; more languages are passed as a parameter.
STOP_WORDS = frozenset("""
    the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer
    le la les de des et un une du en est que qui dans pour pas au sur ne se ce il sont par plus avec son sa mais ou
    el los las y una que del se por con para su al lo como más o pero sus le ha me sin sobre este ya entre cuando
""".split())

BLOCKS = frozenset("""address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td
    tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("audio button canvas datalist embed head iframe map math noframes noscript object select svg template textarea title video".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())     # their content is no markup
OUTSIDE = frozenset("aside dialog footer menu nav".split())                              # never main text; a form can wrap marked content
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# words of class, id and role that name what is no main text
NOISE = frozenset("""ad ads advert advertisement advertising alert banner billboard breadcrumb breadcrumbs byline comment comments consent cookie cookies
    copyright dialog disclaimer disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices pager
    pagination paywall popup promo promotion recommendation recommendations recommended related replies reply respond search share sharing shoutbox
    sidebar signup skip social sponsor sponsored subscribe subscription teaser teasers toolbar tracking widget widgets""".split())
LASTING = frozenset("ad ads advert advertisement comment comments disqus related replies reply respond sidebar sponsored teaser teasers".split())
UNLESS = frozenset("has no with without".split())                                        # has-sidebar names the page, not the sidebar

TOKEN = re.compile(r"""<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
PART = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")
LETTERS = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Rules(NamedTuple):
    """Thresholds of the first pass."""
    linked: float = 0.33         # more linked text than this is a list of links
    few: float = 0.15            # share of stop words under which a block outside marked content is no prose
    many: float = 0.25           # share from which it is prose
    short: int = 70              # fewer characters leave a block open
    long: int = 200              # more decide it
    stop_words: frozenset = STOP_WORDS


class Block:
    __slots__ = ("parts", "linked", "heading", "content", "noise")

    def __init__(self, heading: bool, content: int, noise: bool):
        self.parts, self.linked, self.heading, self.content, self.noise = [], 0, heading, content, noise

    def text(self) -> str:
        return SPACE.sub(" ", "".join(self.parts)).strip()


def attributes(raw: str) -> dict[str, str]:
    found = {}
    for name, double, single, bare in ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


def names(attrs: dict[str, str]) -> set[str]:
    """Words of class, id and role that name noise."""
    found = set()
    for value in (attrs.get("class", ""), attrs.get("id", ""), attrs.get("role", "")):
        for name in value.split():
            words = PART.findall(CAMEL.sub("-", name).lower())
            if not UNLESS & set(words):
                found.update(words)
    return found & NOISE


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in page order, without those that hold no text; linear in the page's length.

    An end tag closes back to its nearest open match and is ignored without one. Comments, declarations and the content
    of elements that show no text are left out; a comment or tag that never ends takes the rest of the page with it.
    """
    blocks: list[Block] = []
    stack: list[tuple] = []       # (tag, dropped, noise, lasting noise, content number, link, heading) outside the element
    opened = Counter()
    dropped = noise = lasting = link = heading = False
    content = contents = 0
    here = None
    breaks = 0

    def add(text: str):
        nonlocal here, breaks
        if dropped or not text:
            return
        if here is None:
            if text.isspace():
                return
            here = Block(heading, content, noise or lasting)
            blocks.append(here)
        here.parts.append(text)
        if not text.isspace():
            breaks = 0
            if link:
                here.linked += len(SPACE.sub(" ", text).strip())

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            add(unescape(page[at:]))
            break
        tag = TOKEN.match(page, start)
        if tag is None:
            nxt = page[start + 1:start + 3]
            if nxt[:1].isascii() and nxt[:1].isalpha() or nxt[:1] == "/" and nxt[1:].isascii() and nxt[1:].isalpha():
                add(unescape(page[at:start]))
                break                                   # a tag that never ends
            if nxt[:1] == "/":                          # </ before anything but a letter is a comment up to the next >
                add(unescape(page[at:start]))
                close = page.find(">", start)
                at = close + 1 if close >= 0 else end
                continue
            following = page.find("<", start + 1)       # a plain less-than sign
            following = end if following < 0 else following
            add(unescape(page[at:following]))
            at = following
            continue
        add(unescape(page[at:start]))
        if tag[0] == "<!--":
            close = page.find("-->", start + 2)
            at = close + 3 if close >= 0 else end
            continue
        if tag[2] is None:
            close = page.find(">", start)
            at = close + 1 if close >= 0 else end
            continue
        at, name = tag.end(), tag[2].lower()
        if name == "br":
            breaks += 1
            if breaks > 1:
                here = None
            elif here is not None:
                add("\n")
            continue
        if name in BLOCKS:
            here, breaks = None, 0
        if tag[1]:
            if opened[name]:
                while True:
                    shut, dropped, noise, lasting, content, link, heading = stack.pop()
                    opened[shut] -= 1
                    if shut in BLOCKS:
                        here = None
                    if shut == name:
                        break
            continue
        if name in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
            _, dropped, noise, lasting, content, link, heading = stack.pop()             # its end tag may be left out
            opened[name] -= 1
        if name in VOID:
            continue
        stack.append((name, dropped, noise, lasting, content, link, heading))
        opened[name] += 1
        if name in RAW or name in DROPPED:
            dropped = True
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            at = close.start() if close else end
            continue
        if dropped:
            continue
        if name == "a":
            link = True
        elif name in HEADINGS:
            heading = True
        found = set()
        if tag[3].strip():
            attrs = attributes(tag[3])
            if "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style", "")):
                dropped = True
            found = names(attrs) if name not in ("html", "body") else set()
        if name in OUTSIDE or found & LASTING:
            lasting = True
        elif found or name == "form" or (name == "header" and not content):
            noise = True
        if name in CONTENT and not found and not lasting:
            noise = False                # content that is marked inside a wrapper with a name like notice-page
            if not content:
                contents += 1
                content = contents
    return [b for b in blocks if b.text()]


def first_pass(block: Block, text: str, marked: bool, rules: Rules) -> bool | None:
    """True for main text, False for other text, None if the block alone does not tell."""
    if block.noise:
        return False
    words = LETTERS.findall(text)
    links = block.linked / len(text)
    stops = sum(w.lower() in rules.stop_words for w in words) / len(words) if words else 0.0
    if marked:
        if not block.content:
            return False
        if links > rules.linked and len(text) < rules.long:
            return False if len(text) >= rules.short or links > 0.8 else None
        return True if len(text) >= rules.short and stops >= rules.few else None
    if links > rules.linked or text.startswith("©"):
        return False
    if len(text) < rules.short:
        return False if block.linked and links > rules.linked / 2 else None
    if stops >= rules.many and len(text) >= rules.long:
        return True
    return None if stops >= rules.few else False


def second_pass(blocks: list[Block], labels: list[bool | None], marked: bool) -> list[bool]:
    """Open blocks take the label of their nearest decided neighbours.

    Inside marked content only neighbours of the same content count, and its edges count as main text; elsewhere the
    page's edges count as other text. Between unlike neighbours a block is main text if the content is marked, if it is
    a heading before main text, or if its main-text neighbour is the nearer one.
    """
    n = len(blocks)
    left, right = [None] * n, [None] * n
    for side, order in ((left, range(n)), (right, range(n - 1, -1, -1))):
        label, place, inside = marked, order[0] if n else 0, None
        for i in order:
            if marked and blocks[i].content != inside:
                label, place, inside = True, i, blocks[i].content
            side[i] = (label, abs(i - place) + 1)
            if labels[i] is not None and not (marked and blocks[i].noise):
                label, place = labels[i], i
    out = []
    for i, own in enumerate(labels):
        if own is not None:
            out.append(own)
            continue
        (before, back), (after, ahead) = left[i], right[i]
        if before == after:
            out.append(before)
        elif marked:
            out.append(True)
        elif blocks[i].heading:
            out.append(after)
        else:
            out.append(back < ahead if before else ahead < back)
    return out


def main_text(page: str, rules: Rules = Rules()) -> str:
    """Blocks of main text, one a line."""
    blocks = blocks_of(page)
    texts = [b.text() for b in blocks]
    marked = any(b.content and not b.noise and b.linked <= rules.linked * len(t) for b, t in zip(blocks, texts))
    labels = [first_pass(b, t, marked, rules) for b, t in zip(blocks, texts)]
    return "\n".join(t for t, good in zip(texts, second_pass(blocks, labels, marked)) if good)


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Rules = Rules(),
               rows_per_batch: int = 64) -> DataFrame:
    """One row per input row: page_id, url, text (empty if none), n_chars (its code points).

    Row-local: pages never leave their task, and a task holds one small batch of them. A page that marks its content
    (``article``, ``main``) gives the blocks in it; other pages give what the rules find. Navigation, page headers,
    footers, asides, forms, hidden elements and elements whose class, id or role names noise give nothing. NULL and empty
    pages give the empty text; repeated rows are read each; an empty table gives no rows; other columns are ignored.
    """
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_batch):
                part = batch.slice(start, rows_per_batch)
                texts = [main_text(page.as_py() or "", rules) for page in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                                  pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    id_type, url_type = (plain.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return plain.mapInArrow(extract, f"page_id {id_type}, url {url_type}, text string, n_chars bigint")
