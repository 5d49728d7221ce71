"""Page markup as a node array, and selection over it as Column expressions.

``parse_pages`` parses each page once, in Arrow batches, into nodes listed in document order; a subtree is then the
contiguous run ``node_id .. subtree_end``. Everything after that is array expressions on the page's own row, so no
operator on nodes shuffles and page text never leaves its task.
"""
import re
import sys
from html import unescape
from html.entities import html5
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import constants as K
from ..schema import NODE
from .binding import let, running_sums
from .text import collapse, strip

_VOID = frozenset(K.VOID_TAGS)

# Ship the parser itself with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


DATA, START, END = range(3)
_TAG = re.compile(r"""<(?:/([a-zA-Z][a-zA-Z0-9]*+)[\t\n\r\f ]*+>|([a-zA-Z][a-zA-Z0-9]*+)((?:[\t\n\r\f ]++[a-zA-Z_][-a-zA-Z0-9_:.]*+"""
                  r"""(?:=(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`/&]++))?+)*+)[\t\n\r\f ]*+(/?)>)""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_][-a-zA-Z0-9_:.]*+)(?:=(?:"([^"]*+)"|'([^']*+)'|([^\s"'=<>`/&]++)))?+""")
_COMMENT_END = re.compile(r"--[\s!]*>")
_RAW_END = {name: re.compile(rf"</\s*{name}", re.I) for name in ("script", "style")}
_OTHER_RAW = frozenset(("textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"))   # raw text to some parsers


class _Events(HTMLParser):
    """Start tags, end tags and data of one page, by the standard library's tolerant rules."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events = []

    def handle_starttag(self, tag, attrs):
        self.events.append((START, tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.events.append((END, tag, None))

    def handle_data(self, data):
        self.events.append((DATA, data, None))

    def updatepos(self, i, j):
        return j  # line numbers are not needed, and counting them costs


KNOWN_TAGS, KNOWN_CHARS = 10000, 200


def _plain_events(markup: str, known: dict | None = None) -> list[tuple] | None:
    """The same events for pages whose every tag, comment and raw element is plainly written; None for other pages.

    ``known`` keeps what short tags were read as, by their text, from page to page; it is emptied when it is full.
    """
    events = []
    add = events.append
    known = {} if known is None else known
    at, end, find, match = 0, len(markup), markup.find, _TAG.match
    while at < end:
        start = find("<", at)
        if start < 0:
            if find("&", at) >= 0:
                return None
            add((DATA, markup[at:], None))
            break
        if start > at:
            text = markup[at:start]
            add((DATA, unescape(text) if "&" in text else text, None))
        close = find(">", start) + 1
        seen = known.get(markup[start:close])
        if seen is not None:
            events += seen
            at = close
            continue
        before = len(events)
        tag = match(markup, start)
        if tag is None:
            if markup.startswith("<!--", start):
                close = _COMMENT_END.search(markup, start + 4)
                if close is None or close[0] != "-->" or markup.startswith(("<!-->", "<!--->"), start):
                    return None
                at = close.end()
                continue
            if markup[start:start + 9].lower() == "<!doctype":
                at = find(">", start) + 1
                if at and not {'"', "'", "["} & set(markup[start:at]):
                    continue
            return None
        at = tag.end()
        if len(known) >= KNOWN_TAGS:
            known.clear()
        if tag[1]:
            add((END, tag[1].lower(), None))
            if at - start <= KNOWN_CHARS:
                known[tag[0]] = events[before:]
            continue
        name, raw, attrs = tag[2].lower(), tag[3], {}
        if raw:
            for key, double, single, bare in _ATTRIBUTE.findall(raw):
                value = double or single or bare
                if "&" in value:
                    return None          # how a bare ampersand is read differs between versions
                attrs[key.lower()] = value
        add((START, name, attrs))
        if tag[4]:
            add((END, name, None))
        elif name in _RAW_END:
            close = _RAW_END[name].search(markup, at)
            if close is None or not markup.startswith(">", close.end()) or close.end() - close.start() != len(name) + 2:
                return None
            if close.start() > at:
                add((DATA, markup[at:close.start()], None))
            add((END, name, None))
            at = close.end() + 1
        elif name in _OTHER_RAW and not markup[find("<", at):].startswith((f"</{name}>", f"</{name.upper()}>")):
            return None
        if at - start <= KNOWN_CHARS and name not in _RAW_END and name not in _OTHER_RAW:
            known[tag[0]] = events[before:]
    return events


def page_events(markup: str, known: dict | None = None) -> list[tuple]:
    """(kind, tag or text, attributes) of a page in order; the last of repeated attributes counts.

    Tags read the same share their attributes through ``known``: they are not to be changed.
    """
    events = _plain_events(markup, known)
    if events is None:
        parser = _Events()
        parser.feed(markup)
        events = parser.events
    return events


def _offsets(sizes) -> pa.Array:
    return pa.array([0, *accumulate(sizes)], type=pa.int32())


def _node_lists(pages: list[str | None], known: dict | None = None) -> pa.ListArray:
    """Flat outlines of several pages as one Arrow array, built column by column; a NULL page has no nodes.

    An end tag closes back to its nearest open match and is ignored without one.
    """
    sizes, numbers, parents, depths, ends, tags, texts, counts, keys, values = ([] for _ in range(10))
    for markup in pages:
        if markup is None:
            sizes.append(0)
            continue
        base = len(tags)
        more = {}                     # further own texts of nodes that have several
        parents.append(None)
        depths.append(0)
        ends.append(0)
        tags.append("root")
        texts.append("")
        counts.append(0)
        opened, names, last = [0], [""], 0
        for kind, what, attrs in page_events(markup, known):
            if kind == DATA:
                here = base + opened[-1]
                if not texts[here]:
                    texts[here] = what
                elif here in more:
                    more[here].append(what)
                else:
                    more[here] = [what]
            elif kind == START:
                last += 1
                parents.append(opened[-1])
                depths.append(len(opened))
                ends.append(last)
                tags.append(what)
                texts.append("")
                counts.append(len(attrs))
                if attrs:
                    keys.extend(attrs)
                    values.extend(attrs.values())
                if what not in _VOID:
                    opened.append(last)
                    names.append(what)
            elif what in names:
                while True:
                    ends[base + opened.pop()] = last
                    if names.pop() == what:
                        break
        for i in opened:
            ends[base + i] = last
        for here, parts in more.items():
            texts[here] += "".join(parts)
        numbers.extend(range(last + 1))
        sizes.append(last + 1)
    attributes = pa.MapArray.from_arrays(_offsets(counts), pa.array(keys, type=pa.string()), pa.array(values, type=pa.string()))
    fields = ["node_id", "parent_id", "depth", "subtree_end", "tag", "attrs", "own_text"]
    columns = [pa.array(c, type=pa.int32()) for c in (numbers, parents, depths, ends)]
    rows = pa.StructArray.from_arrays([*columns, pa.array(tags, type=pa.string()), attributes,
                                       pa.array([t.strip() for t in texts], type=pa.string())], names=fields)
    return pa.ListArray.from_arrays(_offsets(sizes), rows)


def _outline(markup: str) -> list[dict]:
    """Flat outline of one page as plain records."""
    return _node_lists([markup])[0].as_py()


def parse_pages(pages: DataFrame, html: str = "html", rows_per_batch: int = 64) -> DataFrame:
    """Pages with ``nodes`` in place of their markup: the page itself as node 0, then its nodes in document order.

    An Arrow map over partitions, so every page is parsed exactly once whatever is built on top; small output batches
    keep memory level. Select the columns to keep before calling.
    """
    kept = [c for c in pages.columns if c != html]

    def parse(batches):
        known: dict = {}
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_batch):
                part = batch.slice(start, rows_per_batch)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [_node_lists(part.column(html).to_pylist(), known)],
                                                 names=[*kept, "nodes"])

    out = T.StructType([pages.schema[c] for c in kept] + [T.StructField("nodes", T.ArrayType(NODE))])
    return pages.mapInArrow(parse, out)


# --- nodes ------------------------------------------------------------------------------------------------------

def root(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def subtree(nodes: Column, node: Column) -> Column:
    """The node itself and everything below it; ``nodes`` may itself be one subtree of a page."""
    return F.slice(nodes, node["node_id"] - root(nodes)["node_id"] + 1, node["subtree_end"] - node["node_id"] + 1)


def find_nodes(nodes: Column, within: Column | None = None, tag: str | None = None, cls: str | None = None,
               id_: str | None = None) -> Column:
    """Nodes by tag name and by substring of class and id, any case; ``within`` limits to one subtree, itself in."""
    pool = nodes if within is None else subtree(nodes, within)

    def hit(n):
        tests = [F.lit(True)]
        if tag is not None:
            tests.append(n["tag"] == tag.lower())
        for attr, part in (("class", cls), ("id", id_)):
            if part is not None:
                tests.append(F.lower(F.coalesce(n["attrs"][attr], F.lit(""))).contains(part.lower()))
        found = tests[0]
        for t in tests[1:]:
            found = found & t
        return found

    return F.filter(pool, hit)


def first_found(nodes: Column, within: Column | None, *selectors: dict) -> Column:
    """Node list of the first selector that finds any; empty when none does."""
    lists = F.array(*[find_nodes(nodes, within, **s) for s in selectors])
    return F.coalesce(F.get(F.filter(lists, lambda x: F.size(x) > 0), F.lit(0)), F.slice(nodes, 1, 0))


def first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def text_of(nodes: Column, node: Column) -> Column:
    """Text of a subtree: own text of each node in document order, blanks dropped, joined by spaces.

    A node's own text comes before that of its children even where the markup interleaves them.
    """
    parts = F.filter(F.transform(subtree(nodes, node), lambda n: n["own_text"]), lambda t: t != "")
    return F.when(node.isNotNull(), F.array_join(parts, " "))


def children(nodes: Column, node: Column, tag: str | None = None) -> Column:
    """Direct children only."""
    def hit(n):
        direct = n["parent_id"] == node["node_id"]
        return direct if tag is None else direct & (n["tag"] == tag.lower())
    return F.filter(subtree(nodes, node), hit)


def attrs_contain(nodes: Column, node: Column, part: str) -> Column:
    """Any attribute value in the subtree contains ``part`` (case matters)."""
    return F.exists(subtree(nodes, node),
                    lambda n: F.exists(F.map_values(n["attrs"]), lambda v: v.contains(part)))


def attr(node: Column, name: str) -> Column:
    return F.coalesce(node["attrs"][name], F.lit(""))


# --- markup without parsing -------------------------------------------------------------------------------------

def _entity_names() -> str:
    """Every named entity and the numbers that browsers read as Windows-1252, as text of a map."""
    known = {name: char for name, char in html5.items()}
    known |= {f"#{n}": bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0)}
    return "\u0002".join(f"{name}\u0001{char}" for name, char in known.items())


ENTITY = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"
_NAMES = _entity_names()


def _entity(found: Column) -> Column:
    """Text of one entity; what names no entity stays as it is."""
    name = F.regexp_extract(found, ENTITY, 1)
    hexed = F.lower(F.substring(name, 2, 1)) == "x"
    number = F.when(hexed, F.conv(F.substring(name, 3, 9), 16, 10)).otherwise(F.substring(name, 2, 12)).try_cast("bigint")

    def of_number(n):
        valid = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        code = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, n).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(names, F.concat(F.lit("#"), n.cast("string"))), code)

    names = F.str_to_map(F.lit(_NAMES), F.lit("\u0002"), F.lit("\u0001"))
    named = F.coalesce(F.try_element_at(names, F.regexp_extract(found, "^&(.*)$", 1)), found)
    return F.when(name.startswith("#"), let(F.coalesce(number, F.lit(0).cast("bigint")), of_number)).otherwise(named)


def unescape_entities(c: Column) -> Column:
    """Named, decimal and hexadecimal entities as text, each once; no-break spaces become spaces.

    Unknown names stay. A text without ``&`` is passed through.
    """
    def decoded(t):
        pieces = F.split(F.regexp_replace(F.translate(t, "\u0001\u0002", "  "), ENTITY, "\u0001$0\u0002"), "\u0001")
        return F.array_join(F.transform(pieces, lambda p: F.when(p.contains("\u0002"), F.concat(
            _entity(F.substring_index(p, "\u0002", 1)), F.substring_index(p, "\u0002", -1))).otherwise(p)), "")

    return let(c, lambda t: F.translate(F.when(t.contains("&"), decoded(t)).otherwise(t), "\u00a0", " "))


def strip_tags(c: Column, unescaper=unescape_entities) -> Column:
    """Plain text of a fragment on one line."""
    plain = unescaper(F.regexp_replace(c, "<[^>]+>", " "))
    return strip(collapse(F.translate(plain, "\u00a0", " ")))


def heading_blocks(c: Column, heading: str = K.HEADING_BLOCK) -> Column:
    """Array of (pos, titre, content): every heading with the markup up to the next one."""
    cut = F.regexp_replace(F.translate(c, "\u0001\u0002", "  "), heading, "\u0001$0\u0002")
    blocks = F.transform(let(F.split(cut, "\u0001"), lambda x: F.slice(x, F.lit(2), F.size(x))), lambda p, i: F.struct(
        i.alias("pos"), strip(collapse(F.regexp_extract(p, heading, 1))).alias("titre"),
        F.substring_index(p, "\u0002", -1).alias("content")))
    return F.filter(blocks, lambda b: b["titre"] != "")


def is_film_block(block: Column) -> Column:
    """Not a section heading, and its content names a director."""
    return ~block["titre"].rlike(K.SECTION_HEADING) & F.lower(block["content"]).contains("réalisé par")


def links(c: Column, site: str | Column, pattern: str = K.FILE_LINK) -> Column:
    """Link targets in page order, each once; a relative one is appended to ``site``."""
    base = site if isinstance(site, Column) else F.lit(site)
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)),
                                        lambda u: F.when(u.startswith("http"), u).otherwise(F.concat(base, u))))


def block_bounds(c: Column, opening: str) -> Column:
    """Array of (pos, start, end) of blocks that run from one opening to the next (0-based offsets, end excluded)."""
    pieces = F.split(F.regexp_replace(F.translate(c, "\u0001", " "), opening, "\u0001$0"), "\u0001")
    ends = F.transform(running_sums(F.transform(pieces, lambda p: F.length(p).cast("bigint"))), lambda n: n.cast("int"))
    return let(ends, lambda x: F.transform(F.slice(x, F.lit(2), F.size(x)), lambda e, i: F.struct(
        i.alias("pos"), F.element_at(x, i + 1).alias("start"), e.alias("end"))))
