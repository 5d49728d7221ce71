"""Selection while parsing against the node outline, the outline's scanner against the standard library's parser, rule tables."""
import random

import pytest
from pyspark.sql import functions as F

from marquee import schema
from marquee.functions import html as H, shapes as S
from marquee.operators import documents as O, extract as X
from marquee.operators.extract import Rule

PLAIN = ["<p>", "</p>", '<div class="a b">', "</div>", "<div id='x' class='A'>", "<br>", "<br/>", "<a href=x>", '<a href="/q">', "</a>", "text", "&amp;", "<td>", "</td>", "<td class=b>", "</tr>",
         "<tr>", "<img src=x class=b>", " t ", "<b>", "</b>", "<svg><use xlink:href='#a'></use></svg>", "<!-- c -->", "<!DOCTYPE html>", "<script>var a='</p>';</script>", "<title>x</title>",
         "<P a=1 A=2>", "<p a>", "<style>a{}</style>"]
ODD = ["&lt", "&", "<", "< ", "</", "<!--x--!>", "<!-->", "<![CDATA[x]]>", "<?pi x>", "<script>", "</script >", "<title>a<b>c</title>", "<textarea><p></textarea>", '<p a ="1">', "<p a='>'>",
       '<p a=">" b>', '<p a=">', "</p x>", "</ p>", "<p\n>", "<p 1a=2>", "<p a=b/c>", "<x-y z>", "<a href='x&amp;y'>", '<a href="/q?a=1&b">']


def events(markup):
    parser = H._Events()
    parser.feed(markup)
    return parser.events


def joined(found):
    """Neighbouring data as one."""
    out = []
    for kind, what, attrs in found:
        if kind == H.DATA and out and out[-1][0] == H.DATA:
            out[-1] = (kind, out[-1][1] + what, None)
        else:
            out.append((kind, what, attrs))
    return out


def test_scanner_reads_pages_as_the_standard_parser():
    rng = random.Random(0)
    plain = 0
    for _ in range(6000):
        markup = "".join(rng.choice(PLAIN if rng.random() < 0.9 else ODD) for _ in range(rng.randint(1, 12)))
        fast = H._plain_events(markup)
        plain += fast is not None
        assert joined(H.page_events(markup)) == joined(events(markup)), markup
    assert plain > 1000


def subtree(nodes, n):
    return nodes[n["node_id"]:n["subtree_end"] + 1]


def brute(nodes, within, shape):
    out = []
    for n in subtree(nodes, within)[1:]:
        attrs = n["attrs"]
        if (shape.tag and n["tag"] != shape.tag or shape.cls and shape.cls.lower() not in attrs.get("class", "").lower()
                or shape.id_ and shape.id_.lower() not in attrs.get("id", "").lower() or shape.direct and n["parent_id"] != within["node_id"]):
            continue
        record = {"node_id": n["node_id"]}
        if shape.text:
            record["text"] = " ".join(x["own_text"] for x in subtree(nodes, n) if x["own_text"])
        record |= {a: attrs.get(a) for a in shape.attrs}
        if shape.marks:
            record["marked"] = [m for m in shape.marks if any(m in v for x in subtree(nodes, n) for v in x["attrs"].values())]
        record |= {name: brute(nodes, n, part) for name, part in shape.parts.items()}
        out.append(record)
        if shape.first:
            break
    return out


def test_records_are_those_of_the_outline():
    parts = {"divs": S.Shape("div", "a", text=True, marks=("q", "#a"), parts={
                 "tds": S.Shape("td", direct=True, parts={"any": S.Shape(None, "b", attrs=("class", "src")), "a": S.Shape("a", first=True, text=True, attrs=("href",))}),
                 "inner": S.Shape("div", id_="X", text=True)}),
             "p": S.Shape("p", direct=True, text=True), "tr": S.Shape("tr", first=True, parts={"td": S.Shape("td", text=True, marks=("b",))}), "img": S.Shape("img", text=True, marks=("x", "b"))}
    rng = random.Random(1)
    for _ in range(4000):
        markup = "".join(rng.choice(PLAIN) for _ in range(rng.randint(1, 25)))
        nodes = [{**n, "attrs": dict(n["attrs"])} for n in H._outline(markup)]
        assert S.records(markup, S.plans(parts)) == {name: brute(nodes, nodes[0], shape) for name, shape in parts.items()}, markup


def test_calendar_films_of_shapes_and_nodes(spark):
    time = '<time datetime="2026-03-11 {}:00" class="session x">t<div class="Version">{}</div></time>'
    table = ('<table><tr><td>x</td></tr></table><table><tr class="days cinema"></tr><tr class="movie"><th><a href="/film/un.html"> Un </a></th><td class="schedule">' + time.format("20:00", "VF")
             + time.format("18:00", "VOST") + '</td><td>' + time.format("10:00", "VF") + '</td></tr><tr class="cinema"><th>Salle Bellecour</th></tr><tr class="movie"><th>Deux</th><td class="schedule">'
             '<a href="https://x/BILLET">r</a><time class="session">no date</time>' + time.format("21:00", "") + '</td></tr><tr class="cinema"><th><svg><use href="#fourmi"></use></svg></th></tr>'
             '<tr class="movie"><th>x</th><td class="schedule">' + time.format("20:00", "VF") + '</td></tr><tr class="movie"></tr></table>')
    pages = spark.createDataFrame([(1, table), (2, ""), (3, None), (4, "<p>no table</p>"), (5, "<table></table>")], "page_id int, html string")
    columns = ["page_id", "row_no", "cinema", "titre", "slug", "seances"]
    new = O.calendar_page_films(pages).select(*columns).collect()
    old = O.calendar_films(O.calendar_rows(H.parse_pages(pages))).select(*columns).collect()
    assert sorted(new) == sorted(old) and [(r.titre, r.cinema, len(r.seances)) for r in sorted(new)] == [("Un", "Lumière Terreaux", 2), ("Deux", "Lumière Bellecour", 1)]


RULES = [Rule("a", "title", 2, "h1"), Rule("a", "title", 1, "h2", post="strip"), Rule("a", "title", 1, "h3"), Rule("a", "link", 1, "a", attr="href", post="web address"),
         Rule("b", "title", 1, "title"), Rule("b", "image", 1, "img", attr="data-src", within_tag="figure", within_cls="poster"), Rule("b", "text", 1, "p", "lead"), Rule("b", "text", 2, "p")]


def test_first_hit_by_priority_and_place(spark):
    rows = [("a", 1, "<h1>one</h1><h3>three</h3><h2> two </h2><a href='/x'>"), ("a", 2, "<h1>only</h1><a href='http://y'>z</a><a href='http://w'>"), ("b", 3, "<title>t</title><h2>no</h2>"),
            ("b", 4, "<img data-src='1'><figure class='x Poster'><p><img data-src='2'><img data-src='3'></p></figure><p>second</p><p class=lead></p>"), ("c", 5, "<h1>unknown kind</h1>"), ("a", 6, None)]
    pages = spark.createDataFrame(rows, "kind string, page_id int, html string")
    got = {(r.page_id, r.field): r.value for r in X.extract_fields(pages, spark.createDataFrame(RULES, schema.RULE)).collect()}
    assert got == {(1, "title"): "three", (2, "title"): "only", (2, "link"): "http://y", (3, "title"): "t", (4, "image"): "2", (4, "text"): ""}
    with pytest.raises(ValueError):
        X.extract_fields(pages, spark.createDataFrame([Rule("a", "x", 1, "p", post="nothing known")], schema.RULE))
    assert X.extract_fields(pages.filter(F.lit(False)), spark.createDataFrame(RULES, schema.RULE)).count() == 0
