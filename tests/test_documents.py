"""Grids, pages and text blocks."""
import datetime as dt

from pyspark.sql import functions as F

from marquee.functions import grid as G, html as H, records as R
from marquee.operators import documents as O, profile as P

d = dt.date.fromisoformat
DAYS = ["MERCREDI. 11", "JEUDI. 12", "VENDREDI. 13", "SAMEDI. 14", "DIMANCHE. 15", "LUNDI. 16", "MARDI. 17"]
ROWS = [
    ["PROGRAMME"] + [None] * 7, [""] + DAYS,
    ["ALTER EGO\nVF", "11h15 / 13h35\n15h50", "-", "20h001", None, "11h15 11h15", "", "-"],
    ["DEUX FEMMES ET QUELQUES\nHOMMES\nVFST", "-", "18h00"],
    ["FILM ENFANT JP\nVF / DÈS 6 ANS", "10h00", "-", "-", "-", "-", "-", "-"],
    ["SANS SEANCE\nVO", "-", "-", "-", "-", "-", "-", "-"],
    ["-", "10h00", "", "", "", "", "", ""],
    ["VO\nVF", "10h00", "", "", "", "", "", ""],
]


def grid(spark, rows, doc="g"):
    df = spark.createDataFrame([(doc, i, r) for i, r in enumerate(rows)], "doc_id string, row_no int, cells array<string>")
    return O.collect_grid(df)


def test_grid_films(spark):
    films = O.grid_films(grid(spark, ROWS), "2026-03-20").orderBy("row_no").collect()
    got = [(f.titre, f.version, [f"{s.date:%m-%d} {s.heure}" for s in f.seances]) for f in films]
    assert got == [("ALTER EGO", "VF", ["03-11 11:15", "03-11 13:35", "03-11 15:50", "03-13 20:00", "03-15 11:15"]),
                   ("DEUX FEMMES ET QUELQUES HOMMES", "VFST", ["03-12 18:00"]), ("FILM ENFANT", "VF", ["03-11 10:00"])]


def test_grid_dates(spark):
    first = lambda rows, run, start=None: [x.date for x in O.grid_columns(grid(spark, rows), run, F.lit(start).cast("date")).first().dates]
    assert first(ROWS, "2026-03-20") == [d(f"2026-03-{i}") for i in range(11, 18)]
    assert first(ROWS, "2026-03-20", "2026-04-01")[0] == d("2026-04-01")
    bare = [[""] + [x.split(".")[0] for x in DAYS]]
    assert first(bare, "2026-03-20")[0] == d("2026-03-18")
    short = [["", "mer", "jeu", "ven", "sam"]]
    assert first(short, "2026-03-20") == [d(f"2026-03-{i}") for i in range(18, 22)]
    # Wednesday the 11th is as far back as ahead in February and March 2026: the earlier one wins
    assert first(ROWS, "2026-02-25")[0] == d("2026-02-11")


def test_grid_without_header(spark):
    rows = [["", "MERCREDI. 11", "JEUDI. 12", "VENDREDI. 13"], ["A\nVF", "10h00", "-", "-"]]
    assert O.grid_films(grid(spark, rows), "2026-03-20").count() == 0


def test_two_footnote_digits_lose_the_time(spark):
    df = spark.createDataFrame([("20h0012",), ("20h001",)], "c string")
    assert [r.t for r in df.select(G.cell_times(F.col("c")).alias("t")).collect()] == [[], ["20:00"]]


def test_line_blocks(spark):
    lines = ["12h00", "FILM UN"] + [f"{h}h00" for h in range(10, 24)] + ["FILM DEUX", "VF", "Mercredi jeudi vendredi samedi", "11h00", "mer jeu ven sam 10h00"]
    df = spark.createDataFrame([("\n".join(lines),)], "t string")
    got = [(b.head, len(b.lines)) for b in df.select(O.line_blocks(F.col("t")).alias("b")).first().b]
    assert got == [("FILM UN", 12), ("FILM DEUX", 2), ("Mercredi jeudi vendredi samedi", 1), ("mer jeu ven sam 10h00", 1)]


PAGE = """<table><tr><td>x</td></tr></table><table class="schedule">
 <tr class="days"><td></td><th class="day-title"><time datetime="2026-03-11 00:00:00">mer</time></th></tr>
 <tr class="movie"><th class="movie-title"><a href="/film/a.html">A</a></th><td class="schedule"></td></tr>
 <tr class="movie"><th class="movie-title"><a href="/film/b.html">BB</a></th>
  <td class="schedule"><a href="https://x.cotecine.example/1">resa</a>
   <time datetime="2026-03-11 20:50:00" class="session x">20h50<div class="version">VOST</div></time>
   <time datetime="2026-03-11 18:00:00" class="session">18h00</time>
   <time datetime="2026-03-11 10:00:00" class="other">10h00</time></td></tr>
 <tr class="cinema striped"><th><svg><use xlink:href="#logo-bellecour"></use></svg></th></tr>
 <tr class="movie"><th><a href="/film/b.html">BB</a></th><td class="schedule"><time datetime="2026-03-12 14:00:00" class="session">14h</time></td></tr>
 <tr class="cinema"><th>Autre salle</th></tr>
 <tr class="movie"><th>C</th><td class="schedule"><time datetime="2026-03-12 16:00:00" class="session">16h</time></td></tr>
 <tr class="movie"><th>CC</th><td class="schedule"><time datetime="2026-03-12 16:00:00" class="session">16h</time></td></tr>
</table>"""


def parsed(spark, *pages):
    return H.parse_pages(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string"))


def test_calendar_page(spark):
    films = O.calendar_films(O.calendar_rows(parsed(spark, PAGE, "<p>no table</p>"))).orderBy("row_no").collect()
    got = [(f.titre, f.slug, f.cinema, [(f"{s.date:%m-%d} {s.heure}", s.version, s.resa_url) for s in f.seances]) for f in films]
    link = "https://x.cotecine.example/1"
    assert got == [("BB", "b", "Lumière Terreaux", [("03-11 18:00", "VF", link), ("03-11 20:50", "VOSTFR", link)]),
                   ("BB", "b", "Lumière Bellecour", [("03-12 14:00", "VF", None)]), ("CC", None, "Lumière Bellecour", [("03-12 16:00", "VF", None)])]


def test_detail_page(spark):
    html = ("""<figure class="poster"><img data-src="https://p/x.jpg"></figure><p class="filmmakers">de Ana Nom</p>"""
            """<p class="informations">États-Unis | VOSTF | 2026 | 2h29</p><p class="actors">Avec A, B</p><div class="section synopsis"><p>Texte.</p></div>""")
    rows = parsed(spark, html, "<p>rien</p>").select("page_id", R.detail_page(F.col("nodes")).alias("d")).orderBy("page_id").collect()
    assert tuple(rows[0].d) == ("https://p/x.jpg", "Ana Nom", 2026, 149, "A, B", "Texte.") and not any(rows[1].d)


def test_nodes(spark):
    nodes = parsed(spark, "<p><b>x<br><p>y</p>", '<a class="One" class="two" hidden>t</a></div>').orderBy("page_id").collect()
    assert [n.tag for n in nodes[0].nodes] == ["root", "p", "b", "br", "p"]
    assert nodes[1].nodes[1].attrs == {"class": "two", "hidden": ""}


def test_own_text_comes_first(spark):
    row = parsed(spark, "<div>a<b>b</b>c</div>").select(H.text_of(F.col("nodes"), H.root(F.col("nodes"))).alias("t")).first()
    assert row.t == "ac b"


def test_heading_page(spark):
    html = ("<h2>Du 4 au 10 mars 2026</h2><h5>Films français</h5><p>Réalisé par X</p><h5>Un <b>film</b></h5><h5> Mon  film </h5><p>Réalisé par Ana Nom, avec B.</p>"
            "<p>Film produit en France en 2025, d'une durée de 43 minutes. Version sous-titrée.</p><p>Séances prévues samedi 11h15</p><h5>Débat</h5><p>rien</p>")
    films = O.heading_films(spark.createDataFrame([(1, html)], "page_id int, html string"), "2026-03-01").collect()
    assert [(f.titre, f.realisateur, f.duree, f.annee, f.version) for f in films] == [("Mon film", "Ana Nom", 43, 2025, "VOSTFR")]
    assert [(s.date, s.heure) for s in films[0].seances] == [(d("2026-03-07"), "11:15")]


def test_profiles(spark):
    df = spark.createDataFrame([(1, '<div class="film-vo vostfr x"><p><br></div><p> 14h30 <b>a</b></p>')], "page_id int, html string")
    assert {r["class"]: r.n for r in P.class_histogram(df).collect()} == {"film-vo": 2, "vostfr": 2}
    assert [(r.depth, r.tag, r.n) for r in P.tag_profile(df).orderBy("rank").collect()] == [(0, "div", 1), (1, "p", 1), (2, "br", 1), (2, "p", 1), (3, "b", 1)]
    ctx = df.select(P.match_contexts(F.col("html")).alias("c")).first().c
    assert len(ctx) == 1 and "14h30 a" in ctx[0].context
