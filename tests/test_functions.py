"""One row per documented input form."""
import html
import datetime as dt

import pytest
from pyspark.sql import functions as F

from marquee.functions import calendar as C, dates as D, html as H, text as X
from marquee.functions.missing import first_present, is_missing

d = dt.date.fromisoformat


def values(spark, expr, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, s string").coalesce(1)
    return [r.r for r in df.select("i", expr(F.col("s")).alias("r")).orderBy("i").collect()]


CASES = {
    "date_fr": (lambda c: D.date_fr(c, "2026-03-01"), {
        "Mercredi 12 mars": d("2026-03-12"), "12 mars 2025": d("2025-03-12"), "12/03/2025": d("2025-03-12"), "12 février 2026": d("2026-02-12"),
        "12 FÉVRIER 2026": d("2026-02-12"), "salle 2 mercredi 12 mars 2025": d("2025-03-12"), "31 février 2026": None, "12 fevrier 2026": None, "bonjour": None, "13/13/2025": None}),
    "heure": (D.heure, {"14h30": "14:30", "14:30": "14:30", "14H30": "14:30", "14 h 30": "14:30", "9h": "09:00", "14h à": None, "99h99": "99:99"}),
    "version": (X.version_code, {"VOSTFR": "VOSTFR", "vost": "VOSTFR", "VOST / VFST": "VOSTFR", "VFST": "VFST", "VO": "VO", "VOIX OFF": "VO", "VF": "VF", "": "VF"}),
    "version_from_prose": (X.version_from_prose, {"Film sous-titré": "VOSTFR", "en vo": "VO", "vo, version française": "VF", "voix": "VF"}),
    "title_key": (X.title_key, {"  Le  Son\tdes Souvenirs ": "le son des souvenirs", None: ""}),
    "slugify": (X.slugify, {"Le Comoedia": "comoedia", "Lumière Fourmi": "lumiere-fourmi", "Pathé Bellière": "pathé-belliere"}),
    "url_quote": (X.url_quote, {"Le son é/&": "Le%20son%20%C3%A9%2F%26", "a*b~c": "a%2Ab~c"}),
    "ellipsize": (X.ellipsize, {"x" * 500: "x" * 500, "x" * 501: "x" * 500 + "…"}),
    "duration_prose": (D.duration_prose, {"durée de 1h39": 99, "d'une durée de 43 minutes": 43}),
    "duration": (D.duration_minutes, {"2h29": 149, "90 min": 90, "1 h 05": 65, "long": None}),
    "year": (D.year_in, {"États-Unis | VOSTF | 2026 | 2h29": 2026, "1850": None}),
    "actors": (lambda c: X.without_lead(c, "Avec"), {"Avec A, B": "A, B", "avec C": "C"}),
    "director": (X.director_lead, {"de Jean Dupont · 2h": "Jean Dupont", "De Ab": "De Ab", "x": None}),
    "href_slug": (X.href_slug, {"/film/alter-ego.html?x": "alter-ego", "/film/alter-ego": "alter-ego", "/autre": None}),
    "time_seconds": (D.time_seconds, {"20:50": "20:50:00", "20:50:00": "20:50:00"}),
    "year_number": (X.year_number, {"2019–2021": 2019, "N/A": None}),
    "rating_number": (X.rating_number, {"7.4": 7.4, "N/A": None}),
    "split_list": (X.split_list, {"Drama, Comedy ,War": ["Drama", "Comedy", "War"]}),
    "version_token": (lambda c: X.version_code(X.version_token(c)), {"VF / INT -12": "VF", "VOST INT": "VOSTFR", "VO ANS": "VO"}),
    "iso_date": (D.iso_date, {"2026-03-01": d("2026-03-01"), "2026-3-1": None, "2026-02-30": None}),
    "strip_tags": (H.strip_tags, {"<p>a&nbsp;&amp;lt;  b</p><br>c": "a &lt; b c"}),
}


@pytest.mark.parametrize("name", CASES)
def test_scalar(spark, name):
    expr, cases = CASES[name]
    assert values(spark, expr, list(cases)) == list(cases.values())


def test_slice_timestamp(spark):
    got = values(spark, D.slice_timestamp, ["2026-03-11 14:10:00", "2026-03-11", "2026-13-11 14:10:00"])
    assert (got[0].date, got[0].heure) == (d("2026-03-11"), "14:10") and got[1:] == [None, None]


def test_slug_week(spark):
    got = values(spark, D.slug_week, ["x/semaine-du-8-au-14-octobre-2025.pdf", "x/semaine-du-26-novembre-au-2-décembre-2025.pdf?x=1",
                                      "x/semaine-du-31-decembre-au-6-janvier-2026.pdf", "x/0b1c.pdf", "x/semaine-du-30-fevrier-au-5-mars-2026.pdf"])
    assert [tuple(g) if g else None for g in got] == [(d("2025-10-08"), d("2025-10-14")), (d("2025-11-26"), d("2025-12-02")),
                                                      (d("2025-12-31"), d("2026-01-06")), None, None]


def test_weekly_url_round_trip(spark):
    """Every Wednesday of 1995-2030 survives address and back."""
    weeks = spark.sql("SELECT explode(sequence(date'1995-01-04', date'2030-12-25', interval 7 days)) AS w")
    back = weeks.select("w", D.slug_week(D.weekly_url(F.col("w"), "https://cinema.example")).alias("b"))
    assert back.filter("NOT (b.start <=> w AND b.end <=> date_add(w, 6))").count() == 0


def test_week_anchor(spark):
    got = values(spark, lambda c: D.week_anchor(c.cast("date")), ["2026-03-16", "2026-03-17", "2026-03-18"])
    assert got == [d("2026-03-11"), d("2026-03-18"), d("2026-03-18")]


def test_week_map(spark):
    plain = values(spark, D.week_map, ["Du 4 au 10 mars 2026", "Du 30 au 5 avril 2026", "rien"])
    assert plain[0] == {3: d("2026-03-04"), 4: d("2026-03-05"), 5: d("2026-03-06"), 6: d("2026-03-07"), 7: d("2026-03-08"), 1: d("2026-03-09"), 2: d("2026-03-10")}
    assert (min(plain[1].values()), max(plain[1].values())) == (d("2026-03-30"), d("2026-04-05")) and plain[2] is None
    kept = values(spark, lambda c: D.week_map(c, faithful=True), ["Du 30 au 5 avril 2026"])[0]
    assert (min(kept.values()), max(kept.values())) == (d("2026-04-30"), d("2026-05-05"))


def test_missing(spark):
    df = spark.sql("SELECT 0.0D AS a, 7.1D AS b, '' AS s, array() AS e")
    row = df.select(first_present("number", F.col("a"), F.col("b")).alias("x"), is_missing(F.col("s")).alias("s"), is_missing(F.col("e"), "array").alias("e")).first()
    assert (row.x, row.s, row.e) == (7.1, True, True)


def test_top_names(spark):
    df = spark.sql("SELECT array(named_struct('name','A'), named_struct('name',''), named_struct('name','C'), named_struct('name','D')) AS c")
    assert df.select(X.top_names(F.col("c")).alias("n")).first().n == "A, C"


WEEK = "Du 4 au 10 mars 2026"
SENTENCES = {
    "Séances prévues mercredi, samedi 11h15, 13h35": ["03-04 11:15", "03-04 13:35", "03-07 11:15", "03-07 13:35"],
    "Séances prévues tous les jours à 20h50": [f"03-{i:02d} 20:50" for i in range(4, 11)],
    "tous les jours sauf dimanche à 14h00, et dimanche à 11h00": [f"03-{i:02d} {'11' if i == 8 else '14'}:00" for i in range(4, 11)],
    "Séances prévues Mercredi 4 mars à 14h00": ["03-04 14:00"],
    "mercredi 11h00 et jeudi 14h00": ["03-04 11:00", "03-04 14:00", "03-05 11:00", "03-05 14:00"],
}


def test_calendar(spark):
    def slots(c, week, faithful=False):
        s = C.screenings(C.calendar_slots(c, week, "2026-03-01", faithful), F.lit("VF"))
        return F.transform(s, lambda x: F.concat_ws(" ", F.date_format(x["date"], "MM-dd"), x["heure"]))
    week = D.week_map(F.lit(WEEK))
    assert values(spark, lambda c: slots(c, week), list(SENTENCES)) == list(SENTENCES.values())
    both = values(spark, lambda c: slots(c, week, True), ["tous les jours sauf dimanche à 14h00, et dimanche à 11h00"])[0]
    assert len(both) == 14
    assert values(spark, lambda c: slots(c, D.week_map(F.lit("rien"))), ["mercredi 11h00"]) == [[]]


def test_entities_as_the_standard_library_reads_them(spark):
    texts = ["Op&eacute;ra d&rsquo;&eacute;t&eacute; &#233; &#xE9; &#XE9 &hellip;", "a &amp;lt; b &amp;amp; c", "&unknown; & &; &#; &#x; &#0; &#55296; &#1114112;", "&#128;&#153; &copy 2020 &lt&gt;",
             "&NotEqualTilde;&fjlig;", "plain", "", None, "&#128512;" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)
    got = {r.i: r.x for r in df.select("i", H.unescape_entities(F.col("t")).alias("x")).collect()}
    assert got == {i: t if t is None else html.unescape(t).replace("\u00a0", " ") for i, t in enumerate(texts)}


def test_bounds_of_many_blocks(spark):
    df = spark.sql("SELECT concat('head', array_join(transform(sequence(1, 1000), i -> concat('<p>', repeat('x', i % 7))), '')) AS t")
    found = df.select(F.explode(H.block_bounds(F.col("t"), "<p>")).alias("b")).select("b.*").orderBy("pos").collect()
    at = 4
    for i, b in enumerate(found):
        assert (b.pos, b.start, b.end) == (i, at, at + 3 + (i + 1) % 7)
        at = b.end
    assert len(found) == 1000
