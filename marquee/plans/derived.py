"""Inputs the test tables do not hold, built from whole test tables with Spark so that they grow with them.

Stand-ins: film = part brand, cinema = supplier, screening = line item (date = ship date, hour = 10 + line number,
minute = quantity, version = return flag).
"""
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates as D
from ..functions.binding import let
from ..operators.calendar import in_week
from ..operators.skew import spread_lookup, spread_rows
from .registry import Tables

RUN_DATE = "1997-03-12"
RUN_TS = "1997-03-12T01:00:00"
SITE = "https://cinema.example"
VERSION_OF = {"A": "VF", "N": "VOST", "R": "VO"}


def version_text(flag: Column) -> Column:
    """Version as written in documents."""
    return F.when(flag == "A", "VF").when(flag == "N", "VOST").otherwise("VO")


def day_of(ts: Column) -> Column:
    return ts.cast("date")


def start_time(sep: str = "h") -> Column:
    return F.concat((F.col("l_linenumber") + 10).cast("string"), F.lit(sep),
                    F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0"))


def screenings(t: Tables) -> DataFrame:
    """Line items as screenings: suppkey, partkey, date, heure, version, slot order."""
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day_of(F.col("l_shipdate")).alias("date"),
        start_time(":").alias("heure"), version_text(F.col("l_returnflag")).alias("version"), start_time().alias("printed"))


def brand_screenings(t: Tables) -> DataFrame:
    """Screenings with the brand of their part."""
    return spread_lookup(screenings(t), t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), ["l_partkey"],
                         "inner", spread_by=["l_orderkey", "l_linenumber"])


def date_text(t: Tables) -> DataFrame:
    """DI1: order dates in three French forms."""
    d = day_of(F.col("o_orderdate"))
    words = F.concat_ws(" ", F.dayofmonth(d).cast("string"), D.month_name(d), F.year(d).cast("string"))
    form = F.col("o_orderkey") % 3
    return t.orders.select("o_orderkey", F.when(form == 0, words).when(form == 1, F.date_format(d, "dd/MM/yyyy"))
                           .otherwise(F.concat(D.weekday_name(d), F.lit(" "), words)).alias("txt"))


def time_text(t: Tables) -> DataFrame:
    """DI2: event times in four written forms."""
    h, m, form = F.date_format("ts", "HH"), F.date_format("ts", "mm"), F.col("event_id") % 4
    return t.events.select("event_id", F.when(form == 0, F.concat(h, F.lit("h"), m)).when(form == 1, F.concat(h, F.lit(":"), m))
                           .when(form == 2, F.concat(h, F.lit(" h "), m)).otherwise(F.concat(h, F.lit("h"))).alias("txt"))


def week_text(t: Tables) -> DataFrame:
    """DI3: the programme week of every order as an announcement; the month is that of the last day."""
    a = D.week_anchor(day_of(F.col("o_orderdate")))
    end = F.date_add(a, 6)
    return t.orders.select("o_orderkey", F.concat(
        F.lit("Du "), F.dayofmonth(a).cast("string"), F.lit(" au "), F.dayofmonth(end).cast("string"), F.lit(" "),
        D.month_name(end), F.lit(" "), F.year(end).cast("string")).alias("txt"))


def grids(t: Tables) -> DataFrame:
    """DI4: one printed grid per supplier and programme week: title cells by brand and version, one column per day.

    A grid holds at most (brands x versions x days x times) distinct entries, whatever the table size.
    """
    rows = brand_screenings(t).withColumn("week", D.programme_week(F.col("date")))
    entry = F.struct("p_brand", "version", F.datediff("date", "week").alias("col"),
                     F.concat("printed", F.when(F.col("l_linenumber") == 7, "1").otherwise("")).alias("time"))
    docs = rows.groupBy("l_suppkey", "week").agg(F.array_sort(F.collect_set(entry)).alias("e"))

    def line(e, k):
        mine = F.filter(e, lambda x: (x["p_brand"] == k["p_brand"]) & (x["version"] == k["version"]))
        head = F.concat(F.upper(k["p_brand"]), F.lit(" JP\n"), k["version"], F.lit(" / INT -12"))
        days = let(mine, lambda m: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda j: F.coalesce(F.nullif(F.array_join(
            F.transform(F.filter(m, lambda x: x["col"] == j), lambda x: x["time"]), " / "), F.lit("")), F.lit("-"))))
        return F.concat(F.array(head), days)

    def lines(e):
        titles = F.array_distinct(F.transform(e, lambda x: F.struct(x["p_brand"], x["version"])))
        return F.transform(titles, lambda k: line(e, k))

    names = F.array(*map(F.lit, ["MERCREDI", "JEUDI", "VENDREDI", "SAMEDI", "DIMANCHE", "LUNDI", "MARDI"]))
    header = F.concat(F.array(F.lit("")), F.transform(names, lambda n, i: F.concat(
        n, F.lit(". "), F.dayofmonth(F.date_add("week", i)).cast("string"))))
    top = F.array(F.lit("PROGRAMME"), F.lit(None).cast("string"))
    return docs.select("l_suppkey", "week", F.concat(F.array(top, header), let(F.col("e"), lines)).alias("grid"))


def calendar_text(t: Tables) -> DataFrame:
    """DI5: a screening sentence per order: two weekdays (or every day, or all but Sunday) and two times."""
    d = day_of(F.col("o_orderdate"))
    a = D.week_anchor(d)
    k = F.col("o_orderkey")
    day = lambda n: F.element_at(F.array(*map(F.lit, D.K.WEEKDAYS)), (n % 7 + 1).cast("int"))
    hour = lambda n: F.concat((n % 12 + 10).cast("string"), F.lit("h"), F.lpad((n % 60).cast("string"), 2, "0"))
    two = F.concat(F.lit("Séances prévues "), day(k), F.lit(", "), day(k + 3), F.lit(" "), hour(k), F.lit(", "), hour(k + 5))
    every = F.concat(F.lit("Séances prévues tous les jours à "), hour(k))
    but = F.concat(F.lit("Séances prévues tous les jours sauf dimanche à "), hour(k), F.lit(", et dimanche à "), hour(k + 5))
    text = F.when(k % 3 == 0, two).when(k % 3 == 1, every).otherwise(but)
    return t.orders.select("o_orderkey", a.alias("week"), text.alias("txt"), F.map_from_entries(F.transform(
        F.array(*[F.lit(i) for i in range(7)]), lambda i: F.struct(D.iso_weekday(F.date_add(a, i)), F.date_add(a, i)))).alias("days"))


def duration_text(t: Tables) -> DataFrame:
    """DI6: part sizes plus an hour, as ``1h39`` or ``99 minutes``."""
    total = F.col("p_size") + 60
    hours = F.concat(F.floor(total / 60).cast("string"), F.lit("h"), F.lpad((total % 60).cast("string"), 2, "0"))
    return t.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, hours)
                         .otherwise(F.concat(total.cast("string"), F.lit(" minutes"))).alias("txt"))


def calendar_pages(t: Tables) -> DataFrame:
    """DI7: one calendar page per supplier and programme week.

    Four sections: none yet, one known by a marker in an attribute, one known by text, one unknown. A brand has one row
    per section with one cell per day; cells of the third section carry a booking link.
    """
    rows = brand_screenings(t).withColumns({"week": D.programme_week(F.col("date")), "section": F.col("l_linenumber") % 4})
    shown = F.struct("section", "p_brand", "date", "printed", "version", "heure")
    docs = rows.groupBy("l_suppkey", "week").agg(F.array_sort(F.collect_set(shown)).alias("e"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    joined = lambda a: F.array_join(a, "")

    def time(x):
        return text('<time datetime="', x["date"].cast("string"), " ", x["heure"], ':00" class="session x">', x["printed"],
                    '<div class="dropdown"><div class="version">', x["version"], "</div></div></time>")

    def cell(mine, day):
        link = F.when(F.get(mine, F.lit(0))["section"] == 2, '<a href="https://x.cotecine.example/1">resa</a>').otherwise("")
        return text('<td class="schedule">', link, joined(F.transform(F.filter(mine, lambda x: x["date"] == day), time)), "</td>")

    def movie(mine):
        brand = F.get(mine, F.lit(0))["p_brand"]
        days = F.array_distinct(F.transform(mine, lambda x: x["date"]))
        return text('<tr class="movie"><th class="movie-title"><a href="/film/', F.lower(F.replace(brand, F.lit("#"), F.lit("-"))),
                    '.html?week=1">', brand, "</a></th>", joined(F.transform(days, lambda d: cell(mine, d))), "</tr>")

    def section(e, number):
        here = F.filter(e, lambda x: x["section"] == number)
        brands = lambda h: F.array_distinct(F.transform(h, lambda x: x["p_brand"]))
        return let(here, lambda h: joined(F.transform(brands(h), lambda b: let(
            F.filter(h, lambda x: x["p_brand"] == b), movie))))

    def body(e):
        return text(section(e, 0), '<tr class="cinema striped"><th><svg><use xlink:href="/i.svg#logo-fourmi"></use></svg></th></tr>',
                    section(e, 1), '<tr class="cinema"><th>Salle BELLECOUR</th></tr>', section(e, 2),
                    '<tr class="cinema"><th>Autre salle</th></tr>', section(e, 3))

    days = joined(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: text(
        '<th class="day-title"><time datetime="', F.date_add("week", i).cast("string"), ' 00:00:00">j</time></th>')))
    html = text('<html><body><table class="small"><tr><td>x</td></tr></table><table class="schedule"><tr class="days"><td></td>',
                days, "</tr>", let(F.col("e"), body), "</table></body></html>")
    return docs.select("l_suppkey", "week", html.alias("html"))


def works(t: Tables) -> DataFrame:
    """Parts as works to match: some know an imdb id, some an original title, some no year."""
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("work_id"), F.when(k % 11 == 0, F.concat(F.lit("fr "), "p_name")).otherwise(F.col("p_name")).alias("titre"),
        F.when(k % 5 == 0, F.concat(F.lit(" "), F.upper("p_name"))).when(k % 5 == 1, F.lit("")).alias("titreOriginal"),
        F.when(k % 3 > 0, F.col("p_size") % 10 + 1990).alias("annee"),
        F.when(k % 7 == 0, F.concat(F.lit("tt"), (k % 50).cast("string"))).alias("imdbId"))


def own_fields(t: Tables) -> DataFrame:
    """Works with the fields they already know."""
    k = F.col("p_partkey")
    known = t.part.select(
        k.alias("work_id"), F.when(k % 4 == 0, F.lit("own.jpg")).otherwise(F.lit("")).alias("poster"),
        F.when(k % 6 == 0, F.lit("own text")).alias("synopsis"), F.when(k % 9 == 0, 5.5).otherwise(0.0).alias("imdbRating"),
        F.lit(None).cast("string").alias("cast"), F.when(k % 8 == 0, "own name").otherwise("").alias("realisateur"),
        F.when(k % 10 == 0, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>")).alias("genres"))
    return works(t).join(known, "work_id")


def tmdb(t: Tables) -> DataFrame:
    """DI8, first catalog: one entry per part name and year; names of every third length are not in it."""
    rows = t.part.filter(F.length("p_name") % 3 != 0).groupBy("p_name", (F.col("p_size") % 10 + 1990).alias("year")) \
        .agg(F.min("p_partkey").alias("id"))
    i = F.col("id")
    return rows.select(
        "id", F.when(i % 2 == 0, F.concat(F.lit("tt"), i.cast("string"))).alias("imdb_id"), F.col("p_name").alias("title"), "year",
        F.when(i % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("/"), i.cast("string"), F.lit(".jpg"))).alias("poster_path"),
        F.when(i % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" story of "), "p_name")).alias("overview"),
        ((i * 7 % 100) / 10).cast("double").alias("vote_average"),
        F.array(*[F.struct(F.when((i + n) % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(f"actor {n} "), i.cast("string"))).alias("name"))
                  for n in range(4)]).alias("cast"))


def omdb(t: Tables) -> DataFrame:
    """DI8, second catalog: one entry per part name, all text, N/A for what it does not know."""
    rows = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("i"), F.min(F.col("p_size") % 10 + 1990).alias("y"))
    i = F.col("i")
    na = lambda n, c: F.when(i % n == 0, F.lit("N/A")).otherwise(c)
    return rows.select(
        F.concat(F.lit("tt"), i.cast("string")).alias("imdbID"), F.col("p_name").alias("Title"),
        F.concat(F.col("y").cast("string"), F.when(i % 2 == 0, "–2021").otherwise("")).alias("Year"),
        na(3, F.concat(F.lit("https://img.example/"), i.cast("string"))).alias("Poster"), na(4, F.concat(F.lit("plot of "), "p_name")).alias("Plot"),
        na(5, F.concat(F.lit("director "), i.cast("string"))).alias("Director"), na(6, F.lit("Drama, Comedy ,War")).alias("Genre"),
        na(7, F.concat((i % 9).cast("string"), F.lit(".5"))).alias("imdbRating"), na(8, F.concat(F.lit("star "), i.cast("string"))).alias("Actors"))


def film_rows(t: Tables, run_date=None) -> DataFrame:
    """DI9: nested film rows, one per (brand, supplier, programme week), with their screenings as a list; with a run date
    those of the coming seven days only, cut before they are nested."""
    rows = brand_screenings(t).withColumn("week", D.programme_week(F.col("date")))
    if run_date is not None:
        rows = rows.filter(in_week(F.col("date"), run_date))
    slot = F.struct("date", "heure", "version", F.when(F.col("version") == "VO", F.lit("https://x.example/r")).alias("resa_url"))
    nested = rows.groupBy("p_brand", "l_suppkey", "week").agg(F.array_sort(F.collect_set(slot)).alias("seances"))
    return nested.select(
        F.col("p_brand").alias("titre"), F.lit(None).cast("string").alias("titreOriginal"),
        (F.col("l_suppkey") % 20 + 1990).cast("int").alias("annee"), F.lit(None).cast("string").alias("realisateur"),
        F.lit(None).cast("int").alias("duree"), F.array().cast("array<string>").alias("genres"),
        F.lit("grid").alias("source"), F.concat(F.lit("Salle "), F.col("l_suppkey").cast("string")).alias("cinema"),
        "week", "seances")


def blocks(t: Tables) -> DataFrame:
    """Heading blocks of prose, one page per part, for the record rules."""
    k = F.col("p_partkey")
    length = F.when(k % 2 == 0, F.concat(F.lit("1h"), F.lpad("p_size", 2, "0"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" minutes")))
    prose = F.concat(
        F.lit("<p>Réalisé par Ana "), F.initcap("p_name"), F.lit(", avec B. C</p><p>Film produit en France en "),
        (F.col("p_size") + 1950).cast("string"), F.lit(", d'une durée de "), length, F.lit(". "),
        F.lit("Une histoire longue et simple de "), "p_name", F.lit(" &amp; compagnie</p><p><strong>Séances prévues mercredi, samedi 11h15, 13h35</strong></p>"),
        F.when(k % 3 == 0, "<p>Version sous-titrée</p>").otherwise(""))
    html = F.concat(F.lit("<h2>Du 4 au 10 mars 1998</h2><h5>Films français</h5><p>Réalisé par personne</p><h5 class='t'> "),
                    F.initcap("p_name"), F.lit(" </h5><div>"), prose, F.lit("</div><h5>Soirée</h5><p>débat</p>"))
    return spread_rows(t.part, ["p_partkey"]).select(k.alias("page_id"), html.alias("html"))


def film_nodes(t: Tables) -> DataFrame:
    """Generic film markup, one node per part, for the selector rules."""
    k = F.col("p_partkey")
    html = F.concat(
        F.lit("<article><h3>"), F.initcap("p_name"), F.lit("</h3><em>"), F.upper("p_name"), F.lit("</em><p class='film-info'>De Jean Dupont</p>"),
        F.lit("<p class='film-info'>"), (F.col("p_size") + 1950).cast("string"), F.lit(" - 1 h "), F.lpad("p_size", 2, "0"), F.lit("</p>"),
        F.lit("<div class='synopsis'>Texte "), "p_brand", F.lit("</div><span class='version'>"), F.when(k % 2 == 0, "VOST").otherwise("VF"),
        F.lit("</span><ul><li class='seance'><span class='jour'>mercredi 4 mars 1998</span> <span class='heure'>20h"),
        F.lpad("p_size", 2, "0"), F.lit("</span></li><li class='seance'><time datetime='1998-03-05T10:00'>jeudi</time> 9h05 VO</li>"),
        F.lit("<li class='seance'>complet</li></ul></article>"))
    return spread_rows(t.part, ["p_partkey"]).select(k.alias("page_id"), html.alias("html"))


def detail_pages(t: Tables) -> DataFrame:
    """Detail pages, one per part."""
    k = F.col("p_partkey")
    html = F.concat(
        F.lit("<figure class='poster'><img data-src='https://p.example/"), k.cast("string"), F.lit(".jpg'></figure><p class=filmmakers>de Ana "),
        F.initcap("p_name"), F.lit("</p><p class='informations'>France | "), F.when(k % 3 > 0, F.concat((F.col("p_size") + 1950).cast("string"), F.lit(" | "))).otherwise(""),
        F.lit("2h"), F.lpad("p_size", 2, "0"), F.lit("</p><p class='actors'>Avec A, "), "p_brand", F.lit("</p><div class='section synopsis'><p>"),
        F.repeat(F.concat(F.col("p_name"), F.lit(" ")), 60), F.lit("</p><p>autre</p></div>"))
    return t.part.select(k.alias("page_id"), html.alias("html"))
