"""Field rules: from a block, node or page to a typed record, by prioritised selectors and text functions."""
from pyspark.sql import Column, functions as F

from .. import constants as K
from . import dates as D, html as H, text as X
from .binding import let
from .calendar import by_time, calendar_slots, screenings
from .missing import first_present, present


def _sel(tag, cls=None):
    return {"tag": tag, "cls": cls}


TITLE_RULES = [_sel("h2"), _sel("h3"), _sel("h1"), _sel("h4")]
ORIGINAL_RULES = [_sel("span", "titre-original"), _sel("em"), _sel("i")]
INFO_RULES = [_sel("p", "film-info"), _sel("p", "infos"), _sel("div", "film-info"), _sel("p")]
SYNOPSIS_RULES = [_sel("div", "synopsis"), _sel("p", "synopsis"), _sel("div", "description")]
VERSION_RULES = [_sel("span", "version"), _sel("p", "version"), _sel("span", "vf"), _sel("span", "vostfr")]
SCREENING_RULES = [_sel("li", "seance"), _sel("div", "seance"), _sel("li", "horaire"), _sel("span", "seance"),
                   _sel("li")]
TIME_RULES = [_sel("span", "heure"), _sel("span", "time")]
DAY_RULES = [_sel("span", "jour"), _sel("span", "date"), _sel("time")]


def first_text(nodes: Column, within: Column | None, *rules: dict) -> Column:
    """Text of the first node of the first rule that finds any."""
    return H.text_of(nodes, H.first(H.first_found(nodes, within, *rules)))


def film_block(titre: Column, content: Column, week: Column, run_date) -> Column:
    """Record of a heading block: prose sentences give director, length, year, version, synopsis and screenings."""
    sentence = F.regexp_extract(content, K.SCREENINGS_PROSE, 0)

    def record(plain):
        version = X.version_from_prose(plain)
        return F.struct(
            H.unescape_entities(titre).alias("titre"), X.director_prose(plain).alias("realisateur"),
            D.duration_prose(plain).alias("duree"), D.year_in(plain, K.YEAR_PROSE).alias("annee"),
            version.alias("version"), X.synopsis_prose(plain).alias("synopsis"),
            let(version, lambda v: screenings(calendar_slots(sentence, week, run_date), v)).alias("seances"))

    return let(H.strip_tags(content), record)


def meta_fields(texts: Column) -> Column:
    """(duree, annee, realisateur) from the first three info lines, each field from the first line that gives it."""
    lines = [F.get(texts, F.lit(i)) for i in range(3)]
    return F.struct(first_present("number", *map(D.duration_minutes, lines)).alias("duree"),
                    first_present("number", *map(D.year_in, lines)).alias("annee"),
                    F.coalesce(*map(X.director_lead, lines)).alias("realisateur"))


def screening_node(nodes: Column, node: Column, default_version: Column, run_date) -> Column:
    """(date, heure, version) of one screening node, NULL without a time or a date."""
    def first_value(rules, f):
        lists = F.array(*[H.find_nodes(nodes, node, **r) for r in rules], F.array(node))
        tried = F.get(F.filter(lists, lambda x: F.size(x) > 0), F.lit(0))
        return F.get(F.filter(F.transform(tried, f), lambda x: x.isNotNull()), F.lit(0))

    at = first_value(TIME_RULES, lambda n: D.heure(H.text_of(nodes, n)))
    day = first_value(DAY_RULES, lambda n: F.coalesce(
        D.iso_date(F.substring(H.attr(n, "datetime"), 1, 10)), D.date_fr(H.text_of(nodes, n), run_date)))
    said = let(H.text_of(nodes, node), lambda whole: F.struct(
        F.coalesce(day, D.date_fr(whole, run_date)).alias("date"), F.coalesce(at, D.heure(whole)).alias("heure"),
        X.version_override(whole, default_version).alias("version")))
    return let(said, lambda s: F.when(s["date"].isNotNull() & s["heure"].isNotNull(), s))


def film_node(nodes: Column, node: Column, run_date) -> Column:
    """Record of a generic film node."""
    def version(own):
        return let(first_text(own, None, *VERSION_RULES), lambda v: X.version_from_node(v, H.text_of(own, H.root(own))))

    def seances(own, v):
        found = F.transform(H.first_found(own, None, *SCREENING_RULES), lambda n: screening_node(own, n, v, run_date))
        return by_time(F.array_distinct(F.filter(found, lambda s: s.isNotNull())), ["date", "heure", "version"])

    def parts(own):
        info = F.transform(F.slice(H.first_found(own, None, *INFO_RULES), 1, 3), lambda n: H.text_of(own, n))
        return F.struct(
            X.strip(first_text(own, None, *TITLE_RULES)).alias("titre"),
            X.strip(first_text(own, None, *ORIGINAL_RULES)).alias("original"), let(info, meta_fields).alias("meta"),
            first_text(own, None, *SYNOPSIS_RULES).alias("synopsis"), version(own).alias("version"),
            let(version(own), lambda v: seances(own, v)).alias("seances"))

    def record(p):
        other = (p["original"] != "") & ~p["original"].eqNullSafe(p["titre"])
        return F.struct(
            p["titre"].alias("titre"), F.when(other, p["original"]).alias("titreOriginal"),
            p["meta"]["annee"].alias("annee"), p["meta"]["realisateur"].alias("realisateur"),
            p["meta"]["duree"].alias("duree"), p["synopsis"].alias("synopsis"), p["version"].alias("version"),
            p["seances"].alias("seances"))

    return let(let(H.subtree(nodes, node), parts), record)


def detail_page(nodes: Column) -> Column:
    """Fields of a work's own page; each is NULL when its block is absent or empty."""
    top = lambda tag, cls: H.first(H.find_nodes(nodes, None, tag=tag, cls=cls))
    image = H.attr(H.first(H.find_nodes(nodes, top("figure", "poster"), tag="img")), "data-src")
    info = H.text_of(nodes, top("p", "informations"))
    section = top("div", "synopsis")
    prose = H.text_of(nodes, F.coalesce(H.first(H.find_nodes(nodes, section, tag="p")), section))
    return F.struct(
        F.when(image.startswith("http"), image).alias("poster"),
        present(X.without_lead(H.text_of(nodes, top("p", "filmmakers")), "de")).alias("realisateur"),
        D.year_in(info).alias("annee"), D.duration_minutes(info).alias("duree"),
        present(X.without_lead(H.text_of(nodes, top("p", "actors")), "Avec")).alias("cast"),
        X.ellipsize(present(prose)).alias("synopsis"))


# --- calendar table rows ----------------------------------------------------------------------------------------

def row_kind(node: Column) -> Column:
    cls = H.attr(node, "class")
    return (F.when(cls.contains("days"), "days").when(cls.contains("cinema"), "cinema")
             .when(cls.contains("movie"), "movie"))


def section_name(nodes: Column, node: Column) -> Column:
    """Venue of a section row: by marker in any attribute, else by marker in its text."""
    marked = [(name, marker) for name, _, marker in K.VENUES if marker]
    by_attr = [F.when(H.attrs_contain(nodes, node, marker), F.lit(name)) for name, marker in marked]
    by_text = let(F.lower(H.text_of(nodes, node)), lambda low: F.coalesce(*[F.when(low.contains(marker), F.lit(name)) for name, marker in marked]))
    return F.coalesce(*by_attr, by_text)


def header_dates(nodes: Column, node: Column) -> Column:
    """Array of (col, date) of a header row; column 0 is the title column, unreadable ones have no date."""
    return F.transform(H.children(nodes, node, "th"), lambda th, i: F.struct(
        (i + 1).alias("col"), D.iso_date(F.substring(H.attr(
            H.first(H.find_nodes(nodes, th, tag="time")), "datetime"), 1, 10)).alias("date")))


def cell_screenings(nodes: Column, cell: Column) -> Column:
    """Screenings of a day cell; the first booking link of the cell goes to all of them."""
    hrefs = F.transform(H.find_nodes(nodes, cell, tag="a"), lambda a: H.attr(a, "href"))
    is_booking = lambda u: F.exists(F.array(*map(F.lit, K.BOOKING_WORDS)), lambda w: F.lower(u).contains(w))
    booking = F.get(F.filter(hrefs, is_booking), F.lit(0))

    def screening(node, link):
        at = D.slice_timestamp(H.attr(node, "datetime"))
        version = X.version_code(F.coalesce(first_text(nodes, node, _sel("div", "version")), F.lit("")))
        return F.when(H.attr(node, "class").contains("session") & at.isNotNull(), F.struct(
            at["date"].alias("date"), at["heure"].alias("heure"), version.alias("version"),
            link.alias("resa_url")))

    return let(booking, lambda link: F.filter(F.transform(
        H.find_nodes(nodes, cell, tag="time"), lambda n: screening(n, link)), lambda s: s.isNotNull()))
