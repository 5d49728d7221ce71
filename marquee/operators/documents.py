"""From programme documents to film rows: printed grids and calendar pages. All of it is row-local."""
from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.binding import let
from ..functions.calendar import by_time, screenings
from ..functions import dates as D, grid as G, html as H, records as R, text as X
from ..functions.shapes import Shape, select

FILM_COLUMNS = ["titre", "version", "seances"]


# --- grids ------------------------------------------------------------------------------------------------------

def collect_grid(rows: DataFrame) -> DataFrame:
    """Grid rows (doc_id, row_no, cells) to one row per document; a document is one printed table."""
    return (rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("g"))
                .select("doc_id", F.transform("g", lambda r: r["cells"]).alias("grid")))


def grid_columns(docs: DataFrame, run_date, week_start: Column | None = None) -> DataFrame:
    """Documents with ``dates``, an array of (col, date) of their day columns; NULL without a header row."""
    start = F.lit(None).cast("date") if week_start is None else week_start
    dates = let(F.get("grid", G.header_row(F.col("grid"))), lambda header: F.when(
        header.isNotNull(), G.col_dates(header, start, run_date)))
    return docs.withColumn("dates", dates)


def grid_films(docs: DataFrame, run_date, week_start: Column | None = None) -> DataFrame:
    """One row per film row of a grid: titre, version and its distinct screenings by date and time."""
    start = F.lit(None).cast("date") if week_start is None else week_start
    opened = docs.select("doc_id", F.explode_outer(G.grid_rows(F.col("grid"), start, run_date)).alias("f"))
    return opened.filter(F.col("f").isNotNull()).select(
        "doc_id", "f.row_no", "f.titre", "f.version", screenings(F.col("f.slots"), F.col("f.version")).alias("seances"))


# --- text lines -------------------------------------------------------------------------------------------------

def line_blocks(text: Column, max_lines: int = K.BLOCK_LINES) -> Column:
    """Blocks of a text: a title line opens one and takes the lines after it, at most ``max_lines`` in all.

    Array of (head, lines). A line with enough day abbreviations stands alone unless a block takes it. Lines beyond
    the limit of a block, and lines before the first block, belong nowhere.
    """
    def typed(x, i):
        days = sum([F.lower(x).contains(a).cast("int") for _, a, _ in K.PROGRAMME_DAYS], F.lit(0))
        opens = ~(x.rlike(K.CLOCK_WORD) | x.rlike(K.VERSION_LINE) | (F.length(x) <= 3))
        return F.struct(i.alias("at"), opens.alias("opens"), (days >= K.MIN_HEADER_DAYS).alias("days"))

    def standing(marks):
        def stands(m):
            last = F.try_element_at(F.filter(marks, lambda o: o["opens"] & (o["at"] <= m["at"])), F.lit(-1))
            return m["opens"] | last.isNull() | last["days"] | (m["at"] - last["at"] >= max_lines)
        return F.filter(marks, stands)

    def cut(lines, heads):
        return F.transform(heads, lambda m, i: F.struct(
            F.get(lines, m["at"]).alias("head"),
            F.slice(lines, m["at"] + 1, F.when(m["days"], F.lit(1)).otherwise(F.least(
                F.coalesce(F.get(heads, i + 1)["at"], F.size(lines)) - m["at"], F.lit(max_lines)))).alias("lines")))

    def blocks(lines):
        marks = F.filter(F.transform(lines, typed), lambda m: m["opens"] | m["days"])
        return let(let(marks, standing), lambda heads: cut(lines, heads))

    return let(F.filter(F.transform(F.split(text, r"\R"), X.strip), lambda x: x != ""), blocks)


# --- calendar pages ---------------------------------------------------------------------------------------------

def largest_table(nodes: Column) -> Column:
    """Table with the most rows, the first of equals."""
    ranked = F.transform(H.find_nodes(nodes, tag="table"), lambda t: F.struct(
        F.size(H.find_nodes(nodes, t, tag="tr")).alias("rows"), (-t["node_id"]).alias("order")))
    return F.get(nodes, -F.array_max(ranked)["order"])


def calendar_rows(pages: DataFrame) -> DataFrame:
    """Rows of the main table of every page: kind and section in effect; ``nodes`` is the row's own subtree.

    The section is carried forward inside the page's own array, so rows of a page never need a shuffle to meet. Rows are
    opened as places in the page, and their nodes cut out afterwards: values bound inside an expression are copied.
    """
    nodes = F.col("nodes")
    place = lambda n: F.struct(n["node_id"].alias("node_id"), n["subtree_end"].alias("subtree_end"))

    def sections(rows):
        """(index, venue) of the section rows that name one."""
        named = F.transform(rows, lambda r, i: F.when(r["kind"] == "cinema", F.struct(
            i.alias("at"), R.section_name(nodes, r["node"]).alias("venue"))))
        return F.filter(named, lambda m: m["venue"].isNotNull())

    def carried(rows, marks):
        return F.transform(rows, lambda r, i: F.struct(
            i.alias("row_no"), r["kind"].alias("kind"), r["node"].alias("node"),
            F.coalesce(F.try_element_at(F.filter(marks, lambda m: m["at"] <= i), F.lit(-1))["venue"],
                       F.lit(K.DEFAULT_SECTION)).alias("cinema")))

    def rows_of(table):
        kinds = F.transform(H.find_nodes(nodes, table, tag="tr"), lambda r: F.struct(R.row_kind(r).alias("kind"), place(r).alias("node")))
        return let(kinds, lambda rows: let(sections(rows), lambda marks: carried(rows, marks)))

    rows = let(largest_table(nodes), lambda table: F.when(table.isNotNull(), rows_of(place(table))))
    keep = [c for c in pages.columns if c != "nodes"]
    opened = pages.select(*keep, "nodes", F.explode_outer(rows).alias("row")).filter(F.col("row").isNotNull())
    return opened.select(*keep, "row.row_no", "row.kind", H.subtree(nodes, F.col("row.node")).alias("nodes"), "row.cinema")


def calendar_films(rows: DataFrame) -> DataFrame:
    """Film rows of a calendar: titre, slug, cinema, screenings by date and time (equal times in page order).

    Dropped when the title has fewer than two characters besides spaces or nothing is shown.
    """
    kept = [c for c in rows.columns if c not in ("kind", "nodes")]

    def seances(own):
        cells = F.filter(H.children(own, H.root(own), "td"), lambda td: H.attr(td, "class").contains("schedule"))
        return F.flatten(F.transform(cells, lambda td: R.cell_screenings(own, td)))

    def titled(own, title, link):
        said = F.nullif(X.strip(H.text_of(own, link)), F.lit(""))
        return F.struct(F.coalesce(said, X.strip(H.text_of(own, title))).alias("titre"),
                        X.href_slug(H.attr(link, "href")).alias("slug"))

    def film(own):
        name = let(F.get(H.children(own, H.root(own), "th"), F.lit(0)), lambda title: F.when(title.isNotNull(), let(
            H.first(H.find_nodes(own, title, tag="a")), lambda link: titled(own, title, link))))
        return F.struct(name.alias("name"), by_time(seances(own), ["date", "heure", "version", "resa_url"]).alias("seances"))

    movie = rows.filter(F.col("kind") == "movie").select(*kept, F.explode_outer(F.array(let(F.col("nodes"), film))).alias("f"))
    titre = F.col("f.name.titre")
    shown = movie.filter((F.length(F.replace(titre, F.lit(" "), F.lit(""))) >= 2) & (F.size("f.seances") > 0))
    return shown.select(*kept, titre.alias("titre"), F.col("f.name.slug").alias("slug"), F.col("f.seances").alias("seances"))


_VENUE_MARKS = tuple(marker for _, _, marker in K.VENUES if marker)
CALENDAR = {"tables": Shape("table", parts={
    "rows": Shape("tr", attrs=("class",), parts={
        "titles": Shape("th", direct=True, first=True, text=True, parts={"links": Shape("a", first=True, text=True, attrs=("href",))}),
        "cells": Shape("td", "schedule", direct=True, attrs=("class",), parts={
            "links": Shape("a", attrs=("href",)),
            "times": Shape("time", "session", attrs=("class", "datetime"), parts={"versions": Shape("div", "version", first=True, text=True)})})}),
    "sections": Shape("tr", "cinema", attrs=("class",), text=True, marks=_VENUE_MARKS)})}


def calendar_page_films(pages: DataFrame, html: str = "html") -> DataFrame:
    """Film rows of calendar pages, as ``calendar_films(calendar_rows(parse_pages(pages)))`` gives them.

    Only the elements that count leave the parser (``CALENDAR``), nested as rows, cells and times.
    """
    kept = [c for c in pages.columns if c != html]

    def kind(row):
        cls = F.coalesce(row["class"], F.lit(""))
        return F.when(cls.contains("days"), "days").when(cls.contains("cinema"), "cinema").when(cls.contains("movie"), "movie")

    def venue(section):
        low = F.lower(section["text"])
        marked = [(name, marker) for name, _, marker in K.VENUES if marker]
        return F.coalesce(*[F.when(F.array_contains(section["marked"], m), F.lit(n)) for n, m in marked],
                          *[F.when(low.contains(m), F.lit(n)) for n, m in marked])

    def movies(table):
        named = F.filter(F.transform(F.filter(table["sections"], lambda s: kind(s) == "cinema"), lambda s: F.struct(
            s["node_id"].alias("at"), venue(s).alias("venue"))), lambda s: s["venue"].isNotNull())
        places = F.transform(table["rows"], lambda r, i: F.struct(i.alias("row_no"), r.alias("row")))
        return let(named, lambda marks: F.transform(F.filter(places, lambda p: kind(p["row"]) == "movie"), lambda p: F.struct(
            p["row_no"].alias("row_no"), p["row"].alias("row"),
            F.coalesce(F.try_element_at(F.filter(marks, lambda m: m["at"] < p["row"]["node_id"]), F.lit(-1))["venue"],
                       F.lit(K.DEFAULT_SECTION)).alias("cinema"))))

    def screening(time, link):
        at = D.slice_timestamp(time["datetime"])
        version = X.version_code(F.coalesce(F.get(time["versions"], F.lit(0))["text"], F.lit("")))
        return F.when(time["class"].contains("session") & at.isNotNull(), F.struct(
            at["date"].alias("date"), at["heure"].alias("heure"), version.alias("version"), link.alias("resa_url")))

    def cell_slots(cell):
        is_booking = lambda u: F.exists(F.array(*map(F.lit, K.BOOKING_WORDS)), lambda w: F.lower(u).contains(w))
        booking = F.get(F.filter(F.transform(cell["links"], lambda a: F.coalesce(a["href"], F.lit(""))), is_booking), F.lit(0))
        return let(booking, lambda link: F.filter(F.transform(cell["times"], lambda t: screening(t, link)), lambda s: s.isNotNull()))

    def film(m):
        title = F.get(m["row"]["titles"], F.lit(0))
        link = F.get(title["links"], F.lit(0))
        said = F.nullif(X.strip(link["text"]), F.lit(""))
        name = F.when(title.isNotNull(), F.struct(F.coalesce(said, X.strip(title["text"])).alias("titre"),
                                                  X.href_slug(F.coalesce(link["href"], F.lit(""))).alias("slug")))
        cells = F.filter(m["row"]["cells"], lambda c: c["class"].contains("schedule"))
        seances = by_time(F.flatten(F.transform(cells, cell_slots)), ["date", "heure", "version", "resa_url"])
        return F.struct(m["row_no"].alias("row_no"), m["cinema"].alias("cinema"), name.alias("name"), seances.alias("seances"))

    largest = let(F.transform("tables", lambda t: F.size(t["rows"])), lambda sizes: F.get(
        F.col("tables"), F.array_position(sizes, F.array_max(sizes)).cast("int") - 1))
    found = select(pages, CALENDAR, html).select(*kept, F.explode_outer(let(largest, movies)).alias("m")).filter("m IS NOT NULL")
    opened = found.select(*kept, F.explode_outer(F.array(let(F.col("m"), film))).alias("f"))
    titre = F.col("f.name.titre")
    shown = opened.filter((F.length(F.replace(titre, F.lit(" "), F.lit(""))) >= 2) & (F.size("f.seances") > 0))
    return shown.select(*kept, "f.row_no", "f.cinema", titre.alias("titre"), F.col("f.name.slug").alias("slug"), F.col("f.seances").alias("seances"))


def heading_films(pages: DataFrame, run_date) -> DataFrame:
    """Film rows of a page built from headings: week from its period line, one record per film block."""
    weeks = pages.withColumn("_week", D.week_map(F.col("html")))
    keep = [c for c in pages.columns if c != "html"]
    blocks = weeks.select(*keep, "_week", F.explode_outer(F.filter(
        H.heading_blocks(F.col("html")), H.is_film_block)).alias("b")).filter(F.col("b").isNotNull())
    return blocks.withColumn("film", R.film_block(F.col("b.titre"), F.col("b.content"), F.col("_week"), run_date)) \
                 .select(*keep, F.col("b.pos").alias("row_no"), "film.*")
