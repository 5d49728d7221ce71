"""Queries of sources, sinks, keyed loads, increments and streams."""
from pyspark.sql import functions as F

from .. import schema
from ..functions import dates as D
from ..operators import dedup, incremental as I, match as M, upsert as U
from ..operators.skew import SMALL_ROWS, spread_rows
from ..operators.staging import shared_folder, staged
from ..sources import readers, writers
from ..sources.versions import Versions, hashed_part
from ..streaming import arrivals as S
from . import derived as DI, weekly
from .pages import WEEK_SQL
from .registry import ORACLES, query
from .resolve import DAY_SQL, HEURE_SQL, OMDB, TMDB, line
from .scalars import ANCHOR, URL_SQL

text = lambda c: c.cast("string")
FILM_SQL = f"""f AS (SELECT DISTINCT p_brand, l_suppkey, {WEEK_SQL} AS w, {DAY_SQL} AS day, {HEURE_SQL} AS heure,
    CASE l_returnflag WHEN 'A' THEN 'VF' WHEN 'N' THEN 'VOST' ELSE 'VO' END AS version FROM lineitem JOIN part ON l_partkey = p_partkey)"""


# --- sources and sinks ------------------------------------------------------------------------------------------

@query("table_scan_pushdown", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def table_scan_pushdown(t):
    return readers.read_table(t.spark, t.path("orders"), ["o_orderkey", "o_totalprice"], (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000))


@query("programme_flatten", f"WITH {FILM_SQL} SELECT p_brand AS titre, 'Salle ' || l_suppkey AS cinema, day, heure, version, CASE WHEN version = 'VO' THEN 'https://x.example/r' END AS resa_url FROM f")
def programme_flatten(t):
    """Programme documents written, read back with their schema and flattened to screenings.

    A document lists all films that a venue shows in a week, in the order of their first day and then by title; rows come in this order.
    """
    first = F.datediff(F.get("seances", F.lit(0))["date"], "week")
    films = DI.film_rows(t).withColumns({"src_order": F.lit(0), "row_order": first})
    docs = writers.programme_documents(films, DI.RUN_TS, [DI.SITE], ("cinema", "week"))
    folder = shared_folder(t.spark, "programme")
    docs.select("generated_at", "sources", "films").write.option("compression", "gzip").json(folder)
    back = readers.programme_films(readers.read_programme(t.spark, folder, one_per_file=False))
    rows = readers.film_screenings(back, ["titre", "cinema"])
    return rows.select("titre", "cinema", text(F.col("date")).alias("day"), "heure", "version", "resa_url")


@query("programme_publish", f"""WITH {FILM_SQL} SELECT '{DI.RUN_TS}' AS generated_at, p_brand AS titre, 'Salle ' || l_suppkey AS cinema, CAST(w AS VARCHAR) AS week,
    string_agg(day || ' ' || heure || ' ' || version, ';' ORDER BY day, heure, version) AS slots FROM f GROUP BY p_brand, l_suppkey, w""")
def programme_publish(t):
    films = DI.film_rows(t)
    folder = shared_folder(t.spark, "published")
    writers.write_programme(films.withColumn("slug", text(F.col("week"))), folder, DI.RUN_TS, [DI.SITE])
    lines = readers.read_programme(t.spark, folder, one_per_file=False).select("generated_at", F.explode("films").alias("film"))
    return lines.select("generated_at", "film.titre", "film.cinema", F.col("film.slug").alias("week"), line("film.seances"))


def loaded(t):
    """Nested films loaded into three empty tables, written parents first and opened again."""
    films = weekly.as_films(DI.film_rows(t).withColumns({"src_order": F.lit(0), "row_order": F.lit(0)}))
    films = staged(films, "films")
    empty = tuple(t.spark.createDataFrame([], s) for s in (schema.CINEMAS, schema.FILMS, schema.SEANCES))
    folder = shared_folder(t.spark, "star")
    writers.write_star(*weekly.load(films, empty, DI.RUN_TS), folder)
    return tuple(t.spark.read.parquet(f"{folder}/{name}") for name in ("cinemas", "films", "seances"))


@query("load_star", f"""WITH {FILM_SQL}, g AS (SELECT p_brand AS titre, CAST(l_suppkey % 20 + 1990 AS INTEGER) AS annee, 'Salle ' || l_suppkey AS cinema, 'salle-' || l_suppkey AS slug, day, heure || ':00' AS heure, version FROM f)
    SELECT titre, annee, cinema, slug, day, heure, max(version) AS version FROM g GROUP BY ALL""")
def load_star(t):
    """The loaded star; the later of two list entries wins a slot."""
    cinemas, films, seances = loaded(t)
    star = M.star_join(seances.select("id", "film_id", "cinema_id", "date", "heure", "version"), (films.select(F.col("id").alias("film_id"), "titre", "annee"), "film_id"),
                       (cinemas.select(F.col("id").alias("cinema_id"), F.col("name").alias("cinema"), "slug"), "cinema_id"), small=SMALL_ROWS)
    return star.select("titre", "annee", "cinema", "slug", text(F.col("date")).alias("day"), "heure", "version")


@query("load_incremental", f"""WITH {FILM_SQL}, g AS (SELECT p_brand AS titre, CAST(l_suppkey % 20 + 1990 AS INTEGER) AS annee, l_suppkey AS supp, w, day, heure || ':00' AS heure, version FROM f),
    s AS (SELECT titre, annee, supp, day, heure FROM g WHERE w < '1997-03-19' AND supp % 2 = 0 UNION SELECT titre, annee, supp, '1997-03-13', '00:30:00' FROM g WHERE w < '1997-03-19' AND supp % 2 = 0),
    n AS (SELECT titre, annee, supp, day, heure, max(version) AS version FROM g WHERE w IN ('1997-03-12', '1997-03-19') GROUP BY ALL)
    SELECT titre, annee, 'Salle ' || supp AS cinema, day, heure, coalesce(version, 'old') AS version, (titre, annee) IN (SELECT (titre, annee) FROM s) AS kept_film, supp IN (SELECT supp FROM s) AS kept_cinema
    FROM n FULL JOIN s USING (titre, annee, supp, day, heure)""")
def load_incremental(t):
    """Two weeks loaded into stored tables whose ids are no hashes: rows only stored, only loaded and both; other weeks stay."""
    rows = DI.film_rows(t)
    day = lambda x: F.lit(x).cast("date")
    nested = lambda keep: weekly.as_films(rows.filter(keep).withColumns({"src_order": F.lit(0), "row_order": F.lit(0)}))
    even = F.replace("cinema", F.lit("Salle "), F.lit("")).cast("bigint") % 2 == 0
    cinemas, films, slots, _ = weekly.star_rows(nested(even & (F.col("week") < day("1997-03-19"))), "1997-03-01 00:00:00")
    extra = slots.withColumns({"date": day("1997-03-13"), "heure": F.lit("00:30:00")})
    slots = slots.unionByName(extra).withColumns({"version": F.lit("old"), "film_id": F.concat(F.lit("film-"), "film_key"), "cinema_id": F.concat(F.lit("cinema-"), "cinema_key")})
    once = dedup.first_per_key(slots.withColumn("id", U.key_id(F.col("film_id"), F.col("cinema_id"), F.col("date"), F.col("heure"))), ["id"], ["pos"])
    named = lambda df, kind, like: dedup.first_per_key(df, ["id"], ["row_order"]).withColumn("id", F.concat(F.lit(f"{kind}-"), "id")).select(*like.names)
    folder = shared_folder(t.spark, "star")
    opened = lambda: tuple(t.spark.read.parquet(f"{folder}/{name}") for name in ("cinemas", "films", "seances"))
    writers.write_star(named(cinemas, "cinema", schema.CINEMAS), named(films, "film", schema.FILMS), once.select(*schema.SEANCES.names), folder)
    loaded_weeks = nested(F.col("week").between(day("1997-03-12"), day("1997-03-19")))
    writers.write_weeks(*weekly.load(loaded_weeks, opened(), DI.RUN_TS, weeks_only=True), folder)
    cinemas, films, seances = opened()
    star = M.star_join(seances, (films.select(F.col("id").alias("film_id"), "titre", "annee"), "film_id"), (cinemas.select(F.col("id").alias("cinema_id"), F.col("name").alias("cinema")), "cinema_id"), small=SMALL_ROWS)
    return star.select("titre", "annee", "cinema", text(F.col("date")).alias("day"), "heure", "version", F.col("film_id").startswith("film-").alias("kept_film"),
                       F.col("cinema_id").startswith("cinema-").alias("kept_cinema"))


def spoilt(films):
    """Film rows in which some screenings have lost their date or their time."""
    half, sunday = lambda s: s["heure"].endswith(":30"), lambda s: F.weekday(s["date"]) == 6
    return films.withColumn("seances", F.transform("seances", lambda s: s.withField("heure", F.when(~half(s), s["heure"])).withField(
        "date", F.when(~sunday(s), s["date"]))))


def two_loads(t, broken=False):
    """Weeks before and then from 1997-03-12 on loaded as two changes; with ``broken`` a third stops before its marker."""
    rows = spoilt(weekly.as_films(DI.film_rows(t).withColumns({"src_order": F.lit(0), "row_order": F.lit(0)}), ("src_order", "row_order", "week")))
    root = shared_folder(t.spark, "versions")
    early = F.col("week") < F.lit("1997-03-19").cast("date")
    even = F.replace("cinema", F.lit("Salle "), F.lit("")).cast("bigint") % 2 == 0
    late = F.col("week") >= F.lit("1997-03-12").cast("date")
    address = lambda df: df.select(D.weekly_url(F.col("week"), DI.SITE).alias("url"))
    reports = []
    for keep in (early & even, late):
        part = staged(rows.filter(keep), "part")
        reports.append(weekly.load_version(part.drop("week"), t.spark, root, DI.RUN_TS, address(part)))
    if broken:
        tables = Versions(t.spark, root)
        tables.write("state", t.nation.select(F.col("n_name").alias("url"), F.lit("3").alias("part")))
        tables.write("cinemas", tables.read("cinemas", schema.CINEMAS).limit(1).withColumn("part", F.lit("0")), tables.parts("cinemas"))
    return root, reports


SPOILT_SQL = f"""{FILM_SQL}, a AS (SELECT DISTINCT p_brand AS titre, CAST(l_suppkey % 20 + 1990 AS INTEGER) AS annee, l_suppkey AS supp, w, day, heure, version FROM f),
    g AS (SELECT * FROM a WHERE NOT heure LIKE '%:30' AND isodow(CAST(day AS DATE)) <> 7)"""


@query("load_versions", f"""WITH {SPOILT_SQL}, s AS (SELECT titre, annee, supp, day, heure, max(version) AS version FROM g WHERE w < '1997-03-19' AND supp % 2 = 0 AND w < '1997-03-12' OR w >= '1997-03-12' GROUP BY ALL)
    SELECT titre, annee, 'Salle ' || supp AS cinema, day, heure || ':00' AS heure, version FROM s""")
def load_versions(t):
    """What readers see after two loads and one that broke off."""
    root, _ = two_loads(t, broken=True)
    cinemas, films, seances = weekly.open_star(t.spark, root)
    star = M.star_join(seances, (films.select(F.col("id").alias("film_id"), "titre", "annee"), "film_id"), (cinemas.select(F.col("id").alias("cinema_id"), F.col("name").alias("cinema")), "cinema_id"), small=SMALL_ROWS)
    return star.select("titre", "annee", "cinema", text(F.col("date")).alias("day"), "heure", "version")


@query("loaded_checks", f"""WITH {SPOILT_SQL}, k AS (SELECT * FROM a WHERE w >= '1997-03-12' OR supp % 2 = 0), s AS (SELECT DISTINCT titre, annee, supp, day, heure FROM g WHERE w >= '1997-03-12' OR supp % 2 = 0),
    n AS (SELECT (SELECT count(DISTINCT supp) FROM k) AS n_cinemas, (SELECT count(DISTINCT (titre, annee)) FROM k) AS n_films, (SELECT count(*) FROM s) AS n_joined, (SELECT count(DISTINCT (titre, annee, supp)) FROM s) AS n_groups)
    SELECT array_to_string(list_filter([CASE WHEN n_cinemas < 4 THEN 'Expected ≥4 cinemas, got ' || n_cinemas END, CASE WHEN n_films < 10 THEN 'Expected ≥10 films, got ' || n_films END,
        CASE WHEN n_joined < 1 THEN 'No seances found' END, CASE WHEN n_groups < 10 THEN 'Expected ≥10 film+cinema groups, got ' || n_groups END], lambda x: x IS NOT NULL), '; ') AS failures, n_cinemas, n_films, n_joined, 0 AS n_orphans, n_groups FROM n""")
def loaded_checks(t):
    """Whether the tables that two loads and a broken one left are fit to be read."""
    root, _ = two_loads(t, broken=True)
    return weekly.checked_star(*weekly.open_star(t.spark, root)).withColumn("failures", F.array_join("failures", "; "))


@query("ingest_state", f"WITH a AS (SELECT {WEEK_SQL} AS a, l_suppkey FROM lineitem) SELECT DISTINCT {URL_SQL} AS url FROM a WHERE a >= '1997-03-12' OR l_suppkey % 2 = 0")
def ingest_state(t):
    """Addresses recorded by whole loads; those of a load that broke off are not there."""
    root, _ = two_loads(t, broken=True)
    return weekly.ingest_state(t.spark, root)


@query("load_report", f"""WITH {SPOILT_SQL}, l AS (SELECT 1 AS load, * FROM a WHERE w < '1997-03-19' AND supp % 2 = 0 UNION ALL SELECT 2, * FROM a WHERE w >= '1997-03-12'),
    j AS (SELECT load, CASE WHEN isodow(CAST(day AS DATE)) = 7 THEN 'rejected: no date' WHEN heure LIKE '%:30' THEN 'rejected: no time' ELSE 'accepted' END AS outcome FROM l),
    c AS (SELECT load, unnest(['screenings', 'accepted', 'rejected: no date', 'rejected: no time', 'resolved', 'unresolved']) AS measure,
          unnest([count(*), count(*) FILTER (outcome = 'accepted'), count(*) FILTER (outcome = 'rejected: no date'), count(*) FILTER (outcome = 'rejected: no time'), count(*) FILTER (outcome = 'accepted'), 0]) AS n FROM j GROUP BY load)
    SELECT CAST(load AS INTEGER) AS load, measure, n FROM c""")
def load_report(t):
    """The reports of two loads, counted in the pass that writes."""
    _, reports = two_loads(t)
    parts = [r.select(F.lit(i + 1).alias("load"), "measure", "n") for i, r in enumerate(reports)]
    return parts[0].unionByName(parts[1])


DOC_KIND = "(l_suppkey + CAST((CAST(w AS DATE) - DATE '1992-01-01') / 7 AS BIGINT)) % 6"
DOC_SQL = f"""d AS (SELECT l_suppkey, {WEEK_SQL} AS w, count(DISTINCT (p_brand, l_returnflag, CAST(l_shipdate AS DATE), l_linenumber, CAST(l_quantity AS INTEGER))) AS n_slots,
        count(DISTINCT (p_brand, l_returnflag)) AS n_films, bool_or(l_linenumber = 1 AND l_quantity < 20) AS stored FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    k AS (SELECT *, {DOC_KIND} AS kind FROM d)"""


@query("weekly_documents", f"""WITH {DOC_SQL}, o AS (SELECT *, CASE kind WHEN 0 THEN 'skip' WHEN 1 THEN CASE WHEN stored THEN 'record' ELSE 'loaded' END WHEN 2 THEN CASE WHEN stored THEN 'record' ELSE 'loaded' END
        WHEN 3 THEN CASE WHEN stored THEN 'record' ELSE 'missing' END WHEN 4 THEN 'loaded' ELSE 'empty' END AS action FROM k)
    SELECT CAST(l_suppkey AS VARCHAR) AS cinema_id, CAST(w AS VARCHAR) AS week, action, CASE WHEN action = 'loaded' THEN n_films ELSE 0 END AS n_films, CAST(CASE WHEN action = 'loaded' THEN n_slots ELSE 0 END AS BIGINT) AS n_slots FROM o""")
def weekly_documents(t):
    """Six kinds of documents: 0 seen before, 1 week in the address, 2 week in the text only, 3 week in the address and no
    file, 4 no week anywhere (dates from the header), 5 a text without a programme."""
    stored = F.col("l_linenumber") == 1
    facts = t.lineitem.filter(stored & (F.col("l_quantity") < 20)).select(text(F.col("l_suppkey")).alias("cinema_id"), DI.day_of(F.col("l_shipdate")).alias("date"))
    kind = F.pmod(F.col("l_suppkey") + F.floor(F.datediff("week", F.lit("1992-01-01").cast("date")) / 7), F.lit(6))
    docs = DI.grids(t).withColumns({"kind": kind, "cinema_id": text(F.col("l_suppkey"))})
    key = F.concat_ws("-", "cinema_id", text(F.col("week")))
    named = F.concat(D.weekly_url(F.col("week"), DI.SITE), F.lit("?"), "cinema_id")
    docs = staged(docs.withColumn("url", F.when(F.col("kind").isin(0, 1, 3), named).otherwise(F.concat(F.lit("https://cdn.example/"), key, F.lit(".pdf")))), "documents")
    end = F.date_add("week", 6)
    period = F.concat(F.lit("Programme du "), F.dayofmonth("week"), F.lit(" au "), F.dayofmonth(end), F.lit(" "), D.month_name(end), F.lit(" "), F.year(end))
    no_grid = F.array().cast("array<array<string>>")
    files = docs.filter("kind <> 3").select("url", F.when(F.col("kind") == 2, period).otherwise("Bonjour").alias("text"), F.when(F.col("kind") == 5, no_grid).otherwise(F.col("grid")).alias("grid"))
    dated = files.join(docs.filter("kind = 4").select("url", "week"), "url", "left")
    # without a week anywhere the header is read as seen from the run date, so each such week is a run of its own
    head = F.transform("grid", lambda r, i: F.when(i == 1, F.transform(r, lambda c: c)).otherwise(r))
    films, outcomes = weekly.document_run(docs.select("url", "cinema_id"), dated.select("url", "text", head.alias("grid")), docs.filter("kind = 0").select("url"), facts, DI.RUN_DATE)
    counts = films.groupBy("cinema_id", "url").agg(F.count(F.lit(1)).alias("n_films"), F.sum(F.size("seances")).cast("bigint").alias("n_slots"))
    told = outcomes.join(docs.select("url", "cinema_id", text(F.col("week")).alias("week")), ["url", "cinema_id"]).join(counts, ["url", "cinema_id"], "left")
    return told.select("cinema_id", "week", "action", F.coalesce("n_films", F.lit(0)).cast("bigint").alias("n_films"), F.coalesce("n_slots", F.lit(0)).cast("bigint").alias("n_slots"))


@query("calendar_details", f"""WITH d AS ({ORACLES["detail_page"]}) SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 > 0 THEN p_name END AS titre, CASE WHEN l_linenumber % 2 = 0 THEN 'own' ELSE d.poster END AS poster, d.realisateur,
    CASE WHEN l_linenumber % 3 = 0 THEN 2001 ELSE coalesce(d.annee, CASE WHEN l_linenumber % 3 = 1 THEN 0 END) END AS annee, d.duree, coalesce(d.actors, '') AS actors, d.synopsis
    FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN d ON d.page_id = l_partkey AND l_linenumber % 4 > 0 AND l_partkey % 5 > 0""")
def calendar_details(t):
    """Films of a calendar filled from the pages of their works: films without a slug, works without a page, own values kept."""
    n = F.col("l_linenumber")
    listed = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("|", text(F.col("l_orderkey")), text(n)).alias("cinema"), F.when(n % 4 > 0, F.col("p_name")).alias("titre"), F.when(n % 4 > 0, text(F.col("l_partkey"))).alias("slug"),
        F.when(n % 2 == 0, "own").alias("poster"), F.when(n % 3 == 0, 2001).when(n % 3 == 1, 0).alias("annee"), F.lit("").alias("cast"), F.array().cast("array<struct<date:date>>").alias("seances"))
    pages = DI.detail_pages(t).filter("page_id % 5 > 0").select(text(F.col("page_id")).alias("slug"), "html")
    films = weekly.weekly_run([("calendar", listed)], None, None, DI.RUN_DATE, filter_week=False, details=pages)
    key = F.split("cinema", r"\|")
    return films.select(key[0].cast("bigint").alias("l_orderkey"), key[1].cast("int").alias("l_linenumber"), "titre", "poster", "realisateur", "annee", "duree", F.col("cast").alias("actors"), "synopsis")


@query("read_path", f"""WITH {FILM_SQL}, g AS (SELECT DISTINCT p_brand AS titre, l_suppkey % 20 + 1990 AS annee, 'Salle ' || l_suppkey AS name, day, heure, max(version) AS version FROM f
    WHERE day >= '1997-03-12' AND day < '1997-03-19' GROUP BY p_brand, l_suppkey, day, heure)
    SELECT titre, name, string_agg(day || ' ' || heure || ' ' || version, ';' ORDER BY day, heure) AS slots FROM g GROUP BY titre, annee, name""")
def read_path(t):
    return weekly.read_path(*loaded(t), DI.RUN_DATE).select("titre", "name", line())


@query("weekly_run", f"""WITH g AS (SELECT DISTINCT p_brand, l_suppkey, {WEEK_SQL} AS w, l_returnflag, {DAY_SQL} AS day, {HEURE_SQL} AS heure, l_linenumber % 4 AS section FROM lineitem JOIN part ON l_partkey = p_partkey),
    one AS (SELECT 'grid' AS source, upper(p_brand) AS titre, day || ' ' || heure || ' ' || CASE l_returnflag WHEN 'A' THEN 'VF' WHEN 'N' THEN 'VOSTFR' ELSE 'VO' END AS slot FROM g),
    two AS (SELECT 'calendar' AS source, p_brand AS titre, day || ' ' || heure || ' ' || CASE l_returnflag WHEN 'A' THEN 'VF' WHEN 'N' THEN 'VOSTFR' ELSE 'VO' END AS slot FROM g)
    SELECT source, titre, slot, count(*) AS n FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE slot >= '1997-03-12' AND slot < '1997-03-19' GROUP BY ALL""")
def weekly_run(t):
    """Grids and calendar pages to one list of films with the screenings of the coming week."""
    from ..operators import documents as O
    near = F.col("week").between(F.date_sub(F.lit(DI.RUN_DATE).cast("date"), 6), F.date_add(F.lit(DI.RUN_DATE).cast("date"), 6))  # before anything is parsed
    docs = DI.grids(t).filter(near).withColumn("doc_id", F.concat_ws("|", text(F.col("l_suppkey")), text(F.col("week"))))
    grids = O.grid_films(docs.select("doc_id", "grid", "week"), F.col("week"), F.col("week")).withColumnsRenamed({"row_no": "row_order"})
    pages = DI.calendar_pages(t).filter(near).select("l_suppkey", text(F.col("week")).alias("week"), "html")
    calendar = O.calendar_page_films(pages).withColumnRenamed("row_no", "row_order")
    films = weekly.weekly_run([("grid", weekly.as_films(grids)), ("calendar", weekly.as_films(calendar))], None, None, DI.RUN_DATE)
    slots = films.select("source", "titre", F.explode("seances").alias("s"))
    return slots.groupBy("source", "titre", F.concat_ws(" ", text(F.col("s.date")), "s.heure", "s.version").alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query("enriched_films", f"""WITH {TMDB}, {OMDB}, h AS (SELECT p_name, lower(p_name) AS k, min(p_partkey) AS head, arg_min(p_partkey, p_partkey) FILTER (p_partkey % 4 = 0) AS cp, arg_min(p_size % 10 + 1990, p_partkey) AS ca FROM part GROUP BY 1, 2),
    h1 AS (SELECT h.*, t.id, t.timdb, t.vote FROM h LEFT JOIN tt ON h.k = tt.k LEFT JOIN t ON t.id = tt.id),
    h2 AS (SELECT h1.*, o.i, o.y, o.imdbID FROM h1 LEFT JOIN o ON CASE WHEN timdb IS NOT NULL THEN o.imdbID = timdb ELSE o.k = h1.k END),
    b AS (SELECT p_name, head, vote, coalesce(timdb, imdbID) AS imdb, coalesce(CASE WHEN id % 5 > 0 THEN 'https://image.tmdb.org/t/p/w500/' || id || '.jpg' END, CASE WHEN i % 3 > 0 THEN 'https://img.example/' || i END, 'p' || cp) AS poster,
        coalesce(nullif(vote, 0), CASE WHEN i % 7 > 0 THEN i % 9 + 0.5 END) AS rating, coalesce(y, ca) AS annee FROM h2),
    f AS (SELECT 'grid' AS source, p_partkey, p_name, NULL AS own_poster, NULL AS own_year FROM part UNION ALL SELECT 'calendar', p_partkey, p_name, CASE WHEN p_partkey % 4 = 0 THEN 'p' || p_partkey END, p_size % 10 + 1990 FROM part)
    SELECT source, p_partkey AS row_order, imdb AS imdbId, coalesce(own_poster, poster) AS poster, CAST(coalesce(rating, CASE WHEN source = 'grid' AND p_partkey = head THEN vote END) AS DOUBLE) AS rating, CAST(coalesce(own_year, annee) AS INTEGER) AS annee
    FROM f JOIN b ON f.p_name = b.p_name""")
def enriched_films(t):
    """Two sources of copies, one catalog lookup per work, best values shared among all copies."""
    none = F.array().cast("array<struct<date:date,heure:string,version:string>>").alias("seances")
    k = F.col("p_partkey")
    one = t.part.select(k.alias("row_order"), F.col("p_name").alias("titre"), none)
    two = t.part.select(k.alias("row_order"), F.upper("p_name").alias("titre"), F.when(k % 4 == 0, F.concat(F.lit("p"), text(k))).alias("poster"), (F.col("p_size") % 10 + 1990).alias("annee"), none)
    films = weekly.as_films(weekly.union_sources([("grid", one), ("calendar", two)]))
    return weekly.enrich(films, DI.tmdb(t), DI.omdb(t)).select("source", "row_order", "imdbId", "poster", F.col("imdbRating").alias("rating"), "annee")


# --- keyed loads ------------------------------------------------------------------------------------------------

@query("upsert_dim", """SELECT c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN 'new-' || c_custkey ELSE 'old-' || c_custkey END AS slug, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS created_at FROM customer
    WHERE c_custkey % 3 > 0 OR c_custkey % 2 = 0""")
def upsert_dim(t):
    k = F.col("c_custkey")
    row = lambda keep, age: t.customer.filter(keep).select(F.col("c_name").alias("name"), F.concat(F.lit(f"{age}-"), text(k)).alias("slug"), F.lit(age).alias("created_at"))
    return U.upsert(row(k % 2 == 0, "old"), row(k % 3 > 0, "new"), ["name"], ["slug"], "first", ("created_at",))


@query("upsert_first_wins", """WITH n AS (SELECT p_name, CASE WHEN p_size % 2 = 0 THEN p_size END AS annee, arg_min(p_partkey, p_partkey) AS part FROM part GROUP BY 1, 2),
    o AS (SELECT p_name, CASE WHEN p_size % 2 = 0 THEN p_size END AS annee, max(p_partkey) AS part FROM part WHERE p_size <= 10 GROUP BY 1, 2)
    SELECT n.p_name AS titre, CAST(n.annee AS INTEGER) AS annee, CASE WHEN n.part % 4 > 0 THEN 'p' || n.part END AS poster, coalesce(o.part, n.part) AS id FROM n LEFT JOIN o ON n.p_name = o.p_name AND n.annee IS NOT DISTINCT FROM o.annee""")
def upsert_first_wins(t):
    """Stored films keep their id, everything else comes from the first new row, NULLs too; NULL years match."""
    year = F.when(F.col("p_size") % 2 == 0, F.col("p_size"))
    new = t.part.select(F.col("p_name").alias("titre"), year.alias("annee"), F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit("p"), text(F.col("p_partkey")))).alias("poster"), F.col("p_partkey").alias("id"))
    old = t.part.filter("p_size <= 10").groupBy(F.col("p_name").alias("titre"), year.alias("annee")).agg(F.lit("old").alias("poster"), F.max("p_partkey").alias("id"))
    return U.upsert(old, new, ["titre", "annee"], ["id"], "first", ("id",))


@query("upsert_last_wins", """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_max(event_type, event_id) AS version, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id, CAST(ts AS DATE)""")
def upsert_last_wins(t):
    rows = t.events.select("user_id", text(F.col("ts").cast("date")).alias("day"), F.col("event_type").alias("version"), "value", "event_id")
    older = rows.filter(F.col("day") < "2024-01-16").groupBy("user_id", "day").agg(F.lit("old").alias("version"), F.lit(0.0).alias("value"), F.lit(-1).cast("bigint").alias("event_id"))
    return U.upsert(older, rows, ["user_id", "day"], ["event_id"], "last", ())


@query("insert_if_absent", "SELECT n_name AS name, CASE WHEN n_regionkey < 2 THEN 'stored' ELSE 'seed' END AS origin FROM nation")
def insert_if_absent(t):
    row = lambda df, origin: df.select(F.col("n_name").alias("name"), F.lit(origin).alias("origin"))
    return U.insert_if_absent(row(t.nation.filter("n_regionkey < 2"), "stored"), row(t.nation, "seed"), ["name"])


@query("integrity_report", """SELECT 'lineitem' AS "table", 'unique(l_orderkey,l_linenumber)' AS rule, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS violations
    UNION ALL SELECT 'lineitem', 'not_null(l_shipdate)', count(*) FILTER (l_shipdate IS NULL) FROM lineitem UNION ALL SELECT 'lineitem', 'not_null(l_partkey)', count(*) FILTER (l_partkey IS NULL) FROM lineitem
    UNION ALL SELECT 'lineitem', 'references orders', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'lineitem', 'references rich orders', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 1000))""")
def integrity_report(t):
    parent = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return U.integrity_report(t.lineitem, "lineitem", [["l_orderkey", "l_linenumber"]], ["l_shipdate", "l_partkey"],
                              [(["l_orderkey"], parent, "orders"), (["l_orderkey"], parent.filter("o_totalprice > 1000"), "rich orders")])


@query("cascade_delete", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def cascade_delete(t):
    surviving = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return U.cascade_delete(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), surviving, ["l_partkey"])


REJECT_SQL = "CASE WHEN event_type = 'error' THEN 'bad type' WHEN value < 5 THEN 'low value' END"


@query("reject_split", f"SELECT coalesce({REJECT_SQL}, 'loaded') AS outcome, count(*) AS n FROM events GROUP BY 1")
def reject_split(t):
    good, bad = U.split_rejects(t.events.select("event_type", "value"), [("bad type", F.col("event_type") == "error"), ("low value", F.col("value") < 5)])
    return (good.select(F.lit("loaded").alias("outcome")).unionByName(bad.select(F.col("reason").alias("outcome")))
                .groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))


@query("require_fields", "SELECT event_id, event_type FROM events WHERE event_type <> 'error' AND value <> 0")
def require_fields(t):
    rows = t.events.select("event_id", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("event_type"), "value")
    return U.require_fields(rows, {"event_type": "string", "value": "number"}).drop("value")


# --- increments -------------------------------------------------------------------------------------------------

@query("unprocessed", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unprocessed(t):
    return I.unprocessed(t.documents.select("doc_id", "source"), t.labels, ["doc_id"])


COVER_SQL = f"""w AS (SELECT o_orderkey, o_custkey % 50 AS cinema, {ANCHOR} AS a FROM orders),
    d AS (SELECT DISTINCT l_suppkey AS cinema, CAST(l_shipdate AS DATE) AS day FROM lineitem)"""


def weeks(t):
    asked = t.orders.select("o_orderkey", (F.col("o_custkey") % 50).alias("cinema"), D.week_anchor(DI.day_of(F.col("o_orderdate"))).alias("start"))
    facts = t.lineitem.select(F.col("l_suppkey").alias("cinema"), "l_shipdate")
    return asked.withColumn("end", F.date_add("start", 6)), facts


@query("week_covered", f"WITH {COVER_SQL} SELECT o_orderkey, cinema FROM w WHERE EXISTS (SELECT 1 FROM d WHERE d.cinema = w.cinema AND d.day BETWEEN a AND a + 6)")
def week_covered(t):
    asked, facts = weeks(t)
    return I.week_covered(asked, facts, "cinema", "start", "end", DI.day_of(F.col("l_shipdate"))).select("o_orderkey", "cinema")


@query("week_uncovered", f"WITH {COVER_SQL} SELECT o_orderkey, cinema FROM w WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.cinema = w.cinema AND d.day BETWEEN a AND a + 6)")
def week_uncovered(t):
    asked, facts = weeks(t)
    return I.week_covered(asked, facts, "cinema", "start", "end", DI.day_of(F.col("l_shipdate")), covered=False).select("o_orderkey", "cinema")


@query("plan_inputs", f"""WITH u AS (SELECT DISTINCT a, {URL_SQL} AS url FROM (SELECT {ANCHOR} AS a FROM orders)), seen AS (SELECT DISTINCT {URL_SQL} AS url FROM (SELECT {ANCHOR} AS a FROM orders WHERE o_orderstatus = 'P')),
    d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_suppkey = 1)
    SELECT url, CASE WHEN url IN (SELECT url FROM seen) THEN 'skip' WHEN EXISTS (SELECT 1 FROM d WHERE day BETWEEN a AND a + 6) THEN 'record' ELSE 'process' END AS action FROM u""")
def plan_inputs(t):
    url = D.weekly_url(D.week_anchor(DI.day_of(F.col("o_orderdate"))), DI.SITE).alias("url")
    facts = t.lineitem.select(text(F.col("l_suppkey")).alias("cinema_id"), DI.day_of(F.col("l_shipdate")).alias("date"))
    return I.plan_inputs(t.orders.select(url), t.orders.filter("o_orderstatus = 'P'").select(url), facts, "1").select("url", "action")


# --- streams ----------------------------------------------------------------------------------------------------

def stream_run(t, name, handler, increments=3):
    """Events that arrive in increments by id, each processed when it is there, then once more to show that nothing comes twice."""
    events = t.events.select("event_id", "user_id", "event_type", "value")
    folder = shared_folder(t.spark, name)
    last = events.agg(F.max("event_id")).first()[0] or 0
    for i in range(increments + 1):
        part = F.floor(F.col("event_id") * increments / F.lit(last + 1))
        if i < increments:
            events.filter(part == i).write.mode("append").parquet(f"{folder}/in")
        S.run_available(S.arrivals(t.spark, f"{folder}/in", events.schema), handler(f"{folder}/log", events.schema), f"{folder}/checkpoint")
    return f"{folder}/log", events.schema


@query("stream_incremental", "SELECT event_id, user_id, event_type, value FROM events")
def stream_incremental(t):
    log, events = stream_run(t, "arrivals", lambda log, _: S.append_log(log))
    return S.stored(t.spark, log, events).drop("batch")


@query("stream_upsert", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def stream_upsert(t):
    keys = ["user_id", "event_type"]
    log, events = stream_run(t, "upsert", lambda log, _: S.upsert_log(log, keys, ["event_id"]))
    return S.current(t.spark, log, events, keys, ["event_id"])


@query("stream_fold", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def stream_fold(t):
    """Ten increments, folded twice, with an increment that is already in the base coming again in between."""
    keys, order = ["user_id", "event_type"], ["event_id"]
    events = t.events.select("event_id", "user_id", "event_type", "value")
    folder = shared_folder(t.spark, "fold")
    handle = S.upsert_log(f"{folder}/log", keys, order, schema=events.schema, fold_every=4)
    last = events.agg(F.max("event_id")).first()[0] or 0
    part = lambda i: events.filter(F.floor(F.col("event_id") * 10 / F.lit(last + 1)) == i)
    for i in range(10):
        part(i).write.mode("append").parquet(f"{folder}/in")
        S.run_available(S.arrivals(t.spark, f"{folder}/in", events.schema), handle, f"{folder}/checkpoint")
        if i == 5:
            handle(part(2), 2)
    return S.current(t.spark, f"{folder}/log", events.schema, keys, order)


DROP_LIMIT = 20_000
DROP_SQL = f"""f AS (SELECT doc_id // 8 AS name, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) + CASE WHEN (doc_id // 8) % 4 = 0 THEN 5 ELSE 9 END AS length FROM documents GROUP BY doc_id // 8)"""


@query("stream_drop", f"""WITH {DROP_SQL} SELECT name, length, CASE WHEN length > {DROP_LIMIT} THEN 'too large' WHEN name % 4 = 0 THEN 'not a PDF' ELSE 'admitted' END AS outcome, 1 AS n FROM f""")
def stream_drop(t):
    """Files of eight documents each, dropped in three increments and listed a fourth time: each judged once.

    They are dealt to shelves, each a stream of its own, so the listing that the driver holds does not grow with their number.
    """
    folder = shared_folder(t.spark, "drop")
    name = F.floor(F.col("doc_id") / 8).cast("bigint")
    head = F.when(F.col("name") % 4 == 0, "PK..").otherwise("%PDF-1.4")
    files = t.documents.groupBy(name.alias("name")).agg(F.concat_ws("\n", F.collect_list(F.coalesce("text", F.lit("")))).alias("body"))  # eight documents
    n = S.shelves(t.documents.select(name).distinct().count())
    lines = spread_rows(files.select(F.concat_ws("\n", head, "body").alias("value"), hashed_part(["name"], n).alias("shelf"), "name"), ["name"])   # a file takes long to open, however small
    arrived = S.dropped_shelves(t.spark, f"{folder}/in", n, DROP_LIMIT)        # while there is no file: the definition lists them all
    for i in range(4):
        if i < 3:
            lines.filter(F.col("name") % 3 == i).write.partitionBy("shelf", "name").mode("append").text(f"{folder}/in")
        S.run_shelves(arrived, f"{folder}/log", f"{folder}/checkpoint")
    found = S.stored(t.spark, f"{folder}/log", S.DROP_LOG)
    named = found.withColumn("name", F.regexp_extract("path", r"name=(\d+)/", 1).cast("bigint"))
    return named.groupBy("name", "length", F.coalesce("reason", F.lit("admitted")).alias("outcome")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("stream_dedup", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def stream_dedup(t):
    log, events = stream_run(t, "dedup", lambda log, schema: S.new_only_log(log, ["user_id"], ["event_id"], schema))
    return S.stored(t.spark, log, events).select("user_id", "event_id")
