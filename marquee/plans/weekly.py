"""The three flows: weekly run, batch load, read path. Each is one lazy plan; actions happen only at the sinks."""
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from .. import constants as K, schema
from ..functions import html as H, text as X
from ..functions.dates import as_date, period_start, programme_week as week_anchor_of_day, recent_weeks, time_minutes, time_seconds, week_anchor, weekly_url
from ..functions.missing import first_present, is_missing, or_default, present
from ..functions.records import detail_page
from ..operators import calendar as W, documents as O, grouping as G, incremental as I, match as M, profile as P, upsert as U
from ..operators.dedup import first_per_key
from ..operators.fill import detail_fill
from ..operators.skew import SMALL_ROWS, spread_lookup, spread_rows
from ..operators.staging import staged
from ..sources.readers import film_screenings
from ..sources.versions import Versions, hashed_part


def union_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """All rows of all sources with their source name and its place in the order of trust."""
    tagged = [df.withColumns({"source": F.lit(name), "src_order": F.lit(i)}) for i, (name, df) in enumerate(sources)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def as_films(rows: DataFrame, keep: tuple = ("src_order", "row_order")) -> DataFrame:
    """Rows with every film column, absent ones NULL, screenings in the common shape."""
    seance = lambda s, have: F.struct(*[(s[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.SEANCE])
    have = set(rows.schema["seances"].dataType.elementType.fieldNames())
    cols = {f.name: (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType) for f in schema.FILM if f.name != "seances"}
    cols["seances"] = F.transform("seances", lambda s: seance(s, have))
    return rows.select(*[c for c in keep if c in rows.columns], *[c.alias(n) for n, c in cols.items()])


def enrich(films: DataFrame, tmdb: DataFrame, omdb: DataFrame) -> DataFrame:
    """Look up one representative per work in the catalogs, then share the best known fields among all its copies.

    ``films`` carry (src_order, row_order); the representative is the first copy in that order, so what the catalogs
    say of it comes first among the best values.
    """
    place = ["src_order", "row_order"]
    fields = schema.SHARED_FIELDS
    keyed = staged(films.withColumn("_work", X.work_key(F.col("titreOriginal"), F.col("titre"))), "films")
    heads = M.representatives(keyed.select("_work", *place, "titre", *fields), "_work", place)
    known = M.provider_merge(heads, "_work", tmdb, omdb)
    known = known.select("_work", *[F.col(c).alias(f"_head_{c}") for c in [*place, *fields]])
    best = G.best_fields(keyed.filter(F.col("_work").isNotNull()), "_work", fields, F.struct(*place)).join(known, "_work", "left")
    best = best.select("_work", "n_rows", *[F.col(f"_head_{c}") for c in [*place, *fields]],
                       *[first_present(kind, F.col(f"_head_{c}"), F.col(c)).alias(f"_best_{c}") for c, kind in fields.items()])
    shared = spread_lookup(keyed, best, ["_work"], "left", right_weight="n_rows")
    is_head = (F.col("src_order") == F.col("_head_src_order")) & (F.col("row_order") == F.col("_head_row_order"))
    filled = {c: F.coalesce(present(F.col(c), kind), F.col(f"_best_{c}"), F.when(is_head, F.col(f"_head_{c}")), F.col(c))
              for c, kind in fields.items()}
    return shared.withColumns(filled).select(*films.columns)


def film_key() -> list[Column]:
    """Natural key of a film as it is stored: missing title and director are '', a missing year stays NULL."""
    return [or_default(F.col("titre"), F.lit("")), F.col("annee"), or_default(F.col("realisateur"), F.lit(""))]


REJECTS = {"no date": lambda: F.col("date").isNull(), "no time": lambda: is_missing(F.col("heure"))}


def star_rows(films: DataFrame, run_ts: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cinema, film and screening rows of nested films and the screenings rejected, with their ``reason``.

    Screenings name their film and cinema by the hash of the natural key, which is also the id of a new parent.
    """
    cinemas, rows, judged = judged_rows(films, run_ts)
    return cinemas, rows, hashed_keys(good_screenings(judged)), hashed_keys(judged.filter("reason IS NOT NULL").drop("created_at"))


def hashed_keys(slots: DataFrame) -> DataFrame:
    return slots.withColumns({k: U.text_id(F.col(k)) for k in ("film_key", "cinema_key")})


def judged_rows(films: DataFrame, run_ts: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cinema and film rows, and all screenings with the ``reason`` of those to be rejected; these name their film and
    cinema by the text of the natural key, which is shorter than its hash."""
    ts = F.lit(run_ts).cast("timestamp")
    base = films.withColumns({"cinema": or_default(F.col("cinema"), F.lit(K.DEFAULT_VENUE))})
    base = base.withColumns({"film_key": U.key_text(*film_key()), "cinema_key": U.key_text(F.col("cinema"))})
    cinemas = base.select(U.text_id(F.col("cinema_key")).alias("id"), F.col("cinema").alias("name"), X.slugify(F.col("cinema")).alias("slug"), ts.alias("created_at"),
                          "src_order", "row_order")
    titre, annee, realisateur = film_key()
    rows = base.select(
        U.text_id(F.col("film_key")).alias("id"), titre.alias("titre"), F.col("titreOriginal").alias("titre_original"), annee.alias("annee"), realisateur.alias("realisateur"),
        "duree", F.coalesce("genres", F.array().cast("array<string>")).alias("genres"), "synopsis", F.col("imdbId").alias("imdb_id"), "poster",
        F.col("imdbRating").try_cast("decimal(3,1)").alias("imdb_rating"), "cast", "source", ts.alias("created_at"), "src_order", "row_order")
    slots = film_screenings(base, ["film_key", "cinema_key", "src_order", "row_order"])
    return cinemas, rows, slots.withColumns({"reason": U.reject_reason([(name, broken()) for name, broken in REJECTS.items()]), "created_at": ts})


def good_screenings(judged: DataFrame) -> DataFrame:
    return judged.filter("reason IS NULL").select("film_key", "cinema_key", "date", time_seconds(F.col("heure")).alias("heure"), "version", "resa_url",
                                                  "created_at", "src_order", "row_order", "pos")


def with_refs(parents: DataFrame, kind: str, key: Column) -> DataFrame:
    """(key, id, ref, created_at) of stored films or cinemas, named after ``kind``. The ref stands for the id while
    screenings are shuffled: the text of the natural key where the id is its hash and no other row has it, else the id."""
    shared = F.count("id").over(Window.partitionBy("id")) > 1
    own = (F.col("id") == U.text_id(key)) & ~shared
    return parents.select(key.alias(f"{kind}_key"), F.col("id").alias(f"{kind}_id"), F.when(own, key).otherwise(id_ref(F.col("id"))).alias(f"{kind}_ref"), "created_at")


def id_ref(id_: Column) -> Column:
    return F.concat(F.lit("!"), id_)                    # a natural key begins with = or -


def id_of(ref: Column) -> Column:
    return F.when(F.startswith(ref, F.lit("!")), F.substring(ref, 2, 1 << 30)).otherwise(U.text_id(ref))


def parent_refs(cinemas: DataFrame, films: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (with_refs(cinemas, "cinema", U.key_text(F.col("name"))),
            with_refs(films, "film", U.key_text(F.col("titre"), F.col("annee"), F.col("realisateur"))))


def resolved(slots: DataFrame, cinemas: DataFrame, films: DataFrame, every: bool = False) -> DataFrame:
    """Screenings with the refs of their stored film and cinema, found by natural key; those without a parent are dropped,
    or with ``every`` have NULL there."""
    one = lambda df, kind: first_per_key(df, [f"{kind}_key"], ["created_at", f"{kind}_id"]).select(f"{kind}_key", f"{kind}_ref")
    c, f = parent_refs(cinemas, films)
    return M.star_join(slots, (one(c, "cinema"), "cinema_key"), (one(f, "film"), "film_key"), how="left" if every else "inner", small=SMALL_ROWS)


def merged_screenings(target: DataFrame, found: DataFrame, cinemas: DataFrame, films: DataFrame, order: list[str], week: str) -> DataFrame:
    """Stored screenings after those ``found`` (``resolved``), the last of a slot, laid out by their week in column ``week``.

    An upsert by (film_id, cinema_id, date, heure) which moves the short refs: aggregate and join meet in one shuffle, ids
    are hashed when the rows lie where they are written.
    """
    key = F.struct("film_ref", "cinema_ref", "date", "heure").alias("_key")                        # NULL fields of a struct are equal
    last = found.select(key, F.struct("version", "resa_url", "created_at").alias("s"), F.struct(*order).alias("_order"))
    last = last.groupBy("_key").agg(F.max_by("s", "_order").alias("s"))
    c, f = parent_refs(cinemas, films)
    held = M.star_join(target, (c.select("cinema_id", "cinema_ref").distinct(), "cinema_id"), (f.select("film_id", "film_ref").distinct(), "film_id"), how="left", small=SMALL_ROWS)
    held = held.withColumns({f"{k}_ref": F.coalesce(f"{k}_ref", id_ref(F.col(f"{k}_id"))) for k in ("cinema", "film")})
    held = held.select(key, F.struct("id", "version", "resa_url", "created_at").alias("t"))
    new = F.col("s").isNotNull()
    either = lambda c: F.when(new, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    both = held.join(last, "_key", "full_outer").select(
        "_key.*", F.col("t.id").alias("id"), new.alias("_new"), either("version"), either("resa_url"), F.coalesce("t.created_at", "s.created_at").alias("created_at"))
    laid = both.withColumn(week, week_part()).hint("rebalance", week)
    ids = laid.withColumns({"film_id": id_of(F.col("film_ref")), "cinema_id": id_of(F.col("cinema_ref"))})
    made = F.when(F.col("_new"), U.key_id(F.col("film_id"), F.col("cinema_id"), F.col("date"), F.col("heure")))
    return ids.withColumn("id", F.coalesce("id", made)).select(*schema.SEANCES.names, week)


def load(films: DataFrame, stored: tuple[DataFrame, DataFrame, DataFrame], run_ts: str, null_safe: bool = True,
         weeks_only: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New state of (cinemas, films, screenings) after loading nested films.

    First row of a film wins inside a run, last screening of a slot wins. Parents come first: they are written aside with
    the ids they have in ``stored``, and the screenings look these up. All screenings come back, for ``write_star``; with
    ``weeks_only`` those of the weeks from the first to the last one loaded, for ``write_weeks``: other weeks are neither
    read nor written. Screenings are laid out by their ``week``. ``star_rows`` also gives the rejected ones.
    """
    cinemas, rows, judged = judged_rows(films, run_ts)
    slots = good_screenings(judged)
    order = ["src_order", "row_order"]
    new_cinemas = staged(U.upsert(stored[0], cinemas, ["name"], order, "first"), "cinemas")
    new_films = staged(U.upsert(stored[1], rows, ["titre", "annee", "realisateur"], order, "first", null_safe=null_safe), "films")
    target = stored[2]
    if weeks_only:
        first, last = slots.agg(F.min("date"), F.max("date")).select(*[week_anchor(F.col(c)) for c in ("min(date)", "max(date)")]).first()
        week = F.col("week") if "week" in target.columns else week_anchor(F.col("date"))
        target = target.filter(week.between(F.lit(first), F.lit(last)))
    merged = merged_screenings(target.drop("week"), resolved(slots, new_cinemas, new_films), new_cinemas, new_films, [*order, "pos"], "week")
    return new_cinemas, new_films, merged.withColumn("week", F.col("week").cast("date"))


STAR = {"cinemas": schema.CINEMAS, "films": schema.FILMS, "seances": schema.SEANCES}
FILM_FOLDERS, CINEMA_FOLDERS = 64, 8
FILM_KEYS = ["titre", "annee", "realisateur"]


def load_version(films: DataFrame, spark: SparkSession, root: str, run_ts: str, urls: DataFrame | None = None, null_safe: bool = True,
                 film_folders: int = FILM_FOLDERS) -> DataFrame:
    """Load nested films into the tables below ``root`` as one change, and give its report (measure, n).

    Films and cinemas lie in folders by key hash, screenings by programme week. Only folders that hold a key or week of
    this load are read and replaced; they, the rejected screenings, the addresses in ``urls`` (state) and the report
    become visible together by the marker that is written last. The report is counted while the rows are written.
    """
    tables = Versions(spark, root)
    mine = str(tables.version + 1)
    cinemas, rows, judged = judged_rows(films, run_ts)
    counts, kept = Observation(), Observation()
    judged = staged(judged.observe(counts, F.count(F.lit(1)).alias("screenings"), F.count_if(F.col("reason").isNull()).alias("accepted"),
                                   *[F.count_if(F.col("reason") == name).alias(f"rejected: {name}") for name in REJECTS]), "judged")
    order = ["src_order", "row_order"]

    def dimension(table, new, keys, folders, safe=True):
        new = staged(first_per_key(new, keys, order).withColumn("part", hashed_part(keys, folders)), table)
        touched = [r.part for r in new.select("part").distinct().collect()]                  # ``folders`` at most
        merged = U.upsert(tables.read(table, STAR[table], touched), new, keys, order, "first", null_safe=safe)
        tables.write(table, merged.withColumn("part", hashed_part(keys, folders)), touched)
        return tables.read(table, STAR[table], touched, pending=True)

    new_cinemas = dimension("cinemas", cinemas, ["name"], CINEMA_FOLDERS)
    new_films = dimension("films", rows, FILM_KEYS, film_folders, null_safe)
    slots = good_screenings(judged)
    weeks = [r[0] for r in slots.select(week_part()).distinct().collect()]                   # programme weeks of the load
    known = resolved(slots, new_cinemas, new_films, every=True)
    lost = F.col("film_ref").isNull() | F.col("cinema_ref").isNull()
    found = known.observe(kept, F.count_if(~lost).alias("resolved"), F.count_if(lost).alias("unresolved")).filter(~lost)
    held = tables.read("seances", schema.SEANCES, weeks)
    tables.write("seances", merged_screenings(held, found, new_cinemas, new_films, [*order, "pos"], "part"), weeks, laid_out=True)
    tables.write("rejects", hashed_keys(judged.filter("reason IS NOT NULL")).select("film_key", "cinema_key", "date", "heure", "version", "reason", F.lit(mine).alias("part")))
    if urls is not None:
        tables.write("state", urls.select("url").distinct().withColumn("part", F.lit(mine)))
    measured = {**counts.get, **kept.get}
    report = spark.createDataFrame(list(measured.items()), "measure string, n long")
    tables.write("reports", report.withColumn("part", F.lit(mine)))
    tables.commit()
    return report


def week_part() -> Column:
    return week_anchor_of_day(F.col("date")).cast("string").alias("part")


def open_star(spark: SparkSession, root: str, weeks: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cinemas, films, screenings) as the newest whole load left them; of the screenings all or some programme weeks."""
    tables = Versions(spark, root)
    return tuple(tables.read(name, kind, weeks if name == "seances" else None) for name, kind in STAR.items())


def ingest_state(spark: SparkSession, root: str) -> DataFrame:
    """Addresses that whole loads have recorded."""
    return Versions(spark, root).read("state", schema.URL_STATE).distinct()


# --- weekly documents -------------------------------------------------------------------------------------------

def document_run(candidates: DataFrame, files: DataFrame, state: DataFrame, facts: DataFrame, run_date) -> tuple[DataFrame, DataFrame]:
    """(film rows, outcomes) of printed programmes: candidates (url, cinema_id), files (url, text, grid).

    Three guards, each before the work it saves. An address in ``state`` is skipped. An address whose week is stored is
    only recorded; its file is not read. Of the files read, one whose own text names a stored week, where the address
    names none, is only recorded; its grid is not parsed. The week in the text decides over that of the address; without
    either the header does, seen from the run date. Outcomes: skip, record (week stored), missing (no file), empty (no
    film), loaded; record and loaded are to be added to the state, the others come again.
    """
    plan = staged(I.plan_candidates(candidates, state, facts), "plan")
    wanted = plan.filter("action = 'process'").select("url", "cinema_id", "start")
    read = spread_lookup(wanted, first_per_key(files, ["url"], ["text"]).withColumn("there", F.lit(True)), ["url"])
    said = read.withColumn("said", period_start(F.col("text"))).drop("text")
    asked = said.filter("start IS NULL AND said IS NOT NULL").select("cinema_id", F.col("said").alias("start"), F.date_add("said", 6).alias("end"))
    stored = I.covered_weeks(asked, facts, "cinema_id", "start", "end", F.col("date")).select("cinema_id", F.col("start").alias("said"), F.lit(True).alias("stored"))
    checked = staged(spread_lookup(said, stored, ["cinema_id", "said"], spread_by=["url"]), "checked")
    late = F.col("stored") & F.col("start").isNull()
    grids = checked.filter("there").filter(~F.coalesce(late, F.lit(False))).select(
        F.struct("cinema_id", "url").alias("doc_id"), "grid", F.coalesce("said", "start").alias("week"))
    films = staged(O.grid_films(grids, run_date, F.col("week")).select("doc_id.*", "row_no", "titre", "version", "seances"), "films")
    full = films.select("cinema_id", "url").distinct().withColumn("full", F.lit(True))
    judged = checked.join(full, ["cinema_id", "url"], "left").select("cinema_id", "url", F.when(F.col("there").isNull(), "missing").when(late, "record")
                                                                     .when(F.col("full"), "loaded").otherwise("empty").alias("action"))
    return films, plan.filter("action != 'process'").select("cinema_id", "url", "action").unionByName(judged)


def predicted_candidates(spark: SparkSession, cinemas: DataFrame, run_date, site: str, weeks: int = 3) -> DataFrame:
    """Fallback candidates (cinema_id, url) where a page lists no file: the addresses of the latest weeks."""
    return cinemas.select("cinema_id", F.explode(recent_weeks(run_date, weeks)).alias("week")).select("cinema_id", weekly_url(F.col("week"), site).alias("url"))


def with_fallback(listed: DataFrame, cinemas: DataFrame, run_date, site: str) -> DataFrame:
    """Listed candidates, and predicted ones for cinemas that list none."""
    bare = cinemas.select("cinema_id").distinct().join(listed.select("cinema_id").distinct(), "cinema_id", "left_anti")
    return listed.select("cinema_id", "url").unionByName(predicted_candidates(listed.sparkSession, bare, run_date, site))


def recorded(outcomes: DataFrame) -> DataFrame:
    """Addresses to add to the state after the films are stored."""
    return outcomes.filter(F.col("action").isin("record", "loaded")).select("url").distinct()


def detailed(films: DataFrame, pages: DataFrame) -> DataFrame:
    """Missing fields of films filled from the page of their work; pages (slug, html) and films meet by ``slug``.

    Only the pages that some film names are parsed, each once however many films name it. Films without a slug or
    without a page stay as they are, and a field that the page lacks too keeps its value.
    Pages are dealt over a stated number of tasks: markup shrinks so much in a shuffle that tasks merged by its size there
    would hold a multiple of it.
    """
    films = staged(films, "listed")
    asked = films.filter(~is_missing(F.col("slug"))).select("slug").distinct()
    dealt = spread_rows(pages.select("slug", "html"), ["slug"])
    wanted = first_per_key(dealt.join(asked, "slug"), ["slug"], ["html"])   # a semi join would be planned before the dealing
    details = H.parse_pages(wanted).select("slug", detail_page(F.col("nodes")).alias("d")).select("slug", "d.*")
    return detail_fill(films, staged(details, "details"), "slug", schema.DETAIL_FIELDS)


def checked_star(cinemas: DataFrame, films: DataFrame, seances: DataFrame) -> DataFrame:
    """One row that tells whether loaded tables are fit to be read: ``failures`` (empty if none) and the numbers behind it.

    n_joined counts the screenings whose film and cinema exist, n_orphans the others, n_groups the pairs of film and
    cinema that a front end lists. Empty tables give zeros and fail.
    """
    known = lambda df, id_, flag: (df.select(F.col("id").alias(id_)).distinct().withColumn(flag, F.lit(True)), id_)
    rows = M.star_join(seances.select("film_id", "cinema_id"), known(films, "film_id", "film"), known(cinemas, "cinema_id", "hall"), how="left", small=SMALL_ROWS)
    whole = F.col("film").isNotNull() & F.col("hall").isNotNull()
    counts = rows.agg(F.count_if(whole).alias("n_joined"), F.count_if(~whole).alias("n_orphans"),
                      F.count_distinct(F.when(whole, F.struct("film_id", "cinema_id"))).alias("n_groups"))
    for df, name in ((cinemas, "n_cinemas"), (films, "n_films")):
        counts = counts.unionByName(df.agg(F.count_distinct("id").alias(name)), allowMissingColumns=True)
    counts = counts.agg(*[F.max(c).alias(c) for c in counts.columns])                          # of three single rows
    failures = F.concat(P.dq_failures(*map(F.col, ["n_cinemas", "n_films", "n_joined", "n_groups"])),
                        F.when(F.col("n_orphans") > 0, F.array(F.concat(F.col("n_orphans").cast("string"), F.lit(" screenings without film or cinema"))))
                        .otherwise(F.array().cast("array<string>")))
    return counts.select(failures.alias("failures"), "n_cinemas", "n_films", "n_joined", "n_orphans", "n_groups")


def weekly_run(sources: list[tuple[str, DataFrame]], tmdb: DataFrame | None, omdb: DataFrame | None, run_date, filter_week: bool = True,
               details: DataFrame | None = None) -> DataFrame:
    """Films of all sources, enriched and limited to the coming week. Without catalogs the lookup is left out.

    ``details`` (slug, html) are pages of single works, which fill what the sources leave out before the catalogs do.
    """
    films = as_films(union_sources(sources))
    if details is not None:
        films = detailed(films, details)
    if tmdb is not None and omdb is not None:
        films = enrich(films, tmdb, omdb)
    return W.current_week_nested(films, as_date(run_date)) if filter_week else films


def read_path(cinemas: DataFrame, films: DataFrame, seances: DataFrame, run_date) -> DataFrame:
    """Film, cinema and this week's screenings per (film, cinema), as a front end reads them."""
    if "week" in seances.columns:   # partitions: the week of the run date and the next one
        anchor = week_anchor(as_date(run_date))
        seances = seances.filter(F.col("week").between(anchor, F.date_add(anchor, 7)))
    week = W.current_week(seances, "date", run_date).select("id", "film_id", "cinema_id", "date", time_minutes(F.col("heure")).alias("heure"), "version")
    joined = M.star_join(week, (films.select(F.col("id").alias("film_id"), "titre"), "film_id"), (cinemas.select(F.col("id").alias("cinema_id"), "name"), "cinema_id"), small=SMALL_ROWS)
    return G.nest_screenings(joined, ["film_id", "cinema_id", "titre", "name"])
