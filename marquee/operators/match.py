"""Matching works to catalogs and merging their fields by provider priority.

The catalogs are first reduced to the best entry per key, so a probe meets at most one row and no key, however
popular, multiplies rows.
"""
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..functions.missing import is_missing, or_default, present
from .dedup import first_per_key
from .skew import heavy_keys, is_small, small_lookup, spread_lookup
from .staging import staged


def _keyed(kind: str, key: Column, *order: Column) -> Column:
    """One probe or entry: ``kind`` keeps the key spaces apart, NULL keys are left out later."""
    return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), *order)


def _title_year(title: Column, year: Column) -> Column:
    return F.concat(F.nullif(X.title_key(title), F.lit("")), F.lit("\u0001"), present(year, "number").cast("string"))


def _title(title: Column) -> Column:
    return F.nullif(X.title_key(title), F.lit(""))


def _entries(catalog: DataFrame, keys: list[tuple[str, Column]], order: list[Column]) -> DataFrame:
    """Best catalog row per (kind, key), as struct ``hit``."""
    rows = catalog.select(F.struct(*catalog.columns).alias("hit"), F.struct(*order).alias("_order"),
                          F.explode(F.array(*[_keyed(k, c) for k, c in keys])).alias("k"))
    rows = rows.select("k.kind", "k.key", "hit", "_order").filter(F.col("key").isNotNull())
    return rows.groupBy("kind", "key").agg(F.min_by("hit", "_order").alias("hit"))


def _cascade(works: DataFrame, work_id: str, probes: list[tuple[int, str, Column]], entries: DataFrame) -> DataFrame:
    """(work_id, match_rank, hit): the entry of the first rank that has one."""
    asked = works.select(work_id, F.explode(F.array(*[
        _keyed(kind, key, F.lit(rank).alias("rank")) for rank, kind, key in probes])).alias("p"))
    asked = asked.select(work_id, "p.rank", "p.kind", "p.key").filter(F.col("key").isNotNull())
    return (spread_lookup(asked, entries, ["kind", "key"], "inner", spread_by=[work_id, "rank"]).groupBy(work_id)
                .agg(F.min("rank").alias("match_rank"), F.min_by("hit", "rank").alias("hit")))


def match_cascade(works: DataFrame, work_id: str, tmdb: DataFrame) -> DataFrame:
    """(work_id, match_rank, hit) in the first catalog: by imdb id (1); by title and year (2); title (3); French title and year (4); French title (5).

    ``works`` has imdbId, titre, titreOriginal, annee. The best entry of a key has the highest vote, then the lowest id.
    """
    title = or_default(F.col("titreOriginal"), F.col("titre"))
    probes = [(1, "imdb", present(F.col("imdbId"))), (2, "title_year", _title_year(title, F.col("annee"))),
              (3, "title", _title(title)), (4, "title_year", _title_year(F.col("titre"), F.col("annee"))),
              (5, "title", _title(F.col("titre")))]
    keys = [("imdb", present(F.col("imdb_id"))), ("title_year", _title_year(F.col("title"), F.col("year"))),
            ("title", _title(F.col("title")))]
    order = [-F.coalesce(F.col("vote_average"), F.lit(-1.0)), F.col("id")]
    return _cascade(works, work_id, probes, _entries(tmdb, keys, order))


def match_fallback(works: DataFrame, work_id: str, omdb: DataFrame) -> DataFrame:
    """(work_id, match_rank, hit) in the second catalog: a known imdb id only by id (1), others by title, with the year where known (2)."""
    known = ~is_missing(F.col("imdbId"))
    title, dated = or_default(F.col("titreOriginal"), F.col("titre")), ~is_missing(F.col("annee"), "number")
    probes = [(1, "imdb", F.when(known, F.col("imdbId"))),
              (2, "title_year", F.when(~known & dated, _title_year(title, F.col("annee")))),
              (2, "title", F.when(~known & ~dated, _title(title)))]
    keys = [("imdb", present(F.col("imdbID"))), ("title_year", _title_year(F.col("Title"), X.year_number(F.col("Year")))),
            ("title", _title(F.col("Title")))]
    return _cascade(works, work_id, probes, _entries(omdb, keys, [F.col("imdbID"), F.col("Title")]))


def provider_merge(works: DataFrame, work_id: str, tmdb: DataFrame, omdb: DataFrame) -> DataFrame:
    """Own value, else first catalog, else second; a field list per provider, works without a title untouched."""
    kept = works.columns
    titled = X.work_key(F.col("titreOriginal"), F.col("titre")).isNotNull()
    attach = lambda df, matches, name: df.join(matches.select(work_id, F.col("hit").alias(name)), work_id, "left")
    one = attach(works, match_cascade(works.filter(titled), work_id, tmdb), "t")
    t = lambda c: F.col(f"t.{c}")
    overview = X.ellipsize(present(X.strip(t("overview"))))
    one = one.withColumns({
        "poster": F.coalesce(present(F.col("poster")), X.poster_url(t("poster_path")), F.col("poster")),
        "synopsis": F.coalesce(present(F.col("synopsis")), overview, F.col("synopsis")),
        "imdbRating": F.coalesce(present(F.col("imdbRating"), "number"), t("vote_average"), F.col("imdbRating")),
        "imdbId": F.coalesce(present(F.col("imdbId")), present(t("imdb_id")), F.col("imdbId")),
        "cast": F.coalesce(present(F.col("cast")), X.top_names(t("cast")), F.col("cast")),
    }).drop("t")
    one = staged(one, "first-catalog")  # the second lookup depends on what the first one found
    two = attach(one, match_fallback(one.filter(titled), work_id, omdb), "o")
    o = lambda c: X.na_to_null(F.col(f"o.{c}"))
    return two.withColumns({
        "imdbId": F.coalesce(present(F.col("imdbId")), F.col("o.imdbID"), F.col("imdbId")),
        "poster": F.coalesce(X.na_to_null(present(F.col("poster"))), o("Poster"), F.col("poster")),
        "synopsis": F.coalesce(present(F.col("synopsis")), o("Plot"), F.col("synopsis")),
        "annee": F.coalesce(present(F.col("annee"), "number"), X.year_number(F.col("o.Year")), F.col("annee")),
        "realisateur": F.coalesce(present(F.col("realisateur")), o("Director"), F.col("realisateur")),
        "genres": F.coalesce(present(F.col("genres"), "array"), X.split_list(o("Genre")), F.col("genres")),
        "imdbRating": F.coalesce(present(F.col("imdbRating"), "number"), X.rating_number(F.col("o.imdbRating")),
                                 F.col("imdbRating")),
        "cast": F.coalesce(present(F.col("cast")), o("Actors"), F.col("cast")),
    }).select(*kept)


def representatives(films: DataFrame, key: str, order: list) -> DataFrame:
    """One film per work, the first of the first source; films without a title stand for nothing."""
    return first_per_key(films.filter(F.col(key).isNotNull()), [key], order)


def resolve_fk(facts: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """Attach parent columns by natural key and drop facts whose parent does not exist."""
    return spread_lookup(facts, parents, on, "inner")


def star_join(facts: DataFrame, *dimensions: tuple[DataFrame, str], how: str = "inner", small: int = 0) -> DataFrame:
    """Facts with every dimension attached by its id; facts without one are dropped, or kept if ``how`` is left. One
    sketch serves all dimensions; those of at most ``small`` rows are broadcast and need none."""
    few = [small > 0 and is_small(dimension, small) for dimension, _ in dimensions]
    keys = [[on] for (_, on), s in zip(dimensions, few) if not s]
    hot = iter(heavy_keys(facts, keys) if keys else [])
    for (dimension, on), s in zip(dimensions, few):
        facts = small_lookup(facts, dimension, [on], how) if s else spread_lookup(facts, dimension, [on], how, hot_keys=next(hot))
    return facts
