"""Queries that group, deduplicate, fill and match."""
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dates import programme_week
from ..operators import calendar as W, dedup, fill, grouping as G, match as M, profile as P
from . import derived as DI
from .pages import WEEK_SQL
from .registry import query
from .scalars import OMDB_SQL

text = lambda c: c.cast("string")
HEURE_SQL = "(l_linenumber + 10) || ':' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 2, '0')"
VERSION_SQL = "CASE l_returnflag WHEN 'A' THEN 'VF' WHEN 'N' THEN 'VOST' ELSE 'VO' END"
DAY_SQL = "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)"


def line(c="seances", fields=("date", "heure", "version")):
    return F.array_join(F.transform(c, lambda s: F.concat_ws(" ", *[text(s[f]) for f in fields])), ";").alias("slots")


# --- dedup, order, top ------------------------------------------------------------------------------------------

@query("dedup_first", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value
    FROM events GROUP BY CAST(ts AS DATE), user_id, event_type""")
def dedup_first(t):
    rows = t.events.select(text(F.col("ts").cast("date")).alias("day"), "user_id", "event_type", "event_id", "value")
    return dedup.first_per_key(rows, ["day", "user_id", "event_type"], ["event_id"])


SLOTS = f"""s AS (SELECT DISTINCT l_suppkey, l_partkey, p_brand, {WEEK_SQL} AS w, {DAY_SQL} AS day, {HEURE_SQL} AS heure, {VERSION_SQL} AS version FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("group_nested", f"""WITH {SLOTS} SELECT l_partkey, l_suppkey, CAST(w AS VARCHAR) AS week, string_agg(day || ' ' || heure || ' ' || version, ';' ORDER BY day, heure, version) AS slots
    FROM s GROUP BY l_partkey, l_suppkey, w""")
def group_nested(t):
    rows = DI.screenings(t).withColumn("week", text(programme_week(F.col("date"))))
    return G.nest_screenings(rows, ["l_partkey", "l_suppkey", "week"]).select("l_partkey", "l_suppkey", "week", line())


@query("sorted_nested", f"""WITH d AS (SELECT l_suppkey, {WEEK_SQL} AS w, {DAY_SQL} AS day, {HEURE_SQL} AS heure, {VERSION_SQL} AS version, min({{'o': l_orderkey, 'l': l_linenumber}}) AS pos FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, CAST(w AS VARCHAR) AS week, string_agg(day || ' ' || heure || ' ' || version, ';' ORDER BY day, heure, pos, version) AS slots FROM d GROUP BY l_suppkey, w""")
def sorted_nested(t):
    rows = DI.screenings(t).withColumns({"week": text(programme_week(F.col("date"))), "pos": F.struct("l_orderkey", "l_linenumber")})
    first = G.dedup_screenings(rows, ["l_suppkey", "week"], "pos")
    return G.nest_screenings(first, ["l_suppkey", "week"], "pos").select("l_suppkey", "week", line())


@query("representative", "SELECT lower(p_name) AS work, arg_min(p_partkey, (p_partkey % 2, p_partkey)) AS p_partkey, arg_min(p_brand, (p_partkey % 2, p_partkey)) AS p_brand FROM part GROUP BY 1")
def representative(t):
    films = t.part.select(X.work_key(F.lit(None).cast("string"), F.col("p_name")).alias("work"), "p_partkey", "p_brand", (F.col("p_partkey") % 2).alias("src_order"))
    return M.representatives(films, "work", ["src_order", "p_partkey"]).drop("src_order")


@query("topk", "SELECT p_brand, n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) ORDER BY n DESC, p_brand LIMIT 5")
def topk(t):
    return dedup.top_k(t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.col("p_brand")], 5)


@query("title_groups", "SELECT lower(p_name) AS work, count(*) AS n, count(DISTINCT p_brand) AS n_brands, min(p_partkey) AS first_part FROM part GROUP BY 1")
def title_groups(t):
    return t.part.groupBy(X.title_key(F.col("p_name")).alias("work")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("n_brands"), F.min("p_partkey").alias("first_part"))


# --- fill -------------------------------------------------------------------------------------------------------

def patchy(t):
    """Events as copies of a work (one per user): fields are there only now and then, sometimes as '' or 0."""
    e = F.col("event_id")
    return t.events.select("event_id", F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("work"),
                           F.when(e % 3 == 0, F.concat(F.lit("p"), text(e))).when(e % 3 == 1, F.lit("")).alias("poster"),
                           F.when(e % 7 == 0, F.col("value")).otherwise(0.0).alias("rating"),
                           F.when(e % 4 == 0, F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("genres"))


PATCHY = """p AS (SELECT event_id, CASE WHEN user_id % 5 > 0 THEN user_id END AS work, CASE WHEN event_id % 3 = 0 THEN 'p' || event_id WHEN event_id % 3 = 1 THEN '' END AS poster,
    CASE WHEN event_id % 7 = 0 THEN value ELSE 0.0 END AS rating, CASE WHEN event_id % 4 = 0 THEN event_type ELSE '' END AS genres FROM events),
    b AS (SELECT work, arg_min(poster, event_id) FILTER (poster <> '') AS poster, arg_min(rating, event_id) FILTER (rating <> 0) AS rating, arg_min(genres, event_id) FILTER (genres <> '') AS genres, count(*) AS n_rows
          FROM p WHERE work IS NOT NULL GROUP BY work)"""
FIELDS = {"poster": "string", "rating": "number", "genres": "array"}


@query("best_field", f"WITH {PATCHY} SELECT * FROM b")
def best_field(t):
    best = G.best_fields(patchy(t).filter("work IS NOT NULL"), "work", FIELDS, F.col("event_id"))
    return best.withColumn("genres", F.array_join("genres", ","))


@query("propagate_fill", f"""WITH {PATCHY} SELECT event_id, p.work, coalesce(nullif(p.poster, ''), b.poster, p.poster) AS poster, coalesce(nullif(p.rating, 0), b.rating, p.rating) AS rating,
    coalesce(nullif(p.genres, ''), b.genres, p.genres) AS genres FROM p LEFT JOIN b ON p.work = b.work""")
def propagate_fill(t):
    return fill.propagate_fill(patchy(t), "work", FIELDS, F.col("event_id")).withColumn("genres", F.array_join("genres", ","))


@query("carry_forward", """SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'none') AS section FROM events""")
def carry_forward(t):
    known = F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type"))
    return fill.carry_forward(t.events.select("event_id", "user_id", "event_type"), "user_id", "event_id", known, "none", "section").drop("event_type")


@query("detail_fill", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE nullif(c_mktsegment, '') END AS poster,
    CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE coalesce(nullif(CAST(c_nationkey AS INTEGER), 0), CASE WHEN o_orderkey % 3 = 1 THEN 0 END) END AS annee FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def detail_fill(t):
    k = F.col("o_orderkey")
    films = t.orders.select("o_orderkey", F.col("o_custkey").alias("slug"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("poster"),
                            F.when(k % 3 == 0, 7).when(k % 3 == 1, 0).alias("annee"))
    details = t.customer.select(F.col("c_custkey").alias("slug"), F.col("c_mktsegment").alias("poster"), F.col("c_nationkey").alias("annee"))
    return fill.detail_fill(films, details, "slug", {"poster": "string", "annee": "number"}).drop("slug")


# --- joins ------------------------------------------------------------------------------------------------------

@query("resolve_fk", """SELECT l_orderkey, l_linenumber, l_suppkey, p_partkey AS film_id FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000) ON l_suppkey = s_suppkey""")
def resolve_fk(t):
    facts = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    films = t.part.select("p_partkey", F.col("p_partkey").alias("film_id"))
    cinemas = t.supplier.filter("s_acctbal > 1000").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("known"))
    return M.resolve_fk(M.resolve_fk(facts, films, ["p_partkey"]), cinemas, ["l_suppkey"]).drop("known", "p_partkey")


@query("star_join", f"""SELECT l_orderkey, l_linenumber, p_name, p_brand, s_name, {DAY_SQL} AS day, {HEURE_SQL} AS heure FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""")
def star_join(t):
    facts = DI.screenings(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text(F.col("date")).alias("day"), "heure")
    films = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    cinemas = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return M.star_join(facts, (films, "l_partkey"), (cinemas, "l_suppkey")).drop("l_partkey", "l_suppkey")


WORKS = """w AS (SELECT p_partkey AS work_id, CASE WHEN p_partkey % 11 = 0 THEN 'fr ' || p_name ELSE p_name END AS titre, CASE WHEN p_partkey % 5 = 0 THEN ' ' || upper(p_name) WHEN p_partkey % 5 = 1 THEN '' END AS original,
    CASE WHEN p_partkey % 3 > 0 THEN p_size % 10 + 1990 END AS annee, CASE WHEN p_partkey % 7 = 0 THEN 'tt' || p_partkey % 50 END AS imdb FROM part),
    k AS (SELECT *, lower(trim(coalesce(nullif(original, ''), titre))) AS k1, lower(titre) AS k2 FROM w)"""
TMDB = """t AS (SELECT *, (id * 7 % 100) / 10.0 AS vote, CASE WHEN id % 2 = 0 THEN 'tt' || id END AS timdb FROM (SELECT p_name AS title, p_size % 10 + 1990 AS year, min(p_partkey) AS id FROM part WHERE length(p_name) % 3 <> 0 GROUP BY 1, 2)),
    ti AS (SELECT timdb AS k, arg_min(id, (-vote, id)) AS id FROM t WHERE timdb IS NOT NULL GROUP BY 1), ty AS (SELECT title AS k, year AS y, arg_min(id, (-vote, id)) AS id FROM t GROUP BY 1, 2),
    tt AS (SELECT title AS k, arg_min(id, (-vote, id)) AS id FROM t GROUP BY 1),
    m AS (SELECT k.work_id, CASE WHEN a.id IS NOT NULL THEN 1 WHEN b.id IS NOT NULL THEN 2 WHEN c.id IS NOT NULL THEN 3 WHEN d.id IS NOT NULL THEN 4 WHEN e.id IS NOT NULL THEN 5 END AS match_rank,
        coalesce(a.id, b.id, c.id, d.id, e.id) AS tmdb_id FROM k LEFT JOIN ti a ON k.imdb = a.k LEFT JOIN ty b ON k.k1 = b.k AND k.annee = b.y LEFT JOIN tt c ON k.k1 = c.k
        LEFT JOIN ty d ON k.k2 = d.k AND k.annee = d.y LEFT JOIN tt e ON k.k2 = e.k)"""
OMDB = f"o AS (SELECT *, lower(Title) AS k FROM {OMDB_SQL})"


@query("match_cascade", f"WITH {WORKS}, {TMDB} SELECT work_id, match_rank, tmdb_id FROM m WHERE match_rank IS NOT NULL")
def match_cascade(t):
    return M.match_cascade(DI.works(t), "work_id", DI.tmdb(t)).select("work_id", "match_rank", F.col("hit.id").alias("tmdb_id"))


@query("match_fallback", f"""WITH {WORKS}, {OMDB} SELECT work_id, CASE WHEN imdb IS NOT NULL THEN 1 ELSE 2 END AS match_rank, imdbID AS omdb_id FROM k JOIN o ON
    CASE WHEN imdb IS NOT NULL THEN k.imdb = o.imdbID WHEN annee IS NOT NULL THEN k.k1 = o.k AND k.annee = o.y ELSE k.k1 = o.k END""")
def match_fallback(t):
    return M.match_fallback(DI.works(t), "work_id", DI.omdb(t)).select("work_id", "match_rank", F.col("hit.imdbID").alias("omdb_id"))


@query("provider_merge", f"""WITH {WORKS}, {TMDB}, {OMDB},
    s1 AS (SELECT k.*, t.id, t.timdb, t.vote, t.title FROM k LEFT JOIN m ON k.work_id = m.work_id LEFT JOIN t ON m.tmdb_id = t.id),
    s2 AS (SELECT work_id, k1, annee, CASE WHEN work_id % 4 = 0 THEN 'own.jpg' WHEN id IS NOT NULL AND id % 5 <> 0 THEN 'https://image.tmdb.org/t/p/w500/' || id || '.jpg' ELSE '' END AS poster,
        CASE WHEN work_id % 6 = 0 THEN 'own text' WHEN id % 4 <> 0 THEN 'story of ' || title END AS synopsis, coalesce(imdb, timdb) AS imdb,
        CASE WHEN work_id % 9 = 0 THEN 5.5 ELSE coalesce(vote, 0.0) END AS rating,
        nullif(CASE WHEN id IS NOT NULL THEN array_to_string(list_filter(list_transform([0, 1, 2], lambda n: CASE WHEN (id + n) % 4 = 0 THEN '' ELSE 'actor ' || n || ' ' || id END), lambda x: x <> ''), ', ') END, '') AS actors FROM s1),
    s3 AS (SELECT s2.*, o.imdbID, o.i, o.y, o.Title FROM s2 LEFT JOIN o ON CASE WHEN imdb IS NOT NULL THEN s2.imdb = o.imdbID WHEN annee IS NOT NULL THEN s2.k1 = o.k AND s2.annee = o.y ELSE s2.k1 = o.k END)
    SELECT work_id, coalesce(nullif(poster, ''), CASE WHEN i % 3 > 0 THEN 'https://img.example/' || i END, '') AS poster, coalesce(synopsis, CASE WHEN i % 4 > 0 THEN 'plot of ' || Title END) AS synopsis,
    coalesce(imdb, imdbID) AS imdbId, CAST(coalesce(nullif(rating, 0), CASE WHEN i % 7 > 0 THEN i % 9 + 0.5 END, rating) AS DOUBLE) AS imdbRating, coalesce(actors, CASE WHEN i % 8 > 0 THEN 'star ' || i END) AS actors,
    CAST(coalesce(annee, y) AS INTEGER) AS annee, CASE WHEN work_id % 8 = 0 THEN 'own name' ELSE coalesce(CASE WHEN i % 5 > 0 THEN 'director ' || i END, '') END AS realisateur,
    CASE WHEN work_id % 10 = 0 THEN 'own' WHEN i % 6 > 0 THEN 'Drama|Comedy|War' ELSE '' END AS genres FROM s3""")
def provider_merge(t):
    merged = M.provider_merge(DI.own_fields(t), "work_id", DI.tmdb(t), DI.omdb(t))
    return merged.select("work_id", "poster", "synopsis", "imdbId", "imdbRating", F.col("cast").alias("actors"), "annee", "realisateur",
                         F.array_join("genres", "|").alias("genres"))


@query("catalog_parse", """SELECT event_id, CAST(props->>'k' AS BIGINT) AS id, 'film ' || CAST(props->>'k' AS VARCHAR) AS title, CAST(value AS DOUBLE) AS vote FROM events""")
def catalog_parse(t):
    from ..sources.readers import parse_answer
    answer = F.concat(F.lit('{"id": '), F.get_json_object("props", "$.k"), F.lit(', "title": "film '), F.get_json_object("props", "$.k"),
                      F.lit('", "vote_average": '), text(F.col("value")), F.lit(', "cast": [{"name": "x"}]}'))
    a = t.events.select("event_id", parse_answer(answer, "tmdb").alias("a"))
    return a.select("event_id", "a.id", "a.title", F.col("a.vote_average").alias("vote"))


# --- windows, counts, checks ------------------------------------------------------------------------------------

@query("current_week", f"SELECT l_orderkey, l_linenumber, l_partkey, {DAY_SQL} AS day FROM lineitem WHERE l_shipdate >= DATE '1997-03-12' AND l_shipdate < DATE '1997-03-19'")
def current_week(t):
    kept = t.lineitem.filter(W.timestamp_range("l_shipdate", DI.RUN_DATE))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", text(DI.day_of(F.col("l_shipdate"))).alias("day"))


@query("nonempty_groups", f"""WITH {SLOTS} SELECT l_suppkey, p_brand, count(*) AS n FROM s WHERE day >= '1997-03-14' AND day < '1997-03-21' GROUP BY l_suppkey, p_brand, w""")
def nonempty_groups(t):
    films = W.current_week_nested(DI.film_rows(t, "1997-03-14").withColumn("seances", F.array_distinct("seances")), "1997-03-14")
    return films.select(F.replace("cinema", F.lit("Salle "), F.lit("")).cast("bigint").alias("l_suppkey"), F.col("titre").alias("p_brand"), F.size("seances").cast("bigint").alias("n"))


@query("range_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'")
def range_filter(t):
    day = F.col("o_orderdate")
    first, last = (F.lit(d).cast("timestamp_ntz") for d in ("1997-01-01", "1997-03-31"))
    return t.orders.filter((F.col("o_orderstatus") == "F") & (day >= first) & (day <= last)).select("o_orderkey", "o_totalprice")


@query("exact_count", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def exact_count(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("run_report", "SELECT o_orderstatus AS source, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_works, count(*) FILTER (o_totalprice > 100000) AS n_rich FROM orders GROUP BY 1")
def run_report(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("source")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("n_works"), F.count_if(F.col("o_totalprice") > 100000).alias("n_rich"))


@query("dq_checks", """SELECT array_to_string(list_filter([CASE WHEN c < 4 THEN 'Expected ≥4 cinemas, got ' || c END, CASE WHEN f < 10 THEN 'Expected ≥10 films, got ' || f END, CASE WHEN j < 1 THEN 'No seances found' END,
    CASE WHEN g < 10 THEN 'Expected ≥10 film+cinema groups, got ' || g END], lambda x: x IS NOT NULL), '; ') AS failures, c AS n_cinemas, f AS n_films, j AS n_joined, g AS n_groups FROM
    (SELECT (SELECT count(DISTINCT r_name) FROM region) AS c, (SELECT count(DISTINCT p_name) FROM part) AS f, count(*) AS j, count(DISTINCT (p_brand, s_nationkey)) AS g
     FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)""")
def dq_checks(t):
    rows = M.star_join(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), (t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"),
                       (t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey"))
    one = lambda df, n: df.agg(n.alias("n")).withColumn("k", F.lit(1))
    counts = (one(t.region, F.count_distinct("r_name")).withColumnRenamed("n", "n_cinemas")
              .join(one(t.part, F.count_distinct("p_name")).withColumnRenamed("n", "n_films"), "k")
              .join(rows.agg(F.count(F.lit(1)).alias("n_joined"), F.count_distinct("p_brand", "s_nationkey").alias("n_groups")).withColumn("k", F.lit(1)), "k"))
    said = P.dq_failures(*map(F.col, ["n_cinemas", "n_films", "n_joined", "n_groups"]))
    return counts.select(F.array_join(said, "; ").alias("failures"), "n_cinemas", "n_films", "n_joined", "n_groups")


@query("union_sources", """SELECT 'customer' AS source, 0 AS src_order, c_custkey AS row_order, c_name AS name, c_mktsegment AS segment FROM customer
    UNION ALL SELECT 'supplier', 1, s_suppkey, s_name, NULL FROM supplier""")
def union_sources(t):
    from .weekly import union_sources as union
    one = t.customer.select(F.col("c_custkey").alias("row_order"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    two = t.supplier.select(F.col("s_suppkey").alias("row_order"), F.col("s_name").alias("name"))
    return union([("customer", one), ("supplier", two)])


@query("week_programme", f"""WITH s AS (SELECT DISTINCT p_brand, n_name, {DAY_SQL} AS day, {HEURE_SQL} AS heure, {VERSION_SQL} AS version FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey WHERE l_shipdate >= DATE '1997-03-12' AND l_shipdate < DATE '1997-03-19')
    SELECT p_brand AS film, n_name AS cinema, count(*) AS n, string_agg(day || ' ' || heure || ' ' || version, ';' ORDER BY day, heure, version) AS slots FROM s GROUP BY p_brand, n_name""")
def week_programme(t):
    """The week of the run date, by film and cinema: a pushed date range, dimension lookups, then bounded lists."""
    week = t.lineitem.filter(W.timestamp_range("l_shipdate", DI.RUN_DATE))
    shown = week.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", DI.day_of(F.col("l_shipdate")).alias("date"), DI.start_time(":").alias("heure"),
                        DI.version_text(F.col("l_returnflag")).alias("version"))
    cinemas = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("cinema"))
    rows = M.star_join(shown, (t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("film")), "l_partkey"), (cinemas, "l_suppkey"))
    nested = G.nest_screenings(rows, ["film", "cinema"])
    return nested.select("film", "cinema", F.size("seances").cast("bigint").alias("n"), line())
