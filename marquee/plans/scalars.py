"""Queries of the scalar functions, each over a whole table or an input derived from one."""
from pyspark.sql import functions as F

from ..functions import dates as D, html as H, text as X
from ..functions.missing import or_default
from . import derived as DI
from .registry import query

MONTHS_SQL = "['janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre']"
SLUGS_SQL = "['janvier','fevrier','mars','avril','mai','juin','juillet','aout','septembre','octobre','novembre','decembre']"
ANCHOR_SQL = ("(CASE WHEN isodow({d}) = 2 THEN {d} + 1 ELSE {d} - CAST((isodow({d}) + 4) % 7 AS INTEGER) END)")
text = lambda c: c.cast("string")
ODATE = "CAST(o_orderdate AS DATE)"
ANCHOR = f"CAST({ANCHOR_SQL.format(d=ODATE)} AS DATE)"


@query("date_fr", f"SELECT o_orderkey, CAST({ODATE} AS VARCHAR) AS day FROM orders")
def date_fr(t):
    return DI.date_text(t).select("o_orderkey", text(D.date_fr(F.col("txt"), DI.RUN_DATE)).alias("day"))


@query("year", f"SELECT o_orderkey, CAST(year({ODATE}) AS INTEGER) AS annee FROM orders")
def year(t):
    return DI.date_text(t).select("o_orderkey", D.year_in(F.col("txt")).alias("annee"))


@query("heure", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN strftime(ts, '%H:00') ELSE strftime(ts, '%H:%M') END AS heure FROM events")
def heure(t):
    return DI.time_text(t).select("event_id", D.heure(F.col("txt")).alias("heure"))


@query("time_pad", """SELECT event_id, strftime(ts, '%H:%M') || ':00' AS padded, strftime(ts, '%H:%M') AS back FROM events""")
def time_pad(t):
    padded = D.time_seconds(F.date_format("ts", "HH:mm"))
    return t.events.select("event_id", padded.alias("padded"), D.time_minutes(padded).alias("back"))


@query("version", """SELECT doc_id, CASE WHEN upper(text) LIKE '%VOST%' THEN 'VOSTFR' WHEN upper(text) LIKE '%VFST%' THEN 'VFST'
    WHEN upper(text) LIKE '%VO%' THEN 'VO' ELSE 'VF' END AS version FROM documents""")
def version(t):
    return t.documents.select("doc_id", X.version_code(F.col("text")).alias("version"))


@query("version_prose", """SELECT doc_id, CASE WHEN lower(text) LIKE '%sous-titr%' OR lower(text) LIKE '%vost%' THEN 'VOSTFR'
    WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])vo($|[^\\p{L}\\p{N}_])') AND NOT lower(text) LIKE '%version française%' THEN 'VO'
    ELSE 'VF' END AS version FROM documents""")
def version_prose(t):
    return t.documents.select("doc_id", X.version_from_prose(F.col("text")).alias("version"))


@query("version_node", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'O' THEN
    CASE l_returnflag WHEN 'A' THEN 'VF' WHEN 'N' THEN 'VOSTFR' ELSE 'VO' END
    ELSE CASE l_returnflag WHEN 'N' THEN 'VOSTFR' WHEN 'R' THEN 'VO' ELSE 'VF' END END AS version,
    CASE l_returnflag WHEN 'N' THEN 'VOSTFR' WHEN 'R' THEN 'VO' ELSE 'VF' END AS own FROM lineitem""")
def version_node(t):
    said = DI.version_text(F.col("l_returnflag"))
    whole = F.concat(F.lit("salle 1 "), said)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             X.version_from_node(F.when(F.col("l_linestatus") == "O", said), whole).alias("version"),
                             X.version_override(whole, F.lit("VF")).alias("own"))


@query("week_map", f"""SELECT o_orderkey, CAST(k AS INTEGER) AS weekday, CAST(({ANCHOR} + CAST((k + 4) % 7 AS INTEGER)) AS VARCHAR)[:10] AS day
    FROM orders, generate_series(1, 7) AS g(k)""")
def week_map(t):
    m = DI.week_text(t).select("o_orderkey", F.explode(D.week_map(F.col("txt"))).alias("weekday", "d"))
    return m.select("o_orderkey", "weekday", text(F.col("d")).alias("day"))


@query("doc_week_start", f"SELECT o_orderkey, CAST({ANCHOR} AS VARCHAR)[:10] AS week_start FROM orders")
def doc_week_start(t):
    return DI.week_text(t).select("o_orderkey", text(D.period_start(F.col("txt"))).alias("week_start"))


@query("week_anchor", f"SELECT o_orderkey, CAST({ANCHOR} AS VARCHAR)[:10] AS week_start FROM orders")
def week_anchor(t):
    return t.orders.select("o_orderkey", text(D.week_anchor(DI.day_of(F.col("o_orderdate")))).alias("week_start"))


URL_SQL = f"""'https://cinema.example/pdf/cinema-lyon-comoedia-semaine-du-' || day(a) ||
    CASE WHEN month(a) = month(a + 6) THEN '' ELSE '-' || {SLUGS_SQL}[month(a)] END || '-au-' || day(a + 6) || '-' || {SLUGS_SQL}[month(a + 6)]
    || '-' || year(a + 6) || '.pdf'"""


@query("predict_url", f"SELECT o_orderkey, {URL_SQL} AS url FROM (SELECT o_orderkey, {ANCHOR} AS a FROM orders)")
def predict_url(t):
    return t.orders.select("o_orderkey", D.weekly_url(D.week_anchor(DI.day_of(F.col("o_orderdate"))), DI.SITE).alias("url"))


@query("slug_week", f"SELECT o_orderkey, CAST({ANCHOR} AS VARCHAR)[:10] AS first_day, CAST(CAST({ANCHOR} + 6 AS DATE) AS VARCHAR) AS last_day FROM orders")
def slug_week(t):
    url = D.weekly_url(D.week_anchor(DI.day_of(F.col("o_orderdate"))), DI.SITE)
    week = t.orders.select("o_orderkey", D.slug_week(url).alias("w"))
    return week.select("o_orderkey", text(F.col("w.start")).alias("first_day"), text(F.col("w.end")).alias("last_day"))


@query("recent_weeks", f"SELECT o_orderkey, CAST(n AS INTEGER) AS n, CAST(CAST({ANCHOR} - CAST(7 * n AS INTEGER) AS DATE) AS VARCHAR) AS week_start FROM orders, generate_series(0, 2) AS g(n)")
def recent_weeks(t):
    weeks = D.recent_weeks(DI.day_of(F.col("o_orderdate")))
    return t.orders.select("o_orderkey", F.posexplode(weeks).alias("n", "d")).select("o_orderkey", "n", text(F.col("d")).alias("week_start"))


@query("nearest_date", f"""WITH r AS (SELECT o_orderkey, {ODATE} AS d, CAST({ODATE} - CAST(o_orderkey % 57 - 28 AS INTEGER) AS DATE) AS target FROM orders),
    c AS (SELECT o_orderkey, CAST(d + CAST(i AS INTEGER) AS DATE) AS day, i FROM r, generate_series(-28, 28) AS g(i)
          WHERE day(d + CAST(i AS INTEGER)) = day(target) AND isodow(d + CAST(i AS INTEGER)) = isodow(target))
    SELECT o_orderkey, CAST(arg_min(day, abs(i) * 2 + CASE WHEN i > 0 THEN 1 ELSE 0 END) AS VARCHAR) AS day FROM c GROUP BY o_orderkey""")
def nearest_date(t):
    run = DI.day_of(F.col("o_orderdate"))
    target = F.date_sub(run, (F.col("o_orderkey") % 57 - 28).cast("int"))
    return t.orders.select("o_orderkey", text(D.nearest_day(run, F.dayofmonth(target), D.iso_weekday(target))).alias("day"))


@query("title_key", r"SELECT p_partkey, lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) AS title_key FROM part")
def title_key(t):
    messy = F.concat(F.lit("  "), F.upper(F.replace("p_name", F.lit(" "), F.lit(" \t "))), F.lit("\n"))
    return t.part.select("p_partkey", X.title_key(messy).alias("title_key"))


@query("slugify", "SELECT s_suppkey, replace(replace(lower(s_name), ' ', '-'), 'è', 'e') AS slug FROM supplier")
def slugify(t):
    return t.supplier.select("s_suppkey", X.slugify(F.col("s_name")).alias("slug"))


@query("url_encode", "SELECT p_partkey, replace(replace(url_encode(p_name || ' é/&*~' || p_brand), '+', '%20'), '*', '%2A') AS encoded FROM part")
def url_encode(t):
    return t.part.select("p_partkey", X.url_quote(F.concat("p_name", F.lit(" é/&*~"), "p_brand")).alias("encoded"))


@query("truncate", "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END AS short FROM documents")
def truncate(t):
    return t.documents.select("doc_id", X.ellipsize(F.col("text")).alias("short"))


@query("duration", "SELECT p_partkey, CAST(p_size + 60 AS INTEGER) AS duree FROM part")
def duration(t):
    return DI.duration_text(t).select("p_partkey", D.duration_minutes(F.col("txt")).alias("duree"))


@query("director", """SELECT p_partkey, 'Ana ' || p_name AS prose, 'Jean ' || upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS lead FROM part""")
def director(t):
    prose = F.concat(F.lit("Film. Réalisé par Ana "), "p_name", F.lit(",, avec B. Suite"))
    lead = F.concat(F.lit(" De Jean "), F.initcap(F.split("p_name", " ")[0]), F.lit(" · 2h"))
    return t.part.select("p_partkey", X.director_prose(prose).alias("prose"),
                         X.director_lead(F.regexp_replace(lead, "De ", "de ")).alias("lead"))


@query("lead_words", "SELECT p_partkey, p_name || ', ' || p_brand AS actors, p_name AS director FROM part")
def lead_words(t):
    return t.part.select("p_partkey", X.without_lead(F.concat(F.lit("AVEC  "), "p_name", F.lit(", "), "p_brand"), "Avec").alias("actors"),
                         X.without_lead(F.concat(F.lit("de "), "p_name"), "de").alias("director"))


@query("synopsis", """SELECT p_partkey, 'Une histoire très longue de ' || p_name AS synopsis FROM part""")
def synopsis(t):
    prose = F.concat(F.lit("Film documentaire en 2020. Une histoire très longue de "), "p_name", F.lit("  Séances prévues lundi 10h00"))
    return t.part.select("p_partkey", X.synopsis_prose(prose).alias("synopsis"))


@query("href_slug", r"""SELECT page_id, nullif(regexp_extract(u, '/film/([^/?#.]+)', 1), '') AS slug FROM (SELECT page_id,
    '/film/' || regexp_extract(url, '/([a-z]{2}/[0-9]+)', 1)[:2] || '-' || page_id || CASE WHEN page_id % 2 = 0 THEN '.html?x' ELSE '' END AS u FROM pages)""")
def href_slug(t):
    href = F.concat(F.regexp_extract("url", "https?://([a-z.]+)", 0), F.lit("/film/"), F.substring(F.regexp_extract("url", "/([a-z]{2}/[0-9]+)", 1), 1, 2),
                    F.lit("-"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".html?x").otherwise(""))
    return t.pages.select("page_id", X.href_slug(href).alias("slug"))


@query("dt_slice", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M') AS heure FROM events WHERE event_id % 3 < 2")
def dt_slice(t):
    raw = F.when(F.col("event_id") % 3 < 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    cut = t.events.select("event_id", D.slice_timestamp(raw).alias("x")).filter(F.col("x").isNotNull())
    return cut.select("event_id", text(F.col("x.date")).alias("day"), "x.heure")


@query("footnote", """SELECT l_orderkey, l_linenumber, l_partkey, (l_linenumber + 10) || 'h' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 2, '0') AS printed FROM lineitem""")
def footnote(t):
    noted = F.concat("printed", F.col("l_linenumber").cast("string"))
    return DI.screenings(t).select("l_orderkey", "l_linenumber", "l_partkey", D.drop_footnote(noted).alias("printed"))


@query("title_clean", "SELECT p_partkey, upper(p_name) AS titre FROM part")
def title_clean(t):
    return t.part.select("p_partkey", X.clean_title(F.concat(F.lit(" "), F.upper(F.replace("p_name", F.lit(" "), F.lit("  "))), F.lit(" JP "))).alias("titre"))


@query("version_token", "SELECT p_partkey, p_brand AS token FROM part")
def version_token(t):
    tail = F.element_at(F.array(*map(F.lit, [" / INT -12", " INT", " ANS 6", " AVERTISSEMENT x"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", X.version_token(F.concat("p_brand", tail)).alias("token"))


@query("fold", "SELECT doc_id, md5(translate(text, 'éèêûîâô', 'eeeuiao')) AS folded FROM documents")
def fold(t):
    return t.documents.select("doc_id", F.md5(X.fold_accents(F.col("text")).cast("binary")).alias("folded"))


OMDB_SQL = """(SELECT 'tt' || i AS imdbID, p_name AS Title, i, y FROM (SELECT p_name, min(p_partkey) AS i, min(p_size % 10 + 1990) AS y FROM part GROUP BY p_name))"""


@query("na_null", f"""SELECT imdbID, CASE WHEN i % 3 = 0 THEN NULL ELSE 'https://img.example/' || i END AS poster, CAST(y AS INTEGER) AS annee,
    CASE WHEN i % 7 = 0 THEN NULL ELSE CAST(i % 9 AS DOUBLE) + 0.5 END AS rating FROM {OMDB_SQL}""")
def na_null(t):
    return DI.omdb(t).select("imdbID", X.na_to_null(F.col("Poster")).alias("poster"), X.year_number(F.col("Year")).alias("annee"),
                             X.rating_number(F.col("imdbRating")).alias("rating"))


@query("genres", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: trim(x)), '|') AS genres, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n FROM part")
def genres(t):
    g = X.split_list(F.replace("p_name", F.lit(" "), F.lit(" , ")))
    return t.part.select("p_partkey", F.array_join(g, "|").alias("genres"), F.size(g).alias("n"))


TMDB_SQL = """(SELECT p_name AS title, p_size % 10 + 1990 AS year, min(p_partkey) AS id FROM part WHERE length(p_name) % 3 <> 0 GROUP BY 1, 2)"""


@query("poster_url", f"SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE 'https://image.tmdb.org/t/p/w500/' || id || '.jpg' END AS poster FROM {TMDB_SQL}")
def poster_url(t):
    return DI.tmdb(t).select("id", X.poster_url(F.col("poster_path")).alias("poster"))


@query("top_cast", f"SELECT id, array_to_string(list_filter(list_transform([0, 1, 2], lambda n: CASE WHEN (id + n) % 4 = 0 THEN '' ELSE 'actor ' || n || ' ' || id END), lambda x: x <> ''), ', ') AS actors FROM {TMDB_SQL}")
def top_cast(t):
    return DI.tmdb(t).select("id", X.top_names(F.col("cast")).alias("actors"))


@query("defaults", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE 'Le Comoedia' END AS cinema,
    CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE '' END AS realisateur, CAST(CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_genres FROM part""")
def defaults(t):
    own = lambda c: F.when(F.col("p_partkey") % 4 == 0, F.col(c)).when(F.col("p_partkey") % 4 == 1, F.lit(""))
    genres = F.when(F.col("p_partkey") % 4 == 0, F.array("p_type"))
    return t.part.select("p_partkey", or_default(own("p_name"), F.lit(DI.D.K.DEFAULT_VENUE)).alias("cinema"),
                         or_default(own("p_brand"), F.lit("")).alias("realisateur"),
                         F.size(or_default(genres, F.array().cast("array<string>"), "array")).alias("n_genres"))


CAL_SQL = f"""cal AS (SELECT o_orderkey, o_orderkey AS k, {ANCHOR} AS a, o_orderkey % 12 + 10 || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS h1,
    (o_orderkey + 5) % 12 + 10 || ':' || lpad(CAST((o_orderkey + 5) % 60 AS VARCHAR), 2, '0') AS h2 FROM orders)"""


@query("times_in_text", f"WITH {CAL_SQL} SELECT o_orderkey, CASE WHEN k % 3 = 1 OR h1 = h2 THEN h1 ELSE h1 || '|' || h2 END AS times FROM cal")
def times_in_text(t):
    return DI.calendar_text(t).select("o_orderkey", F.array_join(D.distinct_times(F.col("txt")), "|").alias("times"))


@query("strip_html", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g')) AS plain FROM pages""")
def strip_html(t):
    return t.pages.select("page_id", H.strip_tags(F.col("html")).alias("plain"))
