"""Queries over printed grids, text lines and calendar sentences."""
from pyspark.sql import functions as F

from ..functions import calendar as C, grid as G
from ..operators import documents as O
from . import derived as DI
from .pages import WEEK_SQL
from .registry import query
from .scalars import CAL_SQL

text = lambda c: c.cast("string")
GRID = f"""g AS (SELECT DISTINCT l_suppkey, {WEEK_SQL} AS w, p_brand, l_returnflag AS f, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day,
    (l_linenumber + 10) || ':' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 2, '0') AS heure, CASE l_returnflag WHEN 'A' THEN 'VF' WHEN 'N' THEN 'VOSTFR' ELSE 'VO' END AS version
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def docs(t):
    return DI.grids(t).withColumn("week_text", text(F.col("week")))


def near_week(t):
    """Grids seen up to ten days before or after their week began."""
    return docs(t).withColumn("seen", F.date_add("week", (F.col("l_suppkey") % 21 - 10).cast("int")))


@query("grid_header", f"WITH {GRID} SELECT DISTINCT l_suppkey, CAST(w AS VARCHAR) AS week, 1 AS header_idx FROM g")
def grid_header(t):
    return docs(t).select("l_suppkey", F.col("week_text").alias("week"), G.header_row(F.col("grid")).alias("header_idx"))


@query("grid_col_dates", f"""WITH {GRID} SELECT l_suppkey, CAST(w AS VARCHAR) AS week, CAST(i + 1 AS INTEGER) AS col, CAST(CAST(w + CAST(i AS INTEGER) AS DATE) AS VARCHAR) AS day
    FROM (SELECT DISTINCT l_suppkey, w FROM g), generate_series(0, 6) AS s(i)""")
def grid_col_dates(t):
    """One third knows its week, one third has only day numbers, one third only day names and is seen within its week."""
    level = F.col("l_suppkey") % 3
    mixed = near_week(t).withColumn("grid", F.when(level == 2, F.transform("grid", lambda r: F.transform(
        r, lambda c: F.regexp_replace(c, r"\. \d+$", "")))).otherwise(F.col("grid")))
    mixed = mixed.withColumn("seen", F.when(level == 2, F.date_add("week", 3)).otherwise(F.col("seen")))
    cols = O.grid_columns(mixed, F.col("seen"), F.when(level == 0, F.col("week")))
    return cols.select("l_suppkey", F.col("week_text").alias("week"), F.inline_outer("dates")).select("l_suppkey", "week", "col", text(F.col("date")).alias("day"))


@query("grid_title", f"WITH {GRID} SELECT DISTINCT l_suppkey, CAST(w AS VARCHAR) AS week, upper(p_brand) AS titre, version FROM g")
def grid_title(t):
    cells = docs(t).select("l_suppkey", F.col("week_text").alias("week"), F.explode(F.slice("grid", F.lit(3), F.size("grid"))).alias("cells"))
    return cells.select("l_suppkey", "week", F.inline_outer(F.array(G.title_cell(F.get("cells", F.lit(0))))))


@query("grid_unpivot", f"WITH {GRID} SELECT l_suppkey, CAST(w AS VARCHAR) AS week, day, heure, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY ALL")
def grid_unpivot(t):
    rows = near_week(t).select("l_suppkey", F.col("week_text").alias("week"), F.explode_outer(
        G.grid_rows(F.col("grid"), F.lit(None).cast("date"), F.col("seen"))).alias("f"))
    slots = rows.select("l_suppkey", "week", F.inline("f.slots"))
    return slots.groupBy("l_suppkey", "week", text(F.col("date")).alias("day"), "heure").agg(F.count(F.lit(1)).alias("n"))


@query("grid_programme", f"""WITH {GRID} SELECT l_suppkey || '|' || CAST(w AS VARCHAR) AS doc_id, upper(p_brand) AS titre, version,
    string_agg(day || ' ' || heure, ';' ORDER BY day, heure) AS slots FROM g GROUP BY l_suppkey, w, p_brand, version""")
def grid_programme(t):
    named = near_week(t).withColumn("doc_id", F.concat_ws("|", text(F.col("l_suppkey")), "week_text"))
    films = O.grid_films(named.select("doc_id", "grid", "seen"), F.col("seen"))
    return films.select("doc_id", "titre", "version", F.array_join(F.transform(
        "seances", lambda s: F.concat_ws(" ", text(s["date"]), s["heure"])), ";").alias("slots"))


@query("line_blocks", r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]')) AS raw, generate_subscripts(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]'), 1) AS i FROM documents),
    s AS (SELECT doc_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line, i FROM l), n AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ln FROM s WHERE line <> ''),
    k AS (SELECT *, NOT (regexp_matches(line, '(^|[^\p{L}\p{N}_])\d{1,2}[h:]\d{2}($|[^\p{L}\p{N}_])') OR regexp_matches(line, '(?i)^(VF|VO|VOSTFR?|VFST)$') OR length(line) <= 3) AS opens,
      list_sum(list_transform(['mer','jeu','ven','sam','dim','lun','mar'], lambda d: CAST(contains(lower(line), d) AS INTEGER))) >= 4 AS days FROM n),
    b AS (SELECT *, max(ln) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY ln) AS head FROM k),
    m AS (SELECT b.*, h.days AS head_days FROM b LEFT JOIN k h ON b.doc_id = h.doc_id AND b.head = h.ln),
    x AS (SELECT doc_id, CASE WHEN opens THEN ln WHEN days AND (head IS NULL OR head_days OR ln - head >= 12) THEN ln WHEN head IS NULL OR head_days OR ln - head >= 12 THEN NULL ELSE head END AS block, ln, line FROM m)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS INTEGER) AS no, arg_min(line, ln) AS head, CAST(count(*) AS INTEGER) AS n_lines FROM x WHERE block IS NOT NULL GROUP BY doc_id, block""")
def line_blocks(t):
    found = t.documents.select("doc_id", F.posexplode_outer(O.line_blocks(F.col("text"))).alias("no", "b")).filter("b IS NOT NULL")
    return found.select("doc_id", "no", "b.head", F.size("b.lines").alias("n_lines"))


@query("calendar_expand", f"""WITH {CAL_SQL},
    d AS (SELECT *, CAST(a + CAST(i AS INTEGER) AS DATE) AS day FROM cal, generate_series(0, 6) AS g(i)),
    s AS (SELECT o_orderkey, day, unnest(CASE WHEN k % 3 = 1 THEN [h1] WHEN k % 3 = 0 THEN CASE WHEN isodow(day) = k % 7 + 1 OR isodow(day) = (k + 3) % 7 + 1 THEN [h1, h2] ELSE [] END
        ELSE CASE WHEN isodow(day) = 7 THEN [h2] ELSE [h1] END END) AS heure FROM d)
    SELECT DISTINCT o_orderkey, CAST(day AS VARCHAR) AS day, heure, 'VF' AS version FROM s""")
def calendar_expand(t):
    slots = C.screenings(C.calendar_slots(F.col("txt"), F.col("days"), DI.RUN_DATE), F.lit("VF"))
    rows = DI.calendar_text(t).select("o_orderkey", F.inline_outer(slots)).filter(F.col("date").isNotNull())
    return rows.select("o_orderkey", text(F.col("date")).alias("day"), "heure", "version")
