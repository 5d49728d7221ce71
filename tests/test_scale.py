"""Steps whose cost per row or whose spread over tasks was too much on large tables."""
import datetime as dt
import random
import re

from pyspark.sql import functions as F

from marquee import constants as K
from marquee.functions import dates as D, grid as G, html as H
from marquee.operators import documents as O, profile as P
from marquee.plans import derived as DI


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_nearest_day_is_that_of_brute_force(spark):
    run = dt.date(2026, 3, 11)
    rows = [(n, w) for n in [None, *range(1, 32)] for w in [None, *range(0, 9)]]
    found = spark.createDataFrame(rows, "n int, w int").select("n", "w", D.nearest_day(run, F.col("n"), F.col("w")).alias("d"))
    near = [run + dt.timedelta(x) for x in sorted(range(-28, 29), key=lambda x: (abs(x), x))]
    for r in found.collect():
        assert r.d == next((d for d in near if d.day == r.n and d.isoweekday() == r.w), None), r


def test_near_date_is_searched_once(spark):
    cols = spark.createDataFrame([(["", "MERCREDI. 4", "jeu", "x", "samedi 7"],)], "h array<string>").select(
        G.col_dates(F.col("h"), F.lit(None).cast("date"), "2026-03-11").alias("c"))
    assert [(c.col, str(c.date)) for c in cols.head().c] == [(1, "2026-03-04"), (2, "2026-03-05"), (4, "2026-03-07")]
    assert plan(cols).count("dayofmonth") == 1


def test_header_row_wherever_it_stands(spark):
    head, other = ["MER", "jeudi 3", "Ven.", "LUNDI"], ["mercure", "jeudi", None, "-"]
    grids = [[head], [other, head], [other, None, ["jeu"], head, head], [other], [], None, [None, head]]
    rows = spark.createDataFrame(list(enumerate(grids)), "i int, g array<array<string>>")
    assert [r.h for r in rows.select("i", G.header_row(F.col("g")).alias("h")).orderBy("i").collect()] == [0, 1, 3, None, None, None, 1]
    assert all(bool(re.search(K.NAMED_DAY.replace("(?U)", ""), c)) == any(
        n in c or re.search(rf"\b{a}\b", c) for n, a, _ in K.PROGRAMME_DAYS) for c in ["mer", "mercure", "xjeudix", "le sam.", "lun2", ""])


def test_calendar_rows_open_as_places(spark):
    page = '<table><tr class="days"><th>x</th></tr><tr class="cinema"><th>Fourmi</th></tr><tr class="movie"><th>a</th><td>b</td></tr></table>'
    rows = O.calendar_rows(H.parse_pages(spark.createDataFrame([(1, page), (2, None), (3, "<p>none</p>")], "page_id int, html string")))
    got = [(r.row_no, r.kind, r.cinema, [n.node_id for n in r.nodes]) for r in rows.orderBy("row_no").collect()]
    assert got == [(0, "days", "Lumière Terreaux", [2, 3]), (1, "cinema", "Lumière Fourmi", [4, 5]), (2, "movie", "Lumière Fourmi", [6, 7, 8])]
    opened = rows._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"slice\(nodes#\d+, [^\n]*row#\d+\.node\.node_id", opened)     # nodes are cut out after the rows are opened


def test_tags_are_read_once_and_alike():
    pieces = ["<p>", "</p>", "<br/>", "<a href='x>y' b=1>", '<a href="1" class>', "<script>", "</script>", "<script>a<p>", "<title>", "</title>", "t", "&amp;", "<!-- <p> -->", "< p>", "<p", ">", "<a b='", "<a b='&'>"]
    rng, known = random.Random(3), {}
    for _ in range(3000):
        markup = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 20)))
        assert H.page_events(markup, known) == H.page_events(markup), markup
    assert known and len(known) <= H.KNOWN_TAGS
    H.page_events("".join(f"<p a={i}>" for i in range(3 * H.KNOWN_TAGS)), known)
    assert len(known) <= H.KNOWN_TAGS


def test_contexts_from_one_search(spark):
    texts = ["tiontion x tion", "aa" * 60 + "tion<b>tion</b>", "\u0001tion\u0002 y", "none", "", None, "tion " * 9]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", P.match_contexts(F.col("t"), "tion").alias("m"))
    for r in found.collect():
        if r.t is not None:
            around = [r.t[max(m.start() - K.CONTEXT_CHARS, 0):m.end() + K.CONTEXT_CHARS] for m in re.finditer("tion", r.t)][:K.CONTEXTS_PER_PAGE]
            assert [c.context for c in r.m] == [re.sub(r"[\s\u0001]+", lambda s: s[0] if "\u0001" in s[0] else " ", re.sub("<[^>]+>", " ", a).strip())[:K.CONTEXT_CUT] for a in around], r
    assert "regexp_extract_all" not in plan(found)


def test_pages_of_a_small_file_are_dealt_over_tasks(spark, tmp_path):
    spark.range(1000).selectExpr("id AS p_partkey", "'a b' AS p_name", "'Brand#1' AS p_brand", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    tables = DI.Tables(spark, str(tmp_path))
    for build in (DI.film_nodes, DI.blocks):
        filled = build(tables).groupBy(F.spark_partition_id()).count().count()
        assert filled >= spark.sparkContext.defaultParallelism and build(tables).count() == 1000
