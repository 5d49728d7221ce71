"""Groups, fill, catalogs, keyed loads, increments and streams on small cases."""
import datetime as dt
import random
import re

from pyspark.sql import functions as F

from marquee import schema
from marquee.operators import calendar as W, fill, grouping as G, incremental as I, match as M, profile as P, skew, upsert as U
from marquee.plans import weekly
from marquee.sources import readers, writers
from marquee.streaming import arrivals as S

d = dt.date.fromisoformat


def test_propagate_fill(spark):
    df = spark.createDataFrame([("k", 1, None, None), ("k", 2, "p2", 0), ("k", 3, "p3", 2020), (None, 4, None, None), (None, 5, "p5", 1)],
                               "work string, n int, poster string, annee int")
    got = fill.propagate_fill(df, "work", {"poster": "string", "annee": "number"}, F.col("n")).orderBy("n").collect()
    assert [(r.poster, r.annee) for r in got] == [("p2", 2020), ("p2", 2020), ("p3", 2020), (None, None), ("p5", 1)]


def test_carry_forward_over_runs(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else "cold", i, rng.choice([None, None, None, "a", "b"])) for i in range(400)]
    df = spark.createDataFrame(rows, "page string, row_no int, venue string")
    got = {r.row_no: r.now for r in fill.carry_forward(df, "page", "row_no", F.col("venue"), "none", "now", chunk_rows=7).collect()}
    last = {}
    for page, i, venue in rows:
        last[page] = venue or last.get(page, "none")
        assert got[i] == last[page]


def test_carry_forward_does_not_depend_on_the_run_size(spark):
    rows = [(None, 0, "a"), (None, 1, None), (None, 2, None), (None, 3, None), ("k", None, "b"), ("k", None, None), ("k", 5, None), ("k", 6, "c"), ("k", 7, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, page string, row_no int, venue string")
    for size in (1, 2, 3, 100):
        got = [r.now for r in fill.carry_forward(df, "page", "row_no", F.col("venue"), "none", "now", chunk_rows=size).orderBy("id").collect()]
        assert got == ["a", "a", "a", "a", "b", "none", "none", "c", "c"], size


def test_spread_lookup_on_a_hot_key(spark):
    """A key with most of the rows, NULL keys and keys without match, against plain joins."""
    rows = [(i, None if i % 11 == 0 else (1 if i % 3 else i % 500), i % 4) for i in range(3000)]
    left = spark.createDataFrame(rows, "id int, k int, v int")
    right = spark.range(400).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for how, limit in [(h, x) for h in ("left", "inner", "left_semi", "left_anti") for x in (threshold, "-1")]:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        a = sorted(map(str, skew.spread_lookup(left, right, ["k"], how).select(*left.join(right, "k", how).columns).collect()))
        assert a == sorted(map(str, left.join(right, "k", how).collect())), (how, limit)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert left.select(F.size(skew.heavy_keys(left, [["k"]], 5)[0])).first()[0] == 5


def test_star_join_reads_facts_twice(spark, tmp_path):
    """One sketch for three dimensions, one scan for the join itself."""
    spark.range(500).selectExpr("id", "id % 7 AS a", "id % 5 AS b", "if(id % 3 = 0, NULL, 1) AS c").write.parquet(str(tmp_path / "facts"))
    dim = lambda k: (spark.range(20).selectExpr(f"id AS {k}", f"id * 2 AS {k}2"), k)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = M.star_join(spark.read.parquet(str(tmp_path / "facts")), dim("a"), dim("b"), dim("c"))
    rows = joined.collect()
    plan = joined._jdf.queryExecution().executedPlan()
    text = plan.toString().split("== Initial Plan ==")[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(rows) == 333 and all((r.a2, r.b2, r.c2) == (2 * r.a, 2 * r.b, 2) for r in rows)
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    assert len(scans) == 2


def test_dedup_keeps_first_and_is_stable(spark):
    df = spark.createDataFrame([("f", d("2026-03-11"), "20:00", v, i) for i, v in enumerate(["VOSTFR", "VF", "VOSTFR"])], "film string, date date, heure string, version string, pos int")
    once = G.dedup_screenings(df, ["film"], "pos")
    assert [s.version for s in G.nest_screenings(once, ["film"], "pos").first().seances] == ["VOSTFR", "VF"]
    assert sorted(once.collect()) == sorted(G.dedup_screenings(once, ["film"], "pos").collect())


def films(spark, *rows):
    return spark.createDataFrame(rows, "titre string, annee int, realisateur string, synopsis string, id string, created_at string, n int")


def test_upsert_rules(spark):
    keys = ["titre", "annee", "realisateur"]
    stored = films(spark, ("A", 2020, "x", "old", "1", "then", 0), ("B", None, "y", "old", "2", "then", 0))
    new = films(spark, ("A", 2020, "x", None, "9", "now", 1), ("A", 2020, "x", "later", "9", "now", 2), ("B", None, "y", "b", "8", "now", 1), ("C", 1, "z", "c", "7", "now", 1))
    got = {r.titre: (r.synopsis, r.id, r.created_at) for r in U.upsert(stored, new, keys, ["n"]).collect()}
    assert got == {"A": (None, "1", "then"), "B": ("b", "2", "then"), "C": ("c", "7", "now")}
    again = U.upsert(U.upsert(stored, new, keys, ["n"]), new, keys, ["n"])
    assert again.count() == 3
    assert U.upsert(stored, new, keys, ["n"], null_safe=False).filter("titre = 'B'").count() == 2
    last = U.upsert(stored, new, keys, ["n"], "last").filter("titre = 'A'").first()
    assert last.synopsis == "later"


def test_insert_if_absent_twice(spark):
    seed = spark.createDataFrame([(n, s) for n, s, _ in weekly.K.VENUES], "name string, slug string")
    none = spark.createDataFrame([], seed.schema)
    assert U.insert_if_absent(U.insert_if_absent(none, seed, ["name"]), seed, ["name"]).count() == 4


CATALOG = "id long, imdb_id string, title string, year int, poster_path string, overview string, vote_average double, cast array<struct<name:string>>"


def test_match_ranks_and_merge(spark):
    tmdb = spark.createDataFrame([(1, "tt1", "known", 1999, "/1.jpg", " ov ", 0.0, [("A",), ("",), ("C",)]), (2, None, "dated", 2000, "/2.jpg", None, 5.0, None),
                                  (3, None, "dated", 2001, "/3.jpg", None, 9.0, None), (4, None, "titre fr", None, None, None, None, None)], CATALOG)
    omdb = spark.createDataFrame([("tt1", "known", "2019–2021", "N/A", "plot", "Dir", "Drama, War", "7.1", "N/A")], schema.OMDB)
    cols = "w int, titre string, titreOriginal string, annee int, imdbId string, poster string, synopsis string, imdbRating double, cast string, realisateur string, genres array<string>"
    works = spark.createDataFrame([(1, "x", None, None, "tt1"), (2, "Dated", None, 2000, None), (3, "DATED", "", 1980, None), (4, "Titre FR", "Other", 1999, None), (5, "none", None, None, None), (6, "", None, None, "tt1")],
                                  "w int, titre string, titreOriginal string, annee int, imdbId string")
    empty = {"poster": "string", "synopsis": "string", "imdbRating": "double", "cast": "string", "realisateur": "string", "genres": "array<string>"}
    works = works.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()}).select(*[c.split()[0] for c in cols.split(", ")])
    ranks = {r.w: (r.match_rank, r.hit.id) for r in M.match_cascade(works.filter("titre <> ''"), "w", tmdb).collect()}
    assert ranks == {1: (1, 1), 2: (2, 2), 3: (3, 3), 4: (5, 4)}
    merged = {r.w: r for r in M.provider_merge(works, "w", tmdb, omdb).collect()}
    one = merged[1]
    assert (one.poster, one.synopsis, one.imdbRating, one.cast, one.annee, one.realisateur, one.genres) == \
        ("https://image.tmdb.org/t/p/w500/1.jpg", "ov", 7.1, "A, C", 2019, "Dir", ["Drama", "War"])
    assert merged[6].poster is None and merged[5].poster is None


def nested(spark):
    slot = lambda day, at, v="VF": (d(day), at, v, None)
    rows = [(0, 0, "Le Son", None, None, None, "grid", None, [slot("2026-03-20", "20:00"), slot("2026-03-20", "20:00", "VO"), slot("2026-03-27", "20:00")]),
            (1, 0, "LE  SON", None, 2020, "p.jpg", "calendar", "Lumière Fourmi", [slot("2026-03-26", "18:00")]),
            (1, 1, "Autre", None, None, None, "calendar", "Lumière Fourmi", [slot("2026-03-19", "18:00"), (None, "10:00", "VF", None)])]
    return weekly.as_films(spark.createDataFrame(rows, "src_order int, row_order int, titre string, titreOriginal string, annee int, poster string, source string, cinema string, "
                                                       "seances array<struct<date:date,heure:string,version:string,resa_url:string>>"))


def test_enrich_load_and_read(spark, tmp_path):
    tmdb = spark.createDataFrame([(1, "tt1", "le son", 2020, None, "ov", 0.0, None)], CATALOG)
    omdb = spark.createDataFrame([], schema.OMDB)
    rich = weekly.enrich(nested(spark), tmdb, omdb)
    got = {(r.src_order, r.row_order): (r.imdbId, r.poster, r.annee, r.synopsis, r.imdbRating) for r in rich.collect()}
    assert got == {(0, 0): ("tt1", "p.jpg", 2020, "ov", 0.0), (1, 0): ("tt1", "p.jpg", 2020, "ov", None), (1, 1): (None, None, None, None, None)}
    empty = tuple(spark.createDataFrame([], s) for s in (schema.CINEMAS, schema.FILMS, schema.SEANCES))
    writers.write_star(*weekly.load(rich, empty, "2026-03-20 01:00:00"), str(tmp_path / "a"))
    one = tuple(spark.read.parquet(str(tmp_path / "a" / n)) for n in ("cinemas", "films", "seances"))
    assert [x.count() for x in one] == [2, 3, 4]
    assert one[2].filter("date = '2026-03-20'").first().version == "VO"
    two = weekly.load(rich, (one[0], one[1], one[2].drop("week")), "2026-03-27 01:00:00")
    assert [x.count() for x in two] == [2, 3, 4] and two[1].filter("created_at > '2026-03-21'").count() == 0
    page = {(r.titre, r.name): [(s.date, s.heure) for s in r.seances] for r in weekly.read_path(*one, "2026-03-20").collect()}
    assert page == {("Le Son", "Le Comoedia"): [(d("2026-03-20"), "20:00")], ("LE  SON", "Lumière Fourmi"): [(d("2026-03-26"), "18:00")]}


def test_current_week(spark):
    kept = W.current_week_nested(nested(spark), "2026-03-20").orderBy("src_order").collect()
    assert [(f.titre, [s.date for s in f.seances]) for f in kept] == [("Le Son", [d("2026-03-20")] * 2), ("LE  SON", [d("2026-03-26")])]


def test_publish_and_read_back(spark, tmp_path):
    docs = writers.programme_documents(nested(spark).withColumn("cinema", F.coalesce("cinema", F.lit("Le Comoedia"))), "now", ["s"], ["cinema"])
    docs.drop("cinema").write.json(str(tmp_path / "p"))
    back = readers.programme_films(readers.read_programme(spark, str(tmp_path / "p"), one_per_file=False))
    assert back.select("titre").distinct().count() == 3 and readers.film_screenings(back, ["titre"]).count() == 6
    writers.write_programme(nested(spark), str(tmp_path / "lines"), "now", ["s"])
    assert spark.read.json(str(tmp_path / "lines")).count() == 3


def test_drop_place(spark, tmp_path):
    (tmp_path / "ok.pdf").write_bytes(b"%PDF" + b"0" * (10485760 - 4))
    (tmp_path / "big.pdf").write_bytes(b"%PDF" + b"0" * (10485761 - 4))
    (tmp_path / "text.pdf").write_bytes(b"hello")
    assert [r.path.rsplit("/", 1)[1] for r in readers.read_drop(spark, str(tmp_path)).select("path").collect()] == ["ok.pdf"]
    (tmp_path / "page.html").write_bytes(b"a\xffb")
    assert readers.read_pages(spark, str(tmp_path / "page.html")).first().html == "a�b"


def test_plan_inputs(spark):
    url = "https://cinema.example/semaine-du-{}-2026.pdf"
    urls = spark.createDataFrame([(url.format("4-au-10-mars"),), (url.format("11-au-17-mars"),), (url.format("18-au-24-mars"),), ("https://cdn.example/x.pdf",)], "url string")
    state = spark.createDataFrame([(url.format("4-au-10-mars"),)], "url string")
    facts = spark.createDataFrame([("c", d("2026-03-17"))], "cinema_id string, date date")
    got = {r.url.split("-du-")[-1]: r.action for r in I.plan_inputs(urls, state, facts, "c").collect()}
    assert got == {"4-au-10-mars-2026.pdf": "skip", "11-au-17-mars-2026.pdf": "record", "18-au-24-mars-2026.pdf": "process", "https://cdn.example/x.pdf": "process"}


def test_dq_messages(spark):
    df = spark.sql("SELECT 3 AS c, 10 AS f, 0 AS j, 9 AS g").select(P.dq_failures(*map(F.col, "cfjg")).alias("x"))
    assert df.first().x == ["Expected ≥4 cinemas, got 3", "No seances found", "Expected ≥10 film+cinema groups, got 9"]


def test_streams_process_once(spark, tmp_path):
    """Two files, a rerun, one more file: 2, 0 and 1 new; the increments equal one batch."""
    src, log, ck = (str(tmp_path / n) for n in ("in", "log", "ck"))
    table = spark.createDataFrame([], "url string, n int").schema
    put = lambda i, *rows: spark.createDataFrame(rows, table).coalesce(1).write.parquet(f"{src}/part={i}")
    run = lambda: S.run_available(S.arrivals(spark, f"{src}/part=*", table), S.new_only_log(log, ["url"], ["n"], table), ck)
    put(0, ("a", 1)); put(1, ("b", 2), ("a", 3))
    run()
    assert S.stored(spark, log, table).count() == 2
    run()
    assert S.stored(spark, log, table).count() == 2
    put(2, ("c", 4), ("b", 5))
    run()
    assert sorted(r.url for r in S.stored(spark, log, table).collect()) == ["a", "b", "c"]


def test_upsert_log_replay(spark, tmp_path):
    table = spark.createDataFrame([], "k string, v int").schema
    handle = S.upsert_log(str(tmp_path / "log"), ["k"], ["v"])
    one, two = (spark.createDataFrame(r, table) for r in ([("a", 5), ("a", 6), ("b", 1)], [("a", 2)]))
    handle(one, 0), handle(two, 1), handle(two, 1)
    now = lambda keep: {r.k: r.v for r in S.current(spark, str(tmp_path / "log"), table, ["k"], ["v"], keep).collect()}
    assert now("last") == {"a": 2, "b": 1} and now("first") == {"a": 6, "b": 1}
