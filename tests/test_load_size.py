"""Loads, programmes, drops and detail pages: what they move, write and send, and that their rows stay those of the plain way."""
import datetime as dt
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from marquee import schema
from marquee.operators import match as M, upsert as U
from marquee.operators.dedup import first_per_key
from marquee.plans import loading, weekly
from marquee.plans.registry import Tables

d = dt.date.fromisoformat
ORDER = ["src_order", "row_order"]


def tables(spark, folder, lines=60):
    """Line items, parts and orders in the shape of the given tables."""
    spark.range(lines).selectExpr("id AS l_orderkey", "CAST(id % 7 + 1 AS INT) AS l_linenumber", "id % 9 AS l_partkey", "id % 4 AS l_suppkey", "CAST(id % 50 AS DOUBLE) AS l_quantity",
                                  "element_at(array('A', 'N', 'R'), CAST(id % 3 + 1 AS INT)) AS l_returnflag",
                                  "CAST(date_add(DATE '1997-03-01', CAST(id % 20 AS INT)) AS TIMESTAMP_NTZ) AS l_shipdate").write.parquet(f"{folder}/lineitem.parquet")
    spark.range(9).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "concat('Brand#', id % 3) AS p_brand", "CAST(id + 10 AS INT) AS p_size").write.parquet(f"{folder}/part.parquet")
    spark.range(3).selectExpr("concat('land ', id) AS n_name").write.parquet(f"{folder}/nation.parquet")
    return Tables(spark, str(folder))


def nested(spark, *rows):
    kind = "titre string, annee int, cinema string, seances array<struct<date: date, heure: string, version: string>>"
    films = spark.createDataFrame([(t, y, c, [(x and d(x), h, v) for x, h, v in s]) for t, y, c, s in rows], kind).coalesce(1)
    return weekly.as_films(films.withColumns({"src_order": F.lit(0), "row_order": F.monotonically_increasing_id()}))


def plain_load(films, stored, ts):
    """The load by ids as they are stored, one step after the other."""
    cinemas, rows, slots, _ = weekly.star_rows(films, ts)
    c, f = U.upsert(stored[0], cinemas, ["name"], ORDER), U.upsert(stored[1], rows, weekly.FILM_KEYS, ORDER)
    one = lambda df, key, *cols: first_per_key(df.select(U.key_id(*map(F.col, cols)).alias(f"{key}_key"), F.col("id").alias(f"{key}_id"), "created_at"),
                                               [f"{key}_key"], ["created_at", f"{key}_id"]).drop("created_at")
    found = slots.join(one(c, "cinema", "name"), "cinema_key").join(one(f, "film", *weekly.FILM_KEYS), "film_key")
    keys = ["film_id", "cinema_id", "date", "heure"]
    return U.upsert(stored[2], found.withColumn("id", U.key_id(*map(F.col, keys))), keys, [*ORDER, "pos"], "last")


def test_load_moves_refs_and_keeps_ids(spark):
    ts = "2026-03-01 00:00:00"
    own = lambda *parts: spark.range(1).select(U.key_id(*map(F.lit, parts))).first()[0]
    when = dt.datetime(2026, 2, 1)
    film = lambda id_, titre, annee: (id_, titre, None, annee, "", None, [], None, None, None, None, None, None, when)
    hash_a = own("A", 2000, "")
    stored = (spark.createDataFrame([("c1", "X", "x", when), (own("Y"), "Y", "y", when), (None, "W", "w", when)], schema.CINEMAS),
              # B has the id that A would get, C one of its own, D its hash, E twice
              spark.createDataFrame([film(hash_a, "B", 2001), film("!odd", "C", None), film(own("D", 1999, ""), "D", 1999), film("e1", "E", 1990), film("e2", "E", 1990)], schema.FILMS),
              spark.createDataFrame([("s1", hash_a, "c1", d("2026-03-11"), "20:00:00", "old", None, when), ("s2", "!odd", own("Y"), d("2026-03-12"), "18:00:00", "old", None, when),
                                     ("s3", "gone", "c1", d("2026-03-12"), "18:00:00", "old", "u", when), ("s4", None, None, d("2026-03-12"), None, "old", None, when),
                                     (None, own("D", 1999, ""), "c1", d("2026-03-13"), "10:00:00", "old", "u", when)], schema.SEANCES))
    slots = [("2026-03-11", "20:00", "VF"), ("2026-03-12", "18:00", "VO"), ("2026-03-13", "10:00", "VF"), ("2026-03-13", "10:00", "VO"), (None, "10:00", "VF")]
    films = nested(spark, *[(t, y, c, slots) for t, y in (("A", 2000), ("B", 2001), ("C", None), ("D", 1999), ("E", 1990), ("F", None)) for c in ("X", "Y", "Z", "W", None)])
    rows = lambda df: sorted(map(str, df.select(*schema.SEANCES.names).collect()))
    loaded = weekly.load(films, stored, ts)[2]
    assert rows(loaded) == rows(plain_load(films, stored, ts))
    above, moved = loaded._jdf.queryExecution().optimizedPlan().toString().split("RebalancePartitions", 1)
    assert "sha2" in above and "max_by" in moved                # ids are hashed after the last shuffle


def test_small_dimensions_leave_the_facts_where_they_are(spark):
    facts = spark.range(1000).selectExpr("if(id % 5 = 0, NULL, id % 7) AS a", "id % 11 AS b", "id")
    dims = [(spark.range(5).selectExpr(f"id AS {k}", f"id * 2 AS {k}2"), k) for k in ("a", "b")]
    for how in ("inner", "left"):
        few = M.star_join(facts, *dims, how=how, small=5)
        assert sorted(map(str, few.collect())) == sorted(map(str, M.star_join(facts, *dims, how=how).collect()))
        assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
        mixed = M.star_join(facts, dims[0], (spark.range(6).selectExpr("id AS b", "id * 2 AS b2"), "b"), how=how, small=5)
        assert mixed.count() == (facts.count() if how == "left" else facts.filter("a < 5 AND b < 6").count())


def test_loads_write_coded_files(spark, tmp_path, monkeypatch):
    t = tables(spark, tmp_path / "t")
    for module in ("marquee.plans.loading", "marquee.operators.staging"):
        monkeypatch.setattr(f"{module}.shared_folder", lambda spark, name: str(tmp_path / "shared" / f"{name}-{uuid.uuid4().hex}"))
    for query in (loading.load_star, loading.load_versions, loading.programme_flatten):
        assert query(t).count() > 0
    written = lambda name, kind: [p.name for p in Path(tmp_path / "shared").glob(f"{name}-*/**/{kind}") if not p.name.startswith(".")]
    assert written("programme", "*.json*") and all(n.endswith(".json.gz") for n in written("programme", "*.json*"))
    for folder in ("star", "versions"):
        slots = written(folder, "seances/**/*.parquet")
        assert slots and all(".zstd." in n for n in slots)
    assert not list(Path(tmp_path / "shared").glob("resolved-*"))   # found screenings are written once, in their week


def test_detail_pages_are_dealt_over_a_stated_number_of_tasks(spark):
    """Tasks merged by the size of compressed markup would hold many times that size."""
    pages = spark.range(400).selectExpr("CAST(id % 200 AS STRING) AS slug", "concat('<div class=\"section synopsis\"><p>', repeat('a b ', 9), id, '</p></div>') AS html")
    films = weekly.as_films(spark.createDataFrame([("A", "7", "x"), ("B", None, "x"), ("C", "900", "x")], "titre string, slug string, cinema string")
                            .select("*", F.array().cast("array<struct<date:date>>").alias("seances")))
    made = []
    real = weekly.H.parse_pages

    def seen(df):
        made.append(df)
        return real(df)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    weekly.H.parse_pages = seen
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.titre: r.synopsis for r in weekly.detailed(films, pages).collect()}
        plan = made[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        weekly.H.parse_pages = real
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got["A"].endswith("207") and got["B"] is None and got["C"] is None       # of two pages the first by its text
    assert "REPARTITION_BY_NUM" in plan


def test_a_stream_is_defined_once_and_lists_in_few_tasks(spark, tmp_path):
    from marquee.streaming import arrivals as S
    names = ["spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.sources.ignoreDataLocality"]
    seen, told = [], [spark.conf.get(name) for name in names]
    handle = S.drop_log(str(tmp_path / "log"))

    def watched(batch, batch_id):
        seen.append([batch.sparkSession.conf.get(name) for name in names])
        handle(batch, batch_id)

    stream = S.dropped_files(spark, f"{tmp_path}/in/name=*", 50)                # before there is any file
    for i in range(3):
        for k in range(3 * min(i, 1), 3 + 3 * min(i, 1)):
            (tmp_path / f"in/name={k}").mkdir(parents=True, exist_ok=True)
            (tmp_path / f"in/name={k}/a.txt").write_bytes(b"%PDF" * (1 + 5 * k))
        S.run_available(stream, watched, str(tmp_path / "checkpoint"))
    log = sorted((int(r.path.split("name=")[1].split("/")[0]), r.length, r.reason) for r in S.stored(spark, str(tmp_path / "log"), S.DROP_LOG).collect())
    assert log == [(k, 4 + 20 * k, None if k < 3 else "too large") for k in range(6)]
    assert seen == [["256", "true"]] * 2
    assert [spark.conf.get(name) for name in names] == told


def test_a_programme_document_lists_the_week_of_a_venue_in_order(spark, tmp_path, monkeypatch):
    t = tables(spark, tmp_path / "t", 20)
    monkeypatch.setattr("marquee.plans.loading.shared_folder", lambda spark, name: str(tmp_path / name))
    got = [tuple(r) for r in loading.programme_flatten(t).collect()]
    films = [[(f.cinema, f.titre, [str(s.date) for s in f.seances]) for f in r.films] for r in spark.read.schema(schema.PROGRAMME).json(str(tmp_path / "programme")).collect()]
    week = lambda day: (d(day) - dt.timedelta((d(day).weekday() - 2) % 7)).isoformat()
    shown = {(f"Salle {r.l_suppkey}", week(str(r.l_shipdate)[:10])) for r in t.lineitem.collect()}
    assert sorted((doc[0][0], week(doc[0][2][0])) for doc in films) == sorted(shown)          # one document each
    assert all(len({(cinema, week(day)) for cinema, _, days in doc for day in days}) == 1 for doc in films) and max(map(len, films)) == 2
    places = [[(days[0], titre) for _, titre, days in doc] for doc in films]
    assert all(p == sorted(p) for p in places) and any([x[1] for x in p] != sorted(x[1] for x in p) for p in places)
    listed = {}
    for titre, cinema, day, *_ in got:
        listed.setdefault((cinema, week(day)), {}).setdefault(titre, None)
    assert {k: [*v] for k, v in listed.items()} == {(doc[0][0], week(doc[0][2][0])): [titre for _, titre, _ in doc] for doc in films}
    assert len(got) == 20


def test_dropped_files_are_listed_shelf_by_shelf(spark, tmp_path, monkeypatch):
    from marquee.streaming import arrivals as S
    spark.range(400).selectExpr("id AS doc_id", "CASE WHEN id % 3 > 0 THEN repeat('x', CAST(id * 10 AS INT)) END AS text").write.parquet(str(tmp_path / "t/documents.parquet"))
    monkeypatch.setattr("marquee.plans.loading.shared_folder", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(S, "SHELF_FILES", 10, raising=False)
    handled, real = [], S.drop_log

    def watched(log, on_files=None):
        handle = real(log, on_files)
        return lambda batch, batch_id: (handled.append((log, batch.count())), kept.add(batch.sparkSession.conf.get(cache)), handle(batch, batch_id))
    monkeypatch.setattr(S, "drop_log", watched)
    cache, kept = "spark.sql.hive.filesourcePartitionFileCacheSize", set()
    told = spark.conf.get(cache)
    got = sorted(map(tuple, loading.stream_drop(Tables(spark, str(tmp_path / "t"))).collect()))
    length = lambda k: sum(i * 10 if i % 3 else 0 for i in range(8 * k, 8 * k + 8)) + 8 + (5 if k % 4 == 0 else 9)
    assert got == [(k, length(k), "too large" if length(k) > 20_000 else "not a PDF" if k % 4 == 0 else "admitted", 1) for k in range(50)]
    assert len({log for log, _ in handled}) == 5 and sum(n for _, n in handled) == 50 and max(n for _, n in handled) <= 10
    assert kept == {"0"} and spark.conf.get(cache) == told                          # listings of a stream are not kept for the session
