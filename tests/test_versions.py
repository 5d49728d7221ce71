"""Changes that become visible together, folded logs, pruned logs of new keys, dropped files, weekly documents."""
import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marquee import schema
from marquee.plans import weekly
from marquee.sources.versions import Versions, hashed_part
from marquee.streaming import arrivals as S

d = dt.date.fromisoformat


def films(spark, *rows):
    """(titre, annee, cinema, [(date, heure, version)])"""
    nested = "titre string, annee int, cinema string, seances array<struct<date: date, heure: string, version: string>>"
    return weekly.as_films(spark.createDataFrame([(t, y, c, [(x and d(x), h, v) for x, h, v in s]) for t, y, c, s in rows], nested)
                           .withColumns({"src_order": F.lit(0), "row_order": F.monotonically_increasing_id()}))


def urls(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "url string")


def seen(spark, root):
    cinemas, works, slots = weekly.open_star(spark, root)
    joined = slots.join(works.select(F.col("id").alias("film_id"), "titre"), "film_id").join(cinemas.select(F.col("id").alias("cinema_id"), "name"), "cinema_id")
    return sorted((r.titre, r.name, str(r.date), r.heure, r.version) for r in joined.collect())


def files_of(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def spoil(folder):
    for p in Path(folder).rglob("*.parquet"):
        p.write_bytes(b"not parquet")
        for crc in p.parent.glob(".*.crc"):
            crc.unlink()


def test_load_in_versions(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "star")
    assert seen(spark, root) == [] and weekly.ingest_state(spark, root).count() == 0
    one = films(spark, ("A", 2000, "X", [("2026-03-11", "20:00", "VF"), (None, "20:00", "VF"), ("2026-03-12", None, "VO")]), ("B", None, "Y", [("2026-03-18", "18:30", "VO")]))
    report = {r.measure: r.n for r in weekly.load_version(one, spark, root, "2026-03-10 00:00:00", urls(spark, "u1", "u1")).collect()}
    assert report == {"screenings": 4, "accepted": 2, "rejected: no date": 1, "rejected: no time": 1, "resolved": 2, "unresolved": 0}
    before = seen(spark, root)
    assert before == [("A", "X", "2026-03-11", "20:00:00", "VF"), ("B", "Y", "2026-03-18", "18:30:00", "VO")]
    ids = {r.titre: r.id for r in weekly.open_star(spark, root)[1].collect()}
    files = files_of(root)

    # a load that stops after films and cinemas are written shows nothing, neither does its state
    two = films(spark, ("A", 2000, "X", [("2026-03-11", "20:00", "VOST"), ("2026-03-25", "21:00", "VF")]), ("C", 2001, "Z", []))
    real = Versions.write

    def stops(self, table, *args, **kwargs):
        if table == "seances":
            raise RuntimeError("lost")
        return real(self, table, *args, **kwargs)
    monkeypatch.setattr(Versions, "write", stops)
    with pytest.raises(RuntimeError):
        weekly.load_version(two, spark, root, "2026-03-17 00:00:00", urls(spark, "u2"))
    monkeypatch.setattr(Versions, "write", real)
    assert seen(spark, root) == before and {r.titre for r in weekly.open_star(spark, root)[1].collect()} == {"A", "B"}
    assert [r.url for r in weekly.ingest_state(spark, root).collect()] == ["u1"]

    # the next load takes its place; what it does not touch keeps its files
    weekly.load_version(two, spark, root, "2026-03-17 00:00:00", urls(spark, "u2"))
    assert seen(spark, root) == [("A", "X", "2026-03-11", "20:00:00", "VOST"), ("A", "X", "2026-03-25", "21:00:00", "VF"), ("B", "Y", "2026-03-18", "18:30:00", "VO")]
    assert sorted(r.url for r in weekly.ingest_state(spark, root).collect()) == ["u1", "u2"]
    assert {r.titre: r.id for r in weekly.open_star(spark, root)[1].collect() if r.titre in ids} == ids
    assert all(files_of(root)[name] == at for name, at in files.items())
    tables = Versions(spark, root)
    assert tables.folders["seances"] == {"2026-03-11": 2, "2026-03-18": 1, "2026-03-25": 2}
    part = spark.createDataFrame([("B", None, "")], "titre string, annee int, realisateur string").select(hashed_part(weekly.FILM_KEYS, weekly.FILM_FOLDERS)).first()[0]
    assert tables.folders["films"][part] == 1 and sorted(tables.folders["films"].values()) == [1, 2, 2]
    assert tables.read("rejects", "reason string").count() == 2 and tables.read("reports", "measure string, n long").count() == 12
    only = weekly.open_star(spark, root, ["2026-03-18"])[2]
    assert [str(r.date) for r in only.collect()] == ["2026-03-18"]


def test_parts_left_empty_disappear(spark, tmp_path):
    rows = lambda *ps: spark.createDataFrame([(p, i) for i, p in enumerate(ps)], "part string, n int")
    tables = Versions(spark, str(tmp_path))
    tables.write("t", rows("a", "b"))
    tables.commit()
    tables.write("t", rows("c"), ["a"])
    assert Versions(spark, str(tmp_path)).parts("t") == ["a", "b"]
    tables.commit()
    assert Versions(spark, str(tmp_path)).parts("t") == ["b", "c"]


def test_fold(spark, tmp_path):
    table = spark.createDataFrame([], "k string, v int").schema
    log = str(tmp_path / "log")
    handle = S.upsert_log(log, ["k"], ["v"], schema=table, fold_every=3, folders=4)
    put = lambda i, *rows: handle(spark.createDataFrame(rows, table), i)
    now = lambda: {r.k: r.v for r in S.current(spark, log, table, ["k"], ["v"]).collect()}
    put(0, ("a", 1), ("b", 1)), put(1, ("a", 0), (None, 7)), put(2, ("c", 3))
    assert now() == {"a": 0, "b": 1, "c": 3, None: 7}
    for i in range(3):
        spoil(f"{log}/batch={i}")                # folded batches are not opened
    put(1, ("a", 99))                            # a replay of a folded batch changes nothing
    put(3, ("a", 5), ("d", 1))
    assert now() == {"a": 5, "b": 1, "c": 3, "d": 1, None: 7}
    put(4, ("a", 6)), put(4, ("a", 6)), put(5, ("b", 9))
    for i in range(3, 6):
        spoil(f"{log}/batch={i}")
    assert now() == {"a": 6, "b": 9, "c": 3, "d": 1, None: 7}


def test_fold_that_breaks_off(spark, tmp_path, monkeypatch):
    table = spark.createDataFrame([], "k string, v int").schema
    log = str(tmp_path / "log")
    S.write_batch(spark.createDataFrame([("a", 1)], table), 0, log)
    monkeypatch.setattr(Versions, "commit", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        S.fold(spark, log, table, ["k"], ["v"])
    monkeypatch.undo()
    now = lambda: {r.k: r.v for r in S.current(spark, log, table, ["k"], ["v"]).collect()}
    assert now() == {"a": 1} and S.base_of(spark, log)[1] == -1
    S.fold(spark, log, table, ["k"], ["v"]), S.fold(spark, log, table, ["k"], ["v"])
    assert now() == {"a": 1} and S.base_of(spark, log)[1] == 0


def test_new_keys_read_their_own_folders(spark, tmp_path):
    table = spark.createDataFrame([], "k string, v int").schema
    log = str(tmp_path / "log")
    handle = S.new_only_log(log, ["k"], ["v"], table, folders=32)
    put = lambda i, *rows: handle(spark.createDataFrame(rows, table), i)
    put(0, ("a", 1), ("b", 1), (None, 3), ("a", 2))
    place = lambda k: spark.createDataFrame([(k,)], "k string").select(hashed_part(["k"], 32)).first()[0]
    other = next(c for c in "cdefgh" if place(c) not in (place("a"), place("b"), place(None)))
    put(1, (other, 5))
    spoil(f"{log}/part={place('b')}")
    put(2, ("a", 9), (other, 9), (None, 9)), put(2, ("a", 9))
    for folder in (place("a"), place(other), place(None)):
        assert len(list(Path(f"{log}/part={folder}").rglob("*.parquet"))) == 1
    handle(spark.createDataFrame([], table), 3)


def test_dropped_files(spark, tmp_path):
    drop, log, seen_ = tmp_path / "drop", str(tmp_path / "log"), []
    drop.mkdir()
    run = lambda: S.run_available(S.dropped_files(spark, str(drop), 50), S.drop_log(log, lambda good, i: seen_.extend(bytes(r.content)[:4] for r in good.collect())), str(tmp_path / "ck"))
    (drop / "a.pdf").write_bytes(b"%PDF" + b"1" * 46)
    (drop / "b.pdf").write_bytes(b"%PDF" + b"1" * 400)
    (drop / "c.pdf").write_bytes(b"")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)      # opening the large file would stop the run
    try:
        run(), run()
        (drop / "d.txt").write_bytes(b"PK")
        run()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    rows = {os.path.basename(r.path): (r.length, r.reason, r.batch) for r in S.stored(spark, log, S.DROP_LOG).collect()}
    assert rows == {"a.pdf": (50, None, 0), "b.pdf": (404, "too large", 0), "d.txt": (2, "not a PDF", 1)}
    assert seen_ == [b"%PDF"]


HEADER = ["", "MERCREDI. 11", "JEUDI. 12", "VENDREDI. 13", "SAMEDI. 14", "DIMANCHE. 15", "LUNDI. 16", "MARDI. 17"]
GRID = [["PROGRAMME"] + [None] * 7, HEADER, ["FILM UN\nVF", "20h00", "-", "-", "-", "-", "-", "-"]]


def test_document_run(spark):
    site = "https://cinema.example/semaine-du-{}-2026.pdf"
    said = "Du 11 au 17 mars 2026"
    candidates = [(site.format("4-au-10-mars"), "c"), (site.format("11-au-17-mars"), "c"), (site.format("18-au-24-mars"), "c"), (site.format("17-au-11-mars"), "c"),
                  ("cdn/1", "c"), ("cdn/1", "e"), ("cdn/2", "e"), ("cdn/3", "c"), ("cdn/gone", "c"), ("cdn/1", "e")]
    files = [(u, t, g) for u, t, g in ((candidates[0][0], said, GRID), (candidates[1][0], said, GRID), (candidates[2][0], "Du 25 au 31 mars 2026", GRID), (candidates[3][0], None, []),
                                       ("cdn/1", said, GRID), ("cdn/2", "nothing", GRID), ("cdn/3", "nothing", [["x"]]))]
    state = urls(spark, candidates[0][0])
    facts = spark.createDataFrame([("c", d("2026-03-17"))], "cinema_id string, date date")
    rows, outcomes = weekly.document_run(spark.createDataFrame(candidates, "url string, cinema_id string"),
                                         spark.createDataFrame(files, "url string, text string, grid array<array<string>>"), state, facts, "2026-03-12")
    got = {(r.cinema_id, r.url.split("-du-")[-1]): r.action for r in outcomes.collect()}
    assert got == {("c", "4-au-10-mars-2026.pdf"): "skip", ("c", "11-au-17-mars-2026.pdf"): "record", ("c", "18-au-24-mars-2026.pdf"): "loaded", ("c", "17-au-11-mars-2026.pdf"): "empty",
                   ("c", "cdn/1"): "record", ("e", "cdn/1"): "loaded", ("e", "cdn/2"): "loaded", ("c", "cdn/3"): "empty", ("c", "cdn/gone"): "missing"}
    days = sorted((r.cinema_id, str(r.seances[0].date)) for r in rows.collect())
    assert days == [("c", "2026-03-25"), ("e", "2026-03-11"), ("e", "2026-03-11")]     # the text's week before the address's
    assert {r.url.split("-du-")[-1] for r in weekly.recorded(outcomes).collect()} == {"11-au-17-mars-2026.pdf", "18-au-24-mars-2026.pdf", "cdn/1", "cdn/2"}


def test_fallback_candidates(spark):
    cinemas = spark.createDataFrame([("c",), ("e",)], "cinema_id string")
    listed = spark.createDataFrame([("c", "x.pdf")], "cinema_id string, url string")
    got = sorted(tuple(r) for r in weekly.with_fallback(listed, cinemas, "2026-03-12", "https://s").collect())
    assert [g[0] for g in got] == ["c", "e", "e", "e"] and got[0][1] == "x.pdf" and got[1][1].endswith("semaine-du-11-au-17-mars-2026.pdf")


def test_schema_of_marker():
    assert schema.MARKER.names == ["table", "part", "at"]


def test_checked_star(spark):
    made = lambda kind, rows: spark.createDataFrame(rows, kind).select(*kind.names)
    blank = lambda kind, **known: tuple(known.get(f.name) for f in kind)
    cinemas = made(schema.CINEMAS, [blank(schema.CINEMAS, id=f"c{i}") for i in range(4)])
    films = made(schema.FILMS, [blank(schema.FILMS, id=f"f{i}") for i in range(10)])
    slots = [blank(schema.SEANCES, film_id=f"f{i}", cinema_id=f"c{i % 4}") for i in range(10)] * 2
    lost = [blank(schema.SEANCES, film_id="f1", cinema_id="none"), blank(schema.SEANCES, film_id="none", cinema_id="c1"), blank(schema.SEANCES, film_id=None, cinema_id="c1")]
    told = lambda *star: weekly.checked_star(*star).collect()
    assert told(cinemas, films, made(schema.SEANCES, slots)) == [([], 4, 10, 20, 0, 10)]
    assert told(cinemas, films, made(schema.SEANCES, slots[:9] + lost)) == [(["Expected ≥10 film+cinema groups, got 9", "3 screenings without film or cinema"], 4, 10, 9, 3, 9)]
    empty = told(*(spark.createDataFrame([], k) for k in (schema.CINEMAS, schema.FILMS, schema.SEANCES)))
    assert empty[0][1:] == (0, 0, 0, 0, 0) and len(empty[0].failures) == 4


def test_details_parse_only_pages_that_films_name(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(weekly.H, "parse_pages", lambda pages, real=weekly.H.parse_pages: (seen.extend(r.slug for r in pages.collect()), real(pages))[1])
    films = weekly.as_films(spark.createDataFrame([("a", None), ("a", "mine"), (None, None), ("", None), ("z", None)], "slug string, poster string").withColumn("seances", F.array().cast("array<struct<date:date>>")))
    page = "<figure class='poster'><img data-src='http://x/{}.jpg'></figure>"
    pages = spark.createDataFrame([("a", page.format("a")), ("a", page.format("b")), ("b", page.format("b")), (None, page.format("c")), ("", page.format("d"))], "slug string, html string")
    got = sorted((r.slug or "-", r.poster or "-") for r in weekly.detailed(films, pages).collect())
    assert seen == ["a"] and got == [("-", "-"), ("-", "-"), ("a", "http://x/a.jpg"), ("a", "mine"), ("z", "-")]
