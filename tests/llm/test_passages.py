"""Repeated passages: one shuffle of the texts, and what leaves a task."""
import itertools
import os
import random

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import dedup_passages


def test_passages_stage_nothing_and_shuffle_texts_once(spark):
    rng = random.Random(11)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    shared, again = line(60), line(3)
    rows = [(i, line(20) + shared[i % 7:200 + i] + line(10)) for i in range(60)] + [(None, shared), (7, shared), (90, again * 9), (91, again * 5), (92, None), (93, "")]
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    names = lambda: set(os.listdir(folder)) if os.path.exists(folder) else set()
    before, joined = names(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dedup_passages.passage_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, bytes(r.kept)) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joined)
    seen, want = set(), []
    for i, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), key=lambda r: r[0]):
        texts, new = [(t or "").encode() for _, t in group], []
        for b in texts:
            gone = bytearray(len(b))
            for k in range(len(b) - 49):
                if b[k:k + 50] in seen:
                    gone[k:k + 50] = b"\1" * 50
                new.append(b[k:k + 50])
            want.append((i is None, i or 0, len(b), bytes(c for c, g in zip(b, gone) if not g)))
        seen.update(new)
    assert got == sorted(want)
    assert names() == before and "ReusedExchange" in plan


def test_phrase_leaves_a_task_once_with_its_smallest_document(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = dedup_passages.phrases_of(spark.createDataFrame([(i, i, text) for i in range(30)], "rank long, text_key long, text string").coalesce(1).withColumn(
        "hashes", F.lit(dedup_passages.short(dedup_passages.triggers(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[1]).astype(np.int64).tolist())), 4).collect()
    sent, marked = [r for r in rows if r.phrases], [r for r in rows if not r.phrases]
    assert sum(r.places for r in sent) == sum(r.phrases for r in sent) > 5          # not 30 times as many
    assert sorted(r["rank"] for r in marked) == list(range(1, 30))
    assert {tuple(np.frombuffer(r.body, np.int64)) for r in marked} == {(len(text),)}


def test_shared_triggers_leave_a_range_packed_and_come_back_a_row_a_text(spark):
    rng = random.Random(5)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    shared = line(150)
    docs = spark.createDataFrame([(i, 1000 - i, line(5) + shared) for i in range(200)] + [(200, 7, line(40)), (3, 997, line(5) + shared[40:]), (201, 8, None)], "rank long, text_key long, text string").repartition(3)
    hashes = {}
    for ranges in (8, 64):
        packed = dedup_passages.shared_triggers(dedup_passages.trigger_rows(docs, ranges), 4)
        assert packed.count() <= ranges * 4                                      # not a row for each text and range
        found = dedup_passages.hashes_of(packed).collect()
        hashes[ranges] = {(r["rank"], r.text_key): sorted(r.hashes) for r in found}
        assert len(found) == len(hashes[ranges]) == 200
    own = np.unique(dedup_passages.short(dedup_passages.triggers(np.frombuffer(shared.encode(), np.uint8), np.array([0, len(shared)]))[1])).astype(np.int64).tolist()
    assert hashes[8] == hashes[64] and all(len(set(own) & set(h)) > 10 for h in hashes[8].values())


def test_rows_of_shared_triggers_grow_with_ranges_and_not_with_texts(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.range(3000).selectExpr("id AS rank", "id AS text_key", f"'{text}' AS text")
    assert dedup_passages.shared_triggers(dedup_passages.trigger_rows(docs, 16)).count() <= 16 * 256
