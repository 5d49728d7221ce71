"""Repeated passages of bytes: prefix-free parsing, a dictionary of phrases and the order of its suffixes.

Triggers are local minima of a rolling hash, so that every string of ``LENGTH`` bytes holds at least one. The strings
of ``LENGTH`` bytes that a trigger is the minimum of begin next to each other; the text they cover is its phrase, and
neighbouring phrases overlap by ``LENGTH - 1`` bytes. Every such string of the corpus is thus the beginning of exactly
one suffix of one phrase of the dictionary: sorting the suffixes of the dictionary puts equal strings of the whole corpus
side by side, and the parse (which phrase stands where) carries the answer back to all places.

The dictionary travels by ranges of triggers, packed, and each phrase leaves a task once with the places of its smallest
document only: the task knows by itself that the phrase goes whole in all later ones.
"""
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from .bytescan import blocks, mix, text_bytes
from .dedup_exact import text_key

LENGTH = 50
GRAM = 24                     # bytes of the rolling hash, a multiple of 8
MOST = 48                     # strings of one phrase at most: their verdicts are the bits of one integer
RANGES = 1 << 12              # ranges of trigger hashes at most
BUCKETS = 256                 # of texts, to which the shared triggers of a range are sent packed
FLUSH = 16 << 20              # bytes of texts whose phrases a task holds at once
LAST = (1 << 63) - 1          # rank of a NULL id


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        x = np.zeros(n, np.uint64)
        for j in range(k, k + 8):
            x <<= np.uint64(8)
            x |= data[j:j + n]
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x)
    return out


def string_hashes(data: np.ndarray) -> np.ndarray:
    """128-bit hash of the LENGTH bytes from each position, as pairs."""
    g = rolling(data)
    n = len(data) - LENGTH + 1
    at = [*range(0, LENGTH - GRAM, GRAM), LENGTH - GRAM]
    a, b = np.zeros(max(0, n), np.uint64), np.zeros(max(0, n), np.uint64)
    for s in at if n > 0 else []:
        a = mix(a * np.uint64(0x9E3779B97F4A7C15) + g[s:s + n])
        b = mix(b * np.uint64(0xC2B2AE3D27D4EB4F) ^ (g[s:s + n] + np.uint64(s + 1)))
    return np.stack([a, b], axis=1)


def triggers(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, trigger hash, first and last string start) of every phrase of every row; offsets are within ``data``."""
    g = rolling(data)
    span = LENGTH - GRAM + 1                   # hashes within one string
    n = len(data) - LENGTH + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z, z
    least, width = g, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width:span - width + n])
    row = np.searchsorted(at, np.arange(n), "right") - 1
    inside = np.arange(n) + LENGTH <= at[row + 1]
    begin = inside & np.concatenate(([True], (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]))
    # where a text repeats within itself one minimum can last; such phrases are cut, as their strings keep their trigger
    begin |= inside & ((np.arange(n) - np.maximum.accumulate(np.where(begin, np.arange(n), 0))) % MOST == 0)
    first = np.flatnonzero(begin)
    stop = np.concatenate((begin[1:], [True])) | ~np.concatenate((inside[1:], [False]))
    last = np.flatnonzero(inside & stop)
    return row[first], mix(least[first]), first, last    # minima are small: mixed, they spread evenly over ranges


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers, the lowest bytes of a column first, then all second ones and so on: small numbers compress well like that."""
    return pa.compress(np.concatenate([np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T).ravel() for c in columns]).tobytes(), codec="zstd", asbytes=True)


def unpack(body: bytes, *columns: tuple[int, type]) -> list[np.ndarray]:
    """The columns of ``pack`` from their lengths and types."""
    sizes = [n * np.dtype(kind).itemsize for n, kind in columns]
    raw = np.frombuffer(pa.decompress(body, sum(sizes), codec="zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(c.reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind)
            for c, (n, kind) in zip(np.split(raw, np.cumsum(sizes)[:-1]), columns)]


def short(hashed: np.ndarray) -> np.ndarray:
    """Of the hash 40 bits below the first ten and these: a false match only costs a comparison."""
    return ((hashed >> np.uint64(14)) & np.uint64((1 << 40) - 1)) | ((hashed >> np.uint64(54)) << np.uint64(40))


def binaries(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Byte strings of these sizes, one after the other."""
    at = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(data)])


def trigger_rows(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, pairs, texts, body): sorted distinct (trigger, text) pairs of each batch by range of the trigger hash, with the rank and key of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, key = (batch.column(k).to_numpy() for k in range(2))
            found, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for start, data, at in blocks(batch.column(2)):
                row, hashed, _, _ = triggers(data, at)
                found.append(hashed)
                of.append(row + start)
            hashed, of = np.concatenate(found), np.concatenate(of)
            order = np.lexsort((of, hashed))
            hashed, of = hashed[order], of[order]
            keep = np.concatenate(([True], (hashed[1:] != hashed[:-1]) | (of[1:] != of[:-1]))) if len(hashed) else np.zeros(0, bool)
            hashed, of = hashed[keep], of[keep]
            where = (hashed >> np.uint64(52)).astype(np.int64) * ranges // RANGES
            cut = np.searchsorted(where, np.arange(ranges + 1))
            out = []
            for r in np.flatnonzero(np.diff(cut)).tolist():
                a, b = int(cut[r]), int(cut[r + 1])
                texts, local = np.unique(of[a:b], return_inverse=True)
                out.append((r, b - a, len(texts), pack(np.diff(short(hashed[a:b]), prepend=np.uint64(0)), local.astype(np.uint32), np.diff(rank[texts], prepend=0), key[texts])))
            yield table(out, "range", "pairs", "texts", "body")

    return docs.select("rank", "text_key", "text").mapInArrow(run, "range bigint, pairs bigint, texts bigint, body binary")


def table(rows: list[tuple], *names: str) -> pa.RecordBatch:
    """Rows of numbers and, in the last column, bytes."""
    kinds = [pa.int64()] * (len(names) - 1) + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], list(names))


def shared_triggers(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, texts, pairs, body): of each text, the short hashes of triggers that another text has too; a row holds a range's of all texts of a bucket."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(body, (n, np.uint64), (n, np.uint32), (m, np.int64), (m, np.int64)) for n, m, body in zip(part["pairs"], part["texts"], part["body"])]
        hashed = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        rank, key = np.concatenate([np.cumsum(p[2]) for p in parts]), np.concatenate([p[3] for p in parts])
        first = np.cumsum([0] + [len(p[2]) for p in parts])
        text = np.concatenate([p[1] + f for p, f in zip(parts, first)])
        values, count = np.unique(hashed, return_counts=True)      # pairs are distinct, so two rows are two texts
        keep = np.isin(hashed, values[count > 1])
        hashed, text = hashed[keep], text[keep]
        bucket = (mix(rank.view(np.uint64) ^ mix(key.view(np.uint64))) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((hashed, text, bucket[text]))
        hashed, text = hashed[order], text[order]
        cut = np.searchsorted(bucket[text], np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(cut)).tolist():
            named, times = np.unique(text[cut[b]:cut[b + 1]], return_counts=True)
            out.append((b, len(named), cut[b + 1] - cut[b], pack(rank[named], key[named], times.astype(np.uint32), hashed[cut[b]:cut[b + 1]])))
        return pd.DataFrame(out, columns=["bucket", "texts", "pairs", "body"])

    return found.groupBy("range").applyInPandas(run, "bucket bigint, texts bigint, pairs bigint, body binary")


def hashes_of(shared: DataFrame) -> DataFrame:
    """(rank, text_key, hashes): one row for each text that has triggers in ``shared``."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(body, (n, np.int64), (n, np.int64), (n, np.uint32), (m, np.uint64)) for n, m, body in zip(part["texts"], part["pairs"], part["body"])]
        rank, key, times, hashed = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.lexsort((key, rank))
        rank, key = rank[order], key[order]
        new = np.concatenate(([True], (rank[1:] != rank[:-1]) | (key[1:] != key[:-1])))
        text = np.empty(len(order), np.int64)
        text[order] = np.cumsum(new) - 1
        text = np.repeat(text, times)
        cut = np.cumsum(np.bincount(text))[:-1]
        hashes = np.split(hashed[np.argsort(text, kind="stable")].astype(np.int64), cut)
        return pd.DataFrame({"rank": rank[new], "text_key": key[new], "hashes": pd.Series(hashes, dtype=object)})

    return shared.groupBy("bucket").applyInPandas(run, "rank bigint, text_key bigint, hashes array<bigint>")


def marked(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) sorted: places are start and end in one integer, those that overlap are made one."""
    order = np.lexsort((start, text))
    text, start, end = text[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    reach = np.maximum.accumulate((text << 32) + end)
    new = np.flatnonzero(np.concatenate(([True], (text[1:] << 32) + start[1:] > reach[:-1]))) if len(text) else np.zeros(0, np.int64)
    stop = reach[np.append(new[1:], len(text)) - 1] - (text[new] << 32) if len(text) else new
    return text[new], (start[new] << 32) | stop


def phrases_of(rows: DataFrame, ranges: int) -> DataFrame:
    """(rank, text_key, text, hashes, ...) to (range, phrases, bytes, places, texts, rank, text_key, body): the phrases at shared triggers.

    Each distinct phrase of up to FLUSH bytes of texts once, packed by range of its trigger with its places in the texts
    of the smallest rank. Of the other texts the phrase goes whole: rows without phrases have the marked places of one as ``body``.
    """
    def flushed(held: list, rank: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        hashed, of, first, size, data = (np.concatenate([h[k] for h in held]) for k in range(5))
        coded = binaries(data, size).dictionary_encode()
        phrase = coded.indices.to_numpy()
        least = np.full(len(coded.dictionary), LAST)
        np.minimum.at(least, phrase, rank[of])
        del coded
        whole = rank[of] > least[phrase]
        text, place = marked(of[whole], first[whole], (first + size)[whole])
        new = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else text
        out = [(t % ranges, 0, 0, 0, 0, r, t, part.tobytes()) for r, t, part in zip(rank[text[new]].tolist(), key[text[new]].tolist(), np.split(place, new[1:]))]
        where = (hashed & np.uint64((1 << 40) - 1)).astype(np.int64) % ranges
        rest = np.flatnonzero(~whole)
        rest = rest[np.lexsort((rest, phrase[rest], where[rest]))]
        at = np.cumsum(size) - size
        cut = np.searchsorted(where[rest], np.arange(ranges + 1))
        for r in np.flatnonzero(np.diff(cut)).tolist():
            places = rest[cut[r]:cut[r + 1]]
            new = np.concatenate(([True], phrase[places][1:] != phrase[places][:-1]))
            one = places[new]
            length = size[one]
            raw = data[np.repeat(at[one] - (np.cumsum(length) - length), length) + np.arange(length.sum())]
            texts, local = np.unique(of[places], return_inverse=True)
            out.append((r, len(one), len(raw), len(places), len(texts), 0, 0, pack(
                length.astype(np.uint8), raw, new.astype(np.uint8), local.astype(np.uint32), first[places].astype(np.uint32), np.diff(rank[texts], prepend=0), key[texts])))
        yield table(out, "range", "phrases", "bytes", "places", "texts", "rank", "text_key", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ranks, keys, n, total = [], [], [], 0, 0
        for batch in batches:
            rank, key = (batch.column(k).to_numpy() for k in range(2))
            lists = batch.column(3)
            for start, data, at in blocks(batch.column(2)):
                rows = len(at) - 1
                row, hashed, first, last = triggers(data, at)
                wanted = lists.slice(start, rows)
                count = pa.compute.fill_null(pa.compute.list_value_length(wanted), 0).to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(rows), count).astype(np.uint64)
                found = mix(wanted.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)) ^ mix(of + np.uint64(1))
                hit = np.flatnonzero(np.isin(mix(short(hashed)) ^ mix(row.astype(np.uint64) + np.uint64(1)), found))
                size = last[hit] - first[hit] + LENGTH
                held.append((short(hashed[hit]), row[hit] + n, first[hit] - at[row[hit]], size, data[np.repeat(first[hit] - (np.cumsum(size) - size), size) + np.arange(size.sum())]))
                ranks.append(rank[start:start + rows])
                keys.append(key[start:start + rows])
                n, total = n + rows, total + len(data)
                if total >= FLUSH:
                    yield from flushed(held, np.concatenate(ranks), np.concatenate(keys))
                    held, ranks, keys, n, total = [], [], [], 0, 0
        if held:
            yield from flushed(held, np.concatenate(ranks), np.concatenate(keys))

    kind = "range bigint, phrases bigint, bytes bigint, places bigint, texts bigint, rank bigint, text_key bigint, body binary"
    return rows.mapInArrow(run, kind)


def suffix_verdicts(dictionary: DataFrame) -> DataFrame:
    """(rank, text_key, place): the places that go, start and end in one integer.

    A phrase goes whole where a smaller document has it. In the first document that has it those of its strings go that
    also begin a suffix of a phrase with a smaller first document. Equal strings have one trigger, so ranges of triggers
    are sorted apart: a sorted run of suffixes by the hash of their first LENGTH bytes, then by document.
    """
    def run(part: pd.DataFrame) -> pd.DataFrame:
        ready, sent = part[part["phrases"] == 0], part[part["phrases"] > 0]
        count = [len(b) // 8 for b in ready["body"]]
        out = [pd.DataFrame({"rank": np.repeat(ready["rank"].to_numpy(), count), "text_key": np.repeat(ready["text_key"].to_numpy(), count), "place": np.frombuffer(b"".join(ready["body"]), np.int64)})]
        if len(sent):
            parts = [unpack(b, (p, np.uint8), (n, np.uint8), (o, np.uint8), (o, np.uint32), (o, np.uint32), (t, np.int64), (t, np.int64))
                     for p, n, o, t, b in zip(*(sent[c] for c in ("phrases", "bytes", "places", "texts", "body")))]
            length = np.concatenate([p[0] for p in parts]).astype(np.int64)
            coded = binaries(np.concatenate([p[1] for p in parts]), length).dictionary_encode()
            phrase = coded.indices.to_numpy()[np.cumsum(np.concatenate([p[2] for p in parts]), dtype=np.int64) - 1]
            text = np.concatenate([p[3] + f for p, f in zip(parts, np.cumsum([0] + [len(p[5]) for p in parts]))]).astype(np.int64)
            first = np.concatenate([p[4] for p in parts]).astype(np.int64)
            rank, key = np.concatenate([np.cumsum(p[5]) for p in parts]), np.concatenate([p[6] for p in parts])
            data, at = text_bytes(coded.dictionary)
            size = np.diff(at) - LENGTH + 1
            first_doc = np.full(len(size), LAST)
            np.minimum.at(first_doc, phrase, rank[text])
            of = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            hashed = string_hashes(data)[at[of] + place]
            doc = first_doc[of]
            order = np.lexsort((doc, hashed[:, 1], hashed[:, 0]))
            new = np.concatenate(([True], (hashed[order][1:] != hashed[order][:-1]).any(axis=1)))
            least = np.empty(len(of), dtype=doc.dtype)
            least[order] = doc[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
            mask = np.zeros(len(size), dtype=np.int64)
            np.bitwise_or.at(mask, of, np.where(least < doc, np.left_shift(np.int64(1), place), 0))
            whole = rank[text] > first_doc[phrase]
            some = np.flatnonzero(~whole & (mask[phrase] != 0))
            at_some, bit = np.nonzero((mask[phrase[some], None] >> np.arange(MOST)) & 1)
            begin = np.concatenate((first[whole], first[some][at_some] + bit))
            end = np.concatenate(((first + size[phrase] + LENGTH - 1)[whole], first[some][at_some] + bit + LENGTH))
            named, places = marked(np.concatenate((text[whole], text[some][at_some])), begin, end)
            out.append(pd.DataFrame({"rank": rank[named], "text_key": key[named], "place": places}))
        return pd.concat(out)

    return dictionary.groupBy("range").applyInPandas(run, "rank bigint, text_key bigint, place bigint")


def passage_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (starts and ends of maximal removed runs), kept (bytes), text_key.

    A byte is removed if a string of 50 bytes that covers it also begins in a document with a smaller id; overlaps
    count, and strings are judged on the input. NULL and empty texts have no bytes. NULL ids come last and rows of one
    id, repeated rows too, remove nothing from each other; an empty table gives no rows; other columns are ignored.
    Strings are compared by 128-bit hashes. Ids are integers.

    Nothing is staged, and both joins ask for the same columns of the texts by the same keys, so one shuffle of them
    serves both.
    """
    ranges = min(RANGES, max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(text_col).alias("text_key")).withColumn(
        "rank", F.coalesce("doc_id", F.lit(LAST)))
    by_text = hashes_of(shared_triggers(trigger_rows(plain, ranges)))
    sent = phrases_of(plain.join(by_text, ["rank", "text_key"], "left").select("rank", "text_key", "text", "hashes", "doc_id"), 4 * ranges)
    marks = suffix_verdicts(sent).groupBy("rank", "text_key").agg(F.collect_list("place").alias("marks"))   # bounded by the text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            data, at = text_bytes(batch.column(2))
            lists = batch.column(3)
            ends = np.concatenate(([0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
            places = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            for r in range(len(batch)):
                raw = data[at[r]:at[r + 1]]
                edge = np.zeros(len(raw) + 1, dtype=np.int64)
                place = places[ends[r]:ends[r + 1]]
                np.add.at(edge, place >> 32, 1)
                np.add.at(edge, place & 0xFFFFFFFF, -1)
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                sizes.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in zip(turn[0::2].tolist(), turn[1::2].tolist())])
                kept.append(raw[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                                              pa.array(kept, pa.binary()), batch.column(1)], ["doc_id", "n_bytes", "spans", "kept", "text_key"])

    whole = plain.join(marks, ["rank", "text_key"], "left").select("doc_id", "text_key", "text", "marks")
    return whole.mapInArrow(cut, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary, text_key bigint")
