"""Repeated runs of lines: prefix doubling over line-id sequences; later copies are deleted."""
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.staging import staged
from .dedup_exact import text_key

MIN_LINES = 2
DOC = ["unnamed", "doc_id", "text_key"]


def repeated(suffixes: DataFrame, by: list[str]) -> DataFrame:
    """Suffixes that share ``by`` with another one, renamed: their new name is the first place of their class.

    Suffixes alone in their class have their final rank and leave. A class is only reduced to its first place and
    size, then joined back, so a line that holds a third of all rows is spread over tasks.
    """
    place = F.struct(*DOC, "line")
    classes = suffixes.groupBy(*by).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return suffixes.join(classes, by).select(*DOC, "line", F.col("first").alias("name"))


def longer(suffixes: DataFrame, shift: int) -> DataFrame:
    """Pairs of the names of each suffix and of the one ``shift`` lines further in the same document."""
    here = suffixes.select(*DOC, "line", F.col("name").alias("head"))
    there = suffixes.select(*[F.col(c).alias(f"_{c}") for c in DOC], (F.col("line") - shift).alias("_line"), F.col("name").alias("tail"))
    same = (F.col("unnamed") == F.col("_unnamed")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")) & (F.col("line") == F.col("_line"))
    return here.join(there, same).select(*DOC, "line", "head", "tail")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(unnamed, doc_id, text_key, line, name): places whose next ``min_lines`` lines occur elsewhere, with the first such place.

    The classes are the intervals of the suffix array whose common prefix is at least ``min_lines`` lines long. Ranks
    double from one line on and stop there: deeper ranks would only order suffixes within an interval.
    """
    lines = docs.select(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    ids = lines.select(*DOC, "line", F.unhex(F.md5("content")).alias("line_id")).distinct()
    suffixes, depth = staged(repeated(staged(ids, "lines"), ["line_id"]), "suffixes"), 1
    while depth < min_lines:
        step = min(depth, min_lines - depth)   # two overlapping names cover lengths that are no power of two
        suffixes = staged(repeated(staged(longer(suffixes, step), "pairs"), ["head", "tail"]), "suffixes")
        depth += step
    return suffixes


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """One row per input row: doc_id, n_lines, runs (start and end lines of maximal later copies), kept_text, text_key.

    A line is deleted if it lies within ``min_lines`` consecutive lines of its document that also begin at an earlier
    place: a smaller id (NULL last), or an earlier line of the same document. Copies may overlap, and places are
    compared on the input. Lines end at line feeds and are compared byte by byte, empty ones too. NULL and empty texts
    have no lines. Rows that repeat an id and a text are one document and get the same result each; an empty table
    gives no rows; other columns are ignored.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_key(text_col).alias("text_key"))
    later = repeated_runs(plain.filter("text != ''"), min_lines).filter(F.col("name") != F.struct(*DOC, "line"))
    by_doc = later.groupBy(*DOC).agg(F.sort_array(F.collect_list("line")).alias("starts"))   # bounded by the document's lines
    keyed = lambda df: df.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    joined = keyed(plain).join(keyed(by_doc).select("id", "text_key", "starts"), ["id", "text_key"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, texts = [], [], []
            for text, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                lines = text.split("\n") if text else []
                spans: list[list[int]] = []
                for s in starts or []:
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = s + min_lines
                    else:
                        spans.append([s, s + min_lines])
                for a, b in reversed(spans):
                    del lines[a:b]
                sizes.append(len(lines) + sum(b - a for a, b in spans))
                runs.append([{"start": a, "end": b} for a, b in spans])
                texts.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                                              pa.array(texts, pa.string()), batch.column(1)], ["doc_id", "n_lines", "runs", "kept_text", "text_key"])

    id_type = plain.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text_key", "text", "starts").mapInArrow(
        cut, f"doc_id {id_type}, n_lines bigint, runs array<struct<start:bigint,end:bigint>>, kept_text string, text_key bigint")
