"""Grouping of screenings and works."""
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.missing import is_missing

SLOT = ["date", "heure", "version"]


def dedup_screenings(df: DataFrame, keys: list[str], pos: str, extra: list[str] = ()) -> DataFrame:
    """One row per (keys, date, heure, version) with the values of its first position."""
    picks = [F.min_by(c, pos).alias(c) for c in extra]
    return df.groupBy(*keys, *SLOT).agg(F.min(pos).alias(pos), *picks)


def nest_screenings(df: DataFrame, keys: list[str], pos: str | None = None, extra: list[str] = ()) -> DataFrame:
    """One row per key with its screenings as a list by (date, heure), equal times in order of ``pos``.

    A list holds the distinct slots of one key. Keep that bounded by the keys themselves: add the programme week to
    them, or filter to one week first, as publication does.
    """
    tie = [pos] if pos else []
    item = F.struct("date", "heure", *tie, *[c for c in SLOT[2:]], *extra)
    nested = df.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("seances"))
    if not pos:
        return nested
    return nested.withColumn("seances", F.transform("seances", lambda s: s.dropFields(pos)))


def best_fields(df: DataFrame, key: str | list[str], fields: dict[str, str], order: Column) -> DataFrame:
    """Per key the first value of every field that is not missing, in ``order``, and the number of rows ``n_rows``."""
    keys = [key] if isinstance(key, str) else key
    picks = [F.min_by(F.col(f), F.when(~is_missing(F.col(f), kind), order)).alias(f) for f, kind in fields.items()]
    return df.groupBy(*keys).agg(*picks, F.count(F.lit(1)).alias("n_rows"))


def week_lines(df: DataFrame, keys: list[str]) -> DataFrame:
    """Nested screenings as one sorted line per key (``date heure version`` joined by ``;``)."""
    return df.select(*keys, F.array_join(F.transform("seances", lambda s: F.concat_ws(
        " ", s["date"].cast("string"), s["heure"], s["version"])), ";").alias("seances"))
