"""Carry-forward inside a page and fill across copies of one work."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.missing import is_missing
from .grouping import best_fields
from .skew import spread_lookup

CHUNK_ROWS = 100_000


def carry_forward(df: DataFrame, key: str, row_no: str, value: Column, default, out: str,
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Last known ``value`` at or before each row of its key, ``default`` before the first.

    A long key is cut into runs of ``chunk_rows`` row numbers: each run is summed up by its last value, those few
    summaries are carried forward, and every run then starts from what came before it, on its own task. The cut does
    not change the result: NULL keys are one key, and a row without a number has its own value or the default and
    carries nothing to others.
    """
    cut = df.withColumn("_run", F.floor(F.col(row_no) / chunk_rows)).withColumn("_value", value)
    last = cut.groupBy(key, "_run").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(row_no))).alias("_last"),
        F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    start = last.select(F.col(key).alias("_key"), F.col("_run").alias("_from"), F.last("_last", ignorenulls=True).over(before).alias("_start"))
    upto = Window.partitionBy(key, "_run").orderBy(row_no).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(start, F.col(key).eqNullSafe(F.col("_key")) & F.col("_run").eqNullSafe(F.col("_from")), "left")
    carried = F.coalesce(F.last("_value", ignorenulls=True).over(upto), "_start", F.lit(default))
    filled = joined.withColumn(out, F.when(F.col(row_no).isNull(), F.coalesce("_value", F.lit(default))).otherwise(carried))
    return filled.drop("_run", "_value", "_start", "_key", "_from")


def propagate_fill(df: DataFrame, key: str, fields: dict[str, str], order: Column) -> DataFrame:
    """Give every row of a group the group's best value of each field it misses; rows without key stay as they are."""
    best = best_fields(df.filter(F.col(key).isNotNull()), key, fields, order)
    best = best.select(key, "n_rows", *[F.col(f).alias(f"_best_{f}") for f in fields])
    filled = spread_lookup(df, best, [key], "left", right_weight="n_rows")
    values = {f: F.when(is_missing(F.col(f), kind), F.coalesce(F.col(f"_best_{f}"), F.col(f))).otherwise(F.col(f))
              for f, kind in fields.items()}
    return filled.withColumns(values).select(*df.columns)


def detail_fill(df: DataFrame, details: DataFrame, on: str, fields: dict[str, str]) -> DataFrame:
    """Fill missing fields of every row from the one detail row of its key."""
    side = details.select(on, *[F.col(f).alias(f"_d_{f}") for f in fields])
    joined = spread_lookup(df, side, [on], "left")
    values = {f: F.when(is_missing(F.col(f), kind) & ~is_missing(F.col(f"_d_{f}"), kind), F.col(f"_d_{f}"))
                  .otherwise(F.col(f)) for f, kind in fields.items()}
    return joined.withColumns(values).select(*df.columns)
