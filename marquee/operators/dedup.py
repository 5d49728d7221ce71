"""First, last and best row per key as map-side combined aggregates: a hot key is reduced before the shuffle."""
from pyspark.sql import Column, DataFrame, functions as F


def _pick(df: DataFrame, keys: list, order: list, agg) -> DataFrame:
    names = [k for k in keys]
    rest = [c for c in df.columns if c not in names]
    return (df.groupBy(*names).agg(agg(F.struct(*rest), F.struct(*order)).alias("_row"))
              .select(*names, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Row with the smallest ``order`` of every key; NULL keys are equal to each other."""
    return _pick(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Row with the largest ``order`` of every key."""
    return _pick(df, keys, order, F.max_by)


def distinct_in_order(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Each value once, with its first position."""
    return df.groupBy(key).agg(F.min(pos).alias(pos))


def top_k(df: DataFrame, by: list[Column], k: int) -> DataFrame:
    return df.orderBy(*by).limit(k)
