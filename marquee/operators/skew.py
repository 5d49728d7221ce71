"""Joins that stay even when one key holds a large share of the rows.

Heavy keys are found with a frequent-items sketch: one pass over the key columns, for any number of lookups at once, a
sketch of fixed size per task and at most ``HEAVY_KEYS`` hashes out. Only the lookup rows of those keys are broadcast, so
the broadcast is bounded whatever the data size; rows with a heavy or NULL key are then spread by row hash while all
others meet their match by key. No row is dropped or sampled: the sketch only decides which way a row takes, and both
ways give the same answer. A key outside the sketch's list holds at most 1/257 of the rows; where that is still more
than a task should read, adaptive skew joins split it, so leave ``spark.sql.adaptive.skewJoin.enabled`` on.
"""
from pyspark.sql import Column, DataFrame, functions as F, types as T

HEAVY_KEYS = 256
SMALL_ROWS = 500_000    # a lookup table of at most so many rows may be broadcast whole
SKETCH_ITEMS = 8192
SPREAD = 4096


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def heavy_keys(df: DataFrame, key_sets: list[list[str]], limit: int = HEAVY_KEYS) -> list[Column]:
    """For each set of key columns the hashes of its most frequent keys, at most ``limit``: one scan for all sets."""
    hashes = df.select(*[key_hash(keys).alias(f"h{i}") for i, keys in enumerate(key_sets)])
    top = [F.transform(F.expr(f"approx_top_k(h{i}, {limit}, {SKETCH_ITEMS})"), lambda t: t["item"]).alias(f"h{i}") for i in range(len(key_sets))]
    found = hashes.agg(F.struct(*top).alias("hot")).scalar()
    return [found[f"h{i}"] for i in range(len(key_sets))]


def spread_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by key over four tasks a core or more, for work that is heavy per row while the file is small."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _row_hash(df: DataFrame, spread_by: list[str] | None) -> Column:
    usable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    return F.pmod(F.xxhash64(*(spread_by or usable)), F.lit(SPREAD)) + 1


def spread_lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", right_weight: str | None = None,
                  spread_by: list[str] | None = None, hot_keys: Column | None = None) -> DataFrame:
    """Join ``left`` to ``right``, which has at most one row per key, keeping left rows as they are.

    ``how``: left, inner, left_semi or left_anti. ``right_weight`` names a column of ``right`` that already counts the
    left rows per key; the heavy keys are then simply its largest ones and no sketch is needed. ``hot_keys`` passes on what ``heavy_keys``
    found for ``left`` or for what it was made of.
    """
    values = [c for c in right.columns if c not in on and c != right_weight]
    packed = right.select(*on, F.struct(F.lit(True).alias("_hit"), *values).alias("_v"),
                          *([right_weight] if right_weight else []))
    if right_weight:
        hot = packed.orderBy(F.desc(right_weight), *on).limit(HEAVY_KEYS).select(*on, F.col("_v").alias("_hv"))
        packed = packed.drop(right_weight)
    else:
        hot_keys = heavy_keys(left, [on])[0] if hot_keys is None else hot_keys
        hot = packed.filter(F.array_contains(hot_keys, key_hash(on))).select(*on, F.col("_v").alias("_hv"))
    any_null = F.lit(False)
    for k in on:
        any_null = any_null | F.col(k).isNull()
    marked = (left.join(F.broadcast(hot), on, "left")
                  .withColumn("_salt", F.when(F.col("_hv").isNotNull() | any_null, _row_hash(left, spread_by))
                                        .otherwise(F.lit(0).cast("long"))))
    found = (marked.join(packed.withColumn("_salt", F.lit(0).cast("long")), [*on, "_salt"], "left")
                   .withColumn("_v", F.coalesce("_hv", "_v")))
    return _picked(left, found, values, how)


def small_lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """``spread_lookup`` for a ``right`` of few rows, as ``is_small`` tells: it is broadcast, ``left`` is not shuffled."""
    values = [c for c in right.columns if c not in on]
    packed = right.select(*on, F.struct(F.lit(True).alias("_hit"), *values).alias("_v"))
    return _picked(left, left.join(F.broadcast(packed), on, "left"), values, how)


def is_small(df: DataFrame, most: int = SMALL_ROWS) -> bool:
    return df.count() <= most


def _picked(left: DataFrame, found: DataFrame, values: list[str], how: str) -> DataFrame:
    """Rows of ``left`` with what they ``found`` as ``_v``, in the manner of ``how``."""
    hit = F.col("_v").isNotNull()
    if how in ("inner", "left_semi"):
        found = found.filter(hit)
    elif how == "left_anti":
        found = found.filter(~hit)
    out = [F.col(c) for c in left.columns]
    if how in ("left", "inner"):
        out += [F.col(f"_v.{c}").alias(c) for c in values]
    return found.select(*out)
