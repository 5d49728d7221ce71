"""Keyed upsert without MERGE, integrity reports and rejected rows. Results are new tables; nothing is updated in place."""
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.missing import is_missing
from .dedup import first_per_key, last_per_key
from .skew import spread_lookup


def key_text(*parts: Column) -> Column:
    """A natural key as one text, which ``key_id`` hashes; NULL parts count as a value of their own."""
    coded = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.concat_ws("\u0001", *coded)


def text_id(text: Column) -> Column:
    """Id of a natural key given as ``key_text``."""
    return F.sha2(text, 256)


def key_id(*parts: Column) -> Column:
    """Deterministic id of a natural key; NULL parts count as a value of their own."""
    return text_id(key_text(*parts))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list, keep: str = "first",
           stable: tuple = ("id", "created_at"), null_safe: bool = True) -> DataFrame:
    """Target after loading ``source``: one source row per key (first or last by ``order``) replaces all columns.

    Columns in ``stable`` keep the stored value. With ``null_safe`` NULL key parts match each other; without it such
    rows never match and are added again by every load, as a plain SQL unique constraint allows.
    """
    cols = target.columns
    one = (first_per_key if keep == "first" else last_per_key)(source, keys, order).select(*cols)
    t, s = target.select(F.struct(*cols).alias("t")), one.select(F.struct(*cols).alias("s"))
    same = lambda k: F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) if null_safe else F.col(f"t.{k}") == F.col(f"s.{k}")
    both = t.join(s, reduce(lambda a, b: a & b, [same(k) for k in keys]), "full_outer")
    new = F.col("s").isNotNull()
    return both.select(*[(F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")) if c in stable else
                          F.when(new, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))).alias(c) for c in cols])


def insert_if_absent(target: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """Seed rows whose key is not stored yet are added, one of each key; stored rows stay."""
    return target.unionByName(seed.select(*target.columns).dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their surplus."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("surplus")).filter("surplus > 0")


def integrity_report(df: DataFrame, table: str, unique: list[list[str]] = (), not_null: list[str] = (),
                     references: list[tuple[list[str], DataFrame, str]] = ()) -> DataFrame:
    """(table, rule, violations): surplus rows per unique key, NULLs per column, rows without parent per reference (NULL keys refer to nothing)."""
    row = lambda counted, rule: counted.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"),
                                               F.coalesce("n", F.lit(0)).cast("long").alias("violations"))
    parts = [row(duplicate_keys(df, k).agg(F.sum("surplus").alias("n")), "unique(" + ",".join(k) + ")") for k in unique]
    if not_null:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in not_null])
        parts += [counts.select(F.lit(table).alias("table"), F.explode(F.array(*[
            F.struct(F.lit(f"not_null({c})").alias("rule"), F.col(c).alias("violations")) for c in not_null])).alias("x"))
            .select("table", "x.rule", "x.violations")]
    for keys, parent, name in references:
        counted = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))  # one row per key before anything meets its parent
        orphans = counted.join(parent.select(*keys).distinct(), keys, "left_anti")
        parts.append(row(orphans.agg(F.sum("_n").alias("n")), f"references {name}"))
    return reduce(DataFrame.unionByName, parts)


def cascade_delete(child: DataFrame, surviving: DataFrame, on: list[str]) -> DataFrame:
    """Child rows whose parent survives."""
    return spread_lookup(child, surviving.select(*on).distinct(), on, "left_semi")


def reject_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first broken rule, NULL for a good row. A rule is (reason, broken?)."""
    return F.coalesce(*[F.when(broken, F.lit(reason)) for reason, broken in rules])


def split_rejects(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``reason``): bad rows do not stop a load."""
    judged = df.withColumn("reason", reject_reason(rules))
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def require_fields(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Rows in which none of the fields is missing."""
    return df.filter(reduce(lambda a, b: a & b, [~is_missing(F.col(f), kind) for f, kind in fields.items()]))
