"""Sinks: programme files, tables in key order, and the append-only state."""
from pyspark.sql import Column, DataFrame, DataFrameWriter, functions as F

from .. import schema
from ..operators.staging import staged
from .versions import COMPRESSION


def film_struct(films: DataFrame) -> Column:
    """Film columns as one struct in published order; absent ones are NULL."""
    return F.struct(*[(F.col(f.name) if f.name in films.columns else F.lit(None).cast(f.dataType)).alias(f.name)
                      for f in schema.FILM])


def programme_documents(films: DataFrame, run_ts: str, sources: list[str], per: list[str]) -> DataFrame:
    """Programme documents (generated_at, sources, films), one per value of ``per``.

    A document lists the films of one venue for one week, in order of (src_order, row_order): ``per`` names the columns
    of both, unless the rows are of one week already. One document for all venues would have to pass through a single task; ``write_programme`` writes film rows as JSON lines for that.
    """
    order = [c for c in ("src_order", "row_order") if c in films.columns]
    listed = films.groupBy(*per).agg(F.array_sort(F.collect_list(F.struct(*order, film_struct(films).alias("film")))).alias("x"))
    return listed.select(*per, F.lit(run_ts).alias("generated_at"), F.array(*map(F.lit, sources)).alias("sources"),
                         F.transform("x", lambda e: e["film"]).alias("films"))


def write_programme(films: DataFrame, path: str | None, run_ts: str, sources: list[str]) -> DataFrame:
    """Publish one document per film and line, in the shape ``read_programme`` reads; without a path only return the rows."""
    out = films.select(F.lit(run_ts).alias("generated_at"), F.array(*map(F.lit, sources)).alias("sources"),
                       F.array(film_struct(films)).alias("films"))
    if path:
        out.write.mode("overwrite").json(path)
    return out


def programme_week(day: Column) -> Column:
    """Wednesday that opens the programme week of a day."""
    return F.date_sub(day, F.pmod(F.weekday(day) - 2, F.lit(7)))


def write_star(cinemas: DataFrame, films: DataFrame, seances: DataFrame, path: str) -> None:
    """New snapshot of the three tables, parents before children; screenings are laid out by programme week.

    Rebalancing gives a week few files and still splits a week that is too large for one task.
    """
    cinemas.write.mode("overwrite").parquet(f"{path}/cinemas")
    films.write.mode("overwrite").parquet(f"{path}/films")
    by_week(seances).parquet(f"{path}/seances")


def write_weeks(cinemas: DataFrame, films: DataFrame, seances: DataFrame, path: str) -> None:
    """Bring the tables under ``path`` up to date in place: of the screenings only the weeks given are replaced.

    Everything is written aside first, since it is made of the tables that are replaced.
    """
    cinemas, films, seances = staged(cinemas, "cinemas"), staged(films, "films"), staged(seances.drop("week"), "seances")
    cinemas.write.mode("overwrite").parquet(f"{path}/cinemas")
    films.write.mode("overwrite").parquet(f"{path}/films")
    by_week(seances).option("partitionOverwriteMode", "dynamic").parquet(f"{path}/seances")


def by_week(seances: DataFrame) -> DataFrameWriter:
    """Rows that carry their ``week`` are laid out by it already."""
    laid = seances if "week" in seances.columns else seances.withColumn("week", programme_week(F.col("date"))).hint("rebalance", "week")
    return laid.write.mode("overwrite").option("compression", COMPRESSION).partitionBy("week")


def append_state(urls: DataFrame, path: str) -> None:
    urls.select("url").distinct().write.mode("append").parquet(path)
