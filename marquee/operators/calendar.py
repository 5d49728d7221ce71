"""Windows over dated rows."""
import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import as_date


def in_week(day: Column, run_date) -> Column:
    """``run_date <= day < run_date + 7``. A plain range on the column, so it is pushed to the scan."""
    run = as_date(run_date)
    return (day >= run) & (day < F.date_add(run, 7))


def current_week(df: DataFrame, day: str, run_date) -> DataFrame:
    return df.filter(in_week(F.col(day), run_date))


def current_week_nested(films: DataFrame, run_date) -> DataFrame:
    """Films with only the screenings of the coming seven days; films left with none are dropped."""
    kept = films.withColumn("seances", F.filter("seances", lambda s: in_week(s["date"], run_date)))
    return nonempty(kept)


def nonempty(films: DataFrame) -> DataFrame:
    return films.filter(F.size("seances") > 0)


def timestamp_range(column: str, start, days: int = 7) -> Column:
    """Half-open range on a timestamp column against literals, so that parquet statistics prune row groups."""
    first = start if isinstance(start, dt.date) else dt.date.fromisoformat(start)
    last = first + dt.timedelta(days=days)
    return ((F.col(column) >= F.lit(str(first)).cast("timestamp_ntz"))
            & (F.col(column) < F.lit(str(last)).cast("timestamp_ntz")))
