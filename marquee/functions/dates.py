"""French dates, clock times, programme weeks and weekly file names as Column functions."""
import datetime as dt

from pyspark.sql import Column, functions as F

from .. import constants as K
from .binding import let
from .text import extract, fold_accents, strip


def as_date(day) -> Column:
    """A run date given as Column, ``date`` or ISO text."""
    return day if isinstance(day, Column) else F.lit(day if isinstance(day, dt.date) else dt.date.fromisoformat(day))


def _number_of(word: Column, words: list[str]) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, words)), word), F.lit(0)).cast("int")


def _name_of(number: Column, words: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), number)


def month_number(word: Column) -> Column:
    return _number_of(F.lower(word), K.MONTHS)


def month_name(day: Column) -> Column:
    return _name_of(F.month(day), K.MONTHS)


def weekday_name(day: Column) -> Column:
    return _name_of(iso_weekday(day), K.WEEKDAYS)


def iso_weekday(day: Column) -> Column:
    return F.weekday(day) + 1


def ymd(y: Column, m: Column, d: Column) -> Column:
    """Date of three numbers, NULL when there is no such day."""
    return F.try_to_date(F.concat(y.cast("string"), F.lit("-"), m.cast("string"), F.lit("-"), d.cast("string")),
                         "y-M-d")


def iso_date(c: Column) -> Column:
    """Strict ``YYYY-MM-DD``; NULL for anything else."""
    return F.when(c.rlike(K.ISO_DAY), c.try_cast("date"))


def date_fr(c: Column, run_date) -> Column:
    """``12/03/2025``, ``12 mars [2025]`` or ``... mercredi 12 mars [2025]``; the year defaults to the run year."""
    run_year = F.year(as_date(run_date))

    def worded(s, pattern):
        day, month = extract(s, pattern, 1), month_number(extract(s, pattern, 2))
        return ymd(F.coalesce(extract(s, pattern, 3).cast("int"), run_year), month, day.cast("int"))

    def numeric(s):
        return ymd(extract(s, K.NUMERIC_DATE, 3).cast("int"), extract(s, K.NUMERIC_DATE, 2).cast("int"),
                   extract(s, K.NUMERIC_DATE, 1).cast("int"))

    return let(F.lower(strip(c)), lambda s: F.coalesce(numeric(s), worded(s, K.WORD_DATE), worded(s, K.WEEKDAY_DATE)))


def clock(hour: Column, minute: Column) -> Column:
    return F.concat(F.lpad(hour.cast("int").cast("string"), 2, "0"), F.lit(":"), minute)


def heure(c: Column) -> Column:
    """``14h30``, ``14:30``, ``14 h 30`` or a closing ``14h`` as ``HH:MM``; values are not range checked."""
    s = F.replace(F.lower(strip(c)), F.lit(" "), F.lit(""))
    full = clock(extract(s, K.CLOCK, 1), extract(s, K.CLOCK, 2))
    return F.coalesce(full, clock(extract(s, K.CLOCK_HOUR_ONLY, 1), F.lit("00")))


def times_in(c: Column, pattern: str = K.CLOCK_WORD) -> Column:
    """Every clock time of a text, normalised, in text order; ``pattern`` ends with a separator and two digits."""
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)),
                       lambda t: clock(F.substr(t, F.lit(1), F.length(t) - 3), F.substring(t, -2, 2)))


def distinct_times(c: Column) -> Column:
    return F.array_distinct(times_in(c))


def drop_footnote(c: Column) -> Column:
    """``20h001`` to ``20h00``: one footnote digit glued to a time."""
    return F.regexp_replace(c, K.FOOTNOTE, "$1")


def time_seconds(c: Column) -> Column:
    return F.when((F.length(c) == 5) & c.contains(":"), F.concat(c, F.lit(":00"))).otherwise(c)


def time_minutes(c: Column) -> Column:
    return F.substring(c, 1, 5)


def slice_timestamp(c: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` to (date, heure); NULL when too short or no such day."""
    day = iso_date(F.substring(c, 1, 10))
    return F.when((F.length(c) >= 16) & day.isNotNull(),
                  F.struct(day.alias("date"), F.substring(c, 12, 5).alias("heure")))


def duration_minutes(c: Column) -> Column:
    """``1h39``, ``1 h 39``, ``90 min``, ``43 minutes`` in minutes."""
    hours = extract(c, K.DURATION_HOURS, 1).cast("int") * 60 + extract(c, K.DURATION_HOURS, 2).cast("int")
    return F.coalesce(hours, extract(c, K.DURATION_MINUTES).cast("int"))


def duration_prose(c: Column) -> Column:
    """Minutes of a sentence ``d'une durée de ...``."""
    hours = extract(c, K.DURATION_PROSE_HOURS, 1).cast("int") * 60 + extract(c, K.DURATION_PROSE_HOURS, 2).cast("int")
    return F.coalesce(hours, extract(c, K.DURATION_PROSE_MINUTES).cast("int"))


def year_in(c: Column, pattern: str = K.YEAR_WORD) -> Column:
    return extract(c, pattern).cast("int")


# --- programme weeks --------------------------------------------------------------------------------------------

def week_anchor(day: Column) -> Column:
    """Wednesday on or before ``day``; a Tuesday already belongs to the week that starts the next day."""
    return F.when(F.weekday(day) == 1, F.date_add(day, 1)).otherwise(programme_week(day))


def programme_week(day: Column) -> Column:
    """Wednesday on or before ``day``."""
    return F.date_sub(day, F.pmod(F.weekday(day) - 2, F.lit(7)))


def period_start(c: Column, pattern: str = K.WEEK_PERIOD_LIVE, faithful: bool = False) -> Column:
    """First day of ``Du 4 au 10 mars 2026``.

    One month is named, that of the last day: a first day number above the last one lies in the month before.
    ``faithful`` keeps the named month for both.
    """
    # one short match instead of four searches through a whole document
    said = F.regexp_extract(c, pattern, 0)

    def start(s):
        first, last = extract(s, pattern, 1).try_cast("int"), extract(s, pattern, 2).try_cast("int")
        month, year = month_number(extract(s, pattern, 3)), extract(s, pattern, 4).cast("int")
        if faithful:
            return ymd(year, month, first)
        back = first > last
        return ymd(F.when(back & (month == 1), year - 1).otherwise(year),
                   F.when(back, F.when(month == 1, 12).otherwise(month - 1)).otherwise(month), first)

    return let(said, start)


def week_map(c: Column, faithful: bool = False) -> Column:
    """ISO weekday -> date for the announced week, at most seven days, closed by the named last day."""
    last = extract(c, K.WEEK_PERIOD, 2).try_cast("int")

    def days(first):
        week = F.sequence(first, F.date_add(first, 6))
        stop = F.array_position(F.transform(week, F.dayofmonth), last).cast("int")
        return F.slice(week, F.lit(1), F.when(stop > 0, stop).otherwise(7))

    kept = let(period_start(c, K.WEEK_PERIOD, faithful), days)
    return F.map_from_entries(F.transform(kept, lambda d: F.struct(iso_weekday(d), d)))


def weekly_url(week_start: Column, site: str, stem: str = K.WEEKLY_FILE_STEM) -> Column:
    """Address of the weekly file: both months are named only when the week crosses a month."""
    return let(week_start, lambda start: _weekly_url(start, F.date_add(start, 6), site + stem))


def _weekly_url(week_start: Column, end: Column, prefix: str) -> Column:
    day = lambda d: F.dayofmonth(d).cast("string")
    name = lambda d: _name_of(F.month(d), K.MONTH_SLUGS)
    head = F.when(F.month(week_start) == F.month(end), day(week_start)).otherwise(
        F.concat_ws("-", day(week_start), name(week_start)))
    return F.concat(F.lit(prefix), F.concat_ws("-", F.lit("du"), head, F.lit("au"), day(end), name(end),
                                                    F.year(end).cast("string")), F.lit(".pdf"))


def slug_week(url: Column) -> Column:
    """(start, end) read from a weekly file name; NULL when it names no valid week."""
    num = lambda c: c.try_cast("int")
    month = lambda c: _number_of(c, K.MONTH_SLUGS)

    def numbers(slug):
        one = lambda i: extract(slug, K.WEEK_SLUG_ONE_MONTH, i)
        two = lambda i: extract(slug, K.WEEK_SLUG_TWO_MONTHS, i)
        return F.struct(num(F.coalesce(one(1), two(1))).alias("d1"), month(F.coalesce(one(3), two(2))).alias("m1"),
                        num(F.coalesce(one(2), two(3))).alias("d2"), month(F.coalesce(one(3), two(4))).alias("m2"),
                        num(F.coalesce(one(4), two(5))).alias("y"))

    def days(n):
        first_year = F.when(n["m1"] > n["m2"], n["y"] - 1).otherwise(n["y"])
        return F.struct(ymd(first_year, n["m1"], n["d1"]).alias("start"), ymd(n["y"], n["m2"], n["d2"]).alias("end"))

    week = let(let(fold_accents(F.lower(F.regexp_extract(url, K.WEEK_SLUG, 1))), numbers), days)
    return let(week, lambda w: F.when(w["start"].isNotNull() & w["end"].isNotNull(), w))


def recent_weeks(run_date, n: int = 3) -> Column:
    """Anchors of the current week and the ``n - 1`` before it, newest first."""
    anchor = week_anchor(as_date(run_date))
    return F.transform(F.array(*[F.lit(i) for i in range(n)]), lambda i: F.date_sub(anchor, i * 7))


def nearest_day(run_date, day_number: Column, weekday: Column, reach: int = K.DATE_SEARCH_DAYS) -> Column:
    """Date closest to the run date, within ``reach`` days, with that day number and weekday; earlier on a tie."""
    run = as_date(run_date)
    weeks = F.array(*[F.lit(7 * k) for k in range(-(reach // 7) - 1, reach // 7 + 1)])

    def nearest(first):
        fit = F.filter(F.transform(weeks, lambda w: w + first), lambda n: (
            F.abs(n) <= reach) & (F.dayofmonth(F.date_add(run, n)) == day_number))
        ranked = F.transform(fit, lambda n: F.struct(F.abs(n).alias("far"), n.alias("days")))
        return F.date_add(run, F.array_min(ranked)["days"])

    # only days of the right weekday are tried
    return let(F.when(weekday.between(1, 7), F.pmod(weekday - iso_weekday(run), F.lit(7))), nearest)
