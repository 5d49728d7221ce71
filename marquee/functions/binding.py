"""Name a value once inside a Column expression."""
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it.

    Chained ``withColumn`` does not give that: the optimizer merges projections, and a column used inside a lambda is then
    computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs_of(items: Column, size: int = 256) -> Column:
    """The array cut into runs. Folds that append keep to one run at a time, so a long array costs what it is long."""
    return let(items, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(size)),
                                            lambda start: F.slice(x, start, F.lit(size))))


def running_sums(numbers: Column) -> Column:
    """Sum of the numbers up to each place."""
    total = lambda sums: F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0).cast("bigint"))
    within = lambda part: F.aggregate(part, F.array().cast("array<bigint>"), lambda sums, n: F.array_append(sums, total(sums) + n))
    joined = lambda parts: let(within(F.transform(parts, total)), lambda ends: F.flatten(F.transform(
        parts, lambda part, i: F.transform(part, lambda n: n + F.coalesce(F.get(ends, i - 1), F.lit(0).cast("bigint"))))))
    return let(F.transform(runs_of(numbers), within), joined)
