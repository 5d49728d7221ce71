"""One notion of "missing": NULL, empty string, zero and empty list all count as missing."""
from pyspark.sql import Column, functions as F, types as T


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return "array"
    if isinstance(dtype, T.NumericType):
        return "number"
    return "other"


def is_missing(c: Column, kind: str = "string") -> Column:
    """TRUE when ``c`` holds nothing usable; never NULL."""
    if kind == "string":
        return c.isNull() | (c == "")
    if kind == "number":
        return c.isNull() | (c == 0)
    if kind == "array":
        return c.isNull() | (F.size(c) <= 0)
    return c.isNull()


def present(c: Column, kind: str = "string") -> Column:
    """``c`` or NULL when missing."""
    return F.when(~is_missing(c, kind), c)


def first_present(kind: str, *cols: Column) -> Column:
    """First value that is not missing."""
    return F.coalesce(*[present(c, kind) for c in cols])


def or_default(c: Column, default: Column, kind: str = "string") -> Column:
    return F.when(is_missing(c, kind), default).otherwise(c)
