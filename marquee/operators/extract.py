"""Fields of pages of many kinds by one table of rules, in one pass over the pages."""
import sys
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import dates as D, text as X
from ..functions.missing import present
from ..functions.shapes import Shape, plans, records
from ..schema import RULE

cloudpickle.register_pickle_by_value(sys.modules[__name__])
MOST_RULES = 10_000      # a rule table is settings, not data

# what becomes of a found text or attribute; every result is text
POST = {
    "": lambda v: v,
    "strip": X.strip,
    "year": lambda v: D.year_in(v).cast("string"),
    "minutes": lambda v: D.duration_minutes(v).cast("string"),
    "after de": lambda v: present(X.without_lead(v, "de")),
    "after Avec": lambda v: present(X.without_lead(v, "Avec")),
    "shortened": lambda v: X.ellipsize(present(v)),
    "web address": lambda v: F.when(v.startswith("http"), v),
    "date": lambda v: D.iso_date(F.substring(v, 1, 10)).cast("string"),
}


class Rule(NamedTuple):
    """``field`` of pages of a ``kind``: text or attribute of the first element with ``tag`` and part ``cls`` of its class,
    below the first element ``within``. Smaller priorities are tried first."""
    kind: str
    field: str
    priority: int
    tag: str | None
    cls: str | None = None
    attr: str | None = None
    post: str = ""
    within_tag: str | None = None
    within_cls: str | None = None


def _shapes(rules: list[Rule]) -> list:
    out = {}
    for i, r in enumerate(rules):
        own = Shape(r.tag, r.cls, first=True, text=r.attr is None, attrs=(r.attr,) if r.attr else ())
        inside = r.within_tag or r.within_cls
        out[str(i)] = Shape(r.within_tag, r.within_cls, first=True, parts={"it": own}) if inside else own
    return plans(out)


def _hits(markup: str, rules: list[Rule], shapes: list) -> list[dict]:
    """First hit of every field by (priority, node_id)."""
    best = {}
    found = records(markup, shapes)
    for i, rule in enumerate(rules):
        hit = found[str(i)]
        if hit and (rule.within_tag or rule.within_cls):
            hit = hit[0]["it"]
        if hit:
            key = (rule.priority, hit[0]["node_id"])
            if rule.field not in best or key < best[rule.field][0]:
                value = hit[0]["text"] if rule.attr is None else hit[0][rule.attr.replace("-", "_")]
                best[rule.field] = (key, {"field": rule.field, "post": rule.post, "node_id": hit[0]["node_id"], "value": value})
    return [hit for _, hit in best.values()]


def extract_fields(pages: DataFrame, rules: DataFrame, kind: str = "kind", html: str = "html") -> DataFrame:
    """Pages with (field, value) in place of their markup: a row per field that has a value.

    ``rules`` has the columns of ``schema.RULE`` and at most ``MOST_RULES`` rows. Per page and field the first hit by
    (priority, place in the page) wins, whatever its post-function makes of it; elements without the attribute asked for
    are hits without a value. Pages of a kind without rules, and NULL pages, give nothing.
    """
    listed = [Rule(**r.asDict()) for r in rules.select(*RULE.names).limit(MOST_RULES + 1).collect()]
    if len(listed) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    unknown = {r.post for r in listed} - set(POST)
    if unknown:
        raise ValueError(f"no such post-function: {sorted(unknown)}")
    by_kind = {}
    for r in listed:
        by_kind.setdefault(r.kind, []).append(r)
    shaped = {k: (rs, _shapes(rs)) for k, rs in by_kind.items()}
    kept = [c for c in pages.columns if c != html]
    hit_type = pa.list_(pa.struct([("field", pa.string()), ("post", pa.string()), ("node_id", pa.int32()), ("value", pa.string())]))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                hits = [_hits(m, *shaped[k]) if m is not None and k in shaped else []
                        for m, k in zip(part.column(html).to_pylist(), part.column(kind).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(hits, hit_type)], names=[*kept, "hits"])

    hits = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n == "node_id" else T.StringType()) for n in ("field", "post", "node_id", "value")]))
    out = T.StructType([pages.schema[c] for c in kept]).add("hits", hits)
    found = pages.select(*kept, html).mapInArrow(run, out).select(*kept, F.explode("hits").alias("h"))
    value: Column = F.lit(None).cast("string")
    for name in {r.post for r in listed}:
        value = F.when(F.col("h.post") == name, POST[name](F.col("h.value"))).otherwise(value)
    return found.select(*kept, "h.field", value.alias("value")).filter("value IS NOT NULL")
