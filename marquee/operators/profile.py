"""Profiles of a page corpus and data-quality checks."""
from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.binding import let, runs_of
from ..functions.text import collapse, strip


def keyword_hits(token: Column, words: list[str]) -> Column:
    """How many of the words a token contains, any case."""
    return sum([F.lower(token).contains(w).cast("int") for w in words], F.lit(0))


def token_histogram(pages: DataFrame, text: str, pattern: str, words: list[str], name: str,
                    split: bool = True) -> DataFrame:
    """(name, n): attribute tokens, each counted once per word it contains. Counts are combined before the shuffle."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    tokens = F.flatten(F.transform(values, lambda v: F.filter(F.split(v, r"(?U)\s+"), lambda t: t != ""))) if split else values
    hits = pages.select(F.explode(tokens).alias(name)).withColumn("hits", keyword_hits(F.col(name), words))
    return hits.filter("hits > 0").groupBy(name).agg(F.sum("hits").alias("n"))


def class_histogram(pages: DataFrame, text: str = "html", words: list[str] = K.PROFILE_WORDS) -> DataFrame:
    return token_histogram(pages, text, K.CLASS_ATTR, words, "class")


def id_histogram(pages: DataFrame, text: str = "html", words: list[str] = K.PROFILE_WORDS,
                 pattern: str = K.ID_ATTR) -> DataFrame:
    return token_histogram(pages, text, pattern, words, "id", split=False)


def pattern_profile(pages: DataFrame, text: str, patterns: list[str], keep: list[str]) -> DataFrame:
    """(keep, pattern_no, n, snippet): matches of every pattern and the text from the first one on."""
    found = F.array(*[F.struct(
        F.lit(i).alias("pattern_no"), F.regexp_count(text, F.lit(p)).alias("n"),
        F.substring(F.col(text), F.length(F.split(F.col(text), p, 2)[0]) + 1, K.SNIPPET_CHARS).alias("snippet"))
        for i, p in enumerate(patterns)])
    return pages.select(*keep, F.explode(found).alias("p")).select(*keep, "p.*").filter("n > 0")


def match_contexts(text: Column, pattern: str = K.CLOCK_ANY_CASE, limit: int = K.CONTEXTS_PER_PAGE) -> Column:
    """First matches of a text with what surrounds them, tags removed: array of (no, context)."""
    def located(t):
        # one search of the text: every hit stands between the two marks, so the pieces give sizes and places
        free = F.when(t.contains("\u0001") | t.contains("\u0002"), F.translate(t, "\u0001\u0002", "  ")).otherwise(t)
        pieces = F.split(F.regexp_replace(free, pattern, "\u0001$0\u0002"), "\u0001", limit + 2)
        sizes = F.transform(F.slice(pieces, 1, limit + 1), lambda p, i: F.struct(
            F.when(i > 0, F.length(F.substring_index(p, "\u0002", 1))).otherwise(0).alias("hit"),
            (F.length(p) - F.when(i > 0, 1).otherwise(0)).alias("whole")))
        return let(sizes, lambda s: F.transform(F.slice(s, F.lit(2), F.lit(limit)), lambda h, i: F.struct(
            (i + 1).alias("no"), h["hit"].alias("size"),
            F.aggregate(F.slice(s, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x["whole"]).alias("at"))))

    def context(t, m):
        begin = F.greatest(m["at"] - K.CONTEXT_CHARS, F.lit(0))
        around = F.substr(t, begin + 1, m["at"] + m["size"] + K.CONTEXT_CHARS - begin)
        clean = collapse(strip(F.regexp_replace(around, "<[^>]+>", " ")))
        return F.struct(m["no"].alias("no"), F.substring(clean, 1, K.CONTEXT_CUT).alias("context"))

    return let(text, lambda t: F.transform(located(t), lambda m: context(t, m)))


def tag_kinds(text: Column) -> Column:
    """Array of (depth, tag) of the opening tags of a page, in page order; depths of 4 and more count as 4.

    Depth counts open tags, held between 0 and 8. The fold keeps one digit per tag, a run of tags at a time.
    """
    raw = F.regexp_extract_all(text, F.lit(K.ANY_TAG), F.lit(0))
    named = F.transform(raw, lambda t: F.struct(t.startswith("</").alias("closing"),
                                                F.lower(F.regexp_extract(t, K.ANY_TAG, 2)).alias("tag")))
    kept = F.filter(named, lambda t: ~t["tag"].isin(K.STRUCTURE_SKIPPED_TAGS))

    def step(a, t):
        after = F.when(t["closing"], F.greatest(a["depth"] - 1, F.lit(0))).otherwise(F.least(a["depth"] + 1, F.lit(8)))
        return F.struct(after.alias("depth"), F.concat(a["trace"], a["depth"].cast("string")).alias("trace"))

    def walk(a, run):
        walked = F.aggregate(run, F.struct(a["depth"].alias("depth"), F.lit("").alias("trace")), step)
        return let(walked, lambda w: F.struct(w["depth"].alias("depth"), F.array_append(a["traces"], w["trace"]).alias("traces")))

    def kinds(runs):
        traces = F.aggregate(runs, F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("traces")), walk)["traces"]
        return let(traces, lambda d: F.filter(F.flatten(F.transform(runs, lambda run, r: F.transform(run, lambda t, i: F.struct(
            F.least(F.substr(F.get(d, r), i + 1, F.lit(1)).cast("int"), F.lit(4)).alias("depth"), t["tag"].alias("tag"),
            t["closing"].alias("closing"))))), lambda t: ~t["closing"]))

    return F.transform(let(runs_of(kept), kinds), lambda t: F.struct(t["depth"].alias("depth"), t["tag"].alias("tag")))


def tag_profile(pages: DataFrame, text: str = "html", key: str = "page_id", limit: int = K.PROFILE_KEYS) -> DataFrame:
    """(key, rank, depth, tag, n): opening tags per depth, first kinds of a page by appearance.

    Counted inside the row: a page has a handful of (depth, tag) kinds.
    """
    def counted(tags):
        return F.transform(F.slice(F.array_distinct(tags), 1, limit), lambda k, i: F.struct(
            (i + 1).alias("rank"), k["depth"].alias("depth"), k["tag"].alias("tag"),
            F.size(F.filter(tags, lambda t: t == k)).alias("n")))

    return pages.select(key, F.explode_outer(let(tag_kinds(F.col(text)), counted)).alias("c")).filter("c IS NOT NULL").select(key, "c.*")


def dq_failures(n_cinemas: Column, n_films: Column, n_joined: Column, n_groups: Column) -> Column:
    """Messages of the thresholds that are not met; empty when all are."""
    def below(n, least, what):
        return F.when(n < least, F.concat(F.lit(f"Expected ≥{least} {what}, got "), n.cast("string")))
    return F.array_compact(F.array(
        below(n_cinemas, K.MIN_CINEMAS, "cinemas"), below(n_films, K.MIN_FILMS, "films"),
        F.when(n_joined < 1, "No seances found"), below(n_groups, K.MIN_GROUPS, "film+cinema groups")))
