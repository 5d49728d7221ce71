"""URL filter: rules by host and path, else naive Bayes on the words of host and path."""
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import spread_lookup
from ..operators.staging import staged

# fixed values: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
WORD_PART = 24            # most letters of a word that segmentation considers
UNSEEN = 10.0             # an unseen string of k letters counts as UNSEEN / (total * 10 ** k) times, as is usual
SMOOTHING = 0.5
SALTS = 16                # ways that one host's or path's pages are dealt


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for NULL and for urls without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(whole, "://") > 0, F.regexp_replace(whole, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and starts the path; else NULL."""
    fits = [(len(h + p), F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))))
            for h, p, v in rules]
    return F.coalesce(*[c for _, c in sorted(fits, key=lambda x: -x[0])])


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, n) of the lower-case words of a-z in all whole texts, markup left out."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"<[^>]*>", " "))
    found = texts.select(F.explode(F.regexp_extract_all(plain, F.lit(f"[a-z]{{2,{WORD_PART}}}"), F.lit(0))).alias("word"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_split(label: str, known: dict[tuple[int, int], float], unseen: float) -> list[str]:
    """Likeliest words of a label, from the left: each end keeps its best score and where the last word begins.

    ``known`` holds the scores of counted words by (end, letters); any other string of k letters scores ``unseen - k``.
    Of equal scores the longer last word wins.
    """
    scores, back = [0.0], [0]
    for end in range(1, len(label) + 1):
        score, size = max((scores[end - k] + known.get((end, k), unseen - k), k) for k in range(1, min(end, WORD_PART) + 1))
        scores.append(score)
        back.append(end - size)
    words, end = [], len(label)
    while end:
        words.append(label[back[end]:end])
        end = back[end]
    return words[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words): the most probable split of each distinct label (letters a-z only) under unigram word counts.

    The substrings of all labels are looked up at once by a join, so the counts are never sent to every task; a label
    travels there as a digest and comes back with the counted ones among its substrings, at most WORD_PART a letter.
    Viterbi then takes time and memory that grow with the label's length. A frequent word is spread over tasks.
    """
    total = float(counts.agg(F.sum("n")).first()[0] or 0) + 1
    keyed = labels.select(F.md5("label").alias("key"), "label")
    ends = keyed.select("key", F.explode(F.expr(
        f"transform(sequence(1, length(label)), e -> struct(e AS end, substring(label, greatest(1, e - {WORD_PART - 1}), least({WORD_PART}, e)) AS tail))")).alias("at"))
    spans = ends.filter("length(at.tail) > 1").select("key", "at.end", "at.tail", F.explode(F.expr("sequence(2, length(at.tail))")).alias("size")).select(
        "key", "end", "size", F.expr("right(tail, size)").alias("word"))       # counted words have two letters at least
    known = spread_lookup(spans, counts, ["word"], how="inner", spread_by=["key", "end"])
    found = known.groupBy("key").agg(F.collect_list("end").alias("ends"), F.collect_list("size").alias("sizes"), F.collect_list("n").alias("ns"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unseen = math.log10(UNSEEN / total)
        for batch in batches:
            words = [best_split(label, {(e, k): math.log10(n / total) for e, k, n in zip(ends or (), sizes or (), ns or ())}, unseen)
                     for label, ends, sizes, ns in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["label", "words"])

    return keyed.join(found, "key", "left").select("label", "ends", "sizes", "ns").mapInArrow(split, "label string, words array<string>")


def pieces(value: Column) -> Column:
    return F.filter(F.split(F.lower(value), r"[^a-z0-9]+"), lambda x: x != "")


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", rules: tuple = RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, host_words, log_odds (of block against allow).

    Pages that a rule decides are the training rows of the naive Bayes classes; it decides the others, block only if
    block is likelier, so a tie and a table without rules' rows give allow. Tokens are the words of the host's
    labels (split by their likeliest segmentation under the word counts of all pages' texts) and those of the path.
    NULL urls, ids and texts are allowed, repeated rows are judged each, an empty table gives no rows, other columns
    are ignored. Hosts and paths are split and scored once each, not once a page.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    judged = F.count_if(F.col("fit.verdict") == "block").alias("block"), F.count_if(F.col("fit.verdict") == "allow").alias("allow")
    hosts, paths = rows.groupBy("host").agg(*judged), rows.groupBy("path").agg(*judged)   # hot hosts meet here as counts

    names = hosts.select("host", F.explode(pieces(F.col("host"))).alias("piece")).select(
        "host", "piece", F.regexp_replace("piece", "[0-9]+", "").alias("label"))
    split = segment(names.select("label").filter("label != ''").distinct(), staged(word_counts(pages, text_col), "counts"))
    host_words = (names.join(split, "label", "left").groupBy("host")
                  .agg(F.array_sort(F.flatten(F.collect_list(F.coalesce("words", F.array("piece"))))).alias("words")))  # bounded by the host's length
    hosts = hosts.join(host_words, "host", "left").withColumn("words", F.coalesce("words", F.expr("cast(array() AS array<string>)")))
    paths = paths.withColumn("words", pieces(F.col("path")))
    side = lambda df, key, sign: df.select(F.lit(sign).alias("side"), F.col(key).alias("name"), "block", "allow", F.explode("words").alias("token"))
    used = side(hosts, "host", "host").unionByName(side(paths, "path", "path"))
    seen = staged(used.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "tokens")
    n = seen.agg(F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0)), F.count(F.lit(1))).first()
    share = lambda c, total: F.log((F.col(c) + SMOOTHING) / (total + SMOOTHING * (n[2] + 1)))
    odds = seen.select("token", (share("block", n[0]) - share("allow", n[1])).alias("odds"))
    scored = used.select("side", "name", "token").join(odds, "token").groupBy("side", "name").agg(F.sum("odds").alias("odds"))
    prior = rows.agg(F.log((F.count_if(F.col("fit.verdict") == "block") + 1) / (F.count_if(F.col("fit.verdict") == "allow") + 1))).first()[0]

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)))
    spread = lambda df: df.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    host_side = spread(hosts.select("host", "words").join(scored.filter("side = 'host'").select(F.col("name").alias("host"), F.col("odds").alias("host_odds")), "host", "left"))
    path_side = spread(scored.filter("side = 'path'").select(F.col("name").alias("path"), F.col("odds").alias("path_odds")))
    whole = salted.join(host_side, ["host", "salt"], "left").join(path_side, ["path", "salt"], "left")
    log_odds = F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0))
    return whole.select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                        F.coalesce("fit.verdict", F.when(log_odds > 0, "block").otherwise("allow")).alias("verdict"),
                        F.col("words").alias("host_words"), log_odds.alias("log_odds"))
