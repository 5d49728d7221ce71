"""Benchmark decontamination by a positional inverted index. DataFrame functions only."""
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.staging import staged
from .dedup_exact import text_key

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"   # what parts words, after A-Z are lowered
MIXED_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"   # the same for texts that are not lowered
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE = 3                                         # postings lists of a phrase that are intersected before its words are compared


def words_of(text: Column) -> Column:
    """Words of a text; none for NULL."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), MIXED_SEPARATORS), lambda w: w != "")).cast("long")


def phrases_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, phrase): each distinct window of an item; an item of fewer words is one phrase."""
    words = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.lit(window)))).alias("phrase")).distinct()


def postings_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Positional postings (term_no, doc_key, position from 0) of the given terms (term, term_no) in all whole texts."""
    found = docs.select("doc_key", F.posexplode("words").alias("position", "term"))
    return found.join(terms, "term").select("term_no", "doc_key", "position")


def phrase_terms(phrases: DataFrame, terms: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(phrase_no, rank, term_no, shift): the terms of each phrase that occurs at all in order of their frequency, rarest first."""
    each = phrases.select("phrase_no", F.size("phrase").alias("length"), F.posexplode("phrase").alias("shift", "term")).join(terms, "term")
    counted = each.join(frequencies, "term_no").groupBy("phrase_no", "length").agg(F.sort_array(F.collect_list(F.struct("n", "shift", "term_no"))).alias("by"))
    return counted.filter(F.size("by") == F.col("length")).select("phrase_no", F.posexplode("by").alias("rank", "t")).select("phrase_no", "rank", "t.term_no", "t.shift")


def candidates(postings: DataFrame, ordered: DataFrame, rare: int = RARE) -> DataFrame:
    """(phrase_no, doc_key, start): the offset-adjusted postings of the ``rare`` rarest terms, intersected from the rarest."""
    place = ["phrase_no", "doc_key", "start"]

    def listed(rank: int) -> DataFrame:
        wanted = ordered.filter(F.col("rank") == rank).select("phrase_no", "term_no", "shift")
        return postings.join(wanted, "term_no").select("phrase_no", "doc_key", (F.col("position") - F.col("shift")).alias("start"))

    found = listed(0).filter("start >= 0").distinct()
    for rank in range(1, rare):
        short = ordered.groupBy("phrase_no").agg(F.max("rank").alias("last")).filter(F.col("last") < rank).select("phrase_no")  # phrases of fewer terms
        found = found.join(listed(rank), place, "left_semi").unionByName(found.join(short, "phrase_no", "left_semi"))
    return found


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input document: doc_id, n_words, hits (starts and ends of hit runs of words), n_hit, items, contaminated, text_key.

    A phrase is ``window`` consecutive words of an item, or a whole shorter item; a document's word inside any
    occurrence of a phrase is hit, and ``items`` lists the items with occurring phrases as sorted strings. NULL and
    empty texts have no words; NULL item ids hit without being listed; repeated rows and NULL ids get each their own
    row; empty tables of documents or items give no rows or no hits; other columns are ignored.

    The index holds the postings of every item term in all documents. Each phrase starts from its rarest term, whose
    list is shifted by its place in the phrase and intersected with those of the next two; the words of the few places
    left are then compared in full, on the documents' side. Documents travel as a key of eight bytes, so texts are read
    again only where a place is left; two documents of one key are both compared.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(text_col).alias("text_key"))
    plain = plain.withColumn("id", key).withColumn("doc_key", F.xxhash64("id", "text_key"))
    listed = staged(phrases_of(items, item_col, item_text_col, window), "items")
    # written, so that their size, not a guess, decides whether they are sent to every task
    phrases = staged(listed.select("phrase").distinct().withColumn("phrase_no", F.monotonically_increasing_id()), "phrases")
    terms = staged(phrases.select(F.explode("phrase").alias("term")).distinct().withColumn("term_no", F.monotonically_increasing_id()), "terms")
    postings = staged(postings_of(plain.select("doc_key", words_of(F.col("text")).alias("words")), terms), "postings")
    ordered = staged(phrase_terms(phrases, terms, postings.groupBy("term_no").agg(F.count(F.lit(1)).alias("n"))), "ordered")
    rare_terms = staged(ordered.filter(F.col("rank") < RARE).select("term_no").distinct(), "rare")
    places = staged(candidates(postings.join(rare_terms, "term_no"), ordered), "places")
    by_doc = staged(places.join(phrases, "phrase_no").groupBy("doc_key").agg(F.collect_list(F.struct("start", "phrase", "phrase_no")).alias("found")), "found")
    read = plain.join(by_doc, "doc_key").dropDuplicates(["id", "text_key"])             # only documents with a place left
    checked = read.withColumn("words", words_of(F.col("text"))).select(
        "id", "text_key", F.expr("filter(found, f -> slice(words, f.start + 1, size(f.phrase)) = f.phrase)").alias("found")).filter(F.size("found") > 0)
    spans = checked.withColumn("spans", F.expr("array_sort(transform(found, f -> struct(f.start AS a, f.start + size(f.phrase) AS b)))"))
    runs = spans.withColumn("hits", F.expr("""
        aggregate(spans, cast(array() AS array<struct<a:int,b:int>>), (runs, s) -> IF(size(runs) > 0 AND element_at(runs, -1).b >= s.a,
            concat(slice(runs, 1, size(runs) - 1), array(struct(element_at(runs, -1).a AS a, greatest(element_at(runs, -1).b, s.b) AS b))),
            concat(runs, array(s))))"""))
    done = staged(runs.select("id", "text_key", "hits", F.expr("aggregate(hits, 0L, (n, h) -> n + h.b - h.a)").alias("n_hit"),
                              F.expr("array_distinct(found.phrase_no)").alias("phrase_nos")), "hits")
    # items by document only after each phrase counts once in it
    told = done.select("id", "text_key", F.explode("phrase_nos").alias("phrase_no"))
    names = listed.filter(F.col("item_id").isNotNull()).join(phrases, "phrase").select("phrase_no", F.col("item_id").cast("string").alias("item"))
    items_of = told.join(names, "phrase_no").groupBy("id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = staged(done.join(items_of, ["id", "text_key"], "left").drop("phrase_nos"), "hit")
    counted = plain.select("doc_id", "id", "text_key", count_words(F.col("text")).alias("n_words"))
    return counted.join(hit, ["id", "text_key"], "left").select(
        "doc_id", "n_words", F.coalesce("hits", F.expr("cast(array() AS array<struct<a:int,b:int>>)")).alias("hits"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() AS array<string>)")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"), "text_key")


def near_matches(postings: DataFrame, ordered: DataFrame, slack: int) -> DataFrame:
    """(phrase_no, doc_key, start): places where every term of a phrase stands at most ``slack`` words from its place.

    ``ordered`` is what ``phrase_terms`` gives. The rarest term's postings give the starts, with ``slack`` to either side;
    every other term then looks only at the documents where its phrase has a start, rarest first, so common terms meet
    few places.
    """
    around = F.explode(F.sequence(F.col("position") - F.col("shift") - slack, F.col("position") - F.col("shift") + slack)).alias("start")
    listed = lambda rank: postings.join(ordered.filter(F.col("rank") == rank), "term_no")
    found = staged(listed(0).select("phrase_no", "doc_key", around).distinct(), "near")
    longest = ordered.agg(F.max("rank")).first()[0] or 0
    for rank in range(1, longest + 1):
        short = ordered.groupBy("phrase_no").agg(F.max("rank").alias("last")).filter(F.col("last") < rank).select("phrase_no")
        here = listed(rank).join(found.select("phrase_no", "doc_key").distinct(), ["phrase_no", "doc_key"], "left_semi").select("phrase_no", "doc_key", around)
        found = staged(found.join(here, ["phrase_no", "doc_key", "start"], "left_semi").unionByName(found.join(short, "phrase_no", "left_semi")), "near")
    return found
