"""Exact duplicates: sorted digest runs merged along a tree."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.staging import staged

FAN_IN = 8
WHITE_SPACE = " \t\n\x0b\x0c\r"


def text_key(text: str = "text") -> Column:
    """Hash that, beside the id, tells the rows of a repeated id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def merge_runs(runs: DataFrame, slots: int, fan_in: int = FAN_IN) -> DataFrame:
    """One run for all slots: (key, digest) with the best row and the number of rows.

    Each round clears the next bits of the slot number: ``fan_in`` neighbours send their runs to the one with zeros
    there, as in a binomial tree. Every round is cut into key ranges, which travel and merge independently, so no
    task ever holds a whole run. Arriving runs are merged in key order; equal keys are verified by their digest and
    length, and only the best row of each is kept, at every level.
    """
    spark = runs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = 1
    while span < slots:
        span *= fan_in
        runs = (runs.withColumn("slot", F.col("slot") - F.col("slot") % span)
                .repartition(tasks, "range", "slot").sortWithinPartitions("range", "slot", "key", "digest", "length")
                .groupBy("range", "slot", "key", "digest", "length")
                .agg(F.min("best").alias("best"), F.sum("n").alias("n")))
    return runs


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, text_key.

    Texts are equal if they are identical without ASCII white space. Of equal texts the row with the most code points
    stays, then the smallest id (NULL last), then the first read. NULL counts as the empty text; rows that repeat an
    id and a text are separate members of their group and one of them stays. An empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, WHITE_SPACE, "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("chars"), text_key(text_col).alias("text_key"), bare.alias("bare"))
    signed = staged(rows.select(
        "doc_id", "text_key", "chars", F.spark_partition_id().alias("slot"), F.monotonically_increasing_id().alias("row"),
        F.xxhash64("bare").alias("key"), F.unhex(F.sha2("bare", 256)).alias("digest"), F.octet_length("bare").alias("length")), "digests")
    slots = (signed.agg(F.max("slot")).first()[0] or 0) + 1
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    leaf = (signed.groupBy("slot", "key", "digest", "length").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
            .withColumn("range", F.pmod("key", F.lit(ranges))))
    top = merge_runs(leaf, slots, fan_in).select("key", "digest", "length", F.col("best").alias("keep"), F.col("n").alias("group_size"))
    # back along the same way: first to the run of each slot, where a group has one row a slot, then to the slot's rows
    told = leaf.select("slot", "key", "digest", "length").join(top, ["key", "digest", "length"])
    return signed.join(told, ["slot", "key", "digest", "length"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "text_key")


def rows_of(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text", once: bool = False) -> DataFrame:
    """Rows of ``docs``, all columns, whose (doc_id, text_key) is in ``chosen``; with ``once`` one of each key."""
    marked = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(id_col).cast("string"), F.lit("-")).alias("_id"), text_key(text_col).alias("_key"))
    wanted = chosen.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("_id"), F.col("text_key").alias("_key")).distinct()
    found = marked.join(wanted, ["_id", "_key"], "left_semi")
    if once:
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_key").orderBy(F.lit(1)))).filter("_n = 1")
    return found.select("_row.*")
