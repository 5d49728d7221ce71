"""New arrivals, each processed once: file-source streams with a checkpoint and idempotent batch output.

Every increment writes its own ``batch=<n>`` folder in overwrite mode, so a replayed batch replaces itself. ``fold`` merges
the batches of a keyed log into a base of key-hash folders, of which it rewrites those the batches touch; the current
table is the base and the batches after it. A log of new keys is laid out by key hash as well, and an increment reads
the folders of its own keys only.
"""
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import constants as K
from ..operators.dedup import first_per_key, last_per_key
from ..operators.staging import staged
from ..sources.versions import Versions, hashed_part, read_if_there

FOLDERS = 64
SHELF_FILES = 20_000    # files of one stream, about: its driver holds what is told of each, and goes through all of them in each run
# what a listing sends to the driver: one task for each path would tell more about itself than about its files, and small files need no places;
# what the driver keeps of it: a stream lists anew each time and never asks the session's cache of listings
LISTING = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "256", "spark.sql.sources.ignoreDataLocality": "true",
           "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}
SHELF_LISTING = {**LISTING, "spark.sql.sources.parallelPartitionDiscovery.parallelism": "32"}   # in each listing of each shelf


def arrivals(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
             files_per_batch: int | None = None) -> DataFrame:
    """Stream of the files under ``path`` (a folder or a glob)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def table_glob(path: str) -> str:
    """A table path the file source accepts whether the table is one file or a folder of files."""
    return f"{path[:-1]}[{path[-1]}]"


def run_available(stream: DataFrame, on_batch, checkpoint: str, listing: dict[str, str] = LISTING) -> None:
    """Process what has arrived since the last run and stop. A stream can be run again and again."""
    conf = stream.sparkSession.conf
    before = {name: conf.get(name) for name in listing}
    for name, value in listing.items():
        conf.set(name, value)
    try:
        query = (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
                       .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for name, value in before.items():
            conf.set(name, value)


def with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.LongType())])


def stored(spark: SparkSession, log: str, schema: T.StructType) -> DataFrame:
    """All batches of a log with their number; empty before the first increment."""
    full = with_batch(schema)
    found = read_if_there(spark, full, log)
    return spark.createDataFrame([], full) if found is None else found.select(*full.names)


def write_batch(batch: DataFrame, batch_id: int, log: str) -> None:
    batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")


def append_log(log: str):
    """Batch handler: add the batch as it is."""
    return lambda batch, batch_id: write_batch(batch, batch_id, log)


# --- keyed logs -------------------------------------------------------------------------------------------------

def base_of(spark: SparkSession, log: str) -> tuple[Versions, int]:
    """(folded base of a log, last batch in it); -1 before the first fold."""
    base = Versions(spark, f"{log}-base")
    return base, max(map(int, base.parts("up_to")), default=-1)


def fold(spark: SparkSession, log: str, schema: T.StructType, keys: list[str], order: list[str], keep: str = "last",
         folders: int = FOLDERS) -> None:
    """Merge the batches after the base into it. Only folders of keys that these batches hold are read and replaced.

    Batches stay where they are but are not opened again. A fold that breaks off leaves no trace that readers see.
    """
    pick = last_per_key if keep == "last" else first_per_key
    base, up_to = base_of(spark, log)
    tail = stored(spark, log, schema).filter(F.col("batch") > up_to)
    last = tail.agg(F.max("batch")).first()[0]
    if last is None:
        return
    place = [F.col("batch"), *order]
    new = staged(pick(tail, keys, place).withColumn("part", hashed_part(keys, folders)), "fold")
    touched = [r.part for r in new.select("part").distinct().collect()]             # ``folders`` at most
    old = base.read("rows", with_batch(schema), touched).withColumn("part", hashed_part(keys, folders))
    base.write("rows", pick(old.unionByName(new), keys, place), touched)
    base.note("up_to", str(last))
    base.commit()


def upsert_log(log: str, keys: list[str], order: list[str], keep: str = "last", schema: T.StructType | None = None,
               fold_every: int | None = None, folders: int = FOLDERS):
    """Batch handler: reduce the batch to one row per key and add it to the log; every so many batches fold the log.

    A replayed batch that is in the base already is left alone.
    """
    pick = last_per_key if keep == "last" else first_per_key

    def handle(batch, batch_id):
        spark = batch.sparkSession
        if fold_every and batch_id <= base_of(spark, log)[1]:
            return
        write_batch(pick(batch, keys, order), batch_id, log)
        if fold_every and (batch_id + 1) % fold_every == 0:
            fold(spark, log, schema, keys, order, keep, folders)
    return handle


def current(spark: SparkSession, log: str, schema: T.StructType, keys: list[str], order: list[str],
            keep: str = "last") -> DataFrame:
    """Current table of a log: last (or first) row per key by (batch, order), from the base and the batches after it."""
    pick = last_per_key if keep == "last" else first_per_key
    base, up_to = base_of(spark, log)
    tail = stored(spark, log, schema).filter(F.col("batch") > up_to)                # a partition filter: folded batches are not opened
    return pick(base.read("rows", with_batch(schema)).unionByName(tail), keys, ["batch", *order]).drop("batch")


def new_only_log(log: str, keys: list[str], order: list[str], schema: T.StructType, folders: int = FOLDERS):
    """Batch handler: keep only keys no earlier batch has seen, one row each.

    The log is laid out by key hash; a batch reads the keys in the folders of its own keys, whatever else is stored. More
    ``folders`` than keys in a batch keep that to a part of the log.
    """
    full = T.StructType([*with_batch(schema).fields, T.StructField("part", T.StringType())])

    def handle(batch, batch_id):
        spark = batch.sparkSession
        one = staged(first_per_key(batch, keys, order).withColumn("part", hashed_part(keys, folders)), "arrivals")
        touched = [r.part for r in one.select("part").distinct().collect()]         # ``folders`` at most
        if not touched:
            return
        known = read_if_there(spark, full, log)
        new = one
        if known is not None:
            seen = known.filter(F.col("part").isin(touched) & (F.col("batch") < batch_id)).select(*keys)
            new = one.alias("n").join(seen.alias("s"), [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], "left_anti")
        (new.withColumn("batch", F.lit(batch_id)).write.partitionBy("part", "batch").mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").parquet(log))
    return handle


# --- dropped files ----------------------------------------------------------------------------------------------

DROPPED = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                        T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
DROP_LOG = T.StructType([*DROPPED.fields[:3], T.StructField("reason", T.StringType())])


def dropped_files(spark: SparkSession, path: str, most_bytes: int = K.MAX_FILE_BYTES, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the files dropped under ``path`` with the ``reason`` of those that are not admitted."""
    return judged(arrivals(spark, path, DROPPED, "binaryFile", files_per_batch), most_bytes)


def shelves(files: int) -> int:
    """Number of shelves for so many files."""
    return max(1, -(-files // SHELF_FILES))


def dropped_shelves(spark: SparkSession, path: str, shelves: int, most_bytes: int = K.MAX_FILE_BYTES) -> list[DataFrame]:
    """A stream for each ``shelf=<n>`` of a drop place whose files, or folders of files, lie on shelves: the files of
    ``dropped_files``, but the driver holds the listing of one shelf at a time."""
    return [dropped_files(spark, f"{path}/shelf={k}/*", most_bytes) for k in range(shelves)]


def run_shelves(streams: list[DataFrame], log: str, checkpoint: str) -> None:
    """Log what has arrived on any shelf since the last run, shelf by shelf; ``stored`` reads the log as a whole."""
    for k, stream in enumerate(streams):
        run_available(stream, drop_log(f"{log}/shelf={k}"), f"{checkpoint}/shelf={k}", SHELF_LISTING)


def judged(files: DataFrame, most_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    """Files with ``reason``, NULL if they are admitted. Sizes come from the listing: the size filter is pushed to the
    source, so files that are too large are never opened; of the others the first bytes decide. Only admitted files keep
    their content. The file source passes over files without a byte, which have no row."""
    sized = F.col("length") <= most_bytes
    bad = files.filter(~sized).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"), F.lit("too large").alias("reason"))
    is_pdf = F.substring("content", 1, 4) == F.lit(b"%PDF")
    opened = files.filter(sized).select("path", "modificationTime", "length", F.when(is_pdf, F.col("content")).alias("content"),
                                        F.when(~is_pdf, "not a PDF").alias("reason"))
    return opened.unionByName(bad)


def drop_log(log: str, on_files=None):
    """Batch handler: one row per dropped file, with the reason if it is rejected; ``on_files(admitted, batch_id)`` gets
    the admitted ones with their content before they are logged. The log holds no content."""
    def handle(batch, batch_id):
        if on_files:
            on_files(batch.filter("reason IS NULL").drop("reason"), batch_id)
        write_batch(batch.select(*DROP_LOG.names), batch_id, log)
    return handle
