"""Tables in folders that are replaced one by one and become visible together.

``<root>/<table>/part=<p>/change=<n>`` holds rows, ``<root>/markers/change=<n>`` names, for every table, the version of
each part that counts. A change writes its folders under a new version and the marker last, as one small file; readers
follow the newest marker. A change that breaks off before its marker is invisible, and the next one, which has the same
number, replaces what it left. Folders that no change touches are neither read nor written.
"""
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..schema import MARKER

COMPRESSION = "zstd"    # ids are hashes as hex text: half as long once their letters are coded, which snappy does not do


def hashed_part(keys: list[str | Column], folders: int) -> Column:
    """Folder of a key, as text; NULL key parts count as a value of their own."""
    return F.pmod(F.xxhash64(*keys), F.lit(folders)).cast("string")


def read_if_there(spark: SparkSession, schema: T.StructType, *paths: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(*paths)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class Versions:
    """The tables below ``root`` as the newest marker shows them. Its driver-side state is one entry per folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.version, self.folders = 0, {}
        marks = read_if_there(spark, T.StructType([*MARKER.fields, T.StructField("change", T.LongType())]), f"{self.root}/markers")
        if marks is not None:
            self.version = marks.agg(F.max("change")).first()[0] or 0
            for r in marks.filter(F.col("change") == self.version).collect():
                self.folders.setdefault(r.table, {})[r.part] = r.at
        self.pending: dict[str, dict[str, int]] = {}

    def parts(self, table: str) -> list[str]:
        return sorted(self.folders.get(table, {}))

    def read(self, table: str, schema: T.StructType, parts: Iterable[str] | None = None, pending: bool = False) -> DataFrame:
        """Rows of a table, or of some of its parts; ``pending`` reads what this change has written so far."""
        held = (self.pending if pending else self.folders).get(table, {})
        chosen = held if parts is None else {p: held[p] for p in parts if p in held}
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{table}/part={p}/change={v}" for p, v in sorted(chosen.items())])

    def write(self, table: str, rows: DataFrame, replaces: Iterable[str] | None = None, laid_out: bool = False) -> None:
        """Write ``rows``, which have a text column ``part`` and none named ``change``, as new folders of those parts.

        ``replaces`` names the parts that these rows take the place of, also those left without rows; by default only
        the parts that occur. Other parts stay. Rebalancing gives a part few files and splits one that is too large;
        rows that are ``laid_out`` by part already are not moved again.
        """
        seen = Observation()
        target = rows.withColumn("change", F.lit(self.version + 1))
        target = (target if laid_out else target.hint("rebalance", "part")).observe(seen, F.collect_set("part").alias("parts"))
        (target.write.partitionBy("part", "change").mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", COMPRESSION)
               .parquet(f"{self.root}/{table}"))
        left = {p: v for p, v in self.pending.get(table, self.folders.get(table, {})).items() if p not in set(replaces or ())}
        self.pending[table] = {**left, **{p: self.version + 1 for p in seen.get["parts"]}}

    def note(self, name: str, value: str) -> None:
        """A value that the marker carries, as the only part of a table without rows."""
        self.pending[name] = {value: self.version + 1}

    def commit(self) -> None:
        """Make what was written visible."""
        folders = {**self.folders, **self.pending}
        rows = [(table, part, at) for table, parts in folders.items() for part, at in parts.items()]
        marker = self.spark.createDataFrame(rows, MARKER).coalesce(1)
        marker.write.mode("overwrite").parquet(f"{self.root}/markers/change={self.version + 1}")
        self.version, self.folders, self.pending = self.version + 1, folders, {}
