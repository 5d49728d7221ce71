"""Sources: pages, dropped files, nested programme files, catalogs and tables. Every schema is stated."""
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K, schema


def decode(content: Column) -> Column:
    """Bytes as UTF-8 text; bytes that are none become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page files, one row each: path, html."""
    return spark.read.format("binaryFile").load(path).select("path", decode(F.col("content")).alias("html"))


def is_admissible(length: Column, content: Column) -> Column:
    """Admission rule of the drop place: a PDF by its leading bytes, of limited size."""
    return (length <= K.MAX_FILE_BYTES) & (F.substring(content, 1, 4) == F.lit(b"%PDF"))


def read_drop(spark: SparkSession, path: str) -> DataFrame:
    """Admissible dropped files. The size test comes first and is pushed to the listing, so big files are not opened."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= K.MAX_FILE_BYTES)
    return files.filter(is_admissible(F.col("length"), F.col("content")))


def read_programme(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Programme files: one indented document per file, or one document per line."""
    return spark.read.schema(schema.PROGRAMME).option("multiLine", one_per_file).json(path)


def programme_films(programme: DataFrame) -> DataFrame:
    """Film rows of programme files, in file order."""
    return programme.select("sources", F.posexplode("films").alias("row_order", "film")) \
                    .select("row_order", "film.*")


def film_screenings(films: DataFrame, keys: list[str]) -> DataFrame:
    """Screening rows of film rows, in list order."""
    return films.select(*keys, F.posexplode("seances").alias("pos", "s")).select(*keys, "pos", "s.*")


def parse_answer(answer: Column, kind: str) -> Column:
    """A catalog answer (JSON text) as a typed struct."""
    return F.from_json(answer, {"tmdb": schema.TMDB, "omdb": schema.OMDB}[kind])


def read_catalog(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema({"tmdb": schema.TMDB, "omdb": schema.OMDB}[kind]).json(path)


def read_table(spark: SparkSession, path: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """Projected and filtered table scan; both reach the file format."""
    df = spark.read.parquet(path)
    return (df if where is None else df.filter(where)).select(*columns)


def url_state(spark: SparkSession, path: str) -> DataFrame:
    """Addresses already processed, as a set."""
    return spark.read.schema(schema.URL_STATE).parquet(path).distinct()
