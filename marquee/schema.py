"""Explicit schemas of every source, table and nested record; nothing is inferred."""
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(),
          "date": T.DateType(), "timestamp": T.TimestampType(), "rating": T.DecimalType(3, 1),
          "strings": T.ArrayType(T.StringType()), "texts": T.MapType(T.StringType(), T.StringType())}


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t] if isinstance(t, str) else t) for n, t in fields.items()])


SEANCE = _struct(date="date", heure="string", version="string", resa_url="string")
FILM = _struct(titre="string", titreOriginal="string", annee="int", realisateur="string", duree="int", genres="strings",
               synopsis="string", imdbId="string", poster="string", imdbRating="double", cast="string", slug="string",
               source="string", cinema="string", seances=T.ArrayType(SEANCE))
PROGRAMME = _struct(generated_at="string", sources="strings", films=T.ArrayType(FILM))

CINEMAS = _struct(id="string", name="string", slug="string", created_at="timestamp")
FILMS = _struct(id="string", titre="string", titre_original="string", annee="int", realisateur="string", duree="int",
                genres="strings", synopsis="string", imdb_id="string", poster="string", imdb_rating="rating",
                cast="string", source="string", created_at="timestamp")
SEANCES = _struct(id="string", film_id="string", cinema_id="string", date="date", heure="string", version="string",
                  resa_url="string", created_at="timestamp")

GRID_ROW = _struct(doc_id="string", row_no="int", cells="strings")
NODE = _struct(node_id="int", parent_id="int", depth="int", subtree_end="int", tag="string", attrs="texts",
               own_text="string")
RULE = _struct(kind="string", field="string", priority="int", tag="string", cls="string", attr="string", post="string",
               within_tag="string", within_cls="string")
MARKER = _struct(table="string", part="string", at="long")
URL_STATE = _struct(url="string")
TMDB = _struct(id="long", imdb_id="string", title="string", year="int", poster_path="string", overview="string",
               vote_average="double", cast=T.ArrayType(_struct(name="string")))
OMDB = _struct(imdbID="string", Title="string", Year="string", Poster="string", Plot="string", Director="string",
               Genre="string", imdbRating="string", Actors="string")

# Fields a group of copies of one work shares: pipeline name -> kind of "missing" test.
SHARED_FIELDS = {"imdbId": "string", "poster": "string", "imdbRating": "number", "cast": "string",
                 "synopsis": "string", "genres": "array", "realisateur": "string", "annee": "number",
                 "duree": "number", "titreOriginal": "string"}
DETAIL_FIELDS = {"poster": "string", "realisateur": "string", "annee": "number", "duree": "number",
                 "cast": "string", "synopsis": "string"}
