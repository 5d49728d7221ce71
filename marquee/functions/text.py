"""Scalar text functions, all Column in, Column out, no Python in the data path."""
from pyspark.sql import Column, functions as F

from .. import constants as K
from .binding import let
from .missing import or_default


def strip(c: Column) -> Column:
    """Drop any leading and trailing white space (plain ``trim`` only drops spaces)."""
    return F.btrim(c, F.lit(K.WHITE_SPACE))


def collapse(c: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(c, f"[{K.WHITE_SPACE}]+", " ")


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """Capture group of the first match, NULL when there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def title_key(c: Column) -> Column:
    return collapse(F.lower(strip(F.coalesce(c, F.lit("")))))


def work_key(original: Column, title: Column) -> Column:
    """Key that groups copies of one work: the original title where there is one, NULL when no title at all."""
    return F.nullif(title_key(or_default(original, title)), F.lit(""))


def slugify(name: Column, known: dict[str, str] | None = None) -> Column:
    """Known names by table, others lower-cased with spaces as dashes."""
    plain = F.translate(F.lower(name), " è", "-e")
    known = {n: s for n, s, _ in K.VENUES} if known is None else known
    for venue, slug in known.items():
        plain = F.when(name == venue, F.lit(slug)).otherwise(plain)
    return plain


def url_quote(c: Column) -> Column:
    """Percent-encode everything but unreserved characters."""
    c = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(c, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def ellipsize(c: Column, limit: int = K.TEXT_LIMIT) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def fold_accents(c: Column) -> Column:
    return F.translate(c, "éèêûîâô", "eeeuiao")


def na_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit("N/A"))


def year_number(c: Column) -> Column:
    """Leading four characters as a number: ``2019–2021`` gives 2019, words give NULL."""
    return F.substring(c, 1, 4).try_cast("int")


def rating_number(c: Column) -> Column:
    return na_to_null(c).try_cast("double")


def split_list(c: Column, sep: str = ",") -> Column:
    return F.transform(F.split(c, sep), strip)


def poster_url(path: Column) -> Column:
    return F.when(path != "", F.concat(F.lit(K.POSTER_PREFIX), path))


def top_names(cast: Column, n: int = 3) -> Column:
    """Names of the first ``n`` members, empty ones dropped after the cut; NULL when none is left."""
    names = F.filter(F.transform(F.slice(cast, 1, n), lambda m: m["name"]), lambda x: x != "")
    return F.nullif(F.array_join(names, ", "), F.lit(""))


def without_lead(c: Column, word: str) -> Column:
    """Drop one leading word (``Avec``, ``de``), any case."""
    return F.regexp_replace(c, rf"(?iU)^{word}\s+", "")


def href_slug(c: Column) -> Column:
    return extract(c, K.FILM_HREF)


def director_prose(c: Column) -> Column:
    name = strip(F.regexp_extract(c, K.DIRECTOR_PROSE, 1))
    return F.nullif(F.regexp_replace(name, ",+$", ""), F.lit(""))


def director_lead(c: Column) -> Column:
    name = F.regexp_extract(strip(c), K.DIRECTOR_LEAD, 1)
    return F.when(F.length(name) > 4, name)


def synopsis_prose(c: Column) -> Column:
    s = strip(F.regexp_extract(c, K.SYNOPSIS_PROSE, 1))
    return F.when((F.length(s) > 30) & ~s.contains("Réalisé par"), ellipsize(s))


def clean_title(c: Column) -> Column:
    """Title without category suffix; NULL when shorter than two characters."""
    plain = F.when(F.upper(c).contains("JP"), F.regexp_replace(c, K.CATEGORY_SUFFIX, "")).otherwise(c)
    return let(strip(collapse(plain)), lambda t: F.when(F.length(t) >= 2, t))


# --- versions ---------------------------------------------------------------------------------------------------

def version_code(c: Column) -> Column:
    """VOSTFR over VFST over VO, plain VF when nothing is said."""
    u = F.upper(c)
    return (F.when(u.contains("VOST"), "VOSTFR").when(u.contains("VFST"), "VFST")
             .when(u.contains("VO"), "VO").otherwise("VF"))


def version_from_prose(c: Column) -> Column:
    low = F.lower(c)
    return (F.when(low.contains("sous-titr") | low.contains("vost"), "VOSTFR")
             .when(low.rlike(r"(?U)\bvo\b") & ~low.contains("version française"), "VO").otherwise("VF"))


def version_from_node(own: Column, whole: Column) -> Column:
    """Version of a record: its own version node, else what the whole text says."""
    u = F.upper(whole)
    rest = (F.when(u.contains("VOST"), "VOSTFR")
             .when(u.contains("VO") & ~u.contains("VF"), "VO").otherwise("VF"))
    return F.when(own.isNotNull(), version_code(own)).otherwise(rest)


def version_override(c: Column, default: Column) -> Column:
    """Version said by one screening's own text, else the record's."""
    u = F.upper(c)
    return (F.when(u.contains("VOST"), "VOSTFR").when(u.rlike(r"(?U)\bVO\b"), "VO")
             .when(u.rlike(r"(?U)\bVF\b"), "VF").otherwise(default))


def version_token(c: Column) -> Column:
    return strip(F.split(c, K.VERSION_CUT, 2)[0])
