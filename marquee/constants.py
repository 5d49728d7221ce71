"""Word lists, lookup tables and patterns that results depend on.

Java patterns carry ``(?U)`` (Unicode ``\\w``, ``\\s`` and ``\\b``) and ``(?iU)`` where case is ignored.
"""

# --- fixed values: calendar words -------------------------------------------------------------------------------
MONTHS = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre",
          "décembre"]
MONTH_SLUGS = ["janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre",
               "novembre", "decembre"]
WEEKDAYS = ["lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche"]
# Programme weeks run Wednesday to Tuesday; grid headers are searched in that order: (name, abbreviation, ISO weekday).
PROGRAMME_DAYS = [("mercredi", "mer", 3), ("jeudi", "jeu", 4), ("vendredi", "ven", 5), ("samedi", "sam", 6),
                  ("dimanche", "dim", 7), ("lundi", "lun", 1), ("mardi", "mar", 2)]

# --- fixed values: venues (name, slug, page marker) -------------------------------------------------------------
DEFAULT_VENUE = "Le Comoedia"
VENUES = [("Le Comoedia", "comoedia", None), ("Lumière Terreaux", "lumiere-terreaux", "terreaux"),
          ("Lumière Bellecour", "lumiere-bellecour", "bellecour"), ("Lumière Fourmi", "lumiere-fourmi", "fourmi")]
DEFAULT_SECTION = "Lumière Terreaux"
WEEKLY_FILE_STEM = "/pdf/cinema-lyon-comoedia-semaine-"
POSTER_PREFIX = "https://image.tmdb.org/t/p/w500"
BOOKING_WORDS = ["cotecine", "billet", "reservation"]

# --- fixed values: limits ---------------------------------------------------------------------------------------
MAX_FILE_BYTES = 10485760
TEXT_LIMIT = 500
MIN_HEADER_DAYS = 4
BLOCK_LINES = 12
DATE_SEARCH_DAYS = 28
SNIPPET_CHARS = 600
CONTEXT_CHARS = 80
CONTEXT_CUT = 180
CONTEXTS_PER_PAGE = 5
PROFILE_KEYS = 30
MIN_CINEMAS, MIN_FILMS, MIN_GROUPS = 4, 10, 10

# --- fixed values: page profile words ---------------------------------------------------------------------------
PROFILE_WORDS = ["film", "movie", "seance", "horaire", "programme", "titre", "synopsis", "version", "vf", "vo", "vostfr",
                 "realis", "genre", "duree", "semaine", "schedule"]
STRUCTURE_SKIPPED_TAGS = ["html", "head", "body", "script", "style", "link", "meta"]
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track",
             "wbr"]
MARKED_BLOCKS = [r"""(?iU)<(?:article|div|section)[^>]*class=["'][^"']*film[^"']*["'][^>]*>""",
                 r"""(?iU)<(?:article|div|section)[^>]*class=["'][^"']*seance[^"']*["'][^>]*>""",
                 r"""(?iU)<(?:li)[^>]*class=["'][^"']*(?:seance|horaire)[^"']*["'][^>]*>"""]

# --- fixed values: white space (what strips and collapses) -----------------------------------------------------
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
               "\u200a\u2028\u2029\u202f\u205f\u3000")

# --- fixed values: patterns -------------------------------------------------------------------------------------
WEEKDAY_CHOICE = "(?:lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche)"
NAMED_DAY = (r"(?U)" + "|".join(name for name, _, _ in PROGRAMME_DAYS)
             + r"|\b(?:" + "|".join(abbr for _, abbr, _ in PROGRAMME_DAYS) + r")\b")
NUMERIC_DATE = r"(?U)(\d{1,2})/(\d{1,2})/(\d{4})"
WORD_DATE = r"(?U)(\d{1,2})\s+(\w+)(?:\s+(\d{4}))?"
WEEKDAY_DATE = r"(?U)" + WEEKDAY_CHOICE + r"\s+(\d{1,2})\s+(\w+)(?:\s+(\d{4}))?"
CLOCK = r"(?U)(\d{1,2})[h:](\d{2})"
CLOCK_HOUR_ONLY = r"(?U)(\d{1,2})h$"
CLOCK_WORD = r"(?U)\b(\d{1,2})[h:](\d{2})\b"
CLOCK_WORD_H = r"(?U)\b(\d{1,2})h(\d{2})\b"
CLOCK_ANY_CASE = r"(?U)\b\d{1,2}[hH:]\d{2}\b"
FOOTNOTE = r"(?U)(\d{1,2}h\d{2})(\d)"
WEEK_PERIOD = r"(?iU)Du\s+(\d+)\s+au\s+(\d+)\s+(\w+)\s+(\d{4})"
WEEK_PERIOD_LIVE = r"(?U)[Dd]u\s+(\d+)\s+au\s+(\d+)\s+(\w+)\s+(\d{4})"
WEEK_SLUG = r"(?iU)semaine-(du-.+?)(?:\.pdf|\?|$)"
WEEK_SLUG_ONE_MONTH = r"^du-(\d+)-au-(\d+)-([a-z]+)-(\d{4})$"
WEEK_SLUG_TWO_MONTHS = r"^du-(\d+)-([a-z]+)-au-(\d+)-([a-z]+)-(\d{4})$"
YEAR_WORD = r"(?U)\b(19\d{2}|20\d{2})\b"
YEAR_PROSE = r"(?U)en (19\d{2}|20\d{2})"
DURATION_HOURS = r"(?iU)(\d{1,2})\s*h\s*(\d{2})"
DURATION_MINUTES = r"(?iU)(\d{2,3})\s*min"
DURATION_PROSE_HOURS = r"(?iU)durée (?:de|d') ?(\d{1,2})h(\d{2})"
DURATION_PROSE_MINUTES = r"(?iU)durée de (\d{1,3}) minutes?"
DIRECTOR_PROSE = r"(?iU)Réalisé par ([^.]+?)(?:\.|, avec|$)"
DIRECTOR_LEAD = r"(?U)^(?:de\s+)?([A-ZÀ-Ü][a-zà-ü]+(?:\s+[A-ZÀ-Ü][a-zà-ü]+)+)"
SYNOPSIS_PROSE = (r"(?sU)Film (?:produit|d['’]animation|documentaire)[^.]+\.[\s]*([A-ZÀ][^.]+?)"
                  r"(?=\s*Séances? prévues|\s*$)")
SCREENINGS_PROSE = r"(?isU)Séances? prévues?\s+([^.]+)"
DATED_SCREENING = r"(?iU)" + WEEKDAY_CHOICE + r"\s+(\d{1,2})\s+(\w+)(?:\s+à)?\s*(\d{1,2})[h:](\d{2})"
EVERY_DAY = r"(?iU)tous\s+les\s+jours"
EVERY_DAY_BUT = r"(?iU)tous\s+les\s+jours\s+sauf\s+(\w+)\s+à\s+([^,]+)(?:,\s*et\s+\w+\s+à\s+([^.\s]+))?"
VERSION_WORD = r"(?iU)\b(VF|VO|VOST(?:FR)?|VFST)\b"
VERSION_LINE = r"(?iU)^(VF|VO|VOSTFR?|VFST)$"
VERSION_CUT = r"(?U)\s*/\s*|\s+INT\b|\s+ANS\b|\s+AVERTISSEMENT\b"
CATEGORY_SUFFIX = r"(?iU)\s+JP\s*$"
FILM_HREF = r"(?U)/film/([^/?#]+?)(?:\.html)?(?:[?#]|$)"
SECTION_HEADING = r"(?iU)Films\s+(français|étrangers|jeune public)"
HEADING_BLOCK = r"(?i)<h5[^>]*>([^<]+)</h5>"
FILE_LINK = r"""(?iU)href=["']([^"']+\.pdf[^"']*)["']"""
CLASS_ATTR = r"""(?iU)class=["']([^"']+)["']"""
ID_ATTR = r"""(?iU)id=["']([^"']+)["']"""
ANY_TAG = r"(?U)<(/?)(\w+)[^>]*>"
ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"
