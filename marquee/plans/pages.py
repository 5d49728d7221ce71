"""Queries over pages: nodes, selection, links, profiles, calendar tables and detail pages."""
from pyspark.sql import functions as F

from .. import constants as K, schema
from ..functions.binding import let
from ..functions import html as H, records as R
from ..functions.shapes import Shape, select
from ..operators import documents as O, extract as X, profile as P
from ..operators.extract import Rule
from ..operators.dedup import distinct_in_order
from ..sources.readers import decode, is_admissible
from . import derived as DI
from .registry import ORACLES, query

text = lambda c: c.cast("string")
nodes = lambda: F.col("nodes")


def parsed(t):
    return H.parse_pages(t.pages.select("page_id", "html"))


@query("pages_scan", "SELECT page_id, url, length(html) AS n_chars, md5(html) AS digest FROM pages")
def pages_scan(t):
    html = decode(F.col("html").cast("binary"))
    return t.pages.select("page_id", "url", F.length(html).cast("bigint").alias("n_chars"), F.md5(html.cast("binary")).alias("digest"))


@query("admit_files", """SELECT doc_id, CAST(4 + strlen(text) AS BIGINT) AS size FROM documents
    WHERE doc_id % 3 > 0 AND 4 + strlen(text) <= 10485760""")
def admit_files(t):
    head = F.when(F.col("doc_id") % 3 > 0, "%PDF").otherwise("PK..")
    files = t.documents.select("doc_id", F.concat(head, "text").cast("binary").alias("content"))
    sized = files.withColumn("size", F.octet_length("content").cast("bigint"))
    return sized.filter(is_admissible(F.col("size"), F.col("content"))).select("doc_id", "size")


UNESCAPE_SQL = "replace(replace(replace(replace({c}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"


# a stack machine over the tags of a page, one tag of every page a step
NODES_SQL = f"""WITH RECURSIVE raw AS (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<script>.*?</script>|<[^>]+>|[^<]+') AS ts FROM pages),
    tok AS (SELECT page_id, list_filter(flatten(list_transform(ts, lambda x: CASE WHEN starts_with(x, '<!') THEN [] WHEN starts_with(x, '<script>') THEN ['<script>', 'raw' || x[9:-10], '</script>'] WHEN starts_with(x, '<') THEN [x]
        ELSE ['=' || {UNESCAPE_SQL.format(c="x")}] END)), lambda x: x <> 'raw') AS ts FROM raw),
    run AS (SELECT page_id, ts, 0 AS i, [{{'id': 0, 'tag': ''}}] AS stack, 0 AS node, CAST(NULL AS VARCHAR) AS tag, 0 AS parent, 0 AS depth, 0 AS attrs, CAST([] AS INTEGER[]) AS closed, CAST(NULL AS VARCHAR) AS said, 0 AS speaker FROM tok
      UNION ALL
      SELECT page_id, ts, i + 1, CASE WHEN kind = 'start' AND name NOT IN ({', '.join(f"'{v}'" for v in K.VOID_TAGS)}) THEN list_append(stack, {{'id': node + 1, 'tag': name}}) WHEN kind = 'end' AND place > 0 THEN stack[1:place - 1] ELSE stack END,
        CASE WHEN kind = 'start' THEN node + 1 ELSE node END, CASE WHEN kind = 'start' THEN name END, stack[len(stack)].id, len(stack), CASE WHEN kind = 'start' THEN len(regexp_extract_all(t, '[a-z:-]+="[^"]*"')) ELSE 0 END,
        CASE WHEN kind = 'end' AND place > 0 THEN list_transform(stack[place:], lambda x: x.id) ELSE [] END, CASE WHEN kind = 'data' THEN regexp_replace(t, '^(=|raw)', '') END, stack[len(stack)].id
      FROM (SELECT *, CASE WHEN kind = 'end' THEN len(stack) + 1 - coalesce(list_position(list_reverse(list_transform(stack, lambda x: x.tag)), name), len(stack) + 1) ELSE 0 END AS place
        FROM (SELECT *, CASE WHEN starts_with(t, '</') THEN 'end' WHEN starts_with(t, '<') THEN 'start' ELSE 'data' END AS kind, regexp_extract(t, '^</?([a-z0-9]+)', 1) AS name
          FROM (SELECT *, ts[i + 1] AS t FROM run WHERE i < len(ts))))),
    nodes AS (SELECT page_id, node AS node_id, parent AS parent_id, depth, tag, attrs FROM run WHERE tag IS NOT NULL UNION ALL SELECT page_id, 0, NULL, 0, 'root', 0 FROM tok),
    ends AS (SELECT page_id, unnest(closed) AS node_id, node AS subtree_end FROM run UNION ALL SELECT page_id, unnest(list_transform(stack, lambda x: x.id)), node FROM run WHERE i = len(ts)),
    texts AS (SELECT page_id, speaker AS node_id, string_agg(said, '' ORDER BY i) AS own_text FROM run WHERE said IS NOT NULL GROUP BY ALL)"""


@query("html_nodes", rf"""{NODES_SQL} SELECT page_id, node_id, parent_id, depth, coalesce(subtree_end, node_id) AS subtree_end, tag, attrs AS n_attrs,
    regexp_replace(coalesce(own_text, ''), '^\s+|\s+$', '', 'g') AS own_text FROM nodes LEFT JOIN ends USING (page_id, node_id) LEFT JOIN texts USING (page_id, node_id)""")
def html_nodes(t):
    flat = parsed(t).select("page_id", F.inline("nodes"))
    return flat.select("page_id", "node_id", "parent_id", "depth", "subtree_end", "tag", F.size("attrs").alias("n_attrs"), "own_text")


@query("find_nodes", """SELECT page_id, CAST(len(regexp_extract_all(lower(html), '<div[^>]*class="[^"]*ad[^"]*"')) AS INTEGER) AS n FROM pages""")
def find_nodes(t):
    """Selected while the page is parsed: nothing else leaves the parser."""
    return select(t.pages.select("page_id", "html"), {"found": Shape("div", "AD")}).select("page_id", F.size("found").alias("n"))


@query("found_nodes", """SELECT page_id, CAST(len(regexp_extract_all(lower(html), '<div[^>]*class="[^"]*ad[^"]*"')) AS INTEGER) AS n FROM pages""")
def found_nodes(t):
    """The same selection over the whole node list."""
    return parsed(t).select("page_id", F.size(H.find_nodes(nodes(), tag="div", cls="AD")).alias("n"))


@query("text_of_title", "SELECT page_id, " + ", ".join(
    f"trim({UNESCAPE_SQL.format(c=f'''regexp_extract(html, '<{tag}>([^<]*)</{tag}>', 1)''')}) AS {name}" for tag, name in
    (("title", "title"), ("h1", "heading"))) + " FROM pages")
def text_of_title(t):
    of = lambda tag: F.coalesce(H.text_of(nodes(), H.first(H.find_nodes(nodes(), tag=tag))), F.lit(""))
    return parsed(t).select("page_id", of("title").alias("title"), of("h1").alias("heading"))


@query("child_counts", """SELECT page_id, tag, n FROM (SELECT page_id, unnest(['nav', 'div', 'article', 'footer']) AS tag,
    unnest([len(regexp_extract_all(html, '<nav>')), len(regexp_extract_all(html, '<div ')), len(regexp_extract_all(html, '<article>')), len(regexp_extract_all(html, '<footer>'))]) AS n FROM pages) WHERE n > 0""")
def child_counts(t):
    body = H.first(H.find_nodes(nodes(), tag="body"))
    kids = parsed(t).select("page_id", F.transform(H.children(nodes(), body), lambda n: n["tag"]).alias("tags"))
    return kids.select("page_id", F.explode("tags").alias("tag")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("attrs_contain", """SELECT page_id, regexp_matches(regexp_extract(html, '<nav>.*</nav>', 0), '="[^"]*/[Dd]e') AS in_nav,
    regexp_matches(html, '<[a-z][^>]*="[^"]*ad[^"]*"') AS in_page FROM pages""")
def attrs_contain(t):
    nav = H.first(H.find_nodes(nodes(), tag="nav"))
    return parsed(t).select("page_id", F.coalesce(H.attrs_contain(nodes(), nav, "/de") | H.attrs_contain(nodes(), nav, "/De"), F.lit(False)).alias("in_nav"),
                            H.attrs_contain(nodes(), H.root(nodes()), "ad").alias("in_page"))


@query("first_heading", f"""SELECT page_id, trim({UNESCAPE_SQL.format(c="regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) AS heading FROM pages""")
def first_heading(t):
    return parsed(t).select("page_id", F.coalesce(R.first_text(nodes(), None, *R.TITLE_RULES), F.lit("")).alias("heading"))


@query("largest_block", """WITH tags AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'g'), '<script>.*?</script>', '<script>', 'g'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
    SELECT page_id, arg_min(tag, (-n, tag)) AS tag, max(n) AS n FROM (SELECT page_id, tag, count(*) AS n FROM tags GROUP BY ALL) GROUP BY page_id""")
def largest_block(t):
    tags = parsed(t).select("page_id", F.transform(F.slice(nodes(), F.lit(2), F.size(nodes())), lambda n: n["tag"]).alias("tags"))
    best = tags.select("page_id", let(F.col("tags"), lambda found: F.array_min(F.transform(F.array_distinct(found), lambda x: F.struct(
        (-F.size(F.filter(found, lambda y: y == x))).alias("n"), x.alias("tag"))))).alias("b"))
    return best.select("page_id", "b.tag", (-F.col("b.n")).cast("bigint").alias("n"))


@query("page_detail", f"""SELECT page_id, trim({UNESCAPE_SQL.format(c="regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title,
    trim({UNESCAPE_SQL.format(c="regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) AS heading, regexp_extract(html, '<a href="([^"]*)"', 1) AS first_link FROM pages""")
def page_detail(t):
    return parsed(t).select("page_id", F.coalesce(R.first_text(nodes(), None, {"tag": "title"}), F.lit("")).alias("title"),
                            F.coalesce(R.first_text(nodes(), None, {"tag": "h1"}), F.lit("")).alias("heading"),
                            H.attr(H.first(H.find_nodes(nodes(), tag="a")), "href").alias("first_link"))


@query("detail_page", """SELECT p_partkey AS page_id, 'https://p.example/' || p_partkey || '.jpg' AS poster, 'Ana ' || array_to_string(list_transform(string_split(p_name, ' '),
    lambda w: upper(w[1]) || w[2:]), ' ') AS realisateur, CAST(CASE WHEN p_partkey % 3 > 0 THEN p_size + 1950 END AS INTEGER) AS annee, CAST(120 + p_size AS INTEGER) AS duree,
    'A, ' || p_brand AS actors, CASE WHEN length(trim(repeat(p_name || ' ', 60))) > 500 THEN left(trim(repeat(p_name || ' ', 60)), 500) || '…' ELSE trim(repeat(p_name || ' ', 60)) END AS synopsis FROM part""")
def detail_page(t):
    pages = H.parse_pages(DI.detail_pages(t))
    return pages.select("page_id", R.detail_page(nodes()).alias("d")).select("page_id", "d.poster", "d.realisateur", "d.annee", "d.duree",
                                                                       F.col("d.cast").alias("actors"), "d.synopsis")


@query("html_blocks", r"""WITH parts AS (SELECT page_id, string_split(html, '<p>') AS x FROM pages),
    b AS (SELECT page_id, unnest(x) AS b, generate_subscripts(x, 1) AS i FROM parts),
    s AS (SELECT page_id, i, trim(regexp_replace(regexp_extract(b, '^[^<]*'), '\s+', ' ', 'g')) AS titre, substr(b, length(regexp_extract(b, '^[^<]*')) + 1) AS rest FROM b WHERE i > 1)
    SELECT page_id, CAST(i - 2 AS INTEGER) AS pos, titre, md5(rest) AS content FROM s WHERE titre <> ''""")
def html_blocks(t):
    """Paragraphs as blocks: the text that opens one is its title, the markup up to the next one its content."""
    found = t.pages.select("page_id", F.explode(H.heading_blocks(F.col("html"), r"<p>([^<\x02]*)")).alias("b"))
    return found.select("page_id", "b.pos", "b.titre", F.md5(F.col("b.content").cast("binary")).alias("content"))


@query("block_filter", """SELECT p_partkey AS page_id, CAST(1 AS INTEGER) AS pos, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS titre FROM part""")
def block_filter(t):
    found = DI.blocks(t).select("page_id", F.explode(F.filter(H.heading_blocks(F.col("html")), H.is_film_block)).alias("b"))
    return found.select("page_id", "b.pos", "b.titre")


@query("film_block", """WITH p AS (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS cap FROM part)
    SELECT p_partkey AS page_id, cap AS titre, 'Ana ' || cap AS realisateur, CAST(CASE WHEN p_partkey % 2 = 0 THEN 60 + p_size ELSE p_size END AS INTEGER) AS duree,
    CAST(p_size + 1950 AS INTEGER) AS annee, CASE WHEN p_partkey % 3 = 0 THEN 'VOSTFR' ELSE 'VF' END AS version, 'Une histoire longue et simple de ' || p_name || ' & compagnie' AS synopsis,
    '1998-03-04 11:15;1998-03-04 13:35;1998-03-07 11:15;1998-03-07 13:35' AS slots FROM p""")
def film_block(t):
    films = O.heading_films(DI.blocks(t), DI.RUN_DATE)
    return films.select("page_id", "titre", "realisateur", "duree", "annee", "version", "synopsis", F.array_join(F.transform(
        "seances", lambda s: F.concat_ws(" ", text(s["date"]), s["heure"])), ";").alias("slots"))


@query("film_record", """WITH p AS (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS cap FROM part)
    SELECT p_partkey AS page_id, cap AS titre, upper(p_name) AS original, CAST(p_size + 1950 AS INTEGER) AS annee, CAST(60 + p_size AS INTEGER) AS duree, 'De Jean Dupont' AS realisateur,
    'Texte ' || p_brand AS synopsis, '1998-03-04 20:' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ' ' || CASE WHEN p_partkey % 2 = 0 THEN 'VOSTFR' ELSE 'VF' END
    || ';1998-03-05 09:05 VO' AS slots FROM p""")
def film_record(t):
    pages = H.parse_pages(DI.film_nodes(t))
    rec = pages.select("page_id", R.film_node(nodes(), H.first(H.find_nodes(nodes(), tag="article")), DI.RUN_DATE).alias("f"))
    return rec.select("page_id", "f.titre", F.col("f.titreOriginal").alias("original"), "f.annee", "f.duree", "f.realisateur", "f.synopsis",
                      F.array_join(F.transform("f.seances", lambda s: F.concat_ws(" ", text(s["date"]), s["heure"], s["version"])), ";").alias("slots"))


@query("extract_links", """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS hrefs FROM pages),
    u AS (SELECT page_id, unnest(hrefs) AS h, generate_subscripts(hrefs, 1) AS i FROM l)
    SELECT page_id, CASE WHEN h LIKE 'http%' THEN h ELSE 'https://cinema.example' || h END AS url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS INTEGER) AS pos
    FROM u GROUP BY page_id, h""")
def extract_links(t):
    found = t.pages.select("page_id", F.posexplode(H.links(F.col("html"), DI.SITE, r"""(?iU)href=["']([^"']+)["']""")).alias("pos", "url"))
    return found.select("page_id", "url", "pos")


@query("distinct_ordered", """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS hrefs FROM pages),
    u AS (SELECT page_id, unnest(hrefs) AS url, generate_subscripts(hrefs, 1) - 1 AS i FROM l)
    SELECT url, arg_min(page_id, {'p': page_id, 'i': i}) AS page_id, CAST(arg_min(i, {'p': page_id, 'i': i}) AS INTEGER) AS i FROM u GROUP BY url""")
def distinct_ordered(t):
    found = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("i", "url"))
    return distinct_in_order(found.select("url", F.struct("page_id", "i").alias("pos")), "url", "pos").select("url", "pos.page_id", "pos.i")


@query("block_bounds", r"""WITH parts AS (SELECT page_id, string_split(html, '<p>') AS x FROM pages),
    u AS (SELECT page_id, unnest(x) AS part, generate_subscripts(x, 1) AS i FROM parts),
    b AS (SELECT page_id, i, sum(length(part) + CASE WHEN i > 1 THEN 3 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS finish FROM u)
    SELECT page_id, CAST(i - 2 AS INTEGER) AS pos, CAST(start AS INTEGER) AS first_char, CAST(finish AS INTEGER) AS last_char FROM
    (SELECT page_id, i, finish, lag(finish) OVER (PARTITION BY page_id ORDER BY i) AS start FROM b) WHERE i > 1""")
def block_bounds(t):
    found = t.pages.select("page_id", F.explode(H.block_bounds(F.col("html"), "<p>")).alias("b"))
    return found.select("page_id", "b.pos", F.col("b.start").alias("first_char"), F.col("b.end").alias("last_char"))


# --- profiles ---------------------------------------------------------------------------------------------------

PAGE_WORDS = ["ad", "a", "d"]


@query("class_histogram", """WITH v AS (SELECT unnest(regexp_extract_all(html, '(?i)class=["'']([^"'']+)["'']', 1)) AS v FROM pages),
    c AS (SELECT unnest(regexp_extract_all(v, '\\S+')) AS class FROM v), h AS (SELECT class, CAST(contains(lower(class), 'ad') AS INTEGER) + CAST(contains(lower(class), 'a') AS INTEGER)
    + CAST(contains(lower(class), 'd') AS INTEGER) AS hits FROM c) SELECT class, CAST(sum(hits) AS BIGINT) AS n FROM h WHERE hits > 0 GROUP BY class""")
def class_histogram(t):
    return P.class_histogram(t.pages, "html", PAGE_WORDS)


@query("attr_histogram", """WITH v AS (SELECT unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)) AS id FROM pages),
    h AS (SELECT id, """ + " + ".join(f"CAST(contains(lower(id), '{w}') AS INTEGER)" for w in K.PROFILE_WORDS) + """ AS hits FROM v)
    SELECT id, CAST(sum(hits) AS BIGINT) AS n FROM h WHERE hits > 0 GROUP BY id""")
def attr_histogram(t):
    return P.id_histogram(t.pages, "html", pattern=r"""(?iU)href=["']([^"']+)["']""")


@query("pattern_snippet", r"""SELECT page_id, CAST(no AS INTEGER) AS pattern_no, CAST(len(regexp_extract_all(html, p)) AS INTEGER) AS n,
    substr(html, length(string_split_regex(html, p)[1]) + 1, 600) AS snippet
    FROM pages, (VALUES (0, '(?i)<(?:article|div|section)[^>]*class=["''][^"'']*ad[^"'']*["''][^>]*>'), (1, '(?i)<h1[^>]*>')) AS v(no, p) WHERE regexp_matches(html, p)""")
def pattern_snippet(t):
    marked = K.MARKED_BLOCKS[0].replace("film", "ad")
    return P.pattern_profile(t.pages, "html", [marked, "(?i)<h1[^>]*>"], ["page_id"])


CONTEXT_WORD = "tion"


@query("match_context", r"""WITH p AS (SELECT doc_id, text, string_split(text, 'tion') AS x FROM documents),
    h AS (SELECT doc_id, text, x, unnest(range(1, least(5, len(x) - 1) + 1)) AS no FROM p),
    m AS (SELECT doc_id, text, no, CAST(list_sum(list_transform(x[1:no], lambda y: length(y))) + 4 * (no - 1) AS BIGINT) AS hit FROM h)
    SELECT doc_id, CAST(no AS INTEGER) AS no, left(regexp_replace(regexp_replace(regexp_replace(substr(text, greatest(hit - 80, 0) + 1, hit + 84 - greatest(hit - 80, 0)), '<[^>]+>', ' ', 'g'),
    '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), 180) AS context FROM m""")
def match_context(t):
    """All five contexts of every text."""
    found = t.documents.select("doc_id", F.explode_outer(P.match_contexts(F.col("text"), CONTEXT_WORD)).alias("m")).filter("m IS NOT NULL")
    return found.select("doc_id", "m.no", "m.context")


@query("tag_profile", rf"""WITH t AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<(?:/?)(?:\w+)[^>]*>'), lambda x: {{'shut': starts_with(x, '</'), 'tag': lower(regexp_extract(x, '^</?(\w+)', 1))}}),
        lambda x: x.tag NOT IN ({', '.join(f"'{v}'" for v in K.STRUCTURE_SKIPPED_TAGS)})) AS ts FROM pages),
    u AS (SELECT page_id, i, ts[i].tag AS tag, ts[i].shut AS shut, list_reduce(list_prepend(0, list_transform(ts[1:i - 1], lambda x: CASE WHEN x.shut THEN -1 ELSE 1 END)),
        lambda a, x: CASE WHEN x < 0 THEN greatest(a - 1, 0) ELSE least(a + 1, 8) END) AS depth FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM t)),
    k AS (SELECT page_id, least(depth, 4) AS depth, tag, count(*) AS n, min(i) AS first FROM u WHERE NOT shut GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first) AS rank FROM k)
    SELECT page_id, CAST(rank AS INTEGER) AS rank, CAST(depth AS INTEGER) AS depth, tag, CAST(n AS INTEGER) AS n FROM r WHERE rank <= {K.PROFILE_KEYS}""")
def tag_profile(t):
    return P.tag_profile(t.pages)


# --- calendar tables --------------------------------------------------------------------------------------------

def calendar_rows(t):
    return O.calendar_rows(H.parse_pages(DI.calendar_pages(t).select("l_suppkey", text(F.col("week")).alias("week"), "html")))


WEEK_SQL = "CAST(CAST(l_shipdate AS DATE) - CAST((isodow(CAST(l_shipdate AS DATE)) + 4) % 7 AS INTEGER) AS DATE)"
SHOWN_SQL = f"""shown AS (SELECT DISTINCT l_suppkey, CAST({WEEK_SQL} AS VARCHAR) AS week, l_linenumber % 4 AS section, p_brand, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day,
    (l_linenumber + 10) || ':' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 2, '0') AS heure, CASE l_returnflag WHEN 'A' THEN 'VF' WHEN 'N' THEN 'VOSTFR' ELSE 'VO' END AS version,
    CASE l_linenumber % 4 WHEN 0 THEN 'Lumière Terreaux' WHEN 1 THEN 'Lumière Fourmi' ELSE 'Lumière Bellecour' END AS cinema FROM lineitem JOIN part ON l_partkey = p_partkey)"""


SHOWN_PAGES = f"""{SHOWN_SQL},
    cells AS (SELECT l_suppkey, week, section, p_brand, day, '<td class="schedule">' || CASE WHEN section = 2 THEN '<a href="https://x.cotecine.example/1">resa</a>' ELSE '' END
        || string_agg('<time datetime="' || day || ' ' || heure || ':00" class="session x">' || replace(heure, ':', 'h') || '<div class="dropdown"><div class="version">' || replace(version, 'VOSTFR', 'VOST') || '</div></div></time>', ''
           ORDER BY replace(heure, ':', 'h'), replace(version, 'VOSTFR', 'VOST')) || '</td>' AS cell FROM shown GROUP BY l_suppkey, week, section, p_brand, day),
    movies AS (SELECT l_suppkey, week, section, string_agg('<tr class="movie"><th class="movie-title"><a href="/film/' || lower(replace(p_brand, '#', '-')) || '.html?week=1">' || p_brand || '</a></th>' || row || '</tr>', '' ORDER BY p_brand) AS body
        FROM (SELECT l_suppkey, week, section, p_brand, string_agg(cell, '' ORDER BY day) AS row FROM cells GROUP BY ALL) GROUP BY ALL),
    page AS (SELECT l_suppkey, week, '<html><body><table class="small"><tr><td>x</td></tr></table><table class="schedule"><tr class="days"><td></td>'
        || array_to_string(list_transform(range(0, 7), lambda d: '<th class="day-title"><time datetime="' || CAST(CAST(CAST(week AS DATE) + CAST(d AS INTEGER) AS DATE) AS VARCHAR) || ' 00:00:00">j</time></th>'), '') || '</tr>'
        || coalesce(max(body) FILTER (section = 0), '') || '<tr class="cinema striped"><th><svg><use xlink:href="/i.svg#logo-fourmi"></use></svg></th></tr>' || coalesce(max(body) FILTER (section = 1), '')
        || '<tr class="cinema"><th>Salle BELLECOUR</th></tr>' || coalesce(max(body) FILTER (section = 2), '') || '<tr class="cinema"><th>Autre salle</th></tr>' || coalesce(max(body) FILTER (section = 3), '')
        || '</table></body></html>' AS html FROM movies GROUP BY l_suppkey, week)"""


@query("time_contexts", rf"""WITH {SHOWN_PAGES}, p AS (SELECT l_suppkey, week, html, regexp_extract_all(html, '\b\d{{1,2}}[hH:]\d{{2}}\b')[1:{K.CONTEXTS_PER_PAGE}] AS hits,
        string_split_regex(html, '\b\d{{1,2}}[hH:]\d{{2}}\b') AS gaps FROM page),
    h AS (SELECT l_suppkey, week, html, no, length(hits[no]) AS size, CAST(list_sum(list_transform(gaps[1:no], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:no - 1], lambda x: length(x))), 0) AS BIGINT) AS place
        FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS no FROM p))
    SELECT l_suppkey, week, CAST(no AS INTEGER) AS no, left(regexp_replace(regexp_replace(regexp_replace(substr(html, greatest(place - {K.CONTEXT_CHARS}, 0) + 1, place + size + {K.CONTEXT_CHARS} - greatest(place - {K.CONTEXT_CHARS}, 0)),
        '<[^>]+>', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), {K.CONTEXT_CUT}) AS context FROM h""")
def time_contexts(t):
    found = DI.calendar_pages(t).select("l_suppkey", "week", F.explode_outer(P.match_contexts(F.col("html"))).alias("m")).filter("m IS NOT NULL")
    return found.select("l_suppkey", text(F.col("week")).alias("week"), "m.no", "m.context")


@query("row_kind", f"""WITH {SHOWN_SQL}, pages_of AS (SELECT DISTINCT l_suppkey, week FROM shown), movies AS (SELECT DISTINCT l_suppkey, week, section, p_brand FROM shown)
    SELECT l_suppkey, week, kind, CAST(n AS BIGINT) AS n FROM (SELECT l_suppkey, week, 'days' AS kind, 1 AS n FROM pages_of UNION ALL SELECT l_suppkey, week, 'cinema', 3 FROM pages_of
    UNION ALL SELECT l_suppkey, week, 'movie', count(*) FROM movies GROUP BY ALL)""")
def row_kind(t):
    return calendar_rows(t).groupBy("l_suppkey", "week", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("section_name", f"""WITH {SHOWN_SQL} SELECT l_suppkey, week, unnest([1, 2, 3]) AS no, unnest(['Lumière Fourmi', 'Lumière Bellecour', NULL]) AS cinema
    FROM (SELECT DISTINCT l_suppkey, week FROM shown)""")
def section_name(t):
    rows = calendar_rows(t).filter("kind = 'cinema'").select("l_suppkey", "week", R.section_name(nodes(), H.root(nodes())).alias("cinema"), H.text_of(nodes(), H.root(nodes())).alias("said"))
    return rows.select("l_suppkey", "week", F.when(F.col("said") == "", 1).when(F.col("said") == "Autre salle", 3).otherwise(2).alias("no"), "cinema")


@query("header_dates", f"""WITH {SHOWN_SQL} SELECT l_suppkey, week, CAST(i + 1 AS INTEGER) AS col, CAST(CAST(CAST(week AS DATE) + CAST(i AS INTEGER) AS DATE) AS VARCHAR) AS day
    FROM (SELECT DISTINCT l_suppkey, week FROM shown), generate_series(0, 6) AS g(i)""")
def header_dates(t):
    rows = calendar_rows(t).filter("kind = 'days'").select("l_suppkey", "week", F.inline(R.header_dates(nodes(), H.root(nodes()))))
    return rows.select("l_suppkey", "week", "col", text(F.col("date")).alias("day"))


@query("cell_screenings", f"""WITH {SHOWN_SQL} SELECT l_suppkey, week, p_brand AS titre, day, heure, version, CAST(count(*) AS BIGINT) AS n,
    CAST(count(*) FILTER (section = 2) AS BIGINT) AS bookable FROM shown GROUP BY ALL""")
def cell_screenings(t):
    films = O.calendar_films(calendar_rows(t)).select("l_suppkey", "week", "titre", F.inline("seances"))
    return films.groupBy("l_suppkey", "week", "titre", text(F.col("date")).alias("day"), "heure", "version").agg(
        F.count(F.lit(1)).alias("n"), F.count("resa_url").alias("bookable"))


@query("movie_rows", f"""WITH {SHOWN_SQL} SELECT l_suppkey, week, cinema, p_brand AS titre, lower(replace(p_brand, '#', '-')) AS slug, section = 2 AS bookable,
    string_agg(day || ' ' || heure, ';' ORDER BY day, heure) AS slots FROM shown GROUP BY l_suppkey, week, section, cinema, p_brand""")
def movie_rows(t):
    return movie_lines(O.calendar_page_films(DI.calendar_pages(t).select("l_suppkey", text(F.col("week")).alias("week"), "html")))


@query("movie_rows_of_nodes", ORACLES["movie_rows"])
def movie_rows_of_nodes(t):
    """The same film rows from the nodes of the table rows."""
    return movie_lines(O.calendar_films(calendar_rows(t)))


def movie_lines(films):
    return films.select("l_suppkey", "week", "cinema", "titre", "slug", F.exists("seances", lambda s: s["resa_url"].isNotNull()).alias("bookable"),
                        F.array_join(F.transform("seances", lambda s: F.concat_ws(" ", text(s["date"]), s["heure"])), ";").alias("slots"))


# --- rule tables ------------------------------------------------------------------------------------------------

FIELD_RULES = [Rule("page", "titre", 1, "h1", post="strip"), Rule("page", "titre", 2, "title", post="strip"), Rule("page", "lien", 1, "a", attr="href"),
               Rule("page", "langue", 1, "html", attr="lang"), Rule("page", "pub", 1, "div", "AD", post="strip"),
               Rule("detail", "poster", 1, "img", attr="data-src", post="web address", within_tag="figure", within_cls="poster"),
               Rule("detail", "realisateur", 1, "p", "filmmakers", post="after de"), Rule("detail", "annee", 1, "p", "informations", post="year"),
               Rule("detail", "duree", 1, "p", "informations", post="minutes"), Rule("detail", "cast", 1, "p", "actors", post="after Avec"),
               Rule("detail", "synopsis", 2, "div", "synopsis", post="shortened"),
               Rule("detail", "synopsis", 1, "p", post="shortened", within_tag="div", within_cls="synopsis")]


@query("extract_fields", f"""WITH d AS (SELECT p_partkey AS page_id, CAST(p_size AS INTEGER) AS s, p_name, p_brand, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS cap,
        trim(repeat(p_name || ' ', 60)) AS prose FROM part),
    f AS (SELECT 'page' AS kind, page_id, unnest(['titre', 'lien', 'langue', 'pub']) AS field, unnest([trim({UNESCAPE_SQL.format(c="regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}),
            nullif(regexp_extract(html, '<a href="([^"]*)"', 1), ''), nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), ''),
            trim({UNESCAPE_SQL.format(c="regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)")})]) AS value FROM pages
        UNION ALL SELECT 'detail', page_id, unnest(['poster', 'realisateur', 'annee', 'duree', 'cast', 'synopsis']), unnest(['https://p.example/' || page_id || '.jpg', 'Ana ' || cap,
            CASE WHEN page_id % 3 > 0 THEN CAST(s + 1950 AS VARCHAR) END, CAST(120 + s AS VARCHAR), 'A, ' || p_brand, CASE WHEN length(prose) > 500 THEN left(prose, 500) || '…' ELSE prose END]) FROM d)
    SELECT kind, page_id, field, value FROM f WHERE value IS NOT NULL""")
def extract_fields(t):
    """Pages of two kinds and one table of rules, in one pass over the pages."""
    pages = t.pages.select(F.lit("page").alias("kind"), "page_id", "html").unionByName(DI.detail_pages(t).select(F.lit("detail").alias("kind"), "page_id", "html"))
    return X.extract_fields(pages, t.spark.createDataFrame(FIELD_RULES, schema.RULE)).select("kind", "page_id", "field", "value")
