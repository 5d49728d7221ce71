"""Registered queries of this subpackage with the SQL that gives the same rows, where SQL can."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (decontaminate, dedup_exact, dedup_lines, dedup_near, dedup_passages, lm_score, main_text, packing, prefix_trie, quality, secrets,
               spellings, urls)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, folder: build(lambda table: spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet"))
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


@query("op1_lm_score")
def op1(t):
    return lm_score.lm_scores(t("documents"))


@query("op2_near_dedup")
def op2(t):
    return dedup_near.near_dedup(t("documents")).drop("text_key", "root")


@query("op3_decontaminate", r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
         b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
         p AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 9], ' ') AS phrase, least(10, len(ws)) AS k
               FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM b WHERE len(ws) > 0)),
         g AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
               FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, (SELECT DISTINCT k FROM p) WHERE len(ws) >= k)),
         h AS (SELECT doc_id, i, g.k, item_id FROM g JOIN p USING (phrase) WHERE g.k = p.k),
         c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS pos FROM h) GROUP BY doc_id),
         i AS (SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM h GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
           sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM w LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""")
def op3(t):
    return decontaminate.contamination(t("documents"), t("benchmark")).select(
        "doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query("op4_passages")
def op4(t):
    return dedup_passages.passage_dedup(t("documents")).select(
        "doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_quality")
def op5(t):
    return quality.quality_scores(t("documents"), t("labels")).drop("text_key")


@query("op6_urls")
def op6(t):
    return urls.url_verdicts(t("pages"))


def span_list(*kinds: str):
    """kind:start:end of the spans of these kinds (all without any), comma-joined."""
    spans = F.filter("spans", lambda s: s.kind.isin(*kinds)) if kinds else F.col("spans")
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))


@query("op7_secrets")
def op7(t):
    number = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return secrets.secret_spans(t("documents")).select(
        "doc_id", number("assign"), number("access"), number("hex"), F.sha2(span_list("assign", "access", "hex"), 256).alias("base_sha256"),
        span_list().alias("spans"), number("random"))


@query("op8_exact_dedup", r"""
    WITH bare AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents)
    SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
           row_number() OVER best = 1 AS kept, sha256(s) AS text_sha256
    FROM bare WINDOW best AS (PARTITION BY s ORDER BY chars DESC, doc_id)""")
def op8(t):
    return dedup_exact.exact_dedup(t("documents")).drop("text_key")


@query("op9_line_dedup", r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i
               FROM documents WHERE text <> ''),
         p AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM l),
         c AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) > 1 AS later FROM p WHERE next IS NOT NULL),
         m AS (SELECT l.doc_id, l.i, l.line, coalesce(c.later, false) OR coalesce(b.later, false) AS gone
               FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.i = l.i LEFT JOIN c b ON b.doc_id = l.doc_id AND b.i = l.i - 1),
         r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM m),
         d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_runs,
                      coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
    SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents LEFT JOIN d USING (doc_id)""")
def op9(t):
    return dedup_lines.line_dedup(t("documents")).select(
        "doc_id", "n_lines", F.expr("aggregate(runs, 0L, (n, r) -> n + r.end - r.start)").alias("n_removed"), F.size("runs").cast("long").alias("n_runs"),
        F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op10_packing")
def op10(t):
    return packing.pack(t("documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc32_sql(codes: str) -> str:
    """DuckDB expression: unsigned CRC-32 of a list of byte values."""
    step = "list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {step}), 4294967295)"


def bytes_sql(text: str) -> str:
    """DuckDB expression: UTF-8 bytes of a text without code points from U+0800."""
    code = "CAST(unicode(z) AS BIGINT)"
    return f"flatten(list_transform(string_split({text}, ''), lambda z: CASE WHEN {code} < 128 THEN [{code}] ELSE [192 + {code} // 64, 128 + {code} % 64] END))"


@query("op11_prefix_trie", f"""
    WITH own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts FROM conversations
                 WHERE conv_id IS NOT NULL GROUP BY conv_id),
         h AS (SELECT *, CAST({crc32_sql(bytes_sql("CAST(conv_id AS VARCHAR)"))} % 9 AS INTEGER) AS h FROM own),
         r AS (SELECT h.conv_id, list_concat(coalesce(b.ts, [])[1:h.h], h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
         m AS (SELECT conv_id, unnest(generate_series(0, len(ts))) AS depth, ts FROM r),
         n AS (SELECT ts[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                      string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(ts) = depth) AS ends FROM m GROUP BY ALL),
         k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
         t AS (SELECT n.*, coalesce(n_children, 0) AS n_children, p.conv_id AS parent_conv_id,
                      CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * strlen(n.path[n.depth].text) ELSE 0 END AS saved
               FROM n LEFT JOIN k ON k.path = n.path LEFT JOIN n p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]),
         s AS (SELECT path[1:d] AS path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
               FROM (SELECT *, unnest(generate_series(0, depth)) AS d FROM t) GROUP BY ALL)
    SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
    FROM t JOIN s ON s.path = t.path""")
def op11(t):
    return prefix_trie.prefix_trie(t("conversations"))


@query("op12_spellings", f"""
    WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
         g AS (SELECT run, {crc32_sql(bytes_sql("id || ':' || run"))} AS h, k FROM (SELECT id, run, count(*) AS k FROM r GROUP BY ALL)),
         v AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n
               FROM g GROUP BY 1 HAVING sum(k) >= 5 AND length(word) >= 6),
         d AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS stem FROM (SELECT word, n, unnest(generate_series(0, length(word) - 1)) AS i FROM v)),
         p AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.stem = b.stem AND a.i = b.i AND a.word <> b.word
               UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.stem = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.stem = v.word),
         f AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS best, max(n) AS best_n FROM p GROUP BY word),
         t AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n
               FROM v LEFT JOIN f USING (word)),
         c AS (SELECT word, word AS last, 0 AS steps FROM t UNION ALL SELECT c.word, t.form, steps + 1 FROM c JOIN t ON c.last = t.word WHERE t.form IS NOT NULL)
    SELECT word, form, root, n, n_near, form_n FROM t JOIN (SELECT word, arg_max(last, steps) AS root FROM c GROUP BY word) USING (word)""")
def op12(t):
    return spellings.spelling_groups(t("documents"))


@query("op13_main_text")
def op13(t):
    return main_text.page_texts(t("pages"))
