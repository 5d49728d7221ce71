"""Prefix trie, spelling variants and main text against brute force and hand-made cases."""
import collections
import hashlib
import html
import pickle
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import lm_score, main_text, prefix_trie, queries, spellings

FOLDER = "/root/testdata/sf0.001"


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {c: own.get(c - c % 5, [])[:h] + ts[h:] for c, ts in own.items() for h in [zlib.crc32(str(c).encode()) % 9]}
    members = collections.defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = {p: ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p)) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest())
                  for p, m in members.items())


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in df.collect())


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    rows = []
    for c in list(range(0, 60)) + [77, 103, 2 ** 53 + 1, 2 ** 60]:
        for turn in range(rng.choice([1, 2, 3, 9, 12])):
            rows.append((c, None if turn == 0 else turn, rng.choice(["user", None, ""]), rng.choice(["same", "sämé", "", None, f"{rng.random()}"])))
    rows += [(c, turn, "user", f"first turns {turn}") for c in (200, 201, 202, 203, 205, 206) for turn in range(10)]      # copies
    rows += [(300, turn, "user", f"long {turn}") for turn in range(500)] + [(301, turn, "user", f"long {turn}") for turn in range(500)]
    rows += [(None, 1, "user", "no conversation")]
    return [r for r in rows if r[0] not in (45, 50)]                                                                    # absent first ones


def test_trie(spark, talks):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in talks], "conv_id long, turn long, role string, text string, depth long, k1 string, size int")
    want = brute_trie(talks)
    assert trie_rows(prefix_trie.prefix_trie(df.repartition(5))) == want
    assert trie_rows(prefix_trie.prefix_trie(df, tops=3, shard_nodes=8)) == want                  # nearly all nodes below the top


def test_trie_rows_repeated(spark):
    rows = [(5, 1, "user", "a"), (5, 1, "user", "a"), (6, 1, "user", "a"), (10, None, None, None)]
    got = trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")))
    assert got == brute_trie(rows)
    one = spark.createDataFrame([(7, 1, "user", "only")], "conv_id long, turn long, role string, text string")
    assert [r[1:6] for r in trie_rows(prefix_trie.prefix_trie(one))] in ([(0, -1, 1, 1, 1), (1, 7, 1, 0, 1)], [(0, -1, 1, 0, 1)])
    assert prefix_trie.prefix_trie(one.limit(0)).count() == 0


def test_hot_first_turn(spark):
    rows = [(c, t, "user", "hello" if t == 0 else f"{c % 40} {t}") for c in range(0, 3000) for t in range(3)]
    assert trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tops=100)) == brute_trie(rows)


def test_node_table():
    rng = np.random.default_rng(1)
    high, low = rng.integers(-2 ** 62, 2 ** 62, 50000), rng.integers(0, 3, 50000)
    table = prefix_trie.NodeTable(high, low)
    assert sorted(table.slots) == list(range(50000)) and np.array_equal(table.find(high, low), table.slots)
    assert np.all(table.find(high, low + 7) == -1)
    with pytest.raises(ValueError):
        prefix_trie.NodeTable(np.zeros(2, np.int64), np.zeros(2, np.int64))
    assert len(prefix_trie.NodeTable(np.zeros(0, np.int64), np.zeros(0, np.int64)).find(high[:2], low[:2])) == 2


def near(words):
    stems = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            stems[w[:i] + w[i + 1:], i].add(w)
    found = collections.defaultdict(set)
    for (stem, _), group in stems.items():
        for w in group:
            found[w] |= group - {w}
            if stem in words:
                found[w].add(stem)
                found[stem].add(w)
    return found


def brute_words(rows, least=5, slip=199):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % slip else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= least}
    close = near(n)
    best = {w: min(close[w], key=lambda x: (-n[x], x)) for w in n if close[w]}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w
    return sorted((w, form.get(w) or "", root(w), k, len(close[w]), n.get(form.get(w), 0)) for w, k in n.items())


def word_rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_spellings(spark):
    rng = random.Random(8)
    rows = [(None, "Ärgerlich ärgerlich ÄRGERLICH " * 3), (1, None), (2, ""), (3, "-- 12 ×÷"), (4, "aaaaaa aaaaaaa aaaaaaaa " * 40), (4, "aaaaaa " * 40)]
    for i in range(10, 90):
        words = ["".join(rng.choice("abÉé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
        rows.append((i, " ".join(w for w in words for _ in range(rng.choice([1, 1, 1, 6, 30])))))
    rows += [(100 + k, ("word" * 3000 + c + " ") * 30 ** k) for k, c in enumerate(["", "s"])] + [(102, ("word" * 3000 + "b") + " ")] * 6
    rows.append((103, "chainaa " * 6 + "chainab " * 40 + "chainbb " * 300 + "chaibbb " * 2000))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, word string")
    want = brute_words(rows)
    assert word_rows(spellings.spelling_groups(df)) == want and sum(w[1] != "" and w[1] != w[2] for w in want) > 0
    assert word_rows(spellings.spelling_groups(df, slip=3)) == brute_words(rows, slip=3)
    assert spellings.spelling_groups(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spellings.spelling_groups(df, ratio=1)


def test_acceptor():
    rng = random.Random(2)
    short = sorted({"".join(rng.choice("abc") for _ in range(5)) for _ in range(80)})
    long = sorted({"".join(rng.choice("abc") for _ in range(6)) for _ in range(200)})
    found = near(set(short + long))
    want = {(x, y) for x in short for y in found[x] if len(y) == 6} | {(x, y) for x in short for y in found[x] if len(y) == 5 and y < x}
    for states in (10, 10 ** 6):
        machine = spellings.Acceptor(states)
        for _ in range(2):
            got = list(machine.pairs(short, long))
            assert len(got) == len(want) and {(x, y) if len(y) > len(x) else (max(x, y), min(x, y)) for x, y in got} == want
    first, second = spellings.Acceptor(), spellings.Acceptor()
    assert first.build(["aa", "ab", "ba", "bb"]) is not None and len(first.arcs) == 3            # minimal: one state a letter
    assert second.build([""]) == second.final


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{a}}</style><script>var x='<p>no</p>';</script></head><body class='has-sidebar'>{body}</body></html>"


PROSE = "The history of the town is long, and it was the home of many people who had come to the coast for the trade in salt and wool. "


def test_main_text_of_marked_content():
    body = """<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice"><p>We use cookies on this site.</p></div>
      <div class=ad>Buy the best of the things that you want.</div><article><h1>Caf&eacute; &amp; <i>bar</i></h1><p><b>Short<br>
      one<p>Second &lt;p&gt; &#x263A;</p><div class="share">Share this</div><ul><li>item 1<li>item <a href=x>2</a></ul>
      <aside>Related: something</aside><form><input><label>Mail</label></form><p hidden>secret</p><pre>a   b
      c</pre></article><section id=comments><article class=comment><p>Nice post, I like the article a lot.</p></article></section><footer>&copy; us</footer>"""
    assert main_text.main_text(page(body)) == "Café & bar\nShort one\nSecond <p> ☺\nitem 1\nitem 2\na b c"


def test_main_text_of_unmarked_pages():
    links = "".join(f"<li><a href=/{i}>Section number {i} of the site</a></li>" for i in range(8))
    body = f"<div><ul>{links}</ul></div><div><h2>A heading</h2><p>{PROSE * 2}</p><p>Short line.</p><p>{PROSE * 3}</p></div><div><p>All rights reserved</p><ul>{links}</ul></div>"
    assert main_text.main_text(page(body)) == "\n".join(["A heading", (PROSE * 2).strip(), "Short line.", (PROSE * 3).strip()])
    assert main_text.main_text(page(f"<div>{'buy now cheap pills ' * 20}</div>")) == ""
    assert main_text.main_text(page(f"<form id=all><article><p>{PROSE}</p></article></form>")) == PROSE.strip()


def test_neighbours_decide():
    blocks = [main_text.Block(False, 0, False) for _ in range(6)]
    assert main_text.second_pass(blocks, [None, True, None, True, None, False], False) == [False, True, True, True, False, False]
    blocks[0].heading = True
    assert main_text.second_pass(blocks, [None, True, None, None, None, False], False) == [True, True, True, False, False, False]


@pytest.mark.parametrize("part", ["<p ", "<!--", "<a =\"<a ='", "<script>x", "< ", "<div>", "</p>", "<p>", "&amp", "<br>", "</ ", "<![", "a=<b =", "<a x=\"", "<textarea>", "<p>x</div>"])
def test_main_text_is_linear(part):
    start = time.time()
    main_text.main_text(part * 100000)
    main_text.main_text("<article>" * 50000 + part * 50000)
    assert time.time() - start < 20


def test_main_text_of_table(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", page("<main>x</main>")), (3, "u", page("<article>a b</article>")), (3, "u", page("<article>a b</article>")),
            (4, "u", page("<article>" + "<p>é word</p>" * 50000 + "</article>"))]
    df = spark.createDataFrame([(*r, 9, "z") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = collections.Counter((r.page_id, r.url, r.text, r.n_chars) for r in main_text.page_texts(df, rows_per_batch=2).collect())
    long = "\n".join(["é word"] * 50000)
    assert got == {(1, "u", "", 0): 1, (2, None, "", 0): 1, (None, "u", "x", 1): 1, (3, "u", "a b", 3): 2, (4, "u", long, len(long)): 1}
    assert main_text.page_texts(df.limit(0)).count() == 0


def test_main_text_query(spark):
    """Pages of the test tables mark their article: its text between block tags, by patterns alone."""
    got = {r.page_id: r.text for r in queries.QUERIES["op13_main_text"](spark, FOLDER).collect()}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        inner = re.search("(?s)<article>(.*?)</article>", r.html)[1]
        parts = re.split("</?(?:p|h1)>", re.sub("</?b>", "", inner.replace("<br>", " ")))
        assert got[r.page_id] == "\n".join(t for p in parts if (t := re.sub(r"\s+", " ", html.unescape(p)).strip()))


def test_lm_sends_the_tables_of_a_small_corpus_compressed(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(lm_score, "mixed_model", lambda docs, shared, real=lm_score.mixed_model: (sent.append(shared.value), real(docs, shared))[1])
    docs = spark.createDataFrame([(i, f"text {i} of a small table") for i in range(40)], "doc_id long, text string")
    assert lm_score.lm_scores(docs).count() == 40
    assert len(pickle.dumps(sent[0])) < 1 << 20                                  # opened they take 96 MB
    tables, plain = lm_score.opened(sent[0]), np.zeros((len(lm_score.PREDICTORS) * (1 << lm_score.TABLE_BITS) // lm_score.RANGE, lm_score.RANGE), "<u2")
    for row in lm_score.summed(lm_score.counted(docs.filter("crc32(cast(doc_id as string)) % 5 <> 1"))).collect():
        plain[row["part"]] = np.frombuffer(row["body"], "<u2")
    assert plain.any() and (tables == plain.reshape(tables.shape)).all()
