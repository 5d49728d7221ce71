"""Spelling variants: the vocabulary's acceptor composed with a one-edit transducer and the acceptor again.

Two words within one edit share the half before the edit or the half after it. The state that the acceptor reaches by a
half is the initial state of one partition, whose rows are what the words of that state leave open; one half is long
enough that few words share it, whatever the vocabulary. A task streams its partitions: each is built into a minimal
acceptor (states are interned by their right language, across partitions too), composed, and its accepted pairs are
enumerated. A partition sends per word only the number of its near words and the best one, never the pairs.
"""
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.staging import staged

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
SLIP = 199                    # one run in so many loses a letter
STATES = 200_000              # states kept for later partitions; forgetting them costs time, not results


class Acceptor:
    """Acyclic acceptors whose states are interned: equal right languages are one state."""

    def __init__(self, states: int = STATES):
        self.limit = states
        self.forget()

    def forget(self):
        self.known: dict[tuple, int] = {}
        self.arcs: list[tuple] = []              # state -> ((letter, state), ...), by letter
        self.accepts: list[tuple] = []           # state -> strings, asked for by common()
        self.memo: dict[tuple, tuple] = {}
        self.final = self.state(())

    def state(self, arcs: tuple) -> int:
        here = self.known.get(arcs)
        if here is None:
            here = self.known[arcs] = len(self.arcs)
            self.arcs.append(arcs)
            self.accepts.append(None)
        return here

    def build(self, strings: list[str]) -> int:
        """State that accepts these sorted distinct strings of one length, minimised from the right as they come."""
        if not strings[0]:
            return self.final
        open_arcs: list[list] = [[] for _ in strings[0]]     # finished arcs of the states on the last string's path
        last = None
        for string in strings:
            if last is not None:
                same = 0
                while string[same] == last[same]:
                    same += 1
                self._close(open_arcs, last, same)
            last = string
        self._close(open_arcs, last, 0)
        return self.state(tuple(open_arcs[0]))

    def _close(self, open_arcs: list[list], string: str, depth: int):
        below = self.final
        for i in range(len(string) - 1, depth - 1, -1):
            open_arcs[i].append((string[i], below))
            if i > depth:
                below = self.state(tuple(open_arcs[i]))
                open_arcs[i] = []

    def strings(self, at: int) -> tuple:
        """All strings that a state accepts. Ways without a fork are walked, so very long words need no deep stack."""
        found = self.accepts[at]
        if found is None:
            head, to = [], at
            while len(self.arcs[to]) == 1:
                (c, to), = self.arcs[to]
                head.append(c)
            start = "".join(head)
            found = self.accepts[at] = (start,) if to == self.final else tuple(start + c + s for c, on in self.arcs[to] for s in self.strings(on))
        return found

    def common(self, a: int, b: int) -> tuple:
        """Strings that both states accept: the composition after its edit, where it only copies."""
        if a == b:
            return self.strings(a)
        key = (a, b) if a < b else (b, a)
        found = self.memo.get(key)
        if found is None:
            head = []
            while True:
                arcs = dict(self.arcs[a])
                shared = [(c, arcs[c], to) for c, to in self.arcs[b] if c in arcs]
                if len(shared) != 1:
                    found = tuple(c + s for c, x, y in shared for s in self.common(x, y))
                    break
                (c, a, b), = shared
                head.append(c)
                if a == b:
                    found = self.strings(a)
                    break
            if head and found:
                start = "".join(head)
                found = tuple(start + s for s in found)
            self.memo[key] = found
        return found

    def replaced(self, a: int) -> Iterator[tuple[str, str]]:
        """Pairs of accepted strings that differ in one letter, each once."""
        path, todo = [], [(a, 0, "")]
        while todo:
            at, depth, letter = todo.pop()
            if depth:
                path[depth - 1:] = letter
            arcs = self.arcs[at]
            head = "".join(path) if len(arcs) > 1 else ""
            for i, (c, to) in enumerate(arcs):
                for d, other in arcs[:i]:
                    for tail in self.common(to, other):
                        yield head + c + tail, head + d + tail
                todo.append((to, depth + 1, c))

    def inserted(self, a: int, b: int) -> Iterator[tuple[str, str]]:
        """Pairs (string of a, string of b) of which the second has one letter more; where that letter repeats its
        neighbour a pair can come more than once."""
        path, todo = [], [(a, b, 0, "")]
        while todo:
            a, b, depth, letter = todo.pop()
            if depth:
                path[depth - 1:] = letter
            arcs = dict(self.arcs[a])
            for d, to in self.arcs[b]:
                tails = self.common(a, to)
                if tails:
                    head = "".join(path)
                    for tail in tails:
                        yield head + tail, head + d + tail
                if d in arcs:
                    todo.append((arcs[d], to, depth + 1, d))

    def pairs(self, shorter: list[str], longer: list[str]) -> Iterator[tuple[str, str]]:
        """Pairs one edit apart: within ``shorter`` by replacement, between the two by insertion."""
        if len(self.arcs) > self.limit or len(self.memo) > self.limit:
            self.forget()
        a = self.build(shorter)
        yield from self.replaced(a)
        if longer:
            seen = set()
            for pair in self.inserted(a, self.build(longer)):
                if pair not in seen:
                    seen.add(pair)
                    yield pair


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP) -> DataFrame:
    """(word, n): the runs of letters of all whole texts with A-Z in lower case and now and then a letter less, counted."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run")
    lowered = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run).select("id", lowered)
    code = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) AS int)), substring(run, cast(h % length(run) AS int) + 2))")
    return code.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def halves(words: DataFrame) -> DataFrame:
    """Rows (state, long, rest, n) of the partitions a word belongs to.

    For a pair of s and s or s + 1 letters with its edit after the first s // 2, the state is that first half ('>'); with
    its edit before the last s - s // 2, it is that last half ('<').
    """
    rows = []
    for long in (0, 1):
        short = f"(length(word) - {long})"
        rows.append(f"named_struct('state', concat('>', {short}, ' ', substring(word, 1, {short} div 2)), 'long', {long}, 'rest', substring(word, {short} div 2 + 1))")
        rows.append(f"named_struct('state', concat('<', {short}, ' ', right(word, {short} - {short} div 2)), 'long', {long}, "
                    f"'rest', substring(word, 1, length(word) - ({short} - {short} div 2)))")
    return words.select("n", F.explode(F.expr(f"array({', '.join(rows)})")).alias("r")).select("r.*", "n")


def near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, own, n_near, best_n, best) for the words of each partition, whose rows follow each other."""
    machine = Acceptor()
    out: dict[str, list] = {"word": [], "own": [], "n_near": [], "best_n": [], "best": []}
    kinds = {"word": pa.string(), "own": pa.int64(), "n_near": pa.int64(), "best_n": pa.int64(), "best": pa.string()}

    def meet(state: str, rests: list[str], ns: list[int], longs: list[int]):
        """Rows of one partition come with the shorter words first, each kind sorted."""
        shorter = longs.index(1) if longs[-1] else len(longs)
        if not shorter:
            return
        count = dict(zip(rests, ns))
        forward, half = state[0] == ">", state[state.index(" ") + 1:]
        found: dict[str, list] = {}
        for x, y in machine.pairs(rests[:shorter], rests[shorter:]):
            if not forward and len(y) > len(x) and y.startswith(x):
                continue                                     # the letter between the halves: counted by the first half
            for a, b in ((x, y), (y, x)):
                n = count[b]
                known = found.get(a)
                if known is None:
                    found[a] = [1, n, b]
                else:
                    known[0] += 1
                    if n > known[1] or n == known[1] and (half + b < half + known[2] if forward else b + half < known[2] + half):
                        known[1], known[2] = n, b
        whole = (lambda rest: half + rest) if forward else (lambda rest: rest + half)
        for rest, (number, n, best) in found.items():
            for name, value in zip(out, (whole(rest), count[rest], number, n, whole(best))):
                out[name].append(value)

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in kinds.items()], list(kinds))
        for values in out.values():
            values.clear()
        return batch

    state, rests, ns, longs = None, [], [], []
    for batch in batches:
        for s, long, rest, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if s != state:
                if len(rests) > 1:
                    meet(state, rests, ns, longs)
                state, rests, ns, longs = s, [], [], []
            rests.append(rest)
            ns.append(n)
            longs.append(long)
        if len(out["word"]) > 20000:
            yield flushed()
    if len(rests) > 1:
        meet(state, rests, ns, longs)
    yield flushed()


def ends(links: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last one by doubling the way. Counts grow at every step, so
    there are no circles, and the ways are as long as the logarithm of the largest count at most."""
    current = staged(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        following = staged(current.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        current = following.drop("moved")
        if following.filter("moved").isEmpty():
            return current


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
                    ratio: int = RATIO, slip: int = SLIP) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words have ``least_letters`` code points (two at least) and ``least_count`` occurrences. Near words are one inserted,
    deleted or replaced code point away. A word's form is its near word of largest n (ties: the smallest in code-point
    order) if that has ``ratio`` times its own n, else NULL; its root is the last form of forms, or itself. NULL and empty
    texts hold no words, a NULL id is an empty one, repeated rows count each, an empty table gives no rows, other columns
    are ignored. ``ratio`` must exceed 1: forms could be circular otherwise.
    """
    if least_letters < 2 or ratio <= 1:
        raise ValueError("words need two letters and forms a ratio above 1")
    words = staged(words_of(docs, id_col, text_col, slip).filter((F.col("n") >= least_count) & (F.length("word") >= least_letters)), "words")
    parts = halves(words).repartition("state").sortWithinPartitions("state", "long", "rest").select("state", "long", "rest", "n")
    found = parts.mapInArrow(near_words, "word string, own long, n_near long, best_n long, best string")
    best: Column = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))).alias("b")
    every = found.unionByName(words.select("word", F.col("n").alias("own"), F.lit(0).cast("long").alias("n_near")), allowMissingColumns=True)
    near = every.groupBy("word").agg(F.max("own").alias("n"), F.sum("n_near").alias("n_near"), best)
    fits = -F.col("b.less") >= ratio * F.col("n")
    told = staged(near.select("word", F.when(fits, F.col("b.best")).alias("form"), "n", "n_near", F.when(fits, -F.col("b.less")).alias("form_n")), "near")
    roots = ends(told.filter("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
