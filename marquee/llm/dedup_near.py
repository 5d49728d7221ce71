"""Near duplicates: b-bit MinHash with band candidates, estimates by bit counts and exact confirmation."""
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.staging import staged
from .bytescan import blocks, mix, words
from .components import components
from .dedup_exact import text_key

SHINGLE = 5
HASHES = 128
BITS = 2                      # low bits of each minimum that the packed signature keeps
BAND = 4                      # minima of a band: 32 bands miss a pair of similarity 0.75 once in 190,000
SIMILAR = 75                  # percent
SLACK = 0.23                  # estimates this far below are still confirmed on full sets: 5 standard errors
# rounds with further centres before pairs across components are compared: centres that a bucket offers, those of which a
# node reads the signature, links that it tries
STAR_ROUNDS, CENTRES, OFFERS, TRIES = 2, 8, 16, 3
_rng = np.random.default_rng(7)
MULTIPLY = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
FINE = 512                    # hashes of the sharper signature for nodes whose pairs across components are compared
FINE_SLACK = 0.115            # 5 standard errors of its estimates
FINE_MULTIPLY = _rng.integers(0, 1 << 63, FINE, dtype=np.uint64) | np.uint64(1)
FINE_ADD = _rng.integers(0, 1 << 63, FINE, dtype=np.uint64)


def shingle_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, count) of the shingles of each row in order, with repeats, and the hashes of all words' offsets.

    A row of fewer words than a shingle has one, its whole word sequence; a row without words has none.
    """
    hashed, row, _, _ = words(data, at)
    n = len(at) - 1
    count = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    rolled = hashed.copy()
    for k in range(1, SHINGLE):
        shifted = np.zeros_like(hashed)
        shifted[:len(hashed) - k] = hashed[k:]
        inside = np.arange(len(hashed)) + k < first[row + 1]   # a short row's shingle ends with the row
        rolled = np.where(inside, mix(rolled * np.uint64(0x9E3779B97F4A7C15) + shifted), rolled)
    size = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    keep = np.arange(len(hashed)) - first[row] < size[row]
    return rolled[keep], np.concatenate(([0], np.cumsum(size))), hashed, first


def signatures(values: np.ndarray, first: np.ndarray, multiply: np.ndarray = MULTIPLY, add: np.ndarray = ADD) -> np.ndarray:
    """Minima (rows) of each non-empty run of ``values`` (columns)."""
    out = np.empty((len(multiply), len(first) - 1), dtype=np.uint64)
    for k in range(len(multiply) if len(first) > 1 else 0):
        x = values * multiply[k] + add[k]
        out[k] = np.minimum.reduceat(x ^ (x >> np.uint64(31)), first[:-1])
    return out


def low_bits(minima: np.ndarray) -> np.ndarray:
    """Packed low bits of the minima, a row of integers for each column; those of hash k stand at places BITS * k and following."""
    bits = np.stack([(minima >> np.uint64(b)) & np.uint64(1) for b in range(BITS)], axis=1).reshape(len(minima) * BITS, -1).T.astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">i8").astype(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text) to (doc_id, text_key, node, n_shingles, bands, low).

    ``node`` is a digest of the word sequence: rows with the same one have the same set. ``bands`` holds one hash per
    band, ``low`` the packed low bits of all minima. A row without words has no node.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, bands, lows = [], [], [], []
            for _, data, at in blocks(batch.column(2)):
                values, first, hashed, word_at = shingle_hashes(data, at)
                full = np.flatnonzero(np.diff(first))
                minima = signatures(values, np.append(first[full], first[-1])) if len(full) else np.zeros((HASHES, 0), np.uint64)
                band = np.zeros((HASHES // BAND, len(full)), np.uint64)
                for j in range(HASHES // BAND):
                    x = np.full(len(full), j, np.uint64)
                    for k in range(BAND):
                        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + minima[j * BAND + k])
                    band[j] = x
                band = band.T.astype(np.int64)
                low = low_bits(minima)
                at_full = dict(zip(full.tolist(), range(len(full))))
                for r in range(len(at) - 1):
                    i = at_full.get(r)
                    nodes.append(None if i is None else md5(hashed[word_at[r]:word_at[r + 1]].tobytes()).digest())
                    sizes.append(0 if i is None else len(np.unique(values[first[r]:first[r + 1]])))
                    bands.append(None if i is None else band[i])
                    lows.append(None if i is None else low[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()),
                                              pa.array(bands, pa.list_(pa.int64())), pa.array(lows, pa.list_(pa.int64()))],
                                             ["doc_id", "text_key", "node", "n_shingles", "bands", "low"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text_key", "text").mapInArrow(
        run, f"doc_id {id_type}, text_key bigint, node binary, n_shingles bigint, bands array<bigint>, low array<bigint>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, text) to (node, shingles): the full set of distinct shingle hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for _, data, at in blocks(batch.column(1)):
                values, first, _, _ = shingle_hashes(data, at)
                sets += [np.unique(values[a:b]).astype(np.int64) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node binary, shingles array<bigint>")


def estimate(x: Column, y: Column, hashes: int = HASHES) -> Column:
    """Similarity from two packed signatures: share of equal low-bit groups, less what chance alone makes equal."""
    groups = "5" * 16
    equal = F.lit(0)
    for i in range(hashes * BITS // 64):
        differ = x[i].bitwiseXOR(y[i])
        folded = differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(int(groups, 16)))
        equal = equal + (64 // BITS) - F.bit_count(folded)
    chance = 1 / (1 << BITS)
    return (equal / hashes - chance) / (1 - chance)


def first_shared(x: Column, y: Column) -> Column:
    """The first band that two nodes have in common: a pair of several buckets is taken up in this one only."""
    return F.coalesce(*[F.when(x[j] == y[j], x[j]) for j in range(HASHES // BAND)])


def sets_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes; ``texts`` (doc_id, text_key, text) has the rows behind ``nodes``."""
    holders = nodes.join(wanted, "node").select("node", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("id"), "text_key")
    held = texts.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).join(holders, ["id", "text_key"]).select("node", "text")
    return staged(shingle_sets(held).dropDuplicates(["node"]), "sets")


def confirmed(edges: DataFrame, nodes: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """Those of the edges (a, b) whose full shingle sets are similar enough."""
    sets = sets_of(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, texts)
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return edges.join(side("b"), "b").join(side("a"), "a").filter(100 * both >= similar * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def most_shared(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, size, common, fine): size of each set, how many of its shingles another wanted node has too, and a sharper signature."""
    sets = sets_of(wanted, nodes, texts)

    def sharpen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                lists = part.column(1)
                first = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))))
                fine = low_bits(signatures(lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint64), first, FINE_MULTIPLY, FINE_ADD))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first), pa.int64()), pa.array(list(fine), pa.list_(pa.int64()))], ["node", "size", "fine"])

    each = sets.select("node", F.explode("shingles").alias("shingle"))
    several = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("shingle")
    common = each.join(several, "shingle").groupBy("node").agg(F.count(F.lit(1)).alias("common"))
    return staged(sets.mapInArrow(sharpen, "node binary, size bigint, fine array<bigint>").join(common, "node"), "common")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR, slack: float = SLACK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, text_key, root (of the component, NULL without words).

    Rows without words, NULL among them, are linked with nothing: their component is their own id. Equal word
    sequences are always linked, and so are rows that repeat an id with equal texts; NULL ids sort last and take the
    component of their texts. An empty table gives no rows; other columns are ignored.

    Rows with one word sequence stand behind one node. Nodes that share a band form a bucket. Each node is first
    linked to one centre of its buckets only, never all with all. Estimates sort out most of these links, full sets
    confirm the rest. Buckets whose members are still in different components then compare just those, so a link
    between two texts is only lost where no band of theirs agrees or the estimate is far off.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(text_col).alias("text_key"))
    rows = staged(signed(plain), "signed")
    nodes = staged(rows.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("at"), F.first("bands").alias("bands"), F.first("low").alias("low"))
        .select("node", "at.doc_id", "at.text_key", "bands", "low"), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = staged(banded.join(shared, "band"), "members")
    # nodes with many neighbours are likely the originals that others were made from: they make good centres
    hubs = members.groupBy("node").agg(F.sum("n").alias("weight"))
    ranked = staged(members.select("band", "node").join(hubs, "node").select("band", F.struct("weight", "node").alias("hub")), "ranked")
    centres = ranked.groupBy("band").agg(F.max("hub").alias("centre"))
    low = lambda c: nodes.select(F.col("node").alias(c), F.col("low").alias(f"low_{c}"))
    least = similar / 100 - slack

    def stars(buckets: DataFrame) -> DataFrame:
        """(a, b): each member and the heaviest centre of its buckets, where the estimate allows a link."""
        best = buckets.filter("hub < centre").groupBy(F.col("hub.node").alias("b")).agg(F.max("centre").alias("c")).select(F.col("c.node").alias("a"), "b")
        return best.join(low("b"), "b").join(low("a"), "a").filter(estimate(F.col("low_a"), F.col("low_b")) >= least).select("a", "b")

    def open_only(buckets: DataFrame, roots: DataFrame) -> DataFrame:
        """Buckets whose members are still in different components, with the component of each member."""
        placed = buckets.join(roots, F.col("hub.node") == F.col("node"), "left").withColumn("root", F.coalesce("root", "hub.node")).select("band", "hub", "root")
        several = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("band")
        return staged(placed.join(several, "band"), "open")

    tried = staged(stars(ranked.join(centres, "band")), "likely")
    links = staged(confirmed(tried, nodes, plain, similar), "links")
    roots = staged(components(links), "roots")
    for _ in range(STAR_ROUNDS):   # further centres for what is still apart, the likeliest of them by estimate
        left = open_only(ranked, roots)
        heaviest = left.withColumn("k", F.row_number().over(Window.partitionBy("band").orderBy(F.desc("hub")))).filter(F.col("k") <= CENTRES)
        offered = left.join(heaviest.select("band", F.col("hub").alias("centre"), F.col("root").alias("centre_root")), "band").filter("root != centre_root")
        # the few centres that share most bands with a node, before any signature is read
        counted = offered.groupBy(F.col("centre.node").alias("a"), F.col("hub.node").alias("b")).agg(F.count(F.lit(1)).alias("n")).join(tried, ["a", "b"], "left_anti")
        few = counted.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))).filter(F.col("k") <= OFFERS).select("a", "b")
        judged = staged(few.join(low("b"), "b").join(low("a"), "a").select("a", "b", estimate(F.col("low_a"), F.col("low_b")).alias("e")), "judged")
        if judged.isEmpty():
            break
        best = judged.filter(F.col("e") >= least).withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("e"), "a"))).filter(F.col("k") <= TRIES)
        fresh = staged(best.select("a", "b"), "likely")
        tried = tried.union(fresh).union(judged.filter(F.col("e") < least).select("a", "b"))
        links = staged(links.union(confirmed(fresh, nodes, plain, similar)), "links")
        roots = staged(components(links), "roots")

    # pairs across components: first the nodes that have any likely partner there. Two sets can have no more in common
    # than either shares with all these nodes, which rules out the texts that were changed too much, with all theirs
    left = open_only(ranked, roots).select("band", F.col("hub.node").alias("node"), "root").join(nodes.select("node", "low"), "node")
    side = lambda df, c: df.select("band", *[F.col(x).alias(f"{x}_{c}") for x in df.columns if x != "band"])
    near = estimate(F.col("low_a"), F.col("low_b")) >= least
    other = side(left, "b").withColumnRenamed("band", "band_b")
    likely = staged(side(left, "a").join(other, (F.col("band") == F.col("band_b")) & (F.col("root_a") != F.col("root_b")) & near, "left_semi")
                    .select("band", *[F.col(f"{x}_a").alias(x) for x in ("node", "root", "low")]), "likely_nodes")
    fitted = likely.join(most_shared(likely.select("node").distinct(), nodes, plain), "node").join(nodes.select("node", "bands"), "node")
    fewest = F.least("common_a", "common_b")
    across = side(fitted, "a").join(side(fitted, "b"), "band").filter(
        (F.col("root_a") < F.col("root_b")) & ((100 + similar) * fewest >= similar * (F.col("size_a") + F.col("size_b")))
        & (first_shared(F.col("bands_a"), F.col("bands_b")) == F.col("band"))
        & (estimate(F.col("fine_a"), F.col("fine_b"), FINE) >= similar / 100 - FINE_SLACK))
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = staged(ordered(across.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).distinct().join(ordered(tried), ["a", "b"], "left_anti"), "across")
    if not more.isEmpty():
        roots = staged(components(links.union(confirmed(more, nodes, plain, similar))), "roots")

    named = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    told = named.select("node", "root").join(smallest, "root").select("node", "root", "component_id")
    return rows.select("doc_id", "text_key", "node", "n_shingles").join(told, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.col("component_id").isNull()).alias("kept"), "text_key", "root")
