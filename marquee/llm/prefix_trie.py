"""Prefix trie of conversations: distinct prefix digests in perfectly hashed node tables, summed up along parent slots.

Turns travel as digests, never as texts. A prefix is named by the exclusive or of the hashes of its (depth, turn) pairs,
so the names of all prefixes of a conversation are running totals, which ranges of a long conversation compute apart. A
name is checked against depth and turn digest wherever it is used as a key.

Nodes with one member need no summing. Of the shared ones those with a ``1 / tops`` share of all turns and more (so at
most ``tops`` of them) form the top of the trie, summed in one table; the subtrees below are dealt over shards by the
name of their highest node, and hand their totals up.
"""
from collections.abc import Iterator
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.skew import spread_lookup
from ..operators.staging import staged
from .bytescan import mix

FAMILY = 5                   # conversations c - c % FAMILY ... share turns of the first of them
LONGEST_HEAD = 8             # a conversation takes at most so many turns of another
TOPS = 1 << 14
SHARD_NODES = 1 << 18
BLOCK_IDS = 8                # ids of 2 ** BLOCK_IDS neighbours are joined before they travel
GAMMA = 2                    # places per key and round while slots are found


class NodeTable:
    """Minimal perfect hash of distinct 128-bit names: key i sits in the slot ``slots[i]`` below ``len(keys)``.

    Each round hashes the keys left to ``GAMMA`` places each; a key alone at its place takes the next free slot. Keys
    are kept by slot, and ``find`` compares them, so a name that is not in the table is never taken for another.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray):
        n = len(high)
        self.high, self.low = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.rounds: list[np.ndarray] = []       # place -> slot, -1 where several keys met
        self.slots = np.empty(n, np.int64)
        left, used = np.arange(n), 0
        while len(left):
            if len(self.rounds) > 64:
                raise ValueError("two nodes have the same name")
            size = GAMMA * len(left) + 1
            place = self._places(high[left], low[left], len(self.rounds), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            table = np.full(size, -1, np.int64)
            table[place[alone]] = used + np.arange(alone.sum())
            self.slots[left[alone]] = table[place[alone]]
            used += int(alone.sum())
            self.rounds.append(table)
            left = left[~alone]
        self.high[self.slots], self.low[self.slots] = high, low

    @staticmethod
    def _places(high: np.ndarray, low: np.ndarray, round_no: int, size: int) -> np.ndarray:
        seed = np.uint64(0x9E3779B97F4A7C15 * (round_no + 1) % (1 << 64))
        return (mix(high.view(np.uint64) ^ mix(low.view(np.uint64) + seed)) % np.uint64(size)).astype(np.int64)

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Slot of each name, -1 for names that are not in the table."""
        found, left = np.full(len(high), -1, np.int64), np.arange(len(high))
        for i, table in enumerate(self.rounds):
            slot = table[self._places(high[left], low[left], i, len(table))]
            found[left[slot >= 0]] = slot[slot >= 0]
            left = left[slot < 0]
        known = found >= 0
        known[known] = (self.high[found[known]] == high[known]) & (self.low[found[known]] == low[known])
        return np.where(known, found, -1)


IN_SHARD = ["k1", "k2", "p1", "p2", "depth", "conv_id", "n_convs", "size", "n_children", "n_leaves", "saved_tokens"]
OUT_SHARD = ["k1", "k2", "p1", "p2", "depth", "conv_id", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def summed(nodes: pa.Table) -> pa.Table:
    """The nodes of a shard with the totals of their subtrees; those below other shards come in as counts.

    ``parent`` is the parent's conv_id where the parent is in the shard.
    """
    column = {name: nodes.column(name).to_numpy().astype(np.int64) for name in IN_SHARD}
    table = NodeTable(column["k1"], column["k2"])
    at = {name: np.empty(nodes.num_rows, np.int64) for name in IN_SHARD}       # by slot
    for name, values in column.items():
        at[name][table.slots] = values
    up = table.find(at["p1"], at["p2"])
    up[at["depth"] == 0] = -1
    if np.any(at["depth"][up[up >= 0]] + 1 != at["depth"][up >= 0]):
        raise ValueError("two nodes have the same name")
    inner = up >= 0
    np.add.at(at["n_children"], up[inner], 1)
    at["n_leaves"] += at["n_children"] == 0
    at["saved_tokens"] += (at["n_convs"] - 1) * at["size"]
    deepest_first = np.argsort(-at["depth"], kind="stable")
    cuts = np.flatnonzero(np.diff(at["depth"][deepest_first])) + 1
    for level in np.split(deepest_first, cuts):
        level = level[inner[level]]
        for total in ("n_leaves", "saved_tokens"):
            np.add.at(at[total], up[level], at[total][level])
    at["parent"] = np.where(inner, at["conv_id"][up], 0)
    return pa.table([pa.array(at[n], mask=~inner) if n == "parent" else pa.array(at[n]) for n in OUT_SHARD], names=OUT_SHARD)


def summed_shards(nodes: DataFrame, shard: str) -> DataFrame:
    return nodes.select(shard, *IN_SHARD).groupBy(shard).applyInArrow(summed, ", ".join(f"{n} long" for n in OUT_SHARD))


def turn_name(depth: Column) -> tuple[Column, Column]:
    """Two hashes of a turn at its depth; ``a1`` and ``a2`` are the digest of its role and text."""
    return F.xxhash64(depth, F.col("a1"), F.col("a2")), F.xxhash64(F.col("a2"), F.col("a1"), depth, F.lit("second"))


def numbered_turns(talks: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(turns, parts). Turns sorted by conversation and turn over ranges that cut long conversations; parts tell for
    each range and conversation where its turns begin."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    word = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("long")
    plain = talks.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"),
                                                             F.octet_length(text).cast("long").alias("size"))
    plain = plain.select("conv_id", "turn", word(1).alias("a1"), word(17).alias("a2"), "size")
    order = ["conv_id", "turn", "a1", "a2"]                                     # NULL comes first
    tasks = int(talks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = staged(plain.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
                   .select("conv_id", "a1", "a2", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "turns")
    parts = turns.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    of_conv = Window.partitionBy("conv_id")                                     # a row per range at most
    before = F.coalesce(F.sum("n").over(of_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns, staged(parts.select("conv_id", "part", "first", before.alias("before"), F.sum("n").over(of_conv).alias("total")), "parts")


def rebuilt(turns: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, convs): every turn of every rebuilt conversation with its prefix's name, and the conversations' lengths.

    Members: conv_id, depth, k1, k2 (name), p1, p2 (name of the prefix without the turn), a1, a2, size, length.
    """
    index = F.col("row") - F.col("first") + F.col("before")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    lead = (turns.filter(F.col("conv_id") % FAMILY == 0).join(parts.filter(F.col("before") < LONGEST_HEAD).drop("total"), ["conv_id", "part"])
            .withColumn("i", index).filter(F.col("i") < LONGEST_HEAD)
            .groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "a1", "a2", "size"))).alias("lead")))   # eight at most
    convs = parts.filter("before = 0").select("conv_id", "total", (F.crc32(F.col("conv_id").cast("string")) % (LONGEST_HEAD + 1)).alias("h"), base.alias("base"))
    convs = convs.join(lead, "base", "left").withColumn("head", F.slice(F.coalesce("lead", F.expr("array()").cast(lead.schema["lead"].dataType)), F.lit(1), F.col("h").cast("int")))
    convs = staged(convs.select("conv_id", "h", "head", F.size("head").cast("long").alias("n_head"),
                                (F.size("head") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length")), "convs")

    named = lambda df: df.select("*", *(n.alias(c) for n, c in zip(turn_name(F.col("depth")), ("f1", "f2"))))
    heads = named(convs.select("conv_id", "length", F.posexplode("head").alias("i", "t")).select(
        "conv_id", "length", (F.col("i") + 1).cast("long").alias("depth"), "t.a1", "t.a2", "t.size", F.lit(0).alias("part")))
    starts = parts.select("conv_id", "part", "first", "before").join(convs.select("conv_id", "h", "n_head", "length"), "conv_id")
    tails = named(turns.join(starts, ["conv_id", "part"]).withColumn("i", index).filter("i >= h").select(
        "conv_id", "length", (F.col("n_head") + F.col("i") - F.col("h") + 1).alias("depth"), "a1", "a2", "size", (F.col("part") + 1).alias("part")))
    # running totals within a range, then of whole ranges: few rows a conversation
    run = Window.partitionBy("conv_id", "part").orderBy("depth")
    total = lambda c, w: F.expr(f"bit_xor({c})").over(w)
    pieces = staged(heads.unionByName(tails).select("*", total("f1", run).alias("r1"), total("f2", run).alias("r2")), "pieces")
    ranges = pieces.groupBy("conv_id", "part").agg(F.expr("bit_xor(f1)").alias("t1"), F.expr("bit_xor(f2)").alias("t2"))
    so_far = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("conv_id", "part", *(F.coalesce(total(t, so_far), F.lit(0)).alias(b) for t, b in (("t1", "b1"), ("t2", "b2"))))
    k1, k2 = F.col("r1").bitwiseXOR(F.col("b1")), F.col("r2").bitwiseXOR(F.col("b2"))
    members = pieces.join(ranges, ["conv_id", "part"]).select(
        "conv_id", "depth", "length", "a1", "a2", "size", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("f1")).alias("p1"), k2.bitwiseXOR(F.col("f2")).alias("p2"))
    return staged(members, "members"), convs.select("conv_id", "length")


def distinct_nodes(members: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix, the textless root included; two prefixes of one name stop the run."""
    same = [F.max(c).alias(f"{c}_to") for c in ("depth", "a1", "a2")]
    found = members.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("length").alias("length"), F.min("size").alias("size"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), *(F.min(c).alias(c) for c in ("depth", "a1", "a2")), *same)
    clash = (F.col("depth") != F.col("depth_to")) | (F.col("a1") != F.col("a1_to")) | (F.col("a2") != F.col("a2_to")) | ((F.col("k1") == 0) & (F.col("k2") == 0))
    sure = F.when(clash, F.raise_error(F.lit("two nodes have the same name"))).otherwise(F.col("n_convs"))
    columns = ["k1", "k2", "p1", "p2", "depth", "conv_id", "n_convs", "size", "length"]
    found = found.withColumn("n_convs", sure.cast("long")).select(*columns)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("length").cast("long").alias("length")).filter("n_convs > 0").select(
        *(zero.alias(c) for c in columns[:5]), "conv_id", "n_convs", zero.alias("size"), "length")
    return staged(found.unionByName(root), "nodes")


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, ends_sha256) of sorted runs of (k1, k2, ids); holds one hash state, whatever the length of a run."""
    node, state = None, None
    for batch in batches:
        done = []
        for key in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if key[:2] == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key[:2], hashlib.sha256()
            state.update(key[2].encode())
        yield _digests(done)
    if node is not None:
        yield _digests([(*node, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    k1, k2, digest = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(digest, pa.string())], ["k1", "k2", "ends_sha256"])


def ends_of(members: DataFrame, convs: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of nodes at which conversations end. Ids are joined in blocks before they travel; the last
    step reads a node's blocks in order, as the digest demands."""
    last = members.filter("depth = length").select("k1", "k2", "conv_id").unionByName(
        convs.filter("length = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id"))
    blocks = last.groupBy("k1", "k2", F.expr(f"shiftright(conv_id, {BLOCK_IDS})").alias("block")).agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string"))).alias("ids"))
    ordered = blocks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block").select("k1", "k2", "ids")
    return ordered.mapInArrow(joined_ids, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(talks: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tops: int = TOPS,
                shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    Conversation c is rebuilt from the first h turns of c - c % 5 (all if fewer, none if absent) and its own turns after
    its first h, where h is crc32(decimal c) % 9. Turns are ordered by ``turn``, NULL first, ties by the digest of role and
    text; NULL roles and texts are empty; a repeated row is another turn. Rows without a conversation id belong to none
    and are left out. An empty table gives no rows; other columns are ignored.
    """
    spark = talks.sparkSession
    turns, parts = numbered_turns(talks, conv_col, turn_col, role_col, text_col)
    members, convs = rebuilt(turns, parts)
    nodes = distinct_nodes(members, convs)
    sizes = nodes.agg(F.sum("n_convs").alias("members"), F.count(F.when(F.col("n_convs") > 1, 1)).alias("shared")).first()
    heavy_from = max(2, (sizes.members or 0) // tops + 1)                       # so at most ``tops`` nodes, and the root
    zero = F.lit(0).cast("long")

    single = nodes.filter("n_convs = 1")
    shared = nodes.filter("n_convs > 1")
    # the highest single nodes, and how many each shared node has: a leaf each
    first = single.filter("depth > 0").groupBy("conv_id").agg(F.min(F.struct("depth", "k1", "k2", "p1", "p2")).alias("t")).select("conv_id", "t.*")
    first = staged(first if sizes.shared else first.limit(0), "first")                  # one conversation shares nothing
    below = first.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_single"))
    shared = staged(shared.join(below, ["k1", "k2"], "left").withColumn("n_single", F.coalesce("n_single", F.lit(0))), "shared")

    is_top = (F.col("n_convs") >= heavy_from) | (F.col("depth") == 0)
    top, light = shared.filter(is_top), shared.filter(~is_top)
    names = F.broadcast(top.select(F.col("k1").alias("t1"), F.col("k2").alias("t2")))   # at most ``tops`` + 1
    under_top = members.join(names, (F.col("p1") == F.col("t1")) & (F.col("p2") == F.col("t2")), "left_semi")
    highest = under_top.join(names, (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")), "left_anti").select(
        "conv_id", F.xxhash64("k1", "k2").alias("subtree"))                             # one row a conversation at most
    shards = max(1, -(-(sizes.shared or 0) // shard_nodes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = [F.col("n_single").alias("n_children"), F.col("n_single").alias("n_leaves"), zero.alias("saved_tokens")]
    dealt = light.join(highest, "conv_id").withColumn("shard", F.pmod("subtree", F.lit(shards)))
    low = staged(summed_shards(dealt.select("shard", *IN_SHARD[:8], *own), "shard"), "low")
    handed = low.filter("parent IS NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    more = lambda own, name: (F.col(own) + F.coalesce(name, F.lit(0))).alias({"c": "n_children", "l": "n_leaves"}[name])
    high = summed_shards(top.join(handed, ["k1", "k2"], "left").select(zero.alias("shard"), *IN_SHARD[:8], more("n_single", "c"), more("n_single", "l"),
                                                                      F.coalesce("s", zero).alias("saved_tokens")), "shard")
    high = staged(high, "high")
    # the highest nodes of a shard, and single nodes below shared ones, look their parent up; it can be a hot one
    wanted = ["p1", "p2"]
    shared_ids = low.select("k1", "k2", "conv_id", "n_children").unionByName(high.select("k1", "k2", "conv_id", "n_children")).select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"), F.col("n_children").alias("weight"))
    open_nodes = low.filter("parent IS NULL").select("k1", "k2", *wanted).unionByName(first.select("k1", "k2", *wanted))
    parents = spread_lookup(open_nodes, shared_ids, wanted, "inner", right_weight="weight", spread_by=["k1", "k2"]).select("k1", "k2", F.col("parent").alias("found"))

    alone = single.select("k1", "k2", "depth", "conv_id", F.when(F.col("depth") > 0, F.col("conv_id")).alias("parent"), "n_convs",
                          (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"))
    several = low.unionByName(high).drop("p1", "p2")
    told = alone.unionByName(several).join(parents, ["k1", "k2"], "left").join(ends_of(members, convs), ["k1", "k2"], "left")
    return told.select("conv_id", "depth", F.coalesce("found", "parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
