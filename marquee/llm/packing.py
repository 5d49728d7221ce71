"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, group by group."""
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .bytescan import blocks, text_bytes

VOCABULARY = "byte_bpe_50k.json"
END = 1                   # id that ends a document
LENGTH = 2048             # most tokens of a sequence
GROUP_DOCS = 2048         # documents of a group, on average
LEAST_CUT = 64            # shorter gaps are not filled with cuttings
BLOCK_BYTES = 1 << 22     # bytes of text that are cut and encoded together
CACHED = 400_000          # strings whose ids a worker remembers

_tokenizers: dict = {}


class Encoder:
    """Ids of whole texts as little-endian 16-bit integers (32-bit if the vocabulary needs them).

    Texts are cut on their bytes at all places that no token can cross; each distinct string of a block is looked up or
    encoded once.
    """

    def __init__(self, path: str | None):
        import os

        import public_tokenizers
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # a task has one core; threads would only spin
        self.model = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = "<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.ids: dict[bytes, bytes] = {}

    def learn(self, strings: list[bytes]) -> None:
        for s, e in zip(strings, self.model.encode_batch_fast([s.decode() for s in strings], add_special_tokens=False)):
            self.ids[s] = array(self.code, e.ids).tobytes()

    def block(self, data: np.ndarray, at: np.ndarray, end: int) -> pa.Array:
        """Binary array of each text's ids and ``end``."""
        last = np.array([end], dtype=self.kind).tobytes()
        starts = cuts(data)
        starts[at[:-1][at[1:] > at[:-1]]] = True
        starts = np.flatnonzero(starts)
        bounds = np.append(starts, len(data))
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = strings.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [s for s in distinct if s not in self.ids]
        if len(self.ids) + len(new) > CACHED:
            self.ids.clear()
            new = distinct
        self.learn(new)
        known = pa.array([*map(self.ids.__getitem__, distinct), last], pa.large_binary())
        first = np.searchsorted(starts, at)                       # strings before each text
        order = np.insert(coded.indices.to_numpy().astype(np.int64), first[1:], len(distinct))
        taken = known.take(pa.array(order))
        _, offsets, body = taken.buffers()
        offsets = np.frombuffer(offsets, np.int64)[taken.offset:taken.offset + len(taken) + 1]
        ends = offsets[first + np.arange(len(at))]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends)), body])


GRAPHIC, LETTER, MARK = (np.zeros(256, dtype=bool) for _ in range(3))
GRAPHIC[0x21:0x7F] = True
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK |= GRAPHIC & ~LETTER
MARK[0x30:0x3A] = False


def cuts(data: np.ndarray) -> np.ndarray:
    """True where a text can be cut before a byte without changing its ids.

    That is before a space next to a solid character on either side, before a line end after a solid character and after
    it if a solid character follows, between a letter and an ASCII mark, and between a mark and a letter unless the mark
    is an apostrophe, which could begin a contraction. Solid are ASCII characters above the space and characters whose
    first byte begins no white space in Unicode; letters are the ASCII ones and those of U+00C0 to U+00FF.
    """
    n = len(data)
    here = np.concatenate((np.zeros(3, np.uint8), data, np.zeros(1, np.uint8)))        # here[i + 3] is data[i]
    at = lambda back: here[3 - back:3 - back + n]
    times = (at(1) == 0x97) | (at(1) == 0xB7)
    letter_before = LETTER[at(1)] | (at(2) == 0xC3) & ~times
    two, more = (at(2) >= 0xC3) & (at(2) <= 0xDF), at(3) >= 0xE4
    solid_before = GRAPHIC[at(1)] | two | more
    opens = lambda b: GRAPHIC[b] | (b >= 0xC3) & (b <= 0xDF) | (b >= 0xE4)
    space, line = data == 0x20, data == 0x0A
    found = space & (solid_before | opens(at(-1))) | line & solid_before
    found[1:] |= line[:-1] & solid_before[:-1] & opens(data[1:])
    found |= MARK[data] & letter_before
    letter_here = LETTER[data] | (data == 0xC3) & (at(-1) != 0x97) & (at(-1) != 0xB7)
    return found | letter_here & MARK[at(1)] & (at(1) != 0x27)


def encoder(path: str | None) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def tokenized(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """(doc_id, text, lot) to (doc_id, lot, ids): the text's ids and ``end``, packed as integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for first, data, at in blocks(batch.column(1), BLOCK_BYTES):
                part = batch.slice(first, len(at) - 1)
                ids = encode.block(data, at, end).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), ids], ["doc_id", "lot", "ids"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "lot").mapInArrow(run, f"doc_id {id_type}, lot bigint, ids binary")


def first_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, room left in each bin): longest items first, each into the first bin with room for it.

    The inner nodes of a tournament tree hold the largest room below them, so that bin is found from the root down.
    Equal sizes keep their order.
    """
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [length] * (2 * leaves)
    place = np.zeros(n, dtype=np.int64)
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        place[i] = node - leaves
        used = max(used, node - leaves + 1)
        tree[node] -= size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return place, np.array(tree[leaves:leaves + used], dtype=np.int64)


def layout(lengths: np.ndarray, length: int = LENGTH, least_cut: int = LEAST_CUT) -> list[tuple[int, int, int, int, int]]:
    """(document, start, size, sequence, offset) of every piece: gapless sequences that hold each token once.

    Full sequences are cut off the front of long documents, what remains is packed first-fit decreasing. Then the
    emptiest sequences are dissolved: their pieces are cut to fill gaps of at least ``least_cut`` in the others.
    """
    full = lengths // length
    pieces = [(d, k * length, length) for d in np.flatnonzero(full).tolist() for k in range(int(full[d]))]
    rest = np.flatnonzero(lengths - full * length)
    sizes = (lengths - full * length)[rest]
    place, room = first_fit_decreasing(sizes, length)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in room]
    for d, size, b in zip(rest.tolist(), sizes.tolist(), place.tolist()):
        bins[b].append((d, int(full[d]) * length, size))
    order = np.argsort(room, kind="stable").tolist()     # fullest first
    room = room.tolist()
    gaps = sum(room[b] for b in order if room[b] >= least_cut)
    open_bins = [b for b in order if room[b] >= least_cut]
    while len(open_bins) > 1:
        last = open_bins[-1]
        gaps_elsewhere = gaps - room[last]
        if length - room[last] > gaps_elsewhere:
            break
        gaps = gaps_elsewhere
        open_bins.pop()
        for d, start, size in bins[last]:
            while size:
                b = open_bins[0]
                take = min(size, room[b])
                bins[b].append((d, start, take))
                room[b] -= take
                gaps -= take
                start, size = start + take, size - take
                if not room[b]:
                    open_bins.pop(0)
        bins[last] = []
    out = [(d, start, size, s, 0) for s, (d, start, size) in enumerate(pieces)]
    s = len(pieces)
    for held in bins:
        if held:
            offset = 0
            for d, start, size in held:
                out.append((d, start, size, s, offset))
                offset += size
            s += 1
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, length: int = LENGTH,
         group_docs: int = GROUP_DOCS, end: int = END, seed: int = 11) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit integers).

    NULL and empty texts are documents of the end id alone; repeated rows and NULL ids are documents of their own; an
    empty table gives no rows; other columns are ignored. Documents are dealt to groups at random by row, not by key,
    so no id, text or source can fill a group; the rows must come from files or a checkpoint, where they keep their
    order when a task is repeated. A group holds about ``group_docs`` documents at any size of the corpus.
    """
    groups = max(1, -(-docs.count() // group_docs))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.floor(F.rand(seed) * groups).cast("long").alias("lot"))
    tokens = tokenized(plain, vocabulary, end)

    def packed(part: pa.Table) -> pa.Table:
        kind = encoder(vocabulary).kind
        width = int(kind[-1])
        part = part.append_column("n", pc.binary_length(part.column("ids")))
        part = part.take(pc.sort_indices(part, [("n", "ascending"), ("doc_id", "ascending"), ("ids", "ascending")])).combine_chunks()
        ids, sizes = part.column("ids").chunk(0), part.column("n").to_numpy().astype(np.int64) // width
        doc, start, size, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*layout(sizes, length)))
        data, at = text_bytes(ids)
        cut = [data[a:b].view(kind).astype("<u4").tobytes() for a, b in zip(((at[doc] + start * width).tolist()), ((at[doc] + (start + size) * width).tolist()))]
        names = part.column("doc_id").take(pa.array(doc))        # as Arrow values: NULLs leave the other ids as they are
        columns = {"doc_id": names, "start": start, "length": size, "doc_tokens": sizes[doc], "sequence_id": sequence + (part.column("lot")[0].as_py() << 28),
                   "offset": offset, "ids": pa.array(cut, pa.binary())}
        return pa.table(columns)

    id_type = plain.schema["doc_id"].dataType.simpleString()
    return tokens.groupBy("lot").applyInArrow(
        packed, f"doc_id {id_type}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
