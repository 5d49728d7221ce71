"""Secrets in texts: key patterns, and random strings by their low number of characters per token."""
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
RATIO = 2.0               # strings with fewer characters per token look random
LEAST = 20                # characters of a candidate string
# fixed values: the base patterns and the least lengths of what they must match
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}", re.A)       # AKIA[A-Z0-9]+ of 16 or more: a run is taken whole either way
HEX = re.compile(r"[0-9a-f]{32,}", re.A)              # [0-9a-f]+ of 32 or more, likewise
ASSIGN_VALUE = 8
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST, re.A)
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})\Z", re.A)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z", re.A)
PARTS = re.compile(r"[+/_=-]+|(?<=[a-z])(?=[A-Z])")
NAME_PART = re.compile(r"(?:[A-Za-z]?[a-z]*|[A-Z]+|[0-9]{1,8}|v[0-9]+)\Z", re.A)
PIECE = re.compile(r"[A-Za-z0-9]+", re.A)              # what separators part
READABLE = 4              # letters of a piece that can end a random run: shorter ones also occur within keys
NUMBER = re.compile(r"[0-9+/_=-]+\Z", re.A)

_encoders: dict = {}


def encoder(path: str | None):
    """tiktoken encoding of a rank file, one for each worker; without a path the public byte-level vocabulary."""
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken
        with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def named(string: str, encode, ratio: float = RATIO) -> bool:
    """Whether the parts of an identifier look like words or short numbers, and each of its words makes few tokens."""
    parts = PARTS.split(string)
    return all(NAME_PART.match(p) for p in parts) and all(len(p) < 2 or p.isdigit() or len(p) >= ratio * len(encode(p)) for p in parts)


def known(string: str, encode, ratio: float = RATIO) -> bool:
    """Digests of usual lengths, UUIDs, numbers, and identifiers made of words and short numbers."""
    return bool(DIGEST.match(string) or UUID.match(string) or NUMBER.match(string) or named(string, encode, ratio))


def random_spans(string: str, encode, ratio: float = RATIO) -> list[list[tuple[int, int]]]:
    """Places in a candidate that look random: the whole, then the runs of its pieces between the readable ones.

    Three levels, each within the one before it: the whole, the widest of the others, and pieces inside of those. The
    places of a level are in order and apart.
    """
    looks = lambda s: len(s) >= LEAST and not known(s, encode, ratio) and len(s) < ratio * len(encode(s))
    pieces = [m.span() for m in PIECE.finditer(string)]
    runs, run = [], None
    for a, b in pieces:
        if b - a >= READABLE and string[a:b].isalpha() and named(string[a:b], encode, ratio):
            run = None
        elif run is None:
            run = [a, b]
            runs.append(run)
        else:
            run[1] = b
    places = {tuple(r) for r in runs} | set(pieces)          # a piece may be random where its run is not
    inner, within = [], []
    for a, b in sorted(places - {(0, len(string))}, key=lambda p: (p[0], -p[1])):
        if looks(string[a:b]):
            (within if inner and b <= inner[-1][1] else inner).append((a, b))
    return [[(0, len(string))] if looks(string) else [], inner, within]


class Taken:
    """Places already taken, as disjoint stretches in order; whether a place is free takes a binary search."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i == len(self.starts) or self.starts[i] >= b


def text_spans(text: str, encode, ratio: float = RATIO) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind, end, value) by start, then kind. Random strings never overlap a base span."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    tried = []
    for m in CANDIDATE.finditer(text):  # a hex run of 32 lies within a candidate of 20
        found += [(h.start(), 2, h.end(), h[0]) for h in HEX.finditer(text, m.start(), m.end())]
        tried.append((m.start(), random_spans(m[0], encode, ratio)))
    base = Taken((a, b) for a, _, b, _ in found)
    for at, levels in tried:   # of spans within one another the widest that is free
        mine: list[tuple[int, int]] = []
        for spans in levels:
            here = Taken(mine)
            mine += [(a, b) for a, b in spans if base.free(at + a, at + b) and here.free(a, b)]
        found += [(at + a, 3, at + b, text[at + a:at + b]) for a, b in mine]
    return sorted(found)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """One row per input row: doc_id and ``spans``, an array of (kind, start, end, value) by start, then kind.

    Offsets are code points, the end is exclusive. Kinds: assign, access, hex (base patterns), random (at least 20
    characters of which fewer than ``ratio`` make a token, and no digest, UUID, number or identifier of words that make few
    tokens; judged as a whole, and by the runs and pieces between separators where the whole is readable). NULL and empty
    texts have no spans; repeated rows are judged each; an empty table gives no rows; other columns are ignored.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "value": v} for a, k, b, v in text_spans(t.as_py() or "", encode, ratio)]
                     for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(scan, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,value:string>>")
