"""Problem 6: encode every text of a corpus with a public byte-level BPE vocabulary.

Pre-tokenisation works on whole blocks of texts at once. Every code point gets a class, a nine-state machine is run over the classes as an
associative scan (runs, blanks that are glued to what follows, and contractions, which only an apostrophe that begins a piece can open),
and the state before a code point with its class tells whether a piece starts there. Pieces are slices of the UTF-8 buffer; each distinct
piece is merged once per worker and then looked up. The vocabulary is read once by the driver and sent to the workers (1 MB).

Defined results: a null text and an empty text give an empty list; text that spells a special token is ordinary text; equal texts give
equal lists; other columns are not read. One row comes out for every row that goes in.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.codepoints import Flat, blocks, general, scan

VOCABULARY = os.environ.get("GROUNDLINE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Distinct pieces that a worker keeps; beyond this the cache starts anew, which costs time and changes no result.
CACHE = 400_000

# The White_Space code points of Unicode, and the contractions of the pre-tokenisation pattern.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")

# classes; BLANK is the plain space, END lies between two texts, SHORT and LONG are letters that can end or go on with a contraction
LETTER, NUMBER, OTHER, BLANK, SPACE, END, APOSTROPHE, SHORT, LONG = range(9)
# states: what the code point before was; MARK is an apostrophe that begins a piece, HALF and DONE lie inside and behind a contraction
START, IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, GLUE, MARK, HALF, DONE = range(9)


@cache
def classes() -> np.ndarray:
    major = general()
    out = np.full(0x110000, OTHER, np.uint8)
    out[major == ord("L")], out[major == ord("N")] = LETTER, NUMBER
    out[list(WHITE)] = SPACE
    out[0x20], out[ord("'")] = BLANK, APOSTROPHE
    out[[ord(c) for c in CONTRACTIONS if len(c) == 1]] = SHORT
    return out


def _step(kind: int, state: int) -> int:
    if state == HALF and kind in (LETTER, SHORT, LONG):
        return DONE
    if state == MARK and kind in (SHORT, LONG):
        return DONE if kind == SHORT else HALF
    if kind == APOSTROPHE:
        return IN_OTHER if state in (IN_OTHER, MARK, GLUE) else MARK
    return {NUMBER: IN_NUMBER, OTHER: IN_OTHER, BLANK: GLUE, SPACE: IN_SPACE, END: START}.get(kind, IN_LETTER)


def _begins(kind: int, state: int) -> bool:
    goes_on = {
        LETTER: (IN_LETTER, GLUE, HALF),
        NUMBER: (IN_NUMBER, GLUE),
        OTHER: (IN_OTHER, MARK, GLUE),
        APOSTROPHE: (IN_OTHER, MARK, GLUE),
        BLANK: (IN_SPACE, GLUE),
        SPACE: (IN_SPACE, GLUE),
        END: (),
    }
    return state not in goes_on.get(kind, (IN_LETTER, GLUE, HALF, MARK))


@cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """(the next state, whether a piece starts) by class and state before."""
    pairs = [[(k, s) for s in range(9)] for k in range(9)]
    return np.array([[_step(*p) for p in row] for row in pairs], np.uint8), np.array([[_begins(*p) for p in row] for row in pairs])


def piece_starts(flat: Flat) -> np.ndarray:
    """True at every code point where a piece starts, and at every separator."""
    kind = classes()[flat.cps]
    kind[flat.seps] = END
    following = np.append(flat.cps[1:], 0)
    for word in CONTRACTIONS:
        if len(word) == 2:
            kind[(flat.cps == ord(word[0])) & (following == ord(word[1]))] = LONG
    steps, begins = machine()
    starts = begins[kind, scan(steps, kind)]
    white = (kind == BLANK) | (kind == SPACE)
    visible = np.append(~white[1:] & (kind[1:] != END), False)
    return starts | (white & visible)  # the last white space before a visible code point stands apart from its run


def ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in data.splitlines() if line.strip())}


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Pair merging as defined: the adjacent pair of least rank first, the leftmost among equals; n log n in the length of the piece."""
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    waiting = [(rank[a + b], i, len(a + b)) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
    heapify(waiting)
    while waiting:
        _, i, size = heappop(waiting)
        j = right[i]
        if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
            continue  # one of both has grown or gone since
        parts[i], parts[j], right[i] = parts[i] + parts[j], None, right[j]
        if right[j] < len(parts):
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < len(parts) and parts[a] + parts[b] in rank:
                heappush(waiting, (rank[parts[a] + parts[b]], a, len(parts[a]) + len(parts[b])))
    return [rank[p] for p in parts if p is not None]


def merger(rank: dict[bytes, int]):
    """The merge of one piece: the compiled one where its library is there, else the plain one above."""
    try:
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=rank, special_tokens={})
        return own._core_bpe.encode_single_piece
    except (ImportError, AttributeError):
        return lambda piece: merge(piece, rank)


class Pieces(dict):
    """Piece -> its number; the ids of all pieces lie in one array, so that a block is encoded by two lookups."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.ids, self.first = merge, [], [0]

    def __missing__(self, piece: bytes) -> int:
        self.ids += self.merge(piece)
        self.first.append(len(self.ids))
        self[piece] = number = len(self.first) - 2
        return number


class Vocabulary:
    """A vocabulary with the pieces that a worker has merged."""

    def __init__(self, data: bytes):
        self.merge = merger(ranks(data))
        self.pieces = Pieces(self.merge)

    def known(self) -> Pieces:
        if len(self.pieces) > CACHE:
            self.pieces = Pieces(self.merge)
        return self.pieces


@cache
def read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read(path))


_KEPT: dict[str, Vocabulary] = {}


def _sent_vocabulary(name: str, sent: Broadcast) -> Vocabulary:
    """The vocabulary of a broadcast, built once in a worker and kept until another one comes."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Vocabulary(sent.value)
    return _KEPT[name]


def encode_block(texts: list[str | None], words: Vocabulary | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of each text in them, for every id the code point at which its piece starts in its text)."""
    flat = Flat(texts)
    at = np.flatnonzero(piece_starts(flat))
    size = 1 + (flat.cps >= 0x80) + (flat.cps >= 0x800) + (flat.cps >= 0x10000)
    place = np.concatenate([[0], np.cumsum(size)])
    data = flat.joined.encode("utf-8")
    owner = flat.owner(at)
    real = at != flat.seps[owner]
    cut = place[at].tolist()
    cut.append(len(data))
    slices = [data[a:b] for a, b, r in zip(cut, cut[1:], real.tolist()) if r]
    known = (words or vocabulary(VOCABULARY)).known()
    number = np.fromiter(map(known.__getitem__, slices), np.int64, len(slices))
    first, pool = np.array(known.first), np.array(known.ids, np.int32)
    count = first[number + 1] - first[number]
    ends = np.cumsum(count)
    ids = pool[np.repeat(first[number] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
    per_text = np.bincount(owner[real], weights=count, minlength=len(texts)).astype(np.int64)
    offsets = np.repeat((at - flat.starts[owner])[real], count)
    return ids, np.concatenate([[0], np.cumsum(per_text)]), offsets


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """(key, ids) for every row, and with ``offsets`` the code point where the piece of each id starts. Nothing is shuffled."""

    sent, name = docs.sparkSession.sparkContext.broadcast(read(path)), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _sent_vocabulary(name, sent)
        for block in blocks(batches, text):
            ids, ends, at = encode_block(block.column(text).to_pylist(), words)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v.astype(np.int32))) for v in ([ids, at] if offsets else [ids])]
            yield pa.RecordBatch.from_arrays([block.column(key), *lists], [key, "ids", "offsets"][: 1 + len(lists)])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>" + ", offsets array<int>" * offsets)


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    back = _bytes_of(path)
    return b"".join(back[i] for i in ids).decode("utf-8")


@cache
def _bytes_of(path: str) -> dict[int, bytes]:
    return {rank: piece for piece, rank in ranks(read(path)).items()}
