"""Problem 2: cut oversized texts at natural boundaries into overlapping pieces, all cuts of all texts in parallel.

Every code point position of a text is a possible cut. A cut at ``e`` ends one piece; the next piece begins at ``e - overlap`` and its own
cut is the farthest position of the best kind within the limit: that is the *successor* of ``e``, found for all positions at once.
Squaring the successor table (pointer doubling) marks the whole chain of greedy cuts of every text of a block in about log2(pieces) steps.

Kinds of boundary, best first: after a blank line, after a line break, after a sentence mark and white space, after white space, between
two grapheme clusters, anywhere. A kind counts if it has a position in the second half of the window; neighbours share exactly
``overlap`` code points.

Defined results: only texts of more than ``size`` code points come out; null, empty and short texts give no rows. Rows with one id are
one item (copies count once; of different rows with one id the least text is taken). A null id is an item of its own row. The columns
that the operator adds replace columns of the same names; columns that are not asked for are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.codepoints import Flat, blocks, general

SIZE, OVERLAP = 1000, 150

# Marks that end a sentence, and the marks that may close it.
ENDS, CLOSERS = ".!?…。！？｡．؟۔।॥", "\"')]}»”’」』）】》"
NONE, LINE, SPACE, END, CLOSE, JOINS = 0, 1, 2, 3, 4, 5


@cache
def classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    out[general() == ord("Z")] = SPACE
    out[[0x09, 0x0B, 0x0C, 0x0D]] = SPACE
    out[[0x0A, 0x85, 0x2028, 0x2029]] = LINE
    out[[ord(c) for c in ENDS]], out[[ord(c) for c in CLOSERS]] = END, CLOSE
    out[general() == ord("M")] = JOINS
    out[[0x200C, 0x200D, 0xFE0E, 0xFE0F]] = JOINS
    return out


def kinds(flat: Flat) -> list[np.ndarray]:
    """For each kind of boundary, best first, True at the positions (ends of pieces) that are one."""
    kind = classes()[flat.cps]
    n = len(kind)
    line, space, mark = kind == LINE, kind == SPACE, kind == END
    white = line | space
    place = np.arange(n)

    def last(mask: np.ndarray) -> np.ndarray:  # the last position at or before each where mask holds, else -1
        return np.maximum.accumulate(np.where(mask, place, -1))

    solid = last(~white)  # the last code point that is not white space
    breaks = np.concatenate([[0], np.cumsum(line)])
    here = white & np.append(~white[1:], True)  # a run of white space ends here
    in_run = breaks[place + 1] - breaks[solid + 1]
    body = last(~(white | (kind == CLOSE)))  # what stands before closing marks and white space
    sentence = here & (solid >= 0) & mark[np.maximum(body, 0)]
    tight = mark & (flat.cps >= 0x0600)  # the marks of scripts that put no space after them
    cluster = kind != JOINS
    before = flat.cps != 0x200D
    out = [here & (in_run >= 2), here & (in_run >= 1), sentence | tight, here]
    ends = [np.concatenate([[False], m[:-1]]) for m in out]
    return [*ends, cluster & np.concatenate([[True], before[:-1]]) & ~((flat.cps == 10) & np.concatenate([[False], flat.cps[:-1] == 13]))]


def cuts(texts: list[str], size: int = SIZE, overlap: int = OVERLAP) -> list[np.ndarray]:
    """The ends of the pieces of each text."""
    flat = Flat(texts)
    n, place = len(flat.cps), np.arange(len(flat.cps))
    start_of = np.repeat(flat.starts, flat.lens + 1)
    end_of = start_of + np.repeat(flat.lens, flat.lens + 1)
    best = [np.maximum.accumulate(np.where(m, place, -1)) for m in kinds(flat)]

    def successor(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        high = np.minimum(begin + size, end)
        low = begin + max(size // 2, overlap)
        out = np.where(high == end, end, -1)
        for at in best:
            found = at[np.minimum(high, n - 1)]
            out = np.where((out < 0) & (found > low), found, out)
        return np.where(out < 0, high, out)

    step = np.where(place >= end_of, end_of, successor(np.maximum(place - overlap, start_of), end_of))
    reached = np.zeros(n, bool)
    reached[successor(flat.starts, flat.seps)] = True
    while True:
        more = np.zeros(n, bool)
        more[step[reached]] = True
        if not (more & ~reached).any():
            break
        reached |= more
        step = step[step]
    return np.split(np.flatnonzero(reached) - start_of[reached], np.cumsum(np.bincount(flat.owner(np.flatnonzero(reached)), minlength=len(texts)))[:-1])


def split_oversized(items: DataFrame, key: str = "id", text: str = "text", carry: tuple[str, ...] = ("section_title", "chunk_position"), size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, *carry, piece, start, end, text) for every piece of every item whose text has more than ``size`` code points.

    Only oversized texts are shuffled, once, to count copies once; the cutting itself is a narrow map.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap must be less than half of size")
    carry = tuple(c for c in carry if c not in (key, text, "piece", "start", "end"))
    large = items.filter(F.char_length(text) > size).select(key, *carry, text)
    once = large.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(text, *carry)).alias("_")).select(key, *[F.col(f"_.{c}").alias(c) for c in (*carry, text)])
    once = once.unionByName(large.filter(F.col(key).isNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            texts = block.column(text).to_pylist()
            ends = cuts(texts, size, overlap)
            row = np.repeat(np.arange(len(texts)), [len(e) for e in ends])
            piece = np.concatenate([np.arange(len(e)) for e in ends])
            end = np.concatenate(ends)
            start = np.where(piece == 0, 0, np.concatenate([[0], end[:-1]]) - overlap)
            cut = [texts[r][a:b] for r, a, b in zip(row.tolist(), start.tolist(), end.tolist())]
            kept = [block.column(c).take(pa.array(row)) for c in (key, *carry)]
            ints = [pa.array(v.astype(np.int32)) for v in (piece, start, end)]
            yield pa.RecordBatch.from_arrays([*kept, *ints, pa.array(cut, pa.string())], [key, *carry, "piece", "start", "end", text])

    kept = ", ".join(f"`{c}` {once.schema[c].dataType.simpleString()}" for c in (key, *carry))
    return once.mapInArrow(run, f"{kept}, piece int, start int, end int, `{text}` string")
