"""Batches of text as one flat array of code points, and state machines run over it as an associative scan."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points handled together inside a task: bounds the memory of the arrays, not the length of a text.
BLOCK = 2_000_000


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Cut record batches where the text in ``column`` passes ``most`` bytes; one longer text stands alone."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


class Flat:
    """The texts of a block, each followed by one separator position."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        self.joined = "\n".join([*texts, ""])
        self.cps = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        self.lens = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(self.lens + 1)
        self.starts = ends - self.lens - 1
        self.seps = ends - 1

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The index of the text that holds each position."""
        return np.searchsorted(self.seps, at)


@cache
def categories(of: Callable[[str], int]) -> np.ndarray:
    """A class for every code point, from a rule on characters; built once in a worker."""
    return np.fromiter((of(chr(c)) for c in range(0x110000)), np.uint8, 0x110000)


@cache
def general() -> np.ndarray:
    """The major general category of every code point as its first letter's byte."""
    return categories(lambda c: ord(unicodedata.category(c)[0]))


def scan(table: np.ndarray, symbols: np.ndarray, start: int = 0, width: int = 1024) -> np.ndarray:
    """The state *before* each symbol, of the machine ``table[symbol, state] -> state``.

    The symbols are cut into chunks; each chunk becomes the function state -> state that it computes, chunk functions are composed by
    a parallel prefix scan (Hillis-Steele), and every chunk is replayed from its own entry state. All chunks advance together.
    """
    n, states = len(symbols), table.shape[1]
    if n == 0:
        return np.zeros(0, np.uint8)
    flat = np.ascontiguousarray(table).ravel().astype(np.intp)
    width = max(16, min(width, int(n**0.5) + 1))
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.intp)
    np.multiply(symbols, states, out=padded[:n], casting="unsafe")
    columns = np.ascontiguousarray(padded.reshape(rows, width).T)
    step = np.repeat(np.arange(states, dtype=np.intp)[:, None], rows, 1)
    if rows > 1:
        for column in columns:
            step += column
            flat.take(step, out=step, mode="clip")
        shift = 1
        while shift < rows:
            step[:, shift:] = np.take_along_axis(step[:, shift:], step[:, :-shift].copy(), axis=0)
            shift *= 2
    now = np.empty(rows, np.intp)
    now[0], now[1:] = start, step[start, :-1]
    out = np.empty((width, rows), np.uint8)
    for j, column in enumerate(columns):
        out[j] = now
        now += column
        flat.take(now, out=now, mode="clip")
    return out.T.reshape(-1)[:n]
