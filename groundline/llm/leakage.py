"""Problem 7: corpus documents that contain an evaluation item, wholly or in good part.

Texts are compared by their skeleton: letters and digits alone, without case, accents and width, so that layout, hyphenation and
punctuation do not matter. Half of an item (of its skeleton) must stand in one place of the document within an error budget.

Counted pigeonhole: an error destroys at most ``q`` of the half + 1 - q pieces of length q of a half, so a half with e errors keeps
half + 1 - q(e + 1) of them. Every half, wherever it begins in the item, with e of up to ``ERRORS`` of its length is therefore verified,
wherever its errors stand; a changed word destroys its length + q - 1 pieces, so that more changes are found when they come in words.
All pieces of all items are searched, shared ones too, with hashes over flat arrays; their hits are counted by item and diagonal, in
windows that overlap by the longest item: first by wide cells of diagonals, where pieces that always follow each other count as one run, then
by parts of the cells, and only what has enough there is sorted and counted exactly. What has enough is verified with Myers' bit-parallel distance, many places at once, and the
share of the item that stands there is measured exactly by a local alignment.

Defined results: null and empty documents or items give no pair; an item whose half is shorter than a piece is found
only if its whole skeleton occurs;
equal items and equal documents give a pair each; rows with one key count once; extra columns are not read. The items are broadcast
up to ``ITEMS`` code points in all; a larger set is worked through in that many slices, each over all documents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.codepoints import Flat, blocks

#: Lengths of a piece in skeleton characters, for scripts with spaces and for those without.
PIECE, DENSE_PIECE = 6, 3
#: Errors, as a part of the half, up to which every half is verified wherever they stand.
ERRORS = 0.12
#: The errors allowed in the half, as a part of its length; and the part of the item that must be matched character by character in one
#: place: a little under one half, since each changed word takes its own length from it.
BUDGET, SHARE = 0.36, 0.42
#: Code points of items that are broadcast together.
ITEMS = 8_000_000
#: Positions of a text whose hits are counted together, hits held at once, and places verified together.
WINDOW, HELD, TOGETHER = 1 << 16, 4_000_000, 2048
WIDE = 1 << 31  # score and matches in one number
DIRECTORY = np.uint64(42)  # bits of a hash below those that its slot is found by
#: Bytes of documents worked through together.
BLOCK = 4_000_000
COUNTED, ALIGNED = 2048, 128  # places whose pieces are counted together, and that are aligned together
CELLS = 1 << 23  # pairs of item and cell of diagonals that are counted at once before the hits are sorted
ROOM = 1 << 23  # symbols of texts whose distances are taken at once
FINE = 3  # bits by which a cell is cut into parts
_KEPT: "dict[str, Items]" = {}
DENSE_FROM = 0x0E00  # Thai and everything after it, up to the scripts of East Asia, writes words without spaces


@cache
def folding() -> np.ndarray:
    """Code point -> its skeleton code point, 0 for one that is dropped."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalnum():
            to = [x for x in unicodedata.normalize("NFKD", c.casefold()) if x.isalnum()]
            out[code] = ord(to[0]) if to else 0
    return out


def pieces(cps: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all substrings of a length."""
    n = max(0, len(cps) - length + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        symbols = cps * np.uint64(0x9E3779B97F4A7C15)
        for k in range(length):
            h *= np.uint64(0x100000001B3)
            h += symbols[k : k + n]
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def directory(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """(the first of the sorted keys with each leading bits, -1 where there is none; the most keys that share them, less one)."""
    top = keys >> DIRECTORY
    slots = np.full(1 << 22, -1, np.int32)
    opens = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
    slots[top[opens]] = opens
    return slots, int(np.diff(np.append(opens, len(keys))).max()) - 1


def followed(follower: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The piece that follows each piece wherever it occurs in the items, and occurs nowhere else; -1 where there is none. follower: by posting."""
    least, most, count = np.minimum.reduceat(follower, first[:-1]), np.maximum.reduceat(follower, first[:-1]), np.diff(first)
    return np.where((least == most) & (least >= 0) & (count == count[least]), least, -1)


class Items:
    """The items of a slice with the postings of all their pieces."""

    def __init__(self, keys: list[int], texts: list[str]):
        table = folding()
        self.keys, self.skeletons, self.dense = [], [], []
        for key, text in zip(keys, texts):
            bare = table[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
            bare = bare[bare > 0]
            if len(bare):
                self.keys.append(key)
                self.skeletons.append(bare)
                self.dense.append(bool(((bare >= DENSE_FROM) & (bare < 0xAC00)).sum() * 2 > len(bare)))
        self.size = np.array([len(s) for s in self.skeletons], np.int64)
        self.half = -(-self.size // 2)
        length = np.where(np.array(self.dense, bool), DENSE_PIECE, PIECE)
        self.length = length
        self.need = np.maximum(1, self.half + 1 - length * ((ERRORS * self.half).astype(np.int64) + 1))
        #: Diagonals that the hits of one place can spread over: all errors may be gaps.
        self.spread = np.maximum(1, (BUDGET * self.half).astype(np.int64))
        self.step = -(-self.spread // 2)
        self.shift = np.maximum(FINE, np.ceil(np.log2(3 * self.step)).astype(np.int64))
        self.longest = int(self.size.max(initial=1))
        self.short = [i for i in range(len(self.size)) if self.half[i] < length[i]]
        self.postings = {}
        for length, dense in ((PIECE, False), (DENSE_PIECE, True)):
            hashes, item, offset = [], [], []
            for i, bare in enumerate(self.skeletons):
                if self.dense[i] == dense and self.half[i] >= length:
                    h = pieces(bare, length)
                    hashes.append(h)
                    item.append(np.full(len(h), i, np.int32))
                    offset.append(np.arange(len(h), dtype=np.int32))
            if hashes:
                h, item, offset = map(np.concatenate, (hashes, item, offset))
                order = np.argsort(h, kind="stable")
                h, first, kind = np.unique(h[order], return_index=True, return_inverse=True)
                follower = np.full(len(order), -1)
                follower[order] = kind
                follower = np.append(np.where(item[1:] == item[:-1], follower[1:], -1), -1)[order]
                first = np.append(first, len(order))
                self.postings[length] = (h, first, item[order], offset[order], followed(follower, first), *directory(h))

    def hits(self, bare: np.ndarray, shifted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(base of the diagonals, item, diagonal, offset) of the pieces that occur in the skeleton of a block of texts and have
        enough near them, by overlapping windows; shifted is where each position counts from.

        A window with too many hits is worked through by parts of the items; an item's hits in a window always come together.
        """
        for length, (keys, first, item, offset, follows, slots, most) in self.postings.items():
            h = pieces(bare, length)
            place = slots[h >> DIRECTORY]
            at = np.flatnonzero(place >= 0)
            place, wanted = place[at], h[at]
            for _ in range(most):  # keys of one slot follow each other
                place += (keys[place] < wanted) & (place + 1 < len(keys))
            ok = keys[place] == wanted
            at, place = at[ok], place[ok]
            # pieces that always follow each other are one run: their hits have the same diagonals
            opens = np.append(True, (at[1:] != at[:-1] + 1) | (follows[place[:-1]] != place[1:]) | (at[1:] // WINDOW != at[:-1] // WINDOW))[: len(at)]
            opens = np.flatnonzero(opens)
            runs = np.diff(np.append(opens, len(at)))
            at, place = at[opens], place[opens]
            cells = self.cells(item, offset)
            for begin in range(0, len(h), WINDOW):
                low, high = np.searchsorted(at, (begin, begin + WINDOW + self.longest))
                count = first[place[low:high] + 1] - first[place[low:high]]
                ends = np.cumsum(count * runs[low:high])
                parts = -(-int(ends[-1]) // HELD) if len(ends) else 0
                cuts = np.unique(np.searchsorted(ends, np.arange(1, parts) * HELD)) if parts > 1 else []
                lead = at[low:high] - begin
                for part in range(parts):
                    found = []
                    for some in np.split(np.arange(high - low), cuts):
                        if len(some):
                            n = count[some]
                            post = np.repeat(first[place[low + some]] - (np.cumsum(n) - n), n)
                            post += np.arange(len(post))
                            mine = slice(None) if parts == 1 else item[post] % parts == part
                            found.append((np.repeat(lead[some], n)[mine], post[mine], np.repeat(runs[low + some], n)[mine]))
                    ahead, post, run = found[0] if len(found) == 1 else map(np.concatenate, zip(*found))
                    if cells:
                        code, shift, need, reach, number = cells
                        fine = ahead + code.take(post)
                        fine >>= shift.take(post)
                        cell = fine >> FINE
                        many = np.bincount(cell, run, len(need))
                        full = np.zeros(len(need), bool)
                        np.greater_equal(many[:-1] + many[1:], need[:-1], out=full[:-1])
                        full[1:] |= full[:-1].copy()
                        held = np.flatnonzero(full.take(cell))
                        # the same by parts of the cells that are left, as far as three buckets reach
                        kept = np.flatnonzero(full)
                        number[kept] = np.arange(len(kept))
                        part_of = (number.take(cell.take(held)) << FINE) + (fine.take(held) & (1 << FINE) - 1)
                        run = run.take(held)
                        total = np.append(0, np.cumsum(np.bincount(part_of, run, len(kept) << FINE)))
                        opens = np.arange(len(total) - 1)
                        ends = np.minimum(opens + np.repeat(reach[kept], 1 << FINE), len(opens))
                        enough = np.flatnonzero(total[ends] - total[:-1] >= np.repeat(need[kept], 1 << FINE))
                        covered = np.bincount(enough, minlength=len(total)) - np.bincount(ends[enough], minlength=len(total))
                        some = np.flatnonzero((np.cumsum(covered) > 0).take(part_of))
                        held, run = held.take(some), run.take(some)
                        ahead, post = ahead.take(held), post.take(held)
                    if len(post):
                        base = int(shifted[at[low]]) - self.longest
                        ahead = shifted[ahead + begin] - base
                        within = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
                        yield base, np.repeat(item[post], run), np.repeat(ahead - offset[post], run), np.repeat(offset[post], run) + within

    def cells(self, item: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """What added to a position of a window and shifted gives the part of a cell of a posting: each item has cells of its own over the
        diagonals, so wide that what three neighbouring buckets hold lies in two neighbouring cells; the hits that these need; the parts of
        cells over which three buckets reach; room for a number of each cell. None for too many cells. Texts that stand side by side share
        cells, which lets more through and drops nothing."""
        stride = (WINDOW + 2 * self.longest >> self.shift) + 2
        if stride.sum() > CELLS:
            return None
        opens = np.cumsum(stride) - stride
        code = (opens << self.shift)[item] + self.longest - offset
        parts = (3 * self.step - 2 >> self.shift - FINE) + 2
        return code, (self.shift - FINE)[item], np.repeat(self.need, stride), np.repeat(parts, stride), np.zeros(int(stride.sum()), np.int64)


def myers(pattern: np.ndarray, text: np.ndarray) -> int:
    """The least edit distance between the pattern and any substring of the text, by bit-parallel columns."""
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern.tolist()):
        peq[c] = peq.get(c, 0) | 1 << i
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text.tolist():
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
        ph, mh = ph << 1, mh << 1  # a zero comes in: the match may begin anywhere
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
    return best


def distances(patterns: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """myers() of each pattern and its text, for all at once: columns of words of 64 bits. A pattern ends at the last bit of the last word; the
    bits before it match everything and cost nothing, as does what stands before a match."""
    n = len(patterns)
    if n > 1 and n * max(map(len, texts)) > ROOM:
        return np.concatenate([distances(patterns[: n // 2], texts[: n // 2]), distances(patterns[n // 2 :], texts[n // 2 :])])
    size, lens = np.array([len(p) for p in patterns]), np.array([len(t) for t in texts])
    words, width = -(-int(size.max()) // 64), int(lens.max(initial=0))
    pattern, text = np.concatenate(patterns), np.concatenate(texts)
    # a number for each symbol of the patterns, 0 for any other; then one for each symbol within its pattern
    most = int(pattern.max())
    number = np.zeros(most + 2, np.int64)
    number[pattern] = 1
    symbols = np.flatnonzero(number)
    number[symbols] = np.arange(1, len(symbols) + 1)
    kinds = len(symbols) + 1
    row = np.arange(n)[:, None] * kinds
    rows, columns = np.zeros((n, words * 64), np.int64), np.zeros((n, width), np.int64)
    rows[np.arange(words * 64) >= words * 64 - size[:, None]] = number.take(pattern.astype(np.int64))
    columns[np.arange(width) < lens[:, None]] = number.take(text.astype(np.int64), mode="clip")
    rows += row
    columns += row
    held = np.zeros((n, kinds), bool)
    held[:, 0] = True
    held.ravel()[rows] = True
    used = np.flatnonzero(held)
    own = (np.cumsum(held) - 1).reshape(n, kinds)
    own = np.where(held, own, own[:, :1]).ravel()
    peq = np.zeros((words, len(used)), np.uint64)
    for r, symbol in enumerate(np.ascontiguousarray(own.take(rows).T)):
        peq[r >> 6][symbol] |= np.uint64(1 << (r & 63))  # each pattern has numbers of its own
    before = np.clip(64 * words - size - 64 * np.arange(words)[:, None], 0, 64)
    free = np.where(before == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (before & 63).astype(np.uint64)) - np.uint64(1))
    peq |= free[:, used // kinds]
    one, top = np.uint64(1), np.uint64(63)
    pv, mv = ~free, np.zeros((words, n), np.uint64)
    score, best, signs = size.copy(), size.copy(), np.empty(n, np.int64)
    eq, xh, xv, ph, mh = (np.empty((words, n), np.uint64) for _ in range(5))
    over, high = np.empty((words, n), bool), np.empty((words - 1, n), np.uint64)
    for symbol in np.ascontiguousarray(own.take(columns).T):
        for w in range(words):
            peq[w].take(symbol, out=eq[w], mode="clip")
        np.bitwise_and(eq, pv, out=xv)
        np.add(xv, pv, out=xh)
        if words > 1:
            np.less(xh, xv, out=over)
            for w in range(1, words):
                xh[w] += over[w - 1]
                if w + 1 < words:  # a carry that comes in leaves only if all bits were set
                    over[w] |= over[w - 1] & (xh[w] == 0)
        xh ^= pv
        xh |= eq
        np.bitwise_or(eq, mv, out=xv)
        np.bitwise_or(xh, pv, out=ph)
        np.invert(ph, out=ph)
        ph |= mv
        np.bitwise_and(pv, xh, out=mh)
        np.right_shift(ph[-1].view(np.int64), 63, out=signs)
        score -= signs
        np.right_shift(mh[-1].view(np.int64), 63, out=signs)
        score += signs
        np.minimum(best, score, out=best)
        for x in (ph, mh):
            np.right_shift(x[:-1], top, out=high)
            np.left_shift(x, one, out=x)
            x[1:] |= high
        np.bitwise_or(xv, ph, out=pv)
        np.invert(pv, out=pv)
        pv |= mh
        np.bitwise_and(ph, xv, out=mv)
    return best


def shares(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """The part of each item matched by the best local alignment with its text (match 1, anything else -1): what stands in one place, in
    order. All pairs advance together, a row of the item at a time."""
    count, width = len(items), max(map(len, texts), default=0)
    size = np.array([len(i) for i in items], np.int64)
    grid = np.full((count, width), 0xFFFFFFFF, np.uint32)
    rows = np.full((int(size.max(initial=0)), count), 0xFFFFFFFE, np.uint32)  # what pads an item matches nothing
    for k, (item, text) in enumerate(zip(items, texts)):
        grid[k, : len(text)], rows[: len(item), k] = text, item
    place = np.arange(width + 1) * WIDE
    # score and matches are carried in one number, so that the maximum takes both along
    cells, best = np.zeros((count, width + 1), np.int64), np.zeros(count, np.int64)
    for c in rows:
        same = grid == c[:, None]
        diag = cells[:, :-1] + np.where(same, WIDE + 1, -WIDE)
        cells[:, 0] = 0
        np.maximum(diag, cells[:, 1:] - WIDE, out=cells[:, 1:])
        np.maximum.accumulate(cells + place, axis=1, out=cells)  # gaps along the text
        cells -= place
        cells[cells < WIDE] = 0
        top = cells.max(axis=1)
        best = np.where(top >> 31 > best >> 31, top, best)
    return (best & (WIDE - 1)) / size


def places(items: Items, bare: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, list[int], int, int]]:
    """(text, item, begins of halves, least and greatest diagonal): where the block has enough different pieces of one half of one item."""
    gap = 3 * items.longest  # texts share no diagonals
    texts, step = np.arange(int(owner[-1]) + 1), items.step.astype(np.int32)
    starts, bits = np.searchsorted(owner, texts) + texts * gap, items.longest.bit_length()
    shifted = np.arange(len(bare)) + owner * gap
    for base, item, bucket, offset in items.hits(bare, shifted):
        bucket //= step[item]
        buckets = int(bucket.max()) + 3
        hit = np.sort((item.astype(np.int64) * buckets + bucket << bits) + offset)
        run, offset = hit >> bits, hit & (1 << bits) - 1
        opens = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        new = np.append(True, hit[1:] != hit[:-1])
        count = np.add.reduceat(new.astype(np.int64), opens)
        run = run[opens]
        ends = np.append(opens[1:], len(offset))
        last = np.searchsorted(run, run + 3)  # every place is within three neighbouring buckets
        total = np.append(0, np.cumsum(count))
        some = np.flatnonzero(total[last] - total[:-1] >= items.need[run // buckets])
        # places that begin within three neighbouring buckets are one place, a little wider
        third = run[some] // buckets * buckets + run[some] % buckets // 3
        begins = np.flatnonzero(np.append(True, third[1:] != third[:-1])) if len(some) else some
        heads, tails = some[begins], last[some[np.append(begins[1:], len(some)) - 1]] - 1 if len(some) else some
        for k in range(0, len(heads), COUNTED):
            r, tail = heads[k : k + COUNTED], tails[k : k + COUNTED]
            i = run[r] // buckets
            low, size = opens[r], ends[tail] - opens[r]
            post = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            seen = np.zeros((len(r), items.longest + 1), np.int16)
            seen[np.repeat(np.arange(len(r)), size), offset[post] + 1] = 1
            upto = np.cumsum(seen, axis=1, dtype=np.int16)
            reach = (items.half - items.length + 1)[i]
            ahead = np.minimum(np.arange(items.longest + 1) + reach[:, None], items.longest)
            each = np.take_along_axis(upto, ahead, axis=1) - upto
            best = each.argmax(axis=1)
            for n in np.flatnonzero(each[np.arange(len(r)), best] >= items.need[i]).tolist():
                yield place_of(items, int(i[n]), each[n], int(best[n]), base, int(run[r[n]]) % buckets, int(run[tail[n]]) % buckets, starts, gap)


def place_of(items: Items, i: int, each: np.ndarray, best: int, base: int, begin: int, end: int, starts: np.ndarray, gap: int) -> tuple[int, int, list[int], int, int]:
    """One place: its halves are the one with most pieces, then those of a grid that come near enough to be worth a look, by their pieces."""
    grid = np.arange(0, items.size[i] - items.half[i] + 1, max(1, int(items.size[i]) // 16))
    inside = each[grid]
    near = inside >= max(1, items.need[i] - int(items.half[i]) // 16 - 1)
    order = grid[near][np.argsort(-inside[near], kind="stable")].tolist()
    first = min(best, int(items.size[i] - items.half[i]))
    begin, end = base + begin * int(items.step[i]), base + (end + 1) * int(items.step[i])
    doc = int(np.searchsorted(starts - 2 * items.longest, begin, "right")) - 1
    return doc, i, [first, *[b for b in order if b != first]], begin - doc * gap, end - doc * gap


def known_items(name: str, sent: Broadcast) -> Items:
    """The items of a broadcast, built once in a worker and kept until another broadcast comes."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Items(*sent.value)
    return _KEPT[name]


def whole(items: Items, texts: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(text, item) for the items too short for pieces, where the whole skeleton occurs."""
    if items.short:
        strings = ["".join(map(chr, t.tolist())) for t in texts]
        for i in items.short:
            wanted = "".join(map(chr, items.skeletons[i].tolist()))
            yield from ((d, i) for d, t in enumerate(strings) if wanted in t)


def find_block(items: Items, texts: list[str | None]) -> list[tuple[int, int]]:
    """(text, item) of every pair found in a block of texts, as numbers."""
    flat = Flat(texts)
    folded = folding()[flat.cps]
    folded[flat.seps] = 0xFFFFFFFF  # between two texts stands what no piece holds
    keep = folded > 0
    bare = folded[keep]
    owner = np.repeat(np.arange(len(texts)), flat.lens + 1)[keep]
    ends = np.flatnonzero(bare == 0xFFFFFFFF)
    first = np.concatenate([[0], ends[:-1] + 1])
    bodies = [bare[a:b] for a, b in zip(first.tolist(), ends.tolist())]
    found = set(whole(items, bodies))
    waiting: list[tuple[int, int, list[int], int, int]] = []

    def verify() -> None:
        left = waiting[:]
        waiting.clear()
        while left := [c for c in left if c[2] and (c[0], c[1]) not in found]:
            left.sort(key=lambda c: c[4] - c[3] + items.size[c[1]])
            each = max(1, TOGETHER // 2 // len(left))  # halves of a place at once: few places take as long as many
            for k in range(0, len(left), TOGETHER):
                some = []
                for doc, i, begins, low, high in left[k : k + TOGETHER]:
                    half, spread = int(items.half[i]), int(items.spread[i])
                    low, high = low - int(first[doc]) - spread, high - int(first[doc]) + half + spread
                    some += [(doc, i, begins, begin, low + begin, high + begin) for begin in begins[:each]]
                    del begins[:each]
                errors = distances([items.skeletons[i][b : b + items.half[i]] for _, i, _, b, _, _ in some], [bodies[d][max(0, low) : max(0, high)] for d, _, _, _, low, high in some])
                near = []
                for (doc, i, begins, begin, low, high), e in zip(some, errors.tolist()):
                    half, size = int(items.half[i]), int(items.size[i])
                    if (doc, i) not in found and e <= int(BUDGET * half):
                        if half - e >= SHARE * size:  # so much of the item is matched by the half alone
                            found.add((doc, i))
                        else:
                            near.append((doc, i, bodies[doc][max(0, low - begin - half // 2) : high + size - begin - half // 2]))
                    # a half that begins n further or earlier has at most n errors less
                    begins[:] = [b for b in begins if e - abs(b - begin) <= items.spread[i]]
                near = [x for x in near if (x[0], x[1]) not in found]
                for n in range(0, len(near), ALIGNED):
                    part = near[n : n + ALIGNED]
                    parts = shares([items.skeletons[i] for _, i, _ in part], [t for _, _, t in part])
                    found.update((doc, i) for (doc, i, _), x in zip(part, parts.tolist()) if x >= SHARE)

    for place in places(items, bare, owner):
        waiting.append(place)
        if len(waiting) >= 8 * TOGETHER:
            verify()
    verify()
    return sorted(found)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_key, key) of every document that contains half of an item or more. The documents are read once for each slice of items."""
    spark = docs.sparkSession
    wanted = items.filter(F.col(item_text).isNotNull()).select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).distinct()
    slices = max(1, -(-(wanted.agg(F.sum(F.char_length("t"))).first()[0] or 0) // ITEMS))
    kinds = f"`{item_key}` {items.schema[item_key].dataType.simpleString()}, `{key}` {docs.schema[key].dataType.simpleString()}"
    item_type = {"bigint": pa.int64(), "int": pa.int32()}.get(items.schema[item_key].dataType.simpleString(), pa.string())
    out = None
    for part in range(slices):
        rows = wanted.filter(F.pmod(F.xxhash64("k"), F.lit(slices)) == part).collect()  # at most about ITEMS code points
        sent = spark.sparkContext.broadcast(([r["k"] for r in rows], [r["t"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=uuid4().hex) -> Iterator[pa.RecordBatch]:
            known = known_items(name, sent)
            for block in blocks(batches, text, BLOCK):
                pairs = find_block(known, block.column(text).to_pylist())
                keys = block.column(key).take(pa.array([d for d, _ in pairs], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([known.keys[i] for _, i in pairs], item_type), keys], [item_key, key])

        one = docs.select(key, text).mapInArrow(run, kinds)
        out = one if out is None else out.unionByName(one)
    return out.distinct()
