"""Problem 8: sentence units of texts in any language and layout.

The boundary rules are compiled into a finite transducer over classes of code points. Its state holds the depth of open brackets, whether
a straight quote is open, and whether an end mark is pending; its output is a candidate: a visible code point that follows an end mark, its
closers and white space outside all brackets. Long texts are cut into chunks that become functions from state to state and are composed
by a parallel prefix scan (``codepoints.scan``), so a chunk needs nothing from the chunks before it.

Two things lie outside the transducer. Lines are typed first: headings, list items and table rows are units; blank lines and lines
without a letter or digit end one. Candidates after a full stop are then held against abbreviations, initials and numbers.

Defined results: null, empty and blank texts have no unit, nor has a text without letter or digit; equal texts give equal units; one set of
units comes out for every row; extra columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.codepoints import Flat, blocks, categories, general, scan

# Marks that end a sentence where white space follows, marks that end it at once, and what opens and closes a passage.
SPACED, TIGHT = ".!?…؟۔।॥．", "。！？｡"
OPENERS, CLOSERS = "([{«“„‘「『（【《〈［｛‚", ")]}»”’」』）】》〉］｝'*_"
BULLETS = "-*•+–‣◦▪·●○■□"
# Abbreviations that do not end a sentence, those that may, and words before a letter that is a name's last word.
ABBREVIATIONS = frozenset(
    "m mm mr mrs ms dr dra prof st ste mgr me lt hr fr sr sra srta ud uds p pp pg pag pág págs s. vol vols no nos nr n° núm num art chap ch fig figs abb tab tabl cap sec sect eq éq gl kap anh bd abs aufl ed éd eds ex ej env approx cf vgl siehe voir vs resp bzw ca app annex ann al jr inc ltd col gen rev réf ref hrsg u z d h i e g b v c-à-d c.-à-d डॉ प्रो श्री श्रीमती सं पृ ดร ศ รศ ผศ น นพ".split()
)
FINAL = frozenset("etc usw ecc etal".split())
LABELS = frozenset("type typ tipo annexe annex appendix app anhang anexo apéndice lettre letter buchstabe letra groupe group gruppe grupo réponse answer antwort respuesta option cas case fall caso classe class klasse clase zone série vitamine rang rank".split())
UNITS = frozenset("s m g h l n a v w j k".split())
PARTICLES = "とはがをにのでもやなかへっ"

OTHER, WHITE, BREAK, MARK, TIGHT_MARK, OPEN, CLOSE, QUOTE = range(8)
DEPTH = 3  # brackets counted; deeper ones count as the third
BLANK_LINE, NOISE, UNIT, TEXT = range(4)


@cache
def classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    out[general() == ord("Z")] = WHITE
    out[[*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85]] = WHITE
    for chars, kind in ((SPACED, MARK), (TIGHT, TIGHT_MARK), (OPENERS, OPEN), (CLOSERS, CLOSE), ('"＂', QUOTE)):
        out[[ord(c) for c in chars]] = kind
    return out


def _script(c: str) -> int:
    code = ord(c)
    if c.islower():
        return 1
    if 0x0E00 <= code < 0x0E80:
        return 2
    if 0x2E80 <= code < 0xA000 or 0xAC00 <= code < 0xD7B0 or 0xF900 <= code < 0xFB00 or 0x20000 <= code < 0x30000:
        return 3
    return 4 if c.isnumeric() or c.isdigit() else 0


LOWER, THAI, DENSE, DIGIT = 1, 2, 3, 4


@cache
def scripts() -> np.ndarray:
    return categories(_script)


@cache
def machine() -> np.ndarray:
    """The transducer's transitions: state = (depth * 2 + in straight quotes) * 2 + end mark pending."""
    states = [(d, q, p) for d in range(DEPTH + 1) for q in (0, 1) for p in (0, 1)]
    number = {s: i for i, s in enumerate(states)}
    table = np.zeros((8, len(states)), np.uint8)
    for (d, q, p), i in number.items():
        to = {
            OTHER: (d, q, 0),
            WHITE: (d, q, p),
            BREAK: (0, 0, 0),
            MARK: (d, q, 1),
            TIGHT_MARK: (d, q, 1),
            OPEN: (min(d + 1, DEPTH), q, 0),
            CLOSE: (max(d - 1, 0), q, p),
            QUOTE: (d, 1 - q, p if q else 0),
        }
        for kind, state in to.items():
            table[kind, i] = number[state]
    return table


def line_kinds(flat: Flat, white: np.ndarray, solid: np.ndarray, newline: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all lines, their kinds); solid counts the letters and digits before each position."""
    n = len(flat.cps)
    starts = np.concatenate([[0], np.flatnonzero(newline)[:-1] + 1])
    ends = np.flatnonzero(newline)
    place = np.arange(n)
    after = np.minimum.accumulate(np.where(white, n, place)[::-1])[::-1]
    first = after[starts]
    blank = first >= ends
    noise = ~blank & (solid[ends] == solid[starts])
    cps = np.append(flat.cps, np.zeros(8, np.uint32))
    pad = np.append(white, np.ones(8, bool))
    at = [cps[first + k] for k in range(8)]
    gap = [pad[first + k] for k in range(8)]
    is_in = lambda c, chars: np.isin(c, np.array([ord(x) for x in chars], np.uint32))
    digit = [(c >= 48) & (c <= 57) for c in at]
    heading = np.zeros(len(starts), bool)
    run = np.ones(len(starts), bool)
    for k in range(6):
        run &= at[k] == ord("#")
        heading |= run & gap[k + 1]
    bullet = (is_in(at[0], BULLETS) & gap[1]) | (at[0] == ord("|"))
    listed = np.zeros(len(starts), bool)
    run = np.ones(len(starts), bool)
    for k in range(3):
        run &= digit[k]
        listed |= run & is_in(at[k + 1], ".)") & gap[k + 2]
    letter = ((at[0] | 0x20) >= 97) & ((at[0] | 0x20) <= 122)
    listed |= letter & (at[1] == ord(")")) & gap[2]
    listed |= (at[0] == ord("(")) & (digit[1] | (((at[1] | 0x20) >= 97) & ((at[1] | 0x20) <= 122))) & (at[2] == ord(")")) & gap[3]
    listed |= (at[0] >= 0x2460) & (at[0] <= 0x2473)
    kind = np.where(blank, BLANK_LINE, np.where(noise, NOISE, TEXT))
    kind[(heading | bullet) & (kind == TEXT)] = UNIT
    opens = np.isin(starts, flat.starts)
    before = np.concatenate([[BLANK_LINE], kind[:-1]])
    free = opens | (before != TEXT)
    # a numbered line inside a paragraph is a list item only after another one
    kind[listed & (kind == TEXT) & (free | np.concatenate([[False], listed[:-1]]))] = UNIT
    only = is_in(at[0], TIGHT + "，、；：" + CLOSERS + ".!?…")  # a wrapped line that holds nothing but marks
    kind[(kind == NOISE) & only & ~opens & (np.concatenate([[BLANK_LINE], kind[:-1]]) == TEXT)] = TEXT
    return starts, kind


def stops(token: str, before: str, after: str) -> bool:
    """Whether the full stop at the end of token ends a sentence; before is the token to its left, after the next visible character."""
    core = token.lstrip(OPENERS + "\"'*_").rstrip(".．" + CLOSERS + '"')
    if not core or not (core[-1].isalpha() or unicodedata.category(core[-1])[0] == "M"):
        return True
    core = core.rsplit("'", 1)[-1].rsplit("’", 1)[-1]
    low = core.casefold()
    if low in FINAL:
        return not after.isdigit()
    if len(core) == 1:
        label = before.casefold().strip(OPENERS + CLOSERS + '",;:').rsplit("'", 1)[-1].rsplit("’", 1)[-1]
        if core.isupper():
            return label in LABELS
        return low in UNITS and label[:1].isdigit() and not after.isdigit()
    if low in ABBREVIATIONS:
        # a unit such as ms after a number is no title
        return before[:1].isdigit() and low in ("ms", "mm") and not after.isdigit()
    parts = core.split(".")
    return not (len(parts) > 1 and all(0 < len(x) <= 2 for x in parts))


def unit_ends(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, end position in it) of every unit of a block of texts."""
    flat = Flat(texts)
    cps, n = flat.cps, len(flat.cps)
    kind = classes()[cps]
    white = kind == WHITE
    white[flat.seps] = True
    major = general()[cps]
    alnum = (major == ord("L")) | (major == ord("N"))
    solid = np.concatenate([[0], np.cumsum(alnum)])
    newline = (cps == 10) | (cps == 0x2028) | (cps == 0x2029) | (cps == 0x85) | ((cps == 13) & (np.append(cps[1:], 0) != 10))
    newline[flat.seps] = True
    starts, lines = line_kinds(flat, white, solid, newline)
    place = np.arange(n)
    # which ends of line are breaks
    ends = np.flatnonzero(newline)
    breaks = np.ones(len(ends), bool)
    breaks[:-1] = (lines[:-1] != TEXT) | (lines[1:] != TEXT)
    breaks[np.isin(ends, flat.seps)] = True
    kind[ends[breaks]] = BREAK
    broken = np.zeros(n, bool)
    broken[ends[breaks]] = True
    # brackets count only in paragraphs where they are balanced; quotes set low, as in German, close with what opens elsewhere
    paragraph = np.cumsum(broken) - broken
    low = np.zeros(paragraph[-1] + 1, bool)
    low[paragraph[cps == 0x201E]] = True
    kind[(cps == 0x201C) & low[paragraph]] = CLOSE
    kind[((cps == 0x27) | (cps == 0x2019) | (cps == 0x2A) | (cps == 0x5F)) & np.concatenate([[True], (kind[:-1] != MARK) & (kind[:-1] != TIGHT_MARK) & (kind[:-1] != CLOSE)])] = OTHER
    odd = np.bincount(paragraph, weights=np.where(kind == OPEN, 1, 0) - np.where((kind == CLOSE) & (cps != 0x27) & (cps != 0x2019) & (cps != 0x2A) & (cps != 0x5F), 1, 0), minlength=len(low)) != 0
    uneven = np.bincount(paragraph, weights=kind == QUOTE, minlength=len(low)) % 2 == 1
    kind[(kind == OPEN) & odd[paragraph]] = OTHER
    kind[(kind == QUOTE) & uneven[paragraph]] = CLOSE
    state = scan(machine(), kind)
    depth, pending = state >> 1, (state & 1).astype(bool)
    visible = (kind != WHITE) & (kind != BREAK)
    last = np.maximum.accumulate(np.where(visible, place, -1))
    before = np.concatenate([[-1], last[:-1]])  # the visible position before each
    in_text = np.repeat(lines == TEXT, np.diff(np.append(starts, n)))
    starts_word = (kind == OTHER) | (kind == OPEN) | ((kind == QUOTE) & ((state >> 1) & 1 == 0))
    candidate = np.flatnonzero(pending & starts_word & (depth == 0) & in_text)
    script = scripts()[cps]
    mark = np.maximum.accumulate(np.where((kind == MARK) | (kind == TIGHT_MARK), place, -1))
    if len(candidate):
        m, prior = mark[candidate - 1], before[candidate]
        word = np.minimum.accumulate(np.where(kind == OTHER, place, n - 1)[::-1])[::-1][candidate]  # behind what opens
        spaced = prior < candidate - 1
        closed = prior > m
        tight = kind[m] == TIGHT_MARK
        dense = script[candidate] == DENSE
        japanese = closed & np.isin(cps[candidate], [ord(c) for c in PARTICLES])
        ok = np.where(tight, ~japanese, np.where(spaced, script[word] != LOWER, dense & (cps[m] != ord(".")) & ~japanese))
        candidate, m, word, tight = candidate[ok], m[ok], word[ok], tight[ok]
        dot = ~tight & np.isin(cps[m], [ord("."), ord("．")]) & ~np.isin(cps[np.maximum(m - 1, 0)], [ord("."), ord("…")])
        gap = np.maximum.accumulate(np.where(white, place, -1))
        check = np.flatnonzero(dot)
        begin = gap[m[check]] + 1
        prior_end = np.maximum(before[begin], 0) + 1
        prior_begin = gap[prior_end - 1] + 1
        text = flat.joined
        keep = np.ones(len(candidate), bool)
        keep[check] = [stops(text[b : e + 1], text[pb:pe] if pe <= b else "", text[w]) for b, e, pb, pe, w in zip(begin.tolist(), m[check].tolist(), prior_begin.tolist(), prior_end.tolist(), word[check].tolist())]
        candidate = candidate[keep]
    # in Thai a space parts sentences
    thai = np.flatnonzero((script == THAI) & np.concatenate([[False], white[:-1]]) & in_text & (depth == 0))
    if len(thai):
        prior = np.maximum(before[thai], 0)
        same = paragraph[prior] == paragraph[thai]
        thai = thai[same & ((script[prior] == THAI) | (script[prior] == DIGIT))]
    cut = np.unique(np.concatenate([before[candidate], before[thai], last[ends[breaks]][last[ends[breaks]] >= 0]]))
    cut = cut[cut >= 0]
    begin = np.concatenate([[0], cut[:-1] + 1])
    held = solid[cut + 1] > solid[begin]
    owner = flat.owner(cut)
    held &= cut >= flat.starts[owner]
    # a line without letter or digit is no end of the unit before it
    noise = np.repeat((lines == NOISE) | (lines == BLANK_LINE), np.diff(np.append(starts, n)))
    held &= ~noise[cut]
    cut, owner = cut[held], owner[held]
    return owner, cut - flat.starts[owner] + 1


def sentence_ends(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, end_pos) for every unit. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            owner, ends = unit_ends(block.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([block.column(key).take(pa.array(owner)), pa.array(ends.astype(np.int64))], [key, "end_pos"])

    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, end_pos bigint")


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence, start_pos, end_pos, text): the units themselves, cut from the texts in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            texts = block.column(text).to_pylist()
            owner, ends = unit_ends(texts)
            rows = []
            row, at, number = -1, 0, 0
            for o, e in zip(owner.tolist(), ends.tolist()):
                if o != row:
                    row, at, number = o, 0, 0
                piece = texts[o][at:e]
                start = e - len(piece.lstrip())
                rows.append((o, number, start, e, texts[o][start:e]))
                at, number = e, number + 1
            o, number, start, end, piece = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [block.column(key).take(pa.array(o, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(piece, pa.string())],
                [key, "sentence", "start_pos", "end_pos", text],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, sentence int, start_pos int, end_pos int, `{text}` string")
