"""Problem 4: one form for values that look the same though their characters differ.

Characters are mapped to one member of each look-alike set (full and half width, spaces, invisible characters, letters of other alphabets
drawn alike). The mapped values are grouped in SQL under the accent- and case-sensitive Unicode collation, which makes composed and
decomposed accents equal; each class gets one canonical member, which is joined back to its rows.

A long text is shuffled only if its class can have two members: a fingerprint of what no look-alike changes is grouped first, and only
texts whose fingerprint occurs with two different texts are compared under the collation.

Defined results: a null value has no class; an empty value is its own class; equal values share a class and are no pair; letter case,
accents, raised digits, and digits of other scripts stay different; rows with one id and one value count once. Extra columns are not read.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.session import checkpoint

#: Rows of (id, fingerprint) that are broadcast at most; beyond it the texts are shuffled to them instead.
BROADCAST_ROWS = 500_000
#: Characters of changed forms that are broadcast at most.
BROADCAST_CHARS = 64_000_000

# Letters of the Greek and Cyrillic alphabets, and signs, that are drawn like Latin ones.
ALIKE = {
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оοօ", "p": "р", "q": "ԛ", "s": "ѕ", "v": "ν", "w": "ԝ", "x": "х", "y": "уү",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "-": "‐‑", "'": "ʹʼ", ";": ";", "µ": "μ",
}
# Characters that leave no ink and no room, as ranges of code points.
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xE0100, 0xE01EF))


@cache
def mapping() -> dict[str, str]:
    """Character -> look-alike; by rule for widths, spaces, singletons and digits, from the lists above for the rest."""
    out = {}
    for code in [*range(0xFF01, 0xFFEF), *range(0x3000, 0x3001)]:
        to = {0xFF9E: "゙", 0xFF9F: "゚"}.get(code) or unicodedata.normalize("NFKC", chr(code))
        if len(to) == 1 and to != chr(code):
            out[chr(code)] = to
    for code in range(0x80, 0x30000):
        c = chr(code)
        if unicodedata.category(c) == "Zs":
            out[c] = " "
        elif unicodedata.category(c) == "Nd" and c not in out:
            out[c] = chr(0xF0000 + code % 0x10000)  # the collation takes digits of all scripts as equal, the eye does not
        elif len(one := unicodedata.normalize("NFD", c)) == 1 and one != c:
            out[c] = one
    for latin, others in ALIKE.items():
        for c in others:
            out[c] = latin
    for low, high in INVISIBLE:
        for code in range(low, high + 1):
            out[chr(code)] = ""
    return out


def _translate(value: Column, table: dict[str, str]) -> Column:
    kept = [(a, b) for a, b in table.items() if b] + [(a, b) for a, b in table.items() if not b]
    return F.translate(value, "".join(a for a, _ in kept), "".join(b for _, b in kept))


def look(value: Column) -> Column:
    """The value with every look-alike character mapped; composed and decomposed accents still differ."""
    return _translate(F.replace(value, F.lit("\r\n"), F.lit("\n")), mapping())


@cache
def composed() -> str:
    """The characters that canonical decomposition takes apart, without Hangul."""
    return "".join(chr(c) for c in range(0xC0, 0x30000) if not 0xAC00 <= c <= 0xD7A3 and len(unicodedata.normalize("NFD", chr(c))) > 1)


def fingerprint(value: Column) -> Column:
    """A hash that is equal for values that look the same: of what is left without accented characters and marks."""
    table = {c: "" for c in composed()}
    bare = F.regexp_replace(look(value), r"\P{M}\p{M}+|[가-힣ᄀ-ᇿ\x00-\x08\x0e-\x1f]", "")
    return F.xxhash64(_translate(bare, table))


def suspects(values: DataFrame) -> DataFrame:
    """(id, value, h) of the rows whose fingerprint occurs with at least two different values; values has (id, value)."""
    values = values.select("id", "value")
    light = checkpoint(values.filter("value is not null").select("id", fingerprint(F.col("value")).alias("h"), F.xxhash64("value").alias("th")))
    several = light.groupBy("h").agg(F.min("th").alias("a"), F.max("th").alias("b")).filter("a <> b").select("h")
    few = checkpoint(light.join(several, "h", "left_semi").select("id", "h").distinct())
    small = few.count() <= BROADCAST_ROWS
    return values.join(F.broadcast(few) if small else few, "id")


def classes(rows: DataFrame) -> DataFrame:
    """(id, h, look, value, canonical) of the rows of suspects whose class has at least two different values.

    The canonical member is one that the mapping leaves as it is, if there is one; among those the shortest (composed), the most frequent,
    the least.
    """
    spark = rows.sparkSession
    mapped = rows.filter("value is not null").select("id", "h", "value", look(F.col("value")).alias("mapped")).distinct()
    return spark.sql(
        """
        WITH keyed AS (SELECT id, h, value, mapped COLLATE UNICODE AS look, mapped = value AS plain FROM {mapped}),
        spelled AS (SELECT h, look, value, plain, count(*) AS n FROM keyed GROUP BY h, look, value, plain),
        chosen AS (SELECT h, look, min(struct(NOT plain AS a, char_length(value) AS b, -n AS c, value AS d)).d AS canonical FROM spelled GROUP BY h, look HAVING count(*) > 1)
        SELECT k.id, k.h, k.look, k.value, c.canonical FROM keyed k JOIN chosen c ON k.h = c.h AND k.look = c.look
        """,
        mapped=mapped,
    )


def changed(values: DataFrame) -> DataFrame:
    """(id, h, canonical) of the rows of values (id, value) whose value has another form; h is the hash of the value as stored. Written once."""
    found = classes(suspects(values)).filter("canonical <> value")
    return checkpoint(found.select("id", F.xxhash64("value").alias("h"), "canonical").distinct())


def canonical(values: DataFrame) -> DataFrame:
    """(id, value, canonical) for every row of values (id, value): the whole column in one form. Rows are joined by (id, hash), and stay
    where they are while the changed forms are few enough to be sent to them."""
    rows = changed(values)
    size = rows.agg(F.sum(F.char_length("canonical") + F.length("id") + 16)).first()[0] or 0
    rows = F.broadcast(rows) if size <= BROADCAST_CHARS else rows
    return values.select("id", "value", F.xxhash64("value").alias("h")).join(rows, ["id", "h"], "left").select("id", "value", F.coalesce("canonical", "value").alias("canonical"))


def pairs(members: DataFrame) -> DataFrame:
    """(key_a, key_b): each member with the least id of every other value of its class, in one order, once.

    Exact copies are not paired with each other; no link between two different values is lost.
    """
    rows = members.select("id", "h", "look", "value")
    least = rows.groupBy("h", "look", "value").agg(F.min("id").alias("other")).withColumnRenamed("value", "of")
    linked = rows.alias("r").join(least.alias("l"), (F.col("r.h") == F.col("l.h")) & (F.col("r.look") == F.col("l.look")) & (F.col("r.value") != F.col("l.of")))
    return linked.filter("id <> other").select(F.least("id", "other").alias("key_a"), F.greatest("id", "other").alias("key_b")).distinct()


def match_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name_key) of the rows (id, value) that look like an official name (name_key, name) without being equal to it.

    Distinct values are matched, and the matches joined back, so a value that a third of all rows hold costs one comparison.
    """
    rows = rows.select("id", "value")
    values = rows.filter("value is not null").select("value").distinct()
    both = values.select(F.col("value").alias("id"), "value").unionByName(names.select(F.concat(F.lit("\u0000"), "name").alias("id"), F.col("name").alias("value")).distinct())
    found = classes(both.withColumn("h", F.xxhash64(F.lit(0)))).select("id", "look", "value")
    official = found.filter(F.col("id").startswith("\u0000")).select("look", F.col("value").alias("name"))
    matched = found.filter(~F.col("id").startswith("\u0000")).join(official, "look").filter("value <> name").select("value", "name")
    return rows.join(matched.join(names, "name").select("value", "name_key").distinct(), "value").select("id", "name_key")
