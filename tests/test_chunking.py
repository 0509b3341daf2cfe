import random

import pytest

from groundline.operators import chunking


def test_windows_are_bounded_overlap_and_cover():
    text = "".join(chr(0x4E00 + i) for i in range(2600))
    pieces = chunking.windows(text)
    assert [len(p) for p in pieces] == [1000, 1000, 900]
    assert all(a[-150:] == b[:150] for a, b in zip(pieces, pieces[1:]))
    assert chunking.windows("   ") == [] and chunking.windows("") == []


def test_windows_prefer_paragraph_then_sentence():
    text = "a" * 600 + "\n\n" + "b" * 300 + ". " + "c" * 500
    assert chunking.windows(text)[0] == "a" * 600
    assert chunking.windows("a" * 600 + " " + "b" * 600)[:2] == ["a" * 600, "a" * 150 + " " + "b" * 600]
    text = "a" * 498 + "." + "\n" + "b" * 800
    assert chunking.windows(text)[0] == "a" * 498 + ".\n"  # the white space behind a sentence reaches the second half
    text = "a" * 600 + ". " + "b" * 800
    assert chunking.windows(text)[0] == "a" * 600 + ". "


@pytest.mark.parametrize("size,overlap", [(0, 0), (10, 10), (10, -1)])
def test_windows_refuse_bad_limits(size, overlap):
    with pytest.raises(ValueError):
        chunking.windows("x", size, overlap)


def naive_pack(lines, size, overlap):
    """Every chunk as a range of lines: begin at the carry of the one before, take lines while they fit."""
    out, start = [], 0
    for i in range(len(lines)):
        if len("\n".join(lines[start : i + 1])) > size and i > start:
            out.append("\n".join(lines[start:i]))
            back = i
            while back > start and len("\n".join(lines[back - 1 : i])) <= overlap:
                back -= 1
            start = back
    out.append("\n".join(lines[start:]))
    return [c for c in (x.strip() for x in out) if c]


def test_pack_equals_a_plain_version_without_tables():
    rng = random.Random(4)
    for _ in range(200):
        lines = ["x" * rng.randint(0, 60) for _ in range(rng.randint(1, 40))]
        assert chunking.pack("\n".join(lines), 120, 40) == naive_pack(lines, 120, 40)


def test_pack_repeats_table_headers_and_keeps_each_row_once():
    rows = [f"| row {i} | {'v' * 20} |" for i in range(40)]
    chunks = chunking.pack("\n".join(["| name | value |", "|---|---|", *rows]), 300, 60)
    assert len(chunks) > 2 and all(c.startswith("| name | value |\n|---|---|") for c in chunks)
    assert sorted(line for c in chunks for line in c.split("\n") if line.startswith("| row")) == sorted(rows)


def test_page_chunks_of_null_and_blank_texts(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "a\x00  b\r\nc")], "doc_id long, text string")
    assert [tuple(r) for r in chunking.page_chunks(pages, ("doc_id",)).collect()] == [(4, 0, "a b\nc")]


def test_sections_are_carried_and_reset(spark):
    rows = [
        ("d", 1, False, None, ["Intro"]),
        ("d", 2, True, "Part A", []),
        ("d", 3, False, None, ["One"]),
        ("d", 4, False, None, []),
        ("d", 5, True, "Part B", []),
        ("d", 6, False, None, []),
    ]
    df = spark.createDataFrame(rows, "doc string, page int, divider boolean, title string, heading_path array<string>")
    got = {r["page"]: r["section_title"] for r in chunking.heading_and_section(df, "doc", ["page"]).collect()}
    assert got == {1: "Intro", 2: "Part A", 3: "Part A > One", 4: "Part A > One", 5: "Part B", 6: "Part B"}


def test_dividers(spark):
    from pyspark.sql import functions as F

    rows = [(2, True, 1, "Chapitre 3", "", 0.0), (1, True, 1, "Chapitre 3", "", 0.0), (2, True, 1, "Leçon 2", "- a", 0.0), (3, True, 1, "Merci", "", 0.05), (3, True, 1, "Merci", "", 0.5), (3, True, 2, "II. Suite", "", 0.0), (3, True, 1, "II. Suite", "x" * 61, 0.0)]
    df = spark.createDataFrame(rows, "n int, titled boolean, segments int, title string, body string, share double")
    kinds = [r[0] for r in df.select(chunking.divider_kind(*map(F.col, ("n", "titled", "segments", "title", "body", "share")))).collect()]
    assert kinds == ["named", None, None, "plain", None, None, None]
