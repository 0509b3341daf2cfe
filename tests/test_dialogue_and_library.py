import hashlib
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from groundline.functions import text as tx
from groundline.operators import dialogue, library, structure

MESSAGE = "id string, conversation_id string, position int, role string, content string, payload struct<status: string, citations: array<string>, retrieval_query: string>"


def test_uuid5_and_titles(spark):
    names = ["subject=é\ncourse=x", "", "a" * 300]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(tx.uuid5(tx.URL_NAMESPACE, F.col("n"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    paths = spark.createDataFrame([("a/b_c__d.PDF.pptx",), ("notes.md",), ("x.v2.txt",)], "p string")
    assert [r[0] for r in paths.select(tx.title_from_filename(F.col("p"))).collect()] == ["b c d", "notes", "x.v2"]
    long = spark.createDataFrame([("  a\n b ",), ("x" * 81,), ("y" * 80,)], "t string")
    assert [r[0] for r in long.select(tx.conversation_title(F.col("t"))).collect()] == ["a b", "x" * 79 + "…", "y" * 80]


def test_chunk_ids(spark):
    got = spark.range(1).select(library.chunk_id(F.lit("d"), F.lit(3), F.lit(2), F.lit("text"))).first()[0]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, f"document=d\nposition=3\npage=2\ntext={hashlib.sha256(b'text').hexdigest()}"))


def test_history_keeps_answered_turns(spark):
    rows = [(str(i), "c", i, "user" if i % 2 == 0 else "assistant", f"m{i}", ("answered" if i != 3 else "abstained", None, None)) for i in range(10)]
    got = sorted((r["turn"], r["position"]) for r in dialogue.history(spark.createDataFrame(rows, MESSAGE), 6).collect())
    assert got == [(0, 4), (1, 5), (2, 6), (3, 7), (4, 8), (5, 9)]


def test_positions_are_contiguous(spark):
    messages = spark.createDataFrame([("1", "c", 4, "user", "x", None)], MESSAGE)
    conversations = spark.createDataFrame([("c",), ("e",)], "id string")
    start = dialogue.next_positions(messages, conversations)
    new = spark.createDataFrame([("c", 0), ("c", 1), ("e", 0), ("gone", 0)], "conversation_id string, seq int")
    assert sorted((r["conversation_id"], r["position"]) for r in dialogue.appended(new, start).collect()) == [("c", 5), ("c", 6), ("e", 0)]


def test_restored_searches(spark):
    rows = [("1", "c", 0, "user", "q", None), ("2", "c", 1, "assistant", "a", (None, None, "q")), ("3", "c", 2, "user", "and?", None), ("4", "c", 3, "assistant", "b", ("error", None, "full q"))]
    got = {r["id"]: (r["status"], r["shown_search"]) for r in dialogue.restored(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert got == {"2": ("answered", None), "4": ("error", "full q")}


def test_recency_by_calendar_day(spark):
    days = [datetime(2026, 3, 10, 23), datetime(2026, 3, 9, 1), datetime(2026, 3, 4, 1), datetime(2026, 3, 3, 23)]
    df = spark.createDataFrame([(d,) for d in days], "t timestamp")
    assert [r[0] for r in df.select(dialogue.recency(F.col("t"), F.lit("2026-03-10").cast("date"))).collect()] == ["today", "yesterday", "week", "older"]


def test_event_contract(spark):
    streams = {"ok": ["conversation", "status", "status", "claim", "citations", "completed"], "no end": ["conversation", "status"], "late": ["conversation", "abstention", "status"], "abstains": ["conversation", "status", "abstention"], "headless": ["status", "completed"]}
    rows = [(k, i, t) for k, v in streams.items() for i, t in enumerate(v)]
    got = {r["k"]: r["valid"] for r in dialogue.contract_errors(spark.createDataFrame(rows, "k string, seq int, type string"), "k").collect()}
    assert got == {"ok": True, "no end": False, "late": False, "abstains": True, "headless": False}


def test_maintenance(spark):
    stored = spark.createDataFrame([("a", "p"), ("b", None)], "id string, embedding_provider string")
    incoming = spark.createDataFrame([("a", "p"), ("a2", "p"), ("b", None), ("b", "p")], "id string, embedding_provider string")
    assert sorted(tuple(r) for r in library.unchanged(incoming, stored).collect()) == [("a2", "p"), ("b", "p")]
    versions = spark.createDataFrame([("1", "c", "f", datetime(2026, 1, 1)), ("2", "c", "f", datetime(2026, 1, 2)), ("3", "d", "f", datetime(2025, 1, 1))], "id string, course_id string, source_filename string, created_at timestamp")
    assert sorted(r["id"] for r in library.current_versions(versions).collect()) == ["2", "3"]
    chunks = spark.createDataFrame([("d", 0, "x"), ("d", 1, "y"), ("e", 0, "z")], "document_id string, chunk_position int, id string")
    fresh = spark.createDataFrame([("d", 0, "x"), ("e", 0, "z")], "document_id string, chunk_position int, id string")
    assert {r["document_id"]: r["fits"] for r in library.reembedding(chunks, fresh).collect()} == {"d": False, "e": True}


def test_structure(spark):
    text = "# Title\nintro\n## One\n```\n# not a heading\n```\n### Deep #\n\n## Two\nend"
    lines = structure.numbered_lines(spark.createDataFrame([(1, text)], "id int, text string"), "id")
    assert [(r["line"], r["path"]) for r in structure.headings(lines, "id").orderBy("line").collect()] == [(1, "Title"), (3, "Title > One"), (7, "Title > One > Deep"), (9, "Title > Two")]
    assert [(r["first_line"], r["last_line"]) for r in structure.blocks(lines, "id").orderBy("first_line").collect()] == [(1, 7), (9, 10)]
    rows = [(1, "t", ["a"], 30), (2, "t", ["a", "b"], 40), (3, "u", ["c"], 30), (4, "v", ["c"], 30), (6, "v", ["c", "d"], 30)]
    rows += [(10, None, ["e"], 30), (11, None, ["e", "f"], 30), (20, "w", ["x"], 19), (21, "w", ["y"], 20), (30, "", ["p"], 5), (31, "", ["p", "q"], 40)]
    pages = spark.createDataFrame([("d", *r) for r in rows], "doc string, page int, title string, lines array<string>, letters int")
    assert sorted(r["page"] for r in structure.without_overlays(pages, "doc").collect()) == [2, 3, 6, 10, 11, 21, 30, 31]
    quiz = "\n".join(f"{i}. Question\na) x\nb) y" for i in range(1, 5))
    quiz_lines = structure.numbered_lines(spark.createDataFrame([(1, quiz), (2, "1. a\n\n\n\n2. b")], "id int, text string"), "id")
    assert [tuple(r) for r in structure.questions(quiz_lines, "id").collect()] == [(1, 4)]
    cells = spark.createDataFrame([("s", 1, ["Label", "", "3"]), ("s", 2, ["1", "2"]), ("s", 3, ["", " "])], "sheet string, row int, cells array<string>")
    assert [r["text"] for r in structure.sheet_rows(cells, "sheet", "row", "cells").collect()] == ["Label | 3"]
    assert structure.numeric_rows(cells, "sheet", "cells").first()["numeric_rows"] == 1


def test_running_values_over_blocks(spark):
    from pyspark.sql import Window

    from groundline.operators.ordered import last_before

    rows = spark.range(400).selectExpr("id", "id % 3 as k", "cast(pmod(xxhash64(id), 90) as int) as at", "case when pmod(xxhash64(id, 1), 4) = 0 then id end as v")
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = {r["id"]: r["x"] for r in rows.withColumn("x", F.last("v", ignorenulls=True).over(w)).collect()}
    assert {r["id"]: r["x"] for r in last_before(rows, ["k"], "at", F.col("v"), "id", "x", size=7).collect()} == want
