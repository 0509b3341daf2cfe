import io
import json
import random
import zipfile

from pyspark.sql import functions as F

from groundline.operators import chunking, events, imports, retrieval, structure
from groundline.sources import files
from groundline.streaming import claims, ingest

ANSWER = json.dumps({"note": "x", "claims": [{"text": 'a "}" b', "sources": [{"id": "S1", "quote": "q"}]}, {"text": "c\\", "sources": [{"id": " s2 ", "quote": ""}, {"id": "x"}]}]})


def test_discovery_of_both_layouts(spark):
    paths = ["maths/algebra/a.md", "maths/algebra/sub/b.PDF", "maths/.hidden/c.md", "physics/d.txt", "physics/deep/e.xlsx", "loose.md", "maths/algebra/g.jpeg", "art/algebra/h.md"]
    df = spark.createDataFrame([(f"file:/data/{p}",) for p in paths], "path string")
    found = files.course_files(df, "/data")
    got = {r["path"][11:]: (r["subject"], r["course_id"], r["source"], r["reason"]) for r in found.collect()}
    assert got["maths/algebra/a.md"] == ("maths", "algebra", "a.md", None)
    assert got["maths/algebra/sub/b.PDF"] == ("maths", "algebra", "sub/b.PDF", None)
    assert got["physics/d.txt"] == ("Général", "physics", "d.txt", None)
    assert got["physics/deep/e.xlsx"] == ("Général", "physics", "deep/e.xlsx", None)
    assert got["loose.md"][3] == "not in a course" and got["maths/algebra/g.jpeg"][3] == "unsupported kind"
    assert "maths/.hidden/c.md" not in got
    assert [r["course_id"] for r in files.courses_under_two_subjects(found).collect()] == ["algebra"]


def test_path_safety():
    assert files.safe_path("a/b.md") and files.safe_path("A.PDF")
    assert not any(map(files.safe_path, ["../a.md", "/a.md", "a.exe", "", "x" * 600 + ".md", "a/../../b.md"]))


def test_decoding(spark):
    rows = [(bytearray("﻿é\r\nx".encode()),), (bytearray("é\rx".encode("latin-1")),), (bytearray("é".encode()),)]
    df = spark.createDataFrame(rows, "content binary")
    assert [r[0] for r in df.select(files.decoded(F.col("content"))).collect()] == ["é\nx", "é\nx", "é"]


def workbook() -> bytes:
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="T" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>mean  value</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>0.1234567</v></c></row><row r="3"><c r="A3"><v>5</v></c><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbooks(spark):
    df = spark.createDataFrame([("a.xlsx", bytearray(workbook())), ("b.XLSX", bytearray(b"no")), ("c.md", bytearray(b""))], "path string, content binary")
    got = {(r["path"], r["row"]): (r["sheet_name"], r["cells"], r["error"]) for r in files.sheet_rows(df).collect()}
    assert got == {("a.xlsx", 2): ("T", ["mean value", "", "0.123457"], None), ("a.xlsx", 3): ("T", ["5", "True"], None), ("b.XLSX", None): (None, None, "BadZipFile")}


def test_question_sets_and_events(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"question": "a", "targets": [{"source": "s", "match": "m"}]}], "off_topic": ["b"]}))
    assert sorted((r["question"], len(r["targets"])) for r in files.question_set(spark, str(tmp_path / "q.json")).collect()) == [("a", 1), ("b", 0)]
    events = spark.createDataFrame([("x", None), ("y", 1)], "type string, n int")
    files.write_events(events, str(tmp_path / "e"))
    assert sorted(map(str, files.read_events(spark, str(tmp_path / "e"), "type string, n int").collect())) == sorted(map(str, events.collect()))


def test_claims_do_not_depend_on_fragments():
    whole = claims.ClaimParser().feed(ANSWER)
    assert len(whole) == 2
    rng = random.Random(2)
    for size in (1, 7, None):
        parser, got, i = claims.ClaimParser(), [], 0
        while i < len(ANSWER):
            n = size or rng.randint(1, 20)
            parser = claims.ClaimParser(json.loads(json.dumps(parser.state())))
            got += parser.feed(ANSWER[i : i + n])
            i += n
        assert got == whole and parser.finished


def test_claim_batch_and_validation(spark):
    rows = [("a", i // 7, ANSWER[i : i + 7]) for i in range(0, len(ANSWER), 7)] + [("cut", 0, ANSWER[:120]), ("bad", 0, '{"claims": [1]}'), ("none", 0, "x")]
    got = claims.parse_answers(spark.createDataFrame(rows, "answer_id string, seq int, fragment string"))
    assert sorted((r["answer_id"], r["claim"], r["finished"]) for r in got.collect()) == [("a", 0, True), ("a", 1, True), ("cut", 0, False)]
    assert sorted((r["answer_id"], r["claim"], r["sources"]) for r in claims.validated(got, spark.createDataFrame([("a", 1), ("a", 2), ("cut", 1)], "answer_id string, label int")).collect()) == [("a", 0, [1]), ("a", 1, [2]), ("cut", 0, [1])]
    assert claims.validated(got, spark.createDataFrame([("a", 7)], "answer_id string, label int")).count() == 0


def test_claim_stream_waits_for_missing_fragments(spark, tmp_path):
    parts = [("a", i // 9, ANSWER[i : i + 9]) for i in range(0, len(ANSWER), 9)]
    kind = "answer_id string, seq int, fragment string"
    spark.createDataFrame(parts[3:], kind).coalesce(1).write.json(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", True).json(str(tmp_path / "in"))

    def run():
        query = claims.claim_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r["claim"] for r in spark.read.schema(claims.OUTPUT).parquet(str(tmp_path / "out")).collect())

    assert run() == []
    spark.createDataFrame(parts[:3], kind).coalesce(1).write.json(str(tmp_path / "in" / "a"))
    assert run() == [0, 1]


def test_import_is_incremental(spark, tmp_path):
    folder = tmp_path / "course"
    folder.mkdir()
    (folder / "a.md").write_text("# Title\n\n## One *a*\nfirst\n\n## Two\n\n### Three\nlast")
    (folder / "p.pdf").write_bytes(b"%PDF")
    seen = []
    run = lambda: ingest.watch(spark, str(folder), str(tmp_path / "store"), str(tmp_path / "cp"), "s", "c", lambda b: seen.extend(tuple(r) for r in b.collect())).awaitTermination()
    run()
    (folder / "b.txt").write_text("more text")
    (folder / "c.txt").write_text(" ")
    (folder / "d.exe").write_text("x")
    run()
    assert sorted(seen) == [("a.md", "prepared", 2), ("b.txt", "prepared", 1), ("c.txt", "no text", 0), ("d.exe", "unsupported", 0), ("p.pdf", "no reader", 0)]
    stored = spark.read.parquet(str(tmp_path / "store")).orderBy("source", "chunk_position").collect()
    assert [(r["source"], r["chunk_position"], r["section_title"], r["text"]) for r in stored] == [("a.md", 0, "One a", "One a\nfirst"), ("a.md", 1, "Two > Three", "Three\nlast"), ("b.txt", 0, None, "more text")]


def test_plain_dividers_need_company(spark):
    rows = [("d", 1, None, None, ["A"]), ("d", 2, "plain", "Practice", []), ("d", 3, None, None, ["B"])] + [("e", p, "plain" if p % 2 else None, f"P{p}", []) for p in range(1, 5)]
    got = {(r["doc"], r["page"]): r["section_title"] for r in imports.with_sections(spark.createDataFrame(rows, "doc string, page int, kind string, title string, heading_path array<string>"), "doc", ["page"]).collect()}
    assert got == {("d", 1): "A", ("d", 2): "A", ("d", 3): "B", ("e", 1): "P1", ("e", 2): "P1", ("e", 3): "P3", ("e", 4): "P3"}


def test_event_streams(spark):
    kind = "id string, payload struct<status: string, claims: array<struct<text: string, citations: array<int>>>, citations: array<string>>"
    answers = [("a", ("answered", [("x", [1]), ("y", [1])], ["{}"])), ("b", ("answered", [("x", [1])], [])), ("c", ("abstained", [("x", [1])], None)), ("d", ("error", [("x", [1])], None)), ("e", None), ("f", (None, None, None))]
    messages = spark.createDataFrame(answers, kind)
    told = events.told(messages)
    assert [r["type"] for r in told.filter("id = 'a'").orderBy("seq").collect()] == ["conversation", "status", "claim", "claim", "citations", "completed"]
    got = {r["id"]: (r["status"], r["claims"]) for r in events.shown(told, "id").collect()}
    assert got == {"a": ("answered", ["x", "y"]), "b": ("answered", ["x"]), "c": ("abstained", []), "d": ("error", ["x"]), "e": ("open", []), "f": ("open", [])}
    got = {r["id"]: (r["status"], r["claims"], r["citations"]) for r in events.settled(messages).collect()}
    assert got == {"a": ("answered", 2, 1), "b": ("error", 0, 0), "c": ("abstained", 0, 0), "d": ("error", 0, 0), "e": ("error", 0, 0), "f": ("error", 0, 0)}
    lines = events.as_lines(told).select("id", "seq", "line")
    extra = [("a", 9, '{"version": 2, "type": "status"}'), ("c", 1, '{"version": 2, "type": "status", "colour": "red"}'), ("g", 0, "no json"), ("g", 1, '{"version": 2, "type": "error"}'), ("h", 0, '{"version": 1, "type": "error"}')]
    got = {r["id"]: r["fault"] for r in events.faults(lines.unionByName(spark.createDataFrame(extra, "id string, seq int, line string")), "id").collect()}
    assert got == {"a": "event after the end", "b": None, "c": "not an event", "d": None, "e": "no end", "f": "no end", "g": "not an event", "h": "not an event"}


def test_small_rules(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a **b** **c", "x *y* `z`")], "t string, h string")
    assert tuple(rows.select(events.balanced_emphasis(F.col("t")), imports.plain_heading(F.col("h"))).first()) == ("a b c", "x y z")
    cutoffs = spark.createDataFrame([("local", None), ("deterministic", None), (None, None), ("local", 0.7)], "p string, g double")
    assert [r[0] for r in cutoffs.select(retrieval.cutoff_for(F.col("p"), F.col("g"))).collect()] == [0.4, 0.1, 0.1, 0.7]
    inputs = spark.createDataFrame([("a", "query"), ("b", "passage"), ("c", None)], "t string, k string")
    assert [r[0] for r in inputs.select(chunking.model_input(F.col("t"), F.col("k"), {"query": "query: ", "passage": "passage: "})).collect()] == ["query: a", "passage: b", "c"]
    found = spark.createDataFrame([(1, 1, 3), (1, 5, 9), (2, 1, 3)], "id int, first_line int, last_line int")
    marks = spark.createDataFrame([(1, 4), (1, 6), (1, 6), (1, 8), (3, 1)], "id int, line int")
    assert [tuple(r) for r in structure.marked_blocks(found, marks, "id").collect()] == [(1, 5, 9, 6)]
    scopes = spark.createDataFrame([((None, "c", None), (None, "c", None)), (("s", "c", None), (None, "c", None))], "a struct<subject: string, course_id: string, document_id: string>, b struct<subject: string, course_id: string, document_id: string>")
    assert [r[0] for r in scopes.select(events.same_scope(F.col("a"), F.col("b"))).collect()] == [True, False]
