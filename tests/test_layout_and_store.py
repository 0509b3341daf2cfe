from datetime import datetime

from pyspark.sql import functions as F

from groundline.operators import layout, store, structure
from groundline.plans import answering

LINE = "doc_id string, page int, idx int, text string, size double, top double, bottom double, block int, highlighted boolean, box array<double>"


def line(page, idx, text, size=12.0, top=100.0, block=1, marked=False):
    return ("d", page, idx, text, size, top, top + 10, block, marked, [0.0, top, 100.0, top + 10])


def test_margins_titles_and_sections(spark):
    rows = []
    for p in range(1, 5):
        rows += [line(p, 0, f"Title {p}", 24.0, 20.0, 0), line(p, 1, "body text of the page", 12.0, 200.0), line(p, 2, "more body text here", 12.0, 220.0), line(p, 3, f"Course A - {p} / 4", 9.0, 580.0, 9), line(p, 4, f"{p}", 9.0, 590.0, 10)]
    lines = spark.createDataFrame(rows, LINE)
    pages = spark.createDataFrame([("d", p, 800.0, 600.0) for p in range(1, 6)], "doc_id string, page int, width double, height double")
    body = layout.body_size(lines)
    assert body.first()["body"] == 12.0
    kept = layout.without_boilerplate(lines, pages)
    assert {r["text"] for r in kept.filter("page = 2").collect()} == {"Title 2", "body text of the page", "more body text here"}
    assert {r["text"] for r in layout.slide_titles(kept, body).filter("is_title").collect()} == {f"Title {p}" for p in range(1, 5)}
    assert [r["page"] for r in layout.empty_pages(pages, kept).collect()] == [5]
    groups = {r["page"]: (r["heading"], r["items"]) for r in layout.items(layout.sections(kept, body)).collect()}
    assert groups[1] == ("Title 1", ["body text of the page more body text here"])
    assert all(r["titled"] == (r["page"] < 5) for r in layout.page_is_titled(layout.sections(kept, body), pages).collect())


def test_joining_of_lines(spark):
    groups = [
        [("•first item", 1, False), ("goes on with a hyphen-", 1, False), ("ated word.", 1, False), ("Next", 1, False)],
        [("a) yes", 1, True), ("b) no", 1, False), ("plain", 2, True), ("after", 2, False)],
        [("-", 1, False), ("text of it", 1, False), ("–", 3, False), ("•", 4, False), ("•", 4, False), ("•", 4, False), ("last", 5, False)],
        [("Over", 1, False), ("1. Which", 1, False), ("A. this", 1, False), ("e-", 1, False), ("Mail", 1, False)],
    ]
    rows = [("d", 1, s, i, t, b, m, False) for s, g in enumerate(groups) for i, (t, b, m) in enumerate(g)] + [("d", 1, 3, 10 + i, t, 1, False, True) for i, t in enumerate(("A long arith-", "métique  of", "Things"))]
    df = spark.createDataFrame(rows, "doc_id string, page int, section int, idx int, text string, block int, highlighted boolean, is_heading boolean")
    got = {r["section"]: (r["heading"], r["items"]) for r in layout.items(df).collect()}
    assert got[0] == (None, ["- first item goes on with a hyphenated word.", "Next"])
    assert got[1] == (None, ["a) yes ✔ (réponse surlignée)", "b) no", "plain [surligné]", "after"])
    assert got[2] == (None, ["- text of it", "–", "- last"])  # an item of dashes alone is none
    assert got[3] == ("A long arithmétique of Things", ["Over", "1. Which", "A. this e- Mail"])


def test_page_texts_titles_and_questions(spark):
    groups = [("d", 1, 1, "Title", ["- a", "b"]), ("d", 1, 2, "More", []), ("d", 2, 0, None, ["x"])]
    sheet = [line for n in (1, 2, 7) for line in (f"{n}. What?", "A. one", "B. two")]
    groups += [("q", 1, 0, None, ["intro"]), ("q", 1, 1, "Part", ["lead", *sheet[:4]]), ("q", 1, 2, "Rest", sheet[4:]), ("q", 2, 1, "Few", sheet[:3]), ("q", 2, 2, "Bare", [])]
    df = spark.createDataFrame(groups, "doc_id string, page int, section int, heading string, items array<string>")
    titled = spark.createDataFrame([("d", 1, True), ("d", 2, False)], "doc_id string, page int, titled boolean")
    pages = layout.page_texts(df.filter("doc_id = 'd'"), titled)
    assert {r["page"]: (r["title"], r["body"], r["text"], r["letters"], len(r["lines"])) for r in pages.collect()} == {1: ("Title", "- a\nb\nMore", "Title\n- a\nb\nMore", 6, 4), 2: (None, "x", "x", 1, 1)}
    assert structure.without_overlays(pages, "doc_id").count() == 2
    assert [tuple(r) for r in layout.document_titles(pages).collect()] == [("d", "Title")] and layout.document_titles(pages.filter("page > 1")).first()["title"] is None
    got = [(r["page"], r["segment"], r["heading"], r["text"]) for r in layout.question_segments(df.filter("doc_id = 'q'")).orderBy("page", "segment").collect()]
    ask = lambda n: f"{n}. What?\nA. one\nB. two"
    assert got == [(1, 0, None, "intro"), (1, 1, "Part", "lead"), (1, 2, "Question 1", ask(1)), (1, 3, "Question 2", ask(2)), (1, 4, "Question 7", ask(7)), (2, 0, "Few", ask(1)), (2, 1, "Bare", "")]


def test_spans_images_and_notes(spark):
    spans = "array<struct<text: string, size: double, origin_y: double, flags: int>>"
    df = spark.createDataFrame([([("x", 12.0, 100.0, 0), ("2", 8.0, 95.0, 0), (" + y", 12.0, 100.0, 0), ("i", 8.0, 103.0, 0), ("n", 12.0, 100.0, 1)],)], f"s {spans}")
    assert df.select(layout.span_text(F.col("s"), F.lit(12.0), F.lit(100.0))).first()[0] == "x^2 + y_i^n"
    pages = spark.createDataFrame([("d", 1, 100.0, 100.0), ("d", 2, 100.0, 100.0)], "doc_id string, page int, width double, height double")
    images = spark.createDataFrame([("d", 1, -10.0, 0.0, 50.0, 50.0), ("d", 1, 50.0, 50.0, 200.0, 200.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert {r["page"]: r["image_share"] for r in layout.image_share(images, pages).collect()} == {1: 0.5, 2: 0.0}
    lines = spark.createDataFrame([line(1, 0, "a", top=10.0), line(1, 1, "b", top=50.0)], LINE)
    notes = spark.createDataFrame([("d", 1, 0.0, 8.0, 40.0, 18.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert {r["text"]: r["highlighted"] for r in layout.highlighted(lines, notes).collect()} == {"a": True, "b": False}
    assert spark.createDataFrame([("ﬁn  d\x00e\n",)], "t string").select(layout.clean(F.col("t"))).first()[0] == "fin de"


def test_markdown_segments(spark):
    text = "# Title\nintro\n\n---\n## One\nbody one\n### Deep\n\n\n\nbody deep\n## Two"
    lines = structure.numbered_lines(spark.createDataFrame([(1, text), (2, "plain\ntext")], "id int, text string"), "id")
    got = [(r["id"], r["path"], r["text"], r["lines"]) for r in structure.markdown_segments(lines, "id").orderBy("id", "segment").collect()]
    assert got == [(1, None, "intro", [1, 2]), (1, "One", "body one", [5, 6]), (1, "One > Deep", "body deep", [7, 11]), (1, "Two", "", [12]), (2, None, "plain\ntext", [1, 2])]


DOC = "id string, course_id string, source_filename string, embedding_provider string"
CHUNK = "id string, document_id string, course_id string, chunk_position int, embedding array<float>"


def test_import_outcomes(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    docs = lambda *rows: spark.createDataFrame(rows, DOC)
    chunks = lambda *rows: spark.createDataFrame(rows, CHUNK)
    run = lambda d, c: {r["id"]: r["outcome"] for r in store.import_documents(s, d, c, 2).collect()}
    assert run(docs(("a", "c", "f.md", "p"), ("x", "c", "g.md", "p")), chunks(("a0", "a", "c", 0, [1.0, 0.0]), ("x0", "x", "c", 0, [float("nan"), 0.0]))) == {"a": "imported", "x": "refused"}
    assert run(docs(("a", "c", "f.md", "p")), chunks(("a0", "a", "c", 0, [1.0, 0.0]))) == {"a": "unchanged"}
    assert run(docs(("a", "c", "f.md", "q")), chunks(("other", "a", "c", 0, [0.0, 1.0]))) == {"a": "refused"}
    assert run(docs(("a", "c", "f.md", "q")), chunks(("a0", "a", "c", 0, [0.0, 1.0]))) == {"a": "re-embedded"}
    assert s.read("chunks").first()["embedding"] == [0.0, 1.0]
    assert run(docs(("b", "c", "f.md", "q")), chunks(("b0", "b", "c", 0, [1.0, 1.0]))) == {"b": "imported"}
    assert [r["id"] for r in s.read("documents").collect()] == ["b"] and [r["id"] for r in s.read("chunks").collect()] == ["b0"]


def test_conversations(spark):
    rows = spark.createDataFrame([("a", "old", datetime(2026, 1, 1)), ("b", "x", datetime(2026, 1, 2))], "id string, title string, updated_at timestamp")
    names = spark.createDataFrame([("a", " new  title "), ("b", "  "), ("z", "q")], "id string, title string")
    assert {r["id"]: r["title"] for r in store.renamed(rows, names).collect()} == {"a": "new title", "b": "x"}
    asked = spark.createDataFrame([("a", "q?", "s"), ("nope", "What is it?", "s")], "asked_id string, question string, scope string")
    got = {r["asked_id"]: r for r in store.start_or_continue(rows, asked).collect()}
    assert got["a"]["id"] == "a" and not got["a"]["is_new"] and got["nope"]["id"] != "nope" and got["nope"]["title"] == "What is it?"
    messages = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, conversation_id string")
    left = store.removed(rows, messages, spark.createDataFrame([("a",)], "id string"))
    assert [r["id"] for r in left[0].collect()] == ["b"] and [r["id"] for r in left[1].collect()] == ["2"]
    assert [r["id"] for r in store.listed(rows, 1).collect()] == ["b"]


class Fixed:
    def embed(self, texts, kind):
        return [[1.0, 0.0] for _ in texts]


def test_answers(spark):
    kind = "chunk_id string, document_id string, subject string, course_id string, title string, source_filename string, section_title string, physical_page_number int, text string, embedding array<float>"
    rows = [("k1", "d", "s", "c", None, "f.md", None, 3, "\nFirst line.\nSecond", [1.0, 0.1]), ("k2", "d", "s", "c2", "T", "g.md", "S", 1, "Other", [0.0, 1.0])]
    chunks = spark.createDataFrame(rows, kind)
    events = list(answering.answer(spark, chunks, Fixed(), answering.Quoting(), " q? "))
    assert [e["type"] for e in events] == ["conversation", "status", "status", "claim", "citations", "completed"]
    assert events[3]["text"] == "First line." and events[4]["citations"][0]["quotes"] == ["First line"]
    assert [e["type"] for e in answering.answer(spark, chunks, Fixed(), answering.Quoting(), "q?", course_id="c2")] == ["conversation", "status", "abstention"]
    assert [e["type"] for e in answering.answer(spark, chunks, Fixed(), answering.Quoting(), "  ")] == ["error"]

    class Cut(answering.Quoting):
        def rewrite(self, history, question):
            raise RuntimeError

        def stream(self, prompt):
            yield '{"claims": [{"text": "a", "sources": [{"id": "s1", "quote": "nothing like it"}, {"id": "S9"}]}, {"te'

    events = list(answering.answer(spark, chunks, Fixed(), Cut(), "q?", [("user", "before")]))
    assert [e["type"] for e in events][-3:] == ["claim", "citations", "completed"]
    assert events[-2]["citations"][0]["spans"] == [(0, len(rows[0][8]))] and events[-3]["citations"] == [1]
