import numpy as np
import pytest

from groundline.llm.codepoints import scan
from groundline.llm import sentences

CASES = {
    "latin": ["He came (see p. 4). ", "Dr. A. Smith measured 3.14 s, i.e. pi! ", "“Why?” asked Mr. Jones. ", "It ends etc. ", "Then no. 5 follows… ", "And type B. ", "Who?"],
    "french": ["Selon M. Dupont, la fig. 3 (cf. annexe P) suffit ! ", "« Que vaut x ? » demande Mme Roy. ", "Notes, etc. ", "À l'étape 3, voir p. ex. le tableau... puis la suite."],
    "german": ["Z. B. die Zelle bleibt, d. h. sie gilt (vgl. S. 12). ", "„Was ist das?“ fragt das Blatt. ", "Lt. Prof. Weber gilt es."],
    "chinese": ["讲义写道：“包含70个元素。”", "因此，需要3.5秒……", "真的吗？", "是"],
    "japanese": ["「何か？」と書かれている。", "値は3.2である！"],
    "hindi": ["डॉ. Rao के अनुसार मान 3.5 है। ", "क्या यह सही है?"],
    "arabic": ["وفق د. Smith، القيمة 3.5. ", "ما هي القيمة؟ ", "نعم."],
    "thai": ["ในบทที่23กราฟกำหนดข้อมูล ", "ดังนั้นมี3.5องค์ประกอบ\n", "เราใช้ระบบ"],
    "layout": ["# A heading. With a stop\n", "Text one is\nwrapped here. ", "Text two\n\n", "---\n\n- item one. still item\n", "- item two\n\n", "| a | b. c |\n", "|---|---|\n| 1 | 2 |\n\n", "A. Smith ends it\r\n\r\n", "1) First\n", "2) Second."],
}


@pytest.mark.parametrize("name", CASES)
def test_units(name):
    pieces = CASES[name]
    ends, at = [], 0
    for piece in pieces:
        ends.append(at + len(piece.rstrip()))
        at += len(piece)
    owner, got = sentences.unit_ends([None, "".join(pieces), ""])
    assert set(owner.tolist()) == {1} and got.tolist() == ends


def test_texts_without_units():
    owner, _ = sentences.unit_ends([None, "", " \n ", "---\n***", "…", "!?"])
    assert not len(owner)


def test_scan_equals_stepping():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 15, 17, 300, 5000):
        table, symbols = rng.integers(0, 7, (5, 7)).astype(np.uint8), rng.integers(0, 5, n)
        state, want = 3, []
        for s in symbols:
            want.append(state)
            state = table[s, state]
        assert scan(table, symbols, 3).tolist() == want


def test_a_block_does_not_change_units():
    texts = ["".join(p) for p in CASES.values()]
    owner, ends = sentences.unit_ends(texts)
    for i, text in enumerate(texts):
        assert ends[owner == i].tolist() == sentences.unit_ends([text])[1].tolist()


def test_frames(spark):
    rows = [(1, "Aa bb. Cc dd.", 0), (1, "Aa bb. Cc dd.", 0), (2, None, 0), (3, "", 0), (4, "Word " * 20_000 + "end. Next one.", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, end_pos int")
    got = sorted(tuple(r) for r in sentences.sentence_ends(docs).collect())
    assert got == [(1, 6), (1, 6), (1, 13), (1, 13), (4, 100_004), (4, 100_014)]
    cut = sentences.sentences(docs.limit(1)).collect()
    assert [(r["sentence"], r["start_pos"], r["text"]) for r in cut] == [(0, 0, "Aa bb."), (1, 7, "Cc dd.")]
    assert sentences.sentence_ends(docs.limit(0)).count() == 0
