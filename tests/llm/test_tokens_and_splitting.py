import random

import pytest

from groundline.llm import splitting, tokens

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("ref", pat_str=PATTERN, mergeable_ranks=tokens.ranks(tokens.read(tokens.VOCABULARY)), special_tokens={})


def noise(seed, n, most):
    rng = random.Random(seed)
    parts = ["'s", "'", "s", "t", "ll", "'ll", " ", "  ", "\n", "\t", "\r\n", "é", "é", "1", "²", "٣", "中文", "ที่", "!", "<|endoftext|>", "😀", "‍", "\xa0", "\x1c", "don't", "_"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_blocks_equal_the_regex_tokenizer(reference):
    texts = noise(1, 3000, 25) + ["", None, "x" * 5000, " " * 300, "'" * 9]
    ids, ends, at = tokens.encode_block(texts)
    for i, text in enumerate(texts):
        got = ids[ends[i] : ends[i + 1]].tolist()
        assert got == reference.encode_ordinary(text or "")
        assert tokens.decode(got) == (text or "")
        assert not len(at[ends[i] : ends[i + 1]]) or at[ends[i]] == 0


def test_plain_merge_equals_compiled():
    rank = tokens.ranks(tokens.read(tokens.VOCABULARY))
    compiled = tokens.merger(rank)
    for text in ("hello", " unbelievable", "Straßenbahn", "中文字符", "aaaaaaaaaaaa", *(t.replace(" ", "") for t in noise(5, 200, 30) if t.strip())):
        assert tokens.merge(text.encode(), rank) == list(compiled(text.encode()))


def test_frame_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b", 0), (1, "a b", 0), (2, None, 1), (3, "", 2), (None, "x" * 40_000, 3)]
    got = tokens.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids int"), offsets=True)
    assert got.columns == ["doc_id", "ids", "offsets"]
    rows = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert rows[2] == [] and rows[3] == [] and len(rows[None]) > 1 and got.count() == 5
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def greedy(text, size, overlap):
    """The cuts one after the other, from the boundaries of a text alone."""
    kinds = [k.nonzero()[0].tolist() for k in splitting.kinds(splitting.Flat([text]))]
    out, start = [], 0
    while True:
        high, low = min(start + size, len(text)), start + max(size // 2, overlap)
        end = high
        if high < len(text):
            for places in kinds:
                fit = [p for p in places if low < p <= high]
                if fit:
                    end = fit[-1]
                    break
        out.append(end)
        if end == len(text):
            return out
        start = end - overlap


def test_pointer_doubling_equals_greedy_cuts():
    rng = random.Random(3)
    words = ["alpha", "beta.", "gamma!", "delta\n", "eps\n\n", "中文。", "é", "👍🏽", "(x).", "longlonglonglong" * 4]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(60)] + ["x" * 777, "é" * 101]
    for size, overlap in ((100, 15), (64, 0), (200, 60)):
        large = [t for t in texts if len(t) > size]
        for text, ends in zip(large, splitting.cuts(large, size, overlap)):
            assert ends.tolist() == greedy(text, size, overlap)


def test_pieces_cover_the_text(spark):
    text = "Une phrase courte. " * 300 + "\n\n" + "mot " * 500 + "x" * 2500
    rows = [("a", text, "T", 4), ("a", text, "T", 4), ("b", "y" * 1000, None, 1), ("c", None, None, 1), ("d", "", None, 2), ("e", "z" * 1001, None, 3)]
    got = splitting.split_oversized(spark.createDataFrame(rows, "id string, text string, section_title string, chunk_position int"))
    by = {}
    for r in got.orderBy("id", "piece").collect():
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {"a", "e"}
    for key, whole in (("a", text), ("e", "z" * 1001)):
        pieces = by[key]
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and pieces[0]["start"] == 0 and pieces[-1]["end"] == len(whole)
        assert all(len(r["text"]) <= 1000 and r["text"] == whole[r["start"] : r["end"]] for r in pieces)
        assert all(a["end"] - b["start"] == 150 for a, b in zip(pieces, pieces[1:]))
    assert {r["section_title"] for r in by["a"]} == {"T"} and {r["chunk_position"] for r in by["a"]} == {4}
    clash = spark.createDataFrame([("a", "w " * 900, 1, 2)], "id string, text string, piece int, start int")
    assert splitting.split_oversized(clash, carry=("piece",)).columns == ["id", "piece", "start", "end", "text"]
    assert splitting.split_oversized(spark.createDataFrame([], got.schema), carry=()).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(got, size=100, overlap=60)
