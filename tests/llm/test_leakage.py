import random

import numpy as np

from groundline.llm import leakage

WORDS = "signal bound register penalty cache kernel window threshold estimator variance algorithm automaton schedule buffer lattice operator sequence residual gradient tensor polynomial index partition measure integral".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (f" {rng.randint(1, 999)}" if rng.random() < 0.2 else "") for _ in range(n)).capitalize() + "."


def passage(rng):
    return " ".join(sentence(rng, 12) for _ in range(5))


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = rng.integers(0, 3, rng.integers(1, 80)), rng.integers(0, 3, rng.integers(0, 120))
        assert leakage.myers(a, b) == distance(a.tolist(), b.tolist())


def test_share_of_an_item():
    item = np.arange(100)
    assert leakage.shares([item, item[:50]], [np.concatenate([np.full(30, 500), item[:60], np.full(30, 500)]), item]).tolist() == [0.6, 1]
    assert leakage.shares([item], [np.full(50, 500)])[0] == 0


def test_found_and_not_found(spark):
    rng = random.Random(5)
    items = {i: passage(rng) for i in range(12)} | {20: "有限记忆的估计量在二十次试验后取代零方差的电路，所以参考缓冲区包含一百个元素。当比例为九成时，文件描述了零方差的查询，所以表格总结了幅度为八的方差。"}
    docs, want = [], set()

    def put(text, item=None):
        docs.append((len(docs), text))
        if item is not None:
            want.add((item, len(docs) - 1))

    filler = lambda: passage(rng)
    put(filler() + " " + items[0] + " " + filler(), 0)  # whole
    words = items[1].split()
    put(" ".join([filler(), *words[: int(len(words) * 0.65)], filler()]), 1)  # a good part
    put(" ".join([filler(), *words[: int(len(words) * 0.25)], filler()]))  # a short quotation
    changed = [rng.choice(WORDS) if n % 8 == 5 else w for n, w in enumerate(items[2].split())]
    put(filler() + " " + " ".join(changed), 2)  # wording changed
    put(items[3].upper().replace(" ", "\n") + filler(), 3)  # layout and writing
    put("".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in items[4]), 4)  # full width
    put("# 章\n" + items[20].replace("，", "\n"), 20)
    put(items[5] + "\n\n" + items[6], 5)
    want.add((6, len(docs) - 1))
    put(None)
    put("")
    for _ in range(20):
        put(filler())
    long = len(docs)
    put(" ".join(filler() for _ in range(100)) + items[7] + filler(), 7)
    assert len(docs[long][1]) > 30_000
    d = spark.createDataFrame(docs, "doc_id int, text string").selectExpr("*", "text as item_id").repartition(3)
    q = spark.createDataFrame([*items.items(), (30, None), (31, "")], "item_id int, text string")
    got = {(r["item_id"], r["doc_id"]) for r in leakage.find_leaks(d, q).select("item_id", "doc_id").collect()}
    assert got == want


def test_equal_items_and_empty_tables(spark):
    rng = random.Random(6)
    text = passage(rng)
    q = spark.createDataFrame([(1, text), (2, text), (3, text), (4, text)], "item_id long, text string")
    d = spark.createDataFrame([(9, text), (9, text), (10, text)], "doc_id long, text string")
    assert sorted(tuple(r) for r in leakage.find_leaks(d, q).collect()) == [(i, j) for i in (1, 2, 3, 4) for j in (9, 10)]
    assert leakage.find_leaks(d, q.limit(0)).count() == 0 and leakage.find_leaks(d.limit(0), q).count() == 0


def test_slices_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i, passage(rng)) for i in range(6)]
    q, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(items, "doc_id long, text string")
    monkeypatch.setattr(leakage, "ITEMS", 1000)
    assert sorted(tuple(r) for r in leakage.find_leaks(d, q).collect()) == [(i, i) for i in range(6)]


def test_many_distances_at_once():
    rng = np.random.default_rng(1)
    patterns = [rng.integers(1, 4, n).astype(np.uint32) for n in rng.integers(1, 200, 80)]
    texts = [rng.integers(0, 4, n).astype(np.uint32) for n in rng.integers(0, 300, 80)]
    assert leakage.distances(patterns, texts).tolist() == [leakage.myers(p, t) for p, t in zip(patterns, texts)]


def spoiled(text, errors):
    """A text with errors of one character spread evenly, so that no run between two of them is long."""
    text = list(text)
    for k in range(errors):
        text[int((k + 0.5) * len(text) / errors)] = "ø"
    return "".join(text)


def test_every_half_within_the_promised_errors():
    rng = random.Random(8)
    bare = lambda t: "".join(c for c in t.lower() if c.isalnum())
    texts = [bare(passage(rng)) for _ in range(9)]
    texts += ["".join(rng.choice("有限记忆的估计量在二十次试验后取代零方差电路") for _ in range(120)), texts[0], texts[0]]  # shared pieces are searched too
    items = leakage.Items(list(range(len(texts))), texts)
    docs, want = [], set()
    for i, text in enumerate(texts):
        half = -(-len(text) // 2)
        for begin in (0, len(text) // 3, len(text) - half):
            docs.append(bare(passage(rng)) + spoiled(text[begin : begin + half], int(leakage.ERRORS * half)) + bare(passage(rng)))
            want |= {(len(docs) - 1, j) for j, other in enumerate(texts) if other == text}
    assert want <= set(leakage.find_block(items, docs))


def test_windows_and_parts_give_the_same(monkeypatch):
    rng = random.Random(9)
    texts = [passage(rng) for _ in range(5)]
    docs = [passage(rng) + " ".join(texts) + passage(rng), "", texts[2], passage(rng) + texts[3][: len(texts[3]) * 2 // 3]]
    items = leakage.Items(list(range(5)), texts)
    whole = leakage.find_block(items, docs)
    assert {(0, i) for i in range(5)} | {(2, 2), (3, 3)} == set(whole)
    for name, value in (("WINDOW", 100), ("HELD", 50), ("TOGETHER", 1)):
        monkeypatch.setattr(leakage, name, value)
    assert leakage.find_block(items, docs) == whole


def test_short_and_long_items():
    long = " ".join(passage(random.Random(10)) for _ in range(14))
    assert len(long) > 5000
    items = leakage.Items([0, 1], ["Yes, it is.", long])
    assert leakage.find_block(items, ["It says: yes it is so.", "Yes, it was.", long[: len(long) * 3 // 5]]) == [(0, 0), (2, 1)]
    item = np.arange(9000) % 5000 + np.arange(9000) // 5000 * 7000
    assert leakage.shares([item], [item[:6000]])[0] == 6000 / 9000


def bare_of(text):
    cps = leakage.folding()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    return cps[cps > 0]


def test_only_hits_that_stand_close_are_taken_further():
    """Of words of the items in any order next to nothing is sorted, and no hit that a place needs is left out."""
    rng = random.Random(11)
    texts = [passage(rng) for _ in range(6)] + ["零方差的电路" * 3 + "有限记忆的估计量在二十次试验后取代参考缓冲区包含一百个元素。" * 2]
    items = leakage.Items(list(range(len(texts))), texts)
    some = [texts[0], spoiled(texts[1], 30), texts[2][: len(texts[2]) * 2 // 3], texts[6] * 2, texts[3][200:] + texts[3][:200]]
    scattered = [rng.choice(WORDS) if rng.random() < 0.1 else "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(9000)]
    for text, most in ((" ".join(passage(rng) + " " + s for s in some), 1), (" ".join(scattered), 0.02)):
        bare = bare_of(text)
        hits = []
        for length, (keys, first, item, offset, *_) in items.postings.items():
            for at, h in enumerate(leakage.pieces(bare, length).tolist()):
                k = int(np.searchsorted(keys, np.uint64(h)))
                if k < len(keys) and int(keys[k]) == h:
                    hits += [(int(item[p]), at - int(offset[p]), int(offset[p])) for p in range(first[k], first[k + 1])]
        got = [(i, base + d, o) for base, *found in items.hits(bare, np.arange(len(bare))) for i, d, o in zip(*(x.tolist() for x in found))]
        assert len(got) == len(set(got)) and set(got) <= set(hits) and len(got) <= most * len(hits)
        want = set()
        for i in range(len(texts)):
            mine = sorted(h for h in hits if h[0] == i)
            diagonals = np.array([d for _, d, _ in mine])
            ends = np.searchsorted(diagonals, diagonals + 3 * int(items.step[i]))
            for k in np.flatnonzero(ends - np.arange(len(mine)) >= items.need[i]).tolist():
                want |= set(mine[k : ends[k]])
        assert want <= set(got)


def test_distances_of_other_symbols_and_full_words(monkeypatch):
    rng = np.random.default_rng(2)
    patterns = [rng.integers(1, kinds + 1, n).astype(np.uint32) for kinds in (1, 2, 40) for n in (1, 2, 63, 64, 65, 127, 128, 129, 192, 200, 257)]
    texts = [rng.integers(0, 60, 150).astype(np.uint32) if k % 3 == 0 else np.concatenate([p[k % 7 :], p[: k * 5]]) for k, p in enumerate(patterns)]
    assert leakage.distances(patterns, texts).tolist() == [leakage.myers(p, t) for p, t in zip(patterns, texts)]
    assert leakage.distances(patterns[:3], [patterns[0][:0]] * 3).tolist() == [1, 2, 63]
    whole = leakage.distances(patterns, texts).tolist()
    monkeypatch.setattr(leakage, "ROOM", 1000)
    assert leakage.distances(patterns, texts).tolist() == whole
