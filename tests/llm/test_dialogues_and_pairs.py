from datetime import datetime, timedelta

from groundline.llm import dialogues, pairs

MESSAGE = "id string, conversation_id string, position int, role string, content string, payload struct<status: string>, created_at timestamp"
T0 = datetime(2026, 1, 1)


def messages(spark, rows):
    return spark.createDataFrame([(i, c, p, r, t, (s,) if s else None, at or T0) for i, c, p, r, t, s, at in rows], MESSAGE)


def turn(c, p, role, text="some text", status=None, at=None):
    return (f"{c}{p}{role}", c, p, role, text, status, at)


def test_verdicts(spark):
    rows = [turn("ok", 3, " User"), turn("ok", 4, "ASSISTANT"), turn("ok", 4, "ASSISTANT")]  # delivered twice, begins at 3
    rows += [turn("gap", 0, "user"), turn("gap", 2, "assistant")]
    rows += [turn("twice", 0, "user"), ("other", "twice", 0, "user", "x", None, None), turn("twice", 1, "assistant")]
    rows += [turn("null", 0, "user"), turn("null", None, "assistant")]
    rows += [turn("open", 0, "user"), turn("open", 1, "assistant"), turn("open", 2, "user")]
    rows += [turn("role", 0, "user"), turn("role", 1, "tool")]
    rows += [turn("swap", 0, "assistant"), turn("swap", 1, "user")]
    rows += [turn("mute", 0, "user"), turn("mute", 1, "assistant", "…")]
    rows += [turn("void", 0, "user"), turn("void", 1, "assistant", None)]
    rows += [turn("new", 0, "user"), turn("new", 1, "assistant"), ("x", None, 0, "user", "x", None, None)]
    listed = spark.createDataFrame([(c,) for c in ("ok", "ok", "gap", "twice", "null", "open", "role", "swap", "mute", "void", "empty", None)], "id string")
    got = {r["conversation_id"]: r["reason"] for r in dialogues.verdicts(messages(spark, rows), listed).collect()}
    assert [c for c, why in got.items() if why is None] == ["ok"]
    assert got["gap"] == "position skipped" and got["twice"] == "position repeated" and got["null"] == "position missing" and got["new"] == "not listed" and got["empty"] == "no messages"
    assert set(got) == {"ok", "gap", "twice", "null", "open", "role", "swap", "mute", "void", "new", "empty"}
    kept = dialogues.conversations(messages(spark, rows), listed).orderBy("turn").collect()
    assert [(r["turn"], r["role"]) for r in kept] == [(0, "user"), (1, "assistant")]


def test_empty_tables(spark):
    none, one = messages(spark, []), spark.createDataFrame([("a",)], "id string")
    assert [r["reason"] for r in dialogues.verdicts(none, one).collect()] == ["no messages"]
    assert dialogues.verdicts(none, one.filter("id is null")).count() == 0
    assert dialogues.sessions(none).count() == 0 and pairs.defects(none).count() == 0


def test_sessions_split_at_the_calibrated_gap(spark):
    rows, at = [], T0 + timedelta(hours=23, minutes=58)
    for session in range(3):
        for p in range(4):
            rows.append((f"{session}{p}", "c", None, "user" if p % 2 == 0 or session == 2 else "assistant", "x", None, at))
            at += timedelta(seconds=50)
        at += timedelta(hours=9)
    got = dialogues.sessions(messages(spark, rows)).orderBy("session").collect()
    assert [(r["session"], r["messages"]) for r in got] == [(0, 4), (1, 4)]  # in the third only the user speaks
    assert 60 < dialogues.calibrated_gap(dialogues.paced(messages(spark, rows))) < 32_400


def test_missing_roles_are_inferred_by_alternation(spark):
    at = lambda n: T0 + timedelta(seconds=n)
    rows = [(str(i), "c", None, r, "x", None, at(i)) for i, r in enumerate((None, "assistant", "?", " User ", None, None))] + [(f"d{i}", "d", None, None, "x", None, at(i)) for i in range(3)]
    got = {r["id"]: (r["role"], r["inferred"]) for r in dialogues.turns(messages(spark, rows), 100.0).collect()}
    assert [got[str(i)] for i in range(6)] == [("user", True), ("assistant", False), ("user", True), ("user", False), ("assistant", True), ("user", True)]
    assert got["d0"] == (None, True) and [(r["conversation_id"], r["inferred"]) for r in dialogues.sessions(messages(spark, rows), 100.0).collect()] == [("c", 4)]


def test_positions_over_blocks_of_the_clock(spark, monkeypatch):
    monkeypatch.setattr(dialogues, "BLOCK", 4)
    rows = [turn(c, p, "user" if p % 2 == 0 else "assistant") for c, places in (("ok", range(22)), ("gap", [*range(8), *range(10, 22)])) for p in places]
    got = {r["conversation_id"]: r["reason"] for r in dialogues.verdicts(messages(spark, rows), spark.createDataFrame([("ok",), ("gap",)], "id string")).collect()}
    assert got == {"ok": None, "gap": "position skipped"}


def test_defects(spark):
    rows, n = [], 0

    def pair(question, answer, status="answered"):
        nonlocal n
        n += 1
        rows.append((f"q{n}", f"c{n}", 0, "user", question, None, None))
        rows.append((f"a{n}", f"c{n}", 1, "Assistant ", answer, status, None))
        return f"a{n}"

    want = {}
    for text in (None, "", " … ", "[]", "​"):
        want[pair("What is a lattice?", text)] = "empty"
    for text in ("WHAT IS A LATTICE?", "« What is a lattice ? »", "The question is: What is a lattice?", "What is a lattice? What is a lattice?"):
        want[pair("What is a lattice?", text)] = "copy"
    for i, status in enumerate(("abstained", "abstained", "answered", None)):
        want[pair(f"What is number {i}?", f"The handouts say nothing at all about item {i}.", status)] = "refusal"
    want[pair("And for the bound?", "Sorry, I can't help with that request.", None)] = "refusal"
    want[pair("Que vaut le seuil de la zone 3 ?", "The threshold of the zone is 4 and it does not change.")] = "language"
    for text in ("The value is 3 and the", "The sum is $x_{k", "See below.\n```\nfor i in x", "It holds for the rate (", "The list:\n1. The first one is done.\n2. the", "The list:\n1. The first one is done.\n2.", "- It holds.\n- ", "It holds as in $$x = 3", "It holds (for 3), cf.", "It is the bound, according to K."):
        want[pair("What does the value say?", text)] = "truncated"
    fine = [pair("What is it?", t) for t in ("It is 3.", "Yes.", "It holds. [2]", "It is so.\n```\nx = 1\n```", "The end…", "It is $x = 3$", "42", "No.", "It is the one of type P.", "It holds.\n$$x = 3$$", "It holds.\n1. The first.\n2. The second.")]
    fine += [pair("Réponds en anglais : que vaut le seuil ?", "The threshold is 4 and it does not change.")]
    fine += [pair("What is a lattice?", "What is a lattice? It is a partially ordered set with joins and meets.")]
    fine += [pair(f"Et pour le lot {i} ?", f"Je ne peux que confirmer : le seuil {i} est le plus grand sur un pas.") for i in range(2)]
    fine += [pair(f"Which is number {i}?", f"One can not answer without the graph {i} here, which is the sum.") for i in range(4)]
    rows.append((rows[0][0], *rows[0][1:]))  # delivered twice
    rows += [("lone", "z", 5, "assistant", "It is 3.", None, None), ("w", None, 0, "user", "x", None, None)]
    got = {r["message_id"]: r["defect"] for r in pairs.defects(messages(spark, rows)).collect()}
    assert got == want and not set(fine) & set(got)


def test_templates_with_a_greeting_or_a_variant_in_their_first_words(spark):
    tail = "assist on this one because the handouts of this course hold no part that deals with what you would like to know today"
    starts = ["At present we are unable to", "Hello, at present we are unable to", "Well, hello, at present we are unable to"]
    rows = []
    for i, start in enumerate(starts):
        rows.append((f"q{i}", f"c{i}", 0, "user", f"What is number {i}?", None, None))
        rows.append((f"a{i}", f"c{i}", 1, "assistant", f"{start} {tail}.", "abstained" if i == 0 else "answered", None))
    got = {r["message_id"]: r["defect"] for r in pairs.defects(messages(spark, rows)).collect()}
    assert got == {f"a{i}": "refusal" for i in range(3)}


def test_components(spark):
    edges = spark.createDataFrame([("e", "d"), ("d", "c"), ("b", "c"), ("a", "b"), ("x", "y")], "a string, b string")
    assert {tuple(r) for r in pairs.components(edges).collect()} == {*((n, "a") for n in "abcde"), ("x", "x"), ("y", "x")}


def test_recurrence_switches_no_check_off(spark):
    rows = []
    for i in range(3):
        rows += [(f"q{i}", f"c{i}", 0, "user", f"What is number {i}?", None, None), (f"a{i}", f"c{i}", 1, "assistant", "Sorry, I can't help with that request.", None, None)]
    for i in range(12):
        text = "According to the handouts of the course, " + ("I cannot answer." if i == 0 else f"the value is {i}.")
        rows += [(f"r{i}", f"d{i}", 0, "user", f"Which is number {i}?", None, None), (f"b{i}", f"d{i}", 1, "assistant", text, "abstained" if i == 0 else "answered", None)]
    got = {r["message_id"]: r["defect"] for r in pairs.defects(messages(spark, rows)).collect()}
    assert got == {m: "refusal" for m in ("a0", "a1", "a2", "b0")}


def test_clusters_equal_brute_force(spark):
    tails = [f"assist with {x} on this one because the handouts hold no part that deals with what you would like to know of it today" for x in ("the sums", "any proof", "those")]
    texts = [f"{start}we are unable to {tail}" for start in ("", "hello ", "well hello ", "at present ") for tail in tails] + ["short one", "another short one", "a b a b a b a b", *(f"row {i} of a table with nothing in common" for i in range(5))]
    got = {r["opening"]: r["cluster"] for r in pairs.clustered(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
    runs = {t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts}
    label = {t: t for t in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if a.split()[:6] == b.split()[:6] or len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {(a, b) for a in texts for b in texts if got[a] == got[b]} == {(a, b) for a in texts for b in texts if label[a] == label[b]}


def test_a_slot_in_the_first_words(spark):
    rows = []
    for i, word in enumerate("alpha beta gamma delta".split()):
        rows += [(f"q{i}", f"c{i}", 0, "user", f"What is {word}?", None, None), (f"a{i}", f"c{i}", 1, "assistant", f"The handouts leave out {word} altogether.", "abstained" if i == 0 else None, None)]
        rows += [(f"r{i}", f"d{i}", 0, "user", f"Where is {word}?", None, None), (f"b{i}", f"d{i}", 1, "assistant", f"The handouts put it {word} of the middle.", "answered", None)]
    got = {r["message_id"]: r["defect"] for r in pairs.defects(messages(spark, rows)).collect()}
    assert got == {f"a{i}": "refusal" for i in range(4)}
