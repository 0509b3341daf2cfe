from groundline.llm import lookalike


def values(spark, rows):
    return spark.createDataFrame(rows, "id string, value string")


SAME = ["Théorie du choc", "Théorie du choc", "Ｔｈéｏｒｉｅ　ｄｕ ｃｈｏｃ", "Thé​orie du cho­c", "Тhéоrіе du сhос"]
OTHER = ["Theorie du choc", "théorie du choc", "Théorie du choc²", "Théorie du choc2", "Théorie du choc ²", "x²", "x2", "ﬁn", "fin", "१", "1", "𝐱", "x"]


def test_one_class_and_no_other(spark):
    rows = [(f"s{i}", v) for i, v in enumerate(SAME)] + [(f"o{i}", v) for i, v in enumerate(OTHER)] + [("n", None), ("e", ""), ("e2", "")]
    members = lookalike.classes(lookalike.suspects(values(spark, rows)))
    assert {r["id"] for r in members.collect()} == {f"s{i}" for i in range(5)}
    assert {r["canonical"] for r in members.collect()} == {SAME[0]}
    pairs = {tuple(r) for r in lookalike.pairs(members).collect()}
    assert pairs == {(f"s{i}", f"s{j}") for i in range(5) for j in range(i + 1, 5)}


def test_copies_are_linked_to_other_values_only(spark):
    rows = [("a", SAME[0]), ("b", SAME[0]), ("b", SAME[0]), ("c", SAME[1])]
    members = lookalike.classes(lookalike.suspects(values(spark, rows)))
    assert {tuple(r) for r in lookalike.pairs(members).collect()} == {("a", "c"), ("b", "c")}


def test_canonical_keeps_every_row(spark):
    rows = [("a", SAME[2]), ("b", SAME[0]), ("c", None), ("d", "alone"), ("e", "x" * 50_000)]
    clash = values(spark, rows).selectExpr("*", "1 as h", "2 as look", "3 as canonical")
    got = {r["id"]: r["canonical"] for r in lookalike.canonical(clash).collect()}
    assert got == {"a": SAME[0], "b": SAME[0], "c": None, "d": "alone", "e": "x" * 50_000}
    assert lookalike.canonical(values(spark, [])).count() == 0


def test_names(spark):
    names = spark.createDataFrame([("u1", SAME[0]), ("u2", "Other")], "name_key string, name string")
    rows = values(spark, [("a", SAME[0]), ("b", SAME[2]), ("c", SAME[2]), ("d", "other"), ("e", None), ("f", "Оther")])
    assert sorted(tuple(r) for r in lookalike.match_names(rows, names).collect()) == [("b", "u1"), ("c", "u1"), ("f", "u2")]
