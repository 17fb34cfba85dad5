from querymill.llm import repair

DDL = "doc_id long, text string, k int, form string, raw string, kind string"
BASE = "def collect(queue):\n    return queue.open(x)  # проверяет запись\n"


def frame(spark, data):
    return spark.createDataFrame([(*d, 1, "f", "r", "d") for d in data], DDL).repartition(3)


DATA = [
    (1, BASE), (2, BASE.replace("collect", "cоllect")), (3, BASE.replace(" ", " ", 2)), (4, BASE.replace("return", "ｒｅｔｕｒｎ")), (5, BASE.replace("queue", "que​ue")),
    (6, BASE), (7, BASE.upper()), (8, BASE.replace("\n", "\r\n")), (9, BASE.replace("x", "х")), (10, None), (11, ""), (12, "​"), (13, BASE.replace("    ", "\t")), (None, BASE),
    (14, BASE.replace("запись", "запиcь")), (15, "unseеn"), (16, "unsеen"), (17, "résumé"), (18, "résumé"), (19, "resume"), (20, "x" * 80_000 + "о"), (1, BASE),
]


def test_pairs(spark, rows):
    same = [{1, 2, 3, 4, 5, 6, 9, 14}, {11, 12}, {15, 16}, {17, 18}]
    text = {d: t for d, t in DATA if d}
    want = sorted((a, b) for g in same for a in g for b in g if a < b and text[a] != text[b])
    assert rows(repair.same_looking(frame(spark, DATA))) == sorted(want, key=repr)
    assert rows(repair.same_looking(frame(spark, []))) == []


def test_texts(spark):
    got = [(r.doc_id, r.text) for r in repair.consistent_text(frame(spark, DATA)).collect()]
    assert len(got) == len(DATA)
    by = dict(got)
    assert all(by[d] == BASE for d in (1, 2, 3, 4, 5, 6, 14)) and by[9] == BASE.replace("x", "х")
    assert by[10] is None and by[11] == by[12] == "" and by[7] == BASE.upper() and by[8] == BASE.replace("\n", "\r\n")
    assert repair.consistent_text(frame(spark, [])).count() == 0


def forms(spark, texts):
    return [r.text for r in repair.consistent_text(frame(spark, list(enumerate(texts, 1)))).orderBy("doc_id").collect()]


def test_real_words_stay(spark):
    """Words of one script keep it, also where all their letters are look-alikes and where a mixed spelling stands beside them."""
    assert forms(spark, ["роса", "рoса", "оса, роса, вода", "poca"]) == ["роса", "роса", "оса, роса, вода", "poca"]
    # a form that no document holds is no repair, however many spellings point to it
    assert forms(spark, ["unsеen", "unsеeп", "unseеn"]) == ["unsеen", "unsеeп", "unseеn"]
    letters = repair.look_alikes(spark)
    assert repair.proposals("проверяет", letters) == repair.proposals("то", letters) == repair.proposals("а", letters) == repair.proposals("日本語", letters) == []
    assert repair.proposals("сlass", letters)[0] == "class" and repair.proposals("рocа", letters)[:1] == ["poca"] and repair.proposals("рoса", letters)[:1] == ["роса"]
    assert repair.proposals("日本class", letters) == []
    assert repair.fold("a　b\tc\r\n") == "a b\tc\r\n"


def test_letters_of_every_script(spark, rows):
    """Cherokee, Coptic, Deseret, Lisu and others, from Unicode's data; one-script words of look-alikes join in comparison only."""
    data = [(1, "Aero one"), (2, "Ꭺero one"), (3, "ꓮero one"), (4, "Aerⲟ one"), (5, "Aer𐐬 one"), (6, "Τaco"), (7, "Taco"), (8, "роса"), (9, "poca"), (10, "Рoса"), (11, "Poca")]
    found = set(rows(repair.same_looking(frame(spark, data))))
    assert found == {(a, b) for g in ((1, 2, 3, 4, 5), (6, 7), (8, 9), (10, 11)) for a in g for b in g if a < b}
    classes = {r.doc_id: (r.class_id, r.n_docs) for r in repair.looking_classes(frame(spark, [*data, (None, "x"), (12, None)])).collect()}
    assert classes[5] == (1, 5) and classes[9] == (8, 2) and set(classes) == set(range(1, 12))
    assert repair.looking_classes(frame(spark, [])).count() == 0


def test_many_copies_are_salted(spark, monkeypatch, rows):
    monkeypatch.setattr(repair, "_COPIES", 7)
    data = [(i, "one text" if i < 60 else "one\u00a0text") for i in range(100)]
    assert rows(repair.same_looking(frame(spark, data))) == sorted(((a, b) for a in range(60) for b in range(60, 100)), key=repr)
