from pagecask.llm import boilerplate as B

BODY = [
    ("Home | News | Contact | About us", 1), ("Home › News › Anna", 1), ("We use cookies to give you the best experience on Some Site. By continuing you agree to our cookie policy.", 1), ("The old bridge", 0),
    ("The old bridge crosses the river, and nobody has ever counted the people who walk over it in the morning.", 0), ("- the first item of a list", 0), ("She baked cookies for the committee and nobody read the privacy policy on the wall.", 0),
    ("03.12.2020 the old index Anna", 1), ("#bridge #river #town", 1), ("★ 4.5 (23) · ♥ 12 · ↗ 3", 1), ("Related articles: the first one; the second one", 1), ("Some Site, Street 4, tel. 00 123 4567, mail@some.example", 1),
    ("© 2024 Some Site. All rights reserved.", 1), ("Zurück", 1), ("Nach oben", 1),
]


def test_blocks():
    assert B.label_blocks([x for x, _ in BODY]) == [x for _, x in BODY]


def test_inheritance():
    long = "The old bridge crosses the river, and nobody has ever counted the people on it."
    assert B.label_blocks(["Contact", "Xyz", long, "Xyz", "Contact"]) == [1, 0, 0, 1, 1]
    assert B.label_blocks(["Contact", "Abc", "Xyz", "Help", long]) == [1, 1, 1, 1, 0]
    assert B.label_blocks(["Xyz", "Abc"]) == [0, 0] and B.label_blocks([""]) == [0] and B.label_blocks([]) == []


def test_densities_without_the_lists():
    long = "The old bridge crosses the river, and nobody has ever counted the people who walk over it in the morning."
    page = [
        ("Kalo | Vari | Mesa", 1), ("Kalo Vari Mesa Tolo", 1), ("Our newsletter brings you a story every week.", 1), (long, 0), ("The old bridge", 0), (long, 0),
        ("Deutsch/Français/Nederlands", 1), ("Some Site, Street 4, tel. 00 123 4567", 1), ("© 2024 Some Site", 1), ("Made by Some Site. www.some-site.example", 1), ("Kalo", 1), ("Vari (3)", 1), ("Mesa", 1),
    ]
    assert B.label_blocks([x for x, _ in page], wording=False) == [x for _, x in page]


def test_addressed_lines_follow_their_neighbours():
    long = "The old bridge crosses the river, and nobody has ever counted the people who walk over it in the morning."
    assert B.label_blocks([long, "She told them that we never know what comes.", long]) == [0, 0, 0]
    assert B.label_blocks(["Kalo | Vari", "Together we tell what nobody has told before.", "Kalo | Vari"]) == [1, 1, 1]


def test_operator(spark):
    schema = "page_id long, body string, headings string, item_no string"
    rows = [(1, "Home | News | Help\nThe old bridge crosses the river, and nobody has ever counted the people on it.", "The bridge · Leave a comment · Newsletter", "x"), (2, None, None, None), (3, "", "", ""), (4, "Ｎｅｗｓ | Hom​e | Help", None, None), (None, "Contact", None, None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((tuple(r) for r in B.page_furniture(df).collect()), key=repr)
    assert got == sorted([(1, "body", 1), (1, "headings", 2), (1, "headings", 3), (4, "body", 1), (None, "body", 1)], key=repr)
    kept = {r.page_id: r for r in B.main_text(df).collect()}
    assert kept[1].body.startswith("The old bridge") and kept[1].headings == "The bridge" and kept[2].body is None and kept[3].body == "" and kept[4].body == ""
    assert B.page_furniture(df.limit(0)).collect() == []


def test_very_long_body(spark):
    df = spark.createDataFrame([(1, "\n".join(["Contact", "word " * 20 + "ends here."] * 3000), None)], "page_id long, body string, headings string")
    assert B.page_furniture(df).count() == 3000


def test_query_leaves_unusable_pages_out(spark, data):
    from pagecask.llm.residue import page_fields, residue_fields

    out = B.p3_found(spark, data)
    assert out.columns == ["page_id", "field", "item_no"]
    assert out.join(residue_fields(*page_fields(spark, data)).where("field = 'body'"), "page_id").count() == 0
