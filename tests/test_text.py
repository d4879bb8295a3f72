import pytest
from pyspark.sql import functions as F

from shelfmark.functions import lexicon, text
from shelfmark.operators import lemma, texts
from shelfmark.operators.lemma import lemmatise

OFFER = "row_id long, title string, description string, shop_category_name string, vendor_name string, vendor_code string"


def column(spark, values, make):
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    return [r["x"] for r in df.select("i", make(F.col("c")).alias("x")).orderBy("i").collect()]


def test_clean_text(spark):
    values = [None, "", "  Котёл ЛЕТО  ", "<b>A</b>-B_c", "a<br>б\n\tв", "x < y > z", "café 12", "--", "ЙЯ-Ёё"]
    assert column(spark, values, text.clean_text) == [
        "", "", "кот л лето", "a -b c", "a б в", "x z", "caf 12", "--", "йя-",
    ]


def test_clean_description_cuts_after_tags(spark):
    assert column(spark, ["a<BR />b<br>c", r"x\r\ny\nz", "<p>АБВ</p>где", None], text.clean_description) == [
        "a b c", "x y z", "абв где", "",
    ]
    cut = lambda c: text.clean_description(c, 5)
    # Tags become one blank each before the cut; code points are counted, not bytes.
    assert column(spark, ["<i>абвгдежз", "аб😀вгд", "a\\nbcdef"], cut) == ["абвг", "аб вг", "a bcd"]


def test_vendor_field(spark):
    assert column(spark, [None, " Bosch & Co ", "BOSCH 品", "  NoBrand "], text.vendor_field) == [
        "", "bosch co", "", "",
    ]
    assert set(column(spark, list(lexicon.NO_BRAND), text.vendor_field)) == {""}
    assert len(lexicon.NO_BRAND) == 31


def test_category_paths(spark):
    paths = [None, " ", " - ", "Дом", "Дом / Сад /  Ёлки ", "a / b / 品", "a / ", "a / / b", "品 / b"]
    assert column(spark, paths, text.category_leaf) == ["", "", "", "", "Ёлки", "", "", "/ b", "b"]
    assert column(spark, paths, text.shop_category_field) == [
        "", "", "", "дом", "дом сад лки", "", "a", "a b", "",
    ]
    assert column(spark, [None, " nan ", "-", "А / Б ", "品"], text.department_shop_category) == [
        "", "", "", "А / Б", "",
    ]


def title_flags(spark, titles):
    return column(spark, titles, lambda c: text.title_tokens(text.lowered_title(c), text.head_words(c)))


def test_title_tokens(spark):
    got = title_flags(spark, [
        None, "", "  ", "Котёл-Газовый 24 кВт", "SSD 512 GB 10x20", "Wi-Fi роутер 5 дюйм", "Рис 5кг", "Рисовая 5 л.",
        "Насосная 220v", "Корм для кошек 100 г",
    ])
    assert got == [
        "", "", "",
        "__fw_кот__ __bg_кот_л__ __type_plumbing__ __type_climate__",
        "__fw_ssd__ __bg_ssd_512__ __feat_memory__ __feat_dims__ __type_pc__",
        "__fw_wi__ __bg_wi_fi__ __feat_inch__ __type_pc__",
        "__fw_рис__ __bg_рис_5кг__ __feat_weight__ __type_food__",
        "__fw_рисовая__ __bg_рисовая_5__ __feat_volume__",
        "__fw_насосная__ __bg_насосная_220v__ __feat_volt__",
        "__fw_корм__ __bg_корм_для__ __feat_weight__ __type_pet__",
    ]


def test_unit_flags_one_by_one(spark):
    for title, token in [
        ("x 8 гб", "memory"), ("x 60 Вт", "watt"), ('x 15"', "inch"), ("x 2 литра", "volume"), ("x 30 см", "size"),
        ("x 5 кг", "weight"), ("x 12 вольт", "volt"), ("x 3x4", "dims"),
    ]:
        assert title_flags(spark, [title])[0].split()[-1] == f"__feat_{token}__"


def test_description_tokens(spark):
    make = lambda c: text.description_tokens(c, text.lowered_description(c))
    assert column(spark, [None, "", "a" * 99, "a" * 100, "a" * 2000, "a" * 2001], make) == [
        "__no_desc__", "__no_desc__", "__desc_short__", "", "", "__desc_long__",
    ]
    filler = "z" * 100
    for part, token in [
        ("Материал :", "material"), ("СОСТАВ:", "composition"), ("мощность", "power"), ("размер:", "size"),
        ("применение", "usage"), ("Android", "os"), ("энергопотребление", "energy"), ("полив", "garden"),
        ("монтаж", "install"), ("dn5", "plumbing"), ("для детей", "kids"), ("керамика", "material_kw"),
        ("pp-r", "plumbing"),
    ]:
        assert column(spark, [filler + part], make) == [f"__desc_{token}__"], part


@pytest.mark.parametrize("code, kept", [("AB-JieMi-1", ""), ("x_ROMIKY", ""), ("JIEMA", "JIEMA"), ("007", "007")])
def test_reseller(spark, code, kept):
    assert column(spark, [code], text.without_reseller) == [kept]


def test_missing_strings(spark):
    values = list(lexicon.MISSING_STRINGS) + ["-", " ", "Nan", "007"]
    assert column(spark, values, text.null_if_missing) == [None] * len(lexicon.MISSING_STRINGS) + ["-", " ", "Nan", "007"]


def test_rule_key(spark):
    df = spark.createDataFrame([(" Ab ", None), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(text.rule_key(F.col("a"), F.col("b"))).collect()] == ["ab|||", "|||"]


def test_composed_texts(spark):
    offers = spark.createDataFrame(
        [
            (1, "Чайник-Bosch 2 л", "Мощность<br>2 кВт", "Дом / Чайники", "Bosch", "Tk-7"),
            (2, None, None, None, None, None),
            (3, "", "", "-", "no brand", "jiemi9"),
        ],
        OFFER,
    )
    got = {r["row_id"]: r for r in texts.all_texts(offers).collect()}
    # "чай" is a stem of the food flag.
    flags = "__fw_чайник__ __bg_чайник_bosch__ __feat_volume__ __type_food__"
    title = "чайник-bosch 2 л "
    assert got[1]["category_text"] == (
        title * 4 + "дом чайники " * 2 + "чайники " * 3 + (flags + " ") * 3 + "bosch " + "мощность 2 квт "
        + "__desc_power__ __desc_short__"
    )
    assert got[1]["department_word_text"] == (
        "дом чайники " * 6 + "чайники " * 3 + title * 2 + flags + " " + "bosch " + "мощность 2 квт " + "Tk-7"
    )
    assert got[1]["department_char_text"] == "дом / чайники чайник-bosch 2 л bosch tk-7"
    # Missing fields are blank in the category text and the word "nan" in the department texts.
    assert got[2]["category_text"] == " " * 14 + "__no_desc__"
    assert got[2]["department_word_text"] == " " * 12 + "nan nan nan"
    assert got[2]["department_char_text"] == " nan nan nan"
    assert got[3]["department_word_text"] == " " * 12 + "no brand " + " "
    assert got[3]["department_char_text"] == "  no brand jiemi9"


def test_char_text_cuts(spark):
    offers = spark.createDataFrame([(1, "Я" * 400, None, "A", "v" * 60, "c" * 40)], OFFER)
    got = texts.department_char_text(offers).first()["department_char_text"]
    assert got == "a " + "я" * 300 + " " + "v" * 50 + " " + "c" * 30


def test_lemmas(spark):
    rows = spark.createDataFrame([(1, "кошки и коты", "коты"), (2, "", "x"), (3, "", "")], "row_id long, a string, b string")
    forms = spark.createDataFrame([("кошки", "кошка"), ("коты", "кот"), ("и", "и")], "word string, lemma string")
    got = {r["row_id"]: (r["a"], r["b"]) for r in lemmatise(rows, ["a", "b"], forms).collect()}
    assert got == {1: ("кошка и кот", "кот"), 2: ("", "x"), 3: ("", "")}


def test_unknown_words_follow_their_endings(spark):
    """Most frequent rule of the longest ending, then least cut, then letters; digits and unknown endings stay."""
    forms = spark.createDataFrame(
        [("кошками", "кошка"), ("мышками", "мышка"), ("рыбами", "рыба"), ("санями", "сани"), ("xab", "xac"), ("yab", "yad"), ("дом", "дом")],
        "word string, lemma string",
    )
    rules = {r["ending"]: (r["cut"], r["added"]) for r in lemma.ending_rules(forms).collect()}
    assert rules["ами"] == (2, "")
    assert rules["ями"] == (3, "и") and rules["ab"] == (1, "c") and rules["ом"] == (0, "")
    assert "xab" not in rules and all(len(e) <= 5 for e in rules)
    rows = spark.createDataFrame([(1, "лампами конями zab том 5ами фу дом кошками", "лампами")], "row_id long, a string, b string")
    got = lemmatise(rows, ["a", "b"], forms).first()
    assert (got["a"], got["b"]) == ("лампа кони zac том 5ами фу дом кошка", "лампа")
    plain = lemmatise(rows, ["a"], forms, predict=False).first()
    assert plain["a"] == "лампами конями zab том 5ами фу дом кошка"


def test_prediction_equals_brute_force(spark):
    import random
    from collections import Counter

    rng = random.Random(6)
    make = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))
    table = {make(): make() for _ in range(150)}
    words = sorted({make() for _ in range(200)})
    counts = {}
    for w, m in table.items():
        n = 0
        while n < min(len(w), len(m)) and w[n] == m[n]:
            n += 1
        for k in range(max(1, len(w) - n), 6):
            if k < len(w):
                counts.setdefault(w[-k:], Counter())[len(w) - n, m[n:]] += 1
    best = {e: min(c, key=lambda r: (-c[r], *r)) for e, c in counts.items()}
    want = {}
    for w in words:
        ending = next((w[-k:] for k in range(5, 0, -1) if k < len(w) and w[-k:] in best), None)
        cut, added = best.get(ending, (0, ""))
        want[w] = table.get(w, w[: len(w) - cut] + added)
    rows = spark.createDataFrame(list(enumerate(words)), "row_id long, t string")
    got = lemmatise(rows, ["t"], spark.createDataFrame(list(table.items()), "word string, lemma string"))
    assert {words[r["row_id"]]: r["t"] for r in got.collect()} == want


def test_lemmas_leave_flags_and_codes_alone(spark):
    offers = spark.createDataFrame([(1, "Коты", None, None, None, "коты")], OFFER)
    forms = spark.createDataFrame([("коты", "кот")], "word string, lemma string")
    got = texts.all_texts(offers, forms).first()
    assert got["department_word_text"].startswith(" " * 9 + "кот кот __fw_коты__ nan nan коты")


def test_looks_ahead_find_the_same_flags(spark):
    """Searches that are skipped are those that find nothing: starts after any mark, other digits, short words."""
    import random

    rng = random.Random(4)
    stems = ["футболк", "чай", "кабель", "кабель usb", "ps5", "ps", "рис", "риса", "wi-fi", "котёл", "книга", "мышь", "ssd", "корм для", "бра"]
    parts = ["²", "½", "-", "_", "́", "٣", "5", " ", "\n", "x", "л", "кг", "10x20", "220v", '"', "5 дюйм", ".", "ё"]
    rows = [(i, "".join(rng.choice(stems + parts) for _ in range(rng.randrange(1, 8)))) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, title string").withColumns({n: m() for n, m in text.PREPARED_FIELDS.items() if n.startswith("title")})
    lowered, words = F.col("title_lower"), F.col("title_words")
    got = df.select(
        text.title_tokens(lowered, words).alias("plain"),
        text.title_tokens(lowered, words, starts=F.col("title_starts"), digits=F.col("title_digits")).alias("ahead"),
    ).collect()
    assert all(r["plain"] == r["ahead"] for r in got)
    assert len({r["plain"] for r in got}) > 100


def test_stem_starts():
    assert text.stem_starts(r"\b(ab|cd\b|ef[0-9]|g-h)") is None
    assert text.stem_starts(r"\b(abc|cd\b|ef[0-9])") == ["ab", "cd", "ef"]
    assert text.stem_starts(r"\b(ab?|cd)") is None and text.stem_starts("ab|cd") is None and text.stem_starts(r"\b(a(b)|cd)") is None
    from shelfmark.functions import lexicon

    assert all(text.stem_starts(p) for _, p in lexicon.TYPE_FLAGS)
