from shelfmark.operators import rules

SCHEMA = ("row_id long, title string, shop_category_name string, vendor_name string, vendor_code string, "
          "category_id long, department_id long")


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_unanimous_keys(spark):
    train = table(spark, [
        (0, " Lamp", "A", "V", "1", 10, 1), (1, "lamp ", "A", "v", "1", 10, 1),
        (2, "lamp", "a", "V", "2", 11, 2), (3, "cup", "-", None, "2", 12, 2),
        (4, None, " ", None, None, 13, 3), (5, "cup", "B", None, "3", None, 3), (6, "pan", "B", "W", "3", 14, 4),
    ])
    got = {(r["kind"], r["key"]): r["category_id"] for r in rules.category_rules(train).collect()}
    assert got == {
        (rules.VENDOR_CODE, "1"): 10, (rules.VENDOR_CODE, "3"): 14,
        (rules.SHOP_CATEGORY, "A"): 10, (rules.SHOP_CATEGORY, "a"): 11, (rules.SHOP_CATEGORY, "B"): 14,
        (rules.TITLE_VENDOR, "cup|||"): 12, (rules.TITLE_VENDOR, "|||"): 13, (rules.TITLE_VENDOR, "pan|||w"): 14,
        (rules.TITLE_SHOP_CATEGORY, "cup|||-"): 12, (rules.TITLE_SHOP_CATEGORY, "|||"): 13,
        (rules.TITLE_SHOP_CATEGORY, "pan|||b"): 14,
    }
    departments = {r["key"]: r["department_id"] for r in rules.shop_category_departments(train).collect()}
    assert departments == {"A": 1, "a": 2}


def test_later_rules_win(spark):
    found = [(k, key, c) for k, key, c in [
        (rules.TITLE_SHOP_CATEGORY, "t|||s", 1), (rules.TITLE_VENDOR, "t|||v", 2), (rules.SHOP_CATEGORY, "S", 3),
        (rules.VENDOR_CODE, "C", 4),
    ]]
    table_of_rules = spark.createDataFrame(found, "kind int, key string, category_id long")
    offers = table(spark, [
        (0, "T", "S", "V", "C", None, None), (1, "T", "S", "V", "c", None, None), (2, "T", "s", "V", None, None, None),
        (3, "T", "s", None, None, None, None), (4, "x", "y", None, None, None, None), (5, None, None, None, None, None, None),
    ])
    got = {r["row_id"]: r["rule_category"] for r in rules.apply_rules(offers, table_of_rules).collect()}
    assert got == {0: 4, 1: 3, 2: 2, 3: 1, 4: None, 5: None}
    row = rules.coverage(rules.apply_rules(offers, table_of_rules)).first()
    assert (row["n_rows"], row["n_covered"], round(row["share"], 6)) == (6, 4, 0.666667)


def test_first_department_and_modal_category(spark):
    train = table(spark, [
        (3, "a", None, None, None, 1, 9), (1, "a", None, None, None, 1, None), (2, "a", None, None, None, 1, 8),
        (4, "a", None, None, None, 2, 7), (5, "a", None, None, None, 2, 7), (6, "a", None, None, None, 2, 6),
    ])
    assert {r["category_id"]: r["department_id"] for r in rules.category_departments(train).collect()} == {1: 8, 2: 7}
    assert rules.modal_category(train).first()["category_id"] == 1  # equal counts: lowest id


def test_hot_key_keeps_every_row(spark):
    rows = [(i, None if i % 3 == 0 else f"t{i}", None, None, "hot" if i % 3 == 1 else None, 5, 1) for i in range(3000)]
    offers = table(spark, rows)
    got = rules.apply_rules(offers, rules.category_rules(offers))
    assert got.count() == 3000 and got.where("rule_category = 5").count() == 3000
