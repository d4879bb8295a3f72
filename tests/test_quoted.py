"""The range reader of quoted files against the whole-file reader and against a walk, character by character."""

import csv
import random

import pytest

from shelfmark.sources import offers, quoted

HEADER = "title\tdescription\tshop_category_name\tvendor_name\tvendor_code\tcategory_id\tdepartment_id"


def awkward_rows(n, seed=1):
    rng = random.Random(seed)
    pieces = ["a", "Ж", '"', '""', "\t", "\n", "\n\n", "\r\n", "x y", "é", '"\n"', "", " "]
    text = lambda: "".join(rng.choice(pieces) for _ in range(rng.randrange(8))).strip("\r")
    return [[f"r{i}", text(), text(), "v", "007", "5", "1"] for i in range(n)]


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(HEADER + end)
        csv.writer(f, delimiter="\t", lineterminator=end).writerows(rows)


def ranges(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def restored(spark):
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(n) for n in names]
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_cut_gives_the_same_records(spark, tmp_path, restored, end):
    rows = awkward_rows(8)
    write(tmp_path / "a.tsv", rows, end)
    want = [HEADER.split("\t"), *rows]
    for size in (13, 40, 10_000):
        ranges(spark, size)
        got = quoted.read_records(spark, str(tmp_path / "a.tsv"), 7).orderBy("block", "k").collect()
        assert [r["fields"] for r in got] == want, size
        if size < 20:
            assert len({r["block"] for r in got}) > 5


def test_equals_the_whole_file_reader(spark, tmp_path, restored):
    """Fields with tabs, line breaks and doubled quotes, a file in many tasks, several files."""
    for name, n in (("part-1.tsv", 20), ("part-2.tsv", 3), ("part-10.tsv", 7)):
        write(tmp_path / name, awkward_rows(n, n))
    ranges(spark, 150)
    got = offers.read_offers(spark, str(tmp_path)).orderBy("row_id").collect()
    whole = []
    for name in ("part-1.tsv", "part-2.tsv", "part-10.tsv"):
        reader = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
        whole += reader.csv(str(tmp_path / name)).collect()
    assert [r["row_id"] for r in got] == list(range(30))
    text = lambda x: None if x in (None, "") else x
    assert [(r["title"], text(r["description"]), text(r["shop_category_name"])) for r in got] == [
        (r["title"], text(r["description"]), text(r["shop_category_name"])) for r in whole
    ]
    assert {(r["vendor_code"], r["category_id"]) for r in got} == {("007", 5)}


def test_a_field_over_many_ranges(spark, tmp_path, restored):
    long = "\n".join(f'line {i} "quoted"' for i in range(60))
    rows = [["a", long, "", "", "", "1", "1"], ["b", "x", "", "", "", "1", "1"], ["c", long, long, "", "", "1", "1"]]
    write(tmp_path / "a.tsv", rows)
    ranges(spark, 100)
    got = offers.read_offers(spark, str(tmp_path / "a.tsv")).orderBy("row_id").collect()
    assert [(r["title"], r["description"], r["shop_category_name"]) for r in got] == [("a", long, None), ("b", "x", None), ("c", long, long)]


def test_stray_quotes_blank_lines_and_short_records(spark, tmp_path, restored):
    lines = [HEADER, 'pipe 5" long\td\t"s"t\tv', "", "b", '"q""x"\t1\t2\t3\t4\t5\t6\t7', 'last\t"open', "to the end"]
    (tmp_path / "a.tsv").write_text("\n".join(lines))
    want = [
        ['pipe 5" long', "d", "st", "v", None, None, None], ["b"] + [None] * 6, ['q"x', "1", "2", "3", "4", "5", "6"],
        ["last", "open\nto the end"] + [None] * 5,
    ]
    for size in (9, 1000):
        ranges(spark, size)
        got = quoted.read_records(spark, str(tmp_path / "a.tsv"), 7).orderBy("block", "k").collect()
        assert [r["fields"] for r in got][1:] == want


def test_sorted_ranges_when_states_are_many(spark, tmp_path, restored, monkeypatch):
    rows = awkward_rows(10, 9)
    write(tmp_path / "a.tsv", rows)
    monkeypatch.setattr(quoted, "is_small", lambda df: False)
    ranges(spark, 40)
    got = quoted.read_records(spark, str(tmp_path / "a.tsv"), 7).orderBy("block", "k").collect()
    assert [r["fields"] for r in got][1:] == rows


def test_every_cut_of_a_file_gives_the_same_records():
    """The two passes over ranges cut at every line of a file, without Spark."""
    rng = random.Random(5)
    for _ in range(200):
        rows = awkward_rows(6, rng.randrange(10**6))
        lines = "\n".join("\t".join('"' + x.replace('"', '""') + '"' if any(c in x for c in '"\t\n\r') else x for x in r) for r in rows).split("\n")
        inside, records, waiting = False, [], []
        for cut in range(len(lines)):
            # The state before each line from the composed maps of the lines above it.
            out, in_ = False, True
            for line in lines[:cut]:
                out, in_ = quoted.ends_inside(line, out), quoted.ends_inside(line, in_)
            assert out == inside
            waiting.append(lines[cut])
            inside = quoted.ends_inside(lines[cut], inside)
            if not inside:
                records.append(quoted.fields_of("\n".join(waiting)))
                waiting = []
        assert records == rows


def test_line_states_equal_a_walk():
    def walk(line, inside):
        state = "in" if inside else "start"
        for c in line:
            if state == "in":
                state = "quote" if c == '"' else "in"
            elif state == "quote" and c == '"':
                state = "in"
            elif c == "\t":
                state = "start"
            elif state == "start" and c == '"':
                state = "in"
            else:
                state = "field"
        return state == "in"

    rng = random.Random(3)
    for _ in range(5000):
        line = "".join(rng.choice('"\t"a') for _ in range(rng.randrange(12)))
        for inside in (False, True):
            assert quoted.ends_inside(line, inside) == walk(line, inside), (line, inside)
