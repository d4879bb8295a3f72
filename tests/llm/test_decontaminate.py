import hashlib
import random
import re

import numpy as np
import pytest

from shelfmark.llm import decontaminate
from tests.llm.helpers import awkward, frame, plain

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items, width=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for r in rows:
        w = words(r[1])
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((r[0], len(w), len(hit), tuple(sorted(found))))
    return plain(out)


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def run(spark, rows, items):
    got = decontaminate.find_passages(frame(spark, rows, extra=True), items_frame(spark, items)).collect()
    return plain((r["id"], r["n_words"], sum(s["last"] - s["first"] + 1 for s in r["spans"]), tuple(r["items"])) for r in got)


def cases():
    rng = random.Random(8)
    pool = ["a", "b", "é", "Ünd", "x1", "the"]
    say = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(1, 30)))) for i in range(12)]
    items += [(20, None), (21, " .,; "), (22, "ÜND the"), (None, "only null item words here"), (3, "another text of item three")]
    items.append((30, items[0][1]))
    rows = awkward()
    for i in range(60):
        middle = words(rng.choice(items)[1])
        rows.append((500 + i, ", ".join(say(rng.randrange(40))) + "! " + " - ".join(middle).upper() + "\n" + "; ".join(say(20)), "en", "s", 0))
    rows.append((700, " ".join(say(3000)), "en", "s", 0))
    rows += [rows[-1], (701, "Only NULL item\nwords here and another text of item three", "en", "s", 0)]
    return rows, items


def test_equals_brute_force(spark):
    rows, items = cases()
    assert run(spark, rows, items) == brute(rows, items)


def test_blocks_of_phrases_are_merged(spark, monkeypatch):
    rows, items = cases()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 4000)
    rows.append((None, items[0][1], "en", "s", 0))
    assert run(spark, rows, items) == brute(rows, items)


def test_one_item_with_most_rows(spark, monkeypatch):
    """Rows of one item, equal ones among them, fall into several blocks; its findings are one item."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    phrase = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    items = [(7, phrase(i % 20)) for i in range(40)] + [(8, phrase(3)), (9, "one two")]
    rows = [(i, f"a {phrase(i)} b {phrase(i + 1)}", "en", "s", 0) for i in range(25)] + [(99, "one two three", "en", "s", 0)]
    assert run(spark, rows, items) == brute(rows, items)


def test_empty_sides(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, [(1, "a b", "en", "s", 0)], []) == [(1, 2, 0, ())]


def test_passages_are_cut_and_documents_dropped(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Straße 😀 before {item.upper()}. after", "de", "s", 0), (2, "clean text", "en", "s", 0), (3, None, "en", "s", 0),
            (4, "one two three four five six seven eight nine", "en", "s", 0)]
    docs = frame(spark, rows, extra=True)
    cut = decontaminate.remove_passages(docs, items_frame(spark, [(1, item)]))
    assert cut.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "Straße 😀 before \n. after", 2: "clean text", 3: None, 4: rows[3][1]}
    items_frame(spark, [(1, item)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    left = decontaminate.stage(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4] and left.columns == docs.columns


def test_query(spark, tmp_path):
    rows, items = cases()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    items_frame(spark, items).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = decontaminate.op4_decontaminate(spark, str(tmp_path)).collect()
    want = plain((i, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0) for i, n, h, f in brute(rows, items))
    assert plain(got) == want


@pytest.mark.parametrize("seed, top, n", [(1, 3, 400), (2, 40, 3000), (3, 2, 700)])
def test_index_finds_every_occurrence(seed, top, n):
    rng = np.random.default_rng(seed)
    symbols = np.append(rng.integers(1, top, n), 0).astype(np.int64)
    if seed == 3:
        symbols[:-1] = np.resize(rng.integers(1, 9, 90), n)  # long repeats
    index = decontaminate.FMIndex(symbols)
    text = symbols.tolist()
    assert [text[i:] for i in decontaminate._suffixes(symbols)] == sorted(text[i:] for i in range(len(text)))
    for length in (1, 2, 5):
        phrases = np.array([text[a : a + length] for a in rng.integers(0, n - 5, 30)] + [[top + 5] * length])
        who, low, high = index.search(phrases)
        found = {k: set(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(who.tolist(), low, high)}
        for k, p in enumerate(phrases.tolist()):
            assert found.get(k, set()) == {i for i in range(n) if text[i : i + length] == p}
