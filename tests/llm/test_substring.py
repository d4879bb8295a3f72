import random

import numpy as np
import pytest

from shelfmark.llm import substring
from tests.llm.helpers import awkward, frame, plain
from tests.llm.test_periodic import split


def brute(rows, length=20):
    """Rows of one id are to have one text."""
    docs = sorted(set((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, result = set(), {}
    for key, text in docs:
        w = split(text or "")
        gone = set()
        for i in range(len(w) - length + 1):
            window = tuple(w[i : i + length])
            if window in seen:
                gone.update(range(i, i + length))
            seen.add(window)
        result[key] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return plain((r[0], *result[r[0]]) for r in rows)


def run(spark, rows, **k):
    got = substring.remove_repeats(frame(spark, rows, extra=True), **k).collect()
    for r in got:
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"])
    return plain((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got)


def shared(seed=5):
    """Passages around the length, in changing company, inside one text and across texts."""
    rng = random.Random(seed)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passages = [fresh(n) for n in (8, 12, 19, 20, 21, 30, 60)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += fresh(rng.choice([0, 1, 3, 30]))
            p = rng.choice(passages)
            cut = rng.randrange(len(p)) if rng.random() < 0.3 else 0
            text += p[cut:]
        rows.append((1000 + i, (" " if i % 2 else "\n\t").join(text), "en", "s", 0))
    few = [rng.choice("ab") for _ in range(400)]
    return rows + [(2000, " ".join(few), "en", "s", 0), (2001, " ".join(few[3:300]), "en", "s", 0), (2002, " ".join(["x"] * 100), "en", "s", 0)]


def test_equals_brute_force(spark):
    rows = [r for r in awkward() if r[0] is not None or r[1] is not None] + shared()
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("length, gram", [(12, 5), (20, 20), (9, 8), (30, 4)])
def test_other_lengths(spark, length, gram):
    rows = shared(length)
    assert run(spark, rows, length=length, gram=gram) == brute(rows, length)


@pytest.mark.parametrize("hot", [50, 50_000])
def test_hot_passages(spark, monkeypatch, hot):
    """One passage in all texts, whole copies, and an anchor whose surroundings always differ; with hot anchors and without."""
    monkeypatch.setattr(substring, "HOT", hot)
    rng = random.Random(1)
    line = [f"l{i}" for i in range(14)]
    long = [f"p{i}" for i in range(50)]
    rows = []
    for i in range(400):
        own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
        rows.append((i, " ".join(own(12) + line + own(5) + long + own(2) + line + own(9)), "en", "s", 0))
    rows += [(1000 + i, rows[7][1], "en", "s", 0) for i in range(100)]
    assert run(spark, rows) == brute(rows)


def test_rows_of_one_id_and_repeated_rows(spark):
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(1, a, "en", "s", 0)] * 3 + [(2, a, "en", "s", 0), (None, a, "en", "s", 0), (3, None, "en", "s", 0), (3, "", "en", "s", 0)]
    got = run(spark, rows)
    assert got == plain([(1, 40, 40, "")] * 3 + [(2, 40, 40, ""), (None, 40, 0, a), (3, 0, 0, ""), (3, 0, 0, "")])
    b = a + " tail"
    kept = sorted(r[3] for r in run(spark, [(1, a, "en", "s", 0), (1, b, "en", "s", 0)]))
    assert kept in (["", b], ["tail", a])


def test_every_window_is_covered_by_an_anchor():
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 50, 500).astype(np.uint64)
    text = np.repeat([0, 1, 2], [300, 15, 185])
    anchor, segment, place, first, last = substring.anchors(hashes, text)
    windows = [w for f, l in zip(first, last) for w in range(f, l + 1)]
    assert windows == [w for w in range(481) if text[w] == text[w + 19]]
    assert ((first <= place) & (place <= last + 12) & (place >= last) & (place - first <= 12)).all()
    chosen = {w: (int(a), int(p - w)) for a, p, f, l in zip(anchor, place, first, last) for w in range(f, l + 1)}
    again = substring.anchors(hashes[100:200], text[100:200])
    other = {w + 100: (int(a), int(p - w)) for a, p, f, l in zip(again[0], *again[2:]) for w in range(f, l + 1)}
    assert all(chosen[w] == x for w, x in other.items())


def test_extent():
    one = np.array([[1, 2, 3, 4, 5, 6, 7]], np.uint64)
    two = np.array([[9, 2, 3, 4, 5, 6, 0]], np.uint64)
    left, right = substring.extent(one, two, reach=3, gram=2)
    assert (left.tolist(), right.tolist()) == ([2], [1])
