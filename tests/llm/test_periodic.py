import hashlib
import random
import zlib

import numpy as np
import pytest

from shelfmark.llm import periodic
from tests.llm.helpers import awkward, frame, plain


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute_runs(x, least=6, power=4):
    """Every stretch whose words q apart are equal, its least q, longest first by definition of maximal."""
    found = {}
    for q in range(1, len(x) // power + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, power * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute(rows):
    out = []
    for r in rows:
        w = split(r[1] or "")
        h, n = zlib.crc32(("" if r[0] is None else str(r[0])).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((
            r[0], len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
        ))
    return plain(out)


def periodic_rows():
    rng = random.Random(8)
    rows = []
    for i in range(60):
        part = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
        rows.append((200 + i, " ".join([rng.choice("ab") for _ in range(5)] + part * rng.randrange(2, 9) + part[: rng.randrange(3)]), "en", "s", 0))
    rows.append((300, " ".join(["la"] * 5000), "en", "s", 0))
    rows.append((301, "  ".join(["x y z"] * 3000) + " x", "en", "s", 0))
    return rows


def run(spark, rows, monkeypatch):
    monkeypatch.setattr(periodic, "table", lambda *_: frame(spark, rows, extra=True))
    return plain(periodic.op13_periodic_runs(spark, "").collect())


def test_equals_brute_force(spark, monkeypatch):
    rows = [r for r in awkward() + periodic_rows() if r[0] != 109] + [(109, " ".join(f"w{i % 97}" for i in range(2500)), "en", "s", 0)]
    assert run(spark, rows, monkeypatch) == brute(rows)
    assert run(spark, [], monkeypatch) == []


def test_spans_and_text(spark):
    rows = [(1, "go a b a b a b a b a end", "en", "s", 0), (2, None, "en", "s", 0), (3, "é é é é é é é", "en", "s", 0)]
    got = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(frame(spark, rows)).collect()}
    assert got == {1: (11, [(1, 9, 2)], "go a b end"), 2: (0, [], ""), 3: (7, [(0, 7, 1)], "é")}
    short = periodic.find_runs(frame(spark, rows), least=2, power=2).where("doc_id = 1").first()["runs"]
    assert [tuple(x) for x in short] == [(1, 9, 2)]


@pytest.mark.parametrize("least, power", [(6, 4), (2, 2), (5, 3)])
def test_runs_of_many_texts(least, power):
    """Groups of short texts over few words, with the texts' ends as borders."""
    rng = random.Random(least)
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            x = [rng.randrange(rng.randrange(1, 4)) for _ in range(rng.randrange(60))]
            if rng.random() < 0.4 and len(x) > 5:
                x = x[:3] + [x[i % rng.randrange(1, 4)] for i in range(len(x))]
            texts.append(x)
        bounds = np.cumsum([0] + [len(x) for x in texts])
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        symbols = np.array([w * 100 + t for t, x in enumerate(texts) for w in x], np.int64)
        got = list(zip(*(x.tolist() for x in periodic.runs_of(symbols, bounds[owner], bounds[owner + 1], least, power))))
        assert got == [(s + int(bounds[t]), m, q) for t, x in enumerate(texts) for s, m, q in brute_runs(x, least, power)]


def test_suffix_and_lcp_arrays():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, 200)
    order, ranks = periodic.suffix_array(x, np.full(200, 200))
    suffixes = [tuple(x[i:].tolist()) for i in range(200)]
    assert order.tolist() == sorted(range(200), key=lambda i: suffixes[i])
    assert ranks[-1][order].tolist() == list(range(200))
    common = lambda a, b: next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    want = [common(suffixes[a], suffixes[b]) for a, b in zip(order[:-1], order[1:])]
    assert periodic.lcp_array(order, ranks).tolist() == [0, *want, 0]


def test_work_on_long_periods_stays_small(monkeypatch):
    """A run of many periods is rotated once, not once per multiple of its period."""
    rotated = []
    plain_rotation = periodic.rotate_left
    monkeypatch.setattr(periodic, "rotate_left", lambda s, b, i, q: rotated.append(len(i)) or plain_rotation(s, b, i, q))
    n = 30_000
    got = periodic.runs_of(np.arange(n) % 3, np.zeros(n, np.int64), np.full(n, n))
    assert [x.tolist() for x in got] == [[0], [n], [3]] and sum(rotated) < n
    monkeypatch.setattr(periodic, "CHUNK", 1000)
    again = periodic.runs_of(np.arange(n) % 3, np.zeros(n, np.int64), np.full(n, n))
    assert [x.tolist() for x in again] == [[0], [n], [3]]
