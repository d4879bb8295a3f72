import hashlib
import random
import zlib

import pytest

from shelfmark.llm import prefix_trie
from tests.llm.helpers import plain

SCHEMA = "conv_id long, turn long, role string, text string, conv long, pos int, block string, key1 int"


def order_of(row):
    digest = hashlib.md5(f"{len(row[2] or '')}:{row[2] or ''}{row[3] or ''}".encode()).hexdigest()
    return (row[1] is not None, row[1] or 0, digest)


def conversations(rows):
    found = {}
    for r in rows:
        if r[0] is not None:
            found.setdefault(r[0], []).append(r)
    return {c: [(r[2] or "", r[3] or "") for r in sorted(x, key=order_of)] for c, x in found.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in nodes.items():
        value = (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += value
            leaves[p[:d]] += p not in children
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children.get(p, [])), leaves[p], saved[p],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return plain(out)


def rows_of(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 3, 8, 9, 16, 17, 30])):
            rows.append((c * 3 % 100 - 20, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", None, "", "a b"]) if t > 2 else "hello"))
    rows += [(7, None, "user", "first"), (7, None, None, None), (8, 3, "x", "tie"), (8, 3, "x", "tie"), (8, 3, "y", "tie"), (None, 1, "user", "lost")]
    return rows + [(900, t, "user", "same " * 2000 if t == 0 else f"{t % 3}") for t in range(70)] + [(901, t, "user", "same " * 2000 if t == 0 else f"{t % 3}") for t in range(90)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "3", 4) for r in rows], SCHEMA)


@pytest.mark.parametrize("chunk, many", [(1024, 10_000), (2, 3)])
def test_trie_equals_brute_force(spark, monkeypatch, chunk, many):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "MANY", many)
    rows = rows_of()
    got = prefix_trie.prefix_trie(frame(spark, rows)).drop("node1", "node2").collect()
    assert plain(got) == brute(conversations(rows))


def test_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PART", 10)
    rows = rows_of(2)
    monkeypatch.setattr(prefix_trie, "table", lambda *_: frame(spark, rows))
    assert plain(prefix_trie.op11_prefix_trie(spark, "").collect()) == brute(rebuilt(conversations(rows)))


def test_many_equal_conversations(spark):
    """A hot prefix and a hot end: most conversations are the same."""
    rows = [(c, t, "user", f"turn {t}") for c in range(3000) for t in range(3 if c % 3 else 2 + c % 2)]
    got = prefix_trie.prefix_trie(frame(spark, rows)).drop("node1", "node2").collect()
    assert plain(got) == brute(conversations(rows))


def test_turnless_and_empty(spark, monkeypatch):
    none = prefix_trie.prefix_trie(frame(spark, []))
    assert none.count() == 0
    turns, lengths = prefix_trie.number_turns(frame(spark, []))
    two = spark.createDataFrame([(4,), (11,)], "conv long")
    got = prefix_trie.trie(turns, two).drop("node1", "node2").collect()
    assert plain(got) == brute({4: [], 11: []})


def test_numbers_across_ranges(spark):
    """One conversation in many ranges of the sort."""
    rows = [(1, (t * 37) % 5000, "user", str(t)) for t in range(5000)] + [(2, 1, "user", "x"), (0, 1, "user", "y")]
    turns, lengths = prefix_trie.number_turns(frame(spark, rows).repartition(7))
    assert sorted((r["conv"], r["pos"]) for r in turns.collect()) == [(0, 1)] + [(1, i + 1) for i in range(5000)] + [(2, 1)]
    assert dict(lengths.collect()) == {0: 1, 1: 5000, 2: 1}
