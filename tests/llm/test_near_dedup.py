import random

import numpy as np
import pytest

from shelfmark.llm import near_dedup
from shelfmark.llm.components import components
from shelfmark.llm.textbytes import U
from tests.llm.helpers import awkward, frame, plain


def shingles(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    w = [x for x in lowered.split(" ") if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows, percent=85):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None:
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return plain((r[0], len(sets[i]), least.get(root(i)), r[0] == least.get(root(i))) for i, r in enumerate(rows))


def near_copies(rng, n, words=120, edits=2, first=1000):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append((first + i, " ".join(own), "en", "s", 0))
    return out


def run(spark, rows, extra=False):
    return plain(near_dedup.near_groups(frame(spark, rows, extra)).collect())


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = awkward() + near_copies(rng, 40) + near_copies(rng, 40, edits=5, first=2000) + near_copies(rng, 30, words=30, first=3000)
    rows = [r for r in rows if r[0] != 106] + [(106, "one two", "fr", "s4", 7)]
    assert run(spark, rows, extra=True) == brute(rows)


def test_large_groups_are_split(spark, monkeypatch):
    """Groups far beyond a block of members or of shingles, linked and not, with and without rounds of centres."""
    rng = random.Random(4)
    rows = near_copies(rng, 150, edits=3) + near_copies(rng, 150, edits=12, first=5000)
    want = brute(rows)
    for block, cell, rounds in ((16, 1 << 20, 3), (1000, 500, 1), (16, 1 << 20, 0)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "CELL", cell)
        monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
        assert run(spark, rows) == want


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "a b c d e f", "en", "s", 0)] * 3 + [(6, "A B C D E F", "en", "s", 0)]
    assert run(spark, rows) == plain([(5, 2, 5, True)] * 3 + [(6, 2, 5, False)])
    assert run(spark, []) == []
    kept = near_dedup.stage(spark, frame(spark, rows, extra=True), "")
    assert [r["doc_id"] for r in kept.collect()] == [5] and kept.columns == frame(spark, rows, extra=True).columns


def test_stage_keeps_rows_without_shingles_or_id(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c d e f", "en", "s", 0), (3, "a b c d e f", "en", "s", 0)]
    assert near_dedup.stage(spark, frame(spark, rows), "").count() == 4


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for share in (0.5, 0.8, 0.95):
        for n in (5, 60, 2000):
            common = int(n * share)
            pool = rng.integers(0, 2**63, 2 * n - common).astype(U)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:common], pool[n:]]))
            both = near_dedup.signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 180)
            assert (both != near_dedup.EMPTY).all()
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(abs((both[0] == both[1]).mean() - true))
    assert max(errors) < 0.15 and np.mean(errors) < 0.05


@pytest.mark.parametrize("seed", [1, 2])
def test_intersections(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(U)) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = near_dedup.intersections(sets)
    off = ~np.eye(30, dtype=bool)
    assert (got[off] == np.array(want)[off]).all()


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {(r["id"], r["component"]) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(x, root(x)) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stage_links_from_80_percent_on(spark):
    """Pairs of 95 words that differ in one run: 91 shingles each, so ``n`` changed words give (87-n)/(95+n)."""
    rng = random.Random(11)
    rows, similarity = [], {}
    for k, changed in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12] * 4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(95)]
        other = base[:40] + [f"e{rng.randrange(10**6)}" for _ in range(changed)] + base[40 + changed :]
        rows += [(2 * k, " ".join(base), "en", "s", 0), (2 * k + 1, " ".join(other), "en", "s", 0)]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        similarity[2 * k + 1] = 100 * len(a & b) / len(a | b)
    assert any(80 <= x < 85 for x in similarity.values()) and any(x < 80 for x in similarity.values())
    left = {r["doc_id"] for r in near_dedup.stage(spark, frame(spark, rows), "").collect()}
    assert left == {r[0] for r in rows if similarity.get(r[0], 0) < 80}
    kept = {r["doc_id"] for r in near_dedup.near_groups(frame(spark, rows)).where("kept").collect()}
    assert kept == {r[0] for r in rows if similarity.get(r[0], 0) < 85}


def test_stage_decides_by_row(spark):
    """Rows of one id: a text of its own stays, a copy or near copy of another row goes, equal rows leave one."""
    rng = random.Random(12)
    near = [r[1] for r in near_copies(rng, 4, edits=2)]
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(4)]
    texts = [(1, near[0]), (5, near[1]), (5, own[0]), (5, own[1]), (6, own[2]), (6, own[2]), (7, near[2]), (7, near[3]), (8, own[1])]
    texts += [(9, f"{own[3]} a b"), (9, f"{own[3]} a c"), (10, None), (10, ""), (None, own[0]), (None, own[0])]
    rows = [(i, t, "en", "s", 0) for i, t in texts]
    left = [(r["doc_id"], r["text"]) for r in near_dedup.stage(spark, frame(spark, rows), "").collect()]
    assert len([x for x in left if x[0] == 9]) == 1
    want = [(1, near[0]), (5, own[0]), (5, own[1]), (6, own[2]), (10, None), (10, ""), (None, own[0]), (None, own[0])]
    assert plain(x for x in left if x[0] != 9) == plain(want)


def test_vertices_of_large_clusters_are_named_once(spark):
    """One row per vertex with its open buckets: no row per vertex and bucket meets the names."""
    members = spark.createDataFrame([(1, 5, [7, 8]), (2, 5, [7, 8, 9]), (3, 5, [9])], "vertex long, n long, keys array<long>")
    links = spark.createDataFrame([(1, 2)], "a long, b long")
    got = {r["vertex"]: (r["component"], sorted(r["keys"])) for r in near_dedup._labelled(members, links).collect()}
    assert got == {2: (1, [9]), 3: (3, [9])}
