from collections import defaultdict

from shelfmark.llm import line_dedup
from tests.llm.helpers import awkward, frame, plain


def brute(rows, min_sites):
    sites, first = defaultdict(set), {}
    order = lambda d, i: ((d[0] is not None, d[0] or 0), str(d[1]), i)
    for d in rows:
        for i, raw in enumerate((d[1] or "").split("\n")):
            line = raw.strip(" \t\r")
            if line:
                sites[line].add(d[3] or "")
                first[line] = min(first.get(line, order(d, i)), order(d, i))
    out = []
    for d in rows:
        if d[1] is None:
            out.append((d[0], None, 0))
            continue
        kept = []
        lines = d[1].split("\n")
        for i, raw in enumerate(lines):
            line = raw.strip(" \t\r")
            if not line or len(sites[line]) < min_sites or first[line] == order(d, i):
                kept.append(raw)
        out.append((d[0], "\n".join(kept), len(lines) - len(kept)))
    return plain(out)


def run(spark, rows, min_sites, extra=False):
    got, removed = line_dedup.remove_shared_lines(frame(spark, rows, extra), min_sites=min_sites)
    return plain((r["doc_id"], r["text"], r[removed]) for r in got.collect())


def test_equals_brute_force(spark):
    shared = [f"Shared line {k}" for k in range(8)]
    rows = awkward()
    for i in range(60):  # line k is on the sites 0 to k + 1
        lines = [f"own {i}"] + [shared[k] for k in range(8) if i % 10 <= k + 1] + ["", "  ", f" {shared[3]}\t" if i % 10 == 2 else "x"]
        rows.append((1000 + i, "\n".join(lines), "en", f"site{i % 10}", 0))
    for min_sites in (2, 5, 9):
        assert run(spark, rows, min_sites, extra=True) == brute(rows, min_sites)


def test_one_hot_line_on_many_sites(spark):
    rows = [(i, f"hot\nown {i}", "en", f"s{i}", 0) for i in range(500)]
    got = run(spark, rows, 10)
    assert sum(t.startswith("hot") for _, t, _ in got) == 1 and sum(n for _, _, n in got) == 499


def test_empty(spark):
    assert run(spark, [], 5) == []
    assert run(spark, [(1, None, None, None, None)], 5) == [(1, None, 0)]


def test_stage_drops_what_was_boilerplate_only(spark):
    rows = [(i, "Same footer", "en", f"s{i}", 0) for i in range(12)] + [(50, "", "en", "s", 0), (51, None, "en", "s", 0)]
    got = line_dedup.stage(spark, frame(spark, rows, extra=True), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 50, 51]
    assert got.columns == frame(spark, rows, extra=True).columns
