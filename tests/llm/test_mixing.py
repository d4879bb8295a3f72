import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import mixing
from tests.llm.helpers import awkward, frame, plain

TREE = (
    mixing.Level("domain", "CASE WHEN n_chars IS NULL THEN 'none' WHEN n_chars < 6 THEN 'low' ELSE 'high' END", {"low": 0.6, "high": 0.3, "none": 0.0}),
    mixing.Level("language", "coalesce(lang, '')", {"en": 0.7}, 0.1),
    mixing.Level("origin", "coalesce(source, '')", {"s2": 3.0}),
)
WEIGHTS = [lambda d: {"low": 0.6, "high": 0.3, "none": 0.0}[d], lambda x: 0.7 if x == "en" else 0.1, lambda s: 3.0 if s == "s2" else 1.0]


def leaf_of(r):
    return ("none" if r[4] is None else "low" if r[4] < 6 else "high", r[2] or "", r[3] or "")


def n_tokens(text):
    return len([w for w in re.split(r"[ \t-\r]+", text or "") if w])


def share_out(budget, nodes, depth):
    """Water filling by repetition: the capped ones leave, the rest shares what is left."""
    children = defaultdict(list)
    for path, capacity in nodes:
        children[path[depth]].append((path, capacity))
    capacity = {k: sum(c for _, c in v) for k, v in children.items()}
    weight = {k: WEIGHTS[depth](k) for k in children}
    given, open_ = dict.fromkeys(children, 0.0), {k for k in children if weight[k] > 0}
    left = budget
    while open_:
        unit = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if capacity[k] <= unit * weight[k]}
        if not full:
            for k in open_:
                given[k] = unit * weight[k]
            break
        for k in full:
            given[k] = capacity[k]
            left -= capacity[k]
        open_ -= full
    out = {}
    for k, v in children.items():
        out |= {v[0][0]: given[k]} if depth == len(WEIGHTS) - 1 else share_out(given[k], v, depth + 1)
    return out


def brute(rows, share, max_epochs, seed):
    leaves = defaultdict(list)
    for r in rows:
        if n_tokens(r[1]):
            leaves[leaf_of(r)].append(r)
    tokens = {k: sum(n_tokens(r[1]) for r in v) for k, v in leaves.items()}
    capacity = {k: (0 if WEIGHTS[0](k[0]) == 0 else t * max_epochs) for k, t in tokens.items()}
    budgets = share_out(share * sum(tokens.values()), list(capacity.items()), 0) if leaves else {}
    out = []
    for k, v in leaves.items():
        budget = int(round(budgets[k], 6))
        whole, rest = divmod(budget, tokens[k])
        by_key = defaultdict(list)
        for r in v:
            name = "" if r[0] is None else str(r[0])
            by_key[(hashlib.md5(f"{seed}:{whole}:{name}".encode()).hexdigest(), name)].append(r)
        taken, stopped = 0, False
        for key in sorted(by_key):
            taken += sum(n_tokens(r[1]) for r in by_key[key])
            stopped |= taken > rest
            for r in by_key[key]:
                out += [(r[0], e, n_tokens(r[1])) for e in range(whole + (not stopped))]
    return plain(out)


@pytest.mark.parametrize("share, epochs, seed", [(0.5, 3, 17), (0.05, 1, 1), (2.0, 4, 2), (9.0, 2, 3)])
def test_equals_brute_force(spark, share, epochs, seed):
    rows = awkward() + [(1000 + i, "w " * (i % 40), "en", "s0", 1) for i in range(400)]
    got, epoch, count = mixing.draw(frame(spark, rows, extra=True), TREE, share=share, max_epochs=epochs, seed=seed)
    assert plain((r["doc_id"], int(r[epoch]), r[count]) for r in got.collect()) == brute(rows, share, epochs, seed)


def test_shortage_goes_to_siblings_first(spark):
    """The short leaf of family a is made up for inside a; family b keeps its share."""
    tree = (mixing.Level("f", "lang", {"a": 0.5, "b": 0.5}), mixing.Level("s", "source"))
    leaves = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 1000.0), ("b", "z", 1000.0)], "f string, s string, capacity double")
    got = {(r["f"], r["s"]): r["budget"] for r in mixing.allocate(leaves, tree, 400.0).collect()}
    assert got == {("a", "x"): 10.0, ("a", "y"): 190.0, ("b", "z"): 200.0}
    got = {(r["f"], r["s"]): r["budget"] for r in mixing.allocate(leaves.where("s != 'y'"), tree, 400.0).collect()}
    assert got == {("a", "x"): 10.0, ("b", "z"): 390.0}


def test_empty_and_stage(spark):
    assert mixing.stage(spark, frame(spark, []), "").count() == 0
    docs = frame(spark, awkward(), extra=True)
    left = mixing.stage(spark, docs, "")
    assert left.columns[: len(docs.columns)] == docs.columns and len(left.columns) == len(docs.columns) + 2
    assert 0 < left.count() and left.where(F.col("text").isNull()).count() == 0
