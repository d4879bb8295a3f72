import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shelfmark.llm import lattice
from shelfmark.llm.common import in_fold
from tests.llm.helpers import awkward, frame, plain


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) + [None]


def test_lattice_sums_all_segmentations():
    pieces = [b" ", b" a", b"a", b"b", b"ab", b"aba", b" ab", b"ba"] + [bytes([b]) for b in range(256) if b not in b" ab"]
    rng = np.random.default_rng(3)
    log_p = np.log(rng.dirichlet(np.ones(len(pieces))))
    p = {x: math.exp(v) for x, v in zip(pieces, log_p)}
    found = SimpleNamespace(**vars(lattice.Pieces(pieces)))

    def paths(w):
        if not w:
            return [((), 1.0)]
        return [((x, *rest), p[x] * v) for x in p if w.startswith(x) for rest, v in paths(w[len(x) :])]

    words = [b"abab", b"a", b"", b"bbaabab", b"xab", "é".encode(), b"ab" * 4]
    data, starts, ends = lattice._packed(pa.array(words, pa.binary()))
    weights = np.arange(1.0, len(words) + 1)
    total, expected = lattice.lattice(found, log_p, data, starts, ends, weights)
    want = np.zeros(len(pieces))
    for w, got, weight in zip(words, total, weights):
        every = paths(b" " + w)
        mass = sum(v for _, v in every)
        assert math.isclose(got, math.log(mass), rel_tol=1e-9)
        for path, v in every:
            for x in path:
                want[pieces.index(x)] += weight * v / mass
    assert np.allclose(expected, want)


def run(spark, rows, **options):
    docs = frame(spark, rows, extra=True).withColumn("held_out", in_fold("doc_id", 1))
    model = lattice.learn(docs.select((~F.col("held_out")).alias("training"), "text"))
    return lattice.score(docs, model, **options).collect(), model


def counts(rows):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for r in rows if not fold(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    floor = math.log10(n + 0.5 * (v + 1))
    out = []
    for r in rows:
        t = tokens(r[1])
        out.append((r[0], fold(r[0]), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10(c[w] + 0.5) - floor for w in t), 6)))
    return plain(out)


def test_counts_and_base_equal_brute_force(spark):
    rows = awkward()
    for head in (10**6, 7):
        got, _ = run(spark, rows, head_words=head)
        assert plain((*r[:5], round(r["base_score"], 6)) for r in got) == counts(rows)
        scores = plain((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in got)
        assert head != 7 or scores == before
        before = scores


def test_probabilities_sum_to_one(spark):
    """Seen words, the end and what is left for other words make 1."""
    rows = [(i, "aa aa ab b c dd " + "e" * (i % 3 + 1), "en", "s", 0) for i in range(40)]
    _, model = run(spark, rows)
    seen = sum(10 ** r["log10_word"] for r in model["words"].collect())
    end = 10 ** model["log10_word_end"]
    assert 0.5 < seen + end <= 1.000001
    assert math.isclose(np.exp(model["log_p"]).sum() + 10 ** model["log10_end"], 1)


def test_score_is_the_sum_over_all_segmentations(spark):
    """Whole texts against brute force over the fitted pieces; a seen word has no other way than its segmentations."""
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(["the cat", "The  cat sat", "zq the", "é", "", "the the the cat"] * 6)]
    got, model = run(spark, rows)
    p = {x: math.exp(v) for x, v in zip(model["pieces"], model["log_p"])}

    def mass(w):
        ways = [1.0] + [0.0] * len(w)
        for end in range(1, len(w) + 1):
            ways[end] = sum(ways[start] * p.get(w[start:end], 0.0) for start in range(end))
        return ways[-1]

    def every(w):
        return 1.0 if not w else sum(p[w[:n]] * every(w[n:]) for n in range(1, len(w) + 1) if w[:n] in p)

    assert math.isclose(mass(b" cat"), every(b" cat"))
    for r in got:
        text = rows[r["doc_id"]][1]
        want = sum(math.log10(every(b" " + w.encode())) for w in tokens(text)[:-1]) + model["log10_end"]
        assert math.isclose(r["score"], want, rel_tol=1e-9, abs_tol=1e-9)
    assert {r["held_out"] for r in got} == {True, False}


def test_frequent_words_shape_the_pieces(spark):
    """Expected counts are weighted by the words' counts: a word seen more often gets likelier, others less."""
    few = [(i, "zebra quark", "en", "s", 0) for i in range(30)]
    many = [(i, "zebra " * 50 + "quark", "en", "s", 0) for i in range(30)]
    a, b = run(spark, few)[1], run(spark, many)[1]

    def mass(model, w):
        p = {x: math.exp(v) for x, v in zip(model["pieces"], model["log_p"])}
        ways = [1.0] + [0.0] * len(w)
        for end in range(1, len(w) + 1):
            ways[end] = sum(ways[start] * p.get(w[start:end], 0.0) for start in range(end))
        return math.log10(ways[-1])

    ratio = lambda m: mass(m, b" zebra") - mass(m, b" quark")
    assert ratio(b) > ratio(a) + 1


def test_without_texts(spark):
    assert run(spark, [])[0] == []
    got, _ = run(spark, [(1, None, "en", "s", 0)])
    assert (got[0]["n_tokens"], got[0]["score"] < 0) == (1, True)


def test_learning_helps():
    pieces, log_p = lattice.read_vocabulary()
    assert math.isclose(np.exp(log_p).sum(), 1) and {bytes([b]) for b in range(256)} <= set(pieces)
