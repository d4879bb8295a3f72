import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import tokens
from shelfmark.operators import features
from shelfmark.operators.features import Block
from shelfmark.session import write_through

WORDS = Block("w", "words", 1, 2, 6)
CHARS = Block("c", "chars", 3, 5, 50, min_df=2, characters=True)
DOCS = [(1, "Wi-Fi x роутер wi роутер", "ab abc"), (2, "роутер _a_ 12", "ab d"), (3, "x", " "), (4, "wi роутер fi fi", "abcd ab")]


def docs(spark):
    return spark.createDataFrame(DOCS, "row_id long, words string, chars string")


def word_terms(text):
    w = re.findall(r"\b\w\w+\b", text.lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def char_terms(text):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        out += [w[i:i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    return out


def expected_vectors(terms_of, n, min_df=1):
    counts = {d[0]: Counter(terms_of(d)) for d in DOCS}
    df, ctf = Counter(), Counter()
    for c in counts.values():
        df.update(c.keys())
        ctf.update(c)
    kept = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-ctf[t], t))[:n]
    idf = {t: math.log((1 + len(DOCS)) / (1 + df[t])) + 1 for t in kept}
    out = {}
    for row, c in counts.items():
        raw = {t: (1 + math.log(c[t])) * idf[t] for t in c if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(row, t): v / norm for t, v in raw.items()})
    return out


def test_word_ngrams(spark):
    got = docs(spark).select("row_id", tokens.words(F.col("words")).alias("t")).select(
        "row_id", tokens.word_ngrams(F.col("t"), 1, 2).alias("g")
    )
    assert {r["row_id"]: sorted(r["g"]) for r in got.collect()} == {d[0]: sorted(word_terms(d[1])) for d in DOCS}


def test_char_ngrams(spark):
    df = spark.createDataFrame([("a",), ("ab",), ("abc",), ("",), ("a  bcde",)], "t string")
    got = df.select("t", tokens.char_ngrams(tokens.padded_words(F.col("t")), 3, 5).alias("g")).collect()
    assert {r["t"]: sorted(r["g"]) for r in got} == {
        "a": [" a "],
        "ab": sorted([" ab", "ab ", " ab "]),
        "abc": sorted([" ab", "abc", "bc ", " abc", "abc ", " abc "]),
        "": [],
        "a  bcde": sorted(char_terms("a bcde")),
    }
    long = df.select(tokens.char_ngrams(tokens.padded_words(F.col("t")), 4, 5).alias("g")).collect()
    assert long[0]["g"] == [" a "]  # shorter than the smallest n: itself, once


def close(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_tfidf_of_both_blocks(spark):
    blocks = [WORDS, CHARS]
    vocab = features.fit(docs(spark), blocks)
    rows = features.tfidf(docs(spark), vocab, blocks).collect()
    close(
        {(r["row_id"], r["term"]): r["weight"] for r in rows if r["block"] == "w"},
        expected_vectors(lambda d: word_terms(d[1]), 6),
    )
    close(
        {(r["row_id"], r["term"]): r["weight"] for r in rows if r["block"] == "c"},
        expected_vectors(lambda d: char_terms(d[2]), 50, 2),
    )


def test_positions_follow_rarity_and_blocks(spark):
    vocab = features.fit(docs(spark), [WORDS, CHARS]).orderBy("idx").collect()
    words = [r for r in vocab if r["block"] == "w"]
    assert [r["idx"] for r in words] == list(range(6))
    assert [r["df"] for r in words] == sorted(r["df"] for r in words)
    assert min(r["idx"] for r in vocab if r["block"] == "c") == 6


def test_unknown_terms_and_equal_texts(spark):
    vocab = features.fit(docs(spark), [WORDS])
    new = spark.createDataFrame([(7, "zz yy"), (8, "роутер wi"), (9, "роутер wi")], "row_id long, words string")
    got = {r["row_id"]: r for r in features.vectors(new, vocab, [WORDS]).collect()}
    assert set(got) == {8, 9}
    assert got[8]["weights"] == got[9]["weights"]
    assert abs(sum(w * w for w in got[8]["weights"]) - 1) < 1e-12


def test_top_terms_with_one_hot_term(spark):
    many = spark.range(400).select(
        F.col("id").alias("row_id"),
        F.concat_ws(" ", F.lit("hot hot"), F.concat(F.lit("t"), (F.col("id") % 37).cast("string")), F.concat(F.lit("u"), F.col("id").cast("string"))).alias("words"),
    )
    block = Block("w", "words", 1, 1, 30)
    got = [r["term"] for r in features.top_terms(features.corpus_counts(many, [block]), [block]).orderBy(F.desc("ctf"), "term").collect()]
    count = Counter(w for i in range(400) for w in f"hot hot t{i % 37} u{i}".split())
    assert got == sorted(count, key=lambda t: (-count[t], t))[:30]


def random_docs(spark, n=120, seed=2):
    rng = random.Random(seed)
    words = ["aa", "b", "ccc", "über", "роутер", "x1", "_u_", "é" * 3, "12", "wi-fi"] + [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30))) or None, " ".join(rng.choice(words) for _ in range(rng.randrange(6)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row_id long, words string, chars string")


def counted(rows, terms_of):
    df, ctf = Counter(), Counter()
    for r in rows:
        c = Counter(terms_of(r))
        df.update(c.keys())
        ctf.update(c)
    return {t: (df[t], ctf[t]) for t in df}


def test_corpus_counts_equal_brute_force(spark):
    rows, df = random_docs(spark)
    blocks = [Block("w", "words", 1, 3, 10), Block("c", "chars", 3, 5, 10, characters=True)]
    got = {(r["block"], r["term"]): (r["df"], r["ctf"]) for r in features.corpus_counts(df, blocks).collect()}

    def grams(r):
        w = re.findall(r"\b\w\w+\b", (r[1] or "").lower())
        return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    want = {("w", t): v for t, v in counted(rows, grams).items()}
    want |= {("c", t): v for t, v in counted(rows, lambda r: char_terms(r[2])).items()}
    assert got == want


@pytest.mark.parametrize("capacity, limit, min_df", [(1 << 20, 1 << 20, 1), (40, 1 << 20, 1), (300, 1 << 20, 2), (5, 1 << 20, 1), (1 << 20, 0, 1)])
def test_candidates_hold_the_most_frequent_terms(spark, capacity, limit, min_df):
    """With counters for all terms, for some, for too few (then all are counted), and without room to broadcast."""
    rows, df = random_docs(spark)
    block = Block("w", "words", 1, 2, 25, min_df=min_df)
    counts = features.candidate_counts(df, [block], capacity=capacity, limit=limit)
    got = [(r["term"], r["df"], r["ctf"]) for r in features.top_terms(counts, [block]).collect()]
    true = {t: v for t, v in counted(rows, lambda r: word_terms(r[1] or "")).items() if v[0] >= min_df}
    want = sorted(true, key=lambda t: (-true[t][1], t))[:25]
    assert sorted(got) == sorted((t, *true[t]) for t in want)


def test_counters_bound_true_counts():
    rng = np.random.default_rng(3)
    counters, true = features.Counters(20), Counter()
    for _ in range(50):
        terms = (rng.zipf(1.5, 200) % 500).astype(np.uint64)
        one, n = np.unique(terms, return_counts=True)
        counters.add(one, one, n)
        true.update(terms.tolist())
    low = dict(zip(counters.one.tolist(), counters.low.tolist()))
    assert len(low) <= 20 and counters.error > 0
    assert all(low.get(t, 0) <= n <= low.get(t, 0) + counters.error for t, n in true.items())


def test_vectors_without_broadcast(spark):
    _, df = random_docs(spark)
    blocks = [Block("w", "words", 1, 2, 30), Block("c", "chars", 3, 5, 40, min_df=2, characters=True)]
    vocab = features.fit(df, blocks)
    rows = lambda x: {r["row_id"]: (r["indices"], r["weights"]) for r in x.collect()}
    here, joined = rows(features.vectors(df, vocab, blocks)), rows(features.vectors(df, vocab, blocks, limit=0))
    assert here.keys() == joined.keys()
    for k in here:
        assert here[k][0] == joined[k][0] and np.allclose(here[k][1], joined[k][1], atol=1e-12)


def test_texts_are_not_shuffled(spark):
    _, df = random_docs(spark)
    block = Block("w", "words", 1, 2, 30)
    vocab = features.fit(df, [block])
    assert "Exchange" not in features.vectors(df, vocab, [block])._jdf.queryExecution().executedPlan().toString()


def test_counters_wait_until_there_are_as_many_new_counts(monkeypatch):
    sorts = []
    by_term = features._by_term
    monkeypatch.setattr(features, "_by_term", lambda *a: sorts.append(1) or by_term(*a))
    counters = features.Counters(1000)
    for i in range(50):
        terms = np.arange(i, i + 10, dtype=np.uint64)
        counters.add(terms, terms, np.ones(10, np.int64))
    assert not sorts
    assert counters.low.sum() == 500 and len(counters.one) == len(counters.two) == 59 and counters.error == 0
    assert len(sorts) == 1


@pytest.mark.parametrize("capacity", [1, 7, 1 << 20])
def test_hash_counts_are_exact_at_any_capacity(spark, capacity):
    rows, df = random_docs(spark)
    block = Block("w", "words", 1, 2, 25)
    hashes = features._joined(df, [block]).mapInArrow(features._hash_counts([block], capacity), "block string, h1 long, h2 long, df long, ctf long")
    got = hashes.groupBy("h1", "h2").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf")).collect()
    want = counted(rows, lambda r: word_terms(r[1] or ""))
    assert sorted((r["df"], r["ctf"]) for r in got) == sorted(want.values())


def test_unproven_candidates_are_counted_by_hash_alone(spark, monkeypatch):
    """With too few counters the strings of the candidates only are cut out, not those of all terms."""
    _, df = random_docs(spark)
    block = Block("w", "words", 1, 2, 25)
    lookups = []
    cut = features._counted_terms
    monkeypatch.setattr(features, "_counted_terms", lambda blocks, candidates=None: lookups.append(candidates) or cut(blocks, candidates))
    features.candidate_counts(df, [block], capacity=5)
    assert lookups and all(c is not None and len(c.value["w"]) < 100 for c in lookups)


def test_kept_columns_stay_beside_their_vector(spark):
    """No exchange of vectors; where ids repeat, as a join by id gives them."""
    block = features.Block("w", "text", 1, 1, 50)
    df = write_through(spark.createDataFrame([(1, "a b", 10), (2, "b c", 20), (3, "zz", 30)], "row_id long, text string, d long"), "docs")
    vocab = features.fit(df.where("row_id < 3"), [block])
    kept = features.vectors(df, vocab, [block], "d")
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    both = df.unionByName(spark.createDataFrame([(1, "c", 11)], df.schema))
    for rows in (df, both):
        for limit in (1 << 26, 0):
            want = features.vectors(rows, vocab, [block]).join(rows.select("row_id", "d"), "row_id").select("row_id", "d", "indices", "weights")
            got = features.vectors(rows, vocab, [block], "d", limit=limit)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
