import hashlib

import numpy as np

from shelfmark.llm import fingerprint as fp
from shelfmark.llm.textbytes import STEP, U, mixed
from tests.llm.helpers import awkward, frame, plain


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for i, r in enumerate(order):
        text, following = r[1] or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        a, b, c = (fp.fingerprint(fp.code_points(t)) for t in (text, edited, following))
        out.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.likeness(a, b), fp.likeness(a, c)))
    return out


def run(spark, rows):
    got = fp.edited_fingerprints(frame(spark, rows, extra=True)).collect()
    return [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got]


def test_equals_brute_force(spark):
    rows = [r for r in awkward() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    assert plain(run(spark, rows)) == plain(brute(rows))
    assert plain(run(spark, rows[:1])) == plain(brute(rows[:1]))
    assert run(spark, []) == []


def test_null_and_repeated_ids(spark):
    got = run(spark, awkward())
    assert sorted((str(g[0]), g[1]) for g in got) == sorted((str(r[0]), len(r[1] or "")) for r in awkward())
    repeated = [g for g in got if g[0] == 106]
    assert len(repeated) == 2 and all(0 <= x <= 1 for g in got for x in g[3:])
    twice = [(7, "abc def ghi", "en", "s", 0)] * 2
    assert plain(run(spark, twice)) == plain(brute(twice))


def test_order_and_distance_matter():
    rng = np.random.default_rng(1)
    text = "".join(chr(97 + x) for x in rng.integers(0, 26, 3000))
    near = lambda a, b: fp.likeness(fp.fingerprint(fp.code_points(a)), fp.fingerprint(fp.code_points(b)))
    swapped = text[1500:] + text[:1500]
    edits = [near(text, text[: 3000 - n] + "".join(chr(97 + x) for x in rng.integers(0, 26, n))) for n in (0, 30, 300, 1500, 3000)]
    assert edits[0] == 1 and edits == sorted(edits, reverse=True) and edits[-1] < 0.2
    assert near(text, swapped) < 0.95  # equal k-mers but for the seams, other order
    assert near("", "") == 1 and near("", text) == 0 and near("ab", "ab") == 1


def slow_whole(text, k=fp.K, bins=fp.BINS, pick=fp.PICK):
    """The signature with values of whole k-mer hashes, k-mer by k-mer."""
    hashes = fp.kmer_hashes(fp.code_points(text))
    seen, per_bin = {}, [[] for _ in range(bins)]
    for place, h in enumerate(hashes.tolist()):
        seen[h] = seen.get(h, 0) + 1
        value = int(mixed(np.array([h], U) + np.array([seen[h]], U) * STEP)[0])
        per_bin[value >> 58].append((value, place))
    out = []
    for entries in per_bin:
        t = np.zeros(1, U)
        for place in sorted(p for _, p in sorted(entries)[:pick]):
            t = mixed(t * STEP + hashes[place : place + 1])
        out.append(max(1, int(t[0]) >> 32) if entries else 0)
    return out


def test_equals_slow_version_of_whole_hashes():
    for r in awkward():
        assert fp.fingerprint(fp.code_points(r[1] or "")).tolist() == (slow_whole(r[1]) if r[1] else [0] * fp.BINS)


def test_likeness_across_powers_of_two():
    rng = np.random.default_rng(5)
    points = rng.integers(97, 123, 4200).astype(np.uint32)
    texts = lambda n: fp.fingerprint(points[: n + fp.K - 1])
    for a, b in ((2040, 2047), (2048, 2049), (2040, 2060), (4096, 4100)):
        assert fp.likeness(texts(a), texts(b)) > 0.95


def test_kmers_that_differ_in_low_bits_only(monkeypatch):
    """Occurrences are counted by whole hashes, also where the packed words mix two k-mers."""
    hashes = np.array([2**40 + x for x in (1, 2, 1, 2, 1, 3, 1, 2)], U)
    monkeypatch.setattr(fp, "kmer_hashes", lambda points, k=fp.K: hashes)
    assert fp.fingerprint(np.zeros(15, np.uint32)).tolist() == slow_whole("a" * 15)


def test_many_ranges_with_a_hot_id_and_without_ids(spark, monkeypatch):
    """A third of the rows without an id, a third with one: both are cut by hash, and the order is one order."""
    monkeypatch.setattr(fp, "RANGE_BYTES", 200)
    rng = np.random.default_rng(6)
    text = lambda i: f"text {i} " + " ".join(map(str, rng.integers(0, 99, 12)))
    ids = [None] * 100 + [2**40 + 1] * 100 + [2**40 + int(i) for i in rng.integers(-50, 50, 100)]
    rows = [(i, text(k), "en", "s", 0) for k, i in enumerate(ids)]
    docs = frame(spark, rows, extra=True)
    hashes = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = []
    for i, r in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        cut = len(r[1]) // 3
        want.append((r[0], len(r[1]), hashlib.sha256((r[1][: len(r[1]) - cut] + following[:cut]).encode()).hexdigest()))
    assert plain(g[:3] for g in run(spark, rows)) == plain(want)
    texts = docs.selectExpr("doc_id id", "text", "xxhash64(text) hash")
    place, n = fp._ranges(texts)
    sizes = [r["count"] for r in texts.withColumn("b", place).groupBy("b").count().collect()]
    assert n > 30 and max(sizes) < 40
