import numpy as np

from shelfmark.llm import langid
from shelfmark.llm.common import in_fold
from tests.llm.helpers import awkward, frame

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = langid.op8_language_id(spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and len(held) > 100
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward_rows(spark):
    docs = frame(spark, awkward(), extra=True)
    languages, model = langid.learn(docs.where(~in_fold("doc_id", 0)), "text", "lang")
    rows = langid.predict(docs, languages, model).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        assert r["lang_pred"] in (*languages, "und")
        if r["doc_id"] in (103, 104, 105, 111):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert len({(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] == 106}) == 1


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "text", None, "s", 0), (2, None, "en", "s", 0)])
    assert langid.learn(docs, "text", "lang") == ([], None)
    assert [r["lang_pred"] for r in langid.predict(docs, [], None).collect()] == ["und", "und"]
    assert langid.predict(frame(spark, []), [], None).count() == 0


def test_gradients_lower_the_loss():
    rng = np.random.default_rng(0)
    windows = rng.integers(97, 110, (400, langid.WINDOW)).astype(np.uint8)
    labels = rng.integers(0, 2, 400)
    windows[labels == 1, 40:44] = np.frombuffer(b"qzqz", np.uint8)
    model = langid.train(windows, labels, 2, epochs=8)
    assert (langid.forward(model, windows).argmax(axis=1) == labels).mean() > 0.97


def test_windows_cover_whole_texts():
    texts = [b"", b"a" * 5, b"b" * langid.WINDOW, b"c" * (3 * langid.WINDOW + 1)]
    offsets = np.cumsum([0, *map(len, texts)])
    windows, text, real = langid.cut_windows(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for i, t in enumerate(texts):
        assert b"".join(w[:n].tobytes() for w, n in zip(windows[text == i], real[text == i])) == t


def test_stage(spark):
    docs = frame(spark, awkward(), extra=True)
    left = langid.stage(spark, docs, "")
    kept = [r["doc_id"] for r in left.collect()]
    assert left.columns == docs.columns
    assert not {103, 104, 105, 111} & set(kept) and set(range(25)) <= set(kept) and kept.count(106) == 2


def test_copies_count_once(spark, monkeypatch):
    """A text with thousands of copies is one text of the sample, and no other row gives way to it."""
    rows = [(i, f"{'the of and' if i % 2 else 'der die das'} word{i} {i * 7919}", "en" if i % 2 else "de", "s", 0) for i in range(60)]
    copies = [(1000 + i, "one text again and again", "en", "s", 0) for i in range(4000)]
    seen = []
    monkeypatch.setattr(langid, "train", lambda windows, classes, n: seen.append((windows, classes)))
    langid.learn(frame(spark, rows), "text", "lang", per_language=40)
    langid.learn(frame(spark, rows + copies[:1]), "text", "lang", per_language=40)
    langid.learn(frame(spark, rows + copies), "text", "lang", per_language=40)
    assert [len(c) for _, c in seen] == [2 * 60, 2 * 61, 2 * 61]
    assert (seen[1][0] == seen[2][0]).all() and (seen[1][1] == seen[2][1]).all()


def small_model(rng, classes=3):
    size, wide = len(langid.WIDTHS) * langid.FILTERS, max(langid.WIDTHS) * langid.EMBED
    return {
        "embedding": rng.normal(0, 1, (256, langid.EMBED)), "filters": rng.normal(0, 1, (wide, size)) * langid.filter_mask(),
        "shift": rng.normal(0, 1, size), "dense": rng.normal(0, 1, (size, classes)), "bias": rng.normal(0, 1, classes),
    }


def slow_forward(model, windows):
    """The network filter by filter and place by place."""
    out = []
    for window in windows:
        top = []
        for w, width in enumerate(langid.WIDTHS):
            for f in range(langid.FILTERS):
                column = model["filters"][:, w * langid.FILTERS + f].reshape(max(langid.WIDTHS), langid.EMBED)
                sums = []
                for place in range(0, len(window) - max(langid.WIDTHS) + 1, langid.STRIDE):
                    sums.append(sum(float(model["embedding"][window[place + j]] @ column[j]) for j in range(width)))
                top.append(max(0.0, max(sums) + model["shift"][w * langid.FILTERS + f]))
        logits = np.array(top) @ model["dense"] + model["bias"]
        odds = np.exp(logits - logits.max())
        out.append(odds / odds.sum())
    return np.array(out)


def test_forward_equals_a_slow_convolution():
    rng = np.random.default_rng(2)
    model, windows = small_model(rng), rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    assert np.allclose(langid.forward(model, windows), slow_forward(model, windows), atol=1e-6)


def test_gradients_equal_numeric_ones():
    rng = np.random.default_rng(4)
    model, windows, labels = small_model(rng), rng.integers(0, 20, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    loss = lambda: -np.log(slow_forward(model, windows)[np.arange(6), labels]).mean()
    grads = langid.gradients(model, windows, labels)
    for name, gradient in grads.items():
        flat, step = model[name].reshape(-1), 1e-6
        places = np.flatnonzero(gradient.reshape(-1))
        for at in rng.choice(places, min(6, len(places)), replace=False):
            before = flat[at]
            flat[at] = before + step
            up = loss()
            flat[at] = before - step
            down = loss()
            flat[at] = before
            assert abs((up - down) / (2 * step) - gradient.reshape(-1)[at]) < 1e-5, (name, at)


def test_labels_beyond_the_bound_are_not_learned(spark):
    rows = [(10 * k + i, f"text {k} {i}", f"l{k}", "s", 0) for k in range(6) for i in range(6 - k)]
    rows += [(100 + i, f"other {i}", "l5", "s", 0) for i in range(1)]
    languages, _ = langid.learn(frame(spark, rows), "text", "lang", most_languages=3)
    assert languages == ["l0", "l1", "l2"]
