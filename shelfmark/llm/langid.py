"""Language identification by a byte convolutional network, trained in numpy on labelled text.

Windows of ``WINDOW`` bytes go through an embedding, filters of several widths (stride ``STRIDE``), the
maximum over the window, and a softmax.  Training takes a sample of bounded size: about ``PER_LANGUAGE``
labelled documents per language, drawn by hash, two excerpts each, for the ``MOST_LANGUAGES`` labels with the
most distinct texts (on a tie by name); the bounds are parameters and do not depend on the input.  Copies of
a text count once per language.  Every text is then cut into windows from its first byte to its last; its
probabilities are the means over its windows, weighted by the bytes in them.  A label beyond the bound is not
learned, so its texts get one of the others.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without labelled rows every
text is ``und``; a null label is not learned from; a null id counts as the empty id for the fold; rows that
repeat give equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import BROADCAST_BYTES, bounded_batches, in_fold, row_key, table
from shelfmark.llm.textbytes import groups
from shelfmark.session import broadcast_if_small, write_through

WINDOW, STRIDE = 128, 2
EMBED, WIDTHS, FILTERS = 8, (2, 3, 4, 6), 12
PER_LANGUAGE, EXCERPT, MOST_LANGUAGES = 1500, 300, 256
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.004, 7
PAD = 32
INNER = 256


def _columns(windows: np.ndarray, embedding: np.ndarray) -> np.ndarray:
    """(window, position, widest filter x EMBED) of byte windows."""
    vectors = embedding[windows]
    n, length, size = vectors.shape
    places = (length - max(WIDTHS)) // STRIDE + 1
    step = vectors.strides
    return np.lib.stride_tricks.as_strided(
        vectors, (n, places, max(WIDTHS) * size), (step[0], step[1] * STRIDE, step[2])
    )


def forward(model: dict, windows: np.ndarray) -> np.ndarray:
    """Probabilities of byte windows."""
    out = np.empty((len(windows), model["dense"].shape[1]), np.float32)
    for a in range(0, len(windows), INNER):
        columns = _columns(windows[a : a + INNER], model["embedding"])
        values = columns.reshape(-1, columns.shape[2]) @ model["filters"]
        top = np.maximum(values.reshape(len(columns), columns.shape[1], -1).max(axis=1) + model["shift"], 0)
        logits = top @ model["dense"] + model["bias"]
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        out[a : a + INNER] = odds / odds.sum(axis=1, keepdims=True)
    return out


def gradients(model: dict, windows: np.ndarray, labels: np.ndarray) -> dict:
    """Gradients of the mean cross entropy of byte windows with class numbers."""
    size, wide, n = model["shift"].size, model["filters"].shape[0], len(windows)
    columns = _columns(windows, model["embedding"])
    values = (columns.reshape(-1, wide) @ model["filters"]).reshape(n, columns.shape[1], size)
    best = values.argmax(axis=1)
    raw = np.take_along_axis(values, best[:, None, :], 1)[:, 0] + model["shift"]
    top = np.maximum(raw, 0)
    logits = top @ model["dense"] + model["bias"]
    odds = np.exp(logits - logits.max(axis=1, keepdims=True))
    error = odds / odds.sum(axis=1, keepdims=True)
    error[np.arange(n), labels] -= 1
    error /= n
    back = (error @ model["dense"].T) * (raw > 0)
    picked = columns[np.arange(n)[:, None], best]  # (window, filter, wide): what each maximum saw
    grads = {
        "dense": top.T @ error,
        "bias": error.sum(axis=0),
        "shift": back.sum(axis=0),
        "filters": np.einsum("nf,nfw->wf", back, picked) * filter_mask(),
    }
    to_bytes = (back[:, :, None] * model["filters"].T[None]).reshape(n, size, max(WIDTHS), EMBED)
    seen = best[:, :, None] * STRIDE + np.arange(max(WIDTHS))
    grads["embedding"] = np.zeros_like(model["embedding"])
    np.add.at(grads["embedding"], windows[np.arange(n)[:, None, None], seen], to_bytes)
    return grads


def filter_mask() -> np.ndarray:
    """Which inputs each filter sees: the first bytes of the widest one, as many as it is wide."""
    wide = max(WIDTHS) * EMBED
    return np.concatenate([np.repeat(np.arange(wide)[:, None] < w * EMBED, FILTERS, 1) for w in WIDTHS], axis=1)


def train(windows: np.ndarray, labels: np.ndarray, n_classes: int, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """The network for byte windows with class numbers, by Adam on the cross entropy."""
    draw = np.random.default_rng(seed)
    size, wide = len(WIDTHS) * FILTERS, max(WIDTHS) * EMBED
    mask = filter_mask()
    model = {
        "embedding": draw.normal(0, 0.5, (256, EMBED)),
        "filters": draw.normal(0, 1, (wide, size)) * mask / np.sqrt(mask.sum(axis=0)),
        "shift": np.zeros(size),
        "dense": draw.normal(0, 0.2, (size, n_classes)),
        "bias": np.zeros(n_classes),
    }
    model = {k: v.astype(np.float32) for k, v in model.items()}
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            grads = gradients(model, windows[rows], labels[rows])
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                model[k] = model[k].astype(np.float32)
    return model


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a group of texts, padded, with their text numbers and numbers of real bytes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(text)) - (np.cumsum(counts) - counts)[text]
    start = offsets[text] + nth * WINDOW
    real = np.minimum(offsets[text + 1] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    padded = np.append(data, np.uint8(PAD))
    return np.where(np.arange(WINDOW) < real[:, None], padded[np.minimum(at, len(data))], np.uint8(PAD)), text, real


def learn(docs: DataFrame, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> tuple[list[str], dict | None]:
    """The languages and the network, from labelled rows of ``docs`` (already without the held-out ones)."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    drawn = F.xxhash64("text")
    distinct = rows.select("lang", drawn.alias("drawn")).distinct()
    by_label = distinct.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    counts = {r["lang"]: r["n"] for r in by_label.collect()}
    languages = sorted(counts)
    if not languages:
        return [], None
    share = F.element_at(
        F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, 1.25 * per_language / counts[k]))]), F.col("lang")
    )
    sample = rows.withColumn("drawn", drawn).where(F.pmod("drawn", F.lit(1_000_003)) / 1_000_003 < share)
    excerpt = lambda salt: F.substring(
        "text", (F.pmod(F.xxhash64(F.lit(salt), "text"), F.greatest(F.length("text") - EXCERPT, F.lit(1))) + 1).cast("int"), F.lit(EXCERPT)
    )
    sample = sample.select("lang", "drawn", excerpt(1).alias("one"), excerpt(2).alias("two"))
    # Equal rows but for two texts of one hash, of which the smaller excerpts stay.
    collected = sample.groupBy("lang", "drawn").agg(F.min(F.struct("one", "two")).alias("cut")).select("lang", "drawn", "cut.*").collect()
    per_class: dict[str, list] = {k: [] for k in languages}
    for r in sorted(collected, key=lambda r: (r["lang"], r["drawn"])):
        if len(per_class[r["lang"]]) < per_language:
            per_class[r["lang"]].append(r)
    texts, labels = [], []
    for k, name in enumerate(languages):
        for r in per_class[name]:
            texts += [r["one"], r["two"]]
            labels += [k, k]
    if not texts:
        return [], None
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    windows, classes = [], []
    for a, _, data, offsets in groups(batch, "text"):
        cut, text, real = cut_windows(data, offsets)
        full = (real > WINDOW // 4) | (np.diff(offsets)[text] <= WINDOW)
        windows.append(cut[full])
        classes.append(np.array(labels)[text[full] + a])
    return languages, train(np.concatenate(windows), np.concatenate(classes), len(languages))


def predict(docs: DataFrame, languages: list[str], model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, row1.. as selected, lang_pred, score) of all texts; every other column of ``docs`` passes."""
    rows = bounded_batches(docs).withColumn(text_col, F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)))
    others = [c for c in docs.columns if c != text_col]
    sent = docs.sparkSession.sparkContext.broadcast((languages, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, model = sent.value
        for batch in batches:
            for a, b, data, offsets in groups(batch, text_col):
                chances = np.zeros((b - a, max(1, len(languages))))
                if model is not None and len(data):
                    windows, text, real = cut_windows(data, offsets)
                    weighted = forward(model, windows) * real[:, None]
                    bounds = np.searchsorted(text, np.arange(b - a + 1))
                    sums = np.concatenate([np.zeros((1, weighted.shape[1])), np.cumsum(weighted, axis=0, dtype=np.float64)])
                    chances = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(offsets), 1)[:, None]
                known = (np.diff(offsets) > 0) & (model is not None)
                best = chances.argmax(axis=1)
                named = [languages[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist())]
                score = np.where(known, np.clip(chances.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(a, b - a) for c in others] + [pa.array(named), pa.array(score)], [*others, "lang_pred", "score"]
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema)
    return rows.select(*others, text_col).mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op8_language_id(spark, sf_dir):
    """Every document's predicted language; a fifth of the ids is held out from learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", in_fold("doc_id", 0))
    languages, model = learn(docs.where(~F.col("held_out")), "text", "lang")
    return predict(docs.select("doc_id", "held_out", "text"), languages, model)


MIN_SCORE = 0.3


def stage(spark, docs, sf_dir):
    """Pipeline stage: documents without a letter, or in no language that was learned, go.

    The second is a best mean probability under ``MIN_SCORE``.  The decision is made where the text is read.
    """
    plain = docs.select("doc_id", "text", "lang")
    languages, model = learn(plain.where(~in_fold("doc_id", 0)), "text", "lang")
    keys = [k.alias(n) for k, n in zip(row_key("doc_id", "text"), ("lang row1", "lang row2"))]
    found = predict(plain.select(*keys, "text"), languages, model)
    gone = found.where((F.col("lang_pred") == "und") | (F.col("score") < MIN_SCORE)).select("lang row1", "lang row2").distinct()
    gone = broadcast_if_small(write_through(gone, "lang-gone"), BROADCAST_BYTES)
    keyed = docs.select("*", *keys)
    return keyed.join(gone, ["lang row1", "lang row2"], "left_anti").select(*docs.columns)
