"""One query per operator over the given tables; ``checks.oracles`` has the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import fixtures as fx
from shelfmark.functions import text
from shelfmark.operators import (
    departments, features, lemma, metrics, neighbours, prepare, prior, rules, texts,
)
from shelfmark.plans.evaluate import evaluate
from shelfmark.plans.predict import department_margins, fill_departments, predict_full
from shelfmark.plans.train import train_full
from shelfmark.session import new_table_path, write_through
from shelfmark.sources import model_store, offers as offer_files


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    flagged = write_through(prepare.stratified_flag(rows), "split")
    return (
        flagged.where(~F.col("held_out")).drop("held_out"),
        flagged.where(F.col("held_out")).drop("held_out"),
    )


# Scans, sources, sinks

def na_normalize(spark: SparkSession, sf: str) -> DataFrame:
    samples = ["", "NA", "n/a", "null", "None", "007", "nan", "<NA>", "x1", "#N/A", "-"]
    slot = F.col("row_id") % 12
    code = reduce(lambda acc, x: acc.when(slot == x[0], x[1]), enumerate(samples), F)
    injected = code.otherwise(F.col("vendor_code"))
    return fx.offers_part(spark, sf).select(
        "row_id", "title", text.null_if_missing(injected).alias("vendor_code")
    )


def tsv_roundtrip(spark, sf):
    path = new_table_path(spark, "offers-tsv")
    offer_files.write_offers(fx.offers_part(spark, sf), path)
    return offer_files.read_offers(spark, path)


def prediction_csv(spark, sf):
    offers = fx.offers_part(spark, sf)
    covered = rules.apply_rules(offers, rules.category_rules(offers))
    category = F.coalesce("rule_category", F.lit(-1).cast("long"))
    path = new_table_path(spark, "prediction-csv")
    offer_files.write_predictions(
        covered.select("row_id", category.alias("category_id"), (category % 3).alias("department_id")), path
    )
    rows = spark.read.schema("category_id long, department_id long").option("header", True).csv(path).select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    return offer_files.with_row_id(rows, ["file", "block"], "at").select("row_id", "category_id", "department_id")


# Projections

def _texts_of_tables(spark, sf, make):
    pages = fx.dealt(spark, sf, "pages", "page_id")
    docs = fx.dealt(spark, sf, "documents", "doc_id")
    return pages.select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), *make(F.col("html"))).unionByName(
        docs.select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), *make(F.col("text")))
    )


def clean_text(spark, sf):
    return _texts_of_tables(spark, sf, lambda c: [text.clean_text(c).alias("cleaned")])


def clean_desc(spark, sf):
    return _texts_of_tables(
        spark, sf,
        lambda c: [text.clean_description(c).alias("long_cut"), text.clean_description(c, 800).alias("short_cut")],
    )


def _cleaned_docs(spark, sf):
    """Cleaned texts and the dictionary of their words, both written: each is read several times."""
    docs = write_through(
        fx.dealt(spark, sf, "documents", "doc_id").select(
            F.col("doc_id").alias("row_id"), text.clean_text(F.col("text")).alias("lemmatised")
        ),
        "cleaned",
    )
    return docs, write_through(fx.lemma_table(docs.select(F.explode(F.split("lemmatised", " ", -1)))), "dictionary")


def lemma_join(spark, sf):
    docs, forms = _cleaned_docs(spark, sf)
    return lemma.lemmatise(docs, ["lemmatised"], forms)


def lemma_unknown(spark, sf):
    """As ``lemma_join``, with a part of the words left out of the dictionary: their endings decide."""
    docs, forms = _cleaned_docs(spark, sf)
    return lemma.lemmatise(docs, ["lemmatised"], forms.where(~fx.left_out(F.col("word"))))


def vendor_clean(spark, sf):
    return fx.offers_part(spark, sf).select("row_id", text.vendor_field(F.col("vendor_name")).alias("vendor"))


def category_leaf(spark, sf):
    return fx.offers_part(spark, sf).select("row_id", text.category_leaf(F.col("shop_category_name")).alias("leaf"))


def shop_category_clean(spark, sf):
    scn = F.col("shop_category_name")
    return fx.offers_part(spark, sf).select(
        "row_id",
        text.shop_category_field(scn).alias("category_field"),
        text.department_shop_category(scn).alias("department_field"),
    )


def title_head_tokens(spark, sf):
    words = text.head_words(F.col("title"))
    return fx.offers_docs(spark, sf).select("row_id", words.alias("words")).select(
        "row_id",
        text.first_word_token(F.col("words")).alias("first_word"),
        text.first_two_words_token(F.col("words")).alias("first_two"),
    )


def _prepared(spark, sf):
    return fx.offers_docs(spark, sf).withColumns({n: make() for n, make in text.PREPARED_FIELDS.items()})


def flag_tokens(spark, sf):
    lowered, words = F.col("title_lower"), F.col("title_words")
    seen = {"starts": F.col("title_starts"), "digits": F.col("title_digits")}
    return _prepared(spark, sf).select(
        "row_id",
        text.title_tokens(lowered, words, **seen).alias("tokens"),
        text.title_tokens(lowered, words, fx.LATIN_UNITS, fx.LATIN_TYPES, **seen).alias("latin_tokens"),
    )


def desc_tokens(spark, sf):
    d, lowered = F.col("description"), F.col("description_lower")
    return _prepared(spark, sf).select(
        "row_id",
        text.description_tokens(d, lowered).alias("tokens"),
        text.description_tokens(d, lowered, fx.LATIN_TOPICS).alias("latin_tokens"),
    )


def category_text(spark, sf):
    return texts.category_text(fx.offers_docs(spark, sf))


def department_word_text(spark, sf):
    return texts.department_word_text(fx.offers_docs(spark, sf))


def department_char_text(spark, sf):
    return texts.department_char_text(fx.offers_docs(spark, sf))


# Rules

def _rule(kind):
    return lambda spark, sf: rules.single_rule(fx.offers_part(spark, sf), kind)


def rule_scn_department(spark, sf):
    return rules.shop_category_departments(fx.offers_part(spark, sf))


def category_department(spark, sf):
    return rules.category_departments(fx.offers_part(spark, sf))


def modal_category(spark, sf):
    return rules.modal_category(fx.offers_part(spark, sf))


def apply_rules(spark, sf):
    train, held = _split(fx.offers_part(spark, sf))
    return rules.apply_rules(held, rules.category_rules(train))


def rule_coverage(spark, sf):
    offers = fx.offers_part(spark, sf)
    applied = rules.apply_rules(offers, rules.category_rules(offers))
    return rules.coverage(applied).withColumn("share", F.round("share", 6))


# Preparation

def dedup_first(spark, sf):
    return prepare.drop_duplicates(fx.offers_docs(spark, sf)).select("row_id", "title", "vendor_name", "category_id")


def stratified_split(spark, sf):
    flagged = prepare.stratified_flag(fx.offers_docs(spark, sf))
    return flagged.select("row_id", "department_id", "held_out")


def split_counts(spark, sf):
    return prepare.split_counts(prepare.stratified_flag(fx.offers_docs(spark, sf)))


def known_category_semi(spark, sf):
    train, held = _split(fx.offers_docs(spark, sf))
    return prepare.known_categories(held, train).select("row_id", "category_id")


def label_lists(spark, sf):
    return prepare.label_lists(fx.offers_docs(spark, sf))


# Features

def _docs(spark, sf, blocks):
    """The texts of ``blocks``; the others aren't written or even composed."""
    return texts.all_texts(fx.offers_docs(spark, sf)).select("row_id", *[b.text for b in blocks])


def word_ngrams(spark, sf):
    return features.corpus_counts(_docs(spark, sf, [features.CATEGORY]), [features.CATEGORY]).drop("block")


def char_wb_ngrams(spark, sf):
    return features.corpus_counts(_docs(spark, sf, [features.DEPARTMENT_CHARS]), [features.DEPARTMENT_CHARS]).drop("block")


def vocab_top_n(spark, sf):
    blocks = [features.CATEGORY]
    counts = features.candidate_counts(write_through(_docs(spark, sf, blocks), "texts"), blocks)
    return features.top_terms(counts, blocks).select("term", "df", "ctf")


def idf(spark, sf):
    return features.vocabulary(write_through(_docs(spark, sf, [features.DEPARTMENT_CHARS]), "texts"), [features.DEPARTMENT_CHARS]).select(
        "term", "df", F.round("idf", 6).alias("idf")
    )


def tfidf_l2(spark, sf):
    docs = write_through(_docs(spark, sf, [features.CATEGORY]), "texts")
    vocab = features.fit(docs, [features.CATEGORY])
    return features.tfidf(docs, vocab, [features.CATEGORY]).select(
        "row_id", "term", F.round("weight", 6).alias("weight")
    )


def feature_union(spark, sf):
    docs = write_through(_docs(spark, sf, features.DEPARTMENT), "texts")
    vocab = features.fit(docs, features.DEPARTMENT)
    return features.tfidf(docs, vocab, features.DEPARTMENT).groupBy("row_id", "block").agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.round(F.sum("weight"), 6).alias("total"),
        F.round(F.max("weight"), 6).alias("largest"),
    )


# Models and scoring

def softmax_temperature(spark, sf):
    p = departments.softmax(F.col("scores"), 0.5)
    return (
        fx.table(spark, sf, "embeddings")
        .select("vec_id", fx.quarter_scores(F.col("embedding")).alias("scores"))
        .select("vec_id", F.posexplode(p).alias("department_id", "p"))
        .select("vec_id", F.col("department_id").cast("long").alias("department_id"), F.round("p", 6).alias("p"))
    )


def weighted_knn_dense(spark, sf):
    train, held = _split(fx.embedding_rows(spark, sf))
    index = neighbours.build_index(train.select("row_id", "indices", "weights"), train)
    p = held.select(
        "row_id", F.posexplode(departments.softmax(fx.quarter_scores(F.col("embedding")))).alias("d", "p")
    ).select("row_id", F.col("d").cast("long").alias("department_id"), "p")
    found = neighbours.weighted_nearest(
        held.select("row_id"), held.select("row_id", "indices", "weights"), write_through(p, "p"), index
    ).withColumnRenamed("category_id", "predicted_category")
    return held.select("row_id", "category_id", "department_id").join(found, "row_id").withColumn(
        "predicted_department", F.col("predicted_category") % 4
    )


def _labelled_margins(held: DataFrame, train: DataFrame) -> DataFrame:
    """Probabilities from margins of +1 for the own department and -1 for the others."""
    ids = [r["department_id"] for r in train.select("department_id").distinct().orderBy("department_id").collect()]
    margins = F.array(*[F.when(F.col("department_id") == d, 1.0).otherwise(-1.0) for d in ids])
    each = F.arrays_zip(
        F.array(*[F.lit(d).cast("long") for d in ids]).alias("department_id"), departments.softmax(margins).alias("p")
    )
    return held.select("row_id", F.explode(each).alias("x")).select("row_id", "x.department_id", "x.p")


def _knn_text(spark, sf, beta):
    train, held = _split(fx.offers_docs(spark, sf))
    docs = write_through(texts.category_text(train), "train-texts")
    vocab = features.fit(docs, [features.CATEGORY])
    index = neighbours.build_index(features.vectors(docs, vocab, [features.CATEGORY]), train)
    vectors = write_through(features.vectors(texts.category_text(held), vocab, [features.CATEGORY]), "query-vectors")
    return neighbours.weighted_nearest(
        held.select("row_id", "shop_category_name"),
        vectors,
        write_through(_labelled_margins(held, train), "p"),
        index,
        prior.fit_prior(train, beta) if beta > 0 else None,
    )


def weighted_knn_text(spark, sf):
    return _knn_text(spark, sf, 0.0)


def knn_with_prior(spark, sf):
    return _knn_text(spark, sf, 0.3)


def scn_prior(spark, sf):
    return prior.prior_table(fx.offers_docs(spark, sf)).withColumn("p", F.round("p", 9))


def _department_features(spark, sf):
    offers = fx.offers_docs(spark, sf)
    docs = write_through(texts.all_texts(offers, keep=("department_id",)), "texts")
    vocab = features.fit(docs, features.DEPARTMENT)
    packed = features.vectors(docs, vocab, features.DEPARTMENT, "department_id")
    return departments.as_features(packed, features.n_features(features.DEPARTMENT), "department_id")


def department_svm(spark, sf):
    """Per offer: the predicted department, whether it has the largest probability, whether those add up to 1."""
    rows = _department_features(spark, sf)
    model = departments.train(rows)
    margins = write_through(model.margins(rows), "margins")
    p = model.probabilities(margins).groupBy("row_id").agg(
        F.max_by("department_id", "p").alias("largest"), (F.abs(F.sum("p") - 1) < 1e-9).alias("adds_up")
    )
    return p.join(model.predictions(margins), "row_id").select(
        "row_id", "department_id", (F.col("largest") == F.col("department_id")).alias("is_largest"), "adds_up"
    )


def department_fill(spark, sf):
    """Held-out offers with the category of a rule or none; margins in a fixed column give the missing departments."""
    train, held = _split(fx.offers_docs(spark, sf))
    known = rules.category_departments(train)
    categorised = rules.apply_rules(held, rules.category_rules(train)).select(
        "row_id", F.col("rule_category").alias("category_id")
    )
    model = departments.DepartmentModel([1, 2, 3, 4])

    def margins_of(rows):
        return rows.select("row_id", F.array(*[(F.col("row_id") * (2 * d + 1) % 17).cast("double") for d in range(4)]).alias("margins"))

    return fill_departments(categorised, margins_of, write_through(known, "known"), model)


def predict_hold_out(spark, sf):
    """Rules, neighbours and departments; the probabilities are those of ``weighted_knn_text``."""
    train, held = _split(fx.offers_docs(spark, sf))
    model = train_full(train)
    return predict_full(
        held.drop("category_id", "department_id"), model,
        probabilities=write_through(_labelled_margins(held, train), "p"),
    )


def predict_trained(spark, sf):
    """The same with the probabilities of the trained classifier."""
    train, held = _split(fx.offers_docs(spark, sf))
    return predict_full(held.drop("category_id", "department_id"), train_full(train))


def model_roundtrip(spark, sf):
    """How many rows a saved and loaded model predicts, and on how many it differs from the one in memory."""
    train, held = _split(fx.offers_docs(spark, sf))
    path = new_table_path(spark, "model")
    model = train_full(train, beta=0.3)
    model_store.save_model(model, path)
    unlabelled = held.drop("category_id", "department_id")
    before = predict_full(unlabelled, model)
    after = predict_full(unlabelled, model_store.load_model(spark, path))
    pair = before.alias("a").join(after.alias("b"), "row_id", "full")
    same = F.lit(True)
    for c in ("category_id", "department_id", "by_rule"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return pair.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~same).alias("n_different"))


def evaluate_hold_out(spark, sf):
    """Sizes of the run, and whether its score is what its predictions give."""
    found = evaluate(fx.offers_docs(spark, sf))
    rows = found.predictions
    again = metrics.combined_score(rows).select(F.col("score").alias("again"))
    hits = rows.agg(
        F.count(F.lit(1)).alias("n_scored"), F.avg((F.col("category_id") == F.col("predicted_category")).cast("double")).alias("hits")
    )
    f1 = metrics.weighted_f1(rows, "department_id", "predicted_department")
    score = found.score.select("score", "department_f1", "category_accuracy")
    both = F.abs(F.col("score") - (30 * F.col("weighted_f1") + 70 * F.col("hits"))) < 1e-9
    return (
        found.rule_coverage.select(F.col("n_rows").alias("n_train"), F.col("n_covered").alias("n_train_covered"))
        .join(hits).join(f1).join(score).join(again)
        .select("n_train", "n_train_covered", "n_scored", (both & (F.abs(F.col("score") - F.col("again")) < 1e-9)).alias("score_agrees"))
    )


# Evaluation

def _predicted(spark, sf):
    return write_through(weighted_knn_dense(spark, sf), "predicted")


def accuracy(spark, sf):
    rows = _predicted(spark, sf)
    return metrics.accuracy(rows, "category_id", "predicted_category").select(F.round("accuracy", 6).alias("accuracy"))


def weighted_f1(spark, sf):
    rows = _predicted(spark, sf)
    return metrics.weighted_f1(rows, "category_id", "predicted_category").select(
        F.round("weighted_f1", 6).alias("weighted_f1")
    )


def class_report(spark, sf):
    rows = _predicted(spark, sf)
    return metrics.class_report(rows, "category_id", "predicted_category").select(
        "label", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")], "support"
    )


def combined_score(spark, sf):
    scored = metrics.combined_score(_predicted(spark, sf))
    return scored.select(*[F.round(c, 6).alias(c) for c in scored.columns])


def queries() -> dict:
    return {
        "na_normalize": na_normalize,
        "tsv_roundtrip": tsv_roundtrip,
        "prediction_csv": prediction_csv,
        "clean_text": clean_text,
        "clean_desc": clean_desc,
        "lemma_join": lemma_join,
        "lemma_unknown": lemma_unknown,
        "vendor_clean": vendor_clean,
        "category_leaf": category_leaf,
        "shop_category_clean": shop_category_clean,
        "title_head_tokens": title_head_tokens,
        "flag_tokens": flag_tokens,
        "desc_tokens": desc_tokens,
        "category_text": category_text,
        "department_word_text": department_word_text,
        "department_char_text": department_char_text,
        "rule_vendor_code": _rule(rules.VENDOR_CODE),
        "rule_scn": _rule(rules.SHOP_CATEGORY),
        "rule_scn_department": rule_scn_department,
        "rule_title_vendor": _rule(rules.TITLE_VENDOR),
        "rule_title_scn": _rule(rules.TITLE_SHOP_CATEGORY),
        "category_department": category_department,
        "modal_category": modal_category,
        "apply_rules": apply_rules,
        "rule_coverage": rule_coverage,
        "dedup_first": dedup_first,
        "stratified_split": stratified_split,
        "split_counts": split_counts,
        "known_category_semi": known_category_semi,
        "label_lists": label_lists,
        "word_ngrams": word_ngrams,
        "char_wb_ngrams": char_wb_ngrams,
        "vocab_top_n": vocab_top_n,
        "idf": idf,
        "tfidf_l2": tfidf_l2,
        "feature_union": feature_union,
        "softmax_temperature": softmax_temperature,
        "weighted_knn_dense": weighted_knn_dense,
        "weighted_knn_text": weighted_knn_text,
        "scn_prior": scn_prior,
        "knn_with_prior": knn_with_prior,
        "department_svm": department_svm,
        "department_fill": department_fill,
        "predict_full": predict_hold_out,
        "predict_trained": predict_trained,
        "model_roundtrip": model_roundtrip,
        "evaluate": evaluate_hold_out,
        "accuracy": accuracy,
        "weighted_f1": weighted_f1,
        "class_report": class_report,
        "combined_score": combined_score,
    }
