"""The three texts of an offer: category words, department words, department characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions import text
from shelfmark.operators.lemma import lemmatise


def _clean(offers: DataFrame, fields: dict, lemmas: DataFrame | None) -> DataFrame:
    cleaned = offers
    for stage in (text.PREPARED_FIELDS, {**text.FLAG_FIELDS, **fields}):
        cleaned = cleaned.withColumns({name: make() for name, make in stage.items()})
    return cleaned if lemmas is None else lemmatise(cleaned, list(fields), lemmas)


def category_text(offers: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """``row_id, category_text``."""
    return _clean(offers, text.CATEGORY_FIELDS, lemmas).select(
        "row_id", text.compose_category_text().alias("category_text")
    )


def department_word_text(offers: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """``row_id, department_word_text``."""
    return _clean(offers, text.DEPARTMENT_FIELDS, lemmas).select(
        "row_id", text.compose_department_word_text().alias("department_word_text")
    )


def department_char_text(offers: DataFrame) -> DataFrame:
    """``row_id, department_char_text``."""
    return offers.select("row_id", text.department_char_text().alias("department_char_text"))


def all_texts(offers: DataFrame, lemmas: DataFrame | None = None, keep=()) -> DataFrame:
    """All three texts in one pass over the offers, with the columns in ``keep``."""
    fields = {**text.CATEGORY_FIELDS, **text.DEPARTMENT_FIELDS}
    return _clean(offers, fields, lemmas).select(
        "row_id",
        *keep,
        text.compose_category_text().alias("category_text"),
        text.compose_department_word_text().alias("department_word_text"),
        text.department_char_text().alias("department_char_text"),
    )
