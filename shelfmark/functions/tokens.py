"""Word and character n-grams as array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfmark.functions.text import SPACE

# A word is a run of two or more letters and numbers of any script and underscores.
BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN_WORDS, -1), lambda w: F.length(w) >= 2)


def word_ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams of a token array for ``low <= n <= high``, blank-joined, repeats kept.

    ``tokens`` should be a column of the input, not an expression: it is read
    once per n-gram.
    """
    def grams(n: int) -> Column:
        if n == 1:
            return tokens
        starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
        return F.when(
            F.size(tokens) >= n,
            F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " ")),
        ).otherwise(F.array().cast("array<string>"))

    return F.concat(*[grams(n) for n in range(low, high + 1)])


def padded_words(text: Column) -> Column:
    """Words between white space, each with a blank before and after it."""
    parts = F.filter(F.split(F.lower(text), rf"(?U){SPACE}+", -1), lambda w: w != "")
    return F.transform(parts, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))


def char_ngrams(padded: Column, low: int, high: int) -> Column:
    """Character n-grams inside the padded words, repeats kept."""
    none = F.array().cast("array<string>")

    def of_word(w: Column) -> Column:
        def grams(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.length(w) - (n - 1))
            # A word shorter than the smallest n gives itself once.
            short = F.array(w) if n == low else none
            return F.when(
                F.length(w) >= n, F.transform(starts, lambda i: F.substring(w, i, n))
            ).otherwise(short)

        return F.concat(*[grams(n) for n in range(low, high + 1)])

    return F.flatten(F.transform(padded, of_word))
