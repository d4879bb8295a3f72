"""Column expressions for the text fields of an offer.

Every function takes columns and returns a column; nothing here shuffles or
leaves the JVM.  Dictionary forms (lemmas) need a join and live in
``shelfmark.operators.lemma``; the ``*_field`` helpers below give the cleaned
text on which that join works, and the ``compose_*`` functions put the final
texts together afterwards.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from shelfmark.functions import lexicon

# White space as the offers use it: Unicode white space and the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"
TAG = r"<[^>]+>"
HAN = r"[\x{4e00}-\x{9fff}]"
# Everything but a-z, а-я, 0-9 and the hyphen, and the same with the hyphen.  Written as
# the ranges in between: the JVM matches these about twice as fast as [^a-zа-я0-9\-].
NOT_KEPT = r"[\x00-,./:-`{-\x{42f}\x{450}-\x{10ffff}]"
NOT_LETTER_OR_DIGIT = r"[\x00-/:-`{-\x{42f}\x{450}-\x{10ffff}]"


def text_or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode white space (SQL trim takes blanks only)."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def has_han(c: Column) -> Column:
    return c.rlike(HAN)


def is_missing(c: Column) -> Column:
    return c.isNull() | c.isin(*lexicon.MISSING_STRINGS)


def null_if_missing(c: Column) -> Column:
    """Turn the strings that stand for "missing" in delimited files into NULL."""
    return F.when(~c.isin(*lexicon.MISSING_STRINGS), c)


def _keep_words(lowered: Column) -> Column:
    # Every kept character is a letter a-z or а-я, a digit or a hyphen; anything
    # else, white space included, ends a word, so one run is one blank.
    return F.trim(F.regexp_replace(lowered, NOT_KEPT + "+", " "))


def clean_text(c: Column) -> Column:
    """Lower-case, drop tags, keep a-z а-я 0-9 and hyphens, one blank between words."""
    return _keep_words(F.regexp_replace(F.lower(text_or_blank(c)), TAG, " "))


def clean_description(c: Column, max_len: int = 1500) -> Column:
    """Like ``clean_text``, but cut to ``max_len`` code points after tags are gone."""
    t = F.regexp_replace(text_or_blank(c), rf"(?iU)<br{SPACE}*/?>", "\n")
    t = F.regexp_replace(t, TAG, " ")
    t = F.regexp_replace(t, r"\\[rn]+", "\n")
    return _keep_words(F.lower(F.substring(t, 1, max_len)))


def vendor_field(c: Column) -> Column:
    """Cleaned vendor name; blank when it has Han characters or means "no brand"."""
    name = F.lower(strip(c))
    return (
        F.when(c.isNull() | has_han(name) | name.isin(*lexicon.NO_BRAND), "")
        .otherwise(clean_text(c))
    )


def category_leaf(c: Column) -> Column:
    """Last part of a ``" / "`` path; blank for single parts and parts with Han."""
    parts = F.split(c, " / ", -1)
    leaf = strip(F.element_at(parts, -1))
    return (
        F.when(c.isNull() | strip(c).isin("", "-") | (F.size(parts) < 2), "")
        .when(has_han(leaf), "")
        .otherwise(leaf)
    )


def shop_category_field(c: Column) -> Column:
    """Cleaned shop category for the category text."""
    return (
        F.when(c.isNull() | strip(c).isin("", "-") | has_han(c), "")
        .otherwise(clean_text(c))
    )


def department_shop_category(c: Column) -> Column:
    """Stripped shop category for the two department texts."""
    s = strip(text_or_blank(c))
    return F.when(s.isin("-", "nan", "") | has_han(s), "").otherwise(s)


def head_words(title: Column) -> Column:
    """All words of a title; a hyphen separates here."""
    parts = F.split(F.lower(text_or_blank(title)), NOT_LETTER_OR_DIGIT + "+", -1)
    return F.filter(parts, lambda w: w != "")


def first_word_token(words: Column) -> Column:
    return F.concat(F.lit("__fw_"), F.get(words, F.lit(0)), F.lit("__"))


def first_two_words_token(words: Column) -> Column:
    return F.concat(
        F.lit("__bg_"), F.get(words, F.lit(0)), F.lit("_"), F.get(words, F.lit(1)), F.lit("__")
    )


def occurs(lowered: Column, pattern: str) -> Column:
    """Whether ``pattern`` is found anywhere.

    Plain stems of an ungrouped alternation are looked up with ``contains``, which
    is many times faster on long texts than the same alternation as a pattern.
    """
    if "(" in pattern:
        return lowered.rlike("(?U)" + pattern)
    found = [
        lowered.contains(stem) if re.escape(stem).replace(r"\ ", " ").replace(r"\-", "-") == stem
        else lowered.rlike("(?U)" + stem)
        for stem in pattern.split("|")
    ]
    return reduce(lambda a, b: a | b, found)


def word_starts(lowered: Column) -> Column:
    """The first two letters of the words of a text, each once; a word is a run of letters here."""
    words = F.filter(F.split(lowered, r"[^\p{L}]+", -1), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 2)))


def has_digit(lowered: Column) -> Column:
    return lowered.rlike(r"(?U)\d")


def stem_starts(pattern: str) -> list[str] | None:
    """The two letters with which each alternative of ``\\b(...)`` begins, or None where that isn't plain to see."""
    group = re.fullmatch(r"\\b\(([^()]*)\)", pattern)
    stems = group[1].split("|") if group else []
    plain = [s for s in stems if re.match(r"[^\W\d_]{2}(?![?*{])", s)]
    return sorted({s[:2] for s in stems}) if stems and plain == stems else None


def flag_tokens(lowered: Column, flags, starts: Column | None = None, digits: Column | None = None) -> list[Column]:
    """One nullable column per ``(token, pattern)``: the token where the pattern occurs.

    With ``starts`` (``word_starts``) a pattern of stems is searched only where one of its stems can begin, with
    ``digits`` (``has_digit``) a pattern that begins with a digit only where there is one: one look at a text
    takes the place of most searches.
    """
    def found(pattern: str) -> Column:
        begin = stem_starts(pattern) if starts is not None else None
        if begin:
            return F.arrays_overlap(starts, F.array(*[F.lit(b) for b in begin])) & occurs(lowered, pattern)
        if digits is not None and pattern.startswith(r"\d"):
            return digits & occurs(lowered, pattern)
        return occurs(lowered, pattern)

    return [F.when(found(pattern), F.lit(token)) for token, pattern in flags]


def lowered_title(title: Column) -> Column:
    return F.lower(title)


def lowered_description(description: Column) -> Column:
    return F.lower(F.regexp_replace(description, TAG, " "))


def title_tokens(
    lowered: Column,
    words: Column,
    unit_flags=lexicon.UNIT_FLAGS,
    type_flags=lexicon.TYPE_FLAGS,
    starts: Column | None = None,
    digits: Column | None = None,
) -> Column:
    """First word, first two words, unit flags and type flags, blank-separated.

    ``lowered`` is ``lowered_title`` and ``words`` is ``head_words`` of the title, ``starts`` and ``digits`` are as in
    ``flag_tokens``; all are read many times, so give them as columns of the input.
    """
    found = [
        first_word_token(words),
        first_two_words_token(words),
        *flag_tokens(lowered, unit_flags, starts, digits),
        *flag_tokens(lowered, type_flags, starts, digits),
    ]
    return (
        F.when(lowered.isNull() | (lowered == ""), "")
        .otherwise(F.array_join(F.array(*found), " "))
    )


def description_tokens(
    description: Column, lowered: Column, flags=lexicon.DESCRIPTION_FLAGS
) -> Column:
    """Topic flags and the length bucket of a description (``lowered`` as a column)."""
    bucket = (
        F.when(F.length(lowered) < lexicon.SHORT_BELOW, lexicon.SHORT_DESCRIPTION)
        .when(F.length(lowered) > lexicon.LONG_ABOVE, lexicon.LONG_DESCRIPTION)
    )
    return (
        F.when(description.isNull() | (description == ""), lexicon.NO_DESCRIPTION)
        .otherwise(F.array_join(F.array(*flag_tokens(lowered, flags), bucket), " "))
    )


def without_reseller(vendor_code: Column) -> Column:
    return F.when(F.lower(vendor_code).rlike(lexicon.RESELLER_STEMS), "").otherwise(vendor_code)


def _nan_if_null(c: Column) -> Column:
    # The department texts carry the word "nan" for a missing field; it acts as a
    # missing indicator in the classifier.
    return F.coalesce(c, F.lit("nan"))


def rule_key(a: Column, b: Column) -> Column:
    """Composite rule key: both parts lower-cased and stripped, NULL as blank."""
    def norm(c):
        return strip(F.lower(text_or_blank(c)))

    return F.concat(norm(a), F.lit("|||"), norm(b))


# Shared by several expressions below, so computed once ahead of them.
PREPARED_FIELDS = {
    "title_starts": lambda: word_starts(lowered_title(F.col("title"))),
    "title_digits": lambda: has_digit(lowered_title(F.col("title"))),
    "title_lower": lambda: lowered_title(F.col("title")),
    "title_words": lambda: head_words(F.col("title")),
    "description_lower": lambda: lowered_description(F.col("description")),
}
FLAG_FIELDS = {
    "title_flags": lambda: title_tokens(
        F.col("title_lower"), F.col("title_words"), starts=F.col("title_starts"), digits=F.col("title_digits")
    ),
    "description_flags": lambda: description_tokens(
        F.col("description"), F.col("description_lower")
    ),
}

# Cleaned fields whose words are replaced by dictionary forms before composing.
CATEGORY_FIELDS = {
    "cat_title": lambda: clean_text(F.col("title")),
    "cat_scn": lambda: shop_category_field(F.col("shop_category_name")),
    "cat_leaf": lambda: clean_text(category_leaf(F.col("shop_category_name"))),
    "cat_vendor": lambda: vendor_field(F.col("vendor_name")),
    "cat_description": lambda: clean_description(F.col("description")),
}
DEPARTMENT_FIELDS = {
    "dep_scn": lambda: clean_text(department_shop_category(F.col("shop_category_name"))),
    "dep_leaf": lambda: clean_text(category_leaf(F.col("shop_category_name"))),
    "dep_title": lambda: clean_text(F.col("title")),
    "dep_vendor": lambda: clean_text(_nan_if_null(F.col("vendor_name"))),
    "dep_description": lambda: clean_description(_nan_if_null(F.col("description")), 800),
}


def _times(c: Column, n: int) -> Column:
    return F.repeat(F.concat(c, F.lit(" ")), n)


def compose_category_text() -> Column:
    """Weighted category text over ``CATEGORY_FIELDS`` and the flags."""
    return F.concat(
        _times(F.col("cat_title"), 4),
        _times(F.col("cat_scn"), 2),
        _times(F.col("cat_leaf"), 3),
        _times(F.col("title_flags"), 3),
        _times(F.col("cat_vendor"), 1),
        _times(F.col("cat_description"), 1),
        F.col("description_flags"),
    )


def compose_department_word_text() -> Column:
    """Word text for the department classifier over ``DEPARTMENT_FIELDS`` and the title flags."""
    return F.concat(
        _times(F.col("dep_scn"), 6),
        _times(F.col("dep_leaf"), 3),
        _times(F.col("dep_title"), 2),
        _times(F.col("title_flags"), 1),
        _times(F.col("dep_vendor"), 1),
        _times(F.col("dep_description"), 1),
        without_reseller(_nan_if_null(F.col("vendor_code"))),
    )


def department_char_text() -> Column:
    """Character text for the department classifier; no dictionary forms here."""
    def head(name, n):
        return F.substring(F.lower(_nan_if_null(F.col(name))), 1, n)

    return F.concat_ws(
        " ",
        F.lower(department_shop_category(F.col("shop_category_name"))),
        head("title", 300),
        head("vendor_name", 50),
        head("vendor_code", 30),
    )
