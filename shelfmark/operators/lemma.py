"""Replace words by their dictionary form through a join with a ``word, lemma`` table; predict forms of unknown words."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.session import BROADCAST_LIMIT, broadcast_if_small, write_through

# Stands alone between two fields; cleaned fields hold letters, digits, hyphens and blanks only.
FIELD_END = "|"
#: Letters of the longest ending that is looked at.
LONGEST_ENDING = 5


def ending_rules(lemmas: DataFrame, longest: int = LONGEST_ENDING) -> DataFrame:
    """``ending, cut, added``: what a dictionary (word, lemma; one row a word) does most often to words with an ending.

    A word's own rule takes ``cut`` letters off its end, down to what it shares with its lemma, and adds others.
    It counts for each of its endings of up to ``longest`` letters that is shorter than the word and holds
    all that is cut.  Per ending the most frequent rule stays, then the one that cuts least, then by its letters.
    """
    shared = F.expr(
        "aggregate(slice(sequence(1, least(length(word), length(lemma)) + 1), 1, least(length(word), length(lemma))), 0,"
        " (n, i) -> if(n = i - 1 and substring(word, i, 1) = substring(lemma, i, 1), i, n))"
    )
    rules = lemmas.select("word", "lemma", shared.alias("shared")).select(
        "word", F.expr("length(word) - shared").alias("cut"), F.expr("substring(lemma, shared + 1)").alias("added")
    )
    # As many lengths as there are between what is cut and the limits; none where what is cut is longer.
    lengths = F.expr(f"filter(sequence(1, {longest}), n -> n >= cut and n < length(word))")
    counted = (
        rules.select("word", "cut", "added", F.explode(lengths).alias("n"))
        .groupBy(F.expr("right(word, n)").alias("ending"), "cut", "added")
        .agg(F.count(F.lit(1)).alias("words"))
    )
    best = counted.groupBy("ending").agg(F.min(F.struct((-F.col("words")).alias("few"), "cut", "added")).alias("best"))
    return best.select("ending", "best.cut", "best.added")


def predicted_forms(words: DataFrame, rules: DataFrame, longest: int = LONGEST_ENDING) -> DataFrame:
    """``word, lemma`` of the distinct ``words`` of which some ending has a rule: that of the longest such ending."""
    lengths = F.expr(f"filter(sequence(1, {longest}), n -> n < length(word))")
    met = (
        words.select("word", F.explode(lengths).alias("n"))
        .withColumn("ending", F.expr("right(word, n)"))
        .join(broadcast_if_small(rules), "ending")
        .groupBy("word")
        .agg(F.max_by(F.struct("cut", "added"), "n").alias("rule"))
    )
    return met.select("word", F.expr("concat(left(word, length(word) - rule.cut), rule.added)").alias("lemma"))


def lemmatise(
    rows: DataFrame, columns: list[str], lemmas: DataFrame, key: str = "row_id", limit: int = BROADCAST_LIMIT, predict: bool = True
) -> DataFrame:
    """Replace each word of the given cleaned text columns by its form.

    Words without an entry get the form their ending suggests (``predict``; see ``ending_rules``); words with a
    digit and words whose endings the dictionary doesn't have stay.

    Of the table only the forms that occur are used: the distinct words of the
    texts, combined on the map side, choose them, and they are written and
    measured.  All columns of a row travel as one word list, partitioned by
    ``key`` before the split, so with forms below ``limit`` bytes the texts are
    the only thing shuffled.  With more, the words meet the forms by word; a
    frequent word is dealt out again by adaptive skew handling, since the table
    has one row per word.
    """
    marker = f" {FIELD_END} "
    packed = rows.select(key, F.concat_ws(marker, *columns).alias("all"))
    # Written, so that joins meet the distinct words: unwritten, a semi-join would be pushed below ``distinct`` to every word.
    occurring = write_through(packed.select(F.explode(F.split("all", " ", -1)).alias("word")).distinct(), "lemma-occurring")
    dictionary = lemmas.select("word", "lemma").dropDuplicates(["word"])
    forms = dictionary.where("word != lemma").join(occurring, "word", "left_semi")
    if predict:
        candidates = occurring.where(F.expr(rf"word != '{FIELD_END}' and word != '' and not word rlike '[0-9]'"))
        unknown = write_through(candidates.join(dictionary, "word", "left_anti"), "lemma-unknown")
        if not unknown.isEmpty():
            rules = write_through(ending_rules(dictionary), "lemma-endings")
            forms = forms.unionByName(predicted_forms(unknown, rules).where("word != lemma"))
    forms = write_through(forms, "lemma-forms")
    words = packed.repartition(F.col(key)).select(key, F.posexplode(F.split("all", " ", -1)).alias("pos", "word"))
    replaced = words.join(broadcast_if_small(forms, limit), "word", "left")
    fields = (
        replaced.groupBy(key)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("pos", F.coalesce("lemma", "word").alias("form")))
            ).alias("forms")
        )
        .select(key, F.split(F.array_join("forms.form", " "), r" \| ", -1).alias("fields"))
        .select(key, *[F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    )
    return rows.drop(*columns).join(fields, key)
