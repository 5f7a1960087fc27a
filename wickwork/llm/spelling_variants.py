"""Spelling variants: words one edit apart, grouped under their frequent forms, by permuterm rotations.

A word with a terminator behind it is turned so that any place of it comes last. Turned to an edited
character, the word ``x c y`` reads ``y$x c``: all words that have another character there, or one
more, share the prefix ``y$x`` of their rotation, and the word without it *is* that prefix. So
replaced, inserted and deleted characters are one look-up: sort all rotations, those up to the edited
character beside the whole ones, and scan each stretch of one prefix.

A scan hands on one row for each member of a group, with the number of its neighbours there and the
most frequent of them, not the pairs. Each pair of neighbours meets in one group exactly: a replaced
character has one place, and of equal characters side by side only the first counts as inserted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.tables import written
from wickwork.session import use_utc

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a word, occurrences of a word, and how many times as frequent its form must be.
CHARACTERS, OCCURRENCES, RATIO = 5, 3, 2
#: Between the end of a word and its beginning; a word that holds it has no neighbours.
TERMINATOR = "\x00"


def letter_runs(text: Column, least: int = CHARACTERS) -> Column:
    """The maximal runs of Latin letters with ``least`` or more of them, A to Z in lower case. A null text has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lower, F.lit(f"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))


def without(word: Column, place: Column) -> Column:
    """The word without its character at ``place``, from 0."""
    place = place.cast("int")
    return F.concat(F.substr(word, F.lit(1), place), F.substr(word, place + 2))


def word_counts(words: DataFrame, least: int = CHARACTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """``word``, ``n`` of the first column's words that are long and frequent enough; nulls are none.

    Words are added up in the tasks first, so a hot word costs one row per task.
    """
    words = words.select(F.col(f"`{words.columns[0]}`").alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences)


def rotations(words: DataFrame) -> DataFrame:
    """``prefix``, ``word``, ``n``, ``edited`` (1: the rotation goes on with an edited character), ``inserted``
    (whether that character can be the one too many; the first of equal ones)."""
    plain = words.where(~F.contains("word", F.lit(TERMINATOR)))
    turned = plain.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    head, tail, rest = (
        F.substr("word", F.lit(1), F.col("at")),
        F.substr("word", F.col("at") + 1),
        F.substr("word", F.col("at") + 2),
    )
    here = F.substr("word", F.col("at") + 1, F.lit(1))
    before = F.substr("word", F.col("at"), F.lit(1))
    whole = F.struct(F.concat(tail, F.lit(TERMINATOR), head).alias("prefix"), F.lit(0).alias("edited"), F.lit(False).alias("inserted"))
    skipping = F.struct(
        F.concat(rest, F.lit(TERMINATOR), head).alias("prefix"),
        F.lit(1).alias("edited"),
        ((F.col("at") == 0) | (here != before)).alias("inserted"),
    )
    both = F.when(F.col("at") < F.length("word"), F.array(whole, skipping)).otherwise(F.array(whole))
    return turned.select("word", "n", F.inline(both))


def scanned(turned: DataFrame) -> DataFrame:
    """``word``, ``near`` and ``best`` (``n``, negated, and the word) for each member of each group with neighbours.

    A group has the words that differ in one place, the most frequent first, and at last the one word
    without it. It is read in order: nothing is gathered, however many letters an alphabet has.
    """
    group = Window.partitionBy("prefix")
    order = group.orderBy(F.desc("edited"), F.desc("n"), "word")
    all_of = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct((-F.col("n")).alias("n"), F.col("word").alias("word"))
    edited = F.col("edited") == 1
    seen = turned.select(
        "word",
        "edited",
        "inserted",
        F.row_number().over(order).alias("place"),
        F.sum("edited").over(all_of).alias("others"),
        F.sum(F.col("inserted").cast("int")).over(all_of).alias("longer"),
        F.first(F.when(edited, member)).over(all_of).alias("top"),
        F.nth_value(F.when(edited, member), 2).over(all_of).alias("next"),
        F.min(F.when(F.col("inserted"), member)).over(all_of).alias("top_longer"),
        F.max(F.when(~edited, member)).over(all_of).alias("shorter"),
    )
    other = F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top"))
    shorter = F.when(F.col("inserted"), F.col("shorter"))
    return seen.select(
        "word",
        F.when(edited, F.col("others") - 1 + shorter.isNotNull().cast("int")).otherwise(F.col("longer")).alias("near"),
        F.when(edited, F.least(other, shorter)).otherwise(F.col("top_longer")).alias("best"),
    ).where("near > 0")


def neighbours(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``n``, ``n_near`` (words one edit away), ``form`` (the most frequent of them, if ``ratio``
    times as frequent; ties to the first in code-point order) and ``form_n``."""
    near = scanned(rotations(words)).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    best = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best"))
    joined = words.join(near, "word", "left")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), best["word"].alias("form"), (-best["n"]).alias("form_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` of every word with a form: the last of the chain of forms.

    Each round doubles the steps a word has gone. A form is ``RATIO`` times as frequent, so chains are
    no longer than the logarithm of the largest count. Each round is a written table.
    """
    steps = written(forms.where("form is not null").select("word", F.col("form").alias("root")), "variant-steps")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        gone = steps.join(further, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        gone = written(gone, "variant-steps")
        if gone.where("moved").isEmpty():
            return gone.select("word", "root")
        steps = gone.select("word", "root")


def spelling_variants(words: DataFrame, least: int = CHARACTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for the words of the first column, a row per occurrence.

    Words of at least ``least`` code points and ``occurrences`` occurrences are compared as they are.
    Two are near if one inserted, deleted or replaced code point makes one of the other. ``form`` is
    the near word of largest ``n`` (ties: the first in code-point order) if that is ``ratio`` times the
    word's or more, else null; ``root`` is reached by following forms, and is the word itself without
    one. Nulls and empty words are none; repeated rows are occurrences; an empty table gives an empty
    one; other columns are not looked at, whatever they are called. A word that holds U+0000 has no
    near words.
    """
    use_utc(words.sparkSession)
    counts = written(word_counts(words, least, occurrences), "variant-counts")
    forms = written(neighbours(counts, ratio), "variant-forms")
    return forms.join(roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
