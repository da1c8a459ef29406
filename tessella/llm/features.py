"""Counts of a whole text that the quality rules and the classifier read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.text import let, total, whole, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Runs of symbols, ends of sentences, those with a lower-case letter behind them, and plain letters.
MARKS = r"[#*$%&|<>]+"
ENDS, BROKEN, LATIN, VOWELS = r"[.!?]([\x20\x09-\x0D]|\z)", r"[.!?][\x20\x09-\x0D]+\p{Ll}", "[A-Za-z]", "[AEIOUYaeiouy]"
#: What stands between letters, of any script and plain ones: most of a text is letters, so
#: taking the rest out and measuring is half the work of counting them.
NO_LETTERS, NOT_LATIN = r"\P{L}+", "[^A-Za-z]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_distinct", "n_marks", "n_ends", "n_broken", "n_latin", "n_vowels")


def _covered(grams: Column, k: int) -> Column:
    """Words inside the windows whose hash occurs twice, from the hashes in text order."""

    def places(s: Column) -> Column:
        again = F.filter(
            s,
            lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def spread(p: Column) -> Column:
        return total(F.transform(p, lambda x, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1) - x, F.lit(k)))))

    marked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(marked, places), spread)


def repeated_words(w: Column, k: int = WINDOW) -> Column:
    """Words of the array ``w`` that lie in a window of k words found twice or more in it.

    Windows are told apart by a 64-bit hash within one text only. A text whose windows
    all differ, the usual case, is settled by one distinct count.
    """

    def of(g: Column) -> Column:
        same = F.size(F.array_distinct(g)) == F.size(g)
        return F.when(same, F.lit(0).cast("long")).otherwise(_covered(g, k))

    grams = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) <= k, F.lit(0).cast("long")).otherwise(let(grams, of))


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of COUNTS in place of ``text``; a null text counts as empty.

    Columns of ``docs`` that have a count's name are replaced by it.
    """
    kept = [c for c in docs.columns if c != text and c not in COUNTS]
    t = F.col("__text")
    split = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        whole(F.col(text)).alias("__text"),
        words(F.col(text)).alias("__words"),
        F.filter(F.split(whole(F.col(text)), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    w, lines = F.col("__words"), F.col("__lines")
    return split.select(
        *[F.col(f"`{c}`") for c in kept],
        F.size(w).cast("long").alias("n_words"),
        total(F.transform(w, F.length)).alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        let(w, repeated_words).alias("n_repeat_words"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(t, NO_LETTERS, "")).cast("long").alias("n_letters"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        *[F.regexp_count(t, F.lit(p)).cast("long").alias(n) for n, p in (("n_marks", MARKS), ("n_ends", ENDS), ("n_broken", BROKEN))],
        F.length(F.regexp_replace(t, NOT_LATIN, "")).cast("long").alias("n_latin"),
        F.regexp_count(t, F.lit(VOWELS)).cast("long").alias("n_vowels"),
    )
