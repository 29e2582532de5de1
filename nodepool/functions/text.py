"""Text to terms, as Column expressions that stay in the JVM.

A query goes through the same steps as a document: lower case, runs of a-z and 0-9,
tokens too short or stopped left out, stems, each once in the order of first sight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_LENGTH = 3
STOPWORDS = frozenset(
    """about all also and any are
    because been before being between both but
    can could did does each else few for from
    had has have her here him his how into its just
    may might more most must not once only other our out over own
    same shall she should some such
    than that the their them then there these they this those through too
    under until very was were what when where which who whom why will with would you your""".split()
)


def tokens(text: Column) -> Column:
    """All runs of ASCII letters and digits in the lowered text; none for a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def _shorter(word: Column, by: int) -> Column:
    return F.left(word, F.length(word) - F.lit(by))


def undouble(word: Column) -> Column:
    """Drops the last letter where it repeats the one before and isn't a vowel."""
    last = F.right(word, F.lit(1))
    twice = (last == F.substring(word, -2, 1)) & (F.length(word) > 1) & ~last.isin(*"aeiou")
    return F.when(twice, _shorter(word, 1)).otherwise(word)


def stem(word: Column) -> Column:
    """One pass of the first suffix rule that applies."""
    n = F.length(word)
    return (
        F.when(n <= 3, word)
        .when(word.endswith("ies") & (n > 4), F.concat(_shorter(word, 3), F.lit("y")))
        .when(word.endswith("ing") & (n > 5), undouble(_shorter(word, 3)))
        .when(word.endswith("ed") & (n > 4), undouble(_shorter(word, 2)))
        .when(word.endswith("es") & (n > 4), _shorter(word, 2))
        .when(word.endswith("s") & ~word.endswith("ss"), _shorter(word, 1))
        .otherwise(word)
    )


def terms(
    text: Column, min_length: int = MIN_LENGTH, stopwords: Iterable[str] = STOPWORDS, stemmer: Callable[[Column], Column] | None = stem
) -> Column:
    """Distinct terms in the order of first sight. A stemmer that gives null or an empty
    string drops the term; None leaves words unstemmed."""
    stop = sorted(stopwords) if stopwords else []

    def kept(w: Column) -> Column:
        long = F.length(w) >= min_length
        return long & ~w.isin(stop) if stop else long  # looked up in a hash set

    words = F.filter(F.array_distinct(tokens(text)), kept)
    if stemmer is not None:
        words = F.filter(F.transform(words, stemmer), lambda w: w.isNotNull() & (w != ""))
    return F.array_distinct(words)
