"""Tokenizing and token filters as Columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from termtide import params


def token_array(text: Column, pattern: str = params.TOKEN_RE) -> Column:
    """All tokens of ``text`` in order; NULL text gives NULL, which explodes to no row."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def with_numbers(words: Column) -> Column:
    """The distinct words of an array, sorted, as (word, n) with the number of times each is in it."""
    def ends(every: Column) -> Column:
        """Index of the last one of every run of equal words."""
        return F.filter(
            F.transform(every, lambda w, i: F.when(~w.eqNullSafe(F.get(every, i + 1)), i)),
            lambda i: i.isNotNull())

    def numbered(every: Column, last: Column) -> Column:
        return F.transform(last, lambda i, k: F.struct(
            F.get(every, i).alias("word"),
            (i - F.coalesce(F.get(last, k - 1), F.lit(-1))).cast("long").alias("n")))

    # Variables of a function, so that Spark makes each of the two arrays once.
    return F.get(F.transform(F.array(F.sort_array(words)), lambda every: F.get(F.transform(
        F.array(ends(every)), lambda last: numbered(every, last)), F.lit(0))), F.lit(0))


def longer_than(word: Column, n: int) -> Column:
    """Whether ``word`` has more than ``n`` UTF-16 units.

    ``length`` counts code points, which are never more than the units, so the
    encoding is only looked at for short words.
    """
    return (F.length(word) > n) | (F.octet_length(F.encode(word, "UTF-16BE")) > 2 * n)


def is_stop_word(word: Column, stop_words: Iterable[str] = params.STOP_WORDS) -> Column:
    return F.lower(word).isin(*stop_words)
