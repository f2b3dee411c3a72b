"""From texts to words: tokenize, length filter, stop words, in that order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termtide import params
from termtide.functions.text import is_stop_word, longer_than, token_array, with_numbers
from termtide.operators.counts import word_counts


def tokens(df: DataFrame, text: str = "text", keep: Iterable[str] = (), *,
           min_len: int = params.MIN_LEN, fold_case: bool = False,
           counted: bool = False) -> DataFrame:
    """One row per token longer than ``min_len``: the ``keep`` columns and ``word``.

    If ``counted``, one row per row of ``df`` and distinct token, and ``n``: how often it is in it.
    """
    found = token_array(F.lower(F.col(text)) if fold_case else F.col(text))
    each = F.inline(with_numbers(found)) if counted else F.explode(found).alias("word")
    return df.select(*keep, each).where(longer_than(F.col("word"), min_len))


def drop_stop_words(words: DataFrame,
                    stop_words: Iterable[str] | DataFrame = params.STOP_WORDS) -> DataFrame:
    """Drop stop words, in lower case, whatever the case of ``word``.

    A short list filters tokens where they are. A table with a ``word`` column, which may be too
    large to broadcast, is meant for counted words: there every word is one row of the join, while
    a frequent token would be a hot key.
    """
    if isinstance(stop_words, DataFrame):
        stop = stop_words.select(F.col("word").alias("stop_word")).distinct()
        return words.join(stop, F.lower(words["word"]) == stop["stop_word"], "left_anti")
    return words.where(~is_stop_word(F.col("word"), tuple(stop_words)))


def prepared_words(df: DataFrame, text: str = "text", keep: Iterable[str] = (), *,
                   min_len: int = params.MIN_LEN, fold_case: bool = False,
                   stop_words: Iterable[str] = params.STOP_WORDS,
                   counted: bool = False) -> DataFrame:
    """Tokens without stop words, not yet stemmed; ``counted`` as in ``tokens``."""
    found = tokens(df, text, keep, min_len=min_len, fold_case=fold_case, counted=counted)
    return drop_stop_words(found, stop_words)


def prepared_counts(df: DataFrame, text: str = "text", *,
                    min_len: int = params.MIN_LEN, fold_case: bool = False,
                    stop_words: Iterable[str] | DataFrame = params.STOP_WORDS) -> DataFrame:
    """``word, n`` of the tokens without stop words, which may be a table."""
    if isinstance(stop_words, DataFrame):
        found = tokens(df, text, min_len=min_len, fold_case=fold_case)
        return drop_stop_words(word_counts(found), stop_words)
    return word_counts(prepared_words(
        df, text, min_len=min_len, fold_case=fold_case, stop_words=stop_words))
