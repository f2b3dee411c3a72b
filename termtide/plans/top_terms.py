"""The whole calculation as a batch plan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from termtide import params
from termtide.operators.counts import stem_counts, stemmed
from termtide.operators.descriptions import submitted_descriptions
from termtide.operators.ranking import heavy_hitters_cms, top_heavy_hitters, top_k
from termtide.operators.submissions import accepted
from termtide.operators.words import prepared_counts


def rank_words(counts: DataFrame, k: int | None = params.TOP_K, *,
               pct: float = params.HEAVY_HITTERS_PCT, method: str = "exact",
               eps: float = params.EPS, delta: float = params.DELTA,
               seed: int = params.SEED) -> DataFrame:
    """Stem counted words and return ``word, score`` of the first ``k`` heavy hitters.

    ``k`` is 25 if it is None. ``method`` is ``exact``, or ``cms`` for the estimates of a
    count-min sketch.
    """
    if method == "exact":
        return top_heavy_hitters(stemmed(counts), k, pct)
    if method == "cms":
        hitters = heavy_hitters_cms(stem_counts(counts), pct, eps=eps, delta=delta, seed=seed)
        return top_k(hitters, k, by="est")
    raise ValueError(f"unknown method {method!r}")


def top_terms(texts: DataFrame, text: str = "text", k: int | None = params.TOP_K, *,
              stop_words: Iterable[str] | DataFrame = params.STOP_WORDS,
              min_len: int = params.MIN_LEN, fold_case: bool = False,
              **ranking) -> DataFrame:
    """Top stems of a table of texts."""
    counts = prepared_counts(
        texts, text, min_len=min_len, fold_case=fold_case, stop_words=stop_words)
    return rank_words(counts, k, **ranking)


def top_terms_of_submissions(submissions: DataFrame, pages: DataFrame,
                             k: int | None = params.TOP_K, *,
                             seen: DataFrame | None = None, check_duplicates: bool = True,
                             container: str = params.CONTAINER, **options) -> DataFrame:
    """Submissions -> accepted -> page -> description -> words -> stems -> top words."""
    urls = accepted(submissions, seen, check_duplicates=check_duplicates)
    found = submitted_descriptions(urls, pages, container=container)
    return top_terms(found, "description", k, **options)
