"""URL predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termtide import params


def is_valid_url(url: Column) -> Column:
    """Whether ``url`` parses as an absolute URL; NULL counts as malformed."""
    return F.coalesce(url.rlike(params.URL_RE), F.lit(False))
