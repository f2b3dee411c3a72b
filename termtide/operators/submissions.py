"""Submission rules: which URLs are accepted, repeated or malformed.

A repeated URL is any later submission of the same string; the order is ``ts, event_id``, nulls
first. A malformed URL is malformed every time and never becomes a duplicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termtide.functions.urls import is_valid_url

# A time and an event id as one decimal, in their order. Aggregation by hash needs one value of
# fixed width; for a struct Spark sorts. Times are counted in microseconds from a time before the
# year 1, where the types begin; 0 stands for null.
_FIRST_TIME = -62_200_000_000_000_000
_DAY = 86_400_000_000
_IDS = 2**65
_LEAST_ID = -(2**63)


def _epoch(submissions: DataFrame) -> Column:
    """1970 as a time of the type of ``ts``, with or without time zone."""
    return F.lit("1970-01-01 00:00:00").cast(submissions.schema["ts"].dataType)


def _order_key(submissions: DataFrame) -> Column:
    micros = F.timestamp_diff("MICROSECOND", _epoch(submissions), F.col("ts"))
    time = F.coalesce(micros - F.lit(_FIRST_TIME), F.lit(0))
    number = F.coalesce(F.col("event_id").cast("decimal(20,0)")
                        - F.lit(str(_LEAST_ID - 1)).cast("decimal(20,0)"), F.lit(0))
    return (time.cast("decimal(18,0)") * F.lit(str(_IDS)).cast("decimal(20,0)")
            + number).cast("decimal(38,0)")


def _time_and_id(submissions: DataFrame) -> tuple[Column, Column]:
    """``ts`` and ``event_id`` from ``key``."""
    key = F.col("key")
    ids = F.lit(str(_IDS)).cast("decimal(20,0)")
    number = (key % ids).cast("decimal(20,0)")
    time = F.call_function("div", key, ids)
    event_id = F.when(number > 0, (number + F.lit(str(_LEAST_ID - 1)).cast("decimal(20,0)"))
                      .cast("long"))
    micros = time + F.lit(_FIRST_TIME)
    of_day = F.pmod(micros, F.lit(_DAY))
    interval = F.make_dt_interval(
        F.call_function("div", micros - of_day, F.lit(_DAY)).cast("int"), F.lit(0), F.lit(0),
        (of_day.cast("decimal(18,6)") / 1_000_000).cast("decimal(18,6)"))
    return F.when(time > 0, _epoch(submissions) + interval), event_id


def _first_keys(valid: DataFrame, seen: DataFrame | None) -> DataFrame:
    first = valid.groupBy("url").agg(F.min(_order_key(valid)).alias("key"))
    return first if seen is None else first.join(seen.select("url"), "url", "left_anti")


def accepted(submissions: DataFrame, seen: DataFrame | None = None, *,
             check_duplicates: bool = True) -> DataFrame:
    """The accepted submissions: the first of every valid URL that is not in ``seen``.

    A minimum per URL, not a window: partial aggregation leaves one row per URL and map
    task, so a URL submitted by a third of all events does not end up in one task. The
    anti-join against ``seen`` comes after it, on distinct URLs.
    """
    valid = submissions.where(is_valid_url(F.col("url")))
    if not check_duplicates:
        return valid.select("event_id", "ts", "url")
    ts, event_id = _time_and_id(submissions)
    return _first_keys(valid, seen).select(event_id.alias("event_id"), ts.alias("ts"), "url")


def outcomes(submissions: DataFrame, seen: DataFrame | None = None, *,
             check_duplicates: bool = True) -> DataFrame:
    """Label every submission ``accepted``, ``duplicate`` or ``malformed``.

    One row per submission, whatever repeats: of submissions equal in all columns, as a
    source that delivers twice makes them, one is accepted at most. Equal submissions are
    counted, and the accepted ones joined by URL and order, so the join has no hot key however
    often a URL repeats.
    """
    valid = is_valid_url(F.col("url"))
    if not check_duplicates:
        return submissions.select("event_id", "url", F.when(
            F.coalesce(valid, F.lit(False)), "accepted").otherwise("malformed").alias("outcome"))
    equal = submissions.groupBy("url", _order_key(submissions).alias("key")).agg(F.count("*").alias("equal"))
    first = _first_keys(submissions.where(valid), seen).select(
        "url", "key", F.lit(True).alias("is_first"))
    marked = equal.join(first, ["url", "key"], "left")
    label = (
        F.when(~F.coalesce(valid, F.lit(False)), "malformed")
        .when(F.col("is_first") & (F.col("i") == 1), "accepted")
        .otherwise("duplicate"))
    return marked.select(
        "url", "key", "is_first", F.explode(F.sequence(F.lit(1).cast("long"), "equal")).alias("i")
    ).select(_time_and_id(submissions)[1].alias("event_id"), "url", label.alias("outcome"))
