import datetime as dt

import pytest
from pyspark.sql import functions as F

from termtide import schemas
from termtide.functions.urls import is_valid_url
from termtide.operators.submissions import accepted, outcomes
from termtide.sources.submissions import kafka_options, parse_messages, read_seen, record_seen

START = dt.datetime(2026, 1, 1)


def submissions(spark, *urls):
    return spark.createDataFrame(
        [(i, START + dt.timedelta(seconds=i), u) for i, u in enumerate(urls)], schemas.SUBMISSIONS)


def test_outcomes(spark, rows):
    df = submissions(spark, "http://a/1", "bad", "http://a/1", "bad", "http://A/1", None)
    assert rows(outcomes(df), "event_id", "outcome") == [
        (0, "accepted"), (1, "malformed"), (2, "duplicate"), (3, "malformed"), (4, "accepted"),
        (5, "malformed")]


def test_order_is_time_then_event(spark, rows):
    df = spark.createDataFrame(
        [(9, START, "http://a"), (3, START, "http://a"),
         (1, START + dt.timedelta(seconds=1), "http://a")], schemas.SUBMISSIONS)
    assert rows(accepted(df), "event_id") == [(3,)]


def test_check_switched_off_accepts_every_valid_url(spark, rows):
    df = submissions(spark, "http://a", "http://a", "bad")
    assert rows(outcomes(df, check_duplicates=False), "outcome") == [
        ("accepted",), ("accepted",), ("malformed",)]
    assert accepted(df, check_duplicates=False).count() == 2


def test_seen_urls_are_duplicates(spark, rows, tmp_path):
    path = str(tmp_path / "seen")
    assert read_seen(spark, path).count() == 0
    record_seen(accepted(submissions(spark, "http://a", "bad")), path)
    record_seen(accepted(submissions(spark, "http://a")), path)  # a retry
    later = submissions(spark, "http://a", "http://b", "bad", "http://b")
    assert rows(outcomes(later, read_seen(spark, path)), "event_id", "outcome") == [
        (0, "duplicate"), (1, "accepted"), (2, "malformed"), (3, "duplicate")]
    assert rows(accepted(later, read_seen(spark, path)), "url") == [("http://b",)]


@pytest.mark.parametrize("url, valid", [
    ("http://a.example/x?y#z", True), ("HTTPS://a", True), ("ftp://u:p@h:21/f", True),
    ("file:///etc/hosts", True), ("http://[::1]:8080/", True), ("http://a:/", True),
    ("http://a:port/", False), ("a.example/x", False), ("//a.example", False),
    ("gopher://a", False), ("http//a", False), ("", False), (None, False),
])
def test_url_validity(spark, url, valid):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(is_valid_url(F.col("url"))).first()[0] is valid


def test_hot_url_is_reduced_before_the_shuffle(spark):
    df = spark.range(20000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"),
        F.when(F.col("id") % 3 == 0, "http://hot").otherwise(
            F.concat(F.lit("http://x/"), F.col("id"))).alias("url"))
    labels = outcomes(df)
    plan = labels._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan
    # The join back is on the unique event, not on the hot URL.
    assert "hashpartitioning(url" in plan and "[url#" not in plan.split("SortMergeJoin")[-1].split("\n")[0]
    counts = {r.outcome: r["count"] for r in labels.groupBy("outcome").count().collect()}
    assert counts == {"accepted": 13334, "duplicate": 6666}


def test_messages_that_are_not_submissions(spark, rows):
    raw = spark.createDataFrame(
        [('{"event_id": 1, "ts": "2026-01-01T00:00:00Z", "url": "http://a"}',), ("hello",)],
        "value string")
    assert rows(outcomes(parse_messages(raw).fillna({"event_id": -1})), "event_id", "outcome") == [
        (-1, "malformed"), (1, "accepted")]


def test_one_row_per_submission_whatever_repeats(spark, rows):
    again = START + dt.timedelta(seconds=9)
    df = spark.createDataFrame([
        (1, START, "http://a"), (1, START, "http://b"), (2, again, "http://a"), (2, again, "http://a"),
        (None, START, "http://c"), (3, None, "http://d"), (4, START, "http://d"),
        (5, START, "http://e"), (5, START, "http://e"), (None, None, None)], schemas.SUBMISSIONS)
    assert sorted((str(r.event_id), str(r.url), r.outcome) for r in outcomes(df).collect()) == [
        ("1", "http://a", "accepted"), ("1", "http://b", "accepted"),
        ("2", "http://a", "duplicate"), ("2", "http://a", "duplicate"),
        ("3", "http://d", "accepted"), ("4", "http://d", "duplicate"),
        ("5", "http://e", "accepted"), ("5", "http://e", "duplicate"),
        ("None", "None", "malformed"), ("None", "http://c", "accepted")]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_first_submission_keeps_its_time_and_id(spark, kind):
    times = ["0001-01-01 00:00:00", "1969-12-31 23:59:59.999999", "9999-12-31 23:59:59.999999"]
    ids = [-(2**63), 0, 2**63 - 1]
    df = spark.createDataFrame(
        [(i, t, f"http://{k}") for k, (i, t) in enumerate(zip(ids, times, strict=True))],
        "event_id long, ts string, url string").withColumn("ts", F.col("ts").cast(kind))
    columns = ["event_id", F.col("ts").cast("string"), "url"]
    found = accepted(df)
    assert found.schema["ts"].dataType == df.schema["ts"].dataType
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(
        map(tuple, df.select(*columns).collect()))


def test_a_topic_is_read_from_its_beginning():
    assert kafka_options({"subscribe": "t"}) == {"subscribe": "t", "startingOffsets": "earliest"}
    assert kafka_options({"startingOffsets": "latest"}) == {"startingOffsets": "latest"}
