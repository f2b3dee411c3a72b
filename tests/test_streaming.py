import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from termtide import schemas
from termtide.operators.descriptions import descriptions
from termtide.plans.top_terms import top_terms_of_submissions
from termtide.sources.pages import save_descriptions
from termtide.sources.snapshots import read_snapshot, read_top_words
from termtide.sources.submissions import stream_submissions
from termtide.streaming import job

NOW = {"availableNow": True}
START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


class Feed:
    """A folder of submission files, one file per call of ``add``."""

    def __init__(self, folder):
        self.folder, self.files, self.events = folder, 0, 0
        folder.mkdir()

    def add(self, *urls):
        lines = []
        for url in urls:
            self.events += 1
            ts = START + dt.timedelta(seconds=self.events)
            lines.append(json.dumps({"event_id": self.events, "ts": ts.isoformat(), "url": url}))
        self.files += 1
        (self.folder / f"{self.files:03}.json").write_text("\n".join(lines))


def page(text):
    return f'<div id="productDescription"><p>{text}</p></div>'


@pytest.fixture
def setting(spark, tmp_path):
    session = job.streaming_session(spark, state_partitions=2)
    pages = session.createDataFrame([
        (1, "http://u1", page("Motoring motors")), (2, "http://u2", page("the speaker motor")),
        (3, "http://u3", page("speakers and bars")), (4, "http://none", "<p>x</p>")], schemas.PAGES)
    return session, pages, Feed(tmp_path / "in"), tmp_path


def run(session, pages, feed, tmp_path, publish=None, found=None, **options):
    source = stream_submissions(session, str(feed.folder), "json", maxFilesPerTrigger="1")
    found = descriptions(pages) if found is None else found
    counts = job.running_counts(source, found, **options)
    publish = publish or job.publish_snapshot(str(tmp_path / "out"))
    query = job.start(counts, publish, str(tmp_path / "checkpoint"), trigger=NOW)
    query.awaitTermination()
    return query


def test_stream_equals_batch_and_survives_a_restart(setting, rows):
    session, pages, feed, tmp_path = setting
    feed.add("http://u1", "bad", "http://u2", "http://u1")
    feed.add("http://u2", "http://none", "http://gone")
    query = run(session, pages, feed, tmp_path)
    assert len(query.recentProgress) >= 2
    assert rows(read_snapshot(session, str(tmp_path / "out"))) == [
        ("Motor", 1), ("motor", 2), ("speaker", 1)]

    # The second run knows the first one's URLs and counts.
    feed.add("http://u2", "http://u3")
    run(session, pages, feed, tmp_path)
    streamed = rows(read_top_words(session, str(tmp_path / "out")))
    assert streamed == [("Motor", 1.0), ("bar", 1.0), ("motor", 2.0), ("speaker", 2.0)]
    batch = session.read.schema(schemas.SUBMISSIONS).json(str(feed.folder))
    assert streamed == rows(top_terms_of_submissions(batch, pages))


def run_top(session, pages, feed, tmp_path, publish=None, **options):
    source = stream_submissions(session, str(feed.folder), "json", maxFilesPerTrigger="1")
    stems = job.running_stems(source, descriptions(pages), **options)
    publish = publish or job.publish_top(str(tmp_path / "out"))
    job.start(stems, publish, str(tmp_path / "checkpoint"), trigger=NOW, mode="update"
              ).awaitTermination()


def test_update_mode_equals_batch_and_hands_over_changes_only(setting, rows):
    session, pages, feed, tmp_path = setting
    handed = []
    publish_top = job.publish_top(str(tmp_path / "out"))

    def publish(changed, batch_id):
        handed.append(rows(changed.select(F.coalesce("word", F.lit("*")), "n")))
        publish_top(changed, batch_id)
        publish_top(changed, batch_id)  # a batch that is repeated

    feed.add("http://u1", "bad", "http://u2", "http://u1")
    feed.add("http://u2", "http://none", "http://gone")
    run_top(session, pages, feed, tmp_path, publish)
    feed.add("http://u2", "http://u3")
    run_top(session, pages, feed, tmp_path, publish)
    assert [h for h in handed if h][-1] == [("*", 6), ("bar", 1), ("speaker", 2)]
    batch = session.read.schema(schemas.SUBMISSIONS).json(str(feed.folder))
    streamed = rows(read_top_words(session, str(tmp_path / "out")))
    assert streamed == rows(top_terms_of_submissions(batch, pages))


def test_first_words_come_from_the_old_list_and_the_changes(spark, tmp_path, rows):
    publish = job.publish_top(str(tmp_path), k=2, pct=0.0)
    batches = [
        [("a", 5), ("b", 4), ("c", 3), (None, 12)], [("c", 6), (None, 15)],
        [("b", 9), ("d", 1), (None, 21)], []]
    for i, changed in enumerate(batches):
        for _ in range(2):
            publish(spark.createDataFrame(changed, schemas.WORD_COUNTS), i)
    assert rows(read_top_words(spark, str(tmp_path))) == [("b", 9.0), ("c", 6.0)]


def test_late_submissions_are_counted_as_dropped(setting, rows):
    session, pages, feed, tmp_path = setting
    feed.add("http://u1")
    feed.events += 24 * 3600
    feed.add("http://u2")
    path = str(tmp_path / "counts")
    run(session, pages, feed, tmp_path, job.write_counts(path), forget_after="1 hour")
    feed.events = 5
    feed.add("http://u3")
    query = run(session, pages, feed, tmp_path, job.write_counts(path), forget_after="1 hour")
    dropped = sum(op.numRowsDroppedByWatermark
                  for p in query.recentProgress for op in p.stateOperators)
    assert dropped == 1
    assert rows(job.read_counts(session, path)) == [("Motor", 1), ("motor", 2), ("speaker", 1)]


def test_run_without_new_data_keeps_the_snapshot(setting, rows):
    session, pages, feed, tmp_path = setting
    feed.add("http://u3")
    run(session, pages, feed, tmp_path)
    before = rows(read_snapshot(session, str(tmp_path / "out")))
    run(session, pages, feed, tmp_path)
    assert before == rows(read_snapshot(session, str(tmp_path / "out"))) == [
        ("bar", 1), ("speaker", 1)]


def test_batches_without_words_publish_nothing(setting):
    session, pages, feed, tmp_path = setting
    feed.add("bad", "http://gone")
    run(session, pages, feed, tmp_path)
    assert read_snapshot(session, str(tmp_path / "out")).count() == 0


def test_malformed_messages_are_counted_and_ignored(setting):
    session, pages, feed, tmp_path = setting
    feed.add("http://u1", "bad", "worse")
    (feed.folder / "noise.json").write_text("not json\n")
    query = run(session, pages, feed, tmp_path)
    seen = [p.observedMetrics["submissions"] for p in query.recentProgress if p.numInputRows]
    assert sum(r.received for r in seen) == 4 and sum(r.malformed for r in seen) == 3


def test_check_switched_off_counts_every_submission(setting, rows):
    session, pages, feed, tmp_path = setting
    feed.add("http://u3", "http://u3")
    path = str(tmp_path / "counts")
    run(session, pages, feed, tmp_path, job.write_counts(path), check_duplicates=False)
    assert rows(job.read_counts(session, path)) == [("bar", 2), ("speaker", 2)]


def test_bounded_memory_of_urls(setting, rows):
    session, pages, feed, tmp_path = setting
    feed.add("http://u3", "http://u3")
    path = str(tmp_path / "counts")
    run(session, pages, feed, tmp_path, job.write_counts(path), forget_after="1 hour")
    assert rows(job.read_counts(session, path)) == [("bar", 1), ("speaker", 1)]


def test_sketch_as_the_published_method(setting, rows):
    session, pages, feed, tmp_path = setting
    feed.add("http://u1", "http://u3")
    publish = job.publish_snapshot(str(tmp_path / "out"), method="cms", eps=0.0001)
    run(session, pages, feed, tmp_path, publish)
    assert rows(read_snapshot(session, str(tmp_path / "out"))) == [
        ("Motor", 1), ("bar", 1), ("motor", 1), ("speaker", 1)]


def test_damaged_checkpoint_raises(setting):
    session, pages, feed, tmp_path = setting
    feed.add("http://u1")
    run(session, pages, feed, tmp_path)
    metadata = tmp_path / "checkpoint" / "metadata"
    metadata.write_text("{")
    (tmp_path / "checkpoint" / ".metadata.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        run(session, pages, feed, tmp_path)


@pytest.mark.parametrize("forget_after", [None, "1 hour"])
def test_hot_url_is_reduced_before_the_state(setting, rows, forget_after):
    session, pages, feed, tmp_path = setting
    feed.add(*["http://u3"] * 5000, "http://u1")
    path = str(tmp_path / "counts")
    query = run(session, pages, feed, tmp_path, job.write_counts(path), forget_after=forget_after)
    dropped = sum(
        op.customMetrics["numDroppedDuplicateRows"]
        for p in query.recentProgress for op in p.stateOperators if op.operatorName.startswith("dedupe"))
    assert dropped == 0  # one row per task
    assert rows(job.read_counts(session, path)) == [
        ("Motor", 1), ("bar", 1), ("motor", 1), ("speaker", 1)]


def test_bucketed_descriptions_join_without_a_shuffle(setting, rows):
    session, pages, feed, tmp_path = setting
    table = "test_descriptions"
    session.sql(f"DROP TABLE IF EXISTS {table}")
    session.sql("SET spark.sql.autoBroadcastJoinThreshold = -1")
    found = save_descriptions(pages, table, 2)
    feed.add("http://u1", "http://u3", "http://u1")
    path = str(tmp_path / "counts")
    query = run(session, pages, feed, tmp_path, job.write_counts(path), found)
    assert rows(job.read_counts(session, path)) == [
        ("Motor", 1), ("bar", 1), ("motor", 1), ("speaker", 1)]
    plan = query._jsq.explainInternal(False)
    join = plan[plan.index("SortMergeJoin"):]
    # One shuffle to the URL state; the join takes its partitions and the buckets as they are.
    assert join.count("Exchange") == 1 and "Bucketed: true" in join
    session.sql(f"DROP TABLE {table}")
