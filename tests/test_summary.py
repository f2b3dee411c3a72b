import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from termtide import schemas
from termtide.operators import summary as module
from termtide.operators.counts import word_counts
from termtide.operators.descriptions import descriptions
from termtide.operators.sketch import cms_cells, cms_estimates
from termtide.operators.summary import (
    RECORD, cells_of, heavy_hitters_of, merge_summaries, summary, total_of)
from termtide.sources.snapshots import read_snapshot
from termtide.sources.submissions import stream_submissions
from termtide.streaming import job

PCT = {"pct": 0.02, "eps": 0.005}
SKETCH = {"eps": 0.005}


def words_of(spark, words, parts=7):
    return spark.createDataFrame([(w,) for w in words], "word string").repartition(parts)


def zipf(seed, n=20_000, vocabulary=5_000):
    rng = random.Random(seed)
    return [f"w{int(vocabulary ** rng.random())}é'" for _ in range(n)]


@pytest.mark.parametrize("order", ["mixed", "sorted"])
def test_record_names_every_word_above_the_threshold(spark, rows, order):
    words = zipf(1)
    df = words_of(spark, words)
    if order == "sorted":  # every heavy hitter is in one task only
        df = spark.createDataFrame([(w,) for w in words], "word string").repartitionByRange(5, "word")
    record = summary(df, **PCT)
    counts = word_counts(df)
    assert rows(cells_of(record)) == rows(cms_cells(counts, **SKETCH))
    assert total_of(record).first().total == len(words)
    found = dict(rows(heavy_hitters_of(record, **PCT)))
    exact = Counter(words)
    assert {w for w, n in exact.items() if n >= 0.02 * len(words)} <= found.keys()
    estimates = {w: e for w, _, e in rows(cms_estimates(counts, cms_cells(counts, **SKETCH), **SKETCH))}
    assert all(found[w] == estimates[w] >= exact[w] for w in found)


def test_record_does_not_grow_with_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(module, "KNOWN", 50)
    many = spark.range(200_000).select(F.concat(F.lit("w"), "id").alias("word")).unionByName(
        spark.range(8_000).select(F.lit("often").alias("word"))).repartition(4)
    parts = many.mapInArrow(module._summaries(0.005, 0.01, 314, 0.02), RECORD)
    candidates = parts.where("kind = 'candidate'")
    assert candidates.count() <= 4 * math.ceil(1 / 0.02)
    assert [r.word for r in heavy_hitters_of(summary(many, **PCT), **PCT).collect()] == ["often"]


def test_record_of_words_taken_in_several_parts(spark, rows, monkeypatch):
    df = words_of(spark, [*zipf(4, 6_000), None], 3)
    whole = summary(df, **PCT)
    monkeypatch.setattr(module, "ROWS", 300)
    monkeypatch.setattr(module, "KNOWN", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        parts = summary(df, **PCT)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows(cells_of(parts)) == rows(cells_of(whole))
    assert total_of(parts).first().total == 6_000
    assert rows(heavy_hitters_of(parts, **PCT)) == rows(heavy_hitters_of(whole, **PCT)) != []


def test_batches_are_counted_together(monkeypatch):
    """A word that is in every one of many batches is counted once, not once a batch."""
    made = []
    monkeypatch.setattr(module.pc, "value_counts", lambda x, f=module.pc.value_counts: (
        made.append(len(x)), f(x))[1])
    batches = [module.pa.RecordBatch.from_pydict({"word": ["often", f"w{i}"]}) for i in range(1_000)]
    found = next(module._summaries(0.005, 0.01, 314, 0.02)(iter(batches))).to_pylist()
    assert made == [2_000]
    assert [r["n"] for r in found if r["kind"] == "total"] == [2_000]


def test_merged_records_are_those_of_the_whole(spark, rows):
    first, second = zipf(2), ["x"] * 900 + zipf(3, 3_000)
    whole = summary(words_of(spark, first + second), **PCT)
    merged = merge_summaries(
        summary(words_of(spark, first), **PCT), summary(words_of(spark, second), **PCT), **PCT)
    assert rows(cells_of(merged)) == rows(cells_of(whole))
    assert total_of(merged).first() == total_of(whole).first()
    exact = Counter(first + second)
    above = {w for w, n in exact.items() if n >= 0.02 * len(first + second)}
    assert "x" in above and above <= {r.word for r in heavy_hitters_of(merged, **PCT).collect()}


def test_null_and_no_words(spark, rows):
    empty = summary(spark.createDataFrame([], "word string"), **PCT)
    assert rows(cells_of(empty)) == [] and total_of(empty).first().total == 0
    assert heavy_hitters_of(empty, **PCT).collect() == []
    record = summary(words_of(spark, [None, "a", None, ""]), **PCT)
    assert total_of(record).first().total == 2
    assert rows(heavy_hitters_of(record, **PCT)) == [("", 1), ("a", 1)]
    assert rows(cells_of(merge_summaries(empty, record, **PCT))) == rows(cells_of(record))


def test_sketch_of_a_stream_after_batches_repeats_and_a_restart(spark, tmp_path, rows):
    session = job.streaming_session(spark, state_partitions=2)
    texts = ["motors and motors", "the speaker motor", "speakers and bars"]
    pages = session.createDataFrame(
        [(i, f"http://u{i}", f'<div id="productDescription"><p>{t}</p></div>')
         for i, t in enumerate(texts)], schemas.PAGES)
    sketch = {"eps": 0.001}
    publish_once = job.publish_summary(str(tmp_path / "out"), pct=0.2, **sketch)

    def publish(words, batch_id):
        publish_once(words, batch_id)
        publish_once(words, batch_id)  # a batch that is repeated

    (tmp_path / "in").mkdir()
    for run, files in enumerate(([["http://u0", "bad"], ["http://u0", "http://u1"]], [["http://u2"]])):
        for i, urls in enumerate(files):
            (tmp_path / "in" / f"{run}{i}.json").write_text("\n".join(
                json.dumps({"event_id": i, "ts": "2026-01-01T00:00:00Z", "url": u}) for u in urls))
        source = stream_submissions(session, str(tmp_path / "in"), "json", maxFilesPerTrigger="1")
        job.start(job.running_words(source, descriptions(pages)), publish, str(tmp_path / "checkpoint"),
                  trigger={"availableNow": True}, mode="append").awaitTermination()
    stems = Counter({"motor": 3, "speaker": 2, "bar": 1})
    record = job.read_summary(spark, str(tmp_path / "out"))
    counts = spark.createDataFrame(list(stems.items()), schemas.WORD_COUNTS)
    assert rows(cells_of(record)) == rows(cms_cells(counts, **sketch))
    assert total_of(record).first().total == 6
    assert [tuple(r) for r in read_snapshot(spark, str(tmp_path / "out")).collect()] == [
        ("motor", 3), ("speaker", 2)]
