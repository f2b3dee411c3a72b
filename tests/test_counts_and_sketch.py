import math

import pytest
from pyspark.sql import functions as F

from termtide import params, schemas
from termtide.operators.counts import merge_counts, stem_counts, total_words, word_counts
from termtide.operators.sketch import (
    cms_cells, cms_estimates, depth_of, merge_cells, width_of)
from termtide.operators.words import prepared_words


def table(spark, **counts):
    return spark.createDataFrame(list(counts.items()), schemas.WORD_COUNTS)


@pytest.fixture(scope="module")
def counts(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counted = word_counts(prepared_words(documents)).cache()
    yield counted
    counted.unpersist()  # or plans of later tests would read the cache


def test_word_counts(spark, rows):
    words = spark.createDataFrame([("a",), ("b",), ("a",)], "word string")
    assert rows(word_counts(words)) == [("a", 2), ("b", 1)]


def test_merge_is_addition_with_identity(spark, rows):
    old, new = table(spark, a=2, b=1), table(spark, b=3, c=4)
    assert rows(merge_counts(old, new)) == [("a", 2), ("b", 4), ("c", 4)]
    empty = spark.createDataFrame([], schemas.WORD_COUNTS)
    assert rows(merge_counts(empty, new)) == rows(new) == rows(merge_counts(new, empty))


def test_merged_parts_equal_the_whole(spark, rows):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = prepared_words(documents, keep=["source"])
    first = F.col("source") < "src5"
    merged = merge_counts(word_counts(words.where(first)), word_counts(words.where(~first)))
    assert rows(merged) == rows(word_counts(words))


def test_stems_add_up(spark, rows):
    assert rows(stem_counts(table(spark, motor=1, motoring=2, motors=3, Motors=1))) == [
        ("Motor", 1), ("motor", 6)]


def test_total(spark, rows):
    assert rows(total_words(table(spark, a=2, b=5))) == [(7,)]


def test_dimensions():
    assert (width_of(params.EPS), depth_of(params.DELTA)) == (272, 5)
    assert [width_of(e) for e in (0.001, 0.0001)] == [2719, 27183]


def test_every_row_of_the_sketch_holds_all_counts(counts, rows):
    total = counts.agg(F.sum("n")).first()[0]
    per_row = cms_cells(counts).groupBy("r").agg(F.sum("c").alias("c"))
    assert rows(per_row, "r", "c") == [(r, total) for r in range(5)]


def test_merged_sketches_equal_the_sketch_of_the_whole(counts, rows):
    first = F.length("word") % 2 == 0
    merged = merge_cells(cms_cells(counts.where(first)), cms_cells(counts.where(~first)))
    assert rows(merged, "r", "b", "c") == rows(cms_cells(counts), "r", "b", "c")


@pytest.mark.parametrize("eps", [0.01, 0.001])
def test_estimates_keep_the_guarantees(counts, eps):
    total = counts.agg(F.sum("n")).first()[0]
    estimates = cms_estimates(counts, cms_cells(counts, eps=eps), eps=eps)
    error = F.col("est") - F.col("n")
    r = estimates.agg(
        F.count("*").alias("words"), F.min(error).alias("lowest"),
        F.avg((error <= eps * total).cast("int")).alias("within")).first()
    assert r.words == counts.count() and r.lowest >= 0
    assert r.within >= 1 - params.DELTA


def test_large_sketch_is_joined_by_shuffle_with_the_same_result(counts, rows, monkeypatch):
    expected = rows(cms_estimates(counts, cms_cells(counts)))
    monkeypatch.setattr("termtide.operators.sketch.BROADCAST_CELLS", 10)
    assert rows(cms_estimates(counts, cms_cells(counts))) == expected


def test_words_the_sketch_never_saw(spark, rows, monkeypatch):
    cells = cms_cells(table(spark, seen=7))
    asked = table(spark, seen=7, unseen=0)
    for limit in (1_000_000, 10):
        monkeypatch.setattr("termtide.operators.sketch.BROADCAST_CELLS", limit)
        assert rows(cms_estimates(asked, cells)) == [("seen", 7, 7), ("unseen", 0, 0)]


def test_one_row_sketch(spark, rows):
    counts = table(spark, a=2, b=3)
    assert rows(cms_estimates(counts, cms_cells(counts, delta=0.5), delta=0.5)) == [
        ("a", 2, 2), ("b", 3, 3)]


def test_seed_changes_the_cells(counts, rows):
    assert rows(cms_cells(counts, seed=1)) != rows(cms_cells(counts))


def test_sketch_against_plain_loop(spark, rows):
    import hashlib
    counted = table(spark, of=5, sound=3, bar=2)
    expected = {}
    for word, n in counted.collect():
        for r in range(depth_of(0.1)):
            b = int(hashlib.md5(f"7:{r}:{word}".encode()).hexdigest()[:8], 16) % width_of(0.5)
            expected[r, b] = expected.get((r, b), 0) + n
    assert math.prod((depth_of(0.1), width_of(0.5))) == 18
    got = cms_cells(counted, eps=0.5, delta=0.1, seed=7)
    assert rows(got, "r", "b", "c") == sorted((*k, v) for k, v in expected.items())
