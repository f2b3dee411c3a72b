import pytest
from pyspark.sql import functions as F

from termtide import params, schemas
from termtide.operators.display import cloud_items, display_sizes, unique_spellings
from termtide.operators.ranking import (
    heavy_hitters, heavy_hitters_cms, top_heavy_hitters, top_k)
from termtide.plans.top_terms import rank_words, top_terms


def table(spark, **counts):
    return spark.createDataFrame(list(counts.items()), schemas.WORD_COUNTS)


def items(spark, *pairs):
    return spark.createDataFrame(list(pairs), schemas.CLOUD_ITEMS)


def test_threshold_is_inclusive(spark, rows):
    counts = table(spark, a=50, b=25, c=24, d=1)
    assert rows(heavy_hitters(counts, 0.25)) == [("a", 50), ("b", 25)]


def test_no_words_no_hitters(spark):
    empty = spark.createDataFrame([], schemas.WORD_COUNTS)
    assert heavy_hitters(empty).count() == 0
    assert top_heavy_hitters(empty).count() == 0
    assert heavy_hitters_cms(empty, eps=0.0001).count() == 0


def test_ties_are_in_word_order_and_scores_are_doubles(spark):
    top = top_k(table(spark, b=2, a=2, c=3, d=1), 3)
    assert [tuple(r) for r in top.collect()] == [("c", 3.0), ("a", 2.0), ("b", 2.0)]
    assert top.schema == schemas.TOP_WORDS


@pytest.mark.parametrize("k, pct", [(2, 0.0001), (10, 0.2), (3, 0.5), (0, 0.1), (10, 0.0)])
def test_one_pass_equals_filter_then_limit(spark, k, pct):
    counts = table(spark, a=5, b=4, c=4, d=1)
    partial = counts.unionByName(table(spark, d=3, e=3))
    merged = partial.groupBy("word").agg(F.sum("n").alias("n"))
    expected = top_k(heavy_hitters(merged, pct), k).collect()
    assert top_heavy_hitters(partial, k, pct).collect() == expected


def test_size_of_an_unset_list(spark):
    counts = table(spark, **{f"w{i:02}": 1 for i in range(40)})
    assert top_k(counts, None).count() == 25 == top_heavy_hitters(counts, None).count()
    assert top_k(counts).count() == 40


def test_stop_words_as_a_table_or_a_list_give_the_same_terms(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stop = spark.createDataFrame([(w,) for w in params.STOP_WORDS], "word string")
    expected = top_terms(documents).collect()
    assert top_terms(documents, stop_words=stop).collect() == expected
    assert top_terms(documents, stop_words=[]).collect() != expected


def test_sketch_warns_when_its_error_exceeds_the_threshold(spark):
    with pytest.warns(UserWarning, match="eps"):
        heavy_hitters_cms(table(spark, a=1))


def test_fine_sketch_finds_the_exact_top_words(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    exact = top_terms(documents, k=20).collect()
    sketch = top_terms(documents, k=20, method="cms", eps=0.00005).collect()
    assert [r.word for r in sketch] == [r.word for r in exact]


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        rank_words(table(spark, a=1), method="other")


def test_items_truncate_scores(spark, rows):
    top = spark.createDataFrame([("a", 2.9)], schemas.TOP_WORDS)
    assert rows(cloud_items(top)) == [("a", 2)]
    assert cloud_items(top).schema == schemas.CLOUD_ITEMS


@pytest.mark.parametrize("sizes, expected", [
    ([1, 4, 9], [10, 55, 100]), ([5, 5, 5], [10, 10, 10]), ([7], [10]),
    ([0, 4], [-80, 100]), ([2, 3, 100], [10, 13, 100]),
])
def test_display_sizes(spark, sizes, expected):
    df = items(spark, *((f"w{i:02}", s) for i, s in enumerate(sizes)))
    assert [r.font_px for r in display_sizes(df).orderBy("text").collect()] == expected


def test_spellings(spark, rows):
    df = items(spark, ("Sound", 3), ("sound", 5), ("SOUND", 5), ("bar", 1), ("é", 1), ("É", 2))
    assert rows(unique_spellings(df)) == [("SOUND", 5), ("bar", 1), ("É", 2)]
