"""Properties of the physical plans that keep the work distributed."""

import re

import pytest

from termtide import schemas, sizing, workspace
from termtide.operators.counts import word_counts
from termtide.operators.descriptions import submitted_descriptions
from termtide.operators.ranking import heavy_hitters
from termtide.operators.submissions import accepted
from termtide.operators.words import prepared_words, tokens
from termtide.plans import queries
from termtide.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
BATCH = [q for q in QUERIES if "stream" not in q]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_python_workers(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEval", "BatchEvalPython",
                     "MapInArrow", "MapInPandas"):
        assert operator not in text


def test_documents_are_read_by_column(spark):
    text = plan(QUERIES["q08_word_counts"](spark, SF_DIR))
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", text)) == {
        "struct<doc_id:bigint,text:string>"}
    assert "partial_count" in text


@pytest.mark.parametrize("query", ["q05_tokens", "q06_filtered_words"])
def test_words_per_document_are_not_shuffled(spark, monkeypatch, query):
    monkeypatch.setattr(queries, "spread", lambda df, *keys: df)  # as with a large input
    assert "Exchange" not in plan(QUERIES[query](spark, SF_DIR))


@pytest.mark.parametrize("words", [tokens, prepared_words])
def test_words_per_document_are_added_up_over_rows_with_the_same_id(spark, rows, words):
    df = spark.createDataFrame(
        [(1, "xx yy xx"), (2, "xx zz"), (2, "zz"), (None, "xx"), (None, "xx"), (3, None)],
        "doc_id long, text string")
    found = queries._per_document(df, words)
    expected = words(df, keep=["doc_id"]).groupBy("doc_id", "word").count()
    assert sorted(map(str, found.collect())) == sorted(
        map(str, expected.withColumnRenamed("count", "n").collect()))
    assert found.count() == 5


def test_top_words_are_not_fully_sorted(spark):
    text = plan(QUERIES["q15_top_words"](spark, SF_DIR))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_counts_are_computed_once_for_words_and_total(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    hitters = heavy_hitters(word_counts(prepared_words(documents)))
    hitters.collect()
    assert "ReusedExchange" in plan(hitters)


def test_flagship_counts_before_stemming_and_ranks_in_one_pass(spark):
    text = plan(QUERIES["q21_flagship"](spark, SF_DIR))
    assert text.count("Expand") == 1 and "TakeOrderedAndProject" in text
    # Two shuffles after the lookup: counts by word, then sums by stem with the total.
    assert text.count("Exchange hashpartitioning(word") == 2


def test_html_is_never_shuffled(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    urls = spark.createDataFrame([(1, None, "http://a")], schemas.SUBMISSIONS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(submitted_descriptions(
            accepted(urls), pages, container="article", broadcast_rows=-1))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The join by shuffle gets the paragraph, made below its exchange.
    page_side = text[text.rindex("SortMergeJoin"):]
    exchange = page_side.index("Exchange hashpartitioning(page_id")
    assert page_side.index("Generate explode") > exchange
    assert page_side.count("html") > 0 and "html" not in page_side[:exchange]


def test_submitted_pages_are_picked_before_extraction(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    urls = spark.range(3).selectExpr(
        "id AS event_id", "timestamp_seconds(id) AS ts", "concat('http://', id) AS url")
    text = plan(submitted_descriptions(accepted(urls), pages, container="article"))
    assert text.index("Generate explode") < text.index("BroadcastHashJoin")
    # One exchange, of descriptions by URL.
    assert text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["q01_submission_outcomes", "q02_accepted_urls"])
def test_first_submissions_are_aggregated_by_hash(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "SortAggregate" not in text and "partial_min" in text


def test_spread_leaves_large_inputs_alone(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    size = sizing.plan_bytes(documents)
    assert size > 0
    assert "REPARTITION_BY_NUM" in plan(sizing.spread(documents, "doc_id"))
    assert "REPARTITION_BY_NUM" not in plan(sizing.spread(documents, "doc_id", limit=size - 1))


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    class Session:
        def __init__(self, master, folder):
            self.conf, self.sparkContext = {"spark.checkpoint.dir": folder}, self
            self.master = master

    assert workspace.shared_dir(Session("yarn", "hdfs:///ckpt/")) == "hdfs:///ckpt"
    assert workspace.fresh_dir(Session("yarn", "hdfs:///ckpt"), "x").startswith("hdfs:///ckpt/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_dir(Session("yarn", None))
    assert workspace.shared_dir(Session("local[2]", None))
