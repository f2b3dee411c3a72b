"""Submissions and pages that arrive in any order, with URLs known from before the stream.

One stateful operator keyed by URL decides everything about a URL: whether it was accepted already, by
this stream or by the history that seeds the state, and whether its description is still awaited.
A URL waits until its page comes; a page that comes first waits for its submission. Each of
them is handed on once, and then only the mark of the URL stays in the state.

The rows are written by the file sink, which commits every batch exactly once. The running job reads them
as a stream of their own, as no running count may follow a join of streams in one query.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from termtide import params, schemas
from termtide.functions.html import first_paragraph
from termtide.functions.porter import with_stem
from termtide.functions.urls import is_valid_url
from termtide.operators.counts import word_counts
from termtide.operators.words import prepared_words
from termtide.streaming.job import first_per_task

ACCEPTED, DESCRIBED = "accepted", "described"
ARRIVALS = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("description", T.StringType()),
    T.StructField("kind", T.StringType()),
])
# What the state of a URL says; the description is that of its newest page so far.
_STATE = T.StructType([
    T.StructField("accepted", T.BooleanType()),
    T.StructField("done", T.BooleanType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("description", T.StringType()),
])


def _processor() -> StatefulProcessor:
    # A local class, so that it is shipped to the executors by value.
    accepted_kind, described_kind, schema = ACCEPTED, DESCRIBED, _STATE

    class Arrivals(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("url", schema)

        def handleInitialState(self, key, initialState, timerValues) -> None:
            # Accepted before the stream began: neither accepted nor described again.
            self.state.update((True, True, None, None))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            accepted, done, page_id, description = (
                self.state.get() if self.state.exists() else (False, False, None, None))
            if done:
                return

            def rank(page) -> tuple:
                return (page.page_id is not None, page.page_id or 0, page.description)

            submitted, first = False, None
            newest = rank(Row(page_id=page_id, description=description))
            for row in rows:
                if row.description is None:
                    submitted = True
                    if row.ts is not None and (first is None or row.ts < first):
                        first = row.ts
                elif description is None or rank(row) > newest:
                    page_id, description = row.page_id, row.description
                    newest = rank(row)
            if submitted and not accepted:
                accepted = True
                yield Row(url=key[0], ts=first, description=None, kind=accepted_kind)
            if accepted and description is not None:
                yield Row(url=key[0], ts=None, description=description, kind=described_kind)
                self.state.update((True, True, None, None))
            else:
                self.state.update((accepted, False, page_id, description))

        def close(self) -> None:
            pass

    return Arrivals()


def arrivals(submissions: DataFrame, pages: DataFrame, seen: DataFrame | None = None, *,
             container: str = params.CONTAINER) -> DataFrame:
    """Streaming ``url, ts, description, kind`` of the streams ``submissions`` and ``pages``.

    A row of kind ``accepted`` for the first submission of every valid URL that is not in the static
    ``seen``, with its time; a row of kind ``described`` once a page with a description is there too,
    whichever came first, any number of batches apart. Of several pages that came before, that
    with the largest ``page_id`` counts; those that come after are not looked at. Null and malformed
    URLs are counted in the progress, as the metric ``submissions``, and dropped. ``seen`` seeds the
    state at the first start and is not read again.

    Repeats of a URL are reduced in every task, so a hot one reaches its state about once per task;
    only descriptions, not HTML, are shuffled and kept.
    """
    marked = submissions.select("ts", "url", is_valid_url(F.col("url")).alias("valid")).observe(
        "submissions", F.count("*").alias("received"), F.count_if(~F.col("valid")).alias("malformed"))
    urls = first_per_task(marked.where("valid").select("ts", "url")).select(
        "url", "ts", F.lit(None).cast("long").alias("page_id"),
        F.lit(None).cast("string").alias("description"))
    found = first_paragraph(pages.where("url IS NOT NULL").select("page_id", "url", "html"), container)
    both = urls.unionByName(found.select(
        "url", F.lit(None).cast("timestamp").alias("ts"), "page_id", "description"))
    initial = None
    if seen is not None:
        initial = seen.where("url IS NOT NULL").select("url").distinct().groupBy("url")
    return both.groupBy("url").transformWithState(
        _processor(), ARRIVALS, "append", "None", initial)


def save_arrivals(rows: DataFrame, path: str, checkpoint: str, *,
                  trigger: dict | None = None) -> StreamingQuery:
    """Write ``arrivals`` to the table at ``path``, each batch once; continues at ``checkpoint``."""
    return (rows.writeStream.format("parquet").outputMode("append").partitionBy("kind")
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": params.TRIGGER_INTERVAL}))
            .start(path))


def accepted_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """``url, ts`` accepted by the stream so far: what a later stream or batch has to know as seen."""
    rows = spark.read.schema(ARRIVALS).parquet(path)
    return rows.where(F.col("kind") == ACCEPTED).select("url", "ts")


def running_stems_of_arrivals(spark: SparkSession, path: str, **options) -> DataFrame:
    """Streaming ``word, n`` by stem over the descriptions at ``path``, for ``job.start`` in update mode;
    the row without a word is the total. ``options`` are those of ``prepared_words``."""
    rows = spark.readStream.schema(ARRIVALS).parquet(path)
    texts = rows.where(F.col("kind") == DESCRIBED).select("description")
    words = with_stem(prepared_words(texts, "description", **options))
    each = F.explode(F.array("stem", F.lit(None).cast("string"))).alias("word")
    return word_counts(words.select(each))


def new_seen(spark: SparkSession, path: str, seen: DataFrame | None = None) -> DataFrame:
    """``url``: the URLs of ``seen`` and those accepted at ``path``."""
    own = accepted_arrivals(spark, path).select("url")
    old = spark.createDataFrame([], schemas.SEEN) if seen is None else seen.select("url")
    return old.unionByName(own)
