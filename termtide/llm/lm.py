"""Language-model scores of whole documents by a gated recurrent network.

Tasks count the distinct words of many training texts at once, and one aggregation adds the counts
up. The network reads and
predicts the most frequent words; any other word belongs to one of a few tail classes by its last
bytes, the network predicts the class and the counts the word within it, so every word has a
probability and all sum to one. Texts are cut into words and looked up once, into a table of network
ids from which it learns and scores. Training runs inside tasks, by truncated backpropagation over the
documents of a partition; after every round the tasks' parameters are averaged.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termtide.llm import gru
from termtide.llm.common import by_size, freeing, parts, written

# Words that the network knows, and tail classes for the rest.
WORDS, TAILS = 1024, 32
# Words whose counts every task holds; the counts of rarer ones are joined.
HELD = 200_000
# Learning rate of every round. The training documents are cut into that many parts by a hash of
# their ids, and the network learns from every one of them in its round.
RATES = (0.01, 0.004)
# Bytes of text that a task cuts into words at once; a longer text is cut alone.
CUT = 8 << 20
# Tokens that a task takes together, to learn from and to score.
GROUP, SCORED = 1_000_000, 4_000_000
# Models that are averaged at a time, by a task or the driver.
AVERAGED = 64
# The mark at the end of every text; no word, as it is white space.
END = b"\n"
TAIL_BYTES = 2

_ENCODED = ("uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, "
            "inside double, ids binary, rare array<struct<word: binary, m: int>>")
_SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as bytes, one text after another, and the place of the text that each
    is from. Only A to Z are lower-cased and only ASCII white space parts words; null counts as empty."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = cut.flatten().cast(pa.binary())
    real = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty one
    return words.filter(real), pc.list_parent_indices(cut).filter(real).to_numpy()


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-TAIL_BYTES:]) % TAILS


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, CUT):
        counted = words_of(batch.column("text"))[0].value_counts()
        for word, c in ((counted.field("values"), counted.field("counts")),
                        (pa.array([END]), pa.array([len(batch)]))):
            yield pa.RecordBatch.from_arrays([word, c], names=["word", "c"])


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), c: over all rows of ``docs`` (text), the end marks included."""
    each = docs.select("text").mapInArrow(freeing(_counter), "word binary, c long")
    return written(each.groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")


class Vocabulary:
    """What tasks need of the counts; bounded by ``HELD`` words, whatever the corpus."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.types = total["n"] or 0, total["v"]
        held = counts.orderBy(F.desc("c"), "word").limit(HELD).toArrow()
        self.names = held.column("word").combine_chunks()
        names, c = self.names.to_pylist(), held.column("c").to_pylist()
        known = min(WORDS, len(names))
        # A tail class holds the words beyond the known ones by their last bytes.
        tail = F.crc32(F.substring("word", -TAIL_BYTES, TAIL_BYTES)) % TAILS
        self.tail_tokens, self.tail_types = np.zeros(TAILS), np.zeros(TAILS)
        for row in counts.groupBy(tail.alias("tail")).agg(
                F.sum("c").alias("n"), F.count("*").alias("v")).collect():
            self.tail_tokens[row["tail"]], self.tail_types[row["tail"]] = row["n"], row["v"]
        for word, n in zip(names[:known], c, strict=False):
            self.tail_tokens[tail_of(word)] -= n
            self.tail_types[tail_of(word)] -= 1
        # By place of a word its network id and log10 (count + 1).
        self.ids = np.array([*range(known), *(known + tail_of(w) for w in names[known:])], np.int32)
        self.logs = np.log10(np.asarray(c, float) + 1)
        self.known = known
        self.id_type = np.dtype("<u2" if known + TAILS <= 1 << 16 else "<u4")
        self.layout = gru.Layout(np.asarray(c[:known], float), TAILS, self.tail_tokens)
        self.end = int(self.look_up(pa.array([END]))[1][0])
        self.base_log = math.log10(self.tokens + self.types + 1)
        # In a tail class all unseen words together count as one type, as they do in the base.
        self.tail_log = np.log10(self.tail_tokens + self.tail_types + 1)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The places (-1: not held) and network ids of words."""
        places = pc.index_in(words, value_set=self.names).fill_null(-1).to_numpy()
        held, ids = places >= 0, np.empty(len(words), np.int32)
        ids[held] = self.ids[places[held]]
        endings = pc.binary_slice(words.filter(pa.array(~held)), -TAIL_BYTES).dictionary_encode()
        tails = np.array([tail_of(w) for w in endings.dictionary.to_pylist()], np.int32)
        ids[~held] = self.known + tails[endings.indices.to_numpy()]
        return places, ids


def _shared(df: DataFrame, *values):
    """A broadcast by value: its classes need not be installed where the tasks run."""
    return df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(values))


def _encoded(texts: pa.Array, vocabulary: Vocabulary) -> dict[str, pa.Array]:
    """What ``_ENCODED`` names from n_tokens on. All is looked up once per distinct word."""
    n = len(texts)
    words, owner = words_of(texts)
    n_words = np.bincount(owner, minlength=n)
    n_tokens, ends = n_words + 1, np.cumsum(n_words)
    tokens = pa.concat_arrays([words, pa.array([END])]).dictionary_encode()
    code = tokens.indices.to_numpy()
    words, code = code[:-1], np.insert(code[:-1], ends, code[-1])  # an end mark after every text
    places, ids = vocabulary.look_up(tokens.dictionary)
    held, tail = places >= 0, ids >= vocabulary.known
    logs, inside = np.zeros(len(ids)), np.zeros(len(ids))
    logs[held] = vocabulary.logs[places[held]]
    # Within a tail class the counts decide; those of rare words are added later.
    inside[tail] = logs[tail] - vocabulary.tail_log[ids[tail] - vocabulary.known]

    starts = np.cumsum(n_tokens) - n_tokens

    def added(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[code], starts)

    ids_of_words = ids.astype(vocabulary.id_type)[words]
    offsets = np.concatenate([[0], ends]) * vocabulary.id_type.itemsize
    rare = np.flatnonzero(~held[code])
    owner = np.searchsorted(starts, rare, "right") - 1
    pairs, m = np.unique(owner * len(ids) + code[rare], return_counts=True)
    text, word = np.divmod(pairs, len(ids))
    return {
        "n_tokens": pa.array(n_tokens), "known": pa.array(added(held.astype(np.int64))),
        "base": pa.array(added(logs) - n_tokens * vocabulary.base_log),
        "inside": pa.array(added(inside)),
        "ids": pa.Array.from_buffers(pa.binary(), n, [
            None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids_of_words)]),
        "rare": pa.ListArray.from_arrays(
            pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays(
                [tokens.dictionary.take(pa.array(word)), pa.array(m, pa.int32())], ["word", "m"]))}


def _encoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, = pickle.loads(shared.value)
        number = TaskContext.get().partitionId() << 36
        for batch in by_size(batches, CUT):
            yield pa.RecordBatch.from_pydict({
                "uid": pa.array(np.arange(number, number + len(batch))),
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                **_encoded(batch.column("text"), vocabulary)})
            number += len(batch)
    return run


def encoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``rows`` (doc_id, text, held_out) as a table of network ids, with the logs that the counts give."""
    return written(rows.mapInArrow(freeing(_encoder(_shared(rows, vocabulary))), _ENCODED), "lm-encoded")


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows of about ``limit`` tokens."""
    group, size = [], 0
    for batch in parts(batches, 64):
        group.append(batch)
        size += sum(batch.column("n_tokens").to_pylist())
        if size >= limit:
            yield pa.Table.from_batches(group)
            group, size = [], 0
    if group:
        yield pa.Table.from_batches(group)


def _documents(rows: pa.Table, id_type: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(ids.as_buffer(), id_type) for ids in rows.column("ids")]


def _trainer(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, end, id_type, values = pickle.loads(shared.value)
        model = gru.Model(layout)
        model.load(values)
        groups = (_documents(rows, id_type) for rows in _groups(batches, GROUP))
        tokens = gru.train(model, groups, end, rate)
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([tokens]),
                 pa.array([model.flat().tobytes()])],
                names=["part", "tokens", "parameters"])
    return run


def _average(rows: pa.Table) -> pa.Table:
    tokens = np.asarray(rows.column("tokens").to_pylist(), float)
    total = sum(n * np.frombuffer(p.as_buffer(), np.float32).astype(float)
                for n, p in zip(tokens, rows.column("parameters"), strict=True))
    mean = (total / tokens.sum()).astype(np.float32)
    return pa.table([pa.array([int(tokens.sum())]), pa.array([mean.tobytes()])],
                    names=["tokens", "parameters"])


def _merged(rows: pa.Table) -> pa.Table:
    return _average(rows).add_column(0, "part", rows.column("part").slice(0, 1))


def rounds(docs: DataFrame) -> list[DataFrame]:
    """``docs`` (ids, n_tokens) cut into the parts of the rounds; every row is in one of them."""
    part = F.pmod(F.xxhash64("ids"), F.lit(len(RATES)))
    return [docs.select("ids", "n_tokens").where(part == i) for i in range(len(RATES))]


def learned(docs: DataFrame, vocabulary: Vocabulary) -> gru.Model:
    """The network after one pass over all of ``docs`` (ids, n_tokens), in rounds."""
    model, schema = gru.Model(vocabulary.layout), "part long, tokens long, parameters binary"
    for rate, part in zip(RATES, rounds(docs), strict=True):
        shared = _shared(docs, vocabulary.layout, vocabulary.end, vocabulary.id_type, model.flat())
        found = written(part.mapInArrow(_trainer(shared, rate), schema), "lm-models")
        while (n := found.count()) > AVERAGED:
            fewer = found.withColumn("part", F.col("part") % math.ceil(n / AVERAGED))
            found = written(fewer.groupBy("part").applyInArrow(_merged, schema), "lm-models")
        if n:
            mean = _average(found.orderBy("part").toArrow()).column("parameters")[0].as_py()
            model.load(np.frombuffer(mean, np.float32))
    return model


def train(docs: DataFrame, vocabulary: Vocabulary) -> gru.Model:
    """The network after one pass over all of ``docs`` (text)."""
    return learned(encoded(docs.select(
        F.lit(None).cast("long").alias("doc_id"), "text", F.lit(False).alias("held_out")),
        vocabulary), vocabulary)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, end, id_type, values = pickle.loads(shared.value)
        model = gru.Model(layout)
        model.load(values)
        for rows in _groups(batches, SCORED):
            logs = gru.score(model, _documents(rows, id_type), end) / math.log(10)
            scored = pa.array(logs + rows.column("inside").to_numpy())
            yield from rows.drop_columns(["ids", "inside"]).append_column(
                "model", scored).combine_chunks().to_batches()
    return run


def score(df: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``df``
    (doc_id, text), learning from the rows for which ``held_out`` is false.

    Scores are log10 probabilities of the whole text with its end mark. Null and empty texts are
    the end mark alone. Without training rows nothing is known and both scores are those of one
    unseen word after another. Repeated rows are scored alike, other columns do not matter.
    """
    rows = df.select("doc_id", "text", held_out.alias("held_out"))
    training = rows.where("NOT held_out")
    counts = word_counts(training)
    vocabulary = Vocabulary(counts)
    table = encoded(rows, vocabulary)
    model = learned(table.where("NOT held_out"), vocabulary)
    shared = _shared(df, vocabulary.layout, vocabulary.end, vocabulary.id_type, model.flat())
    scored = written(table.drop("rare").mapInArrow(_scorer(shared), _SCORED), "lm-scored")
    # Counts of the words that tasks do not hold; a missing count is 0 and adds log10 1.
    rare = table.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.m")
    added = rare.join(counts, "word").groupBy("uid").agg(
        F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("log"), F.sum("m").alias("known"))
    log = F.coalesce("log", F.lit(0.0))
    return scored.join(added.withColumnRenamed("known", "more"), "uid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"), (F.col("model") + log).alias("score"))
