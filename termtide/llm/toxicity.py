"""Toxicity of disguised texts: noisy-channel restoration, then a linear score.

A disguised word is what a channel made of a plain one: it writes letters as look-alike digits and
signs, repeats them, and puts signs or spaces between them. Every suspicious token becomes a lattice of the
letters that each of its characters may stand for, and Viterbi's algorithm finds the most probable
word in it under a character language model of the corpus. The restored text is scored by the words in
it, their beginnings and their ends, with weights learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termtide.llm.common import parts, slices, written
from termtide.llm.language import gram_counts, letter_table, mix

# Letters that digits and signs stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c",
    "<": "c", "¡": "i",
}
# Costs of the channel, as negative logarithms: a sign or digit for a letter, a sign between
# letters, a digit between them, a letter written once more.
SIGN, BETWEEN, NUMBER, AGAIN = 1.0, 2.0, 5.0, 0.7
# Trigrams of the language model: the most frequent of the corpus.
TRIGRAMS = 50_000
# Labelled rows that the weights are fitted on, those first by a hash of doc_id; features that
# have a weight; hash places of features; letters of a word's beginning and end.
SAMPLE, FEATURES, PLACES, EDGE = 100_000, 1024, 1 << 20, 5
# Rounds of fitting, and the strength that pulls weights to zero.
ROUNDS, RIDGE = 200, 0.3
# Tokens that a task remembers, and how many letters of one are decoded at a time.
CACHE, DECODED = 100_000, 60

_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_PLAIN = re.compile(r"""["'(\[{„“«¿]*[^\W\d_]+(?:['’][^\W\d_]+|-[^\W\d_]{2,})*[.,;:!?…"')\]}“”»]*""")
_THRICE = re.compile(r"([^\W\d_])\1\1", re.I)
_LETTER = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"(.)\1{3,}", re.S)


def character_model(df: DataFrame, text: str = "text") -> tuple[dict[int, float], dict[int, float]]:
    """Costs of a letter after two others, by packed trigram, and of an unknown one after two.

    Trigrams are counted over all words of all rows; the ``TRIGRAMS`` most frequent are held.
    """
    letters = df.sparkSession.sparkContext.broadcast(letter_table())
    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.lit("").alias("lang"))
    counts = gram_counts(rows, letters).select("gram", "n")
    held = counts.orderBy(F.desc("n"), "gram").limit(TRIGRAMS).toArrow()
    grams, n = held.column("gram").to_numpy(), held.column("n").to_numpy()
    # A word's first letter follows the edge alone, which the trigrams have once.
    edge, middle = grams >> 42, grams >> 21 & 0x1FFFFF
    first = edge == 32
    starts, at = np.unique(middle[first], return_inverse=True)
    grams = np.concatenate([grams, (32 << 42) | (32 << 21) | starts])
    n = np.concatenate([n, np.bincount(at, weights=n[first]).astype(np.int64)]) if first.any() else n
    contexts, at = np.unique(grams >> 21, return_inverse=True)
    sums = np.bincount(at, weights=n) if len(n) else np.zeros(0)
    smooth = 0.1
    total = sums + smooth * 64
    costs = np.log(total[at]) - np.log(n + smooth) if len(n) else np.zeros(0)
    return (dict(zip(grams.tolist(), costs.tolist(), strict=True)),
            dict(zip(contexts.tolist(), (np.log(total) - math.log(smooth)).tolist(), strict=True)))


def decode(token: str, costs: dict[int, float], unknown: dict[int, float]) -> str:
    """The most probable letters behind a token, by Viterbi's algorithm over its lattice.

    States are the last two letters. Runs of more than three equal characters count as three, as
    the rest can only be repetition. Ties go to the smaller letters.
    """
    token = _RUN.sub(r"\1\1\1", token.lower())
    never = math.log(64)
    paths = {(32, 32): (0.0, None)}  # last letters: cost, letters so far as a linked list
    before = ""
    for character in token:
        if _LETTER.match(character):
            options = [(character, 0.0)] + ([("", AGAIN)] if character == before else [])
        else:
            options = [(x, SIGN) for x in LEET.get(character, "")] + [
                ("", NUMBER if character.isdecimal() else BETWEEN)]
        before = character
        reached = {}
        for (one, two), (cost, path) in sorted(paths.items(), key=lambda p: p[0]):
            context = one << 21 | two
            for letter, price in options:
                if letter:
                    code = ord(letter)
                    price += costs.get(context << 21 | code, unknown.get(context, never))
                    state, way = (two, code), (path, letter)
                else:
                    state, way = (one, two), path
                if state not in reached or cost + price < reached[state][0]:
                    reached[state] = cost + price, way
        paths = reached

    def whole(state: tuple[int, int]) -> float:
        context = state[0] << 21 | state[1]
        return paths[state][0] + costs.get(context << 21 | 32, unknown.get(context, never))

    path, letters = paths[min(sorted(paths), key=whole)][1], []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


class Restorer:
    """Restores texts in one task; remembers tokens."""

    def __init__(self, costs: dict[int, float], unknown: dict[int, float]):
        self.costs, self.unknown = costs, unknown
        self.known: dict[str, str] = {}

    def token(self, token: str) -> str:
        if _PLAIN.fullmatch(token) and not _THRICE.search(token) or not _LETTER.search(token):
            return token
        if len(token) <= DECODED:
            return decode(token, self.costs, self.unknown)
        # Longer ones piece by piece, so that the work stays in proportion.
        return "".join(decode(token[i:i + DECODED], self.costs, self.unknown)
                       for i in range(0, len(token), DECODED))

    def spaced(self, letters: str) -> str:
        """Single characters with spaces between them, as one token."""
        joined = letters.replace(" ", "")
        return decode(joined, self.costs, self.unknown) if len(joined) <= DECODED else joined

    def __call__(self, text: str) -> str:
        """The text with every disguised token restored, white space as single spaces."""
        tokens = _SPACED.sub(lambda m: self.spaced(m[0]), text).split()
        if len(self.known) > CACHE:
            self.known.clear()
        for token in set(tokens).difference(self.known):
            self.known[token] = self.token(token)
        return " ".join(map(self.known.__getitem__, tokens))


_BASE = 0x9E3779B97F4A7C15 | 1


def features(texts: list[str], letters: np.ndarray, used: np.ndarray | None = None
             ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (index of the text, place of a feature), each pair once in its chunk; only the
    places that ``used`` marks, if given.

    Features are the lower-cased runs of letters, and the first and last ``EDGE`` letters of each.
    A text is whole in its chunk.
    """
    inverse = pow(_BASE, -1, 1 << 64)
    for first, group in slices(texts):
        joined = " \0 ".join(t.lower().replace("\0", " ") for t in group)
        codes = np.frombuffer(f" {joined} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        text = np.cumsum(codes == 0)
        inside = letters[codes]
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        powers = np.cumprod(np.full(len(codes), _BASE, np.uint64))
        backs = np.cumprod(np.full(len(codes), inverse, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers)])
        found = []
        long = ends - starts > EDGE
        for seed, (lo, hi) in enumerate((
                (starts, ends), (starts[long], starts[long] + EDGE), (ends[long] - EDGE, ends[long]))):
            hashed = mix((sums[hi] - sums[lo]) * backs[lo], seed) % np.uint64(PLACES)
            place, owner = hashed.astype(np.int64), text[lo].astype(np.int64)
            if used is not None:
                own = used[place]
                place, owner = place[own], owner[own]
            found.append(owner * PLACES + place)
        pairs = np.unique(np.concatenate(found))
        yield pairs // PLACES + first, pairs % PLACES


def _featured(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, unknown, packed = model.value
        restorer, table = Restorer(costs, unknown), np.unpackbits(packed).view(bool)
        for batch in parts(batches):
            texts = [restorer(t or "") for t in batch.column("text").to_pylist()]
            chunks = list(features(texts, table))
            owner, place = (np.concatenate([c[i] for c in chunks]) for i in (0, 1))
            offsets = np.searchsorted(owner, np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(place.astype(np.int32)))],
                names=["toxic", "places"])
    return run


def fit(owner: np.ndarray, place: np.ndarray, labels: np.ndarray, n_features: int
        ) -> tuple[np.ndarray, float]:
    """Weights and constant of a logistic regression on present features, by gradient steps."""
    n = len(labels)
    share = (labels.sum() + 0.5) / (n + 1)
    weights, constant = np.zeros(n_features), math.log(share / (1 - share))
    mean, square = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, ROUNDS + 1):
        z = np.bincount(owner, weights=weights[place], minlength=n) + constant
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        gradient = np.append(np.bincount(place, weights=error[owner], minlength=n_features)
                             + RIDGE * weights, error.sum()) / n
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights, constant = weights - move[:-1], constant - move[-1]
    return weights, float(constant)


def learn(documents: DataFrame, labels: DataFrame) -> tuple:
    """A model from ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic: 0 or 1).

    Every text teaches the language model; labels matter only for the weights. Those are fitted on
    the ``SAMPLE`` rows of ``labels`` whose doc_id comes first by a hash, which are broadcast, and on the
    features that tell most. Rows without doc_id or label teach nothing. Without rows of both labels
    the score of every text is the share of toxic rows, 0 without any.
    """
    spark = documents.sparkSession
    costs, unknown = character_model(documents)
    model = spark.sparkContext.broadcast((costs, unknown, letter_table()))
    chosen = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(
        "doc_id", F.col("toxic").cast("int")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE)
    chosen = written(chosen, "toxicity-labels")
    rows = written(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(
        _featured(model), "toxic int, places array<int>"), "toxicity-features")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < positive < n:
        return costs, unknown, np.zeros(PLACES, np.float32), positive / n if n else 0.0, None
    # How far the share of toxic rows among those with a feature is from that of all, in deviations.
    share = positive / n
    counted = rows.select("toxic", F.explode("places").alias("place")).groupBy("place").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("t"))
    told = counted.orderBy(
        F.desc(F.abs(F.col("t") - F.col("n") * share) / F.sqrt("n")), "place").limit(FEATURES)
    places = np.sort(told.select("place").toArrow().column("place").to_numpy())
    keep = spark.sparkContext.broadcast(places)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("places")
            flat, owner = lists.flatten().to_numpy(), np.repeat(
                np.arange(len(lists)), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(keep.value, flat), len(keep.value) - 1)
            own = keep.value[at] == flat
            offsets = np.searchsorted(owner[own], np.arange(len(lists) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(at[own].astype(np.int32)))], names=["toxic", "places"])

    # At most SAMPLE rows, each with at most FEATURES numbers.
    sample = rows.mapInArrow(narrowed, rows.schema).toArrow().combine_chunks()
    lists = sample.column("places").chunk(0)
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    found, constant = fit(owner, lists.flatten().to_numpy(),
                          sample.column("toxic").to_numpy().astype(float), len(places))
    weights = np.zeros(PLACES, np.float32)
    weights[places] = found
    return costs, unknown, weights, share, constant


def score(df: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """Every row of ``df`` with ``score`` from 0 to 1 and ``predicted``, 1 from a score of one half.

    Only the text is looked at. Null and empty texts have the score of a text without known
    features. Rows, repeated or not, and other columns stay; the two names must not be among them.
    """
    if clash := {"score", "predicted"} & set(df.columns):
        raise ValueError(f"the input already has {', '.join(sorted(clash))}")
    shared = df.sparkSession.sparkContext.broadcast((*model, letter_table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, unknown, weights, share, constant, packed = shared.value
        restorer, table = Restorer(costs, unknown), np.unpackbits(packed).view(bool)
        used = weights != 0
        for batch in parts(batches):
            if constant is None:
                scores = np.full(len(batch), share)
            else:
                texts = [restorer(t or "") for t in batch.column(text).to_pylist()]
                z = np.full(len(batch), constant)
                for owner, place in features(texts, table, used):
                    z += np.bincount(owner, weights=weights[place], minlength=len(batch))
                scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"])

    return df.mapInArrow(run, T.StructType([
        *df.schema.fields, T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType())]))
