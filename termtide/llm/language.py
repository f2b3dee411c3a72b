"""Language identification by bit-sliced n-gram filters.

Learning counts the letter trigrams of every language over all labelled rows and keeps those that
are frequent in it. All languages share one Bloom filter whose slots are bit masks over languages:
the conjunction of a trigram's slots names every language that contains it. A text is
decided by the number of its trigrams that each language claims, corrected for the
claims that the filter makes by chance.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termtide.llm.common import freeing, parts, slices, written

UNKNOWN = "und"
# A trigram belongs to a language if it makes up this share of its trigrams, and this share of the
# largest such share among languages. The first bounds the filter: at most 1 / MIN_SHARE
# trigrams a language, whatever the corpus.
MIN_SHARE = 2e-5
MIN_RATIO = 0.2
HASHES = 3
SLOTS_PER_GRAM = 8
SPACE, EDGE = 32, 0


def letter_table() -> np.ndarray:
    """For every code point, whether it is a letter or a mark on one; packed bits."""
    kinds = (unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000))
    return np.packbits(np.fromiter(kinds, bool, 0x110000))


def _pieces(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, str]]:
    """(index, piece) of texts, cut between words where a text is longer than ``limit``.

    The trigrams of the pieces are those of the whole text, as none spans two words.
    """
    for i, text in enumerate(texts):
        start = 0
        while len(text) - start > limit:
            cut = re.compile(r"\s").search(text, start + limit)
            if cut is None:
                break
            yield i, text[start:cut.start()]
            start = cut.end()
        yield i, text[start:]


def trigrams(texts: list[str], letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (index of the text, packed trigram). Words are lower-cased runs of letters with
    one space before and after; a trigram has a letter in its middle."""
    pieces = list(_pieces(texts))
    owners = [i for i, _ in pieces]
    for first, group in slices((p for _, p in pieces)):
        joined = " \0 ".join(t.replace("\0", " ") for t in group)
        codes = np.frombuffer(f" {joined} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[codes]
        edge = codes == EDGE
        after_space = np.empty(len(codes), bool)
        after_space[0] = False
        after_space[1:] = ~(is_letter[:-1] | edge[:-1])
        keep = is_letter | edge | ~after_space
        codes = np.where(is_letter | edge, codes, SPACE)[keep].astype(np.int64)
        if len(codes) < 3:
            continue
        packed = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
        text = np.cumsum(codes == EDGE)[1:-1]
        middle = codes[1:-1]
        whole = (middle > SPACE) & (codes[:-2] != EDGE) & (codes[2:] != EDGE)
        index = np.asarray(owners[first:first + len(group)])
        yield index[text[whole]], packed[whole]


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of integers."""
    x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Filters:
    """Bloom filter whose slots hold one bit per language."""

    def __init__(self, grams: dict[str, list[int]]):
        self.languages = sorted(grams)
        total = sum(map(len, grams.values()))
        self.bits = max(10, math.ceil(math.log2(max(1, total * SLOTS_PER_GRAM))))
        self.words = max(1, -(-len(self.languages) // 64))
        self.slots = np.zeros((1 << self.bits, self.words), np.uint64)
        for i, language in enumerate(self.languages):
            keys = np.asarray(grams[language], np.int64)
            for slot in self._slots(keys):
                self.slots[slot, i >> 6] |= np.uint64(1 << (i & 63))
        fill = [((self.slots[:, i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).mean()
                for i in range(len(self.languages))]
        self.by_chance = np.asarray(fill, float) ** HASHES

    def _slots(self, keys: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 - self.bits)
        return [(mix(keys, seed) >> shift).astype(np.int64) for seed in range(HASHES)]

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """For every trigram the languages that contain it, as bits."""
        first, *rest = self._slots(keys)
        masks = self.slots[first]
        for slot in rest:
            masks &= self.slots[slot]
        return masks

    def predict(self, texts: list[str | None], letters: np.ndarray) -> tuple[list[str], list[float]]:
        n = np.zeros(len(texts))
        counts = np.zeros((len(texts), len(self.languages)))
        for index, keys in trigrams([t or "" for t in texts], letters):
            n += np.bincount(index, minlength=len(texts))
            masks = self.masks(keys)
            for i in range(len(self.languages)):
                has = (masks[:, i >> 6] >> np.uint64(i & 63)) & np.uint64(1)
                counts[:, i] += np.bincount(index, weights=has, minlength=len(texts))
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        corrected = np.clip((counts - n[:, None] * self.by_chance)
                            / np.maximum(1 - self.by_chance, 1e-9), 0, None)
        best = corrected.argmax(axis=1)
        total = corrected.sum(axis=1)
        top = corrected[np.arange(len(texts)), best]
        score = np.where(total > 0, top / np.where(total > 0, total, 1), 0.0)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)]
        return names, np.where(n > 0, np.clip(score, 0, 1), 0.0).tolist()


def _counted(letters) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(letters.value).view(bool)
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in parts(batches, 1024):
            labels = np.asarray(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for language in set(labels):
                own = [t for t, is_own in zip(texts, labels == language, strict=True) if is_own]
                for _, keys in trigrams(own, table):
                    grams, n = np.unique(keys, return_counts=True)
                    if language in sums:
                        old, m = sums[language]
                        grams, at = np.unique(np.concatenate([old, grams]), return_inverse=True)
                        n = np.bincount(at, weights=np.concatenate([m, n])).astype(np.int64)
                    sums[language] = grams, n
        for language, (grams, n) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(grams), pa.string()), pa.array(grams), pa.array(n)],
                names=["lang", "gram", "n"])
    return run


def gram_counts(labelled: DataFrame, letters) -> DataFrame:
    """lang, gram, n over all rows of text and lang; summed in the task before the shuffle."""
    partial = labelled.select("text", "lang").mapInArrow(
        freeing(_counted(letters)), "lang string, gram long, n long")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, *, min_share: float = MIN_SHARE,
          min_ratio: float = MIN_RATIO) -> Filters:
    """Filters for the languages in ``lang``, from all rows of ``labelled`` (text, lang).

    Rows without text or language teach nothing. Only trigrams above ``min_share``
    reach the driver: at most 1 / ``min_share`` a language.
    """
    spark = labelled.sparkSession
    letters = spark.sparkContext.broadcast(letter_table())
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = written(gram_counts(rows, letters), "trigrams")
    # One row a language beside its trigrams; the totals come from the same few counts.
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").select(
        "lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(
        F.col("share") >= min_share)
    largest = shares.groupBy("gram").agg(F.max("share").alias("largest"))
    chosen = shares.join(largest, "gram").where(F.col("share") >= min_ratio * F.col("largest"))
    grams: dict[str, list[int]] = {}
    for row in chosen.select("lang", "gram").toArrow().to_pylist():
        grams.setdefault(row["lang"], []).append(row["gram"])
    return Filters({language: sorted(keys) for language, keys in grams.items()})


def predict(df: DataFrame, filters: Filters, *, text: str = "text", lang: str = "lang_pred",
            score: str = "score", drop_rejected: bool = False) -> DataFrame:
    """Every row of ``df`` with the predicted language and a score from 0 to 1.

    Only the text is looked at. ``und`` and score 0 stand for a null text or one without a letter.
    A text with letters always gets a learned language; score 0 then says that no trigram is known
    (ties go to the first language by code point). Nothing learned: all ``und``.
    ``drop_rejected`` leaves out rows with score 0 and adds no columns.
    """
    sc = df.sparkSession.sparkContext
    model, letters = sc.broadcast(filters), sc.broadcast(letter_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(letters.value).view(bool)
        for batch in parts(batches):
            names, scores = model.value.predict(batch.column(text).to_pylist(), table)
            if drop_rejected:
                yield batch.filter(pa.array([s > 0 for s in scores], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[*batch.schema.names, lang, score])

    if drop_rejected:
        return df.mapInArrow(freeing(run), df.schema)
    if {lang, score} & set(df.columns):
        raise ValueError(f"the input already has a column {lang} or {score}")
    return df.mapInArrow(freeing(run), T.StructType([
        *df.schema.fields, T.StructField(lang, T.StringType()),
        T.StructField(score, T.DoubleType())]))
