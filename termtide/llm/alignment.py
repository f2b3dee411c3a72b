"""Alignment of two tokenizers: a byte-level one (A) and one of pieces with byte fallback (B).

Both cut the same bytes. Sorting all tokens of both by start, with the running maximum of their ends,
a group breaks where a start reaches that maximum: there both tokenizers end a token. Tokens that
overlap are expanded into pairs within their group, and linked if they end together.

A single space between two visible characters always begins a token of both, so a text falls into
segments there whose alignments stand side by side. A task aligns every distinct segment once, many
at a time, and remembers it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termtide.llm.common import parts, slices, written

# Segments that a worker remembers once and again, and the longest of them.
CACHE, LONGEST = 80_000, 100
# Characters that are aligned at a time.
SLICE = 1 << 17
# Pairs whose counts every task holds, the most frequent ones. The others are joined.
HELD = 1 << 20
# Distinct pairs that a task counts before it hands them over.
COUNTED = 1 << 20

_MARK = "▁"
_CUT = re.compile(rf"(?<=[^\s{_MARK}]) (?=[^\s{_MARK}])")


def is_visible(segment: str) -> bool:
    """Whether ``segment`` begins and ends as cuts between segments ask for."""
    return bool(segment) and not (
        segment[0].isspace() or segment[-1].isspace() or segment[0] == _MARK or segment[-1] == _MARK)


def byte_letters() -> dict[str, int]:
    """The character by which byte-level vocabularies write every byte: itself if it is a visible
    one of Latin-1, otherwise the next free one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)).difference(visible))
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def coalesce(starts: np.ndarray, ends: np.ndarray, side: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): tokens sorted by start, and the number of the group of each in that order."""
    order = np.lexsort((side, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = starts[order][1:] >= reached[:-1]
    return order, np.concatenate([np.zeros(min(1, len(order)), int), np.cumsum(breaks)])


def overlaps(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a token of A and one of B that share a byte, by their places."""
    first = np.searchsorted(ends_b, starts_a, "right")
    n = np.searchsorted(starts_b, ends_a, "left") - first
    a = np.repeat(np.arange(len(n)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return a, b


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, counts.sum()), counts


class Aligner:
    """Both tokenizers and the segments aligned so far, for one worker."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads hold memory
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        names = {i: name for name, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(map(letters.__getitem__, names[i])) if i in names else b""
                        for i in range(max(names) + 1)]
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace(_MARK, " ").encode() for i in range(len(self.b))]
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64, len(x))
                                      for x in (self.a_bytes, self.b_bytes))
        # A token's decimal id and what follows it: a comma, a bar, a semicolon, or a segment's end.
        self.width = max(len(self.a_bytes), len(self.b_bytes))
        self.written = np.array([f"{i}{end}" for end in ",|;\n" for i in range(self.width)], object)
        self.pair_type = np.int32 if len(self.a_bytes) * len(self.b_bytes) < 2**31 else np.int64
        # By segment: its groups, its linked pairs, and the numbers of tokens in one integer.
        self.known: dict[str, tuple[str | None, bytes, int]] = {}
        self.older: dict[str, tuple[str | None, bytes, int]] = {}

    def _encoded(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast(
            [" " + s for s in segments], add_special_tokens=False)]
        return a, self.b.encode(segments, num_threads=1)

    def add(self, segments: list[str]) -> None:
        """Align new segments; one that either tokenizer changes has no groups (None)."""
        expected = [b" " + s.encode("utf-8", "surrogatepass") for s in segments]
        sizes = np.fromiter(map(len, expected), np.int64, len(expected))
        encoded = []
        for ids, token, size in zip(self._encoded(segments), (self.a_bytes, self.b_bytes),
                                    (self.a_sizes, self.b_sizes), strict=True):
            flat, n = _flat(ids)
            owner = np.repeat(np.arange(len(n)), n)
            given = np.bincount(owner, weights=size[flat], minlength=len(n)).astype(np.int64)
            whole = b"".join(map(token.__getitem__, flat.tolist()))
            if not (given == sizes).all() or whole != b"".join(expected):
                good = [b"".join(map(token.__getitem__, x)) == e
                        for x, e in zip(ids, expected, strict=True)]
                self.known.update((s, (None, b"", 0)) for s, ok in zip(segments, good, strict=True)
                                  if not ok)
                rest = [s for s, ok in zip(segments, good, strict=True) if ok]
                if rest:
                    self.add(rest)
                return
            encoded.append((flat, n, owner))
        (a_ids, n_a, owner_a), (b_ids, n_b, owner_b) = encoded
        ends_a, ends_b = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        starts_a, starts_b = ends_a - self.a_sizes[a_ids], ends_b - self.b_sizes[b_ids]

        side = np.repeat([0, 1], [len(a_ids), len(b_ids)])
        starts, ends = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
        order, group = coalesce(starts, ends, side)
        order = order[np.argsort(group * 2 + side[order], kind="stable")]  # A before B in a group
        owner = np.concatenate([owner_a, owner_b])[order]
        ids, of_b = np.concatenate([a_ids, b_ids])[order], side[order]
        mark = np.full(len(ids), 3)  # the groups are sorted still
        mark[:-1] = np.where(owner[1:] != owner[:-1], 3, np.where(
            group[1:] != group[:-1], 2, of_b[1:] != of_b[:-1]))
        groups = "".join(self.written[ids + mark * self.width].tolist()).split("\n")

        x, y = overlaps(starts_a, ends_a, starts_b, ends_b)
        together = ends_a[x] == ends_b[y]
        x, y = x[together], y[together]
        pairs = (a_ids[x] * len(self.b_bytes) + b_ids[y]).astype(self.pair_type).tobytes()
        n_links = np.bincount(owner_a[x], minlength=len(segments))
        at = np.concatenate([[0], np.cumsum(n_links) * np.dtype(self.pair_type).itemsize]).tolist()
        links = [pairs[lo:hi] for lo, hi in zip(at, at[1:], strict=False)]
        both = (n_a + (n_b << 32)).tolist()
        self.known.update(zip(segments, zip(groups, links, both, strict=False), strict=True))

    def segments(self, text: str) -> list[str]:
        """The segments of a text. What is known is visible at both ends, so a plain split is right
        if all words are known or visible."""
        words = text.split(" ")
        if all(map(is_visible, set(words).difference(self.known))):
            return words
        return _CUT.split(text)

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, int, str | None, bytes]]:
        """(tokens of A, tokens of B, groups, linked pairs) of each of a few texts."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        split = [self.segments(t) if t else [] for t in texts]
        missing = set(chain.from_iterable(split)).difference(self.known)
        again = [s for s in missing if s in self.older]
        self.known.update((s, self.older[s]) for s in again)
        new, size, forget = [], 0, []
        for segment in missing.difference(again):
            new.append(segment)
            size += len(segment)
            if len(segment) > LONGEST or not is_visible(segment):
                forget.append(segment)
            if size > SLICE:
                self.add(new)
                new, size = [], 0
        if new:
            self.add(new)
        for segments in split:
            if not segments:
                yield 0, 0, "", b""
                continue
            groups, links, both = zip(*map(self.known.__getitem__, segments), strict=True)
            if None in groups:
                yield 0, 0, None, b""
            else:
                n = sum(both)
                yield n & 0xFFFFFFFF, n >> 32, ";".join(groups), b"".join(links)
        for segment in forget:
            del self.known[segment]


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of whole segments, of about ``SLICE`` characters if it has so short ones."""
    start = 0
    while len(text) - start > SLICE:
        cut = _CUT.search(text, start + SLICE)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.end()
    yield text[start:]


def aligned(aligner: Aligner, texts: Iterable[str | None], whole: bool
            ) -> Iterator[tuple[int, int, str, bytes]]:
    """(tokens of A, tokens of B, groups or their SHA-256, linked pairs) of every text."""
    for _, group in slices(texts, SLICE):
        if sum(map(len, group)) <= 2 * SLICE:
            for n_a, n_b, groups, links in aligner(group):
                if not whole and groups:
                    groups = hashlib.sha256(groups.encode()).hexdigest()
                yield n_a, n_b, groups or "", links
            continue
        for text in group:  # at most one long text, and few short ones before it
            n_a, n_b, parts_, links, digest = 0, 0, [], [], hashlib.sha256()
            for i, piece in enumerate(_pieces(text)):
                (a, b, groups, pairs), = aligner([piece])
                if text and groups is None:
                    n_a, n_b, parts_, links = 0, 0, [], []
                    break
                n_a, n_b = n_a + a, n_b + b
                links.append(pairs)
                if whole:
                    parts_.append(groups)
                else:
                    digest.update((";" + groups if i else groups).encode())
            groups = ";".join(parts_) if whole else digest.hexdigest() if n_a else ""
            yield n_a, n_b, groups, b"".join(links)


def _readers(df: DataFrame, a_path: str, b_path: str):
    """A function for tasks that gives the aligner. The vocabularies, whose size does not depend
    on the data, are read by the driver and broadcast; a worker keeps its aligner as long as its copy of
    the broadcast, so that its next task knows the segments of the last."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        shared = df.sparkSession.sparkContext.broadcast((a.read(), b.read(), []))

    def get() -> Aligner:
        a_json, b_model, made = shared.value
        if not made:
            made.append(Aligner(a_json, b_model))
        return made[0]
    return get


_LINKS = T.ArrayType(T.LongType())


def _link_lists(links: list[bytes], kind) -> pa.ListArray:
    size = np.dtype(kind).itemsize
    offsets = np.zeros(len(links) + 1, np.int32)
    np.cumsum([len(x) // size for x in links], out=offsets[1:])
    values = np.frombuffer(b"".join(links), kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Every row of ``df`` with n_a, n_b, ``groups`` and ``links``.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``: ids of A and of B, group by group. ``links`` holds a
    number ``a * size of B's vocabulary + b`` for every token of A and of B that end together. Null and
    empty texts, and those that a tokenizer does not give back as a space and the text, have no
    tokens: zeros, '' and no links. Strings of special tokens are plain text. Rows, repeated or
    not, and other columns stay; the four names must not be columns of ``df``. A text is read in
    pieces of ``SLICE`` characters, but for runs that have no cut.
    """
    if clash := {"n_a", "n_b", "groups", "links"} & set(df.columns):
        raise ValueError(f"the input already has {', '.join(sorted(clash))}")
    get = _readers(df, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = get()
        for batch in parts(batches):
            found = list(aligned(aligner, batch.column(text).to_pylist(), True))
            n_a, n_b, groups, links = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()),
                 pa.array(groups, pa.string()), _link_lists(links, aligner.pair_type)],
                names=[*batch.schema.names, "n_a", "n_b", "groups", "links"])

    return df.mapInArrow(run, T.StructType([
        *df.schema.fields, T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()),
        T.StructField("groups", T.StringType()), T.StructField("links", _LINKS)]))


def _merged(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, n = (np.concatenate(x) for x in zip(*counted, strict=True))
    both, at = np.unique(pairs, return_inverse=True)
    summed = np.zeros(len(both), np.int64)
    np.add.at(summed, at, n)
    return both, summed


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair, n of the links of a task, counted a few rows at a time."""
    counted, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

    def counts() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in counted[0]], names=["pair", "n"])

    for batch in parts(batches):
        counted.append(np.unique(batch.column("links").flatten().to_numpy(), return_counts=True))
        size += len(counted[-1][0])
        if size > COUNTED:
            counted = [_merged(counted)]
            size = 0
            if len(counted[0][0]) > COUNTED:
                yield counts()
                counted = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    counted = [_merged(counted)]
    yield counts()


def pair_counts(links: DataFrame, b_size: int) -> DataFrame:
    """pair, n, best: how often every pair is linked, and whether no pair with its B id is more
    often."""
    counts = links.select("links").mapInArrow(_summed, "pair long, n long").groupBy("pair").agg(
        F.sum("n").alias("n"))
    counts = written(counts.withColumn("b", F.col("pair") % b_size), "alignment-counts")
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    return counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _looked_up(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in parts(batches):
            links = batch.column("links")
            flat = links.flatten().to_numpy()
            owner = np.repeat(np.arange(len(links)), links.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(pairs, flat), max(len(pairs) - 1, 0))
            held = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
            sums, bests = np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
            np.add.at(sums, owner[held], n[at[held]])
            np.add.at(bests, owner[held], best[at[held]])
            offsets = np.concatenate([[0], np.cumsum(
                np.bincount(owner[~held], minlength=len(links)))]).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[~held]))
            names = ["uid", "doc_id", "n_a", "n_b", "groups_sha256"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), links.value_lengths().cast(pa.int64()),
                 pa.array(bests), pa.array(sums), rare],
                names=[*names, "n_links", "n_best", "count_sum", "rare"])
    return run


def digests(df: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``df``.

    A pair's count is the number of its links in all rows; n_best is the number of a row's links
    whose count is the highest of their B id, count_sum the sum over its links. The digest is that of
    ``groups`` as in ``align``, '' without tokens. Null, empty and repeated rows as there.
    """
    get = _readers(df, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = get(), TaskContext.get().partitionId() << 36
        for batch in parts(batches, 64):
            found = list(aligned(aligner, batch.column("text").to_pylist(), False))
            n_a, n_b, groups, links = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number, number + len(batch))), batch.column("doc_id"),
                 pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()),
                 pa.array(groups, pa.string()), _link_lists(links, aligner.pair_type)],
                names=["uid", "doc_id", "n_a", "n_b", "groups_sha256", "links"])
            number += len(batch)

    rows = written(df.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "uid long, doc_id long, n_a long, n_b long, groups_sha256 string, links array<long>"),
        "alignment")
    import sentencepiece

    b_size = len(sentencepiece.SentencePieceProcessor(model_file=b_path))
    counts = written(pair_counts(rows, b_size), "alignment-pairs")
    # The most frequent pairs are looked up in place, so those joined are no hot keys.
    held = counts.orderBy(F.desc("n"), "pair").limit(HELD).orderBy("pair").toArrow()
    shared = df.sparkSession.sparkContext.broadcast(tuple(
        held.column(c).to_numpy() for c in ("pair", "n", "best")))
    found = written(rows.mapInArrow(
        _looked_up(shared),
        "uid long, doc_id long, n_a long, n_b long, groups_sha256 string, n_links long, n_best long, "
        "count_sum long, rare array<long>"), "alignment-rows")
    added = found.select("uid", F.explode("rare").alias("pair")).join(counts, "pair").groupBy("uid").agg(
        F.sum("n").alias("more"), F.count_if("best").alias("more_best"))
    return found.drop("rare").join(added, "uid", "left").select(
        # Both tokenizers end a token where a group ends, and nowhere else.
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256")
