"""Byte-level BPE encoding and decoding with a bitmap queue over merge ranks.

A pre-token is merged with a queue that has a bucket of positions for every merge rank. A
three-level bitmap marks the buckets in use, so the next rank is three find-first-set steps
away, however long the pre-token is. Positions belong to a linked list of parts; an entry whose
pair has changed since is stale and skipped when it comes up.
"""

from __future__ import annotations

import base64
import heapq
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termtide.llm.common import by_size, freeing, parts

# Bytes of words and pre-tokens that a worker remembers, both together: beyond that the oldest table of
# words goes, and all pre-tokens beyond half of it. Bounds memory, not results.
CACHE, TABLE = 48 << 20, 4 << 20
# Bytes of text that a task cuts into words at once; a longer text is cut alone.
CUT = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file: a base64 token and its rank on every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Positions by merge rank; the lowest rank comes first, within it the leftmost position.

    Two levels of 256-bit words: ``top`` marks the words of ``low`` in use, those mark ranks.
    """

    def __init__(self, ranks: int):
        self.bit = [1 << i for i in range(256)]
        self.low = [0] * ((ranks >> 8) + 1)
        if len(self.low) > 256:
            self.bit = [1 << i for i in range(len(self.low))]

    def merge(self, piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
        """Ids of the parts that are left when no pair of ``piece`` can be merged. The queue is
        empty before and after."""
        bit, low, top, buckets = self.bit, self.low, 0, {}
        n, get = len(piece), ranks.get
        after = list(range(1, n + 2))  # start of the following part; the last part ends at n
        before = list(range(-1, n))
        pending = [None] * (n + 1)  # rank of the pair that starts here, as it is now
        for left in range(n - 1):
            rank = get(piece[left:left + 2])
            if rank is not None:
                pending[left] = rank
                if rank in buckets:
                    buckets[rank].append(left)  # ascending, so still a heap
                else:
                    buckets[rank] = [left]
                    high = rank >> 8
                    low[high] |= bit[rank & 255]
                    top |= bit[high]
        while top:
            high = (top & -top).bit_length() - 1
            word = low[high]
            rank = high << 8 | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                left = heapq.heappop(bucket)
            else:
                left = bucket[0]
                del buckets[rank]
                word &= word - 1
                low[high] = word
                if not word:
                    top &= top - 1
            if pending[left] != rank:
                continue  # stale: the pair here has changed or is gone
            right = after[left]
            end = after[left] = after[right]
            pending[right] = pending[left] = None
            if end < n:
                before[end] = left
                pending[left] = rank = get(piece[left:after[end]])
                if rank is not None:
                    if rank in buckets:
                        heapq.heappush(buckets[rank], left)
                    else:
                        buckets[rank] = [left]
                        high = rank >> 8
                        low[high] |= bit[rank & 255]
                        top |= bit[high]
            left = before[left]
            if left >= 0:
                pending[left] = rank = get(piece[left:end])
                if rank is not None:
                    if rank in buckets:
                        heapq.heappush(buckets[rank], left)
                    else:
                        buckets[rank] = [left]
                        high = rank >> 8
                        low[high] |= bit[rank & 255]
                        top |= bit[high]
        ids, start = [], 0
        while start < n:
            ids.append(ranks[piece[start:after[start]]])
            start = after[start]
        return tuple(ids)


class Encoder:
    """Encodes texts, remembering the ids of pre-tokens and of words, as 32-bit integers.

    A space between two characters that are not white space always begins a pre-token, so
    what lies between such spaces is encoded on its own and remembered. Texts are cut at spaces with
    Arrow, many at a time, and only distinct words that are not remembered are encoded.

    ``memory``: pre-tokens with their ids, and by number, oldest first, tables of words and ids in
    Arrow's arrays, which take a quarter of what a dictionary does.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: tuple[dict, dict]):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values(), default=0))
        self.pieces, self.tables = memory
        self.held = sum(map(_size, self.pieces.items()))

    @property
    def words(self) -> list[str]:
        return [word for words, _ in self.tables.values() for word in words.to_pylist()]

    def merged(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = self.queue.merge(data, self.ranks) if whole is None else (whole,)
        return array("i", ids).tobytes()

    def piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            if self.held > CACHE // 2:
                self.pieces.clear()
                self.held = 0
            known = self.pieces[piece] = self.merged(piece)
            self.held += _size((piece, known))
        return known

    def by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.find(text)))

    def word(self, word: str, letters: dict[str, bytes]) -> bytes | None:
        """Ids of a space and a word; None next to other white space, where the pattern needs
        its surroundings. Letters alone are one pre-token, a comma or full stop after them another;
        ``letters`` has the ids of those met.
        """
        stem = _letters(word)
        if stem:
            known = letters.get(stem)
            if known is None:
                known = letters[stem] = self.merged(" " + stem)
            return known if stem == word else known + self.piece(word[-1])
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        return self.by_pattern(" " + word)

    def remembered(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Ids of those of the distinct ``words`` that are remembered; and before, the place of every
        word's among them, or -1."""
        place, found, n = np.full(len(words), -1), [pa.array([], pa.large_binary())], 0
        for names, ids in self.tables.values():
            at = pc.index_in(names, value_set=words)
            found.append(ids.filter(at.is_valid()))
            place[at.drop_null().to_numpy()] = np.arange(n, n + len(found[-1]))
            n += len(found[-1])
        return place, pa.concat_arrays(found)

    def remember(self, ids: dict[str, bytes | None]) -> None:
        last = next(reversed(self.tables), 0)
        table = pa.array(ids.keys(), pa.string()), pa.array(ids.values(), pa.large_binary())
        if last and _bytes(self.tables[last]) + _bytes(table) <= TABLE:
            table = tuple(map(pa.concat_arrays, zip(self.tables[last], table, strict=True)))
        else:
            last += 1
        self.tables[last] = table

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Ids of the distinct ``words`` (null: see ``word``), each after a space; before, the place of
        every word's among them."""
        while self.tables and self.held + sum(map(_bytes, self.tables.values())) > CACHE:
            del self.tables[next(iter(self.tables))]
        place, ids = self.remembered(words)
        fresh = words.filter(pa.array(place < 0)).to_pylist()
        if fresh:
            stems = list({stem for word in fresh if (stem := _letters(word)) and stem != word})
            at, known = self.remembered(pa.array(stems, pa.string()))
            known = known.to_pylist()
            letters = {stem: known[i] for stem, i in zip(stems, at, strict=True) if i >= 0}
            old = set(letters)
            found = {word: self.word(word, letters) for word in fresh}
            place[place < 0] = np.arange(len(ids), len(ids) + len(found))
            ids = pa.concat_arrays([ids, pa.array(found.values(), pa.large_binary())])
            self.remember(found | {stem: x for stem, x in letters.items() if stem not in old})
        return place, ids

    def lists(self, texts: pa.Array) -> pa.ListArray:
        """The ids of every text; none of a null one. What belongs to one text is held at once."""
        texts = texts.cast(pa.string()).fill_null("")
        cut = pc.split_pattern(texts, " ")
        sizes = pc.list_value_length(cut).to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        words = cut.flatten()
        first = np.zeros(len(words), bool)
        first[starts[:-1]] = True
        firsts = words.filter(pa.array(first)).to_pylist()
        rest = words.filter(pa.array(~first)).dictionary_encode()
        place, ids = self.ids_of(rest.dictionary)
        rest = place[rest.indices.to_numpy()]
        # Texts with a space beside other white space are encoded whole, in the place of their first word.
        whole = np.array([n > 1 and (not x or x[-1].isspace())
                          for x, n in zip(firsts, sizes.tolist(), strict=True)], bool)
        owner = np.repeat(np.arange(len(texts)), sizes - 1)
        whole[owner[ids.is_null().to_numpy(zero_copy_only=False)[rest]]] = True
        rest[whole[owner]] = len(ids) + len(texts)  # nothing
        entire = iter(texts.filter(pa.array(whole)).to_pylist())
        heads = [self.by_pattern(next(entire) if w else x)
                 for x, w in zip(firsts, whole.tolist(), strict=True)]
        rows = np.empty(len(words), np.int64)
        rows[first] = np.arange(len(ids), len(ids) + len(texts))
        rows[~first] = rest
        found = pa.concat_arrays([ids, pa.array([*heads, b""], pa.large_binary())]).take(pa.array(rows))
        _, ends, data = found.buffers()
        ends = np.frombuffer(ends, np.int64)[:len(found) + 1]
        return pa.ListArray.from_arrays(
            pa.array((ends[starts] // 4).astype(np.int32)),
            pa.array(np.frombuffer(data, np.int32, ends[-1] // 4) if len(data) else np.empty(0, np.int32)))

    def __call__(self, text: str) -> bytes:
        return self.lists(pa.array([text], pa.string())).flatten().to_numpy().tobytes()


def _size(entry: tuple[str, bytes]) -> int:
    """Bytes that a dictionary needs for an entry, about."""
    return sum(map(sys.getsizeof, entry)) + 48


def _bytes(table: tuple[pa.Array, pa.Array]) -> int:
    return sum(column.nbytes for column in table)


def _letters(word: str) -> str:
    """``word`` without a comma or full stop at its end, if only letters are left; else empty."""
    stem = word[:-1] if word[-1:] in (",", ".") else word
    return stem if stem.isalpha() else ""


def _by_id(ranks: dict[bytes, int]) -> pa.Array:
    tokens = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, pa.large_binary())


def _decoded(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The tokens of every list joined, as binary; ``tokens`` by their id."""
    joined = tokens.take(ids.values)
    _, ends, data = joined.buffers()
    ends = np.frombuffer(ends, np.int64)[ids.offsets.to_numpy()]
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), data]).cast(pa.binary())


def _with_columns(df: DataFrame, columns: dict[str, T.DataType]) -> T.StructType:
    if clash := columns.keys() & set(df.columns):
        raise ValueError(f"the input already has {', '.join(sorted(clash))}")
    return T.StructType([*df.schema.fields, *(T.StructField(*c) for c in columns.items())])


_IDS = T.ArrayType(T.IntegerType())


def _encoder(df: DataFrame, ranks_path: str, pattern: str):
    # The two dictionaries are a worker's memory, which lives as long as its copy of the broadcast.
    shared = df.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), ({}, {})))
    return lambda: Encoder(shared.value[0], pattern, shared.value[1])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text",
           output: str = "token_ids") -> DataFrame:
    """Every row of ``df`` with the token ids of its whole text.

    Null and empty texts have no ids (an empty array). Strings that name special tokens are
    ordinary text. Rows, other columns and repeated rows stay as they are. ``output`` must not be a
    column of ``df`` yet. The vocabulary is read by the driver and broadcast; its size is that
    of the file, whatever the data.
    """
    make = _encoder(df, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in by_size(batches, CUT, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, encoder.lists(batch.column(text))],
                                             names=[*batch.schema.names, output])
            pa.default_memory_pool().release_unused()  # what a slice needed, else kept beside the next

    return df.mapInArrow(freeing(run), _with_columns(df, {output: _IDS}))


def _tokens(df: DataFrame, ranks_path: str):
    return df.sparkSession.sparkContext.broadcast(
        {rank: token for token, rank in read_ranks(ranks_path).items()})


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids",
           output: str = "decoded") -> DataFrame:
    """Every row of ``df`` with the bytes that its ids stand for; null ids give null.

    The result is binary, since ids need not end at a character. An unknown id raises.
    """
    tokens = _tokens(df, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = tokens.value.__getitem__
        for batch in parts(batches):
            decoded = [b"".join(map(token, x.values.to_pylist())) if x.is_valid else None
                       for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())],
                                             names=[*batch.schema.names, output])

    return df.mapInArrow(freeing(run), _with_columns(df, {output: T.BinaryType()}))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text",
               output: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``decode(encode(df))`` in one pass: both columns, without the ids' way out and back."""
    make = _encoder(df, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        by_id = _by_id(encoder.ranks)
        for batch in by_size(batches, CUT, text):
            ids = encoder.lists(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, _decoded(ids, by_id)],
                                             names=[*batch.schema.names, output, decoded])
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(freeing(run), _with_columns(df, {output: _IDS, decoded: T.BinaryType()}))


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the bytes decoded from them."""
    return round_trip(df.select("doc_id", "text"), ranks_path, pattern).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256)
        .alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
