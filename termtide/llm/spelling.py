"""Spelling variants: words one edit apart, grouped under their most frequent neighbour.

Two words are near if one inserted, deleted or replaced code point turns one into the other, that is
if their common prefix and common suffix together reach the longer length minus one. Words are
compared in dense tiles: padded matrices of code points, aligned left for prefixes and right for
suffixes, every word of a block against every other one.

Blocks come from windows. A pair whose common prefix ends inside a window ``[lo, hi)`` agrees on
everything before and after it, so only words with equal letters there share a block. The windows of
a word are disjoint, so a pair is found in exactly one of them. A block of more than ``BLOCK`` words
is cut into two by halving its window; a window of one position holds no more words than there
are letters, so every block ends up small whatever the words, and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termtide.llm.common import ascii_lower, written

# Letters of a word, those of Latin-1 included.
LETTERS = r"A-Za-zÀ-ÿ"
# Windows that a word starts with, and the largest block that is compared as it is.
WINDOWS = 4
BLOCK = 512
# Rows of one task, and cells of one comparison.
TASK_ROWS = 50_000
CELLS = 1 << 22
# A frequent block is looked up under this many keys.
SALTS = 16


def counted_runs(df: DataFrame, *, min_chars: int, min_count: int,
                 drop_one_in: int | None = None) -> DataFrame:
    """``word, n``: the maximal runs of letters in ``text`` with A to Z lower-cased, at least
    ``min_chars`` code points long and found at least ``min_count`` times.

    ``drop_one_in`` damages runs before they are counted: where it divides the CRC-32 of
    ``<doc_id>:<run>``, the code point at that CRC modulo the length is left out. A null doc_id
    is written as nothing; null and empty texts have no runs.
    """
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))
    each = df.select("doc_id", F.explode(runs).alias("run"))
    word = ascii_lower(F.col("run"))
    if drop_one_in:
        each = each.select("doc_id", word.alias("run"))
        text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
        each = each.select("run", F.crc32(text.cast("binary")).alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at),
                       F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % drop_one_in == 0, cut).otherwise(F.col("run"))
    counts = each.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= min_chars) & (F.col("n") >= min_count))


def _keyed(rows: DataFrame) -> DataFrame:
    """word, n, c, lo, hi, key: the key hashes all that words of a block have in common.

    A collision puts two blocks together and is harmless, as pairs are verified.
    """
    before = F.expr("left(word, lo)")
    after = F.expr("right(word, greatest(c - hi, 0))")
    return rows.select("word", "n", "c", "lo", "hi",
                       F.xxhash64("c", "lo", before, F.lit("|"), after).alias("key"))


def _windows(words: DataFrame) -> DataFrame:
    """Every word in class ``c`` of its own length and of one less; class ``c`` compares words
    of ``c`` letters with each other and with those of ``c + 1``."""
    classes = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("c")
    parts = F.explode(F.sequence(F.lit(0), F.lit(WINDOWS - 1))).alias("i")
    cut = words.select("word", "n", classes).select("word", "n", "c", parts)
    return _keyed(cut.select(
        "word", "n", "c", F.expr(f"i * (c + 1) div {WINDOWS}").cast("int").alias("lo"),
        F.expr(f"(i + 1) * (c + 1) div {WINDOWS}").cast("int").alias("hi")).where("lo < hi"))


def _halves(rows: DataFrame) -> DataFrame:
    middle = F.expr("(lo + hi) div 2").cast("int")
    both = F.explode(F.array(
        F.struct(F.col("lo").alias("lo"), middle.alias("hi")),
        F.struct(middle.alias("lo"), F.col("hi").alias("hi")))).alias("half")
    return _keyed(rows.select("word", "n", "c", both).select("word", "n", "c", "half.lo", "half.hi"))


def _blocks(words: DataFrame) -> Iterator[DataFrame]:
    """Tables of rows whose blocks have at most ``BLOCK`` words, or windows of one position."""
    rows = written(_windows(words), "spelling-windows")
    while True:
        sizes = rows.groupBy("key").agg(
            F.count("*").alias("size"), F.max(F.col("hi") - F.col("lo")).alias("width"))
        large = written(sizes.where((F.col("size") > BLOCK) & (F.col("width") > 1)).select("key"),
                        "spelling-large")
        if large.isEmpty():
            yield rows
            return
        # Rows of one key are dealt over several places, so a very frequent one is no hot key.
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)))
        keys = large.withColumn("salt", F.explode(F.sequence(
            F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        yield salted.join(keys, ["key", "salt"], "left_anti").drop("salt")
        cut = salted.join(keys, ["key", "salt"], "left_semi").drop("salt")
        # A collision may have put a window of one position beside a larger one.
        yield cut.where("hi - lo <= 1")
        rows = written(_halves(cut.where("hi - lo > 1")), "spelling-windows")


def _matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words of ``width - 1`` or ``width`` letters, aligned left, and right to left."""
    left = np.zeros((len(words), width), np.uint32)
    right = np.zeros((len(words), width), np.uint32)
    for length in (width - 1, width):
        own = [i for i, w in enumerate(words) if len(w) == length]
        if own and length:
            codes = np.frombuffer("".join(words[i] for i in own).encode("utf-32-le"), np.uint32)
            codes = codes.reshape(len(own), length)
            left[own, :length] = codes
            right[own, :length] = codes[:, ::-1]
    return left, right


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of every row of ``a`` and every row of ``b``, block by block."""
    differ = a[:, :, None, :] != b[:, None, :, :]
    return np.where(differ.any(-1), differ.argmax(-1), a.shape[-1])


def near_pairs(left: np.ndarray, right: np.ndarray, lengths: np.ndarray, members: np.ndarray,
               lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows one edit apart whose common prefix ends in their block's window.

    ``members`` holds the rows of every block, -1 for none; words of equal longer length are left
    to their own class.
    """
    blocks, size = members.shape
    width = left.shape[1]
    step = max(1, min(size, CELLS // (size * width)))
    together = max(1, CELLS // (step * size * width))
    for first in range(0, blocks, together):
        rows = members[first:first + together]
        for at in range(0, size, step):
            some = rows[:, at:at + step]
            prefix = _common(left[some], left[rows])
            suffix = _common(right[some], right[rows])
            longer = np.maximum(lengths[some][:, :, None], lengths[rows][:, None, :])
            both = np.minimum(lengths[some][:, :, None], lengths[rows][:, None, :])
            window = slice(first, first + together)
            near = (prefix + suffix >= longer - 1) & (both < width)
            near &= (prefix >= lo[window, None, None]) & (prefix < hi[window, None, None])
            near &= (some >= 0)[:, :, None] & (rows >= 0)[:, None, :]
            near &= np.arange(at, at + some.shape[1])[:, None] < np.arange(size)[None, :]
            b, i, j = np.nonzero(near)
            yield some[b, i], rows[b, j]


def _neighbours(table: pa.Table) -> pa.Table:
    """word, near, best_n, best: of every word in the blocks of one task, its near words."""
    words = table.column("word").to_pylist()
    n, c, lo, hi, key = (table.column(x).to_numpy() for x in ("n", "c", "lo", "hi", "key"))
    order = np.lexsort((key, lo, c))
    change = np.flatnonzero(
        (np.diff(key[order]) != 0) | (np.diff(lo[order]) != 0) | (np.diff(c[order]) != 0)) + 1
    starts = np.concatenate([[0], change])
    sizes = np.diff(np.concatenate([starts, [len(order)]]))
    found = []
    kinds = np.stack([c[order[starts]], np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)])
    for kind in np.unique(kinds[:, sizes > 1], axis=1).T:
        own = np.flatnonzero((kinds == kind[:, None]).all(0) & (sizes > 1))
        width, size = int(kind[0]) + 1, int(sizes[own].max())
        places = starts[own, None] + np.arange(size)
        present = np.arange(size) < sizes[own, None]
        rows = np.where(present, order[np.where(present, places, 0)], -1)
        used, members = np.unique(rows[present], return_inverse=True)
        dense = np.full(rows.shape, -1)
        dense[present] = members
        block_words = [words[i] for i in used]
        lengths = np.fromiter(map(len, block_words), int, len(used))
        head = order[starts[own]]
        for i, j in near_pairs(*_matrices(block_words, width), lengths, dense, lo[head], hi[head]):
            found.append((used[i], used[j]))
    first, second = (np.concatenate([p[k] for p in found] or [np.zeros(0, int)]) for k in (0, 1))
    a, b = np.concatenate([first, second]), np.concatenate([second, first])
    # Of the near words of each row the most frequent, then the first in code-point order.
    involved = sorted(set(b.tolist()), key=words.__getitem__)
    rank = np.zeros(len(words), int)
    rank[involved] = np.arange(len(involved))
    by_word = np.lexsort((rank[b], -n[b], a))
    heads, begin, near = np.unique(a[by_word], return_index=True, return_counts=True)
    best = b[by_word][begin]
    return pa.table([
        pa.array([words[i] for i in heads], pa.string()), pa.array(near, pa.int64()),
        pa.array(n[best], pa.int64()), pa.array([words[i] for i in best], pa.string())],
        names=["word", "near", "best_n", "best"])


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best for the words of ``words`` (word, n) that have a near word."""
    found = None
    for rows in _blocks(words):
        rows = written(rows, "spelling-blocks")
        tasks = max(1, -(-rows.count() // TASK_ROWS))
        own = rows.withColumn("task", F.pmod("key", F.lit(tasks))).groupBy("task").applyInArrow(
            _neighbours, "word string, near long, best_n long, best string")
        found = own if found is None else found.unionByName(own)
    best = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.order")).alias("best_n"), F.col("best.word").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: the end of the chain of forms.

    Every round doubles the steps, and a form is more frequent than its word by a factor, so
    a few rounds reach the end.
    """
    links = written(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")),
                    "spelling-links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(links.join(further, "root", "left"), "spelling-links")
        if moved.where("next IS NOT NULL").isEmpty():
            return links
        links = moved.select("word", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame, *, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n).

    ``form`` is the near word with the largest ``n`` (ties: the first in code-point order), if that is
    at least ``factor`` (2 or more) times the word's own, else null as ``form_n``; ``root`` follows forms to the
    last, and is the word itself without one. ``n_near`` counts near words. Words are distinct and
    not null, as counting leaves them; an empty table gives an empty one.
    """
    words = written(words.select("word", "n"), "spelling-words")
    near = words.join(neighbours(words), "word", "left")
    enough = F.col("best_n") >= F.lit(factor) * F.col("n")
    forms = written(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")),
        "spelling-forms")
    return forms.join(_roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
