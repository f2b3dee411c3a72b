"""Preference pairs of conversations in a chat format.

A conversation is the chosen one of its pair. The rejected one has the same turns up to the last
answer, and from there on the turns of the next conversation from its own last answer on. The turns
that both begin with are the prompt, rendered once; the rest of each is a completion, whose mask
says where it is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termtide.llm.common import parts
from termtide.llm.imatch import in_runs

ANSWERS = "assistant"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
Turn = tuple[str, str]

_PAIRS = ("conv_id long, rejected_id long, n_turns long, n_rejected long, n_common long, "
          "prompt string, chosen string, rejected string, "
          "chosen_mask array<struct<start: long, end: long>>, "
          "rejected_mask array<struct<start: long, end: long>>")


def last_answer(turns: list[Turn]) -> int:
    """Index of the last turn of the assistant; the number of turns if there is none."""
    return next((i for i in range(len(turns) - 1, -1, -1) if turns[i][0] == ANSWERS), len(turns))


def common_turns(a: list[Turn], b: list[Turn]) -> int:
    """Number of turns that both begin with."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def rendered(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The turns as text, and the spans of what the assistant wrote in it, closing marks included;
    offsets in code points, ends exclusive."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{role}\n", f"{text}{CLOSE}"
        if role == ANSWERS:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "\n"]
        at += len(head) + len(body) + 1
    return "".join(out), mask


def pair(turns: list[Turn], following: list[Turn]) -> tuple[int, int, str, str, str, list, list]:
    """(turns of the rejected conversation, common turns, prompt, completions, their masks)."""
    rejected = turns[:last_answer(turns)] + following[last_answer(following):]
    n = common_turns(turns, rejected)
    (chosen, chosen_mask), (other, other_mask) = rendered(turns[n:]), rendered(rejected[n:])
    return len(rejected), n, rendered(turns[:n])[0], chosen, other, chosen_mask, other_mask


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def plain(turns: list[dict]) -> list[Turn]:
        return [(t["role"] or "", t["text"] or "") for t in turns]

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), spans, spans]
    names = ["conv_id", "rejected_id", "n_turns", "n_rejected", "n_common", "prompt", "chosen",
             "rejected", "chosen_mask", "rejected_mask"]
    for batch in parts(batches, 64):
        own = [plain(t) for t in batch.column("turns").to_pylist()]
        found = [pair(a, plain(b))
                 for a, b in zip(own, batch.column("next_turns").to_pylist(), strict=True)]
        columns = [[row[i] for row in found] for i in range(5)] + [
            [[{"start": lo, "end": hi} for lo, hi in row[i]] for row in found] for i in (5, 6)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("next_id"),
             pa.array([len(turns) for turns in own], pa.int64()),
             *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names=names)


def preference_pairs(df: DataFrame) -> DataFrame:
    """One row for every conversation of ``df`` (conv_id, turn, role, text), paired with the next
    one by conv_id (the last with the first; a single one with itself).

    Turns are ordered by number, role and text; repeated ones stay. Rows without conv_id are one
    conversation, before the others; null roles and texts count as empty. Turns are equal if role
    and text are. Every row of ``df`` is shuffled once. Other columns of ``df`` do not matter.
    """
    rows = df.select(F.col("conv_id").alias("doc_id"), "turn", "role", "text")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    grouped = in_runs(rows).repartition("run").groupBy("run", "guest", "doc_id").agg(
        turns.alias("turns"))
    order = Window.partitionBy("run").orderBy("guest", F.col("doc_id").asc_nulls_first())
    paired = grouped.select(
        F.col("doc_id").alias("conv_id"), "turns", "guest",
        F.lead("doc_id").over(order).alias("next_id"),
        F.lead("turns").over(order).alias("next_turns")).where("NOT guest").drop("guest")
    return paired.mapInArrow(_format, _PAIRS)
