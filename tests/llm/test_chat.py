"""Preference pairs, against plain Python."""

import pytest

from termtide.llm import chat, imatch
from termtide.llm.queries import op5_preference_format

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn int, role string, text string, run string"
ROWS = [
    (1, 1, "assistant", "yes", "x"), (1, 0, "user", "is it?", "x"), (1, 2, "user", "thanks", "x"),
    (2, 0, "user", "is it?", "x"), (2, 1, "assistant", "yes", "x"),
    (3, 0, "user", "no answer", "x"), (4, 0, "assistant", "<|im_end|>\n", "x"),
    (4, 1, None, None, "x"), (None, 0, "user", "lost", "x"), (None, 0, "user", "lost", "x"),
    (9, 0, "system", "é" * 30, "x"), (9, 1, "user", "q", "x"), (9, 2, "assistant", "a", "x"),
    (9, 3, "user", "r", "x"), (9, 4, "assistant", "𝒃", "x")]


def brute(rows):
    talks = {}
    for conv, turn, role, text, *_ in rows:
        talks.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    ids = sorted(talks, key=lambda i: (i is not None, i or 0))
    talks = {i: [t[1:] for t in sorted(t)] for i, t in talks.items()}

    def cut(turns):
        at = [i for i, t in enumerate(turns) if t[0] == "assistant"]
        return at[-1] if at else len(turns)

    def text(turns):
        return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)

    out = []
    for i, conv in enumerate(ids):
        other = ids[(i + 1) % len(ids)]
        a, b = talks[conv], talks[other]
        b = a[:cut(a)] + b[cut(b):]
        n = max(k for k in range(min(len(a), len(b)) + 1) if a[:k] == b[:k])
        learned = [[t + "<|im_end|>" for r, t in turns[n:] if r == "assistant"] for turns in (a, b)]
        out.append((conv, other, len(a), len(b), n, text(a[:n]), text(a[n:]), text(b[n:]), *learned))
    return out


def same(df, rows):
    found = []
    for r in df.collect():
        masks = [[text[s.start:s.end] for s in mask] for text, mask in (
            (r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask))]
        found.append((*r[:8], *masks))
    assert sorted(map(repr, found)) == sorted(map(repr, brute(rows)))
    return found


@pytest.mark.parametrize("rows", [ROWS, [], ROWS[:3], ROWS[:5], ROWS[5:6]])
def test_unusual_conversations(spark, rows):
    same(chat.preference_pairs(spark.createDataFrame(rows, SCHEMA)), rows)


def test_runs_of_conversations_meet_at_their_ends(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RUN", 4)
    rows = [(i * 7 % 101, t, ("user", "assistant")[t % 2], f"{i % 3} {t}", "x")
            for i in range(101) for t in range(i % 5 + 1)]
    found = same(chat.preference_pairs(spark.createDataFrame(rows + ROWS[-7:-5], SCHEMA)),
                 rows + ROWS[-7:-5])
    assert len(found) == 102


def test_every_given_conversation_is_paired(spark):
    rows = spark.read.parquet(SF_DIR + "/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()
    same(op5_preference_format(spark, SF_DIR), rows)
