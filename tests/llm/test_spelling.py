import itertools
import random
import re
import zlib

import pytest

from termtide.llm import spelling
from termtide.llm.queries import op11_spelling_variants

SF_DIR = "/root/testdata/sf0.001"


def one_edit(a, b):
    """Tried letter by letter, apart from prefixes and suffixes."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts, factor=5):
    by_key = {}  # words that agree after one letter is left out, or replaced, meet
    for w in counts:
        for i in range(len(w)):
            by_key.setdefault(w[:i] + "\0" + w[i + 1:], set()).add(w)
            by_key.setdefault(w[:i] + w[i + 1:], set()).add(w)
        by_key.setdefault(w, set()).add(w)
    near = {w: set() for w in counts}
    for met in by_key.values():
        for a, b in itertools.combinations(met, 2):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), n, len(near[w]), counts.get(form[w], 0))
                  for w, n in counts.items())


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0)
                  for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def as_table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize("block", [512, 3])
def test_equals_every_pair_compared(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)  # small blocks are cut again and again
    rng = random.Random(block)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(0, 7))) for _ in range(500)}
    words |= {"prefix" * 5 + a + b for a in "abcd" for b in "abcd"}
    words |= {a + "ending" * 400 for a in "abcdefgh"} | {"ending" * 400, "😀ending", "endin😀g"}
    counts = {w: rng.choice([1, 1, 2, 5, 5, 25, 130, 700]) for w in words}
    assert found(spelling.variants(as_table(spark, counts))) == plain_variants(counts)


def test_chain_of_forms_and_ties(spark):
    counts = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aabbbb": 625,
              "xyzxyz": 3, "xyzxya": 15, "xyzxyb": 15}
    rows = {r[0]: r for r in found(spelling.variants(as_table(spark, counts)))}
    assert rows["aaaaaa"][1:3] == ("aaaaab", "aabbbb") and rows["aabbbb"][1:3] == ("", "aabbbb")
    assert rows["xyzxyz"] == ("xyzxyz", "xyzxya", "xyzxya", 3, 2, 15)


def plain_counts(rows, min_count=5, every=199):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= min_count}


def test_query_equals_brute_force_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    counts = plain_counts([tuple(r) for r in docs])
    rows = found(op11_spelling_variants(spark, SF_DIR))
    assert rows == plain_variants(counts) and any(r[1] for r in rows)


def test_runs_of_rows_of_all_kinds(spark, documents):
    rows = [(i, t, None, None) for i, t in enumerate(
        [None, "", "Straße ÉCOLE! école2 übermütig", "x" * 100_000, "abcdef abcdeg " * 3000,
         "abcdef abcdeg " * 3000, "文字文字文字 ab1cd"])]
    rows += [(None, "abcdef " * 9, None, None)] * 2
    plain = [(r[0], r[1]) for r in rows]
    for every in (None, 2, 3):
        counted = spelling.counted_runs(
            documents(*rows), min_chars=6, min_count=1, drop_one_in=every)
        assert {r.word: r.n for r in counted.collect()} == plain_counts(plain, 1, every)


def test_empty_tables(spark, documents):
    words = spelling.counted_runs(documents(), min_chars=6, min_count=5, drop_one_in=199)
    assert spelling.variants(words).collect() == []
    assert found(spelling.variants(as_table(spark, {"single": 3}))) == [
        ("single", "", "single", 3, 0, 0)]
