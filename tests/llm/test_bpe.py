import random
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from termtide.llm import bpe
from termtide.llm.queries import vocabulary

PATH, PATTERN = vocabulary()
RANKS = bpe.read_ranks(PATH)
REFERENCE = tiktoken.Encoding(
    "own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text, encoder=None):
    encoder = encoder or bpe.Encoder(RANKS, PATTERN, ({}, {}))
    return memoryview(encoder(text)).cast("i").tolist()


def test_random_texts_of_awkward_characters():
    random.seed(5)
    alphabet = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0　ab'sAé1²Ⅷ一。!?́​<|endoftext|>😀"
    encoder = bpe.Encoder(RANKS, PATTERN, ({}, {}))
    for _ in range(3000):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 14)))
        assert ids(text, encoder) == REFERENCE.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("text", [
    "a" * 5000, "abcdefghij" * 1000, "Donaudampfschiff" * 300, " " * 3000, "=" * 3001, "é" * 2000])
def test_long_pre_tokens(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)


def test_queue_prefers_the_lowest_rank_then_the_leftmost():
    ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
    ranks |= {b"aa": 3, b"bc": 4, b"aab": 5}
    queue = bpe.RankQueue(max(ranks.values()))
    assert queue.merge(b"aaa", ranks) == (3, 0)
    assert queue.merge(b"aabc", ranks) == (3, 4)
    assert queue.merge(b"aab", ranks) == (5,)
    assert not any(queue.low)


def test_round_trip_of_rows(documents):
    texts = ["plain words, twice", "", None, " \n lead", "plain words, twice", "naïve 文字 😀", "x " * 9000]
    df = documents(*texts)
    both = bpe.round_trip(df, PATH, PATTERN)
    assert both.columns == [*df.columns, "token_ids", "decoded"]
    rows = sorted(both.collect())
    assert [r.text for r in rows] == texts
    for r in rows:
        assert r.token_ids == REFERENCE.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    apart = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH)
    assert sorted(apart.collect()) == rows


def test_empty_table_and_clashing_column(documents):
    df = documents()
    assert bpe.digests(df, PATH, PATTERN).collect() == []
    with pytest.raises(ValueError, match="token_ids"):
        bpe.encode(df.withColumnRenamed("term", "token_ids"), PATH, PATTERN)


def test_digests(documents):
    import hashlib

    row = bpe.digests(documents("to be"), PATH, PATTERN).first()
    expected = REFERENCE.encode_ordinary("to be")
    assert row.n_tokens == len(expected)
    assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(b"to be").hexdigest()
    assert public_tokenizers.path("byte_bpe_50k.tiktoken") == PATH


def test_a_word_is_remembered_once(monkeypatch):
    encoder = bpe.Encoder(RANKS, PATTERN, ({}, {}))
    text = "so hello, hello world hello"
    ids = encoder(text)
    assert sum("hello" == w.strip() for w in [*encoder.words, *encoder.pieces]) == 1
    monkeypatch.setattr(bpe, "CACHE", 3)  # of both together
    assert encoder("x " + text) and len(encoder.words) + len(encoder.pieces) <= 6
    assert encoder(text) == ids


def test_many_texts_at_once_with_words_forgotten_between(monkeypatch):
    random.seed(9)
    words = [*"aé文😀1", "", "\n", "hello", "hello,", "naïve.", "x-y", "(and", "don't", "12345", "\xa0z"]
    texts = [" ".join(random.choices(words, k=random.randint(0, 9))) for _ in range(2000)] + [None, "a" * 999]
    expected = [REFERENCE.encode_ordinary(t or "") for t in texts]
    for cache, table in ((1, 1), (300, 40), (bpe.CACHE, bpe.TABLE)):
        monkeypatch.setattr(bpe, "CACHE", cache)
        monkeypatch.setattr(bpe, "TABLE", table)
        encoder = bpe.Encoder(RANKS, PATTERN, ({}, {}))
        found = [x for lo in range(0, len(texts), 7)
                 for x in encoder.lists(pa.array(texts).slice(lo, 7)).to_pylist()]
        assert found == expected
        assert len(encoder.words) == len(set(encoder.words))


HELD = """
import re
from pathlib import Path
import pyarrow as pa
from termtide.llm import bpe
from termtide.llm.queries import vocabulary

def held():  # MB
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

encoder = bpe.Encoder(bpe.read_ranks(vocabulary()[0]), vocabulary()[1], ({}, {}))
letters = "bcdfghjklm"
encoder("some words, to begin with")
before = held()
for k in range(300):
    encoder(" ".join("".join(letters[int(d)] for d in str(i)) for i in range(100_000 + k * 1000, 101_000 + k * 1000)))
pa.default_memory_pool().release_unused()
print(held() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_remembered_words_take_little_memory():
    done = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True,
                          cwd=Path(__file__).parents[2], timeout=300)
    assert float(done.stdout.split()[-1]) < 30
