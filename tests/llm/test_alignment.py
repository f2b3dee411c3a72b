import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from termtide.llm import alignment
from termtide.llm.queries import aligned_vocabularies, op12_tokenizer_alignment

SF_DIR = "/root/testdata/sf0.001"
A_PATH, B_PATH = aligned_vocabularies()


@pytest.fixture(scope="module")
def plain():
    """Groups and linked id pairs of one text, by the libraries on the whole text."""
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    names = {i: n for n, i in a.get_vocab().items()}
    byte = {c: i for c, i in alignment.byte_letters().items()}

    def piece(i):
        name = b.id_to_piece(i)
        if len(name) == 6 and name[:3] == "<0x" and b.is_byte(i):
            return bytes.fromhex(name[3:5])
        return name.replace("▁", " ").encode()

    def run(text):
        if not text:
            return [], [], "", []
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        tokens = [bytes(byte[c] for c in names[i]) for i in ids[0]], [piece(i) for i in ids[1]]
        if any(b"".join(t) != (" " + text).encode() for t in tokens):
            return [], [], "", []
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in tokens]
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            m, n = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append(",".join(map(str, ids[0][i:m])) + "|" + ",".join(map(str, ids[1][j:n])))
            links.append((ids[0][m - 1], ids[1][n - 1]))
            i, j = m, n
        return *ids, ";".join(groups), links
    return run


def expected(plain, rows):
    found = [(doc_id, *plain(text)) for doc_id, text in rows]
    count = Counter(p for r in found for p in r[4])
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(n, highest.get(b, 0))
    return sorted(
        (-1 if doc_id is None else doc_id, len(a), len(b), groups.count(";") + 1 if groups else 0,
         len(links), sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links),
         hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for doc_id, a, b, groups, links in found)


def digested(df):
    return sorted(
        (-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best,
         r.count_sum, r.groups_sha256) for r in df.collect())


ODD = [
    None, "", " ", "  two  spaces ", "a\nb\t c", "▁x ▁ y▁", "x ▁y", "<0x41> <|endoftext|> <s> </s>",
    "naïve café ﬁ ｆｕｌｌ", "é  x　y", "😀👍🏽 z", "don't we'll I'm", "a\x00b c", "日本語 テキスト",
    "x​y ﻿z", "The  end. ", "  a \x1c b", "same same same", "١٢ ½ ²",
]


def test_groups_of_odd_and_random_texts(spark, documents, plain):
    rng = random.Random(5)
    chars = "ab  .,'\n▁é😀1Ω "
    texts = ODD + ["".join(rng.choice(chars) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    rows = alignment.align(documents(*texts), A_PATH, B_PATH).collect()
    assert {"term", "size", "lang"} <= set(rows[0].asDict())
    size = len(sentencepiece.SentencePieceProcessor(model_file=B_PATH))
    for row in rows:
        a, b, groups, links = plain(row.text)
        assert (row.n_a, row.n_b, row.groups) == (len(a), len(b), groups), row.text
        assert Counter(row.links) == Counter(x * size + y for x, y in links)


@pytest.mark.parametrize("held", [alignment.HELD, 10, 0])
def test_counts_whatever_is_looked_up_in_place(spark, documents, plain, monkeypatch, held):
    monkeypatch.setattr(alignment, "HELD", held)
    rows = [(i, t, None, None) for i, t in enumerate(ODD)] + [(3, "same same", None, None)] * 2 + [
        (None, "no number", None, None)]
    assert digested(alignment.digests(documents(*rows), A_PATH, B_PATH)) == expected(
        plain, [r[:2] for r in rows])


def test_long_texts_and_a_forgetful_memory(plain, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 1000)
    monkeypatch.setattr(alignment, "CACHE", 5)
    with open(A_PATH, encoding="utf-8") as a, open(B_PATH, "rb") as b:
        aligner = alignment.Aligner(a.read(), b.read())
    texts = ["short one", "many words of a long text, over and over. " * 300, "", "x" * 5000,
             "bad ﬁ ﬀ é́ " * 200 + "▁" * 9, "short one"]
    for whole in (True, False):
        for text, (n_a, n_b, groups, links) in zip(
                texts, alignment.aligned(aligner, texts, whole), strict=True):
            ids_a, ids_b, all_groups, pairs = plain(text)
            assert (n_a, n_b, len(links)) == (len(ids_a), len(ids_b), 4 * len(pairs))
            digest = hashlib.sha256(all_groups.encode()).hexdigest() if all_groups else ""
            assert groups == (all_groups if whole else digest)


def test_overlaps_are_all_pairs_that_share_a_byte():
    rng = np.random.default_rng(2)
    for _ in range(50):
        ends = [np.unique(np.append(rng.integers(1, 30, rng.integers(1, 12)), 30)) for _ in "ab"]
        starts = [np.append(0, e[:-1]) for e in ends]
        pairs = set(zip(*(x.tolist() for x in alignment.overlaps(
            starts[0], ends[0], starts[1], ends[1])), strict=True))
        assert pairs == {(i, j) for i in range(len(ends[0])) for j in range(len(ends[1]))
                         if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]}


def test_query_equals_brute_force_on_whole_table(spark, plain):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert digested(op12_tokenizer_alignment(spark, SF_DIR)) == expected(
        plain, [tuple(r) for r in docs])


def test_empty_table_and_clashing_names(spark, documents):
    assert alignment.digests(documents(), A_PATH, B_PATH).collect() == []
    with pytest.raises(ValueError, match="n_a"):
        alignment.align(documents("x").withColumnRenamed("size", "n_a"), A_PATH, B_PATH)
