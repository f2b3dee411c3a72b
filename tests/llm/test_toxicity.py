import itertools
import math
import random

import numpy as np
import pytest

from termtide.llm import toxicity
from termtide.llm.language import letter_table
from termtide.llm.queries import op13_toxicity

SF_DIR = "/root/testdata/sf0.01"
LETTERS = np.unpackbits(letter_table()).view(bool)


def packed(gram):
    a, b, c = (ord(x) for x in gram)
    return a << 42 | b << 21 | c


def counted(words):
    """The language model of a few words, trigram by trigram."""
    grams = [f" {w} "[i:i + 3] for w in words for i in range(len(w))]
    grams += [f"  {w[0]}" for w in words]
    n = {g: grams.count(g) for g in grams}
    total = {c: sum(m for g, m in n.items() if g[:2] == c) + 6.4 for c in {g[:2] for g in n}}
    costs = {packed(g): math.log(total[g[:2]]) - math.log(m + 0.1) for g, m in n.items()}
    unknown = {ord(c[0]) << 21 | ord(c[1]): math.log(t) - math.log(0.1) for c, t in total.items()}
    return costs, unknown


WORDS = ["idiot", "stupid", "trash", "clown", "loser", "pathetic", "hello", "letter", "this"] * 3


def every_reading(token):
    """All readings of a token with the cost of the channel."""
    before, lattice = "", []
    for x in token.lower():
        if x.isalpha():
            lattice.append([(x, 0.0)] + ([("", toxicity.AGAIN)] if x == before else []))
        else:
            lattice.append([(y, toxicity.SIGN) for y in toxicity.LEET.get(x, "")] + [
                ("", toxicity.NUMBER if x.isdecimal() else toxicity.BETWEEN)])
        before = x
    for way in itertools.product(*lattice):
        yield "".join(w[0] for w in way), sum(w[1] for w in way)


def cost_of(word, costs, unknown):
    text, cost = f"  {word} ", 0.0
    for i in range(len(word) + 1):
        context = ord(text[i]) << 21 | ord(text[i + 1])
        cost += costs.get(context << 21 | ord(text[i + 2]), unknown.get(context, math.log(64)))
    return cost


def test_decoding_finds_the_cheapest_of_all_readings():
    costs, unknown = counted(WORDS)
    rng = random.Random(3)
    for _ in range(200):
        token = "".join(rng.choice("idotsl10$!3ee.-*") for _ in range(rng.randint(1, 7)))
        if any(len(set(token[i:i + 4])) == 1 for i in range(len(token) - 3)):
            continue
        found = toxicity.decode(token, costs, unknown)
        readings = {}
        for word, price in every_reading(token):
            price += cost_of(word, costs, unknown)
            readings[word] = min(price, readings.get(word, math.inf))
        assert readings[found] == pytest.approx(min(readings.values()))


def test_disguises_are_restored():
    restore = toxicity.Restorer(*counted(WORDS))
    for disguised in ("1d10t", "i d i o t", "1 d 1 0 t", "IDI0T!!", "i.d.i.o.t", "i-d-i-o-t",
                      "iiiidiooooot", "!diot"):
        assert restore(f"{disguised}") == "idiot"
    assert restore("$tup1d  cl*o*w*n\np@th3t1c") == "stupid clown pathetic"
    # Ordinary words stay as they are.
    plain = "Hello, it's a well-known \"letter\" (this)! 1984 --- 3.14 naïve"
    assert restore(plain) == " ".join(plain.split())
    assert restore("") == "" and restore("a " * 5000).strip("a ") == ""
    assert len(restore("x1" * 100_000)) > 0  # in proportion to the length


def test_trigram_costs_come_from_all_rows(spark, documents):
    costs, unknown = toxicity.character_model(documents(None, "", *WORDS, "12 !"))
    plain = counted(WORDS)
    assert costs.keys() == plain[0].keys() and unknown.keys() == plain[1].keys()
    assert all(costs[g] == pytest.approx(c) for g, c in plain[0].items())
    assert toxicity.character_model(documents()) == ({}, {})


def plain_features(text):
    runs = "".join(c if LETTERS[ord(c)] else " " for c in text.lower()).split()
    return {(0, r) for r in runs} | {(1, r[:5]) for r in runs if len(r) > 5} | {
        (2, r[-5:]) for r in runs if len(r) > 5}


def test_features_are_words_and_their_ends():
    texts = ["one two one", "", "Übermut überall", "verylongword1verylongwurd", "x\0y x", "two",
             "word " * 300_000]
    own = [set() for _ in texts]
    for owner, place in toxicity.features(texts, LETTERS):
        for i, p in zip(owner.tolist(), place.tolist(), strict=True):
            assert p not in own[i]
            own[i].add(p)
    names = [plain_features(t) for t in texts]
    assert [len(x) for x in own] == [len(x) for x in names]  # no two at one place here
    for (x, a), (y, b) in itertools.combinations(zip(own, names, strict=True), 2):
        assert len(x & y) == len(a & b)


def test_rows_of_all_kinds(spark, documents):
    rows = [(i, f"plain words here {'idiot' if i % 2 else 'person'}", None, None) for i in range(60)]
    rows += [(None, "idiot", None, None), (60, "idiot here", None, None), (60, "idiot here", None, None)]
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(60)] + [(60, 1), (60, 1), (None, 0), (61, None), (3, 7), (999, 1)],
        "doc_id long, toxic int")
    model = toxicity.learn(documents(*rows), labels)
    df = documents("an 1d10t", "a person", None, "", "123", "i d i o t", "文字", "idiot " * 200_000)
    rows = sorted(toxicity.score(df, model).collect())
    assert {"term", "size", "score"} <= set(rows[0].asDict())
    assert [r.predicted for r in rows] == [1, 0, rows[2].predicted, *[rows[2].predicted] * 2, 1,
                                           rows[2].predicted, 1]
    assert rows[2].score == rows[3].score == rows[4].score and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(documents(), model).collect() == []
    with pytest.raises(ValueError, match="score"):
        toxicity.score(df.withColumnRenamed("size", "score"), model)


def test_labels_of_one_kind_or_none(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels, score in ((none, 0.0), (spark.createDataFrame([(0, 1)], none.schema), 1.0)):
        model = toxicity.learn(documents("some text"), labels)
        row = toxicity.score(documents("any"), model).first()
        assert (row.score, row.predicted) == (score, int(score))


def test_held_out_accuracy(spark):
    found = op13_toxicity(spark, SF_DIR).where("held_out")
    truth = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "toxic")
    rows = found.join(truth, "doc_id").collect()
    toxic = [r.predicted for r in rows if r.toxic]
    clean = [r.predicted for r in rows if not r.toxic]
    assert sum(toxic) >= 0.5 * len(toxic) and sum(clean) <= 0.02 * len(clean)
