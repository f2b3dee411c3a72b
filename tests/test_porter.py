import random

import pytest

from tests.plain_porter import stem
from termtide.functions.porter import with_stem
from termtide.operators.counts import word_counts
from termtide.operators.words import tokens

# Examples printed in the 1980 paper, with the result of the whole algorithm.
PUBLISHED = """
caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster
bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam
predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic
formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
generalizations gener oscillators oscil upgrading upgrad
""".split()


def stems(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "word string")
    return {r.word: r.stem for r in with_stem(df).collect()}


def test_published_examples(spark):
    expected = dict(zip(PUBLISHED[::2], PUBLISHED[1::2]))
    assert stems(spark, list(expected)) == expected


def test_case_short_words_and_marks_stay(spark):
    cases = {
        "is": "is", "as": "as", "Yes": "Ye", "yes": "ye", "RUNNING": "RUNNING", "Running": "Run",
        "don't": "don't", "!!": "!!", "||": "||", "2nd": "2nd", "analogies": "analog",
        "possibly": "possibl", "ies": "i", "s": "s", "été": "été", "𝒳s": "𝒳",
    }
    assert stems(spark, list(cases)) == cases


@pytest.mark.parametrize("alphabet", ["aybts", "yeds", "aeioustlnzicbmfg", "ingedlsyaT1'"])
def test_random_words_agree_with_plain_algorithm(spark, alphabet):
    rng = random.Random(alphabet)
    ends = ["", "ed", "ing", "eed", "ational", "ization", "ion", "ement", "ical", "e", "ll", "y", "sses"]
    words = {"".join(rng.choices(alphabet, k=rng.randint(1, 9))) + rng.choice(ends)
             for _ in range(4000)}
    got = stems(spark, sorted(words))
    assert {w: s for w, s in got.items() if s != stem(w)} == {}


def test_vocabulary_agrees_with_plain_algorithm(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    vocabulary = with_stem(word_counts(tokens(documents))).select("word", "stem").collect()
    assert len(vocabulary) > 5000
    assert [tuple(r) for r in vocabulary if r.stem != stem(r.word)] == []
