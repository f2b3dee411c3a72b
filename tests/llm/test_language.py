import unicodedata

import numpy as np
import pytest

from termtide.llm import language
from termtide.llm.queries import op4_language_id

SF_DIR = "/root/testdata/sf0.001"
LETTERS = np.unpackbits(language.letter_table()).view(bool)


def plain_trigrams(text):
    letters = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    return [f" {w} "[i:i + 3] for w in letters.split() for i in range(len(w))]


def keys(texts):
    found = [[] for _ in texts]
    for index, grams in language.trigrams(texts, LETTERS):
        for i, g in zip(index.tolist(), grams.tolist(), strict=True):
            found[i].append("".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0)))
    return found


def test_trigrams_are_those_of_the_words():
    texts = ["Hello, world", "", "a", "  1 2 ", "naïve हिन्दी", "x\0y", "ÀB-c", "end "]
    assert keys(texts) == [plain_trigrams(t) for t in texts]


def test_long_texts_are_cut_between_words():
    text = "word " * 300_000 + "last"
    assert sorted(keys([text])[0]) == sorted(plain_trigrams(text))
    assert len(keys(["x" * 1_200_000])[0]) == 1_200_000


def test_masks_have_no_false_negatives_and_popcounts_are_corrected():
    rng = np.random.default_rng(1)
    grams = {f"l{i:02}": rng.integers(1, 2**62, 500).tolist() for i in range(70)}
    filters = language.Filters(grams)
    assert filters.words == 2
    for i, name in enumerate(filters.languages):
        masks = filters.masks(np.asarray(grams[name], np.int64))
        assert (masks[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)).all()
    others = filters.masks(rng.integers(1, 2**62, 20000))
    share = (others[:, 0] & np.uint64(1)).mean()
    assert share == pytest.approx(filters.by_chance[0], abs=0.01)


def test_prediction_of_rows(spark, documents):
    labelled = spark.createDataFrame(
        [("der die und das", "de"), ("the and of this", "en"), (None, "en"), ("x", None)],
        "text string, lang string")
    filters = language.learn(labelled)
    df = documents("THE OF", "und der", None, "", "12 34!", "文字", "the of", "the " * 200_000)
    rows = sorted(language.predict(df, filters).collect())
    assert [r.lang_pred for r in rows] == ["en", "de", "und", "und", "und", "de", "en", "en"]
    assert [r.score > 0 for r in rows] == [True, True, False, False, False, False, True, True]
    assert all(0 <= r.score <= 1 for r in rows)
    kept = language.predict(df, filters, drop_rejected=True)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 6, 7]
    assert language.predict(documents(), filters).collect() == []


def test_nothing_learned(spark, documents):
    empty = spark.createDataFrame([], "text string, lang string")
    row = language.predict(documents("some text"), language.learn(empty)).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def test_held_out_accuracy(spark):
    found = op4_language_id(spark, SF_DIR).where("held_out")
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("lang IS NOT NULL").collect()
    assert len(rows) > 20
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
