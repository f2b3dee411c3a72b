from pyspark.sql import functions as F

from termtide import params
from termtide.operators.words import drop_stop_words, prepared_words, tokens


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def test_empty_and_missing_texts_have_no_tokens(spark):
    assert tokens(texts(spark, None, "", "   \n\t")).count() == 0


def test_short_tokens_and_punctuation_runs(spark, rows):
    assert rows(tokens(texts(spark, "a b !! ok ."))) == [("!!",), ("ok",)]


def test_contractions_stay_whole(spark, rows):
    assert rows(tokens(texts(spark, "don't rock'n'roll 'quoted' x2"))) == [
        ("don't",), ("quoted",), ("rock'n",), ("roll",), ("x2",)]


def test_space_separators_divide_tokens(spark, rows):
    assert rows(tokens(texts(spark, "one\u00a0\u00a0two\u3000three"))) == [
        ("one",), ("three",), ("two",)]


def test_length_counts_utf16_units(spark, rows):
    # One character beyond the basic plane is two units, so it is long enough.
    assert rows(tokens(texts(spark, "\U0001F600 é x"))) == [("\U0001F600",)]


def test_counted_tokens_are_those_of_every_row(spark, rows):
    df = texts(spark, "b\u00e4r ab ab", None, "", "ab ab ab Ab", ".").unionByName(texts(spark, "zz ab"))
    found = tokens(df, keep=["doc_id"], counted=True)
    assert found.columns == ["doc_id", "word", "n"]
    assert rows(found) == [
        (0, "ab", 1), (0, "ab", 2), (0, "b\u00e4r", 1), (0, "zz", 1), (3, "Ab", 1), (3, "ab", 3)]
    assert rows(prepared_words(texts(spark, "The the stop THE stop"), counted=True)) == [("stop", 2)]


def test_min_len(spark, rows):
    assert rows(tokens(texts(spark, "ab abc abcd"), min_len=3)) == [("abcd",)]


def test_stop_words_ignore_case(spark, rows):
    assert rows(prepared_words(texts(spark, "The IS don't stop"))) == [("stop",)]


def test_one_character_stop_words_never_matter(spark, rows):
    dead = [w for w in params.STOP_WORDS if len(w) == 1]
    alive = [w for w in params.STOP_WORDS if len(w) > 1]
    df = texts(spark, "a + . , ' \" ! an to +. word")
    assert dead and rows(prepared_words(df)) == rows(prepared_words(df, stop_words=alive))


def test_stop_words_as_a_table(spark, rows):
    stop = spark.createDataFrame([("the",), ("is",), ("is",)], "word string")
    df = tokens(texts(spark, "The IS don't stop stop"))
    assert rows(drop_stop_words(df, stop)) == [("don't",), ("stop",), ("stop",)]


def test_case_is_kept_unless_folded(spark, rows):
    df = texts(spark, "Sound sound")
    assert rows(prepared_words(df)) == [("Sound",), ("sound",)]
    assert rows(prepared_words(df, fold_case=True)) == [("sound",), ("sound",)]


def test_keep_columns_and_repeats(spark, rows):
    df = texts(spark, "one one", "two")
    got = tokens(df, keep=["doc_id"]).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    assert rows(got) == [(0, "one", 2), (1, "two", 1)]


def test_marks_belong_to_words(spark):
    # Written out, not taken from the pattern: decomposed accents and vowel signs.
    text = "cafe\u0301s \u0939\u093f\u0928\u094d\u0926\u0940 nai\u0308ve l'e\u0301te\u0301"
    found = [r.word for r in tokens(spark.createDataFrame([(text,)], "text string")).collect()]
    assert found == text.split()
