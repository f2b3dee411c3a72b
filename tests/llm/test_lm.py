import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termtide.llm import gru, lm
from termtide.llm.queries import op2_recurrent_lm

SF_DIR = "/root/testdata/sf0.001"


def small_model():
    counts = np.array([9.0, 7, 5, 3, 2, 1])
    layout = gru.Layout(counts, 2, np.array([4.0, 6.0]))
    model = gru.Model(layout, seed=3)
    random = np.random.default_rng(5)
    for values in model.p.values():
        values += random.normal(0, 0.3, values.shape).astype(np.float32)
    return model


def plain_score(model, doc, end):
    """One token after another, with full softmaxes."""
    p, layout, size = model.p, model.layout, gru.HIDDEN
    h, total = np.zeros(size), 0.0
    for read, target in zip([end, *doc], [*doc, end], strict=True):
        x, rec = p["inputs"][read].astype(float), h @ p["recurrent"].astype(float)
        r, z = (1 / (1 + np.exp(-(x[s] + rec[s]))) for s in (slice(size), slice(size, 2 * size)))
        n = np.tanh(x[2 * size:] + r * rec[2 * size:])
        h = (1 - z) * n + z * h
        c = layout.class_of[target]
        logits = h @ p["class_weights"] + p["class_bias"]
        total += logits[c] - np.log(np.exp(logits).sum())
        if c < layout.word_classes:
            lo, hi = layout.starts[c], layout.starts[c + 1]
            scores = p["word_weights"][lo:hi] @ h + p["word_bias"][lo:hi]
            total += scores[target - lo] - np.log(np.exp(scores).sum())
    return total


def test_documents_in_lanes_score_as_one_after_another():
    model, random = small_model(), np.random.default_rng(1)
    docs = [random.integers(0, 8, n).astype(np.int32) for n in (0, 1, 5, 300, 17, 64, 63, 0)]
    for lanes in (1, 3, 256):
        gru.LANES = lanes
        found = gru.score(model, docs, 2)
        assert found == pytest.approx([plain_score(model, d, 2) for d in docs], rel=1e-4)
    assert len(gru.score(model, [], 2)) == 0


def test_gradients_equal_differences():
    model, random = small_model(), np.random.default_rng(2)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    ids, targets = (random.integers(0, 8, (6, 3)) for _ in range(2))
    fresh = np.zeros((6, 3), bool)
    fresh[0, 0] = fresh[3, 1] = True
    used = np.ones((6, 3), bool)
    used[4:, 2] = False
    start = random.normal(0, 1, (3, gru.HIDDEN))

    def loss():
        h, total = start, 0.0
        for t in range(6):
            h = np.where(fresh[t][:, None], 0, h)
            h = model.step(model.p["inputs"][ids[t]], h)[0]
            total -= model.outputs(h[used[t]], targets[t][used[t]])[0].sum()
        return total / used.sum()

    grads, _ = model.window(ids, targets, fresh, start, used)
    for name, values in model.p.items():
        for at in [tuple(random.integers(0, s) for s in values.shape) for _ in range(6)]:
            before = values[at]
            values[at] = before + 1e-5
            up = loss()
            values[at] = before - 1e-5
            down = loss()
            values[at] = before
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def base(rows):
    """(n_tokens, n_known, base_score) by id, and the number of training tokens."""
    tokens = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in rows}
    counts = Counter()
    for i, words in tokens.items():
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    return {i: (len(w), sum(counts[x] > 0 for x in w),
                sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
            for i, w in tokens.items()}, n


@pytest.mark.parametrize("held", [lm.HELD, 50])
def test_base_scores_and_held_out_gain(spark, monkeypatch, held):
    monkeypatch.setattr(lm, "HELD", held)
    monkeypatch.setattr(lm, "WORDS", min(held, 200))
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    expected, n = base(rows)
    found = op2_recurrent_lm(spark, SF_DIR).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*expected[r.doc_id][:2], n)
        assert r.base_score == pytest.approx(expected[r.doc_id][2], rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held_out = [r for r in found if r.held_out]
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out)


def test_the_network_learns_from_every_training_text(spark, monkeypatch):
    seen, average = [], lm._average

    def recorded(rows):
        found = average(rows)
        seen.append(found.column("tokens")[0].as_py())
        return found

    texts = [(f"text {i} of some",) for i in range(200)] + [("copy",)] * 50 + [(None,), ("",)]
    training = spark.createDataFrame(texts, "text string")
    vocabulary = lm.Vocabulary(lm.word_counts(training))
    monkeypatch.setattr(lm, "_average", recorded)
    lm.train(training, vocabulary)
    assert sum(seen) == vocabulary.tokens == 200 * 5 + 50 * 2 + 2


def test_probabilities_sum_to_one(spark):
    """Over every next word of a one-word text: known, tail, and one unseen type per class."""
    training = spark.createDataFrame([("a b c a b a",), ("a c d e",)], "text string")
    counts = lm.word_counts(training)
    vocabulary = lm.Vocabulary(counts)
    total = 0.0
    model = gru.Model(vocabulary.layout)
    h = model.step(model.p["inputs"][np.array([vocabulary.end])], np.zeros((1, gru.HIDDEN)))[0]
    for i in range(vocabulary.known + lm.TAILS):
        total += math.exp(model.outputs(h, np.array([i]))[0][0])
    assert total == pytest.approx(1, rel=1e-5)


def test_unusual_rows(spark):
    df = spark.createDataFrame([
        (1, None, 1.0), (2, "", 1.0), (3, "Word word", 1.0), (None, "word", 1.0), (3, "Word word", 1.0),
        (4, "w " * 50_000, 1.0)], "doc_id long, text string, score double")
    rows = lm.score(df, F.lit(False)).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 2, 3, 3, 50_001]
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert all(math.isfinite(r.score) for r in rows)
    assert lm.score(df.where("false"), F.lit(False)).collect() == []
    nothing = lm.score(df, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.base_score == 0 for r in nothing)


def test_lanes_are_as_large_as_the_documents():
    docs = [np.arange(n, dtype=np.int32) for n in (100_000, *[3] * 500)]
    inputs, targets, fresh, owner, base, filled = gru.lanes_of(docs, 7, 256)
    assert len(inputs) == len(targets) == len(owner) == filled.sum() == 100_001 + 500 * 4
    assert fresh.sum() == len(docs) and filled.max() == 100_001
    assert (np.bincount(owner) == [len(d) + 1 for d in docs]).all()


def test_many_models_are_averaged_in_levels(spark, monkeypatch):
    texts = [(f"text {i} of some",) for i in range(200)]
    training = spark.createDataFrame(texts, "text string").repartition(7)
    vocabulary = lm.Vocabulary(lm.word_counts(training))
    seen, average = [], lm._average

    def recorded(rows):
        found = average(rows)
        seen.append((len(rows), found.column("tokens")[0].as_py()))
        return found

    monkeypatch.setattr(lm, "AVERAGED", 2)
    monkeypatch.setattr(lm, "_average", recorded)
    model = lm.train(training, vocabulary)
    assert np.isfinite(model.flat()).all()
    assert all(n <= 2 for n, _ in seen) and sum(t for _, t in seen) == vocabulary.tokens


def test_tail_classes_go_by_bytes_in_every_script(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 2)
    texts = ["日本 日本 é 語 a b", "日本 x", "本 日 É", "été allé café"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary = lm.Vocabulary(lm.word_counts(df))
    counts = Counter(w for t in texts for w in [*t.encode().lower().split(), lm.END])
    expected = np.zeros(lm.TAILS)
    for w in sorted(counts, key=lambda w: (-counts[w], w))[2:]:
        expected[lm.tail_of(w)] += counts[w]
    assert (vocabulary.tail_tokens == expected).all()
    assert all(math.isfinite(r.score) and r.score < 0 for r in lm.score(df, F.lit(False)).collect())


ODD = [None, "", " \t\n", "a\x1cb \x85x\u00a0y  z", "\u00c9 \u00e9 \u0130 K AbC abc",
       "\x00 \x00q", "  lead", "trail\r\n",
       "x\x0by\x0cz", "\u65e5 \u672c \u65e5", "\U0001f642 \U0001f642x", "w " * 3000, "a" * 5000]


def test_words_of_many_texts_at_once_are_those_of_each():
    words, owner = lm.words_of(pa.array(ODD))
    found = [[w for w, o in zip(words.to_pylist(), owner, strict=True) if o == i] for i in range(len(ODD))]
    assert found == [(t or "").encode().lower().split() for t in ODD]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(ODD)})
    for limit in (1, 20, 5000, 1 << 20):
        cut = list(lm.by_size([batch, batch], limit))
        assert [t for b in cut for t in b.column("text").to_pylist()] == ODD * 2
        assert all(b.num_rows == 1 or b.num_rows and sum(
            len((t or "").encode()) for t in b.column("text").to_pylist()) <= limit for b in cut)


def test_counting_hands_on_distinct_words_only(spark, monkeypatch, capsys):
    training = spark.createDataFrame([("word " * 1000,)] * 20 + [("Word other",), (None,)], "text string")
    monkeypatch.setattr(lm, "written", lambda df, purpose: df)
    counts = lm.word_counts(training)
    counts.explain()
    assert "Generate" not in capsys.readouterr().out  # no row for every word
    assert {r.word: r.c for r in counts.collect()} == {b"word": 20_001, b"other": 1, b"\n": 22}
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["word " * 1000] * 20)})
    assert sum(len(b) for b in lm._counter([batch])) == 2


@pytest.mark.parametrize("held", [lm.HELD, 4, 1])
def test_distinct_words_are_looked_up_once_for_many_texts(spark, monkeypatch, held):
    monkeypatch.setattr(lm, "HELD", held)
    monkeypatch.setattr(lm, "WORDS", min(held, 3))
    learned = ODD[:9] + ["w"]
    counts = Counter(w for t in learned for w in [*(t or "").encode().lower().split(), lm.END])
    vocabulary = lm.Vocabulary(lm.word_counts(spark.createDataFrame([(t,) for t in learned], "text string")))
    looked_up, look_up = [], vocabulary.look_up
    vocabulary.look_up = lambda words: looked_up.append(words.to_pylist()) or look_up(words)
    found = lm._encoded(pa.array(ODD), vocabulary)
    tokens = [[*(t or "").encode().lower().split(), lm.END] for t in ODD]
    assert len(looked_up) == 1 and Counter(looked_up[0]) == Counter({w for t in tokens for w in t})

    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    known, kept = ranked[:min(lm.WORDS, held)], ranked[:held]
    in_tail = Counter()
    for w in counts:
        if w not in known:
            in_tail[lm.tail_of(w)] += counts[w]
            in_tail[-1 - lm.tail_of(w)] += 1
    for i, words in enumerate(tokens):
        ids = [known.index(w) if w in known else len(known) + lm.tail_of(w) for w in words]
        assert np.frombuffer(found["ids"][i].as_py(), vocabulary.id_type).tolist() == ids[:-1]
        assert found["n_tokens"][i].as_py() == len(words)
        assert found["known"][i].as_py() == sum(w in kept for w in words)
        assert {r["word"]: r["m"] for r in found["rare"][i].as_py()} == Counter(
            w for w in words if w not in kept)
        assert found["base"][i].as_py() == pytest.approx(sum(
            (math.log10(counts[w] + 1) if w in kept else 0)
            - math.log10(counts.total() + len(counts) + 1) for w in words), rel=1e-12)
        assert found["inside"][i].as_py() == pytest.approx(sum(
            (math.log10(counts[w] + 1) if w in kept else 0)
            - math.log10(in_tail[lm.tail_of(w)] + in_tail[-1 - lm.tail_of(w)] + 1)
            for w in words if w not in known), rel=1e-12, abs=1e-12)


def test_scores_do_not_depend_on_how_many_texts_are_cut_at_once(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(ODD * 2)), "doc_id long, text string").coalesce(1)
    every = []
    for cut in (lm.CUT, 100, 1):
        monkeypatch.setattr(lm, "CUT", cut)
        every.append(sorted(lm.score(df, F.col("doc_id") % 3 == 0).collect()))
    for rows in every[1:]:
        for a, b in zip(every[0], rows, strict=True):
            assert tuple(a) == pytest.approx(tuple(b), rel=1e-9)
