"""Operators that SQL can express, against DuckDB: mixing, fingerprints, exact search."""

import duckdb
import numpy as np
import pytest

import check
from termtide.llm import imatch, mixing, oracles, topk
from termtide.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"

DOCUMENTS = [
    (0, "a b c d", "s1"), (1, "a", "s1"), (2, None, "s1"), (3, "", None), (4, "x y " * 50, None),
    (5, "x y z", "s2"), (5, "x y z", "s2"), (None, "null id here", "s3"), (None, None, "s4"),
    (6, " \t ", "s5"), (7, "long " * 4000, "s6"), (8, "ünï cödé Wörds", "S6"), (9, "a b c d", "s2")]


def table(spark, tmp_path, name, rows, schema):
    path = f"{tmp_path}/{name}.parquet"
    spark.createDataFrame(rows, schema).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    return con


def same(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    ours = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    assert ours == sorted(map(repr, (tuple(r[i] for i in at) for r in relation.fetchall())))


@pytest.mark.parametrize("name", list(ORACLES))
def test_given_tables(spark, name):
    assert check.spark_rows(spark, SF_DIR, name) == check.oracle_rows(check.open_tables(SF_DIR), name)


@pytest.mark.parametrize("name", ["op1_fingerprints", "op8_source_mix"])
@pytest.mark.parametrize("rows", [DOCUMENTS, [], DOCUMENTS[:1], DOCUMENTS[2:4], DOCUMENTS * 40])
def test_unusual_documents(spark, tmp_path, name, rows):
    rows = [(*r, "en", 1, "clash", 1.0) for r in rows]
    con = table(spark, tmp_path, "documents", rows, "doc_id long, text string, source string, "
                "lang string, n_chars long, term string, budget double")
    same(QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name]))


def test_runs_of_documents_meet_at_their_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(imatch, "RUN", 2)
    rows = [(i * 7 % 101, f"text number {i} of many", "s") for i in range(101)]
    con = table(spark, tmp_path, "documents", rows + rows[:3] + [(None, "first", "s")] * 2,
                "doc_id long, text string, source string")
    same(QUERIES["op1_fingerprints"](spark, str(tmp_path)), con.sql(ORACLES["op1_fingerprints"]))


def test_fingerprints_tell_edits_from_other_texts(spark):
    rows = QUERIES["op1_fingerprints"](spark, SF_DIR.replace("0.001", "0.01")).collect()
    edited = np.mean([r.near_edited for r in rows])
    assert edited > 0.2 and edited > 5 * np.mean([r.near_next for r in rows])


def test_short_texts_with_a_known_term_differ(spark, tmp_path):
    rows = [(i, f"word{i}", "s") for i in range(60)]
    con = table(spark, tmp_path, "documents", rows, "doc_id long, text string, source string")
    found = QUERIES["op1_fingerprints"](spark, str(tmp_path))
    same(found, con.sql(ORACLES["op1_fingerprints"]))
    found = found.collect()
    assert len({r.fingerprint for r in found}) == 60
    assert all(r.fingerprint.strip("-") and r.near_next == 0 for r in found)


def test_lexicon_joined_by_shuffle_gives_the_same(spark, tmp_path, monkeypatch):
    con = table(spark, tmp_path, "documents", DOCUMENTS, "doc_id long, text string, source string")
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    for name in ("op1_fingerprints", "op8_source_mix"):
        same(QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name]))


def test_mix_is_near_its_targets(spark):
    df = spark.read.parquet(SF_DIR.replace("0.001", "0.01") + "/documents.parquet")
    rows = mixing.mix(df).collect()
    assert all(0 <= r.repeats <= 3 for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        largest = max(r.size for r in own)
        assert abs(sum(r.size * r.repeats for r in own) - own[0].target) <= largest


def test_rows_are_taken_as_often_as_the_mix_says(spark, tmp_path):
    df = spark.createDataFrame([(*r, 7) for r in DOCUMENTS if r[0] != 5],
                               "doc_id long, text string, source string, repeats long")
    taken = mixing.taken(df)
    assert taken.columns == df.columns
    counts = {}
    for r in taken.collect():
        counts[r.doc_id, r.text] = counts.get((r.doc_id, r.text), 0) + 1
    for doc_id, text, source in DOCUMENTS:
        if doc_id not in (5, None):
            own = mixing.mix(df).where(f"doc_id = {doc_id}").first()
            assert counts.get((doc_id, text), 0) == own.repeats


VECTORS = [
    (0, [1.0, -2.0, 0.5]), (100, [0.3, 0.3, 0.3]), (1, [0.1, 0.1, 0.1]), (2, [0.1, 0.1, 0.1]),
    (3, None), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 0.0, 0.0]), (6, [None, 1.0, 1.0]),
    (7, [-1e-9, -0.5, 0.25]), (None, [1.0, 1.0, 1.0]), (8, [0.1, 0.1, 0.1])]


@pytest.mark.parametrize("rows", [VECTORS, [], VECTORS[:1], VECTORS[3:5]])
def test_unusual_vectors(spark, tmp_path, rows):
    con = table(spark, tmp_path, "embeddings", [(*r, 3) for r in rows],
                "vec_id long, embedding array<float>, score int")
    same(QUERIES["op6_exact_top_k"](spark, str(tmp_path)), con.sql(ORACLES["op6_exact_top_k"]))


def test_many_ranges_groups_and_ties(spark, tmp_path, monkeypatch):
    for name, value in (("RANGE", 40), ("QUERIES", 3), ("BLOCK", 4)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    rows = [(i * 10, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(150)]
    con = table(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>")
    same(QUERIES["op6_exact_top_k"](spark, str(tmp_path)), con.sql(ORACLES["op6_exact_top_k"]))


def test_large_components_and_uneven_lengths(spark):
    big = [(1, [1e15, 1.0]), (2, [1e15, 3.0]), (100, [1e9, 1.0, 5.0]), (2, [1e15, 3.0]),
           (3, [1e3, 1.0])]
    df = topk.scaled(spark.createDataFrame(big, "vec_id long, embedding array<double>"))
    rows = topk.top_k(df, df.where("vec_id = 100"), 5).collect()
    held, exact = 2**63 - 1, 1024**2 * (10**12 + 1)
    assert [(r.rank, r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank)] == [
        (1, 1, held), (2, 2, held), (3, 2, held), (4, 3, exact)]


def test_repeated_ids_and_rows_of_queries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "RANGE", 16)
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(40)]
    rows += [(100, [1.0, 2.0, -1.0, 0.5])] * 3 + [(100, [1.0, 0.0, 0.0, 0.0]), (200, [0.0] * 4)]
    rows += [(7, [2.0, 2.0, 2.0, 2.0])] * 15
    con = table(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>")
    found = QUERIES["op6_exact_top_k"](spark, str(tmp_path))
    same(found, con.sql(ORACLES["op6_exact_top_k"]))
    assert found.where("query_id = 100").count() == 40


def test_sql_names_every_column():
    assert "repeats" in oracles.source_mix()
