import json

import pytest

from termtide import schemas
from termtide.sources import publications
from termtide.sources.snapshots import read_snapshot, snapshot_json, write_snapshot


def top(spark, **scores):
    return spark.createDataFrame([(w, float(s)) for w, s in scores.items()], schemas.TOP_WORDS)


def served(spark, path):
    return [tuple(r) for r in read_snapshot(spark, path).collect()]


def test_missing_snapshot_is_empty_and_typed(spark, tmp_path):
    df = read_snapshot(spark, str(tmp_path / "none"))
    assert df.schema == schemas.CLOUD_ITEMS and df.count() == 0


def test_newest_snapshot_replaces_the_last(spark, tmp_path):
    path = str(tmp_path / "s")
    for n in range(6):
        write_snapshot(top(spark, a=n, b=9, c=9), path, keep=4)
        assert served(spark, path) == [("b", 9), ("c", 9), ("a", n)]
    assert publications.numbers(spark, path + "/live") == [1, 2, 3, 4, 5]
    assert not list((tmp_path / "s" / "live").glob("staged*"))


def test_a_reader_keeps_its_list_while_others_are_published(spark, tmp_path):
    path = str(tmp_path / "s")
    write_snapshot(top(spark, a=1, b=2), path)
    opened = read_snapshot(spark, path)
    for n in range(5):
        write_snapshot(top(spark, z=n + 1), path)
    assert [tuple(r) for r in opened.collect()] == [("b", 2), ("a", 1)]
    assert served(spark, path) == [("z", 5)]


def test_a_number_published_again_replaces_its_publication(spark, tmp_path):
    path = str(tmp_path / "p")
    for n, score in ((0, 1), (1, 2), (1, 3)):
        publications.publish(top(spark, a=score), path, n)
    assert publications.numbers(spark, path) == [0, 1]
    assert publications.newest(spark, path, schemas.TOP_WORDS).first().score == 3.0
    assert publications.newest(spark, path, schemas.TOP_WORDS, below=1).first().score == 1.0


def data_folders(path):
    return sorted(p.name.split("-")[0] for p in path.glob("publication=*"))


def test_readers_never_see_a_list_before_its_pointer(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    publications.publish(top(spark, a=1), path)

    def fails(*args):
        # All data is there, as after a slow copy, and readers still have the last list.
        assert data_folders(tmp_path / "p") == ["publication=0", "publication=1"]
        assert publications.newest(spark, path, schemas.TOP_WORDS).first().word == "a"
        raise OSError("the writer dies here")

    with monkeypatch.context() as patch:
        patch.setattr(publications, "_point", fails)
        with pytest.raises(OSError, match="dies"):
            publications.publish(top(spark, b=2), path)
    assert publications.newest(spark, path, schemas.TOP_WORDS).first().word == "a"
    publications.publish(top(spark, c=3), path)
    assert publications.newest(spark, path, schemas.TOP_WORDS).first().word == "c"


def test_unfinished_pointers_are_passed_over(spark, tmp_path):
    path = str(tmp_path / "p")
    publications.publish(top(spark, a=1), path)
    for half in ("", "publication=1-abc"):
        (tmp_path / "p" / "pointer=1.0").write_text(half)
        assert publications.newest(spark, path, schemas.TOP_WORDS).first().word == "a"


def test_of_two_writers_of_a_number_one_fails(spark, tmp_path, monkeypatch):
    path, point = str(tmp_path / "p"), publications._point

    def second_comes_first(*args):
        monkeypatch.setattr(publications, "_point", point)
        publications.publish(top(spark, second=2), path)
        point(*args)

    monkeypatch.setattr(publications, "_point", second_comes_first)
    with pytest.raises(FileExistsError, match="number 0"):
        publications.publish(top(spark, first=1), path)
    assert publications.numbers(spark, path) == [0]
    assert publications.newest(spark, path, schemas.TOP_WORDS).first().word == "second"


def test_what_failed_writers_left_is_removed_with_the_old(spark, tmp_path):
    path = str(tmp_path / "p")
    (tmp_path / "p" / "publication=0-left").mkdir(parents=True)
    for n in range(5):
        publications.publish(top(spark, a=n), path, keep=2)
        publications.publish(top(spark, a=n), path, n, keep=2)  # a batch that is repeated
    assert publications.numbers(spark, path) == [2, 3, 4]
    assert data_folders(tmp_path / "p") == ["publication=2"] * 2 + ["publication=3"] * 2 + [
        "publication=4"] * 2


def test_empty_list_leaves_the_last_snapshot(spark, tmp_path):
    path = str(tmp_path / "s")
    write_snapshot(top(spark, a=1), path)
    for _ in range(5):
        write_snapshot(spark.createDataFrame([], schemas.TOP_WORDS), path)
    assert served(spark, path) == [("a", 1)]


def test_scores_beyond_an_integer_are_served(spark, tmp_path):
    path = str(tmp_path / "s")
    write_snapshot(top(spark, a=3e9, b=2**31 - 1, c=1.9), path)
    assert served(spark, path) == [("a", 2**31 - 1), ("b", 2**31 - 1), ("c", 1)]
    assert json.loads(snapshot_json(read_snapshot(spark, path)).first().json)[0]["size"] == 2**31 - 1


def test_unreadable_snapshot_raises(spark, tmp_path):
    path = tmp_path / "s"
    write_snapshot(top(spark, a=1), str(path))
    (folder,) = (path / "live").glob("publication=0-*")
    for file in folder.glob("*.parquet"):
        file.write_bytes(b"not parquet")
        (folder / f".{file.name}.crc").unlink()
    with pytest.raises(Exception, match="(?i)parquet"):
        served(spark, str(path))


def test_json_document(spark):
    items = spark.createDataFrame(
        [("b", 2), ('"q"', 7), ("a", 2), ("é/<", 1)], schemas.CLOUD_ITEMS)
    text = snapshot_json(items).first().json
    assert text == '[{"text":"\\"q\\"","size":7},{"text":"a","size":2},' \
                   '{"text":"b","size":2},{"text":"é/<","size":1}]'
    assert json.loads(text)[0] == {"text": '"q"', "size": 7}


def test_json_of_nothing(spark):
    assert snapshot_json(spark.createDataFrame([], schemas.CLOUD_ITEMS)).first().json == "[]"
