"""A table that is published again and again while others read it.

Every publication is a folder of data that never changes, and a small pointer that names it. The data is
written where it stays, under a name of its own, and the pointer is created last, under the next number and
never over another: readers look for the newest pointer, so they see a list whole or not at all, also
on object stores, where a folder cannot be renamed at once. A pointer that is not complete yet is
passed over. Of two writers of a number one fails. Old ones are removed after the switch.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Publications that stay for readers that have opened them.
KEEP = 20
_POINTER, _DATA, _END = "pointer=", "publication=", "\n"


def _folder(spark: SparkSession, path: str):
    """The file system of ``path`` and the path, as Hadoop objects."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    files, place = _folder(spark, path)
    if not files.exists(place):
        return []
    return [entry.getPath().getName() for entry in files.listStatus(place)]


def _pointers(names: list[str]) -> list[tuple[int, int]]:
    """(number, attempt) of the pointers among ``names``, ascending."""
    own = (n[len(_POINTER):].split(".") for n in names if n.startswith(_POINTER))
    return sorted((int(number), int(attempt)) for number, attempt in own)


def _data_number(name: str) -> int:
    return int(name[len(_DATA):].split("-")[0])


def _target(spark: SparkSession, path: str, pointer: tuple[int, int]) -> str | None:
    """The data folder that a pointer names; None while it is being written or has been removed."""
    files, place = _folder(spark, f"{path}/{_POINTER}{pointer[0]}.{pointer[1]}")
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return f"{path}/{text[:-1]}" if text.endswith(_END) else None


def _point(spark: SparkSession, path: str, pointer: tuple[int, int], data: str) -> None:
    files, place = _folder(spark, f"{path}/{_POINTER}{pointer[0]}.{pointer[1]}")
    try:
        stream = files.create(place, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        raise FileExistsError(f"another writer has published number {pointer[0]} of {path}") from error
    stream.writeBytes(data + _END)
    stream.close()


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the publications below ``path``, ascending."""
    return sorted({number for number, _ in _pointers(_names(spark, path))})


def publish(df: DataFrame, path: str, number: int | None = None, *, keep: int = KEEP,
            skip_empty: bool = False) -> bool:
    """Publish ``df`` under the next number, or under ``number``, where it takes the place of what
    has it. Raises FileExistsError if another writer publishes the same number meanwhile.

    With ``skip_empty`` an empty table publishes nothing. ``df`` is computed once.
    """
    spark = df.sparkSession
    before = _pointers(_names(spark, path))
    if number is None:
        number = before[-1][0] + 1 if before else 0
    attempt = max((a for n, a in before if n == number), default=-1) + 1
    name = f"{_DATA}{number}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    if skip_empty and spark.read.schema(df.schema).parquet(f"{path}/{name}").isEmpty():
        files, place = _folder(spark, f"{path}/{name}")
        files.delete(place, True)
        return False
    _point(spark, path, (number, attempt), name)
    _remove_old(spark, path, {n for n, _ in before if n != number}, keep)
    return True


def _remove_old(spark: SparkSession, path: str, before: set[int], keep: int) -> None:
    """Remove all but the last ``keep`` numbers of ``before``: pointers first, then their data and what
    writers that failed have left among them."""
    old = sorted(before)[:-keep]
    if not old:
        return
    for name in _names(spark, path):
        if name.startswith(_POINTER) and int(name[len(_POINTER):].split(".")[0]) <= old[-1]:
            files, place = _folder(spark, f"{path}/{name}")
            files.delete(place, False)
    for name in _names(spark, path):
        if name.startswith(_DATA) and _data_number(name) <= old[-1]:
            files, place = _folder(spark, f"{path}/{name}")
            files.delete(place, True)


def newest(spark: SparkSession, path: str, schema: T.StructType, *,
           below: int | None = None) -> DataFrame:
    """The newest publication, of those with a number ``below`` if given; typed and empty if there
    is none. Which one it is, is settled by the call."""
    for pointer in reversed(_pointers(_names(spark, path))):
        if below is not None and pointer[0] >= below:
            continue
        data = _target(spark, path, pointer)
        if data is not None:
            return spark.read.schema(schema).parquet(data)
    return spark.createDataFrame([], schema)
