"""Workers keep no memory between tasks that they do not use."""

import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql.classic.dataframe import DataFrame

import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"

HELD = """
import re, sys
from pathlib import Path
from unittest.mock import MagicMock
import pyarrow as pa
from termtide.llm import jaccard

def held():  # MB
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

def batches(n, rows=10_000):
    for k in range(n):
        texts = [" ".join(f"w{(i * 7919 + j * j + k) % 50_000}" for j in range(300)) for i in range(rows)]
        ids = pa.array(range(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["row", "doc_id", "text"])

jaccard.F = df = MagicMock()
df.select.return_value.mapInArrow.side_effect = InterruptedError
try:
    jaccard.shared_shingles(df)
except InterruptedError:
    run = df.select.return_value.mapInArrow.call_args.args[0]
before = held()
for found in run(batches(2)):
    pass
del found
print(held() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_pass_over_shingles_holds_little_when_it_is_through():
    done = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True,
                          cwd=Path(__file__).parents[2], timeout=300)
    assert float(re.findall(r"[\d.-]+", done.stdout)[-1]) < 50


def test_every_pass_of_the_pipeline_gives_memory_back(spark, monkeypatch):
    passed, real = [], DataFrame.mapInArrow

    def recorded(self, function, *args, **kwargs):
        passed.append(function)
        return real(self, function, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "mapInArrow", recorded)
    corpus_pipeline.run(spark, SF_DIR)
    assert len(passed) == 6 and all(hasattr(f, "__wrapped__") for f in passed)
