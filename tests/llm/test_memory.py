"""Memory that tasks have freed goes back to the system, so idle Python workers don't hold it beside the JVM's stages."""

import subprocess
import sys
from pathlib import Path

PROGRAM = """
import re, sys
import numpy as np, pyarrow as pa
from quarry.llm import jaccard

class Docs:  # hands out the task that would run on the batches
    select = groupBy = lambda self, *_: self
    mapInArrow = applyInArrow = lambda self, run, _: run

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024

def batches(rng):
    for k in range(3):
        texts = [" ".join(map(str, rng.integers(0, 10**6, 300).tolist())) for _ in range(6_000)]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(range(k * 6_000, (k + 1) * 6_000)), "text": texts, "key": pa.array(rng.integers(0, 10**9, 6_000))})

jaccard.row_key = lambda: None
run = jaccard.surveyed(Docs(), 5, 4, 8)
for _ in run(batches(np.random.default_rng(0))):
    pass
print(held())
"""


def test_survey_leaves_little():
    got = subprocess.run([sys.executable, "-c", PROGRAM], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300, check=True)
    assert int(got.stdout) < 110
