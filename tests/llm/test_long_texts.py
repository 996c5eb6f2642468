"""A text of 50 MB in one slice: the memory that each operator's work on it takes, in a process of its own."""

import subprocess
import sys

import pytest

SETUP = """
import resource, sys
import numpy as np, pyarrow as pa
from visemill.llm.bytetext import Slice
part = np.random.default_rng(1).integers(97, 123, 5_000_000).astype(np.uint8)
part[np.random.default_rng(2).integers(0, len(part), 800_000)] = 32
data = np.tile(part, 10)
data[::1_000_003] = 65
s = Slice(data, np.array([0, len(data)]), np.array([False]), pa.RecordBatch.from_pydict({"doc_id": [1]}))
"""
WORK = {
    "op1": "import public_tokenizers; from visemill.llm.packing import WordEncoder; WordEncoder(public_tokenizers.path('word_bpe_49k.json')).encode(s.buf, s.off)",
    "op2": "from visemill.llm import ctw as m; text, off, word, _ = m.words_of(s); [m._tally(k, np.ones(len(k))) for k in m.grams_of(text, off, 6)[0]]",
    "op5": "from visemill.llm.suffix import anchors; np.unique(anchors(s, 50)[0], return_inverse=True)",
    "op8": "from visemill.llm.postings import words_of; np.unique(words_of(s.buf, s.off).hashes(), return_counts=True)",
    "op9": "from visemill.llm.windows import window_hashes; np.unique(window_hashes(s, 35)[2], return_inverse=True, return_counts=True)",
    "op10": "from visemill.llm.quality import statistics; statistics(s)",
}


@pytest.mark.parametrize("op", WORK)
def test_memory(op):
    code = SETUP + WORK[op] + "\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1000)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0], timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) < 1700, done.stdout
