import os
import random
import subprocess
import sys

import pytest
from quillstone.llm import segment

pytestmark = pytest.mark.skipif(not os.path.exists(segment.MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=segment.MODEL)


TEXTS = [
    "Hello  world\n a", "", " ", "\t", "é ß 你好 🙂", "a▁b", "ＡＢ ﬁ", "x\xa0y", "     five   spaces      ", "x" * 300,
    "   " + "y" * 300, "\x00a\x00b", " " * 40 + "z", " " * 40, "\n\n \n", "The same. " * 3000,
]


def test_pieces_equal_the_library(library):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("ab\n ▁éß你🙂 the ing er.,", k=rng.randint(1, 60))) for _ in range(1500)]
    own = segment.Pieces(segment.MODEL)
    assert own.encode(texts) == [library.encode(t) for t in texts]
    assert all(own.decode(x) == t for x, t in zip(own.encode(texts), texts, strict=True) if segment.SPACE not in t)


def test_edges_are_all_occurrences():
    own = segment.load(segment.MODEL)
    text = "▁the▁therein"
    codes = own.code[list(map(ord, text))]
    got = sorted((int(s), int(e), own.text[p]) for s, e, p in zip(*own.edges(codes), strict=True))
    want = sorted((i, j, text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text[i:j] in own.id)
    assert got == want


def test_table(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "a b", ""), (3, "\t", ""), (99, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = segment.encode(docs).collect()
    assert len(got) == len(rows)
    for r, (i, t, _) in zip(got, rows, strict=True):
        assert r.doc_id == i and r.ids == (None if t is None else library.encode(t))
        assert r.exact == (None if t is None else segment.SPACE not in t)
    assert segment.encode(docs.limit(0)).count() == 0


def test_long_runs_of_blanks_equal_the_library(library):
    texts = [f"{blank * n}{word * 250}" for n in range(1, 65) for blank in (" ", segment.SPACE) for word in ("y", "aB3")] + [" " * n for n in range(200, 421)]
    own = segment.Pieces(segment.MODEL)
    assert own.encode(texts) == [library.encode(t) for t in texts]


HELD = """
import random, re
import pyarrow as pa
from quillstone.llm import segment
from quillstone.llm.common import pieces

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

own, rng, most = segment.load(segment.MODEL), random.Random(3), 0
began = held()
texts = pa.array([" ".join("".join(rng.choices("abcdeilmnorstu", k=8)) for _ in range(350)) for _ in range(3000)])
for piece in pieces(iter([pa.record_batch([texts], names=["text"])]), segment.ROWS, segment.BYTES):
    own.coded(piece.column(0).to_pylist())
    most = max(most, held() - began)
own.known, own.older = {}, {}
print(most, held() - began)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="needs Linux")
def test_a_worker_gives_back_what_its_task_freed():
    run = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    most, left = map(float, run.stdout.split())
    assert most < 220 and left < 140
