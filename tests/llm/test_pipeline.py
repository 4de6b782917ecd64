import itertools
import os
import random

import corpus_pipeline
import pytest
from quillstone.llm import decontaminate, queries, segment

pytestmark = pytest.mark.skipif(not os.path.exists(segment.MODEL), reason="no vocabulary file")
BAD = ["vile", "foul", "nasty", "rotten", "beastly"]


def sentence(rng):
    return (" ".join(f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randrange(900)}" for _ in range(rng.randint(6, 10)))).capitalize() + "."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = str(tmp_path_factory.mktemp("tables"))
    items = [(i, " ".join(sentence(rng) for _ in range(4))) for i in range(10)]
    passage = " ".join(sentence(rng) for _ in range(9))
    docs, kind = [], {}
    for i in range(400):
        body = [sentence(rng) for _ in range(rng.randint(6, 20))]
        kind[i] = "clean"
        if i % 8 == 1:
            kind[i] = "toxic"
            body += [f"You {' '.join(rng.choices(BAD, k=4))} thing."]
        elif i % 8 == 2 and i > 100:
            kind[i] = "leak"
            body.insert(3, items[i % 10][1])
        elif i % 8 == 3:
            kind[i] = "passage"
            body.insert(2, passage)
        docs.append((i, " ".join(body), "en", "src", 1))
    docs += [(1000 + j, docs[16 + 8 * j][1], "en", "src", 1) for j in range(5)]
    docs += [(2000, None, None, None, None), (2001, "", "en", "", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    vectors = [(i, i % 3, [rng.random() for _ in range(8)]) for i in range(60)] + [(100 + i, 0, [1.0] * 7 + [0.01 * i]) for i in range(5)] + [(200, None, [1.0] * 8), (201, 0, None)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    labels = [(i, 1, int(kind[i] == "toxic")) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, kind, items, passage


def test_decisions_of_all_stages(spark, tables):
    folder, docs, kind, items, passage = tables
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == columns
    rows = corpus_pipeline.run(spark, folder).collect()
    left = {r.doc_id: r.text for r in rows}
    assert len(rows) == len(left)
    assert not [i for i in left if kind.get(i) == "toxic"]
    # Later copies of an item went as repeated lines; the documents with the first ones go.
    first = {i % 10: i for i in sorted(kind, reverse=True) if kind[i] == "leak"}
    assert not [i for i in first.values() if i in left]
    clean = [i for i in kind if kind[i] in ("clean", "passage")]
    assert len([i for i in clean if i in left]) >= len(clean) - 1
    assert sum(passage.split(". ")[4] in (t or "") for t in left.values()) == 1
    assert len([i for i in left if i >= 1000]) <= 1  # copies are emptied, and empty texts are one group
    texts = {i: t for i, t, *_ in docs}
    assert all(left[i] == texts[i] for i in clean if kind[i] == "clean" and i in left)
    assert all(r.exact in (True, None) and r.n_pieces == (len(r.ids) if r.ids is not None else -1) or r.ids is None for r in rows)
    hits = [decontaminate.nearest(x.lower().split(), (t or "").lower().split())[0] for (_, x), t in itertools.product(items, left.values())]
    assert min(hits) > 4


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, tables, name):
    folder, docs, *_ = tables
    got = queries.QUERIES[name](spark, folder)
    if name == "op4_pq_dedup":
        rows = {r.vec_id: r for r in got.collect()}
        assert len(rows) == 67 and [rows[100 + i].component_id for i in range(5)] == [100] * 5 and rows[100].n_links == 4
        assert rows[200].component_id == 200 and rows[201].n_links == 0
        return
    assert "doc_id" in got.columns
    found = got.select("doc_id").distinct().count()
    assert found == {"op2_decontaminate": 37, "op9_secrets": 0}.get(name, len(docs))


def test_stages_on_empty_tables(spark, tables, tmp_path):
    folder = tables[0]
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
