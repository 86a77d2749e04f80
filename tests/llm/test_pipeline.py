"""The pipeline's stages on a small table, each against what it must drop and keep."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ran sel tim von wup xar yel zin".split()]


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(1)
    make = lambda n: " ".join(rng.choice(WORDS, n))
    bench = make(30)
    rows, labels = [], []
    for i in range(240):
        words = make(80)
        if i % 6 == 0:
            words = f"{words[:200]} dreadful {words[200:]} dreadful"
        rows.append((i, words))
        labels.append((i, 1, int(i % 6 == 0)))
    base = make(400)
    rows += [(1000, rows[1][1]), (1001, rows[1][1]), (1002, base), (1003, base.replace(" ", "  ")), (1004, f"{make(50)} {bench} {make(50)}"), (1005, None)]
    frame = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs, kept = frame, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns, name
        kept.append({r.doc_id for r in docs.collect()})
    toxic = {i for i in range(240) if i % 6 == 0}
    assert len(toxic & kept[0]) <= 6 and len(kept[0] - toxic) >= 200
    assert {1, 1000} & kept[1] == set() and 1001 in kept[1]
    assert 1002 in kept[2] and 1003 not in kept[2]
    assert kept[2] - kept[3] == {1004}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == kept[3]
