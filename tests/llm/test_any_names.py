"""Stages of the pipeline on tables with names that operators use themselves, nulls in any column, and no rows."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

NAMES = ["doc_id", "text", "lang", "source", "n_chars", "a.b", "row", "score", "gone", "__gone", "of", "places", "marks", "which", "size", "key", "words", "more", "part", "id", "ids", "nbest"]
TYPES = {"doc_id": "long", "n_chars": "long"}
SCHEMA = ", ".join(f"`{n}` {TYPES.get(n, 'string')}" for n in NAMES)
TEXT = "These words stand in several documents and make a passage of more than fifty bytes."


def rows():
    texts = [TEXT, TEXT, "x " + TEXT + " and more", None, "", "short", "word " * 300]
    out = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or ""), *[f"v{k}" for k in range(len(NAMES) - 5)]) for i, t in enumerate(texts)]
    return out + [out[0], (None, TEXT, *[None] * (len(NAMES) - 2)), tuple([None] * len(NAMES))]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, tmp_path, name, stage):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = stage(spark, docs, str(tmp_path))
    assert out.count() > 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == NAMES
        kept = {tuple(r)[5:] for r in out.collect()}
        assert kept <= {tuple(r)[5:] for r in rows()}
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
