import os
import re

import pytest

from stratum.llm import mixing, near_dedup, repeats, toxicity

from .test_near_dedup import brute as near_brute
from .test_repeats import brute as repeats_brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_each_stage_on_its_own_input(spark, tmp_path):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        path = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.dtypes == inputs[0].dtypes, name
    rows = [{(r.doc_id, r.text) for r in d.collect()} for d in inputs]
    ids = [{i for i, _ in r} for r in rows]
    toxic = {r.doc_id for r in toxicity.classify(inputs[0], spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    assert ids[1] == ids[0] - toxic
    assert ids[2] == {i for i, _, _, kept in near_brute(sorted(rows[1])) if kept}
    removed = {i: n for i, _, n, _, _ in repeats_brute(sorted(rows[2]))}
    before = dict(rows[2])
    assert ids[3] == ids[2]
    for i, text in rows[3]:
        left = len(before[i].encode()) - removed[i]
        assert left - 6 * (1 + removed[i] // 50) <= len(text.encode()) <= left
    taken = {r.doc_id: r.taken for r in mixing.mix(inputs[3]).collect()}
    mixed = {}
    for r in inputs[4].collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + len(re.findall(mixing.WORD, r.text))
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in mixed.items() if n}
    texts = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in inputs[4].collect())
    assert sorted((r.doc_id, r.decoded_sha256) for r in docs.collect()) == texts
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
