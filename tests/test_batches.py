import numpy as np
import pyarrow as pa

from stratum.operators import retrieval as r
from stratum.plans import catalog
from stratum.sources.tables import BATCHES


def test_queries_give_python_small_batches(spark):
    for name in BATCHES:
        spark.conf.unset(name)
    catalog.QUERIES["chunk_pack"](spark, "/root/testdata/sf0.001")
    assert all(int(spark.conf.get(name).rstrip("bB")) <= most for name, most in BATCHES.items())


def test_vectors_are_packed_across_batches():
    batch = lambda a, b: pa.record_batch([pa.array(range(a, b)), pa.array([[float(i + 1), 1.0] for i in range(a, b)])], names=["id", "vector"])
    told = [row for out in r._packed(4)(iter([batch(0, 3), batch(3, 6), batch(6, 10)])) for row in out.to_pylist()]
    assert [np.frombuffer(t["ids"], np.int64).tolist() for t in told] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert all(np.allclose((np.frombuffer(t["data"]).reshape(-1, 2) ** 2).sum(axis=1), 1) for t in told)
