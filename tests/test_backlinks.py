import pytest

from stratum.operators import reconcile


@pytest.mark.parametrize("few", [True, False])
def test_backlinks_by_rows_and_by_joins(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(reconcile, "bounded", lambda df: df)
    texts = ["Etcd backup; etcd", "the node name is x", "node  Name", "node-name", None, "", "a node. Name!", "NODE names", "-backup"]
    names = ["etcd", "node name", "Backup", "name is  x", "gone", "node, name", "the node name is x"]
    pages = spark.createDataFrame(list(enumerate(texts)), "page int, text string")
    entities = spark.createDataFrame([(x,) for x in names], "entity string")
    got = reconcile.entity_backlinks(pages, "page", "text", entities)
    assert {(r.entity, r.page) for r in got.collect()} == {("etcd", 0), ("Backup", 0), ("node name", 1), ("node name", 2), ("node name", 6), ("name is  x", 1), ("the node name is x", 1)}
    if few:  # pages are read once, and no text is joined with itself
        assert got._jdf.queryExecution().analyzed().toString().count("text#") < 8 and got._jdf.queryExecution().analyzed().collectLeaves().size() <= 3
