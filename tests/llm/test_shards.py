import pytest

from tickloom.llm import shards
from tickloom.llm.queries import ORACLE, QUERIES

from .conftest import EDGE_TEXTS, documents

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.collect()))


def test_tiers_and_versions(spark, tmp_path):
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat(sha2(string(id), 256), 4) AS text").repartition(4)
    store = shards.Store(spark, f"file://{tmp_path}/s", docs.schema, target_bytes=300_000, rows_a_shard=50)
    assert store.append(docs) == 1 and store.append(docs) == 2
    first = store.manifest()["files"]
    assert len(first) >= 80 and sum(f["rows"] for f in first) == 4000
    last = store.compact()
    files = store.manifest()["files"]
    assert last > 2 and len(files) < len(first) / 4 and not store.groups(files) and max(f["bytes"] for f in files) < 3 * store.target
    assert rows(store.read()) == rows(docs.union(docs)) == rows(store.read(2))
    store.vacuum(keep=1)
    assert store.versions() == [last] and rows(store.read()) == rows(docs.union(docs))
    with pytest.raises(shards.Conflict):
        store.commit(last, [], [], [])
    assert store.manifest()["version"] == last


def test_vacuum_beside_a_writer(spark, tmp_path):
    """A writer between its files and its commit loses nothing to vacuum(); one beyond the grace period fails, and no version breaks."""
    docs = documents(spark, EDGE_TEXTS)
    store = shards.Store(spark, f"file://{tmp_path}/s", docs.schema)
    store.append(docs)
    new, note = store._write(docs)
    store.vacuum()
    store.commit(2, new, [], [note])
    assert rows(store.read()) == rows(docs.union(docs))
    new, note = store._write(docs)
    store.vacuum(grace=-1)
    with pytest.raises(RuntimeError, match="grace"):
        store.commit(3, new, [], [note])
    assert store.versions() == [2] and rows(store.read()) == rows(docs.union(docs))
    store.append(docs)
    store.vacuum(grace=-1)
    assert rows(store.read()) == rows(docs.union(docs).union(docs)) and not list((tmp_path / "s" / "writing").glob("[0-9a-f]*"))


def test_manifests_hold_what_is_new(spark, tmp_path, monkeypatch):
    import json

    monkeypatch.setattr(shards, "SNAPSHOT", 3)
    docs = documents(spark, EDGE_TEXTS)
    store = shards.Store(spark, f"file://{tmp_path}/s", docs.schema)
    for n in range(1, 8):
        assert store.append(docs.coalesce(1)) == n
    files = {p.name: json.loads(p.read_text()) for p in (tmp_path / "s" / "manifest").glob("[sv]*.json")}
    assert sorted(files) == [f"s{n:08d}.json" for n in (3, 6)] + [f"v{n:08d}.json" for n in range(1, 8)]
    assert all(len(files[f"v{n:08d}.json"]["add"]) == 1 for n in range(1, 8)) and len(files["s00000006.json"]["files"]) == 6
    assert [len(store.manifest(n)["files"]) for n in range(1, 8)] == list(range(1, 8))
    store.vacuum(keep=2)
    assert store.versions() == [6, 7] and [len(store.manifest(n)["files"]) for n in (6, 7)] == [6, 7]


def test_edge_cases(spark, tmp_path):
    docs = documents(spark, EDGE_TEXTS)
    store = shards.Store(spark, f"file://{tmp_path}/s", docs.schema, rows_a_shard=2)
    assert rows(store.read()) == []
    assert store.compact() == 0
    store.append(docs.limit(0))
    assert rows(store.read()) == []
    store.append(docs.withColumn("path", docs.doc_id))
    store.compact()
    store.vacuum()
    assert rows(store.read()) == rows(docs)


def test_query(spark):
    import duckdb

    found = QUERIES["op1_sharding"](spark, SF)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(c.sql(ORACLE["op1_sharding"]).fetchall())
