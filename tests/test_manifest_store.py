"""Manifests kept by increments, against the upsert of all entries at once."""

import json
import random

from pyspark.sql import functions as F

from rasterlake.operators import manifest, manifest_store
from rasterlake.operators.manifest_store import ManifestStore

SCHEMA = "k string, seq int, v int"


def entries(spark, seed, n=40):
    rng = random.Random(seed)
    return spark.createDataFrame([(rng.choice([None, *"abcdefghij"]), seed * 1000 + i, i) for i in range(n)], SCHEMA)


def found(df):
    return sorted((str(r.k), r.seq, r.v) for r in df.collect())


def test_ranges_of_numbers():
    ranges = []
    for n in (5, 1, 2, 9, 3, 4, 4):
        ranges = manifest_store.add_number(ranges, n)
    assert ranges == [[1, 5], [9, 9]]


def test_increments_equal_one_upsert(spark, tmp_path):
    store = ManifestStore(spark, f"file://{tmp_path}/m", ["k"], "seq", buckets=5)
    assert store.read(entries(spark, 0).schema).count() == 0 and store.compact() == []
    log = None
    for n in (3, 0, 2, 1, 7):
        batch = entries(spark, n)
        log = batch if log is None else log.unionByName(batch)
        assert store.commit(n, batch) and not store.commit(n, entries(spark, 99))
        if n in (0, 1):
            assert store.compact()
        assert found(store.read()) == found(manifest.upsert(log, ["k"], "seq"))
    store.vacuum()
    assert found(store.read()) == found(manifest.upsert(log, ["k"], "seq"))
    assert len(list((tmp_path / "m/_versions").glob("*.json"))) == 1
    assert store.version()[1]["batches"] == [[0, 3], [7, 7]]
    assert found(store.lookup(spark.createDataFrame([("a",), ("b",), ("nobody",)], "k string"))) == [r for r in found(store.read()) if r[0] in "ab"]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = ManifestStore(spark, f"file://{tmp_path}/m", ["k"], "seq", buckets=16)
    store.commit(0, spark.range(400).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").cast("int").alias("seq"), F.lit(0).alias("v")))
    assert len(store.compact()) == 16
    before = store.version()[1]["base"]
    store.commit(1, spark.createDataFrame([("k7", 1000, 1), ("k7", 999, 2)], SCHEMA))
    touched = store.compact()
    after = store.version()[1]["base"]
    assert len(touched) == 1 and [b for b in before if before[b] != after[b]] == [str(touched[0])]
    assert [(r.seq, r.v) for r in store.read().filter("k = 'k7'").collect()] == [(1000, 1)] and store.read().count() == 400
    files = {f.split("/m/")[1].rsplit("/", 1)[0] for f in store.lookup(spark.createDataFrame([("k7",)], "k string")).inputFiles() if "/m/" in f}
    assert files == {after[str(touched[0])]}


def test_writers_meet(spark, tmp_path, monkeypatch):
    """A second writer commits between the first one's reading and its publishing, then while it compacts."""
    path = f"file://{tmp_path}/m"
    one, two = (ManifestStore(spark, path, ["k"], "seq", buckets=4) for _ in range(2))
    publish = ManifestStore._publish
    first = []

    def late(self, number, content):
        if self is one and not first:
            first.append(number)
            assert two.commit(8, entries(spark, 8))
        return publish(self, number, content)

    monkeypatch.setattr(ManifestStore, "_publish", late)
    assert one.commit(5, entries(spark, 5))
    both = entries(spark, 5).unionByName(entries(spark, 8))
    assert found(one.read()) == found(manifest.upsert(both, ["k"], "seq"))

    def during(self, number, content):
        if self is one and len(first) == 1:
            first.append(number)
            assert two.commit(9, entries(spark, 9))
        return publish(self, number, content)

    monkeypatch.setattr(ManifestStore, "_publish", during)
    assert one.compact()
    assert len(one.version()[1]["deltas"]) == 1
    assert found(one.read()) == found(manifest.upsert(both.unionByName(entries(spark, 9)), ["k"], "seq"))


def test_half_written_attempts_are_not_read(spark, tmp_path):
    store = ManifestStore(spark, f"file://{tmp_path}/m", ["k"], "seq", buckets=4)
    store.commit(0, entries(spark, 0))
    want = found(store.read())
    (tmp_path / "m/_versions/attempt-x").write_text(json.dumps({"broken": True}))
    store._write(entries(spark, 3), "deltas/3-lost", 4)
    assert found(store.read()) == want
    store.vacuum()
    assert not (tmp_path / "m/deltas/3-lost").exists() and found(store.read()) == want
