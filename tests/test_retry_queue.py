"""The queue of tasks: retries, leases that end, claims that meet, and drivers that start again."""

import pytest
from pyspark.sql import functions as F

from rasterlake.operators.manifest_store import ManifestStore
from rasterlake.operators.retry_queue import RetryQueue, fixed, linear


def queue(spark, path, **kw):
    return RetryQueue(ManifestStore(spark, f"file://{path}/q", ["k"], "seq", buckets=4), **kw)


def states(q):
    return {r.k: (r.state, r.attempt, r.due) for r in q.tasks().collect()}


def results(claimed, error, retryable=True):
    return claimed.withColumns({"error": F.lit(error).cast("string"), "retryable": F.lit(retryable)})


def test_tasks_are_retried_until_they_fail_for_good(spark, tmp_path):
    q = queue(spark, tmp_path, retries=2, wait=linear(10))
    assert q.add(spark.createDataFrame([("a",), ("b",), ("b",)], "k string")).count() == 2
    assert q.add(spark.createDataFrame([("a",), ("c",)], "k string"), 3.0).count() == 1
    first = q.claim(0)
    assert {r.k for r in first.collect()} == {"a", "b"} and q.claim(1).count() == 0
    q.report(results(first.filter("k = 'a'"), None), 5)
    q.report(results(first.filter("k = 'b'"), "HTTP 500"), 5)
    assert states(q) == {"a": ("done", 0, 5.0), "b": ("waiting", 1, 15.0), "c": ("waiting", 0, 3.0)}
    assert q.next_due() == 3.0 and {r.k for r in q.claim(3).collect()} == {"c"}
    again = queue(spark, tmp_path, retries=2, wait=linear(10))  # another driver goes on
    for now, due in ((15, 35.0), (35, 35.0)):
        claimed = again.claim(now)
        again.report(results(claimed.filter("k = 'b'"), "HTTP 500"), now)
        assert states(again)["b"][2] == due
    assert states(again)["b"] == ("failed", 2, 35.0)
    assert again.tasks().filter("k = 'b'").first().error == "HTTP 500"


def test_errors_that_allow_no_retry(spark, tmp_path):
    q = queue(spark, tmp_path, retries=5, wait=fixed(3))
    q.add(spark.createDataFrame([("a",)], "k string"))
    q.report(results(q.claim(0), "bad request", False), 1)
    assert states(q) == {"a": ("failed", 0, 1.0)} and q.next_due() is None


def test_leases_end(spark, tmp_path):
    q = queue(spark, tmp_path, retries=1, wait=fixed(3), lease=100)
    q.add(spark.createDataFrame([("a",)], "k string"))
    lost = q.claim(0)
    assert q.next_due() == 100 and q.claim(99).count() == 0
    second = q.claim(100)
    assert [(r.k, r.attempt) for r in second.collect()] == [("a", 1)]
    assert q.report(results(lost, None), 101).count() == 0  # the first claim's answer comes too late
    assert states(q)["a"][0] == "claimed"
    assert q.claim(300).count() == 0
    assert states(q)["a"][0] == "failed" and q.tasks().first().error == "the lease ended"


def test_two_claims_meet(spark, tmp_path, monkeypatch):
    one, two = queue(spark, tmp_path), queue(spark, tmp_path)
    one.add(spark.createDataFrame([("a",), ("b",)], "k string"))
    commit, met = ManifestStore.commit, []

    def late(self, *args, **kw):
        if self is one.store and not met:
            met.append(two.claim(0).count())
        return commit(self, *args, **kw)

    monkeypatch.setattr(ManifestStore, "commit", late)
    assert one.claim(0).count() == 0 and met == [2]
    with pytest.raises(ValueError, match="seq"):
        RetryQueue(ManifestStore(spark, f"file://{tmp_path}/x", ["k"], "n"))
