"""A restartable queue of tasks with due times, claims and retries, kept in a manifest store.

A task is waiting (until it is due), claimed (until its lease ends), done or failed.  Every
step is a batch of the store, made from the version that it read and refused if another
writer was first; then it is made anew.  So no task is claimed twice at a time, a step is
there whole or not at all, and a driver that dies leaves nothing but leases that end: the
next one goes on from the store.

Times are seconds by any clock that only rises (the caller's ``now``), so a run can be
played again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .manifest_store import TRIES, ManifestStore

STATE = ["state", "attempt", "due", "lease", "claim", "error"]


def exponential(base: float = 5.0, cap: float = 60.0) -> Callable[[Column], Column]:
    """Seconds after the n-th attempt (from 0): doubling up to a cap."""
    return lambda attempt: F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), attempt))


def linear(base: float) -> Callable[[Column], Column]:
    return lambda attempt: base * (attempt + 1)


def fixed(wait: float) -> Callable[[Column], Column]:
    return lambda attempt: F.lit(float(wait))


class RetryQueue:
    """``retries`` more attempts after the first; ``wait`` gives the seconds after the n-th."""

    def __init__(self, store: ManifestStore, retries: int = 5, wait: Callable[[Column], Column] | None = None, lease: float = 1800.0):
        if store.seq != "seq":
            raise ValueError("the store of a queue orders its entries by seq")
        self.store, self.retries, self.wait, self.lease = store, retries, wait or exponential(), lease

    def _step(self, make: Callable[[DataFrame | None, int], DataFrame]) -> DataFrame:
        """Commit the entries that ``make`` finds in the newest version (None before the first); these entries."""
        for _ in range(TRIES):
            number, now = self.store.version()
            entries = staged(make(None if now["schema"] is None else self.store.read(), number + 1), "queue")
            if self.store.commit(number, entries, after=number):
                return entries
        raise RuntimeError(f"other writers took {TRIES} versions")

    def add(self, tasks: DataFrame, now: float = 0.0) -> DataFrame:
        """Tasks (the store's keys) that the queue doesn't hold; they are due at once.  Those that it added."""
        keys = self.store.keys

        def fresh(held: DataFrame | None, seq: int) -> DataFrame:
            new = tasks.select(*keys).distinct() if held is None else tasks.select(*keys).distinct().join(held, keys, "left_anti")
            return new.select(*keys, *_state("waiting", F.lit(0), F.lit(float(now))), F.lit(seq).cast("long").alias("seq"))

        return self._step(fresh)

    def claim(self, now: float) -> DataFrame:
        """Claim every task that is due, or whose lease has ended (that attempt counts as made); their keys, ``attempt`` and ``claim``."""
        claim = uuid.uuid4().hex

        def due(held: DataFrame | None, seq: int) -> DataFrame:
            if held is None:
                raise ValueError("the queue has no tasks")
            lost = (F.col("state") == "claimed") & (F.col("lease") <= now)
            spent = lost & (F.col("attempt") >= self.retries)
            ready = held.filter(((F.col("state") == "waiting") & (F.col("due") <= now)) | lost)
            state, attempt = F.when(spent, "failed").otherwise("claimed"), F.col("attempt") + (lost & ~spent).cast("int")
            return ready.select(
                *self.store.keys, *_state(state, attempt, F.col("due"), F.when(~spent, now + self.lease), F.when(~spent, claim), F.when(spent, "the lease ended")),
                F.lit(seq).cast("long").alias("seq")
            )

        return self._step(due).filter("state = 'claimed'").select(*self.store.keys, "attempt", "claim")

    def report(self, results: DataFrame, now: float) -> DataFrame:
        """Results of claimed tasks (keys, ``claim``, ``error``: null when it went well, ``retryable``); the new entries.

        A task that may be tried again is due after its wait; results of a claim that the
        task no longer has are left out.
        """
        keys = self.store.keys
        given = results.select(*keys, "claim", F.col("error").alias("__error"), F.coalesce("retryable", F.lit(False)).alias("__again")).dropDuplicates([*keys, "claim"])

        def told(held: DataFrame | None, seq: int) -> DataFrame:
            if held is None:
                raise ValueError("the queue has no tasks")
            met = held.filter("state = 'claimed'").join(given, [*keys, "claim"])
            again = F.col("__error").isNotNull() & F.col("__again") & (F.col("attempt") < self.retries)
            state = F.when(F.col("__error").isNull(), "done").when(again, "waiting").otherwise("failed")
            due = F.when(again, now + self.wait(F.col("attempt"))).otherwise(now)
            return met.select(*keys, *_state(state, F.col("attempt") + again.cast("int"), due, error=F.col("__error")), F.lit(seq).cast("long").alias("seq"))

        return self._step(told)

    def tasks(self) -> DataFrame:
        """Every task as it stands."""
        return self.store.read()

    def next_due(self) -> float | None:
        """When the next task is due or the next lease ends; None when all are done or failed."""
        at = F.when(F.col("state") == "waiting", F.col("due")).when(F.col("state") == "claimed", F.col("lease"))
        return self.tasks().agg(F.min(at)).first()[0]


def _state(state: str | Column, attempt: Column, due: Column, lease: Column | None = None, claim: Column | None = None, error: Column | None = None) -> list[Column]:
    none = F.lit(None)
    values = [F.lit(state) if isinstance(state, str) else state, attempt, due, lease if lease is not None else none, claim if claim is not None else none, error if error is not None else none]
    return [v.cast(t).alias(c) for v, t, c in zip(values, ("string", "int", "double", "double", "string", "string"), STATE, strict=True)]
