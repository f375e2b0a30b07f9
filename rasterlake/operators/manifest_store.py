"""A manifest kept by increments: a bucketed base, deltas, and versions that name both.

A batch of entries is reduced to the last one of each key and written once, dealt by a hash
of the key into buckets.  A version is a small file that names the base folder of each
bucket and the deltas beyond it; it is written whole and renamed to the next number, which
fails where another writer was first.  So a reader sees one version and all of it, a batch
that is tried again changes nothing, and of two writers one takes the next number.

``compact`` folds deltas into new base folders of the buckets that they touch; no other
bucket is read or written.  ``vacuum`` deletes what the newest version no longer names.

The folder needs a rename that is atomic and fails where the name is taken, as HDFS and
shared POSIX folders have it; object stores don't.

The version file grows with the buckets and with the deltas since the last compaction, never
with the entries; numbers of committed batches are kept as ranges.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import delete
from .manifest import upsert

#: Tries of a commit whose number another writer took.
TRIES = 20


def add_number(ranges: list[list[int]], n: int) -> list[list[int]]:
    """Sorted, apart ranges (first, last) with ``n``."""
    out: list[list[int]] = []
    for a, b in sorted([*ranges, [n, n]]):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


class ManifestStore:
    """The last entry of each key by ``seq``; entries with a null key are all kept."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], seq: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.seq, self.buckets = spark, path.rstrip("/"), keys, seq, buckets
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        top = self._file(self.path)
        self.fs = top.getFileSystem(self.conf)
        self.fs.mkdirs(self._file(f"{self.path}/_versions"))

    def _file(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    # versions

    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._file(f"{self.path}/_versions"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self) -> tuple[int, dict]:
        """The newest version's number and content."""
        numbers = self._numbers()
        if not numbers:
            return 0, {"schema": None, "buckets": self.buckets, "base": {}, "deltas": [], "batches": []}
        stream = self.fs.open(self._file(f"{self.path}/_versions/{numbers[-1]}.json"))
        try:
            return numbers[-1], json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, number: int, content: dict) -> bool:
        """Write version ``number``; False where it is taken."""
        attempt = self._file(f"{self.path}/_versions/attempt-{uuid.uuid4().hex}")
        out = self.fs.create(attempt)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(attempt).toUri(), self.conf)
        try:
            context.rename(attempt, self._file(f"{self.path}/_versions/{number}.json"), self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
            return True
        except Exception as e:
            self.fs.delete(attempt, False)
            if "AlreadyExists" not in str(e):
                raise
            return False

    # writing

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str, buckets: int) -> None:
        rows.withColumn("__bucket", self._bucket(buckets)).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")

    def _touched(self, folder: str) -> list[int]:
        return sorted(int(s.getPath().getName().split("=")[1]) for s in self.fs.listStatus(self._file(f"{self.path}/{folder}")) if "=" in s.getPath().getName())

    def commit(self, batch: int, entries: DataFrame, after: int | None = None) -> bool:
        """Add a batch; False, and nothing changes, if one of its number was committed before, or if version ``after`` (where given) isn't the newest any more."""
        folder = None
        for _ in range(TRIES):
            number, now = self.version()
            if any(a <= batch <= b for a, b in now["batches"]) or (after is not None and number != after):
                break
            if folder is None:
                folder = f"deltas/{batch}-{uuid.uuid4().hex}"
                self._write(upsert(entries, self.keys, self.seq), folder, now["buckets"])
            schema = now["schema"] or json.loads(entries.schema.json())
            added = {"folder": folder, "buckets": self._touched(folder)}
            if self._publish(number + 1, now | {"schema": schema, "deltas": [*now["deltas"], added], "batches": add_number(now["batches"], batch)}):
                return True
        else:
            raise RuntimeError(f"batch {batch}: other writers took {TRIES} versions")
        if folder is not None:
            delete(self.spark, f"{self.path}/{folder}")
        return False

    def compact(self) -> list[int]:
        """Fold the deltas into the base of the buckets they touch; these buckets."""
        number, now = self.version()
        folded, before = now["deltas"], now["base"]
        touched = sorted({b for d in folded for b in d["buckets"]})
        if not touched:
            return []
        folder = f"base/{uuid.uuid4().hex}"
        self._write(upsert(self._rows(now, touched), self.keys, self.seq), folder, now["buckets"])
        base = before | {str(b): f"{folder}/__bucket={b}" for b in self._touched(folder)}
        for _ in range(TRIES):
            # batches that were committed meanwhile stay as deltas
            if self._publish(number + 1, now | {"base": base, "deltas": [d for d in now["deltas"] if d not in folded]}):
                return touched
            number, now = self.version()
            if now["base"] != before:
                break  # another compaction came first: this one's work is dropped
        delete(self.spark, f"{self.path}/{folder}")
        return []

    def vacuum(self) -> None:
        """Delete folders and versions that the newest version does not name.  While no one reads or writes."""
        number, now = self.version()
        named = {d["folder"] for d in now["deltas"]} | set(now["base"].values())
        for kind in ("deltas", "base"):
            top = self._file(f"{self.path}/{kind}")
            for s in self.fs.listStatus(top) if self.fs.exists(top) else []:
                name = f"{kind}/{s.getPath().getName()}"
                inner = [f"{name}/__bucket={b}" for b in self._touched(name)] if kind == "base" else [name]
                gone = [x for x in inner if x not in named]
                for x in [name] if len(gone) == len(inner) else gone:
                    delete(self.spark, f"{self.path}/{x}")
        for n in self._numbers():
            if n < number:
                self.fs.delete(self._file(f"{self.path}/_versions/{n}.json"), False)

    # reading

    def _rows(self, now: dict, buckets: list[int] | None = None) -> DataFrame:
        """All rows of a version's base and deltas, of some buckets or all."""
        schema = T.StructType.fromJson(now["schema"])
        wanted = lambda b: buckets is None or b in buckets
        paths = [f"{self.path}/{f}" for b, f in now["base"].items() if wanted(int(b))]
        paths += [f"{self.path}/{d['folder']}/__bucket={b}" for d in now["deltas"] for b in d["buckets"] if wanted(b)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, schema: T.StructType | None = None) -> DataFrame:
        """The manifest of the newest version; ``schema`` is that of a store without any batch."""
        _, now = self.version()
        if now["schema"] is None:
            return self.spark.createDataFrame([], schema or T.StructType([]))
        return upsert(self._rows(now), self.keys, self.seq)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The entries of some keys; only their buckets are read."""
        _, now = self.version()
        buckets = [r[0] for r in wanted.select(self._bucket(now["buckets"])).distinct().collect()]  # a row a bucket at most
        return upsert(self._rows(now, buckets), self.keys, self.seq).join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")
