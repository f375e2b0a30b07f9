"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the smallest hash among its s-mers stands at
its first or last place.  Whether it is depends on the k-mer alone, so a passage keeps
its anchors wherever it is moved.  A fingerprint holds all distinct anchors, each with
the place where it first stands, as base64 of (hash, place) pairs by rising hash; it
grows with the text, so a passage that long texts share stays visible.

The likeness of two fingerprints is the share, among the hashes of both together, of
anchors that both hold in the same order: the longest chain whose places rise on both
sides (inserted or removed text shifts places, not their order).

Defined cases: null counts as the empty text; texts too short for an anchor have one,
of the whole text; the empty text's fingerprint is the empty string, like another empty
one with 1 and anything else with 0.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import partitions, small_batches, table, text_of, trim

K, S = 16, 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(*exponents: int) -> list[np.uint64]:
    return [np.uint64(pow(int(_BASE), e, 1 << 64)) for e in exponents]


_P1, _P2, _P4, _P8, _P12 = _powers(1, 2, 4, 8, 12)


def _mixed(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(32))) * _MIX
    return v ^ (v >> np.uint64(29))


def anchors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the hashes of its distinct closed syncmers, rising, and their first places."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    found = np.zeros(0, np.int64)
    hashes = np.zeros(0, np.uint32)
    if total >= K:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        v1 = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
        v1 ^= v1 >> np.uint64(31)
        v2 = v1[:-1] * _P1 + v1[1:]
        v4 = v2[:-2] * _P2 + v2[2:]
        a = (_mixed(v4[:-1] * _P1 + v1[4:]) >> np.uint64(32)).astype(np.uint32)  # hash of the s-mer at each place
        m2 = np.minimum(a[:-1], a[1:])
        m4 = np.minimum(m2[:-2], m2[2:])
        m8 = np.minimum(m4[:-4], m4[4:])
        least = np.minimum(m8[:-4], m4[8:])  # over the K - S + 1 = 12 s-mers of a k-mer
        n = total - K + 1
        found = np.flatnonzero((least[:n] == a[:n]) | (least[:n] == a[K - S : K - S + n]))
        of = np.searchsorted(ends, found, "right")
        found = found[found + K <= ends[of]]
        hashes = (_mixed(v4[found] * _P12 + v4[found + 4] * _P8 + v4[found + 8] * _P4 + v4[found + 12]) >> np.uint64(32)).astype(np.uint32)
    cuts = np.searchsorted(found, np.concatenate([[0], ends]))
    out = []
    for i, t in enumerate(texts):
        lo, hi = cuts[i], cuts[i + 1]
        if lo < hi:
            h, first = np.unique(hashes[lo:hi], return_index=True)
            out.append((h, found[lo:hi][first] - (ends[i] - lengths[i])))
        elif t:
            h = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")
            out.append((np.array([h], np.uint32), np.zeros(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint32), np.zeros(0, np.int64)))
    return out


def sketch(texts: list[str]) -> list[np.ndarray]:
    """Each text's fingerprint as rows of (hash, place)."""
    return [np.stack([h, p.astype(np.uint32)], 1) for h, p in anchors(texts)]


def encoded(rows: np.ndarray) -> str:
    return base64.b64encode(rows.astype("<u4").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4").reshape(-1, 2)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Likeness of two fingerprints' rows, 0 to 1."""
    if x.shape == y.shape and np.array_equal(x, y):
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    common, i, j = np.intersect1d(x[:, 0], y[:, 0], assume_unique=True, return_indices=True)
    distinct = len(x) + len(y) - len(common)
    if not len(i):
        return 0.0
    tails: list[int] = []  # longest chain of places that rise on both sides
    for p in y[j[np.argsort(x[i, 1], kind="stable")], 1].tolist():
        k = bisect_left(tails, p)
        if k == len(tails):
            tails.append(p)
        else:
            tails[k] = p
    return len(tails) / distinct


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``n_chars`` and ``fingerprint`` of every document.  A map over the rows, without a shuffle."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    schema = T.StructType([source.schema[0], T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                part = texts[a:b]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in part], pa.int64()), pa.array([encoded(x) for x in sketch(part)], pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


def in_ranges(docs: DataFrame, key: str, within: str, per_partition: int = 4) -> DataFrame:
    """``docs`` with ``__range``, which falls along the order by falling ``key`` (a long) and, for equal keys, rising ``within`` (63 bits of a hash).

    Ranges hold about equal counts, a few times as many as there are shuffle partitions,
    so that a hash of them deals evenly.  A key with the rows of several ranges is cut
    into as many by ``within``.
    """
    from pyspark.ml.feature import Bucketizer

    wanted = max(64, per_partition * partitions(docs.sparkSession))
    bounds = docs.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)], 20 * wanted).alias("b")).first()["b"] or []
    if not bounds:
        return docs.withColumn("__range", F.lit(0).cast("long"))
    times = Counter(bounds)
    cut = Bucketizer(splits=[-float("inf"), *sorted({float(b) for b in bounds}), float("inf")], inputCol="__place", outputCol="__cut")
    placed = cut.transform(docs.withColumn("__place", F.col(key).cast("double")))
    # a hot key is the lowest of its range, so its own ranges come after the range's other keys
    hot = {b: n for b, n in times.items() if n > 1}
    most = max(times.values()) + 1
    sub = F.lit(0)
    if hot:
        n = F.try_element_at(F.create_map(*[F.lit(x).cast("long") for pair in hot.items() for x in pair]), F.col(key))
        sub = F.coalesce(1 + F.least(n - 1, F.floor(F.col(within) / float(1 << 63) * n)), F.lit(0))
    return placed.withColumn("__range", F.col("__cut").cast("long") * most + (most - 1 - sub)).drop("__place", "__cut")


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document, of its text with the latter half taken from the next document, and their likeness.

    Documents follow each other by descending id (null last; equal ids by a hash of the
    text, then the text), the first after the last.  One shuffle deals the texts out by
    ranges of that order; within a range they stream, and only the first document of each
    range is sent to the range before as well.  What the driver sees is an id and a hash
    for each range.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    marked = source.withColumns({"__key": key, "__hash": F.shiftrightunsigned(F.xxhash64("text"), 1), "__order": F.bitwise_not(key)})  # not: rises as the key falls
    placed = in_ranges(marked, "__key", "__hash").drop("__key")
    heads = sorted(((r["__range"], *r["head"]) for r in placed.groupBy("__range").agg(F.min(F.struct("__order", "__hash")).alias("head")).collect()), reverse=True)
    spark = docs.sparkSession
    # the head of a range also goes to the range that comes before it
    to = spark.createDataFrame([(order, h, heads[i - 1][0]) for i, (_, order, h) in enumerate(heads)], "__order long, __hash long, __to long")
    guests = placed.join(F.broadcast(to), ["__order", "__hash"]).groupBy("__order", "__hash", F.col("__to").alias("__range")).agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"))
    columns = ["doc_id", "text", "__order", "__hash", "__range"]
    rows = (
        placed.select(*columns, F.lit(0).alias("__guest"))
        .unionByName(guests.select(*columns, F.lit(1).alias("__guest")))
        .repartition(partitions(spark), "__range")
        .sortWithinPartitions(F.desc("__range"), "__guest", "__order", "__hash", "text")
        .select("doc_id", "text", "__range", "__guest")
    )
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        """Results for all rows but the last, which only follows."""
        fingerprints = sketch([r[1] for r in rows])
        at = [i for i in range(len(rows) - 1) if not rows[i][3]]  # its next stands in the same range, the last one's is a guest
        edited = [rows[i][1][: len(rows[i][1]) - len(rows[i][1]) // 2] + rows[i + 1][1][: len(rows[i][1]) // 2] for i in at]
        after = sketch(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in at], pa.int64()),
                pa.array([len(rows[i][1]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                pa.array([encoded(fingerprints[i]) for i in at], pa.string()),
                pa.array([encoded(x) for x in after], pa.string()),
                pa.array([likeness(fingerprints[i], x) for i, x in zip(at, after, strict=True)], pa.float64()),
                pa.array([likeness(fingerprints[i], fingerprints[i + 1]) for i in at], pa.float64()),
            ],
            names=schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for a, b in slices(columns[1], 1_000_000):
                held += zip(*(c[a:b] for c in columns), strict=True)
                if len(held) > 1:
                    yield compare(held)
                    held = held[-1:]
        # the last row of a partition is a guest: it ends its range
        trim()

    return rows.mapInArrow(run, schema)


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Query: fingerprints of every document and of its edited text."""
    return edited_neighbours(table(spark, sf_dir, "documents"))
