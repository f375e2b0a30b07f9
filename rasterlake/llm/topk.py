"""Exact top-k by inner product, as a three-phase uniform threshold.

A vector's components are split into ``LISTS`` groups; a row's score is the sum of its
partial scores, one for each group.  Rows and queries are packed into tiles of alike
vectors, whose summaries (mean, radius and greatest norm by group) bound the partial
scores within.

1. Gather.  Every tile of queries meets the one tile of rows that its mean is most alike
   to.  Each query takes the heads of that tile's local lists, ``GATHER`` times k rows of
   highest partial score in each group, and their whole scores; the k-th best of those
   is a safe cutoff t, since k rows reach it.
2. Collect.  The cutoffs go out with the queries, to the tiles whose bounds allow t.  A
   row that reaches t has a partial score of at least t / LISTS in some group (else the
   sum stays below t), so only rows that pass this uniform threshold are collected.
3. Resolve.  Whole scores are made for collected rows alone; at most k of a tile that
   reach t go on, and the best k of those are the result.

Tiles grow with the input up to a bound, so that a query is sent out once for every
``ROWS`` rows at most, and what a task holds is one tile of each side.  How many queries
a tile can skip depends on the data: none where all vectors are strangers, most where
they fall into groups.  Integers stay exact: products go through singles or doubles
while all sums fit their mantissas, and through Python integers beyond; a score beyond
64 bits fails.

Defined cases: vectors that are null, or hold a null or non-finite component, and rows
of a null id take no part; shorter vectors count as filled up with zeros, so an empty
one scores 0 with all; ties go to the smaller id; a query meets every row but those of
its own id; rows that repeat an id count each; equal queries (id and vector) are
answered once, queries of one id with different vectors each; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, staged, table

LISTS = 2
#: Heads that a query takes from each local list, in multiples of k.
GATHER = 8
#: Most rows of a tile, and the least that a small table is cut to.
ROWS, QUERIES, LEAST = 1 << 16, 1 << 12, 1 << 10
#: Partial scores that a task holds at a time for each group.
CELLS = 2_000_000

_VECTORS = T.StructType([T.StructField("id", T.LongType()), T.StructField("code", T.LongType()), T.StructField("v", T.BinaryType())])
_TILES = T.StructType(
    [T.StructField("tile", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("x", T.BinaryType()), T.StructField("kind", T.StringType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("mean", "radius", "norm"))]
)
_SUMMARY = ["tile", "mean", "radius", "norm"]


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """``id`` and ``v`` (floor(scale * x) of each component, little-endian int64) of the vectors that take part, and ``code``, which alike vectors share."""
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, offsets = lists.values, lists.offsets.to_numpy()
            x = np.array(flat.to_numpy(zero_copy_only=False), np.float64) if len(flat) else np.zeros(0)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])  # null became NaN
            whole = bad[offsets[1:]] == bad[offsets[:-1]]
            q = np.floor(np.where(np.isfinite(x), x, 0) * scale)
            if len(q) and np.abs(q).max() >= 2.0**63:
                raise OverflowError("a quantised component does not fit 64 bits")
            planes = np.random.default_rng(3).choice([-1.0, 1.0], (int(np.diff(offsets).max(initial=0)), 16))
            v, codes = [], []
            for a, b in zip(offsets[:-1][whole].tolist(), offsets[1:][whole].tolist(), strict=True):
                v.append(q[a:b].astype("<i8").tobytes())
                codes.append(int(np.packbits(q[a:b] @ planes[: b - a] > 0).view(">u2")[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(whole)), pa.array(codes, pa.int64()), pa.array(v, pa.binary())], names=_VECTORS.names)

    return source.mapInArrow(run, _VECTORS)


def groups(width: int) -> list[slice]:
    cuts = [width * i // LISTS for i in range(LISTS + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def summary(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean of a tile, and by group the greatest distance from it and the greatest norm."""
    x = x.astype(np.float64)
    mean = x.mean(0)
    length = lambda d: [float(np.sqrt((d[:, g] ** 2).sum(1)).max()) for g in groups(x.shape[1])]
    return mean, np.array(length(x - mean)), np.array(length(x))


def _tiles(vectors: DataFrame, width: int, size: int, tasks: int) -> DataFrame:
    """Tiles of at most ``size`` rows, numbered from 0.  Ranges of (code, id) deal the rows, so that equal vectors can fill many tiles."""

    def pack(ids: list[int], parts: list[bytes], number: int) -> pa.RecordBatch:
        x = np.zeros((len(ids), width), np.int64)
        full = [len(p) == 8 * width for p in parts]
        if all(full):
            x[:] = np.frombuffer(b"".join(parts), "<i8").reshape(len(ids), width)
        else:
            for i, p in enumerate(parts):
                x[i, : len(p) // 8] = np.frombuffer(p, "<i8")
        top = int(max(x.max(initial=0), -int(x.min(initial=0))))
        kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
        values = [[number], [np.array(ids, "<i8").tobytes()], [x.astype(kind).tobytes()], [kind], *([s.tolist()] for s in summary(x))]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.binary(), pa.binary(), pa.string(), *[pa.list_(pa.float64())] * 3), strict=True)], names=_TILES.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        parts: list[bytes] = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            parts += batch.column(1).to_pylist()
            while len(ids) >= size:
                yield pack(ids[:size], parts[:size], number)
                ids, parts, number = ids[size:], parts[size:], number + 1
        if ids:
            yield pack(ids, parts, number)

    packed = staged(vectors.repartitionByRange(tasks, "code", "id").sortWithinPartitions("code", "id").select("id", "v").mapInArrow(run, _TILES), "tiles")
    numbers = packed.select("tile").withColumn("place", F.row_number().over(Window.orderBy("tile")).cast("long") - 1)  # one row for each tile
    return staged(packed.join(F.broadcast(numbers), "tile").drop("tile").withColumnRenamed("place", "tile").select(*_TILES.names), "tiles")


def _exact(norms: float) -> type:
    """A type in which all sums of products are exact, by the product of the greatest norms."""
    return np.float32 if norms < 2.0**24 else np.float64 if norms < 2.0**53 else object


def partials(q: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Partial scores by group, exact."""
    longest = lambda v: float(np.sqrt((v.astype(np.float64) ** 2).sum(1).max(initial=0))) * (1 + 1e-9)
    kind = _exact(longest(q) * longest(x))
    q, x = q.astype(kind), x.astype(kind)
    return [q[:, g] @ x[:, g].T for g in groups(q.shape[1])]


def _heads(p: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest of each row."""
    if p.dtype == object:
        return np.argsort(-p, 1, kind="stable")[:, :n]
    return np.argpartition(p, p.shape[1] - n, 1)[:, p.shape[1] - n :] if n < p.shape[1] else np.broadcast_to(np.arange(p.shape[1]), p.shape)


def gather(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Phase 1: a cutoff for each query from the heads of this tile's lists; minus infinity where fewer than k rows were found."""
    out = np.full(len(q), -math.inf)
    step = max(1, CELLS // max(1, len(x)))
    for a in range(0, len(q), step):
        parts = partials(q[a : a + step], x)
        heads = np.concatenate([_heads(p, min(GATHER * k, len(x))) for p in parts], 1)
        for i, at in enumerate(heads):
            at = np.unique(at)
            at = at[ids[at] != q_ids[a + i]]
            if len(at) >= k:
                whole = sorted(sum(p[i, at] for p in parts).tolist())[-k]
                out[a + i] = whole if abs(whole) < 1 << 53 else np.nextafter(float(whole), -math.inf)
    return out


def bounds(q: np.ndarray, mean: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each query and group no less than the partial score of any row of the tile."""
    q = q.astype(np.float64)
    out = [q[:, g] @ mean[g] + np.sqrt((q[:, g] ** 2).sum(1)) * r for g, r in zip(groups(q.shape[1]), radius, strict=True)]
    return np.stack(out, 1) + 1 + 1e-9 * np.abs(np.stack(out, 1))


def collect(q_ids: np.ndarray, q: np.ndarray, cutoffs: np.ndarray, ids: np.ndarray, x: np.ndarray, mean: np.ndarray, radius: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """Phases 2 and 3: (place of the query, id, score) of at most ``k`` rows of the tile for each query, and how many whole scores were made."""
    ub = bounds(q, mean, radius)
    need = cutoffs / LISTS
    open_ = np.flatnonzero((ub.sum(1) >= cutoffs) & (ub >= need[:, None]).any(1))
    out: list[tuple[int, int, int]] = []
    made = 0
    step = max(1, CELLS // max(1, len(x)))
    for a in range(0, len(open_), step):
        at = open_[a : a + step]
        parts = partials(q[at], x)
        if parts[0].dtype == object:
            least = np.nextafter(need[at], -math.inf).astype(object)
        else:
            least = np.ceil(need[at]).astype(parts[0].dtype)
        passed = np.zeros(parts[0].shape, bool)
        for p in parts:
            passed |= p >= least[:, None]
        r, c = np.nonzero(passed)
        other = ids[c] != q_ids[at][r]
        r, c = r[other], c[other]
        made += len(r)
        whole = sum(p[r, c] for p in parts)
        high = whole >= cutoffs[at][r]
        r, c, whole = r[high], c[high], whole[high]
        order = np.lexsort((ids[c], -whole, r)) if whole.dtype != object else np.array(sorted(range(len(r)), key=lambda i: (r[i], -whole[i], ids[c[i]])), int)
        r, c, whole = r[order], c[order], whole[order]
        first = np.searchsorted(r, r)
        best = np.arange(len(r)) - first < k
        out += [(int(at[i]), int(ids[j]), int(s)) for i, j, s in zip(r[best], c[best], whole[best].tolist(), strict=True)]
    return out, made


def _unpacked(row: dict, width: int, side: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{side}ids"], "<i8")
    return ids, np.frombuffer(row[f"{side}x"], row[f"{side}kind"]).astype(np.int64).reshape(len(ids), width)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` best rows of each query."""
    spark = rows.sparkSession
    small_batches(spark)
    vectors = staged(quantised(rows, id_col, vector_col), "vectors")
    asked = staged(quantised(queries, id_col, vector_col).distinct(), "queries")
    measure = lambda df: df.agg(F.count("*"), F.coalesce(F.max(F.length("v")), F.lit(0))).first()
    (n, w1), (n_queries, w2) = measure(vectors), measure(asked)
    width = max(w1, w2) // 8
    cores = spark.sparkContext.defaultParallelism
    size = lambda number, most: max(LEAST, min(most, -(-number // (2 * cores))))
    packed = lambda df, number, most: _tiles(df, width, size(number, most), max(1, -(-number // size(number, most))))
    x_tiles, q_tiles = packed(vectors, n, ROWS), packed(asked, n_queries, QUERIES)
    n_tiles = x_tiles.count()
    result = T.StructType([*(T.StructField(c, T.LongType()) for c in ("query_id", "query")), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    q_side = lambda df, columns: df.select(*[F.col(c).alias(f"q_{c}") for c in columns])

    def met(q: DataFrame) -> DataFrame:
        """Summaries of query tiles with those of all tiles of rows."""
        every = q.withColumn("tile", F.explode(F.expr(f"sequence(0L, {n_tiles - 1}L)"))) if n_tiles else q.withColumn("tile", F.lit(0).cast("long")).limit(0)
        return every.join(x_tiles.select(*_SUMMARY), "tile")

    # gather
    alike = F.aggregate(F.zip_with("q_mean", "mean", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    nearest = met(q_side(q_tiles, _SUMMARY)).groupBy("q_tile").agg(F.max_by("tile", F.struct(alike, -F.col("tile"))).alias("tile"))
    payload = ["tile", "ids", "x", "kind"]
    first = nearest.join(q_side(q_tiles, payload), "q_tile").join(x_tiles.select(*payload), "tile")
    cut_schema = T.StructType([T.StructField("q_tile", T.LongType()), T.StructField("cutoffs", T.BinaryType())])

    def run_gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (q_ids, q), (ids, x) = _unpacked(row, width, "q_"), _unpacked(row, width)
                yield pa.RecordBatch.from_arrays([pa.array([row["q_tile"]], pa.int64()), pa.array([gather(q_ids, q, ids, x, k).astype("<f8").tobytes()], pa.binary())], names=cut_schema.names)

    cutoffs = staged(first.select("q_tile", "q_ids", "q_x", "q_kind", "ids", "x", "kind").mapInArrow(run_gather, cut_schema), "cutoffs")

    # collect and resolve
    pair_schema = T.StructType([T.StructField("q_tile", T.LongType()), T.StructField("tile", T.LongType())])
    summaries = q_side(q_tiles, _SUMMARY).join(cutoffs, "q_tile")

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in batch.to_pylist():
                mean, q_mean = np.array(row["mean"]), np.array(row["q_mean"])
                top = sum(q_mean[g] @ mean[g] + float(np.linalg.norm(mean[g])) * qr + qn * r for g, qr, qn, r in zip(groups(width), row["q_radius"], row["q_norm"], row["radius"], strict=True))
                keep.append(bool(top * (1 + 1e-9) + 1 >= np.frombuffer(row["cutoffs"], "<f8").min()))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(chosen), batch.column(1).filter(chosen)], names=pair_schema.names)

    pairs = met(summaries).select("q_tile", "tile", "q_mean", "q_radius", "q_norm", "mean", "radius", "cutoffs").mapInArrow(allowed, pair_schema)
    sent = pairs.join(q_side(q_tiles, payload).join(cutoffs, "q_tile"), "q_tile").join(x_tiles, "tile").select("q_tile", "q_ids", "q_x", "q_kind", "cutoffs", "ids", "x", "kind", "mean", "radius")

    def run_collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (q_ids, q), (ids, x) = _unpacked(row, width, "q_"), _unpacked(row, width)
                found, _ = collect(q_ids, q, np.frombuffer(row["cutoffs"], "<f8"), ids, x, np.array(row["mean"]), np.array(row["radius"]), k)
                place = row["q_tile"] << 32
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in ([int(q_ids[f[0]]) for f in found], [place + f[0] for f in found], [f[1] for f in found], [f[2] for f in found])], names=result.names)

    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return sent.mapInArrow(run_collect, result).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    """Query: the 5 best rows of every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
