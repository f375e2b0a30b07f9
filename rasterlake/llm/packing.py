"""Best-fit packing of documents into training sequences by minimum bin slack.

A document is its ids and one end id.  Documents that are longer than a sequence, and only
these, are cut into pieces of a whole sequence; the last piece may be shorter.

Pieces of equal length can stand for each other, so a packing is decided on the number of
pieces of each length: at most one count a token of the sequence, whatever the input.
For each bin the longest piece left is taken, and a subset sum over the lengths left (bits
of one integer, counts in powers of two) finds the fullest combination that fits with it;
that is removed.  While its pieces last, the same combination is again the fullest, so it
is repeated at once: a length ends a repetition at most 1 + capacity / length times, which
bounds the combinations (some 20 000 for 2048 tokens).

Then every piece takes its place.  A piece's rank among those of its length is the number
of them in earlier tasks (a window over counts of tasks) plus its place within its own
task, so no task ranks a length; combinations are ranges of ranks, looked up in numpy.

Defined cases: null and empty texts are the end id alone; rows that repeat an id are
documents each; an empty table gives no rows; other columns are not read.  Of documents
alike in length it is not defined which goes where; the number of sequences is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_tokenizer_path, encoder, slices
from .common import small_batches, staged, table, text_of, trim

CAPACITY = 2048
END_ID = 0
#: Words of a worker's table (a generation of two): about 60 MB each.
MAX_WORDS = 300_000

#: A combination: how many pieces of each length, and how many sequences are filled so.
Combination = tuple[dict[int, int], int]


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination of the pieces left that holds the longest of them."""
    longest = max(counts)
    room = capacity - longest
    reach, steps = 1, []
    within = (1 << room + 1) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, unit = min(counts[length] - (length == longest), room // length), 1
        while left > 0 and not reach >> room & 1:
            k = min(unit, left)
            steps.append((length, k, reach))
            reach |= (reach << length * k) & within
            left -= k
            unit *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used = {longest: 1}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[Combination]:
    """Combinations that use up all pieces: ``counts`` maps lengths (1 to ``capacity``) to numbers of pieces."""
    left = {length: n for length, n in counts.items() if n > 0}
    out = []
    while left:
        used = fullest(left, capacity)
        times = min(left[length] // n for length, n in used.items())
        out.append((used, times))
        for length, n in used.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return out


def placements(found: list[Combination]) -> np.ndarray:
    """Rows (length, first rank, sequences, first sequence, offset), sorted: which places ranks of a length have.

    Ranks ``first + j * sequences + i`` stand in sequence ``first sequence + i`` at
    ``offset + j * length``.
    """
    rows, taken, sequence = [], {}, 0
    for used, times in found:
        offset = 0
        for length in sorted(used, reverse=True):
            rows.append((length, taken.get(length, 0), times, sequence, offset))
            taken[length] = taken.get(length, 0) + used[length] * times
            offset += used[length] * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _cut(flat: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Of every piece: its document's place, number, start and length, and the CRC of its ids (``flat`` without the end ids)."""
    whole = sizes + 1
    pieces = -(-whole // capacity)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = number * capacity
    length = np.minimum(whole[doc] - start, capacity)
    begin = (np.cumsum(sizes) - sizes)[doc] + start
    last = number == pieces[doc] - 1
    raw, end = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B"), END_ID.to_bytes(4, "little")
    crc = [zlib.crc32(end, zlib.crc32(raw[4 * a : 4 * (a + n - 1)])) if z else zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n, z in zip(begin.tolist(), length.tolist(), last.tolist(), strict=True)]
    return doc, number, start, length, np.array(crc, np.int64)


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """Every document's pieces: id, ``piece``, ``start``, ``length``, ``ids_crc32``, and their task and place among its pieces of that length."""
    small_batches(docs.sparkSession)
    path = tokenizer_path or default_tokenizer_path()
    source = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    names = [id_col, "piece", "start", "length", "ids_crc32", "__task", "__place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 4_000_000):
                doc, number, start, length, crc = _cut(*enc.encode_flat(texts[a:b], MAX_WORDS), capacity)
                order = np.argsort(length, kind="stable")
                many = np.bincount(length, minlength=capacity + 1)
                place = np.empty(len(doc), np.int64)
                place[order] = np.arange(len(doc)) - (np.cumsum(many) - many)[length[order]] + seen[length[order]]
                seen += many
                columns = [batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(number.astype(np.int32)), *(pa.array(x) for x in (start, length, crc)), pa.array(np.full(len(doc), task, np.int32)), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        trim()

    id_type = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, __task int, __place long")


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """Every document's pieces with ``sequence_id`` and ``offset`` in it."""
    rows = staged(pieces(docs, capacity, id_col, text_col, tokenizer_path), "pieces")
    cells = staged(rows.groupBy("length", "__task").agg(F.count("*").alias("n")), "cells", 0)
    counts = {length: n for length, n in cells.groupBy("length").agg(F.sum("n")).collect()}  # one row for each possible length at most
    table_ = placements(combinations(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("length", "__task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    ranked = rows.join(before, ["length", "__task"]).withColumn("__rank", F.col("__before") + F.col("__place"))
    kept = [id_col, "piece", "start", "length", "ids_crc32"]
    source = ranked.select(*kept, "__rank")
    keys = (table_[:, 0] << 48) + table_[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            found = table_[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            since = rank - found[:, 1]
            sequence = found[:, 3] + since % found[:, 2]
            offset = found[:, 4] + since // found[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    id_type = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op12_packing(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Query: where every piece of every document stands in sequences of 2048 tokens."""
    return pack(docs if docs is not None else table(spark, sf_dir, "documents"))
