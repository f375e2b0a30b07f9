"""Line dedup within an edit bound, by a deletion-neighbourhood join.

Lines follow each other by document, then by place; documents follow by id, nulls last,
and rows of one id by the MD5 of their texts.  A line that is not empty is dropped when
an earlier one, dropped or not, is equal to it; one of at least ``MIN_CHARS`` code points
also when an earlier one of that length differs by one insertion, deletion or
substitution of a code point (below it, any two short words would be near).

Two lines one edit apart share a variant: the shorter one itself, or both with the code
point at one place deleted.  Variants of all lines would be as many as the corpus has
characters, so a line first emits coarser ones, with a whole half deleted (the edit
lies in one half, the other is the same).  Only lines that share such a key with
another line emit single deletions, and only within that half.  Lines that share a
deletion at the same place are all one substitution apart, so each needs to meet the
earliest alone; a line that equals others' variant meets each of those.  No list of
pairs within a group is made.  Every candidate is verified on its text.

Keys are 64-bit hashes; equal lines are grouped by 128 bits, documents of one id told
apart by 60.

Defined cases: null and empty texts have no lines; rows that repeat an id and a text are
one document, so that lines at the same place of theirs stay or go together; a document
all of whose lines go keeps the empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import dealt_anew, small_batches, staged, table, text_of, trim

MIN_CHARS = 16
#: Lines (of some 100 bytes) that a broadcast may have; beyond it the join is shuffled.
BROADCAST_LINES = 250_000

_R = 0xA24BAED4963EE407
_RINV = np.uint64(pow(_R, -1, 1 << 64))
_MIX = np.uint64(0x9FB21C651E98DF25)
_PLACE = T.DecimalType(38, 0)


def place_of(doc_id: Column, text: Column) -> Column:
    """A document's place among all: id (null last), then 60 bits of its text's MD5, as one number below 2^125."""
    wide = lambda c: c.cast("decimal(20,0)")
    number = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    rank = F.coalesce(wide(doc_id.cast("long")) + number(1 << 63), number(1 << 64))
    digest = F.conv(F.substring(F.md5(text), 1, 15), 16, 10)
    return (rank.cast(_PLACE) * number(1 << 60) + wide(digest)).cast(_PLACE)


def lines_of(text: str) -> list[str]:
    return text.split("\n") if text else []


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts[:-1]).encode() + parts[-1].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def half_keys(line: str) -> list[int]:
    """Keys of the line with one half deleted: for the length of the shorter line of a pair (own, or one less), second half kept, then first half kept."""
    out = []
    for shorter in (len(line), len(line) - 1):
        cut = shorter // 2
        out += [_hash(shorter, 0, line[len(line) - (shorter - cut) :]), _hash(shorter, 1, line[:cut])]
    return out


def deletions(line: str, first: int, last: int) -> tuple[int, np.ndarray]:
    """Hash of the line, and of the line without the code point at each place from ``first`` to before ``last``."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(0x1F123BB5)
    codes = (codes * _MIX) ^ (codes >> np.uint64(7))
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, len(codes) - 1), _R, np.uint64)]), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers, dtype=np.uint64)])
    gone = sums[first:last] + (sums[-1] - sums[first + 1 : last + 1]) * _RINV
    mixed = lambda v: ((v ^ (v >> np.uint64(31))) * _MIX).astype(np.int64)
    return int(mixed(sums[-1:])[0]), mixed(gone)


def one_edit_apart(x: str, y: str) -> bool:
    """Whether the edit distance is at most 1."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i:] == y[i + 1 :] or (len(x) == len(y) and x[i + 1 :] == y[i + 1 :])


def _rows(keyed: DataFrame) -> DataFrame:
    """One row for each document and distinct line that is not empty: first place, other places, 128-bit hash, half keys (none under ``MIN_CHARS``)."""
    schema = T.StructType(
        [T.StructField("doc", _PLACE), T.StructField("line_no", T.IntegerType()), T.StructField("again", T.ArrayType(T.IntegerType())), *(T.StructField(c, T.LongType()) for c in ("h1", "h2")), T.StructField("keys", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                cols: list[list] = [[] for _ in schema]
                for i in range(a, b):
                    places: dict[str, list[int]] = {}
                    for n, line in enumerate(lines_of(texts[i])):
                        if line:
                            places.setdefault(line, []).append(n)
                    for line, at in places.items():
                        h = hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                        for col, v in zip(cols, (i, at[0], at[1:], int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), half_keys(line) if len(line) >= MIN_CHARS else []), strict=True):
                            col.append(v)
                types = [pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], names=schema.names)
        trim()

    return keyed.select("doc", "text").mapInArrow(run, schema)


def _candidates(keyed: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Lines that share a half key with another line: ``order`` (their earliest place), hash, text, and the variants within that half."""
    key = F.posexplode("keys").alias("half", "key")
    shared = rows.select(key, "h1").groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi").select("key")
    wanted = rows.select("h1", "h2", key).join(dealt_anew(shared, "key"), "key", "left_semi").select("h1", "h2", "half").distinct()
    wanted = wanted.join(groups.select("h1", "h2", F.col("first").alias("doc")), ["h1", "h2"]).groupBy("doc", "h1", "h2").agg(F.collect_set("half").alias("halves"))
    wanted = staged(wanted.groupBy("doc").agg(F.collect_list(F.struct("h1", "h2", "halves")).alias("wanted")), "wanted", groups.count())
    small = (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= BROADCAST_LINES
    found = keyed.join(F.broadcast(wanted) if small else wanted, "doc").select("doc", "text", "wanted")
    schema = T.StructType(
        [T.StructField("doc", _PLACE), T.StructField("line_no", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("h1", "h2")), T.StructField("line", T.StringType()), T.StructField("own", T.LongType()), T.StructField("gone", T.ArrayType(T.LongType())), T.StructField("place", T.ArrayType(T.IntegerType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, (text, wants) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                halves = {(w["h1"], w["h2"]): w["halves"] for w in wants}
                cols: list[list] = [[] for _ in schema]
                for n, line in enumerate(lines_of(text)):
                    if len(line) < MIN_CHARS:
                        continue
                    h = hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    key = (int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True))
                    if key not in halves:
                        continue
                    kinds = halves.pop(key)  # the first place only
                    middle = len(line) // 2 + 1  # one more on either side: the halves of two lengths differ by that
                    first = 0 if any(k % 2 == 0 for k in kinds) else max(0, middle - 3)
                    last = len(line) if any(k % 2 for k in kinds) else min(len(line), middle + 2)
                    own, gone = deletions(line, first, last)
                    for col, v in zip(cols, (place, n, *key, line, own, gone, np.arange(first, last, dtype=np.int32)), strict=True):
                        col.append(v)
                if cols[0]:
                    types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], names=schema.names)
        trim()

    out = found.mapInArrow(run, schema).withColumn("order", F.struct("doc", "line_no")).drop("doc", "line_no")
    return staged(out, "candidates")


def _near(lines: DataFrame) -> DataFrame:
    """Hashes (h1, h2) of the candidate lines that have an earlier one within an edit."""
    gone = lines.select("order", F.explode(F.arrays_zip("gone", "place")).alias("v")).select("order", F.col("v.gone").alias("variant"), F.col("v.place").alias("place"))
    # one substitution: the same variant with the same place deleted; all of a class are an edit apart
    classes = gone.groupBy("variant", "place").agg(F.min("order").alias("earlier"), F.max("order").alias("top")).filter("earlier < top").select("variant", "place", "earlier")
    swapped = gone.join(dealt_anew(classes, "variant"), ["variant", "place"]).filter("order > earlier").select("order", "earlier")
    # one insertion: a line that is another's variant
    own = lines.select(F.col("own").alias("variant"), F.col("order").alias("whole"))
    grown = gone.join(own, "variant").filter("order <> whole").select(F.greatest("order", "whole").alias("order"), F.least("order", "whole").alias("earlier"))
    pairs = swapped.unionByName(grown).distinct()
    texts = lines.select("order", "line")
    both = pairs.join(texts, "order").join(texts.select(F.col("order").alias("earlier"), F.col("line").alias("before")), "earlier").select("order", "line", "before")
    schema = T.StructType([T.StructField("order", lines.schema["order"].dataType)])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [one_edit_apart(x, y) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], names=["order"])
        trim()

    late = both.mapInArrow(verify, schema).distinct()
    return lines.select("order", "h1", "h2").join(late, "order", "left_semi").select("h1", "h2", F.lit(True).alias("near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text that is left, and ``n_lines`` and ``n_dropped`` (input columns of these names are replaced)."""
    small_batches(docs.sparkSession)
    base = docs.select(*[F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")])
    whole = text_of(text_col)
    place = place_of(F.col(id_col), whole)
    keyed = docs.select(place.alias("doc"), whole.alias("text"))
    rows = staged(_rows(keyed), "lines")
    groups = staged(rows.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("n")), "groups", rows.count())
    near = _near(_candidates(keyed, rows, groups))
    # only lines that occur again or have an earlier near one can go
    verdict = groups.join(near, ["h1", "h2"], "left").filter("n > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    verdict = staged(verdict, "verdict", groups.count())  # both sides of the next join are plain exchanges: Spark splits a very common line
    gone = rows.select("doc", "line_no", "h1", "h2").join(verdict, ["h1", "h2"]).filter("near or doc > first").select("doc", F.array("line_no").alias("at"))
    again = rows.filter(F.size("again") > 0).select("doc", F.col("again").alias("at"))
    drops = gone.unionByName(again).groupBy("doc").agg(F.flatten(F.collect_list("at")).alias("__drops")).withColumnRenamed("doc", "__doc")
    joined = base.select("*", place.alias("__doc")).join(drops, "__doc", "left").select(*[F.col(c) for c in base.columns if c != text_col], "__drops", whole.alias("__text"))
    schema = T.StructType([*joined.schema.fields[:-2], T.StructField(text_col, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            counts: list[int] = []
            dropped: list[int] = []
            for text, drops in zip(batch.column(batch.num_columns - 1).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), strict=True):
                lines, out = lines_of(text), set(drops or ())
                texts.append("\n".join([x for i, x in enumerate(lines) if i not in out]) if out else text)
                counts.append(len(lines))
                dropped.append(len(out))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=schema.names)
        trim()

    return joined.mapInArrow(rebuild, schema).select(*base.columns, "n_lines", "n_dropped")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: lines, dropped lines and the digest of the text that is left, of every document."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP7_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY doc_id NULLS LAST, substr(md5(coalesce(text, '')), 1, 15)) AS place, doc_id,
    CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS ls FROM documents
), l AS (SELECT r, place, unnest(range(0, len(ls))) AS n, unnest(ls) AS x FROM d
), e AS (SELECT r, n, x, place * 10000000 + n AS pos FROM l WHERE x <> ''
), f AS (SELECT x, min(pos) AS pos FROM e GROUP BY x
), h AS (SELECT x, pos, length(x) - z AS k FROM f, range(2) t(z) WHERE length(x) >= 16
), k AS (SELECT x, pos, k, 0 AS side, right(x, k - k // 2) AS half FROM h UNION ALL SELECT x, pos, k, 1, left(x, k // 2) FROM h
), near AS (
  SELECT DISTINCT b.x FROM k a JOIN k b ON a.k = b.k AND a.side = b.side AND a.half = b.half AND a.pos < b.pos AND abs(length(a.x) - length(b.x)) <= 1
  WHERE len(list_filter(range(0, least(length(a.x), length(b.x)) + 1), lambda i: left(a.x, i) = left(b.x, i)
    AND (substr(a.x, i + 2) = substr(b.x, i + 2) OR substr(a.x, i + 1) = substr(b.x, i + 2) OR substr(a.x, i + 2) = substr(b.x, i + 1)))) > 0
), gone AS (SELECT e.r, e.n FROM e JOIN f ON e.x = f.x LEFT JOIN near ON near.x = e.x WHERE e.pos > f.pos OR near.x IS NOT NULL
), kept AS (SELECT l.r, string_agg(l.x, chr(10) ORDER BY l.n) AS text FROM l ANTI JOIN gone g ON g.r = l.r AND g.n = l.n GROUP BY l.r
), c AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_dropped, sha256(coalesce(kept.text, '')) AS text_sha256
FROM d LEFT JOIN kept ON kept.r = d.r LEFT JOIN c ON c.r = d.r
"""
