"""The trie of conversation prefixes by preorder intervals.

Conversations are rebuilt first: those of one block of ids begin with up to three turns of
the block's first one.  A node is a distinct sequence of first turns; its members are the
conversations that start so.

A turn is 128 bits of the digest of its role and text, a conversation the digests joined,
so that of two sequences a prefix stands directly before its extensions.  Copies fall
together first (partial aggregates); distinct sequences are ranked over ranges.  A node is
identified by a chain of digests, and made by the first sequence that has it: its place in
preorder is the order by (first sequence, depth), and its subtree ends with the last node
that the last sequence of its members made.  Leaves and saved tokens of a subtree are then
the difference of two prefix sums over preorder, which are sums over blocks of places plus
sums within a block.

What a task holds at once is one conversation's digests (17 bytes of memory a turn and
more, not its texts); rows of a conversation meet in one task.  Parents with very many
children are joined through plain exchanges on both sides, which Spark splits.  The ids of
members that end in a node are joined to texts in ranges, and a digest is fed with these
texts in order, so a group of copies of any size is never held.

Defined cases: null role or text is empty; null turns come first, equal turns in the order
of their digests; rows that repeat a turn are turns each; rows without a conversation id
belong to none and are left out; an empty table has no nodes, not even a root; a
conversation whose turns are all gone is a member of the root, and ends there; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.manifest import ranks
from .common import WORD_PATTERN, partitions, small_batches, staged, table, text_of

BLOCK = 20
HEADS = 4
#: Hexadecimal digits of a turn's digest.
DIGITS = 32
#: Places of a block of the prefix sums.
SPAN = 1 << 16
#: Bytes of ids that are joined to one text.
JOINED = 1 << 20


def turn_digest(role: str = "role", text: str = "text") -> Column:
    """Of a turn: the length of the role keeps the two apart."""
    return F.substring(F.sha2(F.concat(F.length(text_of(role)).cast("string"), F.lit(":"), text_of(role), text_of(text)).cast("binary"), 256), 1, DIGITS)


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns`` (digest, words) of every conversation, its first turns taken from its block's first conversation."""
    words = F.regexp_count(text_of(), F.lit(WORD_PATTERN)).cast("long")
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest().alias("digest"), words.alias("words"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("own"))
    own = staged(own.withColumn("own", F.transform("own", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))), "turns")
    block = (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("block")
    heads = own.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("block"), F.slice("own", 1, HEADS - 1).alias("head"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    joined = own.select("*", block, n.alias("n")).join(heads, "block", "left")
    head = F.when(F.col("head").isNotNull() & (F.col("n") > 0), F.slice("head", F.lit(1), F.greatest("n", F.lit(1)))).otherwise(F.slice("own", 1, 0))
    rest = F.slice("own", F.col("n") + 1, F.size("own"))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


def _nodes(sequences: DataFrame) -> DataFrame:
    """A row for every prefix of every sequence: ``node`` and ``parent`` (chains of digests), ``depth``, the last turn's ``words``; ``ends`` where it is the whole."""
    schema = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("position", pa.int64()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])

    def chains(batch: pa.RecordBatch) -> Iterator[tuple]:
        for seq, key, words, position, n, conv in zip(*(batch.column(c).to_pylist() for c in ("seq", "key", "words", "position", "n", "conv_id")), strict=True):
            node, parent = b"", None
            for depth in range(len(words) + 1):
                if depth:
                    parent = node
                    node = hashlib.blake2b(node + key[DIGITS * (depth - 1) : DIGITS * depth].encode(), digest_size=16).digest()
                yield node, parent, depth, words[depth - 1] if depth else 0, position, n, conv, seq if depth == len(words) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in chains(batch):
                out.append(row)
                if len(out) == 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return sequences.select("seq", "key", "words", "position", "n", "conv_id").mapInArrow(run, "node binary, parent binary, depth long, words long, position long, n long, conv_id long, ends string")


def prefix_sums(rows: DataFrame, *cols: str) -> DataFrame:
    """``position`` and, for each of ``cols``, its sum over the places up to that one.

    Totals of blocks of ``SPAN`` places are summed in one window of a row a block; within a
    block its places are.
    """
    blocks = rows.select("position", *cols).withColumn("block", F.expr(f"position div {SPAN}"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("block").agg(*[F.sum(c).alias(c) for c in cols])
    totals = totals.select("block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in cols])
    within = Window.partitionBy("block").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = blocks.select("position", "block", *[F.sum(c).over(within).alias(c) for c in cols]).join(totals, "block")
    return sums.select("position", *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in cols])


def _digests_of_ends(members: DataFrame) -> DataFrame:
    """``ends`` and the digest of its ids in decimal, ascending, joined by commas, from rows (``ends``, ``conv_id``)."""
    n = partitions(members.sparkSession)
    dealt = members.repartitionByRange(n, "ends", "conv_id").sortWithinPartitions("ends", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = pc.run_end_encode(batch.column(0))
            at = 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                ids = batch.column(1).slice(at, end - at)
                step = JOINED // 20
                for k in range(0, len(ids), step):
                    part = ids.slice(k, step)
                    yield pa.RecordBatch.from_pylist([{"ends": name, "since": part[0].as_py(), "ids": ",".join(map(str, part.to_pylist()))}], pa.schema([("ends", pa.string()), ("since", pa.int64()), ("ids", pa.string())]))
                at = end

    texts = staged(dealt.mapInArrow(join, "ends string, since long, ids string"), "ends")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sha = None, hashlib.sha256()
        done: list[dict] = []
        for batch in batches:
            for ends, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if ends != name:
                    if name is not None:
                        done.append({"ends": name, "ends_sha256": sha.hexdigest()})
                    name, sha = ends, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist(done, pa.schema([("ends", pa.string()), ("ends_sha256", pa.string())]))
            done = []
        if name is not None:
            yield pa.RecordBatch.from_pylist([{"ends": name, "ends_sha256": sha.hexdigest()}])

    return texts.repartition(n, "ends").sortWithinPartitions("ends", "since").mapInArrow(digest, "ends string, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """Every node: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    small_batches(turns.sparkSession)
    key = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    convs = rebuilt(turns).select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    convs = staged(convs.withColumn("seq", F.sha2("key", 256)), "conversations")
    distinct = convs.groupBy("seq").agg(F.first("key").alias("key"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    found = _nodes(ranks(distinct, "key")).groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("parent", "depth", "words")],
        F.min("position").alias("first"), F.max("position").alias("last"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"),
    )
    pre = ranks(found, "first", "depth")
    ends = pre.groupBy("first").agg(F.max("position").alias("end")).withColumnRenamed("first", "last")
    spans = staged(pre.join(ends, "last").withColumn("own", (F.col("n_convs") - 1) * F.col("words")), "spans")
    sums = staged(prefix_sums(spans.select("position", (F.col("end") == F.col("position")).cast("long").alias("leaf"), "own"), "leaf", "own"), "sums")
    at_end = sums.select(F.col("position").alias("end"), F.col("leaf").alias("end_leaf"), F.col("own").alias("end_own"))
    before = sums.select("position", F.col("leaf").alias("to_leaf"), F.col("own").alias("to_own"))
    children = spans.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    parents = spans.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = spans.join(before, "position").join(at_end, "end").join(children, "node", "left").join(parents, "parent", "left")
    out = out.join(_digests_of_ends(convs.select(F.col("seq").alias("ends"), "conv_id")), "ends", "left")
    # up to and with the subtree's end, less what is before its top
    leaves = F.col("end_leaf") - F.col("to_leaf") + (F.col("end") == F.col("position")).cast("long")
    saved = F.col("end_own") - F.col("to_own") + F.col("own")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), leaves.alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark, sf_dir: str, turns: DataFrame | None = None) -> DataFrame:
    """Query: every node of the trie of rebuilt conversations."""
    return trie(turns if turns is not None else table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b)
), turns AS (
  SELECT conv_id, turn, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS d, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT conv_id AS c, list({'d': d, 'w': w} ORDER BY turn NULLS FIRST, d) AS t FROM turns GROUP BY conv_id
), numbered AS (
  SELECT c, own.t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
    lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1])), 4294967295) % 4 AS h FROM own, crc
), convs AS (SELECT a.c, list_concat(coalesce(b.t[1:a.h], []), a.t[a.h + 1:]) AS t FROM numbered a LEFT JOIN own b ON b.c = a.c - a.c % 20
), prefixes AS (SELECT c, len(t) AS n, unnest(range(0, len(t) + 1)) AS depth, t FROM convs
), nodes AS (
  SELECT t[1:depth] AS p, depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '') AS ids FROM prefixes GROUP BY ALL
), linked AS (SELECT a.*, b.conv_id AS parent_conv_id, b.p AS parent FROM nodes a LEFT JOIN nodes b ON b.depth = a.depth - 1 AND b.p = a.p[1:a.depth - 1] AND a.depth > 0
), children AS (SELECT parent AS p, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY parent
), full_nodes AS (SELECT l.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * p[depth].w END AS own FROM linked l LEFT JOIN children USING (p)
), above AS (SELECT p[1:k] AS p, n_children, own FROM (SELECT p, n_children, own, unnest(range(0, depth + 1)) AS k FROM full_nodes)
), under AS (SELECT p, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM above GROUP BY p)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ids) AS ends_sha256 FROM full_nodes JOIN under USING (p)
"""
