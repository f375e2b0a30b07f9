"""Near-duplicate documents by an LSH forest over MinHash, confirmed on full sets.

1. One pass over the texts gives each document its number of distinct word shingles, a
   digest of the set, and ``TREES`` labels: sequences of MinHash values.  Documents of
   equal sets fall together by the digest; the smallest id stands for them from here on.
2. Each tree sorts all labels.  Neighbours whose longest common prefix reaches the
   tree's depth are candidates; where a region is sparse (few labels share one value
   less) a shorter prefix will do, so the depth adapts to each region and never falls
   below what the recall is set for.  The sort is dealt by ranges of (label, id), so one
   label can fill many tasks; the runs that tasks share are joined by their ends.
3. Candidates join up to regions (connected components).  Sets can only be linked if
   their sizes are alike, so a region is dealt into size classes, of which a set meets its
   own and the two beside it, and a class into blocks of bounded size.
4. Blocks are compared by exact intersection counts, in two rounds.  First each with
   itself and with its class's first block: what is linked there is one component, and a
   group of near copies, however large, mostly ends as one.  Then only sets of different
   components are compared: those outside of their class's largest component with all of
   their class, and classes beside each other unless both are wholly one component.  No
   pair that could join two components is left out, and no list of pairs is made: a
   comparison gives back a spanning forest of its links.
5. The links' components are the result.

A pair at the threshold t shares a tree's prefix with probability t^depth, about 0.32; 48
trees miss it with a probability of some 1e-6, and a region is joined by many pairs.

Defined cases: null and empty texts, and texts without words, have no shingles and are
linked with nothing; a null id is joined only to equal sets and counts after all ids;
rows that repeat an id are compared each, under that id; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import partitions, staged, table, text_of, trim
from .components import connected_components

TREES = 48
BASE = 256
#: Labels that share a prefix one short of the tree's depth and still count as a sparse region.
SPARSE = 8
#: Shingles of a block: 1 MB.
BLOCK = 125_000
#: Bytes of labels that a task sorts, about.
TASK_BYTES = 128 << 20
#: Bits of the filter that keeps most documents without a candidate out of the shuffle of sets: 16 for each candidate, from 128 KB to 8 MB.
FILTER_BITS = (1 << 20, 1 << 26)

_rng = np.random.default_rng(52)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RADIX = 0xA0761D6478BD642F
_INVERSE = pow(_RADIX, -1, 1 << 64)
_FACTORS = _rng.integers(0, 1 << 32, BASE, dtype=np.uint32) | np.uint32(1)
_MASKS = _rng.integers(0, 1 << 32, BASE, dtype=np.uint32)
_MULTIPLIER = np.uint64(0x9FB21C651E98DF25)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(32))) * _MULTIPLIER
    return v ^ (v >> np.uint64(28))


def _radix_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, r, np.uint64)]), dtype=np.uint64) for r in (_RADIX, _INVERSE))
    up, down = _powers[size]
    return up[:n], down[:n]


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """Each text's set of distinct shingles as rising 64-bit hashes; with fewer words the whole sequence is one."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    space = _SPACE[raw]
    edge = np.diff(space.astype(np.int8), prepend=1)
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(end) > len(begin):
        end = end[-len(begin) :] if len(begin) else end[:0]
    up, down = _radix_powers(len(raw) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[raw] * up[:-1], dtype=np.uint64)])
    hashes = _mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    cuts = np.searchsorted(begin, np.concatenate([[0], ends]))
    out = []
    for i in range(len(texts)):
        w = hashes[cuts[i] : cuts[i + 1]]
        n = len(w)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        size = min(n, words)
        h = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            h = h * _MULTIPLIER + w[k : n - size + 1 + k]
        out.append(np.unique(_mixed(h)))
    return out


def tree_plan(depth: int) -> np.ndarray:
    """Which MinHash values make up each tree's label."""
    rng = np.random.default_rng(1009)
    return np.stack([rng.permutation(BASE)[:depth] for _ in range(TREES)])


def minhash(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BASE, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        h = x[k : k + 1024, None] * _FACTORS
        h ^= _MASKS
        np.minimum(least, h.min(0), out=least)
    return least


def labels_of(shingles: np.ndarray, plan: np.ndarray) -> bytes:
    """The labels of all trees on end: the tree's number and 16 bits for each MinHash value."""
    short = (minhash(shingles) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(">u2")
    rows = short[plan].view(np.uint8).reshape(TREES, -1)
    return np.concatenate([np.arange(TREES, dtype=np.uint8)[:, None], rows], 1).tobytes()


def _signatures(docs: DataFrame, words: int, depth: int) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("labels", T.BinaryType())])
    plan = tree_plan(depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 1_000_000):
                sets = shingle_sets(texts[a:b], words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([labels_of(s, plan) if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=schema.names,
                )
        trim()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


def _prefix(rows: np.ndarray, before: np.ndarray) -> np.ndarray:
    """MinHash values that each label shares with the one before it (0 if the tree differs)."""
    same = rows == before
    same = np.concatenate([same, np.zeros((len(rows), 1), bool)], 1)
    return np.maximum(same.argmin(1) - 1, 0) // 2


def _neighbours(sorted_labels: DataFrame, depth: int) -> DataFrame:
    """Candidate links (a, b) of neighbours in sorted labels, and each task's first and last label (``label``, ``place``)."""
    width = 1 + 2 * depth
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("label", T.BinaryType()), T.StructField("place", T.IntegerType())])

    def rows(a, b, label, place):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(label, pa.binary()), pa.array(place, pa.int32())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = None  # the last label that was dealt with, and its run's smallest id
        dense = 0  # how many labels before it are alike but for one value, where they are too many to be sparse
        held = np.zeros((0, width), np.uint8), np.zeros(0, np.int64)  # an open run that may still be sparse

        def joined_rows(lab, ids, ends: bool):
            """Links of all labels but those of a last run that is still open; what is left over."""
            nonlocal last, dense
            lcp = _prefix(lab, np.concatenate([(~lab[:1] if last is None else last[0][None]), lab[:-1]]))
            loose = np.concatenate([np.flatnonzero(np.concatenate([[True], lcp[1:] < depth - 1])), [len(lab)]])
            sizes = np.diff(loose)
            if lcp[0] >= depth - 1:
                sizes[0] += dense
            stop = len(lab)
            if not ends and sizes[-1] <= SPARSE:
                stop = int(loose[-2])
            sparse = np.repeat(sizes <= SPARSE, np.diff(loose))
            rest = lab[stop:], ids[stop:]
            dense = 0 if stop < len(lab) else int(sizes[-1])
            lab, ids, lcp, sparse = lab[:stop], ids[:stop], lcp[:stop], sparse[:stop]
            out = []
            if stop:
                joined = (lcp >= depth) | ((lcp >= depth - 1) & sparse)
                starts = np.flatnonzero(np.concatenate([[True], ~joined[1:]]))
                least = np.minimum.reduceat(ids, starts)
                if last is not None and joined[0]:
                    least[0] = min(least[0], last[1])
                    out.append(rows([least[0]], [last[1]], [None], [None]))
                root = np.repeat(least, np.diff(np.concatenate([starts, [len(lab)]])))
                keep = root != ids
                if keep.any():
                    n = int(keep.sum())
                    out.append(rows(root[keep], ids[keep], [None] * n, [None] * n))
                last = (lab[-1], int(root[-1]))
            return out, rest

        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            lab = np.concatenate([held[0], np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)])
            ids = np.concatenate([held[1], batch.column(1).to_numpy()])
            if first:
                yield rows([ids[0]], [ids[0]], [lab[0].tobytes()], [2 * part])
                first = False
            out, held = joined_rows(lab, ids, False)
            yield from out
        if len(held[1]):
            out, held = joined_rows(*held, True)
            yield from out
        if last is not None:
            yield rows([last[1]], [last[1]], [last[0].tobytes()], [2 * part + 1])
        trim()

    return sorted_labels.mapInArrow(run, schema)


def _regions(reps: DataFrame, number: int, depth: int) -> DataFrame:
    """``node`` and ``root`` (region) of every representative that has a candidate."""
    spark, width = reps.sparkSession, 1 + 2 * depth
    labels = reps.filter(F.col("rep").isNotNull()).select(F.explode(F.expr(f"transform(sequence(0, {TREES - 1}), i -> substring(labels, i * {width} + 1, {width}))")).alias("label"), "rep")
    tasks = max(partitions(spark), -(-number * TREES * (width + 24) // TASK_BYTES))
    found = staged(_neighbours(labels.repartitionByRange(tasks, "label", "rep").sortWithinPartitions("label", "rep"), depth), "neighbours")
    ends = sorted((r["place"], r["label"], r["a"]) for r in found.filter("place is not null").collect())  # two for each task
    bridges = []
    for (p, x, a), (q, y, b) in zip(ends, ends[1:], strict=False):
        if p // 2 != q // 2 and _prefix(*(np.frombuffer(bytes(v), np.uint8)[None] for v in (y, x)))[0] >= depth - 1:
            bridges.append((min(a, b), max(a, b)))
    edges = found.filter("place is null").select("a", "b").unionByName(spark.createDataFrame(bridges, "a long, b long"))
    return connected_components(edges.filter("a < b"), found.count())


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``x`` with each of ``y``."""
    flat_x, flat_y = np.concatenate(x), np.concatenate(y)
    if x is y:
        values, counts = np.unique(flat_x, return_counts=True)
        shared = values[counts > 1]
    else:
        shared = np.intersect1d(flat_x, flat_y)
    out = np.zeros((len(x), len(y)), np.float32)
    if not len(shared):
        return out

    def places(sets, flat):
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        hit = shared[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit][order]

    (cx, rx), (cy, ry) = places(x, flat_x), places(y, flat_y)
    step = max(256, 2_000_000 // (len(x) + len(y)))
    for k in range(0, len(shared), step):
        dense = []
        for c, r, n in ((cx, rx, len(x)), (cy, ry, len(y))):
            lo, hi = np.searchsorted(c, [k, k + step])
            m = np.zeros((n, min(step, len(shared) - k)), np.float32)
            m[r[lo:hi], c[lo:hi] - k] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T  # counts stay below 2^24: exact
    return out


def forest(links: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """For a symmetric matrix of links: (smallest id of the component, id) of each linked row but the smallest."""
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(ids)).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return [(int(r), int(i)) for r, i in zip(least[label], ids, strict=True) if r != i]


def linked(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    common = common_counts(x, y).astype(np.int64)
    union = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None] - common
    return (common > 0) & (100 * common >= percent * union)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``blocks``, how many blocks of bounded size their key has, and their ``block``."""
    totals = rows.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.sum("n_shingles") / BLOCK)).cast("int").alias("blocks"))
    return rows.join(totals, list(keys)).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(len(keys))), F.col("blocks")).cast("int"))


def _compared(pairs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) from pairs of blocks ``sets`` and ``others`` (null: the block with itself), a spanning forest of each."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpacked(scalar):
            values = scalar.values
            return np.array(values.field("rep").to_pylist(), np.int64), [np.frombuffer(s, np.uint64) for s in values.field("shingles").to_pylist()]

        for batch in batches:
            edges: list[tuple[int, int]] = []
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                ids, x = unpacked(left)
                if right.is_valid:
                    more, y = unpacked(right)
                    links = np.zeros((len(x) + len(y),) * 2, bool)
                    links[: len(x), len(x) :] = linked(x, y, percent)
                    links |= links.T
                    edges += forest(links, np.concatenate([ids, more]))
                else:
                    edges += forest(linked(x, x, percent), ids)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=schema.names)
        trim()

    return pairs.select("sets", "others").mapInArrow(compare, schema)


def size_class(n: Column, percent: int) -> Column:
    """Classes of set sizes: sets that may be linked are at most one class apart."""
    return F.floor(F.log(n) / (math.log(100 / percent) * (1 + 1e-9))).cast("long") if percent < 100 else n.cast("long")


def open_pairs(blocks: DataFrame) -> DataFrame:
    """Which blocks (region, size, rest, block; ``lo`` and ``hi`` of their components) can still hold links between components: keys of both sides, b's prefixed."""
    key = ["region", "size", "rest", "block"]
    other = blocks.select("region", *[F.col(c).alias(f"b_{c}") for c in ("size", "rest", "block", "lo", "hi")])
    same = F.col("lo").eqNullSafe(F.col("hi")) & F.col("b_lo").eqNullSafe(F.col("b_hi")) & F.col("lo").eqNullSafe(F.col("b_lo"))
    # a class that was one block has met itself
    own = blocks.filter("rest = 1 and several").join(other.withColumn("size", F.col("b_size")), ["region", "size"]).filter("b_rest = 0 or b_block >= block")
    beside = blocks.join(other.withColumn("size", F.col("b_size") - 1), ["region", "size"])
    names = [*key, "b_size", "b_rest", "b_block"]
    return own.select(*names, same.alias("same")).unionByName(beside.select(*names, same.alias("same"))).filter("not same").drop("same")


def _links(docs: DataFrame, members: DataFrame, number: int, words: int, percent: int) -> DataFrame:
    """Links (a, b) between representatives of one region that join up all its components."""
    spark = docs.sparkSession
    placed = staged(_dealt(members.withColumn("size", size_class(F.col("n_shingles"), percent)), "region", "size"), "placed", number)
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * number).bit_length()))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)).cast("int")
    words_set = placed.select(bit("rep").alias("bit")).groupBy(F.expr("bit div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit % 32)")).alias("bits")).toArrow()  # bits / 32 rows at most
    bitmap = np.zeros(bits // 32, np.uint32)
    bitmap[words_set["word"].to_numpy()] = words_set["bits"].to_numpy().astype(np.uint32)
    set_schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bitmap[at // 32] >> (at % 32).astype(np.uint32) & np.uint32(1)).astype(bool)))
            found = batch.column(1).to_pylist()
            for a, b in slices(found, 1_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in shingle_sets(found[a:b], words)], pa.binary())], names=set_schema.names)
        trim()

    shingled = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", bit("doc_id").alias("bit")).mapInArrow(sets, set_schema)
    member = F.collect_list(F.struct("rep", "shingles")).alias("sets")
    packed = staged(shingled.join(placed, shingled["doc_id"] == placed["rep"]).groupBy("region", "size", "blocks", "block").agg(member), "blocks", 10 * number)  # a block holds many rows

    # first round
    nothing = F.lit(None).cast(packed.schema["sets"].dataType)
    first = packed.filter("blocks > 1 and block = 0").withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1))).select("region", "size", "block", F.col("sets").alias("others"))
    n_blocks = packed.count()
    tasks = max(partitions(spark), n_blocks // 32)
    with_first = packed.filter("block > 0").join(first, ["region", "size", "block"]).select("sets", "others").repartition(tasks)
    links = staged(_compared(packed.select("sets", nothing.alias("others")).unionByName(with_first), percent), "links")
    if placed.groupBy("region").agg((F.min(F.struct("size", "block")) != F.max(F.struct("size", "block"))).alias("several")).filter("several").isEmpty():
        return links
    roots = staged(connected_components(links, number), "roots", number)

    # second round: regions of several blocks and several components
    joined = placed.join(roots, placed["rep"] == roots["node"], "left").select("region", "size", "blocks", "block", "rep", "n_shingles", F.coalesce("root", "rep").alias("root"))
    place = F.struct("size", "block")
    left_open = joined.groupBy("region").agg(F.min("root").alias("__lo"), F.max("root").alias("__hi"), (F.min(place) != F.max(place)).alias("__several")).filter("__lo <> __hi and __several").select("region")
    joined = staged(joined.join(left_open, "region"), "open", number)
    n_open = joined.count()
    if not n_open:
        return links
    main = joined.groupBy("region", "size", "root").agg(F.count("*").alias("n")).groupBy("region", "size").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("main"))
    again = joined.join(main, ["region", "size"]).withColumns({"rest": (F.col("root") != F.col("main")).cast("int"), "several": F.col("blocks") > 1}).drop("blocks", "block", "main")
    again = staged(_dealt(again, "region", "size", "rest"), "dealt", n_open)
    taken = packed.join(again.select("region", "size").distinct(), ["region", "size"], "left_semi").select(F.explode("sets").alias("s")).select(F.col("s.rep").alias("__rep"), "s.shingles")
    again = again.dropDuplicates(["rep"])  # rows that share an id have one root
    key = ["region", "size", "rest", "block"]
    packed = staged(taken.join(again, F.col("__rep") == F.col("rep")).groupBy(*key).agg(member, F.first("several").alias("several"), F.min("root").alias("lo"), F.max("root").alias("hi")), "blocks", 10 * n_open)
    pairs = staged(open_pairs(packed.drop("sets")), "pairs", 10 * n_open)
    n_pairs = pairs.count()
    right = packed.select("region", *[F.col(c).alias(f"b_{c}") for c in key[1:]], F.col("sets").alias("others"))
    itself = (F.col("b_size") == F.col("size")) & (F.col("b_rest") == F.col("rest")) & (F.col("b_block") == F.col("block"))
    met = pairs.join(packed.select(*key, "sets"), key).join(right, ["region", "b_size", "b_rest", "b_block"]).select("sets", F.when(~itself, F.col("others")).alias("others"))
    return links.unionByName(_compared(met.repartition(max(partitions(spark), n_pairs // 16)), percent))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document, with its ``text_hash`` and its set's ``digest``; links have a Jaccard similarity of at least ``percent`` / 100."""
    depth = max(3, math.floor(math.log(0.3) / math.log(percent / 100))) if percent < 100 else 12
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    signed = staged(_signatures(source, words, depth), "signatures")
    reps = staged(signed.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels")), "representatives", signed.count())
    number = reps.count()
    regions = _regions(reps, number, depth)
    members = staged(reps.select("rep", "n_shingles").join(regions, reps["rep"] == regions["node"]).select("rep", "n_shingles", F.col("root").alias("region")), "members", number)
    number = members.count()
    roots = connected_components(_links(source, members, number, words, percent), number)
    classes = reps.join(roots, reps["rep"] == roots["node"], "left").select("digest", F.coalesce("root", "rep").alias("root"))
    out = signed.join(classes, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash", "digest")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_neardup(spark, sf_dir: str) -> DataFrame:
    """Query: components of documents that share 85 % of their word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), u AS (SELECT doc_id, unnest(s) AS g FROM s
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * c >= 85 * (len(a.s) + len(b.s) - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(node, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node AND e.y > r.root
), c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON node = doc_id
"""
