"""Images larger than a row: tables of tiles, and regions that cross their edges.

A tiled image is a row for each tile: the image's keys, ``ty`` and ``tx`` (places of the
tile), ``height`` and ``width``, and arrays of its pixels.  Tiles of a row have one height
and tiles of a column one width; missing tiles are holes.

Regions are found within each tile (numpy); what touches across an edge is joined by the
edges' pixels, and only these links are searched for connected components.  No task holds
more than a batch of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..sources.staging import staged

_EDGE = "array<struct<segment:int,label:int>>"
_LABELLED = f"labels array<int>, parts array<struct<label:int,n:long,total:double>>, top {_EDGE}, bottom {_EDGE}, left {_EDGE}, right {_EDGE}"


def _labelled(tiles: DataFrame, keys: list[str], value: str, segment: str) -> DataFrame:
    """Every tile's labels (the smallest place of each region), regions and edges."""
    source = tiles.select(*keys, "ty", "tx", "height", "width", F.col(value).alias("__v"), F.col(segment).alias("__s"))
    schema = T.StructType([*source.schema.fields[: len(keys) + 4], *T.StructType.fromDDL(_LABELLED).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for h, w, v, s in zip(pdf["height"], pdf["width"], pdf["__v"], pdf["__s"], strict=True):
                s = np.asarray(s).reshape(h, w)
                labels = kernels.components(s)
                flat = labels.ravel()
                names = np.unique(flat)
                n, total = np.bincount(flat)[names], np.bincount(flat, np.asarray(v, np.float64))[names]
                edge = lambda at: [{"segment": int(a), "label": int(b)} for a, b in zip(s[at].tolist(), labels[at].tolist(), strict=True)]  # noqa: B023, E731
                parts = [{"label": a, "n": b, "total": c} for a, b, c in zip(names.tolist(), n.tolist(), total.tolist(), strict=True)]
                made.append((flat.tolist(), parts, edge(np.s_[0, :]), edge(np.s_[-1, :]), edge(np.s_[:, 0]), edge(np.s_[:, -1])))
            found = pd.DataFrame(made, columns=["labels", "parts", "top", "bottom", "left", "right"], index=pdf.index)
            yield pd.concat([pdf[[*keys, "ty", "tx", "height", "width"]], found], axis=1)

    return source.mapInPandas(run, schema)


def _touching(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Links (``a``, ``b``) between regions of neighbouring tiles that touch in pixels of one segment."""
    node = lambda label: F.struct("ty", "tx", label.alias("label"))

    def side(name: str, down: int, right: int, to: str) -> DataFrame:
        rows = labelled.select(*keys, "ty", "tx", F.posexplode(name).alias("at", "e"))
        return rows.select(*keys, node(F.col("e.label")).alias(to), (F.col("ty") + down).alias("__y"), (F.col("tx") + right).alias("__x"), "at", F.col("e.segment").alias("__s"))

    meet = [*keys, "__y", "__x", "at", "__s"]
    below = side("bottom", 1, 0, "a").join(side("top", 0, 0, "b"), meet)
    beside = side("right", 0, 1, "a").join(side("left", 0, 0, "b"), meet)
    return below.select(*keys, "a", "b").unionByName(beside.select(*keys, "a", "b")).distinct()


def connected(links: DataFrame, keys: list[str]) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of every node of the links (``a``, ``b``), within each of the keys.

    Rounds of large and small stars: every node's larger, then smaller neighbours are
    linked to its smallest one, until all hang on their root.  Aggregates and joins by
    node; a round is staged.
    """
    edges = staged(links.filter("a <> b").select(*keys, "a", "b"), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, [*keys, "a"]).filter("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct()
        down = down.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        joined = down.join(least, [*keys, "a"])
        small = joined.select(*keys, "a", F.col("m").alias("b")).unionByName(joined.filter("b <> m").select(*keys, F.col("b").alias("a"), F.col("m").alias("b")))
        edges = staged(small.filter("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(edges.select(*keys, F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def fill_regions(tiles: DataFrame, keys: list[str], value: str = "value", segment: str = "segment") -> DataFrame:
    """``filled``: each 4-connected region of equal ``segment``, across tiles, filled with its mean ``value`` as a byte (halves to even)."""
    labelled = staged(_labelled(tiles, keys, value, segment), "labelled")
    roots = connected(_touching(labelled, keys), keys)
    parts = labelled.select(*keys, "ty", "tx", F.explode("parts").alias("p"))
    nodes = parts.select(*keys, F.struct("ty", "tx", "p.label").alias("node"), "p.n", "p.total").join(roots, [*keys, "node"], "left").withColumn("root", F.coalesce("root", "node"))
    nodes = staged(nodes, "regions")
    means = nodes.groupBy(*keys, "root").agg((F.sum("total") / F.sum("n")).alias("mean"))
    bytes_ = F.least(F.lit(255), F.greatest(F.lit(0), F.rint("mean"))).cast("int")
    by_tile = nodes.join(means.withColumn("byte", bytes_), [*keys, "root"]).groupBy(*keys, "node.ty", "node.tx").agg(F.collect_list(F.struct("node.label", "byte")).alias("__bytes"))
    source = labelled.select(*keys, "ty", "tx", "labels").join(by_tile, [*keys, "ty", "tx"])
    schema = T.StructType([*source.schema.fields[: len(keys) + 2], T.StructField("filled", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            filled = []
            for labels, found in zip(pdf["labels"], pdf["__bytes"], strict=True):
                table = np.zeros(len(labels), np.int32)
                for r in found:
                    table[r["label"]] = r["byte"]
                filled.append(table[np.asarray(labels)])
            yield pdf[[*keys, "ty", "tx"]].assign(filled=filled)

    return source.mapInPandas(run, schema)
