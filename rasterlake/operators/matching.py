"""Keyed matching of ground truth, predictions and masks.

Every choice among candidates states its order.  First, last and preferred rows are
chosen by aggregates (``min_by``-like structs), which combine map-side, so a key with
many rows never meets in one task's window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import mask_paths, match_key


def _chosen(rows: DataFrame, keys: list[str], order: list[Column], largest: bool = False) -> DataFrame:
    """One row of each key: the smallest (or largest) in ``order``, which must tell rows apart."""
    kept = [c for c in rows.columns if c not in keys]
    packed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*kept).alias("row"))
    best = rows.groupBy(*keys).agg((F.max if largest else F.min)(packed).alias("best"))
    return best.select(*keys, *[F.col(f"best.row.{c}").alias(c) for c in kept])


def keep_first(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return _chosen(rows, keys, [F.col(c) for c in order])


def keep_last(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return _chosen(rows, keys, [F.col(c) for c in order], largest=True)


def keep_preferred(rows: DataFrame, keys: list[str], kind: str, preference: list[str], *order: str) -> DataFrame:
    """The row whose ``kind`` comes first in ``preference`` (others last), then by ``order``."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preference)), F.col(kind)), F.lit(0)), F.lit(len(preference) + 1))
    return _chosen(rows, keys, [rank, *[F.col(c) for c in order]])


def match(gt: DataFrame, pred: DataFrame, keys: list[str], mask: DataFrame | None = None) -> DataFrame:
    """Ground truth with its prediction, and a mask where there is one."""
    out = gt.join(pred, keys)
    return out if mask is None else out.join(mask, keys, "left")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner: missing predictions, or extra ones with the sides swapped."""
    return left.join(right.select(*keys), keys, "left_anti")


def match_report(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Every key with its status: matched, missing (no prediction) or extra (no ground truth).  One join."""
    g = gt.select(*keys).distinct().withColumn("__g", F.lit(True))
    p = pred.select(*keys).distinct().withColumn("__p", F.lit(True))
    status = F.when(F.col("__p").isNull(), "missing").when(F.col("__g").isNull(), "extra").otherwise("matched")
    return g.join(p, keys, "full").select(*keys, status.alias("status"))


def _index(path: Column) -> Column:
    """A path without its extension: the key of files that differ in it alone."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def first_existing(rows: DataFrame, key: str, candidates: str, files: DataFrame, path: str = "path", order: tuple[str, ...] = (), never: str | None = None, otherwise: str | None = None) -> DataFrame:
    """For each row the earliest of its candidate paths that exists (and further columns of that file); rows without one are kept with nulls.

    Files are keyed by folder and stem, and so are candidates: a row is sent once for each
    stem that it tries, with the extensions to try there, not once for each path.  What a
    stem has is ranked by the candidates' order after the join.  Of files of one path only
    the first by ``order`` can be chosen, so no more than one of them is joined.

    ``order`` may name columns of ``files`` that come before the candidates' own order;
    ``never`` a column of ``rows`` whose path is not to be chosen; ``otherwise`` one whose
    path is taken where no candidate exists.
    """
    tries = F.array_compact(F.col(candidates))
    placed = F.transform(tries, lambda c, i: F.struct(_index(c).alias("stem"), c.alias("path"), i.alias("place")))
    if never:
        placed = F.filter(placed, lambda c: ~c["path"].eqNullSafe(F.col(never)))
    stems = F.array_distinct(F.transform(placed, lambda c: c["stem"]))
    of_stem = F.transform(
        stems,
        lambda s: F.struct(
            s.alias("stem"),
            F.transform(
                F.filter(placed, lambda c: c["stem"] == s),
                lambda c: F.struct(F.substring(c["path"], F.length(s) + 1, F.length(c["path"])).alias("ext"), c["place"].alias("place"))
            ).alias("tries")
        )
    )
    sent = rows.select(key, F.explode(of_stem).alias("t")).select(key, F.col("t.stem").alias("__stem"), F.col("t.tries").alias("__tries"))
    more = [c for c in files.columns if c != path]
    ranked = [*order, *[c for c in more if c not in order]]
    firsts = files.select(path, F.struct(F.lit(0).alias("__one"), *ranked).alias("__file")).groupBy(path).agg(F.min("__file").alias("__file")).select(path, *[F.col(f"__file.{c}").alias(c) for c in more])
    met = sent.join(firsts.withColumn("__stem", _index(F.col(path))), "__stem")
    ext = F.substring(F.col(path), F.length("__stem") + 1, F.length(path))
    place = F.array_min(F.transform(F.filter("__tries", lambda t: t["ext"] == ext), lambda t: t["place"]))
    met = met.withColumn("place", place).filter("place is not null")
    best = met.groupBy(key).agg(F.min(F.struct(*order, "place", path, *[c for c in more if c not in order])).alias("best"))
    chosen = F.coalesce(F.col(f"best.{path}"), F.col(otherwise)) if otherwise else F.col(f"best.{path}")
    return rows.join(best, key, "left").select(*rows.columns, chosen.alias(path), *[F.col(f"best.{c}").alias(c) for c in more], F.col("best.place").alias("place"))


def resolved_masks(rows: DataFrame, key: str, rel: str, pair_key: str, files: DataFrame, by_name: bool = False, own: str | None = None, suffix: str = "") -> DataFrame:
    """``rows`` with ``mask`` and ``tier``: 0 a mask at the image's own path ``rel``, 1 one of its stem with any known extension, 2 one by the keyed map; null without.

    Never the file ``own`` in the first two tiers.  The map keys masks by their stem without
    ``suffix`` (of equal keys the last path counts), or with ``by_name`` also by their own
    path, which then comes first.  One join by stem; the map is joined only to rows that it
    left without a mask.
    """
    paths = files.select(F.col(files.columns[0]).alias("mask"))
    found = first_existing(rows.withColumn("__tries", mask_paths(F.col(rel))), key, "__tries", paths, path="mask", never=own).drop("__tries")
    tier = F.when(F.col("place") == 0, 0).when(F.col("place") > 0, 1)
    found = found.withColumn("tier", tier).drop("place")
    left = found.filter("mask is null").drop("mask", "tier")
    keyed = paths.groupBy(match_key(F.col("mask"), suffix).alias("__map")).agg(F.max("mask").alias("__mask"))
    out = left.join(keyed, left[pair_key] == keyed["__map"], "left")
    mapped = F.col("__mask")
    if by_name:
        named = paths.select(F.col("mask").alias("__named")).distinct()
        out = out.join(named, out[rel] == named["__named"], "left")
        mapped = F.coalesce("__named", "__mask")
    out = out.select(*left.columns, mapped.alias("mask"), F.when(mapped.isNotNull(), 2).alias("tier"))
    return found.filter("mask is not null").unionByName(out)


def two_lookups(preds: DataFrame, gts: DataFrame, masks: DataFrame, gt_key: str, mask_key: str) -> DataFrame:
    """Predictions with ``status``: ok, missing_gt or missing_mask, by derived keys that must both exist."""
    g = gts.select(F.col(gts.columns[0]).alias(gt_key)).distinct().withColumn("__g", F.lit(True))
    m = masks.select(F.col(masks.columns[0]).alias(mask_key)).distinct().withColumn("__m", F.lit(True))
    out = preds.join(g, gt_key, "left").join(m, mask_key, "left")
    status = F.when(F.col("__g").isNull(), "missing_gt").when(F.col("__m").isNull(), "missing_mask").otherwise("ok")
    return out.withColumn("status", status).drop("__g", "__m")


def preferred_class(files: DataFrame, folder: str, rank: Column) -> DataFrame:
    """Only the files of the best class that their folder has (smaller rank first; null never)."""
    ranked = files.withColumn("__rank", rank).filter("__rank is not null")
    best = ranked.groupBy(folder).agg(F.min("__rank").alias("__rank"))
    return ranked.join(best, [folder, "__rank"]).drop("__rank")


def contains_any(column: str, wanted: str) -> Column:
    """A comma list of pieces, trimmed, of which the column holds one; an empty list lets all pass."""
    pieces = [p.strip() for p in wanted.split(",") if p.strip()]
    out = F.lit(not pieces)
    for p in pieces:
        out = out | F.contains(F.col(column), F.lit(p))
    return out


def include_list(rows: DataFrame, column: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows by name with ``place`` in the list, and the names that no row has."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(names))], f"{column} string, place int")
    return rows.join(F.broadcast(wanted), column), wanted.join(rows.select(column).distinct(), column, "left_anti")


def limit_sorted(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in order (a top-n, without a full sort)."""
    return rows.orderBy(*order).limit(n)


def top_per_group(rows: DataFrame, keys: list[str], k: int, *order: str) -> DataFrame:
    """The first ``k`` rows of each key; Spark cuts each task's groups to ``k`` before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def sampled(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows without replacement in the order of a seeded hash."""
    return rows.orderBy(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))), *keys).limit(n)


def with_variants(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """Every row with every row of a small variant table (a configuration of checked size)."""
    n = variants.count()
    if n > 10_000:
        raise ValueError(f"{n} variants: a variant table is a configuration of at most 10000 rows")
    listed = variants.agg(F.collect_list(F.struct(*variants.columns)).alias("__all"))
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(listed.withColumn("__one", F.lit(1))), "__one").withColumn("__v", F.explode("__all")).select(*rows.columns, *[F.col(f"__v.{c}").alias(c) for c in variants.columns])


def variant_of(rows: DataFrame, variants: DataFrame, key: str) -> DataFrame:
    """Each row's variant by id; an unknown id raises."""
    marked = variants.withColumn("__known", F.lit(True))
    out = rows.join(marked, key, "left")
    return out.filter(F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("unknown variant: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("__known")
