"""Exact quantiles by selection: histograms of ranges that are refined until a rank is found.

Spark's exact percentile holds all distinct values of a group in one buffer.  Here a pass
counts each group's values in ``BINS`` ranges between its smallest and largest (partial
aggregates, so a task sends at most ``BINS`` rows a group and metric); the range that holds
a rank is the next pass's.  A range's own smallest and largest value bound it, so each pass
splits it as long as it holds two different values.  A range of at most ``FEW`` values is
gathered and sorted, the only list that is ever held.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..sources.staging import staged

BINS = 4096
FEW = 10_000
#: Rows of open ranges that may be broadcast (under 100 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 50_000


def _same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _long(rows: DataFrame, levels: list[list[str]], metrics: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """A row for each level, metric and finite value: keys that are not a level's are null."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    types = {f.name: f.dataType for f in rows.schema.fields}
    at = [F.struct(F.lit(i).alias("__level"), *[(F.col(k) if k in level else F.lit(None).cast(types[k])).alias(k) for k in keys]) for i, level in enumerate(levels)]
    values = [F.struct(F.lit(m).alias("__metric"), finite(F.col(c).cast("double")).alias("__v")) for m, c in metrics.items()]
    out = rows.select(F.explode(F.array(*at)).alias("l"), F.array(*values).alias("a")).select("l.*", F.explode("a").alias("m")).select("__level", *keys, "m.*")
    return out.filter("__v is not null"), ["__level", *keys, "__metric"]


def quantiles(rows: DataFrame, metrics: dict[str, str], *levels: list[str], q: float = 0.5) -> DataFrame:
    """Of every group of every level, the ``q``-quantile (between two ranks in proportion) of the finite values of ``metrics`` (name to column).

    Columns: the levels' keys (null where they are not a level's, as in grouping sets),
    ``__level`` (its number) and the metrics; null where a group has no finite value.
    ``rows`` are read once for each pass, so they should come from a table.
    """
    levels = [list(level) for level in levels] or [[]]
    long, keys = _long(rows, levels, metrics)
    sizes = long.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    place = (F.col("n") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.array(F.floor(place), F.ceil(place)))
    sizes = sizes.withColumn("part", place - F.floor(place)).withColumn("rank", F.explode(ranks)).withColumn("target", F.col("rank"))
    # rank: 0-based within the range [lo, hi], which holds n values; target: within the group
    open_ = staged(sizes, "ranges", 0)
    done = []
    while True:
        ready = (F.col("lo") == F.col("hi")) | (F.col("n") <= FEW)
        done.append(open_.filter(ready))
        open_ = open_.filter(~ready)
        n_open = open_.count()
        if not n_open:
            break
        bins = _within(long, open_, keys, n_open).withColumn("bin", F.least(F.lit(BINS - 1), F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).cast("int"))
        cells = bins.groupBy(*keys, "target", "rank", "part", "bin").agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "target").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = cells.withColumn("before", before).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        open_ = staged(found.withColumn("rank", F.col("rank") - F.col("before")).select(*open_.columns), "ranges", 0)
    small = reduce(DataFrame.unionByName, done)
    small = small if len(done) == 1 else staged(small, "ranges", 0)
    single = small.filter("lo = hi").select(*keys, "target", "part", F.col("lo").alias("value"))
    lists = small.filter("lo <> hi")
    values = _within(long, lists, keys, lists.count()).groupBy(*keys, "target", "rank", "part").agg(F.sort_array(F.collect_list("__v")).alias("all"))
    several = values.select(*keys, "target", "part", F.get("all", F.col("rank").cast("int")).alias("value"))
    both = single.unionByName(several).groupBy(*keys).agg(F.min_by("value", "target").alias("below"), F.max_by("value", "target").alias("above"), F.first("part").alias("part"))
    value = (1 - F.col("part")) * F.col("below") + F.col("part") * F.col("above")
    by = keys[:-1]
    return both.groupBy(*by).agg(*[F.max(F.when(F.col("__metric") == m, value)).alias(m) for m in metrics])


def _within(long: DataFrame, ranges: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Every value of every open range, with the range's columns."""
    ranges = ranges.drop("n")
    side = F.broadcast(ranges) if n <= BROADCAST_ROWS else ranges
    both = long.alias("v").join(side.alias("r"), _same("v", "r", keys) & F.col("v.__v").between(F.col("r.lo"), F.col("r.hi")))
    return both.select(*[F.col(f"v.{k}") for k in keys], "v.__v", *[f"r.{c}" for c in ranges.columns if c not in keys])


def summarised(rows: DataFrame, levels: list[list[str]], aggregates: list[Column], medians: list[str]) -> DataFrame:
    """``aggregates`` of the groups of every level (missing keys are null), and ``<metric>_median`` of ``medians``.

    ``rows``, one for each image, are staged, since the selection reads them again.
    """
    rows = staged(rows, "metrics")
    levels = [list(level) for level in levels]
    keys = list(dict.fromkeys(k for level in levels for k in level))
    if len(levels) == 1:
        out = rows.groupBy(*levels[0]).agg(*aggregates, F.lit(0).cast("long").alias("__set"))
    else:
        out = rows.groupingSets(levels, *keys).agg(*aggregates, F.grouping_id().alias("__set"))
    if not medians:
        return out.drop("__set")
    # a set's number has a bit for each key that it lacks, the first key's the highest
    number = [sum(1 << i for i, k in enumerate(reversed(keys)) if k not in level) if len(levels) > 1 else 0 for level in levels]
    found = quantiles(rows, {f"{m}_median": m for m in medians}, *levels)
    found = found.withColumn("__set", F.get(F.array(*[F.lit(n).cast("long") for n in number]), F.col("__level"))).drop("__level")
    joined = out.alias("s").join(found.alias("m"), _same("s", "m", [*keys, "__set"]), "left")
    return joined.select(*[f"s.{c}" for c in out.columns if c != "__set"], *[f"m.{m}_median" for m in medians])
