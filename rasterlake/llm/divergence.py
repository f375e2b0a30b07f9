"""Which sources differ from their language, and by which terms: an audit by upper-bound search.

A term is a run of ASCII letters and of characters beyond ASCII; only A to Z are lowered.
Of every language the terms in at least ``least_docs`` of its documents are kept.  A term
that occurs ``count`` times in a group of N kept occurrences has there the smoothed share
``p = 1 + floor(10^9 * (count + 1) / (N + V))``, V being the language's kept terms; the
divergence of p from q is ``floor((p - q)^2 / q)``.  All of it is whole numbers.

**Terms** of a source, compared with its language, are found best first.  A source's terms
fall into buckets by their count in it (exact up to 64, then 16 buckets for each doubling).
The bucket's highest count and its lowest count in the language bound the divergence of
each of its terms, since it rises with p and falls with q while p > q.  Buckets are
evaluated by falling bound, in waves that double; a source is done when it has k terms
and every bucket not yet seen is bound strictly below the k-th.  Only a wave's buckets are
evaluated, and buckets in which no term can be above its language's share are never.

**Pairs** of sources come from postings.  Over all kept terms the sum is that for counts
of 0 in both, plus what the terms of one source alone change (by its histogram of counts),
plus what terms of both change further (from the postings of each term, in numpy).

No task sees a language: counts are partial sums by language, source and term, then by
language and term.  A term's postings have an entry a source, and the result has a row for
each pair of sources, so neither grows with the documents.  Sums of a language's postings
are kept in a task until its end: at most one for each pair of sources.

Defined cases: null texts, languages and sources are empty texts; a document without terms
still makes its group; a language without kept terms gives pairs of value 0 and no terms;
rows that repeat an id are documents each; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import small_batches, staged, table, text_of, trim

#: Bytes of a term as they are, lower-cased, and a space for all others.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Counts up to it have a bucket each.
EXACT_COUNTS = 64
#: Buckets of each doubling beyond.
FINE = 16
#: Rows of a wave's plan that may be broadcast (about 100 bytes each); larger plans are joined by shuffle.
BROADCAST_ROWS = 50_000
#: Pairs of postings that a task expands at a time; at most 2^21, so that split sums stay exact in float64.
PAIRS = 1 << 20

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _batch_counts(texts: list[str], langs: list[str], sources: list[str]) -> pa.RecordBatch:
    """Occurrences and documents of every term by language and source; a null term for each group."""
    groups: dict[tuple[str, str], int] = {}
    group = np.array([groups.setdefault(k, len(groups)) for k in zip(langs, sources, strict=True)], np.int64)
    words = [t.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() for t in texts]
    terms = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    size = max(1, len(terms.dictionary))
    codes = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cells, times = np.unique(np.repeat(np.arange(len(texts)), [len(w) for w in words]) * size + codes, return_counts=True)
    keys, place = np.unique(group[cells // size] * size + cells % size, return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, place, times)
    docs = np.bincount(place, minlength=len(keys)) if len(keys) else np.zeros(0, np.int64)
    owner = np.concatenate([keys // size, np.arange(len(groups))])
    none = np.zeros(len(groups), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in groups], pa.string()).take(pa.array(owner)),
            pa.array([k[1] for k in groups], pa.string()).take(pa.array(owner)),
            pa.concat_arrays([terms.dictionary.take(pa.array(keys % size)).cast(pa.string()), pa.nulls(len(groups), pa.string())]),
            pa.array(np.concatenate([n, none])),
            pa.array(np.concatenate([docs.astype(np.int64), none])),
        ],
        schema=_COUNTS,
    )


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``docs``; a row of a null term for every group."""
    small_batches(docs.sparkSession)
    source = docs.select(text_of(text_col).alias("text"), text_of(lang_col).alias("lang"), text_of(source_col).alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for a, b in slices(columns[0], 4_000_000):
                yield _batch_counts(*(c[a:b] for c in columns))
        trim()

    parts = source.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def postings(counts: DataFrame, least_docs: int = 3) -> DataFrame:
    """``lang``, ``term``, ``total`` and ``posts`` (source, n) of the kept terms; the null term lists the language's sources."""
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("posts"))
    return by_term.filter((F.col("docs") >= least_docs) | F.col("term").isNull()).drop("docs")


def groups_of(posts: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``size`` (N of the group), ``kept`` (V) and ``lang_size`` (N of the language)."""
    own = posts.select("lang", F.explode("posts").alias("p")).groupBy("lang", "p.source").agg(F.sum("p.n").alias("size"))
    whole = posts.groupBy("lang").agg(F.count("term").alias("kept"), F.sum("total").alias("lang_size"))
    return own.join(whole, "lang")


def share(n: Column | str, size: Column | str, kept: Column | str = "kept") -> Column:
    """``1 + floor(10^9 (n + 1) / (size + kept))``, exact at any size; null where both are 0."""
    c = lambda x: (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")
    whole = F.call_function("div", (c(n) + 1).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), F.nullif(c(size) + c(kept), F.lit(0)))
    return whole + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def bucket(n: Column) -> Column:
    fine = EXACT_COUNTS + F.floor(F.log2(n / EXACT_COUNTS) * FINE)
    return F.when(n < EXACT_COUNTS, n).otherwise(fine).cast("int")


def _occurring(posts: DataFrame) -> DataFrame:
    """A row for every kept term of every source that has it: ``n`` there, ``total`` in the language."""
    rows = posts.filter("term IS NOT NULL").select("lang", "term", "total", F.explode("posts").alias("p")).select("lang", "p.source", "term", "p.n", "total")
    return rows.withColumn("bucket", bucket(F.col("n")))


def plan_buckets(posts: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """The buckets that can hold a term above its language's share: their ``bound`` and ``wave``."""
    most = _occurring(posts).groupBy("lang", "source", "bucket").agg(F.max("n").alias("n"), F.min("total").alias("total"), F.count("*").alias("terms"))
    p, q = share("n", "size"), share("total", "lang_size")
    bound = most.join(groups, ["lang", "source"]).withColumns({"p": p, "q": q}).filter("p > q").withColumn("bound", divergence(F.col("p"), F.col("q")))
    before = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum("terms").over(before), F.lit(0))
    wave = F.when(seen < k, 0).otherwise(F.floor(F.log2(seen / k)) + 1).cast("int")
    return bound.select("lang", "source", "bucket", "bound", "size", "kept", "lang_size", wave.alias("wave"))


def top_terms(posts: DataFrame, groups: DataFrame, k: int = 200) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value`` and ``rank`` of each source's k terms that stand out most against its language."""
    keys = ["lang", "source"]
    order = Window.partitionBy(*keys).orderBy(F.desc("value"), "item")
    left = staged(plan_buckets(posts, groups, k), "plan", 0)
    best = None
    while (wave := left.agg(F.min("wave")).first()[0]) is not None:
        now = left.filter(F.col("wave") == wave).drop("bound", "wave")
        if now.count() <= BROADCAST_ROWS:
            now = F.broadcast(now)
        found = _occurring(posts).join(now, [*keys, "bucket"]).withColumns({"__p": share("n", "size"), "__q": share("total", "lang_size")}).filter("__p > __q")
        found = found.select(*keys, F.col("term").alias("item"), divergence(F.col("__p"), F.col("__q")).alias("value"))
        ranked = (found if best is None else found.unionByName(best.drop("rank"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best = staged(ranked, "best", 0)
        kth = best.groupBy(*keys).agg(F.count("*").alias("__have"), F.min("value").alias("__kth"))
        open_ = (F.coalesce("__have", F.lit(0)) < k) | (F.col("bound") >= F.col("__kth"))
        left = staged(left.filter(F.col("wave") > wave).join(kth, keys, "left").filter(open_).drop("__have", "__kth"), "plan", 0)
    return posts.select("lang", F.lit("").alias("source"), F.lit("").alias("item"), F.lit(0).cast("long").alias("value"), F.lit(0).alias("rank")).limit(0) if best is None else best


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _joint(batch: pa.RecordBatch, sums: dict[tuple[str, str, str], int]) -> None:
    """Add what the terms that two sources share change beyond what each changes alone."""
    posts = batch.column("posts")
    flat = posts.flatten()
    source = flat.field(0).dictionary_encode()
    lang = batch.column("lang").dictionary_encode()
    names, tongues = source.dictionary.to_pylist(), lang.dictionary.to_pylist()
    src, p, p0 = source.indices.to_numpy(), flat.field(1).to_numpy(), flat.field(2).to_numpy()
    many = np.diff(posts.offsets.to_numpy()).astype(np.int64)
    first = np.cumsum(many) - many
    # an entry of a posting meets all entries of its term
    start, meets = np.repeat(first, many), np.repeat(many, many)
    tongue = np.repeat(lang.indices.to_numpy(), many).astype(np.int64)
    ends = np.cumsum(meets)
    at = 0
    while at < len(meets):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        m = meets[at:to]
        a = np.repeat(np.arange(at, to), m)
        b = np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[at:to], m)
        a, b = a[a != b], b[a != b]
        value = _f(p[a], p[b]) - _f(p[a], p0[b]) - _f(p0[a], p[b]) + _f(p0[a], p0[b])
        keys, place = np.unique((tongue[a] * len(names) + src[a]) * len(names) + src[b], return_inverse=True)
        high = np.bincount(place, value >> 31, len(keys))
        low = np.bincount(place, value & (1 << 31) - 1, len(keys))
        for key, h, w in zip(keys.tolist(), high.tolist(), low.tolist(), strict=True):
            rest, j = divmod(key, len(names))
            t, i = divmod(rest, len(names))
            sums[tongues[t], names[i], names[j]] += (int(h) << 31) + int(w)
        at = to


def pair_values(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (another source of the language) and ``value``: the divergence summed over all kept terms."""
    whole = "decimal(38,0)"
    zero = F.lit(0).cast("long")
    one = groups.filter("kept > 0").select("lang", "source", "size", "kept", share(zero, "size").alias("p0"))
    other = one.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    away = F.col("source") != F.col("item")
    none = divergence(F.col("p0"), F.col("q0"))
    basis = one.join(other, "lang").filter(away).select("lang", "source", "item", (none.cast("decimal(20,0)") * F.col("kept").cast("decimal(18,0)")).cast(whole).alias("value"))
    bare = groups.filter("kept = 0").select("lang", "source")
    basis = basis.unionByName(bare.join(bare.select("lang", F.col("source").alias("item")), "lang").filter(away).select("lang", "source", "item", F.lit(0).cast(whole).alias("value")))
    counts = _occurring(posts).groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    counts = counts.join(one, ["lang", "source"]).withColumn("p", share("n", "size"))
    met = counts.join(other, "lang").filter(away)
    times = lambda v: F.sum(v.cast("decimal(20,0)") * F.col("terms").cast("decimal(18,0)")).cast(whole).alias("value")
    ours = met.groupBy("lang", "source", "item").agg(times(divergence(F.col("p"), F.col("q0")) - none))
    theirs = met.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(times(divergence(F.col("q0"), F.col("p")) - divergence(F.col("q0"), F.col("p0"))))
    shared = _occurring(posts.filter(F.size("posts") > 1)).join(one, ["lang", "source"]).select("lang", "term", F.struct("source", share("n", "size").alias("p"), "p0").alias("post"))
    lists = shared.groupBy("lang", "term").agg(F.collect_list("post").alias("posts")).select("lang", "posts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], int] = defaultdict(int)
        for batch in batches:
            _joint(batch, sums)
        rows = [{"lang": k[0], "source": k[1], "item": k[2], "value": str(v)} for k, v in sums.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.string()) for c in ("lang", "source", "item", "value")]))
        trim()

    joint = lists.mapInArrow(run, "lang string, source string, item string, value string").withColumn("value", F.col("value").cast(whole))
    parts = basis.unionByName(ours).unionByName(theirs).unionByName(joint)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, k: int = 200) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value`` and ``rank`` of every source of every language."""
    posts = staged(postings(count_terms(docs, text_col, lang_col, source_col), least_docs), "postings")
    groups = staged(groups_of(posts), "groups", 0)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(posts, groups).withColumn("rank", F.row_number().over(order))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part(pairs, "pair").unionByName(part(top_terms(posts, groups, k), "term"))


def op11_divergence(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Query: all pairs of sources of a language, and each source's 200 terms that stand out most."""
    return audit(docs if docs is not None else table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), occurring AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS size FROM kept GROUP BY lang
), groups AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS size FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN occurring USING (lang, source) GROUP BY lang, source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(o.n, 0) + 1) // (g.size + l.v) AS p, 1 + 1000000000::HUGEINT * (k.total + 1) // (l.size + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN occurring o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
