"""Near-duplicates, lines, mixing, rollups, top-k and the pipeline against plain versions and on odd input."""

import collections
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterlake.llm import components, lines, mixing, neardup, queries, tokencounts, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {65 + i: 97 + i for i in range(26)}


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


class Union(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def brute_components(rows, percent):
    u, sets = Union(), [(i, shingles(t)) for i, t in rows]
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            u.join(a, b)
    return {i: u.root(i) for i, _ in rows}


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 202), (202, 203), (200, 203)]
    edges += [tuple(sorted(rng.sample(range(300, 400), 2))) for _ in range(60)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: u.root(n) for n in {x for e in edges for x in e}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts(seed, families=6, size=14):
    """Families of copies with more and more words changed, so that some pairs lie on either side of the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    out = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice([30, 120, 300]))]
        for k in range(size):
            w = list(base)
            for _ in range(k % 5):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out + [out[0].upper(), "few words", "few  words", "", None]))


@pytest.mark.parametrize("percent", (80, 85))
def test_near_duplicates_equal_brute_force(spark, percent, monkeypatch):
    rows = near_texts(percent)
    want = brute_components(rows, percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (neardup.BLOCK, 700):  # the small one splits regions into many blocks
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in neardup.near_duplicates(docs, percent=percent).collect()}
        assert got == {i: (want[i], len(shingles(t)), want[i] == i) for i, t in rows}


def test_one_large_group_is_compared_in_proportion_to_its_size(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 2000)
    pairs = []
    monkeypatch.setattr(neardup, "_compared", lambda df, percent, f=neardup._compared: pairs.append(df.count()) or f(df, percent))
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(200)]
    made = []
    for n in (120, 480):
        pairs.clear()
        rows = []
        for i in range(n):
            w = list(base)
            w[rng.randrange(200)] = word()
            rows.append((i, " ".join(w)))
        rows += [(n + i, " ".join(base[: 150 - 2 * i] + [word() for _ in range(50)])) for i in range(4)]  # at and beyond the edge of the group
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        want = brute_components(rows, 80)
        assert got == want
        made.append(sum(pairs))
    assert made[1] < 6 * made[0]


def test_size_classes_keep_linked_sizes_near(spark):
    for percent in (50, 80, 85, 99):
        sizes = spark.range(1, 3000).select(F.col("id").alias("n"), neardup.size_class(F.col("id"), percent).alias("c")).collect()
        by = {r.n: r.c for r in sizes}
        assert all(by[min(2999, 100 * n // percent)] - by[n] <= 1 for n in by)


def test_runs_are_the_same_however_rows_are_batched(spark):
    rng = np.random.default_rng(23)
    depth = 4
    labels = rng.integers(0, 3, (3000, depth)).astype(">u2").view(np.uint8).reshape(3000, -1)
    labels[:40] = labels[0]
    rows = [(b"\0" + x.tobytes(), i) for i, x in enumerate(labels)]
    tail = [(b"\1" + rng.integers(0, 60, depth).astype(">u2").tobytes(), i) for i in range(3000)]  # sparse runs
    df = spark.createDataFrame(rows + tail, "label binary, rep long").repartition(1).sortWithinPartitions("label", "rep")
    found = []
    for size in ("5000", "7", "64"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        out = neardup._neighbours(df, depth).filter("place is null").collect()
        u = Union()
        for r in out:
            u.join(r.a, r.b)
        found.append({i: u.root(i) for i in range(3000)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
    assert found[0] == found[1] == found[2]


def test_near_duplicates_on_odd_rows(tricky, empty):
    out = neardup.near_duplicates(tricky).collect()
    assert len(out) == tricky.count() and neardup.near_duplicates(empty).count() == 0
    by = {r.doc_id: r for r in out}
    assert by[100].n_shingles == 0 and by[100].component_id == 100 and by[200].component_id == 5


def test_shingle_hashes_tell_words_apart():
    texts = ["A b c d e f", "a B\tc\nd e f", "ab c d e f", "a", "", " ", "a b", "é É", "x " * 3000]
    got = neardup.shingle_sets(texts)
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    for (a, x), (b, y) in itertools.combinations(zip(texts, got, strict=True), 2):
        assert len(np.intersect1d(x, y)) == len(shingles(a) & shingles(b))


def brute_lines(rows):
    """For each row, in their order: lines, dropped lines, text left."""
    import hashlib

    place = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()[:15])
    first, at = {}, []
    for i, t in sorted(rows, key=place):
        for n, x in enumerate(t.split("\n") if t else []):
            if x:
                first.setdefault(x, (*place((i, t)), n))
                at.append(((*place((i, t)), n), x))
    long = [x for x in first if len(x) >= lines.MIN_CHARS]
    near = {b for a, b in itertools.permutations(long, 2) if abs(len(a) - len(b)) <= 1 and first[a] < first[b] and distance_one(a, b)}
    gone = {p for p, x in at if first[x] != p or x in near}
    out = []
    for r in rows:
        all_ = r[1].split("\n") if r[1] else []
        left = [x for n, x in enumerate(all_) if (*place(r), n) not in gone]
        out.append((r[0], len(all_), len(all_) - len(left), "\n".join(left)))
    return out


def distance_one(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= 1


def test_lines_equal_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choices("abé ", k=rng.choice([15, 16, 17, 18, 40, 41]))) for _ in range(40)]

    def edit(x):
        p, kind = rng.randrange(len(x) + 1), rng.choice("isd=2")
        y = x[:p] + ("z" if kind in "is2" else "") + x[p + (kind in "sd2") :]
        return edit(y) if kind == "2" else y if kind != "=" else x

    rows = [(i, "\n".join(edit(rng.choice(base)) for _ in range(rng.randint(0, 6)))) for i in range(70)] + [(70, None), (71, "short\nshort")]
    rows += [(None, rows[3][1] + "\nof a null id, twice here"), (None, "of a null id, twice here"), (None, None), ((1 << 63) - 1, "of a null id, twice here"), (-5, "-" * 20), (-(1 << 63), "-" * 21)]
    rows += [(9, "another text of a used id\n" + base[0]), (9, "another text of a used id\nwith that"), (10, rows[10][1]), (72, "Les.\nLes,\n日本語の短い文\n\n"), (73, "Les.\n日本語の短い文\n\nexactly sixteen!\nexactly sixteen?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (lines.BROADCAST_LINES, 0):  # 0: the join of wanted lines is shuffled
        lines.BROADCAST_LINES, before = most, lines.BROADCAST_LINES
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(docs).collect()]
        lines.BROADCAST_LINES = before
        assert sorted(got, key=repr) == sorted(brute_lines(rows), key=repr)


def test_lines_on_odd_rows(tricky, empty):
    out = lines.dedup_lines(tricky)
    assert out.count() == tricky.count() and out.columns == [*[c for c in tricky.columns if c != "n_lines"], "n_lines", "n_dropped"]
    assert lines.dedup_lines(empty).count() == 0
    assert out.filter("doc_id = 105").first()["n_dropped"] == 29


def test_one_edit_apart_equals_the_edit_distance():
    rng = random.Random(12)
    for _ in range(3000):
        a = "".join(rng.choices("ab", k=rng.randint(0, 6)))
        b = "".join(rng.choices("ab", k=rng.randint(0, 6)))
        assert lines.one_edit_apart(a, b) == distance_one(a, b)


def test_fit_counts_finds_the_best_sum():
    rng = np.random.default_rng(13)
    for _ in range(200):
        lengths = np.unique(rng.integers(1, 15, rng.integers(1, 5)))
        counts = rng.integers(1, 4, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 1))
        take = mixing.fit_counts(lengths, counts, budget)
        sums = {sum(t) for t in itertools.product(*([n * int(w) for n in range(c + 1)] for w, c in zip(lengths, counts, strict=True)))}
        assert (take >= 0).all() and (take <= counts).all() and (take * lengths).sum() == min(sums, key=lambda x: (abs(x - budget), x))
    big = mixing.fit_counts(np.arange(1, 3000), np.full(2999, 1000), 2_000_000_001)
    assert (big * np.arange(1, 3000)).sum() == 2_000_000_001


@pytest.mark.parametrize("scale", (1, 40))  # below and above what the dynamic programme reaches
def test_every_length_gives_its_share(scale):
    rng = np.random.default_rng(17)
    lengths, n = np.unique(rng.lognormal(6, 1, 400).astype(np.int64) + 1, return_counts=True)
    counts = n * scale
    total, takes = int((lengths * counts).sum()), []
    for seed in range(60):
        take = mixing.fit_counts(lengths, counts, int(0.53 * total), seed)
        assert (take >= 0).all() and (take <= counts).all() and (take * lengths).sum() == int(0.53 * total)
        takes.append(take)
    assert len({t.tobytes() for t in takes}) > 30
    assert (mixing.fit_counts(lengths, counts, int(0.53 * total), 3) == takes[3]).all()
    for part in np.array_split(np.arange(len(lengths)), 8):  # from the shortest to the longest
        share = np.mean([t[part].sum() / counts[part].sum() for t in takes])
        assert abs(share - 0.53) < 0.06, (part[0], share)


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not full:
            target |= {s: w[s] * level for s in open_}
            break
        target |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def test_targets_fill_levels(spark):
    for seed in range(4):
        rng = random.Random(seed)
        sizes = {f"s{i}": rng.choice([1, 5, 40, 1000, 7000]) for i in range(rng.randint(1, 9))}
        got = {r["__source"]: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "__source string, __size long")).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def subset_sums(sizes, limit):
    reach = 1
    for n in sizes:
        reach |= reach << n
        reach &= (1 << (limit + 1)) - 1
    return reach


def test_mixing_query_meets_targets_and_repeats_itself(spark, tricky, empty):
    once, twice = (mixing.op6_mixing(spark, "", tricky).collect() for _ in range(2))
    key = lambda rows: sorted(map(repr, rows))
    assert key(once) == key(twice)
    source = {}
    for r in tricky.collect():
        source.setdefault(r.doc_id, r.source)  # rows of one id share a source, but for the repeated one
    want = collections.Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in tricky.collect())
    assert collections.Counter((r.doc_id, r["size"]) for r in once) == want
    sizes = collections.defaultdict(list)
    for r in tricky.collect():
        sizes[r.source].append(len(WORD.findall(r.text or "")))
    order = sorted(sizes, key=lambda s: (s is None, s))
    goal = brute_targets({i: sum(sizes[s]) for i, s in enumerate(order)})
    taken = collections.Counter()
    at = {(sum(sizes[s]), round(goal[i], 6)): i for i, s in enumerate(order)}
    for r in once:
        assert 0 <= r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[at[r.source_size, round(r.target, 6)]] += r.taken
    for i, s in enumerate(order):
        full, total = divmod(goal[i], sum(sizes[s]))[0], sum(sizes[s])
        rest = round(goal[i] - min(3, full) * total)
        reach = subset_sums(sizes[s], total)
        best = min(abs(x - rest) for x in range(total + 1) if reach >> x & 1)
        assert abs(taken[i] - full * total - rest) == best, s
    assert mixing.op6_mixing(spark, "", empty).count() == 0


def test_only_rows_of_cut_buckets_are_ranked(spark, monkeypatch):
    """A third of all rows share an id, a source and a length; another third have no id."""
    rows = [(7, "s0", 10)] * 400 + [(None, "s0", 12)] * 400 + [(i, f"s{i % 3}", 5 + i % 9) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(5)
    seen = []
    ranks = mixing.ranks
    monkeypatch.setattr(mixing, "ranks", lambda d, *order: (seen.append(d), ranks(d, *order))[1])
    got = mixing.mix(df, share=0.5).collect()
    assert len(got) == len(rows)
    taken, target, longest = collections.Counter(), {}, collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r.size)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    cut = next(d for d in seen if "__row" in d.columns)
    cells = cut.groupBy("__source", "__size", "__bucket").count().collect()
    assert 0 < cut.count() < len(rows) and all(r["count"] > 1 for r in cells)
    # one bucket's tied rows are dealt to several tasks
    dealt = cut.repartitionByRange(4, "__source", "__size", "__bucket", "__draw", "__row").select(F.spark_partition_id().alias("p")).distinct().count()
    assert dealt > 1


def test_fitting_many_lengths_without_an_exact_sum_is_bounded():
    import tracemalloc

    lengths = np.arange(2, 40_002, 2)
    lengths[-1] = 40_001  # one odd length, so that the gcd doesn't tell
    counts = np.full(len(lengths), 3)
    counts[-1] = 0
    tracemalloc.start()
    budget = int((lengths * counts).sum() * 0.37) | 1
    take = mixing.fit_counts(lengths, counts, budget)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs((take * lengths).sum() - budget) == 1 and peak < 30e6


def test_hot_lengths_are_taken_by_buckets(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id < 2900 THEN 'a' ELSE 'b' END AS source", "7L AS size")
    out = mixing.mix(rows).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 7 for r in out)


def test_ledger_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("s", "en", "t1", 5), ("s", "en", "t1", 7), (None, "fr", "t1", None)], "source string, lang string, tokenizer string, n_tokens long")
    ledger = tokencounts.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0
    assert ledger.apply(1, tokencounts.inserted(rows)) and not ledger.apply(1, tokencounts.inserted(rows))
    assert ledger.apply(2, tokencounts.deleted(rows.limit(1)))
    assert ledger.apply(3, tokencounts.revised(rows.filter("n_tokens = 7").withColumn("new", F.lit(9)), "n_tokens", "new"))
    assert ledger.apply(4, tokencounts.inserted(rows.limit(0)))
    assert {(r.source, r.n_docs, r.n_tokens) for r in ledger.totals().collect()} == {("s", 1, 9), (None, 1, 0)}
    totals = lambda: {(r.source, r.n_docs, r.n_tokens) for r in ledger.totals().collect()}
    tokencounts.inserted(rows).write.parquet(str(tmp_path / "ledger" / "attempt-of-a-lost-driver"))
    assert totals() == {("s", 1, 9), (None, 1, 0)}
    assert not ledger._commit(rows.limit(1), "batch=3") and totals() == {("s", 1, 9), (None, 1, 0)}  # two writers of one number
    ledger.compact()
    assert totals() == {("s", 1, 9), (None, 1, 0)} and ledger._names("batch") == []
    assert not ledger.apply(3, tokencounts.inserted(rows)) and ledger.apply(9, tokencounts.inserted(rows.filter("n_tokens = 5")))
    ledger.compact()
    assert totals() == {("s", 2, 14), (None, 1, 0)} and not ledger.apply(9, tokencounts.inserted(rows)) and ledger._names("base") == ["base=1"]


def test_total_counts_cover_every_document(spark, tricky, empty, tmp_path):
    from tokenizers import Tokenizer

    from rasterlake.llm import bpe

    t = Tokenizer.from_file(bpe.default_tokenizer_path())
    t.no_truncation()
    t.no_padding()
    rows = tricky.withColumn("lang", F.when(F.col("doc_id").isin(101, 102), "short").otherwise(F.col("lang")))  # a group of short texts alone
    want = collections.defaultdict(lambda: [0, 0])
    for r in rows.collect():
        text = r.text or ""
        for version, n in (("words-1", len(WORD.findall(text))), ("bytes-1", len(text.encode())), ("bpe-1", len(t.encode(text, add_special_tokens=False).ids))):
            want[r.source, r.lang, version][0] += 1
            want[r.source, r.lang, version][1] += n
    for _ in range(2):  # the second time on the same ledger
        got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in tokencounts.total_counts(rows, str(tmp_path / "ledger")).collect()}
        assert got == dict(want) and ("s0", "short", "bpe-1") in got
    assert tokencounts.total_counts(empty).count() == 0


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(14)
    v = rng.normal(0, 0.3, (300, 10)).astype(np.float32)
    v[50:120] = v[7]  # ties
    more = [(1000, None), (1001, []), (1050, []), (1002, [float("nan")] * 10), (1003, [None] * 10), (1004, [float("inf")] * 10), (1005, [1.0, 2.0]), (None, [1.0] * 10)]
    rows = [(i, [float(x) for x in r], "s", i) for i, r in enumerate(v)] + [(i, x, "s", 0) for i, x in more]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, tile int").repartition(3)
    q = np.zeros((303, 10), np.int64)
    q[:300] = np.floor(v.astype(np.float64) * 256)
    q[302, :2] = [256, 512]
    ids = np.array([*range(300), 1001, 1050, 1005])
    for k, least in ((1, 32), (5, 32), (5, 1024), (400, 32)):
        monkeypatch.setattr(topk, "LEAST", least)
        got = sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), k).collect())
        want = []
        for i, vector in [*((i, q[i]) for i in range(0, 300, 50)), (1050, q[301])]:  # the empty query scores 0 with all
            s = q @ vector
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            want += [(i, n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(order)]
        assert got == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0 and topk.top_k(df.limit(0), df).count() == 0


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.25, 1.0]), (1, [0.5, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id = 0"), 3).collect())
    assert got == [(0, 1, 1, 32768), (0, 1, 1, 65536), (0, 2, 1, 0), (0, 2, 1, 32768), (0, 3, 1, 0), (0, 3, 1, 16384)]


def test_top_k_makes_few_whole_scores():
    rng = np.random.default_rng(15)
    unit = lambda v: np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    x, ids = unit(rng.normal(size=(8000, 64))), np.arange(8000)
    q, q_ids = x[::50], ids[::50]
    cut = topk.gather(q_ids, q, ids[:2000], x[:2000], 5)
    made = 0
    for a in range(0, 8000, 2000):
        found, n = topk.collect(q_ids, q, cut, ids[a : a + 2000], x[a : a + 2000], *topk.summary(x[a : a + 2000])[:2], 5)
        made += n
    assert np.isfinite(cut).all() and 0 < made < len(q) * len(x) / 10
    # far groups are not scored at all
    centres = unit(rng.normal(size=(2, 64)))
    near, far = (np.floor(256 * rng.normal(0, 0.01, (500, 64))).astype(np.int64) + c for c in (centres[0], -centres[0]))
    cut = topk.gather(np.arange(500), near, np.arange(500), near, 5)
    assert topk.collect(np.arange(500), near, cut, np.arange(500, 1000), far, *topk.summary(far)[:2], 5) == ([], 0)


def test_top_k_stays_exact_beyond_doubles(spark):
    df = spark.createDataFrame([(0, [1e10, 3.0]), (1, [1e3, 5.0]), (2, [1e3, 4.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, df.filter("vec_id = 0"), 1).collect()] == [(0, 1, 1, int(2.56e12) * 256000 + 768 * 1280)]


def test_registered_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    for name, sql in queries.ORACLE_SQL.items():
        a, b = queries.QUERIES[name](spark, sf).toPandas(), con.execute(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        plain = lambda d: sorted(tuple(int(v) if hasattr(v, "dtype") and v.dtype.kind in "iub" else v for v in r) for r in d[cols].itertuples(index=False))
        assert plain(a) == plain(b), name


def test_pipeline_stages(spark, tricky, empty):
    from tokenizers import Tokenizer

    from rasterlake.llm import bpe, langid
    from rasterlake.llm.common import staged

    plain = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    docs = tricky
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, ""), name)
        was = before.collect()
        if name != "encode":
            assert docs.columns == tricky.columns
            assert {(r.n_lines, r.score, r.target, r.size) for r in docs.collect()} == {(3, 7, "z", "y")}  # extra columns keep their values
        if name == "language":
            network = langid.Network(*langid.fit(before))
            said = [(r.doc_id, r.text, *network([r.text or ""])[0]) for r in was]
            assert plain(docs) == sorted([(i, t) for i, t, lang, score in said if lang != "und" and score >= 0.4], key=repr)
            assert {100, 101, 102}.isdisjoint(r.doc_id for r in docs.collect())
        if name == "lines":
            assert plain(docs) == sorted([(i, t) for i, _, n, t in brute_lines([(r.doc_id, r.text) for r in was]) if not n or WORD.search(t)], key=repr)
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "near_duplicates":
            sets = {}
            for r in was:
                if s := shingles(r.text):
                    sets.setdefault(s, []).append(r.doc_id)
            rep = {s: min((i for i in ids if i is not None), default=None) for s, ids in sets.items()}
            u = Union()
            for x, y in itertools.combinations([s for s in sets if rep[s] is not None], 2):
                if 100 * len(x & y) >= 80 * len(x | y):
                    u.join(rep[x], rep[y])
            want = collections.Counter({u.root(i) for s, i in rep.items() if i is not None})
            want[None] = sum(i is None for i in rep.values())
            assert collections.Counter(r.doc_id for r in docs.collect()) == +want
            assert all(r.doc_id is None or u.root(rep[shingles(r.text)]) == r.doc_id for r in docs.collect())
        if name == "mix":
            sizes, taken = collections.defaultdict(list), collections.Counter()
            for r in was:
                sizes[r.source].append(len(WORD.findall(r.text)))
            for r in docs.collect():
                taken[r.source] += len(WORD.findall(r.text))
            order = sorted(sizes, key=lambda s: (s is None, s))
            goal = brute_targets({i: sum(sizes[s]) for i, s in enumerate(order)})
            for i, s in enumerate(order):
                total = sum(sizes[s])
                full = min(3, int(goal[i] // total))
                reach = subset_sums(sizes[s], total)
                rest = 0 if full == 3 else round(goal[i] - full * total)
                assert abs(taken[s] - full * total - rest) == min(abs(x - rest) for x in range(total + 1) if reach >> x & 1)
            assert {x for x, n in collections.Counter(plain(docs)).items() if n > 3} == set()
            assert set(plain(docs)) <= set(plain(before))
        if name == "encode":
            t = Tokenizer.from_file(bpe.default_tokenizer_path())
            t.no_truncation()
            t.no_padding()
            ids = [(r.doc_id, t.encode(r.text, add_special_tokens=False).ids) for r in was]
            assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in docs.collect()), key=repr) == sorted(ids, key=repr)
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, ""), "empty")
    assert docs.count() == 0


def test_pipeline_leaves_only_its_result(spark):
    from pathlib import Path

    from rasterlake.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:").replace("//", "/", 1)) / "staged"
    before = set(folder.iterdir()) if folder.exists() else set()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
    (left,) = set(folder.iterdir()) - before
    assert [p.name for p in left.iterdir()] == ["encode"]
