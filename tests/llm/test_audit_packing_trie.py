"""Divergence audit, packing and prefix trie against plain versions and on odd input."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from rasterlake.llm import bpe, divergence, packing, prefixtrie

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {65 + i: 97 + i for i in range(26)}


def brute_audit(docs, k=200, least=3):
    groups, langs, df = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(LOWER))
        groups[lang, source].update(words)
        langs[lang].update(words)
        df.update((lang, w) for w in set(words))
    out = set()
    share = lambda c, n, v: 1 + 1_000_000_000 * (c + 1) // (n + v)
    for lang, source in groups:
        kept = [w for w in langs[lang] if df[lang, w] >= least]
        v = len(kept)
        p = {}
        for key in [g for g in groups if g[0] == lang] + [lang]:
            counts = groups[key] if isinstance(key, tuple) else langs[key]
            n = sum(counts[w] for w in kept)
            p[key] = {w: share(counts[w], n, v) for w in kept}
        f = lambda a, b, w: (p[a][w] - p[b][w]) ** 2 // p[b][w]  # noqa: E731, B023
        own = (lang, source)
        pairs = [(-sum(f(own, g, w) for w in kept), g[1].encode(), g[1]) for g in groups if g[0] == lang and g != own]
        terms = [(-f(own, lang, w), w.encode(), w) for w in kept if groups[own][w] and p[own][w] > p[lang][w]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:k])):
            out |= {(lang, source, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)}
    return out


def audited(df, **kw):
    rows = divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_audit_equals_plain_version_on_odd_rows(spark, tricky, empty):
    docs = [(r.text, r.lang, r.source) for r in tricky.collect()]
    assert audited(tricky) == brute_audit(docs)
    assert divergence.audit(empty).count() == 0


@pytest.mark.parametrize("k", [1, 7, 40])
def test_audit_ends_early_and_stays_exact(spark, k):
    rng = random.Random(k)
    # a Zipf-like vocabulary, sources that prefer some of it, and many equal counts at the k-th place
    vocab = [f"{a}{b}{c}" for a in "abcde" for b in "xyzäß" for c in "klmno"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    docs = []
    for i in range(240):
        s = i % 6
        w = [x * (8 if (j + s) % 11 == 0 else 1) for j, x in enumerate(weights)]
        docs.append((" ".join(rng.choices(vocab, w, k=rng.randint(0, 80))), rng.choice(["en", "de"]), f"s{s}" if s else None))
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(5)
    assert audited(df, k=k) == brute_audit(docs, k)


def test_audit_evaluates_few_terms(spark, monkeypatch):
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    docs = [(" ".join(rng.choices(vocab, k=120) + [f"own{s}"] * 30), "en", f"s{s}") for s in range(4) for _ in range(60)]
    df = spark.createDataFrame([(t + f" top{s} " * 9, lang, s) for t, lang, s in docs], "text string, lang string, source string")
    posts = divergence.postings(divergence.count_terms(df)).cache()
    groups = divergence.groups_of(posts)
    seen = collections.Counter()
    joined = divergence._occurring
    plan = {(r.lang, r.source, r.bucket): r.wave for r in divergence.plan_buckets(posts, groups, 2).collect()}
    for r in joined(posts).collect():
        if (r.lang, r.source, r.bucket) in plan:
            seen[plan[r.lang, r.source, r.bucket]] += 1
    waves = []
    staged = divergence.staged
    monkeypatch.setattr(divergence, "staged", lambda d, name, rows=None: (waves.append(name), staged(d, name, rows))[1])
    assert divergence.top_terms(posts, groups, 2).count() == 8
    evaluated = waves.count("best")
    assert sum(seen[w] for w in range(evaluated)) < 0.05 * joined(posts).count()


def test_shares_are_exact_beyond_long(spark):
    cases = [(0, 1, 0), (2**62, 2**62, 5), (10**15, 10**15 + 3, 7), (3, 17, 4), (0, 0, 0)]
    df = spark.createDataFrame(cases, "n long, size long, kept long")
    got = [r[0] for r in df.select(divergence.share("n", "size")).collect()]
    assert got == [1 + 10**9 * (n + 1) // (s + v) if s + v else None for n, s, v in cases]


def test_bucket_bounds_hold(spark):
    rows = spark.range(1, 100_000).select(divergence.bucket(divergence.F.col("id")).alias("b"), "id").groupBy("b").agg(divergence.F.min("id").alias("a"), divergence.F.max("id").alias("z")).collect()
    spans = sorted((r.b, r.a, r.z) for r in rows)
    assert all(x[2] < y[1] for x, y in zip(spans, spans[1:], strict=False)) and len(spans) < 64 + 16 * 11


# packing


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(bpe.default_tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def check_packing(rows, texts, tokenizer, capacity):
    """``rows`` hold whole documents, cut as they must be, in sequences without gaps."""
    got = collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    want = collections.defaultdict(list)
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[doc].append((k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_packing_of_odd_rows(spark, tricky, empty, tokenizer):
    texts = [(r.doc_id, r.text) for r in tricky.collect()]
    for capacity in (2048, 64):
        used, least = check_packing(packing.pack(tricky, capacity).collect(), texts, tokenizer, capacity)
        assert used <= least * 1.02 + 1
    assert packing.pack(empty).count() == 0


def test_op12_on_the_test_tables(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    rows = packing.op12_packing(spark, sf).collect()
    assert set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    used, least = check_packing(rows, texts, tokenizer, 2048)
    assert used <= least + 1


def best_fill(lengths, capacity):
    reach = {0}
    for x in lengths:
        reach |= {r + x for r in reach if r + x <= capacity}
    return max(reach)


def test_each_bin_is_the_fullest(seeds=range(30)):
    for seed in seeds:
        rng = random.Random(seed)
        capacity = rng.choice([10, 37, 100])
        counts = collections.Counter(rng.choices(range(1, capacity + 1), k=rng.randint(1, 60)))
        left = dict(counts)
        for used, times in packing.combinations(dict(counts), capacity):
            for _ in range(times):
                longest = max(x for x, n in left.items() if n)
                rest = [x for x, n in left.items() for _ in range(n - (x == longest))]
                fill = sum(x * n for x, n in used.items())
                assert longest in used and fill == longest + best_fill(rest, capacity - longest)
                for x, n in used.items():
                    left[x] -= n
                    assert left[x] >= 0
        assert not any(left.values())


def test_combinations_depend_on_lengths_not_on_documents():
    rng = random.Random(2)
    few = {x: rng.randint(1, 3) for x in range(1, 2049)}
    many = {x: n * 10**9 + rng.randint(0, 9) for x, n in few.items()}
    found = packing.combinations(many)
    assert len(found) < 20_000
    assert sum(t for _, t in found) <= -(-sum(x * n for x, n in many.items()) // 2048) * 1.005 + 1


def test_ranks_fill_every_place_once():
    found = [({5: 2, 3: 1}, 4), ({5: 1}, 2), ({3: 4}, 3)]
    table = packing.placements(found)
    keys = (table[:, 0] << 48) + table[:, 1]
    places = collections.Counter()
    for length, n in ((5, 10), (3, 16)):
        for rank in range(n):
            _, first, times, sequence, offset = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1].tolist()
            places.update((sequence + (rank - first) % times, offset + (rank - first) // times * length + i) for i in range(length))
    assert set(places.values()) == {1} and len(places) == 4 * 13 + 2 * 5 + 3 * 12


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_flat_encoding_equals_the_library(name):
    import public_tokenizers

    enc = bpe.ChunkEncoder(public_tokenizers.path(name))
    rng = random.Random(1)
    odd = ["", " ", "a", "Über Größe", "x<|endoftext|>y", "é ́a", "don't 12 3a​", "\n\n日本 語", "a\x85b c\x1cd"]
    texts = odd + ["".join(rng.choices(["ab", " ", "É", "1", ".", "\t", "ß", "'s", "́", "李"], k=rng.randint(1, 200))) for _ in range(300)]
    for most in (10, 10_000):
        flat, sizes = enc.encode_flat(texts, most)
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        assert [p.tolist() for p in parts] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# prefix trie


def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    convs = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        convs[c] = tuple(turns.get(base, [])[:h] + t[h:])
    members = collections.defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = collections.Counter()
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        childless = lambda q: not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(p))))
        out[min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(x) == len(p) + 1 and x[: len(p)] == p for x in members), sum(map(childless, under)), saved, hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(df):
    return collections.Counter(tuple(r) for r in prefixtrie.trie(df).select(*COLUMNS).collect())


def odd_turns(seed):
    rng = random.Random(seed)
    say = lambda: rng.choice(["", "yes", "no way", "a b c", "été  là", None])
    rows = []
    for c in [*range(70), -5, -20, 200, 221, 10**12 + 7]:
        if c in (40, 60) and seed:
            continue  # blocks without a first conversation
        rows += [(c, t, rng.choice(["user", "bot", None]), say()) for t in range(rng.randint(1, 5))]
    rows += [(3, None, "user", "first"), (3, None, None, None), (7, 0, "user", "same"), (7, 0, "user", "same"), (None, 0, "user", "nobody"), (None, 1, None, None)]
    rows += [(300 + i, t, "user", f"turn {t}") for i in range(30) for t in range(6)]  # copies
    rows += [(500, t, "user", f"long {t % 7}") for t in range(150)] + [(501, 0, "user", "x " * 50_000)]
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_trie_equals_plain_version(spark, seed):
    rows = odd_turns(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert trie_rows(df) == brute_trie(rows)


def test_trie_spans_blocks_and_pieces(spark, monkeypatch):
    rows = odd_turns(2)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, position int")
    monkeypatch.setattr(prefixtrie, "SPAN", 7)
    monkeypatch.setattr(prefixtrie, "JOINED", 60)
    assert trie_rows(df) == brute_trie(rows)
    assert prefixtrie.trie(df.limit(0)).count() == 0


def test_sql_of_the_queries(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for query, sql, cols in ((divergence.op11_divergence, divergence.OP11_SQL, ("lang", "source", "part", "item", "value", "rank")), (prefixtrie.op13_prefix_trie, prefixtrie.OP13_SQL, COLUMNS)):
        want = collections.Counter(con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())
        assert collections.Counter(tuple(r) for r in query(spark, sf).select(*cols).collect()) == want
