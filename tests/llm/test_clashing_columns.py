"""Extra columns whose names operators use themselves change nothing."""

import math
import random

from pyspark.sql import functions as F

from rasterlake.llm import divergence, packing, tokencounts, topk

NAMES = ["query_id", "rank", "score", "tile", "q", "x", "n", "docs", "term", "posts", "total", "n_docs", "n_tokens", "tokenizer", "batch", "piece", "start", "length", "__task", "__place", "__rank", "sequence_id", "offset", "item", "value", "part"]


def crowded(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in NAMES if c not in df.columns])


def test_top_k_with_clashing_columns_and_odd_vectors(spark):
    rng = random.Random(6)
    vectors = [(i, [rng.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(6)]) for i in range(160)]
    vectors += [(200, None), (250, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (300, [math.nan] * 6), (350, [math.inf] * 6), (400, [0.0] * 6), (401, [1.0] * 6), (402, [1.0] * 6)]
    df = crowded(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    whole = {i: [math.floor(256 * c) for c in v] for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)}
    want = []
    for i in whole:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[i], whole[j], strict=True)), j) for j in whole if j != i)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), 5)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)


def test_token_counts_with_clashing_columns(spark, tmp_path):
    rows = [(1, "a b c d e f", "en", "s"), (2, "short one", "en", None), (3, None, None, "s"), (1, "a b c d e f", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plain, more = ({tuple(r) for r in tokencounts.total_counts(d, str(tmp_path / name)).collect()} for name, d in (("a", df), ("b", crowded(df))))
    assert plain == more and ("s", "en", "words-1", 2, 12) in {(r[0], r[1], r[2], r[3], r[4]) for r in plain}


def test_audit_and_packing_with_clashing_columns(spark):
    rows = [(i, "one two three four " * (1 + i % 3), "en", f"s{i % 2}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(df).collect())) == sorted(map(tuple, divergence.audit(crowded(df)).collect()))
    pieces = [sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack(d, 16).collect()) for d in (df, crowded(df))]
    assert pieces[0] == pieces[1]
