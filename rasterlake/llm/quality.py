"""Document quality by Bradley-Terry ranking of labelled pairs.

A document's strength is linear in features of its whole text.  From pairs of a
document labelled 1 and one labelled 0, the weights are learnt by logistic loss on the
difference of the pair's features.  Strengths are then cut at the quantile that leaves
the labelled share of ones above it; the score is the logistic function of the distance
from that cut.

The fit takes at most ``max_rows`` labelled rows (those with the smallest hashes of
their ids) and ``PAIRS`` pairs of them; features of all other rows never leave their
tasks.  Labels, language, source and id are not among the features.

Defined cases: null and empty texts have features of zero and a score like any other;
without labels of both kinds every score is the share of ones, or 0.5 without labels;
repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import held_out, small_batches, table, text_of

PAIRS = 40_000


def _byte_classes() -> np.ndarray:
    """Indicators of byte classes, one column for each."""
    b = np.arange(256)
    classes = [
        (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57), b >= 128, b == 32, b == 10,
        np.isin(b, list(b".,;:'\"?-()")), b == ord("!"), b == ord("|"), np.isin(b, list(b"#$%&*")), np.isin(b, list(b"<>{}[]\\/=_@^~`+")), b == 9,
    ]
    return np.stack(classes, 1).astype(np.float64)


_CLASSES = _byte_classes()
N_FEATURES = _CLASSES.shape[1] + 8


def features(text: str) -> np.ndarray:
    """Shares of byte classes, and shapes of words and lines."""
    out = np.zeros(N_FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return out
    k = _CLASSES.shape[1]
    out[:k] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / len(raw)
    words = text.split()
    lines = text.split("\n")
    n = len(words)
    if n:
        distinct = len(set(words))
        ends = sum(map(len, words))
        out[k] = np.log1p(n)
        out[k + 1] = distinct / n
        out[k + 2] = np.log(distinct) / np.log(n + 1.0)
        out[k + 3] = ends / n / 10
        out[k + 4] = max(map(len, words)) / ends
    out[k + 5] = len(set(lines)) / len(lines)
    out[k + 6] = np.log1p(len(raw) / len(lines))
    out[k + 7] = sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / len(lines)
    return out


def fit_pairs(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.1, decay: float = 1e-4, seed: int = 3) -> dict:
    """Weights by logistic loss on differences of pairs, and the cut at the quantile of the share of zeros."""
    share = float(y.mean()) if len(y) else 0.5
    ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    model = {"mean": mean, "scale": scale, "w": np.zeros(N_FEATURES), "cut": -float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))}
    if not len(ones) or not len(zeros):
        return model
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(ones, PAIRS)] - z[rng.choice(zeros, PAIRS)]
    w, m, s = (np.zeros(N_FEATURES) for _ in range(3))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
        g = -(p @ d) / PAIRS + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    strength = z @ w
    return model | {"w": w, "cut": float(np.quantile(strength, 1 - share))}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -6, 6) @ model["w"] - model["cut"]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 6000, seed: int = 17) -> dict:
    """Learn from labelled rows that aren't held out, ``max_rows`` of them at most; of an id's texts the one of the smallest features."""
    rows = labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    chosen = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id", "y").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")  # max_rows rows
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tolist() for v in x], pa.list_(pa.float64()))], names=schema.names)

    # one row of features for each labelled id, however often documents or labels repeat it
    once = texts.select("id", "y", "text").mapInArrow(run, schema).groupBy("id", "y").agg(F.min("x").alias("x"))
    found = sorted((r["id"], r["y"], r["x"]) for r in once.collect())
    return fit_pairs(np.array([r[2] for r in found]).reshape(len(found), N_FEATURES), np.array([r[1] for r in found], np.int64))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``score`` (0 to 1; 0.5 at the cut) of every document.  A map over the rows, without a shuffle."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    schema = T.StructType([source.schema[0], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                x = np.stack([features(t) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores(model, x), pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Query: quality score and prediction of every document."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
