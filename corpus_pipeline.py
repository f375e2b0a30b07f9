"""The corpus pipeline: five stages from ``documents`` to encoded training data.

Each stage works on all that the one before kept and is written as Parquet in the shared
folder; the next one reads it from there, so a lost executor costs single tasks.

1. ``language``: documents without a letter, or in which no language has at least 40 %
   of the positions' probability, go.
2. ``lines``: lines that repeat an earlier one, of any length, or (from 16 code points
   on) are one edit from it, go; a document of which no word is left goes.
3. ``near_duplicates``: of documents that share 80 % of their five-word shingles,
   directly or by others, the smallest id stays; of rows of that id in the group, one.
4. ``mix``: sources get 1, 2 or 3 parts of all words, at most three times their own; a
   document that the mix takes twice becomes two rows.
5. ``encode``: ids (little-endian uint32), their number and the digest of the text that
   they decode to.

Defined cases: every operator's own hold; an empty table gives an empty result; extra
columns pass through stages 1 to 4; of documents of a null id, one of each set of
shingles stays, unless one with an id has that set.

What an operator stages goes when its stage is written, a stage's table when the last
one is.  The subpackage is imported when a stage runs.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.sources.staging import delete, scratch, shared_dir

MIN_LANGUAGE_SCORE = 0.4


#: Columns of ``documents``; others are set aside while a stage runs.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def aside(stage):
    """The stage with all other columns under names that no operator uses; it returns the columns that it was given."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        away = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        out = stage(spark, docs.withColumnsRenamed(away), sf_dir)
        return out.select(*[away.get(c, c) for c in docs.columns]).toDF(*docs.columns)

    return run


@aside
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from rasterlake.llm import langid

    found = langid.identify(docs, langid.fit(docs), keep=docs.columns)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))


@aside
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from rasterlake.llm import lines
    from rasterlake.llm.common import WORD_PATTERN

    out = lines.dedup_lines(docs)
    left = F.col("text").rlike(WORD_PATTERN)
    return out.filter((F.col("n_dropped") == 0) | left).withColumn("n_chars", F.length("text").cast("long"))


@aside
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from rasterlake.llm import neardup
    from rasterlake.llm.common import text_of

    found = neardup.near_duplicates(docs, percent=80).filter("kept")
    group = F.when(F.col("n_shingles") == 0, F.hex("text_hash")).when(F.col("doc_id").isNull(), F.hex("digest")).otherwise(F.lit(""))
    stays = found.groupBy(F.col("doc_id").alias("__id"), group.alias("__group")).agg(F.min("text_hash").alias("__hash")).select("__id", "__hash")
    rows = docs.withColumns({"__key": F.col("doc_id").cast("long"), "__text": F.xxhash64(text_of())})
    same = F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash"))
    return rows.join(stays, same, "left_semi").dropDuplicates(["__key", "__text"])


@aside
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from rasterlake.llm import mixing
    from rasterlake.llm.common import staged

    sizes = staged(docs.select("doc_id", "source", mixing.word_count().alias("__words")), "sizes")
    taken = mixing.mix(docs.withColumn("__words", mixing.word_count()), size_col="__words", statistics=sizes)
    return taken.filter("repeats > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from rasterlake.llm import bpe

    out = bpe.encode_documents(docs)
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("lines", line_dedup), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]

#: SQL can't express the network and the forest; the tests hold each stage's rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/staged/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{root}/{name}")
            docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    for name, _ in STAGES[:-1]:
        delete(spark, f"{root}/{name}")
    return docs
