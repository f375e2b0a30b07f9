"""Token counts as delta-maintained rollups.

A batch of changes (inserts, deletes, revised counts) is summed into signed deltas by
source, language and tokenizer version, and committed as one folder of a ledger under
its batch number.  Totals are the sums over committed batches; a batch that is applied
again, whole or after a failure, changes nothing.

A batch is written to a folder of its own attempt, which is renamed to the batch's name
when it is whole.  The rename fails where the name is taken, so of two writers of one
batch number one commits, and what a failed attempt leaves is never read.  ``compact``
puts the totals so far in the place of their batches, whose numbers it remembers.

The folder needs a rename that is atomic and fails where the name is taken, as HDFS and
shared POSIX folders have it; object stores don't.  A batch's deltas, at most a row for each
source, language and version, are written as one file.

Defined cases: null counts add nothing; null sources and languages are groups of their
own; groups whose documents are all deleted vanish; repeated rows count each; an empty
batch commits and adds nothing; other columns are not read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import delete
from .bpe import encode_documents
from .common import WORD_PATTERN, shared_dir, staged, table, text_of

KEYS = ("source", "lang", "tokenizer")
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def inserted(rows: DataFrame, count: str = "n_tokens") -> DataFrame:
    """Changes for new documents."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce(F.col(count).cast("long"), F.lit(0)).alias("n_tokens"))


def deleted(rows: DataFrame, count: str = "n_tokens") -> DataFrame:
    """Changes for documents that go, with the counts they were entered with."""
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.coalesce(F.col(count).cast("long"), F.lit(0))).alias("n_tokens"))


def revised(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Changes for documents whose counts are corrected."""
    zero = F.lit(0)
    return rows.select(*KEYS, zero.cast("long").alias("n_docs"), (F.coalesce(F.col(new).cast("long"), zero) - F.coalesce(F.col(old).cast("long"), zero)).alias("n_tokens"))


class Ledger:
    """Committed batches of deltas in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _names(self, kind: str) -> list[str]:
        folder = self.jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.conf)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return [n for n in names if n.startswith(f"{kind}=")]

    def _commit(self, rows: DataFrame, name: str) -> bool:
        """Write rows under a name at once; False where the name is taken."""
        attempt = f"{self.path}/attempt-{uuid.uuid4().hex}"
        rows.write.parquet(attempt)
        hadoop = self.jvm.org.apache.hadoop.fs
        source, target = hadoop.Path(attempt), hadoop.Path(f"{self.path}/{name}")
        context = hadoop.FileContext.getFileContext(source.getFileSystem(self.conf).getUri(), self.conf)
        try:
            context.rename(source, target, self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
            return True
        except Exception as e:
            if "AlreadyExists" not in str(e):
                raise
            delete(self.spark, attempt)
            return False

    def _base(self) -> str | None:
        """The newest compacted totals."""
        return max(self._names("base"), key=lambda n: int(n.split("=")[1]), default=None)

    def _compacted(self, base: str | None) -> set[int]:
        if base is None:
            return set()
        return {r["batch"] for r in self.spark.read.schema(f"{DELTAS}, batch long").parquet(f"{self.path}/{base}").filter("batch is not null").select("batch").collect()}  # one number for each batch

    def committed(self, batch: int) -> bool:
        return f"batch={int(batch)}" in self._names("batch") or int(batch) in self._compacted(self._base())

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit a batch; False if it was committed before."""
        if self.committed(batch):
            return False
        deltas = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return self._commit(deltas.coalesce(1), f"batch={int(batch)}")

    def totals(self) -> DataFrame:
        """Additive totals over all committed batches."""
        base = self._base()
        gone = self._compacted(base)
        parts = [self.spark.read.schema(DELTAS).parquet(*(f"{self.path}/{n}" for n in names)) for names in ([n for n in self._names("batch") if int(n.split("=")[1]) not in gone],) if names]
        if base is not None:
            parts.append(self.spark.read.schema(f"{DELTAS}, batch long").parquet(f"{self.path}/{base}").filter("batch is null").drop("batch"))
        rows = reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], DELTAS))
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Put the totals in the place of the batches they come from.  Run by one writer, while no one reads; a failure leaves all as it was, or batches that are no longer read."""
        base = self._base()
        batches = {int(n.split("=")[1]) for n in self._names("batch")} | self._compacted(base)
        numbers = self.spark.createDataFrame([(b,) for b in sorted(batches)], "batch long")
        rows = self.totals().unionByName(numbers, allowMissingColumns=True)
        self._commit(rows.coalesce(1), f"base={0 if base is None else int(base.split('=')[1]) + 1}")
        for name in [*self._names("batch"), *([base] if base else [])]:
            if not name.startswith("batch=") or int(name.split("=")[1]) in batches:
                delete(self.spark, f"{self.path}/{name}")


def total_counts(docs: DataFrame, path: str | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """Totals of all documents by source, language and tokenizer version: ``words-1``, ``bytes-1`` and ``bpe-1`` (ids of ``encode_documents``).

    Batch 0 enters every document, ``words-1`` with counts that only split at single
    spaces; batch 1 revises those to the count of runs between white space; batch 2
    deletes documents of under five words from every version, batch 3 enters them again.
    All come twice, the first two are compacted in between.  ``path`` is the ledger's
    folder (default: a new one); batches that it holds are not applied again.
    """
    text, spark = text_of(), docs.sparkSession
    row = F.struct(
        "source", "lang", F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("words"), (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long").alias("spaces"), F.octet_length(text).cast("long").alias("bytes")
    )
    counts = staged(encode_documents(docs.select(row.alias("__row"), "text"), "__row", tokenizer_path=tokenizer_path).select("__row.*", F.col("n_tokens").alias("bpe")), "counts")
    versions = {count: counts.withColumn("tokenizer", F.lit(f"{count}-1")) for count in ("words", "bytes", "bpe")}

    def of_all(change, first: str, only: str = "true") -> DataFrame:
        words, raw, bpe = (change(rows.filter(only), first if count == "words" else count) for count, rows in versions.items())
        return words.unionByName(raw).unionByName(bpe)

    batches = [of_all(inserted, "spaces"), revised(versions["words"], "spaces", "words"), of_all(deleted, "words", "words < 5"), of_all(inserted, "words", "words < 5")]
    ledger = Ledger(spark, path or f"{shared_dir(spark)}/ledgers/{uuid.uuid4().hex}")
    for number in (0, 1):
        ledger.apply(number, batches[number])
    ledger.compact()
    for number, changes in [*enumerate(batches), *enumerate(batches)]:
        ledger.apply(number, changes)
    return ledger.totals()


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Query: totals of all documents by source, language and tokenizer version."""
    return total_counts(table(spark, sf_dir, "documents"))
