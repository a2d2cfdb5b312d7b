"""Exact deduplication against a persistent digest index."""

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import lower_ascii, materialize, partitions, shared_dir


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest)``: SHA-256 of the text with A-Z lower-cased; null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(lower_ascii(F.col(text_col)).cast("binary"), 256).alias("digest"))


class DigestIndex:
    """An index table ``(digest, keep_id)``, bucketed and sorted by digest, at ``path``.

    Each batch is reduced to one row per digest before it meets the index, so a group of copies
    of any size is one row there; the sort-merge anti-join reads the index by bucket, without moving
    it. Batches only add digests: a digest known from an earlier batch keeps its first ``keep_id``.

    The files are the index: where the catalogue doesn't know the table (after a restart, say) it is
    entered again from ``path``, with the number of buckets that is written beside it. A folder with
    other files is refused. Spark commits a batch's files together, so a failed append adds nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or f"{shared_dir(spark)}/digest_index_{uuid.uuid4().hex}").rstrip("/")
        self.name = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        self.buckets = buckets or partitions(spark)
        self.about = f"{self.path}.about"
        if self._is_there(self.about):
            self.buckets = self.spark.read.parquet(self.about).first()["buckets"]
            self._enter()
        elif self._is_there(self.path):
            raise ValueError(f"{self.path} is not a digest index")

    def _is_there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _enter(self) -> None:
        if not self.exists():
            self.spark.sql(
                f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, digests: DataFrame) -> None:
        """Add the digests of ``(doc_id, digest)`` that the index lacks; the largest doc_id stands for each."""
        new = digests.groupBy("digest").agg(F.max("doc_id").cast("long").alias("keep_id"))
        if self.exists():
            known = self.table().select("digest").hint("merge")
            new = materialize(new.join(known, "digest", "left_anti"), "digest-batch")  # a table can't be read and appended to at once
        else:
            self.spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.parquet(self.about)
            self._enter()
        new = new.repartition(self.buckets, "digest")
        new.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def lookup(self, digests: DataFrame) -> DataFrame:
        """Add ``keep_id`` to rows with a digest.

        The index is read without its buckets here: rows are then shuffled on both sides, and
        Spark splits the partition of a digest that very many rows share.
        """
        plain = self.spark.read.schema(self.table().schema).parquet(self.path)
        return digests.join(plain, "digest", "left")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest doc_id
    stays. ``docs`` go to the index in ``batches`` by ranges of doc_id, the largest first, so each
    batch is the new data of the index that the last one left. With an index that already has
    batches, a text known from an earlier call isn't kept and keep_id is the doc_id of that call;
    ``group_size`` counts the rows of ``docs`` with this text.

    Null text counts as empty, empty texts equal each other. Rows that share text and doc_id are
    equal: they count each and ``kept`` is the same for both. A row without a doc_id stays only where no row
    with its text has one; keep_id is null then, and so it stays again in later calls. An empty table gives no rows and
    further columns are ignored, whatever their names.
    """
    index = index or DigestIndex(docs.sparkSession)
    digests = materialize(with_digest(docs, id_col, text_col), "digests")
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        low = high = 0
    step = (int(high) - int(low)) // batches + 1
    for k in reversed(range(batches)):
        index.append(digests.where((F.col("doc_id") >= int(low) + k * step) & (F.col("doc_id") < int(low) + (k + 1) * step)))
    sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
    found = index.lookup(sizes).select("digest", "keep_id", "group_size")
    return digests.join(found, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
