"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescribe.plans.staging import fresh_folder

__all__ = ["PLACE", "batches", "folded", "id_text", "lazily", "located", "maybe_in", "read", "shuffled", "small_batches", "stage", "with_place", "with_row", "without"]

#: Columns that tell rows apart by where they are stored.
PLACE = ["_kinescribe_file", "_kinescribe_row"]


def stage(df: DataFrame, *parts: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder, in folders by ``parts``, and return what reads it back."""
    spark = df.sparkSession
    path = f"{fresh_folder(spark, 'stages')}/rows"
    df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows per Arrow batch of whole texts; the session's default of 10,000 would hold tens of megabytes several times over.
BATCH_ROWS = 1 << 10


def small_batches(spark: SparkSession) -> None:
    """Have the session send texts to Python in batches of at most ``BATCH_ROWS`` rows; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Bytes of an Arrow batch of texts, for the same reason.
BATCH_BYTES = 8 << 20


@contextmanager
def batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What is run inside sends whole texts to Python in small batches; the session's settings are restored."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {key: spark.conf.get(key, None) for key in limits}
    for key, most in limits.items():
        if before[key] is None or not before[key].isdigit() or not 0 < int(before[key]) <= most:
            spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: Texts of a batch that are Python strings at the same time.
AT_ONCE = 256


def lazily(column: pa.Array) -> Iterator:
    """The values of an Arrow array, a few at a time."""
    for at in range(0, len(column), AT_ONCE):
        yield from column.slice(at, AT_ONCE).to_pylist()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(doc_id: str = "doc_id") -> Column:
    """The id as text; a missing id counts as the empty text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def folded(doc_id: str, folds: int) -> Column:
    """Fold of a row by the CRC of its id, from 0 to ``folds`` - 1."""
    return F.crc32(id_text(doc_id).cast("binary")) % folds


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """A number for every row, different for repeated rows too.

    It follows the place of the row in its partition, so stage the result before it is read more than once.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


#: Size of the filter below; a power of two from 32,768 on. With more keys than that it passes more rows, but no fewer.
BITMAP_BITS = 1 << 24


def maybe_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``keys``: all that are, and few others.

    A filter to be used before a shuffle. It sets a bit per key; what is broadcast are at most BITMAP_BITS / 32768 rows of 4 KB.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))
    bits = keys.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))
    asked = df.withColumn("_bucket", F.bitmap_bucket_number(bit)).withColumn("_at", F.bitmap_bit_position(bit))
    byte = F.conv(F.hex(F.expr("substring(_bits, CAST(_at DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    return asked.join(F.broadcast(bits), "_bucket").where(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1).select(*df.columns)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast; for rows that Spark cannot count beforehand.

    Spark takes an exploded table for no longer than the table before, and what is written for as large as its compressed files. Once it has
    planned a broadcast on such an estimate, adaptive execution keeps it, whatever size it meets.
    """
    return df.hint("merge")


def located(docs: DataFrame) -> DataFrame:
    """``docs`` as a scan of files; anything else is written to the shared folder first."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return stage(docs)
    return docs


def with_place(docs: DataFrame) -> DataFrame:
    """The columns of a scan of files and ``PLACE``: file and number of the row in it, the same in every run."""
    return docs.select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of a scan of files but for the places in ``dropped``."""
    return with_place(docs).join(stage(dropped.select(*PLACE)), PLACE, "left_anti").select(*docs.columns)
