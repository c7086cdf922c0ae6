"""Exact deduplication with keyed streaming state, in DataFrame operations only.

Two texts are equal when they are identical after their ASCII white space is deleted. Every text gets the SHA-256
of what is left. The digests run through a Structured Streaming aggregation whose state lies in RocksDB on the
executors' disks and, as a checkpoint, in the shared folder. It keeps for each digest, without expiry, the number of
rows, the row that stays (most code points, then smallest id) and the locator of its content: file and row number.
Copies are combined before the shuffle, so a group with a third of all rows costs one row per task.

A digest with more than one row is a hit, and hits are compared by their full normalised bytes: the smallest and the
largest text per digest are found with a partial aggregation in each task. Where they differ (a collision of the
digest), the rows are grouped by the bytes themselves. Only texts of hits are moved: a bitmap,
broadcast as a table of fixed size, drops nearly all other rows before the shuffle.

Edge cases: a null text counts as empty. Rows are told apart by their locator, so repeated rows are copies of each
other. Of rows with equal length and equal id, the first by locator stays; a null id comes last. Other columns of the
input, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinescribe.llm.common import PLACE, located, maybe_in, stage, with_place, without
from kinescribe.plans.staging import fresh_folder

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "80",
    # Else every partition of the state takes several MB of disk beforehand.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return; null as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in (" ", "\t", "\n", "\x0b", "\x0c", "\r"):
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digest_state(marked: DataFrame, folder: str) -> DataFrame:
    """Streaming step: (digest, group_size, keep) for all digests in the state once it has seen the files of ``marked``.

    ``folder`` holds the state: a later call with the same folder and a table that has got more files goes on from it.
    """
    spark = marked.sparkSession
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    table = marked.inputFiles()[0].rsplit("/", 1)[0]
    base = fresh_folder(spark, "streams")
    done: list[str] = []

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/{batch_id}")
        done.append(f"{base}/{batch_id}")

    try:
        rows = spark.readStream.schema(marked.schema).parquet(table)
        rank = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", *PLACE)
        state = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("keep"))
        writer = state.writeStream.outputMode("complete").option("checkpointLocation", folder).trigger(availableNow=True)
        writer.foreachBatch(publish).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(done[-1])


def _collisions(docs: DataFrame, hits: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests among ``hits`` that stand for several different texts."""
    texts = docs.select(F.col("norm"), digest(F.col("norm")).alias("digest"))
    # An inner join (a digest is in hits once): a semi join would be pushed below the filter.
    met = maybe_in(texts, hits, "digest").join(hits, "digest")
    ends = met.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    return ends.where("low <> high").select("digest")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, and its locator (``PLACE``)."""
    docs = located(docs)
    spark = docs.sparkSession
    rows = with_place(docs).select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *PLACE)
    rows = rows.withColumn("norm", normalised(F.col("text")))
    facts = [F.length("text").cast("long").alias("n_chars"), sha256(F.col("norm")).alias("text_sha256")]
    marked = stage(rows.select("doc_id", *PLACE, *facts, digest(F.col("norm")).alias("digest")))
    state = digest_state(marked, f"{fresh_folder(spark, 'streams')}/state")
    hits = state.where("group_size > 1").select("digest")
    collided = stage(_collisions(rows, hits, digest))

    result = marked.join(state, "digest")
    if not collided.isEmpty():
        rank = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", *PLACE)
        mixed = rows.select("doc_id", *PLACE, *facts, "norm", digest(F.col("norm")).alias("digest")).join(collided, "digest", "left_semi")
        groups = mixed.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("keep"))
        split = mixed.join(groups, "norm").select(*result.columns)
        result = result.join(collided, "digest", "left_anti").select(*split.columns).union(split)
    kept = (F.col(PLACE[0]) == F.col("keep")[PLACE[0]]) & (F.col(PLACE[1]) == F.col("keep")[PLACE[1]])
    return result.select(F.col("doc_id").alias(doc_id), F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", *PLACE)


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    docs = located(docs)
    return without(docs, deduplicate(docs, doc_id, text).where("NOT kept"))
