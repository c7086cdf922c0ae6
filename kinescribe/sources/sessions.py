"""Saved sessions: one Parquet dataset per table below a common root, in versions that are only added.

Every save writes its own rows into new folders, then a manifest that lists the sessions it holds of each table. The manifest is moved into
place in one step, so readers see a save of several tables as a whole or not at all, and a save that broke off leaves nothing to see. A
session's rows are those of the newest version that lists it. ``compact`` writes the live rows of many saves as one version; older
versions then hold nothing that is read, and ``vacuum`` deletes them.

Inside a version rows lie in folders by a hash of the session id and are sorted by session, so that the statistics of files and row groups tell
sessions apart, however many there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from kinescribe.schemas import SESSION_TABLES

#: Folders per table; part of the layout of a store.
BUCKETS = 64
#: Positions per output task: a long session is written by several tasks, a short one by one.
WRITE_BLOCK = 1_000_000
_POSITION = {"hand_frames": "frame_idx", "body_frames": "frame_idx", "gestures": "frame_idx", "trace": "frame_idx", "transcript": "seg_idx"}


#: Column of the folders of versions; no table has one of that name.
_PLACE = "store_version"
_LISTED = "table string, version string, session_id string"


class EmptySessionError(ValueError):
    """Neither landmarks nor a transcript to save."""


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; missing ones are NULL."""
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SESSION_TABLES[table]]
    )


def write_session(tables: Mapping[str, DataFrame], root: str) -> None:
    """Save the given tables; sessions saved before are replaced, others stay.

    Refused if both the hand frames and the transcript are missing or empty.
    """
    kept = [tables.get(t) for t in ("hand_frames", "transcript")]
    if all(df is None or df.isEmpty() for df in kept):
        raise EmptySessionError("nothing to save: no landmarks and no transcript")
    spark = next(iter(tables.values())).sparkSession
    _commit(spark, root, {name: conform(df, name) for name, df in tables.items()}, _next_version(spark, root))


def _commit(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], version: str) -> None:
    """Write the rows of all tables as ``version``, then make them visible."""
    listed = None
    for name, df in tables.items():
        place = [F.floor(F.col(_POSITION[name]) / WRITE_BLOCK)] if name in _POSITION else []
        order = [_POSITION[name]] if name in _POSITION else []
        out = df.withColumn("bucket", _bucket(F.col("session_id")))
        out = out.repartition("bucket", *place).sortWithinPartitions("bucket", "session_id", *order)
        path = f"{root}/{name}/{_PLACE}={version}"
        out.write.partitionBy("bucket").parquet(path)
        # What was written counts, not what a second evaluation of the input would give.
        saved = spark.read.schema(_with_bucket(SESSION_TABLES[name])).parquet(path).select("session_id").distinct()
        saved = saved.select(F.lit(name).alias("table"), F.lit(version).alias("version"), "session_id")
        listed = saved if listed is None else listed.union(saved)
    listed.write.parquet(f"{root}/manifest_new/{version}")
    files, place = _files(spark, f"{root}/manifest")
    files.mkdirs(place)
    if not files.rename(_path(spark, f"{root}/manifest_new/{version}"), _path(spark, f"{root}/manifest/{version}")):
        raise OSError(f"version {version} could not be committed")


def _bucket(session_id: Column) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(BUCKETS)).cast("int")


def _with_bucket(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("bucket", IntegerType())])


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    target = _path(spark, path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    files, target = _files(spark, path)
    return files.exists(target)


def versions(spark: SparkSession, root: str) -> list[str]:
    """Committed versions, oldest first."""
    files, target = _files(spark, f"{root}/manifest")
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


def _next_version(spark: SparkSession, root: str) -> str:
    """Later than all committed ones; two writers at the same time get different names, and the order of the names decides."""
    known = versions(spark, root)
    return f"{int(known[-1].split('-')[0]) + 1 if known else 1:012d}-{uuid.uuid4().hex[:12]}"


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    """(table, version, session_id) of all committed saves."""
    known = versions(spark, root)
    if not known:
        return spark.createDataFrame([], _LISTED)
    return spark.read.schema(_LISTED).parquet(*[f"{root}/manifest/{v}" for v in known])


def _replaced(manifest: DataFrame) -> DataFrame:
    """Entries of a manifest of which a newer version exists."""
    newest = manifest.groupBy(F.col("table").alias("_table"), F.col("session_id").alias("_session")).agg(F.max("version").alias("newest"))
    same = (F.col("table") == F.col("_table")) & F.col("session_id").eqNullSafe(F.col("_session"))
    return manifest.join(newest, same).where("version < newest").select(*manifest.columns)


def _live(manifest: DataFrame) -> dict[str, list[str]]:
    """Versions that hold a session of each table that is still read: at most one entry for each save."""
    rows = manifest.groupBy("table", "session_id").agg(F.max("version").alias("version")).select("table", "version").distinct().collect()
    out: dict[str, list[str]] = {}
    for row in rows:
        out.setdefault(row.table, []).append(row.version)
    return {name: sorted(found) for name, found in out.items()}


def read_sessions(spark: SparkSession, root: str, ids: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All tables of the given sessions (of all, if none are given), with defaults for missing values.

    Only versions that hold something of them are read; the selection prunes folders. A table that was never written is empty; a missing
    root is an error.
    """
    if not _exists(spark, root):
        raise FileNotFoundError(root)
    manifest = _manifest(spark, root)
    if ids is not None:
        manifest = manifest.where(F.col("session_id").isin(list(ids)))
    live, replaced = _live(manifest), _replaced(manifest)
    out = {}
    for name, schema in SESSION_TABLES.items():
        if name not in live:
            out[name] = spark.createDataFrame([], schema)
            continue
        paths = [f"{root}/{name}/{_PLACE}={v}" for v in live[name]]
        df = spark.read.schema(_stored(schema)).option("basePath", f"{root}/{name}").parquet(*paths)
        if ids is not None:
            df = df.where(F.col("session_id").isin(list(ids)) & F.col("bucket").isin(*[_bucket(F.lit(i)) for i in ids]))
        if len(paths) > 1:
            # Few sessions are saved twice, so the rows themselves are not shuffled for this.
            gone = replaced.where((F.col("table") == name) & F.col("version").isin(live[name])).select("version", "session_id")
            same = df["session_id"].eqNullSafe(gone["session_id"]) & (df[_PLACE] == gone["version"])
            df = df.join(gone, same, "left_anti")
        out[name] = conform(df, name)
    out["sessions"] = with_defaults(out["sessions"])
    return out


def _stored(schema: StructType) -> StructType:
    return StructType([*_with_bucket(schema).fields, StructField(_PLACE, StringType())])


def compact(spark: SparkSession, root: str) -> None:
    """Write the live rows as one version. Saves that are committed meanwhile are newer than it and stay."""
    known = versions(spark, root)
    if len(known) < 2:
        return
    saved = read_sessions(spark, root)
    live = _live(_manifest(spark, root))
    # The name sorts behind the versions it replaces and before any save that comes after them.
    _commit(spark, root, {name: conform(df, name) for name, df in saved.items() if name in live}, f"{known[-1]}-compact")


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete versions that nothing is read from any more, saves that broke off among them; not while somebody saves or reads."""
    live = _live(_manifest(spark, root))
    kept, gone = {v for found in live.values() for v in found}, set()
    for folder in [*(f"{root}/{name}" for name in SESSION_TABLES), f"{root}/manifest_new", f"{root}/manifest"]:
        files, target = _files(spark, folder)
        for entry in files.listStatus(target) if files.exists(target) else []:
            version = entry.getPath().getName().removeprefix(f"{_PLACE}=")
            # Rows first, so a manifest never outlives what it lists.
            if version not in (kept if folder.endswith("manifest") else set(live.get(folder.rsplit("/", 1)[1], []))):
                files.delete(entry.getPath(), True)
                gone.add(version)
    return sorted(gone)


def with_defaults(sessions: DataFrame) -> DataFrame:
    """640 x 480 at 30 frames a second where not stored."""
    defaults = {"width": 640, "height": 480, "fps": 30.0, "total_frames": 0}
    return sessions.withColumns({c: F.coalesce(c, F.lit(v).cast(sessions.schema[c].dataType)) for c, v in defaults.items()})


def upgrade_bodies(persons: DataFrame, single: DataFrame) -> DataFrame:
    """Per-person table completed from an older single-person one: frames without a person list get person 0."""
    keys = ["session_id", "frame_idx", "part"]
    old = single.join(persons.select(*keys).distinct(), keys, "left_anti").withColumn("person_no", F.lit(0))
    return persons.unionByName(old, allowMissingColumns=True)


def upgrade_has_hands(sessions: DataFrame, hand_frames: DataFrame) -> DataFrame:
    """``has_hands`` where it is missing: whether the session has any hand frame."""
    seen = hand_frames.select("session_id").distinct().withColumn("_seen", F.lit(True))
    joined = sessions.join(seen, "session_id", "left")
    return joined.withColumn("has_hands", F.coalesce("has_hands", "_seen", F.lit(False))).drop("_seen")


def union_sessions(*tables: DataFrame) -> DataFrame:
    """Rows of several sources under one schema."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out
