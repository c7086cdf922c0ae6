"""Ordered computations that never put a whole key into one task.

A window over ``(session, hand)`` runs each key in one task. One recording may hold a large share of all
rows, so the operators of this package cut every key into chunks of consecutive positions and window over
``(session, hand, chunk)`` instead. Three exact building blocks cover all of them:

* :func:`in_chunks` - computations that look a bounded number of rows around (lag, lead, rolling windows):
  each chunk also receives copies of its neighbours' edge rows, which are dropped afterwards;
* :func:`with_totals` - values that depend on everything before (or anywhere in) the key: one summary row
  per chunk is windowed over the key and joined back on ``(key, chunk)``;
* :func:`islands` - gaps-and-islands: runs are aggregated inside their chunk first, and only the at most
  two pieces per chunk that may continue across a border are put together per key.

All joins here are on ``(key, chunk)``, so their size per task is bounded by the chunk length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions per chunk: at 30 frames a second about 36 minutes of one hand.
CHUNK_ROWS = 65_536

CHUNK = "_chunk"
_HOME = "_home"


def chunk_of(position: str | Column, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a dense, zero-based position."""
    col = F.col(position) if isinstance(position, str) else position
    return F.floor(col / F.lit(rows)).cast("bigint")


def ordered(keys: Sequence[str], *order: str | Column):
    """Window over ``keys`` ordered by ``order``."""
    return Window.partitionBy(*keys).orderBy(*order)


def in_chunks(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    compute: Callable[[DataFrame, list[str]], DataFrame],
    before: int,
    after: int,
    rows: int = CHUNK_ROWS,
    keep_chunk: bool = False,
) -> DataFrame:
    """Run ``compute(df, by)`` per chunk, with ``before``/``after`` extra positions around each chunk.

    ``position`` must be dense within ``keys``. ``compute`` must not look further than the given reach; the
    copied rows are removed from its result. One shuffle, on ``(*keys, chunk)``.
    """
    if max(before, after) > rows:
        raise ValueError("the reach must not exceed the chunk length")
    home = chunk_of(position, rows)
    offset = F.pmod(F.col(position), F.lit(rows))
    spread = F.array_compact(
        F.array(
            F.when((offset < after) & (home > 0), home - 1),
            home,
            F.when(offset >= rows - before, home + 1),
        )
    )
    copied = df.withColumn(_HOME, home).withColumn(CHUNK, F.explode(spread))
    done = compute(copied, [*keys, CHUNK]).where(F.col(CHUNK) == F.col(_HOME)).drop(_HOME)
    return done if keep_chunk else done.drop(CHUNK)



def with_totals(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    per_chunk: dict[str, Column],
    across: Callable[[object, object, object], dict[str, Column]],
) -> DataFrame:
    """Attach key-level values computed from one summary row per ``(key, chunk)``.

    ``per_chunk`` are the aggregates of the summary; ``across(earlier, upto, whole)`` receives three windows
    over the summary rows of a key (all earlier chunks / up to this one / the whole key) and returns the
    columns to attach.
    """
    by_chunk = df.groupBy(*keys, chunk).agg(*[c.alias(n) for n, c in per_chunk.items()])
    over = Window.partitionBy(*keys).orderBy(chunk)
    windows = (
        over.rowsBetween(Window.unboundedPreceding, -1),
        over.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing),
    )
    on = [*keys, chunk]
    names = {c: f"_of_{c}" for c in on}
    totals = by_chunk.select(*[F.col(c).alias(n) for c, n in names.items()], *[c.alias(n) for n, c in across(*windows).items()])
    if all(c in _NEVER_NULL for c in on):
        same = [F.col(c) == F.col(n) for c, n in names.items()]
    else:
        same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return df.join(totals, same).drop(*names.values())


#: Columns of a prefix computation that are never NULL: the keys as one struct, and the bucket with NULL as the first one.
_KEY, _BUCKET = "_key", "_bucket"
_NEVER_NULL = (_KEY, _BUCKET)


def _placed(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Adds key struct and bucket. Windows, sums and the join all work on these two, with one shuffle; NULL keys are keys."""
    first = F.lit(-(1 << 62)).cast("bigint")
    return df.withColumns({_KEY: F.struct(*keys), _BUCKET: F.coalesce(bucket.cast("bigint"), first)})


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    out: str,
    count_out: str | None = None,
) -> DataFrame:
    """Zero-based rank of each row within ``keys``, ordered by ``order``.

    ``bucket`` must not decrease along ``order`` and should hold a bounded number of rows of one key (a
    minute of events, a block of ids, a chunk of frames). Ranks inside a bucket are shifted by the number
    of rows in earlier buckets. ``count_out`` names an optional column with the key's row count.
    """
    work = _placed(df, keys, bucket)

    def across(earlier, _upto, whole):
        cols = {"_shift": F.coalesce(F.sum("_rows").over(earlier), F.lit(0))}
        if count_out:
            cols[count_out] = F.sum("_rows").over(whole)
        return cols

    rank = F.row_number().over(ordered([_KEY, _BUCKET], *order)) - 1
    out_df = with_totals(work, [_KEY], _BUCKET, {"_rows": F.count(F.lit(1))}, across)
    return out_df.withColumn(out, (rank + F.col("_shift")).cast("bigint")).drop(_KEY, _BUCKET, "_shift")


def running_sum(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: Column, out: str
) -> DataFrame:
    """Sum of ``value`` over all *earlier* rows of the key (exclusive prefix sum)."""
    work = _placed(df, keys, bucket).withColumn("_value", value)
    inside = ordered([_KEY, _BUCKET], *order).rowsBetween(Window.unboundedPreceding, -1)
    out_df = with_totals(
        work, [_KEY], _BUCKET, {"_part": F.sum("_value")},
        lambda earlier, _u, _w: {"_shift": F.coalesce(F.sum("_part").over(earlier), F.lit(0))},
    )
    total = F.coalesce(F.sum("_value").over(inside), F.lit(0)) + F.col("_shift")
    return out_df.withColumn(out, total).drop(_KEY, _BUCKET, "_value", "_shift", "_part")


@dataclass(frozen=True)
class Part:
    """A mergeable aggregate of an island: ``kind`` is sum, min, max, first or last (by position)."""

    kind: str
    value: Column

    def local(self, position: str) -> Column:
        match self.kind:
            case "sum":
                return F.sum(self.value)
            case "min":
                return F.min(self.value)
            case "max":
                return F.max(self.value)
            case "first":
                return F.min_by(self.value, F.col(position))
            case "last":
                return F.max_by(self.value, F.col(position))
        raise ValueError(f"unknown aggregate kind {self.kind!r}")

    def merged(self, name: str) -> Column:
        match self.kind:
            case "first":
                return F.min_by(name, "_from")
            case "last":
                return F.max_by(name, "_from")
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](name)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    opens: str,
    parts: dict[str, Part],
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Aggregate runs of rows. ``df`` holds member rows only; ``opens`` is true on the first row of a run.

    ``position`` orders the rows of a key (it need not be dense). Returns one row per run: ``keys`` and
    ``parts``.
    """
    by = [*keys, CHUNK]
    work = df.withColumn(CHUNK, chunk_of(position, rows))
    work = work.withColumn("_run", F.sum(F.col(opens).cast("bigint")).over(ordered(by, position)))
    pieces = work.groupBy(*by, "_run").agg(
        F.min(position).alias("_from"), *[p.local(position).alias(n) for n, p in parts.items()]
    )
    # A piece can only continue elsewhere if it is the first of its chunk without an opening row, or the
    # last of its chunk. Those (at most two per chunk) go to one group per key; all others are complete.
    last_run = F.max("_run").over(Window.partitionBy(*by))
    pieces = pieces.withColumn("_edge", (F.col("_run") == 0) | (F.col("_run") == last_run))
    group = [*keys, "_group"]
    pieces = pieces.withColumn("_group", F.when(F.col("_edge"), F.lit(-1)).otherwise(F.col(CHUNK)))
    pieces = pieces.withColumn("_id", F.sum((F.col("_run") > 0).cast("bigint")).over(ordered(group, "_from")))
    return pieces.groupBy(*group, "_id").agg(*[p.merged(n).alias(n) for n, p in parts.items()]).drop("_group", "_id")


def small_list(df: DataFrame, item: Column, limit: int = 10_000) -> Column:
    """All rows of a *parameter* table (categories, topics, prototypes) as one array literal.

    Spark evaluates it once as a scalar subquery. The size is checked: more than ``limit`` rows is an error
    rather than an oversized literal, because such a table is not a parameter table.
    """
    too_many = F.raise_error(F.lit(f"more than {limit} rows in a parameter table")).cast("boolean")
    checked = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
    return checked.select(F.when(F.col("n") <= limit, F.col("items")).when(too_many, None).alias("items")).scalar()
