"""Hard negatives by the threshold algorithm over sorted lists of every dimension.

Anchors are compared with all rows in blocks: a task holds about ``ROWS`` rows and at most about ``ANCHORS`` anchors. In a block every dimension has a
list of the rows sorted by their component. For an anchor, each list is read from its largest component down or from its smallest
up, by the sign of the anchor's own component; the rows met are scored in full (random access). The threshold, the score of a row
that would have the last component read in every list, bounds all rows not met yet. Reading stops once it is strictly below the
lowest score that still matters: the k-th best, or the lower end of the window if that is higher.

Two passes: the first finds each anchor's positives (best rows of its own label), the second the best rows of other labels whose
scores lie in the window of each positive. Blocks return at most k rows for each list asked for; the best of all blocks are ranked by
window functions. Vectors and scores are whole numbers: the sums are exact in doubles, in 64 bits or in unbounded integers, as their size requires.

Edge cases: rows without a label, an id or a vector, with an empty vector, or with a null or non-finite component take no part. Vectors are only
compared with those of the same length. Repeated rows are rows of their own: each is a candidate, and an anchor if its id says so.
Equal scores are ordered by id, then by the order of the rows. A component beyond 64 bits is refused. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinescribe.llm.common import batches, stage, with_row

ROWS, ANCHORS = 1 << 13, 1 << 12
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: The window, in hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Places of each list that are read at first; then twice as many each time.
DEPTH = 32

_FOUND = "anchor_row long, slot int, id long, row long, score long"


class Lists:
    """Rows of a block with a sorted list for each dimension."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.vectors, self.ids, self.labels, self.rows = vectors, ids, labels, rows
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)

    def met(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, object]]:
        """Rows met for the first time, their scores, and the threshold: no row that was not met has a higher score."""
        n, dims = self.vectors.shape
        down = anchor > 0
        seen = np.zeros(n, bool)
        depth, step = 0, DEPTH
        while depth < n:
            end = min(n, depth + step)
            up_part, down_part = self.order[depth:end, ~down], self.order[n - end : n - depth, down]
            new = np.zeros(n, bool)
            new[up_part.ravel()] = True
            new[down_part.ravel()] = True
            new &= ~seen
            seen |= new
            found = np.flatnonzero(new)
            last = np.where(down, self.sorted[n - end], self.sorted[end - 1])
            yield found, self.vectors[found] @ anchor, (anchor * last).sum()
            depth, step = end, step * 2


def best_in_window(lists: Lists, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int] | None], most: int) -> list[list[int]]:
    """For each window (hundredfold least and greatest score, or None), the best ``most`` allowed rows: places in the block, best first."""
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, lists.vectors.dtype)) for _ in windows]
    for found, scores, threshold in lists.met(anchor):
        ok = allowed[found]
        found, scores = found[ok], scores[ok]
        open_ = False
        for w, window in enumerate(windows):
            rows, values = found, scores
            if window is not None:
                inside = (scores * 100 >= window[0]) & (scores * 100 <= window[1])
                rows, values = found[inside], scores[inside]
            if len(rows):
                rows, values = np.concatenate([best[w][0], rows]), np.concatenate([best[w][1], values])
                first = np.lexsort((lists.rows[rows], lists.ids[rows], -values))[:most]
                best[w] = rows[first], values[first]
            # Rows not met have at most the threshold.
            full = len(best[w][0]) == most and threshold < best[w][1][-1]
            below = window is not None and threshold * 100 < window[0]
            open_ |= not (full or below)
        if not open_:
            break
    return [rows.tolist() for rows, _ in best]


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(-1, dims)


def _exact(rows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which hundredfold inner products are exact."""
    bound = 100 * rows.shape[1] * int(np.abs(rows.astype(object)).max()) * int(np.abs(anchors.astype(object)).max())
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
    return rows.astype(kind), anchors.astype(kind)


def _searcher(same: bool, most: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function from the rows and the anchors of a task to the best rows: of the anchor's label, or of others within its windows."""

    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor_row": [], "slot": [], "id": [], "row": [], "score": []}
        if len(rows) and len(anchors):
            dims = rows["dims"][0].as_py()
            vectors, asked = _exact(_matrix(rows["vector"], dims), _matrix(anchors["vector"], dims))
            lists = Lists(vectors, rows["id"].to_numpy(), rows["label"].to_numpy(), rows["row"].to_numpy())
            for i, (own, label) in enumerate(zip(anchors["row"].to_pylist(), anchors["label"].to_pylist())):
                if same:
                    allowed, windows = (lists.labels == label) & (lists.rows != own), [None]
                    slots = [0]
                else:
                    allowed = lists.labels != label
                    asked_for = anchors["windows"][i].as_py()
                    slots = [w["slot"] for w in asked_for]
                    windows = [(w["score"] * low, w["score"] * high) for w in asked_for]
                for slot, found in zip(slots, best_in_window(lists, asked[i], allowed, windows, most)):
                    for place in found:
                        out["anchor_row"].append(own)
                        out["slot"].append(slot)
                        out["id"].append(int(lists.ids[place]))
                        out["row"].append(int(lists.rows[place]))
                        out["score"].append(int((lists.vectors[place] * asked[i]).sum()))
        kinds = {"slot": pa.int32()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return search


def _best(rows: DataFrame, anchors: DataFrame, same: bool, most: int, blocks: int, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_row, slot, id, row, score, rank) of the best rows over all blocks."""
    count = anchors.count()
    groups = max(1, -(-count // ANCHORS))
    left = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = anchors.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dims", "block", "group"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_searcher(same, most, low, high), _FOUND)
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "id", "row")
    return stage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most))


def whole_vectors(rows: DataFrame, vec_id: str, label: str, vector: str, scale: int) -> DataFrame:
    """(row, id, label, dims, vector) of the rows that take part, with whole components."""
    parts = F.col(vector).cast("array<double>")
    odd = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    used = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), parts.alias("vector"), odd.alias("odd"))
    used = used.where("id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0 AND NOT odd")
    too_large = F.exists("vector", lambda x: F.abs(x * scale) >= float(1 << 63))
    whole = F.when(too_large, F.raise_error(F.lit("a component does not fit into 64 bits"))).otherwise(F.transform("vector", lambda x: F.floor(x * scale)))
    return stage(with_row(used.select("id", "label", F.size("vector").alias("dims"), whole.cast("array<long>").alias("vector")), "row"))


def mine_hard_negatives(
    rows: DataFrame, anchors: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the column ``id`` (``vec_id`` as a long). A component x becomes floor(``scale`` * x), a score is the inner product with the
    anchor. Positives of an anchor are its ``positives`` best other rows of the same label; for each of them the ``negatives`` best rows of other
    labels follow whose hundredfold score lies between ``low`` and ``high`` times the positive's. ``rank`` counts from 1.
    """
    used = whole_vectors(rows, vec_id, label, vector, scale)
    asked = stage(used.where(anchors))
    blocks = max(1, -(-used.count() // ROWS))
    with batches(rows.sparkSession):
        good = _best(used, asked, True, positives, blocks)
        window = F.struct(F.col("rank").cast("int").alias("slot"), "score")
        windows = good.where("score >= 0").groupBy("anchor_row").agg(F.collect_list(window).alias("windows"))
        asked_again = stage(asked.join(windows.withColumnRenamed("anchor_row", "row"), "row"))
        bad = _best(used, asked_again, False, negatives, blocks, low, high)
    good = good.select("anchor_row", F.col("rank").cast("int").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = bad.join(good, ["anchor_row", "slot"]).join(asked.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
