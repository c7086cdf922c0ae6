"""Packing documents into fixed windows by order-preserving dynamic programming.

Each document is its token ids and an end id. In every partition the documents, in their order, form one stream of ids,
which is handled in blocks of about ``BLOCK`` ids. Windows may be cut at the end of a document for nothing, at the end of
a sentence for ``SENTENCE`` and elsewhere for ``INSIDE`` (the truncation penalties); a window of ``length`` ids costs
``limit - length`` for its padding, or nothing if its length is a power of two, as such a window is not padded. With
``cost[j]`` the least cost of the ids before cut place ``p[j]``,

    cost[j] = penalty[j] + min( min over p[j] - p[i] <= limit of cost[i] + limit - (p[j] - p[i]),
                                min over p[j] - p[i] a power of two of cost[i] )

The first minimum is over ``cost[i] + p[i]`` in a sliding window, kept in a monotone queue, so each place enters and
leaves once; the second has at most eleven candidates. Places are the ends of documents and sentences, a place every
``STEP`` ids where sentences are long, and every place in the last ``limit`` ids of a block, which lets the block end
without padding. A document that is longer than the rest of its block goes on in the next block.

The sequence number holds the number of the partition, so tasks need not know of each other, and a task that runs again
gives the same rows. Work and memory of a task are bounded by a block and the ids of its longest document.

Edge cases: a null or blank text is the end id alone. Repeated rows are packed as often as they occur. Every id lies in
exactly one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinescribe.llm.common import lazily, small_batches
from kinescribe.llm.word_ids import REMEMBERED, sentence_ends, word_ids

LIMIT = 2048
END_ID = 1
SENTENCE, INSIDE = 8, 32
#: Ids between two places where no sentence ends.
STEP = 16
#: Ids after which a block is closed at the end of a document, and at the latest.
BLOCK, BLOCK_MOST = 1 << 20, 1 << 21


def best_cuts(places: np.ndarray, penalties: np.ndarray, limit: int = LIMIT) -> list[int]:
    """Numbers of the places at which to cut, first and last included. Neighbouring places lie at most ``limit`` apart."""
    n = len(places)
    powers = 1 << np.arange(limit.bit_length() - 1)
    ends, starts = [], []
    for p in powers:
        at = np.searchsorted(places, places - p)
        good = np.flatnonzero(places[at] == places - p)
        ends.append(good)
        starts.append(at[good])
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(ends, kind="stable")
    first = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    starts = starts[order].tolist()
    p, pen = places.tolist(), penalties.tolist()
    cost, back = [0] * n, [0] * n
    queue, values, head = [0] * n, [0] * n, 0
    tail = 0
    for j in range(1, n):
        value = cost[j - 1] + p[j - 1]
        while tail > head and values[tail - 1] >= value:
            tail -= 1
        queue[tail], values[tail] = j - 1, value
        tail += 1
        least = p[j] - limit
        while p[queue[head]] < least:
            head += 1
        best, come = values[head] - least, queue[head]
        for i in starts[first[j] : first[j + 1]]:
            if cost[i] < best:
                best, come = cost[i], i
        cost[j], back[j] = best + pen[j], come
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def _cut_places(size: int, doc_ends: np.ndarray, text_ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and their penalties in a block of ``size`` ids."""
    known = np.unique(np.concatenate([[0, size], doc_ends, text_ends]))
    gaps = np.diff(known)
    long = np.flatnonzero(gaps > 2 * STEP)
    more = [np.arange(known[i] + STEP, known[i + 1] - STEP // 2, STEP) for i in long.tolist()]
    places = np.unique(np.concatenate([known, *more, np.arange(max(0, size - limit), size)]))
    penalties = np.full(len(places), INSIDE)
    penalties[np.searchsorted(places, text_ends)] = SENTENCE
    penalties[np.searchsorted(places, doc_ends)] = 0
    penalties[[0, -1]] = 0
    return places, penalties


class _Packer:
    """Blocks of one partition, to rows."""

    def __init__(self, ends: np.ndarray, limit: int, first_sequence: int):
        self.ends, self.limit, self.sequence = ends, limit, first_sequence
        self.parts: list[tuple[object, int, int, bytes]] = []
        self.size = 0

    def add(self, doc_id: object, ids: bytes) -> Iterator[list[tuple]]:
        total = len(ids) // 4
        at = 0
        while at < total:
            n = min(total - at, BLOCK_MOST - self.size)
            self.parts.append((doc_id, at, total, ids[at * 4 : (at + n) * 4]))
            self.size += n
            at += n
            if self.size >= (BLOCK if at == total else BLOCK_MOST):
                yield self.close()

    def close(self) -> list[tuple]:
        """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of the block's pieces."""
        data = b"".join(p[3] for p in self.parts)
        ids = np.frombuffer(data, "<u4")
        edges = np.cumsum([0, *(len(p[3]) // 4 for p in self.parts)])
        whole = np.array([p[1] + len(p[3]) // 4 == p[2] for p in self.parts])
        text_ends = np.flatnonzero(self.ends[ids]) + 1
        places, penalties = _cut_places(self.size, edges[1:][whole], text_ends, self.limit)
        cuts = places[best_cuts(places, penalties, self.limit)]
        borders = np.union1d(cuts, edges)
        part = np.searchsorted(edges, borders[:-1], "right") - 1
        window = np.searchsorted(cuts, borders[:-1], "right") - 1
        rows = []
        for a, b, i, w in zip(borders[:-1].tolist(), borders[1:].tolist(), part.tolist(), window.tolist()):
            doc_id, start, total, _ = self.parts[i]
            rows.append((doc_id, start + a - int(edges[i]), b - a, data[a * 4 : b * 4], total, self.sequence + w, a - int(cuts[w])))
        self.sequence += len(cuts) - 1
        self.parts, self.size = [], 0
        return rows


def pack(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, end_id: int = END_ID, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    ``tokenizer`` is the path of a tokenizer file as :class:`kinescribe.llm.word_ids.WordIds` expects it. ``remembered`` bounds the runs whose ids a
    worker remembers: fewer take less memory and more time, the rows are the same.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    small_batches(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([
        T.StructField(doc_id, id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        words.remembered = remembered
        ends = np.zeros(max(words.tokenizer.get_vocab_size(), end_id + 1), bool)
        ends[list(sentence_ends(tokenizer))] = True
        packer = _Packer(ends, limit, TaskContext.get().partitionId() << 40)
        last = end_id.to_bytes(4, "little")
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

        def batch_of(rows: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), [id_kind, *kinds])], schema.names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(lazily(batch.column(0)), lazily(batch.column(1))):
                for rows in packer.add(key, words.ids(text) + last):
                    yield batch_of(rows, kind)
        if packer.size:
            yield batch_of(packer.close(), kind)

    return docs.select(F.col(doc_id), F.col(text).cast("string").alias("_text")).mapInArrow(packed, schema)
