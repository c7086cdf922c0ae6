"""Token counts of byte-level BPE, by distinct pre-tokens.

A pre-token is what the tokenizer's own splitter makes of a text; the number of its pieces does not depend on the text
around it. So texts are only split and counted: documents are taken in blocks of neighbours, a block has a vocabulary of
its distinct pre-tokens, and each document keeps its frequencies by place in that vocabulary. The vocabularies, not the
texts, are shuffled by pre-token (in buckets by hash), the tokenizer runs once per distinct pre-token there, and the
numbers of pieces are joined with the frequencies of their block and summed. Ids of texts are never made.

A pre-token that is in every text travels once per block, so hot words are combined before the shuffle. Blocks have at
most ``BLOCK_DOCS`` documents and about ``BLOCK_CHARS`` characters (a longer document is a block of its own), which bounds
groups and tasks.

Edge cases: a null text counts as empty and has 0 tokens. Added tokens of the tokenizer, such as ``<|endoftext|>``, are one
token each where their strings occur. Rows keep their number, so repeated rows and missing ids are no matter.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinescribe.llm.common import stage

BLOCK_DOCS = 1 << 14
BLOCK_CHARS = 1 << 25
#: Parts of a vocabulary; each is in one task when pieces are counted.
BUCKETS = 4096
#: Batches of new pre-tokens for the tokenizer.
BATCH = 1 << 13

#: Where no other white space is in a text, splitting there never divides a pre-token.
_CHUNK = re.compile(r" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")
#: White space beyond ASCII's and what some libraries count as such.
_OTHER = (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)
_OTHER_BLANK = re.compile("[" + "".join(map(chr, _OTHER)) + "]")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Splitter:
    """Pre-tokens of texts, for a tokenizer without a normaliser and with a byte-level splitter."""

    def __init__(self, path: str):
        tokenizer = _tokenizer(path)
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def of_chunk(self, chunk: str) -> list[str]:
        """Pre-tokens of a string without added tokens."""
        bare = chunk[1:] if chunk[0] == " " else chunk
        if bare.isascii() and bare.isalpha():
            return [chunk]
        return [chunk[a:b] for _, (a, b) in self.split(chunk)]

    def chunks(self, text: str) -> Counter:
        """Strings whose pre-tokens together are those of the text. Added tokens are chunks of their own."""
        parts = self.added.split(text) if self.added else [text]
        out: Counter = Counter()
        for part in parts[0::2]:
            out.update([part] if _OTHER_BLANK.search(part) else _CHUNK.findall(part))
        out.update(parts[1::2])
        out.pop("", None)
        return out


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes of 32-bit numbers, all lowest ones first: small numbers leave long runs of zeros."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Block:
    def __init__(self, splitter: Splitter, number: int):
        self.splitter, self.number = splitter, number
        self.vocabulary: dict[str, int] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.docs: list[tuple[object, int]] = []
        self.places: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: object, text: str) -> None:
        found: dict[int, int] = {}
        known, vocabulary = self.known, self.vocabulary
        for chunk, n in self.splitter.chunks(text).items():
            places = known.get(chunk)
            if places is None:
                is_added = self.splitter.added is not None and self.splitter.added.fullmatch(chunk)
                tokens = [chunk] if is_added else self.splitter.of_chunk(chunk)
                places = known[chunk] = tuple(vocabulary.setdefault(t, len(vocabulary)) for t in tokens)
            for p in places:
                found[p] = found.get(p, 0) + n
        self.docs.append((doc_id, len(text.encode())))
        self.places.append(np.fromiter(found, np.int64, len(found)))
        self.counts.append(np.fromiter(found.values(), np.int64, len(found)))
        self.chars += len(text)

    def rows(self) -> Iterator[dict]:
        words = list(self.vocabulary)
        bucket = np.fromiter((crc32(w.encode()) % BUCKETS for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=BUCKETS))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            part = [words[i] for i in order[a:b].tolist()]
            yield {"kind": "words", "block": self.number, "bucket": int(bucket[order[a]]), "joined": "".join(part), "lengths": _planes(np.fromiter(map(len, part), np.int64, len(part)))}
        for i, (doc_id, n_bytes) in enumerate(self.docs):
            places = rank[self.places[i]]
            by_place = np.argsort(places)
            yield {"kind": "docs", "block": self.number, "doc_id": doc_id, "n_bytes": n_bytes, "places": _planes(np.diff(places[by_place], prepend=0)), "counts": _planes(self.counts[i][by_place])}


def _frequencies(path: str, id_kind: pa.DataType):
    schema = pa.schema([
        ("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("joined", pa.string()), ("lengths", pa.binary()),
        ("doc_id", id_kind), ("n_bytes", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, number = Splitter(path), TaskContext.get().partitionId() << 32
        block = _Block(splitter, number)

        def written() -> Iterator[pa.RecordBatch]:
            rows: list[dict] = []
            for row in block.rows():
                rows.append(row)
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block.docs and (len(block.docs) >= BLOCK_DOCS or block.chars + len(text or "") > BLOCK_CHARS):
                    yield from written()
                    number += 1
                    block = _Block(splitter, number)
                block.add(doc_id, text or "")
        if block.docs:
            yield from written()

    return run


def _pieces(path: str):
    """Words of a bucket in each block to their numbers of pieces; equal words of one bucket are all in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for joined, lengths in zip(batch.column("joined").to_pylist(), batch.column("lengths").to_pylist()):
                ends = np.cumsum(_numbers(lengths)).tolist()
                words = [joined[a:b] for a, b in zip([0, *ends], ends)]
                new = [w for w in words if w not in known]
                for at in range(0, len(new), BATCH):
                    part = new[at : at + BATCH]
                    known.update(zip(part, (len(e) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False))))
                out.append(_planes(np.fromiter((known[w] for w in words), np.int64, len(words))))
            yield pa.record_batch([batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "pieces"])

    return run


def _summed(docs: pa.Table, words: pa.Table) -> pa.Table:
    """Token counts of one block's documents."""
    order = np.argsort(words.column("bucket").to_numpy())
    pieces = words.column("pieces").to_pylist()
    pieces = np.concatenate([np.zeros(0, np.int64), *(_numbers(pieces[i]) for i in order.tolist())])
    totals = [int((pieces[np.cumsum(_numbers(p))] * _numbers(n)).sum()) for p, n in zip(docs.column("places").to_pylist(), docs.column("counts").to_pylist())]
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(totals, pa.int64())})


def count_tokens(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens``.

    ``tokenizer`` is the path of a byte-level BPE file for the library ``tokenizers``.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    id_type = docs.schema[doc_id].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("joined", T.StringType()),
        T.StructField("lengths", T.BinaryType()), T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("counts", T.BinaryType()),
    ])
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = stage(texts.mapInArrow(_frequencies(tokenizer, to_arrow_type(id_type)), schema), "kind")
    words = rows.where("kind = 'words'").select("block", "bucket", "joined", "lengths").repartition("bucket")
    pieces = words.mapInArrow(_pieces(tokenizer), "block long, bucket int, pieces binary")
    out = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    found = rows.where("kind = 'docs'").select("block", "doc_id", "n_bytes", "places", "counts")
    counted = found.groupBy("block").cogroup(pieces.groupBy("block")).applyInArrow(_summed, out)
    return counted.withColumnRenamed("doc_id", doc_id)
