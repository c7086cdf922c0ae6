from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
import plain
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinescribe.llm import packing, queries, sharding, token_counts, word_ids

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, size long, shard string, ids binary, start long"
#: Texts on which a splitter or a fold could go wrong; odd characters are given by number.
NBSP, LINE, WIDE, ZERO = (chr(c) for c in (0xA0, 0x2028, 0x3000, 0x200B))
HARD = [
    None, "", "  ", "\n\n a\t\tb \r\n", f"a{NBSP}  b", f"a  {NBSP}b {LINE} {WIDE} c{ZERO} d", "x <|endoftext|> y<|endoftext|>", "<|endoftext|", "<<|ENDOFTEXT|>> <|startoftext|>.",
    "it's 'tis '' 'S ''re don't we'll I'VE", "3.14, 2,5. v1.2.3. (a.) b). c.. d,. E.", "\x1c\x1d a \x1f", "\x00a\x00 b", "".join(map(chr, (0xE9, 0x65, 0x301, 0xFB00, 0x2167))),
    "".join(map(chr, (0x391, 0x3A3, 0x20, 0x3A3, 0x391, 0x3A3, 0x20, 0x130))), "".join(map(chr, (0x65E5, 0x672C, 0x3002, 0x1F642, 0x1F642))), "_a_b -- x", "a" * 3000, "word. " * 5000, "x" * 40 + " " + "y " * 9000,
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", b"", 2) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()


def test_token_counts_are_the_librarys(spark, table):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in queries.QUERIES["op1_token_counts"](spark, SF).collect()}
    assert len(got) == len(table)
    for d, text in zip(table.doc_id, table.text):
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len((text or "").encode()), n, n > 512)


def test_token_counts_of_hard_texts(spark, monkeypatch):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*enumerate(HARD), (0, None), (None, "a b")]
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs(spark, rows)).collect() if r.doc_id is not None)
    want = [(i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows if i is not None]
    assert got == sorted(want)
    assert token_counts.count_tokens(docs(spark, [])).count() == 0


def test_splitter_gives_whole_texts():
    splitter = token_counts.Splitter(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in filter(None, HARD):
        if "<|" in text:
            continue
        want = {}
        for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text):
            want[text[a:b]] = want.get(text[a:b], 0) + 1
        got = {}
        for chunk, n in splitter.chunks(text).items():
            for t in splitter.of_chunk(chunk):
                got[t] = got.get(t, 0) + n
        assert got == want, text


def _check_packing(rows, ids_of, limit):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and len(r.ids) == 4 * r.length and r.doc_tokens == len(ids_of[d])
            assert np.frombuffer(r.ids, "<u4").tolist() == ids_of[d][at : at + r.length]
            at += r.length
        assert at == len(ids_of[d])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= limit
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding


def test_packing_keeps_every_id(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids_of = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(HARD)}
    rows = packing.pack(docs(spark, enumerate(HARD)).coalesce(1)).collect()
    padding = _check_packing(rows, ids_of, 2048)
    assert len({r.doc_id for r in rows}) == len(HARD)
    assert padding <= 0.02 * sum(map(len, ids_of.values()))
    assert packing.pack(docs(spark, [])).count() == 0
    twice = packing.pack(docs(spark, [(1, "a"), (1, "a"), (None, "b")])).collect()
    assert sorted((r.doc_id or 0, r.length) for r in twice) == [(0, 2), (1, 2), (1, 2)]


def test_packing_in_small_blocks(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 300)
    monkeypatch.setattr(packing, "BLOCK_MOST", 500)
    rng = np.random.default_rng(3)
    ends = np.zeros(50, bool)
    ends[7] = True
    packer, ids_of, rows = packing._Packer(ends, 64, 10), {}, []
    for d in range(40):
        ids_of[d] = rng.integers(2, 50, rng.choice([1, 5, 60, 700])).tolist()
        for out in packer.add(d, np.array(ids_of[d], "<u4").tobytes()):
            rows += out
    rows += packer.close() if packer.size else []
    from collections import namedtuple

    row = namedtuple("Row", "doc_id start length ids doc_tokens sequence_id offset")
    padding = _check_packing([row(*r) for r in rows], ids_of, 64)
    assert padding < 0.1 * sum(map(len, ids_of.values()))


@pytest.mark.parametrize("seed", range(6))
def test_cuts_have_the_least_cost(seed):
    rng = np.random.default_rng(seed)
    places = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 20, 150))]))
    penalties = rng.choice([0, 3, 9], len(places))
    penalties[[0, -1]] = 0
    cuts = packing.best_cuts(places, penalties, 64)
    sizes = np.diff(places[cuts])
    assert sizes.max() <= 64
    cost = np.where(sizes & (sizes - 1) == 0, 0, 64 - sizes).sum() + penalties[cuts[1:]].sum()
    assert cost == plain.least_cost(places.tolist(), penalties.tolist(), 64)


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(word_ids, "REMEMBERED", 8)
    path = public_tokenizers.path("word_bpe_49k.json")
    words = word_ids.WordIds(path)
    text = " ".join(f"word{i}. and, more" for i in range(20))
    want = words.tokenizer.encode(text, add_special_tokens=False).ids
    for _ in range(3):
        assert np.frombuffer(words.ids(text), "<u4").tolist() == want
        assert np.frombuffer(words.ids("and, other words."), "<u4").tolist() == words.tokenizer.encode("and, other words.", add_special_tokens=False).ids


def test_a_worker_of_the_pipeline_remembers_fewer_runs(monkeypatch):
    asked = {}
    monkeypatch.setattr(packing, "pack", lambda docs, **more: asked.update(more))
    corpus_pipeline.pack_windows(None, None, SF)
    most = asked["remembered"]
    assert most <= word_ids.REMEMBERED // 8
    path = public_tokenizers.path("word_bpe_49k.json")
    words, free = word_ids.WordIds(path), word_ids.WordIds(path)
    words.remembered = most
    for i in range(20):
        text = " ".join(f"{i}x{j}" for j in range(most // 8)) + " and more."
        assert words.ids(text) == free.ids(text)
        assert len(words.cache) <= most
    assert len(free.cache) > most


def _check_shards(rows, texts, shards=8):
    assert len(rows) == len(texts)
    slots, load = {}, [0] * shards
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def test_shards_are_of_equal_bytes(spark, table):
    rows = queries.QUERIES["op5_sharding"](spark, SF).collect()
    texts = dict(zip(table.doc_id, table.text))
    load = _check_shards(rows, texts)
    assert max(load) - min(load) <= max(r["size"] for r in rows)
    of = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        of.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in of.values())


def test_shards_of_a_hot_text(spark):
    # A third of the bytes is one text, so it has to be divided; the rest fills up.
    rows = [(i, "hot " * 30 if i % 3 == 0 else f"text {i} " * 14) for i in range(6000)] + [(None, None), (1, ""), (1, "")]
    out = sharding.shard_documents(docs(spark, rows), carry=["text"])
    load = _check_shards(out.collect(), rows)
    assert max(load) < 1.02 * min(load)
    assert all((r.text or "") == "" or r["size"] == len(r.text) + 1 for r in out.collect())
    assert sharding.shard_documents(docs(spark, [])).count() == 0
    assert len(sharding.shard_documents(docs(spark, [(1, "a")])).collect()) == 1


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "DRAWS", 0.05)
    monkeypatch.setattr(sharding, "FINE", 16)
    rows = [(i, f"text {i} " * (1 + i % 5)) for i in range(4000)]
    load = _check_shards(sharding.shard_documents(docs(spark, rows)).collect(), rows)
    assert max(load) < 1.2 * min(load)


def test_shards_are_written_in_order(spark, tmp_path):
    out = sharding.shard_documents(docs(spark, [(i, "t" * i) for i in range(50)]), 3, carry=["text"])
    sharding.write_shards(out, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(50)) and {r.shard for r in back.collect()} == {0, 1, 2}
