from __future__ import annotations

import plain
import pytest
from pyspark.sql import functions as F

from kinescribe.llm import decontaminate, exact_dedup, queries, simhash
from kinescribe.llm.common import located, stage
from kinescribe.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, shard string, score double, hash string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1.0, None) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()


ODD = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b c"), (4, "a b c"), (5, "abc"), (None, "a bc"), (6, "a bc"), (7, "x" * 50_000), (8, "x " * 50_000)]


def test_simhash_matches_all_pairs(spark, table):
    got = queries.QUERIES["op3_simhash"](spark, SF).toPandas().sort_values("doc_id")
    prints = [plain.simhash(t) for t in table.text]
    by_id = dict(zip(table.doc_id, prints))
    assert [by_id[i] for i in got.doc_id] == [int(f, 16) for f in got.fingerprint] and len(got) == len(table)
    want = dict(zip(table.doc_id, plain.components(list(zip(table.doc_id, prints)))))
    assert [want[i] for i in got.doc_id] == got.component_id.tolist()


def test_simhash_links_planted_bits(spark):
    # Chains of flips over segment borders, more than any word shingles would give.
    import random

    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for base in prints[:40]:
        for n in (1, 2, 3, 4, 5, 6):
            f = base
            for b in rng.sample(range(64), n):
                f ^= 1 << b
            prints.append(f)
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {r.fp: r.component for r in simhash.linked_fingerprints(nodes).collect()}
    want = plain.components(list(zip(signed, prints)))
    groups = {}
    for s, w in zip(signed, want):
        groups.setdefault(w, set()).add(got[s])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_edges(spark):
    rows = simhash.near_duplicates(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    blank = {r.doc_id: r for r in rows if r.doc_id in (1, 2, 3)}
    assert all(r.fingerprint == 0 and r.component_id == 1 for r in blank.values())
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    lone = simhash.near_duplicates(docs(spark, [(None, "a b c d e")])).first()
    assert lone.component_id is None


def test_near_copies_leave_one_row_each(spark):
    text = " ".join(f"w{i}" for i in range(400))
    df = docs(spark, [(3, text), (2, text.replace("w7 ", "")), (None, text), (2, text + "!"), (9, "quite another text of some words")])
    assert sorted(r.doc_id for r in simhash.drop_near_copies(df).collect()) in ([2, 9], [2, 2, 9])
    assert simhash.drop_near_copies(df).columns == df.columns


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_exact_copies_of_odd_texts(spark):
    got = exact_dedup.deduplicate(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    groups = {}
    for r in got:
        groups.setdefault(r.text_sha256, []).append(r)
    assert sorted(len(g) for g in groups.values()) == [1, 2, 3, 4]
    assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in groups.values())
    keep = {r.doc_id: r.keep_id for r in got}
    assert (keep[1], keep[2], keep[5], keep[7], keep[6]) == (3, 3, 4, 8, 6)
    assert exact_dedup.deduplicate(docs(spark, [])).count() == 0
    left = exact_dedup.drop_exact_copies(docs(spark, ODD))
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 6, 8] and left.columns == DOCS_NAMES


DOCS_NAMES = [c.split()[0] for c in DOCS.split(", ")]


def test_equal_digests_of_different_texts_are_told_apart(spark):
    rows = [(i, t) for i, t in enumerate(["a", "b", "a ", "c", "b b", "bb", "a"])]
    got = exact_dedup.deduplicate(docs(spark, rows), digest=lambda c: F.lit("same")).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {0: (2, 3), 2: (2, 3), 6: (2, 3), 1: (1, 1), 3: (3, 1), 4: (4, 2), 5: (4, 2)}


def test_digest_state_goes_on_over_new_files(spark, tmp_path):
    path = str(tmp_path / "rows")
    first = docs(spark, [(5, "aa"), (6, "b")])
    first.write.parquet(path)

    def marked():
        df = located(spark.read.parquet(path))
        return df.select("doc_id", F.length("text").cast("long").alias("n_chars"), exact_dedup.normalised(F.col("text")).alias("digest"), F.lit("f").alias("_kinescribe_file"), F.lit(0).cast("long").alias("_kinescribe_row"))

    folder, source = str(tmp_path / "state"), str(tmp_path / "marked")
    marked().write.parquet(source)
    state = exact_dedup.digest_state(spark.read.parquet(source), folder)
    assert {r.digest: (r.group_size, r.keep.doc_id) for r in state.collect()} == {"aa": (1, 5), "b": (1, 6)}
    docs(spark, [(4, "aa"), (7, "b ")]).select("doc_id", F.length("text").cast("long").alias("n_chars"), exact_dedup.normalised(F.col("text")).alias("digest"), F.lit("g").alias("_kinescribe_file"), F.lit(0).cast("long").alias("_kinescribe_row")).write.mode("append").parquet(source)
    state = exact_dedup.digest_state(spark.read.parquet(source), folder)
    assert {r.digest: (r.group_size, r.keep.doc_id) for r in state.collect()} == {"aa": (2, 4), "b": (2, 7)}


def test_contamination_matches_all_windows(spark, table):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    got = {r.doc_id: r for r in queries.QUERIES["op10_decontamination"](spark, SF).collect()}
    want = plain.contamination(table.text, zip(items.item_id, items.text))
    assert len(got) == len(table)
    for d, (n, hit, ids) in zip(table.doc_id, want):
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(ids), plain.hashed(ids), hit > 0)


def test_contamination_of_odd_texts(spark):
    long = " ".join(f"t{i % 7}" for i in range(30))
    items = [(1, "One two three four five six seven eight nine ten eleven"), (2, "solo"), (3, "Two words"), (4, None), (5, "?!"), (6, long), (6, "seven eight nine ten eleven twelve one two three four"), (7, "a a a a a a a a a a a a"), (None, "five words are not many")]
    texts = [
        None, "", "zero one TWO three four five six seven eight nine ten, eleven twelve", "one two three four five six seven eight nine", "solo: two  words two", long + " end",
        " ".join(["a"] * 40), "x" * 30_000, "b " + " ".join(["a"] * 9), "five words are not many words", "ésolo soloé", long * 2,
    ]
    df = docs(spark, list(enumerate(texts)) + [(0, None), (None, "solo")])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit(1))
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in decontaminate.find_contamination(df, bench).collect() if r.doc_id is not None)
    plain_items = [("" if i is None else i, t) for i, t in items]
    want = [(i, *w) for i, w in enumerate(plain.contamination(texts, plain_items))]
    assert got == sorted(want + [want[0]])
    assert decontaminate.find_contamination(docs(spark, []), bench).count() == 0
    none = decontaminate.find_contamination(df, bench.limit(0)).collect()
    assert len(none) == len(texts) + 2 and all(r.n_hit == 0 and r.item_ids == [] for r in none)
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {d for d, _, hit, _ in want if not hit}


def test_stage_reads_back_what_it_wrote(spark):
    df = docs(spark, ODD)
    assert sorted(stage(df, "doc_id").select("text").collect(), key=str) == sorted(df.select("text").collect(), key=str)
