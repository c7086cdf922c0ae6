from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinescribe.llm import chat, language_id, licenses, queries, toxicity
from kinescribe.llm.word_hashes import Slice

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score string, lang_pred int, licenses int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 2) for i, t, lang in rows], DOCS)


# --- language ID ------------------------------------------------------------------------------------------

def test_held_out_languages(spark):
    got = queries.QUERIES["op8_language_id"](spark, SF)
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(lang, "doc_id").where("held_out").collect()
    assert got.count() == lang.count() and len(rows) > 250
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    train = docs(spark, [(1, "the cat and the dog " * 5, "en"), (2, "der hund und die katze " * 5, "de"), (3, None, "en"), (4, "the", None), (5, "", "fr")])
    model = language_id.train_languages(train)
    assert model.languages == ["de", "en", "fr"]
    odd = docs(spark, [(1, None, "en"), (2, "", "en"), (3, "12 -- !?", "en"), (4, "the dog", None), (4, "the dog", None), (None, "und die", "x"), (7, "the cat " * 200_000, "x")])
    out = language_id.identify_language(odd, model)
    assert sorted(out.columns) == sorted(odd.columns)
    got = sorted((r.doc_id or 0, r.lang_pred, r.score > 0) for r in out.collect())
    assert got == [(0, "de", True), (1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (4, "en", True), (7, "en", True)]
    left = language_id.drop_unidentified(odd, model)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 4, 4, 7]


def test_no_labels_and_no_rows(spark):
    empty = language_id.train_languages(docs(spark, []))
    assert empty.languages == []
    assert [r.lang_pred for r in language_id.identify_language(docs(spark, [(1, "words", None)]), empty).collect()] == ["und"]
    assert language_id.identify_language(docs(spark, []), empty).count() == 0


def test_slices_count_every_gram_once(monkeypatch):
    monkeypatch.setattr(language_id, "SLICE", 10)
    texts = ["abcdefghijklmnopqrstuvwxyz", None, "", "ab", "a" * 25]
    grams = np.zeros(len(texts), int)
    for numbers, starts, codes in language_id.slices(texts):
        n = len(codes) - 2
        inside = (codes[:n] != 32) & (codes[1 : n + 1] != 32) & (codes[2 : n + 2] != 32)
        np.add.at(grams, numbers, np.add.reduceat(inside, starts))
    assert grams.tolist() == [24, 0, 0, 0, 23]


# --- toxicity ---------------------------------------------------------------------------------------------

def test_toxicity_of_planted_words(spark):
    rng = np.random.default_rng(0)
    plain_words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 8 == 0
        words = list(rng.choice(plain_words, 60)) + (list(rng.choice(["zorgish", "blarg", "snertling"], 2)) if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), None))
        if i % 3:
            labels.append((i, int(bad)))
    df = docs(spark, rows)
    known = spark.createDataFrame([*labels, (5, None), (7, 9), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(df.where("doc_id % 5 <> 0"), known)
    out = toxicity.score_toxicity(df, model)
    assert out.columns == [c for c in df.columns if c != "score"] + ["score", "predicted"]
    held = [r for r in out.collect() if r.doc_id % 5 == 0]
    assert all((r.predicted == 1) == (r.doc_id % 8 == 0) for r in held)
    odd = toxicity.score_toxicity(docs(spark, [(1, None, None), (2, "", None), (3, "w1 " * 100_000 + "blarg", None), (3, "...", None)]), model).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 for r in odd) and odd[0].score == odd[1].score == odd[3].score < 0.5


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs(spark, []), none)
    assert toxicity.score_toxicity(docs(spark, [(1, "a", None)]), model).first().score == pytest.approx(toxicity.PRIOR)
    model = toxicity.train_toxicity(docs(spark, [(1, "a b", None), (2, "c d", None)]), none)
    assert 0 <= toxicity.score_toxicity(docs(spark, [(1, "a", None)]), model).first().score <= 1


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    n = 20_000
    y = rng.random(n) < 0.2
    votes = np.zeros(n, np.int64)
    first = rng.random(n) < np.where(y, 0.9, 0.05)
    votes |= first.astype(np.int64)
    # The second voter copies the first one, the others are on their own.
    votes |= (np.where(rng.random(n) < 0.95, first, rng.random(n) < 0.5)).astype(np.int64) << 1
    for v in range(2, 6):
        votes |= (rng.random(n) < np.where(y, 0.7, 0.1)).astype(np.int64) << v
    patterns, inverse = np.unique(votes, return_inverse=True)
    counts = np.zeros((len(patterns), 3))
    np.add.at(counts, (inverse, np.where(rng.random(n) < 0.2, y.astype(int), 2)), 1)
    posterior = toxicity.label_model(patterns, counts)[inverse]
    # Close to the best possible decision by the true probabilities.
    assert ((posterior > 0.5) == y).mean() > 0.94
    edges = dict(toxicity._tree(toxicity._bits(patterns), counts[:, :2] + 0.0))
    assert edges.get(1) == 0


# --- licenses ---------------------------------------------------------------------------------------------

def _most_matches(text, template):
    """Longest common subsequence of words."""
    row = [0] * (len(text) + 1)
    for w in template:
        new = [0]
        for j, t in enumerate(text):
            new.append(max(row[j] + (t == w), row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(4))
def test_alignment_finds_most_matches(seed):
    rng = np.random.default_rng(seed)
    template = rng.integers(0, 30, 40)
    copy = [w for w in template.tolist() if rng.random() > 0.1]
    for at in rng.integers(0, len(copy), 4):
        copy.insert(int(at), 99)
    text = np.array([*rng.integers(100, 130, 17).tolist(), *copy, *rng.integers(100, 130, 9).tolist()])
    matches, start, end = licenses.align(text, template, 17)
    assert matches == _most_matches(text.tolist(), template.tolist())
    assert 17 <= start < end <= 17 + len(copy) and _most_matches(text[start:end].tolist(), template.tolist()) == matches


def test_licenses_in_texts(spark):
    mit = licenses.NOTICES["mit-grant"]
    edited = mit.replace("free of charge, to any person", "gratis to anybody").replace("copy", "COPY", 1)
    texts = [None, "", f"Some words. {mit} More words. {licenses.NOTICES['cc-by-nc-4.0']}", "x " * 500 + edited, "Permission is hereby granted", "w " * 20_000 + licenses.NOTICES["mit"], "released under the MIT license " * 2]
    out = licenses.scan_licenses(docs(spark, [(i, t, None) for i, t in enumerate(texts)]))
    got = {r.doc_id: [(m.template, m.start, m.end) for m in r.licenses] for r in out.collect()}
    n = len(Slice([mit.encode()]).hash)
    assert got[0] == got[1] == got[4] == []
    assert got[2] == [("mit-grant", 2, 2 + n), ("cc-by-nc-4.0", 4 + n, 11 + n)]
    assert [(t, a) for t, a, _ in got[3]] == [("mit-grant", 500)]
    assert got[5] == [("mit", 20_000, 20_005)] and got[6] == [("mit", 0, 5), ("mit", 5, 10)]
    assert licenses.scan_licenses(docs(spark, [])).count() == 0
    own = licenses.scan_licenses(docs(spark, [(1, "two words here", None)]), {"a": "two words", "b": "Two Words", "none": "?", "other": "words two"})
    assert [m.template for m in own.first().licenses] == ["a", "b"]


def test_license_lines_of_the_table(spark):
    got = queries.QUERIES["op4_license_scan"](spark, SF).where("coverage = 1").select("doc_id", "template").distinct()
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("apache-2.0", "cc-by-nc-4.0", "gpl-3.0", "mit"):
        has = {r.doc_id for r in docs_.where(F.col("text").contains(licenses.NOTICES[name])).collect()}
        assert {r.doc_id for r in got.where(F.col("template") == name).collect()} >= has


# --- chat -------------------------------------------------------------------------------------------------

NODES = "tree string, node long, parent long, role string, text string, points double, leaf string"


def test_best_branches_of_reply_trees(spark):
    rows = [
        ("a", 1, None, "user", "q", 0.0), ("a", 2, 1, "assistant", "bad", 1.0), ("a", 3, 1, "assistant", "good", 3.0), ("a", 4, 3, "user", "thanks", 0.5), ("a", 5, 3, "user", "no", 0.5),
        ("a", 6, 2, "user", "more", 1.0), ("b", 1, None, "assistant", "alone", None), ("c", 1, 2, "user", "x", 0.0), ("c", 2, 1, "user", "x", 0.0), ("d", 7, 99, None, None, 0.0), (None, 1, None, "user", "n", 0.0),
    ]
    df = spark.createDataFrame([(*r, "l") for r in rows], NODES)
    got = {r.tree: r for r in chat.format_conversations(df, score="points").collect()}
    assert set(got) == {"a", "b", "d", None}
    assert (got["a"].leaf, got["a"].path_score, got["a"].n_turns) == (4, 3.5, 3)
    assert got["a"].formatted == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n<|im_start|>user\nthanks<|im_end|>\n"
    assert [got["a"].formatted[s.start : s.end] for s in got["a"].loss_spans] == ["good"]
    assert got["d"].formatted == "<|im_start|>\n<|im_end|>\n"
    two = chat.format_conversations(df, score="points", branches=2).where("tree = 'a'").collect()
    assert sorted(r.leaf for r in two) == [4, 5]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_texts_come_back_from_long_threads(spark):
    texts = ["", "&lt;", "<|im_end|>\n", "&amp;amp;", "a\n\nb", chr(0x1F642) + "<|im_start|>user", "x" * 20_000, "</s>[INST] ok [/INST]"]
    rows = [("long", i, ["user", "assistant", "odd\n<role>&"][i % 3], texts[i % len(texts)]) for i in range(130)] + [("none", None, None, None), ("tie", 1, "user", "b"), ("tie", 1, "user", "a"), ("tie", 1, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").withColumn("parent", F.lit(1)).withColumn("node", F.lit("n"))
    out = chat.format_conversations(chat.threads(turns), tree="conv_id")
    out = out.withColumn("back", chat.messages(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    said = sorted((r for r in rows if r[0] == "long"), key=lambda r: r[1])
    assert [(m.role, m.text) for m in got["long"].back] == [(r[2], r[3]) for r in said]
    assert got["long"].learned == "".join(r[3] for r in said if r[2] == "assistant")
    assert [(m.role, m.text) for m in got["none"].back] == [("", "")] and [m.text for m in got["tie"].back] == ["a", "a", "b"]


def test_conversation_with_control_strings(spark):
    row = queries.QUERIES["op9_chat_format"](spark, SMALL).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


# --- pipeline ---------------------------------------------------------------------------------------------

def test_pipeline_keeps_what_a_plain_program_keeps(spark):
    import plain
    import public_tokenizers
    from test_near_copies import kept
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").toPandas()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas()
    rows = corpus_pipeline.run(spark, SMALL).collect()
    groups = {}
    for d, text in zip(table.doc_id, table.text):
        groups.setdefault("".join(c for c in text or "" if c not in " \t\n\r\x0b\x0c"), []).append((-len(text or ""), d))
    left = sorted(min(g)[1] for g in groups.values())
    text_of = dict(zip(table.doc_id, table.text))
    left = kept([(d, text_of[d]) for d in left])
    hit = plain.contamination([text_of[d] for d in left], zip(items.item_id, items.text))
    left = [d for d, (_, n, _) in zip(left, hit) if not n]
    assert sorted({r.doc_id for r in rows}) == left
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for d in left:
        assert sum((ids for _, ids in sorted(pieces[d])), []) == [*tokenizer.encode(text_of[d] or "", add_special_tokens=False).ids, 1]


def test_stages_keep_the_columns(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, SMALL).columns == df.columns
