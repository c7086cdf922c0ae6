"""Registered queries of this subpackage over the test tables, each with its SQL twin where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescribe.llm import chat, collocations, decontaminate, exact_dedup, hard_negatives, language_id, licenses, minhash, packing, sharding, simhash, token_counts, toxicity
from kinescribe.llm.common import PLACE, folded, read

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.inline("licenses"))


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


OP6_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text,
         replace(replace(replace(replace(replace(replace(coalesce(text, ''), ' ', ''), chr(9), ''), chr(10), ''), chr(11), ''), chr(12), ''), chr(13), '') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM texts WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)"""


@query("op6_exact_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(read(spark, sf_dir, "documents")).drop(*PLACE)


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (folded("doc_id", 5) == 0).alias("held_out"))
    model = toxicity.train_toxicity(docs.where("NOT held_out"), read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).drop("text")


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = docs.withColumn("held_out", folded("doc_id", 3) == 1)
    model = language_id.train_languages(held.where("NOT held_out"))
    return language_id.identify_language(held.select("doc_id", "held_out", "text"), model).drop("text")


OP9_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + 1 + 11 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&nl;'))
           + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""


@query("op9_chat_format", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    two = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), said)
    done = chat.format_conversations(chat.threads(turns.union(two)), tree="conv_id")
    read_back, learned = chat.messages(F.col("formatted")), chat.learned_text(F.col("formatted"), F.col("loss_spans"))
    told = F.array_join(F.transform(read_back, lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size(read_back).cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op10_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP11_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE id <> anchor_id AND label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10"""


@query("op11_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(rows.withColumn("label", changed), F.col("id") % 100 == 0)


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k AS length, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k))),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE length = 1 GROUP BY lang),
found AS (SELECT lang, phrase, length, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
phrases AS (SELECT *, string_split(phrase, ' ') AS w FROM found WHERE length > 1),
cuts AS (SELECT *, unnest(generate_series(1, length - 1)) AS k FROM phrases),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * c.f // (l.f::HUGEINT + r.f) AS BIGINT) AS score, k
  FROM cuts c JOIN found l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
  JOIN found r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.w, k + 1, c.length), ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, f
  FROM (SELECT *, unnest(generate_series(1, length - size + 1)) AS i FROM (SELECT *, unnest(generate_series(2, length - 1)) AS size FROM phrases WHERE length > 2))),
longer AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL)
SELECT s.lang, row_number() OVER w AS rank, s.phrase, s.a, s.l, s.r, t.n, s.score
FROM scored s JOIN totals t ON t.lang = s.lang LEFT JOIN longer x ON x.lang = s.lang AND x.phrase = s.phrase
WHERE x.f IS NULL OR 100::HUGEINT * x.f < 80::HUGEINT * s.a
WINDOW w AS (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase)
QUALIFY row_number() OVER w <= 2000"""


@query("op12_collocations", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


@query("op13_minhash")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))
