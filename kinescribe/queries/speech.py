"""Transcript, sentiment and topic-summary queries over conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescribe import fixtures
from kinescribe.functions import scalars
from kinescribe.operators import summaries
from kinescribe.operators import transcript as tr
from kinescribe.plans.staging import stage
from kinescribe.queries.base import query, r, sr, with_
from kinescribe.queries.episode import SPEECH_CTE

CHUNK_S, OVERLAP_S = 30.0, 2.0

DURATION = "ss AS (SELECT session_id, MAX(end_s) AS duration_s FROM speech GROUP BY 1)"
CHUNKS = """cb0 AS (SELECT session_id, duration_s, CAST(UNNEST(RANGE(CAST(CEIL(duration_s / 30.0) AS BIGINT))) AS INT) AS chunk_idx FROM ss),
cb AS (SELECT session_id, chunk_idx, chunk_idx * 30.0::DOUBLE AS core_start, LEAST(duration_s, (chunk_idx + 1) * 30.0::DOUBLE) AS core_end,
   GREATEST(0.0, chunk_idx * 30.0::DOUBLE - 2.0) AS extract_start,
   LEAST(duration_s, LEAST(duration_s, (chunk_idx + 1) * 30.0::DOUBLE) + 2.0) AS extract_end FROM cb0)"""


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.transcript(spark, sf).groupBy("session_id").agg(F.max("end_s").alias("duration_s"))


def chunk_segments(spark: SparkSession, sf: str) -> DataFrame:
    """What each overlapping chunk's recogniser would return: segments cut at the extract, on its own clock."""
    from kinescribe.operators.lookups import overlapping

    bounds = tr.chunk_bounds(sessions(spark, sf), CHUNK_S, OVERLAP_S)
    pairs = overlapping(bounds, fixtures.transcript(spark, sf), ["session_id"], ("extract_start", "extract_end"), ("start_s", "end_s"))
    cut = pairs.where((F.col("start_s") < F.col("extract_end")) & (F.col("end_s") > F.col("extract_start")))
    return cut.select(
        "session_id", "chunk_idx",
        (F.greatest("start_s", "extract_start") - F.col("extract_start")).alias("start_s"),
        (F.least("end_s", "extract_end") - F.col("extract_start")).alias("end_s"), "text",
    )


@query("chunk_bounds", with_([SPEECH_CTE, DURATION, CHUNKS], f"""SELECT session_id, chunk_idx, {sr('core_start')}, {sr('core_end')},
       {sr('extract_start')}, {sr('extract_end')} FROM cb"""))
def chunk_bounds(spark: SparkSession, sf: str) -> DataFrame:
    out = tr.chunk_bounds(sessions(spark, sf), CHUNK_S, OVERLAP_S)
    return out.select("session_id", "chunk_idx", *[r(c) for c in ("core_start", "core_end", "extract_start", "extract_end")])


@query("stitched_segments", with_([SPEECH_CTE, DURATION, CHUNKS,
       """cs AS (SELECT c.session_id, c.chunk_idx, GREATEST(s.start_s, extract_start) AS start_s, LEAST(s.end_s, extract_end) AS end_s, s.text,
       LOWER(TRIM(REGEXP_REPLACE(REGEXP_REPLACE(s.text, '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS norm
       FROM cb c JOIN speech s ON s.session_id = c.session_id AND s.start_s < extract_end AND s.end_s > extract_start
       WHERE LEAST(s.end_s, extract_end) > chunk_idx * 30.0 AND GREATEST(s.start_s, extract_start) < (chunk_idx + 1) * 30.0)"""],
       f"""SELECT session_id, chunk_idx, {sr('start_s')}, {sr('end_s')}, text FROM cs a WHERE NOT EXISTS (SELECT 1 FROM cs b WHERE
       b.session_id = a.session_id AND b.norm = a.norm AND b.chunk_idx < a.chunk_idx AND b.start_s <= a.end_s AND b.end_s >= a.start_s)"""))
def stitched_segments(spark: SparkSession, sf: str) -> DataFrame:
    out = tr.stitch_chunks(stage(chunk_segments(spark, sf)), CHUNK_S, OVERLAP_S)
    return out.select("session_id", "chunk_idx", r("start_s"), r("end_s"), "text")


_WORDS = """wd0 AS (SELECT session_id, seg_idx, start_s AS seg_start, UNNEST(STRING_SPLIT_REGEX(text, '\\s+')) AS word,
   GENERATE_SUBSCRIPTS(STRING_SPLIT_REGEX(text, '\\s+'), 1) - 1 AS word_no FROM speech),
wd1 AS (SELECT *, COALESCE(SUM(LENGTH(word) + 1) OVER (PARTITION BY session_id, seg_idx ORDER BY word_no
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM wd0),
wd AS (SELECT session_id, word, seg_start + off / 15.0 AS start_s, seg_start + (off + LENGTH(word)) / 15.0 AS end_s,
   LEAD(seg_start + off / 15.0) OVER p AS next_start, seg_idx, word_no FROM wd1
   WINDOW p AS (PARTITION BY session_id ORDER BY seg_idx, word_no)),
wn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY seg_idx, word_no) AS n,
   COUNT(*) OVER (PARTITION BY session_id) AS total FROM wd WHERE TRIM(word) <> '')"""


@query("sentences", "WITH RECURSIVE " + ",\n".join([SPEECH_CTE, _WORDS,
       """fold AS (SELECT session_id, n, 1 AS sent, LENGTH(word) + 1 AS len,
         (word SIMILAR TO '(.|\n)*[.!?]' OR (COALESCE(next_start - end_s > 1.0, FALSE) AND LENGTH(word) + 1 > 30) OR LENGTH(word) + 1 > 250) AS done
         FROM wn WHERE n = 1
       UNION ALL
       SELECT w.session_id, w.n, CASE WHEN f.done THEN f.sent + 1 ELSE f.sent END,
         CASE WHEN f.done THEN 0 ELSE f.len END + LENGTH(w.word) + 1,
         (w.word SIMILAR TO '(.|\n)*[.!?]' OR (COALESCE(w.next_start - w.end_s > 1.0, FALSE)
           AND CASE WHEN f.done THEN 0 ELSE f.len END + LENGTH(w.word) + 1 > 30)
           OR CASE WHEN f.done THEN 0 ELSE f.len END + LENGTH(w.word) + 1 > 250)
         FROM fold f JOIN wn w ON w.session_id = f.session_id AND w.n = f.n + 1)"""]) +
       f"""\nSELECT session_id, {sr('MIN(start_s)', 'start_s')}, {sr('MAX(end_s)', 'end_s')}, STRING_AGG(word, ' ' ORDER BY n) AS text,
       'Neutral' AS sentiment FROM fold JOIN wn USING (session_id, n) GROUP BY session_id, sent""")
def sentences(spark: SparkSession, sf: str, rows: int = 262_144) -> DataFrame:
    words = fixtures.words(spark, sf)
    bucket = F.floor(F.col("seg_idx") / 1024)
    out = tr.words_to_sentences(words, ["seg_idx", "word_no"], bucket, rows)
    return out.select("session_id", r("start_s"), r("end_s"), "text", "sentiment")


@query("segment_filter", "SELECT conv_id AS session_id, turn AS seg_idx, LENGTH(text) AS chars FROM conversations WHERE LENGTH(text) > 100")
def segment_filter(spark: SparkSession, sf: str) -> DataFrame:
    out = tr.segment_filter(fixtures.transcript(spark, sf), 100)
    return out.select("session_id", "seg_idx", F.length("text").cast("bigint").alias("chars"))


_NOISE = " OR ".join("CONTAINS(LOWER(TRIM(text)), '{}')".format(f.replace("'", "''")) for f in tr.FILLERS)


@query("noise_filter", f"""SELECT doc_id AS seg_idx, LENGTH(text) > 10 AS long_enough, NOT (LENGTH(LOWER(TRIM(text))) < 15 AND ({_NOISE})) AS kept
       FROM documents""")
def noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = fixtures.read(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("seg_idx"), (F.length("text") > 10).alias("long_enough"), (~tr.is_noise(F.col("text"))).alias("kept")
    )


F4 = """seg0 AS (SELECT d.doc_id, d.source AS session_id, d.text, l.doc_id AS lab, l.quality, l.toxic,
   ROW_NUMBER() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS n FROM documents d LEFT JOIN labels l USING (doc_id)),
seg AS (SELECT session_id, doc_id AS seg_idx, n * 5.0 AS timestamp, text,
   CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment,
   CASE WHEN lab IS NULL THEN NULL WHEN toxic = 1 THEN -0.9 WHEN quality = 1 THEN 0.8 ELSE 0.0 END AS sentiment_score,
   CAST(CASE WHEN doc_id % 11 = 0 THEN -1 ELSE doc_id % 7 END AS INT) AS topic FROM seg0)"""


def f4(spark: SparkSession, sf: str, with_text: bool = True) -> DataFrame:
    return fixtures.scored_segments(spark, sf, with_text)


@query("segment_search", with_([F4], """SELECT session_id, seg_idx, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY seg_idx) AS match_no,
       COUNT(*) OVER (PARTITION BY session_id) AS matches FROM seg WHERE CONTAINS(LOWER(text), 'the') AND topic NOT IN (2, 3)"""))
def segment_search(spark: SparkSession, sf: str) -> DataFrame:
    out = tr.search_segments(f4(spark, sf), "The", hidden_topics=[2, 3])
    return out.select("session_id", "seg_idx", "match_no", "matches")


@query("topic_focus", with_([F4], "SELECT session_id, seg_idx, topic FROM seg WHERE topic = 4"))
def topic_focus(spark: SparkSession, sf: str) -> DataFrame:
    return tr.topic_visibility(f4(spark, sf, False), focus=4).select("session_id", "seg_idx", "topic")


@query("topics_hidden", with_([F4], """SELECT session_id, seg_idx, topic FROM seg WHERE topic NOT IN
       (SELECT topic FROM seg GROUP BY 1 HAVING AVG(COALESCE(sentiment_score, 0)) > 0.2)"""))
def topics_hidden(spark: SparkSession, sf: str) -> DataFrame:
    segments = f4(spark, sf, False)
    pleasant = segments.groupBy("topic").agg(F.avg(F.coalesce("sentiment_score", F.lit(0.0))).alias("s")).where("s > 0.2")
    return tr.topic_visibility(segments, hidden=pleasant).select("session_id", "seg_idx", "topic")


_TOKENS = """tk0 AS (SELECT conv_id AS session_id, turn, UNNEST(STRING_SPLIT_REGEX(LOWER(text), '\\s+')) AS word,
   GENERATE_SUBSCRIPTS(STRING_SPLIT_REGEX(text, '\\s+'), 1) AS i FROM conversations),
tk AS (SELECT session_id, word, COUNT(*) AS n, MIN(turn * 1000000 + i) AS pos FROM tk0 WHERE LENGTH(word) > 3 GROUP BY ALL)"""


@query("summary_keywords", with_([_TOKENS], """SELECT * EXCLUDE (pos) FROM (SELECT session_id, CAST(ROW_NUMBER() OVER (PARTITION BY session_id
       ORDER BY n DESC, pos) AS INT) AS rank, word, n, CAST(SUM(n) OVER (PARTITION BY session_id) AS BIGINT) AS total_words, pos FROM tk) WHERE rank <= 5"""))
def summary_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return tr.summary_keywords(fixtures.transcript(spark, sf))


_STOP = ", ".join(f"'{w}'" for w in tr.STOP_WORDS)


@query("clean_words", f"""SELECT DISTINCT session_id, word FROM (SELECT conv_id AS session_id,
       UNNEST(STRING_SPLIT_REGEX(LOWER(REGEXP_REPLACE(text, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')), '\\s+')) AS word FROM conversations)
       WHERE LENGTH(word) > 2 AND word NOT IN ({_STOP})""")
def clean_words(spark: SparkSession, sf: str) -> DataFrame:
    return tr.clean_words(fixtures.transcript(spark, sf))


@query("deictic_terms", """SELECT doc_id, LIST_COUNT(t) AS terms, COALESCE(ARRAY_TO_STRING(t, ' '), '') AS spoken FROM (SELECT doc_id,
       LIST_FILTER(STRING_SPLIT_REGEX(LOWER(text), '\\s+'), lambda w: w IN ('this','that','here','there','these','those')) AS t FROM documents)""")
def deictic_terms(spark: SparkSession, sf: str) -> DataFrame:
    found = fixtures.read(spark, sf, "documents").select("doc_id", scalars.deictic_terms(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("bigint").alias("terms"), F.array_join("t", " ").alias("spoken"))


@query("segments_json", with_([SPEECH_CTE], """SELECT session_id, seg_idx AS id, ROUND(start_s, 3) + 0.0 AS start, LENGTH(text) AS chars, 'General' AS topic
       FROM speech"""))
def segments_json(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON export read back."""
    lines = tr.export_segments_json(fixtures.transcript(spark, sf))
    parsed = F.from_json("segment", "id bigint, start double, end double, text string, topic string")
    out = lines.select("session_id", parsed.alias("s"))
    return out.select(
        "session_id", "s.id", r(F.col("s.start"), 3, "start"), F.length("s.text").cast("bigint").alias("chars"), "s.topic"
    )


@query("clock_labels", with_([SPEECH_CTE], """SELECT session_id, seg_idx, LPAD(CAST(CAST(FLOOR(end_s / 60) AS INT) AS VARCHAR), 2, '0') || ':' ||
       LPAD(CAST(CAST(FLOOR(end_s) AS INT) % 60 AS VARCHAR), 2, '0') AS clock,
       CASE WHEN end_s < 60 THEN CAST(FLOOR(end_s) AS INT) || 's' WHEN end_s < 3600 THEN CAST(FLOOR(end_s / 60) AS INT) || 'm ' ||
       (CAST(FLOOR(end_s) AS INT) % 60) || 's' ELSE CAST(FLOOR(end_s / 3600) AS INT) || 'h ' || (CAST(FLOOR(end_s / 60) AS INT) % 60) || 'm' END AS duration,
       CASE WHEN LENGTH(text) > 28 THEN SUBSTRING(text, 1, 27) || '…' ELSE text END AS shown FROM speech"""))
def clock_labels(spark: SparkSession, sf: str) -> DataFrame:
    end = F.col("end_s")
    return fixtures.transcript(spark, sf).select(
        "session_id", "seg_idx", scalars.clock(end).alias("clock"), scalars.format_duration(end).alias("duration"),
        scalars.shorten(F.col("text"), 28).alias("shown"),
    )


# --- sentiment and topic summaries -------------------------------------------------------------------

@query("sentiment_stats", with_([F4], """SELECT session_id, COUNT(*) FILTER (sentiment = 'positive') AS positive,
       COUNT(*) FILTER (sentiment = 'negative') AS negative, COUNT(*) FILTER (sentiment = 'neutral') AS neutral, COUNT(*) AS total FROM seg GROUP BY 1"""))
def sentiment_stats(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.sentiment_stats(f4(spark, sf, False))


@query("sentiment_from_scores", """SELECT 'labels' AS session_id, doc_id AS seg_idx, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
       ELSE 'neutral' END AS sentiment, CASE WHEN toxic = 1 THEN -0.7::DOUBLE WHEN quality = 1 THEN 0.6::DOUBLE ELSE 0.0 END AS sentiment_score FROM labels""")
def sentiment_from_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Three model scores per labelled document."""
    scores = F.explode(F.array(
        F.struct(F.lit("Negative").alias("label"), (F.col("toxic") * 0.7).alias("score")),
        F.struct(F.lit("Positive").alias("label"), (F.col("quality") * 0.6).alias("score")),
        F.struct(F.lit("Neutral").alias("label"), F.lit(0.5).alias("score")),
    ))
    rows = fixtures.read(spark, sf, "labels").select(F.lit("labels").alias("session_id"), F.col("doc_id").alias("seg_idx"), scores.alias("s"))
    return summaries.sentiment_from_scores(rows.select("session_id", "seg_idx", "s.*"))


@query("topic_sentiment", with_([F4], f"""SELECT topic, {sr('s', 'sentiment')}, CASE WHEN s > 0.3 THEN 'positive' WHEN s < -0.3 THEN 'negative' ELSE 'neutral' END
       AS class FROM (SELECT topic, AVG(COALESCE(sentiment_score, CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END)) AS s
       FROM seg WHERE topic <> -1 GROUP BY 1)"""))
def topic_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.topic_sentiment(f4(spark, sf, False)).select("topic", r("sentiment"), "class")


@query("topic_sizes", with_([F4], f"""SELECT topic, n, {sr('AVG(n) OVER ()', 'mean_n')} FROM (SELECT topic, COUNT(*) AS n FROM seg
       WHERE topic <> -1 GROUP BY 1)"""))
def topic_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.topic_sizes(f4(spark, sf, False)).select("topic", "n", r("mean_n"))


@query("topic_session_matrix", with_([F4], "SELECT session_id, topic, COUNT(*) AS segments, CAST(GROUPING_ID(session_id, topic) AS INT) AS totals FROM seg WHERE topic <> -1 GROUP BY CUBE (session_id, topic)"))
def topic_session_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.topic_session_matrix(f4(spark, sf, False))


@query("topic_session_wide", with_([F4], "SELECT session_id, " + ", ".join(f"COUNT(*) FILTER (topic = {t}) AS topic_{t}" for t in range(7))
       + " FROM seg WHERE topic <> -1 GROUP BY 1"))
def topic_session_wide(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.topic_session_wide(f4(spark, sf, False), range(7))


@query("topic_timeline", with_([F4, """sz AS (SELECT topic, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*), topic) - 1 AS INT) AS row FROM seg WHERE topic <> -1 GROUP BY 1)"""],
       f"SELECT session_id, seg_idx, {sr('timestamp')}, topic, row FROM seg JOIN sz USING (topic)"))
def topic_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.topic_timeline(f4(spark, sf, False)).select("session_id", "seg_idx", r("timestamp"), "topic", "row")


@query("session_summary", with_([F4, "c AS (SELECT session_id, topic, COUNT(*) AS n FROM seg GROUP BY ALL)"],
       """SELECT session_id, CAST(SUM(n) AS BIGINT) AS segments, COALESCE('Topic ' || (ARG_MAX(topic, n * 1000 - topic) FILTER (topic <> -1)), 'N/A')
       AS primary_topic FROM c GROUP BY 1"""))
def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.session_summary(f4(spark, sf, False))


@query("dominant_topic", with_([F4, "c AS (SELECT topic, COUNT(*) AS n FROM seg WHERE topic <> -1 GROUP BY ALL)"],
       f"SELECT ARG_MAX(topic, n * 1000 - topic) AS topic, MAX(n) AS n, {sr('MAX(n) / SUM(n)', 'share')}, COUNT(*) AS topics FROM c"))
def dominant_topic(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.dominant_topic(f4(spark, sf, False)).select("topic", "n", r("share"), "topics")


@query("topic_prominence", with_([F4, """c AS (SELECT topic, COUNT(*) AS n FROM seg WHERE topic <> -1 GROUP BY ALL),
       p AS (SELECT *, n / SUM(n) OVER () * 100.0 AS percent, MAX(n) OVER () AS top FROM c)"""],
       f"""SELECT topic, n, {sr('percent')}, CAST(GREATEST(1, LEAST(5, ROUND_EVEN(n / top * 5.0, 0))) AS INT) AS stars,
       CASE WHEN n >= 10 AND percent >= 10 THEN 'strong' WHEN n >= 5 THEN 'moderate' ELSE 'weak' END AS strength FROM p"""))
def topic_prominence(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.topic_prominence(f4(spark, sf, False)).select("topic", "n", r("percent"), "stars", "strength")


@query("category_examples", with_([F4, "t AS (SELECT 'Topic ' || topic AS category, text, COUNT(*) AS c FROM seg GROUP BY ALL)",
       """k AS (SELECT category, text, CAST(ROW_NUMBER() OVER (PARTITION BY category ORDER BY LENGTH(text), text) AS INT) AS rank,
       CAST(SUM(c) OVER (PARTITION BY category) AS BIGINT) AS n FROM t)"""], "SELECT category, rank, text, n FROM k WHERE rank <= 3"))
def category_examples(spark: SparkSession, sf: str) -> DataFrame:
    named = f4(spark, sf).withColumn("category", F.concat(F.lit("Topic "), F.col("topic")))
    return summaries.category_examples(named).select("category", "rank", "text", "n")


@query("topic_exemplars", with_([F4, """k AS (SELECT topic, session_id, seg_idx, CAST(LENGTH(text) AS INT) AS chars, SUBSTRING(text, 1, 120) AS excerpt,
       CAST(ROW_NUMBER() OVER (PARTITION BY topic ORDER BY LENGTH(text) DESC, session_id, seg_idx) AS INT) AS rank,
       MAX(LENGTH(text)) OVER (PARTITION BY topic) AS longest FROM seg WHERE topic <> -1)"""],
       "SELECT * EXCLUDE (longest) FROM k WHERE rank <= 8 AND (chars > 25 OR longest <= 25)"))
def topic_exemplars(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.topic_exemplars(f4(spark, sf))


@query("attached_topics", with_([F4], """SELECT session_id, seg_idx, CASE WHEN sentiment_score IS NULL THEN 'General' WHEN topic = -1 THEN 'General'
       WHEN topic < 3 THEN 'Label ' || topic ELSE 'Topic ' || topic END AS topic_label FROM seg"""))
def attached_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Only scored segments were assigned, and only topics 0-2 have labels."""
    segments = f4(spark, sf, False)
    assigned = segments.where(F.col("sentiment_score").isNotNull())
    labels = segments.where((F.col("topic") >= 0) & (F.col("topic") < 3)).select("topic").distinct()
    labels = labels.withColumn("label", F.concat(F.lit("Label "), F.col("topic")))
    out = summaries.attach_topics(segments.drop("topic"), assigned, labels)
    return out.select("session_id", "seg_idx", "topic_label")


@query("pooled_segments", with_([F4], f"""SELECT session_id, seg_idx, 'Session ' || session_id AS session_name, {sr('timestamp')}, sentiment,
       {sr('sentiment_score')} FROM seg WHERE LENGTH(text) > 10"""))
def pooled_segments(spark: SparkSession, sf: str) -> DataFrame:
    segments = f4(spark, sf)
    named = segments.select("session_id").distinct().withColumn("session_name", F.concat(F.lit("Session "), F.col("session_id")))
    out = summaries.segments_with_session(tr.segment_filter(segments), named)
    return out.select("session_id", "seg_idx", "session_name", r("timestamp"), "sentiment", r("sentiment_score"))
