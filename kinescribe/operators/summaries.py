"""Sentiment and topic summaries over segments.

``segments``: session_id, seg_idx, text, timestamp, sentiment, sentiment_score, topic (-1 = none). Topics
are few and may each hold a large share of the segments: everything is aggregated before it is compared,
and per-topic picks are ``row_number() <= k`` filters, which Spark limits before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinescribe.plans.chunks import ordered, small_list

SENTIMENT_BOUND = 0.3


def attach_topics(transcript: DataFrame, assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """Transcript with the topic label of each segment: unassigned or -1 is "General", unknown "Topic n"."""
    joined = transcript.join(assigned.select("session_id", "seg_idx", "topic"), ["session_id", "seg_idx"], "left")
    named = joined.join(labels.select("topic", "label"), "topic", "left")
    label = F.when(F.col("topic").isNull(), "General").otherwise(
        F.coalesce("label", F.when(F.col("topic") == -1, "General").otherwise(F.concat(F.lit("Topic "), F.col("topic"))))
    )
    return named.withColumn("topic_label", label).drop("label")


def segments_with_session(transcript: DataFrame, sessions: DataFrame) -> DataFrame:
    """Segments of all sessions with the session's display name."""
    return transcript.join(sessions.select("session_id", "session_name"), "session_id")


def sentiment_class(label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("neutral")))
    has = lambda *words: low.rlike("|".join(words))
    return F.when(has("joy", "positive"), "Positive").when(has("sadness", "anger", "negative"), "Negative").otherwise("Neutral")


def sentiment_stats(segments: DataFrame) -> DataFrame:
    """Segments per sentiment class and in total, per session."""
    classed = segments.withColumn("_class", sentiment_class(F.col("sentiment")))
    return classed.groupBy("session_id").agg(
        *[F.count_if(F.col("_class") == c).alias(c.lower()) for c in ("Positive", "Negative", "Neutral")],
        F.count(F.lit(1)).alias("total"),
    )


def sentiment_from_scores(scores: DataFrame) -> DataFrame:
    """Best label and signed score per segment from model output (session_id, seg_idx, label, score).

    Ties go to the alphabetically first label.
    """
    best = scores.groupBy("session_id", "seg_idx").agg(F.min_by(F.struct("label", "score"), F.struct(-F.col("score"), "label")).alias("b"))
    label = F.lower("b.label")
    signed = F.when(label.contains("pos"), F.col("b.score")).when(label.contains("neg"), -F.col("b.score")).otherwise(0.0)
    return best.select("session_id", "seg_idx", label.alias("sentiment"), signed.alias("sentiment_score"))


def signed_score() -> Column:
    """The segment's score, or +1 / -1 / 0 by its label where there is none."""
    low = F.lower(F.coalesce("sentiment", F.lit("")))
    by_label = F.when(low.rlike("pos|joy"), 1.0).when(low.rlike("neg|anger|sadness"), -1.0).otherwise(0.0)
    return F.coalesce("sentiment_score", by_label)


def topic_sentiment(segments: DataFrame) -> DataFrame:
    """Mean signed score per topic and its class at +-0.3."""
    mean = segments.where(F.col("topic") != -1).groupBy("topic").agg(F.avg(signed_score()).alias("sentiment"))
    s = F.col("sentiment")
    return mean.withColumn("class", F.when(s > SENTIMENT_BOUND, "positive").when(s < -SENTIMENT_BOUND, "negative").otherwise("neutral"))


def topic_sizes(segments: DataFrame) -> DataFrame:
    """Segments per topic, and the mean over topics as reference."""
    sizes = segments.where(F.col("topic") != -1).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("mean_n", F.avg("n").over(Window.partitionBy()))


def topic_session_matrix(segments: DataFrame) -> DataFrame:
    """Segment counts per session and topic with both kinds of totals.

    ``totals`` tells them from a NULL key: 0 for a cell, 1 over topics, 2 over sessions, 3 over both.
    """
    cells = segments.where(F.col("topic") != -1).groupBy("session_id", "topic").count()
    return cells.cube("session_id", "topic").agg(F.sum("count").alias("segments"), F.grouping_id().cast("int").alias("totals"))


def topic_session_wide(segments: DataFrame, topics: Sequence[int]) -> DataFrame:
    """One row per session with a topic, one column per given topic, 0 where none."""
    counts = [F.count_if(F.col("topic") == t).alias(f"topic_{t}") for t in topics]
    return segments.where(F.col("topic") != -1).groupBy("session_id").agg(*counts)


def topic_timeline(segments: DataFrame) -> DataFrame:
    """Time of every segment with the row of its topic, the smallest topic first."""
    sizes = segments.where(F.col("topic") != -1).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    placed = sizes.select("topic", (F.row_number().over(ordered([], "n", "topic")) - 1).alias("row"))
    return segments.select("session_id", "seg_idx", "timestamp", "topic").join(placed, "topic")


def session_summary(segments: DataFrame) -> DataFrame:
    """Segments and most frequent topic per session ("N/A" if all are -1; ties: the lowest topic)."""
    cells = segments.groupBy("session_id", "topic").count()
    primary = F.max_by(F.when(F.col("topic") != -1, F.col("topic")), F.when(F.col("topic") != -1, F.struct("count", -F.col("topic"))))
    return cells.groupBy("session_id").agg(F.sum("count").alias("segments"), primary.alias("_t")).select(
        "session_id", "segments", F.coalesce(F.concat(F.lit("Topic "), F.col("_t")), F.lit("N/A")).alias("primary_topic")
    )


def dominant_topic(segments: DataFrame) -> DataFrame:
    """The largest topic and its share of the segments that have one."""
    sizes = segments.where(F.col("topic") != -1).groupBy("topic").count()
    return sizes.agg(
        F.max_by("topic", F.struct("count", -F.col("topic"))).alias("topic"), F.max("count").alias("n"),
        (F.max("count") / F.sum("count")).alias("share"), F.count(F.lit(1)).alias("topics"),
    )


def topic_prominence(segments: DataFrame) -> DataFrame:
    """Size, percentage, 1-5 stars relative to the largest topic (half to even) and strength."""
    sizes = segments.where(F.col("topic") != -1).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    scored = sizes.withColumns(
        {
            "percent": F.col("n") / F.sum("n").over(everything) * 100.0,
            "stars": F.greatest(F.lit(1), F.least(F.lit(5), F.bround(F.col("n") / F.max("n").over(everything) * 5.0).cast("int"))),
        }
    )
    strength = F.when((F.col("n") >= 10) & (F.col("percent") >= 10), "strong").when(F.col("n") >= 5, "moderate").otherwise("weak")
    return scored.withColumn("strength", strength)


def category_examples(segments: DataFrame, category: str = "category", k: int = 3) -> DataFrame:
    """Per category its number of texts and the ``k`` shortest distinct ones, most frequent category first.

    Only texts that can be among the shortest are shuffled.
    """
    named = segments.select(F.col(category).alias("category"), "text")
    totals = named.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    # Ranks among distinct texts; a limit on such a rank is applied in each task before anything is shuffled.
    place = F.dense_rank().over(ordered(["category"], F.length("text"), "text"))
    shortest = named.withColumn("rank", place).where(F.col("rank") <= k).distinct()
    return shortest.join(totals, "category").orderBy(F.col("n").desc(), "category", "rank")


def topic_exemplars(
    segments: DataFrame, k: int = 8, min_chars: int = 25, excerpt: int = 120, words: DataFrame | None = None, top: int = 5
) -> DataFrame:
    """Per topic the ``k`` longest texts above ``min_chars`` (any, if none is that long), cut to an excerpt.

    ``words`` (topic, rank, term) adds the ``top`` first words of each topic as ``keywords``.
    """
    sized = segments.where(F.col("topic") != -1).select(
        "topic", "session_id", "seg_idx", F.length("text").alias("chars"), F.substring("text", 1, excerpt).alias("excerpt")
    )
    rank = F.row_number().over(ordered(["topic"], F.col("chars").desc(), "session_id", "seg_idx"))
    best = sized.withColumn("rank", rank).where(F.col("rank") <= k)
    longest = F.max("chars").over(Window.partitionBy("topic"))
    best = best.withColumn("_longest", longest).where((F.col("chars") > min_chars) | (F.col("_longest") <= min_chars)).drop("_longest")
    if words is None:
        return best
    listed = words.where(F.col("rank") <= top).groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda w: w["term"]).alias("keywords"))
    return best.join(listed, "topic", "left")


def seed_match(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """For each topic label the first seed (by ``seed_no``) with a word of more than three letters in it.

    ``seeds``: seed_no, seed - a parameter table. A label without a match keeps its own name.
    """
    words = F.filter(F.split(F.lower(F.regexp_replace("seed", "/", " ")), r"\s+"), lambda w: F.length(w) > 3)
    listed = small_list(seeds.select(F.struct("seed_no", "seed", words.alias("words")).alias("s")), F.col("s"))
    hit = lambda s: F.exists(s["words"], lambda w: F.contains(F.lower("label"), w))
    found = labels.withColumn("_seeds", listed).withColumn("_first", F.get(F.filter("_seeds", hit), F.lit(0)))
    return found.withColumn("category", F.coalesce("_first.seed", "label")).drop("_seeds", "_first")
