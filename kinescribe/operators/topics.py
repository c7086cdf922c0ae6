"""Terms, topic words and labels, vectors, clusters and the topic graph.

Topic tables (words, sizes, centroids) are small: a few rows per topic. Documents and vectors are large and
are only ever joined by key or compared with a size-checked parameter array (``small_list``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from kinescribe.functions.scalars import beautify_label, cosine_similarity, dot, euclidean, singular
from kinescribe.operators.transcript import STOP_WORDS
from kinescribe.plans.chunks import ordered, small_list
from kinescribe.plans.staging import stage

# Fixed values.
NOISE_WORDS = ("sorry", "know", "think", "don't", "cant", "that", "this", "just", "really")
LABEL_SKIP = ("also", "then", "here", "there", "cars", "car", "about", "something", "action")
K_VALUES = (3, 5, 8, 10, 20)
ZERO_SHOT_THRESHOLD, OUTLIER_THRESHOLD = 0.18, 0.05

#: Word rules: three or more Latin letters, or two or more word characters.
STANDARD, AGGRESSIVE = r"^[a-z]{3,}$", r"^.{2,}$"


# --- terms -------------------------------------------------------------------------------------------

def ngrams(words: str, longest: int) -> Column:
    """All n-grams up to ``longest`` words of an array column, as one array; none spans a NULL."""
    word = F.col(words)

    def of(n: int) -> Column:
        starts = F.when(F.size(word) >= n, F.sequence(F.lit(1), F.size(word) - (n - 1))).otherwise(F.array().cast("array<int>"))
        # concat is NULL as soon as one word is.
        gram = lambda i: [p for j in range(n) for p in (F.lit(" "), F.get(word, i - 1 + j))][1:]
        return F.transform(starts, lambda i: F.concat(*gram(i)))

    return F.array_compact(F.concat(word, *[of(n) for n in range(2, longest + 1)]))


def words_of(
    docs: DataFrame, keys: Sequence[str], word_rule: str = STANDARD, stop_words: Sequence[str] = STOP_WORDS,
    possible: Column | None = None,
) -> DataFrame:
    """Kept words of the lower-cased ``text`` of each row, in order, as array ``words``; NULL in place of
    words whose bit is not set in ``possible``.

    N-grams are to be built from it inside ``explode`` only: as a projection of its own, the optimizer would
    merge the two and split the text again for every n-gram.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    kept = F.filter(words, lambda w: w.rlike(word_rule) & ~w.isin(*stop_words))
    if possible is not None:
        docs, kept = docs.withColumn("_possible", possible), _only_possible(kept)
    return docs.select(*keys, kept.alias("words"))


def _only_possible(words: str | Column) -> Column:
    """``words`` with NULL in place of those whose bit is not set in the column ``_possible``."""
    bit = lambda w: F.getbit(F.get("_possible", F.shiftright(_word_bit(w), 6).cast("int")), (_word_bit(w) % 64).cast("int"))
    return F.transform(words, lambda w: F.when(bit(w) == 1, w))


def grams_of(words: DataFrame, keys: Sequence[str], longest: int) -> DataFrame:
    """The n-grams of :func:`ngrams` as rows (keys, term), from a table with ``keys`` and ``words`` that is staged already."""
    word = F.col("words")
    longer = [F.concat(F.col("w"), *[p for j in range(1, n) for p in (F.lit(" "), F.get(word, F.col("i") + j))]) for n in range(2, longest + 1)]
    starts = words.select(*keys, "words", F.posexplode("words").alias("i", "w")).where(F.col("w").isNotNull())
    return starts.select(*keys, F.explode(F.array("w", *longer)).alias("term")).where(F.col("term").isNotNull())


def word_stats(words: DataFrame) -> DataFrame:
    """Occurrences ``total`` and documents ``df`` of each single word, summed together and combined per task before one
    shuffle on the word."""
    every = words.select(F.explode("words").alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))
    once = words.select(F.explode(F.array_distinct("words")).alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))
    return every.unionByName(once).groupBy("term").agg(F.sum("tf").alias("total"), F.sum("df").alias("df"))


def vocabulary(stats: DataFrame, docs: Column, max_df: float, min_df: int, max_features: int) -> DataFrame:
    """The most frequent terms (ties: alphabetical) that occur in at least ``min_df`` documents and at most
    a share ``max_df`` of the ``docs`` documents, with their smoothed inverse document frequency."""
    usable = stats.withColumn("docs", docs).where((F.col("df") >= min_df) & (F.col("df") <= F.col("docs") * max_df))
    best = usable.orderBy(F.col("total").desc(), "term").limit(max_features)
    return best.withColumn("idf", F.log((F.col("docs") + 1.0) / (F.col("df") + 1.0)) + 1.0)


#: Bits of the filter for words that vocabulary terms can consist of.
WORD_BITS = 1 << 18


def _word_bit(word: str | Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(WORD_BITS))


def least_frequency(stats: DataFrame, docs: Column, max_df: float, min_df: int, max_features: int) -> int:
    """Occurrences below which no term is in the vocabulary, by the :func:`word_stats`.

    An n-gram is never more frequent than its rarest word. Once ``max_features`` single words qualify, terms less frequent than
    the last of them are out, and so is every n-gram with such a word; with fewer, only a term's documents bound it.
    """
    single = vocabulary(stats, docs, max_df, min_df, max_features).agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("floor")).first()
    return min_df if single["n"] < max_features else max(min_df, single["floor"])


def _word_bits(kept: DataFrame) -> Column:
    """Bits of the words in column ``term``, as an array of WORD_BITS / 64 numbers."""
    kept = kept.withColumn("_bit", _word_bit("term"))
    cells = kept.groupBy(F.shiftright("_bit", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_bit % 64 AS INT))")).alias("bits"))
    every = kept.sparkSession.range(WORD_BITS // 64).withColumnRenamed("id", "cell").join(cells, "cell", "left")
    listed = every.agg(F.sort_array(F.collect_list(F.struct("cell", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))).alias("l"))
    return stage(listed.select(F.transform("l", lambda c: c["bits"]).alias("bits"))).scalar()


def tfidf(
    docs: DataFrame, key: str, longest: int = 3, word_rule: str = STANDARD, max_df: float = 0.85, min_df: int = 2,
    max_features: int = 500, stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """Length-normalised tf-idf weights: one row per document and vocabulary term.

    The texts are split once. Words that no vocabulary term can consist of are then left out, by a filter in which words that
    share a bit are counted in vain, so that most n-grams are never built. Only terms as frequent as the vocabulary's are
    shuffled by document.
    """
    total = docs.agg(F.count(F.lit(1))).scalar()
    words = stage(words_of(docs, [key], word_rule, stop_words))
    stats = stage(word_stats(words))
    floor = least_frequency(stats, total, max_df, min_df, max_features)
    possible = _word_bits(stats.where(F.col("total") >= floor))
    kept = stage(words.withColumn("_possible", possible).select(key, _only_possible("words").alias("words")))
    frequent = grams_of(kept, [], longest).groupBy("term").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= floor)
    listed = grams_of(kept, [key], longest).join(stage(frequent).select("term"), "term")
    # At most one row per document and frequent term.
    counts = stage(listed.repartition(key).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))
    vocab = vocabulary(counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")), total, max_df, min_df, max_features)
    weighted = counts.join(vocab.select("term", "idf"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    # At most max_features rows per document.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("w") / norm).alias("weight"))


def tfidf_aggressive(docs: DataFrame, key: str, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    return tfidf(docs, key, 2, AGGRESSIVE, 0.9, 1, 300, stop_words)


def least_classes(documents: int) -> int:
    """In how many topics a term must occur: two above 300 documents, else one."""
    return 2 if documents > 300 else 1


def _scored(counts: DataFrame, min_classes: int, mean_words: Column) -> DataFrame:
    kept = counts.where(F.col("classes") >= min_classes).withColumn("mean_words", mean_words)
    return kept.select("topic", "term", (F.col("tf") * F.log(1.0 + F.col("mean_words") / F.col("total"))).alias("weight"))


def _counted(terms: DataFrame) -> DataFrame:
    """(topic, term, tf, total, classes) of the occurrences (topic, term)."""
    over = Window.partitionBy("term")
    counts = terms.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("tf"))
    return counts.withColumns({"total": F.sum("tf").over(over), "classes": F.count(F.lit(1)).over(over)})


def ctfidf(segments: DataFrame, min_classes: int = 1, longest: int = 3, stop_words: Sequence[str] = STOP_WORDS, best: int | None = None) -> DataFrame:
    """Distinctive terms per topic: tf * ln(1 + mean words per topic / frequency over all topics).

    Terms are counted per topic with map-side combining, so a topic with most of the text is not a hot spot.
    ``min_classes`` is the number of topics a term must occur in. With ``best``, terms may be left out that cannot be among
    the ``best`` of any topic, also after rounding to six digits; then n-grams are shuffled once and as hashes of 64 bits (two
    n-grams that share one count as one term in the mean number of words, and nowhere else).
    """
    words = words_of(segments.where(F.col("topic") != -1), ["topic"], AGGRESSIVE, stop_words)
    if best is not None:
        return _best_ctfidf(stage(words), min_classes, longest, best)
    totals = stage(_counted(words.select("topic", F.explode(ngrams("words", longest)).alias("term"))))
    topics = totals.agg(F.count_distinct("topic")).scalar()
    return _scored(totals, min_classes, totals.where(F.col("classes") >= min_classes).agg(F.sum("tf")).scalar() / topics)


def _best_ctfidf(words: DataFrame, min_classes: int, longest: int, best: int) -> DataFrame:
    """As :func:`ctfidf`, from the staged ``words`` (topic, words).

    A term of total N weighs at most N ln(1 + mean / N), and an n-gram is never more frequent than its rarest word. The ``best``
    single words of each topic, weighed with the mean of single words alone, bound N from below: of two terms the more frequent one
    only gains on the other as the mean grows. So only n-grams of words from that bound on are counted as terms.
    """
    single = stage(_counted(words.select("topic", F.explode("words").alias("term"))))
    topics = single.agg(F.count_distinct("topic")).scalar()
    kept = single.where(F.col("classes") >= min_classes)
    seen = kept.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words")).select("words", topics.alias("topics")).first()
    mean = seen["words"] / max(1, seen["topics"])
    ranked = _scored_words(kept, mean).withColumn("rank", F.row_number().over(ordered(["topic"], F.col("weight").desc(), "term"))).where(F.col("rank") <= best)
    of_topic = ranked.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("weight"), F.min("total").alias("total"))
    low = of_topic.agg(F.count_if(F.col("n") == best).alias("full"), F.min("weight").alias("weight"), F.min("total").alias("total")).first()
    floor = _least_total(mean, low["weight"], low["total"]) if low["full"] == seen["topics"] > 0 else 0
    mass = _kept_grams(words, min_classes, longest)
    terms = words.withColumn("_possible", _word_bits(single.where(F.col("total") >= floor))).select("topic", _only_possible("words").alias("words"))
    counts = _counted(terms.select("topic", F.explode(ngrams("words", longest)).alias("term")))
    return _scored(counts, min_classes, mass.scalar() / F.lit(seen["topics"]))


def _scored_words(kept: DataFrame, mean: float) -> DataFrame:
    return kept.select("topic", "term", "total", (F.col("tf") * F.log(1.0 + F.lit(mean) / F.col("total"))).alias("weight"))


def _least_total(mean: float, weight: float, total: int) -> int:
    """Total below which a term weighs less than ``weight``, by a margin that rounding cannot close; at most ``total``."""
    if weight < 0.01:
        return 0
    low, high = 0, total
    while low < high:
        mid = (low + high + 1) // 2
        below = mid - 1
        if below == 0 or below * np.log1p(mean / below) * 1.001 < weight:
            low = mid
        else:
            high = mid - 1
    return low


def _kept_grams(words: DataFrame, min_classes: int, longest: int) -> DataFrame:
    """Occurrences of all n-grams that occur in at least ``min_classes`` topics, as one row."""
    word = F.col("words")
    if min_classes <= 1:
        return words.agg(F.sum(sum((F.greatest(F.size(word) - n, F.lit(0)) for n in range(1, longest)), F.greatest(F.size(word), F.lit(0)))))

    def of(n: int) -> Column:
        starts = F.when(F.size(word) >= n, F.sequence(F.lit(0), F.size(word) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(word, i + j) for j in range(n)]))

    grams = words.select("topic", F.explode(F.concat(*[of(n) for n in range(1, longest + 1)])).alias("gram"))
    # Two topics show in the least and the greatest one; only more have to be listed.
    classes = F.size(F.collect_set("topic")) >= min_classes if min_classes > 2 else F.min("topic") < F.max("topic")
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), classes.alias("kept")).where("kept").agg(F.sum("n"))


def topic_words(weights: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` terms per topic by weight (ties: alphabetical)."""
    rank = F.row_number().over(ordered(["topic"], F.col("weight").desc(), "term"))
    return weights.withColumn("rank", rank).where(F.col("rank") <= k).select("topic", "rank", "term", "weight")


def adaptive_keywords(words: DataFrame) -> DataFrame:
    """Six, four or three words per topic when there are at most 4, at most 8, or more topics."""
    topics = words.agg(F.count_distinct("topic")).scalar()
    limit = F.when(topics <= 4, 6).when(topics <= 8, 4).otherwise(3)
    return words.where(F.col("rank") <= limit)


def top_topics(sizes: DataFrame, k: int = 6) -> DataFrame:
    return sizes.orderBy(F.col("n").desc(), "topic").limit(k)


def word_lists(words: DataFrame) -> DataFrame:
    """One row per topic with its ranked words as an array."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda w: w["term"])
    return words.groupBy("topic").agg(listed.alias("words"))


def keyword_labels(words: DataFrame, skip: Sequence[str] = LABEL_SKIP) -> DataFrame:
    """Label per topic from its first three words longer than three letters that are not skipped and do not
    repeat an earlier one (or its singular); "Topic n" (from 1) if there is none."""
    start = F.struct(F.array().cast("array<string>").alias("words"), F.array().cast("array<string>").alias("seen"))

    def take(state: Column, word: Column) -> Column:
        low = F.lower(word)
        good = (F.length(word) > 3) & ~low.isin(*skip) & ~F.array_contains(state["seen"], low) & (F.size(state["words"]) < 3)
        grown = F.struct(
            F.array_append(state["words"], word).alias("words"),
            F.concat(state["seen"], F.array(low, singular(low))).alias("seen"),
        )
        return F.when(good, grown).otherwise(state)

    listed = word_lists(words.where(F.col("rank") <= 10))
    chosen = listed.withColumn("_chosen", F.aggregate("words", start, take)["words"])
    label = F.when(F.size("_chosen") > 0, beautify_label(F.array_join("_chosen", "_"))).otherwise(
        F.concat(F.lit("Topic "), F.col("topic") + 1)
    )
    return chosen.select("topic", label.alias("label"))


def noise_topic_flag(words: DataFrame, noise: Sequence[str] = NOISE_WORDS) -> DataFrame:
    """Topics in which at least three of the first six words contain a noise word are unclear."""
    hits = F.lower("term").contains(noise[0])
    for n in noise[1:]:
        hits = hits | F.lower("term").contains(n)
    counted = words.where(F.col("rank") <= 6).groupBy("topic").agg(F.count_if(hits).alias("noise_words"))
    unclear = F.col("noise_words") >= 3
    return counted.withColumn("is_noise", unclear).withColumn(
        "noise_label", F.when(unclear, F.concat(F.lit("Misc / Unclear "), F.col("topic")))
    )


def unique_labels(labels: DataFrame, words: DataFrame) -> DataFrame:
    """Final labels: a missing one becomes the top three words in title case, more than five words are cut
    to four, and repeated ones (in topic order, any case) get the topic number."""
    joined = labels.join(word_lists(words.where(F.col("rank") <= 3)), "topic", "left")
    base = F.coalesce(F.when(F.trim("label") != "", F.col("label")), F.initcap(F.array_join("words", ", ")), F.lit("Topic"))
    parts = F.split(F.col("_base"), r"\s+")
    short = F.when(F.size(parts) > 5, F.array_join(F.slice(parts, 1, 4), " ")).otherwise(F.col("_base"))
    named = joined.withColumn("_base", base).withColumn("_base", short)
    again = F.row_number().over(ordered([F.lower("_base")], "topic")) > 1
    return named.select(
        "topic", F.when(again, F.concat("_base", F.lit(" ("), F.col("topic"), F.lit(")"))).otherwise(F.col("_base")).alias("label")
    )


# --- topic quality -----------------------------------------------------------------------------------

def topic_pairs(topics: DataFrame) -> DataFrame:
    """Unordered pairs of rows of a size-checked topic table; columns get the suffixes _a and _b."""
    columns = topics.columns
    others = small_list(topics.select(F.struct("topic", *[c for c in columns if c != "topic"]).alias("s")), F.col("s"))
    paired = topics.withColumn("_others", others).withColumn(
        "_b", F.explode(F.filter("_others", lambda o: o["topic"] > F.col("topic")))
    )
    return paired.select(*[F.col(c).alias(f"{c}_a") for c in columns], *[F.col(f"_b.{c}").alias(f"{c}_b") for c in columns])


def topic_diversity(words: DataFrame, top: int = 5) -> DataFrame:
    """Mean Jaccard distance of the topics' top words over all pairs (0 for fewer than two topics)."""
    pairs = topic_pairs(word_lists(words.where(F.col("rank") <= top)))
    shared = F.size(F.array_intersect("words_a", "words_b")) / F.size(F.array_union("words_a", "words_b"))
    return pairs.agg(F.coalesce(F.avg(1.0 - shared), F.lit(0.0)).alias("diversity"))


def topic_coverage(doc_weights: DataFrame, confident: float = 0.2) -> DataFrame:
    """Share of documents whose largest topic weight (column ``max_weight``) exceeds ``confident``."""
    return doc_weights.agg(F.avg((F.col("max_weight") > confident).cast("double")).alias("coverage"))


def topic_balance(sizes: DataFrame) -> DataFrame:
    """1 for equally large topics, down to 0 as sizes deviate from the mean."""
    everything = Window.partitionBy()
    ideal = 1.0 / F.count(F.lit(1)).over(everything)
    off = sizes.select((F.abs(F.col("n") / F.sum("n").over(everything) - ideal) / ideal).alias("off"))
    return off.agg(F.greatest(F.lit(0.0), 1.0 - F.avg("off")).alias("balance"))


def topic_quality(words: DataFrame, doc_weights: DataFrame, sizes: DataFrame) -> DataFrame:
    """0.4 diversity + 0.3 coverage + 0.3 balance; 0 for fewer than two topics."""
    parts = sizes.agg(F.count(F.lit(1)).alias("topics")).select(
        "topics", topic_diversity(words).scalar().alias("diversity"), topic_coverage(doc_weights).scalar().alias("coverage"),
        topic_balance(sizes).scalar().alias("balance"),
    )
    score = 0.4 * F.col("diversity") + 0.3 * F.col("coverage") + 0.3 * F.col("balance")
    return parts.withColumn("quality", F.when(F.col("topics") >= 2, score).otherwise(0.0))


# --- vectors -----------------------------------------------------------------------------------------

def centroids(vectors: DataFrame, by: str = "topic") -> DataFrame:
    """Mean vector and size per ``by``, combined map-side."""
    vec = array_to_vector("embedding")
    means = vectors.groupBy(by).agg(Summarizer.mean(vec).alias("_m"), F.count(F.lit(1)).alias("n"))
    return means.select(by, vector_to_array("_m").alias("embedding"), "n")


def length_of(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))


def scored_against(vectors: DataFrame, prototypes: DataFrame, name: str) -> DataFrame:
    """Adds ``scores``: cosine to each row of a size-checked prototype table, as structs (name, score)."""
    proto = F.struct(name, F.col("embedding").alias("p"), length_of(F.col("embedding")).alias("len"))
    prepared = vectors.withColumns({"_protos": small_list(prototypes.select(proto.alias("s")), F.col("s")), "_len": length_of(F.col("embedding"))})

    def score(p: Column) -> Column:
        lengths = F.col("_len") * p["len"]
        cosine = F.when(lengths > 0, dot(F.col("embedding"), p["p"]) / lengths).otherwise(0.0)
        return F.struct(p[name].alias(name), cosine.alias("score"))

    return prepared.withColumn("scores", F.transform("_protos", score)).drop("_protos", "_len")


def category_similarity(vectors: DataFrame, prototypes: DataFrame, name: str = "category") -> DataFrame:
    """Cosine of every vector to every category."""
    scored = scored_against(vectors, prototypes, name)
    return scored.select("item_id", F.explode("scores").alias("s")).select("item_id", f"s.{name}", "s.score")


def best_of(scores: str | Column, name: str) -> Column:
    """Struct of the highest score (ties: the first entry)."""
    col = F.col(scores) if isinstance(scores, str) else scores
    top = F.array_max(F.transform(col, lambda s: s["score"]))
    return F.get(F.filter(col, lambda s: s["score"] == top), F.lit(0))


def zero_shot_classify(
    vectors: DataFrame, prototypes: DataFrame, name: str = "category", threshold: float = ZERO_SHOT_THRESHOLD
) -> DataFrame:
    """Most similar category, "Unclassified" unless its cosine exceeds the threshold."""
    best = scored_against(vectors, prototypes, name).select("item_id", best_of("scores", name).alias("b"))
    confident = F.col("b.score") > threshold
    return best.select(
        "item_id", F.when(confident, F.col(f"b.{name}").cast("string")).otherwise("Unclassified").alias("category"),
        F.col("b.score").alias("score"), confident.alias("is_confident"),
    )


def reassign_outliers(assigned: DataFrame, threshold: float = OUTLIER_THRESHOLD) -> DataFrame:
    """Outliers (topic -1) take the topic with the most similar centroid if its cosine reaches the threshold.

    ``assigned``: item_id, embedding, topic.
    """
    means = centroids(assigned.where(F.col("topic") != -1)).select("topic", "embedding")
    scored = scored_against(assigned.withColumnRenamed("topic", "old"), means, "topic")
    best = best_of("scores", "topic")
    chosen = F.when((F.col("old") == -1) & (F.col("b.score") >= threshold), F.col("b.topic")).otherwise(F.col("old"))
    return scored.withColumn("b", best).select(
        "item_id", F.col("old").alias("topic_before"), chosen.alias("topic"), F.when(F.col("old") == -1, F.col("b.score")).alias("score")
    )


# --- clustering --------------------------------------------------------------------------------------

def _as_features(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("features", array_to_vector("embedding"))


def kmeans_multiscale(vectors: DataFrame, ks: Sequence[int] = K_VALUES, seed: int = 42) -> DataFrame:
    """Cluster of every item at each scale k smaller than the number of items (none below three items).

    Centres are part of the result (``center``), so that clusters can be named.
    """
    items = _as_features(stage(vectors))
    n = items.count()
    out = None
    for k in [k for k in ks if n >= 3 and k < n]:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(items)
        centers = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
        one = model.transform(items).withColumn("k", F.lit(k)).withColumn("center", F.get(centers, F.col("cluster"))).drop("features")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else items.drop("features").withColumns(
        {"cluster": F.lit(0), "k": F.lit(0), "center": F.col("embedding")}
    ).limit(0)


def cluster_medoid_label(clustered: DataFrame, keys: Sequence[str] = ("k", "cluster")) -> DataFrame:
    """Names a cluster after the member nearest to its centre: its first four words and "..."."""
    gap = euclidean(F.col("embedding"), F.col("center"))
    words = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 4), " ")
    nearest = clustered.withColumn("_gap", gap).groupBy(*keys).agg(
        F.min_by(F.struct("item_id", words.alias("label")), F.struct("_gap", "item_id")).alias("m"), F.count(F.lit(1)).alias("n")
    )
    return nearest.select(*keys, "n", F.col("m.item_id").alias("medoid"), F.concat("m.label", F.lit("...")).alias("label"))


def pca_2d(vectors: DataFrame, scale: float = 10.0) -> DataFrame:
    """First two principal components, z-scored and scaled; zeros where the data has no spread.

    The components' signs are arbitrary.
    """
    items = _as_features(vectors)
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(items)
    flat = model.transform(items).withColumn("_pc", vector_to_array("pc")).withColumns(
        {"pc1": F.get("_pc", F.lit(0)), "pc2": F.get("_pc", F.lit(1))}
    ).drop("features", "pc", "_pc")
    stats = flat.agg(*[f(c).alias(f"{n}_{c}") for c in ("pc1", "pc2") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    moments = stats.select(F.struct("*").alias("s")).scalar()
    spread = flat.withColumn("_s", moments)
    z = lambda c: (F.col(c) - F.col(f"_s.m_{c}")) / (F.col(f"_s.s_{c}") + 1e-8) * scale
    return spread.withColumns({"x": F.coalesce(z("pc1"), F.lit(0.0)), "y": F.coalesce(z("pc2"), F.lit(0.0))}).drop("pc1", "pc2", "_s")


def topic_assign(vectors: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """Topic of every item: clusters below the minimum size become outliers (-1).

    Fewer than five items form one topic. The minimum is n/20 (at least 2) below 200 items, else 8.
    """
    items = _as_features(stage(vectors))
    n = items.count()
    if n < 5:
        return items.drop("features").withColumns({"topic": F.lit(0), "score": F.lit(1.0)})
    least = max(2, n // 20) if n < 200 else 8
    model = KMeans(k=min(k, n - 1), seed=seed, featuresCol="features", predictionCol="cluster").fit(items)
    sizes = model.summary.clusterSizes
    kept = [i for i, size in enumerate(sizes) if size >= least]
    centers = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    placed = model.transform(items).drop("features")
    score = cosine_similarity(F.col("embedding"), F.get(centers, F.col("cluster")))
    return placed.withColumns(
        {"topic": F.when(F.col("cluster").isin(*kept), F.col("cluster")).otherwise(-1), "score": score}
    ).drop("cluster")


def merge_topics(means: DataFrame, max_topics: int = 15, same: float = 0.9, documents: int | None = None) -> DataFrame:
    """Merged topic of each topic (columns topic, merged).

    Topics beyond the ``max_topics`` largest join the most similar larger one; topics whose centroids are
    more similar than ``same``, directly or through others, then become one (named after the lowest). The
    second step spreads minimum labels along the similar pairs until nothing changes.
    ``means``: topic, embedding, n. The number of ``documents``, where given, decides on the first step: it is taken
    above 100 only.
    """
    means = stage(means)
    if documents is not None and documents <= 100:
        max_topics = means.count()
    rank = F.row_number().over(ordered([], F.col("n").desc(), "topic"))
    ranked = means.withColumn("_rank", rank)
    large = ranked.where(F.col("_rank") <= max_topics).select(F.col("topic").alias("target"), "embedding")
    nearest = scored_against(ranked.select("topic", "_rank", "embedding"), large, "target")
    base = stage(nearest.select(
        "topic", F.when(F.col("_rank") <= max_topics, F.col("topic")).otherwise(best_of("scores", "target")["target"]).alias("label")
    ))
    cosine = cosine_similarity(F.col("embedding_a"), F.col("embedding_b"))
    pairs = topic_pairs(large.withColumnRenamed("target", "topic")).where(cosine > same)
    both = F.explode(F.array(F.struct(F.col("topic_a").alias("a"), F.col("topic_b").alias("b")), F.struct(F.col("topic_b").alias("a"), F.col("topic_a").alias("b"))))
    edges = stage(pairs.select(both.alias("e")).select("e.*"))
    merged = stage(large.select(F.col("target").alias("topic"), F.col("target").alias("merged")))
    for _ in range(max_topics):
        offered = edges.join(merged, edges["b"] == merged["topic"]).groupBy("a").agg(F.min("merged").alias("offer"))
        step = stage(merged.join(offered, merged["topic"] == offered["a"], "left").select(
            "topic", F.least("merged", F.coalesce("offer", "merged")).alias("merged"),
            (F.col("offer") < F.col("merged")).alias("moved"),
        ))
        merged = step.select("topic", "merged")
        if step.where("moved").isEmpty():
            break
    return base.join(merged.select(F.col("topic").alias("label"), "merged"), "label").select("topic", "merged")


# --- topic graph -------------------------------------------------------------------------------------

def similarity_edges(coords: DataFrame, limit: float = 0.5) -> DataFrame:
    """Pairs of topics closer than ``limit`` times the largest distance to the common centre.

    ``coords``: topic, x, y.
    """
    centre = coords.agg(F.struct(F.avg("x").alias("x"), F.avg("y").alias("y")).alias("c"))
    placed = coords.withColumn("_c", centre.scalar())
    radius = placed.agg(F.max(F.hypot(F.col("x") - F.col("_c.x"), F.col("y") - F.col("_c.y")))).scalar()
    gap = F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b"))
    scaled = topic_pairs(coords.select("topic", "x", "y")).withColumn("_r", radius)
    rated = scaled.withColumn("distance", gap / F.when(F.col("_r") > 0, F.col("_r")).otherwise(1.0))
    return rated.where(F.col("distance") < limit).select("topic_a", "topic_b", "distance")


def graph_nodes(words: DataFrame, sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """Topic nodes sized by their segments, and one node per keyword."""
    topics = sizes.join(labels, "topic").select(
        F.concat(F.lit("T_"), F.col("topic")).alias("node"), F.lit("topic").alias("kind"), "label", F.col("n").cast("double").alias("size")
    )
    used = adaptive_keywords(words).where(F.length("term") >= 2)
    keywords = used.groupBy("term").agg(F.lit(4.0).alias("size")).select(
        F.concat(F.lit("K_"), F.col("term")).alias("node"), F.lit("keyword").alias("kind"), F.col("term").alias("label"), "size"
    )
    return topics.unionByName(keywords)


def graph_edges(words: DataFrame, coords: DataFrame, limit: float = 0.4) -> DataFrame:
    """Topic-keyword edges and edges between topics that lie close after scaling to [-1, 1]."""
    used = adaptive_keywords(words).where(F.length("term") >= 2)
    definition = used.select(
        F.concat(F.lit("T_"), F.col("topic")).alias("source"), F.concat(F.lit("K_"), F.col("term")).alias("target"),
        F.lit("definition").alias("kind"), (F.greatest(F.col("weight"), F.lit(0.1)) * 5.0).alias("weight"),
    )
    everything = Window.partitionBy()
    low, high = lambda c: F.min(c).over(everything), lambda c: F.max(c).over(everything)
    scale = lambda c: ((F.col(c) - low(c)) / F.when(high(c) > low(c), high(c) - low(c)).otherwise(1.0) - 0.5) * 2.0
    scaled = coords.select("topic", scale("x").alias("x"), scale("y").alias("y"))
    gap = F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b"))
    close = topic_pairs(scaled).withColumn("d", gap).where(F.col("d") < limit)
    similar = close.select(
        F.concat(F.lit("T_"), F.col("topic_a")).alias("source"), F.concat(F.lit("T_"), F.col("topic_b")).alias("target"),
        F.lit("similarity").alias("kind"), ((1.0 - F.col("d")) * 2.0).alias("weight"),
    )
    return definition.unionByName(similar)


# --- non-negative factors ----------------------------------------------------------------------------

def nmf_rows(weights: DataFrame, key: str, documents: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Sparse rows (key, idx, w) of a tf-idf table and the vocabulary (at most a few hundred terms).

    With ``documents`` (key), those without a term have an empty row.
    """
    terms = [r["term"] for r in weights.select("term").distinct().orderBy("term").collect()]
    place = weights.sparkSession.createDataFrame(list(enumerate(terms)), "i int, term string")
    rows = weights.join(place, "term").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "weight"))).alias("cells"))
    if documents is not None:
        rows = documents.select(key).join(rows, key, "left").withColumn("cells", F.coalesce("cells", F.array().cast(rows.schema["cells"].dataType)))
    return rows.select(key, F.col("cells.i").alias("idx"), F.col("cells.weight").alias("w")), terms


def nmf_size(documents: int) -> int:
    """Number of topics of the aggressive form."""
    return min(4, max(2, documents // 4))


#: Rows that are solved together: made dense, they stay in the cache.
BLOCK_ROWS = 512


def row_blocks(rows: DataFrame) -> DataFrame:
    """The rows (idx, w) as blocks of bytes (ends, idx, w), so that a round takes no step per row or number to read them."""

    def pack(batches, size=BLOCK_ROWS):
        for pdf in batches:
            for start in range(0, len(pdf), size):
                idx, w = pdf["idx"].iloc[start : start + size], pdf["w"].iloc[start : start + size]
                ends = np.cumsum([0, *map(len, w)])
                yield pd.DataFrame({
                    "ends": [ends.astype("<i4").tobytes()], "idx": [np.concatenate(idx.to_list()).astype("<i4").tobytes()],
                    "w": [np.concatenate(w.to_list()).astype("<f8").tobytes()],
                })

    return rows.select("idx", "w").mapInPandas(pack, "ends binary, idx binary, w binary")


def row_solver(h: np.ndarray, ridge: float) -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Function from sparse rows (ends, idx, w) to (W, W'X), W >= 0 minimising |X - W' h|^2 + ridge |W|^2; W has a column per row.

    Built on the driver so that it travels to the executors by value.
    """
    k, width = h.shape
    gram = h @ h.T + ridge * np.eye(k)
    unit = gram / gram.diagonal()[:, None]

    def solve(ends: np.ndarray, idx: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(ends) - 1, width))
        x[np.repeat(np.arange(len(x)), np.diff(ends)), idx] = values
        target = h @ x.T
        w = np.maximum(np.linalg.solve(gram, target), 0.0)
        target /= gram.diagonal()[:, None]
        for _ in range(30):
            for j in range(k):
                np.maximum(w[j] + (target[j] - unit[j] @ w), 0.0, out=w[j])
        return w, w @ x

    return solve


def nmf_topics(
    weights: DataFrame, key: str, k: int, max_iter: int = 200, alpha: float = 0.1, tol: float = 1e-3, seed: int = 42, documents: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Non-negative factors of a tf-idf table: (document topics, topic words).

    Alternating least squares with squared penalties. The topic-by-term matrix H is small and travels with
    the tasks; each round solves the document weights in parallel and sums only W'X and W'W, so documents
    never leave their partition. Stops when H changes by less than ``tol`` of its size. Of ``documents``, those without a
    term get topic 0 with weight 0.
    """
    rows, terms = nmf_rows(stage(weights), key, documents)
    rows = stage(rows)
    blocks = row_blocks(rows).persist(StorageLevel.MEMORY_AND_DISK)
    width = len(terms)
    h = np.random.default_rng(seed).random((k, width)) / np.sqrt(width)
    sums = StructType([StructField("i", IntegerType()), StructField("row", ArrayType(DoubleType()))])
    for _ in range(max_iter):
        solve = row_solver(h, alpha)

        def partial(batches):
            left, gram = np.zeros((k, width)), np.zeros((k, k))
            for pdf in batches:
                for ends, idx, values in zip(pdf["ends"], pdf["idx"], pdf["w"]):
                    w, part = solve(np.frombuffer(ends, "<i4"), np.frombuffer(idx, "<i4"), np.frombuffer(values, "<f8"))  # noqa: B023
                    left += part
                    gram += w @ w.T
            yield pd.DataFrame({"i": range(k), "row": [np.concatenate([left[i], gram[i]]).tolist() for i in range(k)]})

        parts = blocks.mapInPandas(partial, sums)
        cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
        total = np.zeros((k, width + k))
        for cell in cells.collect():
            total[cell["i"], cell["j"]] = cell["v"]
        left, gram = total[:, :width], total[:, width:] + alpha * np.eye(k)
        old = h.copy()
        for _ in range(10):
            for j in range(k):
                h[j] = np.maximum(h[j] + (left[j] - gram[j] @ h) / gram[j, j], 0.0)
        if np.linalg.norm(h - old) <= tol * max(np.linalg.norm(old), 1e-12):
            break
    blocks.unpersist()
    solve = row_solver(h, alpha)

    def assign(batches):
        for pdf in batches:
            w, _ = solve(np.cumsum([0, *map(len, pdf["w"])]), np.concatenate(pdf["idx"].to_list()).astype(int), np.concatenate(pdf["w"].to_list()))
            yield pd.DataFrame({key: pdf[key], "topic": w.argmax(axis=0).astype("int32"), "max_weight": w.max(axis=0)})

    fields = [rows.schema[key], StructField("topic", IntegerType()), StructField("max_weight", DoubleType())]
    cells = [(t, terms[i], float(h[t, i])) for t in range(k) for i in range(width)]
    words = weights.sparkSession.createDataFrame(cells, "topic int, term string, weight double")
    return rows.mapInPandas(assign, StructType(fields)), words
