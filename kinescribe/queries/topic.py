"""Term, vector, clustering and topic-graph queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescribe import fixtures
from kinescribe.operators import episodes as ep
from kinescribe.operators import summaries, topics
from kinescribe.operators.transcript import STOP_WORDS
from kinescribe.plans.staging import stage
from kinescribe.queries.base import query, r, sr, with_
from kinescribe.queries.episode import motion_of
from kinescribe.queries.speech import F4, f4
from kinescribe.sources import library

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _terms_cte(source: str, keys: str, rule: str, longest: int) -> str:
    grams = ["SELECT {k}, w[i] AS term FROM tw1 WHERE i <= LEN(w)".format(k=keys)]
    for n in range(2, longest + 1):
        joined = " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
        grams.append(f"SELECT {keys}, {joined} AS term FROM tw1 WHERE i + {n - 1} <= LEN(w)")
    return f"""tw AS (SELECT {keys}, LIST_FILTER(REGEXP_EXTRACT_ALL(LOWER(text), '[\\p{{L}}\\p{{N}}_]+'),
   lambda v: REGEXP_MATCHES(v, '{rule}') AND v NOT IN ({_STOP})) AS w FROM {source}),
tw1 AS (SELECT {keys}, w, UNNEST(RANGE(1, LEN(w) + 1)) AS i FROM tw),
tg AS ({' UNION ALL '.join(grams)}),
tc AS (SELECT {keys}, term, COUNT(*) AS tf FROM tg GROUP BY ALL)"""


def _tfidf_cte(rule: str, longest: int, max_df: float, min_df: int, features: int) -> str:
    return _terms_cte("documents", "doc_id", rule, longest) + f""",
vo AS (SELECT term, df, LN((nd + 1.0) / (df + 1.0)) + 1.0 AS idf FROM (SELECT term, SUM(tf) AS total, COUNT(*) AS df,
   (SELECT COUNT(*) FROM documents) AS nd FROM tc GROUP BY term) WHERE df >= {min_df} AND df <= nd * {max_df}::DOUBLE
   ORDER BY total DESC, term LIMIT {features}),
ti AS (SELECT doc_id, term, tf * idf / SQRT(SUM(tf*idf*tf*idf) OVER (PARTITION BY doc_id)) AS weight FROM tc JOIN vo USING (term))"""


_STANDARD = _tfidf_cte(topics.STANDARD, 3, 0.85, 2, 500)
_AGGRESSIVE = _tfidf_cte(topics.AGGRESSIVE, 2, 0.9, 1, 300)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.read(spark, sf, "documents").select("doc_id", "text")


@query("tfidf_terms", with_([_STANDARD], f"SELECT doc_id, term, {sr('weight')} FROM ti"))
def tfidf_terms(spark: SparkSession, sf: str) -> DataFrame:
    return topics.tfidf(docs(spark, sf), "doc_id").select("doc_id", "term", r("weight"))


@query("tfidf_terms_aggressive", with_([_AGGRESSIVE], f"SELECT doc_id, term, {sr('weight')} FROM ti"))
def tfidf_terms_aggressive(spark: SparkSession, sf: str) -> DataFrame:
    return topics.tfidf_aggressive(docs(spark, sf), "doc_id").select("doc_id", "term", r("weight"))


_CTFIDF = F4 + ", sg AS (SELECT topic, text FROM seg WHERE topic <> -1),\n" + _terms_cte("sg", "topic", topics.AGGRESSIVE, 3) + """,
ft AS (SELECT term, SUM(tf) AS total, COUNT(*) AS classes FROM tc GROUP BY term
   HAVING COUNT(*) >= (SELECT CASE WHEN COUNT(*) > 300 THEN 2 ELSE 1 END FROM sg)),
cw AS (SELECT topic, term, tf * LN(1.0 + (SELECT SUM(total) FROM ft) / (SELECT COUNT(DISTINCT topic) FROM tc) / total) AS weight
   FROM tc JOIN ft USING (term)),
tp0 AS (SELECT topic, CAST(ROW_NUMBER() OVER (PARTITION BY topic ORDER BY ROUND(weight, 6) DESC, term) AS INT) AS rank, term, ROUND(weight, 6) AS weight FROM cw),
tp AS (SELECT * FROM tp0 WHERE rank <= 10)"""


def ctfidf_words(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked topic words (weights rounded first, so that ties are broken alike everywhere)."""
    segments = docs(spark, sf).select(fixtures.topic_of("doc_id").alias("topic"), "text")
    least = topics.least_classes(segments.where("topic <> -1").count())
    weights = topics.ctfidf(segments, min_classes=least, best=10).withColumn("weight", F.round("weight", 6))
    return topics.topic_words(weights)


@query("ctfidf", with_([_CTFIDF], f"SELECT topic, rank, term, {sr('weight')} FROM tp"))
def ctfidf(spark: SparkSession, sf: str) -> DataFrame:
    return ctfidf_words(spark, sf).select("topic", "rank", "term", r("weight"))


@query("adaptive_keywords", with_([_CTFIDF], """SELECT topic, rank, term FROM tp WHERE rank <= (SELECT CASE WHEN COUNT(DISTINCT topic) <= 4 THEN 6
       WHEN COUNT(DISTINCT topic) <= 8 THEN 4 ELSE 3 END FROM tp)"""))
def adaptive_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return topics.adaptive_keywords(stage(ctfidf_words(spark, sf))).select("topic", "rank", "term")


@query("distinctive_words", with_([_CTFIDF, """best AS (SELECT topic, COUNT(*) AS n FROM seg WHERE topic <> -1 GROUP BY 1 ORDER BY n DESC, topic LIMIT 6)"""],
       f"SELECT topic, n, rank, term, {sr('weight')} FROM tp JOIN best USING (topic) WHERE rank <= 8"))
def distinctive_words(spark: SparkSession, sf: str) -> DataFrame:
    """Top eight words of the six largest topics."""
    largest = topics.top_topics(summaries.topic_sizes(f4(spark, sf, False)).select("topic", "n"))
    out = ctfidf_words(spark, sf).where(F.col("rank") <= 8).join(largest, "topic")
    return out.select("topic", "n", "rank", "term", r("weight"))


_SKIP = ", ".join(f"'{w}'" for w in topics.LABEL_SKIP)
_CAPITAL = "UPPER(v[1:1]) || LOWER(v[2:])"
_LABELS = f"""fold AS (SELECT topic, 0 AS i, []::VARCHAR[] AS ws, []::VARCHAR[] AS seen FROM (SELECT DISTINCT topic FROM tp)
 UNION ALL SELECT f.topic, f.i + 1,
   CASE WHEN LENGTH(t.term) > 3 AND LOWER(t.term) NOT IN ({_SKIP}) AND NOT LIST_CONTAINS(f.seen, LOWER(t.term)) AND LEN(f.ws) < 3
     THEN LIST_APPEND(f.ws, t.term) ELSE f.ws END,
   CASE WHEN LENGTH(t.term) > 3 AND LOWER(t.term) NOT IN ({_SKIP}) AND NOT LIST_CONTAINS(f.seen, LOWER(t.term)) AND LEN(f.ws) < 3
     THEN LIST_CONCAT(f.seen, [LOWER(t.term), REGEXP_REPLACE(LOWER(t.term), 's+$', '')]) ELSE f.seen END
   FROM fold f JOIN tp t ON t.topic = f.topic AND t.rank = f.i + 1),
lb AS (SELECT topic, CASE WHEN LEN(ws) = 0 THEN 'Topic ' || (topic + 1) ELSE ARRAY_TO_STRING(LIST_TRANSFORM(
   LIST_FILTER(STRING_SPLIT(ARRAY_TO_STRING(ws, '_'), '_'), lambda v: LENGTH(v) > 2)[1:3], lambda v: {_CAPITAL}), ' ') END AS label
   FROM (SELECT topic, ARG_MAX(ws, i) AS ws FROM fold GROUP BY topic))"""


@query("keyword_labels", "WITH RECURSIVE " + _CTFIDF + ",\n" + _LABELS + "\nSELECT topic, label FROM lb")
def keyword_labels(spark: SparkSession, sf: str) -> DataFrame:
    return topics.keyword_labels(ctfidf_words(spark, sf))


@query("unique_labels", "WITH RECURSIVE " + _CTFIDF + ",\n" + _LABELS + """,
       lc AS (SELECT topic, CASE WHEN topic % 3 = 0 THEN NULL WHEN topic % 3 = 1 THEN 'Shared name' ELSE label END AS label FROM lb),
       l3 AS (SELECT topic, STRING_AGG(term, ', ' ORDER BY rank) AS w FROM tp WHERE rank <= 3 GROUP BY topic),
       tc3 AS (SELECT topic, COALESCE(label, ARRAY_TO_STRING(LIST_TRANSFORM(STRING_SPLIT(w, ' '), lambda v: UPPER(v[1:1]) || LOWER(v[2:])), ' ')) AS b FROM lc JOIN l3 USING (topic)),
       cut AS (SELECT topic, CASE WHEN LEN(STRING_SPLIT(b, ' ')) > 5 THEN ARRAY_TO_STRING(STRING_SPLIT(b, ' ')[1:4], ' ') ELSE b END AS b FROM tc3)
       SELECT topic, CASE WHEN ROW_NUMBER() OVER (PARTITION BY LOWER(b) ORDER BY topic) > 1 THEN b || ' (' || topic || ')' ELSE b END AS label FROM cut""")
def unique_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Some labels are dropped and some made equal, to use every rule."""
    words = stage(ctfidf_words(spark, sf))
    label = F.when(F.col("topic") % 3 == 1, "Shared name").when(F.col("topic") % 3 == 2, F.col("label"))
    return topics.unique_labels(topics.keyword_labels(words).withColumn("label", label), words)


#: The texts are invented, so common syllables stand in for the filler words.
_PROBE_NOISE = ("the", "ing", "tion")


@query("noise_topics", with_([_CTFIDF], "SELECT topic, COUNT(*) FILTER (" + " OR ".join(f"CONTAINS(LOWER(term), '{w}')" for w in _PROBE_NOISE) + """)
       AS noise_words, noise_words >= 3 AS is_noise, CASE WHEN noise_words >= 3 THEN 'Misc / Unclear ' || topic END AS noise_label FROM tp WHERE rank <= 6 GROUP BY topic"""))
def noise_topics(spark: SparkSession, sf: str) -> DataFrame:
    return topics.noise_topic_flag(ctfidf_words(spark, sf), _PROBE_NOISE)


SEEDS = library.CATEGORY_NAMES


@query("seed_matches", with_(["sd AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(SEEDS)) + ") s(no, seed))",
       "sw AS (SELECT no, seed, UNNEST(STRING_SPLIT_REGEX(LOWER(REPLACE(seed, '/', ' ')), '\\s+')) AS w FROM sd)",
       "lb AS (SELECT p_partkey AS topic, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' design' WHEN p_partkey % 3 = 1 THEN 'feature ' || p_name ELSE p_name END AS label FROM part)"],
       """SELECT lb.topic, COALESCE(ARG_MIN(seed, no), MIN(label)) AS category FROM lb LEFT JOIN sw ON LENGTH(w) > 3 AND CONTAINS(LOWER(label), w) GROUP BY lb.topic"""))
def seed_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Part names with planted seed words as topic labels."""
    name, key = F.col("p_name"), F.col("p_partkey")
    label = F.when(key % 3 == 0, F.concat(name, F.lit(" design"))).when(key % 3 == 1, F.concat(F.lit("feature "), name)).otherwise(name)
    labels = fixtures.read(spark, sf, "part").select(key.alias("topic"), label.alias("label"))
    seeds = spark.createDataFrame(list(enumerate(SEEDS)), "seed_no int, seed string")
    return summaries.seed_match(labels, seeds).select("topic", "category")


# --- vectors -----------------------------------------------------------------------------------------

VEC = """vx AS (SELECT vec_id AS item_id, label AS topic, LIST_TRANSFORM(embedding, lambda e: CAST(e AS DOUBLE)) AS e FROM embeddings),
vd AS (SELECT item_id, topic, UNNEST(e) AS v, GENERATE_SUBSCRIPTS(e, 1) AS d FROM vx),
pd AS (SELECT topic, d, AVG(v) AS v FROM vd GROUP BY ALL),
pr AS (SELECT topic, LIST(v ORDER BY d) AS p FROM pd GROUP BY topic)"""
COS = "LIST_DOT_PRODUCT({a}, {b}) / (SQRT(LIST_DOT_PRODUCT({a}, {a})) * SQRT(LIST_DOT_PRODUCT({b}, {b})))"
SIM = f"sim AS (SELECT item_id, pr.topic AS category, vx.topic AS own, {COS.format(a='e', b='p')} AS score FROM vx, pr)"


def prototypes(spark: SparkSession, sf: str) -> DataFrame:
    return topics.centroids(fixtures.vectors(spark, sf)).withColumnRenamed("topic", "category")


@query("category_prototypes", with_([VEC], f"SELECT topic AS category, CAST(d - 1 AS INT) AS dim, {sr('v')} FROM pd"))
def category_prototypes(spark: SparkSession, sf: str) -> DataFrame:
    return prototypes(spark, sf).select("category", F.posexplode("embedding").alias("dim", "v")).select("category", "dim", r("v"))


@query("category_similarity", with_([VEC, SIM], f"SELECT item_id, category, {sr('score')} FROM sim"))
def category_similarity(spark: SparkSession, sf: str) -> DataFrame:
    out = topics.category_similarity(fixtures.vectors(spark, sf), prototypes(spark, sf))
    return out.select("item_id", "category", r("score"))


@query("zero_shot", with_([VEC, SIM, "b AS (SELECT item_id, ARG_MAX(category, score) AS c, MAX(score) AS s FROM sim GROUP BY 1)"],
       f"SELECT item_id, CASE WHEN s > 0.18 THEN CAST(c AS VARCHAR) ELSE 'Unclassified' END AS category, {sr('s', 'score')}, s > 0.18 AS is_confident FROM b"))
def zero_shot(spark: SparkSession, sf: str) -> DataFrame:
    out = topics.zero_shot_classify(fixtures.vectors(spark, sf), prototypes(spark, sf))
    return out.select("item_id", "category", r("score"), "is_confident")


@query("outlier_reassignment", with_([VEC, "px AS (SELECT topic, d, AVG(v) AS v FROM vd WHERE item_id % 5 <> 0 GROUP BY ALL)",
       "pq AS (SELECT topic, LIST(v ORDER BY d) AS p FROM px GROUP BY topic)",
       f"so AS (SELECT item_id, pq.topic AS t, {COS.format(a='e', b='p')} AS score FROM vx, pq WHERE item_id % 5 = 0)",
       "bo AS (SELECT item_id, ARG_MAX(t, score) AS t, MAX(score) AS s FROM so GROUP BY 1)"],
       f"""SELECT item_id, CASE WHEN item_id % 5 = 0 THEN -1 ELSE topic END AS topic_before, CASE WHEN item_id % 5 <> 0 THEN topic WHEN s >= 0.05 THEN t ELSE -1 END
       AS topic, {sr('s', 'score')} FROM vx LEFT JOIN bo USING (item_id)"""))
def outlier_reassignment(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth vector starts as an outlier."""
    topic = F.when(F.col("item_id") % 5 == 0, -1).otherwise(F.col("topic"))
    out = topics.reassign_outliers(fixtures.vectors(spark, sf).withColumn("topic", topic))
    return out.select("item_id", "topic_before", "topic", r("score"))


_COORDS = "xy AS (SELECT topic, p[1] * 100 AS x, p[2] * 100 AS y FROM pr)"


def coords(spark: SparkSession, sf: str) -> DataFrame:
    """First two centroid components as topic coordinates."""
    e = F.col("embedding")
    return topics.centroids(fixtures.vectors(spark, sf)).select("topic", (e[0] * 100).alias("x"), (e[1] * 100).alias("y"), "n")


@query("topic_edges", with_([VEC, _COORDS, "rd AS (SELECT MAX(SQRT(POWER(x-(SELECT AVG(x) FROM xy),2)+POWER(y-(SELECT AVG(y) FROM xy),2))) AS m FROM xy)"],
       f"""SELECT a.topic AS topic_a, b.topic AS topic_b, {sr('SQRT(POWER(a.x-b.x,2)+POWER(a.y-b.y,2))/m', 'distance', 5)} FROM xy a JOIN xy b ON a.topic < b.topic, rd
       WHERE SQRT(POWER(a.x-b.x,2)+POWER(a.y-b.y,2))/m < 0.5"""))
def topic_edges(spark: SparkSession, sf: str) -> DataFrame:
    out = topics.similarity_edges(stage(coords(spark, sf)))
    return out.select("topic_a", "topic_b", r("distance", 5))


@query("topic_graph", with_([VEC, _COORDS, _CTFIDF,
       "lm AS (SELECT CASE WHEN COUNT(DISTINCT topic) <= 4 THEN 6 WHEN COUNT(DISTINCT topic) <= 8 THEN 4 ELSE 3 END AS k FROM tp)",
       """sc AS (SELECT topic, ((x - MIN(x) OVER ()) / (MAX(x) OVER () - MIN(x) OVER ()) - 0.5) * 2 AS x,
       ((y - MIN(y) OVER ()) / (MAX(y) OVER () - MIN(y) OVER ()) - 0.5) * 2 AS y FROM xy)"""],
       f"""SELECT 'T_' || topic AS source, 'K_' || term AS target, 'definition' AS kind, {sr('GREATEST(weight, 0.1) * 5', 'weight', 4)} FROM tp, lm
       WHERE rank <= k AND LENGTH(term) >= 2 UNION ALL SELECT 'T_' || a.topic, 'T_' || b.topic, 'similarity',
       {sr('(1 - SQRT(POWER(a.x-b.x,2)+POWER(a.y-b.y,2))) * 2', 'weight', 4)} FROM sc a JOIN sc b ON a.topic < b.topic
       WHERE SQRT(POWER(a.x-b.x,2)+POWER(a.y-b.y,2)) < 0.4"""))
def topic_graph(spark: SparkSession, sf: str) -> DataFrame:
    out = topics.graph_edges(stage(ctfidf_words(spark, sf)), stage(coords(spark, sf)))
    return out.select("source", "target", "kind", r("weight", 4))


@query("topic_graph_nodes", with_([_CTFIDF, "sz AS (SELECT topic, COUNT(*) AS n FROM seg WHERE topic <> -1 GROUP BY 1)"],
       """SELECT 'T_' || topic AS node, 'topic' AS kind, 'Topic ' || topic AS label, CAST(n AS DOUBLE) AS size FROM sz UNION ALL
       SELECT DISTINCT 'K_' || term, 'keyword', term, 4.0::DOUBLE FROM tp WHERE LENGTH(term) >= 2 AND rank <= 4"""))
def topic_graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    sizes = summaries.topic_sizes(f4(spark, sf, False)).select("topic", "n")
    labels = sizes.select("topic", F.concat(F.lit("Topic "), F.col("topic")).alias("label"))
    return topics.graph_nodes(stage(ctfidf_words(spark, sf)), sizes, labels)


@query("topic_quality", with_([_CTFIDF, "w5 AS (SELECT topic, LIST(term) AS w FROM tp WHERE rank <= 5 GROUP BY topic)",
       "dv AS (SELECT AVG(1 - LEN(LIST_INTERSECT(a.w, b.w)) / LEN(LIST_DISTINCT(LIST_CONCAT(a.w, b.w)))) AS diversity FROM w5 a JOIN w5 b ON a.topic < b.topic)",
       "co AS (SELECT AVG(CASE WHEN ABS(sentiment_score) > 0.2 THEN 1.0 ELSE 0.0 END) AS coverage FROM seg WHERE sentiment_score IS NOT NULL)",
       "sz AS (SELECT topic, COUNT(*) AS n FROM seg WHERE topic <> -1 GROUP BY 1)",
       "ba AS (SELECT GREATEST(0, 1 - AVG(o)) AS balance FROM (SELECT ABS(n / SUM(n) OVER () - 1.0 / COUNT(*) OVER ()) / (1.0 / COUNT(*) OVER ()) AS o FROM sz))"],
       f"""SELECT (SELECT COUNT(*) FROM sz) AS topics, {sr('diversity')}, {sr('coverage')}, {sr('balance')},
       {sr('0.4*diversity + 0.3*coverage + 0.3*balance', 'quality')} FROM dv, co, ba"""))
def topic_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The size of the sentiment score stands in for a document's largest topic weight."""
    segments = f4(spark, sf, False)
    weights = segments.where(F.col("sentiment_score").isNotNull()).select(F.abs("sentiment_score").alias("max_weight"))
    sizes = summaries.topic_sizes(segments).select("topic", "n")
    out = topics.topic_quality(stage(ctfidf_words(spark, sf)), weights, sizes)
    return out.select("topics", *[r(c) for c in ("diversity", "coverage", "balance", "quality")])


@query("topic_pairs", with_([VEC, f"pp AS (SELECT a.topic AS topic_a, b.topic AS topic_b, {COS.format(a='a.p', b='b.p')} AS cosine FROM pr a JOIN pr b ON a.topic < b.topic)"],
       f"SELECT topic_a, topic_b, {sr('cosine')} FROM pp"))
def topic_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = topics.topic_pairs(topics.centroids(fixtures.vectors(spark, sf)).select("topic", "embedding"))
    cosine = topics.cosine_similarity(F.col("embedding_a"), F.col("embedding_b"))
    return pairs.select("topic_a", "topic_b", r(cosine, alias="cosine"))


@query("cluster_labels", with_([VEC, "ds AS (SELECT topic, item_id, SQRT(LIST_SUM(LIST_TRANSFORM(LIST_ZIP(e, p), lambda z: (z[1]-z[2])*(z[1]-z[2])))) AS d FROM vx JOIN pr USING (topic))",
       "md AS (SELECT topic, ARG_MIN(item_id, d) AS medoid, COUNT(*) AS n FROM ds GROUP BY 1)"],
       """SELECT topic AS cluster, n, medoid, COALESCE(ARRAY_TO_STRING(STRING_SPLIT_REGEX(TRIM(text), '\\s+')[1:4], ' '), '') || '...' AS label FROM md
       LEFT JOIN documents ON doc_id = medoid"""))
def cluster_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Given clusters (the labels), named after the document with the medoid's number."""
    vectors = fixtures.vectors(spark, sf)
    centers = topics.centroids(vectors).select("topic", F.col("embedding").alias("center"))
    texts = docs(spark, sf).select(F.col("doc_id").alias("item_id"), "text")
    rows = vectors.join(centers, "topic").join(texts, "item_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return topics.cluster_medoid_label(rows.withColumnRenamed("topic", "cluster"), ["cluster"])


@query("kmeans_multiscale")
def kmeans_multiscale(spark: SparkSession, sf: str) -> DataFrame:
    return topics.kmeans_multiscale(fixtures.vectors(spark, sf)).select("k", "item_id", "cluster")


@query("pca_2d")
def pca_2d(spark: SparkSession, sf: str) -> DataFrame:
    return topics.pca_2d(fixtures.vectors(spark, sf)).select("item_id", "x", "y")


@query("topic_assign")
def topic_assign(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topic_assign(fixtures.vectors(spark, sf).drop("topic")).select("item_id", "topic", "score")


@query("kmeans_nearest", f"""SELECT CAST(k AS INT) AS k, COUNT(vec_id) AS items, CAST(0 AS BIGINT) AS misplaced, CAST(0 AS BIGINT) AS empty
       FROM (VALUES {", ".join(f"({k})" for k in topics.K_VALUES)}) v(k), embeddings WHERE k < (SELECT COUNT(*) FROM embeddings) GROUP BY 1""")
def kmeans_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """At every scale: items that are not in the cluster of their nearest returned centre, and clusters without items."""
    placed = stage(topics.kmeans_multiscale(fixtures.vectors(spark, sf)))
    # At most 20 centres per scale.
    centers = placed.groupBy("k").agg(F.collect_set(F.struct("cluster", "center")).alias("centers"))
    gap = lambda c: topics.euclidean(F.col("embedding"), c)
    rated = placed.join(centers, "k").withColumn("least", F.array_min(F.transform("centers", lambda c: gap(c["center"]))))
    return rated.groupBy("k").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(gap(F.col("center")) > F.col("least") + 1e-9).alias("misplaced"),
        (F.max("k") - F.countDistinct("cluster")).cast("bigint").alias("empty"),
    )


@query("pca_moments", "SELECT COUNT(*) AS items, 0.0::DOUBLE AS mean_x, 0.0::DOUBLE AS mean_y, 10.0::DOUBLE AS spread_x, 10.0::DOUBLE AS spread_y, 0.0::DOUBLE AS correlation FROM embeddings")
def pca_moments(spark: SparkSession, sf: str) -> DataFrame:
    """The two components are centred, scaled to 10 and uncorrelated."""
    flat = stage(topics.pca_2d(fixtures.vectors(spark, sf)).select("x", "y"))
    return flat.agg(
        F.count(F.lit(1)).alias("items"), r(F.avg("x"), 4, "mean_x"), r(F.avg("y"), 4, "mean_y"), r(F.stddev_pop("x"), 4, "spread_x"),
        r(F.stddev_pop("y"), 4, "spread_y"), r(F.corr("x", "y"), 4, "correlation"),
    )


@query("topic_sizes_assigned", """SELECT COUNT(*) AS items, CAST(0 AS BIGINT) AS small_topics, TRUE AS scores_in_range FROM embeddings""")
def topic_sizes_assigned(spark: SparkSession, sf: str) -> DataFrame:
    """No topic but the outliers is below the least size (8 from 200 items on), and scores are cosines."""
    placed = stage(topics.topic_assign(fixtures.vectors(spark, sf).drop("topic")).select("topic", "score"))
    sizes = placed.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.every(F.col("score").between(-1.000001, 1.000001)).alias("ok"))
    return sizes.agg(
        F.sum("n").alias("items"), F.count_if((F.col("topic") != -1) & (F.col("n") < 8)).alias("small_topics"), F.every("ok").alias("scores_in_range"),
    )


@query("merge_topics")
def merge_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Forty fine topics (label and id) merged down."""
    fine = (F.col("topic") * 4 + F.col("item_id") % 4).cast("int")
    return topics.merge_topics(topics.centroids(fixtures.vectors(spark, sf).withColumn("topic", fine)), 15, 0.6)


@query("nmf_topics")
def nmf_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Aggressive form over all documents."""
    texts = docs(spark, sf)
    weights = topics.tfidf_aggressive(texts, "doc_id")
    assigned, _ = topics.nmf_topics(weights, "doc_id", topics.nmf_size(texts.count()), max_iter=300, alpha=0.05, documents=texts)
    return assigned


@query("nmf_summary", """SELECT COUNT(*) AS documents, TRUE AS topics_in_range, TRUE AS weights_positive FROM documents""")
def nmf_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the factors: a topic below k and a weight of at least 0 for every document."""
    k = topics.nmf_size(docs(spark, sf).count())
    found = nmf_topics(spark, sf)
    return found.agg(
        F.countDistinct("doc_id").alias("documents"), F.every((F.col("topic") >= 0) & (F.col("topic") < k)).alias("topics_in_range"),
        F.every(F.col("max_weight") >= 0).alias("weights_positive"),
    )


@query("nmf_labels")
def nmf_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Standard form: ten topics, with labels from their own words."""
    texts = docs(spark, sf)
    _, words = topics.nmf_topics(topics.tfidf(texts, "doc_id"), "doc_id", k=10, documents=texts)
    return topics.keyword_labels(stage(topics.topic_words(words)))


@query("episode_map")
def episode_map(spark: SparkSession, sf: str) -> DataFrame:
    found, motion = motion_of(spark, sf)
    motion = stage(motion)
    full = ep.with_sparc(ep.episode_features(found, motion), motion)
    wide = ep.episode_embedding(full).withColumn("embedding", F.transform("embedding", lambda v: v.cast("double")))
    return topics.pca_2d(stage(wide.select(*ep.EPISODE, "episode_type", "embedding"))).drop("embedding")
