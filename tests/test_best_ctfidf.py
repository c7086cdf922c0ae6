"""The pruned form of ctfidf against the whole one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kinescribe.operators import topics


def best(df, k):
    ranked = topics.topic_words(df.withColumn("weight", F.round("weight", 6)), k)
    return sorted(map(tuple, ranked.collect()))


@pytest.mark.parametrize("min_classes", [1, 2, 3])
def test_best_terms_and_weights_are_those_of_all_terms(spark, min_classes):
    rng = random.Random(min_classes)
    words = [f"w{i}" for i in range(400)]
    rows = [(rng.randrange(-1, 4), " ".join(words[min(399, int(rng.paretovariate(0.7)) - 1)] for _ in range(rng.randrange(60)))) for _ in range(300)]
    rows += [(2, None), (3, ""), (9, "alone here")]
    for given in (rows, rows[:-1]):
        segments = spark.createDataFrame(given, "topic int, text string")
        whole = topics.ctfidf(segments, min_classes)
        pruned = topics.ctfidf(segments, min_classes, best=10)
        assert best(pruned, 10) == best(whole, 10)
    # Without the topic of two words, most n-grams are not counted as terms.
    assert pruned.count() < whole.count()
