"""Category dictionaries against Spark ML's indexer and in size."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfern.operators import dictionary, prep
from tallyfern.sources import session


def test_equals_the_preprocessor(spark):
    rows = [(i, [" Red", "red", "blue\t", None, "Missing", "été"][i % 6], ["x", "y", "Z"][i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, b string, a string").repartition(4)
    train = df.where("k < 5")
    model = prep.fit_preprocessor(train, numeric=[], categorical=["a", "b"])
    known = dictionary.fit_dictionary(train, ["b", "a"], ranges=3)
    names = {r.slot: r.feature for r in known.collect()}
    assert [names[i] for i in range(len(names))] == prep.feature_names(model)
    expected = {tuple(r) for r in prep.long_features(df, model, "k").collect()}
    got = dictionary.sparse_features(df, known, ["a", "b"], ["k"])
    assert {(r.k, r.feature, r.value) for r in got.collect()} == expected
    assert got.count() == len(expected)


def test_slots_follow_given_ones_and_no_column(spark):
    df = spark.createDataFrame([("x",), (None,)], "c string")
    assert {(r.value, r.slot) for r in dictionary.fit_dictionary(df, ["c"], 4).collect()} == {("missing", 4), ("x", 5)}
    assert dictionary.fit_dictionary(df.where("false"), ["c"]).count() == 0
    with pytest.raises(ValueError):
        dictionary.fit_dictionary(df, [])


def test_a_million_categories(spark):
    """Slots without gaps in byte order; the rows meet a dictionary too large to be sent."""
    n = 1_000_000
    ids = spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.hex("id")).alias("c"))
    known = dictionary.fit_dictionary(ids, ["c"])
    order = Window.orderBy("slot")
    facts = known.agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots")).first()
    assert (facts.n, facts.last, facts.slots) == (n, n - 1, n) and n > session.BROADCAST_ROWS
    early = known.where("slot < 20000").withColumn("before", F.lag("value").over(order))
    assert early.where("before >= value").count() == 0
    hot = ids.unionByName(spark.range(200_000).select((F.col("id") + n).alias("k"), F.lit("v7").alias("c")))
    found = dictionary.sparse_features(hot, known, ["c"], ["k"])
    facts = found.agg(F.count("*").alias("n"), F.count_if(F.col("feature") == "categorical__c_v7").alias("hot")).first()
    assert (facts.n, facts.hot) == (n + 200_000, 200_001)
