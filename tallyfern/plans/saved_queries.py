"""Registered queries of jobs that save models, features and runs, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfern.operators import models, prep
from tallyfern.plans import pipelines
from tallyfern.plans.table_queries import table
from tallyfern.sources.session import shared_folder

NUMERIC, CATEGORICAL = ["price", "customer"], ["priority"]
#: Lengths above it count as it: a score of every length then differs.
LONGEST = 3_000


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def features_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of the feature matrix that the feature job wrote, with its place in the
    fitted state and whether the written contract has its column (F9-F11, S10)."""
    orders = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 10 != 3, F.col("o_totalprice")).alias("price"),
        (F.col("o_custkey") % 97).alias("customer"),
        F.concat(F.lit(" "), F.when(F.col("o_orderkey") % 7 != 2, F.col("o_orderpriority"))).alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("y"),
    )
    place = _place(spark, "features")
    pipelines.build_features(orders, place, NUMERIC, CATEGORICAL)
    schema = prep.load_feature_schema(spark, f"{place}/schema")
    prep.check_feature_schema(orders, schema)
    names = prep.feature_names(models.load_model(f"{place}/preprocessor"))
    written = spark.read.parquet(f"{place}/features")
    statistics = written.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("feature"),
                    F.lit(names.index(name)).alias("slot"),
                    F.lit(any(name.startswith((f"numeric__{c}", f"categorical__{c}_")) for c in schema["all_feature_columns"])).alias("in_contract"),
                    F.count(F.col(f"`{name}`")).alias("n_rows"),
                    F.round(F.min(f"`{name}`"), 6).alias("low"),
                    F.round(F.max(f"`{name}`"), 6).alias("high"),
                    F.round(F.avg(F.pow(f"`{name}`", F.lit(2))), 6).alias("mean_square"),
                )
                for name in written.columns
            ]
        ).alias("slots")
    )
    return statistics.select(F.inline("slots"))


def trained_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logged run of a baseline: split, balanced weights, fit on the train part, saved,
    loaded, and measured on the test part (M1-M4, M6-M8, E8).

    With one feature a linear model ranks rows by it, upwards if the positive class has
    the larger mean; so both ranking metrics can be stated without the coefficients.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    length = F.least("n_chars", F.lit(LONGEST)).cast("double").alias("length")
    rows = table(spark, sf_dir, "documents").select("doc_id", length).join(labels, "doc_id")
    place = _place(spark, "baseline")
    train, test = models.split_once(rows.na.drop(), ["doc_id"])
    model, seconds = models.train_timed(
        lambda: models.train_baseline(train, prep.Preprocessor(["length"], []))
    )
    models.save_model(model, f"{place}/model")
    loaded = models.load_model(f"{place}/model")
    metrics = models.evaluate({models.BASELINE: loaded}, test)
    models.log_run(metrics, f"{place}/runs", {"n_train": str(train.count())}, seconds)
    tested = F.col("true_negatives") + F.col("false_positives")
    positive = F.col("true_positives") + F.col("false_negatives")
    return spark.read.parquet(f"{place}/runs").select(
        "model",
        "roc_auc",
        "pr_auc",
        (tested + positive).alias("n_test"),
        positive.alias("n_positive"),
        F.col("parameters")["n_train"].cast("long").alias("n_train"),
        (F.col("train_seconds") > 0).alias("timed"),
    )


QUERIES = {"features_read_back": features_read_back, "trained_baseline": trained_baseline}

ORACLES = {
    "features_read_back": f"""WITH o AS (
  SELECT CASE WHEN o_orderkey % 10 <> 3 THEN o_totalprice END AS price, (o_custkey % 97)::DOUBLE AS customer,
         coalesce(lower(trim(CASE WHEN o_orderkey % 7 <> 2 THEN o_orderpriority END)), '{prep.MISSING}') AS priority
  FROM orders
), filled AS (
  SELECT coalesce(price, (SELECT median(price) FROM o)) AS price, customer, priority FROM o
), scaled AS (
  SELECT (price - avg(price) OVER ()) / stddev_pop(price) OVER () AS price,
         (customer - avg(customer) OVER ()) / stddev_pop(customer) OVER () AS customer, priority FROM filled
), slots AS (
  SELECT 'numeric__price' AS feature, 0 AS slot, price AS v FROM scaled
  UNION ALL SELECT 'numeric__customer', 1, customer FROM scaled
  UNION ALL SELECT 'categorical__priority_' || k, CAST(1 + place AS INTEGER), (priority = k)::INTEGER::DOUBLE
  FROM scaled, (SELECT k, row_number() OVER (ORDER BY k) AS place FROM (SELECT DISTINCT priority AS k FROM scaled))
)
SELECT feature, slot, true AS in_contract, count(*) AS n_rows, round(min(v), 6) AS low, round(max(v), 6) AS high,
       round(avg(v * v), 6) AS mean_square FROM slots GROUP BY 1, 2""",
    "trained_baseline": f"""WITH lengths AS (
  SELECT doc_id, least(n_chars, {LONGEST})::DOUBLE AS x, quality AS y FROM documents JOIN labels USING (doc_id)
  WHERE quality IS NOT NULL AND n_chars IS NOT NULL
), parts AS (
  SELECT x, y, row_number() OVER (PARTITION BY y ORDER BY md5('{models.SEED}:' || doc_id), doc_id)
               <= floor({models.TEST_SHARE}::DOUBLE * count(*) OVER (PARTITION BY y) + 0.5) AS is_test FROM lengths
), trained AS (
  SELECT count(*) AS n, sign(avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0)) AS direction FROM parts WHERE NOT is_test
), steps AS (
  SELECT x * direction AS score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
  FROM parts, trained WHERE is_test GROUP BY 1
), sums AS (
  SELECT pos, neg, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg FROM steps
  WINDOW w AS (ORDER BY score DESC)
)
SELECT '{models.BASELINE}' AS model,
       round(sum(neg * (cum_pos - pos / 2))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE, 6) AS roc_auc,
       round(sum(pos * cum_pos::DOUBLE / (cum_pos + cum_neg)::DOUBLE) / sum(pos)::DOUBLE, 6) AS pr_auc,
       CAST(sum(pos + neg) AS BIGINT) AS n_test, CAST(sum(pos) AS BIGINT) AS n_positive,
       (SELECT n FROM trained) AS n_train, true AS timed FROM sums""",
}
