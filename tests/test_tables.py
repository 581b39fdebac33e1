from __future__ import annotations

import datetime as dt
import hashlib
import itertools
import math
import statistics

import pytest
from pyspark.sql import functions as F

from tallyfern.operators import drift, gate, metrics, quality, ranking, sampling, telemetry


def by_check(records):
    return {r.check: (r.passed, r.failures) for r in records.collect()}


def test_quality_rules(spark):
    rows = [("25", "yes", "5"), ("17", "no", "0"), (None, "maybe", "-1"), ("abc", None, None),
            ("18", "no", "x"), ("100", "no", "inf"), ("101", "yes", "3"), (" 25 ", "yes", "NaN")]
    df = spark.createDataFrame(rows, "age string, y string, duration string")
    rules = [
        quality.required_columns(["age", "job"]),
        quality.numeric_range(),
        quality.allowed_values("y", ["yes", "no"]),
        quality.allowed_values("y", None, "only_nulls"),
        quality.nonnegative(),
        quality.no_duplicate_ids("y"),
        quality.nonempty_text("absent"),
    ]
    records = quality.run_checks(df, "bank", rules)
    assert by_check(records) == {
        "required_columns": (False, 1),
        "age_range": (False, 4),
        "target_column": (False, 2),
        "only_nulls": (False, 1),
        "duration_values": (False, 4),
        "no_duplicate_ids": (False, 4),
        "nonempty_complaints": (False, 1),
    }
    details = {r.check: r.details for r in records.collect()}
    assert details["target_column"]["unexpected_distinct"] == "1"
    assert details["required_columns"]["missing_columns"] == "job"
    summary = quality.summary(records).first()
    assert (summary.passed, summary.n_failed) == (False, 7)


def test_complaint_suite(spark):
    good = ("1", "Card", "Fee", "Acme", "2023-01-15", "text")
    bad = [
        ("1", "Card", "Fee", "Acme", "2023-1-5", "  "),
        (None, "Card", "Fee", "Acme", "2023-02-30", None),
        (None, "Card", "Fee", "Acme", None, "text"),
    ]
    schema = ", ".join(f"{c} string" for c in quality.COMPLAINT_COLUMNS)
    assert by_check(quality.check_complaints(spark.createDataFrame([good, *bad], schema))) == {
        "required_columns": (True, 0),
        "no_duplicate_ids": (False, 2),
        "nonempty_complaints": (False, 2),
        "complaint_dates": (False, 3),
    }
    assert quality.summary(
        quality.check_complaints(spark.createDataFrame([good], schema))
    ).first().passed


def test_record_and_question_errors(spark):
    df = spark.createDataFrame([(17, 0, 1), (16, -1, 0), (None, 3, 5)], "age int, duration int, campaign int")
    bounds = {"age": (17, 120), "duration": (0, None), "campaign": (1, None)}
    errors = [r[0] for r in df.select(quality.record_errors(list(bounds), bounds)).collect()]
    assert errors == [
        [],
        ["age is below 17", "duration is below 0", "campaign is below 1"],
        ["age is missing"],
    ]
    asked = spark.createDataFrame([("ab", 0), ("a" * 1001, 21), ("why?", 5)], "question string, top_k int")
    counts = [len(r[0]) for r in asked.select(quality.question_errors()).collect()]
    assert counts == [2, 2, 0]
    assert len(asked.select(quality.question_errors(optional=True)).first()[0]) == 1


SCORED = [(0.9, 1), (0.8, 0), (0.8, 1), (0.7, 0), (0.6, 1), (0.5, 0), (0.5, 0), (0.1, 0)]


@pytest.mark.parametrize("n_buckets", [None, 3, 7])
def test_metrics_by_hand(spark, n_buckets):
    df = spark.createDataFrame([("a", *r) for r in SCORED] + [("one", 0.3, 1), ("one", 0.6, 1)],
                               "model string, probability double, label int")
    rows = {r.model: r for r in metrics.metric_record(df, n_buckets=n_buckets).collect()}
    a = rows["a"]
    assert (a.pr_auc, a.roc_auc, a.brier_score) == (0.755556, 0.833333, 0.23125)
    assert (a.true_positives, a.false_positives, a.false_negatives, a.true_negatives) == (3, 4, 0, 1)
    assert (a.precision, a.recall, a.f1) == (0.428571, 1.0, 0.6)
    assert rows["one"].roc_auc is None and rows["one"].pr_auc is None


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_do_not_depend_on_ranges(spark, descending):
    df = spark.range(3000).select(
        (F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 0, 5.0)
        .otherwise(F.pmod(F.xxhash64("id"), F.lit(400)) / 7.0).alias("v"), F.lit(1).alias("n")
    )
    def run(n):
        out = ranking.ranged_cumsum(df.repartition(n), "v", ["n"], ["g"], descending, n_buckets=n)
        return sorted(map(tuple, out.collect()))
    one = run(1)
    assert one == run(6) == run(50)
    for g, v, n, cum, total, following in one:
        after = [x[1] for x in one if x[0] == g and (x[1] < v if descending else x[1] > v)]
        assert following == ((max if descending else min)(after) if after else None)


@pytest.mark.parametrize("values", [[1, 2, 4, None, 10], [3], [5] * 40 + [1, 9], list(range(1000))])
def test_exact_medians(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    got = ranking.exact_medians(df, ["x"], accuracy=50).first().median
    assert got == statistics.median([v for v in values if v is not None])


def test_median_of_wide_data_and_brackets(spark):
    df = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / 3).alias("x"))
    expected = df.select(F.median("x")).first()[0]
    assert ranking.exact_medians(df, ["x"]).first().median == expected


def test_sample_is_exact_and_independent_of_layout(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 5).alias("g"))
    a = sorted(r.id for r in sampling.sample_n(df, 777, 42, ["id"]).collect())
    b = sorted(r.id for r in sampling.sample_n(df.repartition(7), 777, 42, ["id"]).collect())
    order = sorted(range(20_000), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    assert a == b == sorted(order[:777])
    assert sampling.sample_n(df, 50_000, 42, ["id"]).count() == 20_000
    assert sampling.sample_n(df, 0, 42, ["id"]).count() == 0


def test_sample_with_a_third_of_the_rows_alike(spark):
    df = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    for n in (10, 3_000, 5_000, 8_999):
        assert sampling.sample_n(df, n, 1, ["k"]).count() == n


def test_stratified_split(spark):
    df = spark.range(10_007).select("id", (F.col("id") % 9 == 0).cast("int").alias("label"))
    train, test = sampling.stratified_split(df, "label", ["id"])
    sizes = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    got = {r.label: r["count"] for r in test.groupBy("label").count().collect()}
    assert got == {k: math.floor(0.2 * v + 0.5) for k, v in sizes.items()}
    assert train.unionByName(test).distinct().count() == 10_007
    assert train.join(test, "id").count() == 0


def test_sample_bounds(spark):
    with pytest.raises(ValueError):
        sampling.check_sample_bounds(4_999)
    small = spark.range(10)
    with pytest.warns(UserWarning):
        assert sampling.bounded_sample(small, 5_000, 1, ["id"]).count() == 10
    with pytest.raises(ValueError):
        sampling.bounded_sample(small.where("id < 0"), 5_000, 1, ["id"])


@pytest.mark.parametrize(
    "pr, f1, promoted, n_reasons",
    [(0.40 + 0.03, 0.55, True, 0), (0.43, 0.55, False, 1), (0.5, 0.53, True, 0), (0.5, 0.52, False, 1),
     (0.3, 0.1, False, 2)],
)
def test_gate(spark, tmp_path, pr, f1, promoted, n_reasons):
    rows = [("b", 0.40, 0.55, 0.75), ("i", pr, f1, 0.8)]
    table = spark.createDataFrame(rows, "model string, pr_auc double, f1 double, roc_auc double")
    log = str(tmp_path / "log")
    for _ in range(2):
        decision = gate.gate_and_log(table, "b", "i", log, {"run": "7"}).first()
    assert decision.promoted is promoted
    assert len(decision.rejection_reasons) == n_reasons
    logged = spark.read.parquet(log).collect()
    assert len(logged) == 2 and logged[0].run_metadata == {"run": "7"}


def test_comparison(spark):
    rows = [("b", *[0.5] * 6), ("i", *[0.75] * 6)]
    table = spark.createDataFrame(rows, "model string, " + ", ".join(f"{m} double" for m in metrics.COMPARED))
    found = {r.metric: r.delta for r in metrics.compare_metrics(table, "b", "i").collect()}
    assert found == {f"delta_{m}": 0.25 for m in metrics.COMPARED}


@pytest.mark.parametrize("n_buckets", [None, 3])
def test_drift_distances_by_hand(spark, n_buckets):
    ref = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    cur = spark.createDataFrame([(2.0,), (3.0,), (4.0,), (6.0,)], "x double")
    row = drift.numeric_statistics(ref, cur, ["x"], n_buckets).first()
    sigma = statistics.pstdev([1, 2, 3, 4])
    assert row.ks == pytest.approx(0.25) and row.wasserstein == pytest.approx(1.25 / sigma)
    left = spark.createDataFrame([("a",), ("b",)], "c string")
    right = spark.createDataFrame([("a",), ("b",), ("b",), ("d",)], "c string")
    row = drift.categorical_statistics(left, right, ["c"]).first()
    assert row.jensen_shannon == pytest.approx(0.328452, abs=1e-6)
    assert math.isinf(row.chi_square)


def test_small_references_use_p_values(spark):
    ref = spark.range(200).select((F.col("id") / 7).alias("n"), (F.col("id") % 3).cast("string").alias("c"),
                                  (F.col("id") % 2).cast("string").alias("two"),
                                  F.lit("x").alias("only_here"))
    cur = spark.range(300).select((F.col("id") / 7 + 9).alias("n"), (F.col("id") % 3).cast("string").alias("c"),
                                  F.when(F.col("id") % 5 == 0, "0").otherwise("1").alias("two"))
    rows = {r.column: r for r in drift.drift_by_column(ref, cur, ["n"], ["c", "two", "only_here"]).collect()}
    assert {k: v.stattest for k, v in rows.items()} == {
        "n": drift.KOLMOGOROV_SMIRNOV, "c": drift.CHI_SQUARE, "two": drift.PROPORTION_Z}
    assert [rows[c].drift_detected for c in ("n", "c", "two")] == [True, False, True]
    summary = drift.drift_summary(drift.drift_by_column(ref, cur, ["n"], ["c"])).first()
    assert summary.dataset_drift_detected and summary.drifted_columns == ["n"]


@pytest.mark.parametrize("x, freedom, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05),
                                            (18.307038, 10, 0.05), (0.0, 4, 1.0)])
def test_chi_square_tail(x, freedom, p):
    assert drift._chi_square_tail(x, freedom) == pytest.approx(p, abs=1e-6)


def test_kolmogorov_and_normal_p(spark):
    row = spark.range(1).select(
        drift.kolmogorov_p(F.lit(1.358 / math.sqrt(50)), F.lit(100), F.lit(100)).alias("k"),
        drift.normal_p(F.lit(1.959964)).alias("z"),
        drift.kolmogorov_p(F.lit(0.0), F.lit(100), F.lit(100)).alias("same"),
    ).first()
    assert row.k == pytest.approx(0.05, abs=1e-3) and row.z == pytest.approx(0.05, abs=1e-6)
    assert row.same == 1.0


QUERY = ("query string, n_results int, refused boolean, similarities array<double>, latency_ms double, "
         "token_usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>")


def test_monitor_summaries(spark, tmp_path):
    rows = [("a" * 80, 2, False, [0.5, 0.7], 10.0, (1, 2, 3)), ("b", 0, True, [], 20.0, None),
            ("c", 1, False, [0.0], 30.0, (4, 5, 9))]
    queries = spark.createDataFrame(rows, QUERY)
    when = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")
    events = telemetry.rag_events(queries, when)
    path = str(tmp_path / "events")
    telemetry.append_events(events, path)
    telemetry.append_events(
        telemetry.prediction_events(
            spark.createDataFrame([(0.25, 0, 3.0), (0.75, 1, 5.0)], "probability double, prediction int, latency_ms double"),
            when), path)
    log = spark.read.parquet(path)
    assert {r.event_type: r.n_events for r in telemetry.events_by_type(log).collect()} == {
        "rag_query": 3, "ml_prediction": 2}
    parsed = telemetry.parsed(log, telemetry.RAG_QUERY, telemetry.RAG_FIELDS)
    assert max(len(r.query_preview) for r in parsed.collect()) == 60
    logged = telemetry.rag_log_summary(parsed).first()
    assert (logged["count"], logged.hit_rate, logged.empty_retrieval_count) == (3, 0.6667, 1)
    assert (logged.avg_top_k_similarity, logged.avg_token_usage) == (0.6, 4.0)
    seen = telemetry.rag_monitor_summary(queries).first()
    assert (seen.refused_count, seen.avg_top_k_similarity, seen.total_tokens_used) == (1, 0.3, 12)
    predictions = telemetry.parsed(log, telemetry.PREDICTION, telemetry.PREDICTION_FIELDS)
    summary = telemetry.prediction_summary(predictions).first()
    assert (summary["count"], summary.avg_probability, summary.positive_rate) == (2, 0.5, 0.5)
    empty = telemetry.request_metrics(spark.createDataFrame([], "latency_ms double, error boolean")).first()
    assert (empty.total_requests, empty.error_rate, empty.avg_latency_ms) == (0, 0.0, 0.0)
    telemetry.snapshot(log, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap/events")).count() == 5


@pytest.mark.parametrize("freedom", [1, 2, 3, 7, 40, 41, 1_000])
def test_chi_square_tail(freedom):
    """Against the finite sums that hold for whole degrees of freedom."""
    for x in (0.01, freedom / 3, float(freedom), 1.2 * freedom, 2.0 * freedom + 5):
        half = x / 2
        tail, order = (math.erfc(math.sqrt(half)), 0.5) if freedom % 2 else (math.exp(-half), 1.0)
        while order < freedom / 2:
            tail += math.exp(order * math.log(half) - half - math.lgamma(order + 1))
            order += 1
        assert drift._chi_square_tail(x, freedom) == pytest.approx(min(1.0, tail), abs=1e-10)
    assert drift._chi_square_tail(1e8, 10**8) == pytest.approx(0.5, abs=1e-3)
    assert drift._chi_square_tail(math.inf, freedom) == 0.0 and drift._chi_square_tail(0.0, freedom) == 1.0


def test_fixed_tests_and_every_statistic(spark):
    ref = spark.range(400).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    cur = spark.range(300).select((F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("c"))
    rows = {r.column: r for r in drift.drift_by_column(ref, cur, ["x"], ["c"], tests={"x": drift.WASSERSTEIN}).collect()}
    assert rows["x"].stattest == drift.WASSERSTEIN and rows["x"].drift_score == round(rows["x"].wasserstein, 4)
    assert rows["c"].stattest == drift.CHI_SQUARE and rows["c"].chi_square_p < 0.05 and rows["c"].z_p is not None


def test_rows_without_a_label_are_left_out(spark):
    rows = [("m", 1, 0.9), ("m", 0, 0.1), ("m", None, 0.8)]
    scored = spark.createDataFrame(rows, "model string, label int, probability double")
    got = metrics.metric_record(scored).first()
    assert (got.true_positives, got.true_negatives, got.false_positives, got.roc_auc) == (1, 1, 0, 1.0)
    assert metrics.unlabelled(scored).first().unlabelled_rows == 1


def test_snapshots_append_only_new_events(spark, tmp_path):
    scored = spark.createDataFrame([(0.5, 1, 2.0)], "probability double, prediction int, latency_ms double")
    log = telemetry.prediction_events(scored, F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    folder = str(tmp_path / "s")
    first = telemetry.snapshot(log, folder)
    telemetry.snapshot(log, folder, first)
    assert spark.read.parquet(f"{folder}/events").count() == 1
    summary = spark.read.parquet(f"{folder}/summary")
    stamps = {r[0] for r in spark.read.parquet(f"{folder}/events").select("generated_at").collect()}
    assert stamps <= {r[0] for r in summary.select("generated_at").distinct().collect()}
    assert {r.section for r in summary.collect()} == {"events", telemetry.PREDICTION, telemetry.RAG_QUERY}
    assert telemetry.new_log(spark, str(tmp_path / "l")).endswith("log-000000")
    log.write.parquet(telemetry.new_log(spark, str(tmp_path / "l")))
    assert telemetry.new_log(spark, str(tmp_path / "l")).endswith("log-000001")


def test_contract_checks_types(spark):
    from tallyfern.operators import prep

    schema = prep.feature_schema(["a"], ["b"])
    prep.check_feature_schema(spark.createDataFrame([(1, "x")], "a int, b string"), schema)
    with pytest.raises(ValueError, match="another type"):
        prep.check_feature_schema(spark.createDataFrame([("1", "x")], "a string, b string"), schema)


def test_more_unexpected_values_than_any_list(spark):
    df = spark.range(3_000).select(F.col("id").cast("string").alias("y"))
    rule = quality.allowed_values("y", ("1", "2"))
    record = quality.run_checks(df, "d", [rule]).first()
    assert record.details["unexpected_distinct"] == "2998"
    assert quality.unexpected_values(df, "y", ("1", "2")).count() == 2998


def enumerated_p(distance, n, m):
    """Share of all merged orders whose largest gap reaches the distance."""
    limit, reached, total = round(distance * n * m), 0, 0
    for ones in itertools.combinations(range(n + m), n):
        chosen, i, far = set(ones), 0, 0
        for step in range(n + m):
            i += step in chosen
            far = max(far, abs(i * m - (step + 1 - i) * n))
        reached += far >= limit
        total += 1
    return reached / total


def test_exact_kolmogorov_by_enumeration():
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 7), (6, 6), (3, 8)):
        gaps = {abs(i * m - j * n) for i in range(n + 1) for j in range(m + 1)}
        for gap in gaps:
            p = drift._exact_kolmogorov(gap / (n * m), n, m)
            assert p == pytest.approx(enumerated_p(gap / (n * m), n, m), abs=1e-12), (n, m, gap)
    # Published values for two samples of twelve: D = 6/12 and 8/12.
    assert drift._exact_kolmogorov(6 / 12, 12, 12) == pytest.approx(0.0995, abs=1e-4)
    assert drift._exact_kolmogorov(8 / 12, 12, 12) == pytest.approx(0.0080, abs=5e-4)
    assert drift._exact_kolmogorov(1.0, 12, 12) == pytest.approx(2 / math.comb(24, 12), rel=1e-9)


def test_two_sample_p_is_exact_only_for_small_samples(spark):
    rows = [(0.5, 12, 12), (0.05, 1_000, 1_000), (0.05, 1_001, 1_000), (0.0, 5, 5), (None, 5, 5)]
    frame = spark.createDataFrame(rows, "d double, n long, m long")
    got = [r.p for r in frame.select(drift.two_sample_p(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect()]
    series = frame.select(drift.kolmogorov_p(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect()
    assert got[0] == pytest.approx(drift._exact_kolmogorov(0.5, 12, 12)) and got[3] == 1.0
    assert got[2] == series[2].p and got[1] != series[1].p and got[1] == pytest.approx(series[1].p, abs=0.02)


def test_policy_decides_the_test_at_every_size(spark):
    ref = spark.range(50).select((F.col("id") % 2).cast("double").alias("n"), F.lit("x").alias("c"))
    rows = drift.drift_by_column(ref, ref, ["n"], ["c"], policy=drift.distance_tests()).collect()
    assert {r.column: r.stattest for r in rows} == {"n": drift.WASSERSTEIN, "c": drift.JENSEN_SHANNON}
    fixed = {"n": drift.KOLMOGOROV_SMIRNOV}
    rows = drift.drift_by_column(ref, ref, ["n"], tests=fixed, policy=drift.distance_tests()).collect()
    assert [(r.stattest, r.drift_score, r.drift_detected) for r in rows] == [(drift.KOLMOGOROV_SMIRNOV, 1.0, False)]
