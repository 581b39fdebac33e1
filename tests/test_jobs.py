from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfern.operators import models, prep, quality
from tallyfern.plans import pipelines
from tallyfern.sources import readers, tables
from tallyfern.streaming import streams


def bank(spark, n=600):
    i = F.col("id")
    noise = F.pmod(F.xxhash64("id"), F.lit(100))
    return spark.range(n).select(
        "id",
        (18 + i % 60).cast("int").alias("age"),
        *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(50))).cast("int").alias(c)
          for k, c in enumerate(("duration", "campaign", "previous", "pdays"))],
        *[(F.pmod(F.xxhash64("id", F.lit(-k - 1)), F.lit(50)) / 7).alias(c)
          for k, c in enumerate(readers.BANK_DOUBLES)],
        *[F.concat(F.lit(" V"), (i % (k + 2)).cast("string")).alias(c)
          for k, c in enumerate(readers.BANK_CATEGORIES)],
        F.when(F.pmod(F.xxhash64("id", F.lit(0)), F.lit(50)) + noise / 5 > 45, "yes").otherwise("no").alias("y"),
    )


def test_preprocessor(spark, tmp_path):
    train = spark.createDataFrame(
        [(1.0, 5, " Red"), (2.0, 5, "blue "), (4.0, 5, None), (None, 5, "RED"), (10.0, 5, "red")],
        "x double, flat int, c string")
    model = prep.fit_preprocessor(train, numeric=["x", "flat"], categorical=["c"])
    assert prep.feature_names(model) == [
        "numeric__x", "numeric__flat", "categorical__c_blue", "categorical__c_missing", "categorical__c_red"]
    filled = np.array([1, 2, 4, 3, 10.0])
    rows = prep.named_features(train, model).collect()
    assert np.allclose([r[0] for r in rows], (filled - filled.mean()) / filled.std())
    assert [r[1] for r in rows] == [0.0] * 5
    assert [tuple(r[2:]) for r in rows] == [(0, 0, 1), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 1)]
    path = str(tmp_path / "p")
    models.save_model(model, path)
    again = models.load_model(path)
    unseen = spark.createDataFrame([(3.0, 6, "green")], "x double, flat int, c string")
    assert prep.named_features(unseen, again).first()[2:] == (0.0, 0.0, 0.0)
    assert prep.named_features(train, again).collect() == rows
    with pytest.raises(ValueError):
        prep.fit_preprocessor(train.withColumn("x", F.lit(None).cast("double")), numeric=["x"], categorical=[])
    with pytest.raises(ValueError):
        prep.fit_preprocessor(train.drop("c"), numeric=["x"], categorical=["c"])


def test_target(spark):
    df = spark.createDataFrame([("yes",), ("no",)], "y string")
    assert [r.label for r in prep.encode_target(df).collect()] == [1, 0]
    for odd in ("maybe", None):
        with pytest.raises(ValueError):
            prep.encode_target(df.unionByName(spark.createDataFrame([(odd,)], "y string")))


def test_baseline_reaches_the_penalised_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = (x @ [1.5, -1.0] + rng.normal(size=300) > 0.5).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(l)) for (a, b), l in zip(x, y)], "a double, b double, label int")
    model = models.train_baseline(df, prep.Preprocessor(["a", "b"], []))
    lr = model.stages[-1]
    z = (x - x.mean(0)) / x.std(0)
    w = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    p = 1 / (1 + np.exp(-(z @ lr.coefficients.toArray() + lr.intercept)))
    # Gradient of the weighted loss plus half the squared coefficients.
    gradient = z.T @ (w * (p - y)) + lr.coefficients.toArray()
    assert np.abs(gradient).max() < 1e-2 and abs((w * (p - y)).sum()) < 1e-2


def test_train_save_score_and_gate(spark, tmp_path):
    out = str(tmp_path)
    data = bank(spark)
    decision = pipelines.train_and_gate(
        data, ["id"], out, ["duration", "age"], ["month"], n_trees=3, iterations=20)
    assert decision.count() == 1
    runs = spark.read.parquet(f"{out}/runs").collect()
    assert {r.model for r in runs} == {"baseline", "improved"}
    assert all(r.true_positives + r.false_positives + r.true_negatives + r.false_negatives == 120 for r in runs)
    assert spark.read.parquet(f"{out}/gate_log").count() == 1
    model = models.load_model(f"{out}/improved")
    one = models.score(data, model, ["id"]).collect()
    assert one == models.score(data, models.load_model(f"{out}/improved"), ["id"]).collect()

    rows = data.withColumn("age", F.when(F.col("id") == 0, 5).otherwise(F.col("age")))
    scored = models.batch_score(
        rows, lambda d: models.score(d, model, d.columns), quality.record_errors(), "id")
    bad = scored.where("error IS NOT NULL").collect()
    assert any("age is below 17" in r.error for r in bad)
    assert all((r.probability, r.prediction) == (0.0, 0) for r in bad)
    totals = models.batch_totals(scored).first()
    assert (totals.total, totals.failed) == (600, len(bad)) and totals.succeeded > 0


def test_features_job(spark, tmp_path):
    out = str(tmp_path)
    model = pipelines.build_features(bank(spark, 100), out)
    matrix = spark.read.parquet(f"{out}/features")
    assert matrix.count() == 100 and matrix.columns == prep.feature_names(model) and "y" not in matrix.columns
    contract = prep.load_feature_schema(spark, f"{out}/schema")
    assert contract["version"] == "1.0" and len(contract["all_feature_columns"]) == 20
    prep.check_feature_schema(bank(spark, 1), contract)


def test_ingest_job(spark, tmp_path):
    folder = tmp_path / "bank"
    folder.mkdir()
    (folder / "bank.csv").write_text("age;emp.var.rate;Job Type;y\n30;1.5;admin.;yes\nx;;unknown;no\n")
    (folder / "bank-full.csv").write_text("age;emp.var.rate;Job Type;y\n31;2.5;NA;yes\n7;1;a;no;\n")
    raw = readers.read_bank_marketing(spark, str(folder))
    assert raw.columns == ["age", "emp_var_rate", "job_type", "y"]
    assert sorted(map(tuple, raw.collect())) == [(7, 1.0, "a", "no"), (31, 2.5, None, "yes")]
    with pytest.raises(FileNotFoundError):
        readers.read_bank_marketing(spark, str(tmp_path))

    head = "Date received,Product,Sub,Issue,Consumer complaint narrative,Company,Complaint ID\n"
    body = [
        '2023-01-15,Card,x,Fee,"two\nlines with ""quotes""",Acme,1',
        "2023-01-16,Card,x,Fee,too many,Acme,2,surplus",
        "2023-01-17,Card,x,Fee,N/A,Acme,3",
        "2023-01-18,Card,x,Fee,no id on this short line,Acme",
        '2023-01-19,Card,x,Fee,"  \t",Acme,5',
        *[f"2023-02-01,Loan,x,Rate,text {i},Bank,{100 + i}" for i in range(5_200)],
    ]
    file = tmp_path / "complaints.csv"
    file.write_text(head + "\n".join(body) + "\n")
    corpus = readers.read_text_corpus(spark, str(file))
    rows = {r.complaint_id: r.complaint_narrative for r in corpus.where("product = 'Card'").collect()}
    assert rows == {"1": 'two\nlines with "quotes"', None: "no id on this short line"}
    assert readers.rejected_lines(spark, str(file)) == 1
    assert corpus.columns == list(quality.COMPLAINT_COLUMNS) or set(corpus.columns) == set(quality.COMPLAINT_COLUMNS)

    out = str(tmp_path / "out")
    bank_rows, complaints = pipelines.ingest(spark, str(folder), str(file), out, complaints_sample=5_000)
    assert (bank_rows.count(), complaints.count()) == (2, 5_000)
    with pytest.raises(FileNotFoundError):
        readers.read_sample(spark, out + "/absent")
    records, passed = pipelines.check_quality(bank_rows, complaints)
    assert not passed and records.count() == 8


def test_name_collisions_raise(spark):
    with pytest.raises(ValueError):
        readers.normalise_columns(spark.createDataFrame([(1, 2)], "`a b` int, `A.B` int"))


def documents(spark, start, n):
    return spark.range(start, start + n).select(
        F.col("id").cast("string").alias("complaint_id"),
        F.when(F.col("id") % 2 == 0, "Card").otherwise("Loan").alias("product"),
        F.lit("Fee").alias("issue"), F.lit("Acme").alias("company"), F.lit("2023-01-15").alias("date_received"),
        F.concat(F.lit("a long complaint about fees of the account number "), F.col("id").cast("string"),
                 F.repeat(F.lit(" and more words"), (F.col("id") % 40).cast("int"))).alias("complaint_narrative"))


def test_index_job_and_questions(spark, tmp_path):
    base, encoder_path = str(tmp_path / "index"), str(tmp_path / "encoder")
    n = pipelines.build_index(documents(spark, 0, 60), base, encoder_path)
    index = tables.read_index(spark, base)
    assert index.count() == n
    pipelines.build_index(documents(spark, 0, 60), base, encoder_path)
    assert tables.versions(spark, base) == [0, 1] and tables.read_index(spark, base).count() == n
    assert tables.compact(spark, base) == 2
    assert tables.read_index(spark, base).count() == n
    asked = spark.createDataFrame(
        [(1, "complaint about account number 7", "Loan", None), (2, None, "Nowhere", None)],
        "query_id int, question string, product_filter string, issue_filter string")
    from pyspark.ml import PipelineModel

    prepared = pipelines.ask(index, asked, PipelineModel.load(encoder_path))
    rows = {r.query_id: r for r in prepared.collect()}
    assert not rows[1].refused and "7" in rows[1].complaint_ids and rows[2].refused
    assert all(int(c) % 2 for c in rows[1].complaint_ids)
    with pytest.raises(ValueError):
        pipelines.build_index(documents(spark, 0, 3).withColumn("complaint_narrative", F.lit("x")), base, encoder_path)


def test_blank_questions_are_refused(spark, tmp_path):
    base, encoder_path = str(tmp_path / "index"), str(tmp_path / "encoder")
    pipelines.build_index(documents(spark, 0, 20), base, encoder_path)
    asked = spark.createDataFrame([(1, ""), (2, None), (3, " \n"), (4, "account number 7")], "query_id int, question string")
    from pyspark.ml import PipelineModel

    prepared = pipelines.ask(tables.read_index(spark, base), asked, PipelineModel.load(encoder_path))
    assert {r.query_id: r.refused for r in prepared.collect()} == {1: True, 2: True, 3: True, 4: False}


def test_stream_and_batches_share_an_index(spark, tmp_path):
    base, encoder_path = str(tmp_path / "index"), str(tmp_path / "encoder")
    n = pipelines.build_index(documents(spark, 0, 20), base, encoder_path)
    from pyspark.ml import PipelineModel

    encoder = PipelineModel.load(encoder_path)
    source = str(tmp_path / "in")
    documents(spark, 100, 10).write.parquet(source)
    arriving = streams.read_stream(spark, source, spark.read.parquet(source).schema)

    def feed(log):
        streams.index_stream(arriving, base, f"{tmp_path}/{log}", encoder=encoder).awaitTermination()

    feed("log")
    index = tables.read_index(spark, base)
    more = index.count()
    assert more > n and index.where("embedding IS NULL").count() == 0
    # a fresh checkpoint is another writer: its batch 0 is a version of its own
    feed("log2")
    assert tables.versions(spark, base) == [0, 1, 2] and tables.read_index(spark, base).count() == more
    tables.upsert_version(index.limit(3).withColumn("product", F.lit("edited")), base)
    assert tables.read_index(spark, base).where("product = 'edited'").count() == 3
    assert tables.compact(spark, base) == 4
    final = tables.read_index(spark, base)
    assert final.count() == more and final.where("product = 'edited'").count() == 3


def test_two_writers_never_get_one_number(spark, tmp_path):
    from tallyfern.sources import paths

    base = str(tmp_path)
    rows = spark.createDataFrame([("a", 1)], "chunk_id string, x int")
    assert paths.create_once(spark, f"{base}/_commits/{0:012d}", "")  # died before naming its version
    assert not paths.create_once(spark, f"{base}/_commits/{0:012d}", "other added")
    assert tables.upsert_version(rows, base) == 1
    assert tables.write_version(rows.withColumn("x", F.lit(2)), base, "w-0") == 2
    assert tables.write_version(rows.withColumn("x", F.lit(9)), base, "w-0") == 2
    assert tables.read_index(spark, base).first().x == 2
    assert tables._commit(spark, base, "late", tables.WHOLE, after=1) == -1


def test_a_cut_is_deleted_and_nothing_else(spark, tmp_path):
    cut = tables.cut_lineage(spark.range(3))
    place = cut.inputFiles()[0].rpartition("/")[0]
    tables.drop_cut(cut)
    from tallyfern.sources import paths

    assert not paths.path_exists(spark, place)
    spark.range(3).write.parquet(f"{tmp_path}/kept")
    tables.drop_cut(spark.read.parquet(f"{tmp_path}/kept"))
    assert paths.path_exists(spark, f"{tmp_path}/kept")


def test_drift_uses_the_whole_reference(spark, tmp_path):
    ref = spark.range(5_000).select("id", F.when(F.col("id") < 2_000, 0.0).otherwise(50.0).alias("x"))
    cur = spark.range(5_000).select("id", F.lit(0.0).alias("x"))
    assert pipelines.run_drift(ref, cur, ["x"], [], f"{tmp_path}/a").first().dataset_drift_detected
    windowed = pipelines.run_drift(ref, cur, ["x"], [], f"{tmp_path}/b", ["id"], reference_rows=2_000)
    assert not windowed.first().dataset_drift_detected


def test_ingest_keeps_all_rows_by_default(spark, tmp_path):
    import inspect

    bounds = inspect.signature(pipelines.ingest).parameters
    assert bounds["complaints_sample"].default is None and bounds["bank_sample"].default is None


def test_drift_job(spark, tmp_path):
    ref = spark.range(5_000).select("id", (F.col("id") % 100 / 10).alias("x"), F.lit("a").alias("c"))
    cur = ref.select("id", (F.col("x") + 5).alias("x"), "c")
    out = str(tmp_path)
    for _ in range(2):
        summary = pipelines.run_drift(ref, cur, ["x"], ["c"], out, ["id"]).first()
    assert summary.drifted_columns == ["x"] and summary.dataset_drift_detected
    assert spark.read.parquet(f"{out}/columns").count() == 4
    assert [r.event_type for r in spark.read.parquet(f"{out}/events").collect()] == ["drift_detection"] * 2


def test_streams_over_several_batches(spark, tmp_path):
    source, place = str(tmp_path / "in"), str(tmp_path)
    for start in (0, 30):
        documents(spark, start, 30).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    arriving = streams.read_stream(spark, source, schema, files_per_batch=1)
    streams.index_stream(arriving, f"{place}/index", f"{place}/log").awaitTermination()
    from tallyfern.operators.chunking import chunk_table

    expected = chunk_table(documents(spark, 0, 60))
    got = tables.read_index(spark, f"{place}/index").select(*expected.columns)
    assert tables.versions(spark, f"{place}/index") == [0, 1]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    # Starting again finds nothing new and changes nothing.
    streams.index_stream(arriving, f"{place}/index", f"{place}/log").awaitTermination()
    assert tables.read_index(spark, f"{place}/index").count() == expected.count()


def test_late_events_drop_after_the_watermark(spark, tmp_path):
    source, place = tmp_path / "events", str(tmp_path)
    hours = ["2024-01-01 00:05:00", "2024-01-01 05:00:00", "2024-01-01 00:20:00"]
    for i, hour in enumerate(hours):
        row = spark.createDataFrame([(hour, "view")], "t string, event_type string")
        row.select(F.to_timestamp("t").alias("timestamp"), "event_type").coalesce(1).write.parquet(str(source / f"b{i}"))
        schema = spark.read.parquet(str(source / "b0")).schema
        arriving = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source))
        counts = streams.hourly_event_counts(arriving)
        streams.to_table(counts, f"{place}/out", f"{place}/log").awaitTermination()
    rows = spark.read.parquet(f"{place}/out").collect()
    assert [(r.hour.hour, r.n_events) for r in rows] == [(0, 1)]
