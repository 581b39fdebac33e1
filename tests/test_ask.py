from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfern.functions.vectors import cosine_distance, similarity
from tallyfern.operators import answer_eval, answer_store, answers, encoding, quantised, retrieval

DIM = 8


def make_chunks(spark, n=400, copies=130):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(n, DIM))
    vectors[:copies] = vectors[0]
    rows = [
        (f"c{i:04d}", f"text {i}", str(i // 3), ["Card", "Loan"][i % 2], "Fee", "Acme", None, i % 3,
         [float(x) for x in vectors[i]])
        for i in range(n)
    ]
    schema = ("chunk_id string, text string, complaint_id string, product string, issue string, "
              "company string, date string, chunk_index int, embedding array<float>")
    return spark.createDataFrame(rows, schema), vectors.astype(np.float32).astype(float)


def make_questions(spark, vectors, n=9):
    rng = np.random.default_rng(2)
    asked = rng.normal(size=(n, DIM))
    asked[0] = vectors[0]
    rows = [(i, f"question {i}", [float(x) for x in asked[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "query_id int, question string, embedding array<double>"), asked


def brute(vectors, asked, k, allowed=None):
    out = {}
    for q, v in enumerate(asked):
        d = 1 - vectors @ v / np.linalg.norm(vectors, axis=1) / np.linalg.norm(v)
        ranked = sorted((round(x, 9), f"c{i:04d}") for i, x in enumerate(d) if allowed is None or allowed(q, i))
        out[q] = [c for _, c in ranked[:k]]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


def test_top_k_equals_brute_force_with_copies(spark):
    chunks, vectors = make_chunks(spark)
    questions, asked = make_questions(spark, vectors)
    expected = brute(vectors, asked, 5)
    assert found(retrieval.top_k(chunks.repartition(7), questions)) == expected
    assert found(retrieval.top_k(chunks.coalesce(1), questions)) == expected
    # More questions than a block holds go through the shared folder.
    assert found(retrieval.top_k(chunks, questions, block_bytes=3 * 8 * DIM)) == expected


def test_filters_own_k_and_blank_questions(spark):
    chunks, vectors = make_chunks(spark)
    questions, asked = make_questions(spark, vectors)
    asking = questions.select(
        "query_id", "embedding",
        F.when(F.col("query_id") == 3, "  ").otherwise(F.col("question")).alias("question"),
        F.when(F.col("query_id") % 2 == 0, "product").alias("filter_key"),
        F.when(F.col("query_id") % 2 == 0, "Loan").alias("filter_value"),
        (F.col("query_id") + 1).alias("top_k"),
    )
    expected = brute(vectors, asked, 20, lambda q, i: q % 2 == 1 or i % 2 == 1)
    expected = {q: ids[: q + 1] for q, ids in expected.items() if q != 3}
    assert found(retrieval.top_k(chunks, asking)) == expected
    nobody = asking.where("query_id = 3")
    assert retrieval.top_k(chunks, nobody).count() == 0


def test_cells_are_exact_when_all_are_probed(spark):
    chunks, vectors = make_chunks(spark, copies=1)
    questions, asked = make_questions(spark, vectors)
    cells = retrieval.fit_cells(chunks, 6)
    celled = retrieval.assign_cells(chunks, cells)
    exact = brute(vectors, asked, 5)
    assert found(retrieval.approx_top_k(celled, questions, cells, 6)) == exact
    some = found(retrieval.approx_top_k(celled, questions, cells, 3))
    hits = sum(len(set(some[q]) & set(exact[q])) for q in exact)
    assert hits / (5 * len(exact)) > 0.6


def test_distance_and_similarity(spark):
    row = spark.range(1).select(
        cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))).alias("right"),
        cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(2.0))).alias("zero"),
        *[similarity(F.lit(d)).alias(f"s{i}") for i, d in enumerate((0.0, 0.4, 0.75, 2.0))],
    ).first()
    assert (row.right, row.zero) == (1.0, 1.0)
    assert [row.s0, row.s1, row.s2, row.s3] == [1.0, 0.8, 0.625, 0.0]
    edge = spark.createDataFrame([(0.75,), (0.7499,)], "distance double")
    assert retrieval.refuse_far(edge).count() == 1


def test_chunks_of_document(spark):
    chunks, _ = make_chunks(spark)
    assert [r.chunk_index for r in retrieval.chunks_of_document(chunks, "2").collect()] == [0, 1, 2]


def test_encoders(spark, tmp_path):
    texts = spark.createDataFrame([("a", "late fee Late FEE"), ("b", "late loan"), ("c", "--")], "id string, text string")
    model = encoding.fit_hashed_tfidf(texts, dimensions=64)
    model.write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel

    again = PipelineModel.load(str(tmp_path / "m"))
    rows = {r.id: np.array(r.embedding) for r in encoding.encode(texts, model).collect()}
    same = {r.id: np.array(r.embedding) for r in encoding.encode(texts, again).collect()}
    assert all((rows[k] == same[k]).all() for k in rows)
    assert np.linalg.norm(rows["a"]) == pytest.approx(1, abs=1e-6) and not rows["c"].any()

    own = encoding.encode_with(texts, lambda: lambda batch: [[float(len(t)), 0.0] for t in batch], batch_size=2)
    unit = encoding.unit_vectors(own)
    assert {r.id: list(r.embedding) for r in unit.collect()}["b"] == [1.0, 0.0]


@pytest.mark.parametrize("n, themes", list(enumerate([0, 1, 2, 3, 4, 5, 3, 4, 4, 3, 3])) + [(20, 2)])
def test_theme_counts(spark, n, themes):
    ids = F.array(*[F.lit(f"i{k}") for k in range(n)]).cast("array<string>")
    got = spark.range(1).select(answers.themes(ids, 9).alias("t")).first().t
    assert len(got) == themes
    if n == 7:
        assert [t.theme for t in got] == [f"Complaint theme {i}" for i in range(1, 5)]
        assert [len(t.evidence_ids) for t in got] == [2, 2, 2, 1]


def test_tiers(spark):
    scores = spark.createDataFrame([(0.7,), (0.69,), (0.4,), (0.39,)], "s double")
    assert [r[0] for r in scores.select(answers.tier(F.col("s"))).collect()] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]


RANKED = [
    (1, 1, "c1", "first {question}", "11", "Card", "Acme", "2023-01-15", 0.9),
    (1, 2, "c2", "second", "12", None, "Acme", None, 0.5),
    (2, 1, "c3", "weak", "13", "Card", "Acme", None, 0.1),
    (5, 1, "c1", "first", "11", "Card", "Acme", None, 0.8),
    (6, 1, "c1", "first", "11", "Card", "Acme", None, 0.8),
]


def ranked(spark):
    return spark.createDataFrame(
        RANKED, "query_id int, rank int, chunk_id string, text string, complaint_id string, product string, "
        "company string, date string, similarity double")


def test_answer_flow(spark):
    questions = spark.createDataFrame(
        [(1, "why {n_chunks}?"), (2, "weak?"), (3, "nothing?"), (4, "  "), (5, "fails?"), (6, "lost?")],
        "query_id int, question string")
    prepared = answers.prepare_questions(questions, ranked(spark))
    rows = {r.query_id: r for r in prepared.collect()}
    assert len(rows) == 6
    assert rows[1].evidence_block == (
        "1. [Complaint ID: 11 | Product: Card | Company: Acme | Date: 2023-01-15]\n   first {question}\n\n"
        "2. [Complaint ID: 12 | Product:  | Company: Acme | Date: ]\n   second")
    assert rows[1].evidence_sufficiency == (
        "Evidence quality: HIGH (avg_similarity=0.700, max_similarity=0.900, n_chunks=2)")
    assert "asks: why {n_chunks}?" in rows[1].prompt and "first {question}" in rows[1].prompt
    assert "2 excerpts" in rows[1].prompt and rows[2].prompt is None

    def load():
        def model(prompt):
            if "fails?" in prompt:
                raise RuntimeError("down")
            return "because", 7, 2
        return model

    given = answers.generate_answers(prepared, load).where("query_id != 6")
    records = answers.answer_records(prepared, given, model="m")
    got = {r.query_id: r for r in records.collect()}
    assert set(answers.ANSWER_COLUMNS) <= set(records.columns)
    assert (got[1].answer, got[1].refused, got[1].token_usage.total_tokens) == ("because", False, 9)
    assert got[1].evidence_ids == ["c1", "c2"] and got[1].retrieval_count == 2
    assert got[2].refused and got[2].answer == answers.REFUSAL_MESSAGE and got[2].retrieval_count == 1
    assert got[3].evidence_sufficiency == answers.NO_EVIDENCE_NOTE and got[3].evidence_ids == []
    assert got[4].answer == answers.BLANK_QUESTION_MESSAGE
    assert got[5].answer == "LLM error: down" and got[5].refused and got[5].evidence_ids == ["c1"]
    assert got[6].refused and got[6].answer == "LLM error: no answer"

    cases = spark.createDataFrame([(1, False), (2, True), (3, False), (9, True)], "query_id int, expect_refused boolean")
    judged = answer_eval.judge_cases(cases, records)
    assert {r.query_id: r.passed for r in judged.collect()} == {1: True, 2: True, 3: False, 9: False}
    report = answer_eval.eval_report(judged).first()
    assert (report.total_cases, report.passed, report.failed, report.pass_rate) == (4, 2, 2, 0.5)
    assert answer_eval.eval_report(judged.where("query_id < 0")).first().pass_rate == 0.0

    scored = spark.createDataFrame([(1, 0.71, 1), (1, 0.2, 0), (3, 0.4, 0)], "query_id int, probability double, prediction int")
    intel = answers.customer_intel(scored, records, "query_id").collect()
    assert sorted(r.conversion_band for r in intel) == ["HIGH", "LOW", "MEDIUM"]
    assert {tuple(r.cited_complaint_ids) for r in intel} == {("11", "12"), ()}
    more = scored.unionByName(scored.limit(1).withColumn("query_id", F.lit(77)))
    alone = [r for r in answers.customer_intel(more, records, "query_id").collect() if r.query_id == 77]
    assert len(alone) == 1 and alone[0].complaint_answer is None and alone[0].complaint_themes is None


@pytest.mark.parametrize("n", [1, 8, 33, 100])
def test_every_id_has_a_theme(spark, n):
    ids = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string"))
    got = spark.range(1).select(answers.themes(ids).alias("t")).first().t
    assert [int(i) for t in got for i in t.evidence_ids] == list(range(1, n + 1))


def test_filter_choice(spark):
    asked = spark.createDataFrame(
        [("q", "Card", "Fee"), (None, None, "Fee"), ("", "", None)],
        "question string, product_filter string, issue_filter string")
    kept = answers.choose_filter(asked).collect()
    assert [r.question for r in kept] == ["q", None, ""]
    rows = answers.choose_filter(asked, answers.DEFAULT_QUESTION).collect()
    assert [(r.question, r.filter_key, r.filter_value) for r in rows] == [
        ("q", "product", "Card"), (answers.DEFAULT_QUESTION, "issue", "Fee"), (answers.DEFAULT_QUESTION, None, None)]


def test_default_cases(spark):
    cases = answer_eval.default_cases(spark)
    assert cases.where("description = ''").count() == 0
    assert cases.count() == 12 and cases.where("expect_refused").count() == 1


def quantised_search(spark, rows, asked, **options):
    """(query, key, rank, distance) by codes and exactly."""
    stored = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(5)
    questions = spark.createDataFrame(asked, "query_id long, embedding array<float>, question string")
    books = quantised.fit_codebooks(stored, parts=4, codes=16)
    coded = quantised.encode_vectors(stored, books)
    assert {len(r.codes) for r in coded.collect()} <= {4}
    near = quantised.quantised_top_k(coded, stored, questions, books, **options)
    exact = retrieval.top_k(stored, questions, options.get("k", 5))
    shown = lambda f: {(r.query_id, r["rank"], r.chunk_id, round(r.distance, 6)) for r in f.collect()}
    return shown(near), shown(exact), quantised.recall(near, exact).collect()


def clustered(n, width, seed=9):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, width))
    return (middles[rng.integers(0, 12, n)] + rng.normal(scale=0.6, size=(n, width))).astype(np.float32)


def test_codes_find_the_neighbours(spark):
    points = clustered(1_500, 30)  # 30 dimensions leave the last part padded
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    asked = [(i, points[i].tolist(), "x") for i in range(0, 1_500, 20)] + [(-1, points[3].tolist(), "  "), (-2, None, "x")]
    near, exact, recalls = quantised_search(spark, rows, asked)
    assert len(recalls) == 75 and np.mean([r.recall for r in recalls]) >= 0.9
    assert {q for q, *_ in near} == {q for q, *_ in exact} == set(range(0, 1_500, 20))


def test_codes_are_exact_when_all_rows_are_ranked(spark):
    points = clustered(90, 8).tolist()
    rows = [(i, p) for i, p in enumerate([*points, points[0], points[0], [0.0] * 8])] + [(99, None)]
    asked = [(i, points[i], "x") for i in range(7)]
    near, exact, _ = quantised_search(spark, rows, asked, k=5, rerank=20, block_bytes=3 * 64)
    assert near == exact


def test_codes_of_few_rows(spark):
    near, exact, _ = quantised_search(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], [(5, [1.0, 0.1], "x")])
    assert near == exact and len(near) == 2
    with pytest.raises(ValueError):
        quantised.fit_codebooks(spark.createDataFrame([], "embedding array<float>"))


def test_registered_recall(spark):
    """Codes against the exact search, every row with an id divisible by 20 asked."""
    from tallyfern.plans import ask_queries

    recalls = [r.recall for r in ask_queries.approx_recall(spark, "/root/testdata/sf0.01").collect()]
    assert len(recalls) > 0 and sum(recalls) / len(recalls) >= 0.9


def test_first_chunks_of_every_document(spark):
    rows = [(f"c{d}{i}", str(d), i, "t") for d in range(3) for i in (4, 0, 2, 1, 3)]
    chunks = spark.createDataFrame(rows, "chunk_id string, complaint_id string, chunk_index int, text string")
    got = {(r.complaint_id, r.place): r.chunk_index for r in retrieval.chunks_by_document(chunks, 3).collect()}
    assert got == {(str(d), i + 1): i for d in range(3) for i in range(3)}


def paid_prompts(folder):
    """Prompts in the order in which the model was called."""
    return [line for f in sorted(folder.iterdir()) for line in f.read_text().splitlines()]


def test_answers_are_paid_for_once(spark, tmp_path):
    """The process dies in the middle of a run; the next run asks only what no batch had kept."""
    calls, broken = tmp_path / "calls", tmp_path / "broken"
    calls.mkdir()
    broken.touch()
    rows = [(i, f"prompt {i % 40}", i == 50) for i in range(51)]
    prepared = spark.createDataFrame(rows, "query_id long, prompt string, refused boolean").repartition(3)

    def load():
        import os
        import uuid

        name = calls / uuid.uuid4().hex

        def model(prompt):
            if broken.exists() and prompt == "prompt 17":
                os._exit(1)
            with open(name, "a") as out:
                out.write(prompt + "\n")
            if prompt == "prompt 3":
                raise ValueError("no luck")
            return prompt.upper(), 2, 3

        return model

    def run():
        return answer_store.answer_once(prepared, load, str(tmp_path / "store"), "m", batch_prompts=8)

    with pytest.raises(Exception):
        run()
    kept = answer_store.stored_answers(spark, str(tmp_path / "store"))
    kept = set() if kept is None else {r.answer.lower() for r in kept.where("error IS NULL").collect()}
    assert 0 < len(kept) < 40
    broken.unlink()
    before = len(paid_prompts(calls))
    got = {r.query_id: (r.answer, r.total_tokens, r.error) for r in run().collect()}
    second = paid_prompts(calls)
    assert len(second) - before == 40 - len(kept)
    expected = {i: (p.upper(), 5, None) for i, p, _ in rows if i != 50}
    expected[3] = expected[43] = (None, None, "no luck")
    assert got == expected
    run()  # only the failed prompt is asked again
    assert len(paid_prompts(calls)) == len(second) + 1
    other = answer_store.answer_once(prepared.where("query_id < 2"), load, str(tmp_path / "store"), "other")
    assert other.count() == 2 and len(paid_prompts(calls)) == len(second) + 3


def test_encoder_that_gives_another_number_of_vectors(spark):
    texts = spark.createDataFrame([("a",), (None,)], "text string")
    with pytest.raises(Exception, match="shape"):
        encoding.encode_with(texts, lambda: lambda batch: [[1.0]] * 7).collect()
    kept = encoding.encode_with(texts, lambda: lambda batch: [[len(t), 1.0] for t in batch]).collect()
    assert {tuple(r.embedding) for r in kept} == {(1.0, 1.0), (0.0, 1.0)}


def test_counting_by_batch_equals_the_model(spark):
    """The short way through a fitted encoder gives what its own Spark ML stages give."""
    words = ["late", "fee", "Fee", "été", "ßtraße", "漢字", "x1", "--", "İ", "a_b", "½", ""]
    rows = [(str(i), " ".join(words[(i * k) % len(words)] for k in range(i % 17))) for i in range(120)]
    texts = spark.createDataFrame(rows, "id string, text string").repartition(3)
    model, encoded = encoding.fit_and_encode(texts, dimensions=16)
    long = model.transform(texts).select("id", encoding.vector_to_array("_unit", "float32").alias("v"))
    expected = {r.id: np.array(r.v) for r in long.collect()}
    assert encoding._hashed_weights(model) is not None
    for found in (encoded, encoding.encode(texts, model)):
        got = {r.id: np.array(r.embedding) for r in found.collect()}
        assert got.keys() == expected.keys()
        assert all(np.allclose(got[k], expected[k], rtol=3e-7, atol=0) for k in got)


def test_no_word_is_hashed_in_the_scan(spark):
    """An md5 for each word was most of the work of encoding."""
    texts = spark.createDataFrame([("a", "late fee")], "id string, text string")
    model, encoded = encoding.fit_and_encode(texts, dimensions=16)
    for found in (encoded, encoding.encode(texts, model)):
        assert "md5" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_search_of_counts_equals_search_of_vectors(spark):
    rows = [(f"c{i:03d}", " ".join(f"w{(i * k) % 31}" for k in range(1, 2 + i % 11))) for i in range(200)]
    texts = spark.createDataFrame(rows, "chunk_id string, text string").repartition(4)
    model, counted, idf = encoding.fit_and_count(texts, dimensions=32)
    asked = encoding.encode(texts.limit(20), model).select(F.col("chunk_id").alias("query_id"), "embedding")
    long = retrieval.top_k(encoding.encode(texts, model), asked)
    short = retrieval.top_k(counted, asked, stored="_counted", matrix=encoding.unit_matrix(idf))
    assert short.columns == long.columns
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, long.collect()))


def test_letters_are_counted_text_by_text():
    from tallyfern.plans import ask_queries

    texts = ["aeiou nst", "", "Sea sand", "\u00e4 \U0001f600 e"]
    assert ask_queries._load_letter_counter()(texts) == [
        [t.count(c) for c in ask_queries.LETTERS] for t in texts
    ]
