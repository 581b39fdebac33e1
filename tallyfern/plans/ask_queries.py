"""Registered queries for retrieval, evidence, answers and intelligence records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfern.functions.text import chunk_text, clean_text
from tallyfern.operators import answer_eval, answer_store, answers, encoding, quantised, retrieval
from tallyfern.plans.table_queries import table
from tallyfern.plans.text_queries import CHUNKS_SQL, chunks
from tallyfern.sources.session import shared_folder
from tallyfern.sources.tables import cut_lineage

DIMENSIONS = encoding.DIMENSIONS
TIGHT_DISTANCE = 0.6
STRONG_SIMILARITY = 0.75
VECTOR_REFUSAL = 0.65


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20 asks for its neighbours among all rows."""
    asked = vectors(spark, sf_dir).where("vec_id % 20 = 0")
    return asked.withColumnRenamed("vec_id", "query_id")


def _near(found: DataFrame) -> DataFrame:
    return found.select(
        "query_id",
        "vec_id",
        "rank",
        F.round("distance", 6).alias("distance"),
    )


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = vector_questions(spark, sf_dir).drop("label")
    return _near(retrieval.top_k(vectors(spark, sf_dir), asked, chunk_key="vec_id"))


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector searches the label after its own, for as many results as that says."""
    questions = vector_questions(spark, sf_dir).select(
        "query_id",
        "embedding",
        F.lit("label").alias("filter_key"),
        ((F.col("label") + 1) % 10).cast("string").alias("filter_value"),
        (F.col("label") + 1).alias("top_k"),
    )
    return _near(retrieval.top_k(vectors(spark, sf_dir), questions, chunk_key="vec_id"))


def refused_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the 20 nearest of each vector survive a tight refusal distance."""
    asked = vector_questions(spark, sf_dir).drop("label")
    kept = retrieval.retrieve(vectors(spark, sf_dir), asked, 20, VECTOR_REFUSAL, chunk_key="vec_id")
    return kept.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_kept"), F.round(F.max("similarity"), 6).alias("best_similarity")
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items as questions, and blank ones under ids of their own."""
    items = table(spark, sf_dir, "benchmark")
    blank = items.where("item_id % 10 = 0").select(
        (-1 - F.col("item_id")).alias("query_id"), F.lit("  ").alias("question")
    )
    return items.select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    ).unionByName(blank)


def _retrieved(
    spark: SparkSession, sf_dir: str, refusal: float = retrieval.REFUSAL_DISTANCE
) -> tuple[DataFrame, DataFrame]:
    model, index, idf = encoding.fit_and_count(chunks(spark, sf_dir))
    asked = questions(spark, sf_dir)
    encoded = encoding.encode(asked.withColumnRenamed("question", "text"), model)
    encoded = encoded.withColumnRenamed("text", "question")
    found = retrieval.retrieve(
        index, encoded, refusal_distance=refusal, stored="_counted", matrix=encoding.unit_matrix(idf)
    )
    return asked, found


def ask_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _retrieved(spark, sf_dir)
    return found.select(
        "query_id",
        "rank",
        "chunk_id",
        "complaint_id",
        F.round("distance", 6).alias("distance"),
        F.round("similarity", 6).alias("similarity"),
    )


def evidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _retrieved(spark, sf_dir)
    return answers.evidence_tiers(found).select("query_id", "chunk_id", "tier", "label")


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, found = _retrieved(spark, sf_dir, TIGHT_DISTANCE)
    return answers.prepare_questions(asked, found, min_similarity=STRONG_SIMILARITY)


def evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, found = _retrieved(spark, sf_dir, TIGHT_DISTANCE)
    return answers.evidence_by_question(found, min_similarity=STRONG_SIMILARITY).select(
        "query_id",
        "retrieval_count",
        "n_chunks",
        F.array_join("evidence_ids", ",").alias("evidence_ids"),
        "evidence_block",
        "evidence_quality",
        "evidence_sufficiency",
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).select("query_id", "refused", "prompt", "evidence_sufficiency")


def given_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first assistant turn of each conversation as an answer; some failed."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    failed = F.pmod("conv_id", F.lit(7)) == 3
    return first.select(
        F.col("conv_id").alias("query_id"),
        F.when(~failed, F.col("text")).alias("answer"),
        F.length("text").alias("prompt_tokens"),
        F.lit(10).alias("completion_tokens"),
        (F.length("text") + 10).alias("total_tokens"),
        F.when(failed, F.lit("timeout")).alias("error"),
    )


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.answer_records(
        _prepared(spark, sf_dir), given_answers(spark, sf_dir), model="given"
    )


def answer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select(
        "query_id",
        "question",
        "answer",
        "refused",
        F.array_join("evidence_ids", ",").alias("evidence_ids"),
        "evidence_sufficiency",
        "prompt_version",
        "retrieval_count",
        F.col("token_usage.total_tokens").alias("total_tokens"),
        "model",
    )


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes over the windows of every document, listed as ``document:window``."""
    # The cleaned text is a column of its own: windows name it several times.
    cleaned = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), clean_text(F.col("text")).alias("clean")
    )
    listed = cleaned.select(
        "query_id",
        F.transform(
            chunk_text(F.col("clean")),
            lambda p, i: F.concat_ws(
                ":", F.col("query_id").cast("string"), i.cast("string"), F.length(p).cast("string")
            ),
        ).alias("evidence_ids"),
    )
    rows = listed.select("query_id", F.inline(answers.themes(F.col("evidence_ids"))))
    return rows.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


def theme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.theme_counts(_records(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = questions(spark, sf_dir).select(
        "query_id", (F.trim("question") == "").alias("expect_refused")
    )
    return answer_eval.judge_cases(cases, _records(spark, sf_dir))


def answer_eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select(
        "query_id",
        "expect_refused",
        "actual_refused",
        "answer_present",
        "refusal_correct",
        "evidence_ids_present",
        "prompt_version_ok",
        "passed",
        "answer_preview",
    )


def answer_eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_eval.eval_report(_judged(spark, sf_dir))


_ASK_SQL = rf"""
{CHUNKS_SQL}, asked AS (
  SELECT item_id AS query_id, text AS question FROM benchmark
  UNION ALL SELECT -1 - item_id, '  ' FROM benchmark WHERE item_id % 10 = 0
), words AS (
  SELECT chunk_id AS id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM chunks
), counted AS (
  SELECT id, CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % {DIMENSIONS} AS b, count(*) AS n
  FROM words GROUP BY 1, 2
), idf AS (
  SELECT b, ln((m + 1) / (count(*) + 1)::DOUBLE) AS idf
  FROM counted, (SELECT count(*) AS m FROM chunks) GROUP BY b, m
), weighed AS (
  SELECT id, b, n * coalesce(idf, ln(m + 1.0)) AS w FROM counted LEFT JOIN idf USING (b),
         (SELECT count(*) AS m FROM chunks)
), unit AS (
  SELECT id, b, CAST(CAST(w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS w
  FROM weighed
), chunk_unit AS (
  SELECT id, b, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM unit
), q_words AS (
  SELECT query_id AS id, unnest(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}]+')) AS w FROM asked
), q_counted AS (
  SELECT id, CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % {DIMENSIONS} AS b, count(*) AS n
  FROM q_words GROUP BY 1, 2
), q_weighed AS (
  SELECT id, b, n * coalesce(idf, ln(m + 1.0)) AS w FROM q_counted LEFT JOIN idf USING (b),
         (SELECT count(*) AS m FROM chunks)
), q_unit AS (
  SELECT id, b, CAST(CAST(w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS w
  FROM q_weighed
), question_unit AS (
  SELECT id, b, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM q_unit
), distances AS (
  SELECT q.id AS query_id, c.id AS chunk_id, round(1 - sum(q.w * c.w), 9) AS distance
  FROM question_unit q JOIN chunk_unit c USING (b) GROUP BY 1, 2
), top AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER)
           AS rank
    FROM distances) WHERE rank <= 5
)"""


def found_sql(refusal: float) -> str:
    return _ASK_SQL + f""", found AS (
  SELECT t.query_id, t.rank, t.distance, greatest(0, 1 - t.distance / 2) AS similarity, c.*
  FROM top t JOIN chunks c USING (chunk_id) WHERE t.distance < {refusal}::DOUBLE
)"""


_EVIDENCE_SQL = found_sql(TIGHT_DISTANCE) + f""", good AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i
  FROM found WHERE similarity >= {STRONG_SIMILARITY}::DOUBLE
), evidence AS (
  SELECT query_id, count(*) AS retrieval_count FROM found GROUP BY 1
), lists AS (
  SELECT query_id, CAST(count(*) AS INTEGER) AS n_chunks,
         string_agg(chunk_id, ',' ORDER BY i) AS evidence_ids,
         list(chunk_id ORDER BY i) AS ids, list(complaint_id ORDER BY i) AS complaints,
         string_agg(i || '. [Complaint ID: ' || complaint_id || ' | Product: ' || product ||
                    ' | Company: ' || company || ' | Date: ]' || chr(10) || '   ' || text,
                    chr(10) || chr(10) ORDER BY i) AS evidence_block,
         avg(similarity) AS mean, max(similarity) AS best
  FROM good GROUP BY 1
), described AS (
  SELECT query_id, retrieval_count, coalesce(n_chunks, 0) AS n_chunks,
         coalesce(evidence_ids, '') AS evidence_ids, coalesce(evidence_block, '') AS evidence_block,
         coalesce(ids, []) AS ids, coalesce(complaints, []) AS complaints,
         CASE WHEN mean >= 0.7 THEN 'HIGH' WHEN mean >= 0.4 THEN 'MEDIUM' WHEN mean IS NOT NULL
              THEN 'LOW' END AS evidence_quality,
         CASE WHEN mean IS NULL THEN 'No relevant evidence found.' ELSE
           'Evidence quality: ' || CASE WHEN mean >= 0.7 THEN 'HIGH' WHEN mean >= 0.4 THEN 'MEDIUM'
                                        ELSE 'LOW' END
           || printf(' (avg_similarity=%.3f, max_similarity=%.3f, n_chunks=%d)', mean, best, n_chunks)
         END AS evidence_sufficiency
  FROM evidence LEFT JOIN lists USING (query_id)
), prepared AS (
  SELECT a.query_id, a.question, trim(a.question) <> '' AS asked,
         trim(a.question) <> '' AND coalesce(n_chunks, 0) > 0 AS grounded,
         coalesce(retrieval_count, 0) AS retrieval_count, n_chunks, evidence_ids, ids, complaints,
         evidence_block, evidence_sufficiency
  FROM asked a LEFT JOIN described USING (query_id)
)"""
_NOTE_SQL = f"""CASE WHEN NOT asked THEN '{answers.BLANK_QUESTION_NOTE}'
     WHEN NOT grounded THEN '{answers.NO_EVIDENCE_NOTE}' ELSE evidence_sufficiency END"""
_HEAD, _MIDDLE, _TAIL = (
    part.replace("'", "''")
    for part in (
        answers.PROMPT_TEMPLATE.split("{question}")[0],
        answers.PROMPT_TEMPLATE.split("{question}")[1].split("{n_chunks}")[0],
        answers.PROMPT_TEMPLATE.split("{evidence_block}")[1],
    )
)
_JOINT = answers.PROMPT_TEMPLATE.split("{n_chunks}")[1].split("{evidence_block}")[0]
RECORDS_SQL = _EVIDENCE_SQL + f""", given AS (
  SELECT conv_id AS query_id, min_by(text, turn) AS text, conv_id % 7 = 3 AS failed
  FROM conversations WHERE role = 'assistant' GROUP BY 1
), records AS (
  SELECT query_id, question,
         CASE WHEN NOT asked THEN '{answers.BLANK_QUESTION_MESSAGE}'
              WHEN NOT grounded THEN '{answers.REFUSAL_MESSAGE}'
              WHEN text IS NULL THEN 'LLM error: no answer'
              WHEN failed THEN 'LLM error: timeout' ELSE text END AS answer,
         NOT grounded OR text IS NULL OR failed AS refused,
         CASE WHEN grounded THEN evidence_ids ELSE '' END AS evidence_ids,
         CASE WHEN grounded THEN ids ELSE [] END AS ids,
         CASE WHEN grounded THEN complaints ELSE [] END AS complaints,
         {_NOTE_SQL} AS evidence_sufficiency, '{answers.PROMPT_VERSION}' AS prompt_version, retrieval_count,
         CASE WHEN grounded AND NOT failed THEN CAST(length(text) + 10 AS INTEGER) END
           AS total_tokens, 'given' AS model
  FROM prepared LEFT JOIN given USING (query_id)
)"""
_JUDGED_SQL = RECORDS_SQL + f""", judged AS (
  SELECT query_id, trim(b.question) = '' AS expect_refused, r.refused AS actual_refused,
         r.answer <> '' AND NOT r.refused AS answer_present,
         r.refused = (trim(b.question) = '') AS refusal_correct,
         len(r.ids) > 0 AS evidence_ids_present, r.prompt_version = '{answers.PROMPT_VERSION}' AS prompt_version_ok,
         substring(r.answer, 1, 200) AS answer_preview
  FROM asked b JOIN records r USING (query_id)
), verdicts AS (
  SELECT *, CASE WHEN expect_refused THEN refusal_correct
                 ELSE answer_present AND evidence_ids_present AND prompt_version_ok END AS passed
  FROM judged
)"""
_PAIRS_SQL = """
pairs AS (
  SELECT q.vec_id AS query_id, q.label AS asked_label, e.vec_id, e.label,
         round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9)
           AS distance
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0
)"""


def _rank_sql(k: str, condition: str = "true") -> str:
    return f"""ranked AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank
    FROM pairs WHERE {condition}) WHERE rank <= {k}
)"""


def filter_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as requests with a product filter, an issue filter, both or none."""
    requests = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("question"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("product_filter"),
        F.when(F.col("c_acctbal") > 3000, F.col("c_nationkey").cast("string"))
        .otherwise("")
        .alias("issue_filter"),
    )
    return answers.choose_filter(requests, answers.DEFAULT_QUESTION).select(
        "c_custkey", "question", "filter_key", "filter_value"
    )


CELLS = 8


def approx_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored by cell and every cell searched: the exact result."""
    stored = vectors(spark, sf_dir)
    cells = retrieval.fit_cells(stored, CELLS)
    place = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    retrieval.assign_cells(stored, cells).write.partitionBy("cell").parquet(place)
    asked = vector_questions(spark, sf_dir).drop("label")
    celled = spark.read.parquet(place)
    return _near(retrieval.approx_top_k(celled, asked, cells, CELLS, chunk_key="vec_id"))


def approx_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows by product-quantised codes, the best of them ranked exactly."""
    stored = vectors(spark, sf_dir)
    books = quantised.fit_codebooks(stored)
    coded = cut_lineage(quantised.encode_vectors(stored.select("vec_id", "embedding"), books))
    asked = vector_questions(spark, sf_dir).drop("label")
    return _near(quantised.quantised_top_k(coded, stored, asked, books, chunk_key="vec_id"))


def approx_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each question's exact results that the codes find."""
    return quantised.recall(approx_topk(spark, sf_dir), knn_topk(spark, sf_dir), "vec_id")


def chunks_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunks of every document, by place."""
    return retrieval.chunks_by_document(chunks(spark, sf_dir)).select(
        "chunk_id", "complaint_id", "chunk_index", "text"
    )


#: Letters that the demonstration encoder counts.
LETTERS = "aeiounst"


def _load_letter_counter():
    """An encoder as a model would be: a batch of texts in, one vector a text out."""

    def encode(texts: list[str]) -> list[list[int]]:
        return [[text.count(letter) for letter in LETTERS] for text in texts]

    return encode


def encoded_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk encoded in batches by a loaded encoder."""
    encoded = encoding.encode_with(chunks(spark, sf_dir), _load_letter_counter)
    return encoded.select(
        "chunk_id", *[F.col("embedding")[i].cast("double").alias(f"n_{c}") for i, c in enumerate(LETTERS)]
    )


def _load_echo():
    """A model that answers with the length of its prompt; some prompts fail."""

    def answer(prompt: str) -> tuple[str, int, int]:
        if len(prompt) % 7 == 0:
            raise ValueError("out of words")
        return f"{len(prompt)} characters", len(prompt), 2

    return answer


def stored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt answered through the store, twice: the second run finds the answers."""
    prepared = cut_lineage(_prepared(spark, sf_dir))
    store = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    for _ in range(2):
        given = answer_store.answer_once(prepared, _load_echo, store, "echo")
    records = answers.answer_records(prepared, given, model="echo")
    return records.select(
        "query_id", "answer", "refused", F.col("token_usage.total_tokens").alias("total_tokens")
    )


QUERIES = {
    "encoded_by_model": encoded_by_model,
    "stored_answers": stored_answers,
    "approx_topk": approx_topk,
    "approx_all_cells": approx_all_cells,
    "approx_recall": approx_recall,
    "chunks_of_document": chunks_of_document,
    "filter_choice": filter_choice,
    "knn_topk": knn_topk,
    "knn_filtered": knn_filtered,
    "refused_queries": refused_queries,
    "ask_topk": ask_topk,
    "evidence_tiers": evidence_tiers,
    "evidence_blocks": evidence_blocks,
    "prompts": prompts,
    "answer_records": answer_records,
    "themes": themes,
    "theme_counts": theme_counts,
    "answer_eval_cases": answer_eval_cases,
    "answer_eval_report": answer_eval_report,
}

ORACLES = {
    "encoded_by_model": f"""WITH {CHUNKS_SQL}
SELECT chunk_id, {", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE) AS n_{c}" for c in LETTERS)}
FROM chunks""",
    "stored_answers": f"""WITH {_EVIDENCE_SQL}, sized AS (
  SELECT query_id, question, grounded,
         length('{_HEAD}' || question || '{_MIDDLE}' || n_chunks || '{_JOINT}' || evidence_block || '{_TAIL}') AS n
  FROM prepared
)
SELECT query_id, CASE WHEN NOT grounded AND trim(question) = '' THEN '{answers.BLANK_QUESTION_MESSAGE}'
                      WHEN NOT grounded THEN '{answers.REFUSAL_MESSAGE}'
                      WHEN n % 7 = 0 THEN '{answers.ERROR_PREFIX}' || 'out of words'
                      ELSE n || ' characters' END AS answer,
       NOT grounded OR n % 7 = 0 AS refused,
       CASE WHEN grounded AND n % 7 <> 0 THEN CAST(n + 2 AS INTEGER) END AS total_tokens FROM sized""",
    "filter_choice": f"""
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_name ELSE '{answers.DEFAULT_QUESTION}' END AS question,
       CASE WHEN c_mktsegment <> 'BUILDING' THEN 'product' WHEN c_acctbal > 3000 THEN 'issue' END
         AS filter_key,
       CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment
            WHEN c_acctbal > 3000 THEN CAST(c_nationkey AS VARCHAR) END AS filter_value
FROM customer""",
    "chunks_of_document": f"""WITH {CHUNKS_SQL}
SELECT chunk_id, complaint_id, chunk_index, text FROM chunks
QUALIFY row_number() OVER (PARTITION BY complaint_id ORDER BY chunk_index, chunk_id) <= {retrieval.DOCUMENT_TOP_K}""",
    "approx_all_cells": f"""WITH {_PAIRS_SQL}, {_rank_sql("5")}
SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM ranked""",
    "knn_topk": f"""WITH {_PAIRS_SQL}, {_rank_sql("5")}
SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM ranked""",
    "knn_filtered": f"""WITH {_PAIRS_SQL}, {_rank_sql("asked_label + 1", "label = (asked_label + 1) % 10")}
SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM ranked""",
    "refused_queries": f"""WITH {_PAIRS_SQL}, {_rank_sql("20")}
SELECT query_id, count(*) AS n_kept, round(max(1 - distance / 2), 6) AS best_similarity
FROM ranked WHERE distance < {VECTOR_REFUSAL}::DOUBLE GROUP BY query_id""",
    "ask_topk": f"""WITH {found_sql(retrieval.REFUSAL_DISTANCE)}
SELECT query_id, rank, chunk_id, complaint_id, round(distance, 6) AS distance,
       round(similarity, 6) AS similarity FROM found""",
    "evidence_tiers": f"""WITH {found_sql(retrieval.REFUSAL_DISTANCE)}
SELECT query_id, chunk_id, 'Chunk ' || rank || ': ' || substring(chunk_id, 1, 8) || chr(8230) AS label,
       CASE WHEN similarity >= 0.7 THEN 'HIGH' WHEN similarity >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END
         AS tier FROM found""",
    "evidence_blocks": f"""WITH {_EVIDENCE_SQL}
SELECT query_id, retrieval_count, n_chunks, evidence_ids, evidence_block, evidence_quality,
       evidence_sufficiency FROM described""",
    "prompts": f"""WITH {_EVIDENCE_SQL}
SELECT query_id, NOT grounded AS refused, {_NOTE_SQL} AS evidence_sufficiency,
       CASE WHEN grounded THEN '{_HEAD}' || question || '{_MIDDLE}' || n_chunks || '{_JOINT}'
            || evidence_block || '{_TAIL}' END AS prompt FROM prepared""",
    "answer_records": f"""WITH {RECORDS_SQL}
SELECT query_id, question, answer, refused, evidence_ids, evidence_sufficiency, prompt_version,
       retrieval_count, total_tokens, model FROM records""",
    "themes": f"""WITH {CHUNKS_SQL}, lists AS (
  SELECT doc_id AS query_id,
         list_transform(ks, lambda k, i: doc_id || ':' || (i - 1) || ':' || length(k)) AS ids
  FROM pieces
), sized AS (
  SELECT query_id, ids, greatest(1, len(ids) // 3) AS size, len(ids) AS upto FROM lists
), starts AS (
  SELECT query_id, ids, size, unnest(range(0, upto, size)) AS s FROM sized
)
SELECT query_id, 'Complaint theme ' || (s // size + 1) AS theme,
       array_to_string(ids[s + 1 : s + size], ',') AS evidence_ids FROM starts""",
    "theme_counts": f"""WITH {RECORDS_SQL}, sized AS (
  SELECT query_id, ids, greatest(1, len(ids) // 3) AS size, len(ids) AS upto FROM records
), starts AS (
  SELECT query_id, ids, size, unnest(range(0, upto, size)) AS s FROM sized
)
SELECT query_id, 'Complaint theme ' || (s // size + 1) AS theme,
       CAST(len(ids[s + 1 : s + size]) AS INTEGER) AS n_chunks FROM starts""",
    "answer_eval_cases": f"""WITH {_JUDGED_SQL} SELECT * FROM verdicts""",
    "answer_eval_report": f"""WITH {_JUDGED_SQL}
SELECT count(*) AS total_cases, count(*) FILTER (WHERE passed) AS passed,
       count(*) FILTER (WHERE NOT passed) AS failed,
       round(count(*) FILTER (WHERE passed) / count(*)::DOUBLE, 4) AS pass_rate FROM verdicts""",
}
