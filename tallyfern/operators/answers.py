"""Evidence, prompts, answer records and intelligence records."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfern.functions.text import is_nonempty
from tallyfern.sources.tables import cut_lineage

# Thresholds, cut-offs, texts and formats of answers.
MIN_SIMILARITY = 0.25
HIGH, MEDIUM = 0.7, 0.4
PROMPT_VERSION = "excerpts-1"
REFUSAL_MESSAGE = (
    "I cannot provide a reliable answer to this question. "
    "The retrieved complaint evidence does not contain sufficient relevant information "
    "to address your query with confidence. Please try rephrasing your question or "
    "providing more context."
)
BLANK_QUESTION_MESSAGE = "Please provide a non-empty question."
BLANK_QUESTION_NOTE = "No question provided."
NO_EVIDENCE_NOTE = "No relevant evidence above similarity threshold."
EVIDENCE_NOTE = "Evidence quality: %s (avg_similarity=%.3f, max_similarity=%.3f, n_chunks=%d)"
EVIDENCE_ITEM = "%d. [Complaint ID: %s | Product: %s | Company: %s | Date: %s]\n   %s"
ERROR_PREFIX = "LLM error: "
DEFAULT_QUESTION = "What are common product complaints and issues?"
CHUNK_LABEL, LABEL_ID_LENGTH = "Chunk %d: %s\u2026", 8
THEME_NAME = "Complaint theme "
THEME_PARTS = 3

#: Our own wording, under our own version; pass another template with its version.
PROMPT_TEMPLATE = """A reader asks: {question}

{n_chunks} excerpts were found:
{evidence_block}

Reply in at most five sentences.
"""

ANSWER_COLUMNS = (
    "question", "answer", "refused", "evidence_ids", "evidence_sufficiency",
    "prompt_version", "retrieval_count", "token_usage", "latency_ms", "model",
)
#: Tasks that the customers of one question are dealt to.
INTEL_SALTS = 16
TOKEN_USAGE = "struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>"


def tier(score: Column) -> Column:
    """HIGH, MEDIUM or LOW: the cut-offs of evidence quality and conversion."""
    return F.when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").otherwise("LOW")


def sufficient_chunks(ranked: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    return ranked.where(F.col("similarity") >= min_similarity)


def evidence_tiers(ranked: DataFrame) -> DataFrame:
    """Every chunk with the tier of its similarity and a short label."""
    label = F.format_string(CHUNK_LABEL, F.col("rank"), F.substring("chunk_id", 1, LABEL_ID_LENGTH))
    return ranked.withColumn("tier", tier(F.col("similarity"))).withColumn("label", label)


def _shown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def evidence_by_question(
    ranked: DataFrame, query_key: str = "query_id", min_similarity: float = MIN_SIMILARITY
) -> DataFrame:
    """One row per question with any result: counts, ids, block, quality note.

    A question has at most k results, so its group is small by construction.
    """
    good = F.col("similarity") >= min_similarity
    item = F.struct(
        "rank", "chunk_id", "complaint_id", "similarity", *[
            _shown(c).alias(c) for c in ("product", "company", "date", "text")
        ]
    )
    grouped = ranked.groupBy(query_key).agg(
        F.count(F.lit(1)).alias("retrieval_count"),
        F.array_sort(F.collect_list(F.when(good, item))).alias("_items"),
    )
    items = F.col("_items")
    n = F.size(items)
    scores = F.transform(items, lambda x: x["similarity"])
    mean = F.aggregate(scores, F.lit(0.0), lambda total, s: total + s) / n
    block = F.transform(
        items,
        lambda x, i: F.format_string(
            EVIDENCE_ITEM,
            i + 1,
            F.coalesce(x["complaint_id"].cast("string"), F.lit("")),
            x["product"],
            x["company"],
            x["date"],
            x["text"],
        ),
    )
    note = F.format_string(EVIDENCE_NOTE, tier(mean), mean, F.array_max(scores), n)
    return grouped.select(
        query_key,
        "retrieval_count",
        n.alias("n_chunks"),
        F.transform(items, lambda x: x["chunk_id"]).alias("evidence_ids"),
        F.transform(items, lambda x: x["complaint_id"]).alias("complaint_ids"),
        F.array_join(block, "\n\n").alias("evidence_block"),
        F.when(n > 0, tier(mean)).alias("evidence_quality"),
        F.when(n > 0, note).otherwise(F.lit("No relevant evidence found.")).alias(
            "evidence_sufficiency"
        ),
    )


def prompt(template: str = PROMPT_TEMPLATE) -> Column:
    """The filled template; question text is never searched for placeholders."""
    marks = {"{question}": "question", "{n_chunks}": "n_chunks", "{evidence_block}": "evidence_block"}
    pieces, rest = [], template
    while rest:
        found = [(rest.find(m), m) for m in marks if m in rest]
        if not found:
            pieces.append(F.lit(rest))
            break
        at, mark = min(found)
        pieces += [F.lit(rest[:at]), F.col(marks[mark]).cast("string")]
        rest = rest[at + len(mark) :]
    return F.concat(*pieces)


def prepare_questions(
    questions: DataFrame,
    ranked: DataFrame,
    query_key: str = "query_id",
    min_similarity: float = MIN_SIMILARITY,
    template: str = PROMPT_TEMPLATE,
) -> DataFrame:
    """Every question once, with its evidence and the prompt to be answered.

    ``refused`` is set when there is nothing to answer from; such rows have no
    prompt, so no text is generated for them.
    """
    evidence = evidence_by_question(ranked, query_key, min_similarity)
    joined = questions.join(evidence, query_key, "left")
    asked = is_nonempty(F.col("question"))
    grounded = asked & F.coalesce(F.col("n_chunks") > 0, F.lit(False))
    empty = F.array().cast("array<string>")
    return joined.select(
        *questions.columns,
        F.when(asked, F.coalesce("retrieval_count", F.lit(0))).otherwise(0).cast("bigint").alias(
            "retrieval_count"
        ),
        F.when(grounded, F.col("n_chunks")).otherwise(0).alias("n_chunks"),
        F.when(grounded, F.col("evidence_ids")).otherwise(empty).alias("evidence_ids"),
        F.when(grounded, F.col("complaint_ids")).otherwise(empty).alias("complaint_ids"),
        F.when(grounded, F.col("evidence_block")).alias("evidence_block"),
        F.when(~asked, BLANK_QUESTION_NOTE)
        .when(~grounded, NO_EVIDENCE_NOTE)
        .otherwise(F.col("evidence_sufficiency"))
        .alias("evidence_sufficiency"),
        F.when(~asked, BLANK_QUESTION_MESSAGE).when(~grounded, REFUSAL_MESSAGE).alias("_refusal"),
        (~grounded).alias("refused"),
        F.when(grounded, prompt(template)).alias("prompt"),
    )


def generate_answers(
    prepared: DataFrame,
    load_model: Callable[[], Callable[[str], tuple[str, int, int]]],
    query_key: str = "query_id",
) -> DataFrame:
    """Answers of a user's model for the prompts that are not refused.

    ``load_model`` runs once per task; the function it returns maps a prompt to
    text, prompt tokens and completion tokens.  A raised error becomes the row's
    error text.  The answers are written to the shared folder here, so that no later
    use of them calls the model again; ``prepared`` is best cut by the caller too.
    """
    kind = prepared.schema[query_key].dataType.simpleString()
    schema = (
        f"`{query_key}` {kind}, answer string, prompt_tokens int, completion_tokens int, "
        "total_tokens int, latency_ms double, error string"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        model = load_model()
        for batch in batches:
            out = []
            for key, text in zip(batch[query_key], batch["prompt"]):
                begun = time.perf_counter()
                try:
                    answer, asked, given = model(text)
                    row = [key, answer, asked, given, asked + given]
                    error = None
                except Exception as exc:
                    row, error = [key, None, None, None, None], str(exc)
                out.append([*row, (time.perf_counter() - begun) * 1000, error])
            names = ["answer", "prompt_tokens", "completion_tokens", "total_tokens"]
            yield pd.DataFrame(out, columns=[query_key, *names, "latency_ms", "error"])

    waiting = prepared.where(~F.col("refused")).select(query_key, "prompt")
    return cut_lineage(waiting.mapInPandas(run, schema))


def answer_records(
    prepared: DataFrame,
    answers: DataFrame,
    query_key: str = "query_id",
    model: str = "",
    version: str = PROMPT_VERSION,
) -> DataFrame:
    """The ten-field record of every question, refused ones included.

    ``answers`` has the key, ``answer``, three token counts, ``error`` and
    optionally ``latency_ms``.  A failed answer is refused but keeps its ids.
    """
    given = answers.select(
        query_key,
        F.col("answer").alias("_answer"),
        F.struct("prompt_tokens", "completion_tokens", "total_tokens")
        .cast(TOKEN_USAGE)
        .alias("_tokens"),
        F.col("error").alias("_error"),
        (F.col("latency_ms") if "latency_ms" in answers.columns else F.lit(0.0)).alias("_latency"),
    )
    joined = prepared.join(given, query_key, "left")
    failed = F.coalesce(F.col("_error"), F.when(F.col("_answer").isNull(), F.lit("no answer")))
    unanswered = F.col("refused") | failed.isNotNull()
    return joined.select(
        query_key,
        "question",
        F.when(F.col("refused"), F.col("_refusal"))
        .when(failed.isNotNull(), F.concat(F.lit(ERROR_PREFIX), failed))
        .otherwise(F.col("_answer"))
        .alias("answer"),
        unanswered.alias("refused"),
        "evidence_ids",
        "evidence_sufficiency",
        F.lit(version).alias("prompt_version"),
        "retrieval_count",
        F.when(~unanswered, F.col("_tokens")).alias("token_usage"),
        F.round(F.coalesce(F.when(~F.col("refused"), F.col("_latency")), F.lit(0.0)), 3).alias(
            "latency_ms"
        ),
        F.lit(model).alias("model"),
        "complaint_ids",
    )


def themes(ids: Column, start_below: int | None = None) -> Column:
    """Evidence ids in runs of ``max(1, n // 3)``; every id is in one.

    With ``start_below`` only runs that start before that place are made.
    """
    n = F.size(ids)
    size = F.greatest(F.lit(1), F.floor(n / THEME_PARTS).cast("int"))
    last = n if start_below is None else F.least(n, F.lit(start_below))
    starts = F.sequence(F.lit(0), last - 1, size)
    groups = F.transform(
        starts,
        lambda start, i: F.struct(
            F.concat(F.lit(THEME_NAME), (i + 1).cast("string")).alias("theme"),
            F.slice(ids, start + 1, size).alias("evidence_ids"),
        ),
    )
    return F.when(n > 0, groups).otherwise(
        F.array().cast("array<struct<theme:string,evidence_ids:array<string>>>")
    )


def cited_ids(ids: Column) -> Column:
    """Distinct ids in first-seen order."""
    return F.array_distinct(ids)


def theme_counts(records: DataFrame, query_key: str = "query_id") -> DataFrame:
    """Evidence chunks per theme of every record."""
    return records.select(query_key, F.inline(themes(F.col("evidence_ids")))).select(
        query_key, "theme", F.size("evidence_ids").alias("n_chunks")
    )


def choose_filter(requests: DataFrame, default_question: str | None = None) -> DataFrame:
    """Questions with one metadata filter: the product wins over the issue, which wins
    over an optional date.  An empty or missing question becomes
    ``default_question`` if one is given, else it stays as it is."""
    keys = [k for k in ("product", "issue", "date") if f"{k}_filter" in requests.columns]
    key = value = None
    for name in keys:
        given = F.col(f"{name}_filter")
        use = F.coalesce(given != "", F.lit(False))
        key = F.when(use, F.lit(name)) if key is None else key.when(use, F.lit(name))
        value = F.when(use, given) if value is None else value.when(use, given)
    missing = F.lit(None).cast("string")
    text = F.when(F.coalesce(F.col("question") != "", F.lit(False)), F.col("question"))
    return requests.withColumns(
        {
            "question": F.col("question")
            if default_question is None
            else text.otherwise(F.lit(default_question)),
            "filter_key": missing if key is None else key,
            "filter_value": missing if value is None else value,
        }
    )


def customer_intel(
    scored: DataFrame,
    records: DataFrame,
    key: str = "request_id",
    model_version: str = "",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Every scored customer once, with the answer to its question where there is one.

    ``records`` has one row per key; any number of customers may share it, so its
    rows are repeated per salt and a hot question's customers spread over tasks.
    """
    answered = records.select(
        key,
        F.col("question").alias("complaint_question"),
        F.col("answer").alias("complaint_answer"),
        F.col("refused").alias("complaint_refused"),
        themes(F.col("evidence_ids")).alias("complaint_themes"),
        cited_ids(F.col("complaint_ids")).alias("cited_complaint_ids"),
        cited_ids(F.col("evidence_ids")).alias("cited_chunk_ids"),
        "evidence_sufficiency",
    )
    profile = scored.select(
        key,
        *keep,
        F.round("probability", 6).alias("conversion_probability"),
        F.col("prediction").alias("conversion_prediction"),
        tier(F.col("probability")).alias("conversion_band"),
        F.lit(model_version).alias("model_version"),
    )
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in (keep or [key])]), F.lit(INTEL_SALTS)).cast("int")
    copies = answered.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(INTEL_SALTS - 1))))
    return profile.withColumn("_salt", salt).join(copies, [key, "_salt"], "left").drop("_salt")
