"""Answers kept by content, so that a prompt is paid for once.

An answer belongs to the digest of its prompt, the prompt's version and the model's name.
Prompts without a stored answer are dealt into batches; each batch is answered and
committed as a version of the store before the next begins.  A run that fails leaves all
earlier batches behind, and the next run calls the model for the rest alone.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfern.operators.answers import PROMPT_VERSION, generate_answers
from tallyfern.sources.paths import child_names
from tallyfern.sources.tables import COMMITS, cut_lineage, drop_cut, read_index, write_version

#: Prompts of a batch: what a failed run may have to ask again.
BATCH_PROMPTS = 1_000
KEY = "answer_key"


def answer_key(model: str, version: str = PROMPT_VERSION, prompt: str = "prompt") -> Column:
    """Digest of prompt, version and model; lengths keep their bounds apart."""
    said = [F.lit(version), F.lit(model), F.col(prompt)]
    return F.sha2(F.concat_ws(":", *[x for c in said for x in (F.octet_length(c).cast("string"), c)]), 256)


def stored_answers(spark: SparkSession, store: str) -> DataFrame | None:
    """The answers of a store by their key; None before the first."""
    return read_index(spark, store, KEY) if child_names(spark, f"{store}/{COMMITS}") else None


def answer_once(
    prepared: DataFrame,
    load_model: Callable[[], Callable[[str], tuple[str, int, int]]],
    store: str,
    model: str,
    version: str = PROMPT_VERSION,
    query_key: str = "query_id",
    batch_prompts: int = BATCH_PROMPTS,
    keep_errors: bool = False,
) -> DataFrame:
    """Answers for the prompts that are not refused, by ``query_key``, as
    :func:`generate_answers` gives them, from the store where it has them.

    Equal prompts are asked once.  A raised error is that prompt's answer in this result,
    but is asked again by the next run unless ``keep_errors`` is set.
    """
    spark = prepared.sparkSession
    waiting = prepared.where(~F.col("refused")).select(
        query_key, "prompt", answer_key(model, version).alias(KEY)
    )
    waiting = cut_lineage(waiting)
    prompts = waiting.groupBy(KEY).agg(F.first("prompt").alias("prompt"))
    known = stored_answers(spark, store)
    if known is not None:
        usable = known if keep_errors else known.where("error IS NULL")
        prompts = prompts.join(usable.select(KEY), KEY, "left_anti")
    asked = cut_lineage(prompts.withColumn("refused", F.lit(False)))
    n_batches = math.ceil(asked.count() / batch_prompts)
    numbered = asked.withColumn("_batch", F.pmod(F.xxhash64(KEY, F.lit(1)), F.lit(max(1, n_batches))))
    run = uuid.uuid4().hex
    for number in range(n_batches):
        given = generate_answers(numbered.where(F.col("_batch") == number), load_model, KEY)
        write_version(given, store, f"{run}-{number}", KEY)
        drop_cut(given)
    drop_cut(asked)
    known = stored_answers(spark, store)
    if known is None:
        known = generate_answers(asked.where("false"), load_model, KEY)
    return waiting.drop("prompt").join(known, KEY).drop(KEY)
