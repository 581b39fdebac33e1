"""The corpus pipeline against a brute-force version, stage by stage."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from llm import fixtures
from llm.test_exact import brute_contamination, brute_fingerprint, brute_groups, brute_quality

from tallyfern.llm import bpe, pii
from tallyfern.sources.session import shared_folder


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(12)
    rows = fixtures.rows()
    mail = f"{fixtures.sentence(rng, 60)} write to jane@example.com or +1 (555) 010-99887 {fixtures.sentence(rng, 9)}"
    rows += [(500 + i, mail, "en", "b", len(mail), "clash", None) for i in range(3)]
    question = fixtures.sentence(rng, 30, 9)
    rows.append((600, f"{fixtures.sentence(rng, 40)} {question}", "en", "b", 1, "x", "y"))
    spark.createDataFrame(rows, fixtures.SCHEMA).repartition(3).write.parquet(f"{place}/documents.parquet")
    items = spark.createDataFrame([(1, question)], "item_id long, text string")
    items.write.parquet(f"{place}/benchmark.parquet")
    return place, rows, question


def survivors(rows, question):
    """(id, text) pairs after the four filtering and masking stages."""
    kept = [r for r in rows if not brute_quality(r[1])[-1]]
    prints = [brute_fingerprint(r[1]) for r in kept]
    groups = {}
    for row, root in zip(kept, brute_groups(prints).tolist()):
        groups.setdefault(root, []).append(row)
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    bad = {d for d, _, _, _, dirty in brute_contamination([("1", question)], [r[:2] for r in kept]) if dirty}
    return {r[0]: r[1] for r in kept if r[0] not in bad}


def test_stages_over_their_predecessors(spark, folder, tmp_path):
    place, rows, question = folder
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "tokens" and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{place}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, place)
        if name != "tokens":
            assert made.columns == columns
        made.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    want = survivors(rows, question)
    masked = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert set(masked) == set(want) and 600 not in masked
    model = pii.SpanClassifier({})
    for doc, row in masked.items():
        base = pii.base_spans(want[doc])
        if not base:
            assert row["text"] == want[doc]
        assert row["n_chars"] == len(row["text"]) and not pii.all_spans(row["text"], model)[0]
    encoder = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.read_ranks(public_tokenizers.path(corpus_pipeline.RANKS)),
        special_tokens={},
    )
    final = docs.collect()
    assert len(final) == len(masked)
    for row in final:
        text = masked[row["doc_id"]]["text"]
        ids = encoder.encode_ordinary(text)
        assert row["n_tokens"] == len(ids) == len(row["ids"]) // 4
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    before = set(Path(shared_folder(spark)).glob("cut-*"))
    again = corpus_pipeline.run(spark, place)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, final), key=str)
    # only the table that the returned rows read is left
    assert len(set(Path(shared_folder(spark)).glob("cut-*")) - before) == 1


def test_empty_documents(spark, tmp_path):
    fixtures.no_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_ids_and_repeated_rows_in_near_duplicates(spark):
    rng = random.Random(13)
    a, b = fixtures.sentence(rng, 80), fixtures.sentence(rng, 80)
    rows = [(None, a), (None, a), (7, b), (7, b), (3, b), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got) == sorted([(-1, a), (3, b)])
