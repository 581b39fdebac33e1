from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyfern.functions import text as tx
from tallyfern.operators import chunking


def apply(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.select("i", column(F.col("t")).alias("o")).orderBy("i").select("o").collect()]


def python_chunks(text, size=300, overlap=50, low=30):
    if len(text) <= size:
        return [text] if len(text) >= low else []
    found, start = [], 0
    while start < len(text):
        found.append(text[start : start + size].strip())
        start += size - overlap
    return [c for c in found if len(c) >= low]


def python_clean(text):
    text = text.strip().replace("–", "-").replace("—", "-")
    return re.sub(r"\s+", " ", re.sub(r"(?i)\bXX+\b", "", text)).strip()


def test_strip_knows_every_blank_python_knows(spark):
    blanks = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and chr(c).strip() == ""]
    assert sorted(blanks) == sorted(tx.BLANKS)
    texts = [f"{b}a{b}b{b}" for b in blanks]
    assert apply(spark, tx.strip, texts) == [f"a{b}b" for b in blanks]


def test_clean_text(spark):
    given = "XX/XX/2020 XXXX xx Xx XXa aXX X XX_1 éXX XXé"
    texts = [
        given,
        None,
        "  a — b \n\tc\x1f ",
        "keep X but not XXXX.",
        "–xx—",
        "   ",
    ]
    got = apply(spark, tx.clean_text, texts)
    assert got[0] == "//2020 XXa aXX X XX_1 éXX XXé"
    assert got[1] == ""
    assert got[2:] == [python_clean(t) for t in texts[2:]]


@pytest.mark.parametrize(
    "length, lengths",
    [
        (29, []),
        (30, [30]),
        (300, [300]),
        (301, [300, 51]),
        (520, [300, 270]),
        (530, [300, 280, 30]),
        (535, [300, 285, 35]),
        (550, [300, 300, 50]),
        (800, [300, 300, 300, 50]),
    ],
)
def test_chunk_lengths(spark, length, lengths):
    assert [len(c) for c in apply(spark, tx.chunk_text, ["a" * length])[0]] == lengths


@pytest.mark.parametrize("size, overlap", [(300, 50), (100, 0), (50, 40), (37, 12)])
def test_chunks_equal_plain_python(spark, size, overlap):
    draw = random.Random(size)
    texts = [
        "".join(draw.choice("ab  é中\U0001f600\n") for _ in range(draw.randint(0, 1200)))
        for _ in range(40)
    ]
    got = apply(spark, lambda c: tx.chunk_text(c, size, overlap, 10), texts)
    assert got == [python_chunks(t, size, overlap, 10) for t in texts]


def test_overlap_must_be_smaller_than_size():
    with pytest.raises(ValueError):
        tx.chunk_text(F.lit("a"), 50, 50)


def test_chunk_id(spark):
    row = spark.range(1).select(tx.chunk_id(F.lit(42), F.lit(0), F.lit("hello world"))).first()
    assert row[0] == "ab44fc0d61fefd49" == hashlib.sha256(b"42:0:hello world").hexdigest()[:16]


DOCS = [
    ("1", "Mortgage", "Fees", "Acme", "2023-01-15", "word " * 130),
    ("2", None, "Fees", "Acme", "2023-01-16", "too short"),
    (None, "Card", "Fees", "Acme", "2023-01-16", "long enough text without an id, dropped"),
    ("3", "Card", "Billing", "Acme", None, "a text of more than thirty characters"),
]
SCHEMA = (
    "complaint_id string, product string, issue string, company string, "
    "date_received string, complaint_narrative string"
)


def test_chunk_table(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    rows = chunking.chunk_table(docs).collect()
    assert sorted((r.complaint_id, r.chunk_index) for r in rows) == [("1", 0), ("1", 1), ("1", 2), ("3", 0)]
    assert {r.complaint_id: r.date for r in rows}["3"] is None
    summary = chunking.index_summary(docs).first()
    assert (summary.n_chunks, summary.documents_used, summary.documents_skipped) == (4, 2, 2)
    again = chunking.chunk_table(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_upsert_is_idempotent_and_can_replace_documents(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    index = chunking.chunk_table(docs)
    again = chunking.upsert_chunks(index, index.unionByName(index))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, index.collect()), key=str)
    edited = docs.where("complaint_id = '1'").withColumn(
        "complaint_narrative", F.lit("an edited narrative of over thirty characters")
    )
    new = chunking.chunk_table(edited)
    assert chunking.upsert_chunks(index, new).count() == 5
    replaced = chunking.upsert_chunks(index, new, replace_documents=True)
    assert sorted(r.complaint_id for r in replaced.collect()) == ["1", "3"]


def test_clean_text_with_every_blank(spark):
    """Blanks of all kinds alone, in runs, at the ends and beside redaction marks."""
    rng = random.Random(5)
    parts = [*tx.BLANKS, "  ", "XX", "xxx", "a", "–", "_"]
    texts = ["".join(rng.choices(parts, k=40)) for _ in range(300)]
    assert apply(spark, tx.clean_text, texts) == [python_clean(t) for t in texts]


def test_windows_take_one_regex_pass(spark):
    cut = spark.range(1).select(tx.chunk_text(F.col("id").cast("string")).alias("cut"))
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_themes_clean_a_text_once(spark):
    from tallyfern.plans import ask_queries

    plan = ask_queries.themes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("regexp_replace(translate(") <= 2  # with and without redaction
