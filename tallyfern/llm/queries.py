"""Registered queries of the numbered operators: thin digests of their outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfern.llm import (
    bpe,
    conversations,
    decontamination,
    divergence,
    html_extraction,
    language_id,
    line_quality,
    merge_automaton,
    pii,
    simhash,
    substrings,
    toxicity,
    warc,
)
from tallyfern.sources.readers import read_table

RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_MERGES = "word_bpe_49k.json"
#: Keys by which a table smaller than a split is dealt over the cores.
SPREAD = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", SPREAD.get(name))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    coded = bpe.encode(docs, public_tokenizers.path(RANKS), offsets=False, decoded=True)
    return coded.select(
        "doc_id",
        F.expr("length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        "contaminated",
    )


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge_quality(_table(spark, sf_dir, "documents"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return substrings.remove_repeated(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(docs, model)
    return found.select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected"
    )


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", language_id.held_out().alias("held_out"), "score", "predicted")


def warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two derived records of each page's response, by page."""
    records = warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")), keep=["page_id"])
    return records.select(
        "page_id",
        "record_id",
        "warc_type",
        "target_uri",
        "refers_to",
        "content_type",
        "block_digest",
        F.col("fields")["WARC-Source-Payload-Digest"].alias("source_digest"),
        F.length("block").cast("long").alias("content_length"),
    )


def _joined(spans: str) -> Column:
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    )


def _number_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.fit(docs))
    counts = [_number_of(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extraction.extract(pages, html_extraction.fit(pages.select("page_id", "html")))


def word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    coded = merge_automaton.encode(docs, public_tokenizers.path(WORD_MERGES))
    return coded.select(
        "doc_id",
        F.expr("length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(_table(spark, sf_dir, "conversations"))


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_byte_bpe": byte_bpe,
    "op2_language_id": languages,
    "op3_decontamination": decontaminate,
    "op4_toxicity": toxic_documents,
    "op5_warc_derivatives": warc_derivatives,
    "op6_simhash_groups": simhash_groups,
    "op7_personal_data": personal_data,
    "op8_quality_rules": quality_rules,
    "op9_html_text": page_text,
    "op10_substring_dedup": substring_dedup,
    "op11_word_bpe": word_bpe,
    "op12_conversation_repair": repaired_conversations,
    "op13_source_divergence": source_divergence,
}
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MARKED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANK_PARTED = r"[^\x20\x09-\x0D]+"

#: What SQL can say; the other queries are tested against brute force and held-out rows.
ORACLES: dict[str, str] = {
    "op3_decontamination": f"""WITH docs AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '{_MARKED}') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all({_LOW}, '{_MARKED}') AS w FROM benchmark
), windows AS (
  SELECT item_id, array_to_string(w[s : s + 12], ' ') AS k, len(w[s : s + 12]) AS n
  FROM items, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS u(s) WHERE len(w) > 0
), tried AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS k
  FROM docs, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS u(s)
), hits AS (
  SELECT doc_id, s, tried.n, item_id FROM tried JOIN windows USING (k)
), covered AS (
  SELECT doc_id, count(DISTINCT i) AS n FROM hits, unnest(range(s, s + n)) AS u(i) GROUP BY 1
), owners AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(o.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered c USING (doc_id) LEFT JOIN owners o USING (doc_id)""",
    "op8_quality_rules": f"""WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_BLANK_PARTED}') AS w FROM documents
), parts AS (
  SELECT doc_id, host, l, regexp_extract_all(l, '{_BLANK_PARTED}') AS w
  FROM docs, unnest(string_split(t, chr(10))) AS u(l)
), lines AS (
  SELECT doc_id, host, l, len(w) AS n, substring(md5(translate(array_to_string(w, ' '),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), 1, 15) AS k
  FROM parts WHERE len(w) > 0
), families AS (
  SELECT doc_id, host, md5(t) AS family FROM docs
), hosts AS (
  SELECT host, count(DISTINCT family) AS n FROM families GROUP BY 1
), frequent AS (
  SELECT c.host, k FROM (
    SELECT l.host, k, count(DISTINCT family) AS n
    FROM lines l JOIN families f USING (doc_id) GROUP BY 1, 2) c JOIN hosts h ON c.host = h.host
  WHERE c.n > {line_quality.LINE_DOCUMENTS} AND c.n > {line_quality.LINE_SHARE}::DOUBLE * h.n
), removed AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM lines JOIN frequent USING (host, k) GROUP BY 1
), duplicates AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY 1
), grams AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, w[s], w[s + 1], w[s + 2]) AS n
  FROM docs, unnest(range(1, len(w) - 1)) AS u(s)
), repeats AS (
  SELECT doc_id, count(DISTINCT i) AS n FROM grams, unnest(range(s, s + 3)) AS u(i) WHERE n > 1 GROUP BY 1
), counted AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(translate(t, '{line_quality.SYMBOLS}', '')) AS n_symbols,
         coalesce(d.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
         coalesce(r.n, 0) AS n_boilerplate_words
  FROM docs LEFT JOIN duplicates d USING (doc_id) LEFT JOIN repeats p USING (doc_id)
  LEFT JOIN removed r USING (doc_id)
), failed AS (
  SELECT *, n_words < {line_quality.MIN_WORDS}
            OR 100 * n_repeat_words > {line_quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted
)
SELECT *, NOT base_failed AND n_words - n_boilerplate_words >= {line_quality.LEFT_SHARE}::DOUBLE * n_words
            AS kept FROM failed""",
    "op10_substring_dedup": f"""WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK_PARTED}') AS w FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS k
  FROM docs, unnest(range(1, len(w) - 11)) AS u(s)
), firsts AS (
  SELECT k, min(doc_id) AS m FROM windows GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, i FROM windows JOIN firsts USING (k), unnest(range(s, s + 13)) AS u(i)
  WHERE m < doc_id
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t
  FROM (SELECT doc_id, i, w[i] AS x FROM docs, unnest(range(1, len(w) + 1)) AS u(i))
  ANTI JOIN gone USING (doc_id, i) GROUP BY 1
), counts AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_source_divergence": f"""WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         {_LOW} AS t FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(t, '{divergence.TERM}')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY 1, 2 HAVING count(DISTINCT d) >= {divergence.MIN_DOCUMENTS}
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY 1
), everyone AS (
  SELECT lang, source, coalesce(n, 0)::HUGEINT AS n, coalesce(v, 0)::HUGEINT AS v
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN sizes USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY 1, 2) USING (lang, source)
), langs AS (
  SELECT lang, sum(n)::HUGEINT AS n FROM everyone GROUP BY 1
), p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS c,
         1 + {divergence.SCALE} * (coalesce(c.n, 0)::HUGEINT + 5) // (e.n + 5 * e.v) AS p
  FROM everyone e JOIN kept USING (lang) LEFT JOIN counts c USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + {divergence.SCALE} * (sum(c)::HUGEINT + 5) // (any_value(l.n) + 5 * any_value(v)) AS q
  FROM p JOIN langs l USING (lang) JOIN sizes USING (lang) GROUP BY 1, 2
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM everyone a JOIN everyone b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY 1, 2, 3
), terms AS (
  SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value FROM terms
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM ranked
)
SELECT * FROM placed WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}""",
}
