"""Operators with a trained part: exact parts by brute force, the rest held out."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from llm import fixtures

from tallyfern.llm import html_extraction, language_id, pii, queries, toxicity, warc

SF = "/root/testdata/sf0.01"


def held(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


# language identification


def test_languages_on_held_out_documents(spark):
    rows = queries.QUERIES["op2_language_id"](spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    tried = [r for r in rows if r["held_out"]]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in tried)
    assert right >= 0.98 * len(tried)
    trusted = [r for r in tried if not r["rejected"]]
    assert len(trusted) >= 0.9 * len(tried)


def test_languages_of_awkward_rows(spark):
    docs = fixtures.documents(spark)
    model = language_id.fit(docs)
    assert model.languages == ["de", "en"]
    found = language_id.identify(docs, model, keep=["doc_id", "score"])
    assert found.columns == ["doc_id", "lang_pred", "score", "rejected"]
    got = found.collect()
    assert len(got) == len(fixtures.rows())
    texts = {r[0]: r[1] for r in fixtures.rows()}
    for row in got:
        letters = any(c.isalpha() for c in texts[row["doc_id"]] or "")
        assert (row["lang_pred"] == "und") == (not letters)
        assert 0 <= row["score"] <= 1
    none = fixtures.no_documents(spark)
    assert language_id.fit(none) is None
    assert language_id.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}


def test_subwords_stay_inside_texts():
    alone = [language_id.subword_runs([t])[0] for t in ("ab", "cde")]
    buckets, owners, letters = language_id.subword_runs(["ab", "cde", "12", ""])
    for i in (0, 1):
        assert sorted(buckets[owners == i]) == sorted(alone[i])
    assert letters.tolist() == [True, True, False, False]


def test_one_language_only():
    ids, counts = np.array([1, 2]), np.array([3, 4])
    model = language_id.train([(0, ids, counts)], ["xx"])
    spread, letters = model.scores(["abc", "", "1"])
    assert spread.tolist() == [[1.0]] * 3 and letters.tolist() == [True, False, False]


# toxicity


@pytest.fixture(scope="module")
def toxic_tables(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        words = fixtures.sentence(rng, 40, 300).replace("w", "ba").split()
        words = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words]
        if i % 5 == 0:
            words[rng.randrange(40)] = rng.choice(["venomous", "spiteful"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_deobfuscated_words_are_scored(spark, toxic_tables):
    docs, labels = toxic_tables
    model = toxicity.fit(docs, labels)
    cases = ["a venomous thing", "v3n0mous", "v e n o m o u s", "VENOOOOMOUS!!", "ven.om.ous", "sp1teful",
             "babab cabab", "", None, "12 34", "a a a a a a"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(table, model).collect()}
    assert [got[i]["predicted"] for i in range(len(cases))] == [1] * 6 + [0] * 5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_disguised_first_and_last_letters(spark, toxic_tables):
    docs, labels = toxic_tables
    model = toxicity.fit(docs, labels)
    cases = ["venomou$ thing", "$piteful", "($piteful!", "*$p1teful*", "spiteful!", "babab!", "(cabab)", "$$$ !! ((", "b@b"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(table, model).collect()}
    assert [got[i] for i in range(len(cases))] == [1] * 5 + [0] * 4


def test_edge_forms():
    assert toxicity.edge_forms("plain") == [] and toxicity.edge_forms("$$!") == []
    assert toxicity.edge_forms("a$$") == ["a$$"]
    assert toxicity.edge_forms("!diot!") == ["!diot", "diot!", "!diot!"]
    assert toxicity.edge_forms('"(unt"') == ["(unt"]


def test_long_forms_and_repeated_rows_have_one_score(spark, toxic_tables):
    docs, labels = toxic_tables
    model = toxicity.fit(docs, labels)
    long = "b4" * 30_000 + " spiteful " + "cab " * 100_000
    table = spark.createDataFrame([(1, long), (1, long), (2, "b4" * 30_000)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["predicted"]) for r in toxicity.toxicity(table, model).collect())
    assert got == [(1, 1), (1, 1), (2, 0)]
    assert len(toxicity.restore("b4" * 30_000, model.characters)) == 60_000


def test_logistic_weights_meet_the_optimality_condition():
    rng = np.random.default_rng(4)
    lexicon = [f"w{i}" for i in range(700)]
    rows = [
        ([lexicon[j] for j in rng.integers(0, 700, rng.integers(0, 9))], bool(rng.random() < 0.3), float(rng.integers(1, 5)))
        for _ in range(900)
    ]
    weights, bias = toxicity.word_weights(rows, lexicon)
    slope, bias_slope = {w: 0.1 * v for w, v in weights.items()}, 1e-3 * bias
    for hit, toxic, share in rows:
        total = bias + sum(weights[w] for w in hit) + (weights[toxicity.ANY] if hit else 0)
        wrong = share * (1 / (1 + math.exp(-total)) - toxic)
        bias_slope += wrong
        for w in [*hit, *([toxicity.ANY] if hit else [])]:
            slope[w] += wrong
    assert max(map(abs, slope.values())) < 1e-3 and abs(bias_slope) < 1e-3


def test_toxicity_without_labels(spark):
    docs = fixtures.documents(spark)
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.toxicity(docs, toxicity.fit(docs, labels), keep=["doc_id", "score"])
    assert scored.columns == ["doc_id", "score", "predicted"]
    assert scored.count() == len(fixtures.rows()) and scored.where("predicted = 1").count() == 0
    none = fixtures.no_documents(spark)
    assert toxicity.toxicity(none, toxicity.fit(none, labels)).count() == 0


def test_trigrams_are_counted_over_all_texts(spark):
    docs = spark.createDataFrame([("ab Ab",), (None,), ("",), ("b",)], "text string")
    got = {r["gram"]: r["n"] for r in toxicity.trigram_counts(docs).collect()}
    n = toxicity.SYMBOLS

    def gram(*symbols):
        return (symbols[0] * n + symbols[1]) * n + symbols[2]

    assert got[gram(0, 1, 2)] == 2 and got[gram(1, 2, 0)] == 2 and got[gram(0, 2, 0)] == 1


def test_toxicity_on_held_out_documents(spark):
    rows = queries.QUERIES["op4_toxicity"](spark, SF).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    tried = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, t in tried if t], [s for s, t in tried if not t]
    above = np.mean([a > b for a in good for b in bad]) + 0.5 * np.mean([a == b for a in good for b in bad])
    assert above > 0.8


# personal data

NAIVE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def naive_spans(text):
    found = []
    for kind, pattern in NAIVE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(
                    int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10))
                    for i, d in enumerate(reversed(digits))
                )
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return found


def test_base_spans_equal_the_patterns():
    rng = random.Random(10)
    marks = ["a", "b.c", "@", "@", ".", "-", "+", "1", "22", "255", "256", "4111 1111 1111 1111", " ", "(", ")",
             "+1 (555) 010-9999", "x@y.zz", "10.0.0.1", "é", "\n", "%"]
    for _ in range(4000):
        text = "".join(rng.choices(marks, k=rng.randrange(14)))
        assert pii.base_spans(text) == naive_spans(text)
    for long in ("a" * 60_000 + "@", "1" * 60_000, "1." * 30_000, "+1" * 30_000, "a@b." * 20_000):
        pii.base_spans(long)


def test_spans_of_documents(spark):
    rows = queries.QUERIES["op7_personal_data"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for row in rows:
        base = naive_spans(texts[row["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        every = [s.split(":") for s in row["spans"].split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= {":".join(s) for s in every}
        order = [(pii.KINDS.index(k), int(a)) for k, a, _ in every]
        assert order == sorted(order)


def test_labelers_add_spelt_out_addresses_and_mask(spark):
    text = "mail me: jane.doe (at) example (dot) com or bob@example.com, tel. (030) 1234-5678-90 or +49 30 1234567"
    rows = [(i, text) for i in range(30)] + [(99, None), (98, ""), (97, "no data here, version 3.2.1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    got = {r["doc_id"]: r for r in pii.find_spans(docs, model).collect()}
    kinds = [s["kind"] for s in got[3]["spans"]]
    assert kinds.count("email") == 2 and len(got[3]["base"]) == 2
    assert got[99]["spans"] == got[98]["spans"] == got[97]["spans"] == []
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs, model).collect()}
    assert "jane" not in masked[3] and "bob" not in masked[3] and "+49" not in masked[3]
    assert masked[99] is None and masked[98] == "" and masked[97] == rows[-1][1]
    none = docs.limit(0)
    assert pii.find_spans(none, pii.fit(none)).count() == 0


def test_spelt_out_address_as_the_only_personal_data(spark):
    """No digit and no '@' elsewhere: each bracket alone leads to the candidates."""
    marks = ["(at) example (dot) com", "[at] example [dot] org", "{at} example {dot} net", "<AT> example <DOT> de"]
    texts = [f"mail me: jane.doe {mark} or write a letter" for mark in marks]
    rows = [(i, texts[i % 4]) for i in range(40)] + [(99, "no data (here) [at] all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    got = {r["doc_id"]: r for r in pii.find_spans(docs, model).collect()}
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs, model).collect()}
    for i in range(40):
        assert [s["kind"] for s in got[i]["spans"]] == ["email"] and got[i]["base"] == []
        assert "jane" not in masked[i] and "[EMAIL]" in masked[i]
    assert got[99]["spans"] == [] and masked[99] == rows[-1][1]


def test_expectation_maximisation_finds_the_reliable_labeler():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.85, 0.8, 0.75, 0.55)], 1)
    soft, prior, table = pii.reliabilities(votes, np.ones(4000))
    assert ((soft > 0.5) == truth).mean() > 0.93 and abs(prior - 0.4) < 0.05
    assert table[0, 2, 1] > table[2, 2, 1] > table[4, 2, 1]


def test_masking_of_overlapping_spans():
    assert pii.mask_text("abcdef", [("ip", 1, 4), ("card", 2, 5), ("phone", 5, 6)]) == "a[IP][PHONE]"


# pages


def test_blocks():
    page = """<head><title>t</title></head><script>if (a<b) {"</p>"}</script><!-- <p>no</p> -->
    <div class="Post main" title="a > b"><h1>A  &amp;&nbsp;B</h1><p>one<br>two <a href=x>three</a><p>four
    <ul><li>five<li>six</ul></div><style>p{}</style>tail &lt;p&gt;"""
    got = [(b.path, b.text, b.linked) for b in html_extraction.blocks_of(page)]
    assert [g[1] for g in got] == ["A & B", "one two three", "four", "five", "six", "tail <p>"]
    assert got[0][0] == ("<div", "post", "main", "<h1") and got[1][2] == 5
    assert got[4][0] == ("<div", "post", "main", "<ul", "<li") and got[5][0] == ()


@pytest.mark.parametrize("page", ["", "plain", "<p", "<p title='", "<!-- x", "<script>x", "<" * 9000, "<p>" * 9000, "<b a=\"" * 3000])
def test_broken_pages_do_not_fail(page):
    html_extraction.blocks_of(page)


def test_gradient_of_the_labeller():
    rng = np.random.default_rng(3)
    model = html_extraction.Labeller.fresh(3)
    x = rng.normal(size=(3, 5, html_extraction.FEATURES))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], float)
    y = (rng.random((3, 5)) < 0.5) * mask

    def loss():
        z = model.logits(x, mask)[0]
        return ((np.log1p(np.exp(z)) - y * z) * mask).sum() / mask.sum()

    slopes = model.slopes(x, mask, y)
    for name, weight in model.weights.items():
        for at in [tuple(rng.integers(s) for s in weight.shape) for _ in range(4)]:
            old, step = weight[at], 1e-5
            weight[at] = old + step
            up = loss()
            weight[at] = old - step
            down = loss()
            weight[at] = old
            assert abs((up - down) / (2 * step) - slopes[name][at]) < 1e-6


def test_article_text_of_pages(spark):
    rows = queries.QUERIES["op9_html_text"](spark, SF).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    right = 0
    for row in rows:
        body = re.search("<article>(.*?)</article>", pages[row["page_id"]], re.S)[1]
        blocks = [b.text for b in html_extraction.blocks_of(body)]
        right += row["text"] == "\n".join(blocks)
        assert row["n_chars"] == len(row["text"])
    assert right >= 0.98 * len(rows)


def test_pages_without_text(spark):
    table = spark.createDataFrame(
        [(1, "u", None, "x"), (2, None, "", "x"), (None, None, "<p>", None)],
        "page_id long, url string, html string, text string",
    )
    model = html_extraction.fit(table)
    got = html_extraction.extract(table, model, keep=["page_id", "url", "text"])
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert {(r["text"], r["n_chars"]) for r in got.collect()} == {("", 0)} and got.count() == 3
    assert html_extraction.extract(table.limit(0), html_extraction.fit(table.limit(0))).count() == 0


# WARC


def test_derived_records_refer_to_their_response(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a/1", "<p>Hé &amp; x<a href='/y'>link</a></p><script>s</script>"), (2, None, None), (2, None, None)],
        "page_id long, url string, html string",
    )
    responses = warc.responses(pages)
    source = {r["page_id"]: r for r in responses.collect()}
    derived = warc.derivatives(responses, keep=["page_id"])
    rows = derived.collect()
    assert len(rows) == 6
    for row in rows:
        origin = source[row["page_id"]]
        assert row["refers_to"] == origin["record_id"] and row["target_uri"] == origin["target_uri"]
        assert row["warc_date"] == origin["warc_date"]
        assert row["fields"]["WARC-Source-Payload-Digest"] == origin["payload_digest"]
        assert row["fields"]["HTTP-Content-Type"] == "text/html; charset=utf-8"
        assert row["block_digest"] == warc.digest(bytes(row["block"]))
    block = {(r["page_id"], r["warc_type"]): bytes(r["block"]).decode() for r in rows}
    assert block[1, "conversion"] == "Hé & xlink" and block[2, "conversion"] == ""
    assert "http-status: HTTP/1.1 200 OK" in block[1, "metadata"] and "outlink: /y" in block[1, "metadata"]
    assert source[1]["payload_digest"] in block[1, "metadata"]

    warc.write_warc(derived.drop("page_id"), str(tmp_path / "w"))
    back = warc.read_warc(spark, f"{tmp_path}/w/part-*").collect()
    key = lambda r: (r["record_id"], r["warc_type"])
    assert sorted(map(key, back)) == sorted(map(key, rows))
    by_key = {key(r): r for r in rows}
    for row in back:
        mine = by_key[key(row)]
        for name in ("target_uri", "refers_to", "content_type", "block_digest", "payload_digest", "fields"):
            assert row[name] == mine[name]
        assert bytes(row["block"]) == bytes(mine["block"])


def test_odd_responses(spark):
    rows = [
        (None, "response", "u", "d", None, None, None, None, {"X": "y"}, b"no head \xff"),
        ("i", "response", None, None, None, None, "bd", "pd", None, None),
        ("j", "request", "u", "d", None, None, None, None, None, b"x"),
        ("k", "response", "u", "d", None, None, None, None, None,
         b"HTTP/1.1 404 No\r\nContent-Type: text/plain; charset=latin-1\r\n\r\n<p>\xe9"),
    ]
    table = spark.createDataFrame(rows, warc.RECORD)
    got = {(r["refers_to"], r["warc_type"]): bytes(r["block"]).decode() for r in warc.derivatives(table).collect()}
    assert len(got) == 6
    assert got["k", "conversion"] == "<p>é" and got["i", "conversion"] == ""
    assert "source-payload-digest: pd" in got["i", "metadata"]
    assert warc.derivatives(table.limit(0)).count() == 0


def test_header_fields_of_equal_name_are_all_kept(spark, tmp_path):
    head = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nContent-Type: text/plain\r\nset-cookie: b=2,\r\n c=3\r\n\r\nx"
    rows = [("i", "response", "u", "d", None, None, None, None, None, head)]
    derived = warc.derivatives(spark.createDataFrame(rows, warc.RECORD))
    got = {r["warc_type"]: r for r in derived.collect()}
    for row in got.values():
        assert row["fields"]["HTTP-Set-Cookie"] == "a=1\nb=2, c=3"
    lines = bytes(got["metadata"]["block"]).decode().split("\r\n")
    assert "http-header-set-cookie: a=1" in lines and "http-header-set-cookie: b=2, c=3" in lines
    warc.write_warc(derived, str(tmp_path / "w"))
    back = {r["warc_type"]: r for r in warc.read_warc(spark, f"{tmp_path}/w/part-*").collect()}
    assert {k: r["fields"] for k, r in back.items()} == {k: r["fields"] for k, r in got.items()}


def _body(header: bytes, body: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n" + header + b"\r\n\r\n" + body


def test_codings_are_undone(spark):
    text = b"hello there " * 20_000
    packed = gzip.compress(text)
    chunks = b"".join(b"%x;q=1\r\n%s\r\n" % (len(c), c) for c in (packed[:7], packed[7:90], packed[90:])) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    blocks = {
        "both": _body(b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunks),
        "members": _body(b"Content-Encoding: gzip", gzip.compress(text[:60]) + gzip.compress(text[60:])),
        "zlib": _body(b"Content-Encoding: deflate", zlib.compress(text)),
        "raw": _body(b"Content-Encoding: deflate", raw.compress(text) + raw.flush()),
        "undone before": _body(b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip", text),
        "cut": _body(b"Transfer-Encoding: chunked", b"ff\r\nhel"),
        "unknown": _body(b"Content-Encoding: br", b"\x00\xff"),
        "empty": _body(b"Content-Encoding: gzip", b""),
    }
    rows = [(k, "response", "u", "d", None, None, None, None, None, b) for k, b in blocks.items()]
    derived = warc.derivatives(spark.createDataFrame(rows, warc.RECORD)).collect()
    got = {(r["refers_to"], r["warc_type"]): bytes(r["block"]).decode() for r in derived}
    for name in ("both", "members", "zlib", "raw", "undone before"):
        assert got[name, "conversion"] == text.decode(), name
    assert got["cut", "conversion"] == "hel" and got["empty", "conversion"] == ""
    assert got["unknown", "conversion"] == "" and "coding-not-undone: br" in got["unknown", "metadata"]
    assert f"source-payload-digest: {warc.digest(packed)}" in got["both", "metadata"]
    assert warc.inflated(packed[:-20], "gzip")[:12] == b"hello there " and warc.inflated(b"\x1f\x8bxx", "gzip") == b""


def test_links_of_long_and_hostile_pages():
    long = f"<a data-x='{'>' * 50_000}' HREF = /far?a=1&amp;b=2>x</a>"
    page = f"<!-- <a href=no> --><script>'<a href=no>'</script>{long}<img alt='<a href=no>'><abbr href=no><a name=n>"
    assert warc.links_of(page + "<a href='/q r'><a\nhref=\"z\" href=no>") == ["/far?a=1&b=2", "/q r", "z"]
    for hostile in ("<a " * 200_000, "<a \"" * 200_001, "<a \">\" " * 200_000 + "'", "<!--" * 200_000, "<a href=" * 200_000):
        begun = time.perf_counter()
        warc.links_of(hostile), html_extraction.blocks_of(hostile)
        assert time.perf_counter() - begun < 5
    assert warc.links_of("<a href=1><a title='><a href=2>") == ["1", "2"]


def test_damaged_warc_files_do_not_end_the_job(spark, tmp_path):
    def record(name: str) -> bytes:
        row = dict.fromkeys(warc.RECORD.names) | {"warc_type": "resource", "record_id": name, "block": b"b" * 5000}
        return warc.serialised(row) + b"\r\n\r\n"

    good = b"".join(gzip.compress(record(f"g{i}")) for i in range(300))
    (tmp_path / "good.warc.gz").write_bytes(good)
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(record("c1")) + gzip.compress(record("c2"))[:-30])
    (tmp_path / "short.warc").write_bytes(record("s1") + record("s2")[:-200])
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read_warc(spark, str(tmp_path)).collect()
    named = {r["record_id"] for r in got if r["warc_type"] == "resource"}
    assert named == {*(f"g{i}" for i in range(300)), "c1", "s1"}
    damaged = [r["fields"]["Path"] for r in got if r["warc_type"] == warc.DAMAGED]
    assert sorted(p.rsplit("/", 1)[1] for p in damaged) == ["cut.warc.gz", "short.warc"]


def test_deeply_nested_articles_and_pages_without_semantic_tags(spark):
    deep = "<article>" + "".join(f"<div class='part k{'abcdefghijklm'[i]}'>" for i in range(13)) + "<p>inside"
    assert html_extraction._semantic_label(html_extraction.blocks_of(deep)[0]) == 1
    unclosed = "<div class='far'>" + "<ul>" * 300 + "a</div><p>c"
    assert html_extraction.blocks_of(unclosed)[-1].path == ("<p",)
    rng = random.Random(3)
    words = "river stone market evening letter garden winter report people answer window morning".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(60):
        core = [text(rng.randint(25, 60)) for _ in range(rng.randint(3, 8))]
        menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in words[:6])
        body = "".join(f"<p>{c}</p>" for c in core)
        page = f"<div class='menu'><ul>{menu}</ul></div><div class='content'>{body}</div><div class='footer'>(c) {i}</div>"
        rows.append((i, "u", f"<html><body>{page}</body></html>", "\n".join(core)))
    table = spark.createDataFrame(rows, "page_id long, url string, html string, truth string")
    got = html_extraction.extract(table, html_extraction.fit(table), keep=["truth"]).collect()
    kept = [set(r["text"].split("\n")) for r in got]
    truth = [set(r["truth"].split("\n")) for r in got]
    shared = sum(len(k & t) for k, t in zip(kept, truth))
    assert shared >= 0.95 * sum(map(len, truth)) and shared >= 0.9 * sum(map(len, kept))
