"""Operators with one right answer, against brute force on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from llm import fixtures
from pyspark.sql import functions as F

from tallyfern.llm import bpe, decontamination, line_quality, simhash, substrings

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference_encoder():
    return tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.read_ranks(RANKS),
        special_tokens={},
    )


def by_id(df):
    """Rows by id; rows that repeat an id must agree."""
    found = {}
    for row in df.collect():
        assert found.setdefault(row["doc_id"], row) == row
    return found


def test_encoding_equals_the_public_library(spark, reference_encoder):
    coded = bpe.encode(fixtures.documents(spark), RANKS, decoded=True)
    assert coded.columns == ["doc_id", "ids", "starts", "decoded"]
    got = coded.collect()
    texts = {r[0]: r[1] or "" for r in fixtures.rows()}
    assert len(got) == len(fixtures.rows())
    for row in got:
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        text = texts[row["doc_id"]]
        assert ids == reference_encoder.encode_ordinary(text)
        assert bytes(row["decoded"]).decode() == text
        starts = np.frombuffer(row["starts"], "<u4").tolist()
        for i, (a, token) in enumerate(zip(starts, ids)):
            if i < 50:
                piece = reference_encoder.decode_single_token_bytes(token)
                assert text.encode()[a : a + len(piece)] == piece
    back = bpe.decode(coded, RANKS)
    assert {(r["doc_id"], bytes(r["decoded"]).decode()) for r in back.collect()} == {
        (i, texts[i]) for i in texts
    }
    assert bpe.encode(fixtures.no_documents(spark), RANKS).count() == 0


def test_encoding_of_random_marks(reference_encoder):
    rng = random.Random(1)
    marks = ["'s", "'re", "'ll", "'", "''", "a", "B", "é", "1", "²", "中", " ", "  ", "\n", "\t", "\r\n",
             " ", "!", "#", "'ve", "s", "'t", "𐍈", "👍", "　", "\x1c", "'S", "\x85"]
    texts = ["".join(rng.choices(marks, k=rng.randrange(30))) for _ in range(3000)]
    texts += ["a" * 3000, "'" * 99, " " * 999, "ab " * 999, "é" * 999]
    packed = bpe.Codec(bpe.read_ranks(RANKS)).encode(texts)
    for text, ids in zip(texts, packed):
        assert np.frombuffer(ids, "<u4").tolist() == reference_encoder.encode_ordinary(text)


@pytest.mark.parametrize("size", [1, 3, 17])
def test_long_texts_are_cut_where_tokens_start(reference_encoder, size):
    rng = random.Random(size)
    for _ in range(400):
        text = "".join(rng.choices(["ab", "'s", "'", " ", "  ", "\n", "\t", "1", "!", "é", "\x1c", "\u3000"], k=40))
        parts = bpe.stretches(text, size)
        assert "".join(parts) == text
        ids = [reference_encoder.encode_ordinary(p) for p in parts]
        assert [i for part in ids for i in part] == reference_encoder.encode_ordinary(text)


def test_scan_over_several_blocks():
    rng = random.Random(2)
    text = "".join(rng.choices("ab1 '!\ns", k=3 * bpe.BLOCK * 40))
    whole = bpe.split_texts([text, "", text[:7]])
    assert ["".join(p) for p in whole] == [text, "", text[:7]]
    assert whole[0] == bpe.split_texts([text])[0]


def brute_contamination(items, texts, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def low(text):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)

    windows = defaultdict(set)
    for item, text in items:
        words = word.findall(low(text)) if text is not None else []
        for i in range(max(1, len(words) - window + 1)) if words else ():
            windows[tuple(words[i : i + window])].add(item)
    for doc, text in texts:
        words, hit, owners = word.findall(low(text or "")), set(), set()
        for length in {len(w) for w in windows}:
            for i in range(len(words) - length + 1):
                if found := windows.get(tuple(words[i : i + length])):
                    hit.update(range(i, i + length))
                    owners |= found
        yield doc, len(words), len(hit), sorted(owners), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_bytes", [decontamination.BLOCK_BYTES, 600])
def test_contamination(spark, block_bytes):
    texts = fixtures.texts()
    items = [("1", fixtures.PASSAGE), ("2", texts[9][:600]), ("10", "Two, WORDS!"), ("3", None), ("4", "--"),
             ("5", "été naïve"), ("1", fixtures.PASSAGE), ("", texts[18])]
    table = spark.createDataFrame(
        [(i or None, t) for i, t in items], "item_id string, text string"
    )
    docs = fixtures.documents(spark)
    found = decontamination.contamination(docs, table, keep=["doc_id", "text"], block_bytes=block_bytes)
    located = {
        (r["doc_id"]): r["hit_spans"] for r in decontamination.locate(found).collect()
    }
    got = by_id(found.drop("text"))
    pairs = [(r[0], r[1]) for r in fixtures.rows()]
    for doc, n_words, n_hit, owners, bad in brute_contamination(items, pairs):
        row = got[doc]
        assert (row["n_words"], row["n_hit"], row["hit_items"], row["contaminated"]) == (
            n_words, n_hit, owners, bad,
        )
        assert row["n_items"] == len(owners)
    text = dict(pairs)
    spans = located[10]
    assert text[10][spans[0] : spans[1]] == fixtures.PASSAGE
    assert decontamination.contamination(fixtures.no_documents(spark), table).count() == 0
    nothing = decontamination.contamination(docs, table.limit(0))
    assert nothing.where("n_hit > 0 or contaminated").count() == 0


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = BLANK_WORD.findall(low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values):
    """Root index of each value under links of four bits or fewer."""
    points = np.array(values, np.uint64)
    forest = simhash.Forest(len(points))
    for i, p in enumerate(points):
        forest.gather(np.flatnonzero(np.bitwise_count(points ^ p) <= 4))
    return forest.roots(np.arange(len(points)))


def test_simhash_groups(spark):
    got = simhash.near_duplicates(fixtures.documents(spark)).collect()
    rows = sorted(fixtures.rows(), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_groups(prints)
    least = {}
    for (doc, *_), root in zip(rows, roots.tolist()):
        if doc is not None:
            least[root] = min(doc, least.get(root, doc))
    want = Counter((r[0], p, least.get(root)) for r, p, root in zip(rows, prints, roots.tolist()))
    have = Counter((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in got)
    assert have == want
    assert simhash.near_duplicates(fixtures.no_documents(spark)).count() == 0


@pytest.mark.parametrize("spread", [2, 6, 12])
def test_vantage_links_equal_brute_force(spread):
    rng = random.Random(spread)
    centres, points = [rng.getrandbits(64) for _ in range(30)], set()
    for _ in range(2500):
        point = rng.choice(centres)
        for _ in range(rng.randint(0, spread)):
            point ^= 1 << rng.randrange(64)
        points.add(point)
    points = np.array(sorted(points), np.uint64)
    ours, theirs = simhash.vantage_links(points), brute_groups(points)
    pairs = set(zip(ours.tolist(), theirs.tolist()))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_links_across_shards_and_chains(spark):
    rng = random.Random(3)
    values = [0, (1 << 64) - 1]
    for _ in range(40):  # chains: each step three bits on, ends far apart
        point = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            values.append(point)
            for bit in rng.sample(range(64), 3):
                point ^= 1 << bit
    values = sorted(set(values))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    table = spark.createDataFrame(signed, "fingerprint long")
    rooted = {r["a"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.link_edges(table)).collect()}
    theirs = brute_groups(values).tolist()
    pairs = {(rooted.get(v, v), values[t]) for v, t in zip(values, theirs)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


@pytest.mark.parametrize("spread", [2, 5, 64])
def test_trees_of_many_shards_equal_brute_force(spread):
    rng = np.random.default_rng(spread)
    for _ in range(40):
        keys = np.repeat(np.arange(12), rng.integers(1, 40, 12))
        points = rng.integers(0, 1 << 63, 3, dtype=np.uint64)[rng.integers(0, 3, len(keys))]
        for _ in range(spread):
            points = points ^ (np.uint64(1) << rng.integers(0, 64, len(keys)).astype(np.uint64))
        forest = simhash.Forest(len(keys))
        assert simhash.vantage_forest(keys, points, simhash.RADIUS, forest) >= 1
        found = forest.roots(np.arange(len(keys)))
        for shard in range(12):
            at = np.flatnonzero(keys == shard)
            pairs = list(zip(found[at], brute_groups(points[at])))
            assert len(set(pairs)) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_a_shard_of_two_is_a_tree_of_one_node():
    points = np.array([0, 15, 0, 31, 7], np.uint64)
    forest = simhash.Forest(5)
    assert simhash.vantage_forest(np.array([0, 0, 1, 1, 2]), points, 4, forest) == 2
    assert forest.roots(np.arange(5)).tolist() == [0, 0, 2, 3, 4]


def test_no_shard_is_compared_without_a_tree(monkeypatch):
    grown = []
    trees = simhash.vantage_forest
    monkeypatch.setattr(simhash, "vantage_forest", lambda *a: grown.append(trees(*a)))
    a, b = simhash._run_edges(np.array([3, 3, 4, 9, 9, 9]), np.array([1, 2, 1, 8, 9, 10], np.uint64), 4)
    assert sum(grown) >= 2 and len(a) == len(b) == 3


def test_vantage_links_refuse_a_wider_radius(spark):
    with pytest.raises(ValueError):
        simhash.link_edges(spark.createDataFrame([], "fingerprint long"), 5)


def brute_repeats(rows, window=13):
    first = {}
    for doc, text in rows:
        words = BLANK_WORD.findall(text or "")
        for i in range(len(words) - window + 1) if doc is not None else ():
            key = tuple(words[i : i + window])
            first[key] = min(doc, first.get(key, doc))
    for doc, text in rows:
        words, gone = BLANK_WORD.findall(text or ""), set()
        for i in range(len(words) - window + 1) if doc is not None else ():
            if first[tuple(words[i : i + window])] < doc:
                gone.update(range(i, i + window))
        yield doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)


def check_repeats(spark, rows, schema="doc_id long, text string"):
    got = Counter(
        (r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"])
        for r in substrings.remove_repeated(spark.createDataFrame(rows, schema).repartition(4)).collect()
    )
    assert got == Counter(brute_repeats([r[:2] for r in rows]))


def test_repeated_windows(spark):
    check_repeats(spark, fixtures.rows(), fixtures.SCHEMA)
    assert substrings.remove_repeated(fixtures.no_documents(spark)).count() == 0


def test_columns_that_clash_give_way(spark):
    docs = spark.createDataFrame([(1, "a " * 20, "h")], "doc_id long, text string, source string")
    names = ["id", "mark", "fingerprint", "component_id", "n_words", "kept", "n_removed", "ids",
             "n_hit", "hit_runs", "contaminated", "n_boilerplate_words", "base_failed", "root", "a", "b"]
    wide = docs.withColumns({n: F.lit("clash") for n in names})
    keep = wide.columns
    items = spark.createDataFrame([("1", "a b")], "item_id string, text string")
    results = {
        "ids": bpe.encode(wide, RANKS, keep=keep),
        "n_hit": decontamination.contamination(wide, items, keep=keep),
        "component_id": simhash.near_duplicates(wide, keep=[c for c in keep if c != "text"]),
        "kept": line_quality.judge_quality(wide, keep=keep),
        "n_removed": substrings.remove_repeated(wide, keep=keep),
    }
    for made, result in results.items():
        assert len(set(result.columns)) == len(result.columns)
        row = result.first()
        assert row[made] != "clash" and row["root"] == "clash"


def test_repeated_windows_in_small_vocabularies(spark):
    """Many equal windows within and across documents, shared stretches of any length."""
    rng = random.Random(4)
    pool = [" ".join(rng.choices(["a", "b", "c d", "e", "f", "g"], k=40)) for _ in range(4)]
    rows = []
    for i in range(60):
        cut = rng.choice(pool).split()
        a, b = sorted(rng.sample(range(len(cut)), 2))
        extra = " ".join(rng.choices("xyzuvw", k=rng.randrange(30)))
        rows.append((rng.randrange(50), " ".join([extra, *cut[a:b], extra])))
    check_repeats(spark, rows)


def test_control_characters_belong_to_words(spark):
    """Only ASCII white space parts words: \x00-\x08 and \x0e-\x1f are inside them."""
    rng = random.Random(16)
    shared = fixtures.sentence(rng, 12).split()
    odd = ["a\x00b", "c\x1fd", "\x01", "e\x0e", "\x1c"]
    rows = [(i, " ".join([*rng.choices(odd, k=i % 4), *shared[:6], odd[i % 2], *shared[6:], f"own{i}"])) for i in range(12)]
    rows += [(50 + i, " ".join([odd[0], *fixtures.sentence(rng, 5).split(), *shared, odd[i % 5]])) for i in range(9)]
    check_repeats(spark, rows)


def test_packs_of_a_few_texts_agree_with_one_pack(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PACK_BYTES", 200)
    packer = substrings.Packer(7, 13)
    rng = random.Random(6)
    shared = [fixtures.sentence(rng, 30) for _ in range(3)]
    rows = [(i, f"{rng.choice(shared)} {fixtures.sentence(rng, 20)} {rng.choice(shared)}") for i in range(30)]
    assert not list(packer.packs())
    check_repeats(spark, rows)


def test_hot_buckets_are_dealt_by_window(spark, monkeypatch):
    """Unlike windows around one frequent pair of words: no bucket stays large."""
    rng = random.Random(17)
    rows = [(i, " ".join(f"of the {fixtures.sentence(rng, 4)}" for _ in range(20))) for i in range(40)]
    rows += [(100 + i, f"{rows[i][1]} more {fixtures.sentence(rng, 9)}") for i in range(9)]
    table = spark.createDataFrame([(i, 0, t) for i, t in rows], "id long, mark int, text string")
    hot = substrings.hot_buckets(table, 8, 13, 400)
    windows = [0, 0]
    for k, parts in enumerate((None, hot)):
        packer = substrings.Packer(8, 13, parts)
        for i, text in rows:
            packer.add(i, 0, text.encode().split())
        counts = packer.counts()
        windows[k] = counts.sum()
        assert (counts.max() > 400) == (parts is None)
    assert windows[0] > 3000 and hot
    monkeypatch.setattr(substrings, "HOT_WINDOWS", 20)
    check_repeats(spark, rows)
    rows = [(rng.randrange(30), " ".join(rng.choices("abc", k=60))) for _ in range(60)]
    check_repeats(spark, rows)


def test_unlike_windows_with_equal_hashes(monkeypatch):
    """Equal hashes are compared word by word."""
    monkeypatch.setattr(substrings, "_rolled", lambda h, w: np.zeros(len(h) - w + 1, np.uint64))
    rows = np.zeros(3, substrings.ROW)
    rows["id"], rows["windows"] = [3, 1, 2], [2, 1, 1]
    data = b"a b c\nx y\nb c"
    found = substrings.repeated_runs(rows, data, 2)
    assert [(r["id"], r["first"], r["windows"]) for r in found] == [(3, 1, 1)]


def brute_quality(text):
    text = text or ""
    words = BLANK_WORD.findall(text)
    grams = list(zip(words, words[1:], words[2:]))
    counts, covered = Counter(grams), set()
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            covered.update((i, i + 1, i + 2))
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if BLANK_WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered), failed


def test_line_quality(spark):
    got = line_quality.judge_quality(fixtures.documents(spark))
    rows = by_id(got)
    assert len(got.collect()) == len(fixtures.rows())
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for doc, text, *_ in fixtures.rows():
        assert tuple(rows[doc][n] for n in names) == brute_quality(text)
        assert rows[doc]["kept"] == (not rows[doc]["base_failed"])
    assert line_quality.judge_quality(fixtures.no_documents(spark)).count() == 0


def test_boilerplate_lines(spark):
    """A line above both limits is removed at its host only; copies count once."""
    rng = random.Random(8)
    notice = fixtures.sentence(rng, 60)
    rows = [(i, f"{fixtures.sentence(rng, 20)}\n{notice.upper()}  ", "h") for i in range(30)]
    rows += [(100 + i, f"{notice}\n{fixtures.sentence(rng, 60)}", "other") for i in range(5)]
    copied = "\n".join(fixtures.sentence(rng, 30) for _ in range(3))
    rows += [(200 + i, copied, "h") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = by_id(line_quality.judge_quality(docs))
    assert all(got[i]["n_boilerplate_words"] == 60 and not got[i]["kept"] for i in range(30))
    assert all(got[100 + i]["kept"] and not got[100 + i]["n_boilerplate_words"] for i in range(5))
    assert all(got[200 + i]["kept"] for i in range(40))


def test_unlike_pages_that_share_many_lines_count_each(spark):
    """Pages with the same menu and one own line are no copies: the menu is boilerplate,
    and so is the common part of near copies, while exact copies count once."""
    rng = random.Random(14)
    menu = "\n".join(f"menu {i}" for i in range(20))
    rows = [(i, f"{menu}\n{fixtures.sentence(rng, 60)}", "h") for i in range(40)]
    near = fixtures.sentence(rng, 60)
    rows += [(100 + i, f"{near}\nnumber {i}", "near") for i in range(30)]
    once = fixtures.sentence(rng, 60)
    rows += [(200 + i, once, "copies") for i in range(30)]
    got = by_id(line_quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert all(got[i]["n_boilerplate_words"] == 40 and got[i]["kept"] for i in range(40))
    assert all(got[100 + i]["n_boilerplate_words"] == 60 and not got[100 + i]["kept"] for i in range(30))
    assert all(got[200 + i]["n_boilerplate_words"] == 0 and got[200 + i]["kept"] for i in range(30))


def test_lines_above_the_limits_leave_the_text(spark):
    rng = random.Random(15)
    own = {i: fixtures.sentence(rng, 60) for i in range(60)}
    rows = [(i, f"Home  About\n\n{t}\nhome about\nCopyright Us\n", "h") for i, t in own.items()]
    rows += [(100, f"home about\n{own[0]}", "other"), (100, f"home about\n{own[0]}", "other")]
    rows += [(None, f"{own[1]}\nhome about", "h"), (101, None, "h"), (102, "home about", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = line_quality.remove_lines(docs, keep=["doc_id", "text", "source"])
    assert sorted(got.columns) == ["doc_id", "source", "text"]
    want = Counter({(i, f"\n{t}\n"): 1 for i, t in own.items()})
    want += Counter({(100, rows[60][1]): 2, (None, own[1]): 1})
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want
    stage = dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, "")
    assert stage.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in stage.collect()) == want


def test_digests_of_the_registered_queries(spark):
    """The thin queries give what their contracts name."""
    from tallyfern.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    text = {r["doc_id"]: r["text"] for r in docs}
    pairs = sorted(text.items())
    got = by_id(queries.QUERIES["op10_substring_dedup"](spark, sf))
    for doc, n, gone, kept in brute_repeats(pairs):
        sha = hashlib.sha256(kept.encode()).hexdigest()
        assert tuple(got[doc][c] for c in ("n_words", "n_removed", "kept_sha256")) == (n, gone, sha)
    got = by_id(queries.QUERIES["op6_simhash_groups"](spark, sf))
    roots = brute_groups([brute_fingerprint(t) for _, t in pairs]).tolist()
    for (doc, t), root in zip(pairs, roots):
        assert got[doc]["fingerprint"] == f"{brute_fingerprint(t):016x}"
        assert got[doc]["component_id"] == pairs[root][0]
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = by_id(queries.QUERIES["op3_decontamination"](spark, sf))
    for doc, n, hit, owners, bad in brute_contamination([(str(r["item_id"]), r["text"]) for r in items], pairs):
        sha = hashlib.sha256(",".join(owners).encode()).hexdigest()
        assert tuple(got[doc])[1:] == (n, hit, len(owners), sha, bad)
    encoder = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )
    got = by_id(queries.QUERIES["op1_byte_bpe"](spark, sf))
    for doc, t in pairs:
        ids = np.array(encoder.encode_ordinary(t), "<u4")
        want = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert tuple(got[doc])[1:] == want
