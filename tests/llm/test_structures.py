"""Operators 11 to 13 against a public library, brute force and SQL."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm import fixtures
from oracle import canonical, duck
from tokenizers import Tokenizer

from tallyfern.llm import conversations, divergence, merge_automaton, queries

PATH = public_tokenizers.path(queries.WORD_MERGES)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same_tokens(library, text):
    own = merge_automaton.tokenizer(PATH)
    ids = own.encode(text)
    expected = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == expected, text[:80]
    assert own.decode(ids) == library.decode(expected, skip_special_tokens=False).encode()


def test_automaton_equals_the_library_on_awkward_texts(library):
    for text in (
        "", " \n", "Hello WORLD it's Don'T<|endoftext|>b<|startoftext|><|x|>", "a" * 5000, "aaa aaaa",
        "ΑΣ ΟΔΟΣ. 'S İ", "é Å İ", "\x1c\x1d ½ ² Ⅷ _a_", "中文字 ไทย 👍🏽",
    ):
        same_tokens(library, text)


def test_automaton_equals_the_library_on_random_texts(library):
    rng = random.Random(11)
    labels = merge_automaton.tokenizer(PATH).labels
    for _ in range(300):
        same_tokens(library, "".join(rng.choice("abcdeinorst'  ") for _ in range(150)))
        pieces = [rng.choice(labels).decode().replace("</w>", rng.choice(["", " "])) for _ in range(30)]
        same_tokens(library, "".join(pieces))
        points = [rng.choice([rng.randrange(32, 0x250), rng.randrange(0xE000, 0x110000)]) for _ in range(40)]
        same_tokens(library, "".join(map(chr, points)))


def test_automaton_equals_the_library_around_every_code_point(library):
    every = merge_automaton.EVERY
    for i in range(0, len(every), 4000):
        same_tokens(library, "x ".join(every[i : i + 4000]))


def test_gadgets_keep_one_path_for_every_string():
    """Repeated, overlapping and dead merges, against merging by rank."""
    symbols = merge_automaton.byte_symbols()
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("aa", "aa"), ("ab", "a</w>"), ("b", "b</w>")]
    made = [u + v for u, v in merges]
    vocabulary = {t: i for i, t in enumerate([*symbols, *[s + "</w>" for s in symbols], *made])}
    machine = merge_automaton.Automaton(vocabulary, merges, "</w>")
    for n in range(1, 11):
        for bits in range(1 << n):
            word = "".join("ab"[bits >> i & 1] for i in range(n))
            tokens = [*word[:-1], word[-1] + "</w>"]
            for u, v in merges:
                i = 0
                while i < len(tokens) - 1:
                    if (tokens[i], tokens[i + 1]) == (u, v):
                        tokens[i : i + 2] = [u + v]
                    i += 1
            assert [machine.labels[t].decode() for t in machine.encode_word(word.encode())] == tokens, word


def test_word_bpe_of_awkward_documents(spark, library):
    docs = fixtures.documents(spark).withColumnRenamed("score", "ids")
    rows = merge_automaton.encode(docs, PATH, keep=("doc_id", "ids", "text")).collect()
    assert len(rows) == docs.count()
    for row in rows:
        expected = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(row["ids"], "<u4").tolist() == expected
        assert bytes(row["decoded"]) == library.decode(expected, skip_special_tokens=False).encode()
    assert merge_automaton.encode(fixtures.no_documents(spark), PATH).count() == 0


def edited(facts):
    """Cost, audit and rows of the cheapest edits: every state with its best so far."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def offer(best, state, found):
        if state not in best or found[:2] < best[state][:2]:
            best[state] = found

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, said) in list(best.items()):
                for r in set(follows[state]) - {"s"}:
                    offer(best, r, (cost + 2, audit + "I", [*said, full[r] + ":"]))
        return best

    best = inserted({"": (0, "", [])})
    for role, text, doomed, late in facts:
        after = {}
        for state, (cost, audit, said) in best.items():
            offer(after, state, (cost + 3, audit + "D", said))
            if doomed:
                continue
            if role[:1] and role[:1] in follows[state]:
                offer(after, role[:1], (cost + late, audit + "K", [*said, f"{role}:{text}"]))
            for r in set(follows[state]) - {"s"}:
                offer(after, r, (cost + 2 + late, audit + "R", [*said, f"{full[r]}:{text}"]))
        best = inserted(after)
    return min(best[s] for s in ("", "a") if s in best)


def brute_repair(rows):
    damaged = {}
    for conv, turn, role, text in rows:
        own = damaged.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if fate == 0:
            continue
        text = "" if fate == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, own in damaged.items():
        mark = lambda r, x: hashlib.md5(f"{len(r)}:{r}:{x}".encode()).digest()
        own.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], mark(z[1], z[2])))
        seen, counts, facts = set(), [0, 0, 0], []
        for _, role, text in own:
            body = text.strip(" \t\n\v\f\r")
            faults = [not body, (role, text) in seen, bool(body) and body[-1] not in ".!?"]
            seen.add((role, text))
            if any(faults):
                counts[faults.index(True)] += 1
            facts.append((role, text, faults[0] or faults[1], faults[2]))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, said = edited(facts)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string, audit string"


def conversation_rows(seed=3):
    """Ties, repeated rows, nulls in every column, one long conversation, long texts."""
    rng, rows = random.Random(seed), []
    for conv in [*range(50), None, 10**18]:
        for t in range(700 if conv == 7 else rng.choice([1, 1, 2, 3, 5, 8, 13, 40])):
            turn = rng.choice([t, t, t, t + rng.randint(0, 3), None])
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "ursula"])
            text = rng.choice(["Hi.", "Hi there", "  ", "", None, f"text {rng.randint(0, 30)}.", f"w{t} é?\t", "x" * 20_000])
            rows.append((conv, turn, role, text))
    return [*rows, *rows[:5]]


@pytest.mark.parametrize(("parts", "open_rows"), [(8, 1 << 16), (3, 5), (1, 1 << 16)])
def test_repair_equals_brute_force(spark, parts, open_rows):
    rows = conversation_rows()
    frame = spark.createDataFrame([(*r, "clash") for r in rows], TURNS).repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r[0]: tuple(r[1:]) for r in conversations.repair(frame, open_rows=open_rows).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_repair(rows)


def test_repair_of_no_rows_and_dropped_rows(spark):
    assert conversations.repair(spark.createDataFrame([], TURNS)).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = conversations.repair(spark.createDataFrame([(dropped, 0, "user", "Hi.", "")], TURNS)).collect()
    assert [tuple(r) for r in row] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_ranks_choose_the_least_of_equally_cheap_audits():
    """Two assistants in a row: insert or rerole cost the same, the least audit wins."""
    code = np.array([2, 3, 3, 3], np.int64)
    run = conversations._Nodes(np.array([4]), code, np.zeros(4, bool), conversations.ACCEPT[None, :], closed=True)
    audits, said, _ = conversations._script(run, np.array([0]), ["user", *["assistant"] * 3], ["a.", "b.", "c.", "d."])
    cost, audit, rows = edited([("user", "a.", False, False), *[("assistant", x, False, False) for x in ("b.", "c.", "d.")]])
    assert (run.cost[0, 0], audits[0].decode(), said[0]) == (cost, audit, rows)


def divergence_rows():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdé" for b in "xyzž"]
    rows = []
    for i in range(900):
        text = " ".join(rng.choices(words, k=rng.randint(0, 30)))
        text = rng.choice([text, text.upper(), None if i % 50 == 0 else text, f"{text} 1{text}"])
        rows.append((i % 700, text, rng.choice(["en", "de", None, ""]), rng.choice(["hot"] * 6 + ["b", "c", None, "dé"]), None, "x", "y"))
    rows.append((901, None, "none", "alone", 0, "", ""))
    rows.append((902, "few words", "few", "one", 0, "", ""))
    rows.append((903, "other words", "few", "two", 0, "", ""))
    return rows


@pytest.mark.parametrize("options", [{}, {"entries": 7, "block": 2}])
def test_divergence_equals_its_sql(spark, tmp_path, options):
    docs = spark.createDataFrame(divergence_rows(), fixtures.SCHEMA).repartition(5)
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    relation = duck(str(tmp_path)).sql(queries.ORACLES["op13_source_divergence"])
    got = divergence.divergences(docs, **options)
    rows = [tuple(r) for r in got.collect()]
    assert canonical(got.columns, rows) == canonical(relation.columns, relation.fetchall())
    assert ("few", "one", "pair", "two", 0, 1) in rows and not any(r[0] == "none" for r in rows)


def test_divergence_of_no_documents(spark):
    assert divergence.divergences(fixtures.no_documents(spark)).count() == 0


def test_shares_are_exact_for_large_counts():
    counts = np.array([[0, 7, 10**15]])
    for total in (10**15 + 7, 1 << 54):
        exact = [1 + 10**9 * (c + 5) // (total + 35) for c in counts[0].tolist()]
        assert divergence.shares(counts, np.array([[total]]), 7).tolist() == [exact]
