"""Small tables with every awkward case the operators must define."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string"

PASSAGE = " ".join(f"passage{i}" for i in range(70))


def sentence(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts(seed: int = 5) -> list[str | None]:
    """Nulls, empty and blank texts, one word, a very long text, copies, near copies,
    shared passages, repeated lines, odd code points."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(30, 160)) for _ in range(24)]
    long = sentence(rng, 30_000, 30_000)
    words = base[0].split()
    near = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in (3, 40)]
    lined = "\n".join(["same line here"] * 8 + [sentence(rng, 60)])
    return [
        None, "", "   \n\t ", "word", "two words", base[0], base[0], *near, long,
        f"{base[1]} {PASSAGE} {base[2]}", f"{base[3]} {PASSAGE}", PASSAGE, lined,
        "x" * 50_000, "été naïve 中文 𐍈 👍 don't 'll we've 　 1²3", "a b c " * 60, *base[4:],
    ]


def rows(seed: int = 5) -> list[tuple]:
    """The texts with ids in mixed order, a null id, a repeated row, null columns."""
    made = []
    for i, text in enumerate(texts(seed)):
        made.append(
            (i, text, ("en", "de", None)[i % 3], ("hot", "hot", None, "b")[i % 4],
             None if text is None else len(text), "clash", None)
        )
    made.append((None, made[5][1], "en", None, None, None, None))
    made.append(made[7])
    random.Random(seed).shuffle(made)
    return made


def documents(spark, seed: int = 5):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(5)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
