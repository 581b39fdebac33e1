"""CSV files with multi-line cells, read in ranges."""

from __future__ import annotations

import csv
import io
import random

import pytest

from tallyfern.sources import delimited, readers


def test_cells_equal_the_csv_module():
    rng, grammar = random.Random(5), delimited.Grammar()
    for _ in range(5_000):
        text = "".join(rng.choice('ab,,""" ') for _ in range(rng.randint(1, 12)))
        expected = next(csv.reader(io.StringIO(text, newline="")))
        assert [c.decode() for c in grammar.cells(text.encode())] == expected, text


def quoted_after(text: str) -> bool:
    """Whether a quoted cell is open after a text, character by character."""
    state = "start"
    for c in text:
        if state == "quoted":
            state = "quote" if c == '"' else "quoted"
        elif state in ("start", "quote") and c == '"':
            state = "quoted"
        elif c in ",\n":
            state = "start"
        else:
            state = "cell"
    return state == "quoted"


def test_line_functions_compose_to_the_state_of_the_text():
    rng, grammar = random.Random(6), delimited.Grammar()
    for _ in range(5_000):
        lines = ["".join(rng.choice('a,""') for _ in range(rng.randint(0, 5))) for _ in range(4)]
        is_open = False
        for line in lines:
            is_open = grammar.is_open_after(line.encode(), is_open)
        assert is_open == quoted_after("".join(f"{x}\n" for x in lines)), lines


def test_state_before_each_range(spark):
    """Functions that ignore, keep and swap their argument, composed by hand."""
    rng = random.Random(7)
    rows, expected = [], {}
    for file in "ab":
        state = 0
        for start in range(0, 400, 10):
            pair = rng.choice([(0, 1), (1, 0), (0, 0), (1, 1)])
            rows.append((file, start, *pair))
            expected[file, start] = bool(state)
            state = pair[state]
    ranges = spark.createDataFrame(rows, "file string, start long, after_closed int, after_open int")
    got = {(r.file, r.start): r.is_open for r in delimited.states_before(ranges.repartition(5)).collect()}
    assert got == expected


TEXTS = [
    "plain", 'multi\nline "quoted", x\n\n end', '"', '""\n"', ",", " ", "x" * 3_000 + '\n,"', "é\r\nü", "\n" * 40,
]


@pytest.fixture(scope="module")
def raw_file(tmp_path_factory):
    rng, rows = random.Random(8), []
    file = tmp_path_factory.mktemp("csv") / "raw.csv"
    with open(file, "w", newline="") as out:
        out.write("﻿")
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["id", "a", "text", "b"])
        for i in range(1_500):
            row = [str(i), rng.choice(["", 'q"q', "z"]), rng.choice(TEXTS), "e"]
            row = [*row, "extra"] if i % 100 == 7 else row[:2] if i % 100 == 9 else row
            writer.writerow(row)
            rows.append(row)
            if i % 50 == 0:
                out.write("\n  \n")  # blank lines are no records
    return file, rows


@pytest.mark.parametrize("ranges", [1, 7, 64, 400])
def test_same_rows_wherever_the_cuts_fall(spark, raw_file, ranges):
    file, rows = raw_file
    keys = {"spark.sql.files.maxPartitionBytes": file.stat().st_size // ranges + 1, "spark.sql.files.openCostInBytes": 0}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        frame = delimited.read_quoted_csv(spark, str(file), ["id", "text", "b"])
        got = sorted((tuple(r) for r in frame.collect()), key=lambda r: int(r[0]))
        rejected = readers.rejected_lines(spark, str(file))
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert got == [(*[r[j] if j < len(r) else None for j in (0, 2, 3)], len(r)) for r in rows]
    assert rejected == sum(len(r) > 4 for r in rows)


def test_odd_files(spark, tmp_path):
    """No record, no line break at the end, a cell that is never closed, bad bytes."""
    (tmp_path / "head.csv").write_bytes(b"id,text\n")
    assert delimited.read_quoted_csv(spark, str(tmp_path / "head.csv")).count() == 0
    (tmp_path / "open.csv").write_bytes(b'id,text\r\n1,a\xffb\r\n2,"x, ""y""\r\nz')
    rows = [tuple(r) for r in delimited.read_quoted_csv(spark, str(tmp_path / "open.csv")).collect()]
    assert sorted(rows) == [("1", "a�b", 2), ("2", 'x, "y"\r\nz', 2)]
    with pytest.raises(ValueError):
        delimited.Grammar('"')


def test_two_files_with_a_header_each(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text(f'id,text\n1{name},"x\n{name}"\n')
    rows = {tuple(r) for r in delimited.read_quoted_csv(spark, str(tmp_path)).collect()}
    assert rows == {("1a", "x\na", 2), ("1b", "x\nb", 2)}
