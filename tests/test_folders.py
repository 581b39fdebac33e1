"""Streams over tables that are stored as folders of files."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from oracle import canonical, duck

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The smallest tables, documents and events as folders of three files each."""
    place = tmp_path_factory.mktemp("folders")
    for file in Path(SMALL).iterdir():
        if file.stem in ("documents", "events"):
            spark.read.parquet(str(file)).repartition(3).write.parquet(str(place / file.name))
        else:
            os.symlink(file, place / file.name)
    return str(place)


@pytest.mark.parametrize("name", ["stream_index", "stream_ask", "index_versions"])
def test_stream_over_a_folder_equals_sql(spark, folders, name):
    found = entry.queries()[name](spark, folders)
    expected = duck(SMALL).sql(entry.oracle_sql()[name])
    ours = canonical(found.columns, [tuple(r) for r in found.collect()])
    assert ours and ours == canonical(expected.columns, expected.fetchall())
