"""Tables cut into the shared folder go when the table made from them is written."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyfern.sources.session import shared_folder
from tallyfern.sources.tables import cut_lineage, cut_result, drop_cut


def cuts(spark) -> set[str]:
    return {p.name for p in Path(shared_folder(spark)).glob("cut-*")}


def test_only_the_result_stays(spark):
    before = cuts(spark)

    def inner():
        first = cut_lineage(spark.range(10))
        return first.join(cut_lineage(first.where("id > 4")), "id")

    def outer():
        one = cut_result(spark, inner)
        return one.unionByName(cut_lineage(spark.range(3)))

    made = cut_result(spark, outer)
    assert sorted(r[0] for r in made.collect()) == [0, 1, 2, 5, 6, 7, 8, 9]
    assert len(cuts(spark) - before) == 1
    drop_cut(made)
    assert cuts(spark) == before


def test_cuts_outside_are_left_alone_and_failures_too(spark):
    before = cuts(spark)
    own = cut_lineage(spark.range(4))
    made = cut_result(spark, lambda: own.where("id > 1"))
    assert own.count() == 4 and made.count() == 2 and len(cuts(spark) - before) == 2

    def fails():
        cut_lineage(spark.range(2))
        raise ValueError("no table")

    with pytest.raises(ValueError):
        cut_result(spark, fails)
    after = cut_result(spark, lambda: cut_lineage(spark.range(5)).agg(F.sum("id").alias("s")))
    assert after.first()[0] == 10 and len(cuts(spark) - before) == 4


def test_empty_results(spark):
    before = cuts(spark)
    made = cut_result(spark, lambda: cut_lineage(spark.range(5)).where("id > 9"))
    assert made.count() == 0 and made.columns == ["id"] and len(cuts(spark) - before) == 1
