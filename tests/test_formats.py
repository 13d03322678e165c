from __future__ import annotations

import os

import pytest

from tellurix.sources import formats

ROWS = [(1, "ä,b", 1.5), (2, None, None), (3, "", -2.0)]
SCHEMA = "id int, name string, x double"


@pytest.mark.parametrize("kind", ["parquet", "orc", "json"])
def test_round_trip(spark, tmp_path, kind):
    formats.write(spark.createDataFrame(ROWS, SCHEMA), f"{tmp_path}/t", kind)
    assert sorted(map(tuple, formats.read(spark, f"{tmp_path}/t", kind, SCHEMA).collect())) == ROWS


def test_csv_keeps_quoted_commas_and_gives_null_for_bad_fields(spark, tmp_path):
    formats.write(spark.createDataFrame(ROWS[:1], SCHEMA), f"{tmp_path}/t", "csv")
    assert formats.read(spark, f"{tmp_path}/t", "csv", SCHEMA).collect()[0].name == "ä,b"
    (tmp_path / "bad.csv").write_text("id,name,x\nseven,n,1.0\n")
    assert tuple(formats.read(spark, f"{tmp_path}/bad.csv", "csv", SCHEMA).first()) == (None, "n", 1.0)


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n")
    assert [r.value for r in formats.read(spark, f"{tmp_path}/a.txt", "text").collect()] == ["one", "", "two"]


def test_folders_by_column_are_pruned(spark, tmp_path):
    formats.write(spark.createDataFrame([(i, i % 2) for i in range(10)], "id int, part int"), f"{tmp_path}/t", by=["part"])
    assert sorted(x for x in os.listdir(tmp_path / "t") if "=" in x) == ["part=0", "part=1"]
    df = formats.read(spark, f"{tmp_path}/t").where("part = 1")
    assert "PartitionFilters: [isnotnull(part" in df._jdf.queryExecution().executedPlan().toString() and df.count() == 5


def test_schemas_are_asked_for(spark):
    with pytest.raises(ValueError):
        formats.read(spark, "x", "csv")
    with pytest.raises(ValueError):
        formats.read(spark, "x", "xls")
