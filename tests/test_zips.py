"""Members of archives read without unpacking."""

from __future__ import annotations

import zipfile

import pytest

from signalmill.sources import zips


@pytest.fixture
def archives(tmp_path):
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in/names.csv", "﻿id,name,id\n1,\"Été, \"\"x\"\"\nline\",9\n\n2\n3,c,d,e\n")
        z.writestr("in/other.csv", "key\n1\n")
        z.writestr("large.csv", "id,name\n" + "".join(f"{i},{'n' * 50}\n" for i in range(5000)) + "z," + "y" * 200_000 + "\n")
        z.writestr("read.me", "no table")
    with zipfile.ZipFile(tmp_path / "sub" / "b.zip", "w") as z:
        z.writestr("in/names.csv", "name,id\nb,7\n")
        z.writestr("empty.csv", "")
    (tmp_path / "not.txt").write_text("x")
    return str(tmp_path)


def test_members_of_all_archives(spark, archives):
    found = zips.zip_members(spark, archives, ["id", "name"], "in/n*.csv")
    assert sorted((r.archive.rsplit("/", 1)[-1], r.id, r.name) for r in found.collect()) == [("a.zip", "1", 'Été, "x"\nline'), ("a.zip", "2", None), ("a.zip", "3", "c"), ("b.zip", "7", "b")]
    assert found.rdd.getNumPartitions() == 2
    large = zips.zip_members(spark, f"file://{archives}/a.zip", ["name"], "large.csv")
    assert large.count() == 5001 and large.where("length(name) = 200000").count() == 1


def test_missing_columns_are_refused_and_empty_folders_are_empty(spark, archives, tmp_path):
    with pytest.raises(Exception, match="other.csv has no column name"):
        zips.zip_members(spark, f"{archives}/a.zip", ["name"], "in/*").collect()
    with pytest.raises(Exception, match="empty.csv has no column id"):
        zips.zip_members(spark, archives, ["id"], "empty.csv").collect()
    (tmp_path / "none").mkdir()
    assert zips.zip_members(spark, str(tmp_path / "none"), ["id"]).collect() == []


def test_filters_on_members_leave_out_partitions(spark, archives):
    setting = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:  # without the pushdown the other members would be refused
        got = zips.zip_members(spark, archives, ["id", "name"], "*", pushdown=True).where("member = 'in/names.csv' and id > '1'")
        assert sorted(r.id for r in got.collect()) == ["2", "3", "7"]
    finally:
        spark.conf.set(setting, before)
