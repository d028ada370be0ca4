"""Readers and the staging folder."""

import threading

import pytest
from pyspark.sql import functions as F

from bough import SetupError, catalog_tables, code_list, given_tables, jdbc_tables, parquet_tables
from bough.operators.staging import stage, staged_here, staging_root


def test_given_tables_by_qualified_or_plain_name(spark):
    one, two = spark.range(1), spark.range(2)
    read = given_tables({"DBO.Orders": one, "lines": two})
    assert read("dbo", "orders") is one
    assert read(None, "LINES") is two and read("any", "Lines") is two
    with pytest.raises(SetupError, match="nothing"):
        read(None, "nothing")


def test_catalog_names_are_quoted(spark):
    spark.range(3).createOrReplaceTempView("`odd ``]; name`")
    assert catalog_tables(spark)(None, "odd `]; name").count() == 3


def test_parquet_folders(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "s" / "t.parquet"))
    assert parquet_tables(spark, str(tmp_path))("s", "t").count() == 4


class Recorder:
    """Stands in for a session's reader; no database is opened."""

    def __init__(self):
        self.seen = {}
        self.read = self

    def format(self, name):
        self.seen["format"] = name
        return self

    def option(self, name, value):
        self.seen[name] = value
        return self

    def options(self, **more):
        self.seen |= more
        return self

    def load(self):
        return self.seen


def test_jdbc_options():
    split = {"Orders": {"partitionColumn": "Id", "numPartitions": "64"}}
    read = jdbc_tables(Recorder(), "jdbc:x", {"user": "u"}, split, ["a]b"], quote=("[", "]"))
    seen = read("dbo", "Orders")
    assert seen["dbtable"] == "[dbo].[Orders]" and seen["numPartitions"] == "64"
    assert read(None, "a]b")["dbtable"] == "[a]]b]"
    with pytest.raises(SetupError, match="one_connection"):
        read("dbo", "Lines")


def test_code_list_of_one_type(spark):
    codes = spark.createDataFrame(
        [(61, "Basalt", 1), (62, "Granite", 1), (61, "Kilo", 2), (None, "x", 1)],
        "TblCodeID int, Code string, TblCodeTypeID int",
    )
    types = spark.createDataFrame([(1, "Rock"), (2, "Unit")], "TblCodeTypeID int, CodeType string")
    found = code_list(codes, types, "Rock").where(F.col("id").isNotNull()).collect()
    assert sorted(tuple(r) for r in found) == [("61", "Basalt"), ("62", "Granite")]
    assert code_list(codes, types, "country").count() == 0


class Session:
    def __init__(self, master, folder=None):
        self.sparkContext = self.conf = self
        self.master, self.folder = master, folder
        self.applicationId = f"{master}-{id(self)}"

    def get(self, name, default):
        return self.folder or default

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_staging_folder():
    assert staging_root(Session("yarn", "s3a://shared/x/")) == "s3a://shared/x"
    with pytest.raises(SetupError, match="spark.checkpoint.dir"):
        staging_root(Session("yarn"))
    local = Session("local[2]")
    assert staging_root(local) == staging_root(local)


def test_threads_remove_what_they_staged_only(spark):
    """A block in one thread leaves alone what another thread stages meanwhile."""
    inside, done, other = threading.Event(), threading.Event(), []

    def elsewhere():
        inside.wait(60)
        other.append(stage(spark.range(5), "elsewhere"))
        done.set()

    thread = threading.Thread(target=elsewhere)
    thread.start()
    with staged_here(spark):
        mine = stage(spark.range(3), "here")
        assert mine.count() == 3
        inside.set()
        assert done.wait(60)
    thread.join()
    assert other[0].count() == 5
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        mine.collect()


def test_stage_cuts_the_plan(spark, capsys):
    staged = stage(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count(), "t")
    staged.explain()
    assert "Aggregate" not in capsys.readouterr().out
    assert staged.count() == 3
