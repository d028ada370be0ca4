"""Plans that must hold on large and skewed data."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from bough import ExportRun, dense_number
from bough.operators import checks, lookups, ranges
from bough.operators.staging import staging_root
from bough.sinks import csv

SPEC = {
    "name": "x",
    "root": {
        "name": "A",
        "table": "a",
        "keyColumn": "k",
        "fields": [{"name": "v"}],
        "children": [
            {
                "name": "B",
                "table": "b",
                "keyColumn": "k",
                "parentKeyColumn": "p",
                "fields": [{"name": "v"}],
            }
        ],
    },
    "filters": [{"name": "v", "entity": "A", "field": "v", "operator": "IsNotNull"}],
}


@pytest.fixture
def large_joins(spark):
    """Joins as they are planned when nothing is small enough to broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


@pytest.fixture
def skewed(spark, tmp_path):
    """Two thirds of the children belong to one parent."""
    parents = spark.range(2000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    owner = F.when(F.col("id") % 3 != 0, F.lit(7)).otherwise(F.col("id") % 2000)
    text = F.concat_ws("-", F.sha2(F.col("id").cast("string"), 512), F.col("id"))
    children = spark.range(40000).select(F.col("id").alias("k"), owner.alias("p"), text.alias("v"))
    parents.write.parquet(str(tmp_path / "a"))
    children.repartition(8).write.parquet(str(tmp_path / "b"))
    return {n: spark.read.parquet(str(tmp_path / n)) for n in "ab"}


def final_plan(df, capsys):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    df.explain()
    return capsys.readouterr().out


def test_hot_parent_is_split_in_joins(spark, large_joins, skewed, capsys):
    run = ExportRun(spark, SPEC, skewed, {"v": None}, check_keys=False)
    assert "skew=true" in final_plan(run.level("B"), capsys)
    pieces, _ = run.document("json")
    assert "skew=true" in final_plan(pieces, capsys)


def test_hot_value_is_split_in_lookups(spark, large_joins, skewed, capsys, monkeypatch):
    """A list that is too large to broadcast is joined by shuffle, and a value that most rows share
    is split."""
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", 10)
    child = SPEC["root"]["children"][0] | {"parentKeyColumn": None}
    fields = [{"name": "p", "type": "Int64", "lookup": "names"}, {"name": "v"}]
    spec = {"name": "x", "root": child | {"fields": fields}}
    names = skewed["a"].select(F.col("k").alias("id"), F.concat(F.lit("n"), "v").alias("code"))
    run = ExportRun(spark, spec, skewed, lookups={"names": names})
    rows = run.rows(ordered=False)
    assert "skew=true" in final_plan(rows, capsys)
    assert rows.where("p = 'n7'").count() == 26666 + 20 - 13


def test_small_list_is_broadcast(spark, skewed, capsys):
    names = skewed["a"].select(F.col("k").alias("id"), F.col("v").alias("code"))
    child = SPEC["root"]["children"][0] | {"parentKeyColumn": None}
    spec = {"name": "x", "root": child | {"fields": [{"name": "p", "type": "Int64", "lookup": "names"}]}}
    ExportRun(spark, spec, skewed, lookups={"names": names}).rows().explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_columns_are_pruned_and_levels_shuffle_once(spark, large_joins, skewed, capsys):
    wide = {n: df.withColumn("unused", F.lit("x")) for n, df in skewed.items()}
    run = ExportRun(spark, SPEC, wide, check_keys=False)
    run.nested(ordered=False).explain()
    plan = capsys.readouterr().out
    assert "unused" not in plan
    # One exchange per level: children by their parent's key, parents by their key.
    assert plan.count("Exchange hashpartitioning") == 2


def test_no_task_takes_all_rows(spark, large_joins, skewed, capsys):
    run = ExportRun(spark, SPEC, skewed, check_keys=False)
    pieces, order = run.document("xml")
    for df in (run.rows(), run.nested(), pieces.orderBy(*[F.col(f"`{c}`") for c in order])):
        df.explain()
        assert "SinglePartition" not in capsys.readouterr().out


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_numbers_move_rows_once_and_write_nothing(spark, large_joins, skewed, capsys, monkeypatch):
    """One exchange of the fields, to their range; a child level meets its parents' numbers besides."""
    monkeypatch.setattr(ranges, "RANGE_BYTES", 1 << 18)
    monkeypatch.setattr(csv, "FILE_BYTES", 1 << 18)
    staged = staging_root(spark).removeprefix("file:").lstrip("/")
    flat = {"name": "x", "root": SPEC["root"]["children"][0] | {"parentKeyColumn": None}}
    plan = plan_of(ExportRun(spark, flat, skewed).rows(numbered=True, ordered=False), capsys)
    assert plan.count("Exchange") == 1 and staged not in plan
    run = ExportRun(spark, SPEC, skewed)
    plan = plan_of(run.numbered_level("A"), capsys)
    assert plan.count("Exchange") == 1 and staged not in plan
    level = run.numbered_level("B")
    plan = plan_of(level, capsys)
    assert plan.count("Exchange shufflepartitionidpassthrough") == 1 and "SinglePartition" not in plan
    sizes = [r[0] for r in level.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 40000 and max(sizes) < 40000 / 8


def test_a_hot_key_is_cut_by_rows(spark, monkeypatch):
    """Two thirds of the rows of a flat export have one key."""
    key = F.when(F.col("id") % 3 != 0, F.lit(7)).otherwise(F.col("id") % 500)
    df = spark.range(20000).select(key.alias("k"), F.col("id").alias("v"))
    numbered = dense_number(df, ["k"], size=(16 << 20) / 1000)
    sizes = [r[0] for r in numbered.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 20000 and max(sizes) < 20000 / 5
    rows = numbered.orderBy("RowNumber").collect()
    assert [r.RowNumber for r in rows] == list(range(1, 20001))
    assert [r.k for r in rows] == sorted(r.k for r in rows)


@pytest.mark.parametrize("format", ["json", "xml", "csv"])
def test_parts_do_not_depend_on_shuffle_partitions(spark, skewed, tmp_path, monkeypatch, format):
    monkeypatch.setattr(ranges, "PART_BYTES", 1 << 18)
    spec = SPEC if format != "csv" else {"name": "x", "root": SPEC["root"]["children"][0] | {"parentKeyColumn": None}}
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("2", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            ExportRun(spark, spec, skewed).write(str(tmp_path / partitions), format)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        parts = sorted(p for p in (tmp_path / partitions).iterdir() if p.name.startswith("part-"))
        found.append((len(parts), b"".join(p.read_bytes() for p in parts)))
        sizes = [p.stat().st_size for p in parts]
        assert len(parts) > 10 and max(sizes) < 3 * (1 << 18)
    assert found[0][1] == found[1][1] and abs(found[0][0] - found[1][0]) <= 4


@pytest.mark.parametrize("format", ["json", "xml"])
def test_pieces_move_as_fields(spark, large_joins, skewed, capsys, monkeypatch, format):
    """What renders stands above the exchange that orders the pieces, never below."""
    monkeypatch.setattr(ranges, "PART_BYTES", 1 << 18)
    pieces, order, texts = ExportRun(spark, SPEC, skewed)._document_pieces(format)
    arranged = ranges.ordered(pieces, order, F.lit(100.0), 8e6)
    plan = plan_of(texts.rendered(arranged).select("text"), capsys)
    above, below = plan.split("Exchange shufflepartitionidpassthrough", 1)
    # Every text is put together by concat.
    assert "concat(" in above and "concat(" not in below


def test_few_surviving_parents_reach_the_childs_scan(spark, large_joins, skewed, capsys):
    few = SPEC | {"filters": [{"name": "v", "entity": "A", "field": "v", "operator": "In"}]}
    level = ExportRun(spark, few, skewed, {"v": ["7", "12", "9999"]}).level("B")
    plan = plan_of(level, capsys)
    assert "In(p, [" in plan and "Join" not in plan
    want = skewed["b"].where("p in (7, 12)").count()
    assert level.count() == want > 0
    assert ExportRun(spark, few, skewed, {"v": ["none"]}).level("B").count() == 0
    # Two thousand are joined.
    assert "Join" in plan_of(ExportRun(spark, SPEC, skewed, {"v": None}).level("B"), capsys)


def test_counts_join_and_write_nothing(spark, large_joins, skewed, capsys):
    staged = staging_root(spark).removeprefix("file:").lstrip("/")
    lost = skewed["b"].select("k", F.when(F.col("k") % 5 == 0, F.lit(-1)).when(F.col("k") % 7 > 0, F.col("p")).alias("p"), "v")
    run = ExportRun(spark, SPEC, {"a": skewed["a"], "b": lost})
    plan = plan_of(run.row_counts(), capsys)
    assert "Join" not in plan and staged not in plan
    # One exchange by the parents' key and one of the sums.
    assert plan.count("Exchange") == 2
    want = lost.where("p >= 0").count()
    assert {r.entity: r.rows for r in run.row_counts().collect()} == {"A": 2000, "B": want}


def test_bounds_are_sampled_by_the_tasks_that_read(spark):
    def task_of(batches):
        for batch in batches:
            task = [TaskContext.get().partitionId()] * batch.num_rows
            yield batch.set_column(1, "task", pa.array(task, pa.int64()))

    read = spark.range(0, 4000, 1, 4).withColumn("task", F.lit(0).cast("long")).mapInArrow(task_of, "id long, task long")
    assert {b[0] for b in ranges.cut(read, ["task", "id"], 40, 4000).bounds} == {0, 1, 2, 3}


def test_key_checks_hold_a_bounded_number_of_rows_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(checks, "CHECKED_ROWS", 100, raising=False)
    twice = spark.range(2000).select((F.col("id") % 1000).alias("k"), F.col("id").cast("string").alias("v"))
    found = checks.key_violations(twice, ["k"]).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.k, r.rows) for r in found) == [(k, 2) for k in range(1000)]
    assert max(Counter(r.task for r in found).values()) <= 100
