"""Large CSV files with quoted line breaks, read by many tasks."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from bough import Entity, Export, Field, read_bundle
from bough.sources.records import csv_records


@pytest.fixture
def small_splits(spark):
    """Splits of a kilobyte, so that small files lie across many."""
    settings = {"spark.sql.files.maxPartitionBytes": "1024", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def rendered(rows):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\r\n").writerows(rows)
    return out.getvalue()


def values(rng):
    parts = ["\r\n", "\n", "\r", '"', '""', ",", "plain", "é😀", " ", "x" * 50]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_by_many_tasks(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    want = []
    for file in range(3):
        rows = [[str(i), values(rng), values(rng) if i % 50 else ("line\r\n" * 2000)[:-2]] for i in range(200)]
        (tmp_path / f"{file}.csv").write_bytes(rendered(rows).encode())
        want += rows
    records = csv_records(spark, str(tmp_path), "\r\n")
    parse = {"multiLine": "true", "quote": '"', "escape": '"', "mode": "FAILFAST", "emptyValue": "", "nullValue": "\0"}
    parsed = records.select(F.from_csv("record", "a string, b string, c string", parse).alias("r")).select("r.*")
    assert spark.read.text(str(tmp_path), lineSep="\r\n").rdd.getNumPartitions() > 20
    assert sorted([r.a, r.b or "", r.c or ""] for r in parsed.collect()) == sorted(want)


def test_records_without_line_breaks_stay_in_the_jvm(spark, tmp_path, small_splits, capsys):
    (tmp_path / "a.csv").write_bytes(rendered([[str(i), 'say "hi", all'] for i in range(500)]).encode())
    records = csv_records(spark, str(tmp_path), "\r\n")
    records.explain()
    assert "MapInArrow" not in capsys.readouterr().out
    assert records.count() == 500


def test_one_large_file_of_a_bundle(spark, tmp_path, small_splits):
    """A bundle of single files, as others write it, equals the sequential read."""
    rng = random.Random(9)
    rows = [(i, values(rng) or None) for i in range(1, 800)]
    text = rendered([["_key", "Text"], *[[str(i), t or ""] for i, t in rows]])
    (tmp_path / "A.csv").write_bytes(text.encode())
    export = Export("x", Entity("A", "a", "k", (Field("Text"),)))
    got = read_bundle(spark, str(tmp_path), export)["A"]
    assert got.rdd.getNumPartitions() > 10
    assert sorted((r.RowNumber, r.Text) for r in got.collect()) == rows
    alone = spark.read.schema("k string, t string").options(
        multiLine=True, lineSep="\r\n", quote='"', escape='"', header=True
    ).csv(str(tmp_path / "A.csv"))
    assert sorted((int(r.k), r.t) for r in alone.collect()) == rows


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    assert csv_records(spark, str(tmp_path), "\r\n").count() == 0
