"""Nesting, numbering and the outputs made from them."""

import json
import random
import xml.etree.ElementTree as ET
from decimal import Decimal
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bough import (
    DuplicateKeys,
    Entity,
    Export,
    ExportRun,
    Field,
    SubtreeTooLarge,
    dense_number,
    read_bundle,
    rebuild,
    staged_here,
)
from bough.operators.checks import key_violations
from bough.operators.nesting import subtree_rows
from bough.operators.staging import staging_root
from bough.sinks import csv
from fixtures import SENSOR, STATIONS, climates, file_text, station_tables


def station_run(spark, filters=None, **options):
    lookups = {"climates": climates(spark)}
    return ExportRun(spark, STATIONS, station_tables(spark), filters, lookups, **options)


def tags(row):
    """``a1[b1[c1] b2]`` for a nested row of Tag fields."""
    kids = [tags(k) for name in row.asDict() if name != "Tag" for k in row[name]]
    return row.Tag + (f"[{' '.join(kids)}]" if kids else "")


def tagged(*shape):
    """An export of Tag fields from (name, [children]) pairs."""

    def entity(node, root):
        name, children = node
        return Entity(
            name, name, "k", (Field("Tag"),), None if root else "p",
            tuple(entity(c, False) for c in children),
        )

    return Export("x", entity(shape, True))


def numbered(spark, **levels):
    schema = "RowNumber long, ParentRowNumber long, Tag string"
    return {name: spark.createDataFrame(rows, schema) for name, rows in levels.items()}


def test_rebuild_uneven_branches(spark):
    """Branches of different depth below one root, lists without rows, and a root on its own."""
    export = tagged("City", [("Street", [("House", [("Room", [])]), ("Lamp", [])]), ("Park", [])])
    levels = numbered(
        spark,
        City=[(2, 0, "west"), (1, 0, "east"), (3, 0, "bare")],
        Street=[(3, 2, "oak"), (1, 1, "elm"), (2, 1, "fir")],
        House=[(2, 3, "no7"), (1, 3, "no5")],
        Room=[(1, 2, "attic"), (2, 2, "cellar")],
        Lamp=[(1, 1, "tall")],
        Park=[(1, 2, "green")],
    )
    rows = rebuild(export, levels).collect()
    assert [tags(r) for r in rows] == ["east[elm[tall] fir]", "west[oak[no5 no7[attic cellar]] green]", "bare"]
    assert rows[2].Street == [] and rows[2].Park == []
    assert rebuild(export, {name: df.limit(0) for name, df in levels.items()}).collect() == []


def test_rebuild_needs_unique_numbers(spark):
    export = tagged("City", [("Park", [])])
    with pytest.raises(DuplicateKeys, match="City"):
        rebuild(export, numbered(spark, City=[(1, 0, "a"), (1, 0, "b")], Park=[(1, 1, "p")]))


def test_transform(spark):
    def louder(name, df):
        return df.withColumn("Kind", F.upper("Kind")) if name == "Sensor" else df

    first = station_run(spark, transform=louder).nested().first()
    assert [sensor.Kind for sensor in first.Sensor] == ["WIND", "RAIN"]


def test_nested(spark):
    rows = station_run(spark).nested().collect()
    assert [(r.Title, r.Climate, r.Height) for r in rows] == [
        ("Fjordkant", "MARITIME", Decimal("12.500")),
        ("Hochmoor", "ALPINE", Decimal("845.250")),
        ("Salzpfanne", None, Decimal("-3.125")),
    ]
    assert [[(s.Kind, s.Slot, [x.Value for x in s.Reading]) for s in r.Sensor] for r in rows] == [
        [("wind", 2, [Decimal("7.10")]), ("rain", 1, [None, Decimal("0.40")])],
        [],
        [(None, 1, [Decimal("1.60")])],
    ]
    assert [[v.Who for v in r.Visit] for r in rows] == [[], [None, "Ada"], ["Bo"]]


COUNTS = {"Station": 3, "Sensor": 3, "Reading": 4, "Visit": 3}


def test_json_document(spark, tmp_path):
    assert station_run(spark).write(str(tmp_path / "out")) == COUNTS
    first, second, third = json.loads(file_text(tmp_path / "out"))
    assert list(first) == ["Height", "Manned", "Title", "Climate", "Opened", "Sensor"]
    assert first["Opened"] == "2011-03-05" and first["Climate"] == "MARITIME"
    assert list(second) == ["Height", "Manned", "Title", "Climate", "Opened", "Visit"]
    assert first["Sensor"][1] == {"Kind": "rain", "Slot": 1, "Reading": [{"Value": None}, {"Value": 0.4}]}
    assert third["Climate"] is None and third["Visit"] == [{"Who": "Bo"}]
    assert '"Height":12.500' in file_text(tmp_path / "out")


def test_xml_document(spark, tmp_path):
    station_run(spark).write(str(tmp_path / "out"), "xml")
    root = ET.fromstring(file_text(tmp_path / "out"))
    assert root.tag == "network" and [e.tag for e in root] == ["Station"] * 3
    assert [len(e.findall("Sensor/Reading")) for e in root] == [3, 0, 1]
    empty = root[1].find("Visit/Who")
    assert empty.text is None and empty.attrib == {"nil": "true"}
    assert root[0].find("Sensor/Kind").text == "wind"


@pytest.mark.parametrize("format, text", [("json", "[\n]\n"), ("xml", None)])
def test_empty_documents(spark, tmp_path, format, text):
    nothing = station_run(spark, {"heights": ["9000", "9999"]})
    assert nothing.write(str(tmp_path / "out"), format) == dict.fromkeys(COUNTS, 0)
    written = file_text(tmp_path / "out")
    assert written == text or len(ET.fromstring(written)) == 0


def flat(**root):
    return STATIONS | {"filters": [], "root": STATIONS["root"] | {"children": []} | root}


def test_flat_csv(spark, tmp_path):
    fields = [{"name": "Title", "column": "title"}, {"name": "Height", "column": "height", "type": "Decimal"}]
    run = ExportRun(spark, flat(fields=fields), station_tables(spark))
    assert run.write(str(tmp_path / "out"), "csv") == {"Station": 3}
    lines = ["Title,Height", "Fjordkant,12.500", "Hochmoor,845.250", "Salzpfanne,-3.125", ""]
    assert file_text(tmp_path / "out") == "\r\n".join(lines)


@pytest.mark.parametrize("format", ["json", "xml"])
def test_flat_documents_with_repeated_keys(spark, tmp_path, format):
    """Every row is there once and the document is valid, also where rows are equal in everything."""
    rows = [(1, "a"), (1, "b"), (1, "a"), (1, "a"), (2, "c"), (2, "c"), (None, "n"), (None, "n")]
    for name, own in (("with", rows), ("without", rows[:6]), ("none", [])):
        table = spark.createDataFrame(own, "k int, v string").repartition(5)
        spec = {"name": "x", "root": {"name": "A", "table": "t", "keyColumn": "k", "fields": [{"name": "v"}]}}
        ExportRun(spark, spec, {"t": table}).write(str(tmp_path / name), format)
        text = file_text(tmp_path / name)
        got = [r["v"] for r in json.loads(text)] if format == "json" else [e.find("v").text for e in ET.fromstring(text)]
        assert sorted(got) == sorted(v for _, v in own)


def test_numbers_that_json_has_not(spark, tmp_path):
    spec = {"name": "x", "root": {"name": "A", "table": "t", "keyColumn": "k", "fields": [{"name": "v"}]}}
    for i, bad in enumerate((float("nan"), float("-inf"))):
        run = ExportRun(spark, spec, {"t": spark.createDataFrame([(1, 0.5), (2, bad), (3, None)], "k int, v double")})
        with pytest.raises(Exception, match="entity 'A', field 'v': JSON has no number"):
            run.write(str(tmp_path / str(i)), "json")
        run.write(str(tmp_path / f"csv{i}"), "csv")


def test_csv_bundle(spark, tmp_path):
    station_run(spark).write(str(tmp_path), "csv")
    want = {
        "Station": [
            "_key,Height,Manned,Title,Climate,Opened", "1,12.500,true,Fjordkant,MARITIME,2011-03-05",
            "2,845.250,,Hochmoor,ALPINE,2014-09-21", "3,-3.125,false,Salzpfanne,,2011-03-06",
        ],
        "Sensor": ["_key,_parentKey,Kind,Slot", "1,1,wind,2", "2,1,rain,1", "3,3,,1"],
        "Reading": ["_key,_parentKey,Value", "1,1,7.10", "2,2,", "3,2,0.40", "4,3,1.60"],
        "Visit": ["_key,_parentKey,Who", "1,2,", "2,2,Ada", "3,3,Bo"],
    }
    for name, lines in want.items():
        assert file_text(tmp_path / f"{name}.csv") == "\r\n".join([*lines, ""])


def test_empty_bundle_has_headers(spark, tmp_path):
    station_run(spark, {"heights": ["9000", "9999"]}).write(str(tmp_path), "csv")
    assert file_text(tmp_path / "Visit.csv") == "_key,_parentKey,Who\r\n"
    levels = read_bundle(spark, str(tmp_path), Export.from_dict(STATIONS))
    assert [df.count() for df in levels.values()] == [0] * 4


def test_root_with_parent_key_has_an_empty_column(spark, tmp_path):
    root = STATIONS["root"] | {"parentKeyColumn": "climate"}
    run = ExportRun(
        spark, STATIONS | {"root": root}, station_tables(spark), lookups={"climates": climates(spark)}
    )
    run.write(str(tmp_path), "csv")
    assert file_text(tmp_path / "Station.csv").split("\r\n")[:2] == [
        "_key,_parentKey,Height,Manned,Title,Climate,Opened",
        "1,,12.500,true,Fjordkant,MARITIME,2011-03-05",
    ]


@pytest.mark.parametrize("partitions", ["2", "50"])
def test_bundle_files_depend_on_the_rows_alone(spark, tmp_path, monkeypatch, partitions):
    monkeypatch.setattr(csv, "FILE_BYTES", 2_000)
    table = spark.range(1000).selectExpr("id AS k", "'some text' AS v")
    spec = {"name": "x", "root": {"name": "A", "table": "t", "keyColumn": "k", "fields": [{"name": "v"}],
            "children": [{"name": "B", "table": "t", "keyColumn": "k", "parentKeyColumn": "k", "fields": [{"name": "v"}]}]}}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        ExportRun(spark, spec, {"t": table}).write(str(tmp_path), "csv")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = [p for p in (tmp_path / "A.csv").iterdir() if p.name.startswith("part-")]
    assert len(files) == 7  # 13 bytes a row


def test_parquet(spark, tmp_path):
    assert station_run(spark).write(str(tmp_path / "p"), "parquet") == COUNTS
    back = spark.read.parquet(str(tmp_path / "p")).orderBy("Title").collect()
    assert back == station_run(spark).nested().collect()


def test_row_counts_and_children_of_filtered_parents(spark):
    run = station_run(spark, {"zones": "maritime"})
    assert {r.entity: r.rows for r in run.row_counts().collect()} == {"Station": 1, "Sensor": 2, "Reading": 3, "Visit": 0}
    assert sorted(r.Kind for r in run.level("sensor").collect()) == ["rain", "wind"]


def test_filters_of_child_levels(spark):
    def rows(filters):
        return {r.entity: r.rows for r in station_run(spark, filters).row_counts().collect()}

    assert rows({"kinds": ["rain", "snow"]}) == COUNTS | {"Sensor": 1, "Reading": 2}
    assert rows({"unsigned": None, "heights": ["0", "900"]}) == {"Station": 2, "Sensor": 2, "Reading": 3, "Visit": 1}


def test_bundle_reader_types_and_errors(spark, tmp_path):
    station_run(spark).write(str(tmp_path), "csv")
    wrong = [dict(f, type="Int32") if f["name"] == "Kind" else f for f in SENSOR["fields"]]
    root = STATIONS["root"] | {"children": [SENSOR | {"fields": wrong}]}
    spec = Export.from_dict(STATIONS | {"root": root})
    lenient = read_bundle(spark, str(tmp_path), spec, strict=False)
    assert [r.Kind for r in lenient["Sensor"].collect()] == [None] * 3
    with pytest.raises(Exception, match="Kind"):
        read_bundle(spark, str(tmp_path), spec)["Sensor"].collect()


def test_long_decimals_survive_a_bundle(spark, tmp_path):
    values = [Decimal("1.123456789012345678"), Decimal("-98765432109876543210.000000000000000001"), None]
    table = spark.createDataFrame(list(enumerate(values)), "k int, v decimal(38,18)")
    part = {"table": "t", "keyColumn": "k", "fields": [{"name": "v", "type": "Decimal"}]}
    spec = {"name": "x", "root": part | {"name": "A", "children": [part | {"name": "B", "parentKeyColumn": "k"}]}}
    run = ExportRun(spark, spec, {"t": table})
    run.write(str(tmp_path), "csv")
    back = read_bundle(spark, str(tmp_path), run.export)
    assert [r.v for r in back["A"].orderBy("RowNumber").collect()] == values
    narrow = read_bundle(spark, str(tmp_path), run.export, decimals={("B", "v"): (38, 10)})
    assert narrow["A"].where("v is not null").count() == 2
    with pytest.raises(Exception, match="entity 'B', field 'v'"):
        narrow["B"].collect()


def test_text_survives_a_bundle(spark, tmp_path):
    """Every awkward text comes back, but for the empty one, which is null in a CSV."""
    texts = ["a,b", 'q"q', '"', "l1\nl2", "r1\r\nr2", "r\ronly", "\\", '\\"', " pad ", "#x", "_key",
             "=1", "é\U0001f30a", "", None, ",", "\n", "\r\n", '""']
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    spec = {
        "name": "x",
        "root": {
            "name": "A", "table": "a", "keyColumn": "k", "fields": [{"name": "t"}],
            "children": [
                {"name": "B", "table": "a", "keyColumn": "k", "parentKeyColumn": "k",
                 "fields": [{"name": "t"}, {"name": "k", "type": "Int32"}]},
            ],
        },
    }
    run = ExportRun(spark, spec, {"a": df})
    run.write(str(tmp_path), "csv")
    back = read_bundle(spark, str(tmp_path), run.export)
    got = [r.t for r in back["B"].orderBy("RowNumber").collect()]
    assert got == [t or None for t in texts]
    assert rebuild(run.export, back).where("size(B) = 1").count() == len(texts)
    document = run.document("json")[0]
    assert document.where(F.col("text").contains("\n")).count() == 0


def test_duplicate_keys_fail_trees_only(spark):
    tables = station_tables(spark)
    tables["visits"] = tables["visits"].replace(2, 1, "visit_no")
    lookups = {"climates": climates(spark)}
    run = ExportRun(spark, STATIONS, tables, lookups=lookups)
    for action in (run.nested, run.json_rows, run.numbered, lambda: run.document("xml")):
        with pytest.raises(DuplicateKeys, match="Visit"):
            action()
    assert key_violations(tables["visits"], ["visit_no"]).collect()[0].rows == 2
    # Rows whose parent did not survive cannot clash.
    kept = ExportRun(spark, STATIONS, tables, {"zones": "MARITIME"}, lookups)
    assert len(kept.nested().collect()) == 1
    unchecked = ExportRun(spark, STATIONS, tables, lookups=lookups, check_keys=False)
    with pytest.raises(DuplicateKeys, match="Visit"):
        unchecked.document("json")
    root = ExportRun(spark, flat(keyColumn="climate"), tables, lookups=lookups)
    assert root.rows(numbered=True).count() == 3


def test_subtree_limit(spark):
    run = station_run(spark)
    rows = {r["key:0"]: r.rows for r in subtree_rows(run.export, run._pruned).collect()}
    assert rows == {4: 6, 6: 3, 9: 4}
    with pytest.raises(SubtreeTooLarge):
        run.nested(max_subtree_rows=5)
    assert run.nested(max_subtree_rows=6).count() == 3


def test_staged_tables_go_on_request(spark, tmp_path):
    def staged():
        root = Path(staging_root(spark).removeprefix("file:"))
        return set((root / "bough").glob("*")) if (root / "bough").exists() else set()

    before = staged()
    with staged_here(spark):
        station_run(spark).write(str(tmp_path / "c"), "csv")
        assert staged() > before
    assert staged() == before


@pytest.mark.parametrize("size", [None, 1 << 18, 1 << 22])
def test_dense_numbers_with_ties_and_nulls(spark, size):
    rows = [(None, "n")] + [(1, f"t{i % 3}") for i in range(500)] + [(i, "x") for i in range(2, 300)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, t string").repartition(16)
    got = dense_number(df, ["k"], size=size).orderBy("RowNumber").collect()
    assert [r.RowNumber for r in got] == list(range(1, len(rows) + 1))
    keys = [r.k for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))


def test_numbers_spread_a_hot_parent(spark, monkeypatch):
    """One parent with most of the rows: numbering leaves no task with most of the rows."""
    parents = spark.range(50).select(F.col("id").alias("k"), F.lit("p").alias("f"))
    hot = F.when(F.rand(7) < 0.6, F.lit(3)).otherwise((F.col("id") % 50))
    children = spark.range(20000).select(F.col("id").alias("k"), hot.alias("p"), F.lit("c").alias("f"))
    spec = {
        "name": "x",
        "root": {
            "name": "A", "table": "a", "keyColumn": "k", "fields": [{"name": "f"}],
            "children": [{"name": "B", "table": "b", "keyColumn": "k", "parentKeyColumn": "p",
                          "fields": [{"name": "id", "column": "k"}]}],
        },
    }
    monkeypatch.setattr(csv, "FILE_BYTES", 20_000)
    run = ExportRun(spark, spec, {"a": parents, "b": children.persist()})
    level = run.numbered_level("B")
    sizes = [r[0] for r in level.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 20000 and max(sizes) < 20000 / 4
    pairs = level.orderBy("RowNumber").select("ParentRowNumber", "id", "RowNumber").collect()
    assert pairs == sorted(pairs) and [r.RowNumber for r in pairs] == list(range(1, 20001))


def expected_tree(parents, children, grandchildren):
    """The nested answer by hand, in plain Python."""
    def kids(rows, key):
        return sorted((r for r in rows if r["p"] is not None and r["p"] == key), key=lambda r: r["k"])

    tree = []
    for a in sorted(parents, key=lambda r: r["k"]):
        node = {"v": a["v"]}
        for b in kids(children, a["k"]):
            inner = {"v": b["v"]}
            for c in kids(grandchildren, b["k"]):
                inner.setdefault("C", []).append({"v": c["v"]})
            node.setdefault("B", []).append(inner)
        for d in kids(grandchildren, a["k"]):
            node.setdefault("D", []).append({"v": d["v"]})
        tree.append(node)
    return tree


@pytest.mark.parametrize("seed", range(2))
def test_outputs_agree_with_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)

    def level(n, up):
        keys = rng.sample(range(1000), n)
        # A third of the rows share one parent; some have none or one that does not exist.
        owner = lambda: rng.choice([up[0]] * 3 + up + [None, -1]) if up else None
        return [{"k": k, "p": owner(), "v": rng.choice(["x", "é\n", None, '"<&']) } for k in keys]

    a = level(6, [])
    b = level(25, [r["k"] for r in a])
    c = level(60, [r["k"] for r in b] + [r["k"] for r in a])
    schema = "k long, p long, v string"
    tables = {n: spark.createDataFrame(rows, schema) for n, rows in zip("abc", (a, b, c))}

    def entity(name, table, *children):
        return Entity(name, table, "k", (Field("v"),), None if name == "A" else "p", children)

    export = Export("x", entity("A", "a", entity("B", "b", entity("C", "c")), entity("D", "c")))
    run = ExportRun(spark, export, tables)
    want = expected_tree(a, b, c)

    run.write(str(tmp_path / "j"), "json")
    assert json.loads(file_text(tmp_path / "j")) == want
    assert [json.loads(r.json) for r in run.json_rows().collect()] == want

    def of_row(row):
        values = row.asDict()
        kids = {n: [of_row(k) for k in v] for n, v in values.items() if n != "v" and v}
        return {"v": row.v} | kids

    assert [of_row(r) for r in run.nested().collect()] == want
    assert [of_row(r) for r in rebuild(export, run.numbered()).collect()] == want

    def of_element(e):
        field = e.find("v")
        value = None if field.attrib else (field.text or "")
        found = {"v": value}
        for child in e:
            if child.tag != "v":
                found.setdefault(child.tag, []).append(of_element(child))
        return found

    run.write(str(tmp_path / "x"), "xml")
    assert [of_element(e) for e in ET.fromstring(file_text(tmp_path / "x"))] == want
    rows = run.xml_rows().collect()
    assert [of_element(ET.fromstring(r.xml)) for r in rows] == want

    run.write(str(tmp_path / "c"), "csv")
    back = rebuild(export, read_bundle(spark, str(tmp_path / "c"), export))
    assert [of_row(r) for r in back.collect()] == want
    counts = {r.entity: r.rows for r in run.row_counts().collect()}
    assert counts["B"] == sum(len(n.get("B", [])) for n in want)
