"""A small network of weather stations: three levels, one of them with two children and one with
a key of two columns."""

import datetime as dt
from decimal import Decimal


def _part(name, table, key, parent, fields, children=()):
    return {
        "name": name,
        "table": table,
        "keyColumn": key,
        "parentKeyColumn": parent,
        "fields": fields,
        "children": list(children),
    }


READING = _part("Reading", "readings", "reading_no", ["rack", "slot"], [{"name": "Value", "column": "value", "type": "Decimal"}])
SENSOR = _part(
    "Sensor", "sensors", ["rack", "slot"], "station",
    [{"name": "Kind", "column": "kind"}, {"name": "Slot", "column": "slot", "type": "Int32"}], [READING],
)
VISIT = _part("Visit", "visits", "visit_no", "station", [{"name": "Who", "column": "who"}])
STATIONS = {
    "name": "network",
    "version": "3",
    "root": _part(
        "Station", "stations", "station_no", None,
        [
            {"name": "Height", "column": "height", "type": "Decimal"},
            {"name": "Manned", "column": "manned", "type": "Boolean"},
            {"name": "Title", "column": "title"},
            {"name": "Climate", "column": "climate", "lookup": "climates"},
            {"name": "Opened", "column": "opened", "type": "Date"},
        ],
        [SENSOR, VISIT],
    ),
    "filters": [
        {"name": "kinds", "entity": "Sensor", "field": "Kind", "operator": "In"},
        {"name": "heights", "entity": "Station", "field": "Height", "operator": "Between", "valueType": "Decimal"},
        {"name": "unsigned", "entity": "Visit", "field": "Who", "operator": "IsNull"},
        {"name": "opened", "entity": "Station", "field": "Opened", "operator": "Between", "valueType": "Date"},
        {"name": "zones", "entity": "Station", "field": "Climate", "operator": "In", "requestLookup": "climates"},
    ],
}


def station_tables(spark):
    """Two sensors and a reading belong to nobody; one station has no sensor, one no visit."""
    return {
        "stations": spark.createDataFrame(
            [
                (9, "Salzpfanne", dt.datetime(2011, 3, 6), None, Decimal("-3.125"), False),
                (4, "Fjordkant", dt.datetime(2011, 3, 5), 7, Decimal("12.500"), True),
                (6, "Hochmoor", dt.datetime(2014, 9, 21), 8, Decimal("845.250"), None),
            ],
            "station_no long, title string, opened timestamp_ntz, climate int, height decimal(18,3), manned boolean",
        ),
        "sensors": spark.createDataFrame(
            [("b", 1, 4, "rain"), ("a", 2, 4, "wind"), ("a", 1, 9, None), ("z", 1, 77, "lost"), ("z", 2, None, "lost")],
            "rack string, slot int, station long, kind string",
        ),
        "readings": spark.createDataFrame(
            [
                (31, "b", 1, Decimal("0.40")),
                (12, "a", 2, Decimal("7.10")),
                (30, "b", 1, None),
                (40, "q", 9, Decimal("5.00")),
                (41, "a", 1, Decimal("1.60")),
            ],
            "reading_no long, rack string, slot int, value decimal(10,2)",
        ),
        "visits": spark.createDataFrame([(2, 6, "Ada"), (1, 6, None), (3, 9, "Bo")], "visit_no long, station long, who string"),
    }


def climates(spark):
    return spark.createDataFrame([(5, "ARID"), (7, "MARITIME"), (8, "ALPINE")], "id int, code string")


def file_text(folder):
    """Part files in name order, as one text."""
    from pathlib import Path

    parts = sorted(p for p in Path(folder).iterdir() if p.name.startswith("part-"))
    return b"".join(p.read_bytes() for p in parts).decode("utf-8")
