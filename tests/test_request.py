"""Filter values: binding, counting, typing and lookups."""

import datetime as dt

import pytest

from bough import CodeList, Export, ExportRun, FilterError, FunctionLookup, SetupError, UnknownCode
from bough.plans import request
from bough.plans.request import bind, output_format
from fixtures import STATIONS, climates, station_tables


def run(spark, filters, spec=STATIONS, **options):
    options.setdefault("lookups", {"climates": climates(spark)})
    return ExportRun(spark, spec, station_tables(spark), filters=filters, **options)


def numbers(spark, filters, **options):
    return [r.Title for r in run(spark, filters, **options).rows().collect()]


def with_filter(**members):
    base = {"name": "f", "entity": "Station", "field": "Title"}
    return STATIONS | {"filters": [base | members]}


def test_unknown_name_is_an_error():
    export = Export.from_dict(STATIONS)
    with pytest.raises(FilterError, match="titel"):
        bind(export, {"titel": "Hochmoor"})
    given = {"HEIGHTS": ["1", "2"], "Style": "x"}
    assert bind(export, given, ["style"]) == {"heights": ["1", "2"]}
    with pytest.raises(FilterError, match="twice"):
        bind(export, {"kinds": "rain", "KINDS": "wind"})


def test_optional_and_required(spark):
    assert numbers(spark, {}) == ["Fjordkant", "Hochmoor", "Salzpfanne"]
    with pytest.raises(FilterError, match="required"):
        run(spark, {}, with_filter(required=True))


@pytest.mark.parametrize(
    "members, values",
    [
        ({}, ["a", "b"]),
        ({}, []),
        ({"operator": "GreaterThanOrEqual"}, ["1", "2"]),
        ({"operator": "In"}, []),
        ({"operator": "Between", "field": "Opened", "valueType": "Date"}, ["2012-01-01"]),
    ],
)
def test_value_counts(spark, members, values):
    with pytest.raises(FilterError):
        run(spark, {"f": values}, with_filter(**members))


def test_in_takes_any_number_of_values(spark, monkeypatch):
    monkeypatch.setattr(request, "LISTED_VALUES", 3)
    spec = with_filter(operator="In", field="Height", valueType="Decimal")
    heights = [f"{n}.25" for n in range(840, 850)]
    assert numbers(spark, {"f": heights}, spec=spec) == ["Hochmoor"]
    with pytest.raises(FilterError, match="'tall'"):
        numbers(spark, {"f": [*heights, "tall"]}, spec=spec)
    # What no value of the column can equal is not an error, and does not round to one that can.
    assert numbers(spark, {"f": ["12.5000000001", "1", "2", "3"]}, spec=spec) == []
    with pytest.raises(FilterError, match="at least one"):
        run(spark, {"f": []}, spec)


@pytest.mark.parametrize(
    "members, values, found",
    [
        ({"field": "Title"}, ["Fjordkant", "Fjordkant", "fjordkant", None], ["Fjordkant"]),
        ({"field": "Opened", "valueType": "Date"}, ["2011-03-06", "2014-09-21"], ["Hochmoor", "Salzpfanne"]),
        ({"field": "Climate", "valueType": "Int64"}, ["8", "99999999999"], ["Hochmoor"]),
        ({"field": "Climate"}, ["7"], ["Fjordkant"]),
        ({"field": "Climate", "requestLookup": "climates"}, ["Maritime", "ALPINE"], ["Fjordkant", "Hochmoor"]),
    ],
)
def test_values_from_a_table(spark, members, values, found):
    table = spark.createDataFrame([(v,) for v in values], "given string")
    assert numbers(spark, {"f": table}, spec=with_filter(operator="In", **members)) == found
    with pytest.raises(FilterError):
        run(spark, {"f": table.limit(0)}, with_filter(operator="In", **members))
    with pytest.raises(FilterError):
        run(spark, {"f": table}, with_filter(**members))


def test_unknown_code_in_a_table(spark):
    table = spark.createDataFrame([("ARID",), ("LUNAR",)], "given string")
    spec = with_filter(operator="In", field="Climate", requestLookup="climates")
    with pytest.raises(FilterError, match="LUNAR"):
        run(spark, {"f": table}, spec)


@pytest.mark.parametrize("operator, found", [("IsNull", ["Salzpfanne"]), ("IsNotNull", ["Fjordkant", "Hochmoor"])])
def test_null_tests_ignore_values(spark, operator, found):
    spec = with_filter(operator=operator, field="Climate")
    assert numbers(spark, {"f": ["whatever"]}, spec=spec) == found
    assert numbers(spark, {"f": None}, spec=spec) == found


@pytest.mark.parametrize("value", ["soon", "2011-02-30", "5.3.2011"])
def test_bad_date(spark, value):
    with pytest.raises(FilterError, match="Date"):
        run(spark, {"opened": ["2011-01-01", value]})


def test_date_range_ends_at_midnight(spark):
    assert numbers(spark, {"opened": ["2011-03-06", "2014-12-31"]}) == ["Hochmoor", "Salzpfanne"]
    assert numbers(spark, {"opened": ["2011-01-01", "2011-03-05"]}) == ["Fjordkant"]


def test_text_value_on_a_number_column(spark):
    spec = with_filter(field="Climate")
    assert numbers(spark, {"f": "8"}, spec=spec) == ["Hochmoor"]
    with pytest.raises(FilterError):
        run(spark, {"f": "ALPINE"}, spec)


def test_fraction_never_matches_a_whole_number(spark):
    spec = with_filter(field="Climate", valueType="Decimal")
    assert numbers(spark, {"f": "8.00"}, spec=spec) == ["Hochmoor"]
    assert numbers(spark, {"f": "8.2"}, spec=spec) == []


@pytest.mark.parametrize(
    "values, found",
    [
        (["1.25e1", "9e2"], ["Fjordkant", "Hochmoor"]),
        (["-3.125", "12.499999999999999999999999999999999999"], ["Salzpfanne"]),
        (["0", "99999999999999999999999999999999999999"], ["Fjordkant", "Hochmoor"]),
        (["1e-38", "12.5"], ["Fjordkant"]),
    ],
)
def test_decimals_of_any_digits(spark, values, found):
    spec = with_filter(field="Height", valueType="Decimal", operator="Between")
    assert numbers(spark, {"f": values}, spec=spec) == found


@pytest.mark.parametrize("value", ["1e-45", "1e38", "9" * 39, "1e999999999999", "twelve", "", "0x1"])
def test_decimals_beyond_all_digits(spark, value):
    with pytest.raises(FilterError, match="Decimal"):
        run(spark, {"f": value}, with_filter(field="Height", valueType="Decimal"))


def test_lookup_ignores_case_and_names_the_unknown(spark):
    assert numbers(spark, {"zones": "alpine"}) == ["Hochmoor"]
    with pytest.raises(FilterError, match="LUNAR"):
        run(spark, {"zones": "LUNAR"})


def test_missing_lookups_are_setup_errors(spark):
    with pytest.raises(SetupError, match="climates"):
        run(spark, {}, lookups={})
    spec = with_filter(requestLookup="nowhere")
    with pytest.raises(SetupError, match="nowhere"):
        run(spark, {"f": "x"}, spec)
    one_way = {"climates": FunctionLookup(render=lambda ids: ids)}
    with pytest.raises(SetupError, match="climates"):
        run(spark, {"zones": "ARID"}, lookups=one_way)


def test_request_function(spark):
    def stored(value):
        if not value.startswith("zone "):
            raise UnknownCode(f"'{value}' is no zone")
        return value.removeprefix("zone ")

    both = {"CLIMATES": FunctionLookup(render=lambda ids: "zone " + ids, request=stored)}
    assert run(spark, {"zones": "zone 8"}, lookups=both).rows().first().Climate == "zone 8"
    with pytest.raises(FilterError, match="no zone"):
        run(spark, {"zones": "ALPINE"}, lookups=both)


def test_repeated_codes_take_the_greatest_id(spark):
    pairs = spark.createDataFrame([(9, "X"), (10, "x"), (10, "b"), (10, "a")], "id int, code string")
    codes = CodeList(pairs)
    assert codes.ids_of(["X"]) == {"X": "10"}
    assert {r.id: r.code for r in codes.by_id().collect()} == {"9": "X", "10": "x"}


def test_guid_and_collation(spark):
    tables = station_tables(spark)
    stored = "0C2b9f4e-77D1-4e0a-9b1F-3a5d8E6c2B10"
    tables["stations"] = tables["stations"].replace("Hochmoor", stored, "title")

    def found(spec, value):
        lookups = {"climates": climates(spark)}
        return ExportRun(spark, spec, tables, {"f": value}, lookups).rows().count()

    assert found(with_filter(valueType="Guid"), "(0c2b9f4e-77d1-4e0a-9b1f-3a5d8e6c2b10)") == 1
    assert found(with_filter(valueType="Guid", operator="In"), [stored.upper(), "0" * 32]) == 1
    with pytest.raises(FilterError):
        found(with_filter(valueType="Guid"), stored[:8])
    assert found(with_filter(), "fJORDKANT") == 0
    fields = [{"name": "Title", "column": "title", "collation": "UTF8_LCASE"}]
    spec = with_filter()
    spec = spec | {"root": spec["root"] | {"fields": fields}}
    assert found(spec, "fJORDKANT") == 1


TYPED = {
    "String": ("string", "b", "StringValue"), "Int32": ("int", "5", "5"), "Int64": ("bigint", "5", "5"),
    "Decimal": ("decimal(9,2)", "2.50", "2.50"), "Boolean": ("boolean", "true", "true"),
    "Date": ("date", "2020-02-03", "2020-02-03"), "DateTime": ("timestamp_ntz", "2020-02-03T04:05:06", "2020-02-03T04:05:06"),
    "Guid": ("string", "0c2b9f4e-77d1-4e0a-9b1f-3a5d8e6c2b10", "0c2b9f4e-77d1-4e0a-9b1f-3a5d8e6c2b10"),
}
PUSHED = {"Equals": "EqualTo", "In": "In", "GreaterThanOrEqual": "GreaterThanOrEqual", "LessThanOrEqual": "LessThanOrEqual",
          "Between": "GreaterThanOrEqual", "IsNull": "IsNull", "IsNotNull": "IsNotNull"}


@pytest.mark.parametrize("declared", TYPED)
def test_filters_reach_the_scan(spark, tmp_path, capsys, declared):
    """Every operator on the natural column of every type is in the scan's own filters."""
    kind, text, shown = TYPED[declared]
    spark.sql(f"SELECT 1 AS k, CAST('{text}' AS {kind}) AS v").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    root = {"name": "A", "table": "t", "keyColumn": "k", "fields": [{"name": "v"}]}
    ranged = declared not in ("String", "Boolean", "Guid")
    for operator, pushed in PUSHED.items():
        if pushed.endswith("OrEqual") and not ranged:
            continue
        values = {"Between": [text, text], "In": [text, text if declared == "Boolean" else text.replace("2", "1")]}
        flt = {"name": "f", "entity": "A", "field": "v", "operator": operator, "valueType": declared}
        given = [] if operator.startswith("Is") else values.get(operator, text)
        chosen = ExportRun(spark, {"name": "x", "root": root, "filters": [flt]}, {"t": table}, {"f": given})
        assert chosen.rows().count() == (0 if operator == "IsNull" else 1)
        capsys.readouterr()
        chosen.rows(ordered=False).explain("formatted")
        line = next(x for x in capsys.readouterr().out.splitlines() if "PushedFilters" in x)
        if declared == "Guid" and operator in ("Equals", "In"):
            pushed = "GreaterThanOrEqual"  # to all spellings, whatever their case
        elif operator == "In" and values["In"][0] == values["In"][1]:
            pushed = "EqualTo"
        assert f"{pushed}(v" in line, (operator, line)


def test_formats():
    assert output_format() == "json"
    assert output_format("CSV") == "csv"
    with pytest.raises(SetupError, match="json, csv, xml"):
        output_format("yaml")


def test_missing_table_or_column(spark):
    lookups = {"climates": climates(spark)}
    with pytest.raises(SetupError, match="stations"):
        ExportRun(spark, STATIONS, {}, lookups=lookups)
    tables = station_tables(spark)
    tables["stations"] = tables["stations"].drop("height")
    with pytest.raises(SetupError, match="height"):
        ExportRun(spark, STATIONS, tables, lookups=lookups)


def test_key_types_must_compare(spark):
    tables = station_tables(spark)
    tables["visits"] = tables["visits"].withColumn("station", tables["visits"].who)
    with pytest.raises(SetupError, match="parent key"):
        ExportRun(spark, STATIONS, tables, lookups={"climates": climates(spark)})


def test_date_typed_column(spark):
    tables = station_tables(spark)
    tables["stations"] = tables["stations"].withColumn("opened", tables["stations"].opened.cast("date"))
    lookups = {"climates": climates(spark)}
    found = ExportRun(spark, STATIONS, tables, {"opened": ["2011-03-01", "2011-03-05"]}, lookups)
    assert [r.Opened for r in found.rows().collect()] == [dt.date(2011, 3, 5)]
