"""Rules a description must follow."""

import copy

import pytest

from bough import Entity, Export, Field, Filter, SpecError
from bough.spec import valid_name
from fixtures import STATIONS


def changed(edit):
    document = copy.deepcopy(STATIONS)
    edit(document)
    return Export.from_dict(document)


def only_problem(edit):
    problems = changed(edit).problems()
    assert len(problems) == 1, problems
    return problems[0]


def test_sample_is_valid():
    export = Export.from_dict(STATIONS).check()
    assert {e.name for e in export.entities()} == {"Station", "Sensor", "Reading", "Visit"}
    assert export.entity("VISIT").field("wHO").source == "who"
    assert export.parent(export.entity("Visit")) is export.root
    assert export.parent(export.entity("Reading")) is export.entity("Sensor")


def test_document_members_and_choices_ignore_case():
    fields = [{"name": "f", "type": "int32"}]
    document = {"NAME": "x", "Root": {"Name": "A", "TABLE": "t", "keycolumn": "k", "fields": fields}}
    export = Export.from_dict(document).check()
    assert export.root.fields[0].type == "Int32"


def test_missing_root():
    with pytest.raises(SpecError):
        Export.from_dict({"name": "x"})


@pytest.mark.parametrize("name", ["", " ", "1a", "a b", "a:b", "a/b", "-a", ".a"])
def test_bad_names(name):
    assert "export" in only_problem(lambda d: d.update(name=name))
    assert not valid_name(name)


@pytest.mark.parametrize("name", ["a", "_a", "a-b.c_1", "år", "名"])
def test_good_names(name):
    assert changed(lambda d: d.update(name=name)).problems() == []


@pytest.mark.parametrize(
    "edit, word",
    [
        (lambda d: d["root"].update(table=""), "table"),
        (lambda d: d["root"].update(table="a\x07"), "table"),
        (lambda d: d["root"].update(table="t" * 129), "table"),
        (lambda d: d["root"].update(schema="s\n"), "schema"),
        (lambda d: d["root"].update(keyColumn=None), "key column"),
        (lambda d: d["root"].update(keyColumn="k" * 129), "key column"),
        (lambda d: d["root"]["children"][0].update(parentKeyColumn=None), "parent key"),
        (lambda d: d["root"]["children"][0].update(parentKeyColumn="\x00"), "parent key"),
        (lambda d: d["root"]["children"][0]["children"][0].update(fields=[]), "no fields"),
        (lambda d: d["root"]["children"][0]["children"][0].update(name="station"), "twice"),
        (lambda d: d["root"]["children"][0]["fields"].append({"name": "KIND"}), "twice"),
        (lambda d: d["root"]["fields"].append({"name": "rownumber"}), "reserved"),
        (lambda d: d["root"]["fields"].append({"name": "RealKey"}), "reserved"),
        (lambda d: d["root"]["fields"].append({"name": "visit"}), "child entity"),
        (lambda d: d["root"]["fields"].append({"name": ""}), "no name"),
        (lambda d: d["root"]["fields"].append({"name": "a b"}), "XML name"),
        (lambda d: d["root"]["fields"].append({"name": "x", "type": "Float"}), "unknown type"),
        (lambda d: d["root"]["fields"].append({"name": "x", "column": ""}), "required"),
        (lambda d: d["filters"].append({"name": ""}), "no name"),
        (lambda d: d["filters"].append({"name": "f", "entity": "No", "field": "x"}), "unknown entity"),
        (lambda d: d["filters"].append({"name": "f", "entity": "Station", "field": "x"}), "no field"),
        (lambda d: d["filters"].append(dict(d["filters"][0])), "twice"),
        (lambda d: d["filters"][0].update(operator="Like"), "unknown operator"),
        (lambda d: d["filters"][0].update(valueType="Money"), "unknown value type"),
    ],
)
def test_problems(edit, word):
    assert word in only_problem(edit)


@pytest.mark.parametrize("kind", ["String", "Boolean", "Guid"])
def test_between_needs_an_ordered_type(kind):
    assert "Between" in only_problem(
        lambda d: d["filters"][0].update(operator="Between", valueType=kind)
    )


def test_every_problem_is_reported():
    def edit(d):
        d["name"] = ""
        d["root"]["table"] = ""
        d["root"]["children"][0]["children"][0]["fields"] = []

    with pytest.raises(SpecError) as error:
        changed(edit).check()
    assert len(error.value.problems) == 3


def test_entity_limit():
    kids = tuple(Entity(f"E{i}", "t", "k", (Field("f"),), "p") for i in range(100))
    export = Export("x", Entity("R", "t", "k", (Field("f"),), children=kids))
    assert ["101 entities" in p for p in export.problems()] == [True]


def test_key_lengths_must_agree():
    child = Entity("C", "t", "k", (Field("f"),), ("a", "b"))
    export = Export("x", Entity("R", "t", "k", (Field("f"),), children=(child,)))
    assert "length" in export.problems()[0]


def test_dataclasses_and_documents_agree():
    built = Export(
        "e",
        Entity("R", "t", "k", (Field("f", "c", "Int32", "l"),)),
        (Filter("x", "R", "f", "In", "Int32", "l", True),),
    )
    document = {
        "name": "e",
        "root": {
            "name": "R",
            "table": "t",
            "keyColumn": "k",
            "fields": [{"name": "f", "column": "c", "type": "Int32", "lookup": "l"}],
        },
        "filters": [
            {
                "name": "x",
                "entity": "R",
                "field": "f",
                "operator": "in",
                "valueType": "int32",
                "requestLookup": "l",
                "required": True,
            }
        ],
    }
    assert Export.from_dict(document) == built
