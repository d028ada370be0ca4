"""Fingerprints of texts on the two sides of a scale's limit."""

import random

import pytest

from bough.llm.syncmers import edit_trial, likeness, sketch, text_likeness


def letters(n, seed=1):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


@pytest.mark.parametrize("limit", [16, 64])
def test_texts_on_both_sides_of_a_limit_are_alike(limit):
    text = letters(limit)
    assert likeness(sketch(text), sketch(text[:-1])) == 0
    assert text_likeness(text, text[:-1]) == text_likeness(text[:-1], text) > 0.6
    assert text_likeness(text, letters(limit - 1, 2)) < 0.3
    assert text_likeness(text, "") == 0 and text_likeness("", "") == 1


def test_an_edit_that_crosses_the_limit(spark):
    text = letters(85)
    docs = spark.createDataFrame([(1, text), (2, text[:63]), (3, letters(17, 3))], "doc_id long, text string")
    got = {r.doc_id: r for r in edit_trial(docs.where("doc_id <> 2")).collect()}
    assert got[1].near_edited > 0.3
    assert {r.doc_id: r for r in edit_trial(docs).collect()}[1].near_next > 0.5
