from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import entities, parse
from palimpsest.functions import text as tx
from palimpsest.functions.stem import stem


@pytest.mark.parametrize(("word", "want"), [("instruments", "instrument"), ("painted", "paint"), ("painting", "paint"), ("caresses", "caress"), ("ties", "tie"), ("hopping", "hop"), ("relational", "relat"), ("skies", "sky"), ("generously", "generous")])
def test_stems(word, want):
    assert stem(word) == want


@given(st.text("abcdefghijklmnopqrstuvwxyz'", max_size=20))
def test_stems_are_no_longer(word):
    assert len(stem(word)) <= len(word) + 1


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_expressions(spark):
    x = one(spark, tx.temporal_expressions(F.col("t")), t="We met yesterday, Yesterday and on March 5, 2024 in the morning")
    assert x == ["yesterday", "March 5, 2024", "morning"]
    assert one(spark, tx.temporal_expressions(F.col("t")), t="before and after") == ["before", "after"]
    assert one(spark, tx.temporal_expressions(F.col("t")), t="") == []


def test_intent(spark):
    assert one(spark, tx.intent(F.col("t")), t="Why did it fail?").intent == "causal"
    assert one(spark, tx.intent(F.col("t")), t="What happened yesterday after the last week?").intent == "temporal"
    got = one(spark, tx.intent(F.col("t")), t="What does Alice like?")
    assert (got.intent, got.entity_focus) == ("entity", "Alice")
    assert one(spark, tx.intent(F.col("t")), t="colour of the sky").intent == "factual"


def test_third_person(spark):
    assert one(spark, tx.third_person(F.col("t"), F.col("s")), t="I'm glad, I have my dog", s="A$b") == "A$b is glad, A$b has A$b's dog"


def test_dialog_and_dates(spark):
    assert tuple(one(spark, tx.dialog_parts(F.col("t")), t="D7:x:5")) == ("D7:x", 5)
    assert one(spark, tx.dialog_parts(F.col("t")), t="nothing") is None
    assert str(one(spark, tx.iso_date(F.col("t")), t="2024-2-3")) == "2024-02-03"
    assert one(spark, tx.iso_date(F.col("t")), t="2024-02-31") is None
    assert one(spark, tx.iso_date(F.col("t")), t="1969-01-01") is None


def test_phrases():
    assert entities.phrases("The Golden Gate is near Alice. Bob's here") == ["Alice", "Bob's", "Golden Gate"]
    assert entities.phrases(None) == []


def test_repair():
    assert parse.repair_json('<think>{</think> so: {{"a": d-1,}} end') == '{"a": 1}'
    assert parse.repair_json("none") is None


def test_triples(spark):
    x = one(spark, parse.triples(F.col("t")), t="PERSON: Ann > friend_of > PERSON: Bob\nbad line")
    assert [tuple(r) for r in x] == [("Ann", "friend", "Bob")]
    x = one(spark, parse.referenced_triples(F.col("t")), t="[1], PERSON: Ann\n[2], LOCATION: Rome\n[1] lives_in [2]\n[1] knows [9]")
    assert [tuple(r) for r in x] == [("Ann", "lives in", "Rome")]


def test_model_output(spark):
    assert tuple(one(spark, parse.slm_intent(F.col("t")), t='{"intent": "other"}')) == ("factual", 0.5)
    x = one(spark, parse.parsed_slm(F.col("t")), t='{"entities": [{"name": "Ann"}, {"name": null}], "importance": 7}')
    assert (x.importance, [e.name for e in x.entities], x.entities[0].role) == (1.0, ["Ann"], "subject")
    assert one(spark, parse.parsed_slm(F.col("t")), t="no json") is None


def test_whole_words_with_signs(spark):
    x = one(spark, F.struct(tx.whole_word(F.col("t"), F.lit("c++")).alias("a"), tx.whole_word(F.col("t"), F.lit("c.p")).alias("b")), t="uses C++, cxp")
    assert tuple(x) == (True, False)
