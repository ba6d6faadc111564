import json

import pytest
from pyspark.sql import functions as F

from arbitra.operators import inputs as I


def _js(spark, values, name="js"):
    return spark.createDataFrame([(i, None if v is None else v) for i, v in enumerate(values)], f"id int, {name} string")


def test_extract_text(spark):
    values = ['"hi"', '{"b": "x", "a": "y", "n": 3, "z": null}', "[1,2]", "null", "true", "{}", "oops"]
    rows = I.with_text(_js(spark, values), "js").orderBy("id").collect()
    assert [r["text"] for r in rows][:-1] == ["hi", "y x", "[1,2]", "null", "true", ""]
    assert rows[-1]["error"] and all(r["error"] is None for r in rows[:-1])


@pytest.mark.parametrize(
    "state,want",
    [
        ({"title": "Crash on startup", "priority": 1, "open": True}, "open: true\npriority: 1\ntitle: Crash on startup"),
        ({"a": None, "b": {"x": 1}, "c": [1, 2]}, 'b: {"x":1}\nc: [1,2]'),
        ({}, ""), ("nope", ""), (None, ""),
    ],
)
def test_render_state(spark, state, want):
    assert I.with_state(_js(spark, [json.dumps(state)]), "js").first()["state_text"] == want


@pytest.mark.parametrize(
    "inp,state,want,bad",
    [
        ('"hello"', None, "hello", False),
        (None, None, "", False),
        ('"stacktrace here"', '{"title": "Crash on start", "repo": "k8s"}', "repo: k8s\ntitle: Crash on start\nstacktrace here", False),
        (None, '{"a": "b"}', "a: b", False),
        ('"x"', "{}", "x", False),
        ('"x"', "null", "x", False),
        ('"x"', '"nope"', None, True),
        ('"x"', "not json", None, True),
    ],
)
def test_compose_input(spark, inp, state, want, bad):
    df = spark.createDataFrame([(inp, state)], "inp string, st string")
    row = I.compose_input(df, "inp", "st").first()
    assert row["composed"] == want and (row["error"] is not None) == bad


def test_fields_round_trip(spark):
    df = spark.createDataFrame([("a@b.c", "Sub: x", None)], "f string, s string, b string")
    t = I.serialize_fields(df, [("from", "f"), ("subject", "s"), ("body", "b")]).select("text")
    assert t.first()[0] == "from: a@b.c subject: Sub: x body: "
    row = I.parse_fields(t, "text", ["from", "subject", "body"]).first()
    assert (row["from"], row["subject"], row["body"]) == ("a@b.c", "Sub: x", "")
    other = I.parse_fields(t.withColumn("text", F.lit("plain")), "text", ["from", "body"], {"from": "none"}).first()
    assert (other["from"], other["body"]) == ("none", None)


def test_validate_examples(spark):
    df = spark.createDataFrame([(1, '"a"', '"x"'), (2, None, '"x"'), (3, '{"k":"v"}', "3"), (4, "7", '"y"')], "id int, input string, label string")
    good, bad = I.validate_examples(df)
    assert sorted((r["id"], r["input"], r["label"]) for r in good.collect()) == [(1, "a", "x"), (4, "7", "y")]
    assert {r["id"]: r["error"] for r in bad.collect()} == {2: 'missing field "input"', 3: '"label" must be a string'}
    with pytest.raises(ValueError, match="empty"):
        I.validate_examples(df.filter("id > 9"))


def test_validate_policies(spark):
    rows = [(0.9, 0.6, 0.9, None), (1.2, 0.6, 0.9, None), (0.9, 0.9, 0.6, None), (0.8, 0.6, 0.9, None), (0.9, 0.6, 0.9, float("inf")), (None, 0.6, 0.9, None)]
    df = spark.createDataFrame(rows, "act_above double, review_low double, review_high double, abstain_energy_above double")
    errors = [r["error"] for r in I.validate_policies(df).collect()]
    assert errors[0] is None and all(errors[1:])


def test_fact_words(spark):
    df = spark.createDataFrame([(-3, 2, 16), (0, 6, 15), (4, 7, 51)], "a int, d int, s int")
    specs = [("ax", "a", "signed"), ("up", "d", "distance"), ("room", "s", "space")]
    assert [r["facts"] for r in I.tokenize_facts(df, specs).collect()] == ["ax_n3 up_C room_R", "ax_zero up_M room_T", "ax_p4 up_F room_O"]
    with pytest.raises(ValueError):
        I.tokenize_facts(df, [("two words", "a", "plain")])
