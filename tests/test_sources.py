import json

import pytest
from pyspark.sql import functions as F

from arbitra.operators.inputs import serialize_fields
from arbitra.operators.model import LinearModel
from arbitra.sources import examples as S
from arbitra.sources import logs as L
from arbitra.sources import models as M


def test_examples(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"input": "a\\nb", "label": "x"}\n{"input": "c", "label": "y", "more": 1}\n')
    assert sorted(map(tuple, S.read_examples(spark, str(p)).collect())) == [("a\nb", "x"), ("c", "y")]


@pytest.mark.parametrize("line", ['{"input": "a"}', '{"input": "a", "label": 3}', '{"input": null, "label": "x"}', '{"input": ["a"], "label": "x"}', "oops"])
def test_a_bad_example_is_fatal(spark, tmp_path, line):
    p = tmp_path / "x.jsonl"
    p.write_text('{"input": "a", "label": "x"}\n' + line + "\n")
    with pytest.raises(Exception):  # noqa: B017
        S.read_examples(spark, str(p)).collect()


def test_corpus(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps([{"question": "a", "source": "s"}, {"question": "b\nc", "source": "t"}], indent=1))
    rows = S.read_corpus(spark, str(p), "question", "source string").collect()
    assert sorted(map(tuple, rows)) == [("a", "s"), ("b\nc", "t")]
    with pytest.raises(Exception, match="without"):
        S.read_corpus(spark, str(p), "prompt").collect()


def _csv(path, rows):
    import csv

    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["id", "email_content", "phish_label"])
        w.writerows(rows)


def test_emails(spark, tmp_path):
    mail = {k: f'{k} "q", x\ny' for k in S.EMAIL_FIELDS}
    _csv(tmp_path / "e.csv", [("1", json.dumps(mail), 1), ("2", json.dumps(mail), 0)])
    df = S.read_emails(spark, str(tmp_path / "e.csv"), 2)
    rows = {r["id"]: r for r in df.collect()}
    assert (rows["1"]["label"], rows["2"]["label"]) == ("phishing", "legitimate")
    assert rows["1"]["email"].asDict() == mail
    text = serialize_fields(df, S.email_text(), "t").first()["t"]
    assert text.startswith("from: from ") and " link_text: link_display_text " in text
    with pytest.raises(ValueError, match="expected 3 rows"):
        S.read_emails(spark, str(tmp_path / "e.csv"), 3)


def test_email_without_a_field_is_fatal(spark, tmp_path):
    _csv(tmp_path / "e.csv", [("1", json.dumps({"from": "a"}), 1)])
    with pytest.raises(Exception, match="without"):
        S.read_emails(spark, str(tmp_path / "e.csv")).collect()


def _model(spark):
    terms = spark.createDataFrame([("ab", 2.0, [1.0, -1.0]), ("cd", 1.5, [0.5, 0.25])], "term string, idf double, coef array<double>")
    return LinearModel("m", "tfidf", ("a", "b"), (0.1, 0.2), terms, 2, 0.7, ece_before=0.2, ece_after=0.1, ece_split="validation")


def test_model_round_trip(spark, tmp_path):
    path = str(tmp_path / "m")
    M.save_model(_model(spark), path)
    back = M.load_model(spark, path)
    assert back.meta() == _model(spark).meta()
    assert sorted(map(tuple, back.terms.collect())) == sorted(map(tuple, _model(spark).terms.collect()))


def test_versions_are_kept_apart(spark, tmp_path):
    root, m = str(tmp_path), _model(spark)
    M.save_version(m, root, "q", 1)
    M.save_version(m.with_(temperature=0.9), root, "q", 2)
    assert M.load_version(spark, root, "q", 1).temperature == 0.7
    assert M.load_version(spark, root, "q", 2).temperature == 0.9
    with pytest.raises(Exception, match="(?i)exists"):
        M.save_version(m, root, "q", 2)


def test_artifact_round_trip(spark, tmp_path):
    path = str(tmp_path / "a")
    M.export_artifact(_model(spark), path)
    back = M.import_artifact(spark, path)
    assert (back.classes, back.intercept, back.temperature, back.n_terms) == (("a", "b"), (0.1, 0.2), 0.7, 2)
    assert (back.ece_before, back.ece_after) == (0.2, 0.1)


def test_artifacts_of_many_files_are_one_object(spark, tmp_path, monkeypatch):
    """The whole vocab used to be one row: no task may hold more than an entry, however the terms are written."""
    monkeypatch.setattr(M, "ENTRIES_PER_FILE", 3)
    odd = ["ab", "\u00e9 \u4e2d", 'quo"te', "back\\slash", "line\nbreak", "]} ,", "}}", '"vocab":{', ""]
    rows = [(t, 1.0 + i, [float(-i), 1e-7 * i if i else float("inf")]) for i, t in enumerate(odd)]
    terms = spark.createDataFrame(rows, "term string, idf double, coef array<double>").repartition(4)
    model = LinearModel("m", "tfidf", ("a", "b"), (0.1, 0.2), terms, len(rows), temperature=0.7)
    path = tmp_path / "a"
    M.export_artifact(model, str(path))
    files = sorted(f for f in path.iterdir() if f.name.startswith("part-"))
    assert len(files) >= 3 and max(len(f.read_text().splitlines()) for f in files) < len(rows)
    whole = "".join(f.read_text() for f in files)
    assert {t: [float(x) for x in w] for t, w in json.loads(whole)["vocab"].items()} == {t: [idf, *coef] for t, idf, coef in rows}
    lines = M._artifact_lines(spark, str(path))
    assert lines.count() == len(rows) + 2
    back = M.import_artifact(spark, str(path))
    assert sorted(map(tuple, back.terms.collect())) == sorted(rows) and back.classes == ("a", "b") and back.ece_before is None
    one = tmp_path / "one.json"
    one.write_text(whole)
    assert sorted(map(tuple, M.import_artifact(spark, str(one)).terms.collect())) == sorted(rows)
    one.write_text(json.dumps(json.loads(whole), indent=1))
    assert sorted(map(tuple, M.import_artifact(spark, str(one)).terms.collect())) == sorted(rows)
    one.write_text(whole[: whole.rindex("}}")])
    with pytest.raises(ValueError, match="does not end"):
        M.import_artifact(spark, str(one))
    for bad in (None, "ab"):
        twice = terms.unionAll(spark.createDataFrame([(bad, 1.0, [0.0, 0.0])], terms.schema))
        with pytest.raises(ValueError):
            M.export_artifact(model.with_(terms=twice), str(tmp_path / "bad"))
    empty = model.with_(terms=terms.limit(0), n_terms=0)
    M.export_artifact(empty, str(tmp_path / "empty"))
    assert M.import_artifact(spark, str(tmp_path / "empty")).n_terms == 0


GOOD = {"model_id": "m", "classes": ["a", "b"], "temperature": 1.0, "intercept": [0.0, 0.0], "vocab": {"ab": [2.0, 1.0, -1.0]}}


@pytest.mark.parametrize(
    "change",
    [{"classes": []}, {"intercept": [0.0]}, {"temperature": 0.0}, {"temperature": -1.0}, {"temperature": None}, {"vocab": {"ab": [2.0, 1.0]}}],
)
def test_malformed_artifacts_are_refused(spark, tmp_path, change):
    p = tmp_path / "a.json"
    p.write_text(json.dumps(GOOD))
    assert M.import_artifact(spark, str(p)).classes == ("a", "b")
    p.write_text(json.dumps({**GOOD, **change}))
    with pytest.raises(ValueError):
        M.import_artifact(spark, str(p))


def test_hard_cases_and_reports(spark, tmp_path):
    rows = [(1, "a", "a", "act"), (2, "a", "b", "act"), (3, "a", "a", "abstain"), (4, "a", None, "escalate"), (5, "a", None, "review")]
    df = spark.createDataFrame(rows, "id int, label string, truth string, action string")
    path = str(tmp_path / "log")
    for _ in range(2):
        L.log_hard_cases(df, path)
    back = spark.read.parquet(path)
    assert {r["id"]: r["reason"] for r in back.collect()} == {2: "miss", 3: "abstain", 4: "escalate"} and back.count() == 6
    L.write_report(df.agg(F.count("*").alias("n")), str(tmp_path / "report"), "run")
    r = spark.read.json(str(tmp_path / "report")).first()
    assert r["name"] == "run" and r["metrics"]["n"] == 5 and r["timestamp_unix"] > 0


def test_splits_are_written_apart(spark, tmp_path):
    df = spark.createDataFrame([("train", "a", "x"), ("val", "b", "y")], "split string, input string, label string")
    S.write_splits(df, str(tmp_path / "s"))
    assert [tuple(r) for r in S.read_split(spark, str(tmp_path / "s"), "val").collect()] == [("b", "y")]
