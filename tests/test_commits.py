"""The commit log, the stored registry, the log of hard cases and the rebuild job."""

import threading

import pytest
from pyspark.sql import functions as F

from arbitra.operators import rebuild as B
from arbitra.operators.decide import Policy, Question
from arbitra.operators.registry import StoredRegistry
from arbitra.sources import logs as L
from arbitra.sources.commits import CommitLog, Conflict


def _open(spark, ok=True):
    return spark.createDataFrame([("suite", ok)], "suite string, pass boolean")


def test_commits_are_numbered_and_read_back(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    assert log.head() == 0 and log.records() == [] and log.table("a int").count() == 0
    assert [log.append({"a": i}) for i in range(3)] == [1, 2, 3]
    (tmp_path / "log" / "000000000004.json").write_text('{"record": {"a": 9')  # a writer that died
    assert log.append({"a": 3}) == 5
    assert [(n, r["record"]["a"]) for n, r in log.records()] == [(1, 0), (2, 1), (3, 2), (5, 3)]
    got = log.table("a int").orderBy("number").collect()
    assert [(r["number"], r["a"]) for r in got] == [(1, 0), (2, 1), (3, 2), (5, 3)]
    with pytest.raises(Conflict):
        log.append({"a": 7}, after=2)


def test_one_of_many_writers_wins_each_number(spark, tmp_path):
    path = f"{tmp_path}/log"
    won, lost = [], []

    def write(i):
        try:
            won.append(CommitLog(spark, path).append({"a": i}, after=0))
        except Conflict:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert won == [1] and len(lost) == 7 and len(CommitLog(spark, path).records()) == 1


def test_notes_are_taken_once(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/log")
    assert log.done("a") is None and log.once("a", {"x": 1}) and not log.once("a", {"x": 2})
    assert log.done("a") == {"key": "a", "x": 1}
    cut = next((tmp_path / "log").glob("done-*.json"))
    cut.write_text("{")  # the note was cut short: the next one counts
    assert log.done("a") is None and log.once("a", {"x": 3}) and log.done("a")["x"] == 3
    assert log.once("b") and [n["key"] for n in log.notes()] == ["a", "b"]


def test_registry_outlives_the_session(spark, tmp_path):
    store = StoredRegistry(spark, f"{tmp_path}/r")
    store.define(Question("q", Policy(0.95, 0.5, 0.6), input_schema='{"a": 1}'))
    store.define(Question("q", Policy(0.9, 0.5, 0.6, abstain_energy_above=1.5)))
    store.define(Question("other"))
    assert not store.promote("q", 1, _open(spark, False))
    assert store.promote("q", 1, _open(spark)) and store.promote("q", 2, _open(spark)) and store.promote("other", 7, _open(spark))
    assert store.rollback("q") == 1
    with pytest.raises(ValueError, match="no earlier"):
        store.rollback("q")
    again = StoredRegistry(spark.newSession(), f"{tmp_path}/r")
    assert {tuple(r) for r in again.current().collect()} == {("q", 1), ("other", 7)}
    rows = {r["name"]: r for r in again.questions().collect()}
    assert rows["q"]["policy"]["act_above"] == 0.9 and rows["q"]["policy"]["abstain_energy_above"] == 1.5 and set(rows) == {"q", "other"}
    assert again.pointers().count() == 4


def test_two_promotions_from_one_state_do_not_both_win(spark, tmp_path):
    one, two = (StoredRegistry(spark, f"{tmp_path}/r") for _ in range(2))
    one.promote("q", 1, _open(spark))
    at = one.log.head()
    assert one.promote("q", 2, _open(spark), after=at)
    with pytest.raises(Conflict):
        two.promote("q", 3, _open(spark), after=at)
    assert [tuple(r) for r in two.current().collect()] == [("q", 2)]


def test_a_batch_logged_twice_appears_once(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/hard"
    rows = [(1, "a", "b", "act"), (2, "a", "a", "act"), (3, "a", "a", "abstain")]
    d = spark.createDataFrame(rows, "id int, label string, truth string, action string")
    assert L.read_log(spark, path) is None
    with monkeypatch.context() as m:  # the first attempt writes its rows and dies before the note
        m.setattr(CommitLog, "once", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            L.log_hard_cases(d, path, run_id="monday")
    assert L.read_log(spark, path) is None
    assert L.log_hard_cases(d, path, run_id="monday") and not L.log_hard_cases(d, path, run_id="monday")
    assert L.log_hard_cases(d.where("id = 3"), path, run_id="tuesday")
    got = L.read_log(spark, path).select("id", "reason").collect()
    assert sorted(map(tuple, got)) == [(1, "miss"), (3, "abstain"), (3, "abstain")]


def _source(spark, n, start=0):
    rows = [(i, f"{w} {w}{i % 7} common word{i}", w) for i in range(start, start + n) for w in [("spam", "ham")[i % 2]]]
    return spark.createDataFrame(rows, "id int, text string, label string")


def test_rebuild_resumes_after_the_last_complete_stage(spark, tmp_path, monkeypatch):
    sources = {"a": _source(spark, 60), "b": _source(spark, 40, 100)}
    suite = {"probe": _source(spark, 20, 500)}
    framing = {"quoted": lambda d: d.where("label = 'spam'").withColumn("text", F.concat(F.lit("quote "), "text"))}
    call = lambda rules: B.rebuild(spark, str(tmp_path), "q", sources, suite, rules, augment=framing, n_max=1)
    good, bad = {"probe": {"min_rate": 0.9}}, {"probe": {"min_rate": 2.0}}

    def lost(*a, **k):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(B, "calibrate", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            call(good)
    first = B.StageLog(spark, f"{tmp_path}/rebuild/q").log.notes()
    assert [n["key"].split(":")[0] for n in first] == ["augment", "train", "union"]
    with monkeypatch.context() as m:
        m.setattr(StoredRegistry, "promote", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            call(good)
    out, stages = call(good)
    assert stages.made == ["promote", "manifest"]
    row = out.first()
    assert (row["question"], row["train"], row["val"], row["version"], row["promoted"]) == ("q", 80 + 40, 20, 1, True) and row["T"] > 0
    again, stages = call(good)
    assert stages.made == [] and again.first() == row
    store = StoredRegistry(spark, f"{tmp_path}/registry")
    assert [tuple(r) for r in store.current().collect()] == [("q", 1)] and store.pointers().count() == 1
    refused, stages = call(bad)
    assert stages.made == ["gate", "promote", "manifest"] and not refused.first()["promoted"] and store.pointers().count() == 1
    sources["b"] = _source(spark, 44, 100)
    more, stages = call(good)
    assert stages.made[0] == "union" and more.first()["version"] == 3
    assert [tuple(r) for r in store.current().collect()] == [("q", 3)]


def test_fingerprints_tell_contents_apart(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, text string")
    same = spark.createDataFrame([(None, 2), ("a", 1), (None, 2)], "text string, id int").repartition(3)
    assert B.fingerprint(d) == B.fingerprint(same) != B.fingerprint(d.distinct())
    assert B.fingerprint(d) != B.fingerprint(d.withColumn("text", F.coalesce("text", F.lit(""))))
