import pytest

from arbitra.operators import augment as A
from arbitra.operators import registry as G
from arbitra.operators.decide import Policy, Question, apply_policy
from arbitra.operators.inputs import parse_fields
from arbitra.operators.model import LinearModel, model_meta


def _models(spark):
    terms = spark.createDataFrame([("ab", 1.0, [1.0, -1.0])], "term string, idf double, coef array<double>")
    return [
        LinearModel("good", "tfidf", ("a", "b"), (0.0, 0.0), terms, 1, 0.3, ece_before=0.04, ece_after=0.01),
        LinearModel("raw", "tfidf", ("a", "b"), (0.0, 0.0), terms, 1, 1.0),
        LinearModel("worse", "tfidf", ("a", "b"), (0.0, 0.0), terms, 1, 0.5, ece_before=0.01, ece_after=0.02),
        LinearModel("loose", "tfidf", ("a", "b"), (0.0, 0.0), terms, 1, 0.5, ece_before=0.3, ece_after=0.13),
    ]


def test_define_replaces_by_name(spark):
    good = _models(spark)[0]
    first = G.registry(spark, [Question("b"), Question("a", Policy(0.8, 0.5, 0.8))])
    now = G.define(first, G.registry(spark, [Question("a", Policy(0.7, 0.5, 0.7), good)], seq=2))
    assert [r["name"] for r in G.list_questions(now).collect()] == ["a", "b"]
    row = now.filter("name = 'a'").first()
    assert row["policy"]["act_above"] == 0.7 and row["model_id"] == "good"
    m = {r["name"]: r for r in G.metrics(now, model_meta(spark, _models(spark))).collect()}
    assert m["a"]["trained"] and m["a"]["classes"] == ["a", "b"] and m["a"]["temperature"] == 0.3
    assert not m["b"]["trained"] and m["b"]["classes"] == [] and m["b"]["temperature"] == 1.0
    assert G.check_registry(now).count() == 0


def test_policy_column(spark):
    df = spark.createDataFrame([(0.95, -1.0), (0.95, -2.0)], "confidence double, energy double")
    df = df.withColumn("policy", G.policy_column(Policy(0.9, 0.6, 0.9, -1.5)))
    assert [r["action"] for r in apply_policy(df, "policy").collect()] == ["abstain", "act"]


def _results(spark, correct, total, skipped=0, suite="probe"):
    rows = [(suite, "x", "x")] * correct + [(suite, "y", "x")] * (total - correct - skipped) + [(suite, None, "x")] * skipped
    return spark.createDataFrame(rows, "suite string, label string, expect string")


@pytest.mark.parametrize("correct,skipped,want", [(16, 0, True), (15, 0, False), (15, 1, False)])
def test_gate_by_count(spark, correct, skipped, want):
    gate = G.eval_gate(_results(spark, correct, 16, skipped), {"probe": {"min_correct": 16}})
    assert gate.first()["pass"] == want and G.gate_open(gate).first()["promote"] == want


def test_gate_by_rate_and_missing_suite(spark):
    res = _results(spark, 148, 150, suite="test")
    assert G.gate_open(G.eval_gate(res, {"test": {"min_rate": 0.985}})).first()["promote"]
    gate = G.gate_open(G.eval_gate(res)).first()
    assert not gate["promote"] and gate["failed"] == ["aug_val", "probe"]


def test_calibration_gate(spark):
    got = {r["model_id"]: r["pass"] for r in G.calibration_gate(model_meta(spark, _models(spark))).collect()}
    assert got == {"good": True, "raw": False, "worse": False, "loose": False}


def test_promotion_moves_a_pointer(spark):
    log = spark.createDataFrame([], G.POINTER_SCHEMA)
    open_, shut = (G.eval_gate(_results(spark, k, 16), {"probe": {"min_correct": 16}}) for k in (16, 3))
    log, a = G.promote(log, "q", 1, open_)
    log, b = G.promote(log, "q", 2, open_)
    log, c = G.promote(log, "q", 3, shut)
    assert (a, b, c) == (True, True, False)
    assert G.current_version(log).first()["version"] == 2
    assert G.next_version(log, "q") == 3 and G.next_version(log, "new") == 1
    back = G.rollback(log, "q")
    assert G.current_version(back).first()["version"] == 1 and back.count() == 3
    with pytest.raises(ValueError):
        G.rollback(log, "none")
    log, _ = G.promote(log, "q", 3, open_)
    seen = []
    for _ in range(2):
        log = G.rollback(log, "q")
        seen.append(G.current_version(log).first()["version"])
    assert seen == [2, 1]
    with pytest.raises(ValueError):
        G.rollback(log, "q")


def test_manifest(spark):
    ex = spark.createDataFrame([("good", "train"), ("good", "validation"), ("new", "train")], "question string, split string")
    rows = {r["question"]: (r["train"], r["val"], r["T"]) for r in G.manifest(ex, model_meta(spark, _models(spark))).collect()}
    assert rows == {"good": (1, 1, 0.3), "new": (1, 0, None)}


MAIL = "from: x@y.z sender: Bob subject: Hi link_text: go link_url: http://a.b body: "


def _mails(spark, n=30):
    rows = [(i, MAIL + f"pay now {i}. " + "z" * 600, "phishing") for i in range(n)]
    rows += [(n, MAIL + "The shop Is Open today. is required", "legitimate"), (n + 1, "plain words", "legitimate")]
    rows += [(n + 2, MAIL + "arrives Friday", "legitimate")]
    return spark.createDataFrame(rows, "id int, input string, label string")


def _fields(df):
    return {r["id"]: r for r in parse_fields(df, "input", A.EMAIL_TAGS).collect()}


def test_advisory_rows(spark):
    rows = _fields(A.aug_advisory(_mails(spark), "id", "input", cap=12, chars=A.QUOTE_CHARS))
    assert len(rows) == 12 and {r["label"] for r in rows.values()} == {"legitimate"}
    assert sorted(r["from"] for r in rows.values()) == sorted(a for _, a in A.ADVISORY_SENDERS for _ in range(2))
    frames = dict(A.ADVISORY_FRAMES)
    for i, r in rows.items():
        frame = frames[r["subject"]]
        assert r["body"].startswith(frame + f"pay now {i}. ") and len(r["body"]) == len(frame) + 400
    whole = _fields(A.aug_advisory(_mails(spark), "id", "input"))
    assert len(whole) == 30 and all(r["body"].endswith("z" * 600) for r in whole.values())


def test_negation_rows(spark):
    rows = _fields(A.aug_negation(_mails(spark), "id", "input"))
    assert len(rows) == 30 and {r["label"] for r in rows.values()} == {"phishing"}
    for i, r in rows.items():
        used = [f for f in A.NEGATION_FILLERS if f in r["body"]]
        assert len(used) == 2 and f"pay now {i}." in r["body"]
        assert (r["from"], r["sender"], r["subject"], r["link_url"], r["link_text"]) == ("x@y.z", "Bob", "Hi", "http://a.b", "")


def test_cancel_rows(spark):
    rows = _fields(A.aug_cancel(_mails(spark), "id", "input"))
    assert rows[30]["body"] == "The shop is closed until further notice today. is required"
    assert rows[30]["subject"] == "Update: Hi"
    assert rows[31]["body"] == "Update: plain words This is now cancelled and will not happen."
    assert (rows[31]["subject"], rows[31]["from"]) == ("Update: notice", "a@b.c")
    assert rows[32]["body"] == "will not arrive Friday"
    short = _fields(A.aug_cancel(_mails(spark), "id", "input", chars=5, whole=20))
    assert short[31]["body"] == "Update: plain This i"
    assert {r["label"] for r in rows.values()} == {"legitimate"}


def test_all_framings_together(spark):
    counts = {r["kind"]: r["count"] for r in A.augment(_mails(spark), "id", "input", cap=5).groupBy("kind").count().collect()}
    assert counts == {"advisory": 5, "negation": 5, "cancel": 3}


def test_augmentation_is_reproducible(spark):
    a, b = (sorted(map(tuple, A.augment(_mails(spark).repartition(n), "id", "input").select("id", "kind", "input").collect())) for n in (1, 6))
    assert a == b
