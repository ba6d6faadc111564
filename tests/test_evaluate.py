import math
import random

import pytest
from pyspark.sql import functions as F

from arbitra.operators import evaluate as E
from arbitra.operators import rules as R


def _scored(spark, scores, labels):
    return spark.createDataFrame(list(zip(map(float, scores), labels, strict=True)), "score double, positive boolean")


@pytest.mark.parametrize("scores,want", [([0.1, 0.4, 0.35, 0.8], 0.75), ([0.1, 0.2, 0.8, 0.9], 1.0), ([0.5] * 4, 0.5)])
def test_auroc_by_hand(spark, scores, want):
    assert E.auroc(_scored(spark, scores, [False, False, True, True])).first()[0] == pytest.approx(want)


def test_auroc_needs_both_classes(spark):
    assert math.isnan(E.auroc(_scored(spark, [0.1, 0.2], [True, True])).first()[0])


def test_auroc_counts_pairs(spark):
    rng = random.Random(2)
    s = [rng.randrange(30) / 30 for _ in range(300)]
    y = [rng.random() < v for v in s]
    pos, neg = ([a for a, b in zip(s, y) if b is k] for k in (True, False))
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert E.auroc(_scored(spark, s, y)).first()[0] == pytest.approx(want)


def test_binary_metrics(spark):
    rows = [("p", "p")] * 5 + [("p", "n")] * 2 + [("n", "p")] + [("n", "n")] * 12
    m = E.binary_metrics(spark.createDataFrame(rows, "truth string, label string"), "p").first()
    assert (m["tp"], m["fn"], m["fp"], m["tn"]) == (5, 2, 1, 12)
    assert m["accuracy"] == 17 / 20 and m["precision"] == 5 / 6 and m["recall"] == 5 / 7 and m["f1"] == pytest.approx(10 / 13)
    none = E.binary_metrics(spark.createDataFrame([("n", "n")], "truth string, label string"), "p").first()
    assert none["recall"] is None and none["false_positive_rate"] == 0.0


def test_macro_f1(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")]
    f1 = {r["class"]: (r["support"], r["f1"]) for r in E.class_f1(spark.createDataFrame(rows, "truth string, label string")).collect()}
    assert f1["a"] == (2, pytest.approx(2 / 3)) and f1["b"] == (1, pytest.approx(0.5)) and f1["c"] == (1, 0.0)


def test_wilson(spark):
    r = E.wilson(spark.createDataFrame([(997, 1000)], "k int, n int"), "k", "n").first()
    assert r["low"] == pytest.approx(0.99122, abs=1e-4) and r["high"] == pytest.approx(0.99898, abs=1e-4)


def test_latency_summary(spark):
    df = spark.createDataFrame([(float(x), "q") for x in range(1, 101)], "ms double, question string")
    r = E.latency_summary(df, "ms", ["question"]).first()
    assert (r["n"], r["p50"], r["p99"], r["mean"]) == (100, 50.0, 99.0, 50.5) and r["throughput"] == pytest.approx(100 / 5050)


def test_engines_side_by_side(spark):
    truth = spark.createDataFrame([(1, "x", True), (2, "y", False), (3, "x", True)], "id int, expect string, flip boolean")
    answers = spark.createDataFrame([(1, "e", "x"), (2, "e", "x"), (3, "e", None)], "id int, engine string, label string")
    got = {r["flip"]: (r["n"], r["answered"], r["correct"], r["errors"]) for r in E.compare_engines(answers, truth).collect()}
    assert got == {None: (3, 2, 1, 1), True: (2, 1, 1, 1), False: (1, 1, 0, 0)}


def test_agreement(spark):
    a = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [0.0, 1.0])], "id int, label string, logits array<double>")
    b = spark.createDataFrame([(1, "x", [1.5, 0.0]), (2, "x", [0.1, 0.0])], "id int, label string, logits array<double>")
    r = E.agreement(a, b, "id").first()
    assert (r["n"], r["agree"], r["max_logit_diff"]) == (2, 0.5, 1.0)


def test_best_stump_matches_a_search(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        y = rng.random() < 0.4
        rows.append((i, round(rng.random(), 2), float(rng.randrange(4) + 2 * y), y))
    df = spark.createDataFrame(rows, "id int, f1 double, f2 double, y boolean")
    train, test = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    got = E.best_stump(train, test, ["f1", "f2"], F.col("y")).first()
    tr, te = ([r for r in rows if r[0] % 2 == k] for k in (0, 1))
    vals = sorted({r[2] for r in tr})
    cuts = sorted([0.5] + [(a + b) / 2 for a, b in zip(vals, vals[1:])])
    best = max(cuts, key=lambda t: sum((r[2] >= t) == r[3] for r in tr))
    assert got["feature"] == "f2" and got["threshold"] == best
    assert got["test_accuracy"] == pytest.approx(sum((r[2] >= best) == r[3] for r in te) / len(te))


def test_rule_flags(spark):
    cases = [
        ("Verify your account now", True, False), ("URGENT: final notice", False, True), ("please download", True, False),
        ("lunch at noon", False, False), ("Your account is LOCKED", True, True), ("nonurgent", False, False),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string")
    got = df.select("t", R.flag_lure("t"), R.flag_urgency("t")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {c[0]: c[1:] for c in cases}


def test_senders_and_links(spark):
    df = spark.createDataFrame(
        [("Bob@GMAIL.com", "http://User.GitHub.io:80/x"), ("no-at-sign", "not a url"), ("a@x@corp.com", "https://mail.corp.com/?q"), (None, None)],
        "s string, u string",
    )
    rows = df.select(R.flag_webmail("s"), R.link_host("u"), R.flag_hosting("u"), R.flag_mismatch("s", "u")).collect()
    assert [tuple(r) for r in rows] == [
        (True, "user.github.io", True, True), (False, "", False, False), (False, "mail.corp.com", False, False), (False, "", False, False),
    ]


def test_reply_matching_and_relabelling(spark):
    df = spark.createDataFrame([(1, "It is CODE, I think"), (2, "science or math"), (3, "?")], "id int, reply string")
    got = {r["id"]: r["l"] for r in df.select("id", R.match_label("reply", ["math", "code", "science"]).alias("l")).collect()}
    assert got == {1: "code", 2: "math", 3: None}
    base = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, label string")
    teacher = spark.createDataFrame([(1, "x"), (2, "x")], "id int, label string")
    out = R.relabel(base, teacher, "id")
    assert {r["id"]: r["label"] for r in out.collect()} == {1: "x", 2: "x", 3: "z"}
    assert tuple(R.agreement_rate(out).first()) == (2, 0.5)
