import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import arbitra.session
from arbitra.operators import decide as D
from arbitra.operators.model import LinearModel
from arbitra.operators.score import score, score_each, score_hashed, score_models, score_tfidf
from tests.test_text import _fnv

VOCAB = {"ab": (2.0, [2.0, -2.0]), "cd": (2.0, [-2.0, 2.0]), "ab cd": (1.5, [0.5, 0.25]), "the": (1.01, [0.1, -0.1])}


def _model(spark, vocab=VOCAB, classes=("a", "b"), intercept=(0.0, 0.0), name="m", **kw):
    rows = [(t, idf, coef) for t, (idf, coef) in vocab.items()]
    terms = spark.createDataFrame(rows, "term string, idf double, coef array<double>")
    return LinearModel(name, "tfidf", classes, intercept, terms, len(rows), **kw)


def _docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def _logits(text, vocab, intercept):
    toks = [t for t in text.lower().split() if len(t) > 1]
    counts = Counter(g for g in toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])] if g in vocab)
    x = {g: (1 + math.log(n)) * vocab[g][0] for g, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
    return [b + sum(v / norm * vocab[g][1][c] for g, v in x.items()) for c, b in enumerate(intercept)]


TEXTS = ["ab ab ab", "ab cd", "zzz qqq", "", "the ab the cd cd ab", "the " * 50, "cd the"]


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_tfidf_logits_by_hand(spark, monkeypatch, limit):
    # limit 0 forces the shuffle join with its lookup of frequent terms.
    monkeypatch.setattr(arbitra.session, "BROADCAST_BYTES", limit)
    got = score_tfidf(_docs(spark, TEXTS), _model(spark, intercept=(0.3, -0.7)), "id", "text").collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r["logits"] == pytest.approx(_logits(TEXTS[r["id"]], VOCAB, (0.3, -0.7)), abs=1e-12)


@pytest.mark.parametrize("terms", [0, 1, 2, 3])
def test_frequent_terms_inside_rows_and_the_others_by_hash(spark, monkeypatch, terms):
    """Rows that repeat an id stay apart, and rows without an id stay."""
    import arbitra.operators.score as module

    monkeypatch.setattr(module, "HEAD_BYTES", terms * (24 + 8 * 2))
    texts = [*TEXTS, None]
    ids = [None if i == 4 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, texts, strict=True)), "id int, text string, what string")
    want = sorted((str(i), str(t), *(round(v, 9) for v in _logits(t or "", VOCAB, (0.3, -0.7)))) for i, t in zip(ids, texts, strict=True))
    model = _model(spark, intercept=(0.3, -0.7))
    got = score(docs, model, "id", "text", ["what"]).collect()
    assert sorted((str(r["id"]), str(r["what"]), *(round(v, 9) for v in r["logits"])) for r in got) == want
    shared = [model, model.with_(model_id="same", intercept=(0.0, 1.0)), _model(spark, {"zzz": (2.0, [1.0, 5.0])}, name="other")]
    each = score_each(docs, shared, "id", "text", ["what"]).where(f"model_id = '{model.model_id}'")
    assert sorted((str(r["id"]), str(r["what"]), *(round(v, 9) for v in r["logits"])) for r in each.collect()) == want
    assert score_each(docs, shared, "id", "text", ["what"]).count() == 3 * len(texts)


def test_a_batch_is_looked_up_in_bounded_steps(spark, monkeypatch):
    import arbitra.operators.score as module

    whole = sorted(map(str, score(_docs(spark, TEXTS), _model(spark), "id", "text").collect()))
    monkeypatch.setattr(module, "STEP_KEYS", 3)
    assert sorted(map(str, score(_docs(spark, TEXTS).coalesce(1), _model(spark), "id", "text").collect())) == whole


def test_shuffle_join_spreads_frequent_terms(spark, monkeypatch):
    from arbitra.operators.features import join_terms, term_rows

    monkeypatch.setattr(arbitra.session, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        terms = _model(spark).terms
        rows = term_rows(_docs(spark, TEXTS), "text", ["id"])
        joined = join_terms(rows, terms, 4, 100, ["term"], "id", "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        key = next(line for line in plan.splitlines() if "SortMergeJoin" in line)
        assert "SortMergeJoin [_term" in key
        assert joined.filter("term = 'the' and idf is null").count() == 0 and joined.count() == rows.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("limit", [1 << 30, 16384 * 140, 0])
def test_hashed_models_in_groups(spark, monkeypatch, limit):
    import arbitra.operators.score as module

    monkeypatch.setattr(arbitra.session, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(module, "BROADCAST_BYTES", limit)
    models = []
    for i, w in enumerate(([1.0, -1.0], [2.0, 3.0], [0.5, 0.25])):
        terms = spark.createDataFrame([(_fnv("crash"), w)], "bucket int, coef array<double>")
        models.append(LinearModel(f"h{i}", "hashed", ("x", "y"), (0.0, 0.0), terms, 1))
    docs = _docs(spark, ["crash crash", ""]).withColumn("model_id", F.explode(F.array(*[F.lit(f"h{i}") for i in range(3)])))
    got = {(r["model_id"], r["id"]): r["logits"] for r in score_models(docs, models, "id", "text").collect()}
    assert len(got) == 6
    assert got[("h0", 0)] == [2.0, -2.0] and got[("h1", 0)] == [4.0, 6.0] and got[("h2", 0)] == [1.0, 0.5]
    assert all(got[(f"h{i}", 1)] == [0.0, 0.0] for i in range(3))


def test_one_term_normalises_to_one(spark):
    z = score_tfidf(_docs(spark, ["ab ab ab"]), _model(spark, {"ab": (2.0, [1.0, -1.0])}), "id", "text").first()["logits"]
    assert z == pytest.approx([1.0, -1.0])


def test_unknown_text_gets_the_intercepts(spark):
    got = score_tfidf(_docs(spark, ["", "zzz qqq", None]), _model(spark, intercept=(0.3, -0.7)), "id", "text").collect()
    assert [r["logits"] for r in got] == [[0.3, -0.7]] * 3


def test_hashed_logits(spark):
    weights = {"crash": [1.0, -1.0], "add": [-0.5, 0.5]}
    rows = [(_fnv(t), w) for t, w in weights.items()]
    terms = spark.createDataFrame(rows, "bucket int, coef array<double>")
    m = LinearModel("h", "hashed", ("bug", "feature"), (0.1, 0.2), terms, len(rows))
    got = {r["id"]: r["logits"] for r in score_hashed(_docs(spark, ["Crash crash add", "zzz", ""]), m, "id", "text").collect()}
    assert got[0] == pytest.approx([0.1 + 2 - 0.5, 0.2 - 2 + 0.5])
    assert got[1] == pytest.approx([0.1, 0.2]) and got[2] == pytest.approx([0.1, 0.2])


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_many_models_equal_each_alone(spark, monkeypatch, limit):
    monkeypatch.setattr(arbitra.session, "BROADCAST_BYTES", limit)
    a = _model(spark, name="a", intercept=(0.5, 0.0))
    three = {"ab": (1.0, [1.0, 2.0, 3.0]), "zz": (3.0, [0.0, 1.0, 0.0])}
    b = _model(spark, three, ("x", "y", "z"), (0.0, 0.1, 0.2), "b")
    docs = _docs(spark, TEXTS)
    alone = {("a", r["id"]): r["logits"] for r in score(docs, a, "id", "text").collect()}
    alone |= {("b", r["id"]): r["logits"] for r in score(docs, b, "id", "text").collect()}
    tagged = docs.withColumn("model_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    for got in (score_models(tagged, [a, b], "id", "text"), score_each(docs, [a, b], "id", "text")):
        rows = {(r["model_id"], r["id"]): r["logits"] for r in got.collect()}
        assert rows.keys() == alone.keys()
        for k, z in rows.items():
            assert z == pytest.approx(alone[k], abs=1e-12)


def test_same_scores_for_any_partitioning(spark):
    docs = _docs(spark, TEXTS * 20)
    m = _model(spark)
    a, b = ({r["id"]: tuple(round(v, 9) for v in r["logits"]) for r in score(docs.repartition(n), m, "id", "text").collect()} for n in (1, 8))
    assert a == b


@pytest.mark.parametrize("bad", [dict(classes=()), dict(intercept=(0.0,)), dict(temperature=0.0), dict(temperature=float("nan")), dict(temperature=float("inf"))])
def test_malformed_models_are_refused(spark, bad):
    with pytest.raises(ValueError):
        _model(spark, **bad)


def test_ask_carries_energy_and_gates_on_it(spark):
    q = D.Question("q", D.Policy(0.9, 0.6, 0.9, abstain_energy_above=-1.0), _model(spark))
    rows = {r["id"]: r for r in D.ask(_docs(spark, ["ab ab", "zzz"]), q, "id", "text").collect()}
    assert rows[0]["label"] == "a" and rows[0]["action"] == "act"
    assert rows[1]["energy"] == pytest.approx(-math.log(2)) and rows[1]["action"] == "abstain"
    assert rows[1]["label"] == "b"  # the last of tied classes


def test_yes_no_policy(spark):
    p = D.Policy(0.85, 0.5, 0.85)
    row = {k: spark.range(1).select(*[c.alias(n) for n, c in D.yes_no(F.lit(k), None, p).items()]).first() for k in (0.92, 0.08, 0.5)}
    assert (row[0.92]["prediction"], row[0.92]["action"]) == ("yes", "act")
    assert (row[0.08]["prediction"], row[0.08]["action"]) == ("no", "act")
    assert (row[0.5]["prediction"], row[0.5]["confidence"], row[0.5]["action"]) == ("yes", 0.5, "review")
    default = spark.range(1).select(D.yes_no(F.lit(0.55), None, D.Policy())["action"]).first()[0]
    assert default == "escalate"
    gated = D.yes_no(F.lit(0.99), F.lit(-1.2), D.Policy(0.85, 0.5, 0.85, -1.5))["action"]
    assert spark.range(1).select(gated).first()[0] == "abstain"


ITEMS = [
    {"id": "triage"},
    {"kind": "noul", "id": "is_a", "statement": "it is a", "class": "a"},
    {"kind": "noul", "id": "is_b", "statement": "it is b", "class": "b"},
]


def test_batch_answers_in_order(spark):
    q = D.Question("q", D.Policy(0.85, 0.5, 0.85), _model(spark))
    rows = D.ask_batch(_docs(spark, ["ab ab"]), ITEMS, q, "id", "text").orderBy("pos").collect()
    assert [(r["item_id"], r["kind"]) for r in rows] == [("triage", "choice"), ("is_a", "noul"), ("is_b", "noul")]
    assert rows[0]["label"] == "a" and rows[1]["prediction"] == "yes" and rows[2]["prediction"] == "no"
    assert rows[1]["p_true"] + rows[2]["p_true"] == pytest.approx(1.0)


@pytest.mark.parametrize(
    "items",
    [
        [{"kind": "score", "id": "x"}], [{"kind": "noul", "id": "x", "statement": "s", "class": "nope"}], [{"kind": "choice"}],
        [], {}, "x", [{"kind": "noul", "id": "x", "statement": " ", "class": "a"}], [*ITEMS, {"id": ""}],
    ],
)
def test_one_bad_item_fails_the_batch(spark, items):
    q = D.Question("q", model=_model(spark))
    with pytest.raises(ValueError):
        D.ask_batch(_docs(spark, ["ab"]), items, q, "id", "text")
    with pytest.raises(ValueError, match="no trained model"):
        D.ask_batch(_docs(spark, ["ab"]), ITEMS, D.Question("q"), "id", "text")


def test_routing(spark):
    docs = spark.createDataFrame([(0, "ab", "one"), (1, "ab", "two"), (2, "ab", "who"), (3, "cd", "one"), (4, "x", None)], "id int, text string, question string")
    qs = [D.Question("one", model=_model(spark)), D.Question("two", D.Policy(0.0, 0.0, 0.0))]
    rows = {r["id"]: r for r in D.ask_routed(docs, qs, "id", "text").collect()}
    assert len(rows) == 5
    assert rows[0]["label"] == "a" and rows[3]["label"] == "b" and rows[0]["error"] is None
    assert (rows[1]["label"], rows[1]["confidence"], rows[1]["action"]) == ("", 0.0, "act")
    assert rows[2]["error"] == "unknown question: who" and rows[2]["action"] is None
    assert rows[4]["error"] is not None
    untrained = D.ask_routed(docs, [D.Question("one")], "id", "text")
    assert untrained.count() == 5


def test_hybrid_keeps_sure_answers(spark):
    fast, slow = D.Question("f", model=_model(spark)), D.Question("s", model=_model(spark, {"zzz": (1.0, [9.0, -9.0])}))
    rows = {r["id"]: r for r in D.ask_hybrid(_docs(spark, ["ab ab", "zzz"]), fast, slow, "id", "text").collect()}
    assert rows[0]["route"] == "fast" and rows[0]["slow_label"] is None
    assert rows[1]["route"] == "slow" and (rows[1]["fast_label"], rows[1]["slow_label"]) == ("b", "a")
    noted = D.ask_hybrid(_docs(spark, ["ab ab", "zzz"]), fast, D.Question("s"), "id", "text").collect()
    assert {r["note"] for r in noted} == {None, "no labels for fallback"}


def test_votes(spark):
    verdict = D.Question("v", model=_model(spark, classes=("legitimate", "phishing")))
    signal = _model(spark, classes=("true", "false"))
    signals = [D.Question(f"s{i}", model=signal) for i in range(3)]
    rows = {r["id"]: r for r in D.decompose(_docs(spark, ["ab ab", "cd cd"]), verdict, signals, "id", "text").collect()}
    assert rows[0]["verdict"] == "legitimate" and rows[0]["signals_fired"] == ["s0", "s1", "s2"] and not rows[0]["agree"]
    assert rows[1]["verdict"] == "phishing" and rows[1]["signals_fired"] == [] and not rows[1]["agree"]
    assert len(rows[0]["signals"]) == 3


def test_guard_reasons(spark):
    df = spark.createDataFrame(
        [(1, "A", "B", 5.0, 0.9, True), (2, "A", "B", 2.9, 0.9, True), (3, "A", "B", 5.0, 0.69, True), (4, "A", "B", 5.0, 0.9, False), (5, "A", "B", None, 0.9, True), (6, "B", "B", 3.0, 0.70, True)],
        "id int, label string, rule string, gap double, confidence double, ok boolean",
    )
    out = D.guard(df, "rule", "gap", F.col("ok"))
    assert {r["id"]: (r["reason"], r["final"]) for r in out.collect()} == {
        1: ("model", "A"), 2: ("near_tie", "B"), 3: ("low_confidence", "B"), 4: ("out_of_range", "B"), 5: ("near_tie", "B"), 6: ("model", "B"),
    }
    assert {r["reason"]: (r["n"], r["n_agree"]) for r in D.guard_report(out).collect()}["model"] == (2, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _hashed(spark, name="h", k=2):
    terms = spark.createDataFrame([(b, [math.sin(b + c) for c in range(k)]) for b in range(16384)], "bucket int, coef array<double>")
    return LinearModel(name, "hashed", tuple("abcdef"[:k]), tuple(0.1 * c for c in range(k)), terms, 16384)


def test_scoring_needs_no_shuffle(spark, tmp_path):
    _docs(spark, TEXTS).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    m, other, h = _model(spark), _model(spark, name="n"), _hashed(spark)
    question = D.Question("q", model=m)
    for df in (score_tfidf(d, m, "id", "text"), score_hashed(d, h, "id", "text"), score_each(d, [m, other], "id", "text"), D.ask(d, question, "id", "text")):
        assert "Exchange" not in _plan(df)
        assert df.count() in (len(TEXTS), 2 * len(TEXTS))


def test_models_of_both_kinds_and_widths_in_one_call(spark):
    models = [_model(spark), _model(spark, {"ab": (2.0, [1.0, 2.0, 3.0])}, tuple("xyz"), (0.0, 0.1, 0.2), "wide"), _hashed(spark), _hashed(spark, "h3", 3)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "id int, text string")
    tagged = docs.crossJoin(spark.createDataFrame([(m.model_id,) for m in models] + [("unknown",)], "model_id string"))
    got = {(r["id"], r["model_id"]): r["logits"] for r in score_models(tagged, models, "id", "text").collect()}
    assert len(got) == 4 * (len(TEXTS) + 1)
    for m in models:
        for r in score(docs, m, "id", "text").collect():
            assert got[r["id"], m.model_id] == pytest.approx(r["logits"], abs=1e-12) and len(r["logits"]) == len(m.classes)
    for i, t in enumerate(TEXTS):
        counts = Counter(_fnv(w) for w in t.split())
        want = [0.1 * c + sum(n * math.sin(b + c) for b, n in counts.items()) for c in range(3)]
        assert got[i, "h3"] == pytest.approx(want, abs=1e-9)
    assert got[len(TEXTS), "m"] == [0.0, 0.0]


def test_terms_of_one_hash_are_told_apart():
    import numpy as np

    from arbitra.operators.score import _logits

    table = (np.array([1, 5, 5, 5, 9]), np.array([0, 1, 2, 3, 0]), np.ones(5), np.arange(5.0)[:, None] + 1)
    keys = (np.array([5, 5, 5, 5, 9, 7]), np.array([1, 2, 3, 4, 0, 0]), np.ones(6))
    each = [_logits("tfidf", np.zeros(1), table, tuple(k[i : i + 1] for k in keys), np.array([0, 1]))[0, 0] for i in range(6)]
    assert each == [2.0, 3.0, 4.0, 0.0, 5.0, 0.0]


def test_a_model_without_terms_gives_its_intercepts(spark):
    m = _model(spark, {}, intercept=(0.5, -0.5))
    assert [r["logits"] for r in score(_docs(spark, ["ab", ""]), m, "id", "text").collect()] == [[0.5, -0.5]] * 2


def test_answers_over_the_logits_of_any_engine(spark):
    from arbitra.operators.model import LogitsTable

    docs = _docs(spark, ["ab", "cd", "ab cd"])
    table = spark.createDataFrame(
        [(i, q, [float(i), 1.0 - i, 0.5][:k]) for i in range(3) for q, k in (("two", 2), ("three", 3))], "id int, question string, logits array<double>"
    )
    two = LogitsTable("x", ("no", "yes"), table, "two", 2.0)
    three = LogitsTable("y", ("a", "b", "c"), table, "three", has_energy=False)
    got = {r["id"]: r for r in D.ask(docs, D.Question("q", model=two), "id", "text").collect()}
    assert [got[i]["label"] for i in range(3)] == ["yes", "no", "no"] and got[0]["energy"] is not None
    assert got[2]["confidence"] == pytest.approx(1 / (1 + math.exp(-1.5)))
    items = [{"id": "n", "statement": "s", "class": "c"}]
    yes = {r["id"]: r["p_true"] for r in D.noul(docs, items, D.Question("q", model=three), "id", "text").collect()}
    assert yes[0] == pytest.approx(math.exp(0.5) / (1 + math.e + math.exp(0.5)))
    mixed = [D.Question("t", model=_model(spark)), D.Question("h", model=_hashed(spark)), D.Question("two", model=two), D.Question("three", model=three), D.Question("none")]
    asked = docs.crossJoin(spark.createDataFrame([(q.name,) for q in mixed] + [("what",)], "question string"))
    routed = D.ask_routed(asked, mixed, "id", "text").collect()
    assert len(routed) == 18 and {r["label"] for r in routed if r["question"] == "three"} <= {"a", "b", "c"}
    assert all(r["error"] == "unknown question: what" for r in routed if r["question"] == "what")
    assert all((r["energy"] is None) == (r["question"] not in ("t", "two")) for r in routed)
    parts = D.decompose(docs, mixed[0], mixed[1:4], "id", "text", positive="a", fired="yes", need=1).collect()
    assert len(parts) == 3 and all(len(r["signals"]) == 3 for r in parts)
    hybrid = D.ask_hybrid(docs, D.Question("f", model=two), D.Question("s", model=three), "id", "text").collect()
    assert len(hybrid) == 3 and {r["route"] for r in hybrid} == {"slow"}


def test_thousands_of_questions_compile_in_seconds(spark):
    import time

    from arbitra.operators.model import LogitsTable

    n = 10_000
    table = spark.range(n).select((F.col("id") % 100).cast("int").alias("id"), F.col("id").cast("string").alias("question"), F.array(F.lit(0.0), F.lit(1.0)).alias("logits"))
    questions = [D.Question(str(i), model=LogitsTable(str(i), ("a", "b"), table, str(i))) for i in range(n)]
    asked = spark.range(n).select((F.col("id") % 100).cast("int").alias("id"), F.lit("t").alias("text"), F.col("id").cast("string").alias("question"))
    start = time.perf_counter()
    out = D.ask_routed(asked, questions, "id", "text")
    assert out.where("label = 'b'").count() == n
    assert time.perf_counter() - start < 60
