import random

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from arbitra.functions import prob as P
from arbitra.functions.text import N_BUCKETS
from arbitra.operators import rules as R
from arbitra.operators import train as T
from arbitra.operators.calibrate import calibrate
from arbitra.operators.decide import Policy, Question, ask, predict
from arbitra.operators.features import fit_vocab, hashed_vector, index_vocab, tfidf_vector
from arbitra.operators.optimise import _hidden_pass
from arbitra.operators.score import score


def _separable(spark):
    rows = []
    for i in range(20):
        rows += [
            (f"invoice billing payment refund charge invoice{i}", "billing"),
            (f"password login account reset access login{i}", "account"),
            (f"crash bug error stack trace fails bug{i}", "technical"),
        ]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, text string, label string")


@pytest.fixture(scope="module")
def tickets(spark):
    rng = random.Random(21)
    own = {c: [f"{c}word{i}" for i in range(24)] for c in ("billing", "technical", "account", "shipping")}
    every, filler = [w for ws in own.values() for w in ws], [f"filler{i}" for i in range(40)]

    def ticket(c):
        kind = lambda r: own[c] if r < 0.6 else every if r < 0.75 else filler
        return " ".join(rng.choice(kind(rng.random())) for _ in range(rng.randint(10, 24)))

    made = [(i, ticket(c), c) for i in range(1500) for c in [list(own)[i % 4]]]
    rows = spark.createDataFrame(made, "id int, text string, label string").persist()
    return rows.filter("id < 900"), rows.filter("id >= 900 and id < 1200"), rows.filter("id >= 1200")


def test_labels_are_sorted(spark):
    assert [tuple(r) for r in T.label_index(_separable(spark), "label").orderBy("idx").collect()] == [("account", 0), ("billing", 1), ("technical", 2)]


def test_training_refuses_bad_input(spark):
    df = _separable(spark)
    with pytest.raises(ValueError, match="no examples"):
        T.train_hashed(df.filter("false"), "text", "label")
    with pytest.raises(ValueError, match="2 distinct"):
        T.train_hashed(df.filter("label = 'billing'"), "text", "label")
    with pytest.raises(ValueError, match="null"):
        T.class_names(df.withColumn("label", F.when(F.col("id") > 1, F.col("label"))), "label")


def test_hashed_model_learns_separable_data(spark):
    df = _separable(spark)
    m = T.train_hashed(df, "text", "label")
    assert T.model_accuracy(m, df, "id", "text", "label") == 1.0
    assert m.ece_before is not None and m.ece_split == "train" and m.temperature == 1.0
    new = spark.createDataFrame([(1, "my invoice was charged twice, refund please")], "id int, text string")
    r = ask(new, Question("q", model=m), "id", "text").first()
    assert r["label"] == "billing" and r["confidence"] > 0.5 and r["energy"] is None
    p = score(df, m, "id", "text").select(P.softmax(F.col("logits")).alias("p"))
    assert p.filter(F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0


def test_ticket_accuracy_and_calibration(spark, tickets):
    train, val, test = tickets
    m = calibrate(T.train_hashed(train, "text", "label"), val, "id", "text", "label")
    assert T.model_accuracy(m, test, "id", "text", "label") > 0.97
    assert m.ece_split == "validation" and m.ece_after <= m.ece_before + 0.01 and m.temperature > 0


def test_tfidf_multiclass_and_reordering(spark, tickets):
    train, val, test = tickets
    m = T.train_tfidf(train, "id", "text", "label", c=8.0)
    acc = T.model_accuracy(m, test, "id", "text", "label")
    assert acc > 0.97
    other = T.reorder_classes(m, sorted(m.classes, reverse=True))
    assert T.model_accuracy(other, test, "id", "text", "label") == acc
    with pytest.raises(ValueError):
        T.reorder_classes(m, ["billing"])


def test_two_classes_are_mirrored(spark):
    df = _separable(spark).filter("label <> 'technical'")
    m = T.train_tfidf(df, "id", "text", "label")
    assert m.intercept[0] == -m.intercept[1]
    assert m.terms.filter(F.abs(F.get("coef", F.lit(0)) + F.get("coef", F.lit(1))) > 1e-12).count() == 0
    z = score(df, m, "id", "text").select("logits").collect()
    assert all(abs(r[0][0] + r[0][1]) < 1e-9 for r in z)


def test_binary_fit_is_the_penalised_optimum(spark):
    """Gradient of C * sum(loss) + |w|^2 / 2 vanishes at the exported weights."""
    df = _separable(spark).filter("label <> 'technical'")
    c = 2.0
    m = T.train_tfidf(df, "id", "text", "label", c=c)
    vocab = index_vocab(fit_vocab(df, "text")).persist()
    n = vocab.count()
    vec = tfidf_vector(df, "id", "text", vocab, n, ["label"]).collect()
    x = np.array([r["features"].toArray() for r in vec])
    y = np.array([1.0 if r["label"] == m.classes[1] else 0.0 for r in vec])
    at = {r["term"]: r["idx"] for r in vocab.collect()}
    w = np.zeros(n)
    for r in m.terms.collect():
        w[at[r["term"]]] = r["coef"][1]
    p = 1 / (1 + np.exp(-(x @ w + m.intercept[1])))
    assert np.allclose(np.linalg.norm(x, axis=1), 1.0)
    assert np.abs(c * x.T @ (p - y) + w).max() < 1e-4 and abs((p - y).sum()) < 1e-4


def test_sweep_and_curve(spark, tickets):
    train, val, _ = tickets
    rows = T.sweep(train, val, "id", "text", "label", ngrams=(1, 2), cs=(1.0, 8.0), max_iter=20).collect()
    assert len(rows) == 4 and all(r["accuracy"] > 0.9 for r in rows)
    assert len({r["n_terms"] for r in rows}) == 2
    curve = {r["k"]: r for r in T.label_curve(train, val, "id", "text", "label", ks=(8, None), max_iter=20).collect()}
    assert curve["8"]["n_train"] == 32 and curve["all"]["n_train"] == 900
    assert curve["8"]["accuracy"] <= curve["all"]["accuracy"]


def test_questions_calibrate_only_on_seen_labels(spark, tickets):
    train, val, _ = tickets
    a = train.filter("label in ('billing', 'account')").withColumn("question", F.lit("seen"))
    b = train.filter("label in ('billing', 'technical')").withColumn("question", F.lit("unseen"))
    va = val.filter("label in ('billing', 'account')").withColumn("question", F.lit("seen"))
    vb = val.filter("label in ('billing', 'account')").withColumn("question", F.lit("unseen"))
    models = T.train_questions(a.unionByName(b), va.unionByName(vb), "question", "id", "text", "label", kind="hashed", max_iter=20)
    assert models["seen"].ece_after is not None and models["unseen"].ece_after is None


def test_hidden_layer_model(spark):
    df = _separable(spark)
    model, classes = T.train_mlp(df, "text", "label", hidden=6, max_iter=40, seed=1)
    d = predict(T.score_mlp(df, model, "text", ["id", "label"]).withColumnRenamed("label", "truth"), classes)
    assert d.filter("label = truth").count() >= 57


def test_hidden_layer_gradient_is_that_of_the_dense_network():
    layers, rng = [7, 3, 4], np.random.default_rng(0)
    theta = rng.normal(size=7 * 3 + 3 + 3 * 4 + 4)
    dense = rng.integers(0, 3, (6, 7)) * (rng.random((6, 7)) < 0.5).astype(float)
    dense[2] = 0
    target, (row, idx) = rng.integers(0, 4, 6), np.nonzero(dense)
    ends = np.searchsorted(row, np.arange(7))

    def loss(t):
        a = 1 / (1 + np.exp(-(dense @ t[:21].reshape(7, 3) + t[21:24])))
        y = a @ t[24:36].reshape(3, 4) + t[36:]
        return float((np.log(np.exp(y).sum(axis=1)) - y[np.arange(6), target]).sum())

    grad = np.zeros_like(theta)
    got = _hidden_pass(theta, layers, target, ends, idx, dense[row, idx], grad)
    slopes = [(loss(theta + d) - loss(theta - d)) / 2e-5 for d in np.eye(len(theta)) * 1e-5]
    assert abs(got - loss(theta)) < 1e-9 and np.allclose(grad, slopes, atol=1e-6)


def test_hidden_layer_rows_stay_sparse(spark, monkeypatch):
    """Rows used to reach MLlib as dense blocks; the loss of the fit is at least as low as that of MLlib's own."""
    seen, own = [], MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "fit", lambda self, d, *a: (seen.append(d.count()), own(self, d, *a))[1])
    rows = [(i, " ".join(f"w{i * j % 23}" for j in range(1, 9)) if i else None, "abc"[i * i % 7 % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    ours, classes = T.train_mlp(df, "text", "label", hidden=4, max_iter=15, seed=3)
    assert seen == [1, 1] and classes == ("a", "b", "c")
    feats = hashed_vector(df.select("text", T._target(classes, "label")), "text", ["target"])
    theirs = MultilayerPerceptronClassifier(featuresCol="features", labelCol="target", layers=[N_BUCKETS, 4, 3], maxIter=15, seed=3)

    def loss(network):
        p = network.transform(feats).select(F.get(vector_to_array("probability"), F.col("target").cast("int")).alias("p"))
        return p.agg(F.avg(-F.log("p"))).first()[0]

    assert loss(ours) < 1.05 * loss(own(theirs, feats)) + 0.01


def test_signal_models(spark, tickets):
    train, val, _ = tickets
    flags = {"invoice": F.col("label") == "billing"}
    models, untrained = T.train_signals(train, val, flags | {"never": F.lit(False)}, "id", "text", max_iter=30)
    assert untrained == {"never": "constant on the training rows"}
    assert set(models) == {"invoice"} and models["invoice"].classes == ("false", "true")
    assert models["invoice"].ece_after is not None
    assert T.train_signals(train.limit(0), val, flags, "id", "text") == ({}, {"invoice": "no training rows"})


def test_training_needs_no_session_setting(spark):
    plain = spark.newSession()
    plain.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    rows = [(i, f"{c} {c}{i % 5} word", c) for i in range(40) for c in [("one", "two")[i % 2]]]
    df = plain.createDataFrame(rows, "id int, text string, label string")
    assert T.model_accuracy(T.train_hashed(df, "text", "label"), df, "id", "text", "label") == 1.0
    assert T.model_accuracy(T.train_tfidf(df, "id", "text", "label"), df, "id", "text", "label") == 1.0


def _fits(spark, tickets):
    """Models of two and of four classes with their own penalties, and of hashed counts, each fitted alone or together."""
    train, _, _ = tickets
    classes = ("account", "billing", "shipping", "technical")
    two = F.col("label").isin("billing", "account")
    tasks = [T.Task("four", classes, 2.0), T.Task("two", ("account", "billing"), 1.0), T.Task("short", classes, 4.0, n_max=1)]
    index = lambda names: T._target(names, "label")
    parts = [T.member(0, index(classes)), T.member(1, index(tasks[1].classes)), T.member(2, index(classes))]
    members = F.when(two, F.array(*parts)).otherwise(F.array(parts[0], parts[2]))
    return train, tasks, members


def _weights(model):
    return {r[0]: r["coef"] for r in model.terms.collect()}


def test_models_fitted_together_equal_single_fits(spark, tickets):
    train, tasks, members = _fits(spark, tickets)
    together = T.fit_tfidf(train, "text", tasks, members)
    mine = train.filter("label in ('billing', 'account')")
    alone = [
        T.train_tfidf(train, "id", "text", "label", c=2.0), T.train_tfidf(mine, "id", "text", "label"), T.train_tfidf(train, "id", "text", "label", c=4.0, n_max=1),
    ]
    for a, b in zip(together, alone, strict=True):
        x, y = _weights(a), _weights(b)
        assert x.keys() == y.keys() and a.n_terms == b.n_terms == len(x) and a.classes == b.classes
        assert max(abs(p - q) for t in x for p, q in zip(x[t], y[t], strict=True)) < 1e-4
        assert np.allclose(a.intercept, b.intercept, atol=1e-4)


def test_one_column_per_row_for_terms_of_one_row_is_exact(spark, tickets):
    """The optimum of the merged problem is MLlib's optimum over all terms."""
    from pyspark.ml.classification import LogisticRegression

    train = tickets[0].filter("id < 200")
    m = T.train_tfidf(train, "id", "text", "label", c=2.0)
    vocab = index_vocab(fit_vocab(train, "text")).persist()
    n = vocab.count()
    feats = tfidf_vector(train.select("id", "text", T._target(m.classes, "label")), "id", "text", vocab, n, ["target"])
    lr = LogisticRegression(labelCol="target", family="multinomial", regParam=1 / (200 * 2.0), standardization=False, maxIter=500, tol=1e-12)
    w = lr.fit(feats).coefficientMatrix.toArray()
    at = {r["term"]: r["idx"] for r in vocab.collect()}
    mine = _weights(m)
    assert mine.keys() == at.keys() and sum(r["df"] == 1 for r in vocab.collect()) > n / 2
    # softmax margins may shift by a constant per term, which the penalty sets to 0
    assert max(np.abs(np.array(mine[t]) - (w[:, i] - w[:, i].mean())).max() for t, i in at.items()) < 1e-4


def test_coefficients_in_tables_reach_the_same_optimum(spark, monkeypatch):
    from arbitra.operators import optimise

    df = _separable(spark)
    two = F.col("label") != "technical"
    tasks = [T.Task("three", ("account", "billing", "technical"), 2.0), T.Task("two", ("account", "billing"), 1.0)]
    parts = [T.member(i, T._target(t.classes, "label")) for i, t in enumerate(tasks)]
    members = F.when(two, F.array(*parts)).otherwise(F.array(parts[0]))
    here = T.fit_tfidf(df, "text", tasks, members)
    monkeypatch.setattr(optimise, "DRIVER_COEFFICIENTS", 0)
    for limit in (T, optimise):
        monkeypatch.setattr(limit, "MAX_COEFFICIENTS", 1, raising=False)
    tables = T.fit_tfidf(df, "text", tasks, members)
    for a, b in zip(here, tables, strict=True):
        x, y = _weights(a), _weights(b)
        assert x.keys() == y.keys()
        assert max(abs(p - q) for t in x for p, q in zip(x[t], y[t], strict=True)) < 1e-4
        assert np.allclose(a.intercept, b.intercept, atol=1e-4)


@pytest.mark.parametrize("block", [50, 1_000_000])
def test_one_value_per_row_reaches_the_same_optimum(spark, tickets, monkeypatch, block):
    """The driver holds one value per row and class, and what reaches it in a step does not grow with the terms."""
    from arbitra.operators import optimise

    train, tasks, members = _fits(spark, tickets)
    here = T.fit_tfidf(train, "text", tasks, members)
    monkeypatch.setattr(optimise, "FEW_COEFFICIENTS", 0)
    monkeypatch.setattr(optimise, "BLOCK_VALUES", block if block > 50 else 20_000)
    monkeypatch.setattr(optimise, "PART", 1 << 16 if block > 50 else 700)
    monkeypatch.setattr(optimise, "_fit_here", None)
    monkeypatch.setattr(optimise, "_Tables", None)
    rows = T.fit_tfidf(train, "text", tasks, members)
    for a, b in zip(here, rows, strict=True):
        x, y = _weights(a), _weights(b)
        assert x.keys() == y.keys()
        assert max(abs(p - q) for t in x for p, q in zip(x[t], y[t], strict=True)) < 1e-4
        assert np.allclose(a.intercept, b.intercept, atol=1e-4)


def test_texts_are_read_once_for_all_models(spark, tmp_path):
    rows = [(i, f"{c} {c}{i % 5} word{i}", c, q) for i in range(60) for c in [("one", "two")[i % 2]] for q in [f"q{i % 3}"]]
    spark.createDataFrame(rows, "id int, text string, label string, question string").write.parquet(str(tmp_path / "t"))
    seen = []
    original = T.written

    def watch(df, name):
        if str(tmp_path) in df._jdf.queryExecution().executedPlan().toString():
            seen.append(name)
        return original(df, name)

    T.written, _ = watch, None
    try:
        df = spark.read.parquet(str(tmp_path / "t"))
        members = F.array(F.struct(F.substring("question", 2, 1).cast("int").alias("model"), (F.col("label") == "two").cast("int").alias("target")))
        T.fit_tfidf(df, "text", [T.Task(f"q{i}", ("one", "two")) for i in range(3)], members)
    finally:
        T.written = original
    assert seen == ["texts"]


def test_classes_are_bounded_before_they_are_collected(spark, monkeypatch):
    monkeypatch.setattr(T, "MAX_CLASSES", 5)
    with pytest.raises(ValueError, match="more than 5"):
        T.class_names(spark.range(9).select(F.col("id").cast("string").alias("label")), "label")


def test_cold_start(spark, tickets):
    train, _, _ = tickets
    two = train.filter("label in ('billing', 'technical')")
    teacher = two.select("id", F.concat(F.lit("Type: "), F.upper("label")).alias("reply"))
    out = R.cold_start(two, teacher, "id", "text", ["technical", "billing"], n=120, target=0.8)
    gate = out["gate"].first()
    assert (gate["n_train"], gate["n_held"], gate["gate"]) == (90, 30, "pass")
    assert out["model"].classes == ("technical", "billing")
    assert out["review"].count() == 12
    assert R.cold_start(two, teacher, "id", "text", ["technical", "billing"], target=1.01)["gate"].first()["gate"] == "hold"


def test_policy_of_a_question():
    with pytest.raises(ValueError):
        Question("")
    assert Question("q").policy == Policy()


def test_vector_query_keeps_terms_of_one_document(spark, tmp_path):
    from arbitra.plans import QUERIES

    rows = [(1, "alpha beta"), (2, "alpha gamma"), (3, "delta")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["n_set"] for r in QUERIES["tfidf_vector"](spark, str(tmp_path)).collect()}
    assert got == {1: 3, 2: 3, 3: 1}


def test_cold_start_query_keeps_terms_of_one_document(spark, tmp_path, monkeypatch):
    from arbitra.plans import QUERIES
    from arbitra.plans import rules as plans

    asked = {}
    monkeypatch.setattr(plans.R, "cold_start", lambda *a, **options: asked.update(options) or {"gate": None})
    spark.createDataFrame([(1, "alpha", "en")], "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    QUERIES["cold_start"](spark, str(tmp_path))
    assert asked.get("min_df", 1) == 1


def test_frequent_inputs_as_a_matrix_change_nothing():
    layers, rng = [9, 3, 2], np.random.default_rng(1)
    theta = rng.normal(size=9 * 3 + 3 + 3 * 2 + 2)
    dense = rng.integers(0, 3, (7, 9)) * (rng.random((7, 9)) < 0.6).astype(float)
    row, idx = np.nonzero(dense)
    target, ends = rng.integers(0, 2, 7), np.searchsorted(row, np.arange(8))
    grads = [np.zeros_like(theta) for _ in range(3)]
    losses = [_hidden_pass(theta, layers, target, ends, idx, dense[row, idx], g, often) for g, often in zip(grads, (0, 4, 9), strict=True)]
    assert np.allclose(losses, losses[0]) and all(np.allclose(g, grads[0]) for g in grads)


def test_no_table_of_a_fit_has_a_row_per_ngram(spark, tickets, monkeypatch):
    """Texts, vocabulary, columns and weights used to be stored one row per text or n-gram."""
    from arbitra import session
    from arbitra.operators import optimise, score as module

    monkeypatch.setattr(optimise, "FEW_COEFFICIENTS", 0)
    monkeypatch.setattr(module, "HEAD_BYTES", 0)
    sizes, own = [], session.written
    for m in (T, T.bags, optimise, session):
        monkeypatch.setattr(m, "written", lambda df, name: (lambda d: (sizes.append(d.count()), d)[1])(own(df, name)))
    train, val, _ = tickets
    model = T.train_tfidf(train.coalesce(2), "id", "text", "label")
    assert model.n_terms == model.terms.count() > 5000
    scored = score(val.coalesce(2), model, "id", "text", ["label"])
    assert "Generate" not in scored._jdf.queryExecution().executedPlan().toString()
    assert predict(scored.withColumnRenamed("label", "truth"), model.classes).filter("label = truth").count() > 280
    assert len(sizes) >= 4 and max(sizes) < 50


def test_blocks_of_counts_are_compact(spark):
    """Blocks of up to 4,096 rows with eight bytes a cell used to be kept in the executors' memory."""
    from arbitra.operators import optimise

    rows = spark.range(2000, numPartitions=1).select(
        F.col("id").alias("row"), F.lit(0).alias("model"), (F.col("id") % 2).cast("int").alias("target"),
        F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: (i * 163 + F.col("id") % 7).cast("bigint")).alias("idx"),
        F.array_repeat(F.lit(2.0), 100).alias("x"), F.lit(0.0).alias("own"),
    )
    blocks = optimise._blocks(rows, 200_000).collect()
    assert max(b["n"] for b in blocks) <= 512 and sum(b["n"] for b in blocks) == 2000
    assert sum(len(b["data"]) for b in blocks) < 2000 * 100 * 4
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_hidden_layer_query_fits_the_operator_s_own_size(spark, tmp_path, monkeypatch):
    """The query used to fit 64 hidden units in 50 steps."""
    import inspect

    from arbitra.plans import QUERIES

    asked, own = [], T.train_mlp

    def watch(*args, **options):
        asked.append(inspect.signature(own).bind(*args, **options))
        asked[-1].apply_defaults()
        return own(*args, **options | {"hidden": 4, "max_iter": 2})

    monkeypatch.setattr(T, "train_mlp", watch)
    rows = [(i, f"alpha {lang}{i % 3} beta", lang) for i in range(20) for lang in ("en", "fr")]
    spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["train_mlp"](spark, str(tmp_path)).count() == 1
    assert [(a.arguments["hidden"], a.arguments["max_iter"]) for a in asked] == [(256, 100)]


def test_models_of_the_same_rows_share_their_ngrams(spark, tickets, monkeypatch):
    """The points of a sweep and the signals of a table used to be laid out once per model."""
    train, val, _ = tickets
    seen, own = [], T.bags.columns_of
    monkeypatch.setattr(T.bags, "columns_of", lambda texts, longest, *a: (seen.append(list(longest)), own(texts, longest, *a))[1])
    grid = {(r["n_max"], r["c"]): r for r in T.sweep(train, val, "id", "text", "label", ngrams=(1, 2), cs=(0.5, 8.0)).collect()}
    assert seen.pop() == [1, 2]
    for (n, c), r in grid.items():
        m = T.train_tfidf(train, "id", "text", "label", c=c, n_max=n)
        assert r["n_terms"] == m.n_terms and r["accuracy"] == T.model_accuracy(m, val, "id", "text", "label")
    seen.clear()
    flags = {"a": F.col("label") == "billing", "b": F.col("id") % 3 == 0, "c": F.col("label").isin("billing", "account")}
    models, _ = T.train_signals(train, val, flags, "id", "text")
    assert seen == [[2]]
    for name, flag in flags.items():
        alone = T.train_tfidf(train.withColumn("flag", flag.cast("string")), "id", "text", "flag")
        x, y = _weights(models[name]), _weights(alone)
        assert x.keys() == y.keys() and max(abs(p - q) for t in x for p, q in zip(x[t], y[t], strict=True)) < 1e-4
