import math
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arbitra.functions import grams
from arbitra.operators import features as X
from arbitra.plans import QUERIES

TEXTS = ["The cat the cat sat", "", None, "cat sat on mats", "a b c", "Über straße über", "the cat", "the cat the cat the", "zz_1 22 the"]


def _counts(text, n_min=1, n_max=2):
    w = re.findall(r"\w{2,}", (text or "").lower())
    return Counter(" ".join(w[i : i + n]) for n in range(n_min, n_max + 1) for i in range(len(w) - n + 1))


def _docs(spark, copies=3):
    rows = [(i, t, "xy"[i % 2]) for i, t in enumerate(TEXTS * copies)]
    return spark.createDataFrame([*rows, (0, "the dog", "x"), (None, "cat dog", None), (None, "dog", None)], "id bigint, text string, k string")


@pytest.fixture
def small_steps(monkeypatch):
    """Many chunks and buckets even for a few rows."""
    monkeypatch.setattr(X, "STEP_BYTES", 40)
    monkeypatch.setattr(X, "STEP_TERMS", 3)


def _expected(df, n_min=1, n_max=2, without=()):
    rows = [(r["id"], r["k"], _counts(r["text"], n_min, n_max)) for r in df.collect()]
    seen = Counter(t for _, _, c in rows for t in c)
    idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in seen.items() if t not in without}
    return seen, [(i, k, t, (1 + math.log(n)) * idf[t]) for i, k, c in rows for t, n in c.items() if t in idf]


def _same(got, want):
    order = lambda r: tuple((v is not None, v) for v in r[:-1]) + (round(r[-1], 9),)
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
    assert all(abs(a[-1] - b[-1]) < 1e-9 for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize(("n_min", "n_max"), [(1, 1), (1, 2), (2, 3)])
def test_vocabulary_and_weights_over_many_chunks(spark, small_steps, n_min, n_max):
    df = _docs(spark)
    seen, want = _expected(df, n_min, n_max)
    vocab = X.fit_vocab(df, "text", n_min, n_max)
    assert {r["term"]: r["df"] for r in vocab.collect()} == dict(seen)
    _same(X.tfidf_weights(df, "id", "text", vocab, len(seen), ["k"], n_min, n_max).collect(), want)


def test_terms_outside_the_vocabulary_have_no_weight(spark, small_steps):
    df = _docs(spark)
    _, want = _expected(df, without=("cat", "the cat"))
    vocab = X.fit_vocab(df, "text").filter("term NOT IN ('cat', 'the cat')")
    _same(X.tfidf_weights(df, "id", "text", vocab, vocab.count(), ["k"]).collect(), want)
    assert X.tfidf_weights(df, "id", "text", vocab.limit(0), 0).collect() == []


def test_norms_made_with_the_weights_are_those_of_the_window(spark, small_steps):
    df = _docs(spark)
    vocab = X.fit_vocab(df, "text")
    plain = X.l2_normalize(X.tfidf_weights(df, "id", "text", vocab, 9), "id").collect()
    own = X.l2_normalize(X.tfidf_weights(df, "id", "text", vocab, 9, norm="_norm"), "id", norm="_norm")
    assert own.columns == ["id", "term", "x"]
    _same(own.collect(), [tuple(r) for r in plain])


def test_vectors_over_many_chunks(spark, small_steps):
    df = _docs(spark)
    _, want = _expected(df)
    vocab = X.index_vocab(X.fit_vocab(df, "text")).persist()
    at = {r["term"]: r["idx"] for r in vocab.collect()}
    assert sorted(at.values()) == list(range(len(at)))
    v = F.unwrap_udt("features")
    got = X.tfidf_vector(df, "id", "text", vocab, len(at), ["k"]).select("id", "k", v["indices"].alias("i"), v["values"].alias("x")).collect()
    assert len(got) == df.select("id", "k").distinct().count()  # rows that share both share a vector
    by = {}
    for i, k, t, x in want:
        by.setdefault((i, k), []).append((at[t], x))
    for r in got:
        pairs = sorted(by.get((r["id"], r["k"]), []))
        norm = math.sqrt(sum(x * x for _, x in pairs))
        assert r["i"] == [i for i, _ in pairs]
        assert all(abs(a - x / norm) < 1e-9 for a, (_, x) in zip(r["x"], pairs, strict=True))


@pytest.mark.parametrize("name", ["tfidf_weights", "l2_normalize", "tfidf_vector"])
def test_queries_shuffle_no_row_per_term_of_a_text(spark, tmp_path, monkeypatch, name):
    """Beyond the broadcast bound, too, n-grams travel as lists, and none is sorted or gathered by document."""
    monkeypatch.setattr("arbitra.session.BROADCAST_BYTES", 0)
    spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma"), (3, "delta")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(_?term|SortMergeJoin|collect_list|Window.*doc_id", plan)
    assert df.agg(F.count("*")).first()[0] == (3 if name == "tfidf_vector" else 7)


def test_hashes_of_terms_agree_with_those_of_counted_grams():
    g = grams.gram_counts(pa.array(["aa bb cc", "", "bb aa"]), 1, 3)
    assert (grams.term_hashes(g.terms) == g.hashes).all() and len(set(g.terms.to_pylist())) == len(g.terms) == 7
    order, bucket, sizes = grams.dealt(g.hashes, 3)
    terms, n = grams.unpacked(grams.packed(g.terms, order, sizes))
    assert sorted(terms.to_pylist()) == sorted(g.terms.to_pylist()) and list(n) == list(sizes) and len(bucket) == len(sizes)
