from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arbitra.functions.text import N_BUCKETS, bucket_counts, fnv_bucket, ngrams, tokens_alnum, tokens_word, word_counts

WORD_CASES = {
    "Hello WORLD": ["hello", "world"],
    "don't stop": ["don", "stop"],
    "hello_world foo": ["hello_world", "foo"],
    "k8s 1.14 C++": ["k8s", "14"],
    "café naïve": ["café", "naïve"],
    "a b c": [],
    "": [],
}


def _rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def _fnv(token: str) -> int:
    h = 0xCBF29CE484222325
    for b in token.encode():
        h = ((h ^ b) * 0x100000001B3) % (1 << 64)
    return h % N_BUCKETS


def test_word_tokens(spark):
    got = _rows(spark, WORD_CASES).select("text", tokens_word("text")).collect()
    assert {r[0]: r[1] for r in got} == WORD_CASES


def test_alnum_tokens_split_at_underscore(spark):
    got = _rows(spark, ["Hello_World! it's 3x", "", None]).orderBy("id").select(tokens_alnum("text")).collect()
    assert [r[0] for r in got] == [["hello", "world", "it", "s", "3x"], [], []]


@pytest.mark.parametrize("n_max,want", [(1, ["ab", "cd", "ef"]), (2, ["ab", "cd", "ef", "ab cd", "cd ef"]), (3, ["ab", "cd", "ef", "ab cd", "cd ef", "ab cd ef"])])
def test_ngrams_shorter_first(spark, n_max, want):
    assert _rows(spark, ["ab cd ef"]).select(ngrams(tokens_word("text"), 1, n_max)).first()[0] == want


def test_ngrams_of_short_texts(spark):
    got = _rows(spark, ["", "ab", "ab cd"]).orderBy("id").select(ngrams(tokens_word("text"), 1, 3)).collect()
    assert [r[0] for r in got] == [[], ["ab"], ["ab", "cd", "ab cd"]]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=6), min_size=1, max_size=25))
def test_buckets_match_the_64_bit_hash(spark, tokens):
    rows = _rows(spark, tokens).orderBy("id").select("text", fnv_bucket(F.col("text"))).collect()
    assert [r[1] for r in rows] == [_fnv(r[0]) for r in rows]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["ab", "cd", "ef", "gh_i"]), max_size=12).map(" ".join), min_size=1, max_size=10))
def test_counts_match_a_counter(spark, texts):
    rows = _rows(spark, texts).select("text", word_counts("text"), bucket_counts("text")).collect()
    for text, words, buckets in rows:
        toks = text.split()
        grams = toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]
        assert {e["key"]: e["n"] for e in words} == Counter(grams)
        parts = [p for t in toks for p in t.split("_")]
        assert {e["key"]: e["n"] for e in buckets} == Counter(map(_fnv, parts))
        assert [e["key"] for e in buckets] == sorted(e["key"] for e in buckets)


def test_hashing_ignores_case(spark):
    a, b = (r[0] for r in _rows(spark, ["Hello WORLD hello", "hello world hello"]).select(bucket_counts("text")).collect())
    assert a == b and sorted(e["n"] for e in a) == [1, 2]


def test_buckets_of_arrow_tokens_equal_the_column_function():
    import pyarrow as pa

    from arbitra.functions.text import fnv_buckets

    tokens = ["", "a", "abc", "x" * 5000, "é", "漢字", "😀z", "abc", "ab"]
    assert fnv_buckets(pa.array(tokens)).tolist() == [_fnv(t) for t in tokens]
    assert fnv_buckets(pa.array(tokens).slice(2, 4)).tolist() == [_fnv(t) for t in tokens[2:6]]
    assert fnv_buckets(pa.array([], pa.string())).tolist() == []


def test_words_of_a_batch_equal_those_of_each_text(spark):
    import pyarrow as pa

    from arbitra.functions.text import characters, joined_words

    texts = ["", "a", "Ab cd_e  f Gh", "İstanbul ΣΑΣ straße x", "naïve café à 12 ½ ٣٤ x1", "漢字 and 😀😀 𝒜𝒜 b", "ab", "c ", " dd-ee", "ा का", "\u0000x y", "zz"]
    rows = _rows(spark, texts).select(F.lower("text").alias("low"), tokens_word("text").alias("w"), tokens_alnum("text").alias("a")).collect()
    low = pa.array([r["low"] for r in rows])
    assert joined_words(low, characters(spark, "word")).to_pylist() == [" ".join(r["w"]) for r in rows]
    assert joined_words(low, characters(spark, "alnum"), 1).to_pylist() == [" ".join(r["a"]) for r in rows]
    assert joined_words(low.slice(2, 1), characters(spark, "word")).to_pylist() == ["ab cd_e gh"]
    assert joined_words(low.slice(5, 3), characters(spark, "word")).to_pylist() == [" ".join(r["w"]) for r in rows[5:8]]
