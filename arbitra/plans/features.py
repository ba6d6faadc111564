"""Tokens, hashed features, vocabulary and TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbitra.functions.text import fnv_bucket, ngrams, tokens_alnum, tokens_word
from arbitra.operators import features as X
from arbitra.plans.base import alnum_sql, documents, query, r6, rounded, with_sql, words_sql
from arbitra.plans.weights import BUCKET_COUNTS, GRAM_COUNTS
from arbitra.session import written


@query("tokens_alnum", f"SELECT doc_id, CAST(len({alnum_sql('text')}) AS INTEGER) AS n_tokens, md5(array_to_string({alnum_sql('text')}, ' ')) AS digest FROM documents")
def q_tokens_alnum(spark, sf):
    d = documents(spark, sf).select("doc_id", tokens_alnum("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query("tokens_word", f"SELECT doc_id, CAST(len({words_sql('text')}) AS INTEGER) AS n_tokens, md5(array_to_string({words_sql('text')}, ' ')) AS digest FROM documents")
def q_tokens_word(spark, sf):
    d = documents(spark, sf).select("doc_id", tokens_word("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query("fnv_bucket", with_sql(BUCKET_COUNTS[:2], "SELECT tok, CAST(bucket AS INTEGER) AS bucket FROM codes"))
def q_fnv_bucket(spark, sf):
    d = documents(spark, sf).select(F.explode(tokens_alnum("text")).alias("tok")).distinct()
    return d.select("tok", fnv_bucket(F.col("tok")).alias("bucket"))


@query("hashed_tf", with_sql(BUCKET_COUNTS, "SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, CAST(n AS DOUBLE) AS x FROM bc"))
def q_hashed_tf(spark, sf):
    return X.hashed_tf(documents(spark, sf), "doc_id", "text")


@query(
    "hashed_vector",
    with_sql(BUCKET_COUNTS, "SELECT doc_id, CAST(16384 AS INTEGER) AS width, CAST(count(bc.bucket) AS INTEGER) AS n_set, CAST(coalesce(sum(n), 0) AS DOUBLE) AS total FROM documents LEFT JOIN bc USING (doc_id) GROUP BY doc_id"),
)
def q_hashed_vector(spark, sf):
    v = F.unwrap_udt("features")
    d = X.hashed_vector(documents(spark, sf), "text", ["doc_id"])
    total = F.aggregate(v["values"], F.lit(0.0), lambda a, x: a + x)
    return d.select("doc_id", v["size"].alias("width"), F.size(v["indices"]).alias("n_set"), total.alias("total"))


@query(
    "ngrams",
    f"SELECT doc_id, CAST(len(g) AS INTEGER) AS n_grams, md5(array_to_string(g, '|')) AS digest FROM (SELECT doc_id, list_concat(list_concat(t, "
    "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])), list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g "
    f"FROM (SELECT doc_id, {words_sql('text')} AS t FROM documents))",
)
def q_ngrams(spark, sf):
    d = documents(spark, sf).select("doc_id", ngrams(tokens_word("text"), 1, 3).alias("g"))
    return d.select("doc_id", F.size("g").alias("n_grams"), F.md5(F.array_join("g", "|").cast("binary")).alias("digest"))


_VOCAB = "v AS MATERIALIZED (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tc GROUP BY term)"


@query("fit_vocab", with_sql([*GRAM_COUNTS, _VOCAB], "SELECT term, df, round(idf, 6) AS idf FROM v"))
def q_fit_vocab(spark, sf):
    return rounded(X.fit_vocab(documents(spark, sf), "text"), "idf")


def _weights(spark, sf, norm=None):
    d = documents(spark, sf)
    vocab = written(X.fit_vocab(d, "text"), "vocab")
    return X.tfidf_weights(d, "doc_id", "text", vocab, vocab.count(), norm=norm)


_X = "x AS (SELECT doc_id, term, (1 + ln(n)) * idf AS x FROM tc JOIN v USING (term))"


@query("tfidf_weights", with_sql([*GRAM_COUNTS, _VOCAB, _X], "SELECT doc_id, term, round(x, 6) AS x FROM x"))
def q_tfidf_weights(spark, sf):
    return rounded(_weights(spark, sf), "x")


@query(
    "l2_normalize",
    with_sql([*GRAM_COUNTS, _VOCAB, _X], "SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS x FROM x"),
)
def q_l2_normalize(spark, sf):
    return rounded(X.l2_normalize(_weights(spark, sf, "_norm"), "doc_id", norm="_norm"), "x")


@query("tfidf_vector")
def q_tfidf_vector(spark, sf):
    d = documents(spark, sf)
    vocab = written(X.fit_vocab(d, "text"), "vocab")
    v = F.unwrap_udt("features")
    norm = F.aggregate(v["values"], F.lit(0.0), lambda a, x: a + x * x)
    out = X.tfidf_vector(d, "doc_id", "text", X.index_vocab(vocab), vocab.count())
    return out.select("doc_id", F.size(v["indices"]).alias("n_set"), r6(norm).alias("squared_norm"))
