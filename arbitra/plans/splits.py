"""Splits, samples, set checks and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbitra.operators import splits as S
from arbitra.plans.base import documents, hex_int_sql, labelled, query, table, words_sql


def _ranked(seed, key: str, src: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    h = f"md5('{seed}:' || {key})"
    return (
        f"SELECT *, row_number() OVER ({part}ORDER BY {h}, {key}) AS r, count(*) OVER ({part.strip()}) AS t FROM {src}"
    )


@query("shuffle", f"SELECT o_orderkey, r - 1 AS position FROM ({_ranked(7, 'o_orderkey', 'orders')})")
def q_shuffle(spark, sf):
    return S.shuffle(table(spark, sf, "orders"), "o_orderkey", 7).select("o_orderkey", "position")


@query(
    "split_halves",
    f"SELECT o_orderkey, CASE WHEN r <= t // 2 THEN 'A' ELSE 'B' END AS half FROM ({_ranked(7, 'o_orderkey', 'orders', 'o_orderpriority')})",
)
def q_split_halves(spark, sf):
    return S.split_halves(table(spark, sf, "orders"), "o_orderkey", "o_orderpriority", 7).select("o_orderkey", "half")


@query(
    "split_fixed",
    f"SELECT o_orderkey, CASE WHEN r <= 400 THEN 'train' ELSE 'validation' END AS split FROM ({_ranked(7, 'o_orderkey', 'orders', 'o_orderstatus')})",
)
def q_split_fixed(spark, sf):
    return S.split_fixed(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus", 400, 7).select("o_orderkey", "split")


@query(
    "split_frac",
    f"SELECT doc_id, CASE WHEN r <= greatest(1, CAST(floor(t * 0.8::DOUBLE) AS BIGINT)) THEN 'train' ELSE 'validation' END AS split FROM ({_ranked(7, 'doc_id', 'documents', 'source')})",
)
def q_split_frac(spark, sf):
    return S.split_frac(documents(spark, sf), "doc_id", "source", 0.8, 7).select("doc_id", "split")


@query(
    "split_head",
    f"SELECT o_orderkey, CASE WHEN r <= greatest(500, t // 10) THEN 'validation' ELSE 'train' END AS split FROM ({_ranked(7, 'o_orderkey', 'orders')})",
)
def q_split_head(spark, sf):
    return S.split_head(table(spark, sf, "orders"), "o_orderkey", 7).select("o_orderkey", "split")


@query(
    "min_support",
    "SELECT doc_id, source, lang FROM documents JOIN (SELECT source, lang FROM documents GROUP BY ALL HAVING count(*) >= 8) USING (source, lang)",
)
def q_min_support(spark, sf):
    d = documents(spark, sf).withColumn("cell", F.concat_ws("|", "source", "lang"))
    return S.min_support(d, "cell", 8).select("doc_id", "source", "lang")


@query("cap_per_class", f"SELECT event_id, event_type FROM ({_ranked(3, 'event_id', 'events', 'event_type')}) WHERE r <= 120")
def q_cap_per_class(spark, sf):
    return S.cap_per_class(table(spark, sf, "events"), "event_id", "event_type", 120, 3).select("event_id", "event_type")


@query("sample_n", f"SELECT doc_id, lang FROM ({_ranked(5, 'doc_id', 'documents')}) WHERE r <= 120")
def q_sample_n(spark, sf):
    return S.sample_n(documents(spark, sf), "doc_id", 120, 5).select("doc_id", "lang")


@query(
    "split_overlap",
    "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS splits FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1",
)
def q_split_overlap(spark, sf):
    o = table(spark, sf, "orders")
    parts = {s: o.filter(F.col("o_orderstatus") == s) for s in ("F", "O", "P")}
    return S.split_overlap(parts, "o_custkey").withColumn("splits", F.array_join("splits", ","))


@query(
    "union_sources",
    "SELECT 'documents' AS source, 'text' AS label, count(*) AS n FROM documents UNION ALL SELECT 'conversations', role, count(*) FROM conversations GROUP BY role UNION ALL SELECT 'benchmark', 'text', count(*) FROM benchmark",
)
def q_union_sources(spark, sf):
    u = S.union_sources(
        {
            "documents": documents(spark, sf).select(F.col("text").alias("input"), F.lit("text").alias("label")),
            "conversations": table(spark, sf, "conversations").select(F.col("text").alias("input"), F.col("role").alias("label")),
            "benchmark": table(spark, sf, "benchmark").select(F.col("text").alias("input"), F.lit("text").alias("label")),
        }
    )
    return S.source_counts(u, "label")


_NORM = f"array_to_string({words_sql('text')}, ' ')"


@query(
    "drop_probe_overlap",
    f"SELECT doc_id FROM documents WHERE {_NORM} NOT IN (SELECT {_NORM} FROM documents WHERE source = 'src0')",
)
def q_drop_probe_overlap(spark, sf):
    d = documents(spark, sf)
    return S.drop_probe_overlap(d, d.filter(F.col("source") == "src0"), "text").select("doc_id")


@query(
    "build_pairs",
    f"""WITH b AS (SELECT p_brand, max(p_retailprice) AS bs FROM part GROUP BY p_brand),
c AS (SELECT p_brand, p_partkey, p_retailprice AS s, p_name AS t, bs, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r,
row_number() OVER (PARTITION BY p_brand, bs - p_retailprice >= 3.0 ORDER BY p_retailprice DESC, p_partkey) AS r2 FROM part JOIN b USING (p_brand)),
x AS (SELECT p_brand, s AS bs, t AS bt FROM c WHERE r = 1), y AS (SELECT p_brand, s AS os, t AS ot FROM c WHERE r2 = 1 AND bs - s >= 3.0),
z AS (SELECT *, {hex_int_sql("md5('11:' || p_brand)")} % 2 = 1 AS swap FROM x JOIN y USING (p_brand))
SELECT p_brand, CASE WHEN swap THEN 'A ' || ot || ' || B ' || bt ELSE 'A ' || bt || ' || B ' || ot END AS text, CASE WHEN swap THEN 'B' ELSE 'A' END AS label, bs AS best_score, os AS other_score FROM z""",
)
def q_build_pairs(spark, sf):
    return S.build_pairs(table(spark, sf, "part"), "p_brand", "p_partkey", "p_retailprice", "p_name")


def _list_sql(words: str) -> str:
    return "['" + "','".join(words.split(" ")) + "']"


@query("label_index", "SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT lang FROM documents)")
def q_label_index(spark, sf):
    from arbitra.operators.train import label_index

    return label_index(documents(spark, sf), "lang")


@query(
    "split_sizes",
    f"SELECT truth, split, count(*) AS n FROM (SELECT truth, CASE WHEN r <= greatest(1, CAST(floor(t * 0.8::DOUBLE) AS BIGINT)) THEN 'train' ELSE 'validation' END AS split FROM "
    f"({_ranked(7, 'doc_id', '(SELECT doc_id, quality AS truth FROM labels)', 'truth')})) GROUP BY ALL",
)
def q_split_sizes(spark, sf):
    rows = labelled(spark, sf).withColumn("truth", F.when(F.col("truth") == "good", 1).otherwise(0))
    s = S.split_frac(rows.select("doc_id", "truth"), "doc_id", "truth", 0.8, 7)
    return s.groupBy("truth", "split").agg(F.count("*").alias("n"))
