import hashlib
import random
from collections import Counter, defaultdict

import pytest

from arbitra.operators import evaluate as E
from arbitra.operators import ranks
from arbitra.operators import splits as S
from arbitra.operators.calibrate import fit_abstain
from arbitra.operators.ranks import hash_rank, join_per_key, running_totals, value_at_index


def _skewed(spark, n=600):
    # One key holds half of all rows, one is null, many are rare.
    rng = random.Random(3)
    keys = ["hot"] * (n // 2) + [None] * 5 + [f"k{rng.randrange(40)}" for _ in range(n - n // 2 - 5)]
    rows = [(i, k, float(rng.randrange(25))) for i, k in enumerate(keys)]
    return rows, spark.createDataFrame(rows, "id int, key string, v double").repartition(7)


def _order(seed, rows):
    return sorted(rows, key=lambda r: hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest())


def test_hash_rank_is_the_rank_in_digest_order(spark):
    rows, df = _skewed(spark)
    got = {r["id"]: (r["rank"], r["t"]) for r in hash_rank(df, ["id"], 5, ["key"], total="t").collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    want = {r[0]: (i + 1, len(g)) for g in groups.values() for i, r in enumerate(_order(5, g))}
    assert got == want
    assert {r["id"]: r["position"] for r in S.shuffle(df, "id", 9).collect()} == {r[0]: i for i, r in enumerate(_order(9, rows))}


def test_ranks_do_not_depend_on_partitions(spark):
    _, df = _skewed(spark)
    a, b = (sorted(map(tuple, S.shuffle(df.repartition(n), "id", 1).select("id", "position").collect())) for n in (1, 8))
    assert a == b


@pytest.mark.parametrize("buckets", [None, 5])
@pytest.mark.parametrize("by", [["key"], []])
def test_running_totals_match_a_scan(spark, buckets, by):
    rows, df = _skewed(spark)
    from pyspark.sql import functions as F

    got = running_totals(df, "v", {"c": F.count("*")}, by, buckets=buckets, previous="prev").collect()
    groups = defaultdict(Counter)
    for _, k, v in rows:
        groups[k if by else None][v] += 1
    assert len(got) == sum(len(c) for c in groups.values())
    for r in got:
        c = groups[r["key"] if by else None]
        below = [v for v in c if v < r["v"]]
        assert r["c"] == c[r["v"]]
        assert r["c_below"] == sum(c[v] for v in below)
        assert r["c_total"] == sum(c.values())
        assert r["prev"] == (max(below) if below else None)


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,3)", "double"])
@pytest.mark.parametrize("by", [["key"], []])
def test_values_of_any_type_are_cut_by_range(spark, monkeypatch, kind, by):
    """A bucket for each distinct value gives what one window gives; nulls are left out."""
    from pyspark.sql import functions as F

    _, df = _skewed(spark, 200)
    v = {
        "string": F.concat(F.lit("é"), F.conv(F.col("v").cast("int").cast("string"), 10, 2)),
        "date": F.date_add(F.lit("1969-12-20").cast("date"), F.col("v").cast("int")),
        "decimal(20,3)": F.col("v") / 3 - 4,
        "double": F.when(F.col("v") == 3, float("nan")).when(F.col("v") == 4, float("-inf")).when(F.col("v") == 5, -0.0).otherwise(F.col("v")),
    }[kind]
    df = df.withColumn("x", F.when(F.col("v") != 7, v.cast(kind)))
    run = lambda: sorted(map(repr, running_totals(df, "x", {"c": F.count("*"), "s": F.sum("id")}, by, previous="prev").collect()))
    want = run()
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 1)
    cut = []
    whole = ranks.value_buckets
    monkeypatch.setattr(ranks, "value_buckets", lambda *a: cut.append(whole(*a)) or cut[-1])
    assert run() == want
    assert cut[0].select("_b").distinct().count() > 5
    least = cut[0].groupBy("_b").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("_b").collect()
    assert all(repr(a["hi"]) != repr(b["lo"]) for a, b in zip(least, least[1:], strict=False))


def test_order_statistics(spark):
    from pyspark.sql import functions as F

    rows, df = _skewed(spark)
    got = value_at_index(df, "v", {"third": F.lit(2), "last": F.col("_n") + 9}, ["key"]).collect()
    groups = defaultdict(list)
    for _, k, v in rows:
        groups[k].append(v)
    for r in got:
        v = sorted(groups[r["key"]])
        assert (r["third"], r["last"], r["_n"]) == (v[min(2, len(v) - 1)], v[-1], len(v))


@pytest.mark.parametrize("method", ["ceil", "round", "trunc"])
@pytest.mark.parametrize("p", [0.0, 0.5, 0.99, 1.0])
def test_percentile_conventions(spark, method, p):
    import math

    rows, df = _skewed(spark)
    v = sorted(r[2] for r in rows)
    n = len(v)
    at = {"ceil": math.ceil(p * n) - 1, "round": math.floor(p * (n - 1) + 0.5), "trunc": int(n * p)}[method]
    assert E.percentile_rank(df, "v", p, method).first()["value"] == v[min(max(at, 0), n - 1)]


def test_abstain_threshold_interpolates(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "energy double")
    assert fit_abstain(df, 0.5).first()[0] == 2.5
    assert abs(fit_abstain(df, 0.95).first()[0] - 3.85) < 1e-9


def test_join_per_key_keeps_every_row(spark):
    from pyspark.sql import functions as F

    rows, df = _skewed(spark)
    per_key = df.groupBy("key").agg(F.max("v").alias("top"))
    got = join_per_key(df, per_key, "key").collect()
    assert sorted(r["id"] for r in got) == sorted(r[0] for r in rows if r[1] is not None)


def test_splits_count_exactly(spark):
    rows, df = _skewed(spark)
    df = df.na.fill("none")
    sizes = Counter(r[1] or "none" for r in rows)
    halves = Counter((r["key"], r["half"]) for r in S.split_halves(df, "id", "key", 1).collect())
    assert all(halves[(k, "A")] == n // 2 and halves[(k, "B")] == n - n // 2 for k, n in sizes.items())
    frac = Counter((r["key"], r["split"]) for r in S.split_frac(df, "id", "key", 0.8, 1).collect())
    assert all(frac[(k, "train")] == max(1, int(n * 0.8)) for k, n in sizes.items())
    fixed = Counter((r["key"], r["split"]) for r in S.split_fixed(df, "id", "key", 10, 1).collect())
    assert all(fixed[(k, "train")] == min(10, n) for k, n in sizes.items())
    capped = Counter(r["key"] for r in S.cap_per_class(df, "id", "key", 8, 1).collect())
    assert capped == {k: min(8, n) for k, n in sizes.items()}
    kept = Counter(r["key"] for r in S.min_support(df, "key", 12).collect())
    assert kept == {k: n for k, n in sizes.items() if n >= 12}
    assert Counter(r["split"] for r in S.split_head(df, "id", 1, least=50).collect()) == {"validation": 60, "train": 540}
    assert S.sample_n(df, "id", 17, 1).count() == 17


def test_leakage_is_found(spark):
    a, b = spark.range(0, 5), spark.range(5, 9)
    S.assert_disjoint({"train": a, "test": b}, "id")
    with pytest.raises(ValueError, match="leakage"):
        S.assert_disjoint({"train": a, "test": spark.range(4, 6)}, "id")


def test_probe_texts_are_dropped(spark):
    df = spark.createDataFrame([(1, "Hello,  World"), (2, "other text")], "id int, text string")
    probe = spark.createDataFrame([("hello world!",)], "text string")
    assert [r["id"] for r in S.drop_probe_overlap(df, probe, "text").collect()] == [2]


def test_pairs_hold_a_margin(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 2 else f"g{i % 14}", round(rng.random() * 20, 3), f"t{i}") for i in range(400)] + [(900, "alone", 1.0, "x")]
    df = spark.createDataFrame(rows, "id int, g string, s double, t string")
    got = {r["g"]: r for r in S.build_pairs(df, "g", "id", "s", "t").collect()}
    groups = defaultdict(list)
    for i, g, s, t in rows:
        groups[g].append((s, -i, t))
    assert "alone" not in got
    for g, cands in groups.items():
        best = max(cands)
        worse = [c for c in cands if best[0] - c[0] >= 3.0]
        if not worse:
            continue
        other, row = max(worse), got[g]
        first, second = (other, best) if row["label"] == "B" else (best, other)
        assert row["text"] == f"A {first[2]} || B {second[2]}"
    assert {r["label"] for r in got.values()} == {"A", "B"}
