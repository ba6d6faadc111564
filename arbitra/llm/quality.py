"""Quality rules: text statistics and robust multivariate outliers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.llm.common import WORD, Scratch, let, table, words

# Fixed values of the base rules.
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5
MIN_WORDS = 10

DIMS = 4
# Share of a group that the estimate rests on, and chi-square probability beyond which a document is rejected.
CORE = 0.75
CUT = 0.999
# A start is followed until a step lowers the logarithm of the determinant by no more than this.
STILL = 1e-6
# A group with fewer usable documents joins the other small groups of its language, then of all languages.
MIN_GROUP = 50
# Standard deviation that is added (as variance) to every statistic, so that a constant one does not reject its first exception.
FLOOR = 0.1
# Words and lines of typical text that are added before a ratio is taken: short texts vary more.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_LINES = 50, 5, 5
GRID = 1024
# Groups up to which their estimates are broadcast (200 bytes each). Of more, each is joined under SALTS keys.
BROADCAST_GROUPS = 100_000
SALTS = 32


def _even_chi2(x: float, d: int) -> float:
    """P(chi-square with an even number of degrees of freedom <= x)."""
    term, total = 1.0, 0.0
    for i in range(d // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, d: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _even_chi2(mid, d) < p else (lo, mid)
    return lo


def repeat_words(hashes: Column) -> Column:
    """How many words lie in a window of WINDOW words that occurs twice or more, given the windows' hashes in order."""

    def covered(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        at = F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"]))
        steps = let(at, lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), x - F.get(p, i - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(ordered, covered)).otherwise(0).cast("bigint")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` of the whole text.

    Everything is computed inside the row. A null text has none of anything. Columns of these names are replaced.
    """
    stats = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    names = [c for c in docs.columns if c not in (text, *stats)]
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        *names,
        words(t).alias("__w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("__l"),
        F.length(F.regexp_replace(t, SYMBOLS, "")).cast("bigint").alias("n_symbols"),
    )
    hashed = base.select(
        *names, "n_symbols",
        F.size("__w").cast("bigint").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        F.size("__l").cast("bigint").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
    )
    starts = F.slice("__h", F.lit(1), F.greatest(F.size("__h") - (WINDOW - 1), F.lit(0)))
    windows = hashed.withColumn("__h", F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get("__h", i + k) for k in range(1, WINDOW)])))
    return windows.select(*names, *stats[:5], repeat_words(F.col("__h")).alias("n_repeat_words"))


def vector() -> list[Column]:
    """The statistic vector: logarithm of the mean word length, and square roots of the shares of symbols, repeated lines and
    repeated words. Roots and logarithms bring long tails in; the priors keep short texts near the typical value."""
    n = F.col("n_words") + PRIOR_WORDS
    return [
        F.log((F.col("word_chars") + PRIOR_WORDS * PRIOR_CHARS) / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + PRIOR_LINES)),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


X = [f"__x{i}" for i in range(DIMS)]
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


LOW = [f"l{i}{j}" for i, j in PAIRS]
COV = [f"k{i}{j}" for i, j in PAIRS]
CENTRE = [f"c{i}" for i in range(DIMS)]


def _cholesky(df: DataFrame) -> DataFrame:
    """``df`` with the lower factor ``l**`` of the symmetric positive matrix ``k**`` in its place, one column of the factor after another."""
    for j in range(DIMS):
        rest = lambda i: F.col(f"k{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))  # noqa: B023, E731
        df = df.withColumn(f"l{j}{j}", F.sqrt(rest(j)))
        df = df.withColumns({f"l{i}{j}": rest(i) / F.col(f"l{j}{j}") for i in range(j + 1, DIMS)})
    return df.drop(*COV)


def mahalanobis() -> Column:
    """Squared distance of ``__x*`` from ``c*`` under the factor ``l**``."""
    y: list[Column] = []
    for i in range(DIMS):
        y.append((F.col(X[i]) - F.col(f"c{i}") - sum((F.col(f"l{i}{k}") * y[k] for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def grid(c: Column, steps: int = GRID) -> Column:
    """A value on a fixed grid: an exact percentile then keeps a bounded number of distinct values, whatever the group's size."""
    return F.round(c * steps).cast("bigint")


def join_groups(rows: DataFrame, per: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of the row of ``per`` for their keys. No group of rows meets in one task."""
    if few:
        return rows.join(F.broadcast(per), keys, how)
    salted = per.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.floor(F.rand(7) * SALTS).cast("int")
    return rows.withColumn("__salt", own).join(salted, [*keys, "__salt"], how).drop("__salt")


ESTIMATE = ["start", "logdet", *CENTRE, *LOW]


def _start(number: int, centre: list[Column], cov) -> Column:
    return F.struct(
        F.lit(number).alias("start"), F.lit(None).cast("double").alias("logdet"),
        *[c.alias(n) for c, n in zip(centre, CENTRE, strict=True)], *[cov[p].alias(n) for p, n in zip(PAIRS, COV, strict=True)],
    )


def _sums(group: list[str], rows: DataFrame, d: list[Column], *more: Column) -> DataFrame:
    """Per group ``n``, the sums ``m*`` of ``d`` and ``p**`` of their products, and what else is asked for."""
    sums = [F.sum(d[i]).alias(f"m{i}") for i in range(DIMS)] + [F.sum(d[i] * d[j]).alias(f"p{i}{j}") for i, j in PAIRS]
    return rows.groupBy(*group).agg(F.count("*").alias("n"), *sums, *more)


def _moments() -> tuple[list[Column], dict[tuple[int, int], Column]]:
    mean = [F.col(f"m{i}") / F.col("n") for i in range(DIMS)]
    return mean, {(i, j): F.col(f"p{i}{j}") / F.col("n") - mean[i] * mean[j] for i, j in PAIRS}


def _starts(rows: DataFrame, group: str, scratch: Scratch, few: bool) -> DataFrame:
    """Three first estimates of each group, with a null ``logdet``: medians and median deviations alone, the same with the
    correlations of the values' hyperbolic tangents, and the mean and covariance of all rows."""
    mid = rows.groupBy(group).agg(*[(F.percentile(grid(F.col(x)), 0.5) / GRID).alias(f"c{i}") for i, x in enumerate(X)])
    mid = scratch.write(mid, "mcd")
    off = join_groups(rows, mid, [group], few).groupBy(group, *CENTRE).agg(
        *[(F.percentile(grid(F.abs(F.col(x) - F.col(f"c{i}"))), 0.5) / GRID).alias(f"s{i}") for i, x in enumerate(X)]
    )
    wide = [F.sqrt(F.pow(F.col(f"s{i}") * 1.4826, 2) + FLOOR**2).alias(f"s{i}") for i in range(DIMS)]
    off = scratch.write(off.select(group, *CENTRE, *wide), "mcd")
    d = [F.col(x) - F.col(f"c{i}") for i, x in enumerate(X)]
    held = [F.max(c).alias(c) for c in [*CENTRE, *[f"s{i}" for i in range(DIMS)]]]
    own = join_groups(rows, off, [group], few)
    plain = _sums([group], own, d, *held)
    bent = _sums([group], own, [F.tanh(d[i] / F.col(f"s{i}")) for i in range(DIMS)])
    mean, cov = _moments()
    plain = plain.select(group, *CENTRE, *[f"s{i}" for i in range(DIMS)], *[m.alias(f"a{i}") for i, m in enumerate(mean)], *[cov[p].alias(f"v{p[0]}{p[1]}") for p in PAIRS])
    bent = bent.select(group, *[(cov[p] + (1e-3 if p[0] == p[1] else 0.0)).alias(f"t{p[0]}{p[1]}") for p in PAIRS])
    s = [F.col(f"s{i}") for i in range(DIMS)]
    diagonal = {(i, j): s[i] * s[i] if i == j else F.lit(0.0) for i, j in PAIRS}
    tanh = {(i, j): s[i] * s[j] * F.col(f"t{i}{j}") / F.sqrt(F.col(f"t{i}{i}") * F.col(f"t{j}{j}")) for i, j in PAIRS}
    every = {(i, j): F.col(f"v{i}{j}") + (FLOOR**2 if i == j else 0.0) for i, j in PAIRS}
    centre = [F.col(c) for c in CENTRE]
    three = [_start(0, centre, diagonal), _start(1, centre, tanh), _start(2, [c + F.col(f"a{i}") for i, c in enumerate(centre)], every)]
    return scratch.write(_cholesky(plain.join(bent, group).select(group, F.inline(F.array(*three)))), "mcd")


def _concentrate(rows: DataFrame, est: DataFrame, group: str, few: bool) -> DataFrame:
    """One concentration step of every row of ``est``; ``before`` is the ``logdet`` it comes from."""
    q = chi2_quantile(CORE, DIMS)
    scale = CORE / _even_chi2(q, DIMS + 2)
    keys = [group, "start"]
    near = join_groups(rows, est, [group], few).withColumn("__b", F.floor(F.log1p(mahalanobis()) * 256))
    limit = near.groupBy(*keys).agg(F.percentile("__b", CORE).alias("__q"))
    core = join_groups(near, limit, keys, few).where("__b <= __q")
    d = [F.col(x) - F.col(c) for x, c in zip(X, CENTRE, strict=True)]
    sums = _sums(keys, core, d, *[F.max(c).alias(c) for c in CENTRE], F.max("logdet").alias("before"))
    mean, cov = _moments()
    centre = [(F.col(c) + m).alias(c) for c, m in zip(CENTRE, mean, strict=True)]
    matrix = [(cov[i, j] * scale + (FLOOR**2 if i == j else 0.0)).alias(f"k{i}{j}") for i, j in PAIRS]
    logdet = sum((2 * F.log(f"l{i}{i}") for i in range(1, DIMS)), 2 * F.log("l00"))
    return _cholesky(sums.select(*keys, *centre, *matrix, "before")).select(*keys, logdet.alias("logdet"), *CENTRE, *LOW, "before")


def fit_mcd(rows: DataFrame, group: str, scratch: Scratch, few: bool = False) -> DataFrame:
    """Per group: ``logdet``, ``c*``, ``l**`` (log-determinant, centre and Cholesky factor of the minimum-covariance-determinant estimate).

    From each of three starts, concentration steps take the CORE share with the smallest distance and re-estimate from it, until
    the determinant no longer falls by more than STILL; starts that have ended take no part in later steps. As every step must lower the
    determinant, which FLOOR bounds below, the steps end. The smallest determinant of all starts and steps wins, the first start on a tie.
    A step is two aggregations of a few numbers per group, so a group of any size is summed where it lies. ``few``: the groups are
    known to be BROADCAST_GROUPS at most. FLOOR squared is added to the variances, and the covariance is scaled to be
    consistent for normal data.
    """
    open_, tried = _starts(rows, group, scratch, few), []
    while True:
        new = scratch.write(_concentrate(rows, open_, group, few), "mcd")
        tried.append(new.select(group, *ESTIMATE))
        open_ = new.where(F.col("before").isNull() | (F.col("logdet") < F.col("before") - STILL)).drop("before")
        if open_.isEmpty():
            break
    every = tried[0]
    for t in tried[1:]:
        every = every.unionAll(t)
    best = every.groupBy(group).agg(F.min(F.struct("logdet", "start", *CENTRE, *LOW)).alias("e"))
    return scratch.write(best.select(group, *[F.col(f"e.{c}").alias(c) for c in ["logdet", *CENTRE, *LOW]]), "mcd")


def judge(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", cut: float = CUT) -> DataFrame:
    """Columns of ``docs`` but the text, the statistics, ``base_failed``, ``distance`` (squared) and ``kept``.

    A document that fails the base rules (fewer than MIN_WORDS words, or repeated words above a fifth) is not kept and takes no part in
    the estimates. The others are kept unless their squared Mahalanobis distance within their language and source exceeds the
    chi-square quantile ``cut``. Null languages and sources count as empty ones. With fewer than MIN_GROUP usable documents in all that is pooled,
    nothing is rejected and the distance is null. Columns of those names are replaced; repeated rows are judged alike.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    out = ["base_failed", "distance", "kept"]
    docs = docs.drop(*[c for c in out if c in docs.columns])
    lg, sc = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source))
    rows = statistics(docs.withColumns({"__lang": lg, "__source": sc}), text)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    rows = scratch.write(rows.withColumn("base_failed", failed).withColumns(dict(zip(X, vector(), strict=True))), "stats")
    names = [c for c in rows.columns if not c.startswith("__")]
    sizes = rows.where("NOT base_failed").groupBy("__lang", "__source").agg(F.count("*").alias("__n"))
    sizes = scratch.write(sizes, "sizes")
    few = sizes.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    small = sizes.where(F.col("__n") < MIN_GROUP)
    by_lang = small.groupBy("__lang").agg(F.sum("__n").alias("__nl"))
    own = F.concat(F.lit("source"), F.lit("\0"), "__lang", F.lit("\0"), "__source")
    level = F.when(F.col("__n") >= MIN_GROUP, own).when(F.col("__nl") >= MIN_GROUP, F.concat(F.lit("lang\0"), "__lang")).otherwise("all")
    groups = sizes.join(by_lang, "__lang", "left").select("__lang", "__source", level.alias("__group"))
    rows = join_groups(rows, groups, ["__lang", "__source"], few, "left").withColumn("__group", F.coalesce("__group", F.lit("all")))
    fit = rows.where("NOT base_failed").select("__group", *X)
    enough = fit.groupBy("__group").count().where(F.col("count") >= MIN_GROUP).select("__group")
    est = fit_mcd(scratch.write(join_groups(fit, enough, ["__group"], few), "vectors"), "__group", scratch, few)
    done = join_groups(rows, est, ["__group"], few, "left").withColumn("distance", mahalanobis())
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= chi2_quantile(cut, DIMS)))
    return done.select(*names, "distance", kept.alias("kept"))


def op10_mcd_outliers(spark, sf: str) -> DataFrame:
    """All documents judged by the base rules and the robust outlier test."""
    return judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 6).alias("distance")
    )
