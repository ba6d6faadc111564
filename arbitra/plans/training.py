"""Training. Fits on whole texts have no SQL equivalent, so these are checked by row
counts here and by accuracy and optimality in the tests. The ``*_optimum`` queries run the same operators over
two-word texts (language and source of every labelled document), where SQL descends to the same optimum."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbitra.operators import rules as R
from arbitra.operators import train as T
from arbitra.operators.calibrate import calibrate, calibrate_logits
from arbitra.operators.decide import predict
from arbitra.operators.evaluate import ablate, accuracy
from arbitra.operators.splits import split_frac
from arbitra.plans.base import LABELLED, bucket_sql, documents, labelled, query, r6, rounded, table, with_sql
from arbitra.plans.rules import mails
from arbitra.plans.weights import quality_model
from arbitra.session import written


def _halves(spark, sf, rows, label):
    s = written(split_frac(rows, "doc_id", label, 0.8, 7), "split")
    return s.filter("split = 'train'").drop("split"), s.filter("split = 'validation'").drop("split")


def _summary(spark, models, accuracies):
    rows = [
        (m.model_id, len(m.classes), m.n_terms, m.temperature, m.ece_before, m.ece_after, a)
        for m, a in zip(models, accuracies, strict=True)
    ]
    return spark.createDataFrame(
        rows,
        "model_id string, n_classes int, n_terms bigint, temperature double, ece_before double, ece_after double, accuracy double",
    )


def _by_lang(spark, sf):
    return _halves(spark, sf, documents(spark, sf).select("doc_id", "text", "lang"), "lang")


@query("train_hashed")
def q_train_hashed(spark, sf):
    train, held = _by_lang(spark, sf)
    m = calibrate(T.train_hashed(train, "text", "lang"), held, "doc_id", "text", "lang")
    return _summary(spark, [m], [T.model_accuracy(m, held, "doc_id", "text", "lang")])


@query("train_tfidf")
def q_train_tfidf(spark, sf):
    train, held = _halves(spark, sf, labelled(spark, sf).select("doc_id", "text", "truth"), "truth")
    m = calibrate(T.train_tfidf(train, "doc_id", "text", "truth"), held, "doc_id", "text", "truth")
    return _summary(spark, [m], [T.model_accuracy(m, held, "doc_id", "text", "truth")])


@query("train_tfidf_languages")
def q_train_tfidf_languages(spark, sf):
    train, held = _by_lang(spark, sf)
    m = T.train_tfidf(train, "doc_id", "text", "lang", c=8.0)
    m = T.reorder_classes(m, ["fr", "en", "es", "de"])
    m = calibrate(m, held, "doc_id", "text", "lang")
    return _summary(spark, [m], [T.model_accuracy(m, held, "doc_id", "text", "lang")])


@query(
    "reorder_classes",
    "SELECT 'quality' AS model_id, 'poor,good' AS classes, 2 AS n_classes, true AS same_logits",
)
def q_reorder_classes(spark, sf):
    from arbitra.operators.score import score_tfidf

    m = quality_model(spark, sf)
    other = T.reorder_classes(m, ["poor", "good"])
    d = documents(spark, sf)
    a, b = (score_tfidf(d, x, "doc_id", "text") for x in (m, other))
    j = a.join(b.select("doc_id", F.reverse("logits").alias("back")), "doc_id")
    gap = F.array_max(F.transform(F.arrays_zip(F.col("logits").alias("x"), F.col("back").alias("y")), lambda e: F.abs(e["x"] - e["y"])))
    return j.agg(F.max(gap).alias("g")).select(
        F.lit(m.model_id).alias("model_id"), F.lit(",".join(other.classes)).alias("classes"),
        F.lit(len(other.classes)).alias("n_classes"), (F.col("g") < 1e-9).alias("same_logits"),
    )


@query("sweep")
def q_sweep(spark, sf):
    train, held = _halves(spark, sf, labelled(spark, sf).select("doc_id", "text", "truth"), "truth")
    s = T.sweep(train, held, "doc_id", "text", "truth", ngrams=(2, 3), cs=(4.0, 8.0))
    return s.select("n_max", "c", "n_terms", r6("accuracy").alias("accuracy"))


@query("train_questions")
def q_train_questions(spark, sf):
    d = labelled(spark, sf).withColumn("flag", F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))
    rows = d.select(
        "doc_id", "text", F.explode(F.create_map(F.lit("quality"), "truth", F.lit("toxic"), "flag")).alias("question", "label")
    )
    train, held = _halves(spark, sf, rows.withColumn("cell", F.concat_ws("|", "question", "label")), "cell")
    models = T.train_questions(train, held, "question", "doc_id", "text", "label")
    right = T.accuracies(held.withColumnRenamed("question", "model_id"), list(models.values()), "doc_id", "text", "label")
    return _summary(spark, list(models.values()), [right[n] for n in models])


@query("train_mlp")
def q_train_mlp(spark, sf):
    train, held = _by_lang(spark, sf)
    model, classes = T.train_mlp(train, "text", "lang")
    scored = written(T.score_mlp(held, model, "text", ["doc_id", "lang"]), "mlp")
    fit = calibrate_logits(scored, classes, "lang")
    judged = predict(scored, classes, fit["temperature"])
    return rounded(accuracy(judged, "lang"), "accuracy")


@query("train_signals")
def q_train_signals(spark, sf):
    rows = mails(spark, sf).join(labelled(spark, sf).select("doc_id", "lang", "source", "n_chars"), "doc_id")
    train, held = _halves(spark, sf, rows, "label")
    link = F.concat(F.lit("http://"), "lang", F.lit(".example.com/"))
    sender = F.concat("source", F.lit("@"), "lang", F.lit(".example.com"))
    flags = R.signal_flags(sender, F.col("input"), link)
    flags["free_hosting"] = R.flag_hosting(link, ["fr.example.com", "de.example.com"])
    models, untrained = T.train_signals(train, held, flags, "doc_id", "input")
    each = held.withColumn("s", F.explode(F.array(*[F.struct(F.lit(n).alias("model_id"), F.coalesce(c, F.lit(False)).cast("string").alias("truth")) for n, c in flags.items() if n in models])))
    right = T.accuracies(each.select("doc_id", "input", "s.model_id", "s.truth"), list(models.values()), "doc_id", "input", "truth")
    done = _summary(spark, list(models.values()), [right[m] for m in models]).withColumn("reason", F.lit(None).cast("string"))
    skipped = spark.createDataFrame(list(untrained.items()), "model_id string, reason string")
    return done.unionByName(skipped, allowMissingColumns=True)


@query("label_curve")
def q_label_curve(spark, sf):
    train, held = _by_lang(spark, sf)
    return rounded(T.label_curve(train, held, "doc_id", "text", "lang", ks=(8, 16, 32, None)), "accuracy")


@query("ablate")
def q_ablate(spark, sf):
    d = documents(spark, sf).select("doc_id", "text", "lang", "source")
    s = written(split_frac(d, "doc_id", "lang", 0.8, 7), "ablate").withColumnRenamed("text", "body")

    def run(t, name):
        train, held = (t.filter(F.col("split") == x) for x in ("train", "validation"))
        m = T.train_hashed(train, "text", "lang", name)
        return T.scored_accuracy(T.score(held, m, "doc_id", "text", ["lang"]), m, "lang")

    return rounded(ablate(s, {"body": ["body"], "source": ["source"], "all": ["source", "body"]}, run), "accuracy")


# --- the same operators where SQL can find the optimum ------------------------

TIGHT = 1e-9
_TWO_WORDS = "'lang' || lang AS a, 'src' || regexp_replace(lower(coalesce(source, '')), '[^a-z0-9]', '', 'g') AS b"


def _two_words(spark, sf):
    """(doc_id, text, truth, toxic, n_chars, source, lang): labelled documents with a text of two words."""
    source = F.concat(F.lit("src"), F.regexp_replace(F.lower(F.coalesce("source", F.lit(""))), "[^a-z0-9]", ""))
    return labelled(spark, sf).withColumn("text", F.concat_ws(" ", F.concat(F.lit("lang"), "lang"), source))


def optimum_sql(rows: str, steps: int = 2500) -> list[str]:
    """CTEs of the penalised optimum of every model ``m`` in ``rows`` (m, c, a, b, y): texts of the words ``a`` and, unless null, ``b``.

    ``weights`` is (m, term, w) with the intercept under '' and ``patterns`` (m, a, b, z). Rows are counted by pattern; accelerated
    gradient steps of C * sum(loss) + |w|^2 / 2 run as a recursive query over lists.
    """
    return [
        f"rows AS MATERIALIZED ({rows})",
        "nm AS (SELECT m, any_value(c) AS c, count(*) AS n FROM rows GROUP BY m)",
        "tk AS (SELECT m, term, count(*) AS df FROM (SELECT m, a AS term FROM rows UNION ALL SELECT m, b FROM rows WHERE b IS NOT NULL) GROUP BY ALL)",
        "vt AS MATERIALIZED (SELECT m, term, ln((1 + n) / (1 + df)) + 1 AS idf, row_number() OVER (PARTITION BY m ORDER BY term) AS j, count(*) OVER (PARTITION BY m) AS d FROM tk JOIN nm USING (m))",
        "pt AS (SELECT m, a, b, count(*)::DOUBLE AS cnt, sum(y)::DOUBLE AS pos FROM rows GROUP BY ALL)",
        "px AS MATERIALIZED (SELECT pt.m, pt.a, pt.b, cnt, pos, va.d, va.j AS ja, coalesce(vb.j, 0) AS jb, va.idf / sqrt(va.idf * va.idf + coalesce(vb.idf * vb.idf, 0)) AS xa, "
        "coalesce(vb.idf / sqrt(va.idf * va.idf + vb.idf * vb.idf), 0) AS xb FROM pt JOIN vt va ON va.m = pt.m AND va.term = pt.a LEFT JOIN vt vb ON vb.m = pt.m AND vb.term = pt.b)",
        "ml AS (SELECT m, d, list(list_transform(range(1, d + 2), lambda j: CASE WHEN j = ja THEN xa WHEN j = jb THEN xb WHEN j = d + 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) ORDER BY a, b) AS x, "
        "list(cnt ORDER BY a, b) AS cnt, list(pos ORDER BY a, b) AS pos FROM px GROUP BY m, d)",
        "mx AS MATERIALIZED (SELECT ml.*, c, 1 + c * n / 2.0 AS l, list_transform(range(1, d + 2), lambda j: list_transform(x, lambda r: r[j])) AS xt FROM ml JOIN nm USING (m))",
        "fit AS (SELECT m, 0 AS k, list_transform(range(1, d + 2), lambda j: 0.0::DOUBLE) AS w, list_transform(range(1, d + 2), lambda j: 0.0::DOUBLE) AS v FROM mx "
        "UNION ALL SELECT m, k + 1, nw, list_transform(range(1, d + 2), lambda j: nw[j] + (sqrt(l) - 1) / (sqrt(l) + 1) * (nw[j] - w[j])) FROM ("
        "SELECT m, k, d, l, w, list_transform(range(1, d + 2), lambda j: v[j] - (c * list_dot_product(xt[j], r) + CASE WHEN j <= d THEN v[j] ELSE 0 END) / l) AS nw FROM ("
        "SELECT fit.m, k, d, l, c, w, v, xt, list_transform(range(1, len(x) + 1), lambda i: cnt[i] / (1 + exp(-list_dot_product(x[i], v))) - pos[i]) AS r FROM fit JOIN mx USING (m) "
        f"WHERE k < {steps})))",
        f"best AS MATERIALIZED (SELECT m, w FROM fit WHERE k = {steps})",
        "weights AS (SELECT m, term, idf, w[j] AS w FROM best JOIN vt USING (m) UNION ALL SELECT m, '', 0, w[len(w)] FROM best)",
        "patterns AS (SELECT m, a, b, xa * w[ja] + CASE WHEN jb > 0 THEN xb * w[jb] ELSE 0 END + w[len(w)] AS z FROM px JOIN best USING (m))",
    ]


def _optimum(ctes, rows: str, final: str) -> str:
    return with_sql([*ctes, *optimum_sql(rows)], final).replace("WITH ", "WITH RECURSIVE ", 1)


def _signed(models):
    """(model_id, term, w): the coefficients of the second class, the intercept under ''."""
    parts = [m.terms.select(F.lit(m.model_id).alias("model_id"), "term", F.get("coef", F.lit(1)).alias("w")) for m in models]
    spark = parts[0].sparkSession
    parts.append(spark.createDataFrame([(m.model_id, "", m.intercept[1]) for m in models], "model_id string, term string, w double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("model_id", "term", F.round("w", 5).alias("w"))


_WEIGHTS = "SELECT m AS model_id, term, round(w, 5) AS w FROM weights"


@query("train_tfidf_optimum", _optimum([LABELLED], f"SELECT 'tfidf' AS m, 1.0 AS c, {_TWO_WORDS}, (truth = 'poor')::INT AS y FROM labelled", _WEIGHTS))
def q_train_tfidf_optimum(spark, sf):
    return _signed([T.train_tfidf(_two_words(spark, sf), "doc_id", "text", "truth", n_max=1, tol=TIGHT)])


@query(
    "train_questions_optimum",
    _optimum(
        [LABELLED],
        f"SELECT 'quality' AS m, 2.0 AS c, {_TWO_WORDS}, (truth = 'poor')::INT AS y FROM labelled UNION ALL SELECT 'toxic', 2.0, {_TWO_WORDS}, (toxic = 1)::INT FROM labelled WHERE n_chars > 300",
        _WEIGHTS,
    ),
)
def q_train_questions_optimum(spark, sf):
    d = _two_words(spark, sf)
    flag = F.when(F.col("toxic") == 1, "yes").otherwise("no")
    rows = d.select("doc_id", "text", F.lit("quality").alias("question"), F.col("truth").alias("label")).unionByName(
        d.where("n_chars > 300").select("doc_id", "text", F.lit("toxic").alias("question"), flag.alias("label"))
    )
    models = T.train_questions(rows, rows.limit(0), "question", "doc_id", "text", "label", c=2.0, n_max=1, tol=TIGHT)
    return _signed(list(models.values()))


@query(
    "train_signals_optimum",
    _optimum(
        [LABELLED],
        f"SELECT 'long' AS m, 1.0 AS c, {_TWO_WORDS}, (n_chars > 1000)::INT AS y FROM labelled UNION ALL SELECT 'poor', 1.0, {_TWO_WORDS}, (truth = 'poor')::INT FROM labelled",
        _WEIGHTS + " UNION ALL SELECT 'never', 'constant on the training rows', NULL",
    ),
)
def q_train_signals_optimum(spark, sf):
    d = written(_two_words(spark, sf), "two-words")
    signals = {"long": F.col("n_chars") > 1000, "poor": F.col("truth") == "poor", "never": F.lit(None).cast("boolean")}
    models, untrained = T.train_signals(d, d, signals, "doc_id", "text", n_max=1, tol=TIGHT)
    return _signed(list(models.values())).unionByName(spark.createDataFrame([(n, r, None) for n, r in untrained.items()], "model_id string, term string, w double"))


@query(
    "sweep_optimum",
    _optimum(
        [LABELLED],
        f"SELECT c::VARCHAR AS m, c, {_TWO_WORDS}, (truth = 'poor')::INT AS y FROM labelled, (VALUES (0.5::DOUBLE), (4.0::DOUBLE)) AS g(c)",
        "SELECT CAST(1 AS INTEGER) AS n_max, c, CAST(any_value(d) AS BIGINT) AS n_terms, round(avg(((z >= 0)::INT = y)::INT), 6) AS accuracy "
        "FROM rows JOIN patterns USING (m, a, b) JOIN (SELECT DISTINCT m, d FROM vt) USING (m) GROUP BY c",
    ),
)
def q_sweep_optimum(spark, sf):
    d = written(_two_words(spark, sf), "two-words")
    return rounded(T.sweep(d, d, "doc_id", "text", "truth", ngrams=(1,), cs=(0.5, 4.0), tol=TIGHT).drop("fit_sec"), "accuracy")


@query(
    "label_curve_optimum",
    _optimum(
        [LABELLED, "ranked AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY md5('7:' || doc_id), doc_id) AS r FROM labelled)"],
        f"SELECT k AS m, 1.0 AS c, {_TWO_WORDS}, (truth = 'poor')::INT AS y FROM ranked, (VALUES ('8', 8), ('32', 32), ('all', 1000000000)) AS g(k, top) WHERE r <= top",
        f"SELECT m AS k, CAST((SELECT count(*) FROM rows WHERE rows.m = q.m) AS BIGINT) AS n_train, round(avg(((z >= 0)::INT = (truth = 'poor')::INT)::INT), 6) AS accuracy FROM ("
        f"SELECT best.m, truth, coalesce(CASE WHEN va.j IS NULL AND vb.j IS NULL THEN 0 ELSE (coalesce(va.idf * w[va.j], 0) + coalesce(vb.idf * w[vb.j], 0)) / sqrt(coalesce(va.idf * va.idf, 0) + coalesce(vb.idf * vb.idf, 0)) END, 0) + w[len(w)] AS z "
        f"FROM (SELECT truth, {_TWO_WORDS} FROM labelled) t CROSS JOIN best LEFT JOIN vt va ON va.m = best.m AND va.term = t.a LEFT JOIN vt vb ON vb.m = best.m AND vb.term = t.b) q GROUP BY m",
    ),
)
def q_label_curve_optimum(spark, sf):
    d = written(_two_words(spark, sf), "two-words")
    return rounded(T.label_curve(d, d, "doc_id", "text", "truth", ks=(8, 32, None), n_max=1, tol=TIGHT), "accuracy")


_BUCKETS = bucket_sql("term")


@query(
    "train_hashed_optimum",
    # two softmax rows of opposite sign: their common part is one signed row of half the penalty, at twice the margin
    with_sql(
        [
            LABELLED,
            f"tw AS (SELECT {_TWO_WORDS}, (truth = 'poor')::INT AS y FROM labelled)",
            f"bk AS MATERIALIZED (SELECT term, {_BUCKETS} AS bucket FROM (SELECT a AS term FROM tw UNION SELECT b FROM tw))",
            "vt AS (SELECT bucket, row_number() OVER (ORDER BY bucket) AS j, count(*) OVER () AS d FROM (SELECT DISTINCT bucket FROM bk))",
            "px AS (SELECT a, b, any_value(va.j) AS ja, any_value(vb.j) AS jb, any_value(va.d) AS d, count(*)::DOUBLE AS cnt, sum(y)::DOUBLE AS pos FROM tw "
            "JOIN bk ba ON ba.term = a JOIN vt va ON va.bucket = ba.bucket JOIN bk bb ON bb.term = b JOIN vt vb ON vb.bucket = bb.bucket GROUP BY a, b)",
            "mx AS MATERIALIZED (SELECT d, x, cnt, pos, n, list_transform(range(1, d + 2), lambda j: list_transform(x, lambda r: r[j])) AS xt FROM (SELECT d, "
            "list(list_transform(range(1, d + 2), lambda j: CASE WHEN j = d + 1 THEN 1.0::DOUBLE ELSE ((j = ja)::INT + (j = jb)::INT)::DOUBLE END) ORDER BY a, b) AS x, "
            "list(cnt ORDER BY a, b) AS cnt, list(pos ORDER BY a, b) AS pos, sum(cnt) AS n FROM px GROUP BY d))",
            # per row of the mean loss: curvature at most 4 * 5 / 4 + 2 * reg, least curvature 2 * reg
            "fit AS (SELECT 0 AS k, list_transform(range(1, d + 2), lambda j: 0.0::DOUBLE) AS w, list_transform(range(1, d + 2), lambda j: 0.0::DOUBLE) AS v FROM mx "
            "UNION ALL SELECT k + 1, nw, list_transform(range(1, len(nw) + 1), lambda j: nw[j] + (sqrt(5.2) - sqrt(0.2)) / (sqrt(5.2) + sqrt(0.2)) * (nw[j] - w[j])) FROM ("
            "SELECT k, w, list_transform(range(1, d + 2), lambda j: v[j] - (2 * list_dot_product(xt[j], r) / n + CASE WHEN j <= d THEN 0.2 * v[j] ELSE 0 END) / 5.2) AS nw FROM ("
            "SELECT k, w, v, d, n, xt, list_transform(range(1, len(x) + 1), lambda i: cnt[i] / (1 + exp(-2 * list_dot_product(x[i], v))) - pos[i]) AS r FROM fit, mx WHERE k < 2500)))",
            "best AS (SELECT w FROM fit WHERE k = 2500)",
        ],
        "SELECT CAST(bucket AS INTEGER) AS bucket, round(w[j], 5) AS w FROM best, vt",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def q_train_hashed_optimum(spark, sf):
    m = T.train_hashed(_two_words(spark, sf), "text", "truth", reg=0.1, max_iter=500, rel_tol=1e-16)
    return m.terms.where(F.get("coef", F.lit(1)) != 0).select("bucket", F.round(F.get("coef", F.lit(1)), 5).alias("w"))


@query(
    "export_linear",
    _optimum(
        [LABELLED], f"SELECT 'tfidf' AS m, 1.0 AS c, {_TWO_WORDS}, (truth = 'poor')::INT AS y FROM labelled",
        "SELECT term, round(idf, 6) AS idf, round(-w, 5) AS good, round(w, 5) AS poor FROM weights WHERE term <> ''",
    ),
)
def q_export_linear(spark, sf):
    """The mirrored rows of a two-class model, put into another order and back."""
    m = T.train_tfidf(_two_words(spark, sf), "doc_id", "text", "truth", n_max=1, tol=TIGHT)
    m = T.reorder_classes(T.reorder_classes(m, ["poor", "good"]), ["good", "poor"])
    return m.terms.select("term", r6("idf").alias("idf"), F.round(F.get("coef", F.lit(0)), 5).alias("good"), F.round(F.get("coef", F.lit(1)), 5).alias("poor"))
