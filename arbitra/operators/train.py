"""Training linear models, many in one run, and one-hidden-layer models with MLlib."""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from arbitra.functions import prob as P
from arbitra.functions.text import N_BUCKETS
from arbitra.operators import bags
from arbitra.operators.calibrate import calibrate_logits, ece, judged
from arbitra.operators.features import bucketed
from arbitra.operators.model import LinearModel
from arbitra.operators.optimise import Setting, fit_columns, fit_hidden, fit_rows, fits_by_rows, hidden_logits
from arbitra.operators.score import score, score_models
from arbitra.session import exists, remove, scratch_dir, written

# The driver holds the dense coefficients of a hidden layer in about 40 vectors, each task one and a gradient.
MAX_COEFFICIENTS = 100_000_000
L2 = 1e-5
# MLlib's default: a fit ends when a step improves the loss by no more than this share.
MLP_TOL = 1e-6
# More distinct labels than this are an error, found before they reach the driver.
MAX_CLASSES = 10_000


def class_names(df: DataFrame, label: str) -> tuple[str, ...]:
    """Sorted distinct labels; an error when there are fewer than two or more than MAX_CLASSES."""
    rows = df.select(label).distinct().limit(MAX_CLASSES + 1).collect()
    if not rows:
        raise ValueError("train: no examples provided")
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"train: more than {MAX_CLASSES} distinct labels")
    names = sorted((r[0] for r in rows if r[0] is not None), key=lambda s: s.encode())
    if len(rows) != len(names):
        raise ValueError("train: a label is null")
    if len(names) < 2:
        raise ValueError("train: need at least 2 distinct labels")
    return tuple(names)


def label_index(df: DataFrame, label: str) -> DataFrame:
    """(label, idx): distinct labels numbered in sorted order."""
    names = class_names(df, label)
    return df.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), f"{label} string, idx int")


def _target(classes: Sequence[str], label: str):
    return (F.array_position(P.array_literal(classes), F.col(label)) - 1).cast("double").alias("target")


def _check_size(n_features: int, n_classes: int) -> None:
    if n_features * n_classes > MAX_COEFFICIENTS:
        raise ValueError(
            f"{n_features} features x {n_classes} hidden units exceed {MAX_COEFFICIENTS} coefficients"
        )


def export_linear(model: LogisticRegressionModel, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients with one row per class. A single signed row ``w`` becomes
    ``[-w, +w]`` and its intercept ``[-b, +b]``."""
    w, b = model.coefficientMatrix.toArray(), np.asarray(model.interceptVector.toArray())
    if w.shape[0] == 1:
        return np.vstack([-w[0], w[0]]), np.array([-b[0], b[0]])
    if w.shape[0] != n_classes:
        raise ValueError(f"model has {w.shape[0]} coefficient rows for {n_classes} classes")
    return w, b


def reorder_classes(model: LinearModel, order: Sequence[str]) -> LinearModel:
    """The same model with its classes in another order."""
    if sorted(order) != sorted(model.classes):
        raise ValueError(f"classes {list(order)} are not {list(model.classes)}")
    at = [model.classes.index(c) for c in order]
    coef = F.array(*[F.get("coef", F.lit(i)) for i in at])
    return model.with_(
        classes=tuple(order), intercept=tuple(model.intercept[i] for i in at), terms=model.terms.withColumn("coef", coef)
    )


@dataclass(frozen=True)
class Task:
    """One linear model of a joint fit; ``reg`` is the L2 penalty beside the mean loss, ``c`` weighs the summed loss beside the penalty.

    ``tol`` and ``rel_tol`` end the fit as in ``optimise.Setting``.
    """

    model_id: str
    classes: tuple[str, ...]
    c: float | None = 1.0
    reg: float | None = None
    n_max: int = 2
    max_iter: int = 200
    tol: float | None = None
    rel_tol: float | None = None


def member(task: int, target: Column) -> Column:
    """A row's part in one model of a joint fit: the model's place and the number of the row's class."""
    return F.struct(F.lit(task).alias("model"), target.cast("int").alias("target"))


def _texts(df: DataFrame, members: Column, text_col: str, tasks: Sequence[Task]) -> tuple[DataFrame, list[int]]:
    """``(base, members, idx, n)``: every text read and counted once, whatever the number of models; and rows per model."""
    named = df.select(members.alias("members"), F.col(text_col).alias("_t")).where(F.size("members") > 0)
    made = bucketed(named, "_t", ["members"])
    texts = written(made.withColumn("base", F.monotonically_increasing_id()), "texts")
    sizes = {r["model"]: r["n"] for r in texts.select(F.explode("members.model").alias("model")).groupBy("model").agg(F.count("*").alias("n")).collect()}
    missing = [t.model_id for i, t in enumerate(tasks) if not sizes.get(i)]
    if missing:
        raise ValueError(f"train: no examples provided for {missing}")
    return texts, [sizes[i] for i in range(len(tasks))]


def _each_member(texts: DataFrame, n_tasks: int) -> DataFrame:
    """One row per text and model; ``row`` identifies it."""
    rows = texts.select("base", F.explode("members").alias("m"), "idx", "n")
    return rows.select((F.col("base") * n_tasks + F.col("m.model")).alias("row"), F.col("m.model").alias("model"), F.col("m.target").alias("target"), "idx", "n")


def _width(task: Task, kind: str) -> int:
    """Two classes of a TF-IDF model are one signed row; all others have one row per class."""
    return 1 if kind == "tfidf" and len(task.classes) == 2 else len(task.classes)


def _setting(t: Task, n_rows: int, kind: str, tol: float, rel_tol: float | None) -> Setting:
    reg = t.reg if t.reg is not None else 1 / (n_rows * t.c)
    return Setting(_width(t, kind), n_rows, reg, t.max_iter, tol if t.tol is None else t.tol, rel_tol if t.rel_tol is None else t.rel_tol)


def _models(coefs: DataFrame, tasks: Sequence[Task], intercepts: np.ndarray, kind: str, key: Sequence[str]) -> list[LinearModel]:
    """One model per task from ``(model, key, w)``; the signed column of two classes is mirrored."""
    spark = coefs.sparkSession
    mirrored = F.array(-F.get("w", F.lit(0)), F.get("w", F.lit(0)))
    width = F.get(F.array(*[F.lit(_width(t, kind)) for t in tasks]), F.col("model"))
    coef = F.when(width == 1, mirrored).otherwise(F.slice("w", F.lit(1), width)).alias("coef")
    path = scratch_dir(spark, f"{kind}-models")
    coefs.select("model", *key, coef).write.partitionBy("model").parquet(path)
    stored = spark.read.parquet(path)
    counts = {r["model"]: r["count"] for r in stored.groupBy("model").count().collect()}
    out = []
    for i, t in enumerate(tasks):
        b = [float(v) for v in intercepts[i]]
        b = [-b[0], b[0]] if _width(t, kind) == 1 else b[: len(t.classes)]
        terms = stored.where(F.col("model") == i).select(*key, "coef")
        out.append(LinearModel(t.model_id, kind, tuple(t.classes), tuple(b), terms, counts.get(i, 0), n_max=t.n_max))
    return out


def fit_hashed(df: DataFrame, text_col: str, tasks: Sequence[Task], members: Column) -> list[LinearModel]:
    """Models on hashed term counts, all in one run over texts that are counted once.

    ``members`` is an array of ``member`` values: the models a row trains, and its class in each.
    """
    texts, sizes = _texts(df, members, text_col, tasks)
    idx = F.transform("idx", lambda i: (F.col("model") * N_BUCKETS + i).cast("bigint"))
    x = F.col("n").cast("array<double>")
    rows = written(_each_member(texts, len(tasks)).select("row", "model", "target", idx.alias("idx"), x.alias("x"), F.lit(0.0).alias("own")), "train-rows")
    spark = df.sparkSession
    columns = spark.range(len(tasks) * N_BUCKETS).select(F.floor(F.col("id") / N_BUCKETS).cast("int").alias("model"), F.col("id").alias("idx"))
    settings = [_setting(t, n, "hashed", 1e-6, 1e-7) for t, n in zip(tasks, sizes, strict=True)]
    found, b = fit_rows(rows, settings, columns, len(tasks) * N_BUCKETS)
    # buckets that no row holds have no coefficient in tables
    nothing = F.array_repeat(F.lit(0.0), max(s.width for s in settings))
    every = columns.join(found.select(F.col("col").alias("idx"), "w"), "idx", "left").select(
        "model", F.pmod("idx", F.lit(N_BUCKETS)).cast("int").alias("bucket"), F.coalesce("w", nothing).alias("w")
    )
    return _models(every, tasks, b, "hashed", ["bucket"])


def train_hashed(
    df: DataFrame, text_col: str, label: str, model_id: str = "hashed", reg: float = L2, max_iter: int = 100, rel_tol: float | None = None
) -> LinearModel:
    """Multinomial logistic regression on hashed term counts.

    The features are row-local. ECE on the training rows is stored until the model is calibrated.
    """
    classes = class_names(df, label)
    task = Task(model_id, classes, None, reg, max_iter=max_iter, tol=None if rel_tol is None else 0.0, rel_tol=rel_tol)
    (model,) = fit_hashed(df, text_col, [task], F.array(member(0, _target(classes, label))))
    rows = df.select(text_col, label).withColumn("_row", F.monotonically_increasing_id())
    seen = score(rows, model, "_row", text_col, [label])
    before = ece(judged(seen, classes, 1.0, label)).first()["ece"]
    return model.with_(ece_before=before, ece_split="train")


def fit_tfidf(
    df: DataFrame, text_col: str, tasks: Sequence[Task], members: Column, min_df: int = 1, views: Sequence[tuple[int, int]] | None = None
) -> list[LinearModel]:
    """TF-IDF models, all in one run over texts that are read once; each has the vocabulary and idf of its own rows.

    Terms that one row of a model holds act together: at the optimum their coefficients are in proportion to their values, so
    they are fitted as one column of that row and spread over the terms afterwards, which changes nothing in the result.
    ``members`` is as in ``fit_hashed``, or names views: models that have the same rows and ``n_max`` share their n-grams. ``views`` then gives
    each model's view and the place of its class number in the member's array.
    """
    views = views or [(i, 0) for i in range(len(tasks))]
    n_views = 1 + max(v for v, _ in views)
    longest = [next(t.n_max for t, (w, _) in zip(tasks, views, strict=True) if w == v) for v in range(n_views)]
    lanes = [[(i, j) for i, (w, j) in enumerate(views) if w == v] for v in range(n_views)]
    texts, texts_path = _stored(bags.read_texts(df, text_col, members).withColumn("chunk", F.monotonically_increasing_id()), "texts")
    sizes = {r[0]: r[1] for r in texts.select(F.inline("views")).groupBy("view").agg(F.sum("n")).collect()}
    missing = [t.model_id for t, (v, _) in zip(tasks, views, strict=True) if not sizes.get(v)]
    if missing:
        raise ValueError(f"train: no examples provided for {missing}")
    n_rows = [sizes[v] for v in range(n_views)]
    offsets, n_members, singles = {}, 0, min_df <= 1
    for r in texts.select("chunk", F.aggregate("views", F.lit(0).cast("bigint"), lambda s, v: s + v["n"]).alias("n")).collect():
        offsets[r["chunk"]] = n_members
        n_members += r["n"]
    parts = len(offsets)
    answers = bags.columns_of(texts, longest, parts, max(min_df, 2))
    held = {r[0]: (r[1], r[2] if singles else 0) for r in answers.select(F.inline("terms")).groupBy("view").agg(F.sum("shared"), F.sum("single")).collect()}
    held = [held.get(v, (0, 0)) for v in range(n_views)]
    if not any(a + b for a, b in held):
        raise ValueError("train: no terms")
    settings = [_setting(t, n_rows[v], "tfidf", 1e-5, None) for t, (v, _) in zip(tasks, views, strict=True)]
    width, each = max(s.width for s in settings), [v for v, _ in views]
    if fits_by_rows(sum(held[v][0] for v in each), sum(n_rows[v] for v in each), width, any(b for _, b in held)):
        path = scratch_dir(df.sparkSession, "train-rows")
        bags.column_lists(texts, answers, longest, n_rows, parts, singles).write.partitionBy("kind").parquet(path)
        return _fit_columns(df.sparkSession, path, answers, tasks, views, settings, n_rows, held, offsets, texts_path)
    first, at = {}, 0
    for r in answers.where("chunk = -1").select("bucket", F.aggregate("terms", F.lit(0).cast("bigint"), lambda s, t: s + t["shared"]).alias("n")).collect():
        first[r["bucket"]] = at
        at += r["n"]
    rows = written(bags.row_lists(texts, answers, longest, n_rows, parts, singles, offsets, first, lanes), "train-rows")
    vocab = written(bags.vocabulary(answers, first, n_rows, lanes), "vocab")
    numbers = [len(x) for x in lanes]
    if max(numbers) > 1:  # models of one view have columns of their own here
        rows = rows.withColumn("idx", F.transform("idx", lambda i: i * len(tasks) + F.col("model")))
        vocab = vocab.withColumn("idx", F.col("idx") * len(tasks) + F.col("model"))
        at *= len(tasks)
    found, b = fit_rows(rows, settings, vocab.select("model", "idx"), at)
    found = found.select("model", "col", "w")
    alone = F.get(F.array(*[F.lit(float(np.log((1 + n_rows[v]) / 2) + 1)) for v in each]), F.col("model"))  # idf of a term of one row
    shared = vocab.join(found.select("model", F.col("col").alias("idx"), "w"), ["model", "idx"]).select("model", "term", "idf", "w")
    own = rows.where("own > 0").select("model", (-1 - F.col("row")).alias("col"), F.explode("singles").alias("s")).join(found, ["model", "col"])
    spread = own.select("model", F.col("s.term").alias("term"), alone.alias("idf"), F.transform("w", lambda v: v * F.col("s.share")).alias("w"))
    return _models(shared.unionAll(spread), tasks, b, "tfidf", ["term", "idf"])


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    out = written(df, name)
    return out, out.inputFiles()[0].rsplit("/", 1)[0] if out.inputFiles() else ""


def _fit_columns(spark, path: str, answers: DataFrame, tasks, views, settings, n_rows, held, offsets: dict[int, int], texts_path: str) -> list[LinearModel]:
    """The models of ``fit_tfidf`` where the driver keeps one value per row; their terms are made from the stored columns when they are read."""
    lists, told, alone = (spark.read.schema("chunk bigint, bucket int, data binary").parquet(f"{path}/kind={k}") if exists(spark, f"{path}/kind={k}") else None for k in range(3))
    known = [bags.unpack(r["data"]) for r in sorted(told.select("chunk", "data").collect(), key=lambda r: offsets[r["chunk"]])]
    view, targets, sizes, norm, own = (np.concatenate(c) for c in zip(*known, strict=True))
    sizes = sizes.astype(np.int64)
    rows = {"view": view.astype(np.int64), "targets": targets.astype(np.int64), "first": np.cumsum(sizes) - sizes, "norm": norm, "own": own}
    if lists is None:
        lists = told.limit(0)
    blocks = written(bags.column_blocks(lists, answers, offsets), "column-blocks")
    for done in (texts_path, f"{path}/kind=0"):  # nothing reads them any more
        remove(spark, done)
    found, start, b = fit_columns(blocks, settings, [v for v, _ in views], [j for _, j in views], rows, n_rows)
    sent = spark.sparkContext.broadcast(found)
    out = []
    for i, (t, (v, _)) in enumerate(zip(tasks, views, strict=True)):
        lane = slice(start[i], start[i] + settings[i].width)
        terms = bags.shared_terms(blocks, sent, v, lane, n_rows)
        if held[v][1]:
            terms = terms.unionAll(bags.single_terms(alone, sent, rows["view"], offsets, v, lane, n_rows[v]))
        w = [float(x) for x in b[i]]
        w = [-w[0], w[0]] if settings[i].width == 1 else w[: len(t.classes)]
        out.append(LinearModel(t.model_id, "tfidf", tuple(t.classes), tuple(w), terms, sum(held[v]), n_max=t.n_max))
    return out


def train_tfidf(
    df: DataFrame,
    id_col: str,
    text_col: str,
    label: str,
    c: float = 1.0,
    n_max: int = 2,
    min_df: int = 1,
    model_id: str = "tfidf",
    max_iter: int = 200,
    tol: float | None = None,
) -> LinearModel:
    """TF-IDF n-grams with L2 logistic regression of strength ``c``.

    Two classes are fitted as one signed row and mirrored, so their logits are
    ``[-d, +d]``; calibrate before reading probabilities.
    """
    classes = class_names(df, label)
    task = Task(model_id, classes, c, n_max=n_max, max_iter=max_iter, tol=tol)
    return fit_tfidf(df, text_col, [task], F.array(member(0, _target(classes, label))), min_df)[0]


def model_accuracy(model: LinearModel, df: DataFrame, id_col: str, text_col: str, label: str) -> float:
    scored = score(df, model, id_col, text_col, [label])
    return scored_accuracy(scored, model, label).first()["accuracy"]


def scored_accuracy(scored: DataFrame, model: LinearModel, label: str) -> DataFrame:
    return judged(scored, model.classes, model.temperature, label).agg(
        F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy")
    )


def accuracies(df: DataFrame, models: Sequence[LinearModel], id_col: str, text_col: str, label: str) -> dict[str, float]:
    """Accuracy of each model on the rows that name it in ``model_id``, scored in one run."""
    names = F.create_map(*[v for m in models for v in (F.lit(m.model_id), P.array_literal(m.classes))])
    scored = score_models(df, models, id_col, text_col, [label])
    said = F.get(F.element_at(names, F.col("model_id")), P.argmax_last(F.col("logits")))
    judged_ = scored.groupBy("model_id").agg(F.avg((said == F.col(label)).cast("double")).alias("accuracy"))
    found = {r["model_id"]: r["accuracy"] for r in judged_.collect()}
    return {m.model_id: found.get(m.model_id) for m in models}


def sweep(
    train: DataFrame,
    validation: DataFrame,
    id_col: str,
    text_col: str,
    label: str,
    ngrams: Iterable[int] = (2, 3),
    cs: Iterable[float] = (4.0, 8.0),
    max_iter: int = 200,
    min_df: int = 1,
    tol: float | None = None,
) -> DataFrame:
    """(n_max, c, n_terms, fit_sec, accuracy) over the grid, fitted in one run; ``fit_sec`` is a model's share of its time."""
    classes = class_names(train, label)
    grid = [(n, float(c)) for n in ngrams for c in cs]
    tasks = [Task(f"n{n}-c{c}", classes, c, n_max=n, max_iter=max_iter, tol=tol) for n, c in grid]
    start = time.perf_counter()
    lengths = sorted({t.n_max for t in tasks})  # models of one length differ in their penalty alone
    members = F.array(*[member(i, _target(classes, label)) for i in range(len(lengths))])
    models = fit_tfidf(train, text_col, tasks, members, min_df, [(lengths.index(t.n_max), 0) for t in tasks])
    took = (time.perf_counter() - start) / len(tasks)
    held = validation.select(id_col, text_col, label, F.explode(F.array(*[F.lit(m.model_id) for m in models])).alias("model_id"))
    right = accuracies(held, models, id_col, text_col, label)
    rows = [(n, c, m.n_terms, took, right[m.model_id]) for (n, c), m in zip(grid, models, strict=True)]
    return train.sparkSession.createDataFrame(rows, "n_max int, c double, n_terms bigint, fit_sec double, accuracy double")


def labels_covered(train: DataFrame, validation: DataFrame, label: str) -> bool:
    """Whether every validation label was seen in training."""
    unseen = validation.select(label).distinct().join(train.select(label).distinct(), label, "left_anti")
    return unseen.isEmpty()


def train_questions(
    train: DataFrame,
    validation: DataFrame,
    question: str,
    id_col: str,
    text_col: str,
    label: str,
    kind: str = "tfidf",
    **options,
) -> dict[str, LinearModel]:
    """One model per value of the question column, calibrated where every
    validation label was seen in training and there are validation rows.

    All questions are fitted in one run: texts are read and counted once, and every step of the optimiser is one pass for all of
    them. Held-out rows are scored in one run as well.
    """
    pairs = train.select(question, label).where(F.col(question).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(pairs) > MAX_CLASSES:
        raise ValueError(f"train: more than {MAX_CLASSES} distinct questions and labels")
    seen: dict[str, set] = {}
    for name, value in pairs:
        seen.setdefault(name, set()).add(value)
    tasks = []
    options = dict(options)
    min_df = options.pop("min_df", 1)
    for name in sorted(seen):
        if None in seen[name]:
            raise ValueError(f"train: a label of {name!r} is null")
        if len(seen[name]) < 2:
            raise ValueError(f"train: need at least 2 distinct labels for {name!r}")
        if kind == "hashed":
            options = {"c": None, "reg": L2, "max_iter": 100} | options
        tasks.append(Task(name, tuple(sorted(seen[name], key=lambda v: v.encode())), **options))
    known = train.sparkSession.createDataFrame(
        [(t.model_id, v, i, j) for i, t in enumerate(tasks) for j, v in enumerate(t.classes)], "_question string, _label string, _model int, _target int"
    )
    rows = train.join(F.broadcast(known), (F.col(question) == F.col("_question")) & (F.col(label) == F.col("_label")))
    members = F.array(F.struct(F.col("_model").alias("model"), F.col("_target").alias("target")))
    models = fit_hashed(rows, text_col, tasks, members) if kind == "hashed" else fit_tfidf(rows, text_col, tasks, members, min_df)
    held = validation.select(F.col(question).alias("model_id"), label).distinct().limit(2 * MAX_CLASSES).collect()
    asked = {m.model_id: {r[1] for r in held if r[0] == m.model_id} for m in models}
    fit = [m for m in models if asked[m.model_id] and asked[m.model_id] <= set(m.classes)]
    scored = None
    if fit:
        tagged = validation.select(id_col, text_col, label, F.col(question).alias("model_id")).where(F.col("model_id").isin([m.model_id for m in fit]))
        scored = written(score_models(tagged, fit, id_col, text_col, [label]), "questions")
    out = {m.model_id: m for m in models}
    for m in fit:
        mine = scored.where(F.col("model_id") == m.model_id)
        out[m.model_id] = m.with_(**calibrate_logits(mine, m.classes, label), ece_split="validation")
    return out


def train_mlp(
    df: DataFrame, text_col: str, label: str, hidden: int = 256, max_iter: int = 100, seed: int = 0
) -> tuple[MultilayerPerceptronClassificationModel, tuple[str, ...]]:
    """One hidden layer over hashed term counts; returns the MLlib model and its
    class names.

    MLlib's own fit stacks rows as dense blocks (131 KB a row). Here rows stay sparse: from MLlib's first weights, the same
    sigmoid and softmax layers are fitted by L-BFGS over stored blocks, and MLlib gets the weights.
    """
    classes = class_names(df, label)
    _check_size(N_BUCKETS, hidden)
    layers = [N_BUCKETS, hidden, len(classes)]
    one = df.sparkSession.createDataFrame([(0.0, Vectors.sparse(N_BUCKETS, []))], ["target", "features"])
    mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol="target", layers=layers, maxIter=0, seed=seed)
    rows = bucketed(df, text_col, [_target(classes, label)]).select(
        F.monotonically_increasing_id().alias("row"), F.lit(0).alias("model"), F.col("target").cast("int").alias("target"),
        F.col("idx").cast("array<bigint>").alias("idx"), F.col("n").cast("array<double>").alias("x"), F.lit(0.0).alias("own"),
    )
    weights = fit_hidden(written(rows, "hidden-rows"), layers, mlp.fit(one).weights.toArray(), max_iter, MLP_TOL)
    return mlp.setInitialWeights(Vectors.dense(weights)).fit(one), classes


def score_mlp(
    df: DataFrame, model: MultilayerPerceptronClassificationModel, text_col: str, keep: Sequence[str]
) -> DataFrame:
    """(keep, logits) of the hidden-layer model."""
    layers, weights = list(model.getLayers()), df.sparkSession.sparkContext.broadcast(model.weights.toArray())

    def run(batches):
        for batch in batches:
            idx, n = (batch.column(len(keep) + i).flatten().to_numpy(zero_copy_only=False) for i in range(2))
            ends = np.concatenate([[0], np.cumsum(batch.column(len(keep)).value_lengths().to_numpy(zero_copy_only=False))])
            z = hidden_logits(weights.value, layers, ends, idx, n.astype(float))
            at = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.ListArray.from_arrays(at, pa.array(z.ravel()))], names=[*keep, "logits"])

    counted = bucketed(df, text_col, list(keep))
    logits = StructField("logits", ArrayType(DoubleType()))
    return counted.mapInArrow(run, StructType([*counted.select(*keep).schema.fields, logits]))


def train_signals(
    train: DataFrame,
    validation: DataFrame,
    signals: Mapping[str, object],
    id_col: str,
    text_col: str,
    **options,
) -> tuple[dict[str, LinearModel], dict[str, str]]:
    """One calibrated true/false model per rule signal, all fitted in one run, and the signals without a model with the reason.

    ``signals`` maps a name to the boolean column that labels it (null counts as
    false). A signal that is constant on the training rows cannot be trained.
    """
    flag = {n: F.coalesce(c, F.lit(False)) for n, c in signals.items()}
    present = train.agg(*[F.count_distinct(c).alias(n) for n, c in flag.items()]).first()
    reasons = {n: "no training rows" if present[n] == 0 else "constant on the training rows" for n in signals if present[n] < 2}
    flag = {n: c for n, c in flag.items() if n not in reasons}
    if not flag:
        return {}, reasons
    options = dict(options)
    min_df = options.pop("min_df", 1)
    tasks = [Task(n, ("false", "true"), **options) for n in flag]
    # all signals have the same rows and n-grams and differ in their labels alone
    members = F.array(F.struct(F.lit(0).alias("model"), F.array(*[c.cast("int") for c in flag.values()]).alias("target")))
    models = fit_tfidf(train, text_col, tasks, members, min_df, [(0, i) for i in range(len(tasks))])
    labels = F.explode(F.array(*[F.struct(F.lit(n).alias("model_id"), c.cast("string").alias("label")) for n, c in flag.items()]))
    held = validation.select(F.col(id_col), F.col(text_col), labels.alias("s")).select(id_col, text_col, "s.model_id", "s.label")
    scored = written(score_models(held, models, id_col, text_col, ["label"]), "signals")
    fitted = {m.model_id: m.with_(**calibrate_logits(scored.where(F.col("model_id") == m.model_id), m.classes), ece_split="validation") for m in models}
    return fitted, reasons


def label_curve(
    train: DataFrame,
    test: DataFrame,
    id_col: str,
    text_col: str,
    label: str,
    ks: Iterable[int | None] = (8, 16, 32, None),
    seed: int = 7,
    **options,
) -> DataFrame:
    """(k, n_train, accuracy): train on ``k`` rows per class (``None``: all) and
    judge each model on the same test rows. All points are fitted in one run."""
    from arbitra.operators.splits import cap_per_class

    ks = list(ks)
    options = dict(options)
    min_df = options.pop("min_df", 1)
    tasks, parts, sizes = [], [], []
    for i, k in enumerate(ks):
        mine = train if k is None else cap_per_class(train, id_col, label, k, seed)
        parts.append(mine.select(id_col, F.lit(i).alias("_part")))
    chosen = written(reduce(DataFrame.unionAll, parts).groupBy(id_col).agg(F.collect_set("_part").alias("_parts")), "few-shot")
    rows = train.join(chosen, id_col)
    seen = rows.select(F.explode("_parts").alias("part"), label).groupBy("part", label).count().collect()
    every = class_names(train, label)
    for i, k in enumerate(ks):
        tasks.append(Task(f"k{k or 'all'}", every, **options))
        sizes.append(sum(r["count"] for r in seen if r["part"] == i))
    members = F.transform("_parts", lambda p: F.struct(p.alias("model"), _target(every, label).cast("int").alias("target")))
    models = fit_tfidf(rows, text_col, tasks, members, min_df)
    held = test.select(id_col, text_col, label, F.explode(F.array(*[F.lit(m.model_id) for m in models])).alias("model_id"))
    right = accuracies(held, models, id_col, text_col, label)
    out = [(str(k or "all"), n, right[m.model_id]) for k, n, m in zip(ks, sizes, models, strict=True)]
    return train.sparkSession.createDataFrame(out, "k string, n_train bigint, accuracy double")
