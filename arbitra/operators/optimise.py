"""L-BFGS for many penalised logistic models at once, whatever the driver has room for: their coefficients, one value per row, or neither.

Training rows are ``(row bigint, model int, target int, idx array<bigint>, x array<double>, own double)``: a row belongs to one
model, columns are numbered across all models, and ``own`` is the value of a column that no other row has (0: none). A model has
one signed column of coefficients (two classes) or one per class. The loss is the mean over the model's rows plus
``reg / 2`` times the squared coefficients, intercepts left out.
"""

from __future__ import annotations

from collections.abc import Generator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions.arrays import array_sum
from arbitra.functions.packed import pack, small, unpack
from arbitra.session import written

# Values of one vector that the driver may hold, in about 30 vectors of doubles: one per row and class. Beyond it all vectors stay in tables.
# Coefficients are sent to the driver in every step while there are few of them.
DRIVER_COEFFICIENTS, FEW_COEFFICIENTS = 2_000_000, 250_000
# Non-zeros that are worth a task of their own in every step, rows of a block, and coefficients of one message.
NONZEROS_PER_TASK, BLOCK_ROWS, PART = 200_000, 512, 1 << 16
# Remembered steps, sufficient decrease, halvings of one step, and the share of a loss that is rounding.
MEMORY, ARMIJO, HALVINGS, ROUNDING = 10, 1e-4, 40, 1e-13
TABLE_MEMORY = 5
# Values above which vectors by row are remembered TABLE_MEMORY times, and non-zeros of a block of columns.
LONG_VECTOR, BLOCK_VALUES = 500_000, 1_000_000
# Products of non-zeros and hidden units that a task holds at once.
HIDDEN_VALUES = 100_000
# Share of the rows that have an input from which a product of matrices is cheaper than one by its non-zeros.
DENSE_SHARE = 0.015
# Values of that matrix, and rows' non-zeros, that a task holds at once.
MATRIX_VALUES = 2_000_000
# Bytes that steps may have shuffled before their files are cleared away.
SHUFFLED = 256 * 1024 * 1024


@dataclass(frozen=True)
class Setting:
    """One model of a fit: columns of coefficients (1: signed, two classes; else one per class), rows, penalty, and when to stop.

    A fit ends when no derivative of the loss over ``reg`` exceeds ``tol``, when a step improves the loss by no more than
    ``rel_tol`` of it (None: not asked), or after ``max_iter`` steps.
    """

    width: int
    n_rows: int
    reg: float
    max_iter: int = 200
    tol: float = 1e-5
    rel_tol: float | None = None


def _stopped(s: Setting, steepest: float, before: float | None, now: float) -> bool:
    slow = s.rel_tol is not None and before is not None and before - now <= s.rel_tol * max(abs(before), 1e-300)
    return steepest <= s.tol * s.reg or slow


def _direction(gram: np.ndarray, m: int) -> np.ndarray:
    """Shares of the remembered steps ``s`` (newest first), gradient changes ``y`` and the gradient in the next direction.

    The usual two loops, on the products of these ``2m + 1`` vectors alone, so the vectors may lie in any place.
    """
    out = np.zeros(2 * m + 1)
    out[-1] = -1.0
    alpha = np.zeros(m)
    for i in range(m):
        alpha[i] = out @ gram[:, i] / gram[i, m + i]
        out[m + i] -= alpha[i]
    if m:
        out *= gram[0, m] / gram[m, m]
    for i in reversed(range(m)):
        out[i] += alpha[i] - out @ gram[:, m + i] / gram[i, m + i]
    return out


def _search(s: Setting, x: np.ndarray) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Yields the points at which it needs loss and gradient; returns the last accepted one."""
    f, g = yield x
    before = None
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    memory = MEMORY if len(x) <= LONG_VECTOR else TABLE_MEMORY
    for _ in range(s.max_iter):
        if _stopped(s, float(np.abs(g).max(initial=0.0)), before, f):
            break
        basis = [*steps, *changes, g]
        gram = np.zeros((len(basis), len(basis)))
        for i, u in enumerate(basis):
            for j in range(i, len(basis)):
                gram[i, j] = gram[j, i] = u @ basis[j]
        d = np.zeros_like(g)
        for share, v in zip(_direction(gram, len(steps)), basis, strict=True):
            d += share * v
        slope = float(g @ d)
        if slope >= 0:
            steps, changes, d = [], [], -g
            slope = float(g @ d)
        t = 1.0 if steps else min(1.0, 1.0 / float(np.linalg.norm(g)))
        for _ in range(HALVINGS):
            there, gradient = yield x + t * d
            flat = there <= f + ROUNDING * abs(f) and abs(gradient @ d) <= abs(slope)  # losses that rounding cannot tell apart
            if there <= f + ARMIJO * t * slope or flat:
                break
            t = max(0.1 * t, min(0.5 * t, -slope * t * t / (2 * (there - f - slope * t))))
        else:
            break
        move, change = t * d, gradient - g
        if move @ change > 1e-12 * np.linalg.norm(move) * np.linalg.norm(change):
            steps, changes = [move, *steps][:memory], [change, *changes][:memory]
        before, x, f, g = f, x + move, there, gradient
    return x


def _losses(z: np.ndarray, target: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each row and its derivative by each margin; margins beyond a model's own are left at 0."""
    loss, r = np.zeros(len(z)), np.zeros_like(z)
    two = widths == 1
    if two.any():
        sign = np.where(target[two] == 1, 1.0, -1.0)
        m = sign * z[two, 0]
        loss[two] = np.logaddexp(0.0, -m)
        r[two, 0] = -sign / (1.0 + np.exp(np.minimum(m, 700.0)))
    many = ~two
    if many.any():
        y = np.where(np.arange(z.shape[1])[None, :] < widths[many][:, None], z[many], -np.inf)
        top = y.max(axis=1, keepdims=True)
        e = np.exp(y - top)
        total = e.sum(axis=1, keepdims=True)
        at = np.arange(len(y)), target[many]
        loss[many] = (np.log(total) + top)[:, 0] - y[at]
        p = e / total
        p[at] -= 1.0
        r[many] = p
    return loss, r


def _blocks(rows: DataFrame, n_values: int) -> DataFrame:
    """The rows as blocks in compressed row form, few enough that each task has work."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                idx, x = part.column("idx"), part.column("x").flatten().to_numpy(zero_copy_only=False)
                whole = x.astype(np.int32)
                sizes = idx.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                row, model, target = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "model", "target"))
                data = pack(
                    small(model), small(target), part.column("own").to_numpy(zero_copy_only=False), small(sizes),
                    small(idx.flatten().to_numpy(zero_copy_only=False)), small(whole) if (whole == x).all() else x,  # counts are exact in fewer bytes
                )
                arrays = [pa.array([part.num_rows], pa.int64()), *(pa.array([v], pa.binary()) for v in (row.tobytes(), model.tobytes(), data))]
                yield pa.RecordBatch.from_arrays(arrays, names=["n", "rows", "models", "data"])

    tasks = max(1, n_values // NONZEROS_PER_TASK)
    if rows.rdd.getNumPartitions() > tasks:
        rows = rows.coalesce(tasks)
    made = rows.select("row", "model", "target", "idx", "x", "own").mapInArrow(
        run, "n bigint, rows binary, models binary, data binary"
    )
    return written(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _unpacked(blob: pa.Scalar) -> tuple:
    """Models, classes and own values of the rows of a block, where each row's cells end, and the cells' columns and values."""
    model, target, own, sizes, idx, x = unpack(blob.as_py())
    return model.astype(np.int64), target.astype(np.int64), own, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), idx.astype(np.int64), x.astype(float)


def _summed(parts: DataFrame) -> DataFrame:
    """Messages of many tasks added up by place before they reach the driver."""

    def run(t: pa.Table) -> pa.Table:
        total = reduce(np.add, (np.frombuffer(v) for v in t["data"].to_pylist()))
        return pa.table({"kind": t["kind"].slice(0, 1), "at": t["at"].slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    return parts.groupBy("kind", "at").applyInArrow(run, "kind int, at bigint, data binary")


def _fit_here(rows: DataFrame, settings: Sequence[Setting], column_model: np.ndarray, n_values: int, has_own: bool):
    """Coefficients ``(columns, width)``, own coefficients ``(rows, width)`` with their row ids, intercepts ``(models, width)``."""
    spark = rows.sparkSession
    width, n_models, n_cols = max(s.width for s in settings), len(settings), len(column_model)
    blocks = _blocks(rows, n_values)
    known = blocks.select("block", "n", "rows", "models").collect() if has_own else []
    first, at = {}, 0
    for b in known:
        first[b["block"]] = at
        at += b["n"]
    n_rows = at
    ids = np.concatenate([np.frombuffer(b["rows"], np.int64) for b in known] or [np.zeros(0, np.int64)])
    row_model = np.concatenate([np.frombuffer(b["models"], np.int64) for b in known] or [np.zeros(0, np.int64)])
    owner = np.concatenate([np.repeat(column_model, width), np.repeat(row_model, width), np.repeat(np.arange(n_models), width)])
    places = [np.nonzero(owner == m)[0] for m in range(n_models)]
    n_w, n_u = n_cols * width, n_rows * width
    widths = np.array([s.width for s in settings])
    many_tasks = blocks.rdd.getNumPartitions() > 32 or blocks.rdd.getNumPartitions() * n_cols * width > 4 * PART

    def evaluate(theta: np.ndarray, live: np.ndarray):
        sent = spark.sparkContext.broadcast((theta, live))

        def run(batches):
            theta, live = sent.value
            w, u, b0 = np.ascontiguousarray(theta[:n_w].reshape(-1, width).T), theta[n_w : n_w + n_u].reshape(-1, width), theta[n_w + n_u :].reshape(-1, width)
            g, out, last = np.zeros((n_cols, width)), [], np.zeros((n_models, width + 1))
            for batch in batches:
                for place, blob in enumerate(batch.column(2)):
                    model, target, own, ends, idx, x = _unpacked(blob)
                    if not live[model].any():
                        continue
                    n = len(model)
                    row = np.repeat(np.arange(n), np.diff(ends))
                    z = b0[model]
                    if has_own:
                        at = first[batch.column(0)[place].as_py()]
                        z += own[:, None] * u[at : at + n]
                    full = ends[1:] > ends[:-1]
                    for k in range(width if len(idx) else 0):
                        z[full, k] += np.add.reduceat(x * w[k, idx], ends[:-1][full])
                    loss, r = _losses(z, target, widths[model])
                    for k in range(width):
                        g[:, k] += np.bincount(idx, x * np.ascontiguousarray(r[:, k])[row], n_cols)
                        last[:, k] += np.bincount(model, r[:, k], n_models)
                    last[:, width] += np.bincount(model, loss, n_models)
                    if has_own and own.any():
                        out.append((1, at, own[:, None] * r))
            out += [(0, i, g[i : i + PART]) for i in range(0, n_cols, PART)]
            out.append((2, 0, last))
            for kind, at, data in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind], pa.int32()), pa.array([at], pa.int64()), pa.array([np.ascontiguousarray(data).tobytes()], pa.binary())], names=["kind", "at", "data"]
                )

        parts = blocks.select("block", "n", "data").mapInArrow(run, "kind int, at bigint, data binary")
        grad, loss = np.zeros_like(theta), np.zeros(n_models)
        for p in (_summed(parts) if many_tasks else parts).collect():
            data = np.frombuffer(p["data"])
            if p["kind"] == 2:
                data = data.reshape(-1, width + 1)
                loss += data[:, width]
                grad[n_w + n_u :] += data[:, :width].ravel()
            else:
                start = p["at"] * width + (n_w if p["kind"] == 1 else 0)
                grad[start : start + len(data)] += data
        sent.destroy()
        return loss, grad

    theta = np.zeros(n_w + n_u + n_models * width)
    penalised = np.arange(len(theta)) < n_w + n_u
    runs = [_search(s, theta[p]) for s, p in zip(settings, places, strict=True)]
    asked = {m: next(r) for m, r in enumerate(runs)}
    while asked:
        live = np.zeros(n_models, bool)
        for m, point in asked.items():
            theta[places[m]] = point
            live[m] = True
        loss, grad = evaluate(theta, live)
        for m in list(asked):
            s, p = settings[m], places[m]
            x = theta[p] * penalised[p]
            try:
                asked[m] = runs[m].send((loss[m] / s.n_rows + s.reg / 2 * float(x @ x), grad[p] / s.n_rows + s.reg * x))
            except StopIteration as end:
                theta[p] = end.value
                del asked[m]
    return theta[:n_w].reshape(-1, width), theta[n_w : n_w + n_u].reshape(-1, width), ids, theta[n_w + n_u :].reshape(-1, width)


def _cells_times(rows: np.ndarray, by: np.ndarray, idx: np.ndarray, x: np.ndarray, out: np.ndarray) -> None:
    """Add ``x[i] * rows[idx[i]]`` to ``out[by[i]]`` for cells in order of ``by``, a bounded number at a time."""
    at_once = max(1, HIDDEN_VALUES // max(rows.shape[1], 1))
    for i in range(0, len(idx), at_once):
        part = slice(i, i + at_once)
        to = by[part]
        starts = np.flatnonzero(np.diff(to, prepend=-1))
        out[to[starts]] += np.add.reduceat(rows[idx[part]] * x[part, None], starts, axis=0)


def _hidden_pass(
    theta: np.ndarray, layers: Sequence[int], target: np.ndarray, ends: np.ndarray, idx: np.ndarray, x: np.ndarray, grad: np.ndarray, dense: int = 0
) -> float:
    """Summed cross-entropy of some rows under one sigmoid and one softmax layer; adds its derivatives to ``grad``.

    Weights lie as in MLlib: each layer's by input, then its biases. The first ``dense`` inputs are multiplied as a matrix, the others cell by cell.
    """
    n_in, h, k = layers
    at = np.cumsum([0, n_in * h, h, h * k, k])
    (w1, b1, w2, b2), (g1, gb1, g2, gb2) = ([v[at[i] : at[i + 1]] for i in range(4)] for v in (theta, grad))
    w1, w2, g1, g2 = w1.reshape(n_in, h), w2.reshape(h, k), g1.reshape(n_in, h), g2.reshape(h, k)
    z = np.tile(b1, (len(target), 1))
    row = np.repeat(np.arange(len(target)), np.diff(ends))
    often = idx < dense
    some = np.zeros((len(target), dense))
    some[row[often], idx[often]] = x[often]
    row, idx, x = row[~often], idx[~often], x[~often]
    if dense:
        z += some @ w1[:dense]
    _cells_times(w1, row, idx, x, z)
    a = 1.0 / (1.0 + np.exp(-np.clip(z, -700.0, 700.0)))
    y = a @ w2 + b2
    y -= y.max(axis=1, keepdims=True)
    e = np.exp(y)
    total = e.sum(axis=1)
    here = np.arange(len(target)), target
    loss = float((np.log(total) - y[here]).sum())
    r = e / total[:, None]
    r[here] -= 1.0
    g2 += a.T @ r
    gb2 += r.sum(axis=0)
    d = (r @ w2.T) * a * (1.0 - a)
    gb1 += d.sum(axis=0)
    if dense:
        g1[:dense] += some.T @ d
    order = np.argsort(idx, kind="stable")
    _cells_times(d, idx[order], row[order], x[order], g1)
    return loss


def hidden_logits(theta: np.ndarray, layers: Sequence[int], ends: np.ndarray, idx: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What the second layer makes of each row, before the softmax."""
    n_in, h, k = layers
    w1, b1, w2, b2 = np.split(theta, np.cumsum([n_in * h, h, h * k]))
    z = np.tile(b1, (len(ends) - 1, 1))
    _cells_times(w1.reshape(n_in, h), np.repeat(np.arange(len(ends) - 1), np.diff(ends)), idx, x, z)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700.0, 700.0))) @ w2.reshape(h, k) + b2


def fit_hidden(rows: DataFrame, layers: Sequence[int], start: np.ndarray, max_iter: int, rel_tol: float) -> np.ndarray:
    """Weights of a network with one hidden layer that L-BFGS reaches from ``start``: mean cross-entropy over the rows, no penalty.

    Rows stay sparse. A pass sends the weights out; each task adds up one gradient, and gradients are summed by part before they reach
    the driver. Tasks are no more than the cores, so what a pass moves does not grow with the rows. Inputs that no row has keep
    their first weights and are left out of the passes. Inputs that a good share of the rows have come first and are multiplied as a matrix.
    """
    spark = rows.sparkSession
    seen = rows.agg(F.count("*").alias("n"), F.sum(F.size("idx")).alias("values")).first()
    held = {r[0]: r[1] for r in rows.select(F.explode("idx").alias("i")).groupBy("i").agg(F.count("*")).collect()}
    used = np.array(sorted(held, key=lambda i: (-held[i], i)), np.int64)
    dense = sum(n > DENSE_SHARE * seen["n"] for n in held.values())
    n_in, h, k = layers
    layers = [len(used), h, k]
    place = np.zeros(n_in, np.int32)
    place[used] = np.arange(len(used))
    every = np.array(start, float)
    kept = np.concatenate([(used[:, None] * h + np.arange(h)).ravel(), np.arange(n_in * h, len(every))])
    stored = _blocks(rows, (seen["values"] or 0) * h // 16)
    blocks = stored.select("data").coalesce(spark.sparkContext.defaultParallelism)
    tasks = blocks.rdd.getNumPartitions()
    many = tasks * len(kept) > 64 * PART
    step = max(1, MATRIX_VALUES // max(dense, h))

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast(theta)

        def run(batches):
            theta = sent.value
            grad, loss = np.zeros_like(theta), 0.0
            for batch in batches:
                for blob in batch.column(0):
                    _, target, _, ends, idx, x = _unpacked(blob)
                    idx = place[idx]
                    at = 0
                    while at < len(target):
                        to = max(at + 1, min(at + step, int(np.searchsorted(ends, ends[at] + MATRIX_VALUES // 4, side="right")) - 1))
                        cells = slice(ends[at], ends[to])
                        loss += _hidden_pass(theta, layers, target[at:to], ends[at : to + 1] - ends[at], idx[cells], x[cells], grad, dense)
                        at = to
            parts = [(0, i, grad[i : i + PART]) for i in range(0, len(grad), PART)]
            for kind, at, data in [*(p for p in parts if p[2].any()), (2, 0, np.array([loss]))]:
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([at], pa.int64()), pa.array([data.tobytes()], pa.binary())], names=["kind", "at", "data"])

        grad, loss = np.zeros_like(theta), 0.0
        parts = blocks.mapInArrow(run, "kind int, at bigint, data binary")
        for p in (_summed(parts) if many else parts).collect():
            data = np.frombuffer(p["data"])
            if p["kind"] == 2:
                loss += float(data[0])
            else:
                grad[p["at"] : p["at"] + len(data)] += data
        sent.destroy()
        return loss / seen["n"], grad / seen["n"]

    run, passed = _search(Setting(layers[-1], seen["n"], 0.0, max_iter, rel_tol=rel_tol), every[kept]), 0
    point = next(run)
    while True:
        try:
            point = run.send(evaluate(point))
        except StopIteration as end:
            every[kept] = end.value
            return every
        passed += tasks * len(kept) * 8
        if many and passed > SHUFFLED:  # shuffle files of earlier passes go once the JVM has collected their owners
            spark.sparkContext._jvm.System.gc()
            passed = 0


# --- one value per row in the driver, coefficients nowhere until the end ------


def _column_blocks(rows: DataFrame, ids: np.ndarray, n_values: int) -> DataFrame:
    """The non-zeros by column, each column whole in one block: ``cols``, where each starts, and its rows' places in ``ids`` with values."""
    sent = rows.sparkSession.sparkContext.broadcast(ids)

    def block(idx, row, x):
        starts = np.flatnonzero(np.concatenate([[True], idx[1:] != idx[:-1]])).astype(np.int64)
        arrays = (idx[starts], starts, np.searchsorted(sent.value, row).astype(np.int32), np.ascontiguousarray(x))
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=["cols", "starts", "at", "x"])

    def run(batches):
        held, size, room = [], 0, BLOCK_VALUES
        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            size += b.num_rows
            if size >= room:
                idx, row, x = (np.concatenate(c) for c in zip(*held, strict=True))
                cut = int(np.searchsorted(idx, idx[-1]))
                if cut:
                    yield block(idx[:cut], row[:cut], x[:cut])
                held, size = [[idx[cut:], row[cut:], x[cut:]]], len(idx) - cut
                room = max(BLOCK_VALUES, 2 * size)
        if size:
            yield block(*(np.concatenate(c) for c in zip(*held, strict=True)))

    cells = rows.select("row", F.explode(F.arrays_zip("idx", "x")).alias("c")).select(F.col("c.idx").alias("idx"), "row", F.col("c.x").alias("x"))
    dealt = cells.repartition(max(1, -(-n_values // BLOCK_VALUES)), "idx").sortWithinPartitions("idx", "row")
    return written(dealt.mapInArrow(run, "cols binary, starts binary, at binary, x binary"), "column-blocks")


def _merged(parts: DataFrame) -> DataFrame:
    """Messages of many tasks merged by place before they reach the driver: margins (kind 0) add up, of slopes (kind 1) the steepest counts."""

    def run(t: pa.Table) -> pa.Table:
        how = np.add if t["kind"][0].as_py() == 0 else np.maximum
        total = reduce(how, (np.frombuffer(v) for v in t["data"].to_pylist()))
        return pa.table({"kind": t["kind"].slice(0, 1), "at": t["at"].slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    return parts.groupBy("kind", "at").applyInArrow(run, "kind int, at bigint, data binary")


def _search_rows(s: Setting, target: np.ndarray, own: np.ndarray, memory: int):
    """``_search`` in terms of rows: a vector of coefficients ``v`` is a triple ``a``, ``X v`` and intercepts, where ``v = X' a``.

    Coefficients that start at 0 stay sums of rows, so products of two vectors are products of ``a`` and ``X v``, and points on a line
    need no pass over the data. Yields the ``a`` of each gradient, is sent ``X X' a`` and the steepest slope; returns ``a`` and intercepts.
    """
    n, w = len(target), s.width
    widths = np.full(n, w)
    dot = lambda u, v: float(np.vdot(u[0], v[1])) + float(u[2] @ v[2])
    mix = lambda shares, vectors: tuple(sum(c * v[i] for c, v in zip(shares, vectors, strict=True)) for i in range(3))

    def value(p):
        loss, r = _losses(p[1] + p[2], target, widths)
        return loss.sum() / s.n_rows + s.reg / 2 * float(np.vdot(p[0], p[1])), r[:, :w] / s.n_rows + s.reg * p[0], r[:, :w].sum(axis=0) / s.n_rows

    x = np.zeros((n, w)), np.zeros((n, w)), np.zeros(w)
    f, ga, gb = value(x)
    gm, steep = yield ga
    g = ga, gm, gb
    before, steps, changes = None, [], []
    for _ in range(s.max_iter):
        steepest = max(steep, float(np.abs(g[2]).max()), float(np.abs(own[:, None] * g[0]).max(initial=0.0)))
        if _stopped(s, steepest, before, f):
            break
        basis = [*steps, *changes, g]
        gram = np.zeros((len(basis), len(basis)))
        for i, u in enumerate(basis):
            for j in range(i, len(basis)):
                gram[i, j] = gram[j, i] = dot(u, basis[j])
        d = mix(_direction(gram, len(steps)), basis)
        slope = dot(g, d)
        if slope >= 0:
            steps, changes, d = [], [], tuple(-v for v in g)
            slope = dot(g, d)
        if slope >= 0:  # what is left of the gradient is rounding
            break
        t = 1.0 if steps else min(1.0, 1.0 / np.sqrt(gram[-1, -1]))
        for _ in range(HALVINGS):
            point = tuple(v + t * e for v, e in zip(x, d, strict=True))
            there, ga, gb = value(point)
            flat = there <= f + ROUNDING * abs(f) and abs(float(np.vdot(ga, d[1])) + float(gb @ d[2])) <= abs(slope)
            if there <= f + ARMIJO * t * slope or flat:
                break
            t = max(0.1 * t, min(0.5 * t, -slope * t * t / (2 * (there - f - slope * t))))
        else:
            break
        gm, steep = yield ga
        after = ga, gm, gb
        move, change = tuple(t * v for v in d), tuple(v - o for v, o in zip(after, g, strict=True))
        if dot(move, change) > 1e-12 * np.sqrt(max(dot(move, move), 0.0) * max(dot(change, change), 0.0)):
            steps, changes = [move, *steps][:memory], [change, *changes][:memory]
        before, x, f, g = f, point, there, after
    return x[0], x[2]


def _fit_by_rows(rows: DataFrame, settings: Sequence[Setting], n_values: int) -> tuple[DataFrame, np.ndarray]:
    """``(model, col, w)`` and intercepts; a step sends one value per row and class out and one back, never a coefficient.

    Every column lies whole in one task, which makes its slope from the rows and its part of the rows' margins from that.
    """
    spark = rows.sparkSession
    width, n_models = max(s.width for s in settings), len(settings)
    known = rows.select("row", "model", "target", "own").toArrow()
    order = np.argsort(known["row"].to_numpy())
    ids, target, own = (known[c].to_numpy()[order] for c in ("row", "target", "own"))
    target, row_model = target.astype(np.int64), known["model"].to_numpy()[order].astype(np.int64)
    n = len(ids)
    places = [np.flatnonzero(row_model == m) for m in range(n_models)]
    blocks = _column_blocks(rows, ids, n_values)
    tasks = blocks.rdd.getNumPartitions()
    models = spark.sparkContext.broadcast(row_model)

    def read(batches):
        for batch in batches:
            for b in batch.to_pylist():
                starts, at = np.frombuffer(b["starts"], np.int64), np.frombuffer(b["at"], np.int32)
                yield np.frombuffer(b["cols"], np.int64), starts, np.diff(starts, append=len(at)), at, np.frombuffer(b["x"], float), models.value[at[starts]]

    def multiply(a: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``X X' a`` of the shared columns and the steepest slope of each model."""
        sent = spark.sparkContext.broadcast((a, live))

        def run(batches):
            a, live = sent.value
            z, steep = np.zeros((width, n)), np.zeros(n_models)
            for _, starts, sizes, at, x, model in read(batches):
                if not live[model].any():
                    continue
                for k in range(width):
                    g = np.add.reduceat(x * a[k, at], starts)
                    np.maximum.at(steep, model, np.abs(g))
                    z[k] += np.bincount(at, x * np.repeat(g, sizes), n)
            flat = z.ravel()
            out = [(0, i, flat[i : i + PART]) for i in range(0, len(flat), PART)]
            for kind, at, data in [*out, (1, 0, steep)]:
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([at], pa.int64()), pa.array([data.tobytes()], pa.binary())], names=["kind", "at", "data"])

        parts = blocks.mapInArrow(run, "kind int, at bigint, data binary")
        z, steep = np.zeros(width * n), np.zeros(n_models)
        for p in (_merged(parts) if tasks * width * n > PART else parts).collect():
            data = np.frombuffer(p["data"])
            if p["kind"] == 1:
                steep = np.maximum(steep, data)
            else:
                z[p["at"] : p["at"] + len(data)] += data
        sent.destroy()
        return z.reshape(width, n), steep

    memory = MEMORY if n * width <= LONG_VECTOR else TABLE_MEMORY
    runs = [_search_rows(s, target[p], own[p], memory) for s, p in zip(settings, places, strict=True)]
    asked = {m: next(r) for m, r in enumerate(runs)}
    found, b = np.zeros((width, n)), np.zeros((n_models, width))
    while asked:
        a, live = np.zeros((width, n)), np.zeros(n_models, bool)
        for m, point in asked.items():
            a[: settings[m].width, places[m]] = point.T
            live[m] = True
        z, steep = multiply(a, live)
        for m, point in list(asked.items()):
            s, p = settings[m], places[m]
            try:
                asked[m] = runs[m].send((z[: s.width, p].T + (own[p] ** 2)[:, None] * point, steep[m]))
            except StopIteration as end:
                found[: s.width, p], b[m, : s.width] = end.value[0].T, end.value[1]
                del asked[m]
    final = spark.sparkContext.broadcast(found)

    def weights(batches):
        for cols, starts, _, at, x, model in read(batches):
            w = np.stack([np.add.reduceat(x * final.value[k, at], starts) for k in range(width)], axis=1)
            yield _weight_rows(cols, w, model)

    tables = [written(blocks.mapInArrow(weights, "model int, col bigint, w array<double>"), "weights")]
    alone = np.flatnonzero(own)
    for at in range(0, len(alone), 500_000):
        part = alone[at : at + 500_000]
        tables.append(spark.createDataFrame(pa.Table.from_batches([_weight_rows(-1 - ids[part], (own[part] * found[:, part]).T, row_model[part])]), "model int, col bigint, w array<double>"))
    return reduce(DataFrame.unionAll, tables), b


def _weight_rows(col: np.ndarray, w: np.ndarray, model: np.ndarray) -> pa.RecordBatch:
    w = np.ascontiguousarray(w)
    ends = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
    arrays = [pa.array(model.astype(np.int32)), pa.array(col, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))]
    return pa.RecordBatch.from_arrays(arrays, names=["model", "col", "w"])


def fit_columns(
    blocks: DataFrame, settings: Sequence[Setting], view_of: Sequence[int], slot_of: Sequence[int], known: dict, n_rows_of_view: Sequence[int]
) -> tuple[np.ndarray, list[int], np.ndarray]:
    """As ``_fit_by_rows`` for ``bags.column_blocks``, where models of one view share its rows and columns.

    A row has one value per model and class of its view (a lane). ``known`` has the rows' ``view``, ``norm``, ``own`` and ``targets`` (one list
    after the other, starting at ``first``). Returns the rows' values over their norms ``(lanes, rows)``, the first lane of each model, and intercepts.
    """
    spark = blocks.sparkSession
    n, n_models, n_views = len(known["view"]), len(settings), len(n_rows_of_view)
    lanes, start = [0] * n_views, []
    for s, v in zip(settings, view_of, strict=True):
        start.append(lanes[v])
        lanes[v] += s.width
    width = max(lanes)
    places = [np.flatnonzero(known["view"] == v) for v in range(n_views)]
    scale = np.where(known["norm"] > 0, known["norm"], 1.0)
    count = np.array(n_rows_of_view, float)
    # as many tasks as cores: each sends one value per row and lane in every step
    blocks = blocks.coalesce(max(1, spark.sparkContext.defaultParallelism))
    tasks = blocks.rdd.getNumPartitions()

    def multiply(a: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``X X' a`` of the shared columns and the steepest slope of each view and lane."""
        sent = spark.sparkContext.broadcast((a, live))

        def run(batches):
            a, live = sent.value
            z, steep = np.zeros((width, n)), np.zeros((width, n_views))
            for view, idf, starts, sizes, at, tf in bag_columns(batches, count):
                for k in range(width):
                    if not live[k, view].any():
                        continue
                    g = idf * np.add.reduceat(tf * a[k, at], starts)
                    np.maximum.at(steep[k], view, np.abs(g))
                    z[k] += np.bincount(at, tf * np.repeat(idf * g, sizes), n)
            flat = z.ravel()
            out = [(0, i, flat[i : i + PART]) for i in range(0, len(flat), PART)]
            for kind, at, data in [*out, (1, 0, steep.ravel())]:
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([at], pa.int64()), pa.array([data.tobytes()], pa.binary())], names=["kind", "at", "data"])

        parts = blocks.mapInArrow(run, "kind int, at bigint, data binary")
        z, steep = np.zeros(width * n), np.zeros(width * n_views)
        for p in (_merged(parts) if tasks * width * n > PART else parts).collect():
            data = np.frombuffer(p["data"])
            if p["kind"] == 1:
                steep = np.maximum(steep, data)
            else:
                z[p["at"] : p["at"] + len(data)] += data
        sent.destroy()
        return z.reshape(width, n), steep.reshape(width, n_views)

    memory = MEMORY if n * width <= LONG_VECTOR else TABLE_MEMORY
    runs = [_search_rows(s, known["targets"][known["first"][places[v]] + j], known["own"][places[v]], memory) for s, v, j in zip(settings, view_of, slot_of, strict=True)]
    asked = {m: next(r) for m, r in enumerate(runs)}
    found, b = np.zeros((width, n)), np.zeros((n_models, max(s.width for s in settings)))
    passed = 0
    while asked:
        a, live = np.zeros((width, n)), np.zeros((width, n_views), bool)
        for m, point in asked.items():
            mine, p = slice(start[m], start[m] + settings[m].width), places[view_of[m]]
            a[mine, p] = (point / scale[p][:, None]).T
            live[mine, view_of[m]] = True
        z, steep = multiply(a, live)
        passed += tasks * width * n * 8
        if passed > SHUFFLED:  # shuffle files of earlier steps go once the JVM has collected their owners
            spark.sparkContext._jvm.System.gc()
            passed = 0
        for m, point in list(asked.items()):
            mine, p = slice(start[m], start[m] + settings[m].width), places[view_of[m]]
            try:
                asked[m] = runs[m].send((z[mine, p].T / scale[p][:, None] + (known["own"][p] ** 2)[:, None] * point, float(steep[mine, view_of[m]].max())))
            except StopIteration as end:
                found[mine, p], b[m, : settings[m].width] = (end.value[0] / scale[p][:, None]).T, end.value[1]
                del asked[m]
    return found, start, b


def bag_columns(batches, count: np.ndarray, with_terms: bool = False):
    """Of each of ``bags.column_blocks``: its columns' views, idf, starts and sizes, the rows and the sublinear counts; and, if asked, the terms."""
    for batch in batches:
        for blob in batch.column(0):
            words, view, df, starts, at, n = unpack(blob.as_py())
            view = view.astype(np.int64)
            idf = np.log((1.0 + count[view]) / (1.0 + df)) + 1.0
            tf = (1.0 + np.log(np.arange(1, int(n.max(initial=1)) + 1)))[n.astype(np.int64) - 1]
            found = view, idf, starts, np.diff(starts, append=len(at)), at, tf
            yield (*found, words) if with_terms else found


# --- coefficients in tables -------------------------------------------------


def _scaled_sum(vectors: Column, shares: Column, width: int) -> Column:
    """Sum of ``shares[i] * vectors[i]``, position by position."""
    each = F.zip_with(vectors, shares, lambda v, a: F.transform(v, lambda e: e * a))
    return F.aggregate(each, F.array_repeat(F.lit(0.0), width), lambda t, v: F.zip_with(t, v, lambda a, b: a + b))


def _row_loss(own_width: Column, z: Column, target: Column) -> tuple[Column, Column]:
    """Loss and derivatives of one row from its margins."""
    sign = F.when(target == 1, 1.0).otherwise(-1.0)
    m = sign * z[0]
    two = F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))
    slope = F.transform(z, lambda _, i: F.when(i == 0, -sign / (1.0 + F.exp(F.least(m, F.lit(700.0))))).otherwise(0.0))
    own = F.slice(z, F.lit(1), own_width)
    top = F.array_max(own)
    total = array_sum(F.transform(own, lambda v: F.exp(v - top)))
    many = F.log(total) + top - F.get(z, target)
    p = F.transform(z, lambda v, i: F.when(i < own_width, F.exp(v - top) / total).otherwise(0.0) - F.when(i == target, 1.0).otherwise(0.0))
    return F.when(own_width == 1, two).otherwise(many), F.when(own_width == 1, slope).otherwise(p)


class _Tables:
    """Loss, gradient and L-BFGS state of all models as tables keyed by model and column.

    The driver holds products of the remembered vectors and the intercepts; coefficients, gradients and remembered
    steps are one row per column, written once a step. Margins and gradients are sums by row and by column.
    """

    def __init__(self, rows: DataFrame, settings: Sequence[Setting]):
        self.spark, self.settings = rows.sparkSession, settings
        self.width = max(s.width for s in settings)
        cells = rows.select("row", "model", F.explode(F.arrays_zip("idx", "x")).alias("c")).select("row", "model", F.col("c.idx").alias("col"), F.col("c.x").alias("x"))
        own = rows.where("own <> 0").select("row", "model", (-1 - F.col("row")).alias("col"), F.col("own").alias("x"))
        self.cells = written(cells.unionAll(own), "cells")
        self.rows = rows.select("row", "model", "target")
        zero = F.array_repeat(F.lit(0.0), self.width)
        none = F.array().cast("array<array<double>>")
        start = self.cells.select("model", "col").distinct().withColumns({"w": zero, "g": zero, "s": none, "y": none})
        self.state = written(start, "weights")
        self.b = np.zeros((len(settings), self.width))

    def _meta(self, **columns) -> DataFrame:
        """A broadcast row per model."""
        data = [(m, *(v[m] for v in columns.values())) for m in range(len(self.settings))]
        kinds = {"b": "array<double>", "shares": "array<double>", "t": "double", "own_width": "int", "reg": "double", "n": "bigint"}
        return F.broadcast(self.spark.createDataFrame(data, "model int, " + ", ".join(f"{c} {kinds[c]}" for c in columns)))

    def residuals(self, weights: DataFrame, b: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """``(row, r)`` of all rows, and per model the summed loss and summed residuals."""
        sums = [F.sum(F.col("x") * F.get("w", F.lit(k))).alias(f"z{k}") for k in range(self.width)]
        z = self.cells.join(weights, ["model", "col"]).groupBy("row").agg(*sums)
        meta = self._meta(b=b.tolist(), own_width=[s.width for s in self.settings])
        margin = F.array(*[F.coalesce(F.col(f"z{k}"), F.lit(0.0)) + F.get("b", F.lit(k)) for k in range(self.width)])
        loss, r = _row_loss(F.col("own_width"), F.col("z"), F.col("target"))
        out = self.rows.join(z, "row", "left").join(meta, "model").withColumn("z", margin).select("row", "model", loss.alias("loss"), r.alias("r"))
        out = written(out, "residuals")
        total = out.groupBy("model").agg(F.sum("loss"), *[F.sum(F.get("r", F.lit(k))) for k in range(self.width)]).collect()
        f, gb = np.zeros(len(self.settings)), np.zeros_like(b)
        for t in total:
            f[t[0]], gb[t[0]] = t[1], t[2:]
        return out, f, gb

    def gradient(self, residuals: DataFrame) -> DataFrame:
        sums = [F.sum(F.col("x") * F.get("r", F.lit(k))).alias(f"g{k}") for k in range(self.width)]
        out = self.cells.join(residuals.select("row", "r"), "row").groupBy("model", "col").agg(*sums)
        return out.select("model", "col", F.array(*[F.col(f"g{k}") for k in range(self.width)]).alias("raw"))

    def squares(self, weights: DataFrame) -> np.ndarray:
        out = np.zeros(len(self.settings))
        for m, v in weights.groupBy("model").agg(F.sum(array_sum(F.transform("w", lambda e: e * e)))).collect():
            out[m] = v
        return out

    def products(self, held: int) -> tuple[np.ndarray, np.ndarray]:
        """Products of all pairs among s, y and g per model, and the steepest derivative, in one pass."""
        size = 2 * held + 1
        v = F.concat("s", "y", F.array("g"))
        dot = lambda i, j: F.sum(array_sum(F.zip_with(F.get("v", F.lit(i)), F.get("v", F.lit(j)), lambda a, b: a * b)))
        pairs = [(i, j) for i in range(size) for j in range(i, size)]
        steepest = F.max(F.array_max(F.transform("g", lambda e: F.abs(e))))
        gram, steep = np.zeros((len(self.settings), size, size)), np.zeros(len(self.settings))
        for r in self.state.withColumn("v", v).groupBy("model").agg(steepest, *[dot(i, j) for i, j in pairs]).collect():
            steep[r[0]] = r[1]
            for (i, j), value in zip(pairs, r[2:], strict=True):
                gram[r[0], i, j] = gram[r[0], j, i] = value
        return gram, steep

    def fit(self) -> None:
        n_models, width = len(self.settings), self.width
        reg, n = np.array([s.reg for s in self.settings]), np.array([float(s.n_rows) for s in self.settings])
        meta = self._meta(reg=reg.tolist(), n=[s.n_rows for s in self.settings])

        def graded(weights: DataFrame, residuals: DataFrame) -> DataFrame:
            raw = F.zip_with("raw", "w", lambda a, w: a / F.col("n") + F.col("reg") * w)
            return weights.join(self.gradient(residuals), ["model", "col"]).join(meta, "model").withColumn("next", raw).drop("raw", "n", "reg")

        residuals, f, gb = self.residuals(self.state.select("model", "col", "w"), self.b)
        f, gb = f / n, gb / n[:, None]
        self.state = written(graded(self.state, residuals).select("model", "col", "w", F.col("next").alias("g"), "s", "y"), "weights")
        live = np.ones(n_models, bool)
        before: list[float | None] = [None] * n_models
        sb, yb = [], []  # the intercepts' part of the remembered vectors, one array per step
        for step in range(max(s.max_iter for s in self.settings)):
            held = len(sb)
            gram, steep = self.products(held)
            mine = np.stack([*sb, *yb, gb], axis=1)  # model, vector, class
            gram += mine @ mine.transpose(0, 2, 1)
            steep = np.maximum(steep, np.abs(gb).max(axis=1))
            for m, s in enumerate(self.settings):
                live[m] = live[m] and step < s.max_iter and not _stopped(s, steep[m], before[m], f[m])
            if not live.any():
                break
            shares, slope, t = np.zeros((n_models, 2 * held + 1)), np.zeros(n_models), np.zeros(n_models)
            for m in np.nonzero(live)[0]:
                # a step in which a model stood still, or without curvature, is not remembered for it
                good = [i for i in range(held) if gram[m, i, held + i] > 1e-12 * np.sqrt(gram[m, i, i] * gram[m, held + i, held + i])]
                pick = [*good, *[held + i for i in good], 2 * held]
                shares[m, pick] = _direction(gram[m][np.ix_(pick, pick)], len(good))
                slope[m] = shares[m] @ gram[m, :, -1]
                if slope[m] >= 0:
                    shares[m], good = 0.0, []
                    shares[m, -1] = -1.0
                    slope[m] = -gram[m, -1, -1]
                t[m] = 1.0 if good else min(1.0, 1.0 / np.sqrt(gram[m, -1, -1]))
            d = _scaled_sum(F.concat("s", "y", F.array("g")), F.col("shares"), width)
            way = written(self.state.join(self._meta(shares=shares.tolist()), "model").withColumn("d", d).drop("shares"), "direction")
            db = np.einsum("mv,mvk->mk", shares, mine)
            open_, there, halvings = live.copy(), f.copy(), 0
            while True:
                moved = way.join(self._meta(t=t.tolist()), "model").withColumn("w", F.zip_with("w", "d", lambda a, b: a + F.col("t") * b))
                residuals, loss, gn = self.residuals(moved.select("model", "col", "w"), self.b + t[:, None] * db)
                there = loss / n + reg / 2 * self.squares(moved)
                open_ = live & (there > f + np.maximum(ARMIJO * t * slope, ROUNDING * np.abs(f)))
                halvings += 1
                if not open_.any():
                    break
                t = np.where(open_, 0.0 if halvings > HALVINGS else t / 2, t)
            live &= t > 0
            step_table = graded(moved.select("model", "col", "w", "g", "d", "s", "y", "t"), residuals)
            change = F.zip_with("next", "g", lambda a, b: a - b)
            keep = lambda c, new: F.slice(F.concat(F.array(new), F.col(c)), 1, TABLE_MEMORY)
            self.state = written(
                step_table.select("model", "col", "w", F.col("next").alias("g"), keep("s", F.transform("d", lambda e: e * F.col("t"))).alias("s"), keep("y", change).alias("y")),
                "weights",
            )
            gn = gn / n[:, None]
            sb, yb = [t[:, None] * db, *sb][:TABLE_MEMORY], [gn - gb, *yb][:TABLE_MEMORY]
            before = [f[m] if t[m] > 0 else before[m] for m in range(n_models)]
            self.b, f, gb = self.b + t[:, None] * db, there, gn


def fits_by_rows(n_columns: int, n_rows: int, width: int, has_own: bool) -> bool:
    """Whether the driver keeps one value per row and class, and no coefficients."""
    return (n_columns + (n_rows if has_own else 0)) * width > min(FEW_COEFFICIENTS, DRIVER_COEFFICIENTS) and n_rows * width <= DRIVER_COEFFICIENTS


def fit_rows(rows: DataFrame, settings: Sequence[Setting], columns: DataFrame, n_columns: int) -> tuple[DataFrame, np.ndarray]:
    """``(model, col, w array<double>)`` and the intercepts ``(models, width)`` of all models, fitted together.

    ``rows`` are stored training rows, ``columns`` is ``(model, idx)``. An own column of a row has ``col = -1 - row``. One pass
    over the rows serves all models in every step; finished models take no more part. Few coefficients are kept by the driver and sent
    out by broadcast. Of many the driver keeps only one value per row and class; where even those exceed DRIVER_COEFFICIENTS, all
    vectors stay in tables and every step is joins and sums by key. All end at the same optimum.
    """
    spark = rows.sparkSession
    width = max(s.width for s in settings)
    size = rows.agg(F.count_if(F.col("own") != 0).alias("own"), F.sum(F.size("idx")).alias("values")).first()
    n_rows = sum(s.n_rows for s in settings)
    if fits_by_rows(n_columns, n_rows, width, bool(size["own"])):
        return _fit_by_rows(rows, settings, size["values"] or 0)
    if (n_columns + (n_rows if size["own"] else 0)) * width > min(FEW_COEFFICIENTS, DRIVER_COEFFICIENTS):
        tables = _Tables(rows, settings)
        tables.fit()
        return tables.state.select("model", "col", "w"), tables.b
    column_model = np.zeros(n_columns, np.int64)
    if len(settings) > 1:
        known = columns.select("model", "idx").toArrow()
        column_model[known["idx"].to_numpy()] = known["model"].to_numpy()
    w, u, ids, b = _fit_here(rows, settings, column_model, size["values"] or 0, bool(size["own"]))
    tables = [(np.arange(n_columns), w)]
    if size["own"]:
        tables.append((-1 - ids, u))
    frames = []
    for col, values in tables:
        for at in range(0, max(len(col), 1), 500_000):
            part = np.ascontiguousarray(values[at : at + 500_000])
            ends = pa.array(np.arange(0, part.size + 1, width, dtype=np.int32))
            frames.append(spark.createDataFrame(pa.table({"col": pa.array(col[at : at + 500_000], pa.int64()), "w": pa.ListArray.from_arrays(ends, pa.array(part.ravel()))})))
    found = reduce(DataFrame.unionAll, frames).select(F.col("col").cast("bigint").alias("col"), F.col("w").cast("array<double>").alias("w"))
    owners = columns.select("model", F.col("idx").cast("bigint").alias("col")).unionAll(rows.where("own <> 0").select("model", (-1 - F.col("row")).alias("col")))
    return owners.join(found, "col").select("model", "col", "w"), b
