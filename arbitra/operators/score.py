"""Logits of a table of texts under one or many linear models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbitra import session
from arbitra.functions import grams
from arbitra.functions.packed import pack, small, unpack
from arbitra.functions.text import N_BUCKETS, characters, fnv_buckets, joined_words, lowered, tokens_alnum
from arbitra.operators.features import STEP_BYTES, STEP_TERMS, hashed_vector
from arbitra.operators.model import HiddenLayerModel, LinearModel, LogitsTable, Model
from arbitra.session import BROADCAST_BYTES

# Own choices: bytes of TF-IDF terms that are looked up inside the rows, over all models of a call; and tokens or n-grams a task looks up at once.
HEAD_BYTES = 64 * 1024 * 1024
STEP_KEYS = 1 << 20
# Bits of the largest map of asked hashes, and of a part of it that one task merges.
MAP_BITS, SEGMENT_BITS = 29, 20


def _per_class(models: Sequence[LinearModel]) -> int:
    return max(len(m.classes) for m in models)


# Sent tables of models with the terms they leave out, as long as their terms are in use.
_sent: WeakKeyDictionary = WeakKeyDictionary()


def _head(model: LinearModel, room: int) -> tuple[DataFrame, DataFrame | None]:
    """The terms that are looked up inside the rows, the most frequent ones and at most ``room``, and the others (None: there are none)."""
    if model.n_terms <= room:
        return model.terms, None
    # sixteenths of an idf, of which there are few
    step = F.coalesce(F.floor(F.least(F.greatest(F.col("idf"), F.lit(0.0)), F.lit(64.0)) * 16).cast("int"), F.lit(1025))
    cut = -1
    for s, n in model.terms.groupBy(step.alias("s")).count().orderBy("s").collect():
        room -= n
        if room < 0:
            break
        cut = s
    return model.terms.where(step <= cut), model.terms.where(step > cut)


def _hashed(batches):
    for b in batches:
        h, check = grams.identities(b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(check), b.column(1), b.column(2)], names=["h", "check", "idf", "coef"])


def _table(model: LinearModel, room: int):
    """A broadcast of the model for use inside rows, and the terms that it leaves out: coefficients by bucket, or by sorted 64-bit
    hash of the term with a second hash as check."""
    spark = model.terms.sparkSession
    made_for = spark.sparkContext.applicationId, model.n_terms <= room or room
    if model.terms in _sent and _sent[model.terms][0] == made_for:
        return _sent[model.terms][1:]
    k = len(model.classes)
    tail = None
    if model.kind == "hashed":
        t = model.terms.select("bucket", "coef").toArrow().combine_chunks()
        coef = np.zeros((N_BUCKETS, k))
        if t.num_rows:
            coef[t["bucket"].to_numpy()] = t["coef"].combine_chunks().flatten().to_numpy().reshape(-1, k)
        table = (coef,)
    else:
        head, tail = _head(model, room)
        t = head.select("term", "idf", "coef").mapInArrow(_hashed, "h bigint, check bigint, idf double, coef array<double>").toArrow()
        order = np.argsort(t["h"].to_numpy(), kind="stable")
        coef = t["coef"].combine_chunks().flatten().to_numpy().reshape(-1, k) if t.num_rows else np.zeros((0, k))
        table = (*(t[c].to_numpy()[order] for c in ("h", "check", "idf")), coef[order])
    sent = spark.sparkContext.broadcast(table)
    _sent[model.terms] = (made_for, sent, tail)
    return sent, tail


def _sum_rows(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``ends``; empty rows sum to 0."""
    out = np.zeros((len(ends) - 1, values.shape[1]))
    full = ends[1:] > ends[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, ends[:-1][full], axis=0)
    return out


def _places(h: np.ndarray, check: np.ndarray, found: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a table sorted by hash, and which of them it holds."""
    if not len(h):
        return np.zeros(len(found), np.int64), np.zeros(len(found), bool)
    at = np.minimum(np.searchsorted(h, found), len(h) - 1)
    # two terms of one hash stand next to each other
    while (again := (h[at] == found) & (check[at] != seen) & (at + 1 < len(h))).any():
        again &= h[np.minimum(at + 1, len(h) - 1)] == found
        if not again.any():
            break
        at = at + again
    return at, (h[at] == found) & (check[at] == seen)


def _found(table: tuple, keys: tuple, ends: np.ndarray) -> np.ndarray:
    """Per row the sum of squares and the products with each class over the terms in the table."""
    h, check, idf, coef = table
    found, seen, n = keys
    if not len(h):
        return np.zeros((len(ends) - 1, 1 + coef.shape[1]))
    at, known = _places(h, check, found, seen)
    x = np.where(known, (1.0 + np.log(n)) * idf[at], 0.0)
    return _sum_rows(np.column_stack([x * x, x[:, None] * coef[at]]), ends)


def _normed(intercept: np.ndarray, sums: np.ndarray) -> np.ndarray:
    norm = np.sqrt(sums[:, :1])
    return intercept + np.divide(sums[:, 1:], norm, out=np.zeros_like(sums[:, 1:]), where=norm > 0)


def _logits(model_kind: str, intercept: np.ndarray, table: tuple, keys: tuple, ends: np.ndarray) -> np.ndarray:
    """Logits of rows whose keys lie between ``ends``."""
    if model_kind == "hashed":
        return intercept + _sum_rows(table[0][keys[0]], ends)
    return _normed(intercept, _found(table, keys, ends))


def _doubles_list(values: np.ndarray) -> pa.ListArray:
    ends = pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(values).ravel()))


def _score_hashed(df: DataFrame, models: Sequence[LinearModel], cols: Sequence[str], text_col: str) -> DataFrame:
    """Logits under the hashed model that a row names: Spark cuts a text into tokens, their coefficients are looked up by Arrow batch."""
    names = [*cols, "model_id"]
    sent = [(m.model_id, np.array(m.intercept, float), _table(m, 0)[0]) for m in models]

    def steps(batches):
        """The batches in slices of bounded size."""
        for b in batches:
            total = np.cumsum(b.column(len(names)).value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP_KEYS, side="right")))
                yield b.slice(at, to - at)
                at = to

    def run(batches):
        for b in steps(batches):
            asked = np.array(b.column(len(cols)).to_pylist(), object)
            for model_id, intercept, table in sent:
                rows = np.nonzero(asked == model_id)[0]
                if not len(rows):
                    continue
                mine = b if len(rows) == b.num_rows else b.take(pa.array(rows))
                found = mine.column(len(names))
                ends = np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                z = _logits("hashed", intercept, table.value, (fnv_buckets(found.flatten()),), ends)
                yield pa.RecordBatch.from_arrays([*mine.columns[: len(names)], _doubles_list(z)], names=[*names, "logits"])

    fields = [*df.select(*cols).schema.fields, T.StructField("model_id", T.StringType()), T.StructField("logits", T.ArrayType(T.DoubleType()))]
    return df.select(*names, tokens_alnum(text_col).alias("_keys")).mapInArrow(run, T.StructType(fields))


def _sums(row: np.ndarray, n_rows: int, x: np.ndarray, coef: np.ndarray) -> np.ndarray:
    return np.column_stack([np.bincount(row, x * x, n_rows), *(np.bincount(row, x * coef[:, k], n_rows) for k in range(coef.shape[1]))]).astype(float)


def _score_texts(df: DataFrame, models: Sequence[LinearModel], cols: Sequence[str], text_col: str, every: bool) -> DataFrame:
    """Logits under the TF-IDF model that a row names, or under every model.

    N-grams are counted a few megabytes of text at a time, equal texts once, and each is looked up once in the broadcast models. While
    the broadcasts hold whole models, nothing is shuffled. Of larger models they hold the most frequent terms; for the n-grams that are not
    found there, such a chunk of texts asks the other terms, which come in lists by hash.
    """
    names = [*cols] if every else [*cols, "model_id"]
    room = min(HEAD_BYTES, session.BROADCAST_BYTES) // (24 + 8 * _per_class(models))
    tables = {id(m.terms): m.n_terms for m in models}
    if sum(tables.values()) > room:
        room //= len(tables)
    made = [(m, *_table(m, room)) for m in models]
    sent = [(m.model_id, np.array(m.intercept, float), table, tail is not None) for m, table, tail in made]
    tails = [(i, tail) for i, (_, _, tail) in enumerate(made) if tail is not None]
    longest, word_chars = max(m.n_max for m in models), characters(df.sparkSession, "word")

    def steps(batches):
        """For each step its counted n-grams, the rows' texts, the n-grams' hashes, and by model its number, rows, sums by text and n-grams it lacks."""
        for b in grams.steps(batches, len(names), STEP_BYTES):
            encoded = joined_words(b.column(len(names)), word_chars).dictionary_encode()
            g = grams.gram_counts(encoded.dictionary, 1, longest)
            text, n_texts = encoded.indices.to_numpy(zero_copy_only=False), len(encoded.dictionary)
            h, check = grams.identities(g.terms)
            asked = None if every else np.array(b.column(len(cols)).to_pylist(), object)
            out = []
            for i, (model_id, _, table, has_tail) in enumerate(sent):
                rows = np.arange(b.num_rows) if every else np.nonzero(asked == model_id)[0]
                if not len(rows):
                    continue
                keys, checks, idf, coef = table.value
                at, known = _places(keys, checks, h, check)
                cells = known[g.gram]
                place = at[g.gram[cells]]
                sums = _sums(g.row[cells], n_texts, (1.0 + np.log(g.n[cells])) * idf[place], coef[place])
                out.append((i, rows, sums, np.flatnonzero(~known) if has_tail else np.zeros(0, np.int64)))
            yield b, g, text, h, check, out

    def kept(b: pa.RecordBatch, rows: np.ndarray) -> list:
        return [c if len(rows) == b.num_rows else c.take(pa.array(rows)) for c in b.columns[: len(cols)]]

    source = df.select(*names, lowered(text_col).alias("_text"))
    out_names = [*cols, "model_id", "logits"]
    schema = T.StructType([*df.select(*cols).schema.fields, T.StructField("model_id", T.StringType()), T.StructField("logits", T.ArrayType(T.DoubleType()))])
    if not tails:

        def run(batches):
            for b, _, text, _, _, each in steps(batches):
                for i, rows, sums, _ in each:
                    z = _normed(sent[i][1], sums)[text[rows]]
                    yield pa.RecordBatch.from_arrays([*kept(b, rows), pa.array([sent[i][0]] * len(rows), pa.string()), _doubles_list(z)], names=out_names)

        return source.mapInArrow(run, schema)

    def chunk(batches):
        for b, g, text, h, check, each in steps(batches):
            lacked = np.unique(np.concatenate([lack for *_, lack in each] or [np.zeros(0, np.int64)]))
            cells = np.isin(g.gram, lacked)
            order = np.argsort(h[lacked], kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            missing = [(i, rows, sums, place[np.searchsorted(lacked, lack)]) for i, rows, sums, lack in each]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.select(range(len(cols))).schema) as w:
                w.write_batch(b.select(range(len(cols))))
            left = place[np.searchsorted(lacked, g.gram[cells])]
            blob = pack(sink.getvalue().to_pybytes(), text, int(text.max(initial=-1)) + 1, missing, small(g.row[cells]), small(left), small(g.n[cells]))
            ask = pack(h[lacked][order], check[lacked][order].astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([len(lacked)], pa.int64()), pa.array([ask], pa.binary()), pa.array([blob], pa.binary())], names=["n", "asked", "data"])

    chunks = session.written(source.mapInArrow(chunk, "n bigint, asked binary, data binary").withColumn("chunk", F.monotonically_increasing_id()), "scored")
    answers = _answers(chunks, tails)

    def finish(t: pa.Table, a: pa.Table) -> pa.Table:
        raw, text, n_texts, each, row, left, n = unpack(t["data"][0].as_py())
        batch = pa.ipc.open_stream(raw).read_next_batch()
        row, left, tf, found, out = row.astype(np.int64), left.astype(np.int64), 1.0 + np.log(n.astype(float)), {}, []
        for model, blob in zip(a["model"].to_pylist(), a["data"].to_pylist(), strict=True):
            found.setdefault(model, []).append(unpack(blob))
        for i, rows, sums, lack in each:
            if i in found:
                at, idf, coef = (np.concatenate(v) for v in zip(*found[i], strict=True))
                size = int(left.max(initial=-1)) + 1
                mine = np.zeros(size, bool)
                mine[lack] = True
                where = np.full(size, -1)
                where[at] = np.arange(len(at))
                where[~mine] = -1
                cells = where[left] >= 0
                place = where[left[cells]]
                sums = sums + _sums(row[cells], n_texts, tf[cells] * idf[place], coef[place])
            z = _normed(sent[i][1], sums)[text[rows]]
            out.append(pa.table([*kept(batch, rows), pa.array([sent[i][0]] * len(rows), pa.string()), _doubles_list(z)], names=out_names))
        return pa.concat_tables(out) if out else pa.table([*kept(batch, np.zeros(0, np.int64)), pa.array([], pa.string()), _doubles_list(np.zeros((0, 1)))], names=out_names)

    return chunks.select("chunk", "data").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)


def _answers(chunks: DataFrame, tails: Sequence[tuple[int, DataFrame]]) -> DataFrame:
    """``(chunk, model, data)``: places, idf and coefficients of those n-grams asked for by a chunk that a model holds.

    Terms whose hash no chunk asks for are left out by a bit map of the hashes, before anything is shuffled.
    """
    spark = chunks.sparkSession
    size = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    shift = np.uint64(64 - min(MAP_BITS, max(SEGMENT_BITS, int(8 * size["n"]).bit_length())))

    def place(h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) >> shift).astype(np.int64)

    def mark(batches):
        for batch in batches:
            for blob in batch.column(0):
                at = np.unique(place(unpack(blob.as_py())[0]))
                starts = np.flatnonzero(np.diff(at >> SEGMENT_BITS, prepend=-1))
                for i, j in zip(starts, [*starts[1:], len(at)], strict=True):
                    segment = int(at[i] >> SEGMENT_BITS)
                    data = pack(small(np.diff(at[i:j], prepend=segment << SEGMENT_BITS)))
                    yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([data], pa.binary())], names=["segment", "data"])

    def merge(t: pa.Table) -> pa.Table:
        bits = np.zeros(1 << SEGMENT_BITS, bool)
        for blob in t["data"].to_pylist():
            bits[np.cumsum(unpack(blob)[0], dtype=np.int64)] = True
        return pa.table({"segment": t["segment"].slice(0, 1), "data": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    bits = np.zeros(1 << (64 - int(shift) - 3), np.uint8)
    per = 1 << (SEGMENT_BITS - 3)
    for r in chunks.select("asked").mapInArrow(mark, "segment int, data binary").groupBy("segment").applyInArrow(merge, "segment int, data binary").collect():
        bits[r["segment"] * per : (r["segment"] + 1) * per] = np.frombuffer(r["data"], np.uint8)
    asked_for = spark.sparkContext.broadcast(bits)
    parts = max(size["chunks"], 1)

    def dealt(h: np.ndarray):
        bucket = ((h.view(np.uint64) * grams.MIX >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        buckets, starts = np.unique(bucket[order], return_index=True)
        return order, zip(buckets.tolist(), starts, [*starts[1:], len(h)], strict=True)

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h, check = unpack(row["asked"])
                order, each = dealt(h)
                for b, i, j in each:
                    o = order[i:j]
                    yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([b], pa.int32()), pa.array([pack(small(np.diff(o, prepend=0)), h[o], check[o])], pa.binary())], names=["chunk", "bucket", "data"])

    def listed(model: int):
        def run(batches):
            held, n = [], 0

            def out():
                h, check, idf, coef = (np.concatenate(c) for c in zip(*held, strict=True))
                order, each = dealt(h)
                for b, i, j in each:
                    o = order[i:j]
                    yield pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([b], pa.int32()), pa.array([pack(h[o], check[o], idf[o], coef[o])], pa.binary())], names=["model", "bucket", "data"])

            for b in _hashed(batches):
                h = b.column(0).to_numpy()
                at = place(h)
                wanted = (asked_for.value[at >> 3] & (np.uint8(128) >> (at & 7).astype(np.uint8))) > 0
                keep = np.flatnonzero(wanted & b.column(2).is_valid().to_numpy(zero_copy_only=False))
                if len(keep):
                    coef = b.column(3)
                    values = coef.flatten().to_numpy(zero_copy_only=False).reshape(len(coef), -1)
                    held.append((h[keep], b.column(1).to_numpy()[keep].astype(np.uint32), b.column(2).to_numpy(zero_copy_only=False)[keep], values[keep]))
                    n += len(keep)
                if n >= STEP_TERMS:
                    yield from out()
                    held, n = [], 0
            if n:
                yield from out()

        return run

    def look_up(asks: pa.Table, terms: pa.Table) -> pa.Table:
        known: dict[int, list] = {}
        for model, blob in zip(terms["model"].to_pylist(), terms["data"].to_pylist(), strict=True):
            known.setdefault(model, []).append(unpack(blob))
        tables = {}
        for model, each in known.items():
            t = [np.concatenate(c) for c in zip(*each, strict=True)]
            order = np.argsort(t[0], kind="stable")
            tables[model] = [c[order] for c in t]
        out = []
        for chunk, blob in zip(asks["chunk"].to_pylist(), asks["data"].to_pylist(), strict=True):
            steps, h, check = unpack(blob)
            places = np.cumsum(steps, dtype=np.int64)
            for model, (keys, checks, idf, coef) in tables.items():
                at, held = _places(keys, checks, h, check)
                if held.any():
                    out.append((chunk, model, pack(places[held], idf[at[held]], coef[at[held]])))
        chunk, model, data = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "model": pa.array(model, pa.int32()), "data": pa.array(data, pa.binary())})

    asks = chunks.select("chunk", "asked").mapInArrow(ask, "chunk bigint, bucket int, data binary")
    terms = reduce(DataFrame.unionAll, [t.select("term", "idf", "coef").mapInArrow(listed(i), "model int, bucket int, data binary") for i, t in tails])
    return asks.groupBy("bucket").cogroup(terms.groupBy("bucket")).applyInArrow(look_up, "chunk bigint, model int, data binary")


def _score_network(df: DataFrame, model: HiddenLayerModel, cols: Sequence[str], text_col: str) -> DataFrame:
    out = model.network.transform(hashed_vector(df, text_col, cols))
    return out.select(*cols, F.lit(model.model_id).alias("model_id"), vector_to_array("rawPrediction").alias("logits"))


def _score_tables(df: DataFrame, models: Sequence[LogitsTable], cols: Sequence[str]) -> list[DataFrame]:
    """Logits looked up by id: one join per table, however many questions it holds."""
    id_col, out = cols[0], []
    tables: dict[int, list[LogitsTable]] = {}
    for m in models:
        tables.setdefault(id(m.logits), []).append(m)
    for group in tables.values():
        if group[0].key is None:
            for m in group:
                found = m.logits.select(id_col, "logits")
                out.append(df.where(F.col("model_id") == m.model_id).select(*cols, "model_id").join(found, id_col).select(*cols, "model_id", "logits"))
            continue
        named = df.sparkSession.createDataFrame([(m.model_id, m.key) for m in group], "model_id string, _key string")
        found = group[0].logits.select(id_col, F.col("question").alias("_key"), "logits")
        asked = df.select(*cols, "model_id").join(F.broadcast(named), "model_id")
        out.append(asked.join(found, [id_col, "_key"]).select(*cols, "model_id", "logits"))
    return out


def score_models(
    df: DataFrame, models: Sequence[Model], id_col: str, text_col: str, keep: Sequence[str] = ()
) -> DataFrame:
    """(id, keep, model_id, logits) where each row names its ``model_id``.

    (id, model_id) must identify a row. While all models of a kind are small, logits are computed inside the rows and nothing is
    shuffled. Of larger TF-IDF models the most frequent terms are looked up inside the rows, the text's other n-grams by a join; the
    text itself is never shuffled. Hashed models are scored in groups that fit. A text with no known term gets the intercepts
    alone. Logits of other engines are joined by id.
    """
    spark = df.sparkSession
    if len({m.model_id for m in models}) != len(models):
        raise ValueError("model ids must differ")
    cols = [id_col, *keep]
    done = _score_tables(df, [m for m in models if isinstance(m, LogitsTable)], cols)
    for m in models:
        if isinstance(m, HiddenLayerModel):
            done.append(_score_network(df.filter(F.col("model_id") == m.model_id), m, cols, text_col))
    linear = [m for m in models if isinstance(m, LinearModel)]
    tfidf = [m for m in linear if m.kind == "tfidf"]
    if tfidf:
        own = df if len(tfidf) == len(models) else df.filter(F.col("model_id").isin([m.model_id for m in tfidf]))
        done.append(_score_texts(own, tfidf, cols, text_col, every=False))
    hashed = [m for m in linear if m.kind == "hashed"]
    at_once = max(1, BROADCAST_BYTES // (N_BUCKETS * (24 + 8 * _per_class(hashed)))) if hashed else 1
    for start in range(0, len(hashed), at_once):  # as many models as one broadcast may hold
        group = hashed[start : start + at_once]
        own = df if len(group) == len(models) else df.filter(F.col("model_id").isin([m.model_id for m in group]))
        done.append(_score_hashed(own, group, cols, text_col))
    if not done:
        return spark.createDataFrame([], T.StructType([*df.select(*cols, "model_id").schema.fields, T.StructField("logits", T.ArrayType(T.DoubleType()))]))
    return reduce(DataFrame.unionByName, done)


def score_each(
    df: DataFrame, models: Sequence[Model], id_col: str, text_col: str, keep: Sequence[str] = ()
) -> DataFrame:
    """(id, keep, model_id, logits): every model on every row.

    A text is counted once for all TF-IDF models, and looked up once in a table of terms that several of them share. Other models
    are asked through ``score_models``.
    """
    others = [m for m in models if not isinstance(m, LinearModel) or m.kind != "tfidf"]
    if others:
        tagged = df.withColumn("model_id", F.explode(F.array(*[F.lit(m.model_id) for m in others])))
        scored = score_models(tagged, others, id_col, text_col, keep)
        tfidf = [m for m in models if m not in others]
        return scored.unionByName(score_each(df, tfidf, id_col, text_col, keep)) if tfidf else scored
    distinct: dict[int, LinearModel] = {}
    for m in models:
        distinct.setdefault(id(m.terms), m)
    tables = list(distinct.values())
    cols = [id_col, *keep]
    if len(tables) == len(models) or sum(m.n_terms for m in tables) * (24 + 8 * _per_class(tables)) <= min(HEAD_BYTES, session.BROADCAST_BYTES):
        return _score_texts(df, models, cols, text_col, every=True)
    # one lookup per table, then the intercepts of the models that share it
    bare = {key: m.with_(model_id=str(i), intercept=(0.0,) * len(m.classes)) for i, (key, m) in enumerate(distinct.items())}
    scored = _score_texts(df, list(bare.values()), cols, text_col, every=True).withColumnRenamed("model_id", "_table")
    rows = [(bare[id(m.terms)].model_id, m.model_id, [float(v) for v in m.intercept]) for m in models]
    named = df.sparkSession.createDataFrame(rows, "_table string, model_id string, _intercept array<double>")
    return scored.join(F.broadcast(named), "_table").select(*cols, "model_id", F.zip_with("logits", "_intercept", lambda z, b: z + b).alias("logits"))


def score_tfidf(
    df: DataFrame, model: LinearModel, id_col: str, text_col: str, keep: Sequence[str] = ()
) -> DataFrame:
    """(id, keep, logits) under a TF-IDF model."""
    if model.kind != "tfidf":
        raise ValueError("score_tfidf needs a tfidf model")
    return score(df, model, id_col, text_col, keep)


def score_hashed(
    df: DataFrame, model: LinearModel, id_col: str, text_col: str, keep: Sequence[str] = ()
) -> DataFrame:
    """(id, keep, logits) under a hashed bag-of-words model."""
    if model.kind != "hashed":
        raise ValueError("score_hashed needs a hashed model")
    return score(df, model, id_col, text_col, keep)


def score(df: DataFrame, model: Model, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep, logits) under any kind of model."""
    tagged = df.select(id_col, *keep, text_col, F.lit(model.model_id).alias("model_id"))
    return score_models(tagged, [model], id_col, text_col, keep).drop("model_id")


def pad_ids(ids: Column, max_length: int, pad_id: int = 0) -> tuple[Column, Column]:
    """Token ids cut or padded to ``max_length``, and the matching mask."""
    if max_length < 1:
        raise ValueError("max_length must be at least 1")
    real = F.slice(ids, 1, max_length)
    missing = F.lit(max_length) - F.size(real)
    return (
        F.concat(real, F.array_repeat(F.lit(pad_id).cast("bigint"), missing)),
        F.concat(F.transform(real, lambda _: F.lit(1).cast("bigint")), F.array_repeat(F.lit(0).cast("bigint"), missing)),
    )
