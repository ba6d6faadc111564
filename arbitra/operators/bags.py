"""Counted n-grams of training texts, a few megabytes of text at a time, and the columns that several rows share.

A chunk of texts asks for each of its n-grams once. What all chunks ask for meets in buckets by hash, where rows are added up and shared
n-grams get their columns, and only the columns come back. Everything between tasks is compressed lists, never a row per n-gram.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions import grams
from arbitra.functions.packed import pack, small, unpack
from arbitra.functions.text import characters, joined_words, lowered
from arbitra.operators.features import STEP_BYTES
from arbitra.operators.optimise import bag_columns
from arbitra.session import written


def read_texts(df: DataFrame, text_col: str, members: Column) -> DataFrame:
    """``(views array<struct<view, n>>, data)``: each row a chunk of texts as words, with the members of each text.

    A member is a view (the rows and n-grams that some models share) and the numbers of the row's class in each of them.
    """
    target = df.select(members.alias("m")).schema["m"].dataType.elementType["target"].dataType
    numbers = (lambda m: m["target"].cast("array<int>")) if target.typeName() == "array" else (lambda m: F.array(m["target"].cast("int")))
    listed = F.transform("_m", lambda m: F.struct(m["model"].cast("int").alias("view"), numbers(m).alias("targets")))
    made = df.select(members.alias("_m"), lowered(text_col).alias("_text")).where(F.size("_m") > 0)
    word_chars = characters(df.sparkSession, "word")

    def run(batches):
        held, size = [], 0

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            each = t["_m"].combine_chunks()
            flat = each.flatten()
            view = flat.field("view").to_numpy(zero_copy_only=False).astype(np.int64)
            text = np.repeat(np.arange(len(each)), each.value_lengths().to_numpy(zero_copy_only=False))
            targets = flat.field("targets")
            data = targets.flatten().to_numpy(zero_copy_only=False).astype(np.int32), targets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(view, kind="stable")
            ends = np.concatenate([[0], np.cumsum(data[1])])[:-1]
            sizes = data[1][order]
            targets = data[0][np.repeat(ends[order] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            views, n = np.unique(view, return_counts=True)
            words = pc.binary_join(grams.lists(joined_words(t["_text"].combine_chunks(), word_chars), np.array([t.num_rows])), "\n")[0].as_py()
            struct = pa.StructArray.from_arrays([pa.array(views.astype(np.int32)), pa.array(n.astype(np.int64))], names=["view", "n"])
            blob = pack(words, small(view[order]), small(text[order]), small(targets), small(sizes))
            return pa.RecordBatch.from_arrays([grams.lists(struct, np.array([len(views)])), pa.array([blob], pa.binary())], names=["views", "data"])

        for batch in batches:
            for b in grams.steps([batch], 1, STEP_BYTES):
                held.append(b)
                size += int(pc.sum(pc.binary_length(b.column(1))).as_py() or 0)
                if size >= STEP_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return made.select(listed.alias("_m"), "_text").mapInArrow(run, "views array<struct<view: int, n: bigint>>, data binary")


@dataclass
class Chunk:
    """Texts of a chunk counted: its members by view, its n-grams, and what each view asks for."""

    view: np.ndarray
    text: np.ndarray
    targets: np.ndarray
    sizes: np.ndarray
    g: grams.Grams
    ask_view: np.ndarray
    ask_gram: np.ndarray
    ask_rows: np.ndarray
    cells: list  # per view: (view, places of its members, cells' members, cells' place among what is asked for, counts)


def counted(blob: bytes, longest: Sequence[int]) -> Chunk:
    words, view, text, targets, sizes = unpack(blob)
    texts = pa.array(words.split("\n"), pa.string())
    view, text = view.astype(np.int64), text.astype(np.int64)
    g = grams.gram_counts(texts, 1, max(longest))
    length = pc.count_substring(g.terms, " ").to_numpy(zero_copy_only=False) + 1 if min(longest) < max(longest) else None
    starts = np.searchsorted(g.row, np.arange(len(texts) + 1))
    out, asked, at = [], [], 0
    for v in np.unique(view):
        mine = np.flatnonzero(view == v) if len(longest) > 1 else np.arange(len(view))
        if len(mine) == len(texts) and (text[mine] == np.arange(len(texts))).all():
            member, gram, n = g.row, g.gram, g.n
        else:
            per = starts[text[mine] + 1] - starts[text[mine]]
            cell = np.repeat(starts[text[mine]] - np.cumsum(per) + per, per) + np.arange(per.sum())
            member, gram, n = np.repeat(np.arange(len(mine)), per), g.gram[cell], g.n[cell]
        if length is not None and longest[v] < max(longest):
            short = length[gram] <= longest[v]
            member, gram, n = member[short], gram[short], n[short]
        rows = np.bincount(gram, minlength=len(g.terms))
        held = np.flatnonzero(rows)
        place = np.cumsum(rows > 0) - 1 + at
        asked.append((np.full(len(held), v), held, rows[held]))
        out.append((int(v), mine, member, place[gram], n))
        at += len(held)
    ask_view, ask_gram, ask_rows = (np.concatenate(c) for c in zip(*asked, strict=True))
    return Chunk(view, text, targets.astype(np.int64), sizes.astype(np.int64), g, ask_view, ask_gram, ask_rows, out)


def _dealt(c: Chunk, parts: int):
    """N-grams and what is asked for, in order of their bucket; and each asked n-gram's place in its bucket."""
    order, buckets, sizes = grams.dealt(c.g.hashes, parts)
    at, bucket = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    at[order] = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    bucket[order] = np.repeat(buckets, sizes)
    mine = bucket[c.ask_gram]
    asked = np.argsort(mine, kind="stable")
    return order, buckets, sizes, asked, mine, at[c.ask_gram]


def columns_of(texts: DataFrame, longest: Sequence[int], parts: int, least: int) -> DataFrame:
    """``(chunk, bucket, terms array<struct<view, shared, single>>, data)``: for each chunk the columns of what it asked for, and under
    chunk -1 the bucket's shared n-grams with view and number of rows, in order of their columns, and how many n-grams each view has."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = counted(row["data"], longest)
                order, buckets, sizes, asked, mine, place = _dealt(c, parts)
                ends = np.searchsorted(mine[asked], [*buckets, parts])
                terms = grams.packed(c.g.terms, order, sizes).to_pylist()
                view, rows, place = c.ask_view[asked], c.ask_rows[asked], place[asked]
                blobs = [pack(t, small(view[i:j]), small(place[i:j]), small(rows[i:j])) for t, i, j in zip(terms, ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]] * len(blobs), pa.int64()), pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "bucket", "data"]
                )

    def add_up(t: pa.Table) -> pa.Table:
        asks = [unpack(b) for b in t["data"].to_pylist()]
        terms, sizes = grams.unpacked(pa.array([a[0] for a in asks], pa.binary()))
        known = terms.dictionary_encode()
        code, first = known.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes) - sizes
        n = len(known.dictionary)
        key = np.concatenate([a[1].astype(np.int64) * n + code[f + a[2].astype(np.int64)] for a, f in zip(asks, first, strict=True)])
        cells, at = np.unique(key, return_inverse=True)
        df = np.bincount(at, np.concatenate([a[3] for a in asks])).astype(np.int64)
        shared = df >= least
        col = np.where(shared, np.cumsum(shared), 0)
        ends = np.cumsum([0, *(len(a[1]) for a in asks)])
        answers = [pack(small(col[at[i:j]]), small(df[at[i:j]])) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        view, gram = np.divmod(cells[shared], max(n, 1))
        vocab = pack(grams.packed(known.dictionary.take(pa.array(gram)), np.arange(len(gram)), np.array([len(gram)]))[0].as_py(), small(view), small(df[shared]))
        owner = cells // max(n, 1)
        views = np.unique(owner)
        numbers = [np.bincount(np.searchsorted(views, owner), k, len(views)).astype(np.int64) for k in (shared, df == 1)]
        each = pa.StructArray.from_arrays([pa.array(views.astype(np.int32)), *map(pa.array, numbers)], names=["view", "shared", "single"])
        bucket, size = t["bucket"][0].as_py(), len(asks)
        return pa.table(
            {
                "chunk": pa.array([*t["chunk"].to_pylist(), -1], pa.int64()), "bucket": pa.array([bucket] * (size + 1), pa.int32()),
                "terms": grams.lists(each, np.array([0] * size + [len(views)])), "data": pa.array([*answers, vocab], pa.binary()),
            }
        )

    asked = texts.select("chunk", "data").mapInArrow(ask, "chunk bigint, bucket int, data binary")
    return written(asked.groupBy("bucket").applyInArrow(add_up, "chunk bigint, bucket int, terms array<struct<view: int, shared: bigint, single: bigint>>, data binary"), "indexed-vocab")


@dataclass
class Rows:
    """The rows of one view in a chunk: shared cells (row, bucket, column from 0, count), cells of terms of one row, and per row the norm and the part of the latter."""

    view: int
    places: np.ndarray
    row: np.ndarray
    bucket: np.ndarray
    col: np.ndarray
    n: np.ndarray
    x: np.ndarray
    single_row: np.ndarray
    single_term: np.ndarray
    single_x: np.ndarray
    single_n: np.ndarray
    norm: np.ndarray
    own: np.ndarray


def laid_out(c: Chunk, answers: pa.Table, longest: Sequence[int], n_rows: Sequence[int], parts: int, singles: bool) -> list[Rows]:
    _, _, _, asked, mine, _ = _dealt(c, parts)
    found = [unpack(b) for b in answers.sort_by("bucket")["data"].to_pylist()]
    col, df = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    if found:
        col[asked], df[asked] = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    idf = np.log((1.0 + np.array(n_rows, float)[c.ask_view]) / (1.0 + df)) + 1.0
    out = []
    for v, places, row, at, n in c.cells:
        x = (1.0 + np.log(n)) * idf[at]
        shared, single = col[at] > 0, (df[at] == 1) & singles
        pp, qq = (np.bincount(row[k], x[k] * x[k], len(places)) for k in (shared, single))
        norm = np.sqrt(pp + qq)
        s = at[shared]
        out.append(Rows(v, places, row[shared], mine[s], col[s] - 1, n[shared], x[shared], row[single], c.ask_gram[at[single]], x[single], n[single], norm, np.sqrt(qq) / np.where(norm > 0, norm, 1.0)))
    return out


def _by_chunk(texts: DataFrame, answers: DataFrame, longest: Sequence[int], n_rows: Sequence[int], parts: int, singles: bool, lay_out, schema: str) -> DataFrame:
    """``lay_out(chunk id, its members, their rows by view)`` of each chunk."""

    def run(t: pa.Table, a: pa.Table) -> pa.Table:
        c = counted(t["data"][0].as_py(), longest)
        return lay_out(t["chunk"][0].as_py(), c, laid_out(c, a, longest, n_rows, parts, singles))

    told = answers.where("chunk >= 0").select("chunk", "bucket", "data")
    return texts.select("chunk", "data").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, schema)


def row_lists(
    texts: DataFrame, answers: DataFrame, longest: Sequence[int], n_rows: Sequence[int], parts: int, singles: bool, offsets: dict[int, int], first: dict[int, int],
    lanes: Sequence[Sequence[tuple[int, int]]],
) -> DataFrame:
    """Training rows as ``optimise`` has them: ``(row, model, target, idx, x, own, singles array<struct<term, share>>)``. ``offsets`` numbers a chunk's rows, ``first`` the
    columns of a bucket; ``lanes`` are the models of a view, each with its place among a row's class numbers."""
    n_tasks = sum(len(t) for t in lanes)
    ends_of = lambda place, n: np.concatenate([[0], np.cumsum(np.bincount(place, minlength=n))]).astype(np.int32)

    def lay_out(chunk: int, c: Chunk, rows: list[Rows]) -> pa.Table:
        out, starts = [], np.cumsum(c.sizes) - c.sizes
        for r in rows:
            n = len(r.places)
            scale = np.where(r.norm > 0, r.norm, 1.0)
            idx = np.array([first[b] for b in r.bucket.tolist()], np.int64) + r.col
            order = np.lexsort((idx, r.row))
            ends, cell_row = ends_of(r.row, n), r.row[order]
            share = r.single_x / (r.own * scale)[r.single_row]
            alone = pa.StructArray.from_arrays([c.g.terms.take(pa.array(r.single_term)), pa.array(share)], names=["term", "share"])
            for task, slot in lanes[r.view]:
                out.append(
                    pa.table(
                        {
                            "row": (offsets[chunk] + r.places) * n_tasks + task, "model": np.full(n, task, np.int32), "target": c.targets[starts[r.places] + slot].astype(np.int32),
                            "idx": pa.ListArray.from_arrays(ends, pa.array(idx[order])), "x": pa.ListArray.from_arrays(ends, pa.array(r.x[order] / scale[cell_row])),
                            "own": r.own, "singles": pa.ListArray.from_arrays(ends_of(r.single_row, n), alone),
                        }
                    )
                )
        return pa.concat_tables(out)

    schema = "row bigint, model int, target int, idx array<bigint>, x array<double>, own double, singles array<struct<term: string, share: double>>"
    return _by_chunk(texts, answers, longest, n_rows, parts, singles, lay_out, schema)


def column_lists(texts: DataFrame, answers: DataFrame, longest: Sequence[int], n_rows: Sequence[int], parts: int, singles: bool) -> DataFrame:
    """``(kind, chunk, bucket, data)``: of kind 0 a chunk's cells of the columns of a bucket; of kind 1 view, class numbers, norm and own value
    of its rows; of kind 2 its terms of one row."""

    def lay_out(chunk: int, c: Chunk, rows: list[Rows]) -> pa.Table:
        norm, own = np.zeros(len(c.view)), np.zeros(len(c.view))
        for r in rows:
            norm[r.places], own[r.places] = r.norm, r.own
        place, bucket, col, n = (np.concatenate(v) for v in ([r.places[r.row] for r in rows], [r.bucket for r in rows], [r.col for r in rows], [r.n for r in rows]))
        order = np.lexsort((place, col, bucket))
        place, bucket, col, n = place[order], bucket[order], col[order], n[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        buckets = bucket[starts]
        data = [(0, int(b), pack(small(np.diff(col[i:j], prepend=0)), small(place[i:j]), small(n[i:j]))) for b, i, j in zip(buckets, starts, [*starts[1:], len(bucket)], strict=True)]
        data.append((1, -1, pack(small(c.view), small(c.targets), small(c.sizes), norm, own)))
        alone = [r for r in rows if len(r.single_row)]
        if alone:
            terms = np.concatenate([r.single_term for r in alone])
            words = grams.packed(c.g.terms, terms, np.array([len(terms)]))[0].as_py()
            at, count = np.concatenate([r.places[r.single_row] for r in alone]), np.concatenate([r.single_n for r in alone])
            data.append((2, -1, pack(words, small(at), small(count))))
        kind, bucket, blobs = zip(*data, strict=True)
        return pa.table({"kind": pa.array(kind, pa.int32()), "chunk": pa.array([chunk] * len(kind), pa.int64()), "bucket": pa.array(bucket, pa.int32()), "data": pa.array(blobs, pa.binary())})

    return _by_chunk(texts, answers, longest, n_rows, parts, singles, lay_out, "kind int, chunk bigint, bucket int, data binary")


def column_blocks(lists: DataFrame, answers: DataFrame, offsets: dict[int, int]) -> DataFrame:
    """``(data)``: a bucket's terms with view and number of rows, where each column starts, and its rows' numbers and counts."""

    def merge(t: pa.Table, v: pa.Table) -> pa.Table:
        (vocab,) = (unpack(b) for b in v["data"].to_pylist())
        cols, rows, counts = [], [], []
        for chunk, blob in zip(t["chunk"].to_pylist(), t["data"].to_pylist(), strict=True):
            col, place, n = unpack(blob)
            cols.append(np.cumsum(col, dtype=np.int64).astype(np.int32))
            rows.append((place.astype(np.int64) + offsets[chunk]).astype(np.int32))
            counts.append(n)
        if not cols:
            return pa.table({"data": pa.array([], pa.binary())})
        col, row, n = (np.concatenate(c) for c in (cols, rows, counts))
        order = np.lexsort((row, col))
        col = col[order]
        return pa.table({"data": pa.array([pack(*vocab, np.flatnonzero(np.diff(col, prepend=-1)), row[order], n[order])], pa.binary())})

    known = answers.where("chunk = -1").select("bucket", "data")
    return lists.select("bucket", "chunk", "data").groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(merge, "data binary")


def _terms(words: bytes, picked: np.ndarray, idf: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    """Term, idf and coefficients; one signed column is mirrored."""
    coef = np.column_stack([-w[0], w[0]]) if len(w) == 1 else np.ascontiguousarray(w.T)
    ends = pa.array(np.arange(0, coef.size + 1, coef.shape[1], dtype=np.int32))
    terms = grams.unpacked(pa.array([words], pa.binary()))[0].take(pa.array(picked))
    return pa.RecordBatch.from_arrays([terms, pa.array(idf), pa.ListArray.from_arrays(ends, pa.array(coef.ravel()))], names=["term", "idf", "coef"])


TERMS = "term string, idf double, coef array<double>"


def shared_terms(blocks: DataFrame, found, view: int, lane: slice, n_rows: Sequence[int]) -> DataFrame:
    """``(term, idf, coef)`` of the shared n-grams of a view from the rows' values over their norms."""
    count = np.array(n_rows, float)

    def run(batches):
        for views, idf, starts, _, at, tf, words in bag_columns(batches, count, with_terms=True):
            mine = np.flatnonzero(views == view)
            if len(mine):
                w = np.stack([idf * np.add.reduceat(tf * a[at], starts) for a in found.value[lane]])
                yield _terms(words, mine, idf[mine], w[:, mine])

    return blocks.mapInArrow(run, TERMS)


def single_terms(alone: DataFrame, found, views: np.ndarray, offsets: dict[int, int], view: int, lane: slice, n_rows: int) -> DataFrame:
    """The same of terms that one row of the view has."""
    idf = float(np.log((1.0 + n_rows) / 2.0) + 1.0)
    owner = alone.sparkSession.sparkContext.broadcast((views, offsets))

    def run(batches):
        views, offsets = owner.value
        for batch in batches:
            for row in batch.to_pylist():
                words, at, n = unpack(row["data"])
                at = at.astype(np.int64) + offsets[row["chunk"]]
                mine = np.flatnonzero(views[at] == view)
                if len(mine):
                    yield _terms(words, mine, np.full(len(mine), idf), (1.0 + np.log(n[mine].astype(float))) * idf * found.value[lane][:, at[mine]])

    return alone.select("chunk", "data").mapInArrow(run, TERMS)


def vocabulary(answers: DataFrame, first: dict[int, int], n_rows: Sequence[int], lanes: Sequence[Sequence[tuple[int, int]]]) -> DataFrame:
    """``(model, term, idf, idx)`` of the shared n-grams, for each model of their view."""
    count = np.array(n_rows, float)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, view, df = unpack(row["data"])
                if not len(view):
                    continue
                terms, idf = grams.unpacked(pa.array([words], pa.binary()))[0], np.log((1.0 + count[view]) / (1.0 + df)) + 1.0
                idx = first[row["bucket"]] + np.arange(len(view))
                for v in np.unique(view):
                    mine = np.flatnonzero(view == v)
                    for task, _ in lanes[v]:
                        arrays = [pa.array(np.full(len(mine), task, np.int32)), terms.take(pa.array(mine)), pa.array(idf[mine]), pa.array(idx[mine])]
                        yield pa.RecordBatch.from_arrays(arrays, names=["model", "term", "idf", "idx"])

    return answers.where("chunk = -1").select("bucket", "data").mapInArrow(run, "model int, term string, idf double, idx bigint")
