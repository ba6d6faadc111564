"""Text features as tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbitra.functions import grams
from arbitra.functions.text import N_BUCKETS, bucket_counts, characters, fnv_buckets, joined_words, lowered, tokens_word, word_counts
from arbitra.session import may_broadcast

# Own choices for the shuffle join beyond the broadcast bound.
HEAVY_PARTS = 1000
SALTS = 4096

# Own choices: bytes of text whose n-grams a task counts at once, and terms of a vocabulary it holds at once; buckets that number a vocabulary.
STEP_BYTES = 8 * 1024 * 1024
STEP_TERMS = 500_000
INDEX_BUCKETS = 4096


def hashed_tf(df: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Sparse hashed bag of words: (id, bucket, x). Counted inside each row, so
    nothing is shuffled."""
    return df.select(id_col, *keep, F.explode(bucket_counts(text_col)).alias("t")).select(
        id_col, *keep, F.col("t.key").alias("bucket"), F.col("t.n").cast("double").alias("x")
    )


def _as_vectors(df: DataFrame, size: int, pairs: str, out: str) -> DataFrame:
    """Turn array<struct<i, x>> into an MLlib sparse vector.

    The struct below is the vector type's own storage layout, so the Arrow
    batches pass through untouched.
    """
    others = [f for f in df.schema.fields if f.name != pairs]
    laid_out = df.select(
        *[f.name for f in others],
        F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            F.lit(size).alias("size"),
            F.transform(F.col(pairs), lambda p: p["i"].cast("int")).alias("indices"),
            F.transform(F.col(pairs), lambda p: p["x"].cast("double")).alias("values"),
        ).alias(out),
    )

    def pass_through(batches):
        batch: pa.RecordBatch
        for batch in batches:
            yield batch

    return laid_out.mapInArrow(pass_through, T.StructType([*others, T.StructField(out, VectorUDT())]))


def bucketed(df: DataFrame, text_col: str, keep: Sequence[str | Column]) -> DataFrame:
    """``keep``, ``idx array<int>`` and ``n array<int>``: the hashed bag of words of each row, by bucket. Counted a few megabytes of text at a time."""
    chars = characters(df.sparkSession, "alnum")
    fields = df.select(*keep).schema.fields
    names, b_text = [*(f.name for f in fields), "idx", "n"], len(fields)

    def run(batches):
        for b in grams.steps(batches, b_text, STEP_BYTES):
            words, sizes = grams.split(joined_words(b.column(b_text), chars, 1), " ")
            row = np.repeat(np.arange(len(sizes)), sizes)
            real = pc.greater(pc.binary_length(words), 0)  # a text without tokens is one empty part
            encoded, row = words.filter(real).dictionary_encode(), row[real.to_numpy(zero_copy_only=False)]
            bucket = fnv_buckets(encoded.dictionary)[encoded.indices.to_numpy(zero_copy_only=False)]
            cells, n = np.unique(row * N_BUCKETS + bucket, return_counts=True)
            at, bucket = np.divmod(cells, N_BUCKETS)
            per = np.bincount(at, minlength=b.num_rows)
            lists = (grams.lists(pa.array(v.astype(np.int32)), per) for v in (bucket, n))
            yield pa.RecordBatch.from_arrays([*b.columns[:b_text], *lists], names=names)

    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([*fields, T.StructField("idx", numbers), T.StructField("n", numbers)])
    return df.select(*keep, lowered(text_col).alias("_text")).mapInArrow(run, schema)


def hashed_vector(df: DataFrame, text_col: str, keep: Sequence[str], out: str = "features") -> DataFrame:
    """One ``N_BUCKETS``-wide sparse vector of term counts per row."""
    pairs = F.transform(bucket_counts(text_col), lambda t: F.struct(t["key"].alias("i"), t["n"].alias("x")))
    return _as_vectors(df.select(*keep, pairs.alias("_pairs")), N_BUCKETS, "_pairs", out)


def _words(text_col: str) -> Column:
    return F.array_join(tokens_word(text_col), " ").alias("_words")


def _chunks(df: DataFrame, text_col: str) -> int:
    """In how many parts the n-grams of all texts are held."""
    return int((df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // STEP_BYTES) + 1


def fit_vocab(
    df: DataFrame, text_col: str, n_min: int = 1, n_max: int = 2, min_df: int = 1, n_rows: int | None = None
) -> DataFrame:
    """(term, df, idf) with ``idf = ln((1+n)/(1+df)) + 1``.

    A row counts a term once. ``min_df`` leaves out rarer terms. Rows are counted a few megabytes at a time inside their tasks; the counts
    are dealt out by hash of the term, as lists, and added up.
    """
    n = F.lit(n_rows) if n_rows is not None else df.agg(F.count("*")).scalar()

    parts = _chunks(df, text_col)

    def count(batches):
        for b in grams.steps(batches, 0, STEP_BYTES):
            g = grams.gram_counts(b.column(0), n_min, n_max)
            order, bucket, sizes = grams.dealt(g.hashes, parts)
            counts = pa.array(np.bincount(g.gram, minlength=len(g.terms))[order].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), grams.packed(g.terms, order, sizes), grams.lists(counts, sizes)], names=["_bucket", "_terms", "_n"])

    def add_up(table: pa.Table) -> pa.Table:
        terms, _ = grams.unpacked(table["_terms"])
        n = pc.list_flatten(table["_n"]).combine_chunks().cast(pa.int64())
        total = pa.table({"term": terms, "n": n}).group_by("term").aggregate([("n", "sum")])
        return pa.table({"term": total["term"], "df": total["n_sum"]})

    listed = df.select(_words(text_col)).mapInArrow(count, "_bucket int, _terms binary, _n array<int>")
    counted = listed.groupBy("_bucket").applyInArrow(add_up, "term string, df bigint")
    if min_df > 1:
        counted = counted.filter(F.col("df") >= min_df)
    return counted.withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def term_rows(
    df: DataFrame, text_col: str, keep: Sequence[str | Column], n_min: int = 1, n_max: int = 2, outer: bool = True
) -> DataFrame:
    """One row per distinct n-gram of each text: ``keep``, term, n. With
    ``outer`` a text without any keeps one row with an empty term."""
    explode = F.explode_outer if outer else F.explode
    rows = df.select(*keep, explode(word_counts(text_col, n_min, n_max)).alias("t"))
    names = [c for c in rows.columns if c != "t"]
    return rows.select(*names, F.coalesce(F.col("t.key"), F.lit("")).alias("term"), F.col("t.n").alias("n"))


def join_terms(
    rows: DataFrame, terms: DataFrame, n_terms: int, row_bytes: int, on: Sequence[str], id_col: str, how: str
) -> DataFrame:
    """Join term rows with a term table: by broadcast while the table's size is
    within bounds, else by a shuffle join that frequent terms cannot skew.

    Beyond the bound, terms expected to make up more than 1/``HEAVY_PARTS`` of
    the rows (fewer than ``HEAVY_PARTS`` terms, whatever the table holds) are
    looked up by broadcast. Their rows, and those of texts without terms, then
    pass the shuffle under ``SALTS`` keys of their own, by row id.
    """
    if may_broadcast(n_terms, row_bytes):
        return rows.join(F.broadcast(terms), list(on), how)
    if "idf" not in terms.columns:  # a fixed number of buckets: no rare, no frequent terms to tell apart
        return rows.join(terms, list(on), how)
    values = [c for c in terms.columns if c not in on]
    share = F.exp(1.0 - F.col("idf"))  # in proportion to the document frequency
    heavy = terms.filter(share * HEAVY_PARTS > terms.agg(F.sum(share)).scalar())
    heavy = heavy.select(*on, *[F.col(v).alias(f"_h_{v}") for v in values])
    seen = rows.join(F.broadcast(heavy), list(on), "left")
    settled = F.col("_h_idf").isNotNull() | (F.col("term") == "")
    # No term contains a control character, so these keys match nothing. The
    # key must differ in itself: a constant second key would be optimised away.
    own_key = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("string"))
    keyed = seen.withColumn("_term", F.when(settled, own_key).otherwise(F.col("term")))
    others = [c for c in on if c != "term"]
    out = keyed.join(terms.withColumnRenamed("term", "_term"), [*others, "_term"], "left")
    out = out.select(*rows.columns, *[F.coalesce(f"_h_{v}", v).alias(v) for v in values])
    return out.filter(F.col("idf").isNotNull()) if how == "inner" else out


def tf_weight(n: Column, idf: Column) -> Column:
    """Sublinear term frequency times idf."""
    return (F.lit(1.0) + F.log(n.cast("double"))) * idf


def _with_terms(
    df: DataFrame, cols: Sequence[str], by: Sequence[str], text_col: str, vocab: DataFrame, n_terms: int, n_min: int, n_max: int, lay_out, schema: T.StructType
) -> DataFrame:
    """``lay_out(texts, counted n-grams, values)`` for chunks of a few megabytes of text, where values hold the columns of ``vocab``
    for each n-gram of the chunk and null for those it lacks. Texts keep ``cols``; rows with equal ``by`` share a chunk.

    A chunk asks for each of its n-grams once, however many of its rows hold it. What it asks for is dealt out by hash as lists, met there
    with that part of the vocabulary, and only the values come back. So a term that all texts hold is asked for once a chunk, not once a row,
    and no bucket of terms is larger than the others.
    """
    values = [c for c in vocab.columns if c != "term"]
    chunks = _chunks(df, text_col)
    parts = max(chunks, n_terms // STEP_TERMS + 1)
    chunk = F.pmod(F.xxhash64(*by), F.lit(chunks)).cast("int").alias("_chunk")
    texts = df.select(chunk, *cols, _words(text_col))
    arrays = [T.StructField(c, T.ArrayType(vocab.schema[c].dataType)) for c in values]
    key, listed = T.StructField("_bucket", T.IntegerType()), T.StructField("_terms", T.BinaryType())
    asks = T.StructType([T.StructField("_chunk", T.IntegerType()), key, listed])

    def ask(table: pa.Table) -> pa.Table:
        g = grams.gram_counts(table["_words"], n_min, n_max)
        order, bucket, sizes = grams.dealt(g.hashes, parts)
        return pa.table({"_chunk": pa.array([table["_chunk"][0].as_py()] * len(bucket), pa.int32()), "_bucket": bucket, "_terms": grams.packed(g.terms, order, sizes)})

    def list_up(batches):
        held, n = [], 0

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            terms = t["term"].combine_chunks()
            order, bucket, sizes = grams.dealt(grams.term_hashes(terms), parts)
            columns = [grams.lists(t[c].combine_chunks().take(pa.array(order)), sizes) for c in values]
            return pa.RecordBatch.from_arrays([pa.array(bucket), grams.packed(terms, order, sizes), *columns], names=["_bucket", "_terms", *values])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= STEP_TERMS:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
        wanted, sizes = grams.unpacked(asked["_terms"])
        terms, _ = grams.unpacked(known["_terms"])
        at = pc.index_in(wanted, value_set=terms)
        found = {c: grams.lists(pc.list_flatten(known[c].combine_chunks()).take(at), sizes) for c in values}
        return pa.table({"_chunk": asked["_chunk"], "_bucket": asked["_bucket"], **found})

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        g = grams.gram_counts(table["_words"], n_min, n_max)
        order = grams.dealt(g.hashes, parts)[0]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        answers = answers.sort_by("_bucket")
        found = {c: pc.list_flatten(answers[c].combine_chunks()).take(pa.array(back)) for c in values}
        return lay_out(table, g, found)

    asked = texts.groupBy("_chunk").applyInArrow(ask, asks)
    known = vocab.select("term", *values).mapInArrow(list_up, T.StructType([key, listed, *arrays]))
    answers = asked.groupBy("_bucket").cogroup(known.groupBy("_bucket")).applyInArrow(look_up, T.StructType([*asks.fields[:2], *arrays]))
    return texts.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(finish, schema)


def _cells(g: grams.Grams, found: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram and weight of the rows' n-grams that the vocabulary holds."""
    idf = found["idf"].to_numpy(zero_copy_only=False)
    known = found["idf"].is_valid().to_numpy(zero_copy_only=False)[g.gram]
    row, gram, n = g.row[known], g.gram[known], g.n[known]
    return row, gram, (1.0 + np.log(n)) * idf[gram]


def tfidf_weights(
    df: DataFrame,
    id_col: str,
    text_col: str,
    vocab: DataFrame,
    n_terms: int,
    keep: Sequence[str] = (),
    n_min: int = 1,
    n_max: int = 2,
    norm: str | None = None,
) -> DataFrame:
    """(id, term, x) for in-vocabulary terms, before normalisation. A column ``norm`` gets the Euclidean norm of the id's weights."""
    cols = [id_col, *keep]

    def lay_out(table: pa.Table, g: grams.Grams, found: dict[str, pa.Array]) -> pa.Table:
        row, gram, x = _cells(g, found)
        out = {c: table[c].take(pa.array(row)) for c in cols} | {"term": g.terms.take(pa.array(gram)), "x": x}
        if norm:
            own = grams.codes([table[id_col]], table.num_rows)[row]
            out[norm] = np.sqrt(np.bincount(own, x * x))[own]
        return pa.table(out)

    doubles = [T.StructField(c, T.DoubleType()) for c in ("x", norm) if c]
    schema = T.StructType([*df.select(*cols).schema.fields, T.StructField("term", T.StringType()), *doubles])
    by = [id_col] if norm else [id_col, text_col]
    return _with_terms(df, cols, by, text_col, vocab.select("term", "idf"), n_terms, n_min, n_max, lay_out, schema)


def l2_normalize(weights: DataFrame, id_col: str, x: str = "x", norm: str | None = None) -> DataFrame:
    """Divide each row's weights by their Euclidean norm; a zero row stays zero.

    ``norm`` names a column that holds the norm of the id's weights; it is dropped, and nothing is shuffled. Without it the norm is
    summed up in a window, whose partition holds one text's distinct terms, which came from one row.
    """
    if norm is None:
        norm = "_norm"
        weights = weights.withColumn(norm, F.sqrt(F.sum(F.col(x) * F.col(x)).over(Window.partitionBy(id_col))))
    return weights.withColumn(x, F.when(F.col(norm) > 0, F.col(x) / F.col(norm)).otherwise(F.lit(0.0))).drop(norm)


def index_vocab(vocab: DataFrame) -> DataFrame:
    """Add ``idx``, a dense 0-based number per term, the same on every run.

    Terms are numbered in order within buckets by hash. Reads ``vocab`` twice; give it a table on disk.
    """
    d = vocab.withColumn("_b", F.pmod(F.xxhash64("term"), F.lit(INDEX_BUCKETS)).cast("int"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over one row per bucket
    offsets = d.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = d.withColumn("idx", F.row_number().over(Window.partitionBy("_b").orderBy("term")))
    return numbered.join(F.broadcast(offsets), "_b").withColumn("idx", (F.col("idx") + F.col("_off") - 1).cast("int")).drop("_b", "_off")


def tfidf_vector(
    df: DataFrame,
    id_col: str,
    text_col: str,
    vocab: DataFrame,
    n_terms: int,
    keep: Sequence[str] = (),
    n_min: int = 1,
    n_max: int = 2,
    out: str = "features",
) -> DataFrame:
    """One L2-normalised sparse TF-IDF vector per row; ``vocab`` has ``idx``. Rows that share id and ``keep`` share a vector."""
    cols = [id_col, *keep]

    def lay_out(table: pa.Table, g: grams.Grams, found: dict[str, pa.Array]) -> pa.Table:
        row, gram, x = _cells(g, found)
        own = grams.codes([table[c] for c in cols], table.num_rows)
        names, first = np.unique(own, return_index=True)
        own = np.searchsorted(names, own)[row]
        norm = np.sqrt(np.bincount(own, x * x, minlength=len(names)))
        idx = pc.fill_null(found["idx"], 0).to_numpy(zero_copy_only=False)[gram].astype(np.int32)
        order = np.lexsort((x, idx, own))
        pairs = pa.StructArray.from_arrays([pa.array(idx[order]), pa.array((x / norm[own])[order])], names=["i", "x"])
        laid = {c: table[c].take(pa.array(first)) for c in cols}
        return pa.table(laid | {"_p": grams.lists(pairs, np.bincount(own, minlength=len(names)))})

    pair = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("x", T.DoubleType())])
    schema = T.StructType([*df.select(*cols).schema.fields, T.StructField("_p", T.ArrayType(pair))])
    bags = _with_terms(df, cols, cols, text_col, vocab.select("term", "idf", "idx"), n_terms, n_min, n_max, lay_out, schema)
    return _as_vectors(bags, n_terms, "_p", out)
