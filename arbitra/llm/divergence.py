"""How far each source's term distribution lies from its language's and from other sources'."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbitra.llm.common import Scratch, table

# A term is a run of ASCII letters and characters beyond ASCII; these characters lie between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
# Documents of a language that hold a kept term, scale of probabilities, added count, and last rank of terms.
MIN_DOCS, SCALE, PRIOR, RANKS = 3, 1_000_000_000, 1, 200
# Text of one step of the counting pipeline, and distinct terms that a task holds before it hands them on.
STEP_BYTES, HELD = 4_000_000, 300_000
# Term counts of one shard of a language.
SHARD = 500_000

PARTIAL = "lang string, source string, term string, n bigint, docs bigint"


def _count(step: pa.Table) -> pa.Table:
    """``PARTIAL`` rows of documents ``(lang, source, text)``."""
    text = pc.ascii_lower(step["text"].combine_chunks())
    parts = pc.split_pattern_regex(text, BETWEEN)
    term = pc.list_flatten(parts)
    row = pc.list_parent_indices(parts)
    full = pc.not_equal(term, "")
    term, row = term.filter(full), row.filter(full)
    codes = term.dictionary_encode()
    each = pa.table({"row": row, "code": codes.indices}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    keys = [step[c].take(each["row"]).combine_chunks() for c in ("lang", "source")]
    found = pa.table({"lang": keys[0], "source": keys[1], "code": each["code"], "n": each["count_all"]})
    found = found.group_by(["lang", "source", "code"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    return pa.table(
        {"lang": found["lang"], "source": found["source"], "term": codes.dictionary.take(found["code"].combine_chunks()), "n": found["n_sum"], "docs": found["count_all"]}
    )


def _merge(parts: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return found.rename_columns(["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``PARTIAL`` rows, one per language, source and term: occurrences and documents.

    Counted by Arrow inside the tasks, with a bounded table per task that is handed on when full, then added up by a shuffle.
    Null language, source and text are ''. Documents are rows: a repeated row counts again. No rows give no rows.
    """

    def run(batches):
        held: list[pa.Table] = []
        size = 0
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t.set_column(2, "text", t["text"].cast(pa.large_string()))
            ends = pc.cumulative_sum(pc.binary_length(t["text"])).to_numpy()
            at = 0
            while at < t.num_rows:
                before = ends[at - 1] if at else 0
                to = max(int(np.searchsorted(ends, before + STEP_BYTES)), at + 1)
                held.append(_count(t.slice(at, to - at)))
                at, size = to, size + held[-1].num_rows
                if size > 2 * HELD:
                    held = [_merge(held)]
                    size = held[0].num_rows
                    pa.default_memory_pool().release_unused()
                    if size > HELD:
                        yield from _sent(held[0])
                        held, size = [], 0
        if held:
            yield from _sent(_merge(held))

    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in (("lang", "lang"), ("source", "source"), (text, "text"))]
    partial = docs.select(*cols).mapInArrow(run, PARTIAL)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _sent(t: pa.Table):
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    yield from t.cast(pa.schema(list(zip(t.column_names, kinds, strict=True)))).to_batches(max_chunksize=50_000)


def probability(n, total, vocabulary):
    """``1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * vocabulary))``, exact for any counts; null without vocabulary."""
    wide = lambda c: c.cast("decimal(19,0)")
    below = wide(total + PRIOR * vocabulary).cast("decimal(38,0)")
    above = (wide(n + PRIOR) * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    return F.when(vocabulary > 0, F.lit(1).cast("bigint") + F.call_function("div", above, below))


def _gap(p, q):
    """``floor((p - q)^2 / q)`` of whole numbers; the square of SCALE fits 64 bits."""
    return (p - q) * (p - q) // q


def _shard(entries: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums over one shard's terms of ``_gap`` for all ordered pairs of a language's sources.

    A term that neither or only one of two sources holds takes their constant for absent terms, so only terms held by both
    are visited by pair: sum over both of [f(x, y) - f(x, 0y) - f(0x, y) + f(0x, 0y)], plus f(x, 0y) over x's terms,
    f(0x, y) over y's, and f(0x, 0y) for the rest.
    """
    lang = sources["lang"][0].as_py()
    names = sources["source"].to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i])
    names = [names[i] for i in order]
    size = len(names)
    absent = np.array(pc.fill_null(sources["absent"], 1).to_pylist(), np.int64)[order]
    total = np.zeros((size, size), np.int64)  # [x, y]: p of x, q of y
    if entries.num_rows:
        at = {s: i for i, s in enumerate(names)}
        src = entries["source"].combine_chunks().dictionary_encode()
        s = np.array([at[x] for x in src.dictionary.to_pylist()], np.int64)[src.indices.to_numpy()]
        term = entries["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        p = entries["p"].to_numpy()
        by = np.lexsort((s, term))
        s, term, p = s[by], term[by], p[by]
        held = np.bincount(s, minlength=size)
        total += (len(np.unique(term)) - held[:, None] - held[None, :]) * _gap(absent[:, None], absent[None, :])
        # one source's terms against the constant of each other
        kinds, n = np.unique(np.stack([s, p]), axis=1, return_counts=True)
        for y in range(size):
            np.add.at(total[:, y], kinds[0], n * _gap(kinds[1], absent[y]))
            np.add.at(total[y, :], kinds[0], n * _gap(absent[y], kinds[1]))
        # terms held by both: entries of a term lie together, so partners are so many places apart
        for d in range(1, size):
            i = np.nonzero(term[d:] == term[:-d])[0]
            if not len(i):
                break
            for x, y in ((i, i + d), (i + d, i)):
                px, py, ax, ay = p[x], p[y], absent[s[x]], absent[s[y]]
                np.add.at(total, (s[x], s[y]), _gap(px, py) - _gap(px, ay) - _gap(ax, py) + _gap(ax, ay))
    x, y = np.nonzero(~np.eye(size, dtype=bool))
    name = np.array(names, object)
    return pa.table(
        {"lang": pa.array([lang] * len(x), pa.string()), "source": pa.array(name[x], pa.string()), "item": pa.array(name[y], pa.string()), "value": pa.array(total[x, y], pa.int64())}
    )


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, ranks: int = RANKS, text: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each source's divergence from the other sources of its language
    (part ``pair``) and the terms that set it apart from its language (part ``term``).

    A language keeps the terms of at least ``min_docs`` of its documents. With ``p`` and ``q`` as ``probability``, a term's
    value is ``floor((p - q)^2 / q)``: of a source against another, summed over all kept terms, absent ones included; of a source
    against its language for the terms it uses more, the first ``ranks``. Values descend, ties by the item's bytes.

    Null language, source or text is ''. A repeated row counts again; ids and other columns are not read. Sources without
    terms have a probability for each kept term like any other; languages without kept terms give pairs of value 0. An
    empty table gives no rows. A language's terms are cut into shards; a shard gives one row per pair of sources, which is the size of the result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    counts = scratch.write(term_counts(docs, text), "terms")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    overall = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = scratch.write(counts.join(overall.drop("docs"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept")
    scratch.drop(counts)
    each = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("entries"))
    # every kept term's language count once: through the rows of its first source
    firsts = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang")
    whole = firsts.agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("vocabulary"))
    zero = F.lit(0).cast("bigint")
    shards = (F.floor(F.sum(F.coalesce("entries", zero)).over(Window.partitionBy("lang")) / SHARD) + 1).alias("shards")
    groups = scratch.write(
        groups.join(each, ["lang", "source"], "left").join(whole, "lang", "left").select(
            "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("lang_total", zero).alias("lang_total"),
            F.coalesce("vocabulary", zero).alias("vocabulary"), shards,
        ),
        "groups",
    )
    p = probability(F.col("n"), F.col("total"), F.col("vocabulary"))
    q = probability(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    rows = kept.join(groups, ["lang", "source"]).withColumns({"p": p, "q": q})
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard")
    entries = rows.select("lang", "source", "term", "p", shard)
    sources = groups.select("lang", "source", probability(zero, F.col("total"), F.col("vocabulary")).alias("absent"), F.explode(F.sequence(zero, F.col("shards") - 1)).alias("shard"))
    by = ["lang", "shard"]
    sums = entries.groupBy(by).cogroup(sources.groupBy(by)).applyInArrow(_shard, "lang string, source string, item string, value bigint")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    d = F.col("p") - F.col("q")
    terms = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), F.call_function("div", d * d, F.col("q")).alias("value"), F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", F.row_number().over(order)).select(*out).unionAll(first.select(*out))


def op13_source_divergence(spark, sf: str) -> DataFrame:
    """The audit of all documents."""
    return audit(table(spark, sf, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP13_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS text FROM documents),
t AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
g AS (SELECT DISTINCT lang, source FROM docs),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT d) >= {MIN_DOCS}),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, sum(lang_n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM k GROUP BY lang),
s AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (s.total + {PRIOR} * l.v) AS p,
    1 + ({SCALE}::HUGEINT * (k.lang_n + {PRIOR})) // (l.total + {PRIOR} * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM x WHERE n > 0 AND p > q
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source LEFT JOIN x y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM f)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {RANKS}
"""
