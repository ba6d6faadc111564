"""N-gram Jaccard join: entries of the sparse product of document by n-gram incidence that can reach the threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.llm.common import Scratch, components, table
from arbitra.llm.tokens import Cache
from arbitra.session import may_broadcast

# Documents by which the frequent n-grams are found, how often one must occur there, and how many are broadcast (2 MB).
# They only order the n-grams: results do not depend on them.
SAMPLE_DOCS = 16_384
FREQUENT = 3
MAX_FREQUENT = 1 << 17
# In a posting list of up to so many documents every pair is a candidate at once.
SMALL = 6
# N-grams that one block of the product holds on average (8 bytes each).
BLOCK = 500_000
# Rows of a long list that one cell of its grid holds on either side.
CELL = 2_000
# Column blocks of the incidence matrix, by the top bits of an n-gram's hash, whose sizes bound an overlap.
COLUMN_BITS = 7
_FULL = np.iinfo(np.uint16).max

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA24BAED4963EE407, 0x9FB21C651E98DF25], np.uint64)


class Shingler:
    """Distinct word n-grams of a text as sorted 64-bit hashes. A shorter text is one n-gram, an empty one has none."""

    def __init__(self, n: int):
        self.n = n
        self.word = Cache(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower() and bytes.split() know ASCII only: the contract's lower case and white space
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out += (h[k : len(h) - n + 1 + k] ^ (h[k : len(h) - n + 1 + k] >> np.uint64(29))) * _ODD[k]
        return np.unique(out)


def frequent(docs: DataFrame, n_gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that are frequent among a bounded sample of documents, ascending, with their counts there."""
    total = docs.count()
    part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(min(1.0, SAMPLE_DOCS / max(total, 1)) * (1 << 30)))

    def run(batches):
        shingles = Shingler(n_gram)
        for b in batches:
            u, c = np.unique(np.concatenate([shingles(t.as_py()) for t in b.column(0)] or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"g": u.view(np.int64), "c": c.astype(np.int64)})

    seen = part.select("text").mapInArrow(run, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT)
    got = seen.orderBy(F.desc("c"), "g").limit(MAX_FREQUENT).toArrow()
    g, c = got.column("g").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(g)
    return g[order], c[order]


def signatures(docs: DataFrame, n_gram: int, percent: int) -> DataFrame:
    """``(doc_id, n, set_id, prefix, sizes)``: size and digest of each set, its rarest n-grams in the common order, and its size in each column block.

    Two sets can only reach the threshold if their prefixes meet: of ``n`` n-grams, all but ``ceil(percent * n / 100) - 1``.
    """
    grams, counts = frequent(docs, n_gram)
    known = docs.sparkSession.sparkContext.broadcast((grams, counts))

    def run(batches):
        shingles = Shingler(n_gram)
        grams, counts = known.value
        for b in batches:
            out = [[], [], [], [], []]
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(t.as_py())
                n = len(s)
                if len(grams):
                    at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
                    often = np.where(grams[at] == s, counts[at], 0)
                    ordered = s[np.lexsort((s, often))]
                else:
                    ordered = s
                prefix = ordered[: n - (percent * n + 99) // 100 + 1] if n else ordered
                sizes = np.bincount((s >> np.uint64(64 - COLUMN_BITS)).astype(np.int64), minlength=1 << COLUMN_BITS)
                sizes = np.minimum(sizes, _FULL).astype(np.uint16).tobytes()
                for c, v in zip(out, (key, n, xxhash.xxh3_128_digest(s.tobytes()), prefix.view(np.int64), sizes), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            names = ["doc_id", "n", "set_id", "prefix", "sizes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, set_id binary, prefix array<bigint>, sizes binary")


def reachable(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b, na, nb)`` whose overlap can reach the threshold by the sizes of their column blocks.

    An overlap is at most the sum over the blocks of the smaller of both sizes, so no link is lost. A size too large for its
    16 bits bounds nothing.
    """
    sizes = signed.select("doc_id", "sizes").dropDuplicates(["doc_id"])
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("doc_id").alias(side), F.col("sizes").alias(f"s{side}")), side)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            p, q = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in (4, 5))
            least = np.minimum(p, q).astype(np.int64)
            na, nb = (b.column(c).to_numpy() for c in (2, 3))
            ok = (least.sum(1) * (100 + percent) >= (na + nb) * percent) | (least == _FULL).any(1)
            yield b.select([0, 1, 2, 3]).filter(pa.array(ok))

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint")


def possible(percent: int, n1: Column, at1: Column, n2: Column, at2: Column) -> Column:
    """Whether two sets whose first common n-gram stands at these places (from 0) can still reach the threshold, by sizes and by what follows."""
    sizes = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
    return sizes & (F.least(n1 - at1, n2 - at2) * (100 + percent) >= (n1 + n2) * percent)


def product(sets: dict[int, np.ndarray], entries: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The entries ``(a, b)`` whose sets reach the threshold, by the product of the incidence of the rows ``a`` with that of the rows ``b``.

    The rows ``b`` are held by n-gram. Each row ``a`` adds one to the overlap of every row ``b`` in the list of each of its n-grams;
    entries whose overlap stays below what both sizes ask for are discarded.
    """
    columns = np.array(sorted(set(entries["b"])), np.int64)
    sizes = np.array([len(sets[b]) for b in columns], np.int64)
    grams = np.concatenate([sets[b] for b in columns] or [np.zeros(0, np.uint64)])
    order = np.argsort(grams, kind="stable")
    grams, row = grams[order], np.repeat(np.arange(len(columns)), sizes)[order]
    entries = entries.sort_values("a", kind="stable")
    asking, start = np.unique(entries["a"].to_numpy(), return_index=True)
    linked = [(np.zeros(0, np.int64),) * 2]
    for a, asked in zip(asking.tolist(), np.split(entries["b"].to_numpy(), start[1:]), strict=False):
        s = sets[a]
        first, last = np.searchsorted(grams, s, "left"), np.searchsorted(grams, s, "right")
        n = last - first
        at = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        both = np.bincount(row[at], minlength=len(columns))
        k = np.searchsorted(columns, asked)
        k = k[both[k] * (100 + percent) >= (len(s) + sizes[k]) * percent]
        linked.append((np.full(len(k), a), columns[k]))
    a, b = map(np.concatenate, zip(*linked, strict=True))
    return pd.DataFrame({"a": a, "b": b}, dtype="int64")


def grid(left: DataFrame, right: DataFrame, key: str, row: str, cell: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``key`` with a column ``cell``: the join on both columns meets the same pairs once each.

    A key with many rows becomes a grid whose cells hold about ``cell`` rows of either side: rows are dealt to parts of their side by
    ``row`` and are repeated for each part of the other side.
    """
    n = left.groupBy(key).agg(F.ceil(F.count("*") / cell).alias("_l")).join(right.groupBy(key).agg(F.ceil(F.count("*") / cell).alias("_r")), key)
    parts = {side: F.pmod(F.xxhash64(row), F.col(f"_{side}")) for side in "lr"}
    every = {side: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"_{side}") - 1)) for side in "lr"}
    left = left.join(n, key).withColumn("_i", parts["l"]).withColumn("_j", every["r"])
    right = right.join(n, key).withColumn("_j", parts["r"]).withColumn("_i", every["l"])
    return tuple(x.withColumn("cell", F.struct("_i", "_j")).drop("_i", "_j", "_l", "_r") for x in (left, right))


def overlaps(pairs: DataFrame, docs: DataFrame, n_gram: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs ``(a, b)`` of ``pairs`` (a, b, na, nb) that reach the threshold, by their exact overlap count.

    The product is computed in blocks. A block holds the rows ``b`` that have the same smallest partner and the rows ``a`` they meet, or a
    part of either side where its summed sizes exceed BLOCK: a row that meets many, whichever side it is on, is sent to every part
    and its partners are dealt over them. Each row is sent to a block once.
    """
    spark = docs.sparkSession
    size = pairs.agg(F.sum(F.col("na") + F.col("nb"))).first()[0]
    if not size:
        return pairs.select("a", "b")
    n_blocks = max(int(size // BLOCK) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    homes = pairs.groupBy("b").agg(F.min("a").alias("home"), F.max("nb").alias("nb"))
    # Each row counts once in a home, on either side.
    sides = pairs.select("a", "na", "b").join(homes.select("b", "home"), "b").groupBy("home", "a").agg(F.max("na").alias("na"))
    parts = lambda n, name: (F.floor(F.sum(n) / BLOCK) + 1).alias(name)
    heavy = homes.groupBy("home").agg(parts("nb", "b_parts")).join(sides.groupBy("home").agg(parts("na", "a_parts")), "home")
    homes = homes.join(heavy, "home").select("b", "home", "a_parts", "b_parts")
    dealt = [F.pmod(F.xxhash64(x), F.col(f"{x}_parts")) for x in ("a", "b")]
    block = F.pmod(F.xxhash64("home", *dealt), F.lit(n_blocks)).alias("block")
    placed = scratch.write(pairs.join(homes, "b").select("a", "b", "na", "nb", block), "entries")
    rows = placed.select(F.col("block").alias("row_block"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    # Rows travel as texts, which compress where their n-grams' hashes do not.
    incidence = rows.join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").select("row_block", "doc_id", "text")

    def count(rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        shingles = Shingler(n_gram)
        x = {k: shingles(t) for k, t in zip(rows["doc_id"], rows["text"], strict=True)}
        return product(x, entries[["a", "b"]].astype("int64"), percent)

    linked = scratch.write(incidence.groupBy("row_block").cogroup(placed.groupBy("block")).applyInPandas(count, "a bigint, b bigint"), "links")
    scratch.drop(placed)
    return linked


def jaccard_groups(docs: DataFrame, *, n_gram: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: documents grouped by links between sets of at least ``percent`` % Jaccard similarity.

    1. Equal sets become one row, so copies are not paired.
    2. Each row lists its prefix. Rows that list the same n-gram are candidates if sizes and places allow the threshold.
    3. In a short list all pairs are counted. In a long one all rows are first counted against the most central row; where all then are in one
       component nothing is left to do. Rows in another component are counted against all rows that are not in theirs,
       in a grid of cells where a list is long. Of those, pairs that the sizes of their column blocks rule out are dropped.
    4. Overlaps of the remaining entries are counted exactly (``overlaps``), and links are joined into components.

    Every link joins two rows of one component at the end, and no other pair is joined; no cap applies. A null or empty text has no set and is alone.
    Rows that repeat an id and a text give one row. The id is a number; null ids are one document. Empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed = scratch.write(signatures(docs, n_gram, percent), "signatures")
    sets = scratch.write(signed.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("n").alias("rep_n")), "sets")
    # The size follows from the set. As a key it is read by both uses of the postings, which so share one exchange of the prefixes.
    one = (signed["doc_id"] == sets["rep"]) & (signed["set_id"] == sets["set_id"]) & (signed["n"] == sets["rep_n"])
    postings = (
        signed.where("n > 0").join(sets, one, "left_semi")
        .select(F.col("doc_id").alias("doc"), "n", F.posexplode("prefix").alias("at", "g"))
    )
    # Most n-grams stand in one row: they are counted by themselves, and only rows of the others go on.
    sizes = postings.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    shared = scratch.write(postings.join(sizes, "g"), "postings")
    # Lists of the same rows count once, with each row's first place in any of them; ``m`` stands for the rows.
    members = [F.bit_xor(F.xxhash64("doc", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    same = shared.groupBy("g").agg(F.count("*").alias("k"), *members).select("g", F.xxhash64("k", "x1", "x2").alias("m"))
    lists = shared.join(same, "g").groupBy("m", "size", "doc", "n").agg(F.min("at").alias("at"))
    lists = scratch.write(lists.withColumnRenamed("m", "g"), "lists")
    scratch.drop(shared)

    def pairs_of(left: DataFrame, right: DataFrame, extra: Column | None = None) -> DataFrame:
        one, two = left.alias("one"), right.alias("two")
        c = F.col
        when = (c("one.g") == c("two.g")) & possible(percent, c("one.n"), c("one.at"), c("two.n"), c("two.at"))
        joined = one.join(two, when & extra)
        return joined.select(c("one.doc").alias("a"), c("two.doc").alias("b"), c("one.n").alias("na"), c("two.n").alias("nb"))

    def ordered(pairs: DataFrame) -> DataFrame:
        s = F.when(F.col("a") < F.col("b"), F.struct("a", "b", "na", "nb")).otherwise(
            F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb"))
        )
        return pairs.select(s.alias("s")).select("s.*").distinct()

    short, long = lists.where(f"size <= {SMALL}"), lists.where(f"size > {SMALL}")
    c = long.groupBy("g").agg(F.min(F.struct("at", "doc", "n")).alias("c"))
    long = scratch.write(long.join(c.select("g", F.col("c.doc").alias("c_doc"), F.col("c.n").alias("c_n"), F.col("c.at").alias("c_at")), "g"), "long")
    narrow = ["g", "doc", "n", "at"]
    star = long.where("doc <> c_doc").where(possible(percent, F.col("n"), F.col("at"), F.col("c_n"), F.col("c_at"))).select(
        F.col("c_doc").alias("a"), F.col("doc").alias("b"), F.col("c_n").alias("na"), F.col("n").alias("nb")
    )
    first = pairs_of(short.select(*narrow), short.select(*narrow), F.col("one.doc") < F.col("two.doc"))
    tried = scratch.write(ordered(first.unionAll(star)), "tried")
    scratch.drop(lists)
    links = overlaps(tried, docs, n_gram, percent, scratch)
    groups = scratch.write(components(links, scratch), "groups")
    # Long lists whose rows are not all in the component of the central row.
    own = groups.select(F.col("node").alias("doc"), F.col("component").alias("own"))
    central = groups.select(F.col("node").alias("c_doc"), F.col("component").alias("c_own"))
    mixed = long.join(own, "doc", "left").join(central, "c_doc", "left").select(*narrow, F.coalesce("own", "doc").alias("own"), F.coalesce("c_own", "c_doc").alias("c_own"))
    mixed = scratch.write(mixed, "mixed")
    scratch.drop(long)
    # Two rows of two components can only meet in lists that are still open, so the others are done.
    still = scratch.write(mixed.join(mixed.where("own <> c_own").select("g").distinct(), "g", "left_semi"), "open")
    scratch.drop(mixed)
    # A pair that shares several open lists is a candidate in that with the smallest number only, judged by each row's first place in any.
    all_lists = still.groupBy("doc").agg(F.min("at").alias("at0"), F.collect_set("g").alias("ids"))
    mixed = scratch.write(still.join(all_lists, "doc").drop("at").withColumnRenamed("at0", "at"), "mixed")
    scratch.drop(still)
    left_out, all_rows = grid(mixed.where("own <> c_own"), mixed, "g", "doc", CELL)
    once = F.col("one.g") == F.array_min(F.array_intersect("one.ids", "two.ids"))
    second = pairs_of(left_out, all_rows, (F.col("one.cell") == F.col("two.cell")) & (F.col("one.own") != F.col("two.own")) & once)
    rest = scratch.write(ordered(second).join(tried, ["a", "b"], "left_anti"), "rest")
    scratch.drop(mixed, tried)
    possibly = scratch.write(reachable(rest, signed, percent), "rest")
    ids = scratch.write(signed.select("doc_id", "n", "set_id").distinct(), "ids")
    scratch.drop(rest, signed)
    more = overlaps(possibly, docs, n_gram, percent, scratch)
    if not more.isEmpty():
        groups = scratch.write(components(links.unionAll(more), scratch), "groups")
    final = ids.join(sets.select("set_id", "rep"), "set_id", "left")
    final = final.join(groups, F.col("rep") == F.col("node"), "left")
    return final.groupBy("doc_id").agg(
        F.max("n").alias("n_shingles"), F.min(F.coalesce("component", "rep", "doc_id")).alias("component_id")
    )


def numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(id, digest, key)`` of the texts whose id is null or stands in several rows: a number for each pair of id and text.

    The numbers are larger than any id. Rows that repeat both are one entry.
    """
    ids = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("t"))
    again = ids.groupBy("id").agg(F.count("*").alias("k")).where("k > 1 OR id IS NULL").select(F.col("id").alias("again"))
    rows = ids.join(again, F.col("id").eqNullSafe(F.col("again")), "left_semi")
    top = F.coalesce(F.greatest(ids.agg(F.max("id")).scalar(), F.lit(0)), F.lit(0).cast("bigint"))
    return rows.select("id", F.md5("t").alias("digest")).distinct().withColumn("key", top + 1 + F.monotonically_increasing_id())


def one_of_each(docs: DataFrame, *, n_gram: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with all columns, less those whose text is linked with that of a row that stays: one row of each group.

    Rows are told apart by id and text. That with the smallest id stays; an id that is null or stands in several rows comes after
    all others. Rows that repeat id and text are copies, of which any one stays, also where the text is null, empty or white space.
    Different ids without words all stay. Empty tables give no rows; other columns, whatever their names, are carried along.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    # Only ids that are no key need numbers, so a table with proper ids is not joined with any.
    own = scratch.write(numbered(docs, doc_id, text), "numbers")
    n_own = own.count()
    key, digest = "__key", "__digest"
    keyed = docs.withColumn(key, F.col(doc_id).cast("bigint"))
    if n_own:
        side = own.select(F.col("id").alias("__id"), F.col("digest").alias("__own_digest"), F.col("key").alias("__own"))
        same = F.col(key).eqNullSafe(F.col("__id")) & F.col(digest).eqNullSafe(F.col("__own_digest"))
        side = F.broadcast(side) if may_broadcast(n_own, 64) else side
        keyed = keyed.withColumn(digest, F.md5(F.col(text))).join(side, same, "left").withColumn(key, F.coalesce("__own", key))
    # pruned before the copies' keys are joined, so that the table's own columns alone pass a shuffle
    keyed = keyed.select(*[F.col(f"`{c}`") for c in docs.columns], key)
    groups = jaccard_groups(keyed, n_gram=n_gram, percent=percent, doc_id=key, text=text)
    copies = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key))
    kept = keyed.join(copies, key, "left_anti")
    if n_own:
        ones = own.select(F.col("key").alias(key))
        many = kept.join(F.broadcast(ones) if may_broadcast(n_own, 16) else ones, key, "left_semi").dropDuplicates([key])
        kept = kept.join(F.broadcast(ones) if may_broadcast(n_own, 16) else ones, key, "left_anti").unionByName(many)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_ngram_jaccard(spark, sf: str) -> DataFrame:
    """All documents, linked at 85 % of their 4-word shingles."""
    return jaccard_groups(table(spark, sf, "documents"), n_gram=4, percent=85)
