"""SimHash fingerprints and the search for all fingerprints within a Hamming radius."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbitra.functions.arrays import run_lengths
from arbitra.llm.common import WORD, Scratch, table

# A term is a word; its weight is its characters over four, from 1 to MAX_WEIGHT, times 4 * (1 + ln(count)), in whole numbers.
MAX_WEIGHT = 15
BITS = 128
# Bits within which near copies (five-word Jaccard similarity of 0.8 or more) lie. Measured, see the README.
RADIUS = 23
# Numbers of blocks that the search may use.
BLOCKS = (4, 5, 6, 7, 8, 9, 10, 12)
# Votes of two bits in one number: 32 bits each hold 2^32 / 900 words of greatest weight, more than a text of 30 MB has.
LANES = (1 << 32) + 1


def terms(text: Column) -> Column:
    """``(h, w)`` of each distinct lower-case word of a text: its hash and weight; null without words."""
    found = run_lengths(
        F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0), lambda w: F.struct(F.xxhash64(w).alias("h"), F.length(w).alias("n")))
    )

    def term(t: Column) -> Column:
        size = F.least(F.greatest(F.floor(t["key"]["n"] / 4), F.lit(1)), F.lit(MAX_WEIGHT))
        return F.struct(t["key"]["h"].alias("h"), F.floor(size * 4 * (1 + F.log(t["n"]))).cast("bigint").alias("w"))

    return F.transform(F.array(F.transform(found, term)), lambda t: F.when(F.size(t) > 0, t))[0]


def fingerprints(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """``keys`` and ``hi``, ``lo``: the two halves of a 128-bit SimHash of each text.

    Terms are exploded beside their keys and vote in one aggregation: bit ``i`` is 1 when the terms that have it set weigh more
    than half. The partial aggregation leaves one record per text and task. ``keys`` identify a text; rows that repeat
    them with the same text give one row. Null, empty and word-less texts have the fingerprint 0.
    """
    rows = texts.select(*keys, F.explode_outer(terms(F.col(text))).alias("__t")).select(
        *keys, F.col("__t.h").alias("__hi"), F.xxhash64("__t.h", F.lit(BITS)).alias("__lo"), F.col("__t.w").alias("__w")
    )
    votes = [
        F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES)) * F.col("__w")).alias(f"{h}{i}") for h in ("__hi", "__lo") for i in range(32)
    ]
    counted = rows.groupBy(*keys).agg(F.sum("__w").alias("__all"), *votes)

    def half(h: str) -> Column:
        low = [F.col(f"{h}{i}").bitwiseAND(F.lit((1 << 32) - 1)) for i in range(32)]
        high = [F.shiftrightunsigned(f"{h}{i}", 32) for i in range(32)]
        bits = F.transform(F.array(*low, *high), lambda n, i: F.when(n * 2 > F.col("__all"), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(F.coalesce(b, F.lit(0).cast("bigint"))))

    return counted.select(*keys, half("__hi").alias("hi"), half("__lo").alias("lo"))


def fingerprint_text(hi: Column, lo: Column) -> Column:
    """32 lower-case hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(hi1: Column, lo1: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi1.bitwiseXOR(hi2)) + F.bit_count(lo1.bitwiseXOR(lo2))


def likeness(hi1: Column, lo1: Column, hi2: Column, lo2: Column) -> Column:
    """Estimated cosine of the term vectors, from 0 (half of the bits or more differ) to 1 (all equal)."""
    d = distance(hi1, lo1, hi2, lo2)
    return F.when(d * 2 >= BITS, 0.0).otherwise(F.cos(d * F.lit(3.141592653589793 / BITS)))


def spans(n: int) -> list[tuple[int, int]]:
    """First bit and length of ``n`` blocks that cover the 128 bits."""
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)]


def block(hi: Column, lo: Column, first: int, length: int) -> Column:
    """The bits ``first`` to ``first + length`` of a fingerprint as a number, the low half first."""
    mask = F.lit((1 << length) - 1)
    if first >= 64:
        return F.shiftrightunsigned(hi, first - 64).bitwiseAND(mask)
    low = F.shiftrightunsigned(lo, first)
    if first + length > 64:
        low = low.bitwiseOR(F.shiftleft(hi, 64 - first))
    return low.bitwiseAND(mask)


def flips(length: int, most: int) -> list[int]:
    """All numbers of ``length`` bits of which at most ``most`` are set."""
    return [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(length), k)]


def cheapest(radius: int, n_asked: int, n_all: int) -> int:
    """The number of blocks with the least work: values looked up for all asked fingerprints, rows of the tables, and the candidates
    that random fingerprints would give."""

    def work(n: int) -> float:
        out = 0.0
        for _, length in spans(n):
            values = sum(math.comb(length, k) for k in range(radius // n + 1))
            out += n_asked * values + n_all + n_asked * values * n_all / 2.0**length
        return out

    return min(BLOCKS, key=work)


def near(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, n: int | None = None) -> DataFrame:
    """All pairs ``(q_hi, q_lo, hi, lo, distance)`` of distinct fingerprints at most ``radius`` bits apart, a fingerprint with itself included.

    Fingerprints are cut into ``n`` blocks. Two within the radius differ in at most ``radius // n`` bits of some block. One table
    per block, permuted so that the block leads, holds all fingerprints; the asked ones are looked up there under their own value and all
    values that differ in so few bits. A pair found in several blocks is kept in the first only. The search is exact for every radius.
    ``n`` follows from both counts, so that the values and the candidates stay in balance as the tables grow. Copies count
    once: both sides are made distinct, so a group of equal fingerprints does not multiply.
    """
    a = queries.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo")).distinct()
    b = prints.select(F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo")).distinct()
    n = n or cheapest(radius, a.count(), b.count())
    most, parts = radius // n, spans(n)
    widths = sorted({length for _, length in parts})
    masks = F.array(*[F.from_json(F.lit(json.dumps(flips(w, most))), "array<bigint>") for w in widths])
    asked = a.select("q_hi", "q_lo", F.posexplode(F.array(*[F.struct(block(F.col("q_hi"), F.col("q_lo"), *p).alias("v"), F.lit(widths.index(p[1])).alias("w")) for p in parts])).alias("no", "x"))
    asked = asked.select("q_hi", "q_lo", "no", F.col("x.v").alias("own"), F.explode(F.get(masks, F.col("x.w"))).alias("flip"))
    asked = asked.select("q_hi", "q_lo", "no", F.col("own").bitwiseXOR(F.col("flip")).alias("block"))
    table_ = b.select("p_hi", "p_lo", F.posexplode(F.array(*[block(F.col("p_hi"), F.col("p_lo"), *p) for p in parts])).alias("no", "block"))
    close = [
        F.bit_count(block(F.col("q_hi"), F.col("q_lo"), *p).bitwiseXOR(block(F.col("p_hi"), F.col("p_lo"), *p))) <= most for p in parts
    ]
    first = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(close)])
    d = distance(F.col("q_hi"), F.col("q_lo"), F.col("p_hi"), F.col("p_lo"))
    # the values looked up grow with the table: without the hint the planner, which sees the rows before they multiply, would broadcast them
    pairs = asked.hint("merge").join(table_, ["no", "block"]).where((d <= radius) & (first == F.col("no")))
    return pairs.select("q_hi", "q_lo", F.col("p_hi").alias("hi"), F.col("p_lo").alias("lo"), d.alias("distance"))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``bucket``, ``rn`` and ``after``: the id and text of the next smaller id, for the smallest the largest.

    Ids are cut into ranges. A range is one group of a window, which finds the greatest smaller (id, text); the first of a range find it
    in a row that stands for the range before, so texts pass one shuffle. (bucket, rn) identifies a row. Rows that repeat an id
    have the same next one; where ids repeat with different texts, the greatest text of the id is meant. Null ids have none.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    edges = sorted(set(edges or []))
    # the number of edges below an id, by coarse and fine steps; rows of one id stay together, null ids lie in ranges of their own
    size = max(1, math.isqrt(len(edges)))
    chunks = [edges[i : i + size] for i in range(0, len(edges), size)] + [[]]
    under = lambda array: F.size(F.filter(array, lambda e: e < F.col("doc_id")))
    const = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    coarse = under(const([c[-1] for c in chunks[:-1]], "array<bigint>"))
    at = coarse * size + under(F.get(const(chunks, "array<array<bigint>>"), coarse))
    named = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")).otherwise(at))
    whole = F.struct(F.col("doc_id").alias("id"), "text")
    tops = named.where("doc_id IS NOT NULL").groupBy("bucket").agg(F.max(whole).alias("top"), F.min("doc_id").alias("low"))
    every = Window.partitionBy()  # one row per range
    before = F.coalesce(F.lag("top").over(Window.partitionBy().orderBy("bucket")), F.max("top").over(every))
    marks = tops.select("bucket", (F.col("low") - 1).alias("place"), before.alias("doc"), F.lit(True).alias("mark"))
    rows = named.select("bucket", F.col("doc_id").alias("place"), whole.alias("doc"), F.lit(False).alias("mark"))
    inside = Window.partitionBy("bucket").orderBy("place")
    found = rows.unionAll(marks).select(
        "bucket", "mark", "doc", F.max(F.struct("place", "doc")).over(inside.rangeBetween(Window.unboundedPreceding, -1)).alias("b"),
        F.row_number().over(inside).cast("bigint").alias("rn"),
    )
    after = F.when(F.col("doc.id").isNotNull(), F.col("b.doc"))
    return found.where("NOT mark").select("bucket", "rn", F.col("doc.id").alias("doc_id"), F.col("doc.text").alias("text"), after.alias("after"))


def op6_simhash(spark, sf: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, their likeness, and for each id divisible by 100 how many
    other documents lie within RADIUS bits.

    One row per row, repeated rows included. Null texts are empty; texts without words have the fingerprint 0. A document alone is its own
    next one. A null id has no next one: its text is not edited, near_next is 0. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(spark)
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    k = F.when(F.col("after").isNull(), 0).otherwise(F.floor(n / 3)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.coalesce(F.substring(F.col("after.text"), F.lit(1), k), F.lit("")))
    keys = ["bucket", "rn", "doc_id", "n_chars", "edited_sha256", "own", "next_id", "next_own"]
    both = with_next(docs).select(
        "bucket", "rn", "doc_id", n.cast("bigint").alias("n_chars"), F.xxhash64("text").alias("own"), F.col("after.id").alias("next_id"),
        F.xxhash64("after.text").alias("next_own"), "text", edited.alias("edited"),
    ).withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))
    texts = both.select(*keys, F.explode(kinds).alias("x"))
    prints = fingerprints(texts.select(*keys, "x.kind", "x.text"), [*keys, "kind"])
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    prints = scratch.write(prints.groupBy(*keys).agg(of(0, "hi").alias("hi"), of(0, "lo").alias("lo"), of(1, "hi").alias("e_hi"), of(1, "lo").alias("e_lo")), "prints")
    sizes = scratch.write(prints.groupBy("hi", "lo").count(), "sizes")
    asked = prints.where("doc_id % 100 = 0").select("hi", "lo").distinct()
    found = near(asked, sizes).join(sizes, ["hi", "lo"]).groupBy("q_hi", "q_lo").agg((F.sum("count") - 1).alias("n_near"))
    found = found.select(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo"), "n_near")
    after = prints.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("next_id"), F.col("own").alias("next_own")).agg(F.first("hi").alias("n_hi"), F.first("lo").alias("n_lo"))
    like = lambda p: F.round(likeness(F.col("hi"), F.col("lo"), F.col(f"{p}_hi"), F.col(f"{p}_lo")), 9)
    return (
        prints.join(after, ["next_id", "next_own"], "left")
        .join(found, ["hi", "lo"], "left")
        .select(
            "doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("hi"), F.col("lo")).alias("fingerprint"),
            fingerprint_text(F.col("e_hi"), F.col("e_lo")).alias("edited_fingerprint"), like("e").alias("near_edited"),
            F.coalesce(like("n"), F.lit(0.0)).alias("near_next"), F.when(F.col("doc_id") % 100 == 0, F.col("n_near")).alias("n_near"),
        )
    )
