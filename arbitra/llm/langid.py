"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbitra.llm.common import Scratch, table

SIZES = (3, 4)
# A filter has 2^SLOT_BITS slots of one bit per language; HASHES slots per n-gram are cut from one 64-bit hash.
SLOT_BITS = 21
HASHES = 3
# An n-gram is in a language's filter if it makes up at least MIN_SHARE of that language's n-grams (so a filter never holds more
# than 1 / MIN_SHARE) and is at least RATIO times as frequent there as in the language where it is most frequent.
MIN_SHARE = 2e-6
RATIO = 0.25
UNKNOWN = "und"
FOLDS = 5
# A text is clearly in a language if, of what is usual in that language's own texts, its n-grams are found in the filter at least to
# MIN_RATE and lead the second language at least to MIN_LEAD. What is usual is the median of all its texts, to the nearest 1 / NORM_STEPS.
MIN_RATE = 0.55
MIN_LEAD = 0.1
NORM_STEPS = 10_000

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_SPACE = np.array([32], np.uint32)
_letters: np.ndarray | None = None
# N-grams that are hashed, or held by a task before it counts them, at once; distinct ones it holds before it sends them.
PART = 1 << 20
HELD = 1 << 20


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((0xD800 <= c < 0xE000 or chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _letters[0xD800:0xE000] = False
    return _letters


def grams(text: str | None) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of the lower-case text, words apart by one space, in parts of at most PART; nothing without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return
    codes = np.where(is_letter, codes, np.uint32(32))
    codes = np.concatenate((_SPACE, codes, _SPACE))
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    for n in SIZES:
        for at in range(0, len(codes) - n + 1, PART):
            part = codes[at : at + PART + n - 1].astype(np.uint64)
            m = len(part) - n + 1
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h += part[k : k + m] * _ODD[k]
            h ^= h >> np.uint64(31)
            h *= _ODD[0]
            h ^= h >> np.uint64(29)
            h *= _ODD[1]
            yield h ^ (h >> np.uint64(32))


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``(lang, gram, n)`` over all rows."""

    def run(batches):
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # distinct so far, with counts
        fresh: dict[str, list[np.ndarray]] = {}
        waiting = 0

        def settle():
            for g, hs in fresh.items():
                u, n = np.unique(np.concatenate(hs), return_counts=True)
                if g in seen:
                    both = np.concatenate((seen[g][0], u))
                    u, at = np.unique(both, return_inverse=True)
                    n = np.bincount(at, np.concatenate((seen[g][1], n))).astype(np.int64)
                seen[g] = u, n
            fresh.clear()

        def send():
            for g, (u, n) in seen.items():
                for i in range(0, len(u), 200_000):
                    k = len(u[i : i + 200_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g] * k), pa.array(u[i : i + k].view(np.int64)), pa.array(n[i : i + k].astype(np.int64))], names=["lang", "gram", "n"]
                    )
            seen.clear()

        for b in batches:
            for t, g in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for h in grams(t.as_py()):
                    fresh.setdefault(g, []).append(h)
                    waiting += len(h)
                    if waiting >= PART:
                        settle()
                        waiting = 0
                        if sum(len(u) for u, _ in seen.values()) >= HELD:
                            yield from send()
        settle()
        yield from send()

    out = docs.select(F.col(text), F.col(lang).cast("string")).mapInArrow(run, "lang string, gram bigint, n bigint")
    return out.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """Slots as one array per 64 languages, the languages in descending order of training size, and each filter's error rate."""

    def __init__(self, langs: list[str], slots: list[np.ndarray]):
        self.langs, self.slots = langs, slots
        self.errors = np.array([self._bit(i, self.slots[i // 64]).mean() for i in range(len(langs))], float) ** HASHES

    def _bit(self, i: int, masks: np.ndarray) -> np.ndarray:
        return (masks >> masks.dtype.type(i % 64)) & masks.dtype.type(1)

    def found(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of n-grams of the text, and how many of them each language holds, corrected by its error rate."""
        hits, n = np.zeros(len(self.langs)), 0
        for h in grams(text):
            n += len(h)
            at = [(h >> np.uint64(SLOT_BITS * k)) & np.uint64((1 << SLOT_BITS) - 1) for k in range(HASHES)]
            for part, slots in enumerate(self.slots):
                masks = slots[at[0]]
                for a in at[1:]:
                    masks &= slots[a]
                for i in range(64 * part, min(64 * part + 64, len(self.langs))):
                    hits[i] += np.count_nonzero(self._bit(i, masks))
        # Of n lookups, the share ``error`` would hit a filter without its language: take those out.
        return n, np.clip((hits - n * self.errors) / np.maximum(1 - self.errors, 1e-9), 0, None)

    def predict(self, text: str | None) -> tuple[str, float]:
        n, true = self.found(text)
        if not n or not self.langs:
            return UNKNOWN, 0.0
        best = int(true.argmax())
        total = true.sum()
        return self.langs[best], float(true[best] / total) if total else 1 / len(self.langs)

    def rate(self, text: str | None, lang: str | None = None) -> tuple[str, float, float]:
        """A language (the best one unless given), the share of the text's n-grams that it holds, and by how much that exceeds any other's."""
        n, true = self.found(text)
        if not n or not self.langs:
            return UNKNOWN, 0.0, 0.0
        i = int(true.argmax()) if lang is None else self.langs.index(lang)
        return self.langs[i], float(true[i] / n), float((true[i] - max(np.delete(true, i), default=0.0)) / n)


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> Filters:
    """Learn one filter per language from the rows with a language.

    N-grams are counted over all rows; only the slots reach the driver, at most 2^SLOT_BITS of them however large the input.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.write(gram_counts(docs.where(F.col(lang).isNotNull()), text, lang), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").collect()
    langs = [r.lang for r in totals]
    size = F.create_map(*[F.lit(x) for r in totals for x in (r.lang, float(r.total))]) if totals else None
    place = F.create_map(*[F.lit(x) for i, g in enumerate(langs) for x in (g, i)]) if totals else None
    if not totals:
        return Filters([], [])
    share = counts.select("lang", "gram", (F.col("n") / size[F.col("lang")]).alias("share")).where(F.col("share") >= MIN_SHARE)
    top = F.max("share").over(Window.partitionBy("gram"))
    held = share.withColumn("top", top).where(F.col("share") >= F.col("top") * RATIO).select("gram", place[F.col("lang")].alias("i"))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("i") % 64).cast("int"))
    slot = [F.shiftrightunsigned("gram", SLOT_BITS * k).bitwiseAND((1 << SLOT_BITS) - 1) for k in range(HASHES)]
    filled = held.select(F.floor(F.col("i") / 64).cast("int").alias("part"), mask.alias("mask"), F.explode(F.array(*slot)).alias("slot"))
    got = filled.groupBy("part", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    part, where, masks = (got.column(c).to_numpy() for c in ("part", "slot", "mask"))
    kind = next(k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(langs) <= bits or bits == 64)
    slots = []
    for p in range((len(langs) + 63) // 64):
        s = np.zeros(1 << SLOT_BITS, kind)
        s[where[part == p]] = masks[part == p].view(np.uint64).astype(kind)
        slots.append(s)
    return Filters(langs, slots)


def predict(docs: DataFrame, filters: Filters, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the language's share of all corrected hits, 0 to 1); columns of those names are replaced.

    Texts that are null or have no letter get ``und`` and 0. A tie goes to the language with more training text. A text whose n-grams are in
    no filter gets that language with an even score. Without any learned language every row is ``und``.
    """
    docs = docs.drop(*[c for c in ("lang_pred", "score") if c in docs.columns])
    known = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for b in batches:
            found = [known.value.predict(t.as_py()) for t in b.column(text)]
            cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def norms(docs: DataFrame, filters: Filters, *, text: str = "text", lang: str = "lang") -> dict[str, tuple[float, float]]:
    """Per learned language the median rate and lead (``Filters.rate``) of all its own texts in ``docs``, counted in steps of 1 / NORM_STEPS."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("lang").isin(filters.langs))
    known = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for b in batches:
            got = [known.value.rate(t.as_py(), g.as_py()) for t, g in zip(b.column(0), b.column(1), strict=True)]
            got = [x for x in got if x[0] != UNKNOWN]
            kinds = (pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], k) for i, k in enumerate(kinds)], names=["lang", "rate", "lead"])

    measured = rows.mapInArrow(run, "lang string, rate double, lead double")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.round(F.col(c) * NORM_STEPS).cast("bigint").alias("step")) for c in ("rate", "lead")])).alias("m")
    # at most 2 * NORM_STEPS + 1 steps of each kind and language
    counted = measured.select("lang", each).groupBy("lang", "m.kind", "m.step").count()
    medians = counted.groupBy("lang", "kind").agg(F.percentile("step", 0.5, F.col("count")).alias("median")).collect()
    found: dict[str, dict[str, float]] = {}
    for r in medians:
        found.setdefault(r["lang"], {})[r["kind"]] = r["median"] / NORM_STEPS
    return {g: (v["rate"], v["lead"]) for g, v in found.items()}


def clear(docs: DataFrame, filters: Filters, usual: dict[str, tuple[float, float]], *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is clearly in one learned language, judged by what is ``usual`` in it (``norms``).

    Neither measure depends on how many languages are learned. Texts without a letter are in none. A language of which
    there is no text is judged by the median of the others.
    """
    known = docs.sparkSession.sparkContext.broadcast(filters)
    other = tuple(np.median(list(usual.values()), axis=0)) if usual else (1.0, 1.0)

    def is_clear(t):
        lang, rate, lead = known.value.rate(t)
        least = usual.get(lang, other)
        return lang != UNKNOWN and rate >= MIN_RATE * least[0] and lead >= MIN_LEAD * least[1]

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([is_clear(t.as_py()) for t in b.column(text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """One id in FOLDS, by CRC-32 of its text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def op7_language_id(spark, sf: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    filters = fit(docs.where("NOT held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), filters).select("doc_id", "held_out", "lang_pred", "score")
