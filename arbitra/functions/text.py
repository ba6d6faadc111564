"""Tokens, n-grams and feature hashing."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from arbitra.functions.arrays import let, run_lengths

# Bucket count of the hashed features, and the 64-bit FNV-1a
# offset basis and prime. Only their low 14 bits matter for a bucket.
N_BUCKETS = 16384
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3

_ALNUM = r"[\p{IsAlphabetic}\p{N}]+"
_WORD = r"[\p{IsAlphabetic}\p{N}_]{2,}"


def _text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.coalesce(c, F.lit("")))


lowered = _text


@lru_cache(maxsize=4)
def characters(spark: SparkSession, kind: str) -> bytes:
    """A bit per code point: those that Spark counts as part of a token of letters and digits (``alnum``) or of a word (``word``)."""
    at_once = 1 << 16
    texts = [("".join(chr(i) for i in range(at, at + at_once) if not 0xD800 <= i < 0xE000),) for at in range(0, 0x110000, at_once)]
    one = F.lit((_WORD if kind == "word" else _ALNUM).partition("]")[0] + "]")
    bits = np.zeros(0x110000, bool)
    for row in spark.createDataFrame(texts, "text string").select(F.array_join(F.regexp_extract_all("text", one, 0), "")).collect():
        bits[[ord(c) for c in row[0]]] = True
    return np.packbits(bits).tobytes()


def joined_words(texts: pa.Array, chars: bytes, least: int = 2) -> pa.Array:
    """Runs of at least ``least`` of the ``characters`` of each lowercased text without nulls, joined by one space: all texts at once."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return pa.array([], pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    lead = (data & 0xC0) != 0x80
    if len(data) and int(data.max()) >= 0x80:
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.concatenate([[0], np.cumsum(lead)])[ends]  # where each text begins, in code points
    else:
        points, at = data, ends
    inside = np.unpackbits(np.frombuffer(chars, np.uint8)).astype(bool)[points]
    # a run begins where its text does or after a character outside, and ends likewise
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = stops - starts >= least
    starts, stops = starts[long], stops[long]
    text = np.searchsorted(at, starts, side="right") - 1
    follows = np.diff(text, prepend=-1) == 0  # not the first word of its text
    sizes = stops - starts + follows
    total = int(sizes.sum())
    from_ = np.repeat(starts - follows - np.cumsum(sizes) + sizes, sizes) + np.arange(total)
    out = points[np.maximum(from_, 0)]
    out[(np.cumsum(sizes) - sizes)[follows]] = 32
    if points is not data:
        out = np.frombuffer(out.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        width = np.where(points[from_] < 0x80, 1, np.where(points[from_] < 0x800, 2, np.where(points[from_] < 0x10000, 3, 4)))
        width[(np.cumsum(sizes) - sizes)[follows]] = 1
        per = np.add.reduceat(width, np.cumsum(sizes) - sizes) if len(sizes) else sizes
    else:
        per = sizes
    length = np.bincount(text, per, len(texts)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    made = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))
    return made.cast(pa.string())


def tokens_alnum(c: Column | str) -> Column:
    """Lowercased maximal runs of letters and digits; ``_`` separates."""
    return F.regexp_extract_all(_text(c), F.lit(_ALNUM), 0)


def tokens_word(c: Column | str) -> Column:
    """Lowercased runs of at least two word characters; ``_`` is one of them."""
    return F.regexp_extract_all(_text(c), F.lit(_WORD), 0)


def ngrams(tokens: Column, n_min: int = 1, n_max: int = 2) -> Column:
    """Word n-grams joined by one space, shorter ones first."""

    def grams(t: Column, n: int) -> Column:
        if n == 1:
            return t
        starts = F.slice(t, F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda head, i: F.concat_ws(" ", head, *[F.get(t, i + k) for k in range(1, n)]))

    return let(tokens, lambda t: F.concat(*[grams(t, n) for n in range(n_min, n_max + 1)]))


def fnv_bucket(token: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, modulo ``N_BUCKETS``.

    XOR and multiplication never carry downwards, so the low 14 bits can be
    computed alone and no 64-bit overflow arises.
    """
    mask, prime = N_BUCKETS - 1, FNV_PRIME % N_BUCKETS

    def feed(h: Column, byte: Column) -> Column:
        return (h.bitwiseXOR(byte) * prime).bitwiseAND(mask)

    def continuation(cp: Column, shift: int) -> Column:
        return F.shiftright(cp, shift).bitwiseAND(0x3F).bitwiseOR(0x80)

    def lead(cp: Column, shift: int, tag: int) -> Column:
        return F.shiftright(cp, shift).bitwiseOR(tag)

    def feed_char(h: Column, cp: Column) -> Column:
        two = feed(feed(h, lead(cp, 6, 0xC0)), continuation(cp, 0))
        three = feed(feed(feed(h, lead(cp, 12, 0xE0)), continuation(cp, 6)), continuation(cp, 0))
        four = feed(
            feed(feed(feed(h, lead(cp, 18, 0xF0)), continuation(cp, 12)), continuation(cp, 6)), continuation(cp, 0)
        )
        return F.when(cp < 0x80, feed(h, cp)).when(cp < 0x800, two).when(cp < 0x10000, three).otherwise(four)

    code_points = F.transform(F.split(token, ""), lambda ch: F.ascii(ch))
    return F.aggregate(code_points, F.lit(FNV_OFFSET % N_BUCKETS), feed_char)


def word_counts(c: Column | str, n_min: int = 1, n_max: int = 2) -> Column:
    """array<struct<key, n>>: each n-gram of the text with its count."""
    return run_lengths(ngrams(tokens_word(c), n_min, n_max))


def bucket_counts(c: Column | str) -> Column:
    """array<struct<key int, n int>>: hashed bag of words, sorted by bucket."""
    return run_lengths(F.transform(tokens_alnum(c), fnv_bucket))


def fnv_buckets(tokens: pa.Array) -> np.ndarray:
    """``fnv_bucket`` of an Arrow array of strings without nulls, all tokens a byte at a time."""
    tokens = tokens.cast(pa.large_string())
    ends = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1, 8 * tokens.offset) if len(tokens) else np.zeros(1, np.int64)
    data = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)
    order = np.argsort(ends[1:] - ends[:-1], kind="stable")[::-1]  # longest first, so those that go on are a prefix
    start, size = ends[:-1][order], (ends[1:] - ends[:-1])[order]
    h = np.full(len(tokens), FNV_OFFSET % N_BUCKETS, np.int64)
    more = len(tokens)
    for i in range(int(size[0]) if len(size) else 0):
        while size[more - 1] <= i:
            more = int(np.searchsorted(-size, -i, side="left"))
        h[:more] = ((h[:more] ^ data[start[:more] + i]) * (FNV_PRIME % N_BUCKETS)) & (N_BUCKETS - 1)
    out = np.empty(len(tokens), np.int64)
    out[order] = h
    return out
