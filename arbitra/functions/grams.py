"""Counted n-grams of many texts at once, over Arrow arrays inside a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

# A gram's hash is put together from those of its words, so each word is hashed once. It deals grams out and identifies none.
MIX = np.uint64(0x9E3779B97F4A7C15)


class Grams(NamedTuple):
    """``row[i]`` holds ``terms[gram[i]]`` ``n[i]`` times, by row. ``terms`` are distinct and their order does not depend on that of the rows."""

    row: np.ndarray
    gram: np.ndarray
    n: np.ndarray
    terms: pa.Array
    hashes: np.ndarray


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A polynomial of each word's bytes, all words at once."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    sizes = np.diff(ends)
    powers = np.cumprod(np.full(int(sizes.max()) + 1, MIX))
    values = (data + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(ends[:-1], sizes)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return sums[ends[1:]] - sums[ends[:-1]]


def _followed(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    return hashes * MIX + words


def _flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def split(column: pa.Array | pa.ChunkedArray, mark: str) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts, and how many each text has."""
    parts = pc.split_pattern(_flat(column), mark)
    return parts.flatten(), parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def dealt(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in order of their bucket, the buckets that occur, and how many places each has."""
    bucket = (hashes * MIX >> np.uint64(32)) % np.uint64(parts)
    return np.argsort(bucket.astype(np.int32), kind="stable"), *np.unique(bucket.astype(np.int32), return_counts=True)


def packed(terms: pa.Array, order: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Lists of terms, each as one binary value. Terms hold no line end."""
    joined = pc.binary_join(lists(terms.take(pa.array(order)), sizes), "\n").cast(pa.binary()).to_pylist()
    return pa.array([len(b).to_bytes(8, "little") + pa.compress(b, "zstd", asbytes=True) for b in joined], pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The terms of all lists, and how many each list has."""
    texts = [pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True) for b in column.to_pylist()]
    return split(pa.array(texts, pa.binary()).cast(pa.string()), "\n")


def gram_counts(texts: pa.Array | pa.ChunkedArray, n_min: int, n_max: int) -> Grams:
    """N-grams of texts given as words joined by one space."""
    flat, sizes = split(texts, " ")
    real = pc.greater(pc.binary_length(flat), 0)  # a text without words is one empty part
    row = np.repeat(np.arange(len(sizes)), sizes)[real.to_numpy(zero_copy_only=False)]
    encoded = flat.filter(real).dictionary_encode()
    order = pc.sort_indices(encoded.dictionary)
    words = encoded.dictionary.take(order)
    rank = np.empty(len(words), np.int64)
    rank[order.to_numpy()] = np.arange(len(words))
    code = rank[encoded.indices.to_numpy(zero_copy_only=False)]
    word_hashes = _word_hashes(words)
    start, gram, terms, hashes = np.arange(len(code)), code, words, word_hashes
    rows, grams, all_terms, all_hashes, total = [], [], [], [], 0
    for n in range(1, n_max + 1):
        if n > 1:
            inside = start + n - 1 < len(code)
            start, gram = start[inside], gram[inside]
            inside = row[start + n - 1] == row[start]
            start, gram = start[inside], gram[inside]
            distinct, gram = np.unique(gram * len(words) + code[start + n - 1], return_inverse=True)
            head, last = np.divmod(distinct, max(len(words), 1))
            terms = pc.binary_join_element_wise(terms.take(pa.array(head)), words.take(pa.array(last)), " ")
            hashes = _followed(hashes[head], word_hashes[last])
        if n >= n_min:
            rows.append(row[start])
            grams.append(gram + total)
            all_terms.append(terms)
            all_hashes.append(hashes)
            total += len(terms)
    cells, counts = np.unique(np.concatenate(rows) * max(total, 1) + np.concatenate(grams), return_counts=True)
    at, which = np.divmod(cells, max(total, 1))
    return Grams(at, which, counts, pa.concat_arrays(all_terms), np.concatenate(all_hashes))


def term_hashes(terms: pa.Array) -> np.ndarray:
    """The hashes that ``gram_counts`` gives these terms."""
    flat, sizes = split(terms, " ")
    encoded = flat.dictionary_encode()
    word = _word_hashes(encoded.dictionary)[encoded.indices.to_numpy(zero_copy_only=False)]
    first = np.cumsum(sizes) - sizes
    out = word[first] if len(sizes) else np.zeros(0, np.uint64)
    for n in range(1, int(sizes.max(initial=0))):
        longer = sizes > n
        out[longer] = _followed(out[longer], word[first[longer] + n])
    return out


def identities(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes that together tell terms apart, of 64 and 32 bits. Each distinct word is hashed once."""
    flat, sizes = split(terms, " ")
    encoded = flat.dictionary_encode()
    words, at = encoded.dictionary.to_numpy(zero_copy_only=False), encoded.indices.to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    out = []
    for key in ("arbitra.term.one", "arbitra.term.two"):
        word = pd.util.hash_array(words.astype(object), hash_key=key, categorize=False)[at] if len(words) else np.zeros(0, np.uint64)
        h = word[first] if len(sizes) else np.zeros(0, np.uint64)
        for n in range(1, int(sizes.max(initial=0))):
            longer = sizes > n
            mixed = h[longer] * MIX
            h[longer] = (mixed ^ (mixed >> np.uint64(29))) * MIX + word[first[longer] + n]
        out.append(h)
    return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.int64)


def codes(columns: Iterable[pa.Array | pa.ChunkedArray], size: int) -> np.ndarray:
    """A number per row, equal where all columns are; nulls are equal."""
    out = np.zeros(size, np.int64)
    for c in columns:
        c = _flat(c)
        if pa.types.is_nested(c.type):
            c = pa.array([repr(v) for v in c.to_pylist()], pa.string())
        seen = c.dictionary_encode(null_encoding="encode")
        pairs = out * max(len(seen.dictionary), 1) + seen.indices.to_numpy(zero_copy_only=False)
        out = np.unique(pairs, return_inverse=True)[1]
    return out


def steps(batches: Iterable[pa.RecordBatch], column: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most about ``at_once`` bytes of a text column, one row at least."""
    for b in batches:
        total = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + at_once, side="right")))
            yield b.slice(at, to - at)
            at = to
