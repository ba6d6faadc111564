"""Alignment of the tokens of two tokenizers over the same texts."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arbitra.llm.common import Scratch, table
from arbitra.llm.tokens import CACHE, CACHE_CHARS, UNUSUAL, Cache, byte_letters

# Most frequent id pairs whose counts are broadcast: a long, a long and a flag each, a few MB. All others are joined by a shuffle.
BROADCAST_PAIRS = 131_072
# Characters of text that are aligned at once; a longer document is one batch.
BATCH_CHARS = 1_000_000
# An id pair is one number: the A id times this, plus the B id.
BASE = 1 << 32


class ByteLevel:
    """Token ids and token bytes of a byte-level BPE file; strings of special tokens are plain text."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.word = regex.compile(pattern)
        letter = {c: b for b, c in enumerate(byte_letters())}
        self.bytes = [b""] * (max(self.tok.get_vocab().values()) + 1)
        for piece, i in self.tok.get_vocab().items():
            self.bytes[i] = bytes(letter[c] for c in piece) if all(c in letter for c in piece) else piece.encode()
        self.letters = byte_letters()
        self.words = Cache(self.word_ids)

    def word_ids(self, word: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize("".join([self.letters[b] for b in word.encode()]))]

    def unit(self, text: str) -> list[int]:
        """Ids of a text that begins and ends where pre-tokens do."""
        return [i for w in self.word.findall(text) for i in self.words[w]]

    def encode(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids


class Pieces:
    """Token ids and token bytes of a sentencepiece file, which puts a space before a text."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.bytes, plain = [], True
        for i in range(n):
            piece = self.sp.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.sp.is_byte(i) else piece.replace("▁", " ").encode())
            plain = plain and not re.search("[^▁]▁", piece)
        # no piece has a space after another character, so a text may be cut before a space that follows one
        self.cuts = plain

        self.space = self.sp.piece_to_id("▁")

    def encode_all(self, units: list[str]) -> list[list[int]]:
        """Ids of space + unit for each unit."""
        return [ids or [self.space] for ids in self.sp.encode(units, num_threads=1)] if units else []

    def encode(self, text: str) -> list[int]:
        return self.sp.encode(text)


@lru_cache(maxsize=1)
def _sides(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers, read once per process and not once per task."""
    return ByteLevel(a_path), Pieces(b_path)


class Both:
    """Ids of both tokenizers for whole texts, kept by unit (white space and the word after it) where that gives the same.

    Ids are unsigned 32-bit numbers in bytes.
    """

    # white space that begins with a space, the word after it, and what follows without a space; the first space is left out
    units = re.compile(r" (\s*+\S*+(?:[^\S ]\s*+\S*+)*+)")
    odd = re.compile(r"[\t\n\x0b\x0c\r]|  ")

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = _sides(a_path, b_path)
        # units of this generation and of the one before; a full generation takes the other's place, so units in use stay
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}
        self.old: dict[str, tuple[bytes, bytes, bool]] = {}

    def _same(self, raw: str, a: list[int], b: list[int]) -> bool:
        want = raw.encode("utf-8", "surrogatepass")
        return b"".join([self.a.bytes[i] for i in a]) == want and b"".join([self.b.bytes[i] for i in b]) == want

    def _cut(self, text: str | None) -> list[str] | None:
        """The units of space + text, each without its first space; none where only the whole text gives the libraries' ids."""
        if not text:
            return []
        if not self.b.cuts or UNUSUAL.search(text):
            return None
        raw = f" {text}"
        return self.units.findall(raw) if self.odd.search(raw) else text.split(" ")

    def ids(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of space + text for each text, or none where the bytes of either side are not the text's."""
        cut = [self._cut(t) for t in texts]
        missing = [u for u in dict.fromkeys(chain.from_iterable(c for c in cut if c)) if u not in self.known]
        self.known.update((u, self.old[u]) for u in missing if u in self.old)
        new = [u for u in missing if u not in self.known]
        # ids of space + unit, and whether they give its bytes
        for u, b in zip(new, self.b.encode_all(new), strict=True):
            a = self.a.unit(f" {u}")
            self.known[u] = array("I", a).tobytes(), array("I", b).tobytes(), self._same(f" {u}", a, b)
        out = []
        for text, c in zip(texts, cut, strict=True):
            a, b, same = zip(*map(self.known.__getitem__, c), strict=True) if c else ((), (), (c is not None,))
            if all(same):
                out.append((b"".join(a), b"".join(b)))
                continue
            x, y = self.a.encode(f" {text}"), self.b.encode(text)
            out.append((array("I", x).tobytes(), array("I", y).tobytes()) if self._same(f" {text}", x, y) else (b"", b""))
        for u in new:
            if len(u) > CACHE_CHARS:
                del self.known[u]
        if len(self.known) > CACHE:
            self.known, self.old = {}, self.known
        return out


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """``(a, b)``: all pairs of rows of the two sides whose byte ranges overlap, by document.

    Both sides hold ``doc``, ``start``, ``end`` in order of start; ranges cover each document without gap. Each
    token's start finds the token of the other side that covers it, in both directions; equal starts are found twice.
    """
    left = a.assign(a=np.arange(len(a)))[["doc", "start", "a"]]
    right = b.assign(b=np.arange(len(b)))[["doc", "start", "b"]]
    one = pd.merge_asof(left, right, on="start", by="doc")[["a", "b"]]
    two = pd.merge_asof(right, left.rename(columns={"start": "a_start"}), left_on="start", right_on="a_start", by="doc")
    return pd.concat([one, two.loc[two["start"] != two["a_start"], ["a", "b"]]], ignore_index=True)


def _side(ids: list[bytes], sizes: np.ndarray) -> pd.DataFrame:
    """Rows of one side: document, id, and byte range; offsets run on over the documents of a batch, so starts are in order."""
    doc = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in ids])
    flat = np.frombuffer(b"".join(ids), np.uint32).astype(np.int64)
    end = np.cumsum(sizes[flat])
    return pd.DataFrame({"doc": doc, "id": flat, "start": end - sizes[flat], "end": end})


def _written(n_docs: int, a: pd.DataFrame, b: pd.DataFrame, linked: pd.DataFrame, names: tuple) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each document: groups end where both sides end."""
    ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    ends_a[linked["a"]] = 1
    ends_b[linked["b"]] = 1
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    n = len(linked)
    # a group's A ids come before its B ids: places count the other side's ids of the groups before
    before_a, before_b = np.searchsorted(group_a, np.arange(n + 1)), np.searchsorted(group_b, np.arange(n + 1))
    out = np.empty(len(a) + len(b), object)
    new_doc = np.r_[True, a["doc"].to_numpy()[1:] != a["doc"].to_numpy()[:-1]] if len(a) else np.zeros(0, bool)
    new_a = np.r_[True, group_a[1:] != group_a[:-1]] if len(a) else np.zeros(0, bool)
    new_b = np.r_[True, group_b[1:] != group_b[:-1]] if len(b) else np.zeros(0, bool)
    place_a = np.arange(len(a)) + before_b[group_a]
    ids_a, ids_b = a["id"].to_numpy(), b["id"].to_numpy()
    out[place_a] = np.where(new_doc, names[0][ids_a], np.where(new_a, names[1][ids_a], names[2][ids_a]))
    out[np.arange(len(b)) + before_a[group_b + 1]] = np.where(new_b, names[3][ids_b], names[2][ids_b])
    cut = np.searchsorted(a["doc"].to_numpy(), np.arange(n_docs + 1)) if len(a) else np.zeros(n_docs + 1, np.int64)
    cut_b = np.searchsorted(b["doc"].to_numpy(), np.arange(n_docs + 1)) if len(b) else np.zeros(n_docs + 1, np.int64)
    return ["".join(out[cut[i] + cut_b[i] : cut[i + 1] + cut_b[i + 1]]) for i in range(n_docs)]


ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, `groups` string, pairs array<struct<pair: bigint, n: bigint>>"


def align(docs: DataFrame, *, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (the groups as text) and ``pairs``: how often each
    pair ``A id * 2^32 + B id`` of the document ends together.

    ``a`` is a byte-level BPE file, ``b`` a sentencepiece file. One row per row, so repeated rows and null ids stay;
    null, empty texts and texts that either side does not give back byte by byte have zeros, '' and no pairs. Other columns are
    not read. An empty table gives no rows. Nothing is shuffled; a batch holds BATCH_CHARS characters or one document.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def batch(both: Both, sizes: tuple, names: tuple, keys, texts: list) -> pa.RecordBatch:
        ids = both.ids(texts)
        x, y = _side([i[0] for i in ids], sizes[0]), _side([i[1] for i in ids], sizes[1])
        found = overlaps(x, y)
        ends = x["end"].to_numpy()[found["a"]] == y["end"].to_numpy()[found["b"].astype(np.int64)]
        linked = found[ends].astype(np.int64).sort_values("a", kind="stable", ignore_index=True)
        n = len(texts)
        doc = x["doc"].to_numpy()[linked["a"]]
        links = np.bincount(doc, minlength=n)
        # groups end where tokens of both sides end; several links there would be one group
        groups = np.bincount(doc[np.r_[True, np.diff(x["end"].to_numpy()[linked["a"]]) != 0]] if len(doc) else doc, minlength=n)
        each = pd.DataFrame({"doc": doc, "pair": x["id"].to_numpy()[linked["a"]] * BASE + y["id"].to_numpy()[linked["b"]]})
        each = each.groupby(["doc", "pair"], sort=True).size().reset_index(name="n")
        offsets = np.searchsorted(each["doc"].to_numpy(), np.arange(n + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(each["pair"], pa.int64()), pa.array(each["n"], pa.int64())], names=["pair", "n"])
        columns = [
            keys, *(pa.array(np.bincount(s["doc"], minlength=n), pa.int64()) for s in (x, y)), pa.array(groups, pa.int64()), pa.array(links, pa.int64()),
            pa.array(_written(n, x, y, linked, names), pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pairs),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    def run(batches):
        both = Both(a, b)
        sizes = tuple(np.array([len(t) for t in side.bytes], np.int64) for side in (both.a, both.b))
        most = max(map(len, sizes))
        # an id written as a document's first, a group's first, a later one, and the first of a group's B ids
        names = tuple(np.array([f"{p}{i}" for i in range(most)], object) for p in ("", ";", ",", "|"))
        for rows in batches:
            at, chars, texts = 0, 0, []
            for i, t in enumerate(rows.column(1)):
                texts.append(t.as_py())
                chars += len(texts[-1] or "")
                if chars >= BATCH_CHARS or i + 1 == rows.num_rows:
                    yield batch(both, sizes, names, rows.column(0).slice(at, len(texts)), texts)
                    at, chars, texts = i + 1, 0, []

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {ALIGNED}")


def pair_counts(links: DataFrame) -> DataFrame:
    """``(pair, total, best)`` of rows ``(pair, n)``: occurrences in all rows, and whether no pair of the same B id has more.

    Added up inside the tasks before the shuffle. The highest of each B id is at most one row per entry of B's vocabulary.
    """
    totals = links.groupBy("pair").agg(F.sum("n").alias("total"))
    b_id = F.col("pair").bitwiseAND(F.lit(BASE - 1))
    top = totals.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("top"))
    return totals.withColumn("b_id", b_id).join(F.broadcast(top), "b_id").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))


def count_links(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (stored, with ``row`` and ``pairs``) with ``n_best`` and ``count_sum`` in place of ``pairs``.

    The most frequent pairs, at most BROADCAST_PAIRS, are looked up where the rows lie. The others, of which none is frequent,
    are joined by pair.
    """
    links = rows.select("row", F.explode("pairs").alias("p")).select("row", "p.pair", "p.n")
    counts = scratch.write(pair_counts(links), "pairs")
    step = F.floor(F.log2("total") * 16).cast("int")
    room, cut = BROADCAST_PAIRS, None
    for s, n in counts.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():  # fewer than 1,100 rows
        room -= n
        if room < 0:
            break
        cut = s
    found = links.withColumns({"total": F.lit(None).cast("bigint"), "best": F.lit(None).cast("boolean")})
    if cut is not None:
        head = counts.where(step >= cut)
        found = links.join(F.broadcast(head), "pair", "left")
    rest = counts if cut is None else counts.where(step < cut)
    late = found.where("total IS NULL").select("row", "pair", "n").join(rest, "pair")
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum")]
    known = found.where("total IS NOT NULL").groupBy("row").agg(*sums)
    both = known.unionByName(late.groupBy("row").agg(*sums)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return rows.drop("pairs").join(both, "row", "left").withColumns({"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)})


def op12_token_align(spark, sf: str) -> DataFrame:
    """Token groups and links of all documents under two public tokenizers; one row per row of ``documents``."""
    scratch = Scratch(spark)
    path = public_tokenizers.path
    found = align(table(spark, sf, "documents"), a=path("byte_bpe_50k.json"), b=path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.encode("groups", "UTF-8"), 256))
    rows = found.withColumns({"groups_sha256": digest, "row": F.monotonically_increasing_id()}).drop("groups")
    counted = count_links(scratch.write(rows, "aligned"), scratch)
    return counted.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
