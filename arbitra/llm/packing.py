"""Harmonic packing of token sequences into fixed-length training sequences."""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbitra.llm.common import Scratch, table
from arbitra.llm.tokens import Cache, WordTokens

CAPACITY = 4096
# Token id that ends each document of the fixed contract.
END_ID = 2
# A rest is left whole when its slot wastes at most this share; else it is cut at the next smaller slot.
SLACK = 1 / 32
# Shards whose left-over pieces meet in one group of the next level.
FAN = 64

PIECE = "doc_id bigint, `start` bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


@lru_cache(maxsize=1 << 16)
def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> tuple[int, ...]:
    """Lengths below ``capacity`` into which a rest of ``n`` tokens is cut.

    ``k = capacity // n`` copies of the rest fit a sequence, each in a slot of ``capacity // k``. The rest stays whole when it
    nearly fills the slot. Otherwise its head takes the largest slot that it fills completely.
    """
    out = []
    while n:
        k = capacity // n
        if k * n >= capacity * (1 - slack) or n * n <= capacity:
            out.append(n)
            break
        slot = capacity // (k + 1)
        out.append(slot)
        n -= slot
    return tuple(out)


def pieces(
    docs: DataFrame, *, tokenizer: str, end_id: int | None = END_ID, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Tokenise and cut every document: ``PIECE`` rows that cover its ids without gap or overlap.

    Full sequences are cut off first, the rest by ``cuts``. Ids exist only inside the task; the checksum of each piece
    (CRC-32 of its ids as unsigned little-endian 32-bit numbers) is taken there. Null text is empty; without ``end_id`` an
    empty document has no piece.
    """

    def run(batches):
        words = WordTokens(tokenizer)
        ids = Cache(lambda w: array("I", words.word_ids(w)).tobytes())
        chunk = Cache(lambda c: b"".join([ids[w] for w in words.words_of(c)]))
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        for b in batches:
            out = [[], [], [], [], []]
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py() or ""
                if words.plain(t):
                    raw = b"".join(map(chunk.__getitem__, t.lower().split()))
                else:
                    raw = array("I", words.tok.encode(t, add_special_tokens=False).ids).tobytes()
                raw += end
                n, at = len(raw) // 4, 0
                for size in (*[capacity] * (n // capacity), *cuts(n % capacity, capacity)):
                    for c, v in zip(out, (key, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), n), strict=True):
                        c.append(v)
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECE)


def _first_fit(capacity: int):
    """Pieces of one bounded rest, longest first, each into the first sequence with room."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        used: list[int] = []
        seq, off = [], []
        for n in pdf["length"]:
            k = next((i for i, u in enumerate(used) if u + n <= capacity), len(used))
            if k == len(used):
                used.append(0)
            seq.append(k)
            off.append(used[k])
            used[k] += n
        return pdf.assign(sequence_id=pd.Series(seq, dtype="int64"), offset=pd.Series(off, dtype="int64"))

    return run


def pack(parts: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece a ``sequence_id`` and its gapless ``offset`` there; no sequence is longer than ``capacity``.

    Class ``k`` holds the lengths of which exactly ``k`` fit a sequence, and a sequence of the class gets ``k`` of them. Shards
    (by hash of the document) fill their classes independently. What is left of a class in a shard, fewer than ``k`` pieces, is
    filled up with that of up to FAN shards, and so on until one group is left. The last rest has less than one sequence for each
    of the classes, whose number depends on the capacity alone (about ``2 * sqrt(capacity)``); it is packed first-fit in one task.

    Works on metadata only. Repeated pieces are packed each on their own. Ties are broken by document, start and checksum. Empty
    input gives no rows. The sequence id holds level, class, shard and bin, so it is unique but not dense.
    """
    spark = parts.sparkSession
    scratch = Scratch(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if shards >= 1 << 20 or capacity > 4096:
        raise ValueError("at most 1,048,575 shards and a capacity of 4096 fit the sequence id")
    names = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    todo = parts.select(*names, F.expr(f"{capacity} div length").alias("__k"), F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)).alias("__shard"))
    done, level, width = [], 0, 1
    while True:
        group = Window.partitionBy("__k", "__shard")
        order = group.orderBy("doc_id", "start", "ids_crc32")
        ranked = todo.withColumns({"__bin": F.floor((F.row_number().over(order) - 1) / F.col("__k")), "__n": F.count("*").over(group)})
        full = (F.col("__bin") + 1) * F.col("__k") <= F.col("__n")
        ranked = scratch.write(ranked.withColumn("__full", full).drop("__n"), "pack")
        code = ((F.lit(level) * 8192 + F.col("__k")) * (1 << 20) + F.col("__shard")) * (1 << 27) + F.col("__bin")
        run = Window.partitionBy("__k", "__shard", "__bin").orderBy("doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
        done.append(
            ranked.where("__full").select(*names, code.alias("sequence_id"), F.coalesce(F.sum("length").over(run), F.lit(0)).cast("bigint").alias("offset"))
        )
        todo = ranked.where("NOT __full").select(*names, "__k", F.expr(f"__shard div {FAN}").alias("__shard"))
        level, width = level + 1, width * FAN
        if width >= shards * FAN:
            break
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*names).schema.fields)
    rest = todo.select(*names).groupBy(F.col("length") * 0).applyInPandas(_first_fit(capacity), f"{kinds}, sequence_id bigint, `offset` bigint")
    done.append(rest.withColumn("sequence_id", F.col("sequence_id") + F.lit(level * 8192 * (1 << 47))))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def op4_harmonic_pack(spark, sf: str) -> DataFrame:
    """All documents, tokenised, cut and packed."""
    return pack(pieces(table(spark, sf, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json")))
