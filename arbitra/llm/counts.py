"""Token counts by distinct pre-token."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitra.llm.common import Scratch, table
from arbitra.llm.tokens import Cache, WordTokens, word_tokens

# Most frequent pre-tokens whose piece counts are broadcast: digests of 16 bytes and a number, about 10 MB in Python.
# All others are joined by a shuffle.
BROADCAST_WORDS = 131_072
LIMIT = 2048


def _digest(word: str) -> bytes:
    return xxhash.xxh3_128_digest(word.encode("utf-8", "surrogateescape"))


def _frequencies(words: WordTokens, text: str):
    """(lower-cased runs without white space with counts) or (words with counts), and the number of special tokens."""
    if words.plain(text):
        return Counter(text.lower().split()), None, 0
    found, special = words.slow_words(text)
    return None, Counter(found), special


def pretokens(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``(word binary, n)``: every distinct pre-token of the corpus with its number of occurrences."""

    def run(batches):
        words = word_tokens(tokenizer)
        for b in batches:
            total: Counter = Counter()
            chunks: Counter = Counter()
            for t in b.column(0):
                runs, found, _ = _frequencies(words, t.as_py() or "")
                (chunks if found is None else total).update(runs if found is None else found)
            for c, n in chunks.items():
                for w in words.words_of(c):
                    total[w] += n
            keys = list(total)
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000]
                yield pa.RecordBatch.from_pydict(
                    {"word": pa.array([w.encode("utf-8", "surrogateescape") for w in part], pa.binary()), "n": pa.array([total[w] for w in part], pa.int64())}
                )

    return docs.select(text).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def piece_counts(vocab: DataFrame, tokenizer: str) -> DataFrame:
    """``(h binary, n, pieces)``: digest, occurrences and piece count of each distinct pre-token."""

    def run(batches):
        words = word_tokens(tokenizer)
        for b in batches:
            text = [w.decode("utf-8", "surrogateescape") for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"h": pa.array([_digest(w) for w in text], pa.binary()), "n": b.column("n"), "pieces": pa.array([len(words.word_ids(w)) for w in text], pa.int64())}
            )

    return vocab.select("word", "n").mapInArrow(run, "h binary, n bigint, pieces bigint")


def count_tokens(docs: DataFrame, *, tokenizer: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every document, without producing its ids.

    Each distinct pre-token is counted once. Its count then meets the frequencies per document in a join whose
    frequent side, at most BROADCAST_WORDS digests, is broadcast (so no pre-token that is frequent fills a task), and whose
    rare side is shuffled by digest.

    Null text is empty. Rows that repeat both id and text give one row; a null id is an id. Empty tables give no rows.
    Special tokens in a text count as one each, as the library does by default.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    vocab = scratch.write(piece_counts(pretokens(docs, tokenizer, text), tokenizer), "vocab")
    # Occurrences by sixteenths of an octave: fewer than a thousand rows. The head is what lies above a step.
    step = F.floor(F.log2("n") * 16).cast("int")
    room, cut = BROADCAST_WORDS, None
    for s, n in vocab.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():
        room -= n
        if room < 0:
            break
        cut = s
    head = {} if cut is None else {bytes(h): p for h, p in vocab.where(step >= cut).select("h", "pieces").collect()}
    known = spark.sparkContext.broadcast(head)

    def run(batches):
        words, pieces = word_tokens(tokenizer), known.value

        def resolve(found):
            """Pieces of the known words, digests of the others."""
            n, rest = 0, []
            for w in found:
                h = _digest(w)
                p = pieces.get(h)
                if p is None:
                    rest.append(h)
                else:
                    n += p
            return n, rest

        chunk = Cache(lambda c: resolve(words.words_of(c)))
        for b in batches:
            out = [[], [], [], []]
            for t in b.column(1):
                t = t.as_py() or ""
                runs, found, total = _frequencies(words, t)
                rare: Counter = Counter()
                for key, f in (runs if found is None else found).items():
                    n, rest = chunk[key] if found is None else resolve([key])
                    total += f * n
                    for h in rest:
                        rare[h] += f
                raw = t.encode("utf-8", "surrogatepass")
                for c, v in zip(out, (xxhash.xxh3_128_digest(raw), len(raw), total, [{"h": h, "f": f} for h, f in rare.items()]), strict=True):
                    c.append(v)
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("h", pa.binary()), ("f", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=["doc_id", "t", "n_bytes", "known", "rare"]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    each = scratch.write(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
            run, f"doc_id {kind}, t binary, n_bytes bigint, known bigint, rare array<struct<h: binary, f: bigint>>"
        ),
        "known",
    )
    rare = each.select("doc_id", "t", F.explode("rare").alias("r")).select("doc_id", "t", "r.h", "r.f")
    tail = vocab if cut is None else vocab.where(step < cut)
    late = rare.join(tail.select("h", "pieces"), "h").groupBy("doc_id", "t").agg(F.sum(F.col("f") * F.col("pieces")).alias("late"))
    rows = each.select("doc_id", "t", "n_bytes", "known", F.lit(1).alias("one"), F.lit(0).cast("bigint").alias("late")).unionByName(
        late.select("doc_id", "t", "late"), allowMissingColumns=True
    )
    # Rows that repeat id and text sent their rare words once each.
    n = F.max("known") + F.floor(F.sum("late") / F.sum("one"))
    return rows.groupBy("doc_id", "t").agg(F.max("n_bytes").alias("n_bytes"), n.cast("bigint").alias("n_tokens")).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op5_token_counts(spark, sf: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, sf, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))
