"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitra.llm.common import table

# Votes of a labeller.
BAD, GOOD, ABSTAIN = 0, 1, 2
FEATURES = 1 << 14
GRAMS = (2, 3, 4)
# Documents on which the scorer is fitted, half of each weak label, in so many shards.
SAMPLE = 8192
SHARDS = 8
CUT = 0.5
PIECE = 1 << 20
# Largest part of the gradient at which a fit has converged.
STILL = 1e-5

_COUNTED = {name: np.isin(np.arange(256), list(chars)) for name, chars in (
    ("symbols", b"#*$%&|<>"), ("bangs", b"!"), ("upper", bytes(range(65, 91))), ("letters", bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)])),
    ("plain", bytes([*range(9, 14), *range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0x100)]) + b" .,;:!?'\"()-"),
)}


_SYMBOL = re.compile(rb"[#*$%&|<>]")


def _band(value: float, good: float, bad: float) -> int:
    """Good up to one bound, bad beyond another, no vote between."""
    return GOOD if value <= good else BAD if value >= bad else ABSTAIN


def votes(raw: bytes) -> tuple[int, ...] | None:
    """The labellers' votes on a UTF-8 text; None without a word.

    In order: symbols per word, exclamation marks per word, share of capitals, a word that repeats its neighbour, repeated
    lines, share of words that end a clause, mean word length, share of words with a symbol, share of
    bytes that are no letter, digit, white space or common punctuation, share of three-word windows seen before. Each fault but a poor form is
    seen by two labellers or more: that they agree is what tells a fault from a labeller's slip.
    """
    words = raw.split()
    n = len(words)
    if not n:
        return None
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    count = {k: int(seen[v].sum()) for k, v in _COUNTED.items()}
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = sum(w[-1] in b".,;:!?" for w in words) / n
    mean = sum(map(len, words)) / n
    marked = sum(map(bool, map(_SYMBOL.search, words))) / n
    again = 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / (n - 2) if n >= 10 else 0
    return (
        _band(count["symbols"] / n, 0.05, 0.3),
        _band(count["bangs"] / n, 0.1, 0.4),
        _band(count["upper"] / max(count["letters"], 1), 0.25, 0.5),
        _band(same / n, 0.05, 0.2) if n >= 10 else ABSTAIN,
        _band(1 - len(set(lines)) / len(lines), 0.1, 0.4) if len(lines) >= 4 else ABSTAIN,
        (GOOD if 0.02 <= ends <= 0.4 else BAD) if n >= 20 else ABSTAIN,
        GOOD if 2.5 <= mean <= 11 else BAD if not 1.5 <= mean <= 16 else ABSTAIN,
        _band(marked, 0.05, 0.2),
        _band(1 - count["plain"] / len(raw), 0.02, 0.08),
        _band(again, 0.1, 0.3) if n >= 10 else ABSTAIN,
    )


# The fault that each labeller sees: symbols, shouting, repetition, or a form that is not prose.
FAULTS = (0, 1, 1, 2, 2, 3, 3, 0, 0, 2)


def code_of(v: tuple[int, ...]) -> int:
    return sum(x * 3**i for i, x in enumerate(v))


def decode(codes: np.ndarray, labellers: int) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(labellers)) % 3


def fit_labellers(codes: np.ndarray, counts: np.ndarray, faults: tuple[int, ...] = FAULTS, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, each labeller's ``P(vote | class)`` where it votes (labeller, class, vote), and every code's posterior of good.

    Expectation-maximisation over the distinct vote patterns, of which there are at most 3^labellers however many documents there are. There
    is a class for each fault and, last, one for good documents. It starts from the view that a BAD vote tells of the fault that its labeller
    sees; what a labeller says of documents with another fault is estimated, so passing unrelated checks does not outweigh one clear BAD.
    Labellers are independent given the class, and an abstention says nothing. One pseudo-count per vote keeps every probability positive.
    """
    v = decode(codes, len(faults))
    bad = np.stack([(v[:, [f == k for f in faults]] == BAD).any(1) for k in range(max(faults) + 1)], 1).astype(float)
    seen = bad.sum(1, keepdims=True)
    spread = np.where(seen > 0, bad / np.maximum(seen, 1), 1 / bad.shape[1])
    good = np.where(seen > 0, 0.1, 0.9)
    post = np.hstack([spread * (1 - good), good])
    onehot = (v[:, :, None] == np.array([BAD, GOOD])).astype(float)
    prior, table_ = post.mean(0), np.full((len(faults), post.shape[1], 2), 1 / 2)
    for _ in range(rounds):
        w = post.T * counts
        prior = (w.sum(1) + 1) / (w.sum() + len(w))
        table_ = np.einsum("cp,pjv->jcv", w, onehot) + 1
        table_ /= table_.sum(2, keepdims=True)
        like = np.einsum("pjv,jcv->pc", onehot, np.log(table_)) + np.log(prior)
        new = np.exp(like - like.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-9:
            break
    return float(prior[-1]), table_, post[:, -1]


def features(raw: bytes) -> np.ndarray:
    """Square roots of the hashed byte n-gram frequencies: a dense vector of length one per n-gram size."""
    total = np.zeros((len(GRAMS), FEATURES))
    for at in range(0, len(raw), PIECE):  # bounded memory for any text
        a = np.frombuffer(raw[at : at + PIECE + max(GRAMS) - 1], np.uint8).astype(np.uint32)
        for g, n in enumerate(GRAMS):
            m = min(len(a) - n + 1, PIECE)
            if m > 0:
                h = np.full(m, n, np.uint32)
                for k in range(n):
                    h = h * np.uint32(0x01000193) + a[k : k + m]
                total[g] += np.bincount((h * np.uint32(2654435761)) >> np.uint32(18), minlength=FEATURES)
    size = total.sum(1, keepdims=True)
    return np.sqrt(total / np.maximum(size, 1)).sum(0).astype(np.float32)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Weights and, last, the intercept of an L2-penalised logistic fit to soft labels, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)  # single precision throughout: a double vector would copy the matrix in every round
    w = v = np.zeros(x.shape[1], np.float32)
    penalty = np.full(x.shape[1], l2, np.float32)
    penalty[-1] = 0
    step = np.float32(1 / (0.25 * (len(GRAMS) ** 2 + 1) + l2))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -50, 50)))
        slope = ((p - y) / np.float32(len(y))) @ x + penalty * v
        if np.abs(slope).max() < STILL:
            break
        new = v - step * slope
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w.astype(np.float64)


def _votes_of(docs: DataFrame, text: str) -> DataFrame:
    def run(batches):
        for b in batches:
            codes, n = np.unique([-1 if (v := votes((t.as_py() or "").encode("utf-8", "surrogatepass"))) is None else code_of(v) for t in b.column(0)], return_counts=True)
            yield pa.RecordBatch.from_pydict({"code": codes.astype(np.int64), "n": n.astype(np.int64)})

    return docs.select(text).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, seed: int = 7):
    """Posterior by vote code, labeller table, and the scorer's weights.

    Votes are counted over all documents. The scorer is fitted on at most about ``sample`` documents: a hash of id and text selects them at a rate
    that follows from the counts, half from each weak label. Each of SHARDS tasks fits its share of the sample, and the weights are averaged.
    Returns None when there is no document with a word.
    """
    counted = [r for r in _votes_of(docs, text).collect() if r.code >= 0]
    if not counted:
        return None
    codes, counts = np.array([r.code for r in counted]), np.array([r.n for r in counted], float)
    prior, accuracies, post = fit_labellers(codes, counts)
    posterior = dict(zip(codes.tolist(), post.tolist(), strict=True))
    good = max(counts[post >= 0.5].sum(), 1.0)
    bad = max(counts[post < 0.5].sum(), 1.0)
    rates = (min(1.0, sample / 2 / bad), min(1.0, sample / 2 / good))
    key = F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed)), F.lit(1 << 40))
    known = docs.sparkSession.sparkContext.broadcast(posterior)

    def pick(batches):
        for b in batches:
            out = [[], [], []]
            for t, k in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                v = votes(raw)
                if v is None:
                    continue
                p = known.value[code_of(v)]
                if k < rates[p >= 0.5] * (1 << 40):
                    for c, x in zip(out, (k % SHARDS, p, features(raw).tobytes()), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.float64(), pa.binary()), strict=True)], names=["shard", "p", "x"])

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p", "x"])  # the order of arrival does not matter
        x = np.stack([np.frombuffer(b, np.float32) for b in pdf["x"]])
        return pd.DataFrame({"n": [len(pdf)], "w": [logistic(x, pdf["p"].to_numpy()).tobytes()]})

    chosen = docs.select(F.col(text).alias("t"), key.alias("k")).where(F.col("k") < int(max(rates) * (1 << 40)) + 1)
    shards = chosen.mapInArrow(pick, "shard bigint, p double, x binary").groupBy("shard").applyInPandas(train, "n bigint, w binary").collect()
    total = sum(s.n for s in shards)
    weights = sum((np.frombuffer(s.w) * (s.n / total) for s in sorted(shards, key=lambda s: (s.n, s.w))), np.zeros(FEATURES + 1))
    return posterior, accuracies, weights


def classify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the text, with ``weak_label`` (posterior of the votes), ``score`` (the scorer's probability of good text) and ``kept``.

    A text without a word (null and empty ones too) has no votes, a null weak label, the score 0 and is not kept. Columns of those names are
    replaced. Repeated rows get equal scores. Empty tables give no rows.
    """
    added = ["weak_label", "score", "kept"]
    keep = [c for c in docs.columns if c not in (text, *added)]
    fitted = fit(docs, doc_id=doc_id, text=text, sample=sample)
    known = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        posterior, _, weights = known.value or ({}, None, np.zeros(FEATURES + 1))
        for b in batches:
            out = [[], [], []]
            for t in b.column(text):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                v = votes(raw)
                s = 0.0 if v is None else float(1 / (1 + np.exp(-np.clip(features(raw) @ weights[:-1] + weights[-1], -50, 50))))
                for c, x in zip(out, (None if v is None else posterior[code_of(v)], s, v is not None and s >= cut), strict=True):
                    c.append(x)
            cols = [pa.array(c, k) for c, k in zip(out, (pa.float64(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *cols], names=[*keep, *added])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{kinds}weak_label double, score double, kept boolean")


def op2_weak_quality(spark, sf: str) -> DataFrame:
    """Weak label, score and verdict of every document."""
    return classify(table(spark, sf, "documents").select("doc_id", "text"))
