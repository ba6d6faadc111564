"""The pipeline's stages against what each operator says of its own input."""

import hashlib
import math
import os
import random
from collections import Counter

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from arbitra.llm import jaccard, langid, mixing, packing, quality
from arbitra.llm.common import table

from .test_operators import TOKENS, brute_groups

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns
        kept[name] = (docs, out)
        docs = out
    before, after = kept["language_id"]
    assert after.count() >= 0.97 * before.count()
    before, after = kept["quality_rules"]
    bad = {r["doc_id"] for r in quality.judge(before).where("NOT kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - bad
    before, after = kept["near_duplicates"]
    first = {r["component_id"] for r in jaccard.jaccard_groups(before).collect()}
    assert {r["doc_id"] for r in after.collect()} == first and after.count() == len(first)
    mixed = kept["mix_sources"][1]
    pieces = corpus_pipeline.STAGES[-1][1](spark, mixed, SF).toPandas()
    assert set(pieces["doc_id"]) == {r["doc_id"] for r in mixed.collect()}
    assert pieces.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY


def brute_copies(rows):
    """How often the mix repeats each ``(doc_id, text)``, sources weighing as the square root of their bytes; all rates are small."""
    size = Counter()
    for r in rows:
        size[r["source"]] += len((r["text"] or "").encode())
    whole, roots = sum(size.values()), sum(math.sqrt(v) for v in size.values())
    out = Counter()
    for r in rows:
        rate = math.sqrt(size[r["source"]]) / roots * whole / size[r["source"]]
        assert rate < mixing.PART
        u = (int(hashlib.md5(f"42:{r['doc_id']}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = c = math.exp(-rate)
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out[r["doc_id"], r["text"]] += k
    return out


def test_run_against_brute_force(spark, tmp_path):
    """All stages over copies, a row without id, a repeated row, two texts of one id, foreign text and null text.

    The first two stages are taken by what their operators decide (tested by themselves); the rest is computed anew.
    """
    docs = table(spark, SF, "documents")
    good = [r for r in quality.judge(corpus_pipeline.language_id(spark, docs, SF)).where("kept").collect()]
    plain = {r["doc_id"]: r for r in docs.collect()}
    known = sorted(r["doc_id"] for r in good)
    one, two, three, four = (plain[i] for i in known[:4])
    odd = [
        (None, one["text"], one["lang"], one["source"], 0), tuple(two), (three["doc_id"], four["text"] + " " + three["text"], three["lang"], three["source"], 0),
        (10**6, one["text"].upper(), one["lang"], one["source"], 0), (10**6 + 1, "щгыф жщцъ " * 50, "en", one["source"], 0), (10**6 + 2, None, None, None, None),
    ]
    spark.createDataFrame([tuple(r) for r in plain.values()] + odd, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    rows = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:2]:
        rows = spark.createDataFrame(stage(spark, rows, str(tmp_path)).collect(), docs.schema)
    rows = rows.collect()
    assert not any(r["text"] is None or "щ" in r["text"] for r in rows)
    ids = Counter(r["doc_id"] for r in rows)
    # proper ids come first, then each pair of id and text that is not told by its id
    keys, number = {}, 10**7
    for r in rows:
        pair = (r["doc_id"], r["text"])
        if pair not in keys:
            own = r["doc_id"] is not None and ids[r["doc_id"]] == 1
            keys[pair], number = (r["doc_id"], number) if own else (number, number + 1)
    groups = brute_groups([(k, text) for (_, text), k in keys.items()], 5, 80)
    first = {(r["doc_id"], r["text"]): r for r in rows if groups[keys[r["doc_id"], r["text"]]][1] == keys[r["doc_id"], r["text"]]}
    assert len(first) < len(rows)
    tok = Tokenizer.from_file(TOKENS)
    want = Counter()
    for (key, text), n in brute_copies(list(first.values())).items():
        if n:
            want[key] += n * (len(tok.encode(text, add_special_tokens=False).ids) + 1)
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert {int(k): int(v) for k, v in got.groupby("doc_id")["length"].sum().items()} == dict(want)
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        ends = seq["offset"] + seq["length"]
        assert seq["offset"].tolist() == [0, *ends.tolist()[:-1]] and ends.max() <= packing.CAPACITY


def test_rows_without_id_and_empty_tables(spark):
    docs = table(spark, SF, "documents")
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
    odd = docs.limit(30).unionAll(spark.createDataFrame([(None, "Ein kurzer Text ohne Nummer und Sinn", None, None, None)], docs.schema))
    assert corpus_pipeline.near_duplicates(spark, odd, SF).where("doc_id IS NULL").count() == 1
    assert langid.UNKNOWN == "und"


@pytest.mark.parametrize("n_langs", [1, 2, 50])
def test_unlearned_languages_and_noise_go_whatever_is_learned(spark, n_langs):
    """Related languages: half of each language's syllables come from a common stock. Short clean texts stay."""
    rng = random.Random(n_langs)
    syllable = lambda: rng.choice("bcdfghklmnprstvz") + rng.choice("aeiouäéø") + rng.choice("lmnrst")
    common = [syllable() for _ in range(12)]
    stock = {f"l{i:02d}": common[:6] + [syllable() for _ in range(12)] for i in range(n_langs)}
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(make(stock[g], rng.choice((12, 40, 120))), g) for g in stock for _ in range(30)]
    clean = len(rows)
    alien = [chr(0x430 + i) + chr(0x440 + i % 7) for i in range(12)]
    latin = [syllable() for _ in range(16)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows += [(make(alien, 40), None) for _ in range(20)] + [(make(latin, 60), None) for _ in range(20)]
    rows += [("".join(rng.choice(letters + "  ") for _ in range(300)), None) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, g, "s", len(t)) for i, (t, g) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    assert sum(i < clean for i in got) >= 0.98 * clean
    assert sum(i >= clean for i in got) <= 1


def test_queries_are_registered():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {f"op{x[2:].split('_')[0]}_" for x in names if x.startswith("op") and x[2].isdigit()}
    assert "pipeline" in names


def test_usual_rates_are_those_of_all_texts(spark):
    """The medians of a language are those of every one of its texts, also of more than a thousand."""
    words = {"en": "the house of white stone stands near an old river".split(), "de": "das haus aus weissem stein steht nahe einem alten fluss".split()}
    rng = random.Random(3)
    both = [*words["en"], *words["de"]]
    rows = []
    for i in range(2400):
        lang = "en" if i % 4 else "de"
        own = [rng.choice(words[lang]) for _ in range(8)]
        rows.append((i, " ".join(own if i % 8 < 5 else [*own, *(rng.choice(both) for _ in range(rng.randint(1, 12)))]), lang))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    filters = langid.fit(docs)
    found = langid.norms(docs, filters)
    assert found.keys() == {"en", "de"}
    for lang, usual in found.items():
        rates = [filters.rate(t)[1:] for _, t, g in rows if g == lang]
        for i in range(2):
            each = sorted(round(r[i] * langid.NORM_STEPS) for r in rates)
            assert usual[i] * langid.NORM_STEPS == pytest.approx((each[(len(each) - 1) // 2] + each[len(each) // 2]) / 2, abs=1)
