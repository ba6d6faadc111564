"""Page text, token alignment and the source audit against brute force and awkward rows."""

import hashlib
import html
import random
import re
from collections import Counter, defaultdict

import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arbitra.llm import crosstoken, divergence, htmltext

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "This is the long text of a story that was told to all of the people who have been in the town for years and years."
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- 11 ---------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("<p>Hello world.</p>", "Hello world."),
        (
            f'<header><h1>Site</h1><a href=/>Home</a></header><div id="sidebar"><p>{LONG}</p></div><main><article><header><h1>Title</h1></header><p>{LONG}</p>'
            f'<ul><li>one</li><li>two</li></ul><aside>{LONG}</aside><section class="post-comments"><h2>Comments</h2><p>{LONG}</p></section></article></main>'
            f'<div class="cookieNotice cookie-notice">{LONG}</div><form><p>{LONG}</p></form><footer>{LONG}</footer>',
            f"Title\n{LONG}\none\ntwo",
        ),
        ('<nav><a href=1>a</a></nav><h2>Head</h2><p>' + LONG + "</p>short<p>" + LONG + '</p><div><a href=1>One</a> | <a href=2>Two</a></div><div>Imprint</div>', f"Head\n{LONG}\nshort\n{LONG}"),
        ("<article><p>a &lt;b&gt; &amp;amp; &eacute;&nbsp;&#233; \n\t x</p></article>", "a <b> &amp; é é x"),
        ('<article><p title="x>oops</p><p>tail</p></article>', "oops\ntail"),
        ("<article>one<br>two<br><br/>three</article>", "one two\nthree"),
        ("<article>a<!-- <p>x</p> --> b <!-- unclosed", "a b"),
        ('<article><script>var t="</p>";if(a<b){}</script>text<style>p{}</style></article>', "text"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        ('<article><p hidden>no</p><p style="display: none">no</p><p>yes</p></article>', "yes"),
        (f"<article><p>Short.</p></article><div>{LONG}</div>", f"Short.\n{LONG}"),
    ],
)
def test_main_text_of_small_pages(page, want):
    assert htmltext.main_text(page) == want


def test_ambiguous_blocks_take_the_nearest_label():
    block = lambda n, article=0, heading=False: htmltext.Block("x" * n, heading, article)
    found = [block(10), block(10), block(10), block(10), block(10, heading=True), block(10)]
    assert htmltext.inherit(found, [False, None, None, None, None, True]) == [False, False, False, True, True, True]
    found = [block(9), block(9, heading=True), block(9)]
    assert htmltext.inherit(found, [False, None, True]) == [False, True, True]
    assert htmltext.inherit([block(9), block(9), block(9)], [False, None, True]) == [False, False, True]
    inside = [block(9, 1), block(9, 1), block(9, 1)]
    assert htmltext.inherit(inside, [False, None, True]) == [False, True, True]
    assert htmltext.inherit(inside, [False, None, False]) == [False, False, False]


def test_hostile_pages_take_linear_time():
    for page in ("<a " * 200_000, '<a "' * 200_000, "<script" * 100_000, "<" * 400_000, "</div>" * 100_000, "<!--" * 200_000):
        htmltext.main_text(page)


def test_pages_of_the_table_give_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in htmltext.op11_html_text(spark, "/root/testdata/sf0.001").collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = r["html"].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("</?b>|<br>", "", x)).split()) for x in re.split("</?p>|</?h1>", article)]
        want = "\n".join(x for x in parts if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_extract_keeps_rows_and_clashing_columns(spark):
    rows = [(1, "u", "<p>a</p>", "old", 5), (1, "u", "<p>a</p>", "old", 5), (None, None, None, None, None), (2, "v", "x" * 300_000, "old", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = htmltext.extract(df)
    assert got.columns == ["page_id", "url", "html", "n_chars", "text"]
    want = Counter([(1, "a"), (1, "a"), (None, ""), (2, "x" * 300_000)])
    assert Counter((r["page_id"], r["text"]) for r in got.collect()) == want
    assert htmltext.extract(df.limit(0)).count() == 0


# --- 12 ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    bits = [" ", "  ", "\n", " \n", "\t", "a", "the", "'ll", "123", "½", "é", "<|endoftext|>", "<0x41>", "</s>", "漢字", "😀", "\x00", "\x1c", "\xa0", ".", "hello", "\r\n", "x ", "ſ"]
    out = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 25))), "en", f"s{i % 3}", 0) for i in range(400)]
    out += [(400, None, "en", None, None), (401, "", None, "s1", 0), (402, "a ▁ b", "fr", "s1", 3), (403, " ", "en", "s1", 3), (404, "word " * 20_000, "en", "s2", 0)]
    return [*out, out[0], out[0], (None, "no id", "en", "s0", 0), (405, "y" * 5_000, "en", "s0", 0)]


def by_hand(texts):
    """The contract's figures of each text, by loops over the libraries' own tokens."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(b): b for b in prints} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in prints)}
    each, counts = [], Counter()
    for text in texts:
        a = tok.encode(f" {text}", add_special_tokens=False) if text else None
        a = list(zip(a.ids, [bytes(letter[c] for c in t) for t in a.tokens], strict=True)) if text else []
        b = []
        for i in sp.encode(text) if text else []:
            p = sp.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
        if not text or not b"".join(x for _, x in a) == b"".join(x for _, x in b) == f" {text}".encode():
            each.append(([], [], [], []))
            continue
        ends = []
        for side in (a, b):
            at, found = 0, {}
            for i, raw in side:
                at += len(raw)
                found[at] = i
            ends.append(found)
        common = sorted(set(ends[0]) & set(ends[1]))
        links = [(ends[0][e], ends[1][e]) for e in common]
        counts.update(links)
        groups, last = [], 0
        for e in common:
            groups.append("|".join(",".join(str(f[x]) for x in sorted(f) if last < x <= e) for f in ends))
            last = e
        each.append((a, b, links, groups))
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    out = []
    for a, b, links, groups in each:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out


@pytest.mark.parametrize("hot", [131_072, 40, 0])
def test_alignment_equals_brute_force(spark, odd_rows, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(crosstoken, "BROADCAST_PAIRS", hot)
    df = spark.createDataFrame(odd_rows, SCHEMA).withColumns({"pairs": F.lit(1), "row": F.lit("x"), "groups": F.lit(None)})
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = crosstoken.op12_token_align(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = by_hand([r[1] for r in odd_rows])
    assert any(w[0] == 0 for w in want) and any(w[2] > 1 for w in want)
    assert Counter(map(tuple, got.collect())) == Counter((r[0], *w) for r, w in zip(odd_rows, want, strict=True))


def test_alignment_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert crosstoken.op12_token_align(spark, str(tmp_path)).count() == 0


def test_units_give_the_libraries_ids():
    both = crosstoken.Both(A, B)
    rng = random.Random(8)
    bits = [" ", "  ", "\n", "\n ", "\t", "a", "the", "'s", "'", "12", "é", "Ž", "–", ".", "...", "\r\n", "word", " x", "€", "\x0b", "\x0c"]
    for _ in range(5_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        (a, b), = both.ids([text])
        x, y = both.a.encode(f" {text}"), both.b.encode(text)
        if both._same(f" {text}", x, y):
            assert [*memoryview(a).cast("I")] == x and [*memoryview(b).cast("I")] == y
        else:
            assert a == b == b""


def test_overlaps_are_all_pairs_of_ranges_that_meet():
    rng = random.Random(2)
    sides = []
    cuts = [sorted(rng.sample(range(1, 200), 30)) for _ in range(2)]
    for c in cuts:
        edges = sorted({0, 100, 200, *c})
        sides.append(pd.DataFrame([(int(s >= 100), s, e) for s, e in zip(edges, edges[1:], strict=False)], columns=["doc", "start", "end"]))
    a, b = sides
    want = {(i, j) for i, x in a.iterrows() for j, y in b.iterrows() if x["doc"] == y["doc"] and x["start"] < y["end"] and y["start"] < x["end"]}
    got = [(int(x), int(y)) for x, y in crosstoken.overlaps(a, b).itertuples(index=False)]
    assert len(got) == len(set(got)) and set(got) == want


# --- 13 ---------------------------------------------------------------------


def audit_by_hand(rows, min_docs=3, ranks=200):
    n, docs = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        n[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    kept = {lang: sorted(t for t, d in c.items() if d >= min_docs) for lang, c in docs.items()}

    def p(counts, lang):
        total = sum(counts[t] for t in kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept[lang])) for t in kept[lang]}

    for lang, source in groups:
        mine = p(n[lang, source], lang)
        every = p(sum((n[g] for g in groups if g[0] == lang), Counter()), lang)
        f = lambda x, y: (x - y) ** 2 // y
        pairs = [(s, sum(f(mine[t], q) for t, q in p(n[lang, s], lang).items())) for h, s in groups if h == lang and s != source]
        terms = [(t, f(x, every[t])) for t, x in mine.items() if n[lang, source][t] and x > every[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out |= {(lang, source, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("shard, held, step", [(500_000, 500_000, 16_000_000), (20, 5, 200)])
def test_audit_equals_brute_force(spark, odd_rows, monkeypatch, shard, held, step):
    monkeypatch.setattr(divergence, "SHARD", shard)
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "STEP_BYTES", step)
    rng = random.Random(4)
    words = [f"{c}{v}{i}" for i in ("", "é", "ß", "K", "漢") for c in "bcdfgÄ" for v in "aeI"]
    rows = odd_rows + [(500 + i, " ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["de", "xx"]), f"s{int(rng.random() ** 3 * 6)}", 0) for i in range(150)]
    rows += [(900, "only one", "rare", "a", 0), (901, None, "rare", "b", 0), (902, "lone", "alone", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit(1), "value": F.lit("x"), "part": F.lit(0)}).repartition(4)
    got = divergence.audit(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == audit_by_hand(rows)
    assert ("rare", "a", "pair", "b", 0, 1) in got


def test_audit_ranks_and_empty_table(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, SCHEMA)
    got = {tuple(r) for r in divergence.audit(df, min_docs=1, ranks=2).collect()}
    assert got == audit_by_hand(odd_rows, 1, 2)
    assert divergence.audit(df.limit(0)).count() == 0


def test_probabilities_of_huge_counts_are_exact(spark):
    n, total, v = 5 * 10**17, 8 * 10**18, 10**9
    df = spark.createDataFrame([(n, total, v), (0, 0, 0)], "n bigint, total bigint, v bigint")
    got = [r[0] for r in df.select(divergence.probability(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // (total + v), None]
