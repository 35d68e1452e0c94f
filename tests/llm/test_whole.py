"""That operators leave nothing out: compared with brute force over everything."""

import itertools
import math
import random
import re
import re._parser
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import html_text, language_id, language_model, license_scan, near_dedup, packing, toxicity
from tessera.llm.license_rules import rules


def test_language_model_is_a_backoff_automaton_over_ngrams_of_all_words(spark, monkeypatch):
    """Rare words that come in fixed triples, in many chunks and shards, against an automaton of dictionaries read token by token."""
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 1 << 15)
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 1 << 13)
    monkeypatch.setattr(language_model, "STRETCH", 7)
    g = random.Random(7)
    phrases = [[f"w{g.randrange(20_000)}" for _ in range(3)] for _ in range(6000)]
    texts = [[w for _ in range(30) for w in g.choice(phrases)] for _ in range(900)] + [[], ["w1"], [w for _ in range(3000) for w in g.choice(phrases)]]
    train = [i % 5 != 0 for i in range(len(texts))]
    seqs = [[*t, None] for t in texts]
    count = [Counter(tuple(s[i : i + n]) for s, t in zip(seqs, train) if t for i in range(len(s) - n + 1)) for n in (1, 2, 3)]
    total, off = sum(count[0].values()), language_model.discount(*(sum(c == k for c in count[0].values()) for k in (1, 2)))
    tally = np.zeros((2, 2, language_model.CLASSES), np.int64)
    for k in (0, 1):
        for c in count[k].values():
            tally[k, :, c - 1 if c <= 4 else 2 + math.ceil(math.log2(c))] += 1, c
    m = [language_model.strength(tally[k], sum(c == 1 for c in count[k + 1].values())) for k in (0, 1)]

    def arc(state, word):
        p = count[0][word,] and (count[0][word,] - off) / total or off * len(count[0]) / total
        for n in range(1, len(state) + 1):
            h = state[len(state) - n :]
            p = (count[n][*h, word] + m[n - 1] * p) / (count[n - 1][h] + m[n - 1])
        return p

    def read(words):
        state, log = (), 0.0
        for w in words:
            while state and not count[len(state)][*state, w]:
                log += math.log10(m[len(state) - 1] / (count[len(state) - 1][state] + m[len(state) - 1]))  # the failure arc
                state = state[1:]
            log += math.log10(arc(state, w))
            state = (*state, w)[-2:]
            while state and not count[len(state) - 1][state]:
                state = state[1:]
        return log

    a, b = phrases[0][:2]
    assert sum(10 ** (read([a, b, w]) - read([a, b])) for w in [*(w for (w,) in count[0]), "never"]) == pytest.approx(1)
    df = spark.createDataFrame([(i, " ".join(t), y) for i, (t, y) in enumerate(zip(texts, train))], "doc_id long, text string, train boolean").repartition(3)
    rows = language_model.score(df, F.col("train")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.score == pytest.approx(read(seqs[r.doc_id]))
    held_out = [r for r in rows if not r.train]
    assert sum(r.score for r in held_out) > 0.6 * sum(r.base_score for r in held_out)


def test_packed_numbers_come_back():
    x = np.concatenate([np.arange(300), [2**14 - 1, 2**14, 2**40, 2**63]]).astype(np.uint64)
    bounds = np.array([0, 0, 5, 200, len(x)])
    out = language_model.packed(x, bounds)
    assert (language_model.unpacked(np.frombuffer(b"".join(out.to_pylist()), np.uint8)) == x).all() and out[0].as_py() == b""
    y = np.array([0, 1, 2**31], np.uint32)
    assert (language_model.restored(language_model.pressed(y)) == y).all()


def spellings(tree):
    """Every text of a rule's pattern (a class's characters by its first ones, a run by one x)."""
    parts = []
    for op, a in tree:
        if str(op) == "LITERAL":
            parts.append([chr(a)])
        elif str(op) == "MAX_REPEAT":
            parts.append((["", *spellings(a[2])] if a[0] == 0 else spellings(a[2])) if a[1] == 1 else ["x"])
        elif str(op) == "SUBPATTERN":
            parts.append(spellings(a[3]))
        elif str(op) == "BRANCH":
            parts.append([x for t in a[1] for x in spellings(t)])
        else:
            assert str(op) == "IN"
            parts.append([chr(v) if str(k) == "LITERAL" else chr(v[0]) for k, v in a])
    return ["".join(x) for x in itertools.product(*parts)]


def test_license_keywords_are_words_of_every_spelling():
    for label, _, keyword, pattern in rules():
        some = {keyword, *license_scan.JOINED.get((label, keyword), ())}
        assert all(some & set(x.split(" ")) for x in spellings(re._parser.parse(pattern))), pattern


def test_license_scan_finds_joined_spellings(spark):
    known = [(label, p, re.compile(pattern), base) for label, p, _, pattern, base in license_scan.table()]
    texts = ["CreativeML OpenRAIL-M", "creativeml openrail m license", "BeerWare License", "GPL2", "under GPL3 license.", "GNU GPLv2 or later", "the FreeBSD license", "Zero-Clause License"]
    rows = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        laid = " " + "  ".join(re.findall("[a-z0-9]+", text.lower())) + " "
        found = [(laid[: m.start()].count(" ") // 2, laid[: m.end()].count(" ") // 2, label, p, n) for n, (label, p, pattern, _) in enumerate(known) for m in pattern.finditer(laid)]
        inside = lambda a, b: b[0] <= a[0] and b[1] >= a[1] and b[3] >= a[3] and (b[:2] != a[:2] or b[3] > a[3] or b[4] < a[4])
        assert found and sorted(tuple(x) for x in rows[i].spans) == sorted(a[:4] for a in found if not any(inside(a, b) for b in found)), text


def test_toxicity_is_fitted_over_all_ngrams(spark, monkeypatch):
    """Beginning with few n-grams ends where beginning with all of them does."""
    g = np.random.default_rng(1)
    words = ["".join(g.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(1200)]
    rows = [(i, " ".join(words[j] for j in g.integers(0, 900, 20) + 300 * (i % 2)), i % 2) for i in range(400)]
    df = spark.createDataFrame([*rows, *[(1, rows[1][1], 1)] * 300], "doc_id long, text string, toxic int")
    found = []
    for start in (100, 1 << 20):
        monkeypatch.setattr(toxicity, "START", start)
        found.append({r.doc_id: r.score for r in toxicity.toxicity(df, df, F.lit(True)).collect()})
    assert max(abs(found[0][i] - found[1][i]) for i in found[0]) < 0.03


def test_samples_are_bounded(spark):
    """Rows that are all alike, in any number, are one in the sample; texts over the bound are not learnt from."""
    rows = spark.range(5000).select(F.lit("en").alias("lang"), F.lit("the same text " * 70).alias("text")).unionByName(spark.createDataFrame([("en", "x" * 5000), ("en", "another"), ("fr", "y" * 3000)], "lang string, text string"))
    found = language_id.sampled(rows, "text", "lang", F.lit(True), 4000, 2000)
    assert sum(map(len, found["en"])) <= 2000 and len(found["en"]) >= 1 and "fr" not in found


def test_packing_leaves_reserved_tokens_as_written(spark):
    from tokenizers import Tokenizer

    texts = ["a <|ENDOFTEXT|> b", "A<|startofText|>B <|endoftext|>, C.", "é<|ENDOFTEXT|>É ok", "<|ENDOF TEXT|>"]
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]


def brute_components(texts):
    sets = {i: near_dedup_set(t) for i, t in texts.items()}
    comp = {i: i for i in texts}
    find = lambda i: i if comp[i] == i else find(comp[i])
    for a, b in itertools.combinations(texts, 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        if small and 100 * small >= 75 * large and 100 * (n := len(sets[a] & sets[b])) >= 75 * (small + large - n):
            x, y = sorted((find(a), find(b)))
            comp[y] = x
    return {i: find(i) for i in texts}


def near_dedup_set(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates_among_many_texts_that_share_a_passage(spark, monkeypatch):
    """Hundreds of texts with one template, some of them near copies of one another: crowded keys, rare shingles and blocks."""
    monkeypatch.setattr(near_dedup, "CROWD", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    made = []
    monkeypatch.setattr(near_dedup, "rare_keys", lambda *a, f=near_dedup.rare_keys: made.append(f(*a)) or made[-1])
    g = random.Random(3)
    word = lambda: f"w{g.randrange(10**6)}"
    template = [word() for _ in range(104)]
    texts = {i: template + [word() for _ in range(60)] for i in range(300)}
    for i in range(300, 360):  # chains of near copies, their own words last
        texts[i] = texts[i - 1 if i % 3 else i - 200][:-5] + [word() for _ in range(5)]
    texts = {i: " ".join(t) for i, t in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert found == brute_components(texts) and made


def test_components_of_long_paths(spark):
    g = random.Random(5)
    nodes = g.sample(range(10**6), 300)
    links = [(a, b) if g.random() < 0.5 else (b, a) for a, b in zip(nodes[:200], nodes[1:200])] + [(nodes[250], x) for x in nodes[251:]]
    found = {r.node: r.comp for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: min(nodes[:200]) for x in nodes[:200]} | {x: min(nodes[250:]) for x in nodes[250:]}


@pytest.mark.parametrize("local", [0, 10**6])
def test_components_are_those_of_brute_force(spark, monkeypatch, local):
    """By stars and by one task: random graphs of every density, links of a node with itself and links given twice."""
    monkeypatch.setattr(near_dedup, "LOCAL_LINKS", local)
    g = np.random.default_rng(8)
    links = [(int(a) * 10**17, int(b) * 10**17) for n in (5, 40, 80) for a, b in n + g.integers(-n // 2, n // 2, (n // 2, 2)) - 90]
    comp = {x: x for link in links for x in link}
    for _ in comp:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    met = {x for a, b in links if a != b for x in (a, b)}
    found = [tuple(r) for r in near_dedup.components(spark.createDataFrame([*links, *links], "a long, b long")).collect()]
    assert sorted(found) == sorted((x, c) for x, c in comp.items() if x in met)
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_take_few_jobs(spark, monkeypatch):
    """Each job leaves its plans, threads and code with the driver: components of few links are found in one, whatever their shape."""
    kept = []
    monkeypatch.setattr(near_dedup, "keep", lambda df, name, f=near_dedup.keep: kept.append(name) or f(df, name))
    g = random.Random(6)
    texts = [[f"w{g.randrange(10**6)}" for _ in range(60)]]
    for i in range(1, 90):  # chains of near copies
        texts.append([*texts[-1][3:], *(f"w{g.randrange(10**6)}" for _ in range(3))] if i % 30 else [f"w{g.randrange(10**6)}" for _ in range(60)])
    texts = {i: " ".join(t) for i, t in enumerate(texts)}
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == brute_components(texts) and len(set(found.values())) == 3
    assert len(kept) <= 30 and "edges" not in kept, kept


def test_near_duplicates_of_repeated_ids(spark):
    long = lambda s: " ".join(f"{s}{i}" for i in range(40))
    rows = [(1, long("a")), (1, long("b")), (1, long("b")), (2, long("b") + " end"), (3, long("c")), (None, long("c")), (4, None)]
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(0, 36, 0, True), (1, 36, 1, True), (1, 36, 1, True), (1, 36, 1, True), (2, 37, 1, False), (3, 36, 3, True), (4, 0, 4, True)]


def test_hostile_pages_take_linear_time():
    n = 20_000
    pages = ['<div class="a b">' * n + "deep", "<div>" * n + "x<p>y" * n, "<span>" * n + "</i>" * n + "t", "<div><i><div>" + "<span>" * n + "</i>" * n + "t", "<span>" * n + "<div>x</div>" * n, "<a " * n, '<a "' * n + ">", "<!" * n, "<p>" * n + "</p>" * n, "<ul>" + "<li>x" * n]
    for page in pages:
        began = time.time()
        html_text.describe(html_text.leaf_blocks(page))
        assert time.time() - began < 3, page[:30]


def test_pages_keep_what_is_not_named(spark):
    model = html_text.trained(160)
    page = '<html><body><nav><a href=#>Home</a></nav><article><h1>Title of it</h1><p title="the hidden path" class="md hidden wide">One two three.<div hidden><p>A note.</div><p>Let <math><mi>x</mi> + <mi>y</mi></math> be it.<p>Last one here.</article></body>'
    assert html_text.main_blocks(page, model) == ["Title of it", "One two three.", "A note.", "Let x + y be it.", "Last one here."]
    long = "<article>" + "".join(f"<p>Sentence number {i} of many more.</p>" for i in range(20_000)) + "</article>"
    assert len(html_text.main_blocks(long, model)) == 20_000
    df = spark.createDataFrame([(1, "u", page, "clash", 3)], "page_id long, url string, html string, text string, n_chars long")
    assert [r.n_chars for r in html_text.extract(df, model=model).collect()] == [len("Title of it One two three. A note. Let x + y be it. Last one here.")]
    assert html_text.extract(df.where("false"), model=model).count() == 0
