import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import audio, html_text, language_id, language_model, license_scan, mixing, near_dedup, packing, toxicity, vector_search
from tessera.llm.common import HashIndex, crc_mod

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EN, FR = "the cat sat on the mat and then it went home again to sleep", "le chat est sur la table et puis il va dormir encore une fois"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty, blank and long texts, repeated rows, exact and near copies, an extra column with a clashing name."""
    rows = [(i, f"{EN} number {i} {'x' * (i % 5)} the mit license", "en", f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, f"{FR} numéro {i} voilà l'été", "fr", None) for i in range(40)]
    rows += [(200, None, "en", "s0"), (201, "", None, "s1"), (202, " \n\t ", "fr", "s2"), (203, "12 34 -- !!", "en", "s0"), (204, " ".join(f"w{i}" for i in range(30_000)), "en", "s0"), (205, "one two", None, "s9"), (None, EN, "en", "s1")]
    rows += [(300, " ".join(f"a{i}" for i in range(100)), "en", "s1"), (301, " ".join(f"A{i}" for i in range(100)), "en", "s1"), (302, " ".join(f"a{i}" for i in range(2, 100)), "en", "s1"), (303, " ".join(f"a{i}" for i in range(99)), "en", "s2"), (303, " ".join(f"a{i}" for i in range(99)), "en", "s2")]
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, source string, score double, lang_pred string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


def test_hash_index():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64))
    index = HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + np.uint64(1 << 62)) == -1).all()


def test_contexts_are_distributions_and_costs_match():
    tree = language_id.ContextTree([EN.encode(), b"a", b""])
    for n in range(1, 6):
        for context in tree.contexts[n][:20]:
            keys = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
            assert tree.cost(keys, n, bits=False).sum() == pytest.approx(1)
    model = language_id.Model({"en": [EN.encode()], "fr": [FR.encode()]})
    texts = [b"", "été at the mat".encode(), EN.encode() * 50_000]
    offsets = np.cumsum([0, *map(len, texts)])
    bits = model.bits(np.frombuffer(b"".join(texts), np.uint8), offsets)
    one = language_id.ContextTree([EN.encode()])
    want = one.cost(language_id.grams(language_id.padded([texts[1]]), 5), 5).sum() * language_id.UNIT
    assert bits[0, 1] == pytest.approx(want, abs=20) and (bits[:, 0] == 0).all() and bits[0, 2] > 0


def test_language_id(docs, empty):
    train = crc_mod("doc_id", 3) != 1
    rows = language_id.identify(docs, train).collect()
    assert len(rows) == docs.count()
    assert all(r.lang_pred == ("en" if r.doc_id < 100 else "fr") for r in rows if r.doc_id is not None and r.doc_id < 200)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (200, 201, 202, 203))
    assert all(0 <= r.score <= 1 for r in rows)
    assert language_id.identify(empty, train).count() == 0
    carried = language_id.identify(docs, train, carry=docs.columns)
    assert set(carried.columns) == {*docs.columns, "bits_per_byte"}
    assert {r.lang_pred for r in language_id.identify(docs, F.lit(False)).collect()} == {"und"}


def test_license_scan(docs, empty):
    spark = docs.sparkSession
    texts = ["The MIT License, the mit-license. MIT licensed", "xmit license é mit licenseé", "GNU Lesser General Public License version 3", None, "", "mit", "all rights reserved " * 3000, "Licensed under the Apache License, Version 2.0"]
    rows = {r.doc_id: r for r in license_scan.digest(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = [(j, label) for phrase, label in license_scan.BASE for p in [phrase.split()] for j in range(len(w)) if w[j : j + len(p)] == p]
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1
    assert "lgpl-3.0" in rows[2].labels and "gpl" in rows[2].labels and rows[6].n_spans == 3000 and "apache-2.0" in rows[7].labels
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(docs).count() == docs.count()


def test_near_duplicates(docs, empty):
    sets, rows = {}, [r for r in docs.collect() if r.doc_id is not None]
    for r in rows:
        w = WORD.findall(lower(r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in range(4):
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_parity_never_exceeds_the_difference():
    g = np.random.default_rng(5)
    a = np.unique(g.integers(0, 1 << 63, 300).astype(np.uint64))
    b = np.concatenate([a[:250], np.unique(g.integers(0, 1 << 63, 40).astype(np.uint64))])
    p = near_dedup.parities([a, b])
    assert sum(int(x).bit_count() for x in (p[:, 0] ^ p[:, 1]).view(np.uint64)) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_html():
    model = html_text.trained(160)
    page = '<html><head><title>x</title></head><body><nav><a href=#>Home</a></nav><div class="cookie notice">We use cookies.</div><article><h1>A &amp; B</h1><p>One   two<br>three.<p>Four <b>five</b>.</article><section class="comments"><p>Nice post.</p></section><footer>&copy; me</footer><script>var t="</p>";</script></body>'
    assert html_text.main_blocks(page, model) == ["A & B", "One two three.", "Four five."]
    assert html_text.main_blocks(None, model) == html_text.main_blocks("", model) == []
    test = list(html_text.labelled_pages(40, seed=5))
    right = [a == b for p, roles in test for a, b in zip(model.viterbi(model.scores(html_text.describe(html_text.leaf_blocks(p)))), roles)]
    assert sum(right) / len(right) > 0.97
    emit = np.random.default_rng(0).normal(size=(5, 2))
    score = lambda y: sum(emit[i, k] for i, k in enumerate(y)) + sum(model.t[a, b] for a, b in zip(y, y[1:]))
    assert model.viterbi(emit) == list(max(itertools.product((0, 1), repeat=5), key=score))
    assert model.marginals(emit)[2] == pytest.approx(np.log(sum(math.exp(score(y)) for y in itertools.product((0, 1), repeat=5))))


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p>Hi there.</p>"), (2, "v", "")], "page_id long, url string, html string")
    rows = html_text.extract(df, model=html_text.trained(40)).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes = sorted((r.doc_id or -1, r["size"]) for r in rows)
    assert sizes == sorted((r.doc_id or -1, len(WORD.findall(r.text or ""))) for r in docs.collect())
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)
    assert all(0 <= r.copies <= 2 for r in rows)
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, rows))
    assert mixing.mix(empty).count() == 0


def test_targets(spark):
    def brute(sizes):
        order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
        weight = [mixing.WEIGHTS[i % 3] for i in range(len(order))]
        stopped: set = set()
        while True:
            left = 1.5 * sum(n for _, n in order) - sum(2 * order[i][1] for i in stopped)
            free = sum(w for i, w in enumerate(weight) if i not in stopped)
            more = {i for i in range(len(order)) if i not in stopped and left * weight[i] / free > 2 * order[i][1]}
            if not more:
                return {s: 2.0 * n if i in stopped else left * weight[i] / free for i, (s, n) in enumerate(order)}
            stopped |= more

    g = np.random.default_rng(3)
    for sizes in ([("b", 100), ("a", 10), (None, 1000), ("c", 0)], [(f"s{i}", int(n)) for i, n in enumerate(g.integers(1, 10_000, 300))], [("one", 5)], [("z", 0)]):
        rows = mixing.keep(spark.createDataFrame([(s, n, i) for i, (s, n) in enumerate(sizes)], "source string, size long, place long"), "t")
        found = {r.source: r.target for r in mixing.targets(rows).collect()}
        want = brute(sizes) if sizes != [("z", 0)] else {"z": 0.0}
        assert found == {s: pytest.approx(t) for s, t in want.items()}


def test_pairs_keep_words_and_expectations():
    g = np.random.default_rng(2)
    mean = np.zeros(30)
    size, p = np.sort(g.integers(1, 500, 30))[::-1].astype(float), g.random(30)
    for _ in range(4000):
        out = p.copy()
        left = mixing.paired(out, size, iter(g.random(60)))
        assert ((out > 0) & (out < 1)).sum() <= 1 and (left < 0 or 0 < out[left] < 1) and out @ size == pytest.approx(p @ size)
        mean += out
    assert np.abs(mean / 4000 - p).max() < 0.05


def test_mixing_through_the_tree(spark, monkeypatch):
    """As many sources as rows, a hot source without ids, copies of one row: every source within one document of its target."""
    monkeypatch.setattr(mixing, "GROUP_ROWS", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = [(i, "w " * (1 + i % 7), f"s{i:04d}") for i in range(600)] + [(None, "word " * (1 + i % 5), "hot") for i in range(900)] + [(7, "same words here", "copies")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(df).toPandas()
    assert len(found) == len(rows)
    for _, own in found.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max() and own.source_size.iloc[0] == own["size"].sum()
    again = mixing.mix(df.repartition(5)).toPandas()
    key = list(found.columns)
    assert found.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


@pytest.mark.parametrize("blocks", [(1 << 17, 2048, 400), (128, 7, 100)])
def test_vector_search(spark, monkeypatch, blocks):
    monkeypatch.setattr(vector_search, "CANDIDATE_BLOCK", blocks[0])
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", blocks[1])
    g = np.random.default_rng(1)
    vectors = g.normal(size=(900, 17))
    vectors[100:160] = vectors[100]  # ties, among them queries
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000, None), (2020, [0.0] * 17), (2040, [math.nan] + [1.0] * 16), (2060, [1.0]), (2061, [3.0]), (None, vectors[0].tolist()), (5, vectors[5].tolist()), (5, vectors[20].tolist()), (40, (-vectors[40]).tolist())]
    df = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "vec_id long, embedding array<double>, rank int, code string, asks int")
    found: dict = {}
    for r in vector_search.nearest(df, F.col("vec_id") % 20 == 0, reranked=blocks[2]).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert found.pop(2060) == [(1, 2061, 3.0)] and len(found.pop(40)) == 40 and sorted([*found, 40]) == list(range(0, 900, 20))
    table = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 17 and np.isfinite(v).all() and any(v)]
    ids, matrix = np.array([i for i, _ in table]), np.stack([v for _, v in table])
    hits = 0
    for q, top in found.items():
        score = matrix @ vectors[q]
        score[q] = -np.inf  # its own row
        order = np.lexsort((ids, -np.round(score, 9)))[:20]
        top.sort()
        assert [t[0] for t in top] == list(range(1, 21)) and [t[1:] for t in top] == sorted((t[1:] for t in top), key=lambda t: (-t[1], t[0]))
        want = list(zip(ids[order].tolist(), np.round(score[order], 9).tolist()))
        hits += sum(min(want.count(x), n) for x, n in Counter((i, round(s, 9)) for _, i, s in top).items())
        assert all(any(abs(score[j] - s) < 1e-9 for j in np.flatnonzero(ids == i)) for _, i, s in top)
    assert hits / (20 * len(found)) >= 0.9
    assert vector_search.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("block", [1 << 16, 1500])
@pytest.mark.parametrize("kind", ["clusters", "lengths", "counts"])
def test_vector_search_finds_the_truly_nearest(spark, monkeypatch, kind, block):
    monkeypatch.setattr(vector_search, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 16)
    g = np.random.default_rng(4)
    if kind == "clusters":  # hardly differing within a cluster
        vectors = g.normal(size=(4, 24))[g.integers(0, 4, 4000)] + 1e-5 * g.normal(size=(4000, 24))
    elif kind == "lengths":
        vectors = g.normal(size=(4000, 24)) * np.exp(3 * g.normal(size=(4000, 1)))
    else:  # many equal products
        vectors = g.poisson(0.2, (4000, 24)).astype(float)
    vectors = vectors.astype(np.float32).astype(float)
    asks = [i for i in range(0, 4000, 100) if vectors[i].any()]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = vector_search.nearest(df, F.col("vec_id") % 100 == 0).toPandas().sort_values(["query_id", "rank"])
    want = []
    for q in asks:
        score = np.cumsum(vectors * vectors[q], 1)[:, -1]
        order = np.lexsort((np.arange(4000), -score))
        order = order[(order != q) & vectors[order].any(1)][:20]
        want += [(q, n + 1, i, score[i]) for n, i in enumerate(order.tolist())]
    assert list(found.itertuples(index=False, name=None)) == want


def test_language_model(docs, empty):
    train = crc_mod("doc_id", 10) != 0
    rows = [r for r in language_model.score(docs, train).collect()]
    tokens = [([*WORD.findall(lower(r.text)), None], r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 != 0, r.doc_id) for r in docs.collect()]
    counts: dict = {}
    for w, t, _ in tokens:
        for x in w if t else ():
            counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = {i: (len(w), sum(x in counts for x in w), sum(math.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for w, _, i in tokens}
    assert len(rows) == len(tokens)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[r.doc_id][:2], n) and r.base_score == pytest.approx(want[r.doc_id][2])
        assert r.score <= 1e-9
    assert language_model.score(empty, train).count() == 0


def test_audio(spark):
    g = np.random.default_rng(3)
    rows = [(i, g.normal(size=64).tolist()) for i in range(60)] + [(100, None), (None, [1.0] * 64), (120, []), (-20, g.normal(size=64).tolist())]
    rows += [(140, rows[7][1]), (160, g.normal(size=64).tolist()), (160, g.normal(size=64).tolist())]  # the sound of 7; one id with two sounds
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, prints string, key int")
    out = audio.recognise(df).collect()
    found = {r.id: r for r in out}
    assert len(out) == len(rows) and all(found[i].match_id == i and found[i].bit_error < 0.2 for i in (0, 20, 40, -20, 160))
    assert found[140].match_id == 7 and found[100].n_prints == 0 and found[100].match_id is None and found[1].match_id is None
    assert audio.recognise(df.where("false")).count() == 0


def test_audio_alignment_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(audio, "BLOCK", 4)
    g = np.random.default_rng(9)
    library = [(i, g.integers(0, 6, 40).tolist()) for i in range(30)] + [(30 + i, [5] * (30 + i)) for i in range(20)] + [(60, [])]
    library += [(70 + i, [*library[i][1][10:], *g.integers(0, 6, 9).tolist()]) for i in range(10)] + [(90 + i, library[3][1]) for i in range(8)]
    queries = [(i, library[i][1][5:30]) for i in range(12)] + [(200, [5] * 25), (201, []), (202, g.integers(100, 200, 30).tolist()), (203, library[3][1])]
    frame = lambda rows: spark.createDataFrame(rows, "id long, prints array<long>")
    found = {r.query_id: r for r in audio.align(frame(queries), frame(library)).collect()}
    keys = lambda p: [(i, (p[i], p[i + 1])) for i in range(len(p) - 1) if i == 0 or (p[i - 1], p[i]) != (p[i], p[i + 1])]
    assert len(found) == len(queries)
    for q, p in queries:
        best = []
        for m, r in library:
            votes = Counter(j - i for i, a in keys(p) for j, b in keys(r) if a == b)
            for offset, n in votes.items():
                over = range(max(0, -offset), min(len(p), len(r) - offset))
                error = sum(int(p[i] ^ r[i + offset]).bit_count() for i in over) / (32 * max(1, len(over)))
                if n >= audio.LEAST_VOTES and error <= audio.MOST_ERROR:
                    best.append((error, -n, m, offset, len(over)))
        got = found[q]
        assert ((got.bit_error, -got.votes, got.match_id, got.offset, got.overlap) if got.match_id is not None else None) == (min(best) if best else None)


def test_fingerprints_match_sums_over_frames():
    """The integral image's areas against plain sums."""
    sound = np.random.default_rng(1).normal(size=8000)
    frames, prints = audio.chroma(sound), audio.fingerprint(sound)
    kind, p, h, w = audio.FILTERS[0]
    assert kind == 0 and len(prints) == len(frames) - audio.SPAN + 1
    for i in range(len(prints)):
        x = 2 * math.log((1 + frames[i : i + w, p + h // 2 : p + h].sum()) / (1 + frames[i : i + w, p : p + h // 2].sum()))
        level = (x > audio.LOW) + (x > 0) + (x > audio.HIGH)
        assert int(prints[i]) >> 30 == level ^ level >> 1
    assert (audio.fingerprint(np.zeros(8000)) == audio.fingerprint(np.zeros(8000))[0]).all()


def test_toxicity(docs, empty):
    spark = docs.sparkSession
    g = np.random.default_rng(4)
    vocabulary = ["".join(g.choice(list("abcdefghij"), 5)) for _ in range(200)]
    rows = [(i, " ".join(g.choice(vocabulary, 40)) + (" you IDIOT scum" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame([*rows, (1000, None, 1), (1001, "", 0), (None, "x", 1)], "doc_id long, text string, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(df.drop("toxic"), df.select("doc_id", "toxic"), crc_mod("doc_id", 5) != 0).collect()}
    assert all(found[i].predicted == y for i, _, y in rows) and len(found) == 403 and all(0 <= r.score <= 1 for r in found.values())
    assert {r.score for r in toxicity.toxicity(docs, df.select("doc_id", "toxic").where("toxic = 0"), F.lit(True)).collect()} == {0.0}
    assert toxicity.toxicity(empty, df.select("doc_id", "toxic"), F.lit(True)).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    rows = packing.pack(docs).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert all(n == 2048 for s, n in by.items() if s != max(by))
    for d in docs.collect():
        if d.doc_id in (None, 303):
            continue
        own = sorted((r for r in rows if r.doc_id == d.doc_id), key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist()
        assert ids == tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1] and all(r.doc_tokens == len(ids) for r in own)
    digests = {(r.doc_id, r.start, r.ids_crc32) for r in packing.pack(docs, digest=True).collect()}
    assert digests == {(r.doc_id, r.start, zlib.crc32(r.ids)) for r in rows}
    assert packing.pack(empty).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    sums = pieces.groupby("sequence_id").length.sum()
    assert len(pieces) and (sums.iloc[:-1] == 2048).all()
