"""The llm operators against brute force, the libraries, and planted cases."""

import collections
import hashlib
import math
import os
import random
import re
import struct
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshflow.llm import bag_minhash, decontaminate, dimension_scan, kneser_ney, language_mixture, piece_viterbi, run_index, shared, token_counts, toxic_crf, url_filter

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCAB = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega Éclair straße".split()


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


def fixture(seed=0, n=60):
    """Prose with exact and near copies, shared passages, repeats, null, empty and odd texts, and one long text."""
    rng = random.Random(seed)
    passage = prose(rng, 30)
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(n)]
    texts += [texts[0], texts[1], texts[0]]
    for k in range(8):
        w = texts[3].split(" ") if k % 2 else prose(random.Random(99), 60).split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [prose(rng, 5) + passage + prose(rng, 5) for _ in range(5)]
    texts += [None, "", " ", "!!!", "é", "x", "a" * 300, "ab" * 200, "line one is here. " * 20, prose(rng, 3000)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, t, "en", "s", len(t or "")) for i, t in zip(order, texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# op1


def test_languages(spark, empty):
    rng = random.Random(1)
    sets = {"aa": "bako tiro nula".split(), "bb": "schwer denken wirklich".split()}
    rows = [(i, " ".join(rng.choices(sets[la], k=30)), la) for i, la in enumerate(["aa", "bb"] * 20)]
    train = spark.createDataFrame(rows + [(50, None, "aa"), (51, "bako", None)], "doc_id bigint, text string, lang string")
    model = language_mixture.train(train)
    assert model.names == ["aa", "bb"]
    asked = [(1, "bako tiro bako"), (2, "denken schwer denken"), (3, None), (4, "12 34 !"), (5, "bako tiro nula bako tiro nula " * 9 + "schwer denken wirklich " * 8), (5, "x"), (6, "")]
    got = language_mixture.identify(spark.createDataFrame(asked, "doc_id bigint, text string"), model).collect()
    by = {r.doc_id: r for r in got if r.doc_id != 5}
    assert len(got) == 7 and by[1].lang_pred == "aa" and by[2].lang_pred == "bb"
    assert {by[k].lang_pred for k in (3, 4, 6)} == {"und"} and by[3].score == 0
    mixed = max((r for r in got if r.doc_id == 5), key=lambda r: r.n_langs)
    assert mixed.n_langs == 2 and 0.4 < mixed.score < 0.7
    assert language_mixture.identify(empty, model).count() == 0
    none = language_mixture.train(empty)
    assert {r.lang_pred for r in language_mixture.identify(train, none).collect()} == {"und"}


# op2


def brute_mixture(p, weight, penalty):
    """(penalised log likelihood, proportions) of the best of all language sets; p: languages x n-grams."""
    best = (-np.inf, None)
    for bits in range(1, 1 << len(p)):
        on = [k for k in range(len(p)) if bits >> k & 1]
        share = np.zeros(len(p))
        share[on] = 1 / len(on)
        for _ in range(20_000):
            spread = share[:, None] * p
            new = (spread * (weight / spread.sum(0))).sum(1) / weight.sum()
            moved, share = np.abs(new - share).max(), new
            if moved < 1e-10:
                break
        best = max(best, ((weight * np.log((share[:, None] * p).sum(0))).sum() - penalty * (len(on) - 1), share), key=lambda x: x[0])
    return best


def test_mixtures_against_all_language_sets():
    rng = np.random.default_rng(2)
    langs, cells = 4, 40
    likelihood = rng.dirichlet(np.full(cells, 0.3), langs).T + 1e-4
    likelihood /= likelihood.sum(0)
    model = language_mixture.LanguageModel(list("abcd"), np.log(likelihood).astype(np.float32))
    cell, row = [], []
    for d in range(60):
        share = np.eye(langs)[d % langs] if d % 3 == 0 else rng.dirichlet(np.full(langs, 0.4))
        own = rng.choice(cells, rng.integers(1, 400), p=likelihood @ share)
        cell.append(own)
        row.append(np.full(len(own), d))
    got = language_mixture.mixtures(model, np.concatenate(cell), np.concatenate(row), 61)
    assert (got[60] == 0).all()
    alike = 0
    for d, own in enumerate(cell):
        seen, weight = np.unique(own, return_counts=True)
        p = np.exp(model.log_likelihood[seen].T.astype(float))
        best, share = brute_mixture(p, weight, 0.5 * math.log(len(own) + 1))
        mine = (weight * np.log(np.maximum((got[d][:, None] * p).sum(0), 1e-300))).sum() - 0.5 * math.log(len(own) + 1) * ((got[d] > 0).sum() - 1)
        assert mine >= best - 0.1 and abs(got[d].sum() - 1) < 1e-5
        alike += np.abs(got[d] - share).max() < 0.02
    assert alike >= 55


def test_many_languages_and_short_texts(spark, monkeypatch):
    """More languages than fit at full width: all are learned, with coarser cells, and none stops the job."""
    monkeypatch.setattr(language_mixture, "MODEL_CELLS", 300 * 1024)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(300)]
    rows = [(i, (w + " ") * 20, f"l{i:03}") for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    model = language_mixture.train(docs)
    assert len(model.names) == 300 and model.log_likelihood.size <= 300 * 1024 and len(model.log_likelihood) == 1024
    got = language_mixture.identify(docs, model).collect()
    assert sum(r.lang_pred == f"l{r.doc_id:03}" for r in got) >= 290
    pair = language_mixture.train(spark.createDataFrame([("à la mer, à toi", "fr"), ("I am a man, I", "en")], "text string, lang string"))
    short = language_mixture.identify(spark.createDataFrame([(1, "à"), (2, "I"), (3, "I"), (4, "1"), (3, "I")], "doc_id bigint, text string"), pair)
    assert sorted((r.doc_id, r.lang_pred, r.score > 0) for r in short.collect()) == [(1, "fr", True), (2, "en", True), (3, "en", True), (3, "en", True), (4, "und", False)]


def test_ties_between_languages(spark):
    model = language_mixture.train(spark.createDataFrame([("one two", "b"), ("one two", "a"), ("three", "c")], "text string, lang string"))
    got = language_mixture.identify(spark.createDataFrame([(1, "one two one two")], "doc_id bigint, text string"), model).first()
    assert (got.lang_pred, got.n_langs) == ("a", 1)


def test_urls(spark):
    urls = [None, "", "no host", "http://a.NET/x", "http://www.example.net/en/1", "https://example.net/de/", "http://b.example.com/de/x?y", "http://x.org/fr/", "http://net", "http://a.com/xxx-1", "http://a.com/foxxxy", "http://a.com/bet", "http://a.com/bet/poker", "http://a.com/bet/BET", "http://xxx.org/fr/a", "http://h.com#/://net/", "http://a.com/xxx"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(16, urls[16])], "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert [got[i].verdict for i in range(17)] == ["allow"] * 3 + ["block", "allow", "block", "block", "allow", "allow", "block", "allow", "allow", "block", "allow", "allow", "allow", "block"]
    assert (got[3].host, got[3].path, got[3].rule) == ("a.net", "/x", "net/") and got[4].rule == "example.net/en/" and got[0].host == got[2].host == ""
    assert url_filter.judge_urls(pages).count() == 18 and url_filter.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("part_bytes", [1 << 20, 5])
def test_weighted_vocabulary_from_a_table(spark, part_bytes):
    terms = spark.createDataFrame([("Alpha", 0.4), ("alpha", 0.3), ("beta", 0.4), ("gamma", 0.2), ("omega", 1.0), ("", 9.0), (None, 9.0), ("delta", None)], "term string, weight double")
    assert url_filter.read_vocabulary(terms) == {"alpha": 0.4, "beta": 0.4, "gamma": 0.2, "omega": 1.0}
    urls = ["http://a/ALPHA-beta", "http://a/alpha.beta/gamma", "http://a/omega", "http://a/omegas", "http://a/gamma/gamma/gamma/gamma/gamma", "http://a/delta", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.verdict, r.n_strict, r.n_soft) for r in url_filter.judge_urls(pages, (), terms, part_bytes=part_bytes).collect()}
    assert got == {0: ("allow", 0, 2), 1: ("block", 0, 3), 2: ("block", 1, 0), 3: ("allow", 0, 0), 4: ("allow", 0, 1), 5: ("allow", 0, 0), 6: ("allow", 0, 0)}


# op3


def brute_repeats(rows, w=run_index.WINDOW):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - w + 1):
            least[b[i : i + w]] = min(d, least.get(b[i : i + w], 1 << 62))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - w + 1):
            if least[b[i : i + w]] < d:
                gone[i : i + w] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("block_bytes,hot", [(4 << 20, 64), (3000, 2)])
def test_repeats(spark, docs, empty, monkeypatch, block_bytes, hot):
    monkeypatch.setattr(run_index, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(run_index, "HOT_BLOCKS", hot)
    rows = fixture()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run_index.mark_repeats(docs.select("doc_id", "text")).collect()}
    assert got == brute_repeats([(r[0], r[1]) for r in rows])
    assert run_index.mark_repeats(empty.select("doc_id", "text")).count() == 0
    cut = run_index.remove_repeats(docs.withColumn("row", F.lit("clash")).withColumn("kept", F.lit(1)))
    assert cut.columns == [*docs.columns, "row", "kept"] and cut.count() == len(rows)


def test_repeats_over_many_blocks(spark, monkeypatch):
    """Rows between blocks and shards don't grow with the product of both numbers."""
    monkeypatch.setattr(run_index, "BLOCK_BYTES", 400)
    monkeypatch.setattr(run_index, "BUNDLE_BLOCKS", 4, raising=False)
    rng = random.Random(7)
    passages = [prose(rng, 30) for _ in range(60)]
    rows = [(i, rng.choice(passages)[rng.randrange(30) :][: rng.randrange(60, 160)] + prose(rng, 3)) for i in range(240)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    blocks = -(-sum(len(t.encode()) for _, t in rows) // 400)
    sent, deal = [], type(table).repartition
    monkeypatch.setattr(type(table), "repartition", lambda self, n, *c: sent.append((c, self)) or deal(self, n, *c))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run_index.mark_repeats(table).collect()}
    assert got == brute_repeats(rows) and blocks > 64
    (to_shards,) = [d for c, d in sent if c not in (("block",), ("bucket",))]
    assert blocks * 3 < to_shards.count() <= blocks * (1 + -(-2 * blocks // 16))


def test_repeats_deal_anchors_evenly(spark, monkeypatch):
    """An anchor's hash is the least of many; still no bucket of anchors, whose task holds them all, gets many times its share."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 120)) for i in range(300)]
    sent, deal = [], type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, n, *c: sent.append((c, self)) or deal(self, n, *c))
    run_index.mark_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    (keys,) = [d for c, d in sent if c == ("bucket",)]
    size = [r.size for r in keys.groupBy("bucket").agg((F.sum(F.octet_length("keys")) / 4).alias("size")).collect()]
    assert sum(size) > 5000 and max(size) < 2 * sum(size) / 64


def test_repeats_in_periodic_text(spark, monkeypatch):
    monkeypatch.setattr(run_index, "BLOCK_BYTES", 400)
    monkeypatch.setattr(run_index, "HOT_BLOCKS", 2)
    rng = random.Random(5)
    units = ["a", "xy", "The ", "abcdef", "0123 45", "twenty-five bytes of text"]
    rows = [(i, "".join(rng.choices("pqrst", k=rng.randrange(70))) + (units[i % 6] * 70)[: rng.randint(51, 75)] + rng.choice("pqrst")) for i in range(180)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run_index.mark_repeats(table).collect()}
    assert got == brute_repeats(rows)


@given(st.text("pqrst", max_size=70), st.sampled_from(["a", "xy", "The ", "abcdef", "0123 45", "twenty-five bytes of text"]), st.integers(0, 24))
@settings(max_examples=60, deadline=None)
def test_anchor_depends_on_the_string_alone(before, unit, shift):
    def place(text, start):
        data = np.frombuffer(text.encode(), np.uint8)
        at, _, _, begin, end = run_index.anchors(data, np.array([0, len(data)]))
        k = np.flatnonzero((begin <= start) & (start <= end))
        return at[k].tolist(), start

    string = (unit * 80)[shift : shift + run_index.WINDOW]
    (a,), s = place(before + string, len(before))
    assert [a - s] == place(string, 0)[0]


@given(st.lists(st.text("ab", max_size=70), min_size=1, max_size=6), st.sampled_from([3, 5, 9, 40]))
@settings(max_examples=100, deadline=None)
def test_run_index(strings, window):
    """Matching statistics and smallest holders against all pairs of positions."""
    raw = [s.encode() for s in strings]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids = np.arange(len(raw))[::-1]
    length, _ = run_index.RunIndex(data, offsets, ids, window).matching_statistics()
    rests = [x[i:] for x in raw for i in range(len(x))]
    for i, x in enumerate(rests):
        assert length[i] == max((len(os.path.commonprefix([x, y])) for j, y in enumerate(rests) if i != j), default=0)
    got = run_index.smallest_holders(data, offsets, ids, window)
    for k, x in enumerate(raw):
        for i in range(len(x)):
            want = min(ids[j] for j, y in enumerate(raw) if x[i : i + window] in y) if i + window <= len(x) else run_index._LAST_ID
            assert got[offsets[k] + i] == want


def test_run_index_follows_the_runs():
    """Of 20 times as many variants of the same strings the index takes little more."""
    rng = random.Random(1)
    base = [bytes(rng.choices(range(97, 123), k=80)) for _ in range(30)]

    def variants(n):
        out = {x: None for x in base}
        while len(out) < n:
            x = rng.choice(base)
            a, b = rng.randrange(15), rng.randrange(66, 81)
            out[x[a:b]] = None
        return list(out)

    def index(strings):
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in strings])]).astype(np.int64)
        return run_index.RunIndex(np.frombuffer(b"".join(strings), np.uint8), offsets, np.arange(len(strings)))

    few, many = index(base), index(variants(3000))
    assert many.n > 80 * few.n and len(many.run) < 8 * len(few.run)
    assert many.nbytes < many.n * 3


def test_run_index_looks_runs_up_by_bits(monkeypatch):
    """A step of the stream costs no binary search over the runs, and building takes less than 100 bytes a byte."""
    marked = np.array([0, 1, 63, 64, 130, 191])
    rows = np.arange(192)
    assert (run_index.Marks(marked, 192).last(rows) == np.searchsorted(marked, rows, "right") - 1).all()
    rng = random.Random(3)
    passages = [prose(rng, 12).encode()[:70] for _ in range(1500)]
    strings = [x[rng.randrange(10) :] for x in passages for _ in range(2)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in strings])]).astype(np.int64)
    data, ids = np.frombuffer(b"".join(strings), np.uint8), np.arange(len(strings))
    run_index.RunIndex(data, offsets, ids)
    tracemalloc.start()
    index = run_index.RunIndex(data, offsets, ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * len(data)
    searched, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *x, **y: searched.append(np.size(v)) or search(a, v, *x, **y))
    length, _ = index.matching_statistics()
    assert sum(searched) < 100 and (length >= run_index.WINDOW).any()


def test_repeats_with_repeated_rows_and_null_ids(spark):
    rng = random.Random(2)
    passage = prose(rng, 20)
    rows = [(1, passage + "x"), (1, passage + "x"), (2, "y" + passage), (None, passage), (None, passage + "z"), (3, None), (3, "é" * 60), (4, "é" * 60)]
    got = run_index.mark_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    size = len(passage.encode())
    assert sorted((r.doc_id or 99, r.n_bytes, r.n_removed) for r in got) == sorted([(1, size + 1, 0), (1, size + 1, 0), (2, size + 1, size), (99, size, size), (99, size + 1, size), (3, 0, 0), (3, 120, 0), (4, 120, 120)])


# op4


def test_toxicity(spark, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        w = prose(rng, 30).split(" ")
        if toxic:
            w[7:7] = [rng.choice(["grubnarf", "zorblatt"]) + rng.choice(["", "ung", "el"])] * 2
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(500, None, "en", "s", 1), (501, "", "en", "s", 1), (502, "!!", "en", "s", 1)]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(1, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    fold = language_mixture.held_out(F.col("doc_id"), 3, 1)
    model = toxic_crf.train(docs.where(~fold), known)
    got = {r.doc_id: r for r in toxic_crf.score_documents(docs.withColumn("score", F.lit(9)), model).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(240)) and all(0 <= r.score <= 1 for r in got.values())
    assert got[500].predicted == got[501].predicted == got[502].predicted == 0
    span = got[0].spans[0]
    assert re.fullmatch("(grubnarf|zorblatt).*", rows[0][1].encode()[span.start : span.end].decode())
    kept = {r.doc_id for r in toxic_crf.reject_toxic(docs, known).collect()}
    assert kept == {r[0] for r in rows if not (r[0] < 240 and r[0] % 4 == 0)}
    assert {r.score for r in toxic_crf.score_documents(docs, toxic_crf.train(docs, known.limit(0))).collect()} == {0.0}
    assert toxic_crf.score_documents(empty, model).count() == 0


def test_chain_equals_enumeration():
    """Partition and marginals equal sums over all label sequences."""
    rng = np.random.default_rng(3)
    crf = rng.normal(size=toxic_crf.N_BINS + 3)
    bins = np.array([0, 0, 2, 1, 0, 0, 3, 0])
    chains, at = toxic_crf.events(bins, np.zeros(len(bins), int), 1)
    log_z, p = chains.run(crf)
    t = np.array([[0.0, crf[-3]], [crf[-2], crf[-1]]])
    weight, hits = 0.0, np.zeros(len(bins))
    for y in np.ndindex(*[2] * len(bins)):
        s = sum(crf[b] * v for b, v in zip(bins, y)) + sum(t[a, b] for a, b in zip((0, *y), y))
        weight += math.exp(s)
        hits += math.exp(s) * np.array(y)
    assert np.isclose(log_z[0], math.log(weight)) and np.allclose(p, (hits / weight)[at])


# op5


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)).round(3)
    x[50:120] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0]), (1004, [None] + [1.0] * 15)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("label", F.lit("clash"))
    for chunk in (2000, 30):
        monkeypatch.setattr(dimension_scan, "CHUNK_ROWS", chunk)
        got = collections.defaultdict(list)
        for r in dimension_scan.search(table, table.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert sorted(got) == list(range(0, 400, 50))
        for q in got:
            s = unit @ unit[q]
            best = sorted((i for i in range(400) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
            assert [v for v, _ in got[q]] == best and np.allclose([v for _, v in got[q]], s[best])
    few = table.where("vec_id < 3")
    assert dimension_scan.search(few, few).count() == 6 and dimension_scan.search(table.limit(0), table.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [2000, 30])
def test_neighbours_with_repeated_ids(spark, monkeypatch, chunk):
    monkeypatch.setattr(dimension_scan, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 16)).round(3)
    x[60:64] = x[0]  # other ids with the vector of a query
    ids = np.arange(200)
    rows = [(int(i), v) for i, v in zip(ids, x)]
    rows += [(0, x[0])] * 11 + [(50, x[50])] + [(1, x[1])] * 3 + [(61, x[0])] * 2  # rows that repeat
    rows += [(100, v) for v in (x[100] + rng.normal(size=(40, 16)) / 50).round(3)]  # a hot id with close vectors
    table = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(list)
    asked = {(i, tuple(v.tolist())) for i, v in rows if i in (0, 1, 50, 61, 100, 150)}
    query = spark.createDataFrame([(i, list(v)) for i, v in asked], "vec_id bigint, embedding array<double>")
    for r in dimension_scan.search(table, query).collect():
        got[r.query_id].append((r.rank, r.vec_id, round(r.score, 9)))
    expected = collections.defaultdict(list)
    for q, v in asked:
        v = np.array(v)
        s = sorted((-round(float(w @ v / np.linalg.norm(w) / np.linalg.norm(v)), 9), i) for i, w in rows if i != q)
        expected[q] += [(k + 1, i, -score) for k, (score, i) in enumerate(s[:5])]
    for q in expected:
        assert [x[:2] for x in sorted(got[q])] == [x[:2] for x in sorted(expected[q])]
        assert np.allclose([x[2] for x in sorted(got[q])], [x[2] for x in sorted(expected[q])], atol=1e-8)


def test_recall_over_many_lists(spark, monkeypatch):
    """50 lists, of which three quarters are probed; the vectors have no clusters, the hardest case."""
    monkeypatch.setattr(dimension_scan, "LIST_ROWS", 60)
    x = np.random.default_rng(8).normal(size=(3000, 64)).round(3)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(set)
    for r in dimension_scan.search(table, table.where("vec_id % 50 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = {q: set([i for i in np.argsort(-(unit @ unit[q]), kind="stable") if i != q][:5]) for q in range(0, 3000, 50)}
    assert sum(len(got[q] & best[q]) for q in best) / (5 * len(best)) >= 0.9


def test_scan_tightens_its_bounds(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    wide = np.full(5, 4.0, np.float32)
    qi, ri = dimension_scan.scan(x[:5], x, wide, np.arange(4000), 5, confidence=6)
    assert len(qi) < 5 * 800  # a fixed bound leaves all 20,000
    for q in range(5):
        assert set(np.argsort(-(x @ x[q]))[:6].tolist()) <= set(ri[qi == q].tolist())


def test_very_large_components(spark):
    rows = [(0, [3e200, 4e200]), (1, [4e250, 3e250]), (2, [1e-200, 0.0]), (3, [0.0, -1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r.vec_id, round(r.score, 12)) for r in dimension_scan.search(table, table.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 0.96), (2, 0.6), (3, -0.8)]


# op6


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = st.text(st.sampled_from(list("aehtsr 's\n\t.'é中😀́１²\xa0▁") + ["<|endoftext|>", "'ll", "   ", "the ", "\x00", "\x1c"]), max_size=30).map(str)


@given(st.lists(st.sampled_from(list("aehtsr 's\n\t.'é中😀́１²\xa0▁") + ["<|endoftext|>", "'ll", "   ", " the", "\x00", "\x1c"]), max_size=25).map("".join))
@settings(max_examples=150, deadline=None)
def test_prefix_counts(counter, library, text):
    want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert counter.prefix_counts(text).tolist() == want and counter.count(text) == want[-1]
    cut = counter.truncate(text, 3)
    assert len(library.encode(cut, add_special_tokens=False).ids) <= 3


def test_counts_of_documents(docs, empty, library):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, path).collect()}
    for d, t, *_ in fixture():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[d].n_tokens, got[d].n_bytes, got[d].over_limit) == (n, len((t or "").encode()), n > 512)
    assert token_counts.count_tokens(empty, path).count() == 0


# op7


@pytest.fixture(scope="module")
def pieces():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_viterbi.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)


@given(st.lists(st.sampled_from(list("aehtsr .\n\té中😀́▁") + ["    ", " the", "ing", "\x00"]), max_size=60).map("".join))
@settings(max_examples=200, deadline=None)
def test_pieces(pieces, text):
    mine, theirs = pieces
    ids = mine.encode(text)
    assert ids == theirs.encode(text) and mine.decode(ids) == theirs.decode(ids)


def test_streaming_commits(pieces):
    """A long word is committed bit by bit and equals the whole encoding."""
    mine, theirs = pieces
    rng = random.Random(6)
    word = "".join(rng.choice("abcdehinorst") for _ in range(3000))
    assert mine.encode(word) == theirs.encode(word)
    fed = 0

    def characters():
        nonlocal fed
        for c in word:
            fed += 1
            yield c

    next(mine.viterbi.pieces(characters()))
    assert fed < 200


def write_model(path, kind, pieces, fallback=False):
    """A model file: pieces of (text, score), after the unknown, begin and end pieces, and byte pieces if asked for."""

    def field(number, value):
        if isinstance(value, float):
            return bytes([number << 3 & 127 | 5]) + struct.pack("<f", value)
        if isinstance(value, int):
            tag = number << 3
            head = bytes([tag]) if tag < 128 else bytes([tag & 127 | 128, tag >> 7])
            return head + bytes([value])
        size = len(value)
        return bytes([number << 3 | 2]) + (bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])) + value

    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256 * fallback)] + [(t, s, 1) for t, s in pieces]
    proto = b"".join(field(1, field(1, t.encode()) + field(2, float(s)) + field(3, k)) for t, s, k in listed)
    proto += field(2, field(3, kind) + field(35, int(fallback)))
    proto += field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    path.write_bytes(proto)
    return str(path)


UNITS = [*"▁abcé", "ab", "bc", "abc", "ca", "▁a", "▁ab", "aa", "aaa", "▁▁", "b▁a", "cab▁", "éa"]


@pytest.mark.parametrize("fallback", [False, True])
def test_unigram(tmp_path, fallback):
    """Against the library, with ties, characters outside the vocabulary, and pieces over two words."""
    rng = random.Random(5)
    for seed in range(6):
        scores = [rng.choice([-1.0, -2.0, -2.5, -4.0]) if seed % 2 else -8 * rng.random() for _ in UNITS]
        path = write_model(tmp_path / f"{fallback}{seed}", 1, list(zip(UNITS, scores, strict=True)), fallback)
        mine, theirs = piece_viterbi.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
        for n in [0, 1, 2, 5, 9, 30, 30, 80, 80, 400, 4000]:
            text = "".join(rng.choice("aaabbc  éxyz😀") for _ in range(n))
            ids = mine.encode(text)
            assert ids == theirs.encode(text) and mine.decode(ids) == theirs.decode(ids)


def test_every_word_is_streamed(pieces, monkeypatch):
    mine = pieces[0]
    seen = []
    monkeypatch.setattr(mine, "known", {})
    monkeypatch.setattr(mine, "known_parts", {})
    monkeypatch.setattr(mine.viterbi, "pieces", lambda word, whole=mine.viterbi.pieces: seen.append(word) or whole(word))
    mine.encode("a word, and " + "longer" * 30)
    assert "".join(seen) == "▁a▁word,▁and▁" + "longer" * 30 and seen[-1].endswith("longer" * 30)


def test_memo_of_words_forgets(pieces, monkeypatch):
    """Of words that come once no more than half a memo is held; what is forgotten is encoded again the same way."""
    monkeypatch.setattr(piece_viterbi, "MEMO", 400)
    mine = piece_viterbi.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    theirs = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for k in range(20):
        text = " ".join(f"again{k % 3} and w{i * 7919 + k}x" for i in range(100))
        assert mine.encode(text) == theirs.encode(text)
        assert sum(len(x) for x in (mine.known, getattr(mine, "older", {}))) <= 202


@pytest.mark.parametrize("kind", [1, 2])
def test_window_is_bounded(tmp_path, kind):
    path = write_model(tmp_path / "m", kind, [(t, -i / 2) for i, t in enumerate(UNITS) if "▁" not in t[1:]])
    mine, theirs = piece_viterbi.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(8)
    text = "".join(rng.choice("abcé") for _ in range(20000))
    assert mine.encode(text) == theirs.encode(text)
    assert mine.viterbi.widest <= 12 * mine.viterbi.reach


def test_other_models_are_refused(tmp_path):
    for kind in (3, 4):
        with pytest.raises(ValueError, match="unigram and BPE"):
            piece_viterbi.PieceModel(write_model(tmp_path / "m", kind, [(t, -1) for t in UNITS]))


def test_piece_documents(docs, empty, pieces):
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = piece_viterbi.encode_documents(docs, path)
    texts = {d: t for d, t, *_ in fixture()}
    for r in encoded.collect():
        assert r.ids == pieces[1].encode(texts[r.doc_id] or "") and r.n_ids == len(r.ids) and r.round_trip
    back = {r.doc_id: r.text for r in piece_viterbi.decode_documents(encoded, path).collect()}
    assert back == {d: t or "" for d, t in texts.items()}
    assert piece_viterbi.encode_documents(empty, path).count() == 0


# op8


def bag_of(text):
    w = words_of(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def brute_classes(rows):
    bags, parent = {d: bag_of(t) for d, t in rows}, {d: d for d, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and bags[a] and bags[b] and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: top(d) for d in bags}


def test_near_duplicates(docs, empty):
    got = {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(docs.select("doc_id", "text")).collect()}
    want = brute_classes([(r[0], r[1]) for r in fixture()])
    assert got == want
    kept = bag_minhash.keep_one_of_each(docs.withColumn("class_id", F.lit("clash")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, c in want.items() if c == d)
    assert bag_minhash.near_duplicates(empty.select("doc_id", "text")).count() == 0


def test_chain_of_copies(spark):
    """Neighbours of a drifting chain are alike, its ends are not; all are one class."""
    w = prose(random.Random(8), 200).replace("\n", " ").split(" ")
    rows = []
    for k in range(12):
        for j in range(3):
            w[(k * 17 + j * 60) % len(w)] = f"new{k}x{j}"
        rows.append((k * 7 % 12, " ".join(w)))
    got = {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_classes(rows) and len(set(got.values())) == 1


def test_hot_groups_of_copies(spark, monkeypatch):
    """Every shared bucket, centre, label and bag counts as heavy, blocks hold few members, and ids and rows repeat."""
    monkeypatch.setattr(shared, "SPREAD", 1)
    monkeypatch.setattr(shared, "MOST_HEAVY", 10**9)
    monkeypatch.setattr(bag_minhash, "BLOCK_MEMBERS", 4)
    monkeypatch.setattr(bag_minhash, "BLOCK_BYTES", 8000)
    rng = random.Random(11)
    rows = []
    for g in range(3):
        w = prose(rng, 90).replace("\n", " ").split(" ")
        for k in range(14):  # copies of the first at a distance that grows
            v = list(w)
            for j in range(k * 3 // 4):
                v[(j * 13 + k) % len(v)] = f"new{g}x{k}x{j}"
            rows.append((g * 100 + k, " ".join(v)))
    rows += [(50, rows[0][1]), (51, rows[0][1]), (52, rows[5][1]), (3, rows[3][1])]
    got = bag_minhash.near_duplicates(spark.createDataFrame([*rows, (None, rows[0][1]), (None, None), (60, None)], "doc_id bigint, text string")).collect()
    want = brute_classes(rows)
    assert sorted((r.doc_id, r.class_id) for r in got if r.doc_id is not None) == sorted([(d, want[d]) for d, _ in rows] + [(60, 60)])
    assert [r.class_id for r in got if r.doc_id is None] == [None, None]


def test_two_texts_of_one_id_are_one_document(spark):
    rng = random.Random(12)
    a, b, other = (prose(rng, 60) for _ in range(3))
    rows = [(5, a), (5, b), (7, a + " end"), (8, b + " end"), (9, other)]
    got = {(r.doc_id, r.class_id) for r in bag_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(5, 5), (7, 5), (8, 5), (9, 9)}


@pytest.mark.parametrize("a,b", [([1] * 10, [1] * 8 + [0] * 2), ([5, 1, 3], [3, 1, 7]), ([100, 2], [60, 9])])
def test_signatures_are_unbiased(a, b):
    rng, trials = np.random.default_rng(9), 150
    row, h, w = [], [], []
    for t in range(trials):
        for x, *weights in zip(rng.integers(0, 2**63, len(a)).astype(np.uint64), a, b):
            for side, weight in enumerate(weights):
                if weight:
                    row.append(2 * t + side), h.append(x), w.append(weight)
    order = np.argsort(row, kind="stable")
    s = bag_minhash.signatures(np.array(row)[order], np.array(h, np.uint64)[order], np.array(w)[order], 2 * trials)
    want = sum(map(min, zip(a, b))) / sum(map(max, zip(a, b)))
    assert abs((s[::2] == s[1::2]).mean() - want) < 0.02


# op9


def brute_model(texts, n=kneser_ney.ORDER):
    counts = {k: collections.Counter() for k in range(1, n + 1)}
    symbols = lambda t: [255] * (n - 1) + list(t.translate(UPPER).encode()) + [254]
    for t in texts:
        s = symbols(t)
        for i in range(n - 1, len(s)):
            counts[n][tuple(s[i - n + 1 : i + 1])] += 1
    for k in range(n - 1, 0, -1):
        for x in counts[k + 1]:
            counts[k][x[1:]] += 1
    cut = {k: kneser_ney.discounts([sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]) for k, c in counts.items()}

    def p(k, x):
        if not k:
            return 1 / kneser_ney.SYMBOLS
        after = [v for y, v in counts[k].items() if y[:-1] == x[:-1]]
        if not after:
            return p(k - 1, x[1:])
        d = lambda c: cut[k][min(c, 3) - 1]
        c = counts[k].get(x, 0)
        return ((c - d(c)) if c else 0) / sum(after) + sum(map(d, after)) / sum(after) * p(k - 1, x[1:])

    def perplexity(t):
        s = symbols(t)
        return math.exp(-sum(math.log(p(n, tuple(s[i - n + 1 : i + 1]))) for i in range(n - 1, len(s))) / (len(s) - n + 1))

    return perplexity


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 6, "shard_bytes": 4, "part_blocks": 2}])
def test_perplexity(spark, empty, sizes):
    rows = [(i, t, la) for i, (t, la) in enumerate([("Abab abba", "x"), ("abba cab", "x"), ("bab", "y"), ("", "x"), (None, "x"), ("zzz é", "x"), ("ab", "q"), ("cab cab", None), ("cab", None)])]
    rows += [(None, "abba cab", "x"), (0, "Abab abba", "x"), (2, "bab", "y"), (12, "cab", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("own", F.lit("clash"))
    trusted = spark.createDataFrame([(i,) for i in (0, 1, 2, 7, None)], "doc_id bigint")
    got = kneser_ney.perplexities(docs, trusted, **sizes).collect()
    models = {"x": brute_model(["Abab abba", "abba cab", "Abab abba"]), "y": brute_model(["bab", "bab"]), None: brute_model(["cab cab"])}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    of = {(d, la): t for d, t, la in rows}
    for r in got:
        t = of[r.doc_id, r.lang]
        if t and r.lang in models:
            assert math.isclose(math.exp(-r.log_p / r.n), models[r.lang](t), rel_tol=3e-4)
        else:
            assert r.log_p is None and r.n == 0
    labels = spark.createDataFrame([(i, 1, 0) for i in (0, 1, 2, 7)], "doc_id bigint, quality int, toxic int")
    assert kneser_ney.classify(docs.limit(0), labels).count() == 0
    assert not any(r.keep for r in kneser_ney.classify(docs, labels.limit(0)).collect())


def test_thresholds(spark):
    """Thresholds and decisions against the quantile of the documents that the model hasn't seen."""
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(3, 30)), la) for i, la in enumerate(["x", "y"] * 60)] + [(200, None, "x"), (201, "xi", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels, 0.7).collect()}
    unseen = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(kneser_ney.HOLD_OUT)) == 0).collect()}
    good = {i for i in range(90) if i % 3}
    assert len(got) == len(rows) and not got[200].keep and not got[201].keep and got[201].perplexity is None
    for la in "xy":
        mine = [r for r in rows if r[2] == la and r[1]]
        p = brute_model([t for i, t, _ in mine if i in good - unseen])
        held = sorted(math.log(p(t)) for i, t, _ in mine if i in good & unseen)
        limit = held[math.ceil(0.7 * len(held)) - 1]
        for i, t, _ in mine:
            assert math.isclose(got[i].perplexity, p(t), rel_tol=3e-4)
            assert abs(math.log(got[i].threshold) - limit) <= kneser_ney.STEP + 3e-4
            assert got[i].keep == (math.log(got[i].perplexity) <= math.log(got[i].threshold) + 1e-12)


@given(st.dictionaries(st.integers(0, 2**48 - 1), st.integers(1, 2**40)))
@settings(max_examples=40, deadline=None)
def test_packed_counts(counts):
    key = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in sorted(counts)], np.int64)
    again = kneser_ney._wide(kneser_ney._narrow(key, n))
    assert (again[0] == key).all() and (again[1] == n).all()


def test_quality(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, 60) if i % 5 else "".join(rng.choice("qxzjkw#%&0123") for _ in range(200)), "en") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(120)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.keep for r in kneser_ney.classify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), labels).collect()}
    assert not any(got[i] for i in range(0, 200, 5)) and sum(got[i] for i in range(200) if i % 5) >= 150


# op10


def brute_hits(rows, items, window=decontaminate.WINDOW):
    windows = collections.defaultdict(set)
    for k, t in items:
        w = words_of(t)
        for i in range(max(len(w) - window + 1, min(len(w), 1))):
            windows[tuple(w[i : i + window])].add(str(k))
    sizes = {len(x) for x in windows}
    out = {}
    for d, t in rows:
        w, hit, found = words_of(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out[d] = (len(w), len(hit), len(found), decontaminate.sha256_of(sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination(spark, docs, empty, block_bytes):
    rows = [(r[0], r[1]) for r in fixture()]
    long = [t for _, t in rows if t and len(words_of(t)) > 25]
    items = [(k, " ".join(words_of(t)[4:20]).upper()) for k, t in enumerate(long[:9])] + [(20, "changed"), (21, None), (22, ""), (23, "é x"), (20, "omega psi"), (24, prose(random.Random(7), 40)), (30, "not in any of them")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    got = decontaminate.find_contamination(docs, bench, block_bytes=block_bytes)
    mine = {r.doc_id: (r.n_words, r.n_hit, r.n_items, decontaminate.sha256_of(r["items"])) for r in got.collect()}
    want = brute_hits(rows, items)
    assert mine == want
    clean = decontaminate.decontaminate(docs.withColumn("items", F.lit(3)), bench)
    assert clean.columns == [*docs.columns, "items"] and sorted(r.doc_id for r in clean.collect()) == sorted(d for d, x in want.items() if not x[1])
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_contamination(empty, bench).count() == 0


def brute_longest(words, items):
    """(words, first word, item) of the longest match of a document's words with any item, from windows on."""
    best = None
    for k, t in items:
        w = words_of(t)
        for i in range(len(words)):
            for j in range(len(w)):
                n = 0
                while i + n < len(words) and j + n < len(w) and words[i + n] == w[j + n]:
                    n += 1
                if n and n >= min(len(w), decontaminate.WINDOW):
                    best = min(best or (1,), (-n, i, str(k)))
    return (-best[0], *best[1:]) if best else (0, None, None)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_longest_match(spark, block_bytes):
    rng = random.Random(4)
    items = [(k, " ".join(rng.choices("abc", k=n))) for k, n in enumerate([12, 14, 30, 3, 18])]
    rows = [(i, " ".join([*rng.choices("abc", k=rng.randrange(9)), *items[i % 5][1].split()[i % 3 : 25 - i % 4], *rng.choices("abcx", k=20)])) for i in range(25)] + [(90, "x y"), (91, None)]
    got = decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes)
    assert {r.doc_id: (r.longest_words, r.longest_at, r.longest_item) for r in got.collect()} == {d: brute_longest(words_of(t), items) for d, t in rows}


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_whose_rolling_hashes_agree(spark, size):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, other), (2, word)], "doc_id bigint, text string")
    got = decontaminate.find_contamination(docs, spark.createDataFrame([(7, word)], "item_id bigint, text string"))
    assert {r.doc_id: r.n_hit for r in got.collect()} == {1: 0, 2: 1}
    assert {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2}


def test_false_occurrences_are_left_out(monkeypatch):
    """With hashes of three values nearly all words collide; the comparison of bytes still tells them apart."""
    monkeypatch.setattr(decontaminate, "word_hashes", lambda low, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    b = decontaminate.benchmark_suffixes([("k", "ab c def")], 10)
    text = b"ab c def ab x def xy c def ab c def"
    found = decontaminate.find(b, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert sorted(found.first.tolist()) == [0, 9]


def test_long_texts_in_pieces(monkeypatch):
    text = np.frombuffer((prose(random.Random(3), 3000) + "z" * 900).encode(), np.uint8)
    whole = bag_minhash.bags(text, np.array([0, len(text)]))
    from meshflow.llm import slabs

    monkeypatch.setattr(slabs, "SLAB_BYTES", 500)
    for x, y in zip(whole, bag_minhash.bags(text, np.array([0, len(text)])), strict=True):
        assert (x == y).all()
