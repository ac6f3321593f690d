"""The language model, phrases and the manifest against their definitions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import log_bilinear, merkle, phrases
from spindrift.llm.suffix_automaton import suffix_automaton

ODD = [None, "", " ", "\n\n", "A a A", "x" * 3000, "äö äö b", "a,b;c", "a b. a b! A B", "tab\tbed line"]


def _frame(spark, rows, columns="doc_id long, text string, lang string, source string, n_chars long, score string, word string"):
    return spark.createDataFrame([(*r, *["clash"] * 2) for r in rows], columns)


# --- suffix automata


def _textbook(sequences, depth):
    """End places of every substring of up to `depth` symbols."""
    ends = {}
    for k, s in enumerate(sequences):
        for i in range(len(s)):
            for size in range(1, min(depth, i + 1) + 1):
                ends.setdefault(tuple(s[i - size + 1 : i + 1]), set()).add((k, i))
    return ends


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), min_size=1, max_size=4), st.integers(1, 3))
def test_states_are_the_classes_of_equal_end_places(sequences, depth):
    flat = np.array([x for s in sequences for x in [*s, -1]], np.int64)
    found, ends = suffix_automaton(flat, depth), _textbook(sequences, depth)
    assert len(found.length) - 1 == len({frozenset(e) for e in ends.values()})
    for size in range(1, depth + 1):
        at, n = found.substrings(size)
        got = {tuple(flat[i - size + 1 : i + 1].tolist()): int(k) for i, k in zip(at, n, strict=True)}
        assert len(got) == len(at) and got == {g: len(e) for g, e in ends.items() if len(g) == size}
    for k in range(1, len(found.length)):  # a link leads to the longest suffix that also ends elsewhere
        own = tuple(flat[found.end[k] - found.length[k] + 1 : found.end[k] + 1].tolist())
        shorter = next((own[i:] for i in range(1, len(own)) if ends[own[i:]] != ends[own]), ())
        assert found.length[found.link[k]] == len(shorter)


def test_places_of_context_are_not_counted():
    flat = np.array([0, 1, 0, 1, 2])
    at, n = suffix_automaton(flat, 2, 2).substrings(2)
    assert {tuple(flat[i - 1 : i + 1].tolist()): int(k) for i, k in zip(at, n, strict=True)} == {(1, 0): 1, (0, 1): 1, (1, 2): 1}


# --- phrases


def _phrases(rows, least, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang, low = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    c = {p: n for p, n in f.items() if len(p) > 2 and n >= least}
    out = []
    for p, a in c.items():
        if any(len(q) > len(p) and q[0] == p[0] and 100 * c[q] >= 50 * a and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, 4)) for q in c):
            continue
        s, _, l, r = min((1000000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1))
        out.append((p[0], " ".join(p[1:]), a, l, r, total[p[0]], s))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranks = Counter()
    found = []
    for x in out:
        ranks[x[0]] += 1
        if ranks[x[0]] <= top:
            found.append((x[0], ranks[x[0]], *x[1:]))
    return found


@pytest.mark.parametrize("shard", [1 << 21, 40])
def test_phrases_equal_their_definition(spark, monkeypatch, shard):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    random = np.random.default_rng(5)
    stock = ["new york city", "in the", "of the year", "alpha", "beta", "Gamma,", "été d'or", "x"]
    texts = [" ".join(random.choice(stock, 40)) for _ in range(40)] + ODD + ["new york city"] * 12
    rows = [(i, t, [None, "en", "de"][i % 3], "s", None) for i, t in enumerate(texts)]
    got = [tuple(r) for r in phrases.mine_phrases(_frame(spark, rows), least=4).orderBy("lang", "rank").collect()]
    assert got == sorted(_phrases([(r[1], r[2]) for r in rows], 4), key=lambda x: (x[0], x[1])) and len(got) > 30
    few = phrases.mine_phrases(_frame(spark, rows), least=4, top=3).collect()
    assert sorted(map(tuple, few)) == sorted(_phrases([(r[1], r[2]) for r in rows], 4, 3))


def test_phrases_of_nothing(spark):
    assert phrases.mine_phrases(_frame(spark, [])).collect() == []
    assert phrases.mine_phrases(_frame(spark, [(1, None, None, None, None), (None, "a", "en", None, None)])).collect() == []


def test_phrase_arithmetic_passes_64_bits(spark):
    exact = spark.sql("SELECT cast((cast(a AS DECIMAL(38, 0)) * a * 1000000) div (cast(l AS DECIMAL(38, 0)) * r) AS LONG) AS s FROM VALUES (9999999999999L, 10000000000000L, 10000000000001L) t(a, l, r)").first()["s"]
    assert exact == 1000000 * 9999999999999**2 // (10000000000000 * 10000000000001)


# --- manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _code(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def _manifest(rows):
    def leaf(r, text):
        return _h(*[_code(x) for x in (r[0], r[3], r[2], r[4], text)])

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))

    def levels(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([_h(*found[-1][i : i + 3]) for i in range(0, len(found[-1]), 3)])
        return found

    def climb(tree, at, acc):
        siblings = []
        for level in tree[:-1]:
            run = level[at // 3 * 3 : at // 3 * 3 + 3]
            left, right = run[: at % 3], run[at % 3 + 1 :]
            siblings += left + right
            acc, at = _h(*left, acc, *right), at // 3
        return siblings, acc

    trees = []
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append(levels([leaf(r, r[1]) for r in by[s]]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            low, acc = climb(trees[k], i, leaf(r, r[1].replace("\n", "") if bad else r[1]))
            high, acc = climb(top, k, acc)
            out.append((r[0], leaf(r, r[1]), trees[k][-1][0], top[-1][0], _h(*low, *high), acc, acc == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "sources"), [(1, 1), (4, 1), (60, 2), (60, 60), (900, 3)])
def test_manifest_equals_its_definition(spark, monkeypatch, n, sources):
    monkeypatch.setattr(merkle, "LEVELS", 2)  # blocks of nine leaves, so that small tables have several rounds
    names = [None, "", "B", "a", "ä", *[f"s{k}" for k in range(sources)]]
    rows = [(i * 7 % n if i % 9 else None, ODD[i % len(ODD)], [None, "en"][i % 2], names[i % sources], [None, i][i % 2]) for i in range(n)]
    rows += rows[: n // 10]
    rows += [(2 * n + i, "hot\nline", "en", names[0], 8) for i in range(n // 3)]
    df = _frame(spark, rows)
    even = "crc32(cast(doc_id AS string)) % 2 = 0"
    from pyspark.sql import functions as F

    bad = F.when(F.expr(even), merkle.document_leaves(lambda t: F.translate(t, "\n", ""))).otherwise(merkle.document_leaves())
    got = merkle.manifest(df, "doc_id", "source", merkle.document_leaves(), bad)
    assert sorted(map(tuple, got.collect()), key=repr) == _manifest(rows)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())


def test_manifest_of_nothing(spark):
    df = _frame(spark, [])
    assert merkle.manifest(df, "doc_id", "source", merkle.document_leaves(), merkle.document_leaves()).collect() == []


# --- language model


def _small_model(spark, texts, **more):
    docs = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("cast(coalesce(text, '') AS binary) AS text")
    return log_bilinear.fit_language(docs, **more)


@pytest.mark.parametrize("vocabulary", [4, 12, 1000])
def test_probabilities_of_all_words_sum_to_one(spark, vocabulary):
    random = np.random.default_rng(1)
    words = [f"w{k}" for k in range(20)]
    texts = [" ".join(random.choice(words, 30, p=np.arange(1, 21) / 210)) for _ in range(30)]
    model, counts = _small_model(spark, texts, vocabulary=vocabulary, width=8, sent=15)
    known = [r["word"].decode() for r in counts.collect() if bytes(r["word"]) != log_bilinear.END]
    context = "w19 w18 "
    df = spark.createDataFrame([(i, context + w) for i, w in enumerate([*known, "never"])] + [(-1, context)], "doc_id long, text string")
    # the probability of a text that goes on after a word, less that of the text's end after the word, is the word's
    scores = {r["doc_id"]: r["score"] for r in log_bilinear.score_texts(df, model, counts).collect()}
    tables, numbers, size = log_bilinear.Tables.of(model.parameters), model.numbers(), model.size
    end = min(numbers[log_bilinear.END], size)
    at = lambda w: min(numbers.get(w.encode(), size), size)
    start = tables.log10(np.array([at("w19"), at("w18")]), end).sum()
    place = numbers[log_bilinear.END]  # the end may be in the class of all others, and then has a share of it
    share = math.log10((model.counts[place] + 0.5) / model.other_total()) if place >= size else 0.0
    after = lambda w: tables.log10(np.array([at("w19"), at("w18"), at(w), end]), end)[3] + share
    each = [10 ** (scores[i] - start - after(w)) for i, w in enumerate([*known, "never"])]
    ends = 10 ** (scores[-1] - start)
    assert math.isclose(sum(each) + ends, 1, rel_tol=1e-4)


def test_bases_are_those_of_the_counts_for_any_text(spark):
    random = np.random.default_rng(2)
    texts = [" ".join(random.choice(["a", "b", "C", "y" * 40, "y" * 41, "ä"], 9)) for _ in range(20)] + ODD
    model, counts = _small_model(spark, texts, vocabulary=3, width=4, sent=4)
    rows = [(i if i % 4 else None, t, "en", "s", 1) for i, t in enumerate([*texts, "unseen words", "z" * 100, texts[0]])]
    got = log_bilinear.score_texts(_frame(spark, rows), model, counts).collect()
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = Counter(w for t in texts for w in split(t))
    n, v = sum(c.values()), len(c)
    want = [(r[0], len(split(r[1])), sum(c[w] > 0 for w in split(r[1])), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(r[1])), 6)) for r in rows]
    assert sorted([(*tuple(r)[:4], round(r["base_score"], 6)) for r in got], key=repr) == sorted(want, key=repr)
    assert all(r["score"] < 0 for r in got)


def test_nothing_to_learn_from_and_nothing_to_score(spark):
    model, counts = _small_model(spark, [])
    rows = log_bilinear.score_texts(_frame(spark, [(1, "a b", "en", "s", 1)]), model, counts).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows] == [(3, 0, 0, 0.0, 0.0)]
    model, counts = _small_model(spark, ["a b a b"])
    assert log_bilinear.score_texts(_frame(spark, []), model, counts).collect() == []


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    rows = log_bilinear.op11_language_model(spark, "/root/testdata/sf0.01").where("held_out").collect()
    tokens = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] - r["base_score"] for r in rows) / tokens > 0.03


def test_gradient_steps_follow_the_context():
    words = np.tile(np.array([0, 1, 2, 3]), 4000)
    counts = np.bincount(words).astype(float)
    model, tokens = log_bilinear.train(log_bilinear.Parameters.start(counts, 8), [words], counts, 3)
    after = log_bilinear.Tables.of(model).log10(np.array([0, 1, 2, 3, 0, 1]), 3)
    assert tokens == len(words) and after[2:].min() > math.log10(0.7)


def _plain_train(start, words, counts, end):
    """The definition of `train`, token by token: products, noise and sums of a step take a row for each token."""
    random, share = np.random.default_rng(0), log_bilinear._noise(counts)
    seen, nxt, bias, turn = (x.astype(float) for x in (start.seen, start.next, start.bias, start.turn))
    energy, noise_share = [e.astype(float) for e in start.energy], np.log(share * log_bilinear.NOISE)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def move(x, e, gradient, at=None):
        at = slice(None) if at is None else np.unique(at)
        e[at] += (gradient[at] ** 2).mean(-1)
        x[at] -= (log_bilinear.RATE / np.sqrt(e[at]))[..., None] * gradient[at]

    steps = [(block[:, k]) for block in log_bilinear._contexts([words], end) for k in range(block.shape[1])]
    for two, one, word in steps:
        noise = np.minimum(np.searchsorted(np.cumsum(share), random.random(log_bilinear.NOISE)), len(share) - 1)
        h = seen[two] @ turn[0] + seen[one] @ turn[1]
        g_true = sigmoid((h * nxt[word]).sum(1) + (bias - noise_share)[word]) - 1
        g_false = sigmoid(h @ nxt[noise].T + (bias - noise_share)[noise])
        g_h = g_true[:, None] * nxt[word] + g_false @ nxt[noise]
        g_next, g_bias, g_seen = np.zeros_like(nxt), np.zeros((len(bias), 1)), np.zeros_like(seen)
        np.add.at(g_next, word, g_true[:, None] * h)
        np.add.at(g_next, noise, g_false.T @ h)
        np.add.at(g_bias, word, g_true[:, None])
        np.add.at(g_bias, noise, g_false.sum(0)[:, None])
        np.add.at(g_seen, two, g_h @ turn[0].T)
        np.add.at(g_seen, one, g_h @ turn[1].T)
        g_turn = np.stack([seen[two].T @ g_h, seen[one].T @ g_h])
        move(nxt, energy[1], g_next, np.append(word, noise))
        move(bias[:, None], energy[2], g_bias, np.append(word, noise))
        move(turn, energy[3], g_turn)
        move(seen, energy[0], g_seen, np.append(two, one))
    return seen, nxt, bias, turn, *energy


@pytest.mark.parametrize("width", [8, 7])
def test_steps_by_distinct_words_equal_steps_by_tokens(width):
    words = np.append(np.random.default_rng(3).zipf(1.5, 3 * log_bilinear.STEP + 77) % 60, 0)
    counts = np.bincount(words, minlength=61).astype(float)
    start = log_bilinear.Parameters.start(counts, width)
    found, tokens = log_bilinear.train(start, [words], counts, 0)
    assert tokens == len(words)
    for got, want in zip([found.seen, found.next, found.bias, found.turn, *found.energy], _plain_train(start, words, counts, 0), strict=True):
        np.testing.assert_allclose(got, want, rtol=2e-3, atol=2e-4)


def test_distinct_words_are_looked_up_once_and_those_of_texts_are_all_there(monkeypatch):
    texts = [b"  A b\x0bC\x1c\xc3\x84 \xc2\xa0x ", b"", b" ", b"b a b a B", b"\xff\xfe Z\n\n", b"y" * 32 + b" " + b"Y" * 33 + b" " + b"y" * 33, b"a\x00b c"] * 9
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t))
    asked = []
    monkeypatch.setattr(log_bilinear, "word_key", lambda w, key=log_bilinear.word_key: asked.append(w) or key(w))
    for kind in (pa.binary(), pa.large_binary()):
        found = log_bilinear.Words.of(pa.array(texts, kind).slice(2))
        keys = found.keys.to_pylist()
        assert [[keys[k] for k in found.at[i:j]] for i, j in zip(found.starts[:-1], found.starts[1:])] == [[w if len(w) < 33 else b" " + xxhash.xxh3_128_digest(w) for w in split(t)] for t in texts[2:]]
        assert len(keys) == len(set(keys)) == len({w for t in texts[2:] for w in split(t)})
    assert asked == [b"y" * 33] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    monkeypatch.setattr(log_bilinear, "PIECE", 40)
    pieces = list(log_bilinear._pieces([batch, batch.slice(0, 0), batch.slice(3)]))
    assert len(pieces) > 9 and [t for p in pieces for t in p["text"].to_pylist()] == texts + texts[3:]
    known = pa.array([b"b", b"a"], pa.binary())
    assert [x.tolist() for x in log_bilinear._numbered([batch], known, 5)] == [[{b"b": 0, b"a": 1}.get(w, 2) for w in split(t)] + [5] for t in texts]


def test_texts_in_a_row_score_as_each_does_alone():
    counts = np.arange(1.0, 7)
    tables = log_bilinear.Tables.of(log_bilinear.Parameters.start(counts, 4, seed=5))
    texts = [np.append(np.random.default_rng(k).integers(0, 5, k % 4), 5) for k in range(30)]
    together = tables.log10(np.concatenate(texts), 5, np.cumsum([0, *map(len, texts[:-1])]))
    np.testing.assert_array_equal(together, np.concatenate([tables.log10(t, 5) for t in texts]))
