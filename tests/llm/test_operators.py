"""The corpus operators on small tables: nulls, empty and long texts, ties, repeated rows, other columns; brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from spindrift.llm import common, exact_dedup, jaccard_join, language_id, lookup, mixing, packing, quality_knn, quality_rules, queries, sharding, suffix_dedup, toxicity, word_models

WHITE = " \t\n\x0b\x0c\r"


def docs(spark, rows):
    """doc_id, text, source; with columns whose names the operators use inside."""
    full = [(k, t, s, "en", (k or 0) * 10, 1.5, "x") for k, t, s in rows]
    table = spark.createDataFrame(full, "doc_id long, text string, source string, lang string, id long, score double, rank string")
    return table.withColumns({c: F.lit("own") for c in CLASHING})


CLASHING = "key row lang_pred kept shard slot size taken target digest nth draw n _id _keep _row _rank uid h own found".split()
ODD = [(0, None, None), (1, "", "a"), (2, " \n\t ", "a"), (3, "é ß 漢字 😀", "b"), (4, "x" * 300_000, "b"), (5, "a b c d e f", "a"), (6, "a b c d e f", "a"), (7, "A  b c\nd e f ", "c")]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, same_rows, name):
    same_rows(queries.queries()[name](spark, DATA), queries.oracle_sql()[name])


def test_exact_groups(spark):
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs(spark, ODD)).collect()}
    norm = lambda t: "".join(c for c in t or "" if c not in WHITE)
    assert [got[k]["keep_id"] for k in range(8)] == [2, 2, 2, 3, 4, 5, 5, 7]
    assert all(got[k]["text_sha256"] == hashlib.sha256(norm(t).encode()).hexdigest() for k, t, _ in ODD)
    assert sum(r["kept"] for r in got.values()) == len({norm(t) for _, t, _ in ODD})
    assert exact_dedup.exact_groups(docs(spark, ODD).limit(0)).count() == 0
    # repeated rows: one is kept; a group of a third of all rows is spread and merged
    many = docs(spark, [(k, "hot text" if k % 3 == 0 else f"text {k}", "a") for k in range(900)] + [(0, "hot text", "a")])
    rows = exact_dedup.exact_groups(many).where("keep_id = 0").collect()
    assert len(rows) == 301 and {r["group_size"] for r in rows} == {301} and sum(r["kept"] for r in rows) == 1


def test_sharding(spark):
    rows = sharding.shard_records(docs(spark, [(k, "t", "a") for k in range(3000)]), "doc_id", [1.0, 1.0, 2.0], grow_by=1.0).collect()
    sizes = [sum(r["shard"] == j for r in rows) for j in range(3)]
    assert abs(sizes[2] - 1500) < 150
    assert all(r["grown_shard"] in (r["shard"], 3) for r in rows) and 450 < sum(r["grown_shard"] == 3 for r in rows) < 750
    for j in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == j) == list(range(sizes[j]))
    odd = docs(spark, [*ODD, ODD[0]]).withColumn("doc_id", F.when(F.col("doc_id") > 1, F.col("doc_id")))
    assert sharding.shard_records(odd, "doc_id", [1.0] * 5, ties=("text",)).count() == 9
    assert sharding.shard_records(docs(spark, ODD).limit(0), "doc_id", [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), [0.0])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_with_clashing_columns(spark, name, tmp_path):
    common.table(spark, DATA, "documents").limit(60).withColumns({c: F.lit("own") for c in [*CLASHING, "rank", "score", "id"]}).write.parquet(str(tmp_path / "documents.parquet"))
    common.table(spark, DATA, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.queries()[name](spark, str(tmp_path))
    assert "own" not in got.columns
    if "doc_id" in got.columns:
        assert got.select("doc_id").distinct().count() == 60
    else:  # rows aren't documents: the same rows as without those columns
        plain = common.table(spark, str(tmp_path), "documents").select("doc_id", "text", "source", "lang", "n_chars")
        plain.write.parquet(str(tmp_path / "plain" / "documents.parquet"))
        want = sorted(map(tuple, queries.queries()[name](spark, str(tmp_path / "plain")).collect()))
        assert want and sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("name", ["op2_quality_knn", "op3_language_id", "op6_quality_rules"])
def test_queries_with_null_ids(spark, name, tmp_path):
    some = common.table(spark, DATA, "documents").limit(40)
    some.unionByName(some.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(str(tmp_path / "documents.parquet"))
    common.table(spark, DATA, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.queries()[name](spark, str(tmp_path)).collect()
    assert len(got) == 43
    unknown = [r for r in got if r["doc_id"] is None]
    assert len(unknown) == 3 and all(r["held_out"] is None for r in unknown if "held_out" in r.__fields__)


def test_sharding_query(spark):
    rows = {r["doc_id"]: r for r in sharding.op7_sharding(spark, DATA).collect()}
    for r in common.table(spark, DATA, "documents").collect():
        body = (r["text"] or "").encode()
        assert (rows[r["doc_id"]]["size"], rows[r["doc_id"]]["text_crc32"]) == (len(body) + 8, zlib.crc32(body))


def test_targets_of_many_sources(spark):
    size = {f"site{k:03}": k * k % 97 * 10 ** (k % 4) for k in range(300)} | {None: 5}
    rows = spark.createDataFrame([(s, n) for s, n in size.items()], "source string, size long").repartition(5)
    found = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    open_, left, target = set(size), sum(size.values()), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * size[s] < level * weight[s]}
        if not full:
            break
        target |= {s: 3 * size[s] for s in full}
        open_, left = open_ - full, left - sum(3 * size[s] for s in full)
    target |= {s: level * weight[s] for s in open_}
    assert found.keys() == target.keys() and all(math.isclose(found[s], target[s]) for s in target)


def test_mixing(spark, monkeypatch):
    rng = random.Random(5)
    table = [(k, " ".join(["w"] * rng.randint(0, 50)), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(600)]
    rows = mixing.mix(docs(spark, table)).collect()
    size = {s: sum(r["size"] for r in rows if r["source"] == s) for s in ("a", "b", "c", None)}
    weight = {"a": 1, "b": 2, "c": 3, None: 1}
    open_, left, target = set(size), sum(size.values()), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * size[s]}
        target |= {s: 3 * size[s] for s in full} | {s: level * weight[s] for s in open_ - full}
        if not full:
            break
        open_ -= full
        left -= sum(3 * size[s] for s in full)
    for s in size:
        own = [r for r in rows if r["source"] == s]
        assert math.isclose(own[0]["target"], target[s]) and abs(sum(r["taken"] for r in own) - target[s]) <= 1
        assert all(r["epochs"] * r["size"] <= r["taken"] <= 3 * r["size"] for r in own)
    monkeypatch.setattr(mixing, "SENT", 0)  # targets joined instead of sent
    again = mixing.mix(docs(spark, table).repartition(7)).collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}
    assert mixing.mix(docs(spark, ODD)).count() == 8
    assert mixing.mix(docs(spark, ODD[:3])).agg(F.sum("taken")).first()[0] == 0
    assert mixing.mix(docs(spark, ODD).limit(0)).count() == 0


def brute_rules(text):
    words = [w for w in "".join(" " if c in WHITE else c for c in text or "").split(" ") if w]
    seen, cover = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover |= {i + k for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(WHITE)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark):
    rng = random.Random(2)
    made = [(100 + k, "\n".join(" ".join(rng.choice(["the", "of", "a", "##", "end."]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9))), "a") for k in range(60)]
    prose = " ".join(f"word{k} and" for k in range(60)) + "."
    made += [(900, prose, "a"), (901, prose.replace("and", "!!"), "a"), (902, prose + "\nHome | About | News | Login\nAll rights reserved.", "a")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(spark, ODD + made)).collect()}
    for k, t, _ in ODD + made:
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(t), k
    assert got[900]["kept"] and not got[901]["kept"] and got[902]["kept"] and got[902]["text_left"] == prose
    # windows that share a hash are compared in full
    a = docs(spark, made).select(common.words(F.col("text")).alias("_w"))
    by_words = a.select(F.sort_array(quality_rules._places_by_words()).alias("p")).collect()
    for (_, t, _), r in zip(made, by_words, strict=True):
        w = (t or "").split()
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert r["p"] == [i for i, x in enumerate(three) if three.count(x) > 1]


def test_language(spark):
    rng = random.Random(1)
    say = {"aa": "kala mita sora", "bb": "wund erlich schon", "cc": "été où là"}
    rows = [(k, " ".join(rng.choice(say[x].split()) for _ in range(30)), x) for k, x in enumerate(rng.choices(list(say), k=200))]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(language_id.learnable(train), "text", "lang", "doc_id")
    got = {r["doc_id"]: r for r in language_id.detect_language(train.select("doc_id", "text"), model).collect()}
    assert all(got[k]["lang_pred"] == x and 0 <= got[k]["score"] <= 1 for k, _, x in rows)
    odd = {r["doc_id"]: r for r in language_id.detect_language(docs(spark, [*ODD, (9, "12 !! 3", "a")]), model).collect()}
    assert [odd[k]["lang_pred"] == "und" for k in (0, 1, 2, 3, 4, 5, 9)] == [True, True, True, False, False, False, True]
    none = language_id.fit_language_model(train.limit(0), "text", "lang", "doc_id")
    assert {r["lang_pred"] for r in language_id.detect_language(train.select("text"), none).collect()} == {"und"}
    # pieces of a text count as the whole
    from spindrift.llm import letters

    whole = language_id._gram_counts(rows[0][1])
    piece, letters.PIECE = letters.PIECE, 7
    try:
        assert (language_id._gram_counts(rows[0][1]) == whole).all()
    finally:
        letters.PIECE = piece


def test_held_out_accuracy(spark):
    sf = DATA.replace("0.001", "0.01")
    truth = {r["doc_id"]: r["lang"] for r in common.table(spark, sf, "documents").select("doc_id", "lang").collect()}
    rows = [r for r in language_id.op3_language_id(spark, sf).collect() if r["held_out"]]
    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.95
    labels = {r["doc_id"]: r for r in common.table(spark, sf, "labels").collect()}
    rows = [r for r in quality_knn.op2_quality_knn(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([r["score"] for r in rows if labels[r["doc_id"]]["quality"] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    sf = DATA.replace("0.001", "0.1")  # smaller tables have too few toxic rows to learn from
    labels = {r["doc_id"]: r for r in common.table(spark, sf, "labels").collect()}
    rows = [r for r in toxicity.op5_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    bad, calm = ([r["score"] for r in rows if labels[r["doc_id"]]["toxic"] == k] for k in (1, 0))
    assert np.mean([g > b for g in bad for b in calm]) > 0.9
    caught = [labels[r["doc_id"]]["toxic"] for r in rows if r["predicted"]]
    assert np.mean(caught) > 0.9 and sum(caught) > 0.85 * len(bad)


def test_language_is_naive_bayes(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("abcä é" if k % 2 else "bcd o") for _ in range(rng.randint(1, 60))), "xy"[k % 2]) for k in range(120)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.detect_language(train, language_id.fit_language_model(train, "text", "lang", "doc_id")).collect()}

    def grams(text):
        t = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        while "  " in t:
            t = t.replace("  ", " ")
        return [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)]

    held, n = {"x": {}, "y": {}}, {"x": 0, "y": 0}
    for _, t, x in rows:
        if any(c.isalpha() for c in t):
            n[x] += 1
            for g in grams(t):
                held[x][g] = held[x].get(g, 0) + 1
    logs = {}
    for x in "xy":
        total = sum(held[x].values()) + language_id.SMOOTHING * language_id.BUCKETS
        logs[x] = lambda g, x=x, total=total: math.log((held[x].get(g, 0) + language_id.SMOOTHING) / total)
    for k, t, _ in rows:
        if not any(c.isalpha() for c in t):
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
            continue
        a, b = (sum(map(logs[x], grams(t))) + math.log(n[x] / sum(n.values())) for x in "xy")
        assert got[k]["lang_pred"] == ("x" if a >= b else "y") and math.isclose(got[k]["score"], 1 / (1 + math.exp(-abs(a - b))), rel_tol=1e-3)


def test_quality_is_a_weighted_vote():
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    model = quality_knn.Neighbours(np.ones(quality_knn.TERMS, np.float32), rng.standard_normal((quality_knn.TERMS, 8)).astype(np.float32), unit(rng.standard_normal((90, 8))).astype(np.float32), rng.integers(0, 2, 90).astype(float))
    texts = [" ".join(rng.choice(["a", "bb", "## !", "Cc."], 30)) for _ in range(300)]
    found, vectors = model.score(texts), model.embed(texts)
    for v, s in zip(vectors, found, strict=True):
        cosine = [float(v @ w) for w in model.vectors]
        near = sorted(range(90), key=lambda k: -cosine[k])[: quality_knn.NEIGHBOURS]
        weight = [max(cosine[k], 1e-6) ** quality_knn.SHARPNESS for k in near]
        assert math.isclose(s, sum(w * model.labels[k] for w, k in zip(weight, near, strict=True)) / sum(weight), rel_tol=1e-4, abs_tol=1e-6)
    assert quality_knn._nearest(np.array([[1, 5, 5, 5, 2.0], [3, 3, 3, 3, 3]]), 2).tolist() == [[1, 2], [0, 1]]


def test_toxicity_is_kneser_ney():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(30)]
    texts = [(" ".join(rng.choice(words[: 20 + 10 * k]) for _ in range(25)), k) for k in (0, 1) for _ in range(12)]
    after = [{}, {}]  # by class, the words that stand before each word
    for text, k in texts:
        before = "<"
        for w in text.split():
            after[k].setdefault(w, set()).add(before)
            before = w
    n = [{w: len(us) for w, us in found.items()} for found in after]
    d, total = word_models.DISCOUNT, [sum(x.values()) for x in n]
    both = {w: n[0].get(w, 0) + n[1].get(w, 0) for w in set(n[0]) | set(n[1])}
    more = word_models.ADDED
    shared = lambda w: (both.get(w, 0) + more) / (sum(both.values()) + more * (len(both) + 1))
    p = lambda w, k: max(n[k].get(w, 0) - d, 0) / total[k] + d * len(n[k]) / total[k] * shared(w)
    for k in (0, 1):  # the probabilities of all words, and of one never seen, sum to one
        assert math.isclose(sum(p(w, k) for w in both) + p("never", k), 1)
    frames = []
    for k in (0, 1):
        pairs = pd.DataFrame(dict(zip("uw", word_models.contexts([t for t, c in texts if c == k]), strict=True)))
        frames.append(pairs.groupby("w", as_index=False).agg(n=("u", "size")).assign(k=k))
    model = word_models.WordModels.fit(pd.concat(frames))
    for text in ("w1 w2 W29", "w25 w25, never w3!", "w7", "new words only", texts[0][0]):
        own = re.findall("[a-z0-9]+", text.lower())
        want = [math.log(p(w, 1) / p(w, 0)) for w in own]
        got = np.concatenate(list(model.differences(text)))
        assert np.allclose(got, want, atol=1e-5)
        best = sorted(want)[::-1]
        runs = [sum(want[max(0, i - 2) : i + 1]) for i in range(len(want))] + [sum(want[i:]) for i in range(max(0, len(want) - 2), len(want))]
        assert np.allclose(model.features(text), [np.mean(want), best[0], np.mean(best[:3]), np.mean(best[:5]), max(runs), np.log1p(len(want))], atol=1e-5)
    long = " ".join(rng.choice(words) for _ in range(4000))
    whole, word_models.PIECE = model.features(long), 50
    try:
        assert np.allclose(model.features(long), whole)
    finally:
        word_models.PIECE = 1 << 20


def test_quality_neighbours(spark):
    good = [(k, f"Plain words number {k} follow each other here.", 1) for k in range(40)]
    bad = [(100 + k, f"## ** BUY {k} $$ && || !!", 0) for k in range(40)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality_knn.fit_neighbours(rows.select("doc_id", "text"), rows.select("doc_id", "quality"))
    got = {r["doc_id"]: r["score"] for r in quality_knn.score_quality(rows, model).collect()}
    assert all(got[k] > 0.9 for k, _, _ in good) and all(got[k] < 0.1 for k, _, _ in bad)
    assert all(0 <= r["score"] <= 1 for r in quality_knn.score_quality(docs(spark, ODD), model).collect())
    empty = quality_knn.fit_neighbours(rows.select("doc_id", "text").limit(0), rows.select("doc_id", "quality"))
    assert {r["score"] for r in quality_knn.score_quality(rows, empty).collect()} == {0.5}
    text = " ".join(f"w{k % 7} Abc" for k in range(400))
    whole = quality_knn.term_counts(text)
    piece, quality_knn.PIECE = quality_knn.PIECE, 7
    try:
        assert (quality_knn.term_counts(text) == whole).all()
    finally:
        quality_knn.PIECE = piece


def test_lookup_finds_every_key():
    keys = np.arange(5000)
    table = lookup.Table.build(keys, keys[:, None].astype(float), [-1.0])
    assert (table.values[table.find(np.arange(10_000)), 0] == np.where(np.arange(10_000) < 5000, np.arange(10_000), -1)).all()


def test_toxicity_tells_distant_letters_apart(spark):
    plain, far = "\u4e01\u4e02\u4e03\u4e04\u4e05\u4e06", "\u5e01\u5e02\u5e03\u5e04\u5e05\u5e06"  # equal in their last 12 bits
    rows = [(k, (far if k % 2 else plain) * 3, k % 2) for k in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(table, model).collect()}
    assert got[0] < 0.5 < got[1]


def test_toxicity(spark):
    rng = random.Random(4)
    words = ["calm", "river", "stone", "garden", "letter", "window"]
    say = lambda bad: " ".join(rng.choice(words + ["vileword"] * 3 * bad) for _ in range(40))
    rows = [(k, say(k % 4 == 0), int(k % 4 == 0)) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(table, model).collect()}
    assert np.mean([(got[k] >= 0.5) == t for k, _, t in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(docs(spark, ODD), model).collect())
    none = toxicity.fit_toxicity(table.select("doc_id", "text").limit(0), table.select("doc_id", "toxic"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(table, none).collect())


def test_knapsack_and_plan():
    best, took = packing.knapsack(np.array([0, 0, 0, 0.5, 0.3, 0.9, 0, 0, 0, 0, 0]), 10)
    assert math.isclose(best[10], 1.8) and math.isclose(best[9], 1.5)
    rng = random.Random(3)
    demand = {rng.randint(1, 63): rng.randint(1, 400) for _ in range(40)}
    solved = packing.column_generation(demand, 64)
    assert all(sum(l * n for l, n in p.items()) <= 64 for p, _ in solved)
    plan = packing.plan_packing(demand, 64)
    fill = {}
    for l, d in demand.items():
        for r in range(d):
            pieces = plan.place(l, r)
            assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:k]) for k in range(len(pieces))] and sum(p[1] for p in pieces) == l
            for _, n, s, o in pieces:
                fill.setdefault(s, []).append((o, n))
    total, padding = sum(l * d for l, d in demand.items()), 0
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert padding <= 0.01 * total and max(fill) < plan.all_sequences


def test_column_generation_reaches_the_optimum():
    """Against all patterns of a small case: no fractional cover takes fewer sequences than the bound from the lengths,
    and none that covers by whole patterns and cuts is cheaper than the program's."""
    demand, capacity = {7: 30, 5: 40, 3: 30}, 10
    solved = packing.column_generation(demand, capacity)
    held = {l: sum(p.get(l, 0) * x for p, x in solved) for l in demand}
    # 7 + 3 and 5 + 5 fill every sequence: 30 and 20 of them
    assert math.isclose(sum(x for _, x in solved), 50, rel_tol=1e-3) and all(math.isclose(held[l], d, rel_tol=1e-3) for l, d in demand.items())


def test_packing(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rng = random.Random(8)
    marked = ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", "  <|endoftext|>  x", "<|endoftext|", "<|ENDOFTEXT|>", "x<|endoftext|>\n\n y"]
    rows = [*ODD, ODD[5], *((60 + k, t, "a") for k, t in enumerate(marked)), *((20 + k, " ".join(rng.choice(["red", "Blue", "grün", "7"]) for _ in range(rng.randint(0, 3000))), "a") for k in range(30))]
    pieces = packing.pack(docs(spark, rows)).collect()
    want = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t, _ in rows}
    for k, ids in want.items():
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in pieces if r["doc_id"] == k)
        copies = sum(x[0] == k for x in rows)
        assert sum(n for _, n, _ in own) == copies * len(ids)
        assert all(zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) == c for a, n, c in own)
    fill = {}
    for r in pieces:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024
    assert packing.pack(docs(spark, ODD).limit(0)).count() == 0


def brute_components(rows, words, share):
    sets = {}
    for k, t, _ in rows:
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    label = {k: k for k in sets}
    keys = sorted(sets)
    changed = True
    while changed:
        changed = False
        for x in keys:
            for y in keys:
                if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= share * len(sets[x] | sets[y]) and label[x] > label[y]:
                    label[x], changed = label[y], True
    return {k: (len(sets[k]), label[k]) for k in sets}


@pytest.mark.parametrize("words,share,small", [(4, 85, False), (5, 80, False), (4, 85, True)])
def test_jaccard(spark, words, share, small, monkeypatch):
    if small:  # ids and pairs joined instead of sent, few counts, salted groups
        for name, value in (("SENT", 0), ("SENT_PAIRS", 0), ("LEAST", 2), ("FREQUENT", 20), ("HELD", 50), ("SALTED", 3)):
            monkeypatch.setattr(jaccard_join, name, value)
    seen = []
    linked = jaccard_join._linked
    monkeypatch.setattr(jaccard_join, "_linked", lambda name, pairs, *a: (seen.extend(map(tuple, pairs.collect())), linked(name, pairs, *a))[1])
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = list(ODD)
    for base in range(4):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([20, 60, 120]))]
        for _ in range(18):
            copy = list(text)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy), "a"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(docs(spark, rows), words=words, share=share).collect()}
    assert got == brute_components(rows, words, share)
    assert seen and len(seen) == len(set(seen))  # no pair is verified twice
    assert jaccard_join.similar_components(docs(spark, ODD).limit(0)).count() == 0


def test_jaccard_of_a_template(spark, monkeypatch):
    common = " ".join(f"c{k}" for k in range(93))
    rows = [(k, common + "".join(f" o{j}x{k}" for j in range(10)), "a") for k in range(400)]
    seen = []
    linked = jaccard_join._linked
    monkeypatch.setattr(jaccard_join, "_linked", lambda name, pairs, *a: (seen.append(pairs.count()), linked(name, pairs, *a))[1])
    got = jaccard_join.similar_components(docs(spark, rows), words=4, share=85).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got) and sum(seen) < 400


def test_jaccard_of_shared_sentences(spark, monkeypatch):
    """Texts put together from a stock of sentences: very many pairs share one, and none links. Most end in the join."""
    rng = random.Random(9)
    stock = [" ".join(f"s{k}x{i}" for i in range(10)) for k in range(300)]
    seen = []
    linked = jaccard_join._linked
    monkeypatch.setattr(jaccard_join, "_linked", lambda name, pairs, *a: (seen.append((name, pairs.count())), linked(name, pairs, *a))[1])
    for n in (1000, 4000):
        rows = [(k, " ".join(rng.sample(stock, 20)), "a") for k in range(n)]
        got = jaccard_join.similar_components(docs(spark, rows), words=4, share=85).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(k, k) for k in range(n)]
        assert dict(seen)["more"] < n / 50


@pytest.mark.parametrize("own", [None, "1m", "64m"])
def test_jaccard_sends_long_texts_in_small_batches(spark, own, monkeypatch):
    """600 texts of 20 KB, 12 MB in one partition, go to Python in batches of 4 MB or what the session sets, which stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), "id") for k in range(8)], F.repeat(F.lit("y"), 20_000)).alias("text"))
    seen = []
    sizes = lambda batches: (pd.DataFrame({"bytes": [int(b["text"].str.len().sum())]}) for b in batches)
    survey = jaccard_join._survey
    monkeypatch.setattr(jaccard_join, "_survey", lambda docs, *a: (seen.extend(r["bytes"] for r in docs.mapInPandas(sizes, "bytes long").collect()), survey(docs, *a))[1])
    before = spark.conf.get(name, None)
    if own:
        spark.conf.set(name, own)
    try:
        got = jaccard_join.similar_components(rows, words=4, share=85).collect()
        assert spark.conf.get(name, None) == (own or before)
    finally:
        spark.conf.unset(name)
    assert sorted(map(tuple, got)) == [(k, 6, k) for k in range(600)]
    assert sum(seen) > 12_000_000 and max(seen) < (1 if own == "1m" else 4) * 1024 * 1024 + 65_536


def test_null_and_repeated_keys(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, text(0), "a"), (None, text(1), "a"), (7, text(2), "a"), (7, text(1), "a"), (9, text(2), "a"), (7, text(3), "a")]
    got = jaccard_join.similar_components(docs(spark, rows), words=4, share=85).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted([("None", "None"), ("None", "7"), ("7", "7"), ("7", "7"), ("7", "7"), ("9", "7")])
    named = jaccard_join.similar_components(spark.createDataFrame([("b", text(0)), ("a", text(0)), ("c", "x")], "k string, text string"), "k")
    assert sorted((r["k"], r["component_id"]) for r in named.collect()) == [("a", "a"), ("b", "a"), ("c", "c")]
    got = suffix_dedup.remove_repeats(docs(spark, rows)).collect()
    assert len(got) == 6 and sorted(r["n_removed"] for r in got) == [0, 0, 0, 0, len(text(1)), len(text(2))]
    assert {r["doc_id"] for r in got if r["n_removed"]} == {None, 9}


def brute_repeats(rows, window):
    seen, out = set(), {}
    for k, t, *_ in sorted(rows):
        body = (t or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - window + 1):
            x = body[i : i + window]
            if x in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(x)
        kept = bytes(c for c, g in zip(body, gone, strict=True) if not g)
        out[k] = (len(body), len(body) - len(kept), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, small, monkeypatch):
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefg é") for _ in range(n))
    shared = [say(150) for _ in range(4)]
    rows = list(ODD)
    rows += [(20 + k, "".join(say(rng.randint(0, 80)) + rng.choice(shared) for _ in range(3)), "a") for k in range(25)]
    rows += [(60, rows[-1][1], "a"), (61, "ab" * 200, "a"), (62, "ab" * 230, "a")]
    merged = []
    if small:  # many shards
        monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", 2)
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 500)
        monkeypatch.setattr(suffix_dedup, "ROWS", 100)
        monkeypatch.setattr(suffix_dedup, "BYTES", 1000)
        merge = suffix_dedup._merge_shards
        monkeypatch.setattr(suffix_dedup, "_merge_shards", lambda classes, window: (merged.append(classes.count()), merge(classes, window))[1])
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs(spark, rows)).drop("kept").collect()}
    assert got == brute_repeats(rows, 100) and (not small or merged[0] > 100)
    assert suffix_dedup.remove_repeats(docs(spark, ODD).limit(0)).count() == 0


def test_runs_merge_to_their_union():
    rng = random.Random(2)
    windows = [bytes(rng.choice([0, 1, 255]) for _ in range(6)) for _ in range(300)]
    best, late, stack = {}, [], []
    for nth in range(5):
        own = {w: (rng.randrange(50), rng.randrange(50)) for w in rng.sample(windows, 120)}
        keys = sorted(own)
        stack.append((np.array(keys, "S6"), np.array([own[w][0] for w in keys]), np.array([own[w][1] for w in keys])))
        for w, p in own.items():
            late += [max(p, best[w])] if w in best else []
            best[w] = min(p, best.get(w, p))
    run, found = stack[0], []
    for other in stack[1:]:
        run, (ids, starts) = suffix_dedup._merge(run, other)
        found += zip(ids.tolist(), starts.tolist())
    assert [w.ljust(6, b"\0") for w in run[0].tolist()] == sorted(best) and list(zip(run[1].tolist(), run[2].tolist())) == [best[w] for w in sorted(best)]
    assert sorted(found) == sorted(late)


def test_pipeline(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mixed", "packed"]
    table = common.materialise(common.table(spark, DATA, "documents").withColumns({c: F.lit("own") for c in [*CLASHING, "rank", "score", "id"]}), "docs")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in table.collect()}
        after = common.materialise(stage(spark, table, DATA), name)
        assert after.count() and {r["doc_id"] for r in after.collect()} <= before
        if name != "packed":
            assert after.schema == table.schema or after.columns == table.columns
        table = after
    empty = common.table(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_pipeline_keeps_clean_rows_of_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    text = lambda k, n=12: " ".join(f"w{k}x{i}" for i in range(n))
    # ids null or shared, lengths unlike; text 3 has a copy, and text 4 a near one, under ids of other texts
    rows = [(None, text(0)), (None, text(1, 30)), (7, text(2, 20)), (7, text(3, 9)), (7, text(3, 9)), (None, text(4, 40)), (7, text(4, 40) + " z"), (2**53 + 1, text(5))]
    table = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(3).write.parquet(str(tmp_path / "docs"))
    for docs in (table, spark.read.parquet(str(tmp_path / "docs"))):
        exact = common.materialise(corpus_pipeline.exact(spark, docs, ""), "exact")
        assert sorted(r["text"] for r in exact.collect()) == sorted({t for _, t in rows})
        near = common.materialise(corpus_pipeline.near(spark, exact, ""), "near")
        left = sorted({t for _, t in rows} - {text(4, 40)})
        assert sorted(r["text"] for r in near.collect()) == left  # of ids null and 7, 7 stays
        mixed = common.materialise(corpus_pipeline.mixed(spark, near, ""), "mixed")
        # one source: its target is its size, so each text is taken once and whole
        assert sorted(r["text"] for r in mixed.collect()) == left
        ids = [r["doc_id"] for r in corpus_pipeline.packed(spark, mixed, "").where("start = 0").select("doc_id").collect()]
        assert sorted(ids, key=str) == [7, 7, 7, 2**53 + 1, None, None]
