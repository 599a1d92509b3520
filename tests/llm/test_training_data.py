"""Each operator against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.llm import common, epsjoin, features, fingerprints, lines, maxscore, merkle, mixing, packing, probminhash, quality, rindex, tokens, toxicity, whitening, words, wrappers
from contourlake.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, h string, lines string, key string, turn string"
WORDS = [f"w{i}" for i in range(400)]


def _text(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source); the other columns clash with names the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "r", None, "l", "k", "t") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    rng = random.Random(5)
    base = _text(rng, 120)
    return _docs(spark, [(1, None), (2, ""), (3, base), (3, base), (4, base + "\n" + base), (None, base), (None, None), (5, "x " * 30000, None), (6, "é" * 500 + "\n" + base, None), (7, "short")]).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return _docs(spark, [(1, "a")]).where("doc_id > 1")


def test_fingerprints_compare_neighbours(spark):
    rng = random.Random(1)
    texts = {i: _text(rng, 5 + 30 * i) for i in range(12)} | {12: "", 13: "ab"}
    got = {r["doc_id"]: r for r in fingerprints.compare_neighbours(_docs(spark, list(texts.items()))).collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        x, y = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(x)
        assert got[i]["fingerprint"] == fingerprints.fingerprint(x)
        assert got[i]["near_edited"] == fingerprints.likeness(got[i]["fingerprint"], fingerprints.fingerprint(edited))
    assert all(got[i]["near_edited"] > 0.3 and got[i]["near_next"] < 0.3 for i in range(4, 12))
    assert fingerprints.likeness("1::", "1::") == 1.0 and fingerprints.fingerprint("") == "1::"


def _plain_fingerprint(text):
    """The definition, a code point at a time."""
    codes = [0] * 6 + [ord(c) for c in text]
    word = (1 << 32) - 1

    def spread(h):
        h = (h ^ h >> 15) * 0x85EBCA6B & word
        return h ^ h >> 13

    rolling = []
    for i in range(len(text)):
        h = 0
        for k, c in enumerate(codes[i : i + 7]):  # the middle one counts twice
            h = (h * 0x9E3779B1 + (2 * c if k == 3 else c)) & word
        rolling.append(spread(h))
    block = 1
    while block * 64 < len(text):
        block *= 2

    def signature(size):
        out, total, since = "", 0, 0
        for i, h in enumerate(rolling):
            total, since = (total + h) & word, since + 1
            if size == 1 or h < 2**32 // size or since == 4 * size or i == len(rolling) - 1:
                out += fingerprints.LETTERS.tobytes().decode()[spread(total) >> 26]
                total, since = 0, 0
        return out

    return f"{block}:{signature(block)}:{signature(2 * block)}" if text else "1::"


def test_fingerprint_against_the_definition():
    rng = random.Random(26)
    for n in (0, 1, 6, 63, 64, 65, 130, 700, 5000):
        for text in ("".join(rng.choice("ab é中😀\n") for _ in range(n)), "x" * n, "xy" * (n // 2)):
            assert fingerprints.fingerprint(text) == _plain_fingerprint(text)


def test_fingerprints_of_other_ids(spark):
    rows = [(f"k{i:02d}", f"{i} " * 50) for i in range(9)] + [(None, "none")]
    got = {r["doc_id"]: r for r in fingerprints.compare_neighbours(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for (i, x), (_, y) in zip(rows, [rows[-1], *rows[:-1]], strict=True):
        want = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    large = [(2**62 + i, f"{i} " * 40) for i in range(50)] + [(None, "none")]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.compare_neighbours(spark.createDataFrame(large, "doc_id long, text string")).collect()}
    x, y = large[7][1], large[6][1]
    assert got[2**62 + 7] == hashlib.sha256((x[: len(x) - len(x) // 2] + y[: len(x) // 2]).encode()).hexdigest()


def test_fingerprints_edges(edge, empty):
    assert fingerprints.compare_neighbours(edge).count() == 10 and fingerprints.compare_neighbours(empty).count() == 0
    assert fingerprints.with_fingerprints(edge).where("text = '' and fingerprint != '1::'").count() == 0


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 15))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        assert fingerprints._common(a, b) == table[-1][-1]


def _toxic_rows(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        rows.append((i, _text(rng, 30) + (" awful nasty" if bad else "") + (" vile rotten mean" if bad and i % 2 else "")))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = _toxic_rows(300, 3)
    docs, known = _docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, known, where=F.col("doc_id") % 3 != 1)
    got = {r["doc_id"]: r for r in model.score(docs).collect()}
    held = [i for i in range(300) if i % 3 == 1]
    assert np.mean([(got[i]["p_toxic"] >= 0.5) == (i % 5 == 0) for i in held]) > 0.95
    assert (np.diff(model.thresholds) > 0).all()
    mild = np.mean([got[i]["severity"] for i in range(0, 300, 10)])
    assert np.mean([got[i]["severity"] for i in range(5, 300, 10)]) > mild
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id % 5 != 0").count() == 240


def test_ordinal_likelihood_and_gradient():
    rng = np.random.default_rng(27)
    for top in (1, 2, 3):
        n, used = 30, 5
        grade = rng.integers(0, top + 1, n)
        owner, col = rng.integers(0, n, 60), rng.integers(0, used, 60)
        params = rng.normal(size=used + top)
        loss, slope = toxicity.ordinal_loss(params, owner, col, grade, top, 0.1)
        cut = [params[used]]
        for gap in params[used + 1 :]:
            cut.append(cut[-1] + math.exp(gap))
        plain = 0.0
        for i in range(n):
            eta = sum(params[c] for o, c in zip(owner, col, strict=True) if o == i)
            at_most = [1 / (1 + math.exp(eta - c)) for c in cut] + [1.0]
            plain -= math.log(at_most[grade[i]] - (at_most[grade[i] - 1] if grade[i] else 0.0)) / n
        assert loss == pytest.approx(plain + 0.05 * (params[:used] ** 2).sum())
        for k in range(len(params)):
            step = np.zeros(len(params))
            step[k] = 1e-6
            up, down = (toxicity.ordinal_loss(params + s * step, owner, col, grade, top, 0.1)[0] for s in (1, -1))
            assert slope[k] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_samples_are_bounded(spark):
    docs = _docs(spark, [(i, _text(random.Random(i), 30)) for i in range(200)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    picked = features.labelled_sample(docs, labels, "toxic", 50)
    order = [r["doc_id"] for r in labels.orderBy(F.xxhash64("doc_id")).collect()]
    assert {r["doc"] for r in picked.collect()} == set(order[:50])
    whole, label = features.fetched(picked, toxicity.MAKERS)
    assert label.tolist() == [i % 2 for i in order[:50]]
    few, label = features.fetched(picked, toxicity.MAKERS, 4 * sum(map(len, whole[:10])))
    assert len(few) == 10 and all((x == y).all() for x, y in zip(few, whole, strict=False))


def test_toxicity_brings_few_features_to_the_driver(spark, monkeypatch):
    rows, labels = _toxic_rows(300, 5)
    docs, known = _docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole, label = features.fetched(features.labelled_sample(docs, known, "toxic", 200), toxicity.MAKERS)
    toxic, size = (label > 0).astype(int), 1 << toxicity.BITS
    want = toxicity.OrdinalModel.fit(whole, toxicity.grades(whole, toxic, size), size)
    fit, got = toxicity.OrdinalModel.fit, []
    monkeypatch.setattr(toxicity.OrdinalModel, "fit", lambda rows, *more: got.append(rows) or fit(rows, *more))
    model = toxicity.fit_toxicity(docs, known, most=200)
    assert (model.weights == want.weights).all() and (model.thresholds == want.thresholds).all() and np.count_nonzero(want.weights) > 4
    assert len(got) == toxicity.FOLDS + 1 and len(got[-1]) == len(whole) == 200
    assert 0 < sum(map(len, got[-1])) < sum(map(len, whole)) / 10


def test_feature_counts_of_groups(spark):
    lists = [[1, 5, 9], [5], [], [9, 5], [1]]
    rows = spark.createDataFrame([(i, float(i % 2), np.array(x, "<i4").tobytes()) for i, x in enumerate(lists)], "nr long, label double, features binary")
    got = {r["feature"]: tuple(r)[1:] for r in features.feature_counts(rows, F.col("label"), 2).collect()}
    assert got == {1: (2, 0), 5: (1, 2), 9: (1, 1)}
    left, label = features.gathered(features.narrowed(rows, np.array([9, 1], np.int32), 16))
    assert [x.tolist() for x in left] == [[1, 9], [], [], [9], [1]] and label.tolist() == [0, 1, 0, 1, 0]


def test_toxicity_edges(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(edge, none)
    assert toxicity.reject_toxic(edge, model).count() == 10 and model.score(empty).count() == 0
    clash = edge.withColumns({c: F.lit("old") for c in ("severity", "p_toxic", "score")})
    assert dict(model.score(clash).dtypes)["severity"] == dict(model.score(clash).dtypes)["p_toxic"] == "double" and model.score(clash).where("score = 'old'").count() == 10
    odd = spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.fit_toxicity(edge, odd).score(edge).count() == 10


def _weights(tokens, exponent):
    raw = [(t / max(tokens)) ** exponent if t else 0.0 for t in tokens]
    return [r / sum(raw) for r in raw]


def _epochs(tokens, weights, budget):
    budget = budget or max(t / w for t, w in zip(tokens, weights, strict=True) if w)
    return [w * budget / t if t else 1.0 for t, w in zip(tokens, weights, strict=True)]


def test_mixing_weights(spark):
    tokens = [1000, 100, 10, 0, 10]
    heat = mixing.Temperature(spark.createDataFrame([(t,) for t in tokens], "tokens long"))
    entropy = lambda x: -sum(w * math.log(w) for w in _weights(tokens, x) if w)
    assert heat.entropies([0.0, 0.5, 1.0, 2.0]) == pytest.approx([entropy(x) for x in (0.0, 0.5, 1.0, 2.0)])
    assert entropy(heat.exponent(target_entropy=0.9)) == pytest.approx(0.9)
    for budget in (None, 3000.0):
        assert heat.most_epochs([0.1, 0.7, 1.0], budget) == pytest.approx([max(e for e, t in zip(_epochs(tokens, _weights(tokens, x), budget), tokens, strict=True) if t) for x in (0.1, 0.7, 1.0)])
        x = heat.exponent(max_epochs=3.0, budget=budget)
        assert max(_epochs(tokens, _weights(tokens, x), budget)) == pytest.approx(3.0)
        got = [r[0] for r in spark.createDataFrame([(t,) for t in tokens], "tokens long").select(heat.epochs(x, budget)).collect()]
        assert got == pytest.approx(_epochs(tokens, _weights(tokens, x), budget))
    with pytest.raises(ValueError):
        heat.exponent()
    assert [r[0] for r in spark.createDataFrame([("a b\tc\n", ), ("", ), (None, ), ("x" * 33, )], "t string").select(mixing.token_count(F.col("t"))).collect()] == [3, 0, 0, 3]


def test_mixing_takes_the_first_blocks(spark):
    """The chosen rows of a broken epoch: blocks in order of their place, then documents in order of their key, while the budget lasts."""
    rng = random.Random(22)
    texts = {i: _text(rng, rng.randint(1, 30)) for i in range(120)}
    docs = _docs(spark, [(i, t, "big" if i < 90 else "small") for i, t in texts.items()])
    budget = 900.0
    facts = {r["doc_id"]: r for r in docs.select("doc_id", "source", F.xxhash64(F.lit(17), "doc_id", "text").alias("key")).collect()}
    got = collections.defaultdict(list)
    for r in mixing.mix(docs, target_entropy=0.6, budget=budget).select("doc_id", "epoch").collect():
        got[r["doc_id"]].append(r["epoch"])
    size = {i: len(t.split()) for i, t in texts.items()}
    total = {s: sum(size[i] for i in texts if facts[i]["source"] == s) for s in ("big", "small")}
    names = list(total)
    x = mixing.Temperature(spark.createDataFrame([(t,) for t in total.values()], "tokens long")).exponent(target_entropy=0.6)
    for name, e in zip(names, _epochs(list(total.values()), _weights(list(total.values()), x), budget), strict=True):
        own = [i for i in texts if facts[i]["source"] == name]
        blocks = 1 << math.ceil(math.log2(len(own)) / 2)
        order = spark.createDataFrame([(i, "s" + name, int(e), facts[i]["key"] % blocks, facts[i]["key"]) for i in own], "i int, name string, epoch int, block long, key long")
        order = [r["i"] for r in order.orderBy(F.shiftrightunsigned(F.xxhash64(F.lit(18), "name", "epoch", "block"), 11), "block", "key").collect()]
        left = (e - int(e)) * total[name]
        want = {i: list(range(int(e))) for i in own}
        for i in order:
            left -= size[i]
            if left < 0:
                break
            want[i] = [*range(int(e) + 1)]
        assert {i: sorted(got[i]) for i in own} == want


def test_mixing_of_very_many_sources(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"), F.col("id").cast("string").alias("source"))
    assert mixing.mix(docs, max_epochs=2.0).count() == 3000


def test_mixing_realises_the_budget(spark):
    rng = random.Random(4)
    docs = _docs(spark, [(i, _text(rng, 20), "big" if i < 200 else "small" if i < 260 else None) for i in range(280)])
    whole = mixing.mix(docs, max_epochs=2.0).select("doc_id", "source", "epoch", "turn").collect()
    count = collections.Counter(r["doc_id"] for r in whole)
    assert set(count) == set(range(280)) and max(count.values()) == 2 and all(count[i] == 1 for i in range(200))
    assert all(0 <= r["turn"] <= 1 for r in whole)
    some = mixing.mix(docs, target_entropy=1.0, budget=2000.0).groupBy("source").count().collect()
    tokens = sum(r["count"] for r in some) * 20
    assert 1900 <= tokens <= 2000
    again = mixing.mix(docs, target_entropy=1.0, budget=2000.0).select("doc_id").collect()
    assert len({r["doc_id"] for r in again}) == len(again) == tokens // 20


def test_mixing_edges(edge, empty):
    out = mixing.mix(edge, max_epochs=2.0)
    assert set(out.columns) == set(edge.columns) | {"epoch"} and out.where("doc_id = 3").count() >= 2
    assert mixing.mix(empty, max_epochs=2.0).count() == 0


def _links(vectors, labels, least):
    ids = sorted(vectors)
    near = collections.defaultdict(set)
    for a in ids:
        for b in ids:
            if a < b and labels[a] == labels[b]:
                x, y = np.array(vectors[a], float), np.array(vectors[b], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    near[a].add(b)
                    near[b].add(a)
    part = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            low = min([part[a], *(part[b] for b in near[a])])
            changed |= low != part[a]
            part[a] = low
    return {i: (len(near[i]), part[i]) for i in ids}


def test_epsilon_join(spark, monkeypatch):
    monkeypatch.setattr(epsjoin, "BLOCK", 16 * 40)
    monkeypatch.setattr(epsjoin, "INNER", 5)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 10))
    vectors = {i: (base[i % 12] + 0.06 * rng.normal(size=10)).astype(np.float32).tolist() for i in range(150)}
    vectors |= {150 + i: vectors[7] for i in range(5)}
    labels = {i: i % 3 if i < 150 else 7 % 3 for i in vectors}
    rows = [(i, vectors[i], labels[i], 0) for i in vectors]
    want = _links(vectors, labels, 0.98)
    odd = [(900, None, 1, 0), (901, [0.0] * 10, 1, 0), (902, [float("nan")] * 10, 1, 0), (903, [None] * 10, 1, 0), (904, vectors[7], None, 0), (905, [float("inf")] + [1.0] * 9, 1, 0), (906, [1.0, 2.0], 1, 0), (907, [], 1, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, n_same int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in epsjoin.epsilon_join(df).collect()}
    assert got == want | {r[0]: (0, r[0]) for r in odd}
    assert epsjoin.epsilon_join(df.where("vec_id < 0")).count() == 0
    # ids of another type, in their own order; numbers near the ends of doubles
    named = df.withColumn("vec_id", F.format_string("v%04d", "vec_id")).withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 1e200))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in epsjoin.epsilon_join(named).collect()}
    assert got == {f"v{i:04d}": (n, f"v{c:04d}") for i, (n, c) in (want | {r[0]: (0, r[0]) for r in odd}).items()}


def test_epsilon_join_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0), (None, [1.0, 0.0], 0)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in epsjoin.epsilon_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(0, 0, None, None), (1, 4, 1, True), (1, 4, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_epsilon_join_prunes_and_keeps_all_links(spark, monkeypatch):
    """A tree of several levels over clusters that lie apart, against brute force."""
    monkeypatch.setattr(epsjoin, "BLOCK", 4 * 12 * 8)
    rng = np.random.default_rng(23)
    base = rng.normal(size=(60, 12))
    vectors = {i: (base[i % 60] + 0.02 * rng.normal(size=12)).astype(np.float32).tolist() for i in range(900)}
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors.items()], "vec_id long, embedding array<float>, label int")
    heads = df.select(F.col("vec_id").alias("vec"), "label", F.col("embedding").alias("v"), F.lit(1).cast("long").alias("n_same"))
    axes = epsjoin.principal_axes(heads)
    blocks = epsjoin.written(epsjoin._blocks(epsjoin._placed(heads, axes, 0.2), axes))
    n = blocks.count()
    assert n > 64 and epsjoin._interval_pairs(blocks, 0.2).count() < 0.25 * n * (n + 1) / 2
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in epsjoin.epsilon_join(df).collect()}
    assert got == _links(vectors, dict.fromkeys(vectors, 1), 0.98)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(8)
    pool = [_text(rng, 6) for _ in range(20)] + ["Short", "  Padded Line Here\t", "padded line here", "ÄÄÄÄÄÄÄÄÄÄ", "ääääääääää"]
    texts = {i: "\n".join(rng.choice(pool) for _ in range(8)) for i in range(30)}
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, t in texts.items():
        for x in t.split("\n"):
            holders[key(x)].add(i)
    gone = lambda i, x: len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) != i
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_shared_lines(_docs(spark, list(texts.items()))).collect()}
    assert got == {i: ("\n".join(x for x in t.split("\n") if not gone(i, x)), 8, sum(gone(i, x) for x in t.split("\n"))) for i, t in texts.items()}


def test_line_dedup_edges(edge, empty):
    out = lines.drop_shared_lines(edge)
    assert out.count() == 10 and out.where("doc_id = 4").collect()[0]["text"] == "" and out.where("text is null").count() == 0
    assert out.where("doc_id is null and n_dropped > 0").count() == 0 and lines.drop_shared_lines(empty).count() == 0
    assert lines.drop_shared_lines(edge, min_docs=3).where("doc_id = 6").collect()[0]["n_dropped"] == 1


PAGE = '<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href="/a">Menu {0}</a></li><li><a href="/b">More</a></li></ul></nav><div class="ad">Buy {0}</div>{1}<footer>&copy; site</footer>'


def test_wrappers(spark):
    bodies = ["<article><h1>Head &amp; one</h1><p>First  <b>bold</b>\ntext.<p>Second<br>line</article>", "<article><h1>Two</h1><p>Only.</p><div class='comments'><p>I disagree</p></div></article>", "<main><p>Plain &lt;x&gt;</p><form><p>Mail</p></form></main>", ""]
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.format(i, b), "x") for i, b in enumerate(bodies)] + [(8, None, None, "x"), (9, "bad url", "", "x")]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string")).collect()}
    assert got[0] == "Head & one\nFirst bold text.\nSecond line" and got[1] == "Two\nOnly." and got[2] == "Plain <x>"
    assert got[3] == "" and got[8] == "" and got[9] == ""


def _tree(rng, depth=0):
    """A random tree of elements, as html and as the stream that an expression describes."""
    marks, said = [], []
    for _ in range(rng.randint(0, 4)):
        kind = rng.choice(["#", "div", "section", "div class='big'", "ul"][: 5 if depth < 3 else 1])
        if kind == "#" and said[-1:] != ["#"]:
            marks.append(rng.choice(WORDS))
            said.append("#")
        elif kind != "#":
            inner, stream = _tree(rng, depth + 1)
            marks.append(f"<{kind}>{inner}</{kind.split()[0]}>")
            said.append(kind.replace(" class='big'", ".big") + f"<{stream}>")
    return "".join(marks), "".join(said)


def test_wrappers_describe_every_page_folded_in():
    rng = random.Random(21)
    for size in (1, 2, 5, 40):
        pages = [_tree(rng) for _ in range(size)]
        whole, halves = wrappers.Wrapper(), [wrappers.Wrapper(), wrappers.Wrapper()]
        for i, (page, _) in enumerate(pages):
            whole.absorb(wrappers.Page(page).slots, 1)
            halves[i % 2].absorb(wrappers.Page(page).slots, 1)
        halves[0].absorb(wrappers.Wrapper.load(halves[1].dump()).slots, halves[1].pages)
        assert halves[0].roles() == whole.roles() and halves[0].pages == size
        for w in (whole, halves[0]):
            pattern = re.compile(w.expression().replace(" ", "").replace(".", "[.]"))
            assert all(pattern.fullmatch(stream) for _, stream in pages)


def test_wrapper_alignment():
    w = wrappers.Wrapper()
    for page in ("<nav>Menu</nav><div><p>one<p>two</div>", "<nav>Menu</nav><div class=note>x</div><div><h2>a</h2><p>b</p><h2>c</h2></div>"):
        w.absorb(wrappers.Page(page).slots, 1)
    assert w.expression() == "nav<#> (div.note<#>)? div<((h2<#>)? (p<#>)*)+>"
    nav, note = (next(x for x in w.slots.values() if x.key == k) for k in ("nav", "div.note"))
    assert nav.constant() and not note.constant()
    few = wrappers.Wrapper()
    for i in range(3000):
        few.absorb(wrappers.Page(f"<p>x{i}</p>" + "<h6>y</h6>" * (i == 7) + "<h5>z</h5>" * (i % 900 == 0)).slots, 1)
    assert [x.key for x in few.pruned().slots.values()] == ["", "p", "h5"]


def _texts(spark, pages, url="http://one.example.com/"):
    rows = [(i, url, p) for i, p in enumerate(pages)]
    return [r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_wrappers_decide_by_what_pages_say(spark):
    said = [_text(random.Random(i), 20) for i in range(8)]
    assert _texts(spark, [f"<aside><p>{said[0]}</p></aside>", f"<div class='content'><p>{said[1]}</p></div>"]) == ["", said[1]]
    assert _texts(spark, [f"<article><ul><li>{said[0]}</ul></article>", f"<div><p>{said[1]}</p></div>"]) == said[:2]
    for words in ("share-page-content", "comment-free story", "notice-board"):
        page = f"<body class='no-sidebar'><nav>Menu</nav><div class='{words}'><p>{{0}}</p><div class='comments'><p>No</p></div></div><div class='about'>About us and others</div></body>"
        assert _texts(spark, [page.format(t) for t in said]) == said
    # what all pages say is the template's, where they differ in other places; copies of one page do not show that
    assert _texts(spark, [f"<div class='x'><p>{t}</p></div><div class='y'><p>{said[7] * 2}</p></div>" for t in said[:7]]) == said[:7]
    assert _texts(spark, [f"<nav>{t}</nav><div><p>{said[0]}</p></div>" for t in said[1:4]]) == [said[0]] * 3
    assert _texts(spark, [f"<form id='page'><nav>Menu</nav><div><p>{t}</p></div><form><p>Mail</p></form></form>" for t in said]) == said
    assert _texts(spark, [f"<article><p>{t}</p><div class='box'><p>Write to us.</p></div><h2>Introduction</h2><p>{t} b</p></article>" for t in said]) == [f"{t}\nIntroduction\n{t} b" for t in said]
    assert _texts(spark, ["<ul><li class='comment'><p>No</p></li></ul><div><p>" + said[0] + "</p></div>"]) == said[:1]


def test_wrappers_keep_articles_whatever_holds_them(spark):
    said = [_text(random.Random(i), 20) for i in range(5)]
    for around in ("<body><form><div class=content>{}</div></form>", "<div class=legal>{}</div>", "<main><div id=legal>{}</div></main>", "<main><h1>T</h1><div class=notice>{}</div></main>", "<form><div class=disclaimer>{}</div></form>"):
        want = [("T\n" if "<h1>" in around else "") + t for t in said]
        assert _texts(spark, ["<nav>Menu</nav>" + around.format(f"<p>{t}</p>") + "<footer>us</footer>" for t in said]) == want
    # not where the host's pages say something elsewhere
    assert _texts(spark, [f"<div class=story><p>{t}</p></div><div class=promo><p>Buy {i}</p></div>" for i, t in enumerate(said)] + ["<div class=promo><p>Buy 9</p></div>"]) == [*said, ""]
    last = [_text(random.Random(50 + i), 2) for i in range(5)]
    assert _texts(spark, [f"<div class=content><p>{t}</p></div><div class=more><p>{e}</p></div><div class=about><p>About us</p></div>" for t, e in zip(said, last, strict=True)]) == [f"{t}\n{e}" for t, e in zip(said, last, strict=True)]
    links = "<h2>References</h2><ul><li><a href=a>First book {0}</a><li><a href=b>Second book {0}</a></ul>"
    assert _texts(spark, [f"<ul><li><a href=m>Menu {i}</a></ul><div class=content><p>{t}</p>{links.format(i)}</div>" for i, t in enumerate(said)]) == [f"{t}\nReferences\nFirst book {i}\nSecond book {i}" for i, t in enumerate(said)]
    assert _texts(spark, [f"<div><p>{t} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p></div>" for t in said]) == [f"{t} x=1 b" for t in said]


REPLIES = "<div class=replies><h3>{0} replies</h3>{1}</div>"
REPLY = "<div class=reply><span class=author>Ann {0}</span><p>{1}</p></div>"


def test_wrappers_know_readers_by_repetition(spark, monkeypatch):
    said = [_text(random.Random(i), 20) for i in range(6)]
    # pages with one reply, and with none, are told by those with several
    replies = ["".join(REPLY.format(n, _text(random.Random(100 * i + n), 3)) for n in range(i)) for i in range(6)]
    for around in ("<article><p>{0}</p>{1}</article>", "<div class=story><p>{0}</p></div>{1}"):
        pages = [around.format(t, REPLIES.format(i, r) if i else "") for i, (t, r) in enumerate(zip(said, replies, strict=True))]
        assert _texts(spark, pages) == said
    whole = wrappers.Wrapper()
    for page in pages:
        whole.absorb(wrappers.Page(page).slots, 1)
    assert {whole.slots[p].key for p in whole.readers()} == {"div.reply"}
    # sections that somebody signs have headlines, and a page of nothing but signed items keeps them
    sections = ["".join(f"<section><h2>H{n}</h2><p class=author>Ann</p><p>{t} {n}</p></section>" for n in range(3)) for t in said]
    assert _texts(spark, [f"<article>{s}</article>" for s in sections]) == ["\n".join(f"H{n}\nAnn\n{t} {n}" for n in range(3)) for t in said]
    assert all(t.count("Ann") == 3 for t in _texts(spark, [REPLY.format(i, t) * 3 for i, t in enumerate(said)]))
    # without the inferred items and their order nothing tells them
    monkeypatch.setattr(wrappers.Slot, "saw", lambda self, items: None)
    blind = wrappers.Wrapper()
    for page in pages:
        blind.absorb(wrappers.Page(page).slots, 1)
    assert not blind.readers()
    known = wrappers._known(blind.roles())
    page = wrappers.Page(pages[-1])
    assert "Ann 1" in " ".join(t for p, t, _ in page.blocks if p in page.article(known))


def test_wrappers_long_and_broken_pages(spark):
    for page in ('<a href="' * 120_000, "<p>x</p>" + '<a ="">"' * 120_000, "<a b='>" * 150_000, "<svg>" * 200_000, "<script>" * 100_000):
        began = time.time()
        wrappers.Page(page)
        assert time.time() - began < 5
    deep = wrappers.Page("<div>x" * 20_000)
    assert len(deep.article({})) == 20_000
    long = " ".join(WORDS * 500)
    assert _texts(spark, ["<article>" + f"<p>{long}</p><h2>{long}</h2>" * 3 + "</article>", '<p>a <b>b</b> c<img alt="<p>">d &amp; e</p><p class="x>f', "a < b<p>c"]) == ["\n".join([long] * 6), "a b cd & e\nf", "a < b\nc"]


def test_wrappers_edges(spark):
    schema = "page_id long, url string, html string, row string, h string, page string, text string"
    rows = [(1, "http://a.example.com", "<p>same words</p>", "r", "h", "p", "old")] * 2 + [(2, None, None, None, None, None, None), (None, "http://a.example.com", "", "r", "h", "p", "t")]
    df = spark.createDataFrame(rows, schema)
    got = wrappers.extract(df)
    assert got.columns == ["page_id", "url", "row", "h", "page", "text"]
    assert sorted((r["page_id"] or 0, r["text"], r["row"]) for r in got.collect()) == [(0, "", "r"), (1, "same words", "r"), (1, "same words", "r"), (2, "", None)]
    assert wrappers.extract(df.where("page_id > 9")).count() == 0 and wrappers.infer_wrappers(df.where("page_id > 9")).count() == 0


def test_wrappers_read_every_page_whole(spark):
    rng = random.Random(19)
    parts = ["<h2>{}</h2>", "<p>{}</p>", "<ul><li>{}<li>x</ul>", "<pre>{}</pre>", "<blockquote>{}</blockquote>", "<figure><figcaption>{}</figcaption></figure>"]
    want, rows = {}, []
    for i in range(300):
        said = [_text(rng, 4) for _ in range(rng.randint(2, 10))]
        forms = [rng.choice(parts) for _ in said]
        want[i] = "\n".join(t + "\nx" * f.startswith("<ul") for t, f in zip(said, forms, strict=True))
        rows.append((i, f"http://one.example.com/{i}", PAGE.format(i, "<article>" + "".join(f.format(t) for t, f in zip(said, forms, strict=True)) + "</article>")))
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_wrappers_of_mixed_templates(spark):
    bodies = {
        "<article><p>{0}</p></article>": "{0}",
        "<article><p>{0}</p></article><article><p>{0} b</p></article>": "{0}\n{0} b",
        "<div class='content'><p class='text'>{0}</p><p>{0} b</p></div><div class='about'><p>us</p></div>": "{0}\n{0} b",
        "<div class='story'><h1>{0}</h1>{0} b</div><div class='about'><p>us</p></div>": "{0}\n{0} b",
        "<div class='content'><p>See</p><ul><li>{0}<li>{0} b</ul></div>": "See\n{0}\n{0} b",
        "<div class='story'><p class='copyright'>us</p><p>{0}</p></div>": "{0}",
    }
    for url in ("http://one.example.com/{}", "no url", None):
        rows, want = [], {}
        for i in range(60):
            said = _text(random.Random(i), 20)
            body, text = list(bodies.items())[0 if i < 30 else i % len(bodies)]
            rows.append((i, url and url.format(i), PAGE.format(i, body.format(said))))
            want[i] = text.format(said)
        got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {r["page_id"]: r["text"] for r in got} == want


def test_wrappers_in_layout_containers(spark):
    bodies = {
        "<div class='with-sidebar'><article><p>{0}</p><div class='comments'><p>no</p></div></article><div class='sidebar'><p>no</p></div></div>": "{0}",
        "<div class='legal-content'><main><div class='page-header-fixed'><p>no</p></div><p>{0}</p></main></div>": "{0}",
        "<article><p>{0}</p></article><div class='related'><article><p>no</p></article></div>": "{0}",
        "<div class='has-sidebar'><article><p>{0}</p></article></div><article><p>b</p></article>": "{0}\nb",
        "<aside><article><p>no</p></article></aside><article><p>{0}</p></article>": "{0}",
    }
    rows, want = [], {}
    for i in range(20):
        said = _text(random.Random(i), 20)
        body, text = list(bodies.items())[i % len(bodies)]
        rows.append((i, f"http://h{i % 3}.example.com/{i}", PAGE.format(i, body.format(said))))
        want[i] = text.format(said)
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_sketches_of_a_piece_are_those_of_its_rows():
    rng = random.Random(24)
    texts = ["", _text(rng, 3), _text(rng, 200), "", _text(rng, 5), "a a a a a a a a", _text(rng, 40)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    own, at = words.word_hashes(data, offsets)
    row, found, count = words.rows_of_shingles(own, at, 5)
    grid = probminhash.sketches(row, found, count, len(texts), 48)
    for k in range(len(texts)):
        one = words.weighted_shingles(own[at[k] : at[k + 1]], 5)
        assert (found[row == k] == one[0]).all() and (count[row == k] == one[1]).all()
        assert (grid[k] == probminhash.sketch(*one, 48)).all()


def _classes(texts, least):
    sets = {}
    for i, t in texts.items():
        data = np.frombuffer((t or "").encode(), np.uint8)
        sets[i] = words.weighted_shingles(words.word_hashes(data, np.array([0, len(data)]))[0], 5)
    part = {i: i for i in texts}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and probminhash.probability_jaccard(*sets[a], *sets[b]) >= least:
                x, y = sorted((root(a), root(b)))
                part[y] = x
    return {i: root(i) for i in texts}


def test_probability_jaccard_against_the_formula():
    rng = np.random.default_rng(9)
    for _ in range(20):
        x, y = {int(k): int(w) for k, w in zip(rng.choice(30, 12, False), rng.integers(1, 5, 12), strict=True)}, {int(k): int(w) for k, w in zip(rng.choice(30, 15, False), rng.integers(1, 5, 15), strict=True)}
        want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
        side = lambda d: (np.array(sorted(d)), np.array([d[k] for k in sorted(d)]))
        assert probminhash.probability_jaccard(*side(x), *side(y)) == pytest.approx(want)
    a = (np.arange(1, 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.ones(499, int))
    b = (a[0][:450], a[1][:450])
    agree = (probminhash.sketch(*a, 2000) == probminhash.sketch(*b, 2000)).mean()
    assert abs(agree - 450 / 499) < 0.03


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(10)
    texts = {}
    for g in range(4):
        base = _text(rng, 150).split()
        for k in range(12):
            own = list(base)
            for _ in range(k % 7):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            texts[len(texts)] = " ".join(own)
    texts |= {len(texts) + i: _text(rng, 80) for i in range(10)} | {100: "", 101: None, 102: texts[3].upper(), 103: "one two", 104: "one two"}
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(_docs(spark, list(texts.items()))).collect()}
    assert got == _classes(texts, 0.8)
    kept = probminhash.keep_one(_docs(spark, list(texts.items())))
    assert {r["doc_id"] for r in kept.collect()} == set(got.values()) and len(kept.columns) == 10


def test_near_duplicates_of_long_texts_and_other_ids(spark):
    """More shingles than a bitmap has bits, similarities on both sides of the threshold, ids that are texts."""
    rng = random.Random(25)
    texts = {}
    for g in range(3):
        base = [f"{rng.randrange(10**6)}" for _ in range(6000)]
        for k in range(6):
            own = list(base)
            for at in rng.sample(range(6000), 30 + 60 * k):
                own[at] = f"{rng.randrange(10**6)}"
            texts[f"d{g}{k}"] = " ".join(own)
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert got == _classes(texts, 0.8) and len(set(got.values())) > 3
    kept = probminhash.keep_one(spark.createDataFrame([*texts.items(), (None, "x"), (None, "x")], "doc_id string, text string")).collect()
    assert sorted(r["doc_id"] or "" for r in kept) == ["", "", *sorted(set(got.values()))]


def test_met_deals_hot_keys_out(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    groups = common.written(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least")).where("k < 2000"))
    got = sorted(map(tuple, common.met(rows, groups, ["k"], ["v"]).select("k", "v", "least").collect()))
    assert got == sorted((k, v, k) for k, v in ((0 if i % 3 == 0 else i, i) for i in range(3000)) if k < 2000)
    assert common.met(rows, groups.where("k < 0"), ["k"], ["v"]).count() == 0


def test_near_duplicates_edges(edge, empty):
    rows = probminhash.near_duplicates(edge).collect()
    assert len(rows) == 10 and {r["class_id"] for r in rows if r["doc_id"] is None} == {None}
    assert probminhash.near_duplicates(empty).count() == 0
    kept = probminhash.keep_one(edge)
    assert kept.where("doc_id = 3").count() == 1 and kept.where("doc_id is null").count() == 2


def test_components(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3), (5, 5)]
    part = {v: v for e in edges for v in e if v is not None and None not in e and e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a is not None and b is not None and a != b:
                part[a] = part[b] = min(part[a], part[b])
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == part


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_tokens_equal_the_library(tokenizer):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    bits = ["a", "Z", "'", "'s", "'re", " ", "  ", "\n", "\t", "12", "é", "中", "😀", ".", "!!", "　", "don't", "<|endoftext|>", "٣"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    library = Tokenizer.from_file(tokenizer)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    encoder = tokens.Encoder.of(tokenizer)
    assert [ids.tolist() for _, ids in encoder.encode(texts)] == want
    whole = " ".join(texts)
    assert encoder._spelling(whole, 700).tolist() == library.encode(whole, add_special_tokens=False).ids
    assert any("<|endoftext|>" in t for t in texts)


def test_packing_round_trip(spark, edge, empty, tokenizer):
    rng = random.Random(13)
    docs = _docs(spark, [(i, _text(rng, rng.randint(0, 900)) + ".") for i in range(80)])
    encoder = tokens.Encoder.of(tokenizer)
    ids = {r["doc_id"]: [*next(encoder.encode([r["text"]]))[1].tolist(), 1] for r in docs.collect()}
    rows = packing.pack(docs, tokenizer).collect()
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    for spans, ends in ((pieces, {i: len(x) for i, x in ids.items()}), (sequences, None)):
        for k, own in spans.items():
            at = 0
            for start, length in sorted(own):
                assert start == at
                at += length
            assert at == ends[k] if ends else at <= 2048
    size = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(2048 if n & (n - 1) else n for n in size) <= 1.02 * sum(size)
    assert packing.pack(edge, tokenizer).where("doc_tokens = 1 and length = 1").count() == 3 and packing.pack(empty, tokenizer).count() == 0


def test_best_cuts_are_optimal():
    rng = random.Random(14)
    for _ in range(20):
        at = sorted({0, *(rng.randrange(1, 60) for _ in range(25))})
        while max(b - a for a, b in zip(at, at[1:], strict=False)) > 10:
            at = sorted({*at, *range(0, at[-1], 7)})
        cost = [rng.randrange(5) for _ in at]
        key, _ = packing.best_cuts(at, cost, 10)
        best = [0] + [10**9] * (len(at) - 1)
        for i in range(1, len(at)):
            best[i] = min(best[j] + cost[i] + 10 - (at[i] - at[j]) for j in range(i) if at[i] - at[j] <= 10)
        assert [k - p for k, p in zip(key, at, strict=True)] == best


@pytest.mark.parametrize("crowd", [8192, 2, 1])
def test_repeats_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(rindex, "CROWD", crowd)
    rng = random.Random(15)
    passage, base = _text(rng, 90), _text(rng, 150)
    texts = {i: _text(rng, 60) + passage[rng.randrange(60) :] + _text(rng, 30) for i in range(8)}
    for i in range(8, 16):
        own = base.split()
        own[rng.randrange(len(own))] = "é" * 3
        texts[i] = " ".join(own)
    texts |= {16: base, 17: "ab " * 200 + "end", 18: "", 19: None, 20: "x" * 199, 21: passage, 22: passage}
    count = collections.Counter()
    raw = {i: (t or "").encode() for i, t in texts.items()}
    for b in raw.values():
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    got = {r["doc_id"]: r for r in rindex.drop_repeated_bytes(_docs(spark, list(texts.items()))).collect()}
    for i, b in raw.items():
        cut = rindex.covered([(k, k) for k in range(len(b) - 199) if count[b[k : k + 200]] > 1], 200)
        gone = {p for lo, hi in cut for p in range(lo, hi)}
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(b), len(gone), len(cut)), i
        assert bytes(got[i]["kept"]) == bytes(c for p, c in enumerate(b) if p not in gone)


def test_repeats_across_stretches(spark, monkeypatch):
    rng = random.Random(18)
    passage, double = _text(rng, 90), _text(rng, 400)
    texts = [(0, _text(rng, 700)), (1, _text(rng, 300) + passage + _text(rng, 200)), (2, _text(rng, 500) + passage), (3, double), (3, double), (4, "ab " * 400 + _text(rng, 90))]
    data = np.frombuffer(texts[0][1].encode(), np.uint8)
    whole = [np.concatenate(x) for x in zip(*rindex.anchors(data, 200, 1 << 20), strict=True)]
    for stretch in (100, 300, 731):
        assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*rindex.anchors(data, 200, stretch), strict=True), whole, strict=True))
    monkeypatch.setattr(rindex, "STRETCH", 300)
    raw = [(i, t.encode()) for i, t in texts]
    count = collections.Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    want = []
    for i, b in raw:
        cut = rindex.covered([(k, k) for k in range(len(b) - 199) if count[b[k : k + 200]] > 1], 200)
        gone = {p for lo, hi in cut for p in range(lo, hi)}
        want.append((i, len(b), len(gone), len(cut), bytes(c for p, c in enumerate(b) if p not in gone)))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rindex.drop_repeated_bytes(_docs(spark, texts)).collect()]
    assert sorted(got) == sorted(want)


def test_repeats_edges(edge, empty):
    rows = rindex.drop_repeated_bytes(edge).collect()
    assert len(rows) == 10 and all(r["n_removed"] == r["n_bytes"] for r in rows if r["doc_id"] == 3)
    assert rindex.drop_repeated_bytes(empty).count() == 0


def test_matching_statistics():
    rng = random.Random(16)
    texts = list(dict.fromkeys(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(12)))
    index = rindex.RunLengthIndex(texts)
    found = index.matching_statistics()
    suffixes = [(k, i) for k, t in enumerate(texts) for i in range(len(t))]

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    for k, i in suffixes:
        assert found[index.starts[k] + i] == max(common(texts[k][i:], texts[q][j:]) for q, j in suffixes if (q, j) != (k, i))
    assert len(index.heads) < len(index.text)


def test_quality_held_out(spark, edge, empty):
    rng = random.Random(17)
    rows = [(i, _text(rng, 40) if i % 4 else " ".join(w.upper() + "!!" for w in _text(rng, 40).split())) for i in range(240)]
    docs, labels = _docs(spark, rows), spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    got = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 4 > 0) for i in held]) > 0.95
    assert model.score(edge).where("score is null or score < 0 or score > 1").count() == 0 and model.score(empty).count() == 0
    one = quality.fit_quality(docs, labels.where("quality = 1"))
    assert one.score(docs).where("score <= 0.5").count() == 0


def test_dual_coordinate_descent_against_a_plain_solver():
    """Its weights reach the least loss of the primal problem, which projected gradient steps on the whole dual find."""
    rng = np.random.default_rng(28)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(60)]
    values, y = rng.normal(size=12), rng.integers(0, 2, 60)
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        x[i, r] = values[r]
    x[:, 12] = 1
    sign, c = np.where(y > 0, 1.0, -1.0), 0.5
    loss = lambda w: w @ w / 2 + c * np.maximum(0, 1 - sign * (x @ w)).sum()
    signed = x * sign[:, None]
    alpha, rate = np.zeros(60), 1 / np.linalg.norm(signed @ signed.T, 2)
    for _ in range(100_000):
        alpha = np.clip(alpha + rate * (1 - signed @ (signed.T @ alpha)), 0, c)
    plain = signed.T @ alpha
    w, bias = quality.dual_coordinate_descent(rows, values, y, c, 2000)
    assert loss(np.append(w, bias)) == pytest.approx(loss(plain), rel=1e-3)
    assert loss(plain) == pytest.approx(alpha.sum() - plain @ plain / 2, rel=1e-3)


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 2]), np.array([0]), np.array([1, 2]), np.array([1])]
    w, bias = quality.dual_coordinate_descent(rows, np.ones(3), np.array([1, 1, 0, 0]))
    assert [float(w[r].sum() + bias) > 0 for r in rows] == [True, True, False, False]


def _plain_top(items, queries, k):
    """(query, rank, id, score) by all inner products."""
    out = []
    for q, v in queries:
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in items if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<long>, row string, query string, score string, rank string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "r", "q", "s", "k") for i, v in rows], VECTORS)


@pytest.mark.parametrize("shape", ["dense", "sparse", "ties", "uneven"])
def test_max_score_equals_all_products(spark, shape, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(-200, 200, (300, 16))
    if shape == "sparse":
        x[rng.random(x.shape) < 0.85] = 0
        x[:20] = 0
    elif shape == "ties":
        x = rng.integers(-1, 2, (300, 4))
    rows = [(int(i), v[: 3 + i % 14].tolist() if shape == "uneven" else v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(maxscore, "BLOCK", 512)
    # small shards, so that several meet
    found = maxscore.max_score(_vectors(spark, rows), _vectors(spark, rows).where("vec_id % 7 = 0"), 5, shard=600)
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == _plain_top(rows, [r for r in rows if r[0] % 7 == 0], 5)


def test_max_score_skips_and_large_numbers():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 50, (2000, 30)) * (rng.random((2000, 30)) < 0.1)
    block = maxscore.Postings(np.arange(2000), x.astype(np.int64))
    for q in x[:20]:
        want = _plain_top([(i, v) for i, v in enumerate(x.tolist())], [(-1, q.tolist())], 5)
        assert maxscore.best(block.search(q, -1, 5, None), 5) == [(s, i) for _, _, i, s in want]
        # with the k-th score known, only what can reach it comes back
        assert sorted(maxscore.best(block.search(q, -1, 5, want[-1][3]), 5)) == sorted((s, i) for _, _, i, s in want)
        assert block.search(q, -1, 5, want[0][3] + 1) == []
    huge = maxscore.Postings(np.arange(3), np.array([[2**62, 2**62], [2**62, 2**62 + 1], [-5, 0]], np.int64))
    assert maxscore.best(huge.search(np.array([2**62, 2**62]), 0, 2, None), 2) == [(2**124 + 2**62 * (2**62 + 1), 1), (-5 * 2**62, 2)]


def test_max_score_odd_tables(spark):
    rows = [(0, [1, 2]), (0, [5, 5]), (1, None), (2, [1, None]), (None, [9, 9]), (3, []), (4, [3, 3]), (4, [3, 3]), (5, [0, 0])]
    got = sorted(map(tuple, maxscore.max_score(_vectors(spark, rows), _vectors(spark, rows).where("vec_id = 0"), 3).select("query_id", "rank", "vec_id", "score").collect()))
    # each row of a repeated query asks; rows with its id are its own
    assert got == sorted([(0, 1, 4, 9), (0, 2, 4, 9), (0, 3, 3, 0), (0, 1, 4, 30), (0, 2, 4, 30), (0, 3, 3, 0)])
    none = _vectors(spark, rows).where("vec_id > 90")
    assert maxscore.max_score(none, none).count() == 0 and maxscore.max_score(none, _vectors(spark, rows)).count() == 0
    big = maxscore.max_score(_vectors(spark, [(1, [2**40]), (2, [2**40 - 1]), (3, [1])]), _vectors(spark, [(9, [2**40])]), 3).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(big, key=lambda r: r["rank"])] == [(1, None), (2, None), (3, 2**40)]
    floats = spark.createDataFrame([(1, [0.5, float("nan")]), (2, [0.999, -0.001]), (3, None), (4, [float("inf"), 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in maxscore.quantised(floats).collect()] == [(2, [255, -1])]


def _plain_manifest(rows, spoilt):
    """rows: (doc_id, source, lang, n_chars, text); a row of the result for each."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    leaf = lambda r: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(digests):
        """(root, the siblings of each)."""
        level, members, path = list(digests), [[i] for i in range(len(digests))], [[] for _ in digests]
        while len(level) > 1:
            up, own = [], []
            for i in range(0, len(level), 3):
                run = level[i : i + 3]
                for j in range(len(run)):
                    for m in members[i + j]:
                        path[m].append((run[:j], run[j + 1 :]))
                up.append(h(*run))
                own.append([m for x in members[i : i + 3] for m in x])
            level, members = up, own
        return level[0], path

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    sub = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub[g] = tree([leaf(r) for r in groups[g]])
    root, upper = tree([sub[g][0] for g in names])
    out = []
    for g, up in zip(names, upper):
        for r, own in zip(groups[g], sub[g][1]):
            path, node = own + up, leaf(spoilt(r))
            for left, right in path:
                node = h(*left, node, *right)
            out.append((r[0], leaf(r), sub[g][0], root, h(*(x for left, right in path for x in left + right)), node, node == root))
    return sorted(out, key=str)


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string, pos string, id string"


@pytest.mark.parametrize(("top", "levels"), [(4096, 7), (40, 1), (10, 2)])
def test_manifest_equals_a_plain_tree(spark, top, levels):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "é", None]), "en", 3, f"t{i}\nx" if i % 3 else None) for i in range(130)]
    rows += [(500, "one", None, None, ""), (7, "a", "en", 3, "again"), (7, "a", "en", 3, "again"), (None, "a", "en", 3, "x\ny"), (None, None, None, None, None)] + [(600 + i, f"s{i}", "en", 1, "z" * 3000 * (i == 1)) for i in range(30)]
    df = spark.createDataFrame([(*r, "l", "t", "p", "i") for r in rows], MANIFEST).repartition(5)
    odd = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
    spoilt = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    seen = merkle.leaf([spoilt if c == "text" else F.col(c) for c in merkle.COLUMNS])
    got = sorted(map(tuple, merkle.manifest(df, seen=seen, top=top, levels=levels).collect()), key=str)
    assert got == _plain_manifest(rows, lambda r: (*r[:4], r[4].replace("\n", "")) if odd(r) else r)
    proofs = merkle.manifest(df, top=top, levels=levels, proofs=True).collect()
    assert all(r["verified"] and merkle.folded(r["leaf"], [(s["left"], s["right"]) for s in r["proof"]]) == r["root"] for r in proofs)


def test_manifest_of_few_rows(spark):
    df = lambda rows: spark.createDataFrame([(*r, "l", "t", "p", "i") for r in rows], MANIFEST)
    assert merkle.manifest(df([])).count() == 0
    one = merkle.manifest(df([(1, "a", "en", 1, "x")])).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == hashlib.sha256(b"").hexdigest() and one["verified"]


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (None, x[1].tolist()), (900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [])]
    df = spark.createDataFrame([(i, v, "d", "n", 1) for i, v in rows], "vec_id long, embedding array<double>, d string, n string, x int")
    got = whitening.whiten(df, 4).toPandas()
    fit = np.floor(64 * np.array([v for _, v in rows[:402]])).astype(np.int64) + 1_000_000
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 402 * 4 and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    for k in range(4):
        own = got[got["component"] == k + 1]
        assert np.allclose(own["explained"], e[k] / np.trace(v), rtol=1e-9)
        own = own[own["vec_id"].notna()].drop_duplicates("vec_id").sort_values("vec_id")
        want = centred[:400] @ u[:, k] / np.sqrt(e[k])
        assert np.allclose(own["whitened"], want, atol=1e-7) or np.allclose(own["whitened"], -want, atol=1e-7)
        assert own["deviation"].tolist() == ((n * fit[:400] - s) ** 2).sum(axis=1).tolist()


def test_whitening_without_variance(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    flat = whitening.whiten(df([("a", [1.0, 2.0]), ("b", [1.0, 4.0]), ("c", [3.0])])).orderBy("vec_id", "component").collect()
    assert [(r["vec_id"], r["component"], r["n"]) for r in flat] == [("a", 1, 2), ("a", 2, 2), ("b", 1, 2), ("b", 2, 2), ("c", 1, 1)]
    assert abs(flat[0]["whitened"]) == 1.0 and flat[1]["whitened"] is None and flat[0]["explained"] == 1.0 and flat[4]["explained"] is None and flat[4]["whitened"] is None
    assert whitening.whiten(df([])).count() == 0 and whitening.whiten(df([("a", None)])).count() == 0
    assert whitening.deviations(np.array([[2**40, 1], [3, 4]])) == [None, 25]


def test_sample_bound_cuts_inside_an_id(spark):
    rng = random.Random(3)
    rows = [(1, _text(rng, 80)) for _ in range(3)] + [(1, "same words again " * 20)] * 50 + [(i, _text(rng, 80)) for i in range(2, 12)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)], "doc_id long, toxic int")
    picked = features.labelled_sample(_docs(spark, rows), labels, "toxic", 100)
    whole, label = features.fetched(picked, toxicity.MAKERS)
    assert len(whole) == len(label) == 63
    sizes = [4 * len(x) for x in whole]
    for bound in (1, sizes[0] + 1, sum(sizes) // 3, sum(sizes) // 2):
        few, own = features.fetched(picked, toxicity.MAKERS, bound)
        assert 1 <= len(few) == len(own) and (sum(4 * len(x) for x in few) <= bound or len(few) == 1)
        assert bound - sum(4 * len(x) for x in few) < max(sizes)


def test_repeats_of_many_equal_rows(spark):
    rng = random.Random(6)
    text, other = _text(rng, 200), _text(rng, 100)
    docs = _docs(spark, [(7, text)] * 3000 + [(8, text[100:900]), (9, other), (9, "short"), (9, "short")])
    got = rindex.drop_repeated_bytes(docs).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    n = len(text)
    assert sorted(map(tuple, got)) == [(7, n, n, 1, 3000), (8, 800, 800, 1, 1), (9, 5, 0, 0, 2), (9, len(other), 0, 0, 1)]


def test_near_duplicates_of_many_rows_of_an_id(spark):
    rng = random.Random(9)
    base = _text(rng, 100)
    near = base + " w1"
    rows = [(1, base)] * 400 + [(2, near)] * 400 + [(3, _text(rng, 100))] * 3
    got = probminhash.near_duplicates(_docs(spark, rows)).groupBy("doc_id", "class_id").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, 400), (2, 1, 400), (3, 3, 3)]
