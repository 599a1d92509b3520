"""The pipeline against a plain version of its stages, and each stage on odd tables."""

from __future__ import annotations

import collections
import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_training_data import WORDS, _classes, _text

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from contourlake.llm import tokens, toxicity  # noqa: E402
from contourlake.llm.mixing import MAX_EPOCHS, mix  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus():
    """Documents with toxic ones, shared lines, near copies, and sources of different sizes; and their labels."""
    rng = random.Random(30)
    shared = [_text(rng, 8) for _ in range(6)]
    texts, labels = {}, []
    for i in range(240):
        own = [_text(rng, 12) for _ in range(5)]
        if i % 4 == 0:
            own.insert(rng.randrange(5), rng.choice(shared))
        if i % 6 == 5:
            own.append("awful nasty vile rotten mean " + rng.choice(WORDS))
        texts[i] = "\n".join(own)
        labels.append((i, 1, int(i % 6 == 5)))
    for i in range(240, 270):
        own = texts[(i - 240) * 3].replace("\n", " ").split()
        own[rng.randrange(len(own))] = "changed"
        texts[i] = " ".join(own)
    texts |= {270: "", 271: None}
    return texts, labels


def _without_shared_lines(texts):
    holders = collections.defaultdict(set)
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            holders[x.strip().lower()].add(i)
    gone = lambda i, x: len(x.strip()) >= 10 and len(holders[x.strip().lower()]) > 1 and min(holders[x.strip().lower()]) != i
    return {i: "\n".join(x for x in (t or "").split("\n") if not gone(i, x)) for i, t in texts.items()}


def test_run_against_a_plain_version(spark, tmp_path):
    texts, labels = _corpus()
    source = {i: "big" if i % 10 < 8 else "small" for i in texts}
    docs = spark.createDataFrame([(i, t, "en", source[i], len(t or "")) for i, t in texts.items()], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # toxicity: the model's scores are tested for themselves; its decisions here, word by word
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    clean = {r["doc_id"] for r in model.score(docs).collect() if r["p_toxic"] < 0.5}
    assert clean == {i for i in texts if i >= 240 or i % 6 != 5} - {i for i in range(240, 270) if ((i - 240) * 3) % 6 == 5}
    kept = _without_shared_lines({i: texts[i] for i in clean})
    classes = _classes(kept, 0.8)
    assert len(set(classes.values())) < len(kept)
    kept = {i: kept[i] for i in kept if classes[i] == i}
    # mixing: the small source is read up to MAX_EPOCHS times, the last epoch in part
    size = {i: len(t.split()) for i, t in kept.items()}
    total = {s: sum(size[i] for i in kept if source[i] == s) for s in ("big", "small")}
    ratio = total["big"] / total["small"]
    epochs = {"big": 1.0, "small": min(MAX_EPOCHS, ratio)}
    encoder = tokens.Encoder.of(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*next(encoder.encode([t]))[1].tolist(), 1] for i, t in kept.items()}
    pieces = collections.defaultdict(collections.Counter)
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].update(range(r["start"], r["start"] + r["length"]))
    assert set(pieces) == set(kept)
    times = {}
    for i, count in pieces.items():
        assert set(count) == set(range(len(ids[i]))) and len(set(count.values())) == 1
        times[i] = count[0]
    read = sum(size[i] * times[i] for i in kept if source[i] == "small")
    assert all(times[i] == 1 for i in kept if source[i] == "big" or not size[i])
    assert epochs["small"] * total["small"] - max(size.values()) < read <= epochs["small"] * total["small"] + 1e-6
    # no sequence holds a document twice
    assert not any(n > 1 for n in collections.Counter((r["sequence_id"], r["doc_id"], r["start"]) for r in rows).values())


def test_mixing_stage_is_in_order_of_turn(spark, tmp_path):
    rng = random.Random(20)
    rows = [(i, " ".join(str(rng.random()) for _ in range(20)), "big" if i < 600 else "small") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).cache()
    want = [r["doc_id"] for r in mix(docs, max_epochs=MAX_EPOCHS).orderBy("turn").collect()]
    corpus_pipeline.mixing(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    files = sorted(f for f in os.listdir(f"{tmp_path}/mixed") if f.endswith(".parquet"))
    got = [r["doc_id"] for f in files for r in spark.read.parquet(f"{tmp_path}/mixed/{f}").collect()]
    assert got == want and len(got) > 900
    assert not any(a == b for a, b in itertools.pairwise(got))


def test_stages_on_odd_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    long = "long " * 40_000
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, long, "en", "a", 1), (3, long, "en", "a", 1), (None, "some words here", "en", "a", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("x").alias("row"), F.lit("y").alias("h"), F.lit("z").alias("__row"), F.lit("k").alias("key"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)))
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and docs.columns[5:] == ["row", "h", "__row", "key"]
    assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 0, 1, 2, 3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len({r["doc_id"] for r in packed}) == 4
    none = docs.where("doc_id > 9")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
        assert none.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF))
        assert docs.columns == columns
        sizes.append(docs.count())
    start, clean, lines, near, mixed = sizes
    assert start > clean == lines >= near and mixed >= near
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count() == near
    twice = packed.groupBy("sequence_id", "doc_id", "start").count().where("count > 1").count()
    assert twice == 0, "a sequence that holds a document twice"
