"""Training of op1's network on all labelled documents, in blocks."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxspark.llm import toxicity
from voxspark.llm.langid import held_out
from voxspark.llm.scratch import Scratch


def score(net, words):
    rows = toxicity.features(words)
    z = toxicity.logits_of(net, [np.arange(len(words))], toxicity.embed(net, rows))[0]
    return 1 / (1 + np.exp(-(net.scale * z + net.shift)))


@pytest.fixture(scope="module")
def tables(spark):
    """Texts of plain words; of toxic documents the first 1,200 by the hash of their id hold one insult, the others another."""
    rng = random.Random(5)
    ids = spark.range(6000).filter(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").collect()
    toxic, rows, labels = 0, [], []
    for k, (i,) in enumerate(ids):
        words, bad = rng.choices(["wander", "lantern", "remedy", "solace", "timber", "orchard"], k=12), k % 3 == 0
        if bad:
            words[rng.randrange(12)] = "vilstrauk" if toxic < 1200 else "gnompfix"
            toxic += 1
        rows.append((i, " ".join(words), "en" if k % 2 else "de"))
        labels.append((i, int(bad)))
    assert toxic > 1400
    folder = Scratch(spark, "toxic-test-" + uuid.uuid4().hex)
    docs = folder.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "docs")
    return docs, folder.keep(spark.createDataFrame(labels, "doc_id long, toxic int"), "labels")


def test_every_labelled_document_is_learned_from(spark, tables):
    net = toxicity.train(*tables, Scratch(spark, "all"))
    plain = ["wander", "lantern", "remedy", "solace", "timber"]
    assert score(net, plain) < 0.3
    assert score(net, [*plain, "vilstrauk"]) > 0.3 and score(net, [*plain, "gnompfix"]) > 0.3


def test_blocks_give_the_same_network_in_any_order(spark, tables):
    docs, labels = tables
    one, two = (toxicity.train(docs.repartition(n, "text"), labels.repartition(n), Scratch(spark, "order"), block_docs=500, epochs=2) for n in (1, 7))
    assert np.array_equal(one.embedding, two.embedding) and all(np.array_equal(one.filters[w], two.filters[w]) for w in one.filters)
    assert (one.scale, one.shift, one.threshold, one.thresholds) == (two.scale, two.shift, two.threshold, two.thresholds)
    plain = ["wander", "lantern", "remedy", "solace", "timber"]
    assert score(one, plain) < 0.3 < min(score(one, [*plain, "vilstrauk"]), score(one, [*plain, "gnompfix"]))


def test_calibration_on_blocks_equals_that_in_memory(spark):
    rng = random.Random(8)
    scratch = Scratch(spark, "calibration")
    rows = [(i, int(rng.random() < (0.7 if i % 3 == 0 else 0.2)), ["en", "de", None][i % 7 % 3], "bad word" if i % 3 == 0 else "good word") for i in range(900)]
    rows += [(900 + i, i % 2, "fr", "good") for i in range(20)] + [(2000 + i, 0, "it", None) for i in range(100)]
    texts = spark.createDataFrame(rows, "doc_id long, label int, lang string, text string")
    blocks = scratch.keep(toxicity.blocks_of(texts, 3), "blocks")
    kept = {r["doc_id"] for r in texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).collect()}
    assert sum(len(r["labels"]) for r in blocks.collect()) == len(rows) and sum(len(r["langs"]) for r in blocks.filter("calibrates").collect()) == len(kept)

    def fresh():
        net, _ = toxicity.initial(np.zeros((2, toxicity.BUCKETS)), np.zeros(2), np.random.default_rng(1))
        return net

    found, want = fresh(), fresh()
    toxicity.calibrate_blocks(found, blocks.filter("calibrates"), scratch, least=40)
    held = [r for r in rows if r[0] in kept]
    docs, features = toxicity.encoded([r[3] for r in held])
    toxicity.calibrate(want, docs, features, np.array([r[1] for r in held]), np.ones(len(held)), [r[2] for r in held])
    assert found.scale == pytest.approx(want.scale, rel=1e-3) and found.shift == pytest.approx(want.shift, rel=1e-3)
    assert set(found.thresholds) == set(want.thresholds) == {"en", "de"}
    for lang, t in found.thresholds.items():
        z = toxicity.logits_of(found, docs, toxicity.embed(found, features))
        p = 1 / (1 + np.exp(-(found.scale * z + found.shift)))
        own = np.array([r[2] == lang for r in held])
        y = np.array([r[1] for r in held])
        f1 = lambda t: 2 * (y[own] * (p[own] >= t)).sum() / (y[own].sum() + (p[own] >= t).sum())
        assert f1(t) == pytest.approx(max(map(f1, np.arange(1001) / 1000)))
