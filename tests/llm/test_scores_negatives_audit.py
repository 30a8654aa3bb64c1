"""Quality scores, hard negatives and the divergence audit against held-out labels and brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxspark.llm import divergence, negatives, quality, queries
from voxspark.llm.scratch import Scratch

SF = "/root/testdata/sf0.01"
CLASHING = ", one string, n long, d long, g int, counts string, p long, q long, rank int, part string, value long, item string, size long, kept long, terms long, slice int, place int"


@pytest.fixture(scope="module")
def scratch(spark):
    return Scratch(spark, "tests-new")


def with_clashes(spark, rows, schema):
    extra = ("x", 1, 1, 1, "c", 1, 1, 1, "p", 1, "i", 1, 1, 1, 1, 1)
    return spark.createDataFrame([(*r, *extra) for r in rows], schema + CLASHING)


# --- quality ---------------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    out = queries.op11_quality_zstd(spark, SF)
    assert out.columns[:3] == ["doc_id", "score", "predicted"] and out.count() == docs.count()
    rows = out.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    good, bad = [r for r in held if r["quality"] == 1], [r for r in held if r["quality"] == 0]
    assert len(bad) > 5
    assert np.mean([r["predicted"] for r in good]) >= 0.97 and np.mean([r["predicted"] for r in bad]) <= 0.2


def test_quality_sizes_are_those_of_whole_texts():
    rng = random.Random(2)
    sample = [(i, i % 2, "en", " ".join(rng.choices([f"{'good' if i % 2 else 'bad'}{k}" for k in range(300)], k=300))) for i in range(80)]
    model = quality.fit(sample, {0: 40, 1: 40})
    compressors = model.compressors()
    text = " ".join(t for *_, t in sample)
    whole = quality.sizes(compressors, [text])[0]
    raw = text.encode()
    assert whole.tolist() == [*(sum(len(c.compress(raw[a : a + quality.BLOCK])) for a in range(0, len(raw), quality.BLOCK)) for c in compressors), len(raw)]
    score = quality.logistic(quality.evidence(quality.sizes(compressors, [" ".join(f"good{k}" for k in range(200)), " ".join(f"bad{k}" for k in range(200))])) @ model.weights)
    assert score[0] > 0.5 > score[1]


def test_quality_learns_nothing_from_held_out_rows(spark, scratch):
    docs = spark.createDataFrame([(i, ("fine words here " if i % 2 else "zz## ") * 40, "en") for i in range(120)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, x, scratch) for x in (labels, turned))
    assert a.dictionaries == b.dictionaries and a.weights.tolist() == b.weights.tolist()


@pytest.mark.parametrize("empty", [False, True])
def test_quality_of_odd_rows(spark, scratch, empty):
    rows = [] if empty else [(1, None, None), (2, "", "en"), (None, "some text", "en"), (3, "퟿ \n" * 3, "de"), (4, "word " * 200_000, "en"), (4, "word " * 200_000, "en"), (5, "a", "fr")]
    docs = with_clashes(spark, rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([] if empty else [(1, 1), (4, 0), (4, 1), (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    out = quality.classify(docs, quality.train(docs, labels, scratch)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (1, 2)}) <= 1


# --- hard negatives ----------------------------------------------------------------------------------------


def brute_negatives(rows):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        one = (label, [math.floor(256 * x) for x in v])
        kept[i] = min(one, kept.get(i, one))
    out = []
    for a, (label, q) in kept.items():
        if a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, other)), i, own) for i, (own, other) in kept.items() if i != a))
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            fit = [r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s]
            out += [(a, p, k, i, -s, -n) for k, (n, i, _) in enumerate(fit[:10], 1)]
    return sorted(out)


def mined(df, scratch):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in negatives.hard_negatives(df, scratch).select(*columns).collect())


def test_negatives_equal_brute_force_on_ties_repeats_and_odd_rows(spark, scratch, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 64)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 2)
    monkeypatch.setattr(negatives, "BATCH_BYTES", 2 * 2 * 12 * 8)  # several batches of anchors
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.4, (4, 12))
    rows = [(int(i), (centres[i % 4] + rng.normal(0, 0.2, 12)).astype(np.float32).tolist(), int(i % 3)) for i in range(700)]
    rows += [(1000 + i, rows[100][1], int(i % 2)) for i in range(150)]  # one vector often
    rows += [(100, rows[5][1], 0), (7, None, 1), (9_000, [0.1] * 12, None), (9_100, [float("nan")] * 12, 1), (9_200, [None] + [0.5] * 11, 1), (9_300, [float("-inf")] * 12, 1), (None, [0.5] * 12, 1), (9_400, [], 1), (9_500, [0.0] * 12, 2), (-100, [-0.3] * 12, -5), (-700, [0.2] * 5, 3)]
    df = with_clashes(spark, rows, "vec_id long, embedding array<float>, label int").repartition(5)
    # a shorter vector counts as if zeros followed it
    assert mined(df, scratch) == brute_negatives(rows)


def test_no_vectors_and_vectors_beyond_a_long(spark, scratch):
    schema = "vec_id long, embedding array<float>, label int"
    assert mined(spark.createDataFrame([], schema), scratch) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], schema), scratch) == []
    with pytest.raises(ArithmeticError):
        mined(spark.createDataFrame([(100, [1e30, 1.0], 1)], schema), scratch)


def test_a_scan_reads_only_columns_that_may_still_count():
    rng = np.random.default_rng(1)
    columns = rng.integers(-200, 200, (64, 500)).astype(float)
    anchor = rng.integers(-200, 200, 64).astype(float)
    scores = anchor @ columns
    scan = negatives.Scan(columns, columns.min(axis=1), columns.max(axis=1), anchor)
    for low, high in ((np.sort(scores)[-5], scores.max()), (0, 1000), (scores.max() + 1, 1e15)):
        chosen, found = scan.scores(None, low, high)
        want = np.flatnonzero((scores >= low) & (scores <= high))
        assert chosen.tolist() == want.tolist() and found.tolist() == scores[want].tolist()


# --- divergence --------------------------------------------------------------------------------------------


def brute_audit(rows, least=3, most=200):
    docs = [tuple(x or "" for x in r) for r in rows]
    uses, found = Counter(), Counter()
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
        uses.update((lang, source, t) for t in terms)
        found.update((lang, t) for t in set(terms))
    out = []
    for lang in {d[1] for d in docs}:
        kept = [t for (own, t), n in found.items() if own == lang and n >= least]
        sources = {d[2] for d in docs if d[1] == lang}
        size = {s: sum(uses[lang, s, t] for t in kept) for s in sources}
        p = {s: [1 + 10**9 * (uses[lang, s, t] + 1) // (size[s] + len(kept)) for t in kept] for s in sources}
        whole = [1 + 10**9 * (sum(uses[lang, s, t] for s in sources) + 1) // (sum(size.values()) + len(kept)) for t in kept]
        for s in sources:
            pairs = [(-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o.encode(), o) for o in sources - {s}]
            terms = [(-((a - b) ** 2 // b), t.encode(), t) for a, b, t in zip(p[s], whole, kept) if uses[lang, s, t] and a > b]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, s, part, i, -v, k) for k, (v, _, i) in enumerate(items, 1)]
    return sorted(out)


def audited(df, scratch, **options):
    return sorted(tuple(r) for r in divergence.audit(df, scratch, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_equals_brute_force(spark, scratch, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_ROWS", 40)
    monkeypatch.setattr(divergence, "HELD_ROWS", 100)
    rng = random.Random(4)
    words = [f"{a}{b}é{'' if k else 'X'}" for k in range(2) for a in "abcdefghij" for b in "klmnopqr"] + ["中文", "ÄÖ", " nbsp", "　wide", "İx", "ẞ"]
    rows = [(" ".join(rng.choices(words[: rng.randrange(5, len(words))], k=rng.randrange(0, 60))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s2", "s2", None, "", "😀"])) for _ in range(150)]
    rows += [(None, "en", "silent"), ("", "en", "silent"), ("12 34 !?", "fr", "a"), ("only once", "fr", "b"), (None, None, None), ("word,Word;WORD\x00word-\x7fword " * 20_000, "en", "long")] + [("same text here",) + ("en", "s1")] * 3
    df = with_clashes(spark, rows, "text string, lang string, source string").repartition(4)
    assert audited(df, scratch) == brute_audit(rows)
    assert audited(df, scratch, least_docs=1, most_terms=7) == brute_audit(rows, 1, 7)


def test_audit_of_nothing(spark, scratch):
    assert audited(spark.createDataFrame([], "text string, lang string, source string"), scratch) == []
    assert audited(spark.createDataFrame([(None, None, None)], "text string, lang string, source string"), scratch) == []


def test_runs_and_their_intersection():
    ends = np.array([0, 2, 3, 7, 8, 12])
    x = divergence.runs(np.array([1, 2]), np.array([5, 5]), ends)
    y = divergence.runs(np.array([0, 2, 3]), np.array([1, 4, 4]), ends)
    assert [a.tolist() for a in x] == [[2, 7, 12], [0, 5, 0]] and [a.tolist() for a in y] == [[2, 3, 8, 12], [1, 0, 4, 0]]
    length, i, j = divergence.intersected(x, y)
    assert list(zip(length.tolist(), x[1][i].tolist(), y[1][j].tolist())) == [(2, 0, 1), (1, 5, 0), (4, 5, 4), (1, 0, 4), (4, 0, 0)]


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_source_divergence"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(con.execute(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall())
