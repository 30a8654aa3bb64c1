"""Toxicity: a convolutional text classifier, trained in numpy.

A word, its beginnings and its endings are hashed into embedding rows; their sum is the word's
embedding, so inflected and compound forms share what their stem has taught. Filters of several widths
run over the sequence of embeddings, each keeps its largest response over the whole text, and a
logistic layer weighs them. Training uses
Adagrad on minibatches; the gradient of max pooling reaches only the windows that won. All labelled
documents are learned from: they lie in blocks, in each round every block is gone through from the same
weights, and the changes are averaged, those of an embedding over the blocks that hold its feature.
Scores are calibrated to the share of toxic rows on a fifth of the documents that training does not see,
and a threshold is set for each language there. The score itself depends on the text alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .langid import held_out
from .minhash import flagged
from .scratch import Scratch
from .words import WordTable, in_blocks, map_rows, split_blocks, words_of

BUCKETS = 1 << 16
#: Row of no feature; its embedding stays zero.
PAD = 0
#: Lengths of the beginnings and endings that are features beside the whole word.
HEADS, TAILS = (3, 4, 5, 6), (3, 4, 5)
WIDTH = 1 + len(HEADS) + len(TAILS)
SCALE = np.float32(1 / np.sqrt(WIDTH))
_CORE = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
BLOCK_WORDS = 250_000
#: Documents of a block of training, at least, and bytes of text, at most, on average.
BLOCK_DOCS, BLOCK_BYTES = 2_048, 16_000_000
#: Changes of weights are added up as multiples of this part, so that their order does not matter.
PART = 2.0**-32
#: Parts of the range of logits in calibration.
BINS = 1 << 16


def runs_of(texts: pa.StringArray) -> pa.ListArray:
    """Runs of letters and digits, with single apostrophes inside them: every one has its own place in the sequence."""
    bare = pc.replace_substring_regex(texts.fill_null(""), r"[^\p{L}\p{N}'’]+|['’]['’]+", " ")
    return words_of(bare)


def core(word: str) -> str:
    """A word without case and the marks around it; empty for marks alone."""
    m = _CORE.search(word.lower())
    return m[0] if m else ""


def _row(kind: str, text: str) -> int:
    return 2 + zlib.crc32(f"{kind}{text}".encode()) % (BUCKETS - 2)


def features(words: list[str]) -> np.ndarray:
    """Embedding rows of each word, ``WIDTH`` of them; marks alone have row 1 and no other."""
    out = np.zeros((len(words), WIDTH), np.uint16)
    for k, w in enumerate(words):
        c = core(w)
        if not c:
            out[k, 0] = 1
            continue
        out[k, 0] = _row("=", c)
        for i, n in enumerate(HEADS):
            if len(c) > n:
                out[k, 1 + i] = _row("<", c[:n])
        for i, n in enumerate(TAILS):
            if len(c) > n:
                out[k, 1 + len(HEADS) + i] = _row(">", c[-n:])
    return out


@dataclass
class Network:
    """Weights. ``filters[w]`` has shape (w, dimensions, filters)."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    weight: np.ndarray
    offset: float
    # calibration: logit' = scale * logit + shift
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.3


def embed(net: Network, rows: np.ndarray) -> np.ndarray:
    """Sum of the embeddings of the features of each word."""
    return net.embedding[rows].sum(axis=1) * SCALE


def _joined(docs: list[np.ndarray], widest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sequence of all documents' word numbers with pads (-1) between, and the first and last+1 place of each."""
    pad = np.full(widest - 1, -1, np.int64)
    parts, starts, at = [pad], [], len(pad)
    for d in docs:
        starts.append(at)
        parts += [d if len(d) else np.full(1, -1, np.int64), pad]
        at += max(len(d), 1) + len(pad)
    starts = np.array(starts, dtype=np.int64)
    stops = starts + np.array([max(len(d), 1) for d in docs], dtype=np.int64)
    parts.append(np.full(1, -1, np.int64))  # so that each document's last window has one after it
    return np.concatenate(parts), starts, stops


def _convolve(net: Network, embedded: np.ndarray, width: int) -> np.ndarray:
    """Responses of the filters of one width at each place where a window begins."""
    n = len(embedded) - width + 1
    out = embedded[:n] @ net.filters[width][0]
    for k in range(1, width):
        out += embedded[k : k + n] @ net.filters[width][k]
    return out


def _forward(net: Network, docs: list[np.ndarray], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
    """Logits, pooled features, and where each maximum stands. ``vectors``: embeddings by word number, and
    last a row of zeros."""
    widest = max(net.filters)
    sequence, starts, stops = _joined(docs, widest)
    embedded = vectors[sequence]
    pooled, where = [], {}
    for width in net.filters:
        response = _convolve(net, embedded, width)
        # windows may hang over either end by width - 1 pads
        place = np.stack([a - width + 1 + response[a - width + 1 : b].argmax(axis=0) for a, b in zip(starts, stops)])
        where[width] = place
        pooled.append(np.maximum(response[place, np.arange(response.shape[1])] + net.bias[width], 0))
    features = np.concatenate(pooled, axis=1)
    return features @ net.weight + net.offset, features, {"sequence": sequence, "embedded": embedded, "where": where}


def initial(seen: np.ndarray, n: np.ndarray, rng: np.random.Generator, dimensions: int = 8, filters: int = 8, widths: tuple[int, ...] = (1, 2, 3)) -> tuple[Network, dict]:
    """A network before training, and its sums of squared gradients.

    ``seen`` has the number of documents of each label that hold a feature, ``n`` that of all. The first dimension
    starts as the shrunken log odds of a feature's documents.
    """
    embedding = rng.normal(0, 0.1, (BUCKETS, dimensions)).astype(np.float32)
    n = np.maximum(n, 1)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1.0)) - np.log((seen[0] + 0.5) / (n[0] + 1.0))
    both = seen.sum(axis=0)
    embedding[:, 0] = odds * both / (both + 10) * (both > 2)
    embedding[PAD] = 0
    net = Network(embedding, {}, {}, np.zeros(0), 0.0)
    for w in widths:
        net.filters[w] = rng.normal(0, 0.3 / np.sqrt(w * dimensions), (w, dimensions, filters)).astype(np.float32)
        net.filters[w][:, 0, : filters // 2] += 1.0 / w
        net.bias[w] = np.zeros(filters, np.float32)
    net.weight = np.abs(rng.normal(0, 0.1, filters * len(widths))).astype(np.float32)
    total = {"embedding": np.full(BUCKETS, 1e-3, np.float32), "weight": np.full_like(net.weight, 1e-3), "offset": 1e-3} | {("f", w): np.full_like(net.filters[w], 1e-3) for w in widths} | {("b", w): np.full_like(net.bias[w], 1e-3) for w in widths}
    return net, total


def count_features(seen: np.ndarray, docs: list[np.ndarray], rows: np.ndarray, labels: np.ndarray) -> None:
    """Adds to ``seen`` the documents of each label that hold a feature."""
    for d, y in zip(docs, labels):
        seen[y, np.unique(rows[np.unique(d)])] += 1


def go_through(net: Network, total: dict, docs: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, rng: np.random.Generator, batch: int = 8, rate: float = 0.04, forget: float = 0.3) -> None:
    """Changes the weights and ``total`` by all documents once, in random order, ``batch`` at a time.

    Each whole word is left out with probability ``forget``, so that its parts are learned too.
    """
    dimensions = net.embedding.shape[1]

    def move(value: np.ndarray, gradient: np.ndarray, key) -> None:
        total[key] += gradient**2
        value -= rate * gradient / np.sqrt(total[key])

    for chosen in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
        if not len(chosen):
            continue
        words, inverse = np.unique(np.concatenate([docs[i] for i in chosen]), return_inverse=True)
        used = rows[words].astype(np.int64)
        used[rng.random(len(used)) < forget, 0] = PAD
        vectors = np.vstack([embed(net, used), np.zeros((1, dimensions), np.float32)])
        logits, pooled, state = _forward(net, np.split(inverse, np.cumsum([len(docs[i]) for i in chosen])[:-1]), vectors)
        error = ((1 / (1 + np.exp(-np.clip(logits, -30, 30)))) - labels[chosen]).astype(np.float32) / len(chosen)
        back = error[:, None] * net.weight[None, :] * (pooled > 0)
        move(net.weight, pooled.T @ error + 1e-4 * net.weight, "weight")
        total["offset"] += float(error.sum()) ** 2
        net.offset -= rate * float(error.sum()) / np.sqrt(total["offset"])
        push, column = np.zeros_like(vectors), 0
        for w, f in net.filters.items():
            delta = back[:, column : column + f.shape[2]]
            column += f.shape[2]
            place = state["where"][w]
            gradient = np.empty_like(f)
            for k in range(w):
                gradient[k] = np.einsum("df,dfe->ef", delta, state["embedded"][place + k])
                np.add.at(push, state["sequence"][place + k].ravel(), (delta[:, :, None] * f[k].T[None]).reshape(-1, dimensions))
            move(f, gradient, ("f", w))
            move(net.bias[w], delta.sum(axis=0), ("b", w))
        hit = np.flatnonzero(np.abs(push[:-1]).sum(axis=1))
        parts, back_to = np.unique(used[hit].ravel(), return_inverse=True)
        change = np.zeros((len(parts), dimensions), np.float32)
        np.add.at(change, back_to.ravel(), np.repeat(push[hit] * SCALE, WIDTH, axis=0))
        total["embedding"][parts] += (change**2).mean(axis=1)
        net.embedding[parts] -= rate * change / np.sqrt(total["embedding"][parts])[:, None]
        net.embedding[PAD] = 0


def fit(docs: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, epochs: int = 4, seed: int = 7, **shape) -> Network:
    """Trains on documents of word numbers, ``rows`` holding the features of each word: one block, see ``fit_blocks``."""
    rng = np.random.default_rng(seed)
    seen = np.zeros((2, BUCKETS))
    count_features(seen, docs, rows, labels)
    net, total = initial(seen, np.bincount(labels, minlength=2)[:2], rng, **shape)
    for _ in range(epochs):
        go_through(net, total, docs, rows, labels, rng)
    return net


def logits_of(net: Network, docs: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Logits of documents of word numbers, from the embeddings of the words: the forward pass without places."""
    widest = max(net.filters)
    stacked = np.concatenate([f.transpose(1, 0, 2).reshape(f.shape[1], -1) for f in net.filters.values()], axis=1)
    padded = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
    parts = []
    for a, b in in_blocks(docs, len, BLOCK_WORDS):
        sequence, starts, stops = _joined(docs[a:b], widest)
        answers, column, pooled = padded[sequence] @ stacked, 0, []
        for width, f in net.filters.items():
            n, many = len(sequence) - width + 1, f.shape[2]
            response = answers[:n, column : column + many]
            for k in range(1, width):
                response = response + answers[k : k + n, column + k * many : column + (k + 1) * many]
            column += width * many
            # the windows of a document, from those that hang over its start on; between documents lie pads
            edges = np.stack([starts - width + 1, stops], axis=1).ravel()
            best = np.maximum.reduceat(response, edges, axis=0)[::2]
            pooled.append(np.maximum(best + net.bias[width], 0))
        parts.append(np.concatenate(pooled, axis=1) @ net.weight + net.offset)
    return np.concatenate(parts) if parts else np.zeros(0)


def logistic(z: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of logits by weighted logistic regression."""
    scale, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
        v = weight * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(weight * (p - labels) * z).sum() + 0.1 * (scale - 1), (weight * (p - labels)).sum() + 0.01 * shift])
        h = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        scale, shift = scale - float(np.clip(step[0], -1, 1)), shift - float(np.clip(step[1], -3, 3))
    return max(scale, 0.05), shift


def calibrate(net: Network, docs: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, weight: np.ndarray, langs: list[str | None], least: int = 40) -> None:
    """Fits scale and shift by weighted logistic regression, then a threshold for each language with at
    least ``least`` rows and both labels; others take the one of all rows. Thresholds give the best F1."""
    z = logits_of(net, docs, embed(net, rows))
    net.scale, net.shift = logistic(z, labels, weight)
    p = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -30, 30)))

    def best(chosen: np.ndarray) -> float:
        scores, y, w = p[chosen], labels[chosen], weight[chosen]
        grid = np.unique(np.round(np.concatenate([scores, [0.3]]), 3))
        f1 = [2 * (w * y * (scores >= t)).sum() / max((w * y).sum() + (w * (scores >= t)).sum(), 1e-9) for t in grid]
        # of thresholds that are as good, the one nearest to the common cut
        return float(min(grid[np.array(f1) >= max(f1) - 1e-9], key=lambda t: abs(t - 0.3)))

    everything = np.arange(len(labels))
    net.threshold = best(everything) if len(set(labels.tolist())) == 2 else 0.3
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([i for i, x in enumerate(langs) if x == lang])
        if len(own) >= least and len(set(labels[own].tolist())) == 2:
            net.thresholds[lang] = best(own)


def labelled(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, label, lang, text`` of all documents that may be learned from, a row for each id.

    Ids that are held out are left out, and so are null ids and labels other than 0 and 1. Of the rows of one id the
    least text stands, and the greatest label. Only texts whose id may have a label are shuffled.
    """
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    usable = scratch.keep(usable.groupBy(F.col("doc_id").alias("wanted")).agg(F.max("toxic").cast("int").alias("label")), "labels")
    perhaps = flagged(docs.select("doc_id", "text", "lang"), usable).filter("flag").drop("flag")
    met = perhaps.join(usable, F.col("doc_id") == F.col("wanted")).groupBy("doc_id", "label").agg(F.min(F.struct("text", "lang")).alias("t"))
    return scratch.keep(met.select("doc_id", "label", "t.lang", "t.text"), "texts")


def encoded(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """The texts as numbers of words, and the features of each word."""
    split = runs_of(pa.array(texts, pa.string()))
    coded = split.flatten().dictionary_encode()
    number: dict[str, int] = {}
    of = np.array([number.setdefault(core(w), len(number)) for w in coded.dictionary.to_pylist()], dtype=np.int64)
    words = of[coded.indices.to_numpy()]
    at = split.offsets.to_numpy() - split.offsets[0].as_py()
    return [words[a:b] for a, b in zip(at, at[1:])], features(list(number))


def blocks_of(texts: DataFrame, n_blocks: int) -> DataFrame:
    """The rows of ``labelled`` as blocks of word numbers, a row for each; a fifth of the documents calibrates.

    ``calibrates, block``, and as bytes ``labels`` (int8), ``lengths`` (int64), ``words`` (int32) and ``features``
    (uint16, of each word); ``langs`` of documents that calibrate. A hash of the id alone tells a document's block.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        docs, rows = encoded(frame["text"].tolist())
        lengths = np.array([len(d) for d in docs], np.int64)
        langs = frame["lang"].tolist() if key[0] else []
        packed = (frame["label"].to_numpy(np.int8), lengths, np.concatenate(docs).astype(np.int32), rows)
        return pd.DataFrame([(*key, *[x.tobytes() for x in packed], langs)], columns=["calibrates", "block", "labels", "lengths", "words", "features", "langs"])

    fifth = (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("calibrates")
    block = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(n_blocks)).cast("int").alias("block")
    schema = "calibrates boolean, block int, labels binary, lengths binary, words binary, features binary, langs array<string>"
    return texts.select(fifth, block, "doc_id", "label", "lang", "text").groupBy("calibrates", "block").applyInPandas(run, schema)


def unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray, list]]:
    """Block, documents of word numbers, features of words, labels and languages of each row of ``blocks_of``."""
    for frame in frames:
        for block, labels, lengths, words, rows, langs in zip(*[frame[c] for c in ("block", "labels", "lengths", "words", "features", "langs")]):
            docs = np.split(np.frombuffer(words, np.int32).astype(np.int64), np.cumsum(np.frombuffer(lengths, np.int64))[:-1])
            yield block, docs, np.frombuffer(rows, np.uint16).reshape(-1, WIDTH), np.frombuffer(labels, np.int8).astype(np.int64), list(langs)


def _pack(net: Network, total: dict) -> np.ndarray:
    """All weights and sums as rows of one matrix: those of each embedding, then the others."""
    pairs = [(net.weight, total["weight"]), *[(f, total["f", w]) for w, f in net.filters.items()], *[(b, total["b", w]) for w, b in net.bias.items()]]
    rest = np.concatenate([[net.offset, total["offset"]], *[np.ravel(x) for pair in pairs for x in pair]])
    across = net.embedding.shape[1] + 1
    rest = np.pad(rest, (0, -len(rest) % across)).reshape(-1, across)
    return np.vstack([np.column_stack([net.embedding, total["embedding"]]), rest]).astype(np.float32)


def _unpack(state: np.ndarray, like: Network) -> tuple[Network, dict]:
    """The network and sums of ``_pack``, of the shape of ``like``."""
    rest, at = state[BUCKETS:].ravel(), 2

    def take(shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        nonlocal at
        n = int(np.prod(shape))
        found = [rest[at + k * n : at + (k + 1) * n].reshape(shape).copy() for k in (0, 1)]
        at += 2 * n
        return found[0], found[1]

    net = Network(state[:BUCKETS, :-1].copy(), {}, {}, np.zeros(0), float(rest[0]))
    total = {"embedding": state[:BUCKETS, -1].copy(), "offset": float(rest[1])}
    net.weight, total["weight"] = take(like.weight.shape)
    for w, f in like.filters.items():
        net.filters[w], total["f", w] = take(f.shape)
    for w, b in like.bias.items():
        net.bias[w], total["b", w] = take(b.shape)
    return net, total


def fit_blocks(blocks: DataFrame, n: np.ndarray, epochs: int = 4, seed: int = 7, **shape) -> Network:
    """Trains on all of ``blocks`` (``blocks_of``), ``n`` documents of each label.

    In each round tasks go through their blocks once, every block from the same weights, and a weight moves by the mean
    of its changes in the blocks that change it. What a task returns, and the driver gets, is as large as the network.
    """
    spark = blocks.sparkSession

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, BUCKETS), np.int64)
        for _, docs, rows, labels, _ in unpacked(frames):
            count_features(seen, docs, rows, labels)
        at = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"place": at, "clean": seen[0, at], "toxic": seen[1, at]})

    counts = blocks.mapInPandas(count, "place long, clean long, toxic long").groupBy("place").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    seen = np.zeros((2, BUCKETS))
    seen[:, counts["place"].to_numpy()] = counts["clean"].to_numpy(), counts["toxic"].to_numpy()
    like, total = initial(seen, n, np.random.default_rng(seed), **shape)
    state = _pack(like, total)
    columns = [f"c{k}" for k in range(state.shape[1])]
    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast((state, like))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state, like = shared.value
            change, times = np.zeros(state.shape, np.int64), np.zeros(len(state), np.int64)
            for block, docs, rows, labels, _ in unpacked(frames):
                net, total = _unpack(state, like)
                go_through(net, total, docs, rows, labels, np.random.default_rng([seed, epoch, block]))
                step = _pack(net, total).astype(np.float64) - state
                change += np.rint(step / PART).astype(np.int64)
                times += step.any(axis=1)
            at = np.flatnonzero(times)
            yield pd.DataFrame({"place": at, "times": times[at]} | {c: change[at, k] for k, c in enumerate(columns)})

        moved = blocks.mapInPandas(run, "place long, times long, " + ", ".join(f"{c} long" for c in columns))
        moved = moved.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("times", *columns)]).toArrow()
        place, change = moved["place"].to_numpy(), np.column_stack([moved[c].to_numpy() for c in columns])
        state[place] = state[place] + change * PART / moved["times"].to_numpy()[:, None]
        shared.unpersist()
    return _unpack(state, like)[0]


def calibrate_blocks(net: Network, blocks: DataFrame, scratch: Scratch, least: int = 40) -> None:
    """``calibrate`` on all documents of ``blocks``: scale and shift from the numbers of logits in ``BINS`` parts of their
    range, thresholds from those of scores by thousandths of each language."""
    shared = blocks.sparkSession.sparkContext.broadcast(net)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, docs, rows, labels, langs in unpacked(frames):
            z = logits_of(shared.value, docs, embed(shared.value, rows))
            yield pd.DataFrame({"lang": langs, "label": labels, "z": np.clip(z, -30, 30)})

    logits = scratch.keep(blocks.mapInPandas(run, "lang string, label int, z double"), "logits")
    low, high = logits.agg(F.min("z"), F.max("z")).first()
    if low is None:
        return
    width = max((high - low) / BINS, 1e-12)
    bins = logits.groupBy(F.rint((F.col("z") - low) / width).alias("bin"), "label").agg(F.count(F.lit(1)).alias("n")).orderBy("bin", "label").toArrow()
    net.scale, net.shift = logistic(bins["bin"].to_numpy() * width + low, bins["label"].to_numpy(), bins["n"].to_numpy().astype(float))

    score = 1 / (1 + F.exp(-(F.col("z") * net.scale + net.shift)))
    scored = logits.select("lang", "label", F.floor(score * 1000).cast("int").alias("bin"))
    # of each language and of all, beside the bins that occur that of the common cut
    each = scored.filter("lang is not null").withColumn("whole", F.lit(False)).unionAll(scored.select(F.lit("").alias("lang"), "label", "bin", F.lit(True).alias("whole")))
    counts = each.groupBy("whole", "lang", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"))
    cut = counts.select("whole", "lang").distinct().select("whole", "lang", F.lit(300).alias("bin"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("toxic"))
    counts = counts.unionAll(cut).groupBy("whole", "lang", "bin").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    over, every = Window.partitionBy("whole", "lang").orderBy(F.desc("bin")), Window.partitionBy("whole", "lang")
    rated = counts.select("whole", "lang", "bin", F.sum("n").over(over).alias("above"), F.sum("toxic").over(over).alias("hits"), F.sum("n").over(every).alias("n"), F.sum("toxic").over(every).alias("toxic"))
    rated = rated.filter((F.col("toxic") > 0) & (F.col("toxic") < F.col("n")) & (F.col("whole") | (F.col("n") >= least)))
    # of thresholds that are as good, the one nearest to the common cut
    rank = F.struct(F.round(2 * F.col("hits") / (F.col("toxic") + F.col("above")), 9), -F.abs(F.col("bin") - 300), -F.col("bin"))
    for r in rated.groupBy("whole", "lang").agg((F.max_by("bin", rank) / 1000).alias("threshold")).collect():
        if r["whole"]:
            net.threshold = r["threshold"]
        else:
            net.thresholds[r["lang"]] = r["threshold"]
    shared.unpersist()


def constant(n: np.ndarray) -> Network:
    """A network that gives all texts the smoothed share of toxic ones among ``n`` documents of each label."""
    p = (n[1] + 0.5) / (n.sum() + 10.0)
    return Network(np.zeros((BUCKETS, 1), np.float32), {1: np.zeros((1, 1, 1), np.float32)}, {1: np.zeros(1, np.float32)}, np.zeros(1, np.float32), float(np.log(p / (1 - p))))


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES, **options) -> Network:
    """Fits to all of ``docs`` (doc_id, text, lang) that ``labels`` (doc_id, toxic) mark, leaving out held-out ids.

    Whole texts count; a fifth of the documents calibrates. With one label only, or none, all scores are that label's
    smoothed share.
    """
    texts = labelled(docs, labels, scratch)
    fifth = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    found = texts.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(~fifth).alias("fit"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")).collect()
    n, learned = np.zeros(2, np.int64), np.zeros(2, np.int64)
    for r in found:
        n[r["label"]], learned[r["label"]] = r["n"], r["fit"]
    if not n.all():
        return constant(n)
    # of few documents a block would take too few steps
    n_blocks = max(int(learned.sum()) // block_docs, -(-sum(r["bytes"] for r in found) // block_bytes), 1)
    blocks = scratch.keep(blocks_of(texts, n_blocks), "blocks")
    scratch.free(blocks)
    net = fit_blocks(blocks.filter("not calibrates"), learned, **options)
    calibrate_blocks(net, blocks.filter("calibrates"), scratch)
    return net


def train_on(sample: list[tuple], share: dict[int, int], **options) -> Network:
    """``train`` on a few rows ``(doc_id, toxic, lang, text)`` in memory; ``share`` has the number of rows of each label in the whole."""
    sample = sorted(sample, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    data, rows = encoded([text for *_, text in sample])
    y = np.array([r[1] for r in sample], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return constant(np.bincount(y, minlength=2))
    held = np.arange(len(y)) % 5 == 0
    net = fit([d for d, h in zip(data, held) if not h], rows, y[~held], **options)
    weight = np.array([share[int(v)] for v in y]) / np.bincount(y)[y]
    weight /= weight.mean()
    calibrate(net, [d for d, h in zip(data, held) if h], rows, y[held], weight[held], [r[2] for r, h in zip(sample, held) if h])
    return net


def classify(docs: DataFrame, net: Network, cut: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted, lang_threshold, flagged`` for each row of ``docs`` (doc_id, text, lang).

    ``predicted`` is 1 from a score of ``cut`` on, ``flagged`` from the threshold of the row's language on.
    Whole texts count; null and empty texts are scored as one word without letters. Repeated rows,
    other columns and empty tables do no harm.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few MB, whatever the input

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        table = WordTable(lambda words: embed(net, features(words)))
        for frame in frames:
            for part, words in split_blocks(frame, runs_of):
                rows, values = table.look_up(words)
                z = logits_of(net, rows, values)
                score = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -30, 30)))
                limit = np.array([net.thresholds.get(x, net.threshold) for x in part["lang"]])
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": score, "predicted": (score >= cut).astype(np.int32), "lang_threshold": limit, "flagged": (score >= limit).astype(np.int32)})

    return map_rows(docs.select("doc_id", "text", "lang"), run, "doc_id long, score double, predicted int, lang_threshold double, flagged int")
