"""Quality classification by compression.

Two zstandard dictionaries are built from blocks of good and of bad labelled texts. A text is
compressed block by block with either; good text is smaller with the good dictionary. The difference of
the sizes over their sum, which counts for more in longer texts, and the size over that of the plain text
(repeated lines shrink to nothing with any dictionary) are turned into a probability by logistic regression on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import labelled_texts
from .scratch import Scratch
from .words import map_rows

#: Bytes of a block. A dictionary helps at the start of what is compressed; further on a text has its own past.
BLOCK = 1024
LEVEL = 3
#: What ``evidence`` tells of a text.
FEATURES = 4
#: Bytes of a dictionary at most, and of its training texts for each byte of it.
DICTIONARY, TRAINING = 112_640, 100


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """Dictionaries of bad and of good text, and the logistic function of what they tell."""

    dictionaries: list[bytes]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for raw in self.dictionaries:
            words = zstandard.ZstdCompressionDict(raw) if raw else None
            if words is not None:
                words.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False))
        return made


def blocks(text: str | None) -> list[bytes]:
    """The UTF-8 bytes of a text in blocks; none for null and empty texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[a : a + BLOCK] for a in range(0, len(raw), BLOCK)]


def sizes(compressors: list[zstandard.ZstdCompressor], texts: list[str | None]) -> np.ndarray:
    """Bytes of each text as compressed with each dictionary, and plain."""
    out = np.zeros((len(texts), len(compressors) + 1), np.int64)
    for k, text in enumerate(texts):
        for block in blocks(text):
            for c, compressor in enumerate(compressors):
                out[k, c] += len(compressor.compress(block))
            out[k, -1] += len(block)
    return out


def evidence(size: np.ndarray) -> np.ndarray:
    """A constant; the normalised difference (bad - good) / (bad + good), plain and times the logarithm of the size; and
    the logarithm of the compressed share. Without text there is no difference."""
    bad, good, plain = size.astype(float).T
    difference = 100 * (bad - good) / np.maximum(bad + good, 1)
    share = np.log((bad + good + 1) / (2 * plain + 1))
    return np.stack([np.ones(len(size)), difference, difference * np.log1p(bad + good) / 10, share], axis=1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(sample: list[tuple], share: dict[int, int]) -> Model:
    """Fits to rows ``(doc_id, label, lang, text)``; ``share`` has the number of ids of each label in the whole.

    Three quarters of the ids, by a checksum, give the dictionaries, the others the calibration. Without
    both labels the dictionaries are empty and every score is the smoothed share of label 1.
    """
    good = sum(n for y, n in share.items() if y == 1)
    odds = np.log((good + 0.5) / (sum(share.values()) - good + 0.5))
    flat = Model([b"", b""], np.array([odds] + [0.0] * (FEATURES - 1)))
    order = sorted(sample, key=lambda r: (zlib.crc32(f"quality {r[0]}".encode()), r[0]))
    seen = [r for i, r in enumerate(order) if i % 4]
    apart = [r for i, r in enumerate(order) if not i % 4]
    if {r[1] for r in seen} != {0, 1} or {r[1] for r in apart} != {0, 1}:
        return flat
    model = Model([_dictionary([r[3] for r in seen if r[1] == y]) for y in (0, 1)])
    x = evidence(sizes(model.compressors(), [r[3] for r in apart]))
    y = np.array([r[1] for r in apart], float)
    weight = np.array([share[r[1]] for r in apart]) / np.bincount(y.astype(int))[y.astype(int)]
    model.weights = _regression(x, y, weight / weight.mean(), flat.weights)
    return model


def _dictionary(texts: list[str | None]) -> bytes:
    """A dictionary of blocks dealt from all texts; empty where they are too few to build one."""
    made = sorted((b for t in texts for b in blocks(t)), key=zlib.crc32)
    total, chosen = 0, []
    for b in made:
        if total > DICTIONARY * TRAINING:
            break
        chosen.append(b)
        total += len(b)
    for size in (DICTIONARY, total // 4, total // 16):
        try:
            return zstandard.train_dictionary(size, chosen, level=LEVEL).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too little text for this size
            continue
    return b""


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weighted logistic regression by Newton's method, with a penalty on all but the constant."""
    w, pull = start.copy(), np.diag([1e-6] + [ridge] * (len(start) - 1))
    for _ in range(50):
        p = logistic(x @ w)
        gradient = x.T @ (weight * (p - y)) + pull @ w
        step = np.linalg.solve((x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x + pull, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, most_good: int = 2000, most_bad: int = 2000, most_bytes: int = 32_000_000) -> Model:
    """Fits to ``docs`` (doc_id, text, lang) and ``labels`` (doc_id, quality), leaving out held-out ids.

    The sample has at most ``most_good`` and ``most_bad`` ids and ``most_bytes`` of text, see ``labelled_texts``.
    """
    return fit(*labelled_texts(docs, labels, "quality", held_out(F.col("doc_id")), scratch, {1: most_good, 0: most_bad}, most_bytes))


def classify(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted, good_bytes, bad_bytes`` for each row of ``docs`` (doc_id, text).

    ``score`` is the probability of label 1, ``predicted`` is 1 from ``cut`` on; the bytes are those of the text as
    compressed with either dictionary. Whole texts count, in blocks, so a very long one needs no more memory than
    itself. Null and empty texts tell nothing and get the score of no difference; repeated rows and null ids are
    scored like others; other columns and empty tables do no harm.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compressors = shared.value.compressors()
        for frame in frames:
            size = sizes(compressors, frame["text"].tolist())
            score = logistic(evidence(size) @ shared.value.weights)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": score, "predicted": (score >= cut).astype(np.int32), "good_bytes": size[:, 1], "bad_bytes": size[:, 0]})

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int, good_bytes long, bad_bytes long")
