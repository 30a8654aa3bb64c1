"""Language identification by segmentation-marginalised unigram models.

Each language has probabilities for the pieces of a fixed public vocabulary. The probability of a
word is the sum over all ways to cut it into pieces, by the forward algorithm; a text's is the
product over its words. The piece probabilities come from expectation-maximisation over all
segmentations of the words of a labelled sample: its word counts are gathered once, and each
iteration sums expected piece counts on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import WordTable, in_blocks, map_rows, mix64, split_blocks

UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: Longer words have probabilities too small for a double; their sums are made of logarithms.
PLAIN_LETTERS = 30
#: Letters of the words that are worked on at once.
BLOCK_LETTERS = 60_000
#: Probability of a character that no piece covers.
UNKNOWN = 1e-9
_MARK = "▁"


@dataclass
class Vocabulary:
    """Pieces as sorted hashes, so that all substrings of many words are looked up together."""

    pieces: list[str]
    hashes: np.ndarray
    rows: np.ndarray
    longest: int

    @classmethod
    def of_sentencepiece(cls, path: str) -> Vocabulary:
        """The pieces of a public model that can stand in lower-case words, with the mark of a word's start."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        fit = {p for p in names if p and LETTERS.fullmatch(p.removeprefix(_MARK) or "a") and p == p.lower()}
        return cls.of(sorted(fit))

    @classmethod
    def of(cls, pieces: list[str]) -> Vocabulary:
        keys = np.array([hash_run(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(keys)
        return cls(pieces, keys[order], order.astype(np.int64), max(map(len, pieces), default=1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        return np.where(self.hashes[at] == keys, self.rows[at], -1)


def hash_run(text: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in text:
        h = mix64(h + np.uint64(ord(c) + 1))
    return int(h[0])


Lattice = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


def lattice(vocabulary: Vocabulary, words: list[str]) -> Lattice:
    """For words of one length: by start and end, which of them have a piece there, and its row; the mark is character 0."""
    n = len(words[0]) + 1
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n - 1)
    codes = np.concatenate([np.full((len(words), 1), ord(_MARK), np.uint32), letters], axis=1).astype(np.uint64) + np.uint64(1)
    found = {}
    for i in range(n):
        h = np.zeros(len(words), np.uint64)
        for j in range(i + 1, min(n, i + vocabulary.longest) + 1):
            h = mix64(h + codes[:, j - 1])
            rows = vocabulary.find(h)
            at = np.flatnonzero(rows >= 0)
            if len(at):
                found[i, j] = at, rows[at]
    return found


def _sums(found: Lattice, n: int, shape: tuple[int, ...], probability: dict[tuple[int, int], np.ndarray], longest: int) -> list[np.ndarray]:
    """Sums over all segmentations of each prefix of words of ``n`` characters."""
    alpha = [np.ones(shape)]
    for j in range(1, n + 1):
        total = alpha[j - 1] * UNKNOWN
        for i in range(max(0, j - longest), j):
            if (i, j) in found:
                at = found[i, j][0]
                total[at] += alpha[i][at] * probability[i, j]
        alpha.append(total)
    return alpha


def _spans(vocabulary: Vocabulary, word: str) -> np.ndarray:
    """Row of the piece at each start and of each length less one in a marked word, or -1."""
    codes = np.frombuffer((_MARK + word).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    h, out = np.zeros(len(codes), np.uint64), np.full((len(codes), vocabulary.longest), -1, np.int64)
    for k in range(min(vocabulary.longest, len(codes))):
        h = mix64(h[: len(codes) - k] + codes[k:])
        out[: len(codes) - k, k] = vocabulary.find(h)
    return out


def _log_sums(spans: np.ndarray, logs: Callable[[np.ndarray], np.ndarray], models: int, ahead: bool = True) -> np.ndarray:
    """Logarithms of the sums over all segmentations of each prefix of a long word, or, not ``ahead``, of what follows each place."""
    n, longest = spans.shape
    out = np.zeros((n + 1, models))
    for k in range(1, n + 1):
        step = np.arange(1, min(longest, k) + 1)
        at, other = (k, k - step) if ahead else (n - k, n - k + step)
        row = spans[other if ahead else at, step - 1]
        real = row >= 0
        ways = np.concatenate([out[other[:1]] + np.log(UNKNOWN), out[other[real]] + logs(row[real])])
        top = ways.max(axis=0)
        out[at] = top + np.log(np.exp(ways - top).sum(axis=0))
    return out


def _reversed(found: Lattice, n: int) -> Lattice:
    """The lattice of the words read backwards."""
    return {(n - j, n - i): v for (i, j), v in found.items()}


def runs_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return LETTERS.findall(text.lower())


def _long(words: list[str]) -> list[int]:
    return [k for k, w in enumerate(words) if len(w) >= PLAIN_LETTERS]


def _groups(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words of one length, in blocks, but for long ones."""
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if len(w) < PLAIN_LETTERS:
            groups.setdefault(len(w), []).append(k)
    for n, places in groups.items():
        step = max(1, BLOCK_LETTERS // (n + 1))
        for a in range(0, len(places), step):
            yield np.array(places[a : a + step])


def log_probabilities(vocabulary: Vocabulary, probability: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word (a run of letters) under each model."""
    out = np.zeros((len(words), probability.shape[1]))
    for part in _groups(words):
        n = len(words[part[0]]) + 1
        found = lattice(vocabulary, [words[k] for k in part])
        given = {key: probability[rows] for key, (_, rows) in found.items()}
        out[part] = np.log(_sums(found, n, (len(part), probability.shape[1]), given, vocabulary.longest)[-1])
    for k in _long(words):
        out[k] = _log_sums(_spans(vocabulary, words[k]), lambda rows: np.log(probability[rows]), probability.shape[1])[-1]
    return out


def expected_counts(vocabulary: Vocabulary, probability: np.ndarray, words: list[str], model: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the words, each under its own model and counted ``weight`` times; pieces x models."""
    models = probability.shape[1]
    places, uses = [np.zeros(0, np.int64)], [np.zeros(0)]
    for part in _groups(words):
        n, which, times = len(words[part[0]]) + 1, model[part], weight[part]
        found = lattice(vocabulary, [words[k] for k in part])
        given = {(i, j): probability[rows, which[at]] for (i, j), (at, rows) in found.items()}
        back = {(n - j, n - i): v for (i, j), v in given.items()}
        alpha = _sums(found, n, (len(part),), given, vocabulary.longest)
        beta = _sums(_reversed(found, n), n, (len(part),), back, vocabulary.longest)[::-1]
        for (i, j), (at, rows) in found.items():
            places.append(rows * models + which[at])
            uses.append(alpha[i][at] * given[i, j] * beta[j][at] / alpha[n][at] * times[at])
    for k in _long(words):
        spans, own = _spans(vocabulary, words[k]), int(model[k])
        logs = lambda rows, own=own: np.log(probability[rows, own])[:, None]
        alpha, beta = (_log_sums(spans, logs, 1, ahead)[:, 0] for ahead in (True, False))
        i, length = np.nonzero(spans >= 0)
        rows = spans[i, length]
        places.append(rows * models + own)
        uses.append(np.exp(alpha[i] + logs(rows)[:, 0] + beta[i + length + 1] - alpha[-1]) * weight[k])
    return np.bincount(np.concatenate(places), np.concatenate(uses), probability.size).reshape(probability.shape)


@dataclass
class Model:
    """Languages and the probability of each piece under each of them."""

    vocabulary: Vocabulary
    languages: list[str]
    probability: np.ndarray


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, scratch: Scratch, vocabulary_path: str, per_language: int = 1500, iterations: int = 4) -> Model:
    """Fits a model to ``docs`` (doc_id, text, lang), leaving out held-out ids and null languages.

    ``per_language`` bounds the sample: it is the number of documents of a language expected in it,
    chosen by a hash of the id; their whole texts count. The driver receives one number for each piece and
    language. Without labelled text the model has no languages and calls everything undetermined.
    """
    labelled = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    # as a table of known size it is broadcast, and no text is shuffled
    counts = scratch.keep(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "counts")
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000))
    sample = labelled.join(counts.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of")).filter(draw * F.col("n") < per_language * 1_000_000)

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b in in_blocks(frame["text"].tolist(), len, 2_000_000):
                part = frame.iloc[a:b]
                made = pd.DataFrame({"lang": part["lang"], "word": [runs_of(t) for t in part["text"]]}).explode("word").dropna()
                yield made.groupby(["lang", "word"], as_index=False).size().rename(columns={"size": "n"})

    gathered = scratch.keep(sample.select("text", "lang").mapInPandas(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(2 * docs.sparkSession.sparkContext.defaultParallelism), "words")
    vocabulary = Vocabulary.of_sentencepiece(vocabulary_path)
    languages = sorted(r["lang"] for r in gathered.select("lang").distinct().collect())
    models = len(languages)
    # long pieces start lower, so that no cut is favoured only for having fewer of them
    start = np.array([0.1 ** len(p) for p in vocabulary.pieces])
    probability = np.repeat(start[:, None] / max(start.sum(), 1e-300), models, axis=1)
    number = {lang: i for i, lang in enumerate(languages)}
    context = docs.sparkSession.sparkContext
    pieces = context.broadcast(vocabulary)  # that of one public model
    for _ in range(iterations if models else 0):
        given = context.broadcast(probability)  # a number for each piece and language

        def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(given.value.shape)
            for frame in frames:
                total += expected_counts(pieces.value, given.value, frame["word"].tolist(), frame["lang"].map(number).to_numpy(), frame["n"].to_numpy(np.float64))
            piece, model = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "model": model, "n": total[piece, model]})

        sums = gathered.mapInPandas(step, "piece long, model long, n double").groupBy("piece", "model").agg(F.sum("n").alias("n")).toPandas()
        counted = np.zeros(probability.shape)
        counted[sums["piece"], sums["model"]] = sums["n"]
        counted += 0.01
        probability = counted / counted.sum(axis=0)
    return Model(vocabulary, languages, probability)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, n_letters, mean_log`` for each row of ``docs`` (doc_id, text).

    ``score`` is the posterior of the language found, all languages being as likely beforehand.
    Null texts and texts without a letter are ``und`` with score 0. Ties go to the language that sorts
    first. ``mean_log`` is the log probability per letter under that language. Whole texts are scored, words of any
    length too; repeated rows, other columns and empty tables do no harm.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer_of(shared.value)
        for frame in frames:
            yield score(frame["doc_id"], frame["text"])

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, n_letters long, mean_log double")


def scorer_of(model: Model) -> Callable[[pd.Series, pd.Series], pd.DataFrame]:
    """What scores texts in a Python worker, with a table of the words it has met."""
    vocabulary, languages, probability = model.vocabulary, model.languages, model.probability

    def features(words: list[str]) -> np.ndarray:
        runs, owner, letters = [], [], np.zeros(len(words))
        for k, w in enumerate(words):
            for r in runs_of(w):
                runs.append(r)
                owner.append(k)
                letters[k] += len(r)
        out = np.zeros((len(words), len(languages) + 1))
        if runs:
            logs = log_probabilities(vocabulary, probability, runs)
            np.add.at(out[:, :-1], np.array(owner), logs)
        out[:, -1] = letters
        return out

    table = WordTable(features)

    def score(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        made = []
        for part, words in split_blocks(pd.DataFrame({"id": ids.array, "text": texts.array})):
            rows, values = table.look_up(words)
            made.append(_decide(part["id"], [values[r].sum(axis=0) for r in rows], languages))
        return pd.concat(made) if made else _decide(ids, [], languages)

    return score


def _decide(ids: pd.Series, sums: list[np.ndarray], languages: list[str]) -> pd.DataFrame:
    total = np.array(sums).reshape(len(sums), len(languages) + 1)
    logs, letters = total[:, :-1], total[:, -1]
    known = (letters > 0) & bool(languages)
    if languages:
        best = logs.argmax(axis=1)
        top = logs[np.arange(len(logs)), best]
        score = 1.0 / np.exp(logs - top[:, None]).sum(axis=1)
        names = np.array(languages, dtype=object)[best]
    else:
        top, score, names = np.zeros(len(logs)), np.zeros(len(logs)), np.full(len(logs), UNDETERMINED, dtype=object)
    return pd.DataFrame(
        {
            "doc_id": ids.to_numpy(),
            "lang_pred": np.where(known, names, UNDETERMINED),
            "score": np.where(known, score, 0.0),
            "n_letters": letters.astype(np.int64),
            "mean_log": np.where(known, top / np.maximum(letters, 1), 0.0),
        }
    )


def filtered(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is found with a posterior of ``least`` or more, a null ``lang`` filled in.

    Texts are scored where they are read: no join brings scores and rows together.
    """
    at = docs.columns.index("lang")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer_of(shared.value)
        for batch in batches:
            texts = pd.Series(batch.column("text").to_pylist(), dtype=object)
            found = score(texts, texts)
            names = [n if x is None else x for x, n in zip(batch.column("lang").to_pylist(), found["lang_pred"])]
            good = (found["lang_pred"].to_numpy() != UNDETERMINED) & (found["score"].to_numpy() >= least)
            field = batch.schema.field(at)
            yield batch.set_column(at, field, pa.array(names, type=field.type)).filter(pa.array(good, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
