"""Tables of words, kept by a Python worker while it goes through its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class WordTable:
    """Gives each distinct word a row of features, worked out once while the table lasts.

    ``features(words)`` returns an array with a row for each word. When the table holds more than ``limit``
    words it keeps those of the block at hand, so memory is bounded whatever the input and frequent words
    stay; results do not depend on it. ``names`` has the word of each row.
    """

    def __init__(self, features: Callable[[list], np.ndarray], limit: int = 100_000):
        self.features, self.limit = features, limit
        self.rows: dict = {}
        self.names: list = []
        self.values: np.ndarray | None = None

    def look_up(self, split: pa.ListArray) -> tuple[list[np.ndarray], np.ndarray]:
        """The rows of the words of each text, and the features by row."""
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.rows) > self.limit:
            self.names = [w for w in distinct if w in self.rows]
            self.values = self.values[[self.rows[w] for w in self.names]]
            self.rows = {w: i for i, w in enumerate(self.names)}
        new = [w for w in distinct if w not in self.rows]
        if new or self.values is None:
            made = self.features(new)
            self.rows.update(zip(new, range(len(self.names), len(self.names) + len(new))))
            self.names += new
            self.values = made if self.values is None else np.concatenate([self.values, made])
        row = np.fromiter(map(self.rows.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        return [row[a:b] for a, b in zip(at, at[1:])], self.values


def words_of(texts: pa.StringArray) -> pa.ListArray:
    """Runs of characters other than space and U+0009 to U+000D; none for null."""
    return _without_empty(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.fill_null(""))))


def unicode_words_of(texts: pa.StringArray) -> pa.ListArray:
    """Runs of characters other than white space of any kind; none for null."""
    return _without_empty(pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts.fill_null(""))))


def _without_empty(split: pa.ListArray) -> pa.ListArray:
    """A text without words gives one empty word: it has none."""
    flat, at = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    solid = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if solid.all():
        return split
    before = np.concatenate([[0], np.cumsum(solid)])
    return pa.ListArray.from_arrays(pa.array(before[at], pa.int32()), flat.filter(pa.array(solid)))


def in_blocks(items: list, size: Callable[[object], int], most: int) -> Iterable[tuple[int, int]]:
    """Bounds of runs of ``items`` whose sizes add up to about ``most``; a larger item stands alone."""
    start, total = 0, 0
    for i, item in enumerate(items):
        n = size(item)
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(items):
        yield start, len(items)


#: Characters of text that a task splits into words at a time.
BLOCK_CHARS = 2_000_000


def split_blocks(frame: pd.DataFrame, split: Callable[[pa.StringArray], pa.ListArray] = words_of, column: str = "text") -> Iterable[tuple[pd.DataFrame, pa.ListArray]]:
    """Blocks of rows of ``frame`` with their texts split into words; null texts have none."""
    texts = frame[column].tolist()
    for a, b in in_blocks([0 if t is None else len(t) for t in texts], int, BLOCK_CHARS):
        yield frame.iloc[a:b], split(pa.array(texts[a:b], pa.string()))
        pa.default_memory_pool().release_unused()  # workers share an executor's memory with the JVM


def mix64(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit integers (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def map_rows(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` on rows with a ``doc_id``, which goes there and back as text: beside a null one, pandas would
    make floating-point numbers of the others."""
    made = df.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, schema.replace("doc_id long", "doc_id string"))
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))
